"""Detector rules: a pattern plus optional digit limits and checksum, compiled to one SQL expression."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.checksums import business_no_checksum, digits_of, luhn, rrn_checksum
from ..functions.dialect import to_java
from ..functions.matching import search, spans
from ..functions.sqltext import let, literal

MATCHES = "array<struct<category:string,start:int,end:int,matched:string,confidence:double>>"


def _possible(text: str, needs_regex: str | None, needs_text: tuple[str, ...]) -> str:
    tests = []
    if needs_regex is not None:
        tests.append(f"rlike({text}, {literal(needs_regex)})")
    if needs_text:
        tests.append("(" + " OR ".join(f"contains({text}, {literal(t)})" for t in needs_text) + ")")
    return " AND ".join(tests) if tests else f"{text} IS NOT NULL"


@dataclass(frozen=True)
class Rule:
    """``pattern`` is a Java regular expression.

    ``group`` is what to report of a match, and must be what a match ends with. ``validator`` gives SQL that
    tells from SQL for a match's digits whether they are valid. ``needs_regex`` and ``needs_text`` (any of
    several substrings) are cheap, unanchored conditions that hold wherever there is a match; texts that fail
    one are not searched. ``needs_run`` is a condition of this kind on a run of six digits or more with single separators,
    for rules whose matches hold such a run; a line's runs are found once for all rules. ``utf16`` is set when the pattern's repeat limits can span characters above U+FFFF.
    """

    category: str
    pattern: str
    group: int = 0
    min_digits: int | None = None
    max_digits: int | None = None
    validator: Callable[[str], str] | None = None
    conf_ok: float = 1.0
    conf_fail: float = 0.5
    needs_regex: str | None = None
    needs_text: tuple[str, ...] = ()
    needs_run: str | None = None
    utf16: bool = False

    def possible(self, text: str) -> str:
        return _possible(text, self.needs_regex, self.needs_text)

    def search(self, text: str, runs: str) -> str:
        hit = search(text, self.pattern, self.group, self.utf16, category=literal(self.category))
        if self.needs_run is None:
            return f"if({self.possible(text)}, {hit}, null)"
        return f"if(rlike({runs}, {literal(self.needs_run)}) AND {_possible(text, None, self.needs_text)}, {hit}, null)"

    def accepts(self, digits: str) -> str:
        low, high = self.min_digits or 0, self.max_digits or 2**31 - 1
        return f"length({digits}) BETWEEN {low} AND {high}"

    def confidence(self, digits: str) -> str:
        if self.validator is None:
            return f"double({self.conf_ok})"
        return f"if({self.validator(digits)}, double({self.conf_ok}), double({self.conf_fail}))"


@dataclass(frozen=True)
class PandasRule:
    """Escape hatch for detection that no regular expression expresses.

    ``scan`` maps a text to (start, end, confidence) in characters; it runs in Arrow batches.
    """

    category: str
    scan: Callable[[str], Iterable[tuple[int, int, float]]]
    needs_regex: str | None = None
    needs_text: tuple[str, ...] = ()

    def possible(self, text: str) -> str:
        return _possible(text, self.needs_regex, self.needs_text)

    def found(self, text: str | None) -> list[dict]:
        spans = () if text is None else self.scan(text)
        return [{"category": self.category, "start": s, "end": e, "matched": text[s:e], "confidence": float(c)} for s, e, c in spans if text[s:e]]

    def matches(self, text: Column) -> Column:
        @F.pandas_udf(MATCHES)
        def run(texts: pd.Series) -> pd.Series:
            return texts.map(self.found)

        return run(text)


def python_matches(text: Column, rules: Iterable[PandasRule]) -> Column:
    """An array of MATCHES for each line of a page, null for a null page; texts go to Python once for all the rules."""
    rules = tuple(rules)

    @F.pandas_udf(f"array<{MATCHES}>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [[m for r in rules for m in r.found(line)] for line in t.split("\n")])

    # Called so, it stays a step of its own: inside the expressions that use its result it could not be run.
    return run.asNondeterministic()(text)


AnyRule = Rule | PandasRule

# An e-mail match starts where a run of local-part characters starts or where the last match ended. Saying
# so changes no match and keeps the search linear on long runs without an @.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))" + V.EMAIL

# Six digits with at most one separator between neighbours: every number detector needs at least that.
_DIGIT_RUN = to_java(r"\d(?:[\s-]?\d){5}")
_DIGIT_RUNS = to_java(r"\d(?:[\s-]?\d){5,}")
_HANGUL = "[가-힣]"
PROVINCES = tuple(V.ADDRESS.split("(?:")[1].split(")")[0].split("|"))
_PROVINCE_STARTS = tuple(dict.fromkeys(name[:2] for name in PROVINCES))

EMAIL = Rule("email", to_java(_EMAIL), conf_ok=V.CONFIDENCE["email"], needs_text=("@",))
PHONE = Rule(
    "phone",
    to_java(V.PHONE),
    min_digits=V.PHONE_DIGITS[0],
    max_digits=V.PHONE_DIGITS[1],
    conf_ok=V.CONFIDENCE["phone"],
    needs_regex=_DIGIT_RUN,
    needs_run=to_java(r"(?:0|1[016789])(?:[\s-]?\d){7}"),
)
RRN = Rule(
    "rrn",
    to_java(V.RRN),
    validator=rrn_checksum,
    conf_ok=V.CHECKSUM_PASS,
    conf_fail=V.CHECKSUM_FAIL,
    needs_regex=_DIGIT_RUN,
    needs_run=to_java(r"\d{6}-?\d{7}"),
)
CARD = Rule(
    "card",
    to_java(V.CARD),
    min_digits=V.CARD_DIGITS[0],
    max_digits=V.CARD_DIGITS[1],
    validator=luhn,
    conf_ok=V.CHECKSUM_PASS,
    conf_fail=V.CHECKSUM_FAIL,
    needs_regex=_DIGIT_RUN,
    needs_run=to_java(r"\d(?:[ -]?\d){12}"),
)
BUSINESS_NO = Rule(
    "businessNo",
    to_java(V.BUSINESS_NO),
    validator=business_no_checksum,
    conf_ok=V.CHECKSUM_PASS,
    conf_fail=V.CHECKSUM_FAIL,
    needs_regex=_DIGIT_RUN,
    needs_run=to_java(r"\d{3}-?\d{2}-?\d{5}"),
)
ACCOUNT = Rule(
    "account",
    to_java(V.ACCOUNT),
    group=2,
    conf_ok=V.CONFIDENCE["account"],
    needs_regex=_DIGIT_RUN,
    needs_text=("계좌", "입금", "예금주"),
    needs_run=to_java(r"\d"),
    utf16=True,
)
ADDRESS = Rule(
    "address",
    to_java(V.ADDRESS),
    conf_ok=V.CONFIDENCE["address"],
    needs_regex=_HANGUL,
    needs_text=_PROVINCE_STARTS,
    utf16=True,
)

_BUILT_IN = {r.category: r for r in (EMAIL, PHONE, RRN, CARD, BUSINESS_NO, ACCOUNT, ADDRESS)}
ALL_RULES: tuple[AnyRule, ...] = tuple(_BUILT_IN[c] for c in V.RULE_ORDER)


def register_rule(rule: AnyRule, rules: Iterable[AnyRule] = ALL_RULES) -> tuple[AnyRule, ...]:
    """A new rule set with ``rule`` added last, or in place of the rule of the same category."""
    rules = tuple(rules)
    if any(r.category == rule.category for r in rules):
        return tuple(rule if r.category == rule.category else r for r in rules)
    return (*rules, rule)


def pick_rules(*categories: str) -> tuple[AnyRule, ...]:
    return tuple(_BUILT_IN[c] for c in categories)


def any_possible(text: str, rules: Iterable[AnyRule]) -> str:
    """False only where no rule can match; a condition that several rules share is tested once."""
    return " OR ".join(dict.fromkeys(f"({r.possible(text)})" for r in rules))


def native_matches(text: str, rules: Iterable[Rule]) -> str:
    """SQL for MATCHES of all the rules, in rule order; overlaps are kept.

    Every rule only searches; offsets, digit limits and confidences are worked out once, for whatever was found.
    """
    rules = tuple(rules)
    hits = "array(" + ", ".join(r.search(text, "_runs") for r in rules) + ")"
    if any(r.needs_run is not None for r in rules):
        hits = let("_runs", f"array_join(regexp_extract_all({text}, {literal(_DIGIT_RUNS)}, 0), '|')", hits)
    found = f"flatten(transform(filter({hits}, _h -> _h IS NOT NULL), _h -> {spans('_h', 'category')}))"

    def by_category(value: Callable[[Rule], str]) -> str:
        branches = " ".join(f"WHEN {literal(r.category)} THEN {value(r)}" for r in rules)
        return f"CASE _m.s.category {branches} END"

    # Digits are taken out once, for whoever looks at them.
    counted = [r for r in rules if r.min_digits is not None or r.max_digits is not None or r.validator is not None]
    digits = digits_of("_s.matched")
    if len(counted) < len(rules):
        digits = f"if(_s.category IN ({', '.join(literal(r.category) for r in counted) or 'null'}), {digits}, '')"
    found = f"transform({found}, _s -> named_struct('s', _s, 'd', {digits}))"
    limited = [r for r in rules if r.min_digits is not None or r.max_digits is not None]
    if limited:
        kept = " ".join(f"WHEN {literal(r.category)} THEN {r.accepts('_m.d')}" for r in limited)
        found = f"filter({found}, _m -> CASE _m.s.category {kept} ELSE true END)"
    score = by_category(lambda r: r.confidence("_m.d"))
    one = (
        "named_struct('category', _m.s.category, 'start', _m.s.start, 'end', _m.s.end, 'matched', _m.s.matched, "
        f"'confidence', {score})"
    )
    return f"transform({found}, _m -> {one})"


def all_matches(text: str, rules: Iterable[AnyRule]) -> Column:
    """MATCHES column of native and Python rules."""
    rules = tuple(rules)
    native = tuple(r for r in rules if isinstance(r, Rule))
    parts = [F.expr(native_matches(text, native)).cast(MATCHES)] if native else []
    parts += [r.matches(F.col(text)) for r in rules if isinstance(r, PandasRule)]
    return parts[0] if len(parts) == 1 else F.concat(*parts)
