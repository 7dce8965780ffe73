"""Quality rules: a table of thresholds compiled into one projection, without user functions.

Every measure is an expression over the document's own row, so the operator is a scan with neither shuffle nor Python.
Work is n log n in a text's length: word triples are hashed once, and only texts in which some triple comes twice sort
their triples to find the words covered.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

# Common words of the four languages of the corpus.
STOP_WORDS = (
    "the and of to in a is that for it was on are as with be by this from or an at "
    "der die das und in zu den von mit ist des im für auf dem ein eine sich als auch "
    "le la les de des et un une en que est pour dans par sur au du il elle pas avec "
    "el los las y en un una del que se por con para su al es lo no como"
)
SYMBOLS = "#*$%&|<>"
N_SHORT, WINDOW = 50, 3


@dataclass(frozen=True)
class Rule:
    """A document fails when ``measure``, an SQL expression over the base columns, is outside [low, high]."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None

    def failed(self) -> Column:
        value = F.expr(self.measure).cast("double")
        out = F.lit(False)
        if self.low is not None:
            out = out | (value < self.low)
        if self.high is not None:
            out = out | (value > self.high)
        return F.coalesce(out, F.lit(False))


# A ratio whose divisor is 0 is null and fails no rule; texts without words fail the base rule anyway.
RULES = (
    Rule("mean_word_length", "word_chars / nullif(n_words, 0)", 2.0, 12.0),
    Rule("symbols_per_word", "n_symbols / nullif(n_words, 0)", None, 0.1),
    Rule("stop_word_ratio", "n_stop_words / nullif(n_words, 0)", 0.04, None),
    Rule("duplicate_line_ratio", "n_dup_lines / nullif(n_lines, 0)", None, 0.4),
    Rule("exclamations_per_word", "n_exclamations / nullif(n_words, 0)", None, 0.2),
)


FEW = 32


def _triples(words: Column) -> Column:
    """Hashes of all runs of three words, in order."""
    hashes = F.transform(
        F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)),
        lambda i: F.xxhash64(*[F.get(words, i - 1 + k) for k in range(WINDOW)]),
    )
    return F.when(F.size(words) > WINDOW, hashes).otherwise(F.array().cast("array<bigint>"))


def _repeated(triples: Column, sorted_triples: Column) -> Column:
    """The hashes found twice or more, each once; null where there is none."""
    again = F.filter(sorted_triples, lambda x, i: F.coalesce(F.get(sorted_triples, i - 1) == x, F.lit(False)))
    return F.when(F.size(F.array_distinct(triples)) < F.size(triples), F.array_distinct(again))


def _places(triples: Column, repeated: Column) -> Column:
    """Where repeated triples start, ascending. Few hashes are looked for one by one; many are brought next to each
    other by sorting (hash, place). Both give the same places."""
    at = F.transform(triples, lambda h, i: F.struct(h.alias("h"), i.alias("at")))
    ranked = F.array(F.sort_array(at))
    same = lambda s, x, i: F.coalesce(F.get(s, i)["h"] == x["h"], F.lit(False))
    by_sort = F.flatten(F.transform(ranked, lambda s: F.filter(s, lambda x, i: same(s, x, i - 1) | same(s, x, i + 1))))
    by_search = F.filter(at, lambda x: F.array_contains(repeated, x["h"]))
    found = F.when(F.size(repeated) <= FEW, by_search).otherwise(by_sort)
    return F.when(repeated.isNotNull(), F.sort_array(F.transform(found, lambda x: x["at"])))


def _covered(places: Column) -> Column:
    """Words in the triples at ``places``: how far each is from the next, three at most."""
    steps = F.transform(places, lambda at, i: F.least(F.lit(WINDOW), F.coalesce(F.get(places, i + 1) - at, F.lit(WINDOW))))
    return F.coalesce(F.aggregate(steps, F.lit(0).cast("bigint"), lambda total, x: total + x), F.lit(0).cast("bigint"))


def measures(docs: DataFrame, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` and the base columns of every row. A null text has no word and no line; an empty one has no word."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    stop = list(dict.fromkeys(STOP_WORDS.split()))
    filled = "[^\\x20\\x09-\\x0D]"
    # Column names with two underscores in front are taken by nobody else: what the input has besides is not carried.
    split = docs.select(
        *[F.col(c) for c in keep],
        text.alias("__text"),
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("__words"),
        F.filter(F.split(text, "\n", -1), lambda line: F.rlike(line, F.lit(filled))).alias("__lines"),
    )
    words, lines, triples = F.col("__words"), F.col("__lines"), F.col("__triples")
    split = split.withColumn("__triples", _triples(words)).withColumn("__sorted", F.sort_array(triples))
    split = split.withColumn("__repeated", _repeated(triples, F.col("__sorted")))
    split = split.withColumn("__places", _places(triples, F.col("__repeated")))
    # Zero. Spark does not push conditions below a row number: they would take copies of all of this along, many times over.
    once = F.least(F.monotonically_increasing_id(), F.lit(0))
    n_of = lambda chars: (F.length("__text") - F.length(F.translate("__text", chars, ""))).cast("bigint")
    return split.select(
        *[F.col(c) for c in keep],
        F.size(words).cast("bigint").alias("n_words"),
        F.length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
        n_of(SYMBOLS).alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        (_covered(F.col("__places")) + once).alias("n_repeat_words"),
        F.size(lines).cast("bigint").alias("n_lines"),
        F.size(F.filter(words, lambda w: F.lower(w).isin(stop))).cast("bigint").alias("n_stop_words"),
        n_of("!").alias("n_exclamations"),
    )


def quality_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Measures and verdict of every row: ``keep``, the base columns, ``base_failed``, ``failed_rules`` (names, in the
    table's order, joined by commas) and ``kept``.

    One row per input row, repeated rows and null ids included. Null and empty texts have no word and so fail the base
    rule. ``keep`` names the input columns to carry; the others may have any name.
    """
    base = measures(docs, text_col, keep)
    base_failed = (F.col("n_words") < N_SHORT) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    failed = F.concat_ws(",", *[F.when(r.failed(), F.lit(r.name)) for r in rules])
    return base.select(
        "*",
        base_failed.alias("base_failed"),
        failed.alias("failed_rules"),
        (~base_failed & (failed == "")).alias("kept"),
    )
