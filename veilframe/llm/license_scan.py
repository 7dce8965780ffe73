"""Licence scan: normalized passages against licence templates by the Dice coefficient over word bigrams.

A passage is a line, a paragraph (between lines without a word), the whole text, or a run: as many words as the template
has, wherever in the text, so that line ends, comment signs and what stands around a notice don't matter. Runs are laid so
that a marker word of the text falls on a place that the template has it. The Dice coefficient of a passage with a template
is twice the bigrams shared over all bigrams of both, each counted once. Two bounds prune candidates, and both keep all
matches: sizes that differ too much can't reach the threshold, and a match must hold one of the template's marker words,
without which too few of its bigrams are left. Everything is an expression over the document's own row; templates are
literals.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_templates import TEMPLATES
from .quality_rules import STOP_WORDS

THRESHOLD = 0.8


@dataclass(frozen=True)
class Template:
    number: int
    license: str
    bigrams: tuple[str, ...]
    least: int
    most: int
    markers: tuple[str, ...]
    words: tuple[str, ...]

    def places(self) -> dict[str, list[int]]:
        """Where in the template each marker word stands."""
        return {m: [i for i, w in enumerate(self.words) if w == m] for m in self.markers}


def _words(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def compiled(templates: Sequence[tuple[str, str]], threshold: float) -> list[Template]:
    """Bigrams of each template, the sizes that can reach the threshold, and words one of which a match must hold."""
    out = []
    for number, (license_, text) in enumerate(templates):
        words = _words(text)
        bigrams = tuple(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))
        if not bigrams:
            raise ValueError(f"a template of {license_} has fewer than two words")
        n = len(bigrams)
        # 2 s / (m + n) >= t and s <= min(m, n) bound m, and s from below.
        least, most = math.ceil(threshold * n / (2 - threshold) - 1e-9), math.floor(n * (2 - threshold) / threshold + 1e-9)
        left, markers = list(bigrams), []
        # Longest words first, common ones last among equals: so markers are rare in other text.
        for word in sorted(set(words), key=lambda w: (-len(w), w in STOP_WORDS.split(), w)):
            if len(left) < least:
                break
            markers.append(word)
            left = [b for b in left if word not in b.split(" ")]
        out.append(Template(number, license_, bigrams, least, most, tuple(markers), tuple(words)))
    return out


def _normalized(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _bigrams(words: Column) -> Column:
    """Distinct bigrams of a list of words, which is a variable or a column: it is looked into at every place."""
    pairs = F.transform(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.concat_ws(" ", F.get(words, i), w))
    return F.array_distinct(pairs)


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per row of ``docs``: the id, ``licenses`` (names found, sorted, joined by commas), ``n_matches``, ``best_dice``
    (6 digits, null without a match) and ``matches``: passage (its kind and number), template, license and dice of each
    distinct passage and template at or above the threshold, sorted. Of a template's runs only the best counts, the first of
    equals (its number is that of its first word), and none where another passage matches the template.

    Null, empty and other texts without a match have an empty list. Rows stay as they are, repeated ones included.
    """
    table = compiled(templates, threshold)
    markers = "|".join(sorted({m for t in table for m in t.markers}))
    marker = rf"(?<![\p{{L}}\p{{N}}])(?:{markers})(?![\p{{L}}\p{{N}}])"
    text = F.col(text_col)
    numbered = lambda parts, kind: F.transform(
        parts, lambda p, i: F.struct(F.lit(kind).alias("kind"), i.alias("no"), _normalized(p).alias("words"))
    )
    lines, paragraphs = F.split(text, "\n", -1), F.split(text, r"\n(?:[ \t\r\x0b\f]*\n)+", -1)
    passages = F.concat(
        numbered(lines, "line"),
        F.when(F.size(paragraphs) > 1, numbered(paragraphs, "paragraph")).otherwise(F.array().cast("array<struct<kind:string,no:int,words:string>>")),
        F.when(F.size(lines) > 1, numbered(F.array(text), "text")).otherwise(F.array().cast("array<struct<kind:string,no:int,words:string>>")),
    )
    # Texts without any marker word are done here.
    some = F.when(F.rlike(F.lower(text), F.lit(marker)), F.filter(passages, lambda p: F.rlike(p["words"], F.lit(marker))))
    split = F.transform(some, lambda p: F.struct(p["kind"].alias("kind"), p["no"].alias("no"), F.split(p["words"], " ").alias("words")))
    sized = F.transform(split, lambda p: F.struct(p["kind"].alias("kind"), p["no"].alias("no"), _bigrams(p["words"]).alias("bigrams")))

    def match(bigrams: Column, t: Template, kind: Column, no: Column) -> Column:
        n = F.size(bigrams)
        shared = F.size(F.array_intersect(bigrams, F.array(*[F.lit(b) for b in t.bigrams])))
        dice = F.when(n.between(t.least, t.most), F.round(2.0 * shared / (n + len(t.bigrams)), 6))
        return F.when(
            dice >= threshold, F.struct(kind.alias("kind"), no.alias("no"), F.lit(t.number).alias("template"), F.lit(t.license).alias("license"), dice.alias("dice"))
        )

    none = F.array().cast("array<struct<kind:string,no:int,template:int,license:string,dice:double>>")
    found = F.flatten(F.transform(F.col("__passages"), lambda p: F.array(*[match(p["bigrams"], t, p["kind"], p["no"]) for t in table])))

    def run(t: Template) -> Column:
        """The template's best run."""
        at = F.create_map(*[x for m, places in t.places().items() for x in (F.lit(m), F.array(*[F.lit(p) for p in places]))])
        starts = F.flatten(F.transform(F.col("__marked"), lambda h: F.transform(F.coalesce(F.try_element_at(at, h["w"]), F.array().cast("array<int>")), lambda o: F.greatest(h["i"] - o, F.lit(0)))))

        def tried(s: Column) -> Column:
            words = F.slice("__words", s + 1, F.lit(len(t.words)))
            # The words are looked into at every place, so they are bound once.
            return F.get(F.transform(F.array(words), lambda ws: match(_bigrams(ws), t, F.lit("run"), s)), 0)

        hits = F.filter(F.transform(F.array_distinct(starts), tried), lambda m: m.isNotNull())
        best = F.array_max(F.transform(hits, lambda m: F.struct(m["dice"].alias("d"), (-m["no"]).alias("n"), m.alias("m"))))["m"]
        return F.when(~F.exists("__found", lambda m: m["template"] == t.number), best)

    # All of this is for texts with a marker word only.
    words = F.when(F.rlike(F.lower(text), F.lit(marker)), F.split(_normalized(text), " "))
    all_markers = F.array(*[F.lit(m) for m in sorted({m for t in table for m in t.markers})])
    marked = F.filter(F.transform("__words", lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda h: F.array_contains(all_markers, h["w"]))
    slim = docs.select(F.col(id_col), sized.alias("__passages"), words.alias("__words"))
    slim = slim.select(id_col, "__words", marked.alias("__marked"), F.coalesce(F.filter(found, lambda m: m.isNotNull()), none).alias("__found"))
    runs = F.when(F.size("__marked") > 0, F.filter(F.array(*[run(t) for t in table]), lambda m: m.isNotNull()))
    out = slim.select(id_col, F.sort_array(F.concat("__found", F.coalesce(runs, none))).alias("matches"))
    return out.select(
        id_col,
        F.array_join(F.sort_array(F.array_distinct(F.transform("matches", lambda m: m["license"]))), ",").alias("licenses"),
        F.size("matches").cast("bigint").alias("n_matches"),
        F.array_max(F.transform("matches", lambda m: m["dice"])).alias("best_dice"),
        "matches",
    )
