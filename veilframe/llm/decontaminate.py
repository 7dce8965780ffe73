"""Benchmark decontamination by pigeonhole edit matching.

A test item within ``k`` edits of a passage, cut into k + 1 pieces, leaves at least one piece untouched. So all pieces of
all items are looked for at once, exactly; each hit names a window of the text where the item would have to be, and the
window is verified with Myers' bit-parallel edit distance.

The items are a stated query set. They go to the tasks in blocks of bounded size, one narrow pass over the documents for
each block; documents are neither shuffled nor joined, and a task holds one batch of them.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stacked
from .common import row_key
from .tokens import per_worker

EDITS_PER_CHAR = 0.08
MAX_BLOCK_CHARS = 1_000_000


def normalized(text: Column | str) -> Column:
    """Lower case, every run of other characters than letters and digits one space, a space at both ends."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def budget(length: int, edits_per_char: float) -> int:
    return int(length * edits_per_char)


class Myers:
    """Edit distances of a pattern to all ends of a text, a column of the table in one integer."""

    def __init__(self, pattern: str):
        self.length = len(pattern)
        self.where: dict[str, int] = defaultdict(int)
        for i, c in enumerate(pattern):
            self.where[c] |= 1 << i
        self.where.default_factory = None

    def distances(self, text: str, anchored: bool = False) -> Iterator[int]:
        """After each character: the least distance of the pattern to what ends there (anchored: to all so far)."""
        full, top, score = (1 << self.length) - 1, 1 << self.length - 1, self.length
        plus, minus, get = full, 0, self.where.get
        for c in text:
            equal = get(c, 0)
            steady = equal | minus
            across = (((equal & plus) + plus) ^ plus) | equal
            up, down = minus | (full & ~(across | plus)), plus & across
            if up & top:
                score += 1
            elif down & top:
                score -= 1
            up, down = (up << 1 | anchored) & full, (down << 1) & full
            plus, minus = down | (full & ~(steady | up)), up & steady
            yield score


class Matcher:
    """Finds a block of normalized items in normalized texts."""

    def __init__(self, items: Sequence[str], edits_per_char: float):
        self.items = items
        self.budgets = [budget(len(x), edits_per_char) for x in items]
        pieces: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, (item, k) in enumerate(zip(items, self.budgets)):
            cuts = [len(item) * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                pieces[item[a:b]].append((n, b))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, places)
        self.automaton.make_automaton()

    def search(self, text: str) -> list[tuple[int, int, int, int]]:
        """Item, distance, start and end of the closest passage, of every item within its budget."""
        starts: dict[int, set[int]] = defaultdict(set)
        for end, places in self.automaton.iter(text):
            for n, upto in places:
                starts[n].add(end + 1 - upto)
        out = []
        for n, found in sorted(starts.items()):
            item, k = self.items[n], self.budgets[n]
            forward, best = Myers(item), (k + 1, 0)
            for a, b in self._windows(sorted(found), len(item), k, len(text)):
                for at, d in enumerate(forward.distances(text[a:b]), a + 1):
                    if d < best[0]:
                        best = d, at
            if best[0] <= k:
                d, end = best
                back = Myers(item[::-1]).distances(text[max(0, end - len(item) - k) : end][::-1], anchored=True)
                out.append((n, d, end - next(size for size, x in enumerate(back, 1) if x == d), end))
        return out

    @staticmethod
    def _windows(starts: list[int], length: int, k: int, size: int) -> Iterator[tuple[int, int]]:
        """Where an item that starts within k of one of ``starts`` can lie; windows that overlap are one."""
        a = b = None
        for s in starts:
            low, high = max(0, s - k), min(size, s + length + k)
            if b is not None and low <= b:
                b = max(b, high)
                continue
            if b is not None:
                yield a, b
            a, b = low, high
        if b is not None:
            yield a, b


def _matcher(items: tuple[str, ...], edits_per_char: float) -> Matcher:
    return per_worker("matcher", (items, edits_per_char), lambda: Matcher(items, edits_per_char))


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """Ids, normalized texts and the texts' keys; items without a letter or digit can't be found and are left out."""
    items = benchmark.select(F.col(item_col).alias("item"), normalized(text_col).alias("text")).where("length(text) > 2")
    k1, k2 = row_key("text")
    return items.select("item", "text", k1.alias("k1"), k2.alias("k2"))


def blocks(items: DataFrame, max_chars: int) -> Iterator[tuple[list[tuple[int, int]], tuple[str, ...]]]:
    """Keys and texts of the distinct items, a bounded number of characters at a time; an item over the bound is a block
    of its own."""
    every = items.select("text", "k1", "k2").distinct()
    texts = every.where(F.length("text") <= max_chars)
    total = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    n = 2 * total // max_chars + 1
    while True:
        at = F.pmod(F.xxhash64("text", F.lit(n)), F.lit(n))
        sizes = dict(tuple(r) for r in texts.groupBy(at.alias("at")).agg(F.sum(F.length("text"))).collect())
        if max(sizes.values(), default=0) <= max_chars:
            break
        n *= 2
    for k in sorted(sizes):
        rows = texts.where(at == k).orderBy("text").collect()
        yield [(r.k1, r.k2) for r in rows], tuple(r.text for r in rows)
    long = every.where(F.length("text") > max_chars)
    for k1, k2 in sorted(tuple(r) for r in long.select("k1", "k2").collect()):
        yield [(k1, k2)], (long.where((F.col("k1") == k1) & (F.col("k2") == k2)).first().text,)


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    edits_per_char: float = EDITS_PER_CHAR,
    max_block_chars: int = MAX_BLOCK_CHARS,
) -> DataFrame:
    """One row per row of ``docs`` and item found in it: both ids, ``distance``, and ``start`` and ``end`` of the closest
    passage (the first of equals) in the normalized text.

    Null and empty texts hold nothing. Repeated rows and items are repeated in the result, null ids stay null. An item is
    found as whole words with ``edits_per_char`` times its length errors at most, so a very short one only exactly.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col), normalized(text_col).alias("__text"))
    items = _items(benchmark, item_col, item_text_col)
    schema = T.StructType(
        [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("__k1", T.LongType()), T.StructField("__k2", T.LongType())]
        + [T.StructField(c, T.IntegerType()) for c in ("distance", "start", "end")]
    )
    parts = [spark.createDataFrame([], schema)]
    for keys, texts in blocks(items, max_block_chars):
        shared = spark.sparkContext.broadcast((keys, texts))

        def found(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            keys, texts = shared.value
            matcher = _matcher(texts, edits_per_char)
            for batch in batches:
                at, rows = [], []
                for i, text in enumerate(batch.column(1)):
                    for n, *rest in matcher.search(text.as_py() or ""):
                        at.append(i)
                        rows.append((*keys[n], *rest))
                if at:
                    k1, k2, *numbers = zip(*rows)
                    columns = [pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), *(pa.array(x, pa.int32()) for x in numbers)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *columns], names=schema.names)

        parts.append(slim.mapInArrow(found, schema))
    rows = stacked(*parts[1:]) if parts[1:] else parts[0]
    ids = items.select(F.col("item").alias(item_col), F.col("k1").alias("__k1"), F.col("k2").alias("__k2"))
    return rows.join(ids, ["__k1", "__k2"]).select(id_col, item_col, "distance", "start", "end")


def without_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    edits_per_char: float = EDITS_PER_CHAR,
    max_block_chars: int = MAX_BLOCK_CHARS,
) -> DataFrame:
    """The rows of ``docs``, all columns, in which ``contaminated`` finds nothing. Narrow: rows are tested where they lie."""
    spark = docs.sparkSession
    for _, texts in blocks(_items(benchmark, item_col, item_text_col), max_block_chars):
        shared = spark.sparkContext.broadcast(texts)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(shared.value, edits_per_char)
            for batch in batches:
                keep = [not matcher.search(text.as_py() or "") for text in batch.column(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays(batch.columns[:-1], names=batch.schema.names[:-1]).filter(pa.array(keep, pa.bool_()))

        docs = docs.select("*", normalized(text_col).alias("__text")).mapInArrow(clean, docs.schema)
    return docs
