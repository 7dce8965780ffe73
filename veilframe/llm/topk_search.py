"""Exact top-k search by inner product, term at a time.

Vectors are turned into whole numbers, which makes scores exact. Rows are dealt by a hash of their own number into groups of
candidates and blocks of queries, both of a mean size that doesn't depend on the table, and each block meets each group once
in a task of its own. There the group is turned into postings, one list of (row, weight) for each component; a query block
goes through its components one at a time and adds weight times posting to an array with a score for every row and query.
Components that most rows have are kept as whole columns, so that adding them needs no row numbers.

A group's best rows are found by partial selection, not by sorting, on a key that joins score and rank of the id, so ties
are decided there, too. What is left, k rows for each query and group, is merged by a ranked window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

SCALE, TOP, EVERY = 64, 20, 20
GROUP, BLOCK, TILE = 1 << 14, 1 << 10, 128
_DIGITS = 700


def weights(column: pa.ChunkedArray, scale: int) -> np.ndarray:
    """floor(scale * x) of each vector's components, short vectors filled up with zeros; Python integers where 64 bits don't do."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        scaled = np.floor(scale * flat)
    large = len(flat) and np.abs(scaled).max() >= 2.0**62
    # Above 2**53 doubles are whole numbers, so scaling comes after the conversion.
    whole = [int(np.floor(scale * x)) if abs(x) < 2.0**53 else int(x) * scale for x in flat.tolist()] if large else scaled.astype(np.int64)
    width = int(sizes.max(initial=0))
    out = np.zeros((len(sizes), width), object if large else np.int64)
    out[np.arange(width) < sizes[:, None]] = whole
    return out


class Postings:
    """A group of candidate rows, by component."""

    def __init__(self, rows: np.ndarray) -> None:
        self.n, self.width = rows.shape
        self.largest = int(np.abs(rows).max(initial=0))
        self.lists: list[tuple[slice | np.ndarray, np.ndarray]] = []
        for column in rows.T:
            at = np.flatnonzero(column)
            self.lists.append((slice(None), np.ascontiguousarray(column)) if 2 * len(at) > self.n else (at, column[at]))

    def scores(self, queries: np.ndarray) -> np.ndarray:
        """Inner product of every row (first axis) and query."""
        width = min(self.width, queries.shape[1])
        bound = max(1, width) * self.largest * int(np.abs(queries).max(initial=0))
        kind = np.int32 if bound < 2**31 else np.int64 if bound < 2**63 else object
        out = np.zeros((self.n, len(queries)), kind)
        for (at, weight), query in zip(self.lists[:width], queries.T[:width].astype(kind)):
            if len(weight) and query.any():
                out[at] += weight.astype(kind)[:, None] * query
        return out


def best(scores: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each query the rows of its k highest scores, ties to the lower row; ``own`` is the row that is the query itself, or -1."""
    n = len(scores)
    largest = int(np.abs(scores).max(initial=0)) + 1
    kind = np.int64 if (largest + 1) * n < 2**63 else object
    keys = np.ascontiguousarray(scores.T).astype(kind) * n + np.arange(n - 1, -1, -1)
    mine = np.flatnonzero(own >= 0)
    keys[mine, own[mine]] = -largest * n
    k = min(k, n)
    top = np.argpartition(keys, n - k, axis=1)[:, n - k :] if kind is np.int64 else np.argsort(keys, axis=1)[:, n - k :]
    for q in range(len(keys)):
        yield q, top[q][top[q] != own[q]]


def _beyond(score: int) -> str:
    """Text in the order of the scores beyond 64 bits; empty within."""
    return "" if -(2**63) < score < 2**63 else f"+{score:0{_DIGITS}}" if score > 0 else f"!{10**_DIGITS + score:0{_DIGITS}}"


def _searched(k: int, scale: int, queries: pa.Table, rows: pa.Table) -> Iterator[dict]:
    rows = rows.sort_by([("id", "ascending"), ("row", "ascending")])  # null ids last
    postings, ids = Postings(weights(rows["vec"], scale)), rows["id"].to_pylist()
    place = {r: i for i, r in enumerate(rows["row"].to_pylist())}
    for start in range(0, queries.num_rows, TILE):
        tile = queries.slice(start, TILE)
        numbers, names = tile["row"].to_pylist(), tile["id"].to_pylist()
        own = np.array([place.get(r, -1) for r in numbers])
        scores = postings.scores(weights(tile["vec"], scale))
        for q, at in best(scores, own, k):
            for i in at.tolist():
                score = int(scores[i, q])
                # Beyond 64 bits the ends of the range are given.
                yield {"row": numbers[q], "query_id": names[q], "vec_id": ids[i], "score": max(-(2**63), min(2**63 - 1, score)), "beyond": _beyond(score)}


def top_k_search(
    vectors: DataFrame, is_query: Column, k: int = TOP, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """The ``k`` best other rows of every row that ``is_query`` holds for: query_id, rank from 1, vec_id, score.

    The score is the inner product of floor(``scale`` * x) over all components x. Vectors that are null or hold a null or
    non-finite component take no part. Components that a shorter vector lacks count as 0; an empty vector scores 0 with
    all. Ties go to the smaller id, null ids last. Rows equal in id are rows of their own, so one may find the other. A
    query with no other row has no result; neither has an empty table. Scores beyond 64 bits rank by their true value and
    are given as the end of the range.
    """
    x = F.col(vec_col)
    sound = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.where(sound).select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("id"), x.alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks")
    )
    rows = materialize(rows, "vectors")
    n, n_queries = rows.agg(F.count("*"), F.count_if("asks")).first()
    groups, blocks = -(-n // GROUP) or 1, -(-n_queries // BLOCK) or 1
    dealt = rows.select(
        "row", "id", "vec", "asks", F.pmod(F.xxhash64("row"), F.lit(groups)).alias("g"), F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("b")
    )
    asked = dealt.where("asks").select("b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint"))).alias("g"), "row", "id", "vec")
    there = dealt.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("b"), "g", "row", "id", "vec")
    kind = pa.schema([("row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("beyond", pa.string())])

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return kind.empty_table()
        return pa.Table.from_pylist(list(_searched(k, scale, left, right)), schema=kind)

    found = asked.groupBy("b", "g").cogroup(there.groupBy("b", "g")).applyInArrow(search, "row bigint, query_id bigint, vec_id bigint, score bigint, beyond string")
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("beyond").desc(), F.col("vec_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
