"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints of 64 bits link at three differing bits or fewer. Cut into two segments, one of them differs by one bit at
most, so the index holds, for each segment, its 32 variants with one bit wiped out: two segments within one bit share
the variant that wipes the bit they differ in. Equal variants are joined and the pair is verified inside the join.

Fingerprints are made distinct before the index is built, so groups of copies weigh one row there, however large. Of
the variants a pair shares, only the first gives it out. A hot variant is a skewed join key, which Spark splits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import row_key
from .components import components

SHINGLE, MAX_BITS, SEED = 3, 3, 42
BLOCK = 1 << 16


def _counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each bit set. Bits are spread to bytes and added eight at a time, 255 rows before a byte is full."""
    lanes = np.unpackbits(hashes.view(np.uint8), bitorder="little").view(np.uint64).reshape(-1, 8)
    sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)
    return sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint of a whole text; 0 for a text without words."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    if len(words) < size:
        shingles: Iterator[bytes] = iter([b" ".join(words)])
        n = 1
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(size))))
        n = len(words) - size + 1
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(SEED))
    counts = np.zeros(64, np.int64)
    for start in range(0, n, BLOCK):
        counts += _counts(np.fromiter(hashes, np.uint64, min(BLOCK, n - start)))
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def with_fingerprints(docs: DataFrame, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``fp`` of every row."""

    @F.pandas_udf("bigint")
    def fp(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t) for t in texts], dtype="int64")

    return docs.select(*keep, fp(F.col(text_col)).alias("fp"))


def links(fingerprints: DataFrame) -> DataFrame:
    """Pairs (u, v), u < v, of distinct ``fp`` values that differ in three bits or fewer; each pair once."""
    variants = fingerprints.select("fp").distinct().select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
    # The high half of the key numbers segment and wiped bit, the low half holds the segment without that bit.
    index = variants.selectExpr(
        "fp",
        "shiftleft(bigint(i), 32) | ((shiftrightunsigned(fp, (i div 32) * 32) & 4294967295L) & ~shiftleft(1L, i % 32)) AS key",
    )
    a, b = index.withColumnRenamed("fp", "u"), index.withColumnRenamed("fp", "v")
    low, high = "((u ^ v) & 4294967295L)", "shiftrightunsigned(u ^ v, 32)"
    # A segment that differs by one bit shares one variant, an equal one all 32, of which number 0 is taken.
    first = f"if(bit_count({low}) <= 1, bit_count(greatest({low} - 1, 0L)), 32 + bit_count(greatest({high} - 1, 0L)))"
    verified = f"u < v AND bit_count(u ^ v) <= {MAX_BITS} AND shiftrightunsigned(key, 32) = {first}"
    # Spark sizes a side as if there were no 64 variants of each fingerprint, so it would broadcast it: hence the hint.
    return a.hint("merge").join(b, "key").where(verified).select("u", "v")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """``keep``, the id, ``fp``, ``root`` (the component's least fingerprint) and ``component_id`` (its least id) of every row.

    Null and empty texts have fingerprint 0 and are linked like any other. A null id is never the least; a component of
    null ids alone has a null one. Repeated rows are repeated in the result. Ids are integers.
    """
    rows = materialize(with_fingerprints(docs, text_col, [*keep, id_col]), "fingerprints")
    least = materialize(rows.groupBy("fp").agg(F.min(id_col).alias("least")), "distinct-fingerprints")
    roots = components(links(least))
    labelled = least.join(roots, least.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    labelled = materialize(labelled, "components")
    ids = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = labelled.join(ids, "root").select("fp", "root", "component_id")
    return rows.join(by_fp, "fp").select(*keep, id_col, "fp", "root", "component_id")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``fingerprint`` (16 hex digits) and ``component_id`` of every row; see ``simhash_groups``."""
    groups = simhash_groups(docs, id_col, text_col)
    return groups.select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with all its columns: the one with the least id (nulls last), of these any with the
    least key over id and text. Rows equal in id and text count as one."""
    k1, k2 = row_key(id_col, text_col)
    slim = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), k1.alias("__k1"), k2.alias("__k2"))
    groups = simhash_groups(slim, "__id", "__text", ["__k1", "__k2"])
    order = F.struct(F.isnull("__id").alias("n"), F.col("__id").alias("i"), F.col("__k1"), F.col("__k2"))
    kept = groups.groupBy("root").agg(F.min(order).alias("r"))
    keyed = docs.select("*", k1.alias("__k1"), k2.alias("__k2"))
    chosen = keyed.join(kept.select("r.__k1", "r.__k2"), ["__k1", "__k2"], "left_semi")
    return chosen.dropDuplicates(["__k1", "__k2"]).select(*docs.columns)
