"""Token counts by a map-side look-up of two tiers.

First tier: numbers of tokens of the corpus' most frequent words, one compact table of bounded size that is broadcast.
Second tier: each Python worker encodes the words it misses and keeps them for later tasks. Words are never shuffled;
what the frequent ones are is worked out from bounded summaries, one for each task, over all documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import PieceCounts, per_worker

# Bounds: rows of the broadcast table, rows a task may add to the summary, and words it counts before it drops rare ones.
TABLE_ROWS, SUMMARY_ROWS, COUNTED = 50_000, 2_000, 200_000
LIMIT = 4096


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def frequent_words(docs: DataFrame, text_col: str = "text", rows: int = TABLE_ROWS) -> list[str]:
    """The words most often met, up to ``rows``. Each task counts its words, halving all counts when it has too many
    different ones, and gives out its most frequent; these sums are added up. Which words come out changes speed only."""

    def summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update(PieceCounts.words(text.as_py() or ""))
                while len(counts) > COUNTED:
                    counts = Counter({w: n // 2 for w, n in counts.items() if n > 1})
        top = counts.most_common(SUMMARY_ROWS)
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["word", "n"])

    summary = docs.select(text_col).mapInArrow(summarize, "word string, n bigint")
    # Long words cost memory and are rare; leaving them out changes speed only.
    top = summary.where("n > 1 AND length(word) <= 64").groupBy("word").agg(F.sum("n").alias("n"))
    return [r.word for r in top.orderBy(F.desc("n"), "word").limit(rows).collect()]


def token_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, limit: int = LIMIT, table_rows: int = TABLE_ROWS
) -> DataFrame:
    """The id, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) of every row.

    Null texts count as empty: 0 bytes, 0 tokens. Rows stay as they are, repeated ones and null ids included.
    """
    path = tokenizer or default_tokenizer()
    counts = PieceCounts(path)
    counts.learn(set(frequent_words(docs, text_col, table_rows)))
    known = {w: n for w, n in counts.cache.items() if n < 256 and "\0" not in w}
    table = docs.sparkSession.sparkContext.broadcast(("\0".join(known), bytes(known.values())))
    slim = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    schema = T.StructType([slim.schema.fields[0], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def fresh() -> PieceCounts:
        words, sizes = table.value
        out = PieceCounts(path)
        out.cache = dict(zip(words.split("\0"), sizes))
        return out

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = per_worker("piece-counts", (path, len(table.value[1]), hash(table.value[0])), fresh)
        for batch in batches:
            for part in (batch.slice(a, 500) for a in range(0, batch.num_rows, 500)):
                texts = part.column(1).to_pylist()
                sizes = [len(t.encode()) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(counts.count(texts), pa.int64())], names=schema.names)

    return slim.mapInArrow(count, schema).withColumn("over_limit", F.col("n_tokens") > limit)
