"""Sum-of-squares packing of tokenized documents into sequences.

Each piece goes where the sum, over all residual gaps, of the squared number of open sequences with that gap becomes
smallest; of equal choices the tightest. Keeping those numbers even keeps a fitting gap at hand for what is to come.

Tokens never meet in one place: pieces are dealt out by hash, and each task packs its own, largest first, knowing only
how many open sequences have each gap. A task that is run again packs the same way, since its pieces are sorted first.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import WordIds, per_worker

CAPACITY, END_ID = 2048, 0
# Sequences of one task are numbered from its own number times this.
PER_TASK = 1 << 36


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_pieces(
    docs: DataFrame, text_col: str = "text", keep: Sequence[str] = ("doc_id",), tokenizer: str | None = None, capacity: int = CAPACITY
) -> DataFrame:
    """``keep``, ``piece`` (from 0), ``start``, ``length`` and ``ids`` (little-endian unsigned 32-bit numbers) of every piece.

    A document is its ids and the end id, so null and empty texts have the end id alone. Only what is longer than
    ``capacity`` is cut. Repeated rows give their pieces again.
    """
    path = tokenizer or default_tokenizer()
    slim = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    kept = slim.schema.fields[:-1]
    numbers = [T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]
    schema = T.StructType([*kept, *numbers, T.StructField("ids", T.BinaryType())])
    size, end = 4 * capacity, END_ID.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = per_worker("word-ids", path, lambda: WordIds(path))
        for batch in batches:
            for part in (batch.slice(a, 500) for a in range(0, batch.num_rows, 500)):
                at, rows = [], []
                for i, ids in enumerate(words.encode(part.column(part.num_columns - 1).to_pylist())):
                    ids += end
                    for k, a in enumerate(range(0, len(ids), size)):
                        at.append(i)
                        rows.append((k, a // 4, len(ids[a : a + size]) // 4, ids[a : a + size]))
                columns = [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.binary()))]
                taken = [part.column(c).take(pa.array(at)) for c in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*taken, *columns], names=schema.names)

    return slim.mapInArrow(cut, schema)


class OpenSequences:
    """Places lengths one after the other by the sum-of-squares rule."""

    def __init__(self, capacity: int, first_id: int = 0):
        self.capacity, self.next_id = capacity, first_id
        self.count = np.zeros(capacity + 1, np.int64)
        self.ids: list[list[int]] = [[] for _ in range(capacity + 1)]

    def place(self, length: int) -> tuple[int, int]:
        """Sequence and offset."""
        count, capacity = self.count, self.capacity
        # Change of the sum: one sequence fewer with gap g, one more with gap g - length; gap 0 is not counted.
        gap, least = capacity, 2 * count[capacity - length] + 1 if length < capacity else 0
        fits = np.flatnonzero(count[length:capacity]) + length
        if len(fits):
            left = fits - length
            change = np.where(left > 0, 2 * (count[left] - count[fits]) + 2, 1 - 2 * count[fits])
            k = change.argmin()
            if change[k] <= least:
                gap = int(fits[k])
        if gap == capacity:
            sequence, self.next_id = self.next_id, self.next_id + 1
        else:
            sequence = self.ids[gap].pop()
            count[gap] -= 1
        if gap > length:
            self.ids[gap - length].append(sequence)
            count[gap - length] += 1
        return sequence, capacity - gap


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """All columns of ``pieces`` and ``sequence_id`` and ``offset``: rows of a sequence fill it from 0 without gaps.

    ``length`` is from 1 to ``capacity``. Any columns may come along; rows equal in all of them are interchangeable.
    """
    names = pieces.columns
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = OpenSequences(capacity, TaskContext.get().partitionId() * PER_TASK)
        for batch in batches:
            places = [packed.place(n) for n in batch.column(names.index("length")).to_pylist()]
            ids, offsets = zip(*places) if places else ((), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.int64()), pa.array(offsets, pa.int64())], names=schema.names)

    mixed = F.xxhash64(*names)
    dealt = pieces.repartition(mixed).sortWithinPartitions(F.desc("length"), mixed, *names)
    return dealt.mapInArrow(pack, schema)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Where each piece of each document goes; of the ids only their crc32 is kept, so no tokens are shuffled."""
    pieces = token_pieces(docs, text_col, [id_col], tokenizer, capacity)
    return place(pieces.select(id_col, "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), capacity)


def packed_sequences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The sequences themselves: ``sequence_id``, ``n_ids``, ``ids`` (binary) and ``parts``, what they are made of in order."""
    placed = place(token_pieces(docs, text_col, [id_col], tokenizer, capacity), capacity)
    part = F.struct("offset", F.col(id_col), "piece", "start", "length", "ids")
    whole = placed.groupBy("sequence_id").agg(F.sum("length").alias("n_ids"), F.sort_array(F.collect_list(part)).alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda out, p: F.concat(out, p["ids"]))
    return whole.select("sequence_id", "n_ids", joined.alias("ids"), F.transform("parts", lambda p: p.dropFields("ids")).alias("parts"))
