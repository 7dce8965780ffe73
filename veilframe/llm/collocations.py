"""Phrases that stand together more often than their parts would by chance, from an FM-index per shard.

1. Shards. A task turns its texts into word ids, pieces ended by a separator, and cuts them into shards of a bounded number
   of words. A shard's suffixes are sorted and the shard is kept as its Burrows-Wheeler transform and its words with their
   counts. Words of different languages have different ids, so phrases of two languages never meet.
2. Words. The shards' word counts are summed; a shard gets back which of its words are frequent enough.
3. Two words. Every interval of a shard's index is extended by a word to the left (the preceding symbols of the transform)
   and by a word to the right (the parts of the interval), for all intervals at once: a suffix's two-word beginning is its
   first word and, where the transform leads one step on, that of the suffix behind. Intervals of frequent words give pairs
   with their counts; pairs are summed over shards, and a shard gets back which of its intervals are frequent enough.
4. Three to five words. The same extension, from intervals of frequent pairs only.

A phrase that is frequent has frequent parts, so nothing is lost by this. All counts of a shard are sums already: a shard
sends a phrase once, however often it occurs. Separators differ from each other in order, so no phrase crosses one.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, stacked

MIN_COUNT, LONGEST, TOP = 100, 5, 2000
SHARD_WORDS = 1 << 20
BUCKET_WORDS = 1 << 21
SHARDS_OF_TASK, PLACE_BITS = 1 << 10, 31
PLACES = 1 << PLACE_BITS
DEFLATE = 6
SALT = 64

_ENDS = b".,;:!?\x0b\x0c\r"
_TABLE = bytes.maketrans(_ENDS + b"\t", b"\n" * len(_ENDS) + b" ").lower()  # also A-Z to a-z


# ---- a shard's index -----------------------------------------------------------------------------------


def _order(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Positions sorted by (high, low), ties by position."""
    n = len(high)
    bits = [int(x.max(initial=0)).bit_length() for x in (high, low)] + [max(1, n - 1).bit_length()]
    if sum(bits) > 63:
        return np.lexsort((low, high))
    packed = (high << (bits[1] + bits[2])) | (low << bits[2]) | np.arange(n)
    packed.sort()
    return packed & ((1 << bits[2]) - 1)


def suffixes(ids: np.ndarray) -> np.ndarray:
    """Suffix array of word ids from 1 on, in which each 0 is a separator that is less than all words and later separators."""
    n = len(ids)
    nxt = np.append(ids[1:], 0)
    nxt[ids == 0] = 0
    array = _order(ids, nxt)
    rank = np.empty(n, np.int64)
    reach = 2
    # Suffixes whose separator was reached are told by position. So what is still open has no separator within its reach.
    a, b = ids[array], nxt[array]
    new = np.ones(n, bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (b[1:] == 0)
    while True:
        starts = np.flatnonzero(new)
        sizes = np.diff(starts, append=n)
        rank[array] = np.repeat(starts, sizes)
        held = np.repeat(sizes > 1, sizes)
        if not held.any():
            return array
        at = np.flatnonzero(held)
        open_ = array[at]
        behind = rank[open_ + reach]
        moved = _order(rank[open_], behind)
        array[at] = open_[moved]
        new[at] = True
        same = (rank[open_[moved]][1:] == rank[open_[moved]][:-1]) & (behind[moved][1:] == behind[moved][:-1])
        new[at[1:]] = ~same
        reach *= 2


def transform(ids: np.ndarray) -> np.ndarray:
    """Burrows-Wheeler transform: for each suffix in order the symbol before it."""
    return ids[suffixes(ids) - 1]


def behind_of(bwt: np.ndarray) -> np.ndarray:
    """For each suffix in order the rank of the suffix one word later. Not of use for suffixes that begin with a separator."""
    return _order(bwt, np.zeros_like(bwt))


def _packed(values: np.ndarray) -> bytes:
    return zlib.compress(values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), DEFLATE)


def _unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _intervals(valid: np.ndarray, *labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the runs of valid suffixes that agree in all labels."""
    at = np.flatnonzero(valid)
    if not len(at):
        return at, at
    new = np.ones(len(at), bool)
    new[1:] = np.any([x[at[1:]] != x[at[:-1]] for x in labels], axis=0) | (np.diff(at) > 1)
    starts = np.flatnonzero(new)
    return at[starts], np.diff(starts, append=len(at))


# ---- tasks ---------------------------------------------------------------------------------------------


class _Shard:
    def __init__(self) -> None:
        self.next = count(2).__next__
        self.words: dict[str, defaultdict[bytes, int]] = {}
        self.ids: list[np.ndarray] = []
        self.n = 0

    def add(self, lang: str, tokens: list[bytes]) -> None:
        known = self.words.get(lang)
        if known is None:
            known = self.words[lang] = defaultdict(self.next, {b"\n": 0, b"": 1})
        ids = np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))
        ids = np.append(ids[ids != 1], 0)
        self.ids.append(ids[(ids != 0) | (np.append(0, ids[:-1]) != 0)])
        self.n += len(self.ids[-1])

    def row(self, number: int) -> pa.RecordBatch | None:
        ids = np.concatenate(self.ids) if self.ids else np.empty(0, np.int64)
        if not len(ids):
            return None
        ids = np.maximum(ids - 1, 0)  # words from 1 on
        names = sorted((i - 2, lang, w) for lang, known in self.words.items() for w, i in known.items() if i > 1)
        sizes = np.bincount(ids, minlength=len(names) + 1)[1:]
        words = pa.StructArray.from_arrays(
            [pa.array([x[1] for x in names]), pa.array([x[2] for x in names]).cast(pa.string()), pa.array(sizes, pa.int32())], ["lang", "word", "size"]
        )
        offsets = pa.array([0, len(names)], pa.int32())
        columns = [pa.array([number]), pa.array([_packed(transform(ids))]), pa.ListArray.from_arrays(offsets, words)]
        return pa.RecordBatch.from_arrays(columns, ["shard", "bwt", "words"])


def _pieces(text: bytes, most: int) -> Iterator[list[bytes]]:
    """Tokens of a text, separators among them, in portions that end at a separator and hold some ``most`` bytes where that can be."""
    start = 0
    while start < len(text):
        stop = len(text) if len(text) - start <= most else text.find(b"\n", start + most) + 1 or len(text)
        yield text[start:stop].replace(b"\n", b" \n ").split(b" ")
        start = stop


def _shards(size: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = TaskContext.get().partitionId() * SHARDS_OF_TASK, _Shard()
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                for tokens in _pieces((text or "").encode().translate(_TABLE), size):
                    shard.add(lang, tokens)
                    if shard.n >= size:
                        yield shard.row(number)
                        number, shard = number + 1, _Shard()
        last = shard.row(number)
        if last is not None:
            yield last

    return build


# What shards send is dealt to buckets by a hash of the phrase, so a bucket sums whole phrases. It goes as blocks of numbers,
# a row for each shard and bucket, not as a row for each phrase.
_BLOCKS = "bucket bigint, shard bigint, block binary"
_FOUND = "shard bigint, block binary, gid bigint, p bigint, s bigint, f bigint"
_LONG = "length bigint, b1 bigint, b2 bigint, b3 bigint, f bigint"
_KINDS = {"bigint": pa.int64(), "binary": pa.binary()}


def _table(schema: str, n: int, **columns) -> pa.Table:
    """Columns that aren't given are null."""
    fields = [pa.field(name, _KINDS[kind]) for name, kind in (x.split() for x in schema.split(", "))]
    arrays = [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in fields]
    return pa.Table.from_arrays(arrays, schema=pa.schema(fields))


def _block(*columns: np.ndarray) -> bytes:
    """The first column rises, so its steps are kept; bytes of equal weight lie together, as most are zero."""
    steps = np.diff(columns[0], prepend=0)
    return zlib.compress(np.stack([steps, *columns[1:]]).astype("<i8").view(np.uint8).reshape(len(columns), -1, 8).transpose(0, 2, 1).tobytes(), DEFLATE)


def _columns(block: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(block), np.uint8).reshape(n, 8, -1)
    out = np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<i8").reshape(n, -1).astype(np.int64)
    out[0] = np.cumsum(out[0])
    return out


def _mixed(keys: list[np.ndarray]) -> np.ndarray:
    """Hash of a phrase's numbers."""
    h = np.zeros(len(keys[0]), np.uint64)
    for key in keys:
        h = (h ^ key.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _dealt(shard: int, buckets: int, keys: list[np.ndarray], lo: np.ndarray, size: np.ndarray) -> pa.Table:
    to = (_mixed(keys) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    starts = np.flatnonzero(np.diff(to[order], prepend=-1))
    parts = np.split(order, starts[1:]) if len(order) else []
    blocks = [_block(lo[at], size[at], *(k[at] for k in keys)) for at in parts]
    return _table(_BLOCKS, len(parts), bucket=to[order][starts], shard=np.full(len(parts), shard), block=blocks)


def _frequent(keys: list[np.ndarray], size: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of phrases with ``least`` occurrences: their positions phrase by phrase, where each phrase starts, and its sum."""
    slot = (_mixed(keys) >> np.uint64(42)).astype(np.int64)
    # A slot holds all rows of a phrase, so where it falls short, the phrase does.
    at = np.flatnonzero(np.bincount(slot, size)[slot] >= least) if len(slot) else np.empty(0, np.int64)
    at = at[np.lexsort([k[at] for k in keys])]
    new = np.ones(len(at), bool)
    new[1:] = np.any([k[at[1:]] != k[at[:-1]] for k in keys], axis=0)
    starts = np.flatnonzero(new)
    sums = np.add.reduceat(size[at], starts) if len(at) else starts
    held = np.repeat(sums >= least, np.diff(starts, append=len(at)))
    at, new = at[held], new[held]
    return at, np.flatnonzero(new), sums[sums >= least]


def _two_words(buckets: int):
    def pairs(index: pa.Table, frequent: pa.Table) -> pa.Table:
        """Intervals of two frequent words in a shard, by the numbers of first and second word."""
        if not index.num_rows or not frequent.num_rows:
            return _table(_BLOCKS, 0)
        bwt = _unpacked(index["bwt"][0].as_py())
        sizes = np.bincount(bwt)
        gid = np.full(len(sizes), -1, np.int64)
        gid[frequent["place"].to_numpy() + 1] = frequent["gid"].to_numpy()
        first = np.repeat(np.arange(len(sizes)), sizes)
        second = first[behind_of(bwt)]
        lo, size = _intervals((gid[first] >= 0) & (gid[second] >= 0), first, second)
        return _dealt(index["shard"][0].as_py(), buckets, [gid[first[lo]], gid[second[lo]]], lo, size)

    return pairs


def _blocks(table: pa.Table, n: int) -> np.ndarray:
    """All blocks of a bucket side by side, their shards in the last row."""
    parts = [_columns(b.as_py(), n) for b in table["block"]]
    shards = np.repeat(table["shard"].to_numpy(), [x.shape[1] for x in parts])
    return np.vstack([np.concatenate(parts, axis=1), shards])


def _summed_pairs(least: int):
    def summed(blocks: pa.Table) -> pa.Table:
        """Frequent pairs with their sum, and for each shard a block of its intervals of such pairs."""
        lo, size, p, s, shard = _blocks(blocks, 4)
        at, starts, sums = _frequent([p, s], size, least)
        if not len(at):
            return _table(_FOUND, 0)
        place = shard[at] * PLACES + lo[at]
        gid = np.minimum.reduceat(place, starts)
        once = at[starts]
        pairs = _table(_FOUND, len(gid), gid=gid, p=p[once], s=s[once], f=sums)
        of_row = np.repeat(gid, np.diff(starts, append=len(at)))
        order = np.argsort(place)
        at, of_row = at[order], of_row[order]
        cuts = np.flatnonzero(np.diff(shard[at], prepend=-1))
        packed = [_block(lo[x], size[x], g) for x, g in zip(np.split(at, cuts[1:]), np.split(of_row, cuts[1:]))]
        return pa.concat_tables([pairs, _table(_FOUND, len(packed), shard=shard[at[cuts]], block=packed)])

    return summed


def _more_words(buckets: int):
    def extend(index: pa.Table, pairs: pa.Table) -> pa.Table:
        """Intervals of three to five words in which every pair is frequent, by the pairs they are made of."""
        if not index.num_rows or not pairs.num_rows:
            return _table(_BLOCKS, 0)
        bwt = _unpacked(index["bwt"][0].as_py())
        label = np.full(len(bwt), -1, np.int64)
        for block in pairs["block"]:
            lo, size, gid = _columns(block.as_py(), 3)
            label[np.arange(size.sum()) + np.repeat(lo - np.cumsum(size) + size, size)] = np.repeat(gid, size)
        behind, steps, valid, out = behind_of(bwt), [label], label >= 0, []
        at = np.arange(len(bwt))
        for length in range(3, LONGEST + 1):
            at = behind[at]
            steps.append(label[at])
            valid &= steps[-1] >= 0
            lo, size = _intervals(valid, *steps)
            # Of overlapping pairs every second one tells the words, and the last.
            keys = [np.full(len(lo), length), *(steps[k][lo] for k in (0, min(2, length - 2), length - 2))]
            out.append(_dealt(index["shard"][0].as_py(), buckets, keys, lo, size))
        return pa.concat_tables(out)

    return extend


def _summed_phrases(least: int):
    def summed(blocks: pa.Table) -> pa.Table:
        _, size, *keys, _ = _blocks(blocks, 6)
        at, starts, sums = _frequent(keys, size, least)
        once = at[starts]
        return _table(_LONG, len(once), length=keys[0][once], b1=keys[1][once], b2=keys[2][once], b3=keys[3][once], f=sums)

    return summed


# ---- the whole -----------------------------------------------------------------------------------------


def phrases(docs: DataFrame, text_col: str, lang_col: str, min_count: int, shard_words: int) -> tuple[DataFrame, DataFrame]:
    """Phrases (lang, words, f) of one to ``LONGEST`` words with ``min_count`` occurrences or more, and words in all by lang (n)."""
    slim = docs.select(F.coalesce(lang_col, F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    kept = slim.mapInArrow(_shards(shard_words), "shard bigint, bwt binary, words array<struct<lang: string, word: string, size: int>>")
    kept = materialize(kept, "shards")
    each = kept.select("shard", F.posexplode("words").alias("place", "w"))
    words = each.select("w.lang", "w.size")
    totals = materialize(words.groupBy("lang").agg(F.sum("size").alias("n")), "words-of-languages")
    buckets = -(-(totals.agg(F.sum("n")).first()[0] or 0) // BUCKET_WORDS) or 1
    # A row for each word of each shard is shuffled, so it is kept short: one number for the place, one text for word and
    # language. No word has a line feed. A word's number is the first place it has.
    place = F.col("shard") * PLACES + F.col("place")
    short = each.select(place.alias("at"), F.concat("w.word", F.lit("\n"), "w.lang").alias("name"), "w.size")
    same = Window.partitionBy("name")
    named = short.withColumns({"f": F.sum("size").over(same), "gid": F.min("at").over(same)}).where(F.col("f") >= min_count)
    word = F.substring_index("name", "\n", 1)
    frequent = named.select(
        F.shiftright("at", PLACE_BITS).alias("shard"),
        F.col("at").bitwiseAND(F.lit(PLACES - 1)).alias("place"),
        F.substring(F.col("name"), F.length(word) + 2, F.length("name")).alias("lang"),
        word.alias("word"),
        "f",
        "gid",
    )
    frequent = materialize(frequent, "frequent-words")
    index = kept.select("shard", "bwt").groupBy("shard")

    pairs = index.cogroup(frequent.select("shard", "place", "gid").groupBy("shard")).applyInArrow(_two_words(buckets), _BLOCKS)
    pairs = materialize(pairs.groupBy("bucket").applyInArrow(_summed_pairs(min_count), _FOUND), "frequent-pairs")
    placed = pairs.where("block IS NOT NULL").select("shard", "block").groupBy("shard")
    longer = index.cogroup(placed).applyInArrow(_more_words(buckets), _BLOCKS)
    longer = materialize(longer.groupBy("bucket").applyInArrow(_summed_phrases(min_count), _LONG), "frequent-phrases")

    word = frequent.where(F.col("gid") == place).select("gid", "lang", "word", "f")
    first = word.select(F.col("gid").alias("p"), "lang", F.col("word").alias("w1"))
    second = word.select(F.col("gid").alias("s"), F.col("word").alias("w2"))
    two = materialize(pairs.where("gid IS NOT NULL").join(first, "p").join(second, "s").select("gid", "lang", "w1", "w2", "f"), "pairs")
    named = longer
    for k in (1, 2, 3):
        named = named.join(two.select(F.col("gid").alias(f"b{k}"), F.array("w1", "w2").alias(f"t{k}"), *(["lang"] if k == 1 else [])), f"b{k}")
    told = F.when(F.col("length") == 3, F.array(F.col("t1")[0], F.col("t1")[1], F.col("t3")[1]))
    told = told.when(F.col("length") == 4, F.concat("t1", "t3")).otherwise(F.concat("t1", "t2", F.slice("t3", 2, 1)))
    out = stacked(
        word.select("lang", F.array("word").alias("words"), "f"),
        two.select("lang", F.array("w1", "w2").alias("words"), "f"),
        named.select("lang", told.alias("words"), "f"),
    )
    return materialize(out, "phrases"), totals


def _phrase(words: Column) -> Column:
    return F.array_join(words, " ")


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, top: int = TOP, shard_words: int = SHARD_WORDS
) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A candidate is a phrase of two to five words with a >= ``min_count`` occurrences within pieces, overlaps included. Its
    score is the least over its cuts of floor(1000 * a * n / (l * r)), ties to the first cut; l and r are the occurrences
    of the parts and n all words of the language. Candidates that lie in a longer one with as many occurrences go. Order:
    score and a from high to low, then the phrase's bytes.

    Null texts count as empty, null languages as ``und``; repeated rows count each time; a table without a word gives no
    row. A shard ends between pieces, so one piece of more than ``shard_words`` words makes a larger shard.
    """
    all_phrases, totals = phrases(docs, text_col, lang_col, min_count, shard_words)
    counted = all_phrases.select("lang", _phrase(F.col("words")).alias("part"), "f")
    candidates = all_phrases.where(F.size("words") > 1).withColumnRenamed("f", "a").withColumn("phrase", _phrase(F.col("words")))

    # A longer candidate with as many occurrences has one between them that is longer by one word and is no rarer.
    shorter = F.array(*[_phrase(F.slice("words", k, F.size("words") - 1)) for k in (1, 2)])
    held = candidates.where(F.size("words") > 2).select("lang", F.explode(shorter).alias("phrase"), "a")
    held = held.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    open_ = candidates.join(held, ["lang", "phrase"], "left").where("longer IS NULL OR longer < a").drop("longer")

    cuts = open_.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _phrase(F.slice("words", F.lit(1), F.col("k"))).alias("left"), _phrase(F.slice("words", F.col("k") + 1, F.size("words"))).alias("right"))
    cuts = cuts.join(counted.select("lang", F.col("part").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(counted.select("lang", F.col("part").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    cuts = cuts.join(totals, "lang")
    # Decimals of 38 digits hold the products, and div gives the whole quotient.
    score = F.expr("(1000 * CAST(a AS DECIMAL(17, 0)) * CAST(n AS DECIMAL(17, 0))) div (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))")
    least = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(least).select("lang", "phrase", "a", "n", "cut.score", "cut.l", "cut.r")

    # The best of each part first, so that a language's ranking meets a bounded number of rows.
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALT))).orderBy(*order)
    best = scored.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
