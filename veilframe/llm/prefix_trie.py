"""The trie of conversation prefixes, rolled up by depth bands.

A node is a distinct sequence of first turns. It is named by its depth and the exclusive or of two 64-bit hashes of
(depth, role, text) over its turns, so naming a node needs a running value of each conversation and no text.

Totals over subtrees are made in bands of ``BAND`` depths. Within a band, a node's values are given to itself and its
ancestors there, at most ``BAND`` of them. The sums that band tops get this way are the values of a smaller trie, that of
the band tops alone, with a depth ``BAND`` times less. It is rolled up likewise; the totals of its nodes are complete, and
each is given to the ancestors in the band above its own. So a trie of depth D takes log(D) / log(BAND) rounds, and no row
is multiplied by more than ``BAND`` in any of them. Ancestors are looked up in the prefixes of one conversation that goes
through the node, by conversation and band: no key of these joins has more than ``BAND`` rows on either side.

Conversations may be of any length. Ranks and running values are taken over stretches of a range partitioning: within a
stretch by a window, across stretches from their totals (``running``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, stacked

BAND, HEAD_TURNS, FAMILY = 16, 6, 100
CHUNK = 1 << 16
NODE = ("depth", "k1", "k2")


def running(rows: DataFrame, group: str, order: Sequence[Column], values: dict[str, tuple], purpose: str, coarse: int | None = None) -> DataFrame:
    """``rows`` with running values in the order of ``order`` within ``group``, however many rows a group has.

    ``values`` maps a new column to (aggregate function, input column, how to join two values). Ranges are cut by the group
    and the first ``coarse`` columns of the order (else all), wherever that may be in a group. So only the group that a range
    begins with can have rows before it: the table of what lies before is no longer than the number of ranges, and is broadcast.
    """
    part = materialize(rows.repartitionByRange(group, *order[:coarse]).withColumn("__part", F.spark_partition_id()), purpose)
    within = Window.partitionBy("__part", group)
    to_here = within.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = part.groupBy("__part", group).agg(*[f(x).alias(f"__{name}") for name, (f, x, _) in values.items()])
    earlier = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # A sum of sums, a count's sum and an exclusive or of such are what the parts before a range come to.
    before = totals.select("__part", group, *[(F.sum if f is F.count else f)(f"__{name}").over(earlier).alias(f"__{name}") for name, (f, _, _) in values.items()])
    first = next(iter(values))
    before = before.where(F.col(f"__{first}").isNotNull())
    out = part.select("*", *[f(x).over(to_here).alias(name) for name, (f, x, _) in values.items()])
    out = out.join(F.broadcast(before), ["__part", group], "left")
    joined = {name: F.coalesce(join(F.col(name), F.col(f"__{name}")), F.col(name)) for name, (_, _, join) in values.items()}
    return out.withColumns(joined).drop("__part", *[f"__{name}" for name in values])


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations with their head replaced: ids with ``total`` turns, and turns (conv_id, depth, h1, h2, length).

    A conversation takes the first h turns of that with its id rounded down to ``FAMILY``, h being crc32 of its id modulo
    ``HEAD_TURNS``, and goes on with its own turns after the first h. Turns of equal number are taken in the order of role
    and text, of these the first 32 characters before the rest. Rows without a conv_id belong to no conversation.
    """
    slim = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    # Ranges are cut by short values, as samples of them come to the driver.
    order = [F.col("turn").asc_nulls_first(), F.substring("role", 1, 32), F.substring("text", 1, 32), F.col("role"), F.col("text")]
    own = running(slim, "conv_id", order, {"place": (F.count, F.lit(1), lambda a, b: a + b)}, "turns", coarse=3)
    own = own.select("conv_id", "place", "role", "text", F.length("text").cast("bigint").alias("length"))
    own = materialize(own, "placed-turns")
    sizes = own.groupBy("conv_id").agg(F.count("*").alias("size"))
    heads = own.where((F.col("conv_id") % FAMILY == 0) & (F.col("place") < HEAD_TURNS)).withColumnRenamed("conv_id", "head_id")
    convs = sizes.select(
        "conv_id", "size", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("head_id"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD_TURNS).alias("h")
    )
    head_sizes = sizes.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("head_id"), F.col("size").alias("head_size"))
    convs = convs.join(head_sizes, "head_id", "left").withColumn("taken", F.least("h", F.coalesce("head_size", F.lit(0))))
    convs = convs.withColumn("total", F.col("taken") + F.greatest(F.col("size") - F.col("h"), F.lit(0)))
    convs = materialize(convs.select("conv_id", "head_id", "h", "taken", "total"), "conversations")
    head = convs.join(heads, "head_id").where("place <= h").select("conv_id", "total", F.col("place").alias("depth"), "role", "text", "length")
    tail = own.join(convs, "conv_id").where("place > h").select("conv_id", "total", (F.col("place") - F.col("h") + F.col("taken")).alias("depth"), "role", "text", "length")
    named = [F.xxhash64("depth", "role", "text").alias("h1"), F.xxhash64(F.lit(7919), "depth", "role", "text").alias("h2")]
    return convs.select("conv_id", "total"), stacked(head, tail).select("conv_id", "total", "depth", *named, "length")


def prefixes(turns: DataFrame) -> DataFrame:
    """Every prefix of every rebuilt conversation, the empty one included: its node, the node above, and whether it is all."""
    convs, after = rebuilt(turns)
    xor = (F.bit_xor, lambda a, b: a.bitwiseXOR(b))
    named = running(after, "conv_id", [F.col("depth")], {k: (xor[0], F.col(h), xor[1]) for k, h in (("k1", "h1"), ("k2", "h2"))}, "rebuilt")
    named = named.select(
        "conv_id", "depth", "k1", "k2", F.col("k1").bitwiseXOR(F.col("h1")).alias("up1"), F.col("k2").bitwiseXOR(F.col("h2")).alias("up2"), "length", (F.col("depth") == F.col("total")).alias("whole")
    )
    none = F.lit(0).cast("bigint")
    roots = convs.select(
        "conv_id", none.alias("depth"), none.alias("k1"), none.alias("k2"), F.lit(None).cast("bigint").alias("up1"), F.lit(None).cast("bigint").alias("up2"), none.alias("length"), (F.col("total") == 0).alias("whole")
    )
    return materialize(stacked(roots, named), "prefixes")


def rolled_up(nodes: DataFrame, chains: DataFrame, values: Sequence[str], deepest: int, band: int = BAND) -> DataFrame:
    """Sums of ``values`` over each node's subtree.

    ``nodes`` have level, key (a struct), conv_id (a conversation through the node) and the values; ``chains`` the
    (conv_id, level, key) of every prefix of those conversations. Levels go from 0 to ``deepest`` without a gap.
    """
    sums = [F.sum(v).alias(v) for v in values]
    above = chains.select("conv_id", F.col("level").alias("a_level"), F.col("key").alias("a_key"), F.floor(F.col("level") / band).alias("band"))
    lifted = nodes.withColumn("band", F.floor(F.col("level") / band)).join(above, ["conv_id", "band"]).where("a_level <= level")
    within = lifted.groupBy(F.col("a_key").alias("key")).agg(*sums)
    if deepest < band:
        return within
    within = materialize(within, "band-sums")
    tops = nodes.where(F.col("level") % band == 0).select("key", "conv_id", (F.col("level") / band).cast("bigint").alias("level"))
    top_chains = chains.where(F.col("level") % band == 0).select("conv_id", (F.col("level") / band).cast("bigint").alias("level"), "key")
    totals = rolled_up(tops.join(within, "key"), materialize(top_chains, "band-tops"), values, deepest // band, band)
    done = tops.where("level > 0").join(totals, "key").select("conv_id", (F.col("level") - 1).alias("band"), *values)
    given = done.join(above, ["conv_id", "band"]).select(F.col("a_key").alias("key"), *values)
    return stacked(within, given).groupBy("key").agg(*sums)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by node and id; out come the ids of a node as text, in pieces of bounded size that end with a comma."""
    schema = pa.schema([*[(c, pa.int64()) for c in NODE], ("first", pa.int64()), ("ids", pa.string())])
    node, first, ids, size, rows = None, None, [], 0, []

    def ended():
        rows.append((*node, first, "".join(f"{i}," for i in ids)))

    def batch():
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        rows.clear()
        return out

    for part in batches:
        for *key, conv in zip(*(part.column(c).to_pylist() for c in (*NODE, "conv_id"))):
            if key != node or len(ids) * 8 >= CHUNK:
                if node is not None:
                    ended()
                node, first, ids = key, conv, []
            ids.append(conv)
        size = sum(len(r[-1]) for r in rows)
        if size >= CHUNK:
            yield batch()
    if node is not None:
        ended()
    if rows:
        yield batch()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks sorted by node and first id; out comes the SHA-256 of each node's ids."""
    schema = pa.schema([*[(c, pa.int64()) for c in NODE], ("ends_sha256", pa.string())])
    node, digest, held = None, None, b""
    for part in batches:
        rows = []
        for *key, ids in zip(*(part.column(c).to_pylist() for c in (*NODE, "ids"))):
            if key != node:
                if node is not None:
                    digest.update(held[:-1])
                    rows.append((*node, digest.hexdigest()))
                node, digest, held = key, hashlib.sha256(), b""
            digest.update(held)
            held = ids.encode()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    if node is not None:
        digest.update(held[:-1])
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*node, digest.hexdigest()), schema)], schema=schema)


def ends(found: DataFrame) -> DataFrame:
    """SHA-256 over the sorted ids of the conversations that end at a node.

    Ids are sorted and put into text by ranges of (node, id), so a node with many of them is spread over tasks. What is
    left for one task a node is the hash itself, which can't be taken in parts: it streams through the pieces.
    """
    ids = found.where("whole").select(*NODE, "conv_id")
    node = ", ".join(f"{c} bigint" for c in NODE)
    pieces = ids.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").mapInArrow(_chunks, f"{node}, first bigint, ids string")
    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(_digests, f"{node}, ends_sha256 string")


def prefix_trie(turns: DataFrame, band: int = BAND) -> DataFrame:
    """One row for each distinct prefix of the rebuilt conversations (see ``rebuilt``).

    conv_id: least member; depth; parent_conv_id: the parent's conv_id, null for the root; n_convs: members; n_children;
    n_leaves: childless nodes in the subtree; saved_tokens: (members - 1) times the code points of a node's last text,
    summed over its subtree; ends_sha256: over the comma-joined ids of the conversations that end here. Null roles and
    texts count as empty. An empty table, or one without any conv_id, has no node, not even a root.
    """
    found = prefixes(turns)
    nodes = found.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("length").alias("length"), F.max("up1").alias("up1"), F.max("up2").alias("up2"), F.count_if("whole").alias("n_ends")
    )
    nodes = materialize(nodes, "nodes")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    key = F.struct(*NODE)
    # A node without children is one at which all its members end.
    valued = nodes.select(
        F.col("depth").alias("level"), key.alias("key"), "conv_id", (F.col("n_ends") == F.col("n_convs")).cast("bigint").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("length")).alias("saved_tokens")
    )
    totals = rolled_up(valued, found.select("conv_id", F.col("depth").alias("level"), key.alias("key")), ["n_leaves", "saved_tokens"], deepest, band)
    totals = totals.select("key.*", "n_leaves", "saved_tokens")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up1").alias("k1"), F.col("up2").alias("k2")).agg(F.count("*").alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("up1"), F.col("k2").alias("up2"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(totals, list(NODE)).join(children, list(NODE), "left").join(ends(found), list(NODE), "left")
    # Many children of one parent are a skewed key, which Spark splits.
    out = out.join(parents, ["depth", "up1", "up2"], "left")
    return out.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        F.coalesce("n_children", F.lit(0).cast("bigint")).alias("n_children"),
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
