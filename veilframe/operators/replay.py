"""Replaying a review log: ordered events per document to final boxes, with undo and redo.

How it stays distributed
------------------------
Every mutating event creates a version of the document one step deeper than the version it changed; undo and
redo only move between versions. So once each event's depth is known, the version of depth d on the way to the
final state is the *last* mutation of depth d (a plain aggregate), and the final boxes follow from the events
on that way with aggregates and key joins.

Depth is the one sequential quantity. The log is sorted by document and ``seq`` over all tasks and cut into chunks
of so many events, by rank and whatever the numbers in ``seq``, so a chunk is bounded however long a document's log
is. A chunk's effect on (undo steps left, redo steps left) is a small table, because both are at most 100
together; a tree of groups combines these tables and gives each chunk its starting state. Then all chunks are
walked independently. A document within one chunk starts from nothing and needs no table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..fixed_values import DISPLAY_ORDER, UNDO_DEPTH
from ..session import materialize, stacked
from .boxes import AUTO, MANUAL_RECT, TEXT_SELECT, as_boxes
from .skew import lookup

# Events that can be undone.
SOURCE_OF_ADD = {"add_auto": AUTO, "add_manual": MANUAL_RECT, "add_text_select": TEXT_SELECT}
MUTATIONS = (*SOURCE_OF_ADD, "toggle_box", "toggle_category", "update_box", "delete_box")
# Events that change the current version in place: selection, and re-detection of a page, which drops the
# page's auto boxes (rescan) and adds new ones that follow the policy (rescan_box).
IN_PLACE = ("select", "focus", "rescan", "rescan_box")
UNDO, REDO, RESET = "undo", "redo", "reset"

LOG_TYPES = {
    "doc_id": "bigint",
    "seq": "bigint",
    "op": "string",
    "box_id": "string",
    "category": "string",
    "page_index": "int",
    "x0": "double",
    "y0": "double",
    "x1": "double",
    "y1": "double",
    "label": "string",
    "enabled": "boolean",
}

CHUNK_EVENTS = 1 << 14
FAN_IN = 1 << 12
MAX_CATEGORIES = 63
# Chunks of one task are numbered from its own number times this.
CHUNKS_PER_TASK = 1 << 20

_IN_PLACE, _MUTATE, _UNDO, _REDO = 0, 1, 2, 3
_START = ("undo_left", "redo_left", "depth", "policy")
_START_FIELDS = ("reset_seq", *_START, "final_depth")


# ---- effect tables -------------------------------------------------------------------------------------


class Effect:
    """What a run of events does to (undo_left, redo_left, depth, policy), for every possible start.

    Up to the first mutation, undo_left moves between 0 and h = undo_left + redo_left, so it becomes
    clip(undo_left + shift, low[h], high[h]). From the first mutation on only undo_left matters, which is
    then q in 1..100: undo[q], redo[q] and the change of depth, gain[q], say where the run ends.
    """

    SPAN = UNDO_DEPTH + 1

    def __init__(self) -> None:
        q = np.arange(self.SPAN)
        self.shift, self.mutated, self.flips = 0, False, 0
        self.low, self.high = np.zeros_like(q), q.copy()
        self.undo, self.redo, self.gain = q.copy(), np.zeros_like(q), np.zeros_like(q)

    def add(self, kind: int, bit: int) -> None:
        self.flips ^= bit
        if kind == _MUTATE:
            if self.mutated:
                self.undo = np.minimum(self.undo + 1, UNDO_DEPTH)
                self.redo = np.zeros_like(self.redo)
                self.gain = self.gain + 1
            self.mutated = True
        elif kind in (_UNDO, _REDO):
            step = -1 if kind == _UNDO else 1
            if self.mutated:
                can = ((self.undo if kind == _UNDO else self.redo) > 0).astype(np.int64) * step
                self.undo, self.redo, self.gain = self.undo + can, self.redo - can, self.gain + can
            else:
                top = np.arange(self.SPAN)
                self.shift += step
                self.low = np.clip(self.low + step, 0, top)
                self.high = np.clip(self.high + step, 0, top)

    def apply(self, undo, redo, depth):
        """End state for start states given as numbers or arrays."""
        whole = undo + redo
        moved = np.clip(undo + self.shift, self.low[whole], self.high[whole])
        depth = depth + moved - undo
        if not self.mutated:
            return moved, whole - moved, depth
        q = np.minimum(moved + 1, UNDO_DEPTH)
        return self.undo[q], self.redo[q], depth + 1 + self.gain[q]

    def then(self, later: Effect) -> Effect:
        out = Effect()
        out.flips = self.flips ^ later.flips
        out.shift, out.low, out.high = self.shift, self.low, self.high
        out.mutated = self.mutated or later.mutated
        if self.mutated:
            out.undo, out.redo, out.gain = later.apply(self.undo, self.redo, self.gain)
        else:
            out.shift = self.shift + later.shift
            out.low = np.clip(self.low + later.shift, later.low, later.high)
            out.high = np.clip(self.high + later.shift, later.low, later.high)
            out.undo, out.redo, out.gain = later.undo, later.redo, later.gain
        return out

    def pack(self) -> bytes:
        head = np.array([self.shift, int(self.mutated), self.flips])
        parts = [head, self.low, self.high, self.undo, self.redo, self.gain]
        return np.concatenate(parts).astype("<i8").tobytes()

    @classmethod
    def unpack(cls, data: bytes) -> Effect:
        flat = np.frombuffer(data, dtype="<i8")
        out = cls()
        out.shift, out.mutated, out.flips = int(flat[0]), bool(flat[1]), int(flat[2])
        out.low, out.high, out.undo, out.redo, out.gain = flat[3:].reshape(5, cls.SPAN)
        return out


# ---- per-partition helpers -----------------------------------------------------------------------------


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """Regroup sorted batches so that no (doc_id, chunk) is split; a group is at most one chunk."""

    def bounds(table: pa.Table) -> np.ndarray:
        doc, chunk = table["doc_id"].to_numpy(), table["chunk"].to_numpy()
        return np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (chunk[1:] != chunk[:-1])])

    def ranges(starts: np.ndarray, end: int) -> list[tuple[int, int]]:
        return list(zip(starts.tolist(), [*starts[1:].tolist(), end], strict=True))

    pending = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if pending is not None:
            table = pa.concat_tables([pending, table])
        if table.num_rows == 0:
            continue
        starts = bounds(table)
        cut = int(starts[-1])
        if cut:
            yield table.slice(0, cut), ranges(starts[:-1], cut)
        pending = table.slice(cut)
    if pending is not None:
        yield pending, [(0, pending.num_rows)]


def _ints(table: pa.Table, name: str, missing: int) -> list[int]:
    return table[name].fill_null(missing).to_pylist()


def _summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table, groups in _whole_groups(batches):
        kind, bit, seq = (_ints(table, n, 0) for n in ("kind", "bit", "seq"))
        reset = _ints(table, "reset_seq", -1)
        effects = []
        for first, last in groups:
            effect = Effect()
            for i in range(first + 1, last):  # the first row of a group is its header
                if seq[i] > reset[first]:
                    effect.add(kind[i], bit[i])
            effects.append(effect.pack())
        heads = table.select(["doc_id", "chunk"]).take(pa.array([g[0] for g in groups]))
        yield from heads.append_column("effect", pa.array(effects, pa.binary())).to_batches()


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to each event the state after it, and drops headers and events before the last reset."""
    for table, groups in _whole_groups(batches):
        kind, bit, seq = (_ints(table, n, 0) for n in ("kind", "bit", "seq"))
        reset = _ints(table, "reset_seq", -1)
        starts = {n: _ints(table, n, 0) for n in ("undo_left", "redo_left", "depth", "policy")}
        known_final = _ints(table, "final_depth", -1)
        keep, undo_out, redo_out, depth_out, policy_out, final_out = [], [], [], [], [], []
        for first, last in groups:
            undo, redo = starts["undo_left"][first], starts["redo_left"][first]
            depth, policy = starts["depth"][first], starts["policy"][first]
            before = len(keep)
            for i in range(first + 1, last):
                if seq[i] <= reset[first]:
                    continue
                what = kind[i]
                if what == _MUTATE:
                    undo, redo, depth = min(undo + 1, UNDO_DEPTH), 0, depth + 1
                elif what == _UNDO and undo > 0:
                    undo, redo, depth = undo - 1, redo + 1, depth - 1
                elif what == _REDO and redo > 0:
                    undo, redo, depth = undo + 1, redo - 1, depth + 1
                if what == _MUTATE:
                    policy ^= bit[i]
                keep.append(i)
                undo_out.append(undo)
                redo_out.append(redo)
                depth_out.append(depth)
                policy_out.append(policy)
            final = known_final[first] if known_final[first] >= 0 else depth
            final_out.extend([final] * (len(keep) - before))
        if not keep:
            continue
        out = table.take(pa.array(keep))
        new = dict(zip(_START_FIELDS, (None, undo_out, redo_out, depth_out, policy_out, final_out), strict=True))
        for name, values in new.items():
            if values is not None:
                position = out.schema.get_field_index(name)
                out = out.set_column(position, name, pa.array(values, pa.int64()))
        yield from out.to_batches()


def _combine(group: pd.DataFrame) -> pd.DataFrame:
    effects = [Effect.unpack(e) for e in group.sort_values("chunk")["effect"]]
    total = effects[0]
    for effect in effects[1:]:
        total = total.then(effect)
    head = group.iloc[0]
    return pd.DataFrame({"doc_id": [head.doc_id], "chunk": [head.parent], "effect": [total.pack()]})


def _unroll(group: pd.DataFrame) -> pd.DataFrame:
    """Starting states of the chunks of one group, from that of the group (nothing where it has none)."""
    head = group.iloc[0]
    undo, redo, depth, policy = (int(head[n]) for n in ("undo_left", "redo_left", "depth", "policy"))
    rows = []
    for row in group.sort_values("chunk").itertuples():
        rows.append((row.doc_id, row.chunk, undo, redo, depth, policy))
        effect = Effect.unpack(row.effect)
        undo, redo, depth = (int(v) for v in effect.apply(undo, redo, depth))
        policy ^= effect.flips
    out = pd.DataFrame(rows, columns=["doc_id", "chunk", "undo_left", "redo_left", "depth", "policy"])
    out["final_depth"] = depth if head.final_depth < 0 else head.final_depth
    return out


# ---- depths --------------------------------------------------------------------------------------------


def walked(
    log: DataFrame,
    categories: tuple[str, ...],
    chunk_events: int = CHUNK_EVENTS,
    fan_in: int = FAN_IN,
    known: DataFrame | None = None,
) -> DataFrame:
    """Events after each document's last reset, with undo_left, redo_left, depth and policy after each.

    ``known`` (doc_id, undo_left, redo_left, depth, policy) says where documents stand whose earlier events are not in
    the log; the others start from nothing.
    """
    kind = (
        F.when(F.col("op").isin(*MUTATIONS), _MUTATE)
        .when(F.col("op") == UNDO, _UNDO)
        .when(F.col("op") == REDO, _REDO)
        .otherwise(_IN_PLACE)
    )
    bits = F.create_map(*[F.lit(v) for i, c in enumerate(categories) for v in (c, 1 << i)])
    bit = F.when(F.col("op") == "toggle_category", F.element_at(bits, F.col("category"))).otherwise(0)
    events = log.select(
        *LOG_TYPES,
        kind.cast("bigint").alias("kind"),
        F.coalesce(bit, F.lit(0)).cast("bigint").alias("bit"),
        F.lit(1).alias("place"),
        *[F.lit(None).cast("bigint").alias(n) for n in _START_FIELDS],
    )
    ranked = events.repartitionByRange("doc_id", "seq").sortWithinPartitions("doc_id", "seq")
    row = F.monotonically_increasing_id()  # the task's number, and the row's in the task
    chunk = F.shiftright(row, 33) * CHUNKS_PER_TASK + F.floor(row.bitwiseAND((1 << 33) - 1) / chunk_events)
    events = materialize(ranked.withColumn("chunk", chunk.cast("bigint")), "review-chunks")
    docs = events.groupBy("doc_id").agg(
        F.max(F.when(F.col("op") == RESET, F.col("seq"))).alias("reset_seq"),
        F.min("chunk").alias("chunk"),
        F.max("chunk").alias("last"),
    )
    if known is not None:
        # A reset in the log makes an end of what was before it.
        docs = docs.join(known.select("doc_id", *_START), "doc_id", "left")
        docs = docs.withColumns({n: F.when(F.col("reset_seq").isNull(), F.col(n)) for n in _START})
    there = [n for n in _START if n in docs.columns]
    single = docs.where("chunk = last").select("doc_id", "chunk", "reset_seq", *there)
    several = docs.where("chunk <> last").select("doc_id", "reset_seq", *there)
    long_events = events.join(several.select("doc_id"), "doc_id", "left_semi")
    chunks = long_events.select("doc_id", "chunk").distinct().join(several.select("doc_id", "reset_seq"), "doc_id")
    starts = chunks.join(_starts(long_events, chunks, fan_in, several if there else None), ["doc_id", "chunk"])
    arranged = _with_headers(events, stacked(single, starts))
    schema = StructType([StructField(f.name, f.dataType, True) for f in arranged.schema])
    return arranged.mapInArrow(_walk, schema)


def _with_headers(events: DataFrame, headers: DataFrame) -> DataFrame:
    """One header per chunk, sorted ahead of the chunk's events, brings what the chunk needs to know.

    That takes the place of a join, and every key here (document, chunk) is bounded.
    """
    both = stacked(events, headers.withColumn("place", F.lit(0)))
    return both.repartition("doc_id", "chunk").sortWithinPartitions("doc_id", "chunk", "place", "seq")


def _starts(events: DataFrame, chunks: DataFrame, fan_in: int, known: DataFrame | None) -> DataFrame:
    """State at the start of every chunk of the long logs, by a tree of groups of at most ``fan_in`` neighbours.

    The last two levels join a task's chunks, and then runs of tasks; what is left for one group at the top is a
    document's share of the number of tasks, divided by ``fan_in``.
    """
    lean = events.select("doc_id", "chunk", "seq", "kind", "bit", "place", "reset_seq")
    effects = _with_headers(lean, chunks).mapInArrow(_summarize, "doc_id bigint, chunk bigint, effect binary")
    effects = materialize(effects, "review-effects")
    state = "undo_left bigint, redo_left bigint, depth bigint, policy bigint, final_depth bigint"
    levels = []
    for divisor in (fan_in, max(1, CHUNKS_PER_TASK // fan_in), fan_in):
        effects = effects.withColumn("parent", F.floor(F.col("chunk") / divisor).cast("bigint"))
        levels.append(effects)
        effects = effects.groupBy("doc_id", "parent").applyInPandas(_combine, "doc_id bigint, chunk bigint, effect binary")
    zero = F.lit(0).cast("bigint")
    if known is None:
        top = effects.withColumns(dict.fromkeys(_START, zero))
    else:
        top = effects.join(known.drop("reset_seq"), "doc_id").withColumns({n: F.coalesce(n, zero) for n in _START})
    top = top.withColumn("final_depth", F.lit(-1).cast("bigint"))
    starts = top.groupBy("doc_id").applyInPandas(_unroll, f"doc_id bigint, chunk bigint, {state}")
    for level in reversed(levels):
        known = level.join(starts.withColumnRenamed("chunk", "parent"), ["doc_id", "parent"])
        starts = known.groupBy("doc_id", "parent").applyInPandas(_unroll, f"doc_id bigint, chunk bigint, {state}")
    return starts


# ---- folding -------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Replayed:
    """``boxes`` as in operators.boxes; ``state`` is one row per document of the log."""

    boxes: DataFrame
    state: DataFrame


def _newest(value: Column, when: Column) -> Column:
    return F.max_by(value, F.when(when, F.col("seq")))


def _effective(walked: DataFrame) -> DataFrame:
    """The events that made the final version: mutations on the way to it, and what was done in place to
    each version on the way before the next one was made from it."""
    on_way = walked.where(F.col("depth") <= F.col("final_depth"))
    mutations = on_way.where(F.col("kind") == _MUTATE)
    payload = [c for c in walked.columns if c not in ("doc_id", "depth")]
    way = mutations.groupBy("doc_id", "depth").agg(F.max_by(F.struct(*payload), "seq").alias("e"))
    way = way.select("doc_id", "depth", "e.*")
    slots = (
        mutations.select(
            "doc_id",
            F.inline(
                F.array(
                    F.struct(F.col("depth").alias("depth"), F.col("seq").alias("made"), F.lit(None).cast("bigint").alias("left")),
                    F.struct((F.col("depth") - 1).alias("depth"), F.lit(None).cast("bigint").alias("made"), F.col("seq").alias("left")),
                )
            ),
        )
        .groupBy("doc_id", "depth")
        .agg(F.max("made").alias("made"), F.max("left").alias("left"))
    )
    in_place = on_way.where(F.col("op").isin(*IN_PLACE))
    placed = lookup(in_place, slots, ["doc_id", "depth"])
    yes = F.lit(True)
    within = F.coalesce(F.col("seq") > F.col("made"), yes) & F.coalesce(F.col("seq") < F.col("left"), yes)
    return stacked(placed.where(within).select(walked.columns), way.select(walked.columns))


def _final_boxes(events: DataFrame, categories: tuple[str, ...]) -> DataFrame:
    op = F.col("op")
    place = F.array_position(F.array(*[F.lit(c) for c in categories]), F.col("category"))
    position = F.when(place > 0, place - 1)
    policy_on = F.coalesce(F.getbit(F.col("policy"), position.cast("int")) == 0, F.lit(True))

    adds = (*SOURCE_OF_ADD, "rescan_box")
    sources = F.create_map(*[F.lit(v) for item in SOURCE_OF_ADD.items() for v in item], F.lit("rescan_box"), F.lit(AUTO))
    is_add, is_update = op.isin(*adds), op == "update_box"
    born = F.struct(
        "seq",
        "op",
        "page_index",
        "x0",
        "y0",
        "x1",
        "y1",
        F.when(F.element_at(sources, op) == AUTO, F.col("category")).alias("category"),
        F.when(op == "add_manual", F.col("label")).alias("label"),
        F.element_at(sources, op).alias("source"),
        F.when(op == "rescan_box", policy_on).otherwise(F.lit(True)).alias("enabled"),
    )

    def patch(name: str, *fields: str) -> Column:
        given = is_update & F.col(fields[0]).isNotNull()
        return _newest(F.struct("seq", *fields), given).alias(name)

    per_box = (
        events.where(is_add | is_update | (op == "delete_box"))
        .groupBy("doc_id", F.col("box_id").alias("id"))
        .agg(
            _newest(born, is_add | (op == "delete_box")).alias("life"),
            patch("xy", "x0", "y0", "x1", "y1"),
            patch("named", "label"),
            patch("set", "enabled"),
        )
        .where(F.col("life.op").isin(*adds))
    )
    per_box = per_box.select(
        "*", F.col("life.page_index").alias("page_index"), F.col("life.category").alias("category")
    )
    auto = F.col("life.source") == AUTO

    rescans = events.where(op == "rescan").groupBy("doc_id", "page_index").agg(F.max("seq").alias("rescanned"))
    per_box = lookup(per_box, rescans, ["doc_id", "page_index"])
    per_box = per_box.where(~(auto & F.coalesce(F.col("rescanned") > F.col("life.seq"), F.lit(False))))

    switched = (
        events.where(op == "toggle_category")
        .groupBy("doc_id", "category")
        .agg(F.max_by(F.struct("seq", policy_on.alias("enabled")), "seq").alias("switched"))
    )
    per_box = lookup(per_box, switched, ["doc_id", "category"])

    # The last event that set ``enabled`` outright; box toggles after it flip it.
    def as_set(struct_name: str, applies: Column) -> Column:
        s = F.col(struct_name)
        late = applies & (s["seq"] > F.col("life.seq"))
        return F.when(late, F.struct(s["seq"].alias("seq"), s["enabled"].alias("enabled")))

    first = F.struct(F.col("life.seq").alias("seq"), F.col("life.enabled").alias("enabled"))
    outright = F.greatest(first, as_set("set", F.lit(True)), as_set("switched", auto))
    per_box = per_box.withColumn("outright", outright)

    toggles = events.where(op == "toggle_box").select("doc_id", F.col("box_id").alias("id"), "seq")
    since = per_box.select("doc_id", "id", F.col("outright.seq").alias("set_seq"))
    counted = lookup(toggles, since, ["doc_id", "id"]).where(F.col("seq") > F.col("set_seq"))
    flips = counted.groupBy("doc_id", "id").agg(F.count(F.lit(1)).alias("flips"))
    final = per_box.join(flips, ["doc_id", "id"], "left")

    def latest(struct_name: str, field: str) -> Column:
        s = F.col(struct_name)
        return F.when(s["seq"] > F.col("life.seq"), s[field]).otherwise(F.col(f"life.{field}"))

    odd = F.coalesce(F.col("flips"), F.lit(0)) % 2 == 1
    return as_boxes(
        final,
        **{k: latest("xy", k) for k in ("x0", "y0", "x1", "y1")},
        label=latest("named", "label"),
        source=F.col("life.source"),
        enabled=F.col("outright.enabled") != odd,
    )


def _final_state(log: DataFrame, walked: DataFrame, events: DataFrame, categories: tuple[str, ...]) -> DataFrame:
    op = F.col("op")
    docs = log.select("doc_id").distinct()
    last = walked.groupBy("doc_id").agg(
        F.max_by(F.struct("undo_left", "redo_left", "policy"), "seq").alias("s"),
        F.count_if(op == "focus").alias("focus_count"),
    )
    picked = (
        events.where(op.isin("select", "focus"))
        .groupBy("doc_id")
        .agg(F.max_by(F.struct("box_id", "seq"), "seq").alias("p"))
        .select("doc_id", F.col("p.box_id").alias("box_id"), F.col("p.seq").alias("picked_seq"))
        .where(F.col("box_id").isNotNull())
    )
    deleted = (
        events.where(op == "delete_box").groupBy("doc_id", "box_id").agg(F.max("seq").alias("deleted_seq"))
    )
    selected = picked.join(deleted, ["doc_id", "box_id"], "left").where(
        F.coalesce(F.col("deleted_seq") < F.col("picked_seq"), F.lit(True))
    )
    state = docs.join(last, "doc_id", "left").join(
        selected.select("doc_id", F.col("box_id").alias("selected_box_id")), "doc_id", "left"
    )
    zero = F.lit(0).cast("bigint")
    policy = F.coalesce(F.col("s.policy"), zero)
    return state.select(
        "doc_id",
        "selected_box_id",
        F.coalesce(F.col("focus_count"), zero).alias("focus_count"),
        F.coalesce(F.col("s.undo_left"), zero).alias("undo_left"),
        F.coalesce(F.col("s.redo_left"), zero).alias("redo_left"),
        *[(F.getbit(policy, F.lit(i)) == 0).alias(f"{c}_on") for i, c in enumerate(categories)],
    )


def checked(categories: Sequence[str]) -> tuple[str, ...]:
    if len(categories) > MAX_CATEGORIES:
        raise ValueError(f"a policy can hold {MAX_CATEGORIES} categories, not {len(categories)}")
    return tuple(categories)


def folded(docs: DataFrame, done: DataFrame, categories: tuple[str, ...]) -> Replayed:
    """Boxes and states of ``docs`` from their walked events; nothing in this needs the events in order."""
    events = materialize(_effective(done), "review-events")
    return Replayed(_final_boxes(events, categories), _final_state(docs, done, events, categories))


def replay_review_log(
    log: DataFrame,
    categories: tuple[str, ...] = DISPLAY_ORDER,
    chunk_events: int = CHUNK_EVENTS,
    fan_in: int = FAN_IN,
) -> Replayed:
    """Final boxes and state of every document in the log.

    ``seq`` is unique and not negative within a document. ``categories``, 63 at most, are those a policy exists for;
    toggling another takes an undo step, and leaves its boxes enabled as its policy always is.
    The events with their depths, and those that count, are written to the shared folder, as everything
    after reads them several times.
    """
    done = materialize(walked(log, checked(categories), chunk_events, fan_in), "review-walk")
    return folded(log, done, tuple(categories))
