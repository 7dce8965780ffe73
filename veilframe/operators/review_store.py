"""A review log that grows: what was walked once is not walked again.

A store is a folder of batches. ``append_events`` walks only the new events, from where each document stood, and appends
them with their depths and a state for every document they touch. The walk is split into chunks as in ``operators.replay``,
so a document's events are spread over tasks however many come at once. ``read_review`` folds what the batches hold into
boxes and states by aggregates.

Events that are not newer than what a document already has are late. None is lost: a document with late events is not
walked any further, and its events, all in the store, are replayed in full when results are read.

A batch that is appended again replaces its own files and starts from the batches before it, so an append that was
interrupted, or repeated by a stream, gives the same.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed_values import DISPLAY_ORDER
from ..session import materialize, stacked
from .boxes import last_write_wins
from .replay import CHUNK_EVENTS, FAN_IN, LOG_TYPES, RESET, Replayed, checked, folded, walked

_WALK = ("kind", "undo_left", "redo_left", "depth", "policy")
_EVENT = ", ".join([*(f"{n} {t}" for n, t in LOG_TYPES.items()), *(f"{n} bigint" for n in _WALK)])
_STATES = {n: "bigint" for n in ("doc_id", "seq", "reset_seq", "late", *_WALK[1:])}
_STATE = ", ".join(f"{n} {t}" for n, t in _STATES.items())


def _rows(spark: SparkSession, store: str, part: str, schema: str) -> DataFrame:
    """Rows of all batches with their batch_id; none where the store has no batch yet."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store}/batch_id=*/part={part}")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.globStatus(path):
        return spark.createDataFrame([], f"{schema}, batch_id bigint")
    reader = spark.read.schema(f"{schema}, batch_id bigint").option("basePath", store)
    return reader.parquet(f"{store}/batch_id=*/part={part}")


def _standing(states: DataFrame) -> DataFrame:
    """The newest state of each document."""
    return last_write_wins(states, ["doc_id"], "batch_id").drop("batch_id")


def append_events(
    log: DataFrame,
    store: str,
    batch_id: int,
    categories: Sequence[str] = DISPLAY_ORDER,
    chunk_events: int = CHUNK_EVENTS,
    fan_in: int = FAN_IN,
) -> None:
    """Append events of any order as batch ``batch_id``; ids rise from append to append. ``seq`` is unique in a document."""
    spark, categories, out = log.sparkSession, checked(categories), f"{store}/batch_id={batch_id}"
    before = _standing(_rows(spark, store, "state", _STATE).where(F.col("batch_id") < batch_id)).withColumnRenamed("seq", "known_seq")
    log = log.select(*LOG_TYPES)
    touched = log.join(before.select("doc_id", "known_seq"), "doc_id", "left").groupBy("doc_id").agg(
        F.max("seq").alias("new_seq"), F.count_if(F.col("seq") <= F.col("known_seq")).alias("new_late"), F.max(F.when(F.col("op") == RESET, F.col("seq"))).alias("new_reset")
    )
    touched = touched.join(before, "doc_id", "left").withColumn("late", F.coalesce("late", F.lit(0)) + F.col("new_late"))
    touched.write.mode("overwrite").parquet(f"{out}/part=touched")
    touched = spark.read.schema(touched.schema).parquet(f"{out}/part=touched")

    plain = log.join(touched.where("late > 0").select("doc_id"), "doc_id", "left_anti")
    rest = log.join(touched.where("late > 0").select("doc_id"), "doc_id", "left_semi")
    known = touched.where("late = 0 AND known_seq IS NOT NULL")
    done = walked(plain, categories, chunk_events, fan_in, known).select(*LOG_TYPES, *_WALK)
    stacked(done, rest).write.mode("overwrite").parquet(f"{out}/part=events")

    ended = spark.read.schema(_EVENT).parquet(f"{out}/part=events").where("depth IS NOT NULL")
    ended = ended.groupBy("doc_id").agg(F.max_by(F.struct(*_WALK[1:]), "seq").alias("e"))
    kept = F.col("new_reset").isNull()
    state = touched.join(ended, "doc_id", "left").select(
        "doc_id",
        F.greatest("known_seq", "new_seq").alias("seq"),
        F.greatest("reset_seq", "new_reset").alias("reset_seq"),
        "late",
        *[F.coalesce(F.col(f"e.{n}"), F.when(kept, F.col(n)), F.lit(0)).alias(n) for n in _WALK[1:]],
    )
    state.write.mode("overwrite").parquet(f"{out}/part=state")


def read_review(spark: SparkSession, store: str, categories: Sequence[str] = DISPLAY_ORDER) -> Replayed:
    """Boxes and state of every document in the store, as the replay of all its events at once gives them."""
    categories = checked(categories)
    states = _standing(_rows(spark, store, "state", _STATE))
    events = _rows(spark, store, "events", _EVENT).drop("batch_id")
    ends = states.select("doc_id", "late", F.coalesce("reset_seq", F.lit(-1)).alias("reset_seq"), F.col("depth").alias("final_depth"))
    # A document with many events is a skewed key of this join, which Spark splits. Events up to a reset don't count any more.
    rows = events.join(ends, "doc_id").where(F.col("seq") > F.col("reset_seq")).drop("reset_seq")
    review = folded(states.where("late = 0"), rows.where("late = 0").drop("late"), categories)
    again = materialize(walked(rows.where("late > 0").select(*LOG_TYPES), categories), "review-walk")
    again = folded(states.where("late > 0"), again, categories)
    return Replayed(stacked(review.boxes, again.boxes), stacked(review.state, again.state))


def states_of(spark: SparkSession, store: str) -> DataFrame:
    """A row for each batch and document it touched: batch_id, doc_id, seq reached, late events so far, undo and redo steps left."""
    return _rows(spark, store, "state", _STATE).select("batch_id", "doc_id", "seq", "late", "undo_left", "redo_left")
