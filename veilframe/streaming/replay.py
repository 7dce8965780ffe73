"""Review events as a stream: each micro-batch is appended to a review store.

A micro-batch is a table like any other there, so the events that one document brings are cut into chunks over all tasks;
what is carried from one micro-batch to the next is a row for each document. See ``operators.review_store``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..fixed_values import DISPLAY_ORDER
from ..operators.replay import CHUNK_EVENTS, FAN_IN
from ..operators.review_store import append_events, read_review

__all__ = ["read_review", "read_review_boxes", "stream_review_replay"]


def stream_review_replay(
    log: DataFrame,
    output: str,
    checkpoint: str,
    categories: Sequence[str] = DISPLAY_ORDER,
    chunk_events: int = CHUNK_EVENTS,
    fan_in: int = FAN_IN,
) -> StreamingQuery:
    """Append the streaming log to the store at ``output``; a micro-batch that is run again replaces its own files."""

    def keep(batch: DataFrame, batch_id: int) -> None:
        # Read several times below, and a source is not to be asked twice for one micro-batch.
        batch.persist()
        try:
            append_events(batch, output, batch_id, categories, chunk_events, fan_in)
        finally:
            batch.unpersist()

    writer = log.writeStream.outputMode("append").foreachBatch(keep)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_review_boxes(spark: SparkSession, output: str) -> DataFrame:
    return read_review(spark, output).boxes
