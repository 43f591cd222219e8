"""The refinement queue as a stream: what has arrived is drained once, in batches, with progress in a checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.refine import queued


def arrivals(spark: SparkSession, path: str, schema) -> DataFrame:
    """Rows of a folder of Parquet files, as they are added."""
    return spark.readStream.schema(schema).parquet(path)


def drain(rows: DataFrame, refine: Callable[[DataFrame, int], None], checkpoint: str, text: str = "text", mark: str = "ai_refined_at"):
    """Hands each batch of queued rows to refine(batch, id) and ends when all that is there has been handed over.

    The checkpoint makes it start where it ended; a batch that failed comes again with the same id, so refine should
    write by id.
    """
    waiting = rows.where(queued(F.col(mark), F.col(text)))
    return waiting.writeStream.foreachBatch(refine).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def recent(rows: DataFrame, at: str, now: str, minutes: int) -> DataFrame:
    """Rows of the last minutes before a given moment."""
    return rows.where(F.col(at) >= F.expr(f"timestamp'{now}' - interval {int(minutes)} minutes"))


def rate(events: DataFrame, at: str, window: str, late: str, *by: str) -> DataFrame:
    """Counts per window of event time; rows later than `late` are left out of a stream's state."""
    return events.withWatermark(at, late).groupBy(F.window(at, window), *by).agg(F.count(F.lit(1)).alias("n"))
