"""Incremental runs over growing folders: finite drains with checkpoints, stateful dedupe, and event-time windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ResumeError
from ..operators.base import Operator, chain
from ..session import column, prepare


def read(spark: SparkSession, folder: str, schema: T.StructType, files_at_once: int = 1000) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return prepare(spark).readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def drain(df: DataFrame, url: str, checkpoint: str, operators: list[Operator] | None = None, mode: str = "append") -> int:
    """Process what is there and stop; a run after a crash goes on from the checkpoint. Returns the rows read by this run."""
    out = chain(df, operators or [])
    try:
        query = out.writeStream.format("parquet").option("path", url).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    except Exception as e:
        raise ResumeError(str(e).splitlines()[0]) from e
    query.awaitTermination()
    return sum(p["numInputRows"] for p in query.recentProgress)


def drain_each(df: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """As drain, with a function for every micro-batch (its number makes a write idempotent)."""
    df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def dedupe(df: DataFrame, keys: list[str], event_time: str | None = None, late: str | None = None) -> DataFrame:
    """First arrival of each key; with an event time, state is dropped once the watermark has passed."""
    if event_time and late:
        return df.withWatermark(event_time, late).dropDuplicatesWithinWatermark(keys)
    return df.dropDuplicates(keys)


def windows(df: DataFrame, event_time: str, late: str, size: str, slide: str | None, keys: list[str], aggregates: list) -> DataFrame:
    """Tumbling (no slide) or sliding windows over event time."""
    w = F.window(column(event_time), size, slide) if slide else F.window(column(event_time), size)
    return df.withWatermark(event_time, late).groupBy(w, *map(column, keys)).agg(*aggregates)


def sessions(df: DataFrame, event_time: str, late: str, gap: str, keys: list[str], aggregates: list) -> DataFrame:
    """Sessions that end after ``gap`` without an event."""
    return df.withWatermark(event_time, late).groupBy(F.session_window(column(event_time), gap), *map(column, keys)).agg(*aggregates)
