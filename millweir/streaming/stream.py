"""Pipelines on streams: file streams as bronze, steps that work row by row, and event-time windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millweir.functions.conditions import StepError
from millweir.operators.registry import STEPS, Context, run


def file_stream(spark: SparkSession, folder: str, schema: str, kind: str = "parquet", files_per_trigger: int | None = None, **options) -> DataFrame:
    """New files of a folder, with when and from where they came."""
    reader = spark.readStream.format(kind).schema(schema).options(**options)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder).select("*", F.current_timestamp().alias("_ingested_at"), F.col("_metadata.file_path").alias("_source_file"))


def apply_steps(df: DataFrame, steps: list[dict], context: Context) -> DataFrame:
    """Steps on a stream; those that need all rows at once are refused."""
    for s in steps:
        if df.isStreaming and not STEPS[s["type"]].stream_safe:
            raise StepError(f"{s['type']} needs all rows and can't run on a stream; run it in for_each_batch")
        df = run(df, s["type"], s.get("params") or {}, context)
    return df


def for_each_batch(df: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Any batch code on each micro-batch, with progress kept in the checkpoint folder."""
    writer = df.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def tumbling(df: DataFrame, time: str, width: str, late: str, keys: list[str], aggs: list) -> DataFrame:
    """Aggregates by event-time window; rows later than late are left out on a stream."""
    marked = df.withWatermark(time, late) if df.isStreaming else df
    rows = marked.groupBy(F.window(time, width), *keys).agg(*aggs)
    return rows.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *[c for c in rows.columns if c != "window"])


def sessions(df: DataFrame, time: str, gap: str, late: str, keys: list[str], aggs: list) -> DataFrame:
    """Aggregates by session: rows of a key that follow each other within the gap."""
    marked = df.withWatermark(time, late) if df.isStreaming else df
    rows = marked.groupBy(F.session_window(time, gap), *keys).agg(*aggs)
    return rows.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *[c for c in rows.columns if c != "session_window"])


def deduplicated(df: DataFrame, time: str, late: str, keys: list[str]) -> DataFrame:
    """The first row of each key within the watermark."""
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)
