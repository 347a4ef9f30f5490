"""Structured Streaming over newly arriving raw reading files.

The cleaning projections and measure filters are stateless, so the batch
operators apply unchanged to a streaming DataFrame. Raw-value audits become
a running aggregation whose state is one row per distinct invalid value.
Per-(node, day) sample counts run as a watermarked one-day window count.
Consecutive-reading deltas need an ordered window and stay batch-only.
Checkpoints live under the session's shared checkpoint folder, so a restarted
query resumes exactly where it stopped.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from wattle.operators import audits, cleaning
from wattle.session import scratch_path

_CLEANERS = {
    "consumption": cleaning.clean_consumption,
    "voltage": cleaning.clean_voltage,
    "power": cleaning.clean_power,
}


def read_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                max_files_per_trigger: int | None = None) -> DataFrame:
    """New files under ``path`` as a stream (the schema must be declared)."""
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.load(path)


def clean_stream(raw: DataFrame, kind: str, from_ts: str | None = None,
                 to_ts: str | None = None) -> DataFrame:
    """Time window and typed cleaning of a raw reading stream."""
    if kind not in _CLEANERS:
        raise ValueError(f"unknown dataset kind {kind!r}; use one of {sorted(_CLEANERS)}")
    return _CLEANERS[kind](cleaning.time_window(raw, from_ts, to_ts))


def audit_stream(raw: DataFrame, rules: Mapping[str, audits.AuditRule]) -> DataFrame:
    """Running invalid-value counts (single aggregation, as streaming needs)."""
    return audits.run_audits(raw, rules)   # one pass: a single streaming aggregation


def day_counts_stream(samples: DataFrame, watermark: str = "1 day", samples_per_day: int = 96,
                      node: str = "node", ts: str = "ts") -> DataFrame:
    """Rows per (node, calendar day) of a sample stream, final once the
    watermark passes the day's end (append mode), with the complete-day flag.

    State holds only the open days of each node; a day's counts are dropped
    from state when emitted. Samples arriving later than ``watermark``
    behind the newest sample are ignored, as Structured Streaming defines.
    """
    # Watermarks need an instant type; wall-clock (NTZ) timestamps are read in
    # the session time zone, which wattle pins to UTC.
    event = "__event_ts"
    day = F.window(F.col(event), "1 day")
    return (
        samples.withColumn(event, F.col(ts).cast("timestamp"))
        .withWatermark(event, watermark)
        .groupBy(F.col(node), day)
        .agg(F.count(F.lit(1)).alias("samples"))
        .select(
            F.col(node),
            F.to_date(F.col("window.start")).alias("date"),
            "samples",
            (F.col("samples") == samples_per_day).alias("complete"),
        )
    )


def start(df: DataFrame, name: str, sink: str = "parquet", path: str | None = None,
          output_mode: str = "append", checkpoint: str | None = None,
          available_now: bool = True) -> StreamingQuery:
    """Start a streaming write with its checkpoint in the shared folder.

    ``available_now`` processes what has arrived and stops (incremental
    batch); otherwise the query keeps running on the default trigger.
    """
    spark = df.sparkSession
    writer = (
        df.writeStream.queryName(name)
        .outputMode(output_mode)
        .format(sink)
        .option("checkpointLocation", checkpoint or scratch_path(spark, f"stream-{name}"))
    )
    if path:
        writer = writer.option("path", path)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
