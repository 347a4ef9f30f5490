"""Runs of readings in which a condition holds, as rows (start, end, sums)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattle.operators.energy import DEFAULT_BUCKET_SECONDS, HOT_METER_ROWS
from wattle.operators.sequence import time_bucket, with_previous
from wattle.sources.schemas import require_columns


def periods(df: DataFrame, on: Column, node: str, ts: str, max_gap_seconds: int, sums: dict[str, Column],
            peaks: dict[str, Column], bucket_seconds: int = DEFAULT_BUCKET_SECONDS,
            hot_rows: int | None = HOT_METER_ROWS) -> DataFrame:
    """Maximal runs of a node's consecutive readings for which ``on`` holds:
    node, start_ts, end_ts, samples, and the sum or maximum of each expression.

    A reading that does not meet ``on`` ends a run (NULL counts as not), and so
    does a gap of more than ``max_gap_seconds`` to the next reading. Readings
    of one node and time must be one row; those without a time are left out.

    Runs are found inside (node, time bucket), in which a hot node's readings
    are cut further. A bucket that begins inside a run knows so from the
    reading carried into it, and hands its part of the run to the last run
    begun before. Only such parts and the last run begun in each bucket, two
    rows per (node, bucket) at most, are ordered along the node; the others are
    whole and stay by bucket. So the parts are made once.
    """
    names = {**sums, **peaks}
    rows = df.where(F.col(ts).isNotNull()).select(
        F.col(node).alias("node"), F.col(ts).alias("ts"), F.coalesce(on, F.lit(False)).alias("on"),
        *[c.alias(n) for n, c in names.items()])
    rows = with_previous(rows, ["node"], ["ts"], ["on"], time_bucket("ts", bucket_seconds), "prev_",
                         order_is_unique=True, target_rows_per_bucket=hot_rows, bucket_as="bucket")
    micros = [F.unix_micros(F.col(c).cast("timestamp")) for c in ("ts", "prev_ts")]
    follows = F.coalesce(F.col("prev_on"), F.lit(False)) & (micros[0] - micros[1] <= max_gap_seconds * 1_000_000)
    begins = F.col("on") & ~F.coalesce(follows, F.lit(False))
    # Runs begun so far in the bucket; 0: what is left of an earlier bucket's run.
    place = F.sum(begins.cast("long")).over(Window.partitionBy("node", "bucket").orderBy("ts"))
    parts = rows.withColumn("place", place).where("on").groupBy("node", "bucket", "place").agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count(F.lit(1)).alias("samples"),
        *[F.sum(n).alias(n) for n in sums], *[F.max(n).alias(n) for n in peaks])

    latest = F.max("place").over(Window.partitionBy("node", "bucket"))
    linked = parts.withColumn("last", latest).withColumn(
        "apart", F.when((F.col("place") > 0) & (F.col("place") < F.col("last")), F.col("bucket")))
    upto = Window.partitionBy("node", "apart").orderBy("bucket", "place").rowsBetween(Window.unboundedPreceding, 0)
    begun = F.last(F.when(F.col("place") > 0, F.struct("bucket", "place")), ignorenulls=True).over(upto)
    whole = linked.withColumn("run", begun).drop("bucket", "place", "last", "apart")
    return whole.groupBy("node", "run").agg(
        F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), F.sum("samples").alias("samples"),
        *[F.sum(n).alias(n) for n in sums], *[F.max(n).alias(n) for n in peaks]).drop("run")


def reverse_flow_periods(active: DataFrame, max_gap_seconds: int = 900, net: bool = False,
                         bucket_seconds: int = DEFAULT_BUCKET_SECONDS,
                         hot_rows: int | None = HOT_METER_ROWS) -> DataFrame:
    """Periods in which a node feeds power back: node, start_ts, end_ts,
    samples, energy and peak.

    Without ``net`` every reading with P_Pgen > 0 counts, energy is the sum of
    E_Egen and peak the largest P_Pgen. With it only net generation counts
    (P_Pgen above P_Pdem, NULL as 0), and energy and peak are net as well.
    Energy is NULL where no reading of the period has any.
    """
    require_columns(active, ["node", "ts", "P_Pdem", "P_Pgen", "E_Edem", "E_Egen"], "active profile")
    if not net:
        return periods(active, F.col("P_Pgen") > 0, "node", "ts", max_gap_seconds, {"energy": F.col("E_Egen")},
                       {"peak": F.col("P_Pgen")}, bucket_seconds, hot_rows)
    value = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("P_Pdem", "P_Pgen", "E_Edem", "E_Egen")}
    return periods(active, value["P_Pgen"] > value["P_Pdem"], "node", "ts", max_gap_seconds,
                   {"energy": value["E_Egen"] - value["E_Edem"]}, {"peak": value["P_Pgen"] - value["P_Pdem"]},
                   bucket_seconds, hot_rows)
