"""Voltage deviation by the rule of EN 50160: ten-minute means, of which each
week 95 % have to lie within a narrow band and all within a wide one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattle.sources.schemas import require_columns

# Fixed values of the rule: seconds of a mean, share of a week, both bands.
MEAN_SECONDS, SHARE = 600, 0.95
NARROW, WIDE = (0.90, 1.10), (0.85, 1.10)
_WEEK = 7 * 86400
# Epoch second 0 is a Thursday; weeks begin on Monday.
_MONDAY = 4 * 86400


def _slot(ts: str, width: int, shift: int = 0) -> Column:
    seconds = F.col(ts).cast("timestamp").cast("long") - shift
    return F.timestamp_seconds(F.floor(seconds / width) * width + shift).cast("timestamp_ntz")


def resample(profile: DataFrame, seconds: int = MEAN_SECONDS) -> DataFrame:
    """node, phase, ts (start of the slot), V (mean of its readings) and
    samples. Slots without a reading have no row; readings without a value or
    a time are left out. Readings are combined before the shuffle, so a node
    that is read each second travels as one row for each slot and task."""
    require_columns(profile, ["node", "ts", "phase", "V"], "voltage profile")
    known = profile.where(F.col("V").isNotNull() & F.col("ts").isNotNull())
    return known.groupBy("node", "phase", _slot("ts", seconds).alias("ts")).agg(
        F.avg("V").alias("V"), F.count(F.lit(1)).alias("samples"))


def weekly_deviation(profile: DataFrame, nominal: float, narrow: tuple[float, float] = NARROW,
                     wide: tuple[float, float] = WIDE, share: float = SHARE) -> DataFrame:
    """For each node, phase and week (from Monday): slots, v_min, v_max, v_low
    and v_high (exact quantiles of the ten-minute means), in_narrow and in_wide
    (shares of the means inside the bands, edges included) and compliant.

    v_high is the least mean that ``share`` of the week's means do not exceed,
    v_low the largest one that ``share`` of them reach. Both come from counts
    by value: a week has at most 1008 means, so a group of the cumulative
    count is bounded however often a node is read, and no node is sorted as a
    whole.
    """
    means = resample(profile).select("node", "phase", _slot("ts", _WEEK, _MONDAY).alias("week"), "V")
    key = ["node", "phase", "week"]
    counted = means.groupBy(*key, "V").agg(F.count(F.lit(1)).alias("n"))
    up, down = (Window.partitionBy(*key).orderBy(o) for o in (F.col("V"), F.col("V").desc()))
    total = F.sum("n").over(Window.partitionBy(*key))
    ranked = counted.withColumns({"upto": F.sum("n").over(up), "from": F.sum("n").over(down), "all": total})
    enough = F.ceil(F.col("all") * F.lit(share))

    def inside(band: tuple[float, float]) -> Column:
        within = (F.col("V") >= nominal * band[0]) & (F.col("V") <= nominal * band[1])
        return F.sum(F.when(within, F.col("n")).otherwise(0))

    out = ranked.groupBy(*key).agg(
        F.sum("n").alias("slots"), F.min("V").alias("v_min"), F.max("V").alias("v_max"),
        F.max(F.when(F.col("from") >= enough, F.col("V"))).alias("v_low"),
        F.min(F.when(F.col("upto") >= enough, F.col("V"))).alias("v_high"),
        inside(narrow).alias("n_narrow"), inside(wide).alias("n_wide"))
    return out.select(
        *key, "slots", "v_min", "v_max", "v_low", "v_high", (F.col("n_narrow") / F.col("slots")).alias("in_narrow"),
        (F.col("n_wide") / F.col("slots")).alias("in_wide"),
        ((F.col("n_narrow") >= F.ceil(F.col("slots") * F.lit(share))) & (F.col("n_wide") == F.col("slots"))
         ).alias("compliant"))
