"""Load-shape scenarios: calendar labels, complete days, mean daily curves.

Input rows are (node, ts, <power>) samples. A day counts only when a node
has exactly ``samples_per_day`` rows on that date; curves are means per
0-based timestep of complete days.

Plan shape: the day count is a partial aggregate (a node with many rows is
combined before the shuffle); complete days are kept with a left-semi join on
(node, date), and the timestep window partitions by the same (node, date) so
it reuses the join's shuffle. After the join every group has exactly
``samples_per_day`` rows, so no window group can grow with the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattle.functions.columns import day_kind, season_of
from wattle.functions.joins import dealt_join

DAY_KEYS = ["node", "date"]


def calendar_labels(df: DataFrame, seasons: dict[int, str] | None = None,
                    ts: str = "ts") -> DataFrame:
    """Add day ('weekend'/'weekday'), season (month map) and date columns."""
    return df.withColumns({
        "day": day_kind(ts),
        "season": season_of(ts, seasons),
        "date": F.to_date(F.col(ts)),
    })


def samples_per_day(labelled: DataFrame) -> DataFrame:
    """Rows per (node, date)."""
    return labelled.groupBy(*DAY_KEYS).agg(F.count(F.lit(1)).alias("samples"))


def complete_days(df: DataFrame, samples: int = 96,
                  seasons: dict[int, str] | None = None) -> DataFrame:
    """Labelled rows of the (node, date) pairs with exactly ``samples`` rows.

    The counts are aggregated before their shuffle. In the semi-join, which
    keeps one row of each valid day in memory and sorts nothing, a group far
    larger than a day is a skewed partition of the left side, which AQE splits; what matches, and so every later window, holds one day at most.
    """
    labelled = calendar_labels(df, seasons)
    valid = samples_per_day(labelled).filter(F.col("samples") == samples).select(*DAY_KEYS)
    return dealt_join(labelled, valid, DAY_KEYS, "left_semi")


def _timesteps(days: DataFrame, tie: Sequence[str] = ()) -> DataFrame:
    """Rows of a day numbered by time, those of one time by the ``tie`` columns."""
    w = Window.partitionBy(*DAY_KEYS).orderBy("ts", *tie)
    return days.withColumn("timestep", (F.row_number().over(w) - 1).cast("long"))


def weekend_curve(days: DataFrame, power: str = "P", tie: Sequence[str] = ()) -> DataFrame:
    """Mean ``power`` per (node, timestep) over complete weekend days; ``tie``
    orders rows of one timestamp."""
    wend = _timesteps(days.filter(F.col("day") == "weekend"), tie)
    return wend.groupBy("node", "timestep").agg(F.avg(power).alias(power))


def season_curves(days: DataFrame, power: str = "P", tie: Sequence[str] = ()) -> DataFrame:
    """Mean ``power`` per (season, node, timestep) over complete weekdays.

    Timesteps are numbered within (node, date); season is a function of
    the date, so this equals numbering within (season, node, date).
    """
    wday = _timesteps(days.filter(F.col("day") == "weekday"), tie)
    return wday.groupBy("season", "node", "timestep").agg(F.avg(power).alias(power))


def presentation_order(curve: DataFrame) -> DataFrame:
    """Sorted copy for display only (a global sort is a range shuffle)."""
    keys = [c for c in ("season", "node", "timestep") if c in curve.columns]
    return curve.orderBy(*keys)
