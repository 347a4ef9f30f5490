"""Skew check: one meter holding a third of all consumption rows.

Derives consumption readings from the test tables, assigns every third
customer's readings to one meter, and reports for the per-meter lag the
largest share of rows handled by one output partition (task): plain
``lag`` over ``partitionBy(meter)`` against :func:`with_previous` as used by
``energy_deltas``. Also checks that both give the same values.

    python tools/skew_check.py [--sf /root/testdata/sf0.1] [--hot-rows 50000]
"""

from __future__ import annotations

import argparse
import json
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.1")
    ap.add_argument("--hot-rows", type=int, default=500)
    args = ap.parse_args()

    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from wattle.operators import cleaning, energy, measures
    from wattle.session import build_session, scratch_path
    from wattle.sources.fixtures import build_view

    spark = build_session("local[8]", shuffle_partitions=32)
    spark.sparkContext.setLogLevel("ERROR")
    # measure how the work is split, not how AQE packs small partitions
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    raw = build_view(spark, args.sf, "consumption_raw")
    # customers with c % 3 == 0 (seq = c*1000 + ...) all report as meter 1000,
    # each shifted by c seconds so the meter keeps one row per reading.
    is_hot = F.col("seq") % 3000 < 1000
    shift = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0),
                               F.floor(F.col("seq") / 1000).cast("decimal(18,6)"))
    hot = raw.withColumns({
        "MEDIDOR": F.when(is_hot, F.lit("1000")).otherwise(F.col("MEDIDOR")),
        "FECHA_LECTURA_REAL": F.when(is_hot, F.col("FECHA_LECTURA_REAL") + shift)
        .otherwise(F.col("FECHA_LECTURA_REAL")),
    })
    path = scratch_path(spark, "skewed")
    hot.write.parquet(path)
    ene = measures.split(cleaning.clean_consumption(spark.read.parquet(path)), "energy")
    pivot = energy.energy_pivot(ene)

    w = Window.partitionBy("MEDIDOR").orderBy("FECHA_LECTURA")
    plain = pivot.select("MEDIDOR", "FECHA_LECTURA",
                         (F.col("Delivered") - F.lag("Delivered").over(w)).alias("Daily Sent"))
    spread = energy.energy_deltas(ene, hot_rows=args.hot_rows).select(
        "MEDIDOR", "FECHA_LECTURA", "Daily Sent")

    def max_share(df):
        # aggregate the lagged column too, so the window stays in the plan and
        # the partition id is the window task's
        per = (df.select(F.spark_partition_id().alias("p"), "Daily Sent").groupBy("p")
               .agg(F.count(F.lit(1)).alias("n"), F.count("Daily Sent").alias("nd"))
               .collect())                       # one row per partition: bounded
        total = sum(r.n for r in per)
        return round(max(r.n for r in per) / total, 4), total

    hot_share = pivot.filter(F.col("MEDIDOR") == 1000).count() / pivot.count()
    same = plain.exceptAll(spread).isEmpty() and spread.exceptAll(plain).isEmpty()

    # Complete days: one (node, date) with a third of all samples.
    from wattle.operators import scenarios
    from wattle.plans import catalog

    samples = catalog._scenario_input(spark, args.sf)
    n = samples.count()
    crowd = (spark.range(n // 2).select(
        F.lit(-1).cast("long").alias("node"),
        (F.lit("2026-02-02 00:00:00").cast("timestamp_ntz")
         + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0),
                              (F.col("id") / 1000).cast("decimal(18,6)"))).alias("ts"),
        F.lit(1.0).alias("P")))
    skewed = samples.unionByName(crowd)

    def day_share(df):
        per = (df.select(F.spark_partition_id().alias("p"), "timestep").groupBy("p")
               .agg(F.count(F.lit(1)).alias("n"), F.count("timestep").alias("nt")).collect())
        return round(max(r.n for r in per) / sum(r.n for r in per), 4)

    def steps(days):
        from pyspark.sql import Window as W
        return days.withColumn("timestep", F.row_number().over(
            W.partitionBy("node", "date").orderBy("ts")))

    def semi_only(df):
        lab = scenarios.calendar_labels(df)
        valid = scenarios.samples_per_day(lab).filter("samples = 96").select("node", "date")
        return lab.join(valid, ["node", "date"], "left_semi")

    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")  # cluster-size keys
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    # the shuffle before the join reads every labelled row, crowded day included
    labelled = scenarios.calendar_labels(skewed).withColumn("timestep", F.lit(0))
    pre_semi = labelled.repartition("node", "date")
    print(json.dumps({
        "hot_meter_share_of_rows": round(hot_share, 4),
        "largest_task_share_plain_lag": max_share(plain)[0],
        "largest_task_share_with_previous": max_share(spread)[0],
        "same_values": same,
        "crowded_day_share_of_rows": round((n // 2) / (n + n // 2), 4),
        "largest_join_input_share": day_share(pre_semi),
        "same_complete_days": scenarios.complete_days(skewed).exceptAll(
            semi_only(skewed)).isEmpty(),
        "largest_window_task_share": day_share(steps(scenarios.complete_days(skewed))),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
