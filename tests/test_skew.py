"""A key holding a third of all rows must not land in a single task."""

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import rows
from wattle.operators.sequence import head_per_group, time_bucket, with_previous

T0 = dt.datetime(2026, 1, 1)


def _skewed(spark):
    hot = [(1, T0 + dt.timedelta(hours=h), float(h)) for h in range(24 * 60)]       # 1440 rows
    cold = [(k, T0 + dt.timedelta(hours=h), 1.0) for k in range(2, 50) for h in range(60)]
    return spark.createDataFrame(hot + cold, "k long, ts timestamp_ntz, v double")


def _partitions_of_key(df, key=1):
    tagged = df.withColumn("p", F.spark_partition_id())   # tag before any filter
    return {r.p for r in tagged.collect() if r.k == key}.__len__()


def test_hot_key_spreads_over_tasks(spark):
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = _skewed(spark)
        plain = df.select("k", F.lag("v").over(Window.partitionBy("k").orderBy("ts")).alias("pv"))
        assert _partitions_of_key(plain) == 1
        spread = with_previous(df, ["k"], ["ts"], ["v"], time_bucket("ts", 86400))
        assert _partitions_of_key(spread) >= 4
        hot = spread.filter(F.col("k") == 1).orderBy("ts").collect()
        assert hot[0].prev_v is None and all(r.prev_v == r.v - 1 for r in hot[1:])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_hot_group_head_ranks_only_around_the_cut(spark):
    rows = [("big", i) for i in range(3000)] + [("small", i) for i in range(30)]
    df = spark.createDataFrame(rows, "layer string, seq long")
    out = head_per_group(df, "layer", ["seq"], 10)
    assert out.filter(F.col("layer") == "big").count() == 300
    assert out.filter(F.col("layer") == "small").count() == 3


def test_oversized_day_is_no_complete_day(spark):
    from wattle.operators import scenarios
    day = [(2, T0 + dt.timedelta(minutes=15 * i), 1.0) for i in range(96)]
    hot = [(1, T0 + dt.timedelta(seconds=i), 1.0) for i in range(5000)]
    df = spark.createDataFrame(day + hot, "node long, ts timestamp_ntz, P double")
    out = scenarios.complete_days(df)
    assert [tuple(r) for r in out.groupBy("node").count().collect()] == [(2, 96)]


def test_ties_of_a_timestamp(spark):
    from wattle.operators import scenarios
    rows_ = [(1, dt.datetime(2026, 1, 3, 0), float(p), s) for s, p in ((2, 5), (1, 7), (0, 9))]  # a Saturday
    df = spark.createDataFrame(rows_, "node long, ts timestamp_ntz, P double, seq long")
    curve = scenarios.weekend_curve(scenarios.complete_days(df, samples=3), tie=["seq"])
    assert rows(curve, "timestep", "P") == [(0, 9.0), (1, 7.0), (2, 5.0)]


def test_one_stray_clock_does_not_coarsen_a_hot_key(spark):
    """Largest (key, bucket) of a hot meter with one timestamp of 1970."""
    from wattle.operators.sequence import _split_hot_keys
    ts = [T0 + dt.timedelta(minutes=10 * i) for i in range(6000)] + [dt.datetime(1970, 1, 1)]
    df = spark.createDataFrame([(1, t, 1.0) for t in ts], "k long, ts timestamp_ntz, v double")
    weekly = time_bucket("ts", 7 * 86400)
    split, bucket = _split_hot_keys(df, ["k"], "ts", weekly, 200)
    sizes = [r["count"] for r in split.select(bucket.alias("b")).groupBy("b").count().collect()]
    assert max(sizes) <= 2 * 200 and sum(sizes) == 6001
    got = with_previous(df, ["k"], ["ts"], ["v"], weekly, order_is_unique=True, target_rows_per_bucket=200)
    w = Window.partitionBy("k").orderBy("ts")
    assert rows(got, "ts", "prev_ts") == rows(df.select("ts", F.lag("ts").over(w).alias("p")))


def test_hot_key_in_one_bucket_is_split(spark):
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        hot = [(None, T0 + dt.timedelta(seconds=i), float(i)) for i in range(3000)]   # NULL key
        cold = [(k, T0 + dt.timedelta(minutes=m), 1.0) for k in range(2, 40) for m in range(30)]
        df = spark.createDataFrame(hot + cold, "k long, ts timestamp_ntz, v double")
        daily = time_bucket("ts", 86400)          # every hot row falls in one day bucket
        plain = with_previous(df, ["k"], ["ts"], ["v"], daily, order_is_unique=True)
        split = with_previous(df, ["k"], ["ts"], ["v"], daily, order_is_unique=True,
                              target_rows_per_bucket=20)
        tagged = split.withColumn("p", F.spark_partition_id())
        parts = {r.p for r in tagged.collect() if r.k is None}
        assert len(parts) >= 4
        w = Window.partitionBy("k").orderBy("ts")
        lagged = df.select("k", "ts", F.lag("v").over(w).alias("pv"))
        assert rows(split, "k", "ts", "prev_v") == rows(lagged)
        assert rows(plain, "k", "ts", "prev_v") == rows(lagged)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_burst_inside_a_bucket_is_cut_by_depth(spark):
    """Nearly all rows of a day within one second: equal widths would leave them together."""
    from wattle.operators.sequence import _split_hot_keys
    ts = [T0 + dt.timedelta(microseconds=100 * i) for i in range(5000)]
    ts += [T0 + dt.timedelta(minutes=i) for i in range(1, 1000)]
    df = spark.createDataFrame([(1, t) for t in ts], "k long, ts timestamp_ntz")
    split, bucket = _split_hot_keys(df, ["k"], "ts", time_bucket("ts", 86400), 100)
    sizes = [r["count"] for r in split.select(bucket.alias("b")).groupBy("b").count().collect()]
    assert max(sizes) <= 2 * 100 and sum(sizes) == len(ts)


def test_second_order_column_does_not_stop_the_split(spark):
    from wattle.operators.sequence import _split_hot_keys
    df = spark.createDataFrame([(1, T0 + dt.timedelta(seconds=i // 2), i) for i in range(2000)],
                               "k long, ts timestamp_ntz, id long")
    got = with_previous(df, ["k"], ["ts", "id"], [], time_bucket("ts", 86400), target_rows_per_bucket=50, bucket_as="b")
    assert max(r["count"] for r in got.groupBy("b").count().collect()) <= 100
    assert rows(got, "id", "prev_id") == [(0, None), *[(i, i - 1) for i in range(1, 2000)]]
