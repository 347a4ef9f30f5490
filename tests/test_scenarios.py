import datetime as dt

from pyspark.sql import functions as F

from conftest import rows
from wattle.functions.columns import DEFAULT_SEASONS
from wattle.operators import scenarios

SAT = dt.datetime(2026, 3, 7)   # a Saturday
MON = dt.datetime(2026, 3, 9)


def _day(node, start, n, p=lambda i: float(i % 4)):
    return [(node, start + dt.timedelta(minutes=15 * (i % 96), seconds=i // 96), p(i))
            for i in range(n)]


def _df(spark, data):
    return spark.createDataFrame(data, "node long, ts timestamp_ntz, P double")


def test_default_seasons_golden():
    assert DEFAULT_SEASONS == {1: "III", 2: "III", 3: "I", 4: "I", 5: "I", 6: "I",
                               7: "V", 8: "II", 9: "II", 10: "II", 11: "II", 12: "V"}


def test_labels(spark):
    df = _df(spark, [(1, SAT, 1.0), (1, MON, 1.0), (1, dt.datetime(2026, 7, 1), 1.0),
                     (1, dt.datetime(2026, 8, 2), 1.0)])
    got = rows(scenarios.calendar_labels(df), "ts", "day", "season", "date")
    assert [r[1:3] for r in got] == [("weekend", "I"), ("weekday", "I"), ("weekday", "V"),
                                     ("weekend", "II")]
    custom = scenarios.calendar_labels(df, seasons={3: "dry"})
    assert rows(custom, "season") == [(None,), (None,), ("dry",), ("dry",)]


def test_complete_day_is_exactly_96(spark):
    data = _day(1, SAT, 95) + _day(2, SAT, 96) + _day(3, SAT, 97) + _day(2, MON, 96)
    days = scenarios.complete_days(_df(spark, data))
    assert rows(days.groupBy("node", "date").count(), "node", "count") == [(2, 96), (2, 96)]


def test_curves_timesteps_and_means(spark):
    data = _day(2, SAT, 96, lambda i: 1.0) + _day(2, SAT + dt.timedelta(days=1), 96,
                                                  lambda i: 3.0)
    data += _day(2, MON, 96, lambda i: float(i))
    days = scenarios.complete_days(_df(spark, data))
    wend = scenarios.weekend_curve(days)
    got = rows(wend, "timestep", "P")
    assert [t for t, _ in got] == list(range(96)) and all(p == 2.0 for _, p in got)
    season = rows(scenarios.season_curves(days), "season", "timestep", "P")
    assert season[0] == ("I", 0, 0.0) and season[-1] == ("I", 95, 95.0)
    assert dict(wend.dtypes)["timestep"] == "bigint"


def test_curves_independent_of_partitioning(spark):
    data = _day(1, SAT, 96) + _day(1, MON, 96) + _day(4, MON, 96)
    df = _df(spark, data)
    a = rows(scenarios.season_curves(scenarios.complete_days(df.repartition(1))))
    b = rows(scenarios.season_curves(scenarios.complete_days(df.repartition(17))))
    assert a == b and len(a) == 192


def test_samples_per_day(spark):
    data = _day(1, SAT, 10) + _day(1, MON, 3)
    got = rows(scenarios.samples_per_day(scenarios.calendar_labels(_df(spark, data))),
               "node", "samples")
    assert got == [(1, 3), (1, 10)]
    assert scenarios.presentation_order(
        scenarios.calendar_labels(_df(spark, data)).groupBy("node").count()).count() == 1
    assert F is not None


def test_valid_days_are_not_gathered_on_the_driver(spark):
    """Nor are the rows sorted twice: once for the window."""
    twice = spark.range(3).selectExpr("id as node", "explode(sequence(timestamp_ntz'2026-03-07 00:00:00', "
                                      "timestamp_ntz'2026-03-08 23:45:00', interval 15 minutes)) as ts").selectExpr(
        "node", "ts", "cast(hour(ts) as double) as P", "explode(array(1, 0)) as seq")
    curve = scenarios.weekend_curve(scenarios.complete_days(twice, samples=192), tie=["seq"])
    plan = curve._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "ShuffledHashJoin" in plan and plan.count("Sort [") == 1
    assert curve.count() == 3 * 192
