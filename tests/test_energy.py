import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import rows
from wattle.operators.energy import energy_deltas, energy_pivot
from wattle.operators.sequence import time_bucket, with_previous

T0 = dt.datetime(2026, 3, 1)


def _ene(spark, data):
    return spark.createDataFrame(
        [(m, T0 + dt.timedelta(days=d) if d is not None else None, op, v, s, 0.0)
         for m, d, op, v, s in data],
        "MEDIDOR long, FECHA_LECTURA timestamp_ntz, OPERACION string, VALOR_LECTURA double, "
        "seq long, Hour double")


def test_pivot_first_by_sequence_is_order_independent(spark):
    data = [(1, 0, "Delivered", 5.0, 2), (1, 0, "Delivered", 7.0, 1), (1, 0, "Received", None, 0),
            (1, 0, "Received", 3.0, 4), (2, 0, "Received", 1.0, 9)]
    ene = _ene(spark, data)
    want = [(1, 7.0, 3.0), (2, None, 1.0)]
    for parts in (1, 17):
        got = rows(energy_pivot(ene.repartition(parts)), "MEDIDOR", "Delivered", "Received")
        assert got == want


def test_pivot_drops_null_keys_and_empty_rows(spark):
    ene = _ene(spark, [(None, 0, "Delivered", 1.0, 1), (3, None, "Delivered", 1.0, 2),
                       (4, 0, "Delivered", None, 3), (5, 0, "Delivered", 2.0, 4)])
    assert rows(energy_pivot(ene), "MEDIDOR") == [(5,)]
    assert energy_pivot(ene, keep_null_keys=True).count() == 4


def test_deltas_single_reset_and_null(spark):
    data = [(1, 0, "Delivered", 10.0, 1), (1, 1, "Delivered", 15.0, 2),
            (1, 3, "Delivered", 2.0, 3),                      # register reset, 2-day gap
            (1, 4, "Received", 1.0, 4), (1, 5, "Delivered", 4.0, 5),
            (2, 0, "Delivered", 1.0, 6)]                      # single reading
    out = energy_deltas(_ene(spark, data), bucket_seconds=86400)
    got = rows(out, "MEDIDOR", "FECHA_LECTURA", "Period", "Daily Sent", "Daily Gotten")
    d = lambda n: T0 + dt.timedelta(days=n)
    assert got == [
        (1, d(0), None, None, None), (1, d(1), 86400, 5.0, None), (1, d(3), 172800, -13.0, None),
        (1, d(4), 86400, None, None), (1, d(5), 86400, None, None), (2, d(0), None, None, None)]


def test_with_previous_equals_lag(spark):
    rnd = random.Random(7)
    data = []
    for i in range(600):
        key = rnd.choice([None, 1, 2, 3, 3, 3, 3, 4])       # key 3 is hot
        ts = None if rnd.random() < 0.03 else T0 + dt.timedelta(minutes=rnd.randrange(20000))
        data.append((key, ts, i, rnd.choice([None, 1.0, 2.5, 7.0])))
    df = spark.createDataFrame(data, "k long, ts timestamp_ntz, id long, v double")
    w = Window.partitionBy("k").orderBy("ts", "id")
    want = rows(df.select("id", F.lag("v").over(w), F.lag("ts").over(w)))
    for width in (600, 3600 * 7, 10 ** 9):
        got = with_previous(df, ["k"], ["ts", "id"], ["v"], time_bucket("ts", width))
        assert rows(got, "id", "prev_v", "prev_ts") == want


def test_with_previous_single_time_order_fast_path(spark):
    rnd = random.Random(11)
    data, seen = [], set()
    while len(data) < 500:
        key = rnd.choice([None, 1, 2, 2, 2, 5])
        minute = rnd.randrange(30000)
        if (key, minute) in seen:
            continue
        seen.add((key, minute))
        ts = T0 + dt.timedelta(minutes=minute) if rnd.random() > 0.01 else None
        if ts is None and (key, None) in seen:
            continue
        seen.add((key, None) if ts is None else (key, minute))
        data.append((key, ts, len(data), rnd.choice([None, 1.0, 4.0])))
    df = spark.createDataFrame(data, "k long, ts timestamp_ntz, id long, v double")
    w = Window.partitionBy("k").orderBy("ts")
    want = rows(df.select("id", F.lag("v").over(w), F.lag("ts").over(w)))
    for width in (900, 86400, 10 ** 9):
        got = with_previous(df, ["k"], ["ts"], ["v"], time_bucket("ts", width),
                            order_is_unique=True)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan
        assert rows(got, "id", "prev_v", "prev_ts") == want
