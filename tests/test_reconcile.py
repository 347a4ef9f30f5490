import datetime as dt

from conftest import rows
from wattle.operators import reconcile

D1, D2 = dt.datetime(2026, 3, 1), dt.datetime(2026, 3, 2)


def _readings(spark):
    return spark.createDataFrame([
        (1, D1, "Residencial", 1), (1, D2, "Comercial", 2),        # later date wins
        (2, D2, "Industrial", 5), (2, D2, "Comercial", 4),         # tie: first in sequence
        (3, None, "Comercial", 6),                                 # only undated rows
        (4, D1, None, 7),                                          # NULL attribute
    ], "NISE long, FECHA_LECTURA timestamp_ntz, TIPO_SECTOR string, seq long")


def test_latest_attribute(spark):
    got = rows(reconcile.latest_attribute(_readings(spark), tie="seq"))
    assert got == [(1, "Comercial"), (2, "Comercial"), (4, None)]


def test_reconcile_entities(spark):
    master = spark.createDataFrame(
        [(1, "Comercial"), (1, "Residencial"), (2, "Residencial"), (3, "Comercial"),
         (4, "Comercial"), (9, "Comercial")], "NISE long, DESCSECTOR string")
    keys = spark.createDataFrame([(1,), (2,), (3,), (4,)], "NISE long")
    out = reconcile.reconcile_entities(master, _readings(spark), keys, tie="seq")
    assert out.columns == ["NISE", "self_source", "other_source", "match"]
    assert rows(out) == [(1, "Comercial", "Comercial", True), (1, "Residencial", "Comercial", False),
                         (2, "Residencial", "Comercial", False), (4, "Comercial", None, None)]


def test_latest_attribute_orders_dates_ties_and_values(spark):
    """Against a window over all rows: ties, NULL ties and attributes, extreme numbers."""
    import random

    from pyspark.sql import Window
    from pyspark.sql import functions as F

    draw = random.Random(2)
    days = [dt.datetime(1, 1, 2), dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 1, 0, 0, 0, 1), dt.datetime(9999, 12, 30)]
    ties = [None, -(1 << 63), -1, 0, 5, (1 << 63) - 1]
    data = [(draw.choice([1, 2, 3, 4, None]), draw.choice(["a", "b", None]), draw.choice([*days, None]), t)
            for t in ties * 12]
    df = spark.createDataFrame(data, "NISE long, TIPO_SECTOR string, FECHA_LECTURA timestamp_ntz, seq long")
    df = df.withColumn("word", F.col("seq").cast("string"))
    for tie in (None, "seq", "word"):
        order = [F.col("FECHA_LECTURA").desc(), *([F.col(tie)] if tie else []), F.col("TIPO_SECTOR")]
        w = Window.partitionBy("NISE").orderBy(*order)
        brute = df.where("NISE is not null and FECHA_LECTURA is not null").withColumn("rn", F.row_number().over(w))
        got = reconcile.latest_attribute(df, tie=tie)
        assert rows(got, "NISE", "TIPO_SECTOR") == rows(brute.where("rn = 1"), "NISE", "TIPO_SECTOR")


def test_latest_attribute_has_no_sort_aggregate(spark):
    df = spark.createDataFrame([(1, "a", dt.datetime(2026, 1, 1), 1)],
                               "NISE long, TIPO_SECTOR string, FECHA_LECTURA timestamp_ntz, seq long")
    plan = reconcile.latest_attribute(df, tie="seq")._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan
