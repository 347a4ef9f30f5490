import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import rows
from wattle.functions.columns import (
    compact_date, decimal_hour, nise_from_text, try_bigint, try_double)
from wattle.operators import cleaning


def test_nise_text_cases(spark):
    df = spark.createDataFrame(
        [("7",), (" 7 ",), ("7,00",), ("7,05",), ("x",), (None,), ("7.5",), ("+8",)], "v string")
    got = [r[0] for r in df.select(nise_from_text("v")).collect()]
    assert got == [7, 7, 7, None, None, None, None, 8]


def test_ids_null_for_non_integers(spark):
    # D9: 12.7 as a double must not truncate to 12; a whole double is an id
    df = spark.createDataFrame([(12.7, "12.3"), (12.0, "12")], "d double, s string")
    got = df.select(try_bigint("d"), try_bigint("s")).collect()
    assert [tuple(r) for r in got] == [(None, None), (12, 12)]


def test_reading_to_double(spark):
    df = spark.createDataFrame([("1.5",), ("N/A",), (None,), ("5d",)], "v string")
    got = [r[0] for r in df.select(try_double("v")).collect()]
    assert got == [1.5, None, None, 5.0]  # D10: Spark accepts the 'd' suffix


def test_decimal_hour_and_null_ts(spark):
    df = spark.createDataFrame([(dt.datetime(2026, 3, 1, 6, 30, 36),), (None,)],
                               "t timestamp_ntz")
    got = [r[0] for r in df.select(decimal_hour("t")).collect()]
    assert got[0] == pytest.approx(6.51) and got[1] is None  # D8


def test_compact_dates(spark):
    df = spark.createDataFrame([("20210211",), ("20260230",), ("",), (None,), ("2021",)], "v string")
    got = [r[0] for r in df.select(compact_date("v")).collect()]
    assert got == [dt.date(2021, 2, 11), None, None, None, None]


def _raw(spark):
    return spark.createDataFrame([
        ("1001", " 5000003 ", "21", "1.5", dt.datetime(2026, 3, 1, 5), None, "Total",
         "Delivered", "ENE", "kWh", "Comercial", "1"),
        ("M-97", "PLANTA", "12.3", "N/A", None, "Bidireccional", None,
         "Received", "ENE", "kWh", "Otro", "1"),
    ], "MEDIDOR string, LOCALIZACION string, LOCALIZACION_REAL string, VALOR_LECTURA string, "
       "FECHA_LECTURA_REAL timestamp_ntz, SGDA string, CONTADOR string, OPERACION string, "
       "TIPO_CONSUMO string, UNIDAD string, TIPO_SECTOR string, MULTIPLICADOR string")


def test_clean_consumption(spark):
    out = cleaning.clean_consumption(_raw(spark))
    assert "LOCALIZACION" not in out.columns
    got = rows(out, "MEDIDOR", "NISE", "LOCALIZACION_REAL", "VALOR_LECTURA", "CONTADOR", "Hour")
    assert got == [(None, None, None, None, None, None), (1001, 5000003, 21, 1.5, "total", 5.0)]


def test_missing_columns_raise(spark):
    with pytest.raises(ValueError, match="MEDIDOR"):
        cleaning.clean_consumption(_raw(spark).drop("MEDIDOR"))


def test_time_window_half_open_and_pushed(spark, tmp_path):
    raw = _raw(spark).union(_raw(spark).withColumn(
        "FECHA_LECTURA_REAL", F.lit(dt.datetime(2026, 3, 2)).cast("timestamp_ntz")))
    path = str(tmp_path / "raw")
    raw.write.parquet(path)
    df = spark.read.parquet(path)
    win = cleaning.time_window(df, "2026-03-01 05:00:00", "2026-03-02")
    assert win.count() == 1  # lower bound kept, upper bound excluded, NULL ts dropped
    plan = win._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "FECHA_LECTURA_REAL" in plan
    assert cleaning.time_window(df).count() == 4
    with pytest.raises(ValueError):
        cleaning.time_window(df, "2026-13-01")


def test_time_window_prunes_date_partitions(spark, tmp_path):
    from wattle.sources import readers
    base = _raw(spark).filter(F.col("FECHA_LECTURA_REAL").isNotNull())
    days = [base.withColumn("FECHA_LECTURA_REAL",
                            F.lit(dt.datetime(2026, 3, d, 12)).cast("timestamp_ntz"))
            for d in range(1, 8)]
    raw = days[0]
    for d in days[1:]:
        raw = raw.union(d)
    path = str(tmp_path / "by_day")
    readers.write_readings(raw, path)
    df = readers.load_readings(spark, data_path=path)
    win = cleaning.time_window(df, "2026-03-03 12:00:00", "2026-03-05 12:00:00",
                               partition_col=readers.PARTITION_COLUMN)
    assert win.count() == 2  # 3rd and 4th at noon; upper bound excluded
    plan = win._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(reading_date" in plan
    assert rows(win, "FECHA_LECTURA_REAL") == rows(
        cleaning.time_window(raw, "2026-03-03 12:00:00", "2026-03-05 12:00:00"), "FECHA_LECTURA_REAL")


def test_time_window_ignores_a_foreign_reading_date(spark):
    df = spark.createDataFrame([("2026-03-04 10:00:00", "1999-01-01")], "t string, d string").selectExpr(
        "cast(t as timestamp_ntz) as FECHA_LECTURA_REAL", "cast(d as date) as reading_date")
    assert cleaning.time_window(df, "2026-03-04", "2026-03-05").count() == 1


def test_time_window_in_a_foreign_zone(spark, tmp_path):
    from wattle.sources import readers
    path = str(tmp_path / "utc")
    readers.write_readings(spark.sql("select timestamp'2026-03-03 20:00:00' as FECHA_LECTURA_REAL"), path)
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        win = cleaning.time_window(readers.load_readings(spark, data_path=path), "2026-03-04", "2026-03-05",
                                   partition_col=readers.PARTITION_COLUMN)
        assert win.count() == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_numeric_ids_keep_whole_values(spark):
    from decimal import Decimal

    from wattle.functions.columns import try_bigint
    df = spark.createDataFrame(
        [(12.0, Decimal("12.00"), "12", 5), (12345678.0, Decimal("0.50"), "12.7", 6), (12.7, None, " 9 ", None),
         (float("nan"), None, "x", 1), (1e30, Decimal("-3.00"), None, 2), (None, None, None, 3)],
        "d double, c decimal(12,2), s string, i int")
    got = df.select(*[try_bigint(c).alias(c) for c in df.columns]).collect()
    assert [r.d for r in got] == [12, 12345678, None, None, None, None]
    assert [r.c for r in got] == [12, None, None, None, -3, None]
    assert [r.s for r in got] == [12, None, 9, None, None, None]
    assert [r.i for r in got] == [5, 6, None, 1, 2, 3]
