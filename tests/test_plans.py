"""Plan-shape checks: pushdown, pruning, no global sorts inside
building blocks, one window for the three lags, reused exchanges."""

import json
import re

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from wattle.plans import catalog
from wattle.session import MERGED_BYTES, pin_session, widen_shuffles
from wattle.sources import fixtures, readers
from wattle.sources.schemas import schema_from_dtype_map


def _plan(df, final=False):
    if final:
        df.collect()  # runs this DataFrame's own plan, so AQE's final plan is shown
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", ["energy_deltas", "season_curves", "weekend_curve",
                                 "active_profile", "reconcile_entities", "meter_locations"])
def test_no_global_sort_in_building_blocks(spark, key):
    assert "rangepartitioning" not in _plan(catalog.QUERIES[key](spark, SF_SMALL))


def test_three_lags_share_one_window(spark):
    plan = _plan(catalog.QUERIES["energy_deltas"](spark, SF_SMALL))
    lag_windows = [ln for ln in plan.splitlines() if "Window [lag(" in ln]
    assert len(lag_windows) == 1 and lag_windows[0].count("lag(") == 3


def test_pivot_exchange_reused_by_carry_branch(spark):
    plan = _plan(catalog.QUERIES["energy_deltas"](spark, SF_SMALL), final=True)
    assert "ReusedExchange" in plan and "SortAggregate" not in plan


@pytest.mark.parametrize("key", ["calendar_labels", "flatten_active", "reactive_profile"])
def test_pivot_has_more_tasks_for_more_rows(spark, tmp_path, key):
    """The readings of 2,000 meters are too many for two tasks; they are still
    combined before the shuffle."""
    spark.range(1, 2001).selectExpr("id as s_suppkey").write.parquet(str(tmp_path / "supplier.parquet"))
    pin_session(spark)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        plan = _plan(catalog.QUERIES[key](spark, str(tmp_path)))
        (tasks,) = re.findall(r"hashpartitioning\(MEDIDOR#\d+L?, FECHA_LECTURA#\d+, (\d+)\)", plan)
        assert int(tasks) * fixtures.SHUFFLE_ROWS >= 2000 * 14 * 96 * 3 * 2 > 2 * fixtures.SHUFFLE_ROWS
        assert "partial_min(" in plan
        pin_session(spark)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "2"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_pivot_tasks_are_not_merged_into_few(spark, tmp_path):
    """A large advisory size doesn't give one task all the groups again."""
    meters = 2000
    spark.range(1, meters + 1).selectExpr("id as s_suppkey").write.parquet(str(tmp_path / "supplier.parquet"))
    pin_session(spark)
    given = {"spark.sql.shuffle.partitions": "2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1g",
             "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    old = {key: spark.conf.get(key) for key in given}
    for key, value in given.items():
        spark.conf.set(key, value)
    try:
        df = catalog.QUERIES["flatten_active"](spark, str(tmp_path))
        groups = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
        assert len(groups) > 1 and max(groups) < sum(groups) / 3
        assert sum(groups) == df.count() > 0.8 * meters * 14 * 96
        pin_session(spark)
        assert {key: spark.conf.get(key) for key in given} == given
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)


@pytest.mark.parametrize("size, kept", [("8m", True), ("16MB", True), ("65536", True), ("67108864b", False),
                                        ("128MB", False), ("1g", False)])
def test_merged_size_is_only_lowered(spark, size, kept):
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    pin_session(spark)
    old = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        widen_shuffles(spark, 1)
        assert spark.conf.get(key) == size
        widen_shuffles(spark, 2)
        assert spark.conf.get(key) == (size if kept else f"{MERGED_BYTES}b")
        pin_session(spark)
        assert spark.conf.get(key) == size
    finally:
        spark.conf.set(key, old)


def test_wider_shuffles_end_with_the_query(spark):
    key = "spark.sql.shuffle.partitions"
    pin_session(spark)
    few = spark.conf.get(key)
    try:
        widen_shuffles(spark, int(few) - 1)
        assert spark.conf.get(key) == few
        for more in (20, 30, 25):  # several views of one query
            widen_shuffles(spark, int(few) + more)
        assert spark.conf.get(key) == str(int(few) + 30)
        pin_session(spark)
        assert spark.conf.get(key) == few
        widen_shuffles(spark, int(few) + 20)
        spark.conf.set(key, "5")  # by the cluster, meanwhile
        pin_session(spark)
        assert spark.conf.get(key) == "5"
    finally:
        spark.conf.set(key, few)


def test_column_pruning_reaches_scan(spark, tmp_path):
    raw = catalog.build_view(spark, SF_SMALL, "consumption_raw")
    path = str(tmp_path / "raw")
    raw.write.parquet(path)
    from wattle.operators import cleaning, measures
    df = measures.n_phases(measures.split(
        cleaning.clean_consumption(readers.load_readings(spark, data_path=path)), "voltage"))
    scan = [ln for ln in _plan(df).splitlines() if "ReadSchema" in ln][0]
    assert "TIPO_SECTOR" not in scan and "MULTIPLICADOR" not in scan and "CONTADOR" in scan


def test_source_choice(spark):
    with pytest.raises(ValueError):
        readers.load_readings(spark)


def test_dtype_map(tmp_path):
    good = tmp_path / "types.json"
    good.write_text(json.dumps({"NISE": "str", "N": "Int64", "X": "float64"}))
    st = schema_from_dtype_map(str(good))
    assert [f.dataType.simpleString() for f in st.fields] == ["string", "bigint", "double"]
    bad = tmp_path / "bad.json"
    bad.write_text("{not json")
    with pytest.raises(ValueError):
        schema_from_dtype_map(str(bad))
    with pytest.raises(FileNotFoundError):
        schema_from_dtype_map(str(tmp_path / "missing.json"))
