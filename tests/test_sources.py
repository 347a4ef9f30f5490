import pytest
from pyspark.sql.utils import AnalysisException

from conftest import rows
from wattle.sources import fixtures, readers


def test_read_layers_merges_skips_and_names(spark, tmp_path):
    root = tmp_path / "GIS"
    spark.createDataFrame([("7", 1.0, 2.0)], "IDLOCALIZA string, x double, y double") \
        .write.parquet(str(root / "Loads.parquet"))
    spark.createDataFrame([(9, 25.0, 1.0, 1.0)], "OBJECTID long, KVA double, x double, y double") \
        .write.parquet(str(root / "Transformers"))
    spark.createDataFrame([], "OBJECTID long, x double, y double").write.parquet(str(root / "Empty"))
    (root / "Broken.parquet").write_bytes(b"not a parquet file")
    layers = readers.read_layers(spark, str(root))
    got = rows(layers, "layer", "IDLOCALIZA", "OBJECTID", "KVA")
    assert got == [("Loads", "7", None, None), ("Transformers", None, 9, 25.0)]


def test_write_table_modes(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "a long")
    name = "wattle_sink_modes"
    readers.write_table(df, name, mode="overwrite", path=str(tmp_path / "t"))
    readers.write_table(df, name, mode="append")
    assert spark.table(name).count() == 2
    readers.write_table(df, name, mode="ignore")
    assert spark.table(name).count() == 2
    with pytest.raises(AnalysisException):
        readers.write_table(df, name, mode="error")
    readers.write_table(df, name, mode="overwrite", path=str(tmp_path / "t2"))
    assert spark.table(name).count() == 1
    spark.sql(f"drop table {name}")


def test_read_customers_semicolon_text(spark, tmp_path):
    path = tmp_path / "customers.txt"
    path.write_text("NISE;FEC_INST_NISE;FECHA_LECTURA;FECHA_HASTA;FECHA_CONEXION_RED;"
                    "FEC_INST_MED;FECHA_INTER;DESCSECTOR\n"
                    "5000101,00;20210211;;20260230;20200101;20200102;20200103;Comercial\n")
    df = readers.read_customers(spark, str(path), {"NISE": "str"})
    r = df.first()
    assert r.NISE == "5000101,00" and r.FECHA_LECTURA is None and r.DESCSECTOR == "Comercial"


def test_bucketed_tables_join_without_shuffle(spark, tmp_path):
    a = spark.range(1000).selectExpr("id % 100 as NISE", "id as v")
    b = spark.range(100).selectExpr("id as NISE", "cast(id as string) as s")
    readers.write_table(a, "wattle_bkt_a", path=str(tmp_path / "a"), bucket_by=(8, ["NISE"]))
    readers.write_table(b, "wattle_bkt_b", path=str(tmp_path / "b"), bucket_by=(8, ["NISE"]))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("wattle_bkt_a").join(spark.table("wattle_bkt_b"), "NISE")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert joined.count() == 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "64MB")
        spark.sql("drop table wattle_bkt_a")
        spark.sql("drop table wattle_bkt_b")


def test_customers_by_header_in_any_order(spark, tmp_path):
    path = tmp_path / "customers.txt"
    path.write_text("DESCSECTOR;NISE;EXTRA;FEC_INST_NISE;FECHA_LECTURA;FECHA_HASTA;FECHA_CONEXION_RED;"
                    "FEC_INST_MED;FECHA_INTER\nComercial;7;12;20210211;;;;;\n")
    r = readers.read_customers(spark, str(path), {"EXTRA": "int64"}).first()
    assert (r.NISE, r.DESCSECTOR, r.EXTRA, r.FEC_INST_NISE) == ("7", "Comercial", 12, "20210211")
    path.write_text("NISE;DESCSECTOR\n7;x\n")
    with pytest.raises(ValueError, match="FECHA_LECTURA"):
        readers.read_customers(spark, str(path))
    assert readers.read_customers(spark, str(path), required=("NISE",)).count() == 1


def test_layers_one_by_one(spark, tmp_path):
    """Own types, own renames, nested names, globs; damage leaves a layer out whole."""
    from wattle.operators import locations
    root = tmp_path / "network" / "v 1" / "network"
    spark.createDataFrame([("7", "3", 5, 1.0, 2.0)], "IDLOCALIZA string, NUMEROMEDI string, OBJECTID int, x double, "
                          "y double").write.parquet(str(root / "Loads"))
    spark.createDataFrame([(8, 9, 6, 1.0, 2.0)], "LOCALIZACION_REAL long, NISE long, OBJECTID long, x double, y double"
                          ).write.parquet(str(root / "Other.parquet"))
    spark.range(400_000).repartition(4).write.parquet(str(root / "Bad"))
    part = sorted((root / "Bad").glob("part-*"))[0]
    part.write_bytes(part.read_bytes()[:-30])
    (root / "Bad" / f".{part.name}.crc").unlink()
    skipped = []
    with pytest.warns(UserWarning, match="Bad"):
        layers = readers.read_layers(spark, str(root), skipped=skipped,
                                     prepare=lambda _, df: locations.prepare_layer(df, epsg=5367))
    assert [s[0] for s in skipped] == ["Bad"]
    assert rows(layers, "layer", "LOCALIZACION_REAL", "OBJECTID") == [("Loads", 7, 5), ("Other", 8, 6)]
    assert rows(locations.loads_view(layers), "NISE") == [(5,)]
    globbed = readers.read_layers(spark, str(tmp_path / "network" / "*" / "network" / "O*"))
    assert rows(globbed, "layer") == [("Other",)]


def test_null_points_drop(spark):
    from wattle.operators import locations
    readings = spark.createDataFrame([(1, 70), (2, 80)], "MEDIDOR long, LOCALIZACION_REAL long")
    loads = spark.createDataFrame([(70, 1.0, 1.0, 1, 5367), (80, None, None, 2, 5367)],
                                  "LOCALIZACION_REAL long, x double, y double, seq long, epsg int")
    got = locations.meter_locations(readings, loads)
    assert rows(got, "MEDIDOR", "epsg") == [(1, 5367)]
    with pytest.raises(ValueError, match="nothere"):
        locations.meter_locations(readings, loads, order_by="nothere")


def test_views_are_spread_by_the_rows_they_become(spark, tmp_path):
    """More keys make more tasks, not larger ones."""
    parts = {}
    for n in (10, 2000):
        spark.range(1, n + 1).selectExpr("id as s_suppkey").write.parquet(str(tmp_path / str(n) / "supplier.parquet"))
        parts[n] = fixtures.build_view(spark, str(tmp_path / str(n)), "power_raw").rdd.getNumPartitions()
    assert parts[10] == spark.sparkContext.defaultParallelism
    assert parts[2000] * fixtures.TASK_ROWS >= 2000 * 14 * 96 * 3 * 2
