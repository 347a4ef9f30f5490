import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import rows
from wattle.operators import locations, power, projection
from wattle.operators.sequence import head_per_group
from wattle.session import scratch_path


def test_meter_locations_last_wins_and_drops(spark):
    readings = spark.createDataFrame(
        [(1, 70), (1, 70), (2, 70), (3, None), (4, 99), (None, 80)],
        "MEDIDOR long, LOCALIZACION_REAL long")
    loads = spark.createDataFrame(
        [(70, 1.0, 1.0, 1), (70, 2.0, 2.0, 2), (80, 5.0, 5.0, 3)],
        "LOCALIZACION_REAL long, x double, y double, seq long")
    got = rows(locations.meter_locations(readings, loads), "MEDIDOR", "LOCALIZACION_REAL", "x", "y")
    assert got == [(None, 80, 5.0, 5.0), (1, 70, 2.0, 2.0), (2, 70, 2.0, 2.0)]


def test_prepare_layer_and_loads_view(spark):
    layer = spark.createDataFrame([("7", "1001", 5, 1.0, 2.0, "Loads"),
                                   ("x", "1002", 6, 1.0, 2.0, "Loads")],
                                  "IDLOCALIZA string, NUMEROMEDI string, OBJECTID long, "
                                  "x double, y double, layer string")
    prep = locations.prepare_layer(layer, epsg=5367)
    assert rows(prep, "LOCALIZACION_REAL", "MEDIDOR", "epsg") == [(None, "1002", 5367),
                                                                  (7, "1001", 5367)]
    view = locations.loads_view(prep, attributes_only=True)
    assert "NISE" in view.columns and "x" not in view.columns


def test_head_per_group_exact(spark):
    rnd = random.Random(3)
    data = [(rnd.choice(["big"] * 8 + ["a", "b", "c", None]), i)
            for i in rnd.sample(range(5000), 900)]
    df = spark.createDataFrame(data, "layer string, seq long")
    w = Window.partitionBy("layer").orderBy("seq")
    brute = df.select("*", F.row_number().over(w).alias("rn"),
                      F.count(F.lit(1)).over(Window.partitionBy("layer")).alias("n"))
    for pct in (0, 10, 50, 100):
        want = rows(brute.filter(F.col("rn") <= F.floor(F.col("n") * pct / 100)), "layer", "seq")
        got = rows(head_per_group(df, "layer", ["seq"], pct), "layer", "seq")
        assert got == want


def test_layer_slice_none_keeps_all(spark):
    df = spark.createDataFrame([("L", 1)], "layer string, seq long")
    assert locations.layer_slice(df, None).count() == 1


def _meridian_arc_numeric(phi, a=6378137.0, inv_f=298.257223563, steps=20000):
    f = 1 / inv_f
    e2 = f * (2 - f)
    h = phi / steps
    total = 0.0
    for i in range(steps):
        p = (i + 0.5) * h
        total += a * (1 - e2) / (1 - e2 * math.sin(p) ** 2) ** 1.5 * h
    return total


def test_reprojection(spark):
    grid = projection.GRIDS[5367]
    pts = spark.createDataFrame([(-84.0, 10.0), (-85.5, 8.25), (-82.75, 11.0)], "x double, y double")
    fwd = projection.reproject(pts, 4326, 5367)
    got = fwd.collect()
    # central meridian: easting is the false easting, northing the scaled meridian arc
    assert got[0].x == pytest.approx(grid.false_easting, abs=1e-6)
    assert got[0].y == pytest.approx(grid.k0 * _meridian_arc_numeric(math.radians(10.0)), abs=1e-3)
    back = projection.reproject(fwd, 5367, 4326).collect()
    for a, b in zip(pts.collect(), back):
        assert b.x == pytest.approx(a.x, abs=1e-9) and b.y == pytest.approx(a.y, abs=1e-9)
    assert back[0].epsg == 4326
    assert projection.reproject(pts, None, 4326) is pts
    assert projection.reproject(pts, 4326, 4326) is pts
    with pytest.raises(ValueError):
        projection.reproject(pts, 3857, 4326)
    # grid to grid through WGS84: a grid shifted by 100 km of false easting
    shifted = projection.TransverseMercator(lon0=-84.0, lat0=0.0, k0=0.9999,
                                            false_easting=600000.0, false_northing=0.0)
    moved = projection.reproject(fwd, 5367, 9999, grids={9999: shifted}).collect()
    for a, b in zip(got, moved):
        assert b.x == pytest.approx(a.x + 100000.0, abs=1e-3) and b.y == pytest.approx(a.y, abs=1e-3)


def test_flatten(spark):
    df = spark.createDataFrame([(1, (2.0, 3.0), (4.0, 5.0))],
                               "node long, P struct<Pdem:double,Pgen:double>, "
                               "E struct<Edem:double,Egen:double>")
    flat = power.flatten(df)
    assert flat.columns == ["node", "P_Pdem", "P_Pgen", "E_Edem", "E_Egen"]
    assert tuple(flat.first()) == (1, 2.0, 3.0, 4.0, 5.0)


def test_head_per_group_of_null_groups(spark):
    data = [(g, i) for g in ("a", "b", None) for i in range(40)]
    df = spark.createDataFrame(data, "layer string, seq long")
    got = rows(head_per_group(df, "layer", ["seq"], 25), "layer", "seq")
    assert got == sorted([(g, i) for g in ("a", "b", None) for i in range(10)],
                         key=lambda t: (t[0] is not None, t[0] or "", t[1]))


def test_head_per_group_of_any_order_column(spark):
    """Nulls, ties, doubles with NaN, text; a second column breaks ties."""
    rnd = random.Random(4)
    values = [None, 0.5, float("nan"), float("inf"), float("-inf"), -2.0, 7.25]
    data = [(rnd.choice("ab"), rnd.choice(values), rnd.choice([None, "x", "y", "z"]), i) for i in range(700)]
    df = spark.createDataFrame(data, "layer string, v double, t string, id long")
    for order in (["v", "id"], ["t", "id"], ["id"]):
        w = Window.partitionBy("layer").orderBy(*order)
        brute = df.withColumns({"rn": F.row_number().over(w), "n": F.count("*").over(Window.partitionBy("layer"))})
        for pct in (1, 33, 99):
            want = rows(brute.filter(F.col("rn") <= F.floor(F.col("n") * pct / 100)), "id")
            assert rows(head_per_group(df, "layer", order, pct), "id") == want


def test_head_per_group_ranks_only_the_bracket(spark):
    """Nothing runs while the plan is built, and few rows reach the window."""
    df = spark.range(50_000).select(F.lit("big").alias("layer"), F.col("id").alias("seq"))
    df.write.mode("overwrite").parquet(path := scratch_path(spark, "layers"))
    before = spark.sparkContext.statusTracker().getJobIdsForGroup()
    out = head_per_group(spark.read.parquet(path), "layer", ["seq"], 50)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup()) - len(before) <= 1   # the file schema
    assert out.agg(F.count("*"), F.max("seq")).first() == (25_000, 24_999)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and plan.count("Window") == 1 and "Sort" not in plan


def test_service_ids_are_decided_by_layer(spark):
    """A layer's own NISE keeps its gaps; a layer without one takes OBJECTID,
    though the union brings another layer's column."""
    own = spark.createDataFrame([("5", 33), ("bad", 34), (None, 35)], "NISE string, OBJECTID long").withColumns(
        {"layer": F.lit("Loads"), "x": F.lit(0.0), "y": F.lit(0.0)})
    assert rows(locations.loads_view(own), "NISE") == [(None,), ("5",), ("bad",)]
    union = own.withColumn("layer", F.lit("Other")).unionByName(
        own.withColumns({"NISE": F.lit(None).cast("string")}))
    assert rows(locations.loads_view(union, own_service_ids=False), "NISE") == [(33,), (34,), (35,)]


def test_published_control_points(spark):
    """Worked examples of two national guides, stated as printed: Snyder 1987
    (Clarke 1866) and the Ordnance Survey's guide to coordinate systems (Airy)."""
    from wattle.operators.projection import TransverseMercator, tm_forward
    snyder = TransverseMercator(lon0=-75.0, lat0=0.0, k0=0.9996, false_easting=0.0, false_northing=0.0,
                                a=6378206.4, inv_f=294.978698214)
    airy = TransverseMercator(lon0=-2.0, lat0=49.0, k0=0.9996012717, false_easting=400000.0,
                              false_northing=-100000.0, a=6377563.396, inv_f=299.3249646)
    points = ((snyder, -73.5, 40.5, 127106.5, 4484124.4, 0.1),
              (airy, 1 + 43 / 60 + 4.5177 / 3600, 52 + 39 / 60 + 27.2531 / 3600, 651409.903, 313177.270, 0.01))
    for grid, lon, lat, east, north, close in points:
        got = spark.range(1).select(*tm_forward(F.lit(lon), F.lit(lat), grid)).first()
        assert abs(got[0] - east) < close and abs(got[1] - north) < close
