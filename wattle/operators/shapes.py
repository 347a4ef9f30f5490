"""Clusters of daily load shapes: rounds of assignment and means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattle.session import scratch_path
from wattle.sources.schemas import require_columns

# A shape's mean step is this many units; centres stay on the grid of units.
UNITS = 1000
STEPS = 96


def unit_shapes(curves: DataFrame, steps: int = STEPS, value: str = "P") -> DataFrame:
    """node and shape, an array of ``steps`` whole numbers, of the nodes whose
    curve (node, timestep, value; one row a step) is complete: each step over
    the mean step, in units. A curve without any load has no shape; one with
    steps missing, without a value or beyond the last takes no part."""
    require_columns(curves, ["node", "timestep", value], "curves")
    v = F.when((F.col("timestep") >= 0) & (F.col("timestep") < steps), F.col(value).cast("double"))
    # A step is a column of the aggregate: fixed width, so it is a hash aggregate.
    cells = [F.max(F.when(F.col("timestep") == i, v)) for i in range(steps)]
    rows = curves.where(F.col("node").isNotNull()).groupBy("node").agg(
        F.array(*cells).alias("curve"), F.count(F.lit(1)).alias("n"), F.count(v).alias("full"))
    whole = (F.col("n") == steps) & (F.col("full") == steps) & ~F.exists("curve", lambda x: x.isNull())
    rows = rows.where(whole).withColumn("mean", F.aggregate("curve", F.lit(0.0), lambda a, x: a + x) / steps)
    unit = F.transform("curve", lambda x: F.floor(x / F.col("mean") * UNITS + F.lit(0.5)).cast("long"))
    return rows.where("mean > 0").select("node", unit.alias("shape"))


def distance(shape: Column, centre: list[int]) -> Column:
    """Sum of squared differences in units."""
    pairs = F.zip_with(shape, F.array(*[F.lit(c).cast("long") for c in centre]), lambda a, b: (a - b) * (a - b))
    return F.aggregate(pairs, F.lit(0).cast("long"), lambda a, x: a + x)


def assigned(shapes: DataFrame, centres: list[list[int]]) -> DataFrame:
    """node, shape, cluster (the number of the nearest centre, the smaller one
    of two) and distance."""
    near = F.array_min(F.array(*[F.struct(distance(F.col("shape"), c).alias("distance"), F.lit(i).cast("long").alias(
        "cluster")) for i, c in enumerate(centres)]))
    return shapes.withColumn("near", near).select("node", "shape", "near.cluster", "near.distance")


def means(rows: DataFrame, centres: list[list[int]]) -> list[list[int]]:
    """The mean shape of each cluster on the grid; an empty one keeps its
    centre. What returns is one row a cluster."""
    steps = len(centres[0])
    sums = rows.groupBy("cluster").agg(*[
        F.floor(F.sum(F.element_at("shape", i + 1)) / F.count(F.lit(1)) + F.lit(0.5)).cast("long").alias(f"s{i}")
        for i in range(steps)])
    out = list(centres)
    for r in sums.collect():
        out[r["cluster"]] = [r[f"s{i}"] for i in range(steps)]
    return out


def shape_clusters(curves: DataFrame, k: int = 4, rounds: int = 8, steps: int = STEPS, value: str = "P") -> DataFrame:
    """node, cluster and distance of every node that has a complete curve.

    Starts from the shapes of the ``k`` nodes with the least md5 of their
    number and repeats assignment and means for ``rounds`` rounds, or until
    nothing moves. Shapes and centres are whole units, so every sum is exact
    and the result depends neither on partitions nor on their order. Fewer
    nodes than ``k`` make as many clusters; none gives no rows.

    Shapes are stored once in the shared folder; a round is one pass over
    them, and only its k x steps sums, a bound set by the arguments, reach the
    driver and go back as literals.
    """
    spark = curves.sparkSession
    path, made = scratch_path(spark, "load-shapes"), unit_shapes(curves, steps, value)
    made.write.parquet(path)
    shapes = spark.read.schema(made.schema).parquet(path)
    start = shapes.orderBy(F.md5(F.col("node").cast("string").cast("binary")), "node").limit(k).collect()
    if not start:
        return shapes.select("node", F.lit(0).cast("long").alias("cluster"), F.lit(0).cast("long").alias("distance"))
    centres = [list(r["shape"]) for r in start]
    for _ in range(rounds):
        moved = means(assigned(shapes, centres), centres)
        if moved == centres:
            break
        centres = moved
    return assigned(shapes, centres).select("node", "cluster", "distance")
