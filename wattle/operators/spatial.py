"""Neighbourhood operators over points in metres: nearest points, assignment
to the nearest target by widening rings, and density clusters.

Nothing compares all pairs. Points meet the targets of the grid cells around
them; where a cell is crowded it is cut into quarters, again and again, and
only the quarters that can still hold one of the nearest are kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattle.operators.graph import connected_components
from wattle.session import ensure_checkpoint_dir
from wattle.sources.schemas import require_columns

# Targets of a cell from which on it is cut, and how often it can be.
CROWD, CUTS = 256, 20
# Rounding of cell edges: bounds are widened by this share of a cell.
_SLACK = 1e-9


def located(df: DataFrame, id_col: str) -> DataFrame:
    """id, x, y of the rows that have an id and a finite point, each once."""
    require_columns(df, [id_col, "x", "y"], "points")
    rows = df.select(F.col(id_col).alias("id"), *[F.col(c).cast("double").alias(c) for c in ("x", "y")])
    finite = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")) for c in ("x", "y")]
    return rows.where(F.col("id").isNotNull() & finite[0] & finite[1]).distinct()


def in_cells(df: DataFrame, size: float, x: str = "x", y: str = "y") -> DataFrame:
    """Adds the grid cell of each point as cx and cy."""
    return df.withColumns({n: F.floor(F.col(c) / size).cast("long") for n, c in (("cx", x), ("cy", y))})


def _bounds(pairs: DataFrame, size: float) -> DataFrame:
    """near and far: least and largest distance of a spot to its cell."""
    near, far = [], []
    for c, cell in (("x", "cx"), ("y", "cy")):
        low = F.col(cell) * size - F.col(c)
        high = (F.col(cell) + 1) * size - F.col(c)
        near.append(F.greatest(low - size * _SLACK, F.lit(0.0), -high - size * _SLACK))
        far.append(F.greatest(F.abs(low), F.abs(high)) + size * _SLACK)
    return pairs.withColumns({name: F.sqrt(side[0] * side[0] + side[1] * side[1])
                              for name, side in (("near", near), ("far", far))})


def _within_reach(pairs: DataFrame, k: int, radius: float) -> DataFrame:
    """Without the cells that lie beyond cells which hold k targets already."""
    spot = Window.partitionBy("x", "y")
    held = F.sum("n").over(spot.orderBy("far", "level", "cx", "cy"))
    pairs = pairs.withColumn("held", held)
    enough = F.min(F.when(F.col("held") >= k, F.col("far"))).over(spot)
    pairs = pairs.withColumn("enough", F.coalesce(enough, F.lit(float("inf"))))
    return pairs.where(F.col("near") <= F.least("enough", F.lit(float(radius)))).drop("held", "enough")


def _cell_pairs(spots: DataFrame, targets: DataFrame, k: int, radius: float, crowd: int) -> tuple[DataFrame, int]:
    """x, y, level, cx, cy: the cells in which a spot's nearest targets lie,
    and the finest level. A cell of level l is ``radius / 2**l`` wide."""
    around = F.explode(F.expr("flatten(transform(sequence(-1, 1), i -> transform(sequence(-1, 1), "
                              "j -> struct(cx + i as cx, cy + j as cy))))"))
    cells = in_cells(targets, radius).groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"))
    pairs = in_cells(spots, radius).select("x", "y", around.alias("c")).select("x", "y", "c.cx", "c.cy").join(
        cells, ["cx", "cy"])
    pairs = _bounds(pairs.withColumn("level", F.lit(0)), radius)
    largest, level = cells.agg(F.max("n")).first()[0] or 0, 0
    while largest > crowd and level < CUTS:
        level += 1
        size = radius / 2 ** level
        pairs = _within_reach(pairs, k, radius)
        parent = [F.floor(F.col(c) / 2).cast("long").alias(f"p{c}") for c in ("cx", "cy")]
        cells = in_cells(targets, size).groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n")).select("*", *parent)
        cut = (F.col("level") == level - 1) & (F.col("n") > crowd)
        open_ = pairs.where(cut).select("x", "y", F.col("cx").alias("pcx"), F.col("cy").alias("pcy"))
        finer = _bounds(open_.join(cells, ["pcx", "pcy"]).select("x", "y", "cx", "cy", "n").withColumn(
            "level", F.lit(level)), size)
        pairs = pairs.where(~cut).unionByName(finer).checkpoint()
        largest = finer.agg(F.max("n")).first()[0] or 0
    return _within_reach(pairs, k, radius).select("x", "y", "level", "cx", "cy"), level


def nearest(points: DataFrame, targets: DataFrame, k: int, radius: float, point_id: str = "id",
            target_id: str = "id", same: bool = False, crowd: int = CROWD) -> DataFrame:
    """The ``k`` nearest targets of each point within ``radius``: id, rank
    (from 1), target, distance. Ties go to the smaller target id.

    ``same``: both sides are one table, and a point is not its own neighbour.
    Rows without an id or a finite point take no part; a row that repeats
    counts once. Points of one place share one search, and of the targets of
    one place only the first ones by id can be among the nearest, so a place
    that holds a large part of all rows costs as much as any other.
    """
    ensure_checkpoint_dir(points.sparkSession)
    depth = k + 1 if same else k
    points, targets = located(points, point_id), located(targets, target_id)
    at_place = F.row_number().over(Window.partitionBy("x", "y").orderBy("id"))
    targets = targets.withColumn("place", at_place).where(F.col("place") <= depth).drop("place")
    spots = points.select("x", "y").distinct()
    pairs, levels = _cell_pairs(spots, targets, depth, radius, crowd)
    named = targets.select(F.col("id").alias("target"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    met = [pairs.where(F.col("level") == n).join(in_cells(named, radius / 2 ** n, "tx", "ty"), ["cx", "cy"])
           for n in range(levels + 1)]
    candidates = reduce(DataFrame.unionByName, met)
    dx, dy = F.col("tx") - F.col("x"), F.col("ty") - F.col("y")
    candidates = candidates.select("x", "y", "target", F.sqrt(dx * dx + dy * dy).alias("distance"))
    best = Window.partitionBy("x", "y").orderBy("distance", "target")
    candidates = candidates.where(F.col("distance") <= radius).withColumn("rank", F.row_number().over(best))
    lists = candidates.where(F.col("rank") <= depth).drop("rank")
    out = points.join(lists, ["x", "y"])
    if same:
        out = out.where(F.col("id") != F.col("target"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("distance", "target"))
    return out.select("id", rank.alias("rank"), "target", "distance").where(F.col("rank") <= k)


def assign_nearest(points: DataFrame, targets: DataFrame, start: float, bound: float, point_id: str = "id",
                   target_id: str = "id", crowd: int = CROWD) -> DataFrame:
    """id, target and distance of the nearest target of each point up to
    ``bound``; target and distance are NULL beyond it. Ties go to the smaller id.

    Rings widen from ``start``, twice as wide each round: what a ring finds is
    final, since all targets inside it were looked at, and only the points
    without one go on. Each round is checkpointed.
    """
    ensure_checkpoint_dir(points.sparkSession)
    left = located(points, point_id).checkpoint()
    done, radius = [], min(start, bound)
    while True:
        hit = nearest(left, targets, 1, radius, "id", target_id, crowd=crowd).drop("rank").checkpoint()
        done.append(hit)
        left = left.join(hit, "id", "left_anti").checkpoint()
        if radius >= bound or left.isEmpty():
            break
        radius = min(2 * radius, bound)
    none = left.select("id", *[F.lit(None).cast(hit.schema[c].dataType).alias(c) for c in ("target", "distance")])
    return reduce(DataFrame.unionByName, [*done, none.distinct()])


def density_clusters(points: DataFrame, size: float, least: int, point_id: str = "id") -> DataFrame:
    """id, x, y and cluster of every located point.

    A cell of ``size`` metres with ``least`` points or more is dense. Dense
    cells that touch, corners included, are one cluster, named by its least
    point id; points of other cells have no cluster (NULL). Points of one id
    at several places count at each of them.

    Cells are counted before any shuffle of points, and the graph has dense
    cells as nodes: at most one for every ``least`` points.
    """
    points = in_cells(located(points, point_id), size)
    cells = points.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    dense = cells.where(F.col("n") >= least).select(
        F.struct("cx", "cy").alias("cell"), "cx", "cy", "first").withColumn("node", F.xxhash64("cx", "cy"))
    ensure_checkpoint_dir(points.sparkSession)
    dense = dense.checkpoint()
    # Half of the eight neighbours: each touching pair once.
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"))
                                for i, j in ((1, -1), (1, 0), (1, 1), (0, 1))]))
    near = dense.select(F.col("node").alias("a"), "cx", "cy", steps.alias("s")).select(
        "a", (F.col("cx") + F.col("s.i")).alias("cx"), (F.col("cy") + F.col("s.j")).alias("cy"))
    edges = near.join(dense.select(F.col("node").alias("b"), "cx", "cy"), ["cx", "cy"]).select("a", "b")
    roots = connected_components(edges)
    named = dense.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = named.groupBy("root").agg(F.min("first").alias("cluster"))
    by_cell = named.join(names, "root").select("cx", "cy", "cluster")
    return points.join(by_cell, ["cx", "cy"], "left").select("id", "x", "y", "cluster")
