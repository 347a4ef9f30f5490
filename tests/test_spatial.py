"""Neighbours, assignment and clusters against all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from wattle.operators import graph, spatial


def _points(spark, data):
    return spark.createDataFrame([(*r, "k", 1.0) for r in data], "id long, x double, y double, cx string, n double")


def _scattered(seed, n, width):
    draw = random.Random(seed)
    out = [(i, float(draw.randrange(width)), float(draw.randrange(width))) for i in range(n)]
    out += [(n + i, 7.0, 7.0) for i in range(n // 3)]                     # a third at one place
    out += [(2 * n + i, 500.0 + i / 64, 500.0) for i in range(n // 2)]    # a crowd
    return out


def _brute(points, targets, k, radius, same=False):
    out = []
    for p, x, y in set(points):
        near = sorted((math.sqrt((a - x) * (a - x) + (b - y) * (b - y)), t) for t, a, b in set(targets)
                      if not (same and t == p))
        out += [(p, i + 1, t, d) for i, (d, t) in enumerate([n for n in near if n[0] <= radius][:k])]
    return sorted(out)


@pytest.mark.parametrize("k, radius, crowd", [(3, 120.0, 256), (1, 2000.0, 16), (4, 33.3, 6)])
def test_neighbours_match_all_pairs(spark, k, radius, crowd):
    data = _scattered(1, 120, 1000)
    df = _points(spark, data)
    got = spatial.nearest(df, df, k, radius, same=True, crowd=crowd)
    assert rows(got, "id", "rank", "target", "distance") == _brute(data, data, k, radius, same=True)


@pytest.mark.parametrize("start, bound", [(80.0, 300.0), (500.0, 200.0)])
def test_assignment_matches_all_pairs(spark, start, bound):
    data, targets = _scattered(2, 90, 900), [(100 + i, *p[1:]) for i, p in enumerate(_scattered(3, 12, 2500))]
    targets += [(900, -50.0, 3.5), (901, -50.0, 3.5), (900, -50.0, 3.5)]
    got = spatial.assign_nearest(_points(spark, data), _points(spark, targets), start, bound, crowd=12)
    best = {p: (t, d) for p, _, t, d in _brute(data, targets, 1, bound)}
    assert rows(got, "id", "target", "distance") == sorted((p, *best.get(p, (None, None))) for p, _, _ in data)


def test_points_without_place_take_no_part(spark):
    data = [(1, 0.0, 0.0), (2, None, 0.0), (None, 0.0, 0.0), (3, float("nan"), 0.0), (4, 0.0, float("inf")),
            (5, 1.0, 0.0), (5, 1.0, 0.0)]
    df = _points(spark, data)
    got = spatial.nearest(df, df, 2, 10.0, same=True)
    assert rows(got, "id", "rank", "target") == [(1, 1, 5), (5, 1, 1)]
    assert spatial.nearest(df.limit(0), df, 2, 10.0).count() == 0
    assert rows(spatial.assign_nearest(df, df.limit(0), 1.0, 4.0), "id", "target") == [(1, None), (5, None)]


def _brute_clusters(data, size, least):
    cells = {}
    for p in set(data):
        cells.setdefault((math.floor(p[1] / size), math.floor(p[2] / size)), []).append(p)
    dense = {c for c, ps in cells.items() if len(ps) >= least}
    seen, out = set(), {}
    for c in dense:
        if c in seen:
            continue
        todo, part = [c], []
        seen.add(c)
        while todo:
            x, y = todo.pop()
            part.append((x, y))
            for d in ((x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                if d in dense and d not in seen:
                    seen.add(d)
                    todo.append(d)
        name = min(p[0] for q in part for p in cells[q])
        out.update({q: name for q in part})
    return sorted(((*p, out.get(c)) for c, ps in cells.items() for p in ps),
                  key=lambda t: tuple((v is not None, v) for v in t))


@pytest.mark.parametrize("least", [1, 3])
def test_clusters_match_brute_force(spark, least):
    data = _scattered(5, 150, 700) + [(5000 + i, -40.0 * i, 10.0 * (i % 3)) for i in range(80)]
    got = spatial.density_clusters(_points(spark, data), 40.0, least)
    assert rows(got, "id", "x", "y", "cluster") == _brute_clusters(data, 40.0, least)
    if least == 3:
        assert spatial.density_clusters(_points(spark, []), 40.0, least).count() == 0


def test_components_of_paths_and_stars(spark):
    draw = random.Random(6)
    path = list(range(100, 130))
    shuffled = draw.sample(range(1000, 1030), 30)
    edges = list(zip(path, path[1:])) + list(zip(shuffled, shuffled[1:])) + [(5, 3), (3, 5), (9, 9), (2, 7), (7, 3)]
    got = graph.connected_components(spark.createDataFrame(edges, "a long, b long"))
    want = {n: 100 for n in path} | {n: 1000 for n in shuffled} | {2: 2, 3: 2, 5: 2, 7: 2}
    assert {r.node: r.root for r in got.collect()} == want
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_no_all_pairs_in_the_plan(spark):
    df = _points(spark, _scattered(7, 50, 1000))
    plan = spatial.nearest(df, df.withColumn("x", F.col("x") + 1), 2, 50.0)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
