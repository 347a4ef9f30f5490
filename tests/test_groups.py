"""Subtotals, coincident peaks, transformer loading, voltage weeks and load
shapes against plain Python."""

import datetime as dt
import hashlib
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from conftest import rows
from wattle.operators import rollup, shapes, voltage_quality

T0 = dt.datetime(2026, 1, 1)
ACTIVE = "node long, ts timestamp_ntz, P_Pdem double, P_Pgen double, E_Edem double, E_Egen double"


def _active(seed=1, nodes=(1, 2, 3, 4, None), n=40):
    draw = random.Random(seed)
    out = [(k, T0 + dt.timedelta(hours=5 * i), draw.choice([None, 0.0, 1.0, 2.5, 7.25]), draw.choice([None, 0.5]),
            draw.choice([None, 1.0]), draw.choice([0.25, 0.5])) for k in nodes for i in range(n)]
    return out + [(1, None, 9.0, 9.0, 9.0, 9.0)]


PLACES = [(1, "a", 10), (2, "a", 11), (3, None, 10), (4, "b", None)]


def test_rollup_levels_add_up(spark):
    active = spark.createDataFrame(_active(), ACTIVE)
    places = spark.createDataFrame(PLACES, "node long, sector string, zone long")
    got = rollup.load_rollup(active, places)
    where = {n: (s, z) for n, s, z in PLACES}
    want = defaultdict(list)
    for r in _active():
        if r[1] is not None:
            keys = (*where.get(r[0], (None, None)), r[0])
            for level in range(4):
                want[(level, *[k if i < level else None for i, k in enumerate(keys)],
                      dt.datetime.combine(r[1].date(), dt.time()))].append(r)

    def total(values):
        known = [v for v in values if v is not None]
        return sum(known) if known else None

    expected = [(*k, len({r[0] for r in v}), len(v), total(r[4] for r in v), total(r[5] for r in v),
                 max((r[2] for r in v if r[2] is not None), default=None)) for k, v in want.items()]
    cols = ("level", "sector", "zone", "node", "period", "nodes", "samples", "energy_in", "energy_out", "peak")
    assert rows(got, *cols) == sorted(expected, key=lambda t: tuple((v is not None, v) for v in t))
    by_level = {r.level: r.e for r in got.groupBy("level").agg(F.sum("energy_out").alias("e")).collect()}
    assert len(set(by_level.values())) == 1
    with pytest.raises(ValueError):
        rollup.load_rollup(active, places, period="decade")


def test_rollup_reduces_before_it_multiplies(spark):
    active = spark.createDataFrame(_active(), ACTIVE)
    places = spark.createDataFrame(PLACES, "node long, sector string, zone long")
    plan = rollup.load_rollup(active, places)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Expand") < plan.rindex("Aggregate")   # the tree is printed from the top


def test_coincident_peaks(spark):
    data = _active(2, (1, 2, 3, 4))
    members = [(1, 10), (2, 11), (3, 10), (4, None)]
    got = rollup.coincident_peaks(spark.createDataFrame(data, ACTIVE), spark.createDataFrame(
        members, "node long, zone long"), "zone")
    zone, load, top = dict(members), defaultdict(float), defaultdict(lambda: defaultdict(float))
    for n, ts, p, *_ in data:
        if ts is not None:
            load[zone[n], ts] += p or 0
            day = top[zone[n], ts.date()]
            day[n] = max(day[n], p or 0)
    want = []
    for (z, day), by in top.items():
        peak, at = max(((v, t) for (g, t), v in load.items() if g == z and t.date() == day),
                       key=lambda x: (x[0], -x[1].timestamp()))
        want.append((z, peak, at, sum(by.values()), sum(by.values()) / peak if peak else None))
    assert rows(got, "zone", "peak", "peak_ts", "node_peaks", "diversity") == sorted(
        want, key=lambda t: tuple((v is not None, v) for v in t))


def test_transformer_loading(spark):
    data = [(1, T0, 6.0, 1.0, 0.0, 0.0), (2, T0, 5.0, None, 0.0, 0.0), (3, T0, 1.0, 0.0, 0.0, 0.0),
            (4, T0, 0.0, 4.0, 0.0, 0.0)]
    near = spark.createDataFrame([(1, 70), (2, 70), (3, None), (4, 80)], "node long, transformer long")
    units = spark.createDataFrame([(70, 25.0), (70, 20.0), (80, None), (90, 5.0)], "OBJECTID long, KVA double")
    got = rollup.transformer_loading(spark.createDataFrame(data, ACTIVE), near, units)
    assert rows(got, "transformer", "nodes", "net", "kva", "loading") == [(70, 2, 10.0, 25.0, 0.4),
                                                                           (80, 1, -4.0, None, None)]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _expanded(spark):
    """Readings that Spark takes for a few bytes, as each key becomes many rows."""
    return spark.range(4).selectExpr("id as node", "explode(sequence(timestamp_ntz'2026-01-01 00:00:00', "
                                     "timestamp_ntz'2026-01-03 23:45:00', interval 15 minutes)) as ts").selectExpr(
        "*", "cast(node + hour(ts) as double) as P_Pdem", "0.25d as P_Pgen", "1.0d as E_Edem", "0.5d as E_Egen")


def test_peaks_gather_no_readings_on_the_driver(spark):
    got = rollup.coincident_peaks(_expanded(spark), spark.range(4).selectExpr("id as node", "id % 2 as zone"), "zone")
    assert "Broadcast" not in _plan(got)
    assert rows(got, "zone", "peak", "node_peaks", "diversity") == [(z, p, p, 1.0) for z, p in ((0, 48.0), (1, 50.0))
                                                                    for _ in range(3)]


def test_loading_gathers_no_readings_on_the_driver(spark):
    near = spark.range(4).selectExpr("id as node", "if(id = 3, null, id % 2) as transformer")
    units = spark.range(2).selectExpr("id as OBJECTID", "25.0d as KVA")
    got = rollup.transformer_loading(_expanded(spark), near, units)
    assert "Broadcast" not in _plan(got)
    by = {(r.transformer, r.ts): r for r in got.collect()}
    assert len(by) == 2 * 3 * 96 and by[0, T0].nodes == 2 and by[1, T0].nodes == 1 and by[0, T0].net == 1.5


def test_latest_place(spark):
    data = [(1, 5, 120, T0), (1, 6, 250, T0 + dt.timedelta(1)), (1, 6, 240, T0 + dt.timedelta(1)), (2, None, None, T0)]
    readings = spark.createDataFrame(data, "MEDIDOR long, NISE long, LOCALIZACION_REAL long, FECHA_LECTURA timestamp_ntz")
    sectors = spark.createDataFrame([(6, "home"), (5, "shop")], "NISE long, TIPO_SECTOR string")
    assert rows(rollup.node_places(readings, sectors), "node", "sector", "zone") == [(1, "home", 2), (2, None, None)]


def test_voltage_weeks(spark):
    draw = random.Random(3)
    data = []
    for node in (1, 2):
        for i in range(3000):
            data.append((node, T0 + dt.timedelta(minutes=7 * i), "A", None if i % 50 == 0 else 110 + draw.randrange(90) / 4))
    frame = spark.createDataFrame(data + [(1, None, "A", 1.0)], "node long, ts timestamp_ntz, phase string, V double")
    slots = defaultdict(list)
    for n, ts, ph, v in data:
        if v is not None:
            slots[n, ts.replace(minute=ts.minute // 10 * 10)].append(v)
    weeks = defaultdict(list)
    for (n, ts), vs in slots.items():
        day = dt.datetime.combine(ts.date(), dt.time())
        weeks[n, "A", day - dt.timedelta(ts.weekday())].append(sum(vs) / len(vs))
    want = []
    for k, v in weeks.items():
        v.sort()
        m = math.ceil(len(v) * 0.95)
        narrow, wide = sum(112 <= x <= 128 for x in v), sum(111 <= x <= 131 for x in v)
        want.append((*k, len(v), v[0], v[-1], v[len(v) - m], v[m - 1], narrow / len(v), wide / len(v),
                     narrow >= m and wide == len(v)))
    got = voltage_quality.weekly_deviation(frame, 1.0, (112.0, 128.0), (111.0, 131.0))
    cols = ("node", "phase", "week", "slots", "v_min", "v_max", "v_low", "v_high", "in_narrow", "in_wide", "compliant")
    close = [(*g[:3], *[round(x, 9) for x in g[3:]]) for g in rows(got, *cols)]
    assert close == [(*w[:3], *[round(x, 9) for x in w[3:]]) for w in sorted(want)]


def _curves(seed, nodes, steps):
    draw = random.Random(seed)
    out = []
    for n in range(nodes):
        base = [draw.randrange(1, 4) + (8 if (i + 3 * (n % 3)) % 9 < 3 else 0) for i in range(steps)]
        out += [(n, i, base[i] / 4) for i in range(steps)]
    return out


def _k_means(curves, k, rounds, steps):
    by = defaultdict(dict)
    for n, i, p in curves:
        by[n][i] = p
    unit = {n: [math.floor(c[i] / (sum(c[j] for j in range(steps)) / steps) * 1000 + 0.5) for i in range(steps)]
            for n, c in by.items()}
    centres = [unit[n] for n in sorted(unit, key=lambda n: (hashlib.md5(str(n).encode()).hexdigest(), n))[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centres))

    for _ in range(rounds):
        groups = defaultdict(list)
        for v in unit.values():
            groups[near(v)[1]].append(v)
        centres = [[math.floor(sum(x) / len(groups[i]) + 0.5) for x in zip(*groups[i])] if groups[i] else c
                   for i, c in enumerate(centres)]
    return sorted((n, near(v)[1], near(v)[0]) for n, v in unit.items())


@pytest.mark.parametrize("k, rounds", [(3, 5), (5, 0), (60, 2)])
def test_shape_clusters(spark, k, rounds):
    curves = _curves(4, 40, 12)
    broken = [(100, i, 1.0) for i in range(11)] + [(101, i, 0.0) for i in range(12)] + [
        (102, i, None if i == 3 else 1.0) for i in range(12)] + [(103, i, 1.0) for i in range(13)]
    frame = spark.createDataFrame(curves + broken, "node long, timestep long, P double").repartition(5)
    got = shapes.shape_clusters(frame, k, rounds, steps=12)
    assert rows(got, "node", "cluster", "distance") == _k_means(curves, k, rounds, 12)


def test_no_curves_no_clusters(spark):
    frame = spark.createDataFrame([], "node long, timestep long, P double")
    assert shapes.shape_clusters(frame, 3, steps=4).count() == 0
