"""Runs of readings against a walk over each node's rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from wattle.operators import periods

T0 = dt.datetime(2026, 1, 1)
SCHEMA = "node long, ts timestamp_ntz, P_Pdem double, P_Pgen double, E_Edem double, E_Egen double, bucket long, place int"


def _table(spark, data):
    return spark.createDataFrame([(*r, 5, 6) for r in data], SCHEMA)


def _walk(data, net, gap):
    out, last = [], {}
    for node, ts, pd, pg, ed, eg in sorted((r for r in data if r[1] is not None), key=lambda r: (
            r[0] is not None, r[0] or 0, r[1])):
        peak = (pg or 0) - (pd or 0) if net else pg
        energy = (eg or 0) - (ed or 0) if net else eg
        on = peak is not None and peak > 0
        run = last.get(node)
        if on and run and run[-1] and (ts - run[0][2]).total_seconds() <= gap:
            one = run[0]
            one[2], one[3] = ts, one[3] + 1
            one[4] = energy if one[4] is None else one[4] + (energy or 0)
            one[5] = max(one[5], peak)
        elif on:
            one = [node, ts, ts, 1, energy, peak]
            out.append(one)
            last[node] = (one, True)
        if not on:
            last[node] = (None, False)
    return sorted((tuple(o) for o in out), key=lambda t: tuple((v is not None, v) for v in t))


def _random(seed, nodes, n, chance):
    draw = random.Random(seed)
    data = []
    for node in nodes:
        at = T0
        for _ in range(n):
            at += dt.timedelta(minutes=draw.choice([15, 15, 15, 15, 30, 600]))
            pg = draw.choice([0.0, None]) if draw.random() > chance else draw.randrange(1, 9) / 4
            data.append((node, at, draw.choice([None, 0.25, 1.5]), pg, draw.choice([None, 0.5]),
                         draw.choice([None, 0.25, 2.0])))
    return data + [(1, None, 1.0, 1.0, 1.0, 1.0)]


@pytest.mark.parametrize("net", [False, True])
@pytest.mark.parametrize("bucket, hot", [(7 * 86400, None), (1800, None), (10 ** 9, 4)])
def test_periods_match_a_walk(spark, net, bucket, hot):
    data = _random(1, [1, 2, None], 60, 0.7) + _random(2, [9], 80, 0.97)
    got = periods.reverse_flow_periods(_table(spark, data), 900, net, bucket, hot)
    assert rows(got, "node", "start_ts", "end_ts", "samples", "energy", "peak") == _walk(data, net, 900)


def test_one_run_crosses_many_buckets(spark):
    """A hot node that never stops: every bucket but the first holds a rest."""
    data = [(1, T0 + dt.timedelta(minutes=15 * i), 0.0, 1.0, 0.0, 0.25) for i in range(500)]
    got = periods.reverse_flow_periods(_table(spark, data), bucket_seconds=3600).collect()
    assert [(r.samples, r.energy, r.end_ts) for r in got] == [(500, 125.0, T0 + dt.timedelta(minutes=15 * 499))]


def test_hot_node_is_spread(spark):
    data = [(1, T0 + dt.timedelta(minutes=15 * i), 0.0, float(i % 2), 0.0, 0.25) for i in range(2000)]
    plan = periods.reverse_flow_periods(_table(spark, data), bucket_seconds=86400)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Window [sum" in text and "hashpartitioning(node" in text
    assert plan.count() == 1000 and plan.agg(F.max("samples")).first()[0] == 1
    assert periods.reverse_flow_periods(_table(spark, [])).count() == 0


def test_parts_of_runs_are_made_once(spark):
    """A bucket may hold nothing but the rest of a run, many whole runs, or none."""
    data = [(n, T0 + dt.timedelta(minutes=15 * i), 0.0, float(i < 70 or i % 7 < 3 or i > 300), 0.0, 0.25)
            for n in (1, 2, None) for i in range(400) if not 120 < i < 150]
    got = periods.reverse_flow_periods(_table(spark, data), bucket_seconds=6 * 3600)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [sum(") == 1
    assert rows(got, "node", "start_ts", "end_ts", "samples", "energy", "peak") == _walk(data, False, 900)
