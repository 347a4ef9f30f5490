"""Invariants on the derived test tables."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, rows
from wattle.operators import energy, measures, scenarios
from wattle.plans import catalog


@pytest.fixture(scope="module")
def ene(spark):
    df = measures.split(catalog._consumption(spark, SF_SMALL), "energy").cache()
    yield df
    df.unpersist()  # later tests inspect uncached plans


def test_flags_imply_status(spark):
    audit = catalog.QUERIES["domain_audit_nulls"](spark, SF_SMALL)
    bad = audit.filter(
        ~(((F.col("domain_status") == "in_both") == (F.col("in_consumption") & F.col("in_customers")))
          & ((F.col("domain_status") == "only_in_consumption")
             == (F.col("in_consumption") & ~F.col("in_customers")))
          & ((F.col("domain_status") == "only_in_customers")
             == (~F.col("in_consumption") & F.col("in_customers")))))
    assert bad.count() == 0
    assert audit.filter(F.col("NISE").isNull()).count() <= 1


def test_complete_days_have_exactly_96_rows(spark):
    days = catalog.QUERIES["complete_days"](spark, SF_SMALL)
    sizes = {r[0] for r in days.groupBy("node", "date").count().select("count").collect()}
    assert sizes == {96}


def test_timesteps_are_0_to_95(spark):
    curve = catalog.QUERIES["season_curves"](spark, SF_SMALL)
    per = curve.groupBy("season", "node").agg(F.min("timestep"), F.max("timestep"), F.count("*"))
    assert {tuple(r[2:]) for r in per.collect()} == {(0, 95, 96)}


def test_deltas_telescope(ene):
    d = energy.energy_deltas(ene)
    full = d.groupBy("MEDIDOR").agg(
        F.count("*").alias("n"), F.count("Delivered").alias("nd"),
        F.sum("Daily Sent").alias("s"),
        F.max_by("Delivered", "FECHA_LECTURA").alias("last"),
        F.min_by("Delivered", "FECHA_LECTURA").alias("first"),
    ).filter((F.col("n") == F.col("nd")) & (F.col("n") > 1))
    got = full.collect()
    assert got and all(abs(r.s - (r.last - r.first)) < 1e-9 for r in got)


def test_partitioning_does_not_change_results(ene):
    a = rows(energy.energy_deltas(ene.repartition(1)))
    b = rows(energy.energy_deltas(ene.repartition(17), bucket_seconds=86400))
    assert a == b


def test_curves_partitioning_invariant(spark):
    inp = catalog._scenario_input(spark, SF_SMALL)
    a = rows(scenarios.weekend_curve(scenarios.complete_days(inp.repartition(1))))
    b = rows(scenarios.weekend_curve(scenarios.complete_days(inp.repartition(17))))
    assert a == b and len(a) > 0
