"""The workflow API over raw tables stored as Parquet equals the registered
queries built from the same derived tables."""

import pytest

from conftest import SF_SMALL, rows
from wattle.operators import power
from wattle.plans import catalog
from wattle.plans.workflows import (
    SourceConfig, load_consumption, load_power, load_shapes, load_voltage, scenario_input)
from wattle.sources.fixtures import build_view


@pytest.fixture(scope="module")
def paths(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    out = {}
    for name in ("consumption_raw", "power_raw", "voltages_raw"):
        out[name] = str(root / name)
        build_view(spark, SF_SMALL, name).write.parquet(out[name])
    return out


def test_consumption_workflow(spark, paths):
    m = load_consumption(spark, SourceConfig(data_path=paths["consumption_raw"],
                                             audit_invalid_values=True))
    assert rows(m.energy_df) == rows(catalog.QUERIES["energy_deltas"](spark, SF_SMALL))
    assert rows(m.n_phases()) == rows(catalog.QUERIES["n_phases"](spark, SF_SMALL))
    assert rows(m.invalid_value_audit) == rows(catalog.QUERIES["audit_consumption"](spark, SF_SMALL))
    win = load_consumption(spark, SourceConfig(data_path=paths["consumption_raw"],
                                               from_ts="2026-03-03", to_ts="2026-03-10"))
    assert win.sdf.count() == catalog.QUERIES["time_window"](spark, SF_SMALL).count()


def test_power_voltage_and_scenarios(spark, paths):
    p = load_power(spark, SourceConfig(data_path=paths["power_raw"]))
    assert rows(p.active_df) == rows(catalog.QUERIES["active_profile"](spark, SF_SMALL))
    assert rows(p.reactive_df) == rows(catalog.QUERIES["reactive_profile"](spark, SF_SMALL))
    assert p.nested_active().schema["P"].dataType.simpleString() == "struct<Pdem:double,Pgen:double>"
    v = load_voltage(spark, SourceConfig(data_path=paths["voltages_raw"]))
    assert rows(v.voltage_df) == rows(catalog.QUERIES["voltage_profile"](spark, SF_SMALL))
    shapes = load_shapes(scenario_input(p.active_df))
    assert rows(shapes["season"]) == rows(catalog.QUERIES["season_curves"](spark, SF_SMALL))
    assert rows(shapes["weekend"]) == rows(catalog.QUERIES["weekend_curve"](spark, SF_SMALL))


def test_customers_and_network(spark, tmp_path):
    from wattle.plans.workflows import load_customers, load_network
    from wattle.sources.schemas import CUSTOMER_SCHEMA

    text = str(tmp_path / "customers")
    build_view(spark, SF_SMALL, "customers_raw").write.option("sep", ";").option(
        "header", "true").csv(text)
    cust = load_customers(spark, text, {c: "str" for c in CUSTOMER_SCHEMA.fieldNames()})
    assert rows(cust) == rows(catalog._customers(spark, SF_SMALL).select(*cust.columns))

    root = tmp_path / "GIS"
    build_view(spark, SF_SMALL, "gis_loads").write.parquet(str(root / "Loads.parquet"))
    build_view(spark, SF_SMALL, "gis_transformers").write.parquet(str(root / "Transformers"))
    net = load_network(spark, str(root), source_epsg=5367, target_epsg=4326, per_slice=50)
    assert net.layers.count() == catalog.QUERIES["gis_layer_slice"](spark, SF_SMALL).count()
    lon = net.loads.agg({"x": "max"}).first()[0]
    assert -85 < lon < -83 and "x" not in net.attributes.columns and "NISE" in net.loads.columns


def test_custom_audit_rules(spark, tmp_path):
    from wattle.operators.audits import AuditRule
    path = str(tmp_path / "raw")
    build_view(spark, SF_SMALL, "consumption_raw").write.parquet(path)
    rules = {"UNIDAD": AuditRule(r"^kWh$", "unit", False)}
    m = load_consumption(spark, SourceConfig(data_path=path, audit_invalid_values=True, audit_rules=rules))
    got = rows(m.invalid_value_audit, "audit_key", "invalid_raw_value")
    assert got == [("unit", "Voltage"), ("unit", "kW")]


def test_duplicate_interval_readings_follow_the_tie(spark, paths, tmp_path):
    raw = spark.read.parquet(paths["power_raw"]).where("OPERACION = 'Delivered' and MEDIDOR = '1001'").limit(1).drop(
        "DEMANDA", "ENERGIA", "UNIDAD")
    both = raw.crossJoin(spark.createDataFrame(
        [(u, *v) for u in ("kWh", "kVARh") for v in ((5.0, 1.0, 1), (3.0, 2.0, 2), (4.0, 0.5, 3))],
        "UNIDAD string, DEMANDA double, ENERGIA double, seq int"))
    path = str(tmp_path / "power")
    both.repartition(5).write.parquet(path)
    p = load_power(spark, SourceConfig(data_path=path), tie="seq")
    assert [(r.P_Pdem, r.E_Edem) for r in p.active_df.collect()] == [(5.0, 1.0)]
    assert [(r.Q_Qdem, r.E_Edem) for r in p.reactive_df.collect()] == [(5.0, 1.0)]
    assert [(r.P.Pdem, r.E.Edem) for r in p.nested_active().collect()] == [(5.0, 1.0)]
    with pytest.raises(ValueError):
        load_power(spark, SourceConfig(data_path=path), tie="sequence")
    with pytest.raises(ValueError):
        power.active_profile(p.kwh_data.drop("seq"), tie="seq")
