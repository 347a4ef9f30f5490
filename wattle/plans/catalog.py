"""Registered queries: one function per operator key, each ``(spark, sf_dir)
-> DataFrame`` over the raw meter tables derived from the test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattle.operators import (
    analytics,
    audits,
    cleaning,
    energy,
    locations,
    measures,
    periods,
    power,
    projection,
    reconcile,
    rollup,
    scenarios,
    sequence,
    shapes,
    spatial,
    voltage_quality,
)
from wattle.plans import workflows
from wattle.session import scratch_path
from wattle.sources import readers
from wattle.sources.fixtures import build_view
from wattle.sources.schemas import CUSTOMER_SCHEMA

Query = Callable[[SparkSession, str], DataFrame]

# Window used by the time_window query (half-open).
WINDOW_FROM, WINDOW_TO = "2026-03-03", "2026-03-10"


def _consumption(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.clean_consumption(build_view(spark, sf, "consumption_raw"))


def clean_consumption(spark: SparkSession, sf: str) -> DataFrame:
    return _consumption(spark, sf)


def time_window(spark: SparkSession, sf: str) -> DataFrame:
    raw = cleaning.time_window(build_view(spark, sf, "consumption_raw"), WINDOW_FROM, WINDOW_TO)
    return cleaning.clean_consumption(raw)


def time_window_pruned(spark: SparkSession, sf: str) -> DataFrame:
    """The same window over readings stored partitioned by reading date."""
    path = scratch_path(spark, "consumption_by_day")
    readers.write_readings(build_view(spark, sf, "consumption_raw"), path)
    raw = readers.load_readings(spark, data_path=path)
    win = cleaning.time_window(raw, WINDOW_FROM, WINDOW_TO,
                               partition_col=readers.PARTITION_COLUMN)
    return cleaning.clean_consumption(win).drop(readers.PARTITION_COLUMN)


def time_window_other_ts(spark: SparkSession, sf: str) -> DataFrame:
    """A window on another timestamp (a day after the reading) over readings
    stored by reading date: the partition column must not narrow it."""
    path = scratch_path(spark, "consumption_by_day")
    view = build_view(spark, sf, "consumption_raw").withColumn(
        "FECHA_REGISTRO", F.expr("FECHA_LECTURA_REAL + interval 40 hours"))
    readers.write_readings(view, path)
    raw = readers.load_readings(spark, data_path=path)
    win = cleaning.time_window(raw, WINDOW_FROM, WINDOW_TO, ts_col="FECHA_REGISTRO")
    return cleaning.clean_consumption(win).drop(readers.PARTITION_COLUMN, "FECHA_REGISTRO")


def clean_numeric_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Readings whose ids come as floating numbers, with gaps and fractions."""
    ids = {c: F.expr(f"case when seq % 7 = 0 then null when seq % 11 = 0 then seq + 0.5d else seq * 1.0d end")
           for c in ("MEDIDOR", "LOCALIZACION_REAL")}
    return cleaning.clean_consumption(build_view(spark, sf, "consumption_raw").withColumns(ids))


def ene_readings(spark: SparkSession, sf: str) -> DataFrame:
    return measures.split(_consumption(spark, sf), "energy")


def mde_readings(spark: SparkSession, sf: str) -> DataFrame:
    return measures.split(_consumption(spark, sf), "max_demand")


def phase_power(spark: SparkSession, sf: str) -> DataFrame:
    return measures.split(_consumption(spark, sf), "power")


def phase_voltage(spark: SparkSession, sf: str) -> DataFrame:
    return measures.split(_consumption(spark, sf), "voltage")


def phase_current(spark: SparkSession, sf: str) -> DataFrame:
    return measures.split(_consumption(spark, sf), "current")


def phase_pf(spark: SparkSession, sf: str) -> DataFrame:
    return measures.split(_consumption(spark, sf), "power_factor")


def labelled_measures(spark: SparkSession, sf: str) -> DataFrame:
    """Every measure of the daily readings, in one pass."""
    return measures.labelled(_consumption(spark, sf)).select("seq", "measure", "MEDIDOR", "VALOR_LECTURA")


def n_phases(spark: SparkSession, sf: str) -> DataFrame:
    return measures.n_phases(measures.split(_consumption(spark, sf), "voltage"))


def energy_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return energy.energy_pivot(measures.split(_consumption(spark, sf), "energy"))


def energy_deltas(spark: SparkSession, sf: str) -> DataFrame:
    return energy.energy_deltas(measures.split(_consumption(spark, sf), "energy"))


def _power(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.clean_power(build_view(spark, sf, "power_raw"))


def _voltage(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.clean_voltage(build_view(spark, sf, "voltages_raw"))


def clean_power(spark: SparkSession, sf: str) -> DataFrame:
    return _power(spark, sf)


def clean_voltage(spark: SparkSession, sf: str) -> DataFrame:
    return _voltage(spark, sf)


def kwh_data(spark: SparkSession, sf: str) -> DataFrame:
    return measures.split(_power(spark, sf), "active")


def kvarh_data(spark: SparkSession, sf: str) -> DataFrame:
    return measures.split(_power(spark, sf), "reactive")


def active_profile(spark: SparkSession, sf: str) -> DataFrame:
    return power.active_profile(measures.split(_power(spark, sf), "active"))


def reactive_profile(spark: SparkSession, sf: str) -> DataFrame:
    return power.reactive_profile(measures.split(_power(spark, sf), "reactive"))


def flatten_active(spark: SparkSession, sf: str) -> DataFrame:
    nested = power.active_profile(measures.split(_power(spark, sf), "active"), nested=True)
    return power.flatten(nested)


def voltage_profile(spark: SparkSession, sf: str) -> DataFrame:
    return measures.voltage_profile(_voltage(spark, sf))


def _scenario_input(spark: SparkSession, sf: str) -> DataFrame:
    """node, ts, P (= demand delivered) from the active profile."""
    act = power.active_profile(measures.split(_power(spark, sf), "active"))
    return act.select("node", "ts", act["P_Pdem"].alias("P"))


def calendar_labels(spark: SparkSession, sf: str) -> DataFrame:
    return scenarios.calendar_labels(_scenario_input(spark, sf))


def samples_per_day(spark: SparkSession, sf: str) -> DataFrame:
    return scenarios.samples_per_day(scenarios.calendar_labels(_scenario_input(spark, sf)))


def complete_days(spark: SparkSession, sf: str) -> DataFrame:
    return scenarios.complete_days(_scenario_input(spark, sf))


def weekend_curve(spark: SparkSession, sf: str) -> DataFrame:
    return scenarios.weekend_curve(scenarios.complete_days(_scenario_input(spark, sf)))


def season_curves(spark: SparkSession, sf: str) -> DataFrame:
    return scenarios.season_curves(scenarios.complete_days(_scenario_input(spark, sf)))


def _customers(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.clean_customers(build_view(spark, sf, "customers_raw"))


def customers_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Customer master through the ';'-separated text path with a dtype map."""
    path = scratch_path(spark, "customers_text")
    view = build_view(spark, sf, "customers_raw")
    shuffled = view.withColumn("OTRA", F.lit("x")).select("OTRA", *reversed(view.columns))
    shuffled.write.option("sep", ";").option("header", "true").csv(path)
    dtype_map = {name: "str" for name in CUSTOMER_SCHEMA.fieldNames()}
    read = readers.read_customers(spark, path, dtype_map)
    return cleaning.clean_customers(read.select(*view.columns))


def domain_audit(spark: SparkSession, sf: str) -> DataFrame:
    return audits.domain_audit(_consumption(spark, sf), _customers(spark, sf),
                               domain_label="NISE", a_label="consumption",
                               b_label="customers")


def domain_audit_nulls(spark: SparkSession, sf: str) -> DataFrame:
    return audits.domain_audit(_consumption(spark, sf), _customers(spark, sf),
                               domain_label="NISE", a_label="consumption",
                               b_label="customers", drop_null_keys=False)


def audit_column(spark: SparkSession, sf: str) -> DataFrame:
    return audits.audit_odd_values(build_view(spark, sf, "consumption_raw"), "MEDIDOR")


def audit_consumption(spark: SparkSession, sf: str) -> DataFrame:
    return audits.run_audits(build_view(spark, sf, "consumption_raw"), audits.CONSUMPTION_RULES)


def audit_voltage(spark: SparkSession, sf: str) -> DataFrame:
    return audits.run_audits(build_view(spark, sf, "voltages_raw"), audits.VOLTAGE_RULES)


def audit_power(spark: SparkSession, sf: str) -> DataFrame:
    return audits.run_audits(build_view(spark, sf, "power_raw"), audits.POWER_RULES)


def audit_union(spark: SparkSession, sf: str) -> DataFrame:
    return audits.audit_union([
        audits.audit_union([audit_consumption(spark, sf)], "ConsumptionData"),
        audits.audit_union([audit_voltage(spark, sf)], "VoltageData"),
        audits.audit_union([audit_power(spark, sf)], "PowerData"),
    ])


def audit_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Consolidated audits written as a table, read back from the catalog."""
    name = f"wattle_invalid_value_audit_{uuid.uuid4().hex[:12]}"
    audits.write_invalid_value_audit([audit_union(spark, sf)], name, mode="overwrite",
                                     path=scratch_path(spark, name))
    return spark.table(name)


def latest_attribute(spark: SparkSession, sf: str) -> DataFrame:
    return reconcile.latest_attribute(_consumption(spark, sf), "NISE", "TIPO_SECTOR",
                                      "FECHA_LECTURA", tie="seq")


def reconcile_entities(spark: SparkSession, sf: str) -> DataFrame:
    both = domain_audit(spark, sf).filter(F.col("domain_status") == "in_both").select(
        F.col("NISE").cast("bigint").alias("NISE"))
    return reconcile.reconcile_entities(_customers(spark, sf), _consumption(spark, sf), both,
                                        tie="seq")


def scan_path(spark: SparkSession, sf: str) -> DataFrame:
    """Raw readings written to a path and scanned back by format."""
    path = scratch_path(spark, "consumption_raw")
    build_view(spark, sf, "consumption_raw").write.parquet(path)
    return cleaning.clean_consumption(readers.load_readings(spark, data_path=path))


def scan_table(spark: SparkSession, sf: str) -> DataFrame:
    """Raw readings saved as a catalog table and scanned back by name."""
    name = f"wattle_consumption_raw_{uuid.uuid4().hex[:12]}"
    readers.write_table(build_view(spark, sf, "consumption_raw"), name,
                        path=scratch_path(spark, name))
    return cleaning.clean_consumption(readers.load_readings(spark, table_name=name))


LOCAL_EPSG = 5367


def _layers(spark: SparkSession, sf: str) -> DataFrame:
    """Two network layers (loads from customers, transformers from suppliers)
    written as files under one folder, then read back in one scan."""
    root = scratch_path(spark, "network")
    build_view(spark, sf, "gis_loads").write.parquet(f"{root}/Loads.parquet")
    build_view(spark, sf, "gis_transformers").write.parquet(f"{root}/Transformers.parquet")
    return readers.read_layers(
        spark, root, prepare=lambda _, df: locations.prepare_layer(df, epsg=LOCAL_EPSG))


def gis_layers(spark: SparkSession, sf: str) -> DataFrame:
    return _layers(spark, sf)


def gis_layer_slice(spark: SparkSession, sf: str) -> DataFrame:
    return locations.layer_slice(_layers(spark, sf), 50, order_by="seq")


def meter_locations(spark: SparkSession, sf: str) -> DataFrame:
    loads = locations.loads_view(_layers(spark, sf))
    return locations.meter_locations(_consumption(spark, sf), loads).drop("epsg")


def domain_audit_gis(spark: SparkSession, sf: str) -> DataFrame:
    """Service ids of the readings against the loads layer (OBJECTID = NISE)."""
    loads = audits.gis_keys(locations.loads_view(_layers(spark, sf)), "NISE")
    return audits.domain_audit(_consumption(spark, sf), loads, domain_label="NISE",
                               a_label="consumption", b_label="gis")


# WGS84 coordinates are reported at 6 decimals (about 0.1 m), the usual
# precision of map output.
COORD_DECIMALS = 6


def gis_reproject(spark: SparkSession, sf: str) -> DataFrame:
    loads = locations.loads_view(_layers(spark, sf))
    out = projection.reproject(loads, LOCAL_EPSG, projection.WGS84)
    return out.withColumns({c: F.round(c, COORD_DECIMALS) for c in ("x", "y")})


# Voltage band used by the compliance query (nominal volts, relative band).
NOMINAL_V, V_BAND = 120.0, 0.03


def daily_max_demand(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.daily_max_demand(measures.split(_consumption(spark, sf), "max_demand"))


def reverse_flow(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.reverse_flow(power.active_profile(measures.split(_power(spark, sf), "active")))


def voltage_compliance(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.voltage_compliance(measures.voltage_profile(_voltage(spark, sf)),
                                        NOMINAL_V, V_BAND)


def phase_balance(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.phase_balance(measures.split(_consumption(spark, sf), "voltage"))


def phase_balance_power(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.phase_balance(measures.split(_consumption(spark, sf), "power"))


# Analyses over time, place and neighbourhood.

def _active(spark: SparkSession, sf: str) -> DataFrame:
    return power.active_profile(measures.split(_power(spark, sf), "active"))


# Buckets of six hours, so that the runs of the fixture cross them.
RUN_BUCKET = 6 * 3600


def reverse_flow_periods(spark: SparkSession, sf: str) -> DataFrame:
    return periods.reverse_flow_periods(_active(spark, sf), bucket_seconds=RUN_BUCKET)


def net_generation_periods(spark: SparkSession, sf: str) -> DataFrame:
    return periods.reverse_flow_periods(_active(spark, sf), net=True, bucket_seconds=RUN_BUCKET)


def _places(spark: SparkSession, sf: str) -> DataFrame:
    """Sector (by the consumption readings) and zone of each power meter."""
    return rollup.node_places(measures.split(_power(spark, sf), "active"), latest_attribute(spark, sf))


def load_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.load_rollup(_active(spark, sf), _places(spark, sf))


def coincident_peaks(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.coincident_peaks(_active(spark, sf), _places(spark, sf), "zone")


# Rings in metres: the first one, and the farthest transformer a load is given to.
RING, REACH = 50.0, 400.0


def transformer_assignment(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest transformer of each customer of the loads layer."""
    layers = _layers(spark, sf)
    return spatial.assign_nearest(locations.loads_view(layers), layers.filter(F.col("layer") == "Transformers"), RING,
                                  REACH, "NISE", "OBJECTID").withColumnsRenamed(
        {"id": "NISE", "target": "transformer"})


def transformer_loading(spark: SparkSession, sf: str) -> DataFrame:
    layers = _layers(spark, sf)
    transformers = layers.filter(F.col("layer") == "Transformers")
    placed = locations.meter_locations(_power(spark, sf), locations.loads_view(layers))
    near = spatial.assign_nearest(placed, transformers, RING, REACH, "MEDIDOR", "OBJECTID")
    return rollup.transformer_loading(
        _active(spark, sf), near.withColumnsRenamed({"id": "node", "target": "transformer"}), transformers)


# Neighbours of a customer: how many, and within how many metres.
NEIGHBOURS, NEAR = 3, 150.0


def neighbours(spark: SparkSession, sf: str) -> DataFrame:
    loads = locations.loads_view(_layers(spark, sf))
    return spatial.nearest(loads, loads, NEIGHBOURS, NEAR, "NISE", "NISE", same=True).withColumnsRenamed(
        {"id": "NISE", "target": "neighbour"})


# Cell of the density clusters in metres, and the customers that make one dense.
CELL, DENSE = 50.0, 4


def spatial_clusters(spark: SparkSession, sf: str) -> DataFrame:
    loads = locations.loads_view(_layers(spark, sf))
    return spatial.density_clusters(loads, CELL, DENSE, "NISE").withColumnRenamed("id", "NISE")


SHAPES, SHAPE_ROUNDS = 4, 6


def shape_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return shapes.shape_clusters(weekend_curve(spark, sf), SHAPES, SHAPE_ROUNDS)


# Bands narrower than the standard's, which every value of the fixture meets.
NARROW_V, WIDE_V = (0.97, 1.03), (0.96, 1.04)


def voltage_deviation(spark: SparkSession, sf: str) -> DataFrame:
    return voltage_quality.weekly_deviation(measures.voltage_profile(_voltage(spark, sf)), NOMINAL_V, NARROW_V, WIDE_V)


def voltage_resampled(spark: SparkSession, sf: str) -> DataFrame:
    return voltage_quality.resample(measures.voltage_profile(_voltage(spark, sf)), 3600)


# A third layer with ids, types and coordinates of its own.

def _network(spark: SparkSession, sf: str, loads_layer: str) -> workflows.Network:
    root = scratch_path(spark, "network")
    for view, name in (("gis_loads", "Loads"), ("gis_transformers", "Transformers"), ("gis_services", "Services")):
        build_view(spark, sf, view).write.parquet(f"{root}/{name}.parquet")
    grids = {"Loads": LOCAL_EPSG, "Transformers": LOCAL_EPSG, "Services": projection.WGS84}
    return workflows.load_network(spark, root, source_epsg=grids, target_epsg=LOCAL_EPSG, loads_layer=loads_layer)


def _metres(df: DataFrame) -> DataFrame:
    """Points to the millimetre, as engines differ in the last bits."""
    return df.withColumns({c: F.round(c, 3) for c in ("x", "y")})


def network_layers(spark: SparkSession, sf: str) -> DataFrame:
    return _metres(_network(spark, sf, "Loads").layers)


def network_services(spark: SparkSession, sf: str) -> DataFrame:
    """The layer whose own service ids have gaps: they stay gaps."""
    return _metres(_network(spark, sf, "Services").loads)


def network_attributes(spark: SparkSession, sf: str) -> DataFrame:
    """The customers layer without points; its service id is its OBJECTID,
    though the union has another layer's NISE."""
    return _network(spark, sf, "Loads").attributes


def meter_locations_epsg(spark: SparkSession, sf: str) -> DataFrame:
    """Points with the grid they are given in."""
    return locations.meter_locations(_consumption(spark, sf), _network(spark, sf, "Loads").loads)


def _repeated_power(spark: SparkSession, sf: str) -> DataFrame:
    """Interval readings of which every third is there twice, the second time
    with a smaller value and a later number: the caller's order decides."""
    raw = build_view(spark, sf, "power_raw")
    numbered = raw.withColumn("copy", F.explode(F.expr(
        "sequence(0, case when (cast(MEDIDOR as int) + INTERVALO + cast(DEMANDA * 4 as int)) % 3 = 0 then 1 else 0 end)")))
    return cleaning.clean_power(numbered.withColumns({
        "DEMANDA": F.expr("DEMANDA - copy / 4.0d"), "ENERGIA": F.expr("ENERGIA + copy"),
        "seq": F.col("copy").cast("long")}).drop("copy"))


def active_profile_repeats(spark: SparkSession, sf: str) -> DataFrame:
    return power.active_profile(measures.split(_repeated_power(spark, sf), "active", "seq"), tie="seq")


def weekend_curve_ties(spark: SparkSession, sf: str) -> DataFrame:
    """Days of which every timestamp is there twice: numbered by time, then by
    the caller's column."""
    twice = _scenario_input(spark, sf).withColumn("seq", F.explode(F.array(F.lit(1), F.lit(0))))
    days = scenarios.complete_days(twice.withColumn("P", F.col("P") + F.col("seq")), samples=192)
    return scenarios.weekend_curve(days, tie=["seq"])


def scan_table_over_path(spark: SparkSession, sf: str) -> DataFrame:
    """A table and a path are named: the table is read."""
    name = f"wattle_consumption_raw_{uuid.uuid4().hex[:12]}"
    raw = build_view(spark, sf, "consumption_raw")
    readers.write_table(raw, name, path=scratch_path(spark, name))
    other = scratch_path(spark, "consumption_raw")
    raw.filter("seq % 2 = 0").write.parquet(other)
    return cleaning.clean_consumption(readers.load_readings(spark, table_name=name, data_path=other))


def domain_audit_services(spark: SparkSession, sf: str) -> DataFrame:
    """Service ids of the readings against a layer that has its own."""
    services = audits.gis_keys(_network(spark, sf, "Services").loads, "NISE")
    return audits.domain_audit(_consumption(spark, sf), services, domain_label="NISE", a_label="consumption",
                               b_label="services")


def customers_typed(spark: SparkSession, sf: str) -> DataFrame:
    """Customer master text read with whole numbers, floating numbers and text."""
    path = scratch_path(spark, "customers_text")
    build_view(spark, sf, "customers_raw").write.option("sep", ";").option("header", "true").csv(path)
    kinds = {"NISE": "str", "FEC_INST_NISE": "Int64", "FECHA_LECTURA": "float64", "DESCSECTOR": "str"}
    return readers.read_customers(spark, path, kinds).select(*kinds)


def season_curves_sorted(spark: SparkSession, sf: str) -> DataFrame:
    """Curves in their order for display, with the place of each row."""
    ordered = scenarios.presentation_order(season_curves(spark, sf))
    return ordered.withColumn("place", F.monotonically_increasing_id()).withColumn(
        "first", F.row_number().over(Window.partitionBy("season", "node").orderBy("place")) == 1).drop("place")


def _events_input(spark: SparkSession, sf: str) -> DataFrame:
    """Natural data: events per hour and event type as (node, ts, P).

    An integer load keeps every later sum exact, so curve means do not depend
    on summation order."""
    ev = spark.read.parquet(f"{sf}/events.parquet")
    return (
        ev.filter(F.col("ts").isNotNull() & F.col("event_type").isNotNull())
        .groupBy(F.col("event_type").alias("node"), F.date_trunc("hour", "ts").alias("ts"))
        .agg(F.count(F.lit(1)).alias("P"))
    )


def events_complete_days(spark: SparkSession, sf: str) -> DataFrame:
    return scenarios.complete_days(_events_input(spark, sf), samples=24)


def events_weekend_curve(spark: SparkSession, sf: str) -> DataFrame:
    return scenarios.weekend_curve(scenarios.complete_days(_events_input(spark, sf), samples=24))



# The same operators over the content of the supplied tables.

def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def orders_latest_priority(spark: SparkSession, sf: str) -> DataFrame:
    """Priority of each customer's latest order, first by key on one date."""
    return reconcile.latest_attribute(_table(spark, sf, "orders"), "o_custkey", "o_orderpriority",
                                      "o_orderdate", tie="o_orderkey")


def _order_keys(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    orders = _table(spark, sf, "orders").withColumnRenamed("o_custkey", "custkey")
    return orders, _table(spark, sf, "customer").withColumnRenamed("c_custkey", "custkey")


def orders_domain_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Customers of the orders against the customer table."""
    orders, customers = _order_keys(spark, sf)
    return audits.domain_audit(orders, customers, domain_label="custkey", a_label="orders", b_label="customers")


def orders_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    """Market segment of each customer beside the priority of the latest order."""
    orders, customers = _order_keys(spark, sf)
    return reconcile.reconcile_entities(customers, orders, customers, "custkey", "c_mktsegment", "o_orderpriority",
                                        "o_orderdate", tie="o_orderkey")


def events_previous(spark: SparkSession, sf: str) -> DataFrame:
    """Each event with its user's previous one."""
    out = sequence.with_previous(_table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], ["value"],
                                 sequence.time_bucket("ts", 86400), target_rows_per_bucket=energy.HOT_METER_ROWS)
    return out.select("event_id", "user_id", "value", "prev_event_id", "prev_value")


def orders_odd_priority(spark: SparkSession, sf: str) -> DataFrame:
    return audits.audit_odd_values(_table(spark, sf, "orders"), "o_orderpriority", r"^[1-3]-[A-Z]+$")


def events_odd_props(spark: SparkSession, sf: str) -> DataFrame:
    return audits.audit_odd_values(_table(spark, sf, "events"), "props", r'^\{"k": [0-9]\}$', "one_digit")


QUERIES: dict[str, Query] = {
    "clean_consumption": clean_consumption,
    "time_window": time_window,
    "time_window_pruned": time_window_pruned,
    "orders_latest_priority": orders_latest_priority,
    "orders_domain_audit": orders_domain_audit,
    "orders_reconcile": orders_reconcile,
    "events_previous": events_previous,
    "orders_odd_priority": orders_odd_priority,
    "events_odd_props": events_odd_props,
    "time_window_other_ts": time_window_other_ts,
    "clean_numeric_ids": clean_numeric_ids,
    "ene_readings": ene_readings,
    "mde_readings": mde_readings,
    "phase_power": phase_power,
    "phase_voltage": phase_voltage,
    "phase_current": phase_current,
    "phase_pf": phase_pf,
    "n_phases": n_phases,
    "energy_pivot": energy_pivot,
    "energy_deltas": energy_deltas,
    "clean_power": clean_power,
    "clean_voltage": clean_voltage,
    "kwh_data": kwh_data,
    "kvarh_data": kvarh_data,
    "active_profile": active_profile,
    "reactive_profile": reactive_profile,
    "flatten_active": flatten_active,
    "voltage_profile": voltage_profile,
    "calendar_labels": calendar_labels,
    "samples_per_day": samples_per_day,
    "complete_days": complete_days,
    "weekend_curve": weekend_curve,
    "season_curves": season_curves,
    "customers_clean": customers_clean,
    "domain_audit": domain_audit,
    "domain_audit_nulls": domain_audit_nulls,
    "audit_column": audit_column,
    "audit_consumption": audit_consumption,
    "audit_voltage": audit_voltage,
    "audit_power": audit_power,
    "audit_union": audit_union,
    "audit_sink": audit_sink,
    "latest_attribute": latest_attribute,
    "reconcile_entities": reconcile_entities,
    "scan_path": scan_path,
    "scan_table": scan_table,
    "gis_layers": gis_layers,
    "gis_layer_slice": gis_layer_slice,
    "meter_locations": meter_locations,
    "gis_reproject": gis_reproject,
    "domain_audit_gis": domain_audit_gis,
    "daily_max_demand": daily_max_demand,
    "reverse_flow": reverse_flow,
    "voltage_compliance": voltage_compliance,
    "phase_balance": phase_balance,
    "events_complete_days": events_complete_days,
    "events_weekend_curve": events_weekend_curve,
    "phase_balance_power": phase_balance_power,
    "reverse_flow_periods": reverse_flow_periods,
    "net_generation_periods": net_generation_periods,
    "load_rollup": load_rollup,
    "coincident_peaks": coincident_peaks,
    "transformer_assignment": transformer_assignment,
    "transformer_loading": transformer_loading,
    "neighbours": neighbours,
    "spatial_clusters": spatial_clusters,
    "shape_clusters": shape_clusters,
    "voltage_deviation": voltage_deviation,
    "voltage_resampled": voltage_resampled,
    "network_layers": network_layers,
    "network_services": network_services,
    "network_attributes": network_attributes,
    "meter_locations_epsg": meter_locations_epsg,
    "scan_table_over_path": scan_table_over_path,
    "season_curves_sorted": season_curves_sorted,
    "labelled_measures": labelled_measures,
    "domain_audit_services": domain_audit_services,
    "customers_typed": customers_typed,
    "active_profile_repeats": active_profile_repeats,
    "weekend_curve_ties": weekend_curve_ties,
}
