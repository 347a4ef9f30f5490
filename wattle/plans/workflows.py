"""End-to-end workflows over one dataset, as lazy DataFrames.

Each ``load_*`` function reads the raw source (catalog table wins over a
path), applies the optional half-open time window on raw rows (pushed into
the scan), optionally builds the raw-value audits, cleans, and returns a
dataclass of every derived frame. Nothing runs until the caller acts on a
frame; several frames of one workflow share the same scan plan, so a caller
who needs more than one of them may ``persist()`` ``sdf``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattle.operators import (
    audits,
    cleaning,
    energy,
    locations,
    measures,
    power,
    projection,
    scenarios,
)
from wattle.sources import readers


@dataclass
class SourceConfig:
    table_name: str | None = None
    data_path: str | None = None
    fmt: str = "parquet"
    from_ts: str | None = None
    to_ts: str | None = None
    ts_col: str = "FECHA_LECTURA_REAL"
    audit_invalid_values: bool = False
    # Rules by column instead of the dataset's own.
    audit_rules: dict[str, audits.AuditRule] | None = None
    partition_col: str | None = None


def _raw(spark: SparkSession, cfg: SourceConfig, rules: dict) -> tuple[DataFrame, DataFrame | None]:
    raw = readers.load_readings(spark, cfg.table_name, cfg.data_path, cfg.fmt)
    raw = cleaning.time_window(raw, cfg.from_ts, cfg.to_ts, cfg.ts_col, cfg.partition_col)
    audit = audits.run_audits(raw, cfg.audit_rules or rules) if cfg.audit_invalid_values else None
    return raw, audit


@dataclass
class ConsumptionModel:
    sdf: DataFrame
    ene_data: DataFrame
    mde_data: DataFrame
    power_data: DataFrame
    voltage_data: DataFrame
    current_data: DataFrame
    pf_data: DataFrame
    energy_df: DataFrame
    invalid_value_audit: DataFrame | None = None

    def n_phases(self) -> DataFrame:
        return measures.n_phases(self.voltage_data)


def load_consumption(spark: SparkSession, cfg: SourceConfig, tie: str | None = "seq",
                     bucket_seconds: int = energy.DEFAULT_BUCKET_SECONDS) -> ConsumptionModel:
    raw, audit = _raw(spark, cfg, audits.CONSUMPTION_RULES)
    sdf = cleaning.clean_consumption(raw)
    ene = measures.split(sdf, "energy")
    return ConsumptionModel(
        sdf=sdf, ene_data=ene, mde_data=measures.split(sdf, "max_demand"),
        power_data=measures.split(sdf, "power"), voltage_data=measures.split(sdf, "voltage"),
        current_data=measures.split(sdf, "current"), pf_data=measures.split(sdf, "power_factor"),
        energy_df=energy.energy_deltas(ene, tie, bucket_seconds),
        invalid_value_audit=audit,
    )


@dataclass
class VoltageModel:
    sdf: DataFrame
    voltage_data: DataFrame
    voltage_df: DataFrame
    invalid_value_audit: DataFrame | None = None


def load_voltage(spark: SparkSession, cfg: SourceConfig,
                 phase_vals: Sequence[str] = cleaning.DEFAULT_VOLTAGE_PHASES) -> VoltageModel:
    raw, audit = _raw(spark, cfg, audits.VOLTAGE_RULES)
    sdf = cleaning.clean_voltage(raw, phase_vals)
    return VoltageModel(sdf=sdf, voltage_data=measures.voltage_data(sdf),
                        voltage_df=measures.voltage_profile(sdf), invalid_value_audit=audit)


@dataclass
class PowerModel:
    sdf: DataFrame
    kwh_data: DataFrame
    kvarh_data: DataFrame
    active_df: DataFrame
    reactive_df: DataFrame
    invalid_value_audit: DataFrame | None = None
    tie: str | None = None

    def flat_active(self) -> DataFrame:
        return power.flatten(self.nested_active())

    def nested_active(self) -> DataFrame:
        return power.active_profile(self.kwh_data, self.tie, nested=True)


def load_power(spark: SparkSession, cfg: SourceConfig, tie: str | None = None) -> PowerModel:
    raw, audit = _raw(spark, cfg, audits.POWER_RULES)
    sdf = cleaning.clean_power(raw)
    kwh, kvarh = measures.split(sdf, "active", tie), measures.split(sdf, "reactive", tie)
    return PowerModel(sdf=sdf, kwh_data=kwh, kvarh_data=kvarh,
                      active_df=power.active_profile(kwh, tie),
                      reactive_df=power.reactive_profile(kvarh, tie),
                      invalid_value_audit=audit, tie=tie)


def load_shapes(df: DataFrame, power: str = "P", samples: int = 96, seasons: dict[int, str] | None = None,
                tie: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Complete days of (node, ts, power) rows and their mean load shapes:
    ``days``, ``weekend`` and ``season``, all lazy."""
    days = scenarios.complete_days(df, samples, seasons)
    return {"days": days, "weekend": scenarios.weekend_curve(days, power, tie),
            "season": scenarios.season_curves(days, power, tie)}


def scenario_input(active_df: DataFrame, power_col: str = "P_Pdem", name: str = "P") -> DataFrame:
    """node, ts and one power column of a profile, renamed for scenarios."""
    return active_df.select("node", "ts", F.col(power_col).alias(name))


def load_customers(spark: SparkSession, path: str, dtype_map: dict | str | None = None,
                   sep: str = ";") -> DataFrame:
    """Customer master from separated text, typed and cleaned."""
    return cleaning.clean_customers(readers.read_customers(spark, path, dtype_map, sep))


@dataclass
class Network:
    layers: DataFrame          # every layer, tagged with ``layer``
    loads: DataFrame           # the customers layer, its NISE or else its OBJECTID as NISE
    attributes: DataFrame      # the customers layer without point columns


def load_network(spark: SparkSession, root: str, fmt: str = "parquet",
                 source_epsg: int | dict[str, int] | None = None, target_epsg: int | None = None,
                 per_slice: int | None = None, rename_cols: dict[str, str] | None = None,
                 loads_layer: str = locations.LOADS_LAYER, order_by: str = "seq") -> Network:
    """All layers under ``root`` (a folder or a glob): each layer's ids typed
    and renamed and, with ``target_epsg``, its points reprojected from its own
    grid (``source_epsg``: one code, or one by layer), then the union, sliced
    to the first ``per_slice`` percent of each layer (by ``order_by``)."""
    own_ids: dict[str, bool] = {}

    def prepare(name: str, df: DataFrame) -> DataFrame:
        own_ids[name] = "NISE" in df.columns
        epsg = source_epsg.get(name) if isinstance(source_epsg, dict) else source_epsg
        df = locations.prepare_layer(df, rename_cols, epsg=epsg)
        return df if target_epsg is None else projection.reproject(df, epsg, target_epsg)

    layers = readers.read_layers(spark, root, fmt, prepare)
    if per_slice:
        layers = locations.layer_slice(layers, per_slice, order_by)
    loads, attributes = (
        locations.loads_view(layers, loads_layer, bare, own_ids.get(loads_layer)) for bare in (False, True))
    return Network(layers=layers, loads=loads, attributes=attributes)
