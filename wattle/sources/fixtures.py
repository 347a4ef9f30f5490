"""Raw meter tables derived from the supplied TPC-H-style test tables.

The tests and the bench have no meter data of their own, so each raw table is
derived from a key table (``customer`` or ``supplier``) by expanding every key
over a few small integer ranges (days, time slots, measures) and computing
each raw column from integer formulas. Work therefore grows linearly with the
key table.

A view is declared once as a :class:`ViewSpec` of SQL expressions. Spark
builds it with ``explode(sequence(..))`` generators (no joins), and the same
expressions render the DuckDB oracle text, so both engines see identical rows.
Only timestamp construction differs per engine (``{ts:...}`` macro).
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattle.session import default_parallelism, widen_shuffles
from wattle.sources.schemas import CUSTOMER_DATE_COLUMNS


@dataclass(frozen=True)
class ViewSpec:
    name: str
    table: str                      # source test table
    key: str                        # key column of that table
    alias: str                      # short name used in the formulas
    ranges: tuple[tuple[str, int], ...]   # (name, n) -> values 0..n-1
    keep: str                       # SQL predicate on the expanded rows
    columns: tuple[tuple[str, str], ...] = field(default_factory=tuple)


def _loc_cols(k: str) -> tuple[tuple[str, str], ...]:
    """LOCALIZACION / LOCALIZACION_REAL / SGDA formulas keyed on ``k``."""
    return (
        ("LOCALIZACION",
         f"case when {k}%101 = 0 then 'PLANTA' "
         f"when {k}%3 = 0 then ' ' || cast(5000000+{k} as string) || ' ' "
         f"when {k}%3 = 1 then cast(5000000+{k} as string) || ',00' "
         f"else cast(5000000+{k} as string) end"),
        ("LOCALIZACION_REAL",
         f"case when {k}%89 = 0 then '12.3' else cast({k}*7 as string) end"),
        ("SGDA",
         f"case when {k}%10 = 0 then 'Transformador' when {k}%10 < 6 then null "
         f"else 'Bidireccional' end"),
    )


CONSUMPTION = ViewSpec(
    name="consumption_raw",
    table="customer", key="c_custkey", alias="c",
    ranges=(("d", 14), ("k", 12)),
    keep="(c+d)%11 <> 0 and (k <> 1 or c%2 = 0) and (k <> 6 or c%3 > 0) "
         "and (k <> 7 or c%3 > 1) and (k <> 11 or c%5 = 0)",
    columns=(
        ("seq", "c*1000 + d*20 + k"),
        ("MEDIDOR", "case when c%97 = 0 then 'M-' || cast(c as string) "
                    "else cast(c+1000 as string) end"),
        *_loc_cols("c"),
        ("TIPO_CONSUMO", "case when k in (0, 1, 11) then 'ENE' when k in (2, 3) then 'MDE' "
                         "when k = 4 then 'FPO' when k in (5, 6, 7) then 'Voltage' "
                         "when k = 8 then 'kW' when k = 9 then 'Current' "
                         "else 'Power Factor' end"),
        ("CONTADOR", "case when k in (0, 1, 2, 3, 4, 11) then 'Total' when k = 6 then 'B' "
                     "when k = 7 then 'C' else 'A' end"),
        ("OPERACION", "case when k in (0, 2, 4, 11) then 'Delivered' "
                      "when k in (1, 3) then 'Received' when k = 6 then 'B' "
                      "when k = 7 then 'C' else 'A' end"),
        ("UNIDAD", "case when k in (0, 1, 11) then 'kWh' when k in (5, 6, 7) then 'Voltage' "
                   "else 'kW' end"),
        ("VALOR_LECTURA", "case when (c+3*d+k)%53 = 0 then 'N/A' "
                          "when (c+3*d+k)%59 = 0 then null "
                          "else cast((d*(c%40+1)+k) / cast(4 as double) as string) end"),
        ("TIPO_SECTOR", "case c%4 when 0 then 'Comercial' when 1 then 'Residencial' "
                        "when 2 then 'Industrial' else 'Otro' end"),
        ("MULTIPLICADOR", "case when c%50 = 0 then '2' else '1' end"),
        ("FECHA_LECTURA_REAL", "{ts:2026-03-01|d|(c%24)*60}"),
    ),
)

_DEMANDA = (
    "case when op = 2 then cast(0 as double) "
    "when op = 0 then ((31*s+17*d+3*slot+unit)%400) / cast(4 as double) "
    "when slot between 32 and 63 then ((s+slot)%40) / cast(4 as double) "
    "else cast(0 as double) end"
)

POWER = ViewSpec(
    name="power_raw",
    table="supplier", key="s_suppkey", alias="s",
    ranges=(("d", 14), ("slot", 96), ("op", 3), ("unit", 2)),
    keep="(7*s+5*d+slot)%487 <> 0 and (op < 2 or slot = 0)",
    columns=(
        ("MEDIDOR", "cast(s+1000 as string)"),
        *_loc_cols("s"),
        ("OPERACION", "case op when 0 then 'Delivered' when 1 then 'Received' else 'Sum' end"),
        ("UNIDAD", "case unit when 0 then 'kWh' else 'kVARh' end"),
        ("INTERVALO", "15"),
        ("CONSTANTE", "case when s%20 = 0 then '1.5' else '1' end"),
        ("DEMANDA", _DEMANDA),
        ("ENERGIA", f"({_DEMANDA}) / cast(4 as double)"),
        ("VALOR_LECTURA", f"cast(({_DEMANDA}) as string)"),
        ("FECHA_LECTURA_REAL", "{ts:2026-01-03|26*d|15*slot}"),
    ),
)

VOLTAGES = ViewSpec(
    name="voltages_raw",
    table="supplier", key="s_suppkey", alias="s",
    ranges=(("d", 3), ("slot", 96), ("phase", 3)),
    keep="phase = 0 or s%4 = 0",
    columns=(
        ("MEDIDOR", "cast(s+1000 as string)"),
        ("LOCALIZACION", "cast(7000000+s as string) || ',0'"),
        ("LOCALIZACION_REAL", "cast(7*s as string)"),
        ("UNIDAD", "'Phase ' || case phase when 0 then 'A' when 1 then 'B' else 'C' end "
                   "|| ' Average RMS Voltage'"),
        ("VALOR_LECTURA", "cast((480+(s+d+slot+phase)%41-20) / cast(4 as double) as string)"),
        ("FECHA_LECTURA_REAL", "{ts:2026-03-01|d|15*slot}"),
    ),
)


def _compact_date_text(k: str) -> str:
    return (
        f"case when ({k})%31 = 0 then '20260230' when ({k})%37 = 0 then '' "
        f"else '202' || cast(({k})%6 as string) || '0' || cast(1+({k})%9 as string) "
        f"|| cast(10+({k})%19 as string) end"
    )


CUSTOMERS = ViewSpec(
    name="customers_raw",
    table="customer", key="c_custkey", alias="c",
    ranges=(),
    keep="true",
    columns=(
        ("NISE", "case when c%3 = 0 then cast(5000100+c as string) || ',00' "
                 "else cast(5000100+c as string) end"),
        # date column i shifts the key by i
        *[(name, _compact_date_text(f"c+{i}")) for i, name in enumerate(CUSTOMER_DATE_COLUMNS)],
        ("DESCSECTOR", "case c%4 when 0 then 'Comercial' when 1 then 'Residencial' "
                       "when 2 then 'Comercial' else null end"),
    ),
)

GIS_LOADS = ViewSpec(
    name="gis_loads",
    table="customer", key="c_custkey", alias="c",
    ranges=(),
    keep="c%3 <> 0",
    columns=(
        ("IDLOCALIZA", "cast(7*c as string)"),
        ("NUMEROMEDI", "cast(c+1000 as string)"),
        ("OBJECTID", "5000000+c"),
        ("x", "cast(480000+10*(c%200) as double)"),
        ("y", "cast(1090000+10*(c%150) as double)"),
        ("seq", "c"),
    ),
)

GIS_TRANSFORMERS = ViewSpec(
    name="gis_transformers",
    table="supplier", key="s_suppkey", alias="s",
    ranges=(),
    keep="true",
    columns=(
        ("OBJECTID", "9000000+s"),
        ("KVA", "cast(25*(1+s%4) as double)"),
        ("x", "cast(480005+10*(s%200) as double)"),
        ("y", "cast(1090005+10*(s%150) as double)"),
        ("seq", "s"),
    ),
)

# A layer with service ids of its own (some missing or malformed), whole-number
# object ids of another width, and points as longitude and latitude.
GIS_SERVICES = ViewSpec(
    name="gis_services",
    table="customer", key="c_custkey", alias="c",
    ranges=(),
    keep="c%5 = 0",
    columns=(
        ("NISE", "case when c%15 = 0 then null when c%25 = 0 then 'bad' else cast(5000000+c as string) end"),
        ("OBJECTID", "cast(c as int)"),
        ("x", "-84.0 + cast(c%200 as double) / cast(2000 as double)"),
        ("y", "9.85 + cast(c%150 as double) / cast(2000 as double)"),
        ("seq", "c"),
    ),
)

VIEWS: dict[str, ViewSpec] = {
    v.name: v for v in (CONSUMPTION, POWER, VOLTAGES, CUSTOMERS, GIS_LOADS, GIS_TRANSFORMERS, GIS_SERVICES)
}

_TS_MACRO = re.compile(r"\{ts:([^|}]+)\|([^|}]+)\|([^}]+)\}")


def _render(expr: str, engine: str) -> str:
    """Expand ``{ts:base|days|minutes}`` into engine-specific timestamp SQL."""

    def sub(m: re.Match) -> str:
        base, days, minutes = m.group(1), m.group(2), m.group(3)
        if engine == "spark":
            return (f"(cast('{base} 00:00:00' as timestamp_ntz) + "
                    f"make_dt_interval(cast({days} as int), 0, cast({minutes} as int), 0))")
        return (f"(cast('{base} 00:00:00' as timestamp) + to_days(cast({days} as integer)) "
                f"+ to_minutes(cast({minutes} as bigint)))")

    return _TS_MACRO.sub(sub, expr)


# (sf_dir, view name) -> Parquet path of a materialized copy, see materialize().
_MATERIALIZED: dict[tuple[str, str], str] = {}


def materialize(spark: SparkSession, sf_dir: str, root: str,
                names: tuple[str, ...] | None = None) -> dict[str, str]:
    """Write derived raw tables to Parquet under ``root`` once; later
    ``build_view`` calls for ``sf_dir`` scan those files instead (filters
    and column pruning then reach a real Parquet scan)."""
    out = {}
    for name in names or tuple(VIEWS):
        path = f"{root}/{name}"
        build_view(spark, sf_dir, name).write.mode("overwrite").parquet(path)
        _MATERIALIZED[(sf_dir, name)] = path
        out[name] = path
    return out


# Expanded rows that one task makes at most, about: its sorts and hash tables
# then stay as large as they are, however many keys there are.
TASK_ROWS = 1_000_000
# Rows of a view for each task behind a shuffle, likewise. More, since every
# task of the one kind writes a block for every task of the other.
SHUFFLE_ROWS = 4_000_000


def _expanded(keys: DataFrame, spec: ViewSpec) -> int:
    """Rows that the keys become; counting them reads the key file's footers."""
    return keys.count() * math.prod(n for _, n in spec.ranges)


def build_view(spark: SparkSession, sf_dir: str, spec: ViewSpec | str) -> DataFrame:
    """The derived raw table as a lazy Spark DataFrame over ``sf_dir``."""
    if isinstance(spec, str):
        spec = VIEWS[spec]
    stored = _MATERIALIZED.get((sf_dir, spec.name))
    if stored is not None:
        df = spark.read.parquet(stored)
        widen_shuffles(spark, math.ceil(df.count() / SHUFFLE_ROWS))
        return df
    df = spark.read.parquet(f"{sf_dir}/{spec.table}.parquet").select(
        F.col(spec.key).alias(spec.alias)
    )
    if spec.ranges:
        # A key table is small (often one row group); spread the keys before
        # the expansion so the generated rows are produced by every core.
        rows = _expanded(df, spec)
        widen_shuffles(spark, math.ceil(rows / SHUFFLE_ROWS))
        df = df.repartition(max(default_parallelism(spark), math.ceil(rows / TASK_ROWS)), spec.alias)
    for name, n in spec.ranges:
        df = df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    if spec.keep != "true":
        df = df.filter(F.expr(spec.keep))
    return df.select(*[F.expr(_render(e, "spark")).alias(n) for n, e in spec.columns])


def view_sql(spec: ViewSpec | str) -> str:
    """DuckDB text of the same derived table (for the oracle)."""
    if isinstance(spec, str):
        spec = VIEWS[spec]
    inner = f"select {spec.key} as {spec.alias} from {spec.table}"
    for name, n in spec.ranges:
        inner = f"select *, unnest(range(0, {n})) as {name} from ({inner})"
    cols = ", ".join(f"{_render(e, 'duckdb')} as {n}" for n, e in spec.columns)
    return f"select {cols} from ({inner}) where {spec.keep}"
