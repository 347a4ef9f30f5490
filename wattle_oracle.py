"""DuckDB oracle text for every registered query.

Each statement derives the raw meter tables from the pre-registered test
views with the same formulas the Spark side uses (``view_sql``), then states
the operator in plain SQL. Dialect notes: DuckDB ``try_cast('12.3' as
bigint)`` rounds, so integer ids are guarded by a digits-only regex; regex
back-references are ``\\1``; weekday numbers start at Sunday = 0.
"""

from __future__ import annotations

import math
from types import SimpleNamespace

from wattle.sources.fixtures import view_sql

INT_TEXT = "'^[+-]?[0-9]+$'"


def _bigint(x: str) -> str:
    return (f"(case when regexp_matches(trim(cast({x} as varchar)), {INT_TEXT}) "
            f"then try_cast(trim(cast({x} as varchar)) as bigint) end)")


def _nise(x: str) -> str:
    return _bigint(f"regexp_replace(trim(cast({x} as varchar)), '^(\\d+),0+$', '\\1')")


def _hour(ts: str) -> str:
    return (f"((hour({ts})*cast(3600 as double) + minute({ts})*cast(60 as double) "
            f"+ second({ts})) / cast(3600 as double))")


def _epoch(ts: str) -> str:
    return f"cast(epoch(date_trunc('second', {ts})) as bigint)"


CLEAN_CONSUMPTION = f"""
select seq, {_bigint('MEDIDOR')} as MEDIDOR, {_bigint('LOCALIZACION_REAL')} as LOCALIZACION_REAL,
  SGDA, TIPO_CONSUMO, lower(CONTADOR) as CONTADOR, OPERACION, UNIDAD,
  try_cast(VALOR_LECTURA as double) as VALOR_LECTURA, TIPO_SECTOR, MULTIPLICADOR,
  FECHA_LECTURA_REAL, {_nise('LOCALIZACION')} as NISE, FECHA_LECTURA_REAL as FECHA_LECTURA,
  {_hour('FECHA_LECTURA_REAL')} as Hour
from consumption_raw"""

CUSTOMER_METERS = "(SGDA is null or SGDA = 'Bidireccional')"
ENERGY_BASE = (f"{CUSTOMER_METERS} and OPERACION in ('Delivered', 'Received') "
               "and CONTADOR = 'total' and TIPO_CONSUMO <> 'FPO'")
PHASES = "('a', 'b', 'c', 'A', 'B', 'C')"
PHASE_ROWS = f"{CUSTOMER_METERS} and CONTADOR in {PHASES} and OPERACION in {PHASES}"


def _with(**ctes: str) -> str:
    return "with " + ",\n".join(f"{k} as ({v})" for k, v in ctes.items()) + "\n"


def _consumption(extra: dict | None = None, window: tuple[str, str] | None = None) -> str:
    raw = view_sql("consumption_raw")
    if window:
        raw = (f"select * from ({raw}) where FECHA_LECTURA_REAL >= timestamp '{window[0]}' "
               f"and FECHA_LECTURA_REAL < timestamp '{window[1]}'")
    return _with(consumption_raw=raw, clean=CLEAN_CONSUMPTION, **(extra or {}))


ENE = f"select * from clean where {ENERGY_BASE} and contains(TIPO_CONSUMO, 'ENE')"
MDE = f"select * from clean where {ENERGY_BASE} and contains(TIPO_CONSUMO, 'MDE')"


def _first(op: str, value: str, tie: str = "seq") -> str:
    return (f"arg_min({value}, {tie}) filter (where OPERACION = '{op}' "
            f"and {value} is not null)")


PIVOT = f"""select MEDIDOR, FECHA_LECTURA, Hour,
  {_first('Delivered', 'VALOR_LECTURA')} as Delivered,
  {_first('Received', 'VALOR_LECTURA')} as Received
from ene where MEDIDOR is not null and FECHA_LECTURA is not null and Hour is not null
group by MEDIDOR, FECHA_LECTURA, Hour
having Delivered is not null or Received is not null"""

DELTAS = f"""select MEDIDOR, FECHA_LECTURA, Hour, Delivered, Received,
  {_epoch('FECHA_LECTURA')} - {_epoch('lag(FECHA_LECTURA) over w')} as Period,
  Delivered - lag(Delivered) over w as "Daily Sent",
  Received - lag(Received) over w as "Daily Gotten"
from piv window w as (partition by MEDIDOR order by FECHA_LECTURA)"""


def _phase(types: str) -> str:
    return _consumption() + f"select * from clean where {PHASE_ROWS} and TIPO_CONSUMO in {types}"


ORACLE: dict[str, str] = {
    "clean_consumption": _consumption() + "select * from clean",
    "time_window": _consumption(window=("2026-03-03", "2026-03-10")) + "select * from clean",
    "time_window_pruned": _consumption(window=("2026-03-03", "2026-03-10"))
    + "select * from clean",
    "time_window_other_ts": _with(
        consumption_raw=f"select * from ({view_sql('consumption_raw')}) "
        "where FECHA_LECTURA_REAL + interval 40 hours >= timestamp '2026-03-03' "
        "and FECHA_LECTURA_REAL + interval 40 hours < timestamp '2026-03-10'",
        clean=CLEAN_CONSUMPTION) + "select * from clean",
    "clean_numeric_ids": _with(consumption_raw=view_sql("consumption_raw"), clean=CLEAN_CONSUMPTION)
    + "select * replace (case when seq % 7 = 0 or seq % 11 = 0 then null else seq end as MEDIDOR, "
      "case when seq % 7 = 0 or seq % 11 = 0 then null else seq end as LOCALIZACION_REAL) from clean",
    "ene_readings": _consumption() + ENE,
    "mde_readings": _consumption() + MDE,
    "phase_power": _phase("('kW', 'kVAR', 'kVA')"),
    "phase_voltage": _phase("('Voltage', 'Voltage Angle')"),
    "phase_current": _phase("('Current', 'Current Angle')"),
    "phase_pf": _phase("('Power Factor', 'Power Factor Angle')"),
    "n_phases": _consumption({"pv": f"select * from clean where {PHASE_ROWS} and TIPO_CONSUMO in "
                                    "('Voltage', 'Voltage Angle')"})
    + "select MEDIDOR, count(distinct CONTADOR) as n_phases from pv group by MEDIDOR",
    "energy_pivot": _consumption({"ene": ENE}) + PIVOT,
    "energy_deltas": _consumption({"ene": ENE, "piv": PIVOT}) + DELTAS,
}

# ---------------------------------------------------------------- power / voltage

CLEAN_POWER = f"""
select {_bigint('MEDIDOR')} as MEDIDOR, {_bigint('LOCALIZACION_REAL')} as LOCALIZACION_REAL,
  SGDA, OPERACION, UNIDAD, INTERVALO, CONSTANTE, DEMANDA, ENERGIA,
  try_cast(VALOR_LECTURA as double) as VALOR_LECTURA, FECHA_LECTURA_REAL,
  {_nise('LOCALIZACION')} as NISE, FECHA_LECTURA_REAL as FECHA_LECTURA
from power_raw"""

CLEAN_VOLTAGE = f"""
select {_bigint('MEDIDOR')} as MEDIDOR, LOCALIZACION_REAL, cast(UNIDAD as varchar) as UNIDAD,
  try_cast(VALOR_LECTURA as double) as VALOR_LECTURA, FECHA_LECTURA_REAL,
  {_nise('LOCALIZACION')} as NISE, FECHA_LECTURA_REAL as FECHA_LECTURA
from voltages_raw where UNIDAD in ('Phase A Average RMS Voltage')"""

INTERVAL_COLS = ("MEDIDOR, NISE, LOCALIZACION_REAL, OPERACION, INTERVALO, FECHA_LECTURA, "
                 "ENERGIA, DEMANDA")


def _power(extra: dict | None = None) -> str:
    return _with(power_raw=view_sql("power_raw"), cleanp=CLEAN_POWER, **(extra or {}))


def _interval(unit: str) -> str:
    return (f"select {INTERVAL_COLS} from cleanp where {CUSTOMER_METERS} "
            f"and OPERACION in ('Delivered', 'Received') and UNIDAD = '{unit}'")


def _profile(p: str, src: str) -> str:
    return f"""select MEDIDOR as node, FECHA_LECTURA as ts,
  min(DEMANDA) filter (where OPERACION = 'Delivered' and DEMANDA is not null) as {p}_{p}dem,
  min(DEMANDA) filter (where OPERACION = 'Received' and DEMANDA is not null) as {p}_{p}gen,
  min(ENERGIA) filter (where OPERACION = 'Delivered' and ENERGIA is not null) as E_Edem,
  min(ENERGIA) filter (where OPERACION = 'Received' and ENERGIA is not null) as E_Egen
from {src} where MEDIDOR is not null and FECHA_LECTURA is not null
group by MEDIDOR, FECHA_LECTURA
having {p}_{p}dem is not null or {p}_{p}gen is not null or E_Edem is not null
  or E_Egen is not null"""


ACTIVE = _profile("P", "kwh")
SEASON_CASE = ("case month(ts) when 1 then 'III' when 2 then 'III' when 3 then 'I' "
               "when 4 then 'I' when 5 then 'I' when 6 then 'I' when 7 then 'V' "
               "when 8 then 'II' when 9 then 'II' when 10 then 'II' when 11 then 'II' "
               "when 12 then 'V' end")
LABELLED = f"""select node, ts, P_Pdem as P,
  case when dayofweek(ts) in (0, 6) then 'weekend' else 'weekday' end as day,
  {SEASON_CASE} as season, cast(ts as date) as date
from active"""
COUNTS = "select node, date, count(*) as samples from labelled group by node, date"
DAYS = ("select l.* from labelled l where exists (select 1 from counts c where c.node = l.node "
        "and c.date = l.date and c.samples = 96)")


def _scen(extra: dict | None = None) -> str:
    return _power({"kwh": _interval("kWh"), "active": ACTIVE, "labelled": LABELLED,
                   "counts": COUNTS, "days": DAYS, **(extra or {})})


STEPS = ("select *, row_number() over (partition by node, date order by ts) - 1 as timestep "
         "from days where day = '{day}'")

ORACLE.update({
    "clean_power": _power() + "select * from cleanp",
    "clean_voltage": _with(voltages_raw=view_sql("voltages_raw"), cleanv=CLEAN_VOLTAGE)
    + "select * from cleanv",
    "kwh_data": _power() + _interval("kWh"),
    "kvarh_data": _power() + _interval("kVARh"),
    "active_profile": _power({"kwh": _interval("kWh")}) + ACTIVE,
    "reactive_profile": _power({"kvarh": _interval("kVARh")}) + _profile("Q", "kvarh"),
    "flatten_active": _power({"kwh": _interval("kWh")}) + ACTIVE,
    "voltage_profile": _with(voltages_raw=view_sql("voltages_raw"), cleanv=CLEAN_VOLTAGE)
    + "select MEDIDOR as node, FECHA_LECTURA as ts, UNIDAD as phase, VALOR_LECTURA as V "
      "from cleanv",
    "calendar_labels": _scen() + "select * from labelled",
    "samples_per_day": _scen() + "select * from counts",
    "complete_days": _scen() + "select * from days",
    "weekend_curve": _scen({"steps": STEPS.format(day="weekend")})
    + "select node, timestep, avg(P) as P from steps group by node, timestep",
    "season_curves": _scen({"steps": STEPS.format(day="weekday")})
    + "select season, node, timestep, avg(P) as P from steps group by season, node, timestep",
})

# ---------------------------------------------------------------- audits, customers

CUSTOMER_DATES = ("FEC_INST_NISE", "FECHA_LECTURA", "FECHA_HASTA", "FECHA_CONEXION_RED",
                  "FEC_INST_MED", "FECHA_INTER")
CLEAN_CUSTOMERS = ("select " + ", ".join(
    f"cast(try_strptime({c}, '%Y%m%d') as date) as {c}" for c in CUSTOMER_DATES)
    + f", {_nise('NISE')} as NISE, DESCSECTOR from customers_raw")


def _customers(extra: dict | None = None) -> str:
    return _with(consumption_raw=view_sql("consumption_raw"), clean=CLEAN_CONSUMPTION,
                 customers_raw=view_sql("customers_raw"), custc=CLEAN_CUSTOMERS,
                 **(extra or {}))


def _domain(drop_nulls: bool = True) -> str:
    where = "where NISE is not null" if drop_nulls else ""
    return f"""select NISE, bool_or(a) as in_consumption, bool_or(b) as in_customers,
  case when bool_or(a) and bool_or(b) then 'in_both' when bool_or(a) then 'only_in_consumption'
       else 'only_in_customers' end as domain_status
from (select cast(NISE as varchar) as NISE, true as a, false as b from clean
      union all select cast(NISE as varchar), false, true from custc) {where}
group by NISE"""


# (column, regex, audit_key, include_nulls) per dataset, same rules as the Spark side.
_INT, _DEC = r"^[+-]?\d+$", r"^[+-]?\d+([.]\d+)?$"
_RULES = {
    "consumption_raw": [
        ("LOCALIZACION", _INT, "NISE", False), ("MEDIDOR", _INT, None, False),
        ("LOCALIZACION_REAL", _INT, None, False), ("VALOR_LECTURA", _DEC, None, True),
        ("TIPO_SECTOR", r"^(Comercial|Residencial|Industrial|SIN TARIFA)$", None, False),
        ("UNIDAD", r"(?i)^(kWh|Voltage|kW|kVAR|kVARh)$", None, False),
        ("CONTADOR", r"(?i)^(total|[abc]|tier[abcd])$", None, False),
        ("MULTIPLICADOR", r"^[01]$", None, False),
        ("OPERACION", r"^(Delivered|Received|Sum|A|B|C|a|b|c)$", None, False),
    ],
    "voltages_raw": [
        ("LOCALIZACION", _INT, "NISE", False), ("MEDIDOR", _INT, None, False),
        ("LOCALIZACION_REAL", _INT, None, False), ("VALOR_LECTURA", _DEC, None, True),
        ("UNIDAD", r"^Phase [ABC] Average RMS Voltage$", None, False),
    ],
    "power_raw": [
        ("LOCALIZACION", _INT, "NISE", False), ("MEDIDOR", _INT, None, False),
        ("LOCALIZACION_REAL", _INT, None, False), ("VALOR_LECTURA", _DEC, None, True),
        ("UNIDAD", r"(?i)^(kWh|kW|kVAR|kVARh)$", None, False),
        ("CONSTANTE", _INT, None, False),
        ("OPERACION", r"^(Delivered|Received|Sum)$", None, False),
    ],
}


def _audit_one(table: str, col: str, regex: str, key: str | None, nulls: bool,
               source: str | None = None) -> str:
    raw = f"cast({col} as varchar)"
    bad = (f"({raw} is null or not regexp_matches({raw}, '{regex}'))" if nulls
           else f"({raw} is not null and not regexp_matches({raw}, '{regex}'))")
    src = f", '{source}' as source_name" if source else ""
    return (f"select '{key or col}' as audit_key, '{col}' as column_name, "
            f"{raw} as invalid_raw_value, count(*) as invalid_count{src} "
            f"from {table} where {bad} group by {raw}")


def _audit(table: str, source: str | None = None) -> str:
    return "\nunion all\n".join(_audit_one(table, *r, source=source) for r in _RULES[table])


_AUDIT_UNION = (
    _with(consumption_raw=view_sql("consumption_raw"), voltages_raw=view_sql("voltages_raw"),
          power_raw=view_sql("power_raw"))
    + "\nunion all\n".join([_audit("consumption_raw", "ConsumptionData"),
                            _audit("voltages_raw", "VoltageData"),
                            _audit("power_raw", "PowerData")])
)

LATEST = """select NISE, TIPO_SECTOR as {alias} from (
  select NISE, TIPO_SECTOR, row_number() over (partition by NISE
    order by FECHA_LECTURA desc, seq) as rn
  from {src} where NISE is not null and FECHA_LECTURA is not null) where rn = 1"""

ORACLE.update({
    "customers_clean": _with(customers_raw=view_sql("customers_raw"), custc=CLEAN_CUSTOMERS)
    + "select * from custc",
    "domain_audit": _customers() + _domain(),
    "domain_audit_nulls": _customers() + _domain(drop_nulls=False),
    "audit_column": _with(consumption_raw=view_sql("consumption_raw"))
    + _audit_one("consumption_raw", "MEDIDOR", _INT, None, False),
    "audit_consumption": _with(consumption_raw=view_sql("consumption_raw"))
    + _audit("consumption_raw"),
    "audit_voltage": _with(voltages_raw=view_sql("voltages_raw")) + _audit("voltages_raw"),
    "audit_power": _with(power_raw=view_sql("power_raw")) + _audit("power_raw"),
    "audit_union": _AUDIT_UNION,
    "audit_sink": _AUDIT_UNION,
    "latest_attribute": _consumption() + LATEST.format(alias="TIPO_SECTOR", src="clean"),
    "reconcile_entities": _customers({
        "audit": _domain(),
        "keys": "select distinct cast(NISE as bigint) as NISE from audit "
                "where domain_status = 'in_both'",
        "latest": LATEST.format(alias="other_source",
                                src="(select * from clean where NISE in (select NISE from keys))"),
        "mine": "select NISE, DESCSECTOR as self_source from custc "
                "where NISE in (select NISE from keys)",
    }) + """select m.NISE, m.self_source, l.other_source,
  cast(m.self_source as varchar) = cast(l.other_source as varchar) as "match"
from mine m join latest l on m.NISE = l.NISE""",
    "scan_path": _consumption() + "select * from clean",
    "scan_table": _consumption() + "select * from clean",
})

# ---------------------------------------------------------------- network layers

LAYERS = f"""select {_bigint('IDLOCALIZA')} as LOCALIZACION_REAL, NUMEROMEDI as MEDIDOR, OBJECTID,
  x, y, seq, cast(null as double) as KVA, 'Loads' as layer, 5367 as epsg from gis_loads
union all
select cast(null as bigint), cast(null as varchar), OBJECTID, x, y, seq, KVA, 'Transformers',
  5367 from gis_transformers"""


def _layers(extra: dict | None = None) -> str:
    return _with(gis_loads=view_sql("gis_loads"), gis_transformers=view_sql("gis_transformers"),
                 layers=LAYERS, **(extra or {}))


ORACLE.update({
    "gis_layers": _layers() + "select * from layers",
    "gis_layer_slice": _layers() + """select * exclude (rn, cnt) from (
  select *, row_number() over (partition by layer order by seq) as rn,
    count(*) over (partition by layer) as cnt from layers) where rn <= cnt * 50 // 100""",
    "meter_locations": _with(
        consumption_raw=view_sql("consumption_raw"), clean=CLEAN_CONSUMPTION,
        gis_loads=view_sql("gis_loads"), gis_transformers=view_sql("gis_transformers"),
        layers=LAYERS,
        pairs="select distinct MEDIDOR, LOCALIZACION_REAL from clean "
              "where LOCALIZACION_REAL is not null",
        spots="select LOCALIZACION_REAL, arg_max(x, seq) as x, arg_max(y, seq) as y "
              "from layers where layer = 'Loads' and LOCALIZACION_REAL is not null "
              "group by LOCALIZACION_REAL",
    ) + """select p.MEDIDOR, p.LOCALIZACION_REAL, s.x, s.y
from pairs p join spots s on p.LOCALIZACION_REAL = s.LOCALIZACION_REAL""",
})

# ---------------------------------------------------------------- described analyses

_MAXD = PIVOT.replace("from ene", "from mde")
_PHASE_AVG = ", ".join(
    f"avg(case when lower(CONTADOR) = '{p}' then VALOR_LECTURA end) as phase_{p}" for p in "abc")

ORACLE.update({
    "daily_max_demand": _consumption({"mde": MDE}) + _MAXD,
    "reverse_flow": _power({"kwh": _interval("kWh"), "active": ACTIVE})
    + "select node, ts, P_Pdem, P_Pgen, P_Pdem - P_Pgen as P_net from active where P_Pgen > 0",
    "voltage_compliance": _with(voltages_raw=view_sql("voltages_raw"), cleanv=CLEAN_VOLTAGE)
    + """select MEDIDOR as node, count(*) as samples,
  count(case when VALOR_LECTURA < 120.0 * (1 - 0.03) or VALOR_LECTURA > 120.0 * (1 + 0.03)
             then 1 end) as out_of_band,
  count(case when VALOR_LECTURA < 120.0 * (1 - 0.03) or VALOR_LECTURA > 120.0 * (1 + 0.03)
             then 1 end) / count(*) as out_of_band_share
from cleanv where VALOR_LECTURA is not null group by MEDIDOR""",
    "phase_balance": _consumption({"pv": f"select * from clean where {PHASE_ROWS} and "
                                        "TIPO_CONSUMO in ('Voltage', 'Voltage Angle')"})
    + f"""select *, case when (coalesce(phase_a, 0) + coalesce(phase_b, 0) + coalesce(phase_c, 0))
    / ((phase_a is not null)::int + (phase_b is not null)::int + (phase_c is not null)::int) <> 0
  then (greatest(phase_a, phase_b, phase_c) - least(phase_a, phase_b, phase_c))
    / ((coalesce(phase_a, 0) + coalesce(phase_b, 0) + coalesce(phase_c, 0))
       / ((phase_a is not null)::int + (phase_b is not null)::int + (phase_c is not null)::int))
  end as unbalance
from (select MEDIDOR, FECHA_LECTURA, TIPO_CONSUMO, {_PHASE_AVG} from pv
      where VALOR_LECTURA is not null and MEDIDOR is not null and FECHA_LECTURA is not null
      group by MEDIDOR, FECHA_LECTURA, TIPO_CONSUMO)""",
})

# ---------------------------------------------------------------- natural data (events)

_EVENTS = _with(
    hourly="select event_type as node, date_trunc('hour', ts) as ts, count(*) as P "
           "from events where ts is not null and event_type is not null "
           "group by event_type, date_trunc('hour', ts)",
    labelled=LABELLED.replace("P_Pdem as P", "P").replace("from active", "from hourly"),
    counts=COUNTS,
    days=DAYS.replace("c.samples = 96", "c.samples = 24"),
)

ORACLE.update({
    "events_complete_days": _EVENTS + "select * from days",
    "events_weekend_curve": _EVENTS.rstrip("\n") + ",\nsteps as (" + STEPS.format(day="weekend")
    + ")\nselect node, timestep, avg(P) as P from steps group by node, timestep",
})

ORACLE["domain_audit_gis"] = _with(
    consumption_raw=view_sql("consumption_raw"), clean=CLEAN_CONSUMPTION,
    gis_loads=view_sql("gis_loads"), gis_transformers=view_sql("gis_transformers"),
    layers=LAYERS,
) + """select NISE, bool_or(a) as in_consumption, bool_or(b) as in_gis,
  case when bool_or(a) and bool_or(b) then 'in_both' when bool_or(a) then 'only_in_consumption'
       else 'only_in_gis' end as domain_status
from (select cast(NISE as varchar) as NISE, true as a, false as b from clean
      union all select cast(OBJECTID as varchar), false, true from layers where layer = 'Loads')
where NISE is not null group by NISE"""

# ---------------------------------------------------------------- reprojection (TM -> WGS84)


# Published definition of EPSG:5367, stated here apart from the library's own.
_GRID = SimpleNamespace(lon0=-84.0, lat0=0.0, k0=0.9999, false_easting=500000.0, false_northing=0.0,
                        a=6378137.0, inv_f=298.257223563)


def _tm_inverse_sql() -> str:
    """Inverse Transverse Mercator series in SQL for the local grid, with the
    ellipsoid constants computed here in Python (Snyder 1987, eqs. 8-18..8-25)."""
    g = _GRID
    f = 1 / g.inv_f
    e2 = f * (2 - f)
    ep2 = e2 / (1 - e2)
    m1 = 1 - e2 / 4 - 3 * e2 ** 2 / 64 - 5 * e2 ** 3 / 256
    m2 = 3 * e2 / 8 + 3 * e2 ** 2 / 32 + 45 * e2 ** 3 / 1024
    m3 = 15 * e2 ** 2 / 256 + 45 * e2 ** 3 / 1024
    m4 = 35 * e2 ** 3 / 3072
    lat0 = math.radians(g.lat0)
    m0 = g.a * (m1 * lat0 - m2 * math.sin(2 * lat0) + m3 * math.sin(4 * lat0)
                - m4 * math.sin(6 * lat0))
    e1 = (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
    r = repr
    return f"""
mu as (select *, ({r(m0)} + (y - {r(g.false_northing)}) / {r(g.k0)}) / {r(g.a * m1)} as mu
       from loads),
foot as (select *, mu + {r(3 * e1 / 2 - 27 * e1 ** 3 / 32)} * sin(2 * mu)
                 + {r(21 * e1 ** 2 / 16 - 55 * e1 ** 4 / 32)} * sin(4 * mu)
                 + {r(151 * e1 ** 3 / 96)} * sin(6 * mu)
                 + {r(1097 * e1 ** 4 / 512)} * sin(8 * mu) as phi1 from mu),
terms as (select *, {r(ep2)} * pow(cos(phi1), 2) as c1, pow(tan(phi1), 2) as t1,
                 {r(g.a)} / sqrt(1 - {r(e2)} * pow(sin(phi1), 2)) as n1,
                 {r(g.a * (1 - e2))} / pow(1 - {r(e2)} * pow(sin(phi1), 2), 1.5) as r1
          from foot),
dd as (select *, (x - {r(g.false_easting)}) / (n1 * {r(g.k0)}) as d from terms),
geo as (select *,
  phi1 - (n1 * tan(phi1) / r1) * (d * d / 2
    - (5 + 3 * t1 + 10 * c1 - 4 * c1 * c1 - {r(9 * ep2)}) * pow(d, 4) / 24
    + (61 + 90 * t1 + 298 * c1 + 45 * t1 * t1 - {r(252 * ep2)} - 3 * c1 * c1) * pow(d, 6) / 720)
    as phi,
  {r(math.radians(g.lon0))} + (d - (1 + 2 * t1 + c1) * pow(d, 3) / 6
    + (5 - 2 * c1 + 28 * t1 - 3 * c1 * c1 + {r(8 * ep2)} + 24 * t1 * t1) * pow(d, 5) / 120)
    / cos(phi1) as lam
  from dd)"""


ORACLE["gis_reproject"] = (
    _layers({"loads": "select * from layers where layer = 'Loads'"}).rstrip("\n")
    + "," + _tm_inverse_sql() + """
select LOCALIZACION_REAL, MEDIDOR, OBJECTID as NISE, round(degrees(lam), 6) as x,
  round(degrees(phi), 6) as y, seq, KVA, layer, 4326 as epsg from geo"""
)


# ---------------------------------------------------------------- content of the supplied tables

_LATEST_ORDER = """select o_custkey, o_orderpriority from (
  select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as rn
  from orders where o_custkey is not null and o_orderdate is not null) where rn = 1"""

ORACLE.update({
    "orders_latest_priority": _LATEST_ORDER,
    "orders_domain_audit": """select custkey, bool_or(a) as in_orders, bool_or(b) as in_customers,
  case when bool_or(a) and bool_or(b) then 'in_both' when bool_or(a) then 'only_in_orders'
       else 'only_in_customers' end as domain_status
from (select cast(o_custkey as varchar) as custkey, true as a, false as b from orders
      union all select cast(c_custkey as varchar), false, true from customer)
where custkey is not null group by custkey""",
    "orders_reconcile": f"""select c_custkey as custkey, c_mktsegment as self_source,
  o_orderpriority as other_source, c_mktsegment = o_orderpriority as "match"
from customer join ({_LATEST_ORDER}) on o_custkey = c_custkey""",
    "events_previous": """select event_id, user_id, value, lag(event_id) over w as prev_event_id,
  lag(value) over w as prev_value
from events window w as (partition by user_id order by ts nulls first, event_id nulls first)""",
    "orders_odd_priority": _audit_one("orders", "o_orderpriority", "^[1-3]-[A-Z]+$", None, False),
    "events_odd_props": _audit_one("events", "props", r'^\{"k": [0-9]\}$', "one_digit", False),
})


# ---------------------------------------------------------------- analyses over time, place and neighbourhood

_ACTIVE = {"kwh": _interval("kWh"), "active": ACTIVE}


def _runs(on: str, energy: str, peak: str) -> str:
    return _power({
        **_ACTIVE,
        "flagged": f"select *, coalesce({on}, false) as flag from active",
        "before": "select *, lag(flag) over w as flag0, lag(ts) over w as ts0 from flagged "
                  "window w as (partition by node order by ts)",
        "numbered": "select *, sum(case when flag and not coalesce(flag0 and ts <= ts0 + interval 15 minutes, false) "
                    "then 1 else 0 end) over (partition by node order by ts) as run from before",
    }) + f"""select node, min(ts) as start_ts, max(ts) as end_ts, count(*) as samples,
  sum({energy}) as energy, max({peak}) as peak
from numbered where flag group by node, run"""


_NET = "coalesce(P_Pgen, 0) - coalesce(P_Pdem, 0)"
_PLACES = {
    "consumption_raw": view_sql("consumption_raw"), "clean": CLEAN_CONSUMPTION,
    "sectors": LATEST.format(alias="sector", src="clean"),
    "newest": "select MEDIDOR, max(FECHA_LECTURA) as at from kwh where MEDIDOR is not null group by MEDIDOR",
    "last": "select k.MEDIDOR as node, min(k.LOCALIZACION_REAL) as loc, min(k.NISE) as NISE, "
            "bool_or(k.LOCALIZACION_REAL is null) as noloc, bool_or(k.NISE is null) as nonise "
            "from kwh k join newest n on n.MEDIDOR = k.MEDIDOR and n.at = k.FECHA_LECTURA group by k.MEDIDOR",
    "places": "select node, s.sector, case when not noloc then loc // 100 end as zone "
              "from last l left join sectors s on s.NISE = l.NISE and not nonise",
}


def _rollup_level(level: int) -> str:
    names = ("sector", "zone", "node")
    cols = ", ".join(n if i < level else f"null as {n}" for i, n in enumerate(names))
    by = ", ".join([*names[:level], "cast(date_trunc('day', ts) as timestamp)"])
    return (f"select {level} as level, {cols}, cast(date_trunc('day', ts) as timestamp) as period, "
            "count(distinct node) as nodes, count(*) as samples, sum(E_Edem) as energy_in, "
            f"sum(E_Egen) as energy_out, max(P_Pdem) as peak from placed group by {by}")


_PLACED = {"placed": "select a.*, p.sector, p.zone from active a left join places p using (node)"}
_NETWORK_POINTS = {
    "gis_loads": view_sql("gis_loads"), "gis_transformers": view_sql("gis_transformers"), "layers": LAYERS,
    "loads": "select distinct OBJECTID as id, x, y from layers where layer = 'Loads'",
    "transformers": "select OBJECTID, x, y, KVA from layers where layer = 'Transformers'",
}


def _nearest(points: str, reach: float) -> str:
    """id, target and distance of the nearest transformer of each point."""
    return f"""select p.id, t.OBJECTID as target, t.distance from (select distinct id from {points}) p left join (
  select id, OBJECTID, distance, row_number() over (partition by id order by distance, OBJECTID) as place from (
    select p.id, t.OBJECTID, sqrt((t.x - p.x) * (t.x - p.x) + (t.y - p.y) * (t.y - p.y)) as distance
    from {points} p cross join transformers t) where distance <= {reach}) t on t.id = p.id and t.place = 1"""


def _shape_rounds(k: int, rounds: int) -> dict[str, str]:
    """CTEs of the fixed rounds: centres c0, assignment a0, centres c1, ..."""
    ctes = {
        "steps": STEPS.format(day="weekend"),
        "curves": "select node, timestep, avg(P) as P from steps group by node, timestep",
        "lists": "select node, list(P order by timestep) as v, list_reduce(list(P order by timestep), "
                 "lambda a, x: a + x, cast(0 as double)) / 96 as mean from curves "
                 "group by node having count(P) = 96 and count(*) = 96",
        "shapes": "select node, list_transform(v, lambda x: cast(floor(x / mean * 1000 + 0.5) as bigint)) as shape "
                  "from lists where mean > 0",
        "c0": "select row_number() over (order by md5(cast(node as varchar)), node) - 1 as cluster, shape as centre "
              f"from shapes qualify cluster < {k}",
    }
    for r in range(rounds + 1):
        ctes[f"d{r}"] = (f"select node, shape, cluster, list_sum(list_transform(list_zip(shape, centre), "
                         f"lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as distance from shapes cross join c{r}")
        ctes[f"a{r}"] = (f"select * from d{r} qualify row_number() over (partition by node "
                         "order by distance, cluster) = 1")
        if r < rounds:
            ctes[f"m{r}"] = (f"select cluster, i, cast(floor(sum(v) / count(*) + 0.5) as bigint) as v from (select "
                             f"cluster, unnest(shape) as v, generate_subscripts(shape, 1) as i from a{r}) "
                             "group by cluster, i")
            ctes[f"c{r + 1}"] = (f"select c.cluster, coalesce(m.centre, c.centre) as centre from c{r} c left join "
                                 f"(select cluster, list(v order by i) as centre from m{r} group by cluster) m "
                                 "using (cluster)")
    return ctes


_V_MEANS = """select MEDIDOR as node, UNIDAD as phase, time_bucket(interval {0}, FECHA_LECTURA) as ts,
  avg(VALOR_LECTURA) as V, count(*) as samples
from cleanv where VALOR_LECTURA is not null and FECHA_LECTURA is not null group by all"""


def _tm_forward_sql() -> tuple[str, str]:
    """Easting and northing of x, y in degrees (Snyder 1987, eqs. 8-9, 8-10)."""
    g = _GRID
    f = 1 / g.inv_f
    e2 = f * (2 - f)
    ep2 = e2 / (1 - e2)
    phi, a = "radians(y)", f"(radians(x) - {math.radians(g.lon0)!r}) * cos(radians(y))"
    n, t, c = f"({g.a!r} / sqrt(1 - {e2!r} * pow(sin({phi}), 2)))", f"pow(tan({phi}), 2)", \
        f"({ep2!r} * pow(cos({phi}), 2))"
    m = (f"({g.a!r} * ({1 - e2 / 4 - 3 * e2 ** 2 / 64 - 5 * e2 ** 3 / 256!r} * {phi} "
         f"- {3 * e2 / 8 + 3 * e2 ** 2 / 32 + 45 * e2 ** 3 / 1024!r} * sin(2 * {phi}) "
         f"+ {15 * e2 ** 2 / 256 + 45 * e2 ** 3 / 1024!r} * sin(4 * {phi}) "
         f"- {35 * e2 ** 3 / 3072!r} * sin(6 * {phi})))")
    east = (f"{g.false_easting!r} + {g.k0!r} * {n} * (({a}) + (1 - {t} + {c}) * pow({a}, 3) / 6 "
            f"+ (5 - 18 * {t} + {t} * {t} + 72 * {c} - {58 * ep2!r}) * pow({a}, 5) / 120)")
    north = (f"{g.k0!r} * ({m} + {n} * tan({phi}) * (pow({a}, 2) / 2 + (5 - {t} + 9 * {c} + 4 * {c} * {c}) "
             f"* pow({a}, 4) / 24 + (61 - 58 * {t} + {t} * {t} + 600 * {c} - {330 * ep2!r}) * pow({a}, 6) / 720))")
    return east, north


_EAST, _NORTH = _tm_forward_sql()
_NETWORK = {
    "gis_loads": view_sql("gis_loads"), "gis_transformers": view_sql("gis_transformers"),
    "gis_services": view_sql("gis_services"),
    "network": f"""select LOCALIZACION_REAL, MEDIDOR, OBJECTID, round(x, 3) as x, round(y, 3) as y, seq, KVA,
  cast(null as varchar) as NISE, layer, epsg from ({LAYERS})
union all
select null, null, OBJECTID, round({_EAST}, 3), round({_NORTH}, 3), seq, null, NISE, 'Services', 5367
from gis_services""",
}

ORACLE.update({
    "phase_balance_power": ORACLE["phase_balance"].replace(
        "TIPO_CONSUMO in ('Voltage', 'Voltage Angle')", "TIPO_CONSUMO in ('kW', 'kVAR', 'kVA')"),
    "reverse_flow_periods": _runs("P_Pgen > 0", "E_Egen", "P_Pgen"),
    "net_generation_periods": _runs(f"{_NET} > 0", "coalesce(E_Egen, 0) - coalesce(E_Edem, 0)", _NET),
    "load_rollup": _power({**_ACTIVE, **_PLACES, **_PLACED})
    + "\nunion all\n".join(_rollup_level(n) for n in range(4)),
    "coincident_peaks": _power({
        **_ACTIVE, **_PLACES, **_PLACED,
        "loads": "select zone, ts, sum(coalesce(P_Pdem, 0)) as demand from placed group by zone, ts",
        "top": "select zone, cast(date_trunc('day', ts) as timestamp) as period, max(demand) as peak "
               "from loads group by all",
        "own": "select zone, period, sum(p) as node_peaks from (select zone, node, "
               "cast(date_trunc('day', ts) as timestamp) as period, max(coalesce(P_Pdem, 0)) as p "
               "from placed group by all) group by zone, period",
    }) + """select t.zone, t.period, t.peak, (select min(l.ts) from loads l where l.zone is not distinct from t.zone
    and date_trunc('day', l.ts) = t.period and l.demand = t.peak) as peak_ts, o.node_peaks,
  case when t.peak <> 0 then o.node_peaks / t.peak end as diversity
from top t join own o on o.zone is not distinct from t.zone and o.period = t.period""",
    "transformer_assignment": _with(**_NETWORK_POINTS)
    + f"select id as NISE, target as transformer, distance from ({_nearest('loads', 400.0)})",
    "transformer_loading": _power({
        **_ACTIVE, **_NETWORK_POINTS,
        "spots": "select LOCALIZACION_REAL, arg_max(x, seq) as x, arg_max(y, seq) as y from layers "
                 "where layer = 'Loads' and LOCALIZACION_REAL is not null group by LOCALIZACION_REAL",
        "placed": "select distinct c.MEDIDOR as id, s.x, s.y from cleanp c join spots s using (LOCALIZACION_REAL) "
                  "where c.MEDIDOR is not null",
        "near": _nearest("placed", 400.0),
    }) + """select n.target as transformer, a.ts, count(*) as nodes, sum(coalesce(P_Pdem, 0)) as demand,
  sum(coalesce(P_Pgen, 0)) as generation, sum(coalesce(P_Pdem, 0) - coalesce(P_Pgen, 0)) as net, max(t.KVA) as kva,
  abs(sum(coalesce(P_Pdem, 0) - coalesce(P_Pgen, 0))) / max(t.KVA) as loading
from active a join near n on n.id = a.node join transformers t on t.OBJECTID = n.target group by n.target, a.ts""",
    "neighbours": _with(**_NETWORK_POINTS) + """select id as NISE, place as rank, other as neighbour, distance from (
  select *, row_number() over (partition by id order by distance, other) as place from (
    select a.id, b.id as other, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) as distance
    from loads a join loads b on a.id <> b.id) where distance <= 150.0) where place <= 3""",
    "spatial_clusters": "with recursive " + _with(**_NETWORK_POINTS, **{
        "cells": "select *, floor(x / 50.0) as cx, floor(y / 50.0) as cy from loads",
        "dense": "select cx, cy, min(id) as first from cells group by cx, cy having count(*) >= 4",
        "reach": "select cx, cy, cx as tx, cy as ty from dense union select r.cx, r.cy, d.cx, d.cy from reach r "
                 "join dense d on abs(d.cx - r.tx) <= 1 and abs(d.cy - r.ty) <= 1",
        "named": "select r.cx, r.cy, min(d.first) as cluster from reach r join dense d "
                 "on d.cx = r.tx and d.cy = r.ty group by r.cx, r.cy",
    }).removeprefix("with ") + "select id as NISE, x, y, cluster from cells left join named using (cx, cy)",
    "shape_clusters": _scen(_shape_rounds(4, 6)) + "select node, cluster, cast(distance as bigint) as distance from a6",
    "voltage_resampled": _with(voltages_raw=view_sql("voltages_raw"), cleanv=CLEAN_VOLTAGE) + _V_MEANS.format("1 hour"),
    "voltage_deviation": _with(
        voltages_raw=view_sql("voltages_raw"), cleanv=CLEAN_VOLTAGE, means=_V_MEANS.format("10 minutes"),
        weekly="select node, phase, cast(date_trunc('week', ts) as timestamp) as week, V, "
               "row_number() over (partition by node, phase, date_trunc('week', ts) order by V) as up, "
               "row_number() over (partition by node, phase, date_trunc('week', ts) order by V desc) as down, "
               "count(*) over (partition by node, phase, date_trunc('week', ts)) as n from means")
    + f"""select node, phase, week, count(*) as slots, min(V) as v_min, max(V) as v_max,
  max(V) filter (down = cast(ceil(n * cast(0.95 as double)) as bigint)) as v_low,
  max(V) filter (up = cast(ceil(n * cast(0.95 as double)) as bigint)) as v_high,
  count(*) filter (V between {120.0 * 0.97!r} and {120.0 * 1.03!r}) / count(*) as in_narrow,
  count(*) filter (V between {120.0 * 0.96!r} and {120.0 * 1.04!r}) / count(*) as in_wide,
  count(*) filter (V between {120.0 * 0.97!r} and {120.0 * 1.03!r}) >= ceil(count(*) * cast(0.95 as double))
    and count(*) filter (V between {120.0 * 0.96!r} and {120.0 * 1.04!r}) = count(*) as compliant
from weekly group by node, phase, week""",
    "network_layers": _with(**_NETWORK) + "select * from network",
    "network_services": _with(**_NETWORK) + "select * from network where layer = 'Services'",
    "network_attributes": _with(**_NETWORK)
    + "select * exclude (OBJECTID, NISE, x, y), OBJECTID as NISE from network where layer = 'Loads'",
    "meter_locations_epsg": "select *, 5367 as epsg from (" + ORACLE["meter_locations"] + ")",
    "scan_table_over_path": ORACLE["scan_table"],
    "season_curves_sorted": "select *, timestep = min(timestep) over (partition by season, node) as first from ("
    + ORACLE["season_curves"] + ")",
})


# ---------------------------------------------------------------- all measures at once; repeated readings and times

_LABELS = {
    "energy": f"{ENERGY_BASE} and contains(TIPO_CONSUMO, 'ENE')",
    "max_demand": f"{ENERGY_BASE} and contains(TIPO_CONSUMO, 'MDE')",
    "power": f"{PHASE_ROWS} and TIPO_CONSUMO in ('kW', 'kVAR', 'kVA')",
    "voltage": f"{PHASE_ROWS} and TIPO_CONSUMO in ('Voltage', 'Voltage Angle')",
    "current": f"{PHASE_ROWS} and TIPO_CONSUMO in ('Current', 'Current Angle')",
    "power_factor": f"{PHASE_ROWS} and TIPO_CONSUMO in ('Power Factor', 'Power Factor Angle')",
}
_REPEATED = (
    "select * replace (DEMANDA - copy / cast(4 as double) as DEMANDA, ENERGIA + copy as ENERGIA) from (select *, "
    "unnest(range(0, case when (cast(MEDIDOR as int) + INTERVALO + cast(trunc(DEMANDA * 4) as int)) % 3 = 0 "
    "then 2 else 1 end)) as copy from cleanp)")


def _by_copy(op: str, value: str) -> str:
    return f"arg_min({value}, copy) filter (where OPERACION = '{op}' and {value} is not null)"


ORACLE.update({
    "labelled_measures": _consumption() + " union all ".join(
        f"select seq, '{name}' as measure, MEDIDOR, VALOR_LECTURA from clean where {rule}"
        for name, rule in _LABELS.items()),
    "active_profile_repeats": _power({"twice": _REPEATED}) + f"""select MEDIDOR as node, FECHA_LECTURA as ts,
  {_by_copy('Delivered', 'DEMANDA')} as P_Pdem, {_by_copy('Received', 'DEMANDA')} as P_Pgen,
  {_by_copy('Delivered', 'ENERGIA')} as E_Edem, {_by_copy('Received', 'ENERGIA')} as E_Egen
from twice where {CUSTOMER_METERS} and OPERACION in ('Delivered', 'Received') and UNIDAD = 'kWh'
  and MEDIDOR is not null and FECHA_LECTURA is not null group by MEDIDOR, FECHA_LECTURA
having P_Pdem is not null or P_Pgen is not null or E_Edem is not null or E_Egen is not null""",
    "weekend_curve_ties": _scen({
        "again": "select * replace (P + seq as P) from (select *, unnest([0, 1]) as seq from days)",
        "steps": "select *, row_number() over (partition by node, date order by ts, seq) - 1 as timestep "
                 "from again where day = 'weekend'",
    }) + "select node, timestep, avg(P) as P from steps group by node, timestep",
})

ORACLE["domain_audit_services"] = _consumption({**_NETWORK}) + """select NISE, bool_or(a) as in_consumption,
  bool_or(b) as in_services, case when bool_or(a) and bool_or(b) then 'in_both'
    when bool_or(a) then 'only_in_consumption' else 'only_in_services' end as domain_status
from (select cast(NISE as varchar) as NISE, true as a, false as b from clean
      union all select NISE, false, true from network where layer = 'Services')
where NISE is not null group by NISE"""
ORACLE["customers_typed"] = _with(customers_raw=view_sql("customers_raw")) + """select NISE,
  try_cast(FEC_INST_NISE as bigint) as FEC_INST_NISE, try_cast(FECHA_LECTURA as double) as FECHA_LECTURA, DESCSECTOR
from customers_raw"""
