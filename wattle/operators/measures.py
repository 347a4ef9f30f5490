"""Which readings belong to which measure.

Measures are declared once, as conditions on the reading's columns. ``split``
takes one measure's rows, a filter that Catalyst pushes into the scan;
``labelled`` tells all of them in one pass, for a caller who wants several.
"""

from __future__ import annotations

import operator
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattle.sources.schemas import require_columns

# Fixed values of the measure model.
PHASES = ["a", "b", "c", "A", "B", "C"]
FLOWS = ["Delivered", "Received"]
INTERVAL_COLUMNS = ["MEDIDOR", "NISE", "LOCALIZACION_REAL", "OPERACION", "INTERVALO",
                    "FECHA_LECTURA", "ENERGIA", "DEMANDA"]
VOLTAGE_COLUMNS = ["MEDIDOR", "NISE", "FECHA_LECTURA", "UNIDAD", "VALOR_LECTURA"]


@dataclass(frozen=True)
class Measure:
    """``among``: allowed values by column; ``part``: a text that the kind of
    consumption contains; ``columns``: what is kept of a row (all, if none)."""

    among: dict[str, list[str]]
    part: str | None = None
    columns: tuple[str, ...] = ()

    def rule(self) -> Column:
        tests = [F.col(c).isin(values) for c, values in self.among.items()]
        if self.part is not None:
            tests.append(F.col("TIPO_CONSUMO").contains(self.part))
        return reduce(operator.and_, tests)


def _register(part: str) -> Measure:
    return Measure({"OPERACION": FLOWS, "CONTADOR": ["total"]}, part)


def _by_phase(*kinds: str) -> Measure:
    return Measure({"CONTADOR": PHASES, "OPERACION": PHASES, "TIPO_CONSUMO": list(kinds)})


def _interval(unit: str) -> Measure:
    return Measure({"OPERACION": FLOWS, "UNIDAD": [unit]}, columns=tuple(INTERVAL_COLUMNS))


# Of daily readings: registers of the whole meter, then values of one phase.
# Of interval readings: active and reactive energy.
MEASURES: dict[str, Measure] = {
    "energy": _register("ENE"),
    "max_demand": _register("MDE"),
    "power": _by_phase("kW", "kVAR", "kVA"),
    "voltage": _by_phase("Voltage", "Voltage Angle"),
    "current": _by_phase("Current", "Current Angle"),
    "power_factor": _by_phase("Power Factor", "Power Factor Angle"),
    "active": _interval("kWh"),
    "reactive": _interval("kVARh"),
}
DAILY = ("energy", "max_demand", "power", "voltage", "current", "power_factor")


def of_customers() -> Column:
    """A meter of a customer, not of a transformer: SGDA NULL or 'Bidireccional'."""
    return F.col("SGDA").isNull() | F.col("SGDA").isin("Bidireccional")


def split(clean: DataFrame, measure: str, keep: str | None = None) -> DataFrame:
    """The customers' rows of one measure. ``keep`` is a further column (the
    caller's sequence) beside those that an interval measure keeps."""
    spec = MEASURES[measure]
    if keep is not None:
        require_columns(clean, [keep], f"{measure} readings")
    rows = clean.filter(of_customers() & spec.rule())
    if not spec.columns:
        return rows
    return rows.select(*dict.fromkeys([*spec.columns, *([keep] if keep else [])]))


def labelled(clean: DataFrame, names: Iterable[str] = DAILY) -> DataFrame:
    """The customers' rows of all measures in ``names`` in one pass, with a
    ``measure`` column; a row of two measures is there twice."""
    found = F.array(*[F.when(MEASURES[n].rule(), F.lit(n)) for n in names])
    rows = clean.filter(of_customers()).withColumn("measure", F.explode(F.array_compact(found)))
    return rows


def n_phases(phase_voltage_rows: DataFrame) -> DataFrame:
    """Distinct registers (phases) seen per meter in its voltage rows.

    Exact distinct count; Spark plans it as a partial aggregate on
    (meter, register) first, so a meter with many rows is combined map-side.
    """
    return phase_voltage_rows.groupBy("MEDIDOR").agg(
        F.countDistinct("CONTADOR").alias("n_phases")
    )


def voltage_data(clean_voltage_df: DataFrame) -> DataFrame:
    return clean_voltage_df.select(*VOLTAGE_COLUMNS)


def voltage_profile(clean_voltage_df: DataFrame) -> DataFrame:
    """Tidy voltage frame: node, ts, phase, V."""
    names = {"MEDIDOR": "node", "FECHA_LECTURA": "ts", "UNIDAD": "phase", "VALOR_LECTURA": "V"}
    return clean_voltage_df.select(*names).withColumnsRenamed(names)
