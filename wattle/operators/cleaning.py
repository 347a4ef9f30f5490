"""Row-level cleaning of raw readings and of the customer master.

All steps are projections and filters of built-in expressions: they fuse into
one whole-stage-codegen stage right after the scan and never shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattle.functions.columns import (
    compact_date,
    decimal_hour,
    nise_from_text,
    try_bigint,
    try_double,
)
from wattle.sources.schemas import CUSTOMER_DATE_COLUMNS, require_columns

DEFAULT_VOLTAGE_PHASES: tuple[str, ...] = ("Phase A Average RMS Voltage",)


def _bound(df: DataFrame, ts_col: str, value: str):
    try:
        datetime.fromisoformat(value)
    except ValueError as exc:
        raise ValueError(f"invalid time bound {value!r}: {exc}") from None
    return F.lit(value).cast(df.schema[ts_col].dataType)


def time_window(
    df: DataFrame,
    from_ts: str | None = None,
    to_ts: str | None = None,
    ts_col: str = "FECHA_LECTURA_REAL",
    partition_col: str | None = None,
) -> DataFrame:
    """Half-open window ``from_ts <= ts < to_ts`` on raw rows; either end optional.

    Bounds become typed literals so the predicate reaches the Parquet scan.
    Rows with a NULL timestamp drop as soon as one bound is set.

    ``partition_col`` names a date column that was derived from ``ts_col``
    (``write_readings``), in whatever time zone: whole date folders are then
    skipped at planning time, with a day to spare on either side. A column is
    never used for that by its name alone.
    """
    if from_ts is None and to_ts is None:
        return df
    require_columns(df, [ts_col, *([partition_col] if partition_col else [])], "readings")
    cond = None
    if from_ts is not None:
        cond = F.col(ts_col) >= _bound(df, ts_col, from_ts)
    if to_ts is not None:
        upper = F.col(ts_col) < _bound(df, ts_col, to_ts)
        cond = upper if cond is None else cond & upper
    if partition_col:
        day = F.col(partition_col)
        if from_ts is not None:
            cond = cond & (day >= F.date_sub(F.to_date(_bound(df, ts_col, from_ts)), 1))
        if to_ts is not None:
            cond = cond & (day <= F.date_add(F.to_date(_bound(df, ts_col, to_ts)), 1))
    return df.filter(cond)


def _nise(df: DataFrame) -> dict:
    return {"NISE": nise_from_text("LOCALIZACION")}


def clean_consumption(df: DataFrame) -> DataFrame:
    """Typed consumption readings.

    CONTADOR lower-cased text; LOCALIZACION -> NISE (bigint, NULL if not an
    integer); VALOR_LECTURA -> double; MEDIDOR and LOCALIZACION_REAL ->
    bigint; FECHA_LECTURA copies the raw timestamp; Hour is the decimal hour.
    """
    require_columns(df, ["CONTADOR", "LOCALIZACION", "VALOR_LECTURA", "MEDIDOR",
                         "LOCALIZACION_REAL", "FECHA_LECTURA_REAL"], "consumption")
    return (
        df.withColumns({
            "CONTADOR": F.lower(F.col("CONTADOR").cast("string")),
            **_nise(df),
            "VALOR_LECTURA": try_double("VALOR_LECTURA"),
            "MEDIDOR": try_bigint("MEDIDOR"),
            "LOCALIZACION_REAL": try_bigint("LOCALIZACION_REAL"),
            "FECHA_LECTURA": F.col("FECHA_LECTURA_REAL"),
            "Hour": decimal_hour("FECHA_LECTURA_REAL"),
        })
        .drop("LOCALIZACION")
    )


def clean_voltage(
    df: DataFrame, phase_vals: Sequence[str] = DEFAULT_VOLTAGE_PHASES
) -> DataFrame:
    """Typed voltage readings restricted to the chosen phase labels.

    LOCALIZACION_REAL is left as raw text (voltages only audit it).
    """
    require_columns(df, ["LOCALIZACION", "VALOR_LECTURA", "MEDIDOR",
                         "FECHA_LECTURA_REAL", "UNIDAD"], "voltages")
    return (
        df.withColumns({
            **_nise(df),
            "VALOR_LECTURA": try_double("VALOR_LECTURA"),
            "MEDIDOR": try_bigint("MEDIDOR"),
            "FECHA_LECTURA": F.col("FECHA_LECTURA_REAL"),
            "UNIDAD": F.col("UNIDAD").cast("string"),
        })
        .drop("LOCALIZACION")
        .filter(F.col("UNIDAD").isin(list(phase_vals)))
    )


def clean_power(df: DataFrame) -> DataFrame:
    """Typed interval power readings (no sort: ordering is presentation)."""
    require_columns(df, ["LOCALIZACION", "VALOR_LECTURA", "MEDIDOR",
                         "LOCALIZACION_REAL", "FECHA_LECTURA_REAL"], "power")
    return (
        df.withColumns({
            **_nise(df),
            "VALOR_LECTURA": try_double("VALOR_LECTURA"),
            "MEDIDOR": try_bigint("MEDIDOR"),
            "LOCALIZACION_REAL": try_bigint("LOCALIZACION_REAL"),
            "FECHA_LECTURA": F.col("FECHA_LECTURA_REAL"),
        })
        .drop("LOCALIZACION")
    )


def clean_customers(
    df: DataFrame, date_cols: Sequence[str] = CUSTOMER_DATE_COLUMNS
) -> DataFrame:
    """Customer master: compact yyyyMMdd dates -> DATE (bad -> NULL), NISE -> bigint."""
    require_columns(df, ["NISE", *date_cols], "customers")
    return df.withColumns({
        **{c: compact_date(c) for c in date_cols},
        "NISE": nise_from_text("NISE"),
    })
