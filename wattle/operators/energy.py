"""Daily energy: Delivered/Received pivot and deltas between readings."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattle.functions.columns import epoch_seconds
from wattle.operators.sequence import time_bucket, with_previous

# The readings' own sequence; the energy pivots do without where there is none.
DEFAULT_TIE = "seq"
ENERGY_KEYS = ["MEDIDOR", "FECHA_LECTURA", "Hour"]
# Deltas are computed per meter inside weekly buckets (see with_previous); a
# meter's week of more rows than this is cut into parts of about so many rows.
DEFAULT_BUCKET_SECONDS = 7 * 86400
HOT_METER_ROWS = 1_000_000


def first_where(cond: Column, value: str, tie: str | None) -> Column:
    """First non-NULL ``value`` among rows meeting ``cond``.

    "First" is the smallest ``tie`` (the caller's row sequence) so the
    result does not depend on shuffle order; without a tie column the
    smallest value is taken.
    """
    keep = cond & F.col(value).isNotNull()
    if tie is None:
        return F.min(F.when(keep, F.col(value)))
    return F.min_by(F.when(keep, F.col(value)), F.when(keep, F.col(tie)))


def flow_pivot(
    df: DataFrame,
    keys: list[str],
    outputs: dict[str, tuple[str, str]],
    tie: str | None = DEFAULT_TIE,
    keep_null_keys: bool = False,
) -> DataFrame:
    """Pivot OPERACION values into fixed columns, one row per ``keys``.

    ``outputs`` maps output name -> (OPERACION value, source column). A
    conditional aggregate with fixed output columns: no value-discovery job,
    and partial aggregation before the shuffle. By default rows with a NULL
    key are dropped before the shuffle and rows whose outputs are all NULL
    after it (a keyed pivot has nothing to say about either). An absent
    ``tie`` is an error, save the default one.
    """
    if tie is not None and tie not in df.columns:
        if tie != DEFAULT_TIE:
            raise ValueError(f"no tie column {tie!r} in the readings")
        tie = None
    if not keep_null_keys:
        df = df.filter(reduce(operator.and_, [F.col(k).isNotNull() for k in keys]))
    op = F.col("OPERACION")
    out = df.groupBy(*keys).agg(*[
        first_where(op == flow, src, tie).alias(name) for name, (flow, src) in outputs.items()
    ])
    if not keep_null_keys:
        out = out.filter(reduce(operator.or_, [F.col(n).isNotNull() for n in outputs]))
    return out


def energy_pivot(ene: DataFrame, tie: str | None = DEFAULT_TIE, keep_null_keys: bool = False
                 ) -> DataFrame:
    """(meter, timestamp, hour) x OPERACION -> Delivered, Received readings."""
    return flow_pivot(ene, ENERGY_KEYS, {
        "Delivered": ("Delivered", "VALOR_LECTURA"),
        "Received": ("Received", "VALOR_LECTURA"),
    }, tie, keep_null_keys)


def energy_deltas(
    ene: DataFrame,
    tie: str | None = DEFAULT_TIE,
    bucket_seconds: int = DEFAULT_BUCKET_SECONDS,
    keep_null_keys: bool = False,
    hot_rows: int | None = HOT_METER_ROWS,
) -> DataFrame:
    """Per meter, consecutive-reading differences.

    Period: whole seconds since the meter's previous reading; Daily Sent /
    Daily Gotten: Delivered / Received minus the previous reading's value
    (NULL when either is NULL; register resets stay negative).
    """
    pivot = energy_pivot(ene, tie, keep_null_keys)
    prev = with_previous(
        pivot, ["MEDIDOR"], ["FECHA_LECTURA"], ["Delivered", "Received"],
        bucket=time_bucket("FECHA_LECTURA", bucket_seconds), prefix="__prev_",
        order_is_unique=True,  # the pivot has one row per (meter, timestamp)
        target_rows_per_bucket=hot_rows,
    )
    return prev.select(
        *ENERGY_KEYS,
        "Delivered",
        "Received",
        (epoch_seconds("FECHA_LECTURA") - epoch_seconds("__prev_FECHA_LECTURA")).alias("Period"),
        (F.col("Delivered") - F.col("__prev_Delivered")).alias("Daily Sent"),
        (F.col("Received") - F.col("__prev_Received")).alias("Daily Gotten"),
    )
