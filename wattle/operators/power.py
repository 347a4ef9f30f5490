"""Interval power profiles: Delivered/Received pivots into P/Q and E pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattle.operators.energy import flow_pivot

PROFILE_KEYS = ["MEDIDOR", "FECHA_LECTURA"]


def _profile(df: DataFrame, p: str, tie: str | None, nested: bool,
             keep_null_keys: bool) -> DataFrame:
    if tie is not None and tie not in df.columns:
        raise ValueError(f"no tie column {tie!r} in the interval rows")
    dem, gen = f"{p}dem", f"{p}gen"
    out = flow_pivot(df, PROFILE_KEYS, {
        f"{p}_{dem}": ("Delivered", "DEMANDA"),
        f"{p}_{gen}": ("Received", "DEMANDA"),
        "E_Edem": ("Delivered", "ENERGIA"),
        "E_Egen": ("Received", "ENERGIA"),
    }, tie, keep_null_keys).withColumnsRenamed({"MEDIDOR": "node", "FECHA_LECTURA": "ts"})
    if not nested:
        return out.select("node", "ts", f"{p}_{dem}", f"{p}_{gen}", "E_Edem", "E_Egen")
    return out.select(
        "node", "ts",
        F.struct(F.col(f"{p}_{dem}").alias(dem), F.col(f"{p}_{gen}").alias(gen)).alias(p),
        F.struct(F.col("E_Edem").alias("Edem"), F.col("E_Egen").alias("Egen")).alias("E"),
    )


def active_profile(kwh: DataFrame, tie: str | None = None, nested: bool = False,
                   keep_null_keys: bool = False) -> DataFrame:
    """Per (node, ts): demand P_Pdem / P_Pgen from DEMANDA and energy
    E_Edem / E_Egen from ENERGIA (Delivered / Received). Of repeated
    readings the first by ``tie`` counts, without one the smallest values;
    a ``tie`` that the rows don't hold is an error. ``nested`` returns struct
    columns P<Pdem,Pgen> and E<Edem,Egen> instead."""
    return _profile(kwh, "P", tie, nested, keep_null_keys)


def reactive_profile(kvarh: DataFrame, tie: str | None = None, nested: bool = False,
                     keep_null_keys: bool = False) -> DataFrame:
    """Per (node, ts): Q_Qdem / Q_Qgen and E_Edem / E_Egen."""
    return _profile(kvarh, "Q", tie, nested, keep_null_keys)


def flatten(df: DataFrame, sep: str = "_") -> DataFrame:
    """Replace struct columns by their fields named ``parent_child``
    (recursively); empty name parts are skipped. Other columns unchanged."""

    def expand(prefix: list[str], dtype: T.DataType, path: str):
        if isinstance(dtype, T.StructType):
            for f in dtype.fields:
                yield from expand([*prefix, f.name], f.dataType, f"{path}.`{f.name}`")
        else:
            yield F.col(path).alias(sep.join(p for p in prefix if p))

    cols = []
    for f in df.schema.fields:
        cols.extend(expand([f.name], f.dataType, f"`{f.name}`"))
    return df.select(*cols)
