"""Analyses the toolkit describes on top of the cleaned measures.

Each is one aggregation or filter over an existing building block, with
partial aggregation before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattle.operators.energy import ENERGY_KEYS, flow_pivot


def daily_max_demand(mde: DataFrame, tie: str | None = "seq") -> DataFrame:
    """Maximum-demand register per (meter, timestamp, hour), Delivered and
    Received side by side (the energy pivot applied to MDE readings)."""
    return flow_pivot(mde, ENERGY_KEYS, {
        "Delivered": ("Delivered", "VALOR_LECTURA"),
        "Received": ("Received", "VALOR_LECTURA"),
    }, tie)


def reverse_flow(active: DataFrame) -> DataFrame:
    """Intervals in which a node injects power (P_Pgen > 0), with the net
    demand P_Pdem - P_Pgen (negative = net generation)."""
    return active.filter(F.col("P_Pgen") > 0).select(
        "node", "ts", "P_Pdem", "P_Pgen",
        (F.col("P_Pdem") - F.col("P_Pgen")).alias("P_net"),
    )


def voltage_compliance(profile: DataFrame, nominal: float, band: float) -> DataFrame:
    """Per node: samples, samples outside ``nominal * (1 +/- band)`` and
    their share."""
    lo, hi = nominal * (1 - band), nominal * (1 + band)
    v = F.col("V")
    out = (v < F.lit(lo)) | (v > F.lit(hi))
    return (
        profile.filter(v.isNotNull())
        .groupBy("node")
        .agg(F.count(F.lit(1)).alias("samples"),
             F.count(F.when(out, F.lit(1))).alias("out_of_band"))
        .withColumn("out_of_band_share", F.col("out_of_band") / F.col("samples"))
    )


def phase_balance(phase_rows: DataFrame) -> DataFrame:
    """Per (meter, timestamp, measure): mean reading of phases a, b, c and
    the unbalance (max - min) / mean over the phases present."""
    ph = F.lower(F.col("CONTADOR"))
    v = F.col("VALOR_LECTURA")
    per = (
        phase_rows.filter(v.isNotNull() & F.col("MEDIDOR").isNotNull()
                          & F.col("FECHA_LECTURA").isNotNull())
        .groupBy("MEDIDOR", "FECHA_LECTURA", "TIPO_CONSUMO")
        .agg(*[F.avg(F.when(ph == p, v)).alias(f"phase_{p}") for p in "abc"])
    )
    cols = [F.col(f"phase_{p}") for p in "abc"]
    present = sum(F.when(c.isNotNull(), 1).otherwise(0) for c in cols)
    total = sum(F.coalesce(c, F.lit(0.0)) for c in cols)
    mean = total / present
    return per.withColumn(
        "unbalance",
        F.when(mean != 0, (F.greatest(*cols) - F.least(*cols)) / mean),
    )
