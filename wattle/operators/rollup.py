"""Loads of groups of nodes: subtotals over a hierarchy of places, the load
that a group draws at one time, and the loading of transformers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattle.functions.joins import dealt_join, null_safe_join
from wattle.operators.reconcile import latest_attribute
from wattle.sources.schemas import require_columns

PERIODS = ("hour", "day", "week", "month", "quarter", "year")


def node_places(interval_rows: DataFrame, sectors: DataFrame | None = None, zone_width: int = 100,
                node: str = "MEDIDOR", service: str = "NISE", location: str = "LOCALIZACION_REAL",
                sector: str = "TIPO_SECTOR", ts: str = "FECHA_LECTURA") -> DataFrame:
    """node, sector and zone, one row for each node of the readings.

    The zone is a block of ``zone_width`` consecutive location codes, taken
    from the node's latest reading (of several at that time the smallest code);
    the sector is what ``sectors`` (service id, sector; one row each) says of
    the latest service id. Either is NULL where it isn't known.
    """
    latest = [latest_attribute(interval_rows, node, c, ts).withColumnRenamed(node, "node") for c in (location, service)]
    places = dealt_join(*latest, ["node"]).select(
        "node", service, F.floor(F.col(location) / zone_width).cast("long").alias("zone"))
    if sectors is None:
        return places.select("node", F.lit(None).cast("string").alias("sector"), "zone")
    named = sectors.select(service, F.col(sector).alias("sector"))
    return dealt_join(places, named, [service], "left").select("node", "sector", "zone")


def load_rollup(active: DataFrame, places: DataFrame, levels: Sequence[str] = ("sector", "zone", "node"),
                period: str = "day") -> DataFrame:
    """Subtotals of the active profile for every ``period`` and every beginning
    of ``levels``: level (how many of them are given), the levels, period, nodes,
    samples, energy_in, energy_out and peak (largest P_Pdem of one node).

    ``places``: the levels of each node, one row each; a node without any stays,
    under NULL levels (``level`` tells them from subtotals). Readings without
    a time are left out.

    Readings are first reduced to one row for each (node, period), before any
    of them is shuffled or joined; only those rows are multiplied for the
    grouping sets, and every set is pre-aggregated again.
    """
    if period not in PERIODS:
        raise ValueError(f"period {period!r} is none of {PERIODS}")
    require_columns(active, ["node", "ts", "P_Pdem", "E_Edem", "E_Egen"], "active profile")
    require_columns(places, ["node", *[c for c in levels if c != "node"]], "places")
    start = F.date_trunc(period, F.col("ts")).cast("timestamp_ntz")
    base = active.where(F.col("ts").isNotNull()).groupBy("node", start.alias("period")).agg(
        F.count(F.lit(1)).alias("samples"), F.sum("E_Edem").alias("energy_in"), F.sum("E_Egen").alias("energy_out"),
        F.max("P_Pdem").alias("peak"))
    joined = null_safe_join(base, places, ["node"], "left")
    sets = [[*levels[:n], "period"] for n in range(len(levels) + 1)]
    given = sum((1 - F.grouping(c)).cast("int") for c in levels)
    return joined.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in (*levels, "period")]).agg(
        given.alias("level"), F.count(F.lit(1)).alias("nodes"), F.sum("samples").alias("samples"),
        F.sum("energy_in").alias("energy_in"), F.sum("energy_out").alias("energy_out"), F.max("peak").alias("peak"))


def group_load(active: DataFrame, members: DataFrame, group: str) -> DataFrame:
    """What each group draws at each time: group, ts, nodes, demand, generation
    and net (sums of P_Pdem, P_Pgen and their difference, NULL as 0).

    ``members``: node and group, one row for each node; other nodes and
    readings without a time are left out.
    """
    require_columns(active, ["node", "ts", "P_Pdem", "P_Pgen"], "active profile")
    p = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("P_Pdem", "P_Pgen")}
    rows = dealt_join(active.where(F.col("ts").isNotNull()), members.select("node", group), ["node"])
    return rows.groupBy(group, "ts").agg(
        F.count(F.lit(1)).alias("nodes"), F.sum(p["P_Pdem"]).alias("demand"), F.sum(p["P_Pgen"]).alias("generation"),
        F.sum(p["P_Pdem"] - p["P_Pgen"]).alias("net"))


def coincident_peaks(active: DataFrame, members: DataFrame, group: str, period: str = "day") -> DataFrame:
    """The largest load that each group draws at one time of a ``period``:
    group, period, peak, peak_ts (the first such time), node_peaks (the sum of
    what its nodes draw at most) and diversity (node_peaks over peak; NULL
    where the peak is 0).
    """
    start = F.date_trunc(period, F.col("ts")).cast("timestamp_ntz").alias("period")
    load = group_load(active, members, group)
    when = F.struct(F.col("demand").alias("p"), (-F.unix_micros(F.col("ts").cast("timestamp"))).alias("t"))
    top = load.groupBy(group, start).agg(F.max("demand").alias("peak"), F.max_by("ts", when).alias("peak_ts"))
    own = active.where(F.col("ts").isNotNull()).groupBy("node", start).agg(
        F.max(F.coalesce(F.col("P_Pdem"), F.lit(0.0))).alias("p"))
    own = dealt_join(own, members.select("node", group), ["node"]).groupBy(group, "period").agg(
        F.sum("p").alias("node_peaks"))
    return dealt_join(top, own, [group, "period"], null_safe=True).withColumn(
        "diversity", F.when(F.col("peak") != 0, F.col("node_peaks") / F.col("peak")))


def transformer_loading(active: DataFrame, assigned: DataFrame, transformers: DataFrame,
                        transformer_id: str = "OBJECTID", rating: str = "KVA") -> DataFrame:
    """Estimated load of each transformer: transformer, ts, nodes, demand,
    generation, net, kva and loading (the size of net over kva; NULL without a
    rating).

    ``assigned``: node and transformer (the nearest one, as no key links them);
    nodes without one are left out. A transformer listed twice counts with its
    largest rating.
    """
    members = assigned.where(F.col("transformer").isNotNull()).select("node", "transformer")
    load = group_load(active, members, "transformer")
    rated = transformers.groupBy(F.col(transformer_id).alias("transformer")).agg(F.max(rating).alias("kva"))
    return dealt_join(load, rated, ["transformer"], "left").withColumn(
        "loading", F.when(F.col("kva") > 0, F.abs("net") / F.col("kva")))
