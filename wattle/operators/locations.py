"""Network layers and meter locations.

Layers are point tables (x, y columns plus an ``epsg`` code) instead of
geometry objects; every layer sits in one DataFrame with a ``layer`` column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattle.functions.columns import try_bigint
from wattle.functions.joins import dealt_join
from wattle.operators.sequence import head_per_group
from wattle.sources.schemas import require_columns

# Default layer column renames and the customers layer name.
DEFAULT_RENAMES = {"IDLOCALIZA": "LOCALIZACION_REAL", "NUMEROMEDI": "MEDIDOR"}
LOADS_LAYER = "Loads"
GEOMETRY = ("x", "y")


def prepare_layer(df: DataFrame, rename_cols: dict[str, str] | None = None,
                  epsg: int | None = None) -> DataFrame:
    """Location ids to bigint (malformed -> NULL), then column renames.

    ``epsg`` (when known) is recorded in an ``epsg`` column.
    """
    renames = DEFAULT_RENAMES if rename_cols is None else rename_cols
    for source, name in renames.items():
        if source in df.columns:
            value = try_bigint(source) if source == "IDLOCALIZA" else F.col(source)
            if name in df.columns and name != source:  # the layer's own column fills the gaps
                value = F.coalesce(value, F.col(name).try_cast(value_type(df, source)))
                df = df.withColumn(name, value).drop(source)
            else:
                df = df.withColumn(source, value).withColumnRenamed(source, name)
    if epsg is not None and "epsg" not in df.columns:
        df = df.withColumn("epsg", F.lit(int(epsg)))
    return df


def value_type(df: DataFrame, column: str) -> str:
    """Type of a layer column after ``prepare_layer``."""
    return "bigint" if column == "IDLOCALIZA" else df.schema[column].dataType.simpleString()


def loads_view(layers: DataFrame, layer_name: str = LOADS_LAYER,
               attributes_only: bool = False, own_service_ids: bool | None = None) -> DataFrame:
    """The customers layer, with the service id as NISE.

    A layer that has a NISE column keeps it as it is, its gaps too; one that
    has none takes its OBJECTID. That is decided for the layer, not for each
    row. In a union a NISE column may be another layer's: the caller who built
    it can say with ``own_service_ids`` whether this layer brought one; else
    it did if any of its rows has a value. ``attributes_only`` drops the point
    columns."""
    loads = layers.filter(F.col("layer") == layer_name) if "layer" in layers.columns else layers
    if "NISE" in loads.columns and "OBJECTID" in loads.columns and own_service_ids is None:
        own = loads.agg(F.coalesce(F.bool_or(F.col("NISE").isNotNull()), F.lit(False))).scalar()
        kind = loads.schema["NISE"].dataType
        loads = loads.withColumn("NISE", F.when(own, F.col("NISE")).otherwise(F.col("OBJECTID").cast(kind)))
    elif "OBJECTID" in loads.columns and not ("NISE" in loads.columns and own_service_ids):
        loads = loads.drop("NISE").withColumnRenamed("OBJECTID", "NISE")
    if attributes_only:
        loads = loads.drop(*GEOMETRY)
    return loads


def layer_slice(layers: DataFrame, pct: int | None, order_by: str = "seq") -> DataFrame:
    """First ``count * pct // 100`` rows of every layer by ``order_by``;
    ``pct`` None keeps whole layers."""
    if not pct:
        return layers
    return head_per_group(layers, "layer", [order_by], pct)


def meter_locations(
    readings: DataFrame,
    loads: DataFrame,
    node_col: str = "MEDIDOR",
    geo_of_col: str = "LOCALIZACION_REAL",
    order_by: str | None = "seq",
) -> DataFrame:
    """Point of every distinct (meter, location) pair of the readings.

    Pairs with a NULL location, a location absent from the layer or one whose
    point is NULL drop. When the layer repeats a location the last row
    (largest ``order_by``; ``None``: the largest point) wins. An ``epsg``
    column of the layer stays with the point. The layer side is first reduced to one row per location (a
    partial aggregate), so the join is many-to-one; both sides are dealt out by
    location.
    """
    require_columns(readings, [node_col, geo_of_col], "readings")
    require_columns(loads, [geo_of_col, *GEOMETRY, *([order_by] if order_by else [])], "loads layer")
    pairs = (
        readings.select(node_col, geo_of_col)
        .filter(F.col(geo_of_col).isNotNull())
        .distinct()
    )
    kept = [*GEOMETRY, *(["epsg"] if "epsg" in loads.columns else [])]
    point = F.struct(*[F.col(c) for c in kept])
    pick = F.max_by(point, F.col(order_by)) if order_by else F.max(point)
    spots = (
        loads.filter(F.col(geo_of_col).isNotNull())
        .groupBy(geo_of_col)
        .agg(pick.alias("__pt"))
        .select(geo_of_col, *[F.col(f"__pt.{c}").alias(c) for c in kept])
        .filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    )
    return dealt_join(pairs, spots, [geo_of_col])
