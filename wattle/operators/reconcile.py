"""Cross-source reconciliation of entity attributes (customer master vs
meter readings)."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattle.functions.columns import text_agree
from wattle.sources.schemas import require_columns


# A date's rank leaves room for any 64-bit tie below it.
_TIE_SPAN = Decimal(1 << 65)
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def latest_attribute(
    df: DataFrame,
    entity: str = "NISE",
    attr: str = "TIPO_SECTOR",
    date_col: str = "FECHA_LECTURA",
    tie: str | None = None,
    alias: str | None = None,
) -> DataFrame:
    """Per entity, ``attr`` on its latest dated row.

    Ties on the date go to the first row in the caller's ``tie`` order
    (smallest, NULL first), else to the smallest attribute value. Entities
    with no dated row are left out.

    Two steps: date and tie are one number, whose largest value for each
    (entity, attribute value) is a hash aggregate, combined before the shuffle;
    an entity's few values are then ranked. A tie that is no whole number can't
    be a part of that number and is ranked over all rows of the latest date.
    """
    require_columns(df, [entity, attr, date_col] + ([tie] if tie else []), "readings")
    rows = df.filter(F.col(entity).isNotNull() & F.col(date_col).isNotNull())
    micros = F.unix_micros(F.col(date_col).cast("timestamp"))
    name = alias or attr
    if tie is None or isinstance(df.schema[tie].dataType, _WHOLE):
        rank = micros
        if tie is not None:
            place = F.coalesce(F.col(tie).cast("decimal(20,0)"), F.lit(Decimal(-(1 << 63) - 1)).cast("decimal(20,0)"))
            rank = (micros.cast("decimal(18,0)") * F.lit(_TIE_SPAN).cast("decimal(20,0)") - place).cast("decimal(38,0)")
        values = rows.select(F.col(entity).alias("__entity"), F.col(attr).alias("__value"), rank.alias("__rank"))
        values = values.groupBy("__entity", "__value").agg(F.max("__rank").alias("__rank"))
        order = [F.col("__rank").desc(), F.col("__value")]
    else:
        values = rows.select(F.col(entity).alias("__entity"), F.col(attr).alias("__value"), micros.alias("__rank"),
                             F.col(tie).alias("__tie"))
        order = [F.col("__rank").desc(), F.col("__tie"), F.col("__value")]
    first = F.row_number().over(Window.partitionBy("__entity").orderBy(*order))
    best = values.withColumn("__place", first).filter(F.col("__place") == 1)
    return best.select(F.col("__entity").alias(entity), F.col("__value").alias(name))


def reconcile_entities(
    master: DataFrame,
    readings: DataFrame,
    entity_keys: DataFrame,
    entity_label: str = "NISE",
    self_attr: str = "DESCSECTOR",
    other_attr: str = "TIPO_SECTOR",
    date_col: str = "FECHA_LECTURA",
    tie: str | None = None,
) -> DataFrame:
    """Do the master and the readings report the same attribute per entity?

    Output: entity, self_source (master attribute), other_source (latest
    reading attribute), match (text equality, NULL if either is NULL). The
    master may repeat an entity; each of its rows is kept.
    """
    require_columns(master, [entity_label, self_attr], "master")
    keys = entity_keys.select(entity_label).distinct()
    # The readings are reduced to one row an entity before they meet anything,
    # and the keys restrict the master only: the last join restricts the rest.
    # A semi-join on the readings would be pushed below the aggregate and
    # shuffle every raw reading when the key set is too large to broadcast.
    latest = latest_attribute(readings, entity_label, other_attr, date_col, tie, alias="other_source")
    mine = master.join(keys, entity_label, "left_semi").select(
        entity_label, F.col(self_attr).alias("self_source")
    )
    return mine.join(latest, entity_label, "inner").withColumn(
        "match", text_agree("self_source", "other_source")
    )
