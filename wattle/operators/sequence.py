"""Order-based operators that stay parallel when one key is huge.

``lag(x) over (partition by meter order by ts)`` sends every row of a meter to
one task. If one meter holds a large share of all rows that task becomes the
whole job. :func:`with_previous` gives the same values while partitioning by
(key, time bucket): rows are ordered inside their bucket, and the last row of
each bucket is carried into the next non-empty bucket of the same key as an
extra leading row. Only one row per (key, bucket) travels through the carry
step, so the window over buckets stays small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattle.functions.joins import null_safe_join

_BUCKET, _CARRY, _LAST, _NEXT = "__wb", "__carry", "__last", "__next"
_LONG_MIN = -(2 ** 63)


def with_previous(
    df: DataFrame,
    partition_by: Sequence[str],
    order_by: Sequence[str],
    columns: Sequence[str],
    bucket: Column,
    prefix: str = "prev_",
    order_is_unique: bool = False,
    target_rows_per_bucket: int | None = None,
    bucket_as: str | None = None,
) -> DataFrame:
    """Add ``prefix + c`` = value of ``c`` on the previous row of the same
    partition in ``order_by`` order, for every order column and each of
    ``columns``. Identical to ``lag(c)`` over that window.

    ``bucket`` must be non-decreasing along the order (for example a time
    bucket of the first order column). A NULL bucket sorts first, matching
    the NULLS FIRST ascending order of NULL timestamps. ``order_is_unique``
    (no two rows of a partition share the order values) allows a cheaper
    hash aggregate for the carried rows. As with ``lag``, rows tied on the
    order have no defined sequence.

    ``target_rows_per_bucket``: a key's bucket of more rows than this is cut
    into finer ones of about so many rows (by the first order column, if it is
    integral or a time), so even a key whose rows all fall in one ``bucket`` is
    split over many tasks. ``bucket_as`` keeps the bucket under that name, for
    windows inside (key, bucket) that need no further exchange.
    """
    keys = list(partition_by)
    lagged = list(dict.fromkeys([*order_by, *columns]))
    if target_rows_per_bucket:
        df, bucket = _split_hot_keys(df, keys, order_by[0], bucket, target_rows_per_bucket)
    base = df.withColumns({
        _BUCKET: F.coalesce(bucket.cast("long"), F.lit(_LONG_MIN)),
        _CARRY: F.lit(0),
    })
    base = base.drop(*[c for c in base.columns if c.startswith(_HOT)])

    # Last row of each (key, bucket): the largest order tuple. Partial
    # aggregation keeps this cheap even for a key with many rows.
    last = base.groupBy(*keys, _BUCKET).agg(
        *_last_row(base, list(order_by), lagged, order_is_unique))
    # ...which becomes the leading row of the key's next non-empty bucket.
    carry = (
        last.withColumn(_NEXT, F.lead(_BUCKET).over(Window.partitionBy(*keys).orderBy(_BUCKET)))
        .filter(F.col(_NEXT).isNotNull())
        .select(
            *keys,
            F.col(_NEXT).alias(_BUCKET),
            *[F.col(f"{_LAST}{c}").alias(c) for c in lagged],
            F.lit(1).alias(_CARRY),
        )
    )
    rows = base.unionByName(carry, allowMissingColumns=True)
    w = Window.partitionBy(*keys, _BUCKET).orderBy(F.col(_CARRY).desc(), *order_by)
    return (
        rows.select("*", *[F.lag(c).over(w).alias(prefix + c) for c in lagged])
        .filter(F.col(_CARRY) == 0)
        .withColumnsRenamed({_BUCKET: bucket_as} if bucket_as else {})
        .drop(_BUCKET, _CARRY)
    )


_FIXED = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
          T.DoubleType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _order_as_long(df: DataFrame, c: str, nulls_smallest: bool = True) -> Column | None:
    """A long that sorts like column ``c`` (NULL smallest unless asked to
    stay NULL), if one exists."""
    t = df.schema[c].dataType
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        v = F.unix_micros(F.col(c).cast("timestamp"))
    elif isinstance(t, T.DateType):
        v = F.unix_date(F.col(c)).cast("long")
    elif isinstance(t, (T.ByteType, T.ShortType, T.IntegerType)):
        v = F.col(c).cast("long")
    elif isinstance(t, T.LongType):
        v = F.col(c)
    else:
        return None
    return F.coalesce(v, F.lit(_LONG_MIN)) if nulls_smallest else v


def _last_row(df: DataFrame, order_by: list[str], lagged: list[str], unique: bool
              ) -> list[Column]:
    """Aggregates giving ``__last<c>`` = column c on the row with the largest
    order tuple. With a unique, single integral/time order column and
    fixed-width values this is a set of ``max_by`` over a long ordering (a
    hash aggregate); otherwise one ``max`` over a struct of the order
    columns and values, which keeps every value from one row."""
    key = _order_as_long(df, order_by[0]) if unique and len(order_by) == 1 else None
    if key is not None and all(isinstance(df.schema[c].dataType, _FIXED) for c in lagged):
        return [F.max_by(F.col(c), key).alias(f"{_LAST}{c}") for c in lagged]
    last = F.max(F.struct(*[F.col(c) for c in lagged]))
    return [last.getField(c).alias(f"{_LAST}{c}") for c in lagged]


_HOT = "__hot_"
# Largest (key, bucket) groups that are cut, and the parts a cut can make. Both
# bound what is broadcast: MOST_HOT rows of PARTS longs. A group beyond the
# MOST_HOT largest holds less than one part in MOST_HOT of all rows.
MOST_HOT, PARTS, _STEP = 2000, 256, 16


def _split_hot_keys(df: DataFrame, keys: list[str], order_col: str, bucket: Column,
                    target: int) -> tuple[DataFrame, Column]:
    """Bucket column in which a (key, bucket) of more than ``target`` rows is
    cut at its own quantiles, into parts of about ``target`` rows.

    The cuts are of equal depth, so a burst inside the bucket is cut as finely
    as it is dense, and nested in the bucket, so they are never coarser than
    that. Counting is a partial aggregate over the same input (its exchange is
    reused); only rows of hot groups take part in the quantiles.
    """
    o = _order_as_long(df, order_col, nulls_smallest=False)
    if o is None:
        return df, bucket
    names = [*keys, f"{_HOT}b"]
    df = df.withColumn(f"{_HOT}b", F.coalesce(bucket.cast("long"), F.lit(-1)))
    hot = (
        df.groupBy(*names).agg(F.count(F.lit(1)).alias(f"{_HOT}n"))
        .filter(F.col(f"{_HOT}n") > target)
        .orderBy(F.col(f"{_HOT}n").desc()).limit(MOST_HOT)
    )
    shares = [i / PARTS for i in range(1, PARTS)]
    cuts = null_safe_join(df.select(*names, o.alias(f"{_HOT}o")), hot, names, small=True).groupBy(*names).agg(
        F.max(f"{_HOT}n").alias(f"{_HOT}n"),
        F.percentile_approx(f"{_HOT}o", shares, 4 * PARTS).alias(f"{_HOT}cuts"))
    every = F.sequence(F.lit(_STEP), F.lit(PARTS - 1), F.lit(_STEP))
    cuts = cuts.withColumn(f"{_HOT}steps", F.transform(every, lambda i: F.element_at(f"{_HOT}cuts", i)))
    joined = null_safe_join(df, cuts, names, "left", small=True)
    # How many cuts are not above the row: first among every _STEP-th, then between two of those.
    step = F.size(F.filter(f"{_HOT}steps", lambda c: c <= o))
    near = F.slice(f"{_HOT}cuts", step * _STEP + 1, _STEP - 1)
    part = step * _STEP + F.size(F.filter(near, lambda c: c <= o))
    parts = F.least(F.lit(PARTS), F.ceil(F.col(f"{_HOT}n") / target))
    cut = F.col(f"{_HOT}n").isNotNull() & o.isNotNull()
    fine = F.when(cut, F.floor(part * parts / PARTS)).otherwise(0)
    return joined, F.when(bucket.isNotNull(), bucket.cast("long") * PARTS + fine)


def time_bucket(ts: str | Column, width_seconds: int) -> Column:
    """Bucket number of a timestamp: floor(epoch seconds / width)."""
    t = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(t.cast("timestamp").cast("long") / F.lit(int(width_seconds)))


# Share of a group that the cut's quantiles may be off by, each way.
_ERROR = 1e-4


def _order_as_number(df: DataFrame, c: str) -> Column | None:
    """A number that never falls along the order of column ``c`` (nulls
    first), if there is one."""
    t = df.schema[c].dataType
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        v = F.col(c).cast("double")
        return F.coalesce(F.nanvl(v, F.lit(float("inf"))), F.lit(float("-inf")))
    return _order_as_long(df, c)


def head_per_group(df: DataFrame, group: str, order_by: Sequence[str], pct: int) -> DataFrame:
    """Keep, in each ``group``, the first ``count * pct // 100`` rows by
    ``order_by`` (an explicit order: a file's row order is not a Spark
    notion); of rows that tie on it any may be the last ones kept.

    A quantile cut: approximate quantiles on both sides of the cut bracket it,
    and counts of the rows below prove the bracket. Rows below it are kept as
    they are, and only those inside (a few of ten thousand) are shuffled and
    ranked. A group whose bracket the counts don't prove is ranked as a whole,
    so the result is exact in any case. Nothing runs while the plan is built.
    An order without a number that follows it (text) is ranked as a whole too.
    """
    n, lo, hi, o = "__hn", "__hlo", "__hhi", "__ho"
    keep, below, rank = "__hkeep", "__hbelow", "__hrank"
    w = Window.partitionBy(group).orderBy(*order_by)
    number = _order_as_number(df, order_by[0])
    if number is None:
        total = F.count(F.lit(1)).over(Window.partitionBy(group))
        ranked = df.withColumns({n: total, rank: F.row_number().over(w)})
        return ranked.filter(F.col(rank) <= F.expr(f"{n} * {int(pct)} div 100")).drop(n, rank)
    at = pct / 100
    bracket = [max(0.0, at - 2 * _ERROR), min(1.0, at + 2 * _ERROR)]
    df = df.withColumn(o, number)
    bounds = df.groupBy(group).agg(
        F.count(F.lit(1)).alias(n), F.percentile_approx(o, bracket, int(1 / _ERROR)).alias("__hq"))
    bounds = bounds.select(group, F.expr(f"{n} * {int(pct)} div 100").alias(keep), F.col("__hq")[0].alias(lo),
                           F.col("__hq")[1].alias(hi))
    counts = null_safe_join(df.select(group, o), bounds, [group]).groupBy(group, keep, lo, hi).agg(
        F.count_if(F.col(o) < F.col(lo)).alias(below), F.count_if(F.col(o) <= F.col(hi)).alias("__hupto"))
    proven = (F.col(below) <= F.col(keep)) & (F.col("__hupto") >= F.col(keep))
    cut = counts.select(
        group, keep, F.when(proven, F.col(lo)).alias(lo), F.when(proven, F.col(hi)).alias(hi),
        F.when(proven, F.col(below)).otherwise(0).alias(below))
    marked = null_safe_join(df, cut, [group])
    helpers = [o, keep, lo, hi, below]
    whole = marked.filter(F.col(o) < F.col(lo)).drop(*helpers)
    inside = F.col(lo).isNull() | ((F.col(o) >= F.col(lo)) & (F.col(o) <= F.col(hi)))
    ranked = marked.filter(inside).withColumn(rank, F.row_number().over(w))
    return whole.unionByName(ranked.filter(F.col(rank) <= F.col(keep) - F.col(below)).drop(*helpers, rank))
