"""Joins that several operators share."""

from __future__ import annotations

import operator
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OTHER = "__other_"


def dealt_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner",
               null_safe: bool = False) -> DataFrame:
    """Join with a right side of few rows for each key: both sides are dealt
    out by the keys, and neither passes through the driver.

    Spark takes rows that are expanded or come from a checkpoint for far fewer
    than they are, and a broadcast that it plans by such an estimate stays in
    the plan when the true size is known. The left side isn't sorted, and its
    partitions can be cut where a key is hot.
    """
    right = right.hint("shuffle_hash")
    return null_safe_join(left, right, keys, how) if null_safe else left.join(right, list(keys), how)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner",
                   small: bool = False) -> DataFrame:
    """Join by keys of which a NULL equals a NULL; the left's keys stay.

    ``small``: the right side has a proven size bound and is broadcast.
    """
    right = right.withColumnsRenamed({k: _OTHER + k for k in keys})
    on = reduce(operator.and_, [F.col(k).eqNullSafe(F.col(_OTHER + k)) for k in keys])
    out = left.join(F.broadcast(right) if small else right, on, how)
    return out.drop(*[_OTHER + k for k in keys])
