"""Scalar column builders shared by the operators (all native Spark)."""

from wattle.functions.columns import (  # noqa: F401
    DEFAULT_SEASONS,
    as_text,
    compact_date,
    day_kind,
    decimal_hour,
    epoch_seconds,
    nise_from_text,
    season_of,
    text_agree,
    try_bigint,
    try_double,
)
