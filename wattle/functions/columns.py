"""Column expressions for cleaning and labelling readings.

Everything here returns a ``Column`` made of built-in functions, so it stays
inside whole-stage code generation; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# The default month -> season labels of the load-shape model
# (months 1-2 "III", 3-6 "I", 7 "V", 8-11 "II", 12 "V").
DEFAULT_SEASONS: dict[int, str] = {
    1: "III", 2: "III", 3: "I", 4: "I", 5: "I", 6: "I",
    7: "V", 8: "II", 9: "II", 10: "II", 11: "II", 12: "V",
}

# Fixed value: raw service ids may carry a ",000" suffix that is dropped.
NISE_SUFFIX_PATTERN = r"^(\d+),0+$"


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_text(c: ColumnOrName) -> Column:
    return _col(c).cast("string")


def try_bigint(c: ColumnOrName) -> Column:
    """Integer id or NULL, whatever the column's type.

    Floating and decimal ids (the usual export of an integer column with
    gaps) keep whole values in range and lose the others: 12.0 is 12, 12.7 is
    NULL. Text is cast as it stands, so '12.7' is NULL as well. The type is
    known at planning time, so one branch is left in the plan.
    """
    col = _col(c)
    kind, real, exact = F.typeof(col), col.try_cast("double"), col.try_cast("decimal(38,9)")
    return (
        F.when(kind.isin("double", "float"),
               F.when((real == F.floor(real)) & (F.abs(real) < F.lit(2.0**63)), real.try_cast("bigint")))
        .when(kind.startswith("decimal"), F.when(exact == F.floor(exact), exact.try_cast("bigint")))
        .otherwise(col.cast("string").try_cast("bigint"))
    )


def try_double(c: ColumnOrName) -> Column:
    """Reading value or NULL for malformed text."""
    return _col(c).try_cast("double")


def nise_from_text(c: ColumnOrName) -> Column:
    """Service id from raw location text: trim, drop ',00' suffix, to bigint."""
    cleaned = F.regexp_replace(F.trim(as_text(c)), NISE_SUFFIX_PATTERN, "$1")
    return cleaned.try_cast("bigint")


def decimal_hour(ts: ColumnOrName) -> Column:
    """Hour of day as a decimal, NULL when the timestamp is NULL."""
    t = _col(ts)
    seconds = F.hour(t) * F.lit(3600.0) + F.minute(t) * F.lit(60.0) + F.second(t)
    return seconds / F.lit(3600.0)


def epoch_seconds(ts: ColumnOrName) -> Column:
    """Whole epoch seconds (floored). Wall-clock NTZ values go through the
    session time zone, which wattle pins to UTC."""
    return _col(ts).cast("timestamp").cast("long")


def compact_date(c: ColumnOrName, fmt: str = "yyyyMMdd") -> Column:
    """Parse compact date text; impossible dates and blanks become NULL."""
    return F.to_date(F.try_to_timestamp(as_text(c), F.lit(fmt)))


def season_of(ts: ColumnOrName, seasons: dict[int, str] | None = None) -> Column:
    """Season label of the month of ``ts`` from a literal map; unmapped -> NULL."""
    mapping = seasons or DEFAULT_SEASONS
    pairs = [x for k, v in mapping.items() for x in (F.lit(int(k)), F.lit(v))]
    return F.create_map(*pairs)[F.month(_col(ts))]


def day_kind(ts: ColumnOrName) -> Column:
    """'weekend' for Saturday and Sunday, else 'weekday'."""
    return F.when(F.weekday(_col(ts)) >= 5, "weekend").otherwise("weekday")


def text_agree(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Text equality of two attributes; NULL when either side is NULL."""
    return as_text(a) == as_text(b)
