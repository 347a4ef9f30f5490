"""Sources and sinks: reading raw readings, customer text, network layers,
and writing audit tables. Readers are lazy; filters applied afterwards are
pushed into the scan by Catalyst."""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattle.sources.schemas import CUSTOMER_SCHEMA, require_columns, schema_from_dtype_map


def load_readings(
    spark: SparkSession,
    table_name: str | None = None,
    data_path: str | None = None,
    fmt: str = "parquet",
    schema: T.StructType | None = None,
) -> DataFrame:
    """Raw readings from a catalog table (wins) or a path in ``fmt``."""
    if table_name:
        return spark.table(table_name)
    if data_path:
        reader = spark.read.format(fmt)
        if schema is not None:
            reader = reader.schema(schema)
        return reader.load(data_path)
    raise ValueError("name a catalog table or a path to read from")


def read_customers(
    spark: SparkSession,
    path: str,
    dtype_map: dict[str, str] | str | None = None,
    sep: str = ";",
    header: bool = True,
    required: tuple[str, ...] = tuple(CUSTOMER_SCHEMA.fieldNames()),
) -> DataFrame:
    """Customer master from separated text.

    With a header, columns are found by name, in any order, and every column
    of the file is kept; one of ``required`` that is missing raises. Values
    are read as text and those of ``dtype_map`` cast (malformed -> NULL).
    Without a header the columns are those of the customer schema in order.
    """
    reader = spark.read.option("sep", sep).option("mode", "PERMISSIVE")
    if header:
        df = reader.option("header", "true").option("inferSchema", "false").csv(path)
        require_columns(df, required, "customers")
    else:
        df = reader.option("header", "false").schema(CUSTOMER_SCHEMA).csv(path)
    if dtype_map is None:
        return df
    schema = schema_from_dtype_map(dtype_map)
    casts = {f.name: F.col(f.name).try_cast(f.dataType) for f in schema if f.name in df.columns}
    return df.withColumns(casts)


def layer_entries(spark: SparkSession, root: str) -> list[tuple[str, str]]:
    """(layer, path) of each file or folder under ``root``, or of each match
    where ``root`` is a glob; a layer is named up to its first dot."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(conf)
    found = fs.globStatus(path) if any(c in root for c in "*?[{") else fs.listStatus(path)
    entries = [(s.getPath().getName(), s.getPath().toString()) for s in found or []]
    return sorted((n.split(".")[0], p) for n, p in entries if not n.startswith(("_", ".")))


_WHOLE = ("tinyint", "smallint", "int", "bigint")


def _common_type(types: set[str]) -> str:
    """Type to which a column is widened when layers disagree."""
    if len(types) == 1:
        return next(iter(types))
    if types <= set(_WHOLE):
        return "bigint"
    return "double" if types <= {*_WHOLE, "float", "double"} else "string"


# A layer that may not be read, or not now, isn't a damaged one.
_REFUSED = re.compile(r"AccessControlException|AccessDenied|Permission denied|Forbidden|ConnectException|Timeout")


def read_layers(
    spark: SparkSession,
    root: str,
    fmt: str = "parquet",
    prepare: Callable[[str, DataFrame], DataFrame] | None = None,
    skipped: list[tuple[str, str]] | None = None,
) -> DataFrame:
    """All network layers under ``root`` (a folder or a glob), tagged with ``layer``.

    Each entry is one layer, read on its own; ``prepare(layer, df)`` renames
    and types it before the union by name. A layer lacking a column gets
    NULL; where types differ the wider one (else text) holds. A layer that
    can't be opened, any of its files, is left out whole, with a warning and
    an entry in ``skipped``; damage met later, in the data, raises, and so do
    refused permissions and failing connections.
    """
    layers: list[DataFrame] = []
    for name, path in layer_entries(spark, root):
        reader = spark.read.format(fmt).option("recursiveFileLookup", "true")
        if fmt in ("parquet", "orc"):
            reader = reader.option("mergeSchema", "true")  # opens every file's footer
        try:
            df = reader.load(path)
        except (PySparkException, Py4JError) as exc:
            if _REFUSED.search(str(exc)):
                raise
            warnings.warn(f"layer {name} skipped, {path} can't be read: {str(exc)[:200]}", stacklevel=2)
            if skipped is not None:
                skipped.append((name, str(exc)))
            continue
        df = prepare(name, df) if prepare else df
        layers.append(df.withColumn("layer", F.lit(name)))
    if not layers:
        raise ValueError(f"no readable layer under {root}")
    types: dict[str, set[str]] = {}
    for df in layers:
        for column, kind in df.dtypes:
            types.setdefault(column, set()).add(kind)
    wide = [df.withColumns({c: F.col(c).cast(_common_type(types[c])) for c, k in df.dtypes if len(types[c]) > 1})
            for df in layers]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), wide)


PARTITION_COLUMN = "reading_date"


def write_readings(
    df: DataFrame,
    path: str,
    ts_col: str = "FECHA_LECTURA_REAL",
    fmt: str = "parquet",
    mode: str = "overwrite",
) -> None:
    """Store raw readings partitioned by reading date (``reading_date``).

    A later time window then prunes whole date partitions at planning time
    (``PartitionFilters``) instead of opening every file. Rows with a NULL
    timestamp land in the default NULL partition.
    """
    (
        df.withColumn(PARTITION_COLUMN, F.to_date(F.col(ts_col)))
        .write.format(fmt)
        .mode(mode)
        .partitionBy(PARTITION_COLUMN)
        .save(path)
    )


def write_table(
    df: DataFrame,
    table_name: str,
    mode: str = "overwrite",
    fmt: str = "parquet",
    path: str | None = None,
    bucket_by: tuple[int, list[str]] | None = None,
    sort_by: list[str] | None = None,
) -> None:
    """Persist a result as a catalog table (optionally at an explicit path).

    ``bucket_by=(n, cols)`` stores the table in ``n`` hash buckets of
    ``cols``: two tables bucketed the same way join or aggregate on those
    columns without shuffling either side (e.g. readings and customers on
    NISE for repeated reconciliations).
    """
    writer = df.write.format(fmt).mode(mode)
    if path:
        writer = writer.option("path", path)
    if bucket_by:
        n, cols = bucket_by
        writer = writer.bucketBy(n, *cols)
        if sort_by:
            writer = writer.sortBy(*sort_by)
    writer.saveAsTable(table_name)
