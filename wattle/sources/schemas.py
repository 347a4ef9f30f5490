"""Declared raw schemas and column checks.

Raw text columns stay text on read; the cleaning operators cast them, so a
malformed value becomes NULL instead of failing the scan.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_S, _TS, _D, _L = T.StringType(), T.TimestampNTZType(), T.DoubleType(), T.LongType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


CONSUMPTION_SCHEMA = _struct(
    ("MEDIDOR", _S), ("LOCALIZACION", _S), ("LOCALIZACION_REAL", _S),
    ("VALOR_LECTURA", _S), ("FECHA_LECTURA_REAL", _TS), ("SGDA", _S),
    ("CONTADOR", _S), ("OPERACION", _S), ("TIPO_CONSUMO", _S), ("UNIDAD", _S),
    ("TIPO_SECTOR", _S), ("MULTIPLICADOR", _S),
)

VOLTAGE_SCHEMA = _struct(
    ("MEDIDOR", _S), ("LOCALIZACION", _S), ("LOCALIZACION_REAL", _S),
    ("VALOR_LECTURA", _S), ("FECHA_LECTURA_REAL", _TS), ("UNIDAD", _S),
)

POWER_SCHEMA = _struct(
    ("MEDIDOR", _S), ("LOCALIZACION", _S), ("LOCALIZACION_REAL", _S),
    ("VALOR_LECTURA", _S), ("FECHA_LECTURA_REAL", _TS), ("SGDA", _S),
    ("OPERACION", _S), ("UNIDAD", _S), ("INTERVALO", T.IntegerType()),
    ("CONSTANTE", _S), ("ENERGIA", _D), ("DEMANDA", _D),
)

# The six compact yyyyMMdd date columns of the customer master.
CUSTOMER_DATE_COLUMNS = (
    "FEC_INST_NISE", "FECHA_LECTURA", "FECHA_HASTA",
    "FECHA_CONEXION_RED", "FEC_INST_MED", "FECHA_INTER",
)

CUSTOMER_SCHEMA = _struct(
    ("NISE", _S), ("FEC_INST_NISE", _S), ("FECHA_LECTURA", _S), ("FECHA_HASTA", _S),
    ("FECHA_CONEXION_RED", _S), ("FEC_INST_MED", _S), ("FECHA_INTER", _S),
    ("DESCSECTOR", _S),
)

SCENARIO_SCHEMA = _struct(("node", _L), ("ts", _TS), ("P", _D))

# Text dtype names accepted in an external column -> dtype map (pandas-style
# names map to the nearest Spark type; anything else is read as text).
_DTYPE_NAMES: dict[str, T.DataType] = {
    "str": _S, "string": _S, "object": _S, "category": _S,
    "int": _L, "int64": _L, "Int64": _L, "int32": T.IntegerType(), "Int32": T.IntegerType(),
    "float": _D, "float64": _D, "Float64": _D, "float32": T.FloatType(),
    "bool": T.BooleanType(), "boolean": T.BooleanType(),
    "datetime64[ns]": T.TimestampNTZType(), "date": T.DateType(),
}


def require_columns(df: DataFrame, columns: Iterable[str], what: str = "input") -> None:
    """Raise ``ValueError`` naming every missing column, before planning."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} is missing column(s): {', '.join(missing)}")


def schema_from_dtype_map(dtype_map: dict[str, str] | str, order: Iterable[str] | None = None
                          ) -> T.StructType:
    """Build a StructType from a column -> dtype map (a dict or a JSON file).

    A missing or corrupt file raises; a column order may be imposed (CSV
    columns are positional).
    """
    if isinstance(dtype_map, str):
        with open(dtype_map, encoding="utf-8") as fh:
            dtype_map = json.load(fh)
    if not isinstance(dtype_map, dict):
        raise ValueError("dtype map must be a JSON object of column -> dtype")
    names = list(order) if order is not None else list(dtype_map)
    return T.StructType([
        T.StructField(n, _DTYPE_NAMES.get(str(dtype_map.get(n, "string")), _S), True)
        for n in names
    ])
