"""Helpers the text operators share: shipping the package to the workers,
row keys, slicing Arrow batches and hashing words with numpy."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattle.session import scratch_path

# ASCII white space of the word rules: \x20 and \x09-\x0D.
SPACES = bytes([0x20, *range(0x09, 0x0E)])
# Bytes of text that one numpy step works on (its arrays take about 80 times that).
SLICE_BYTES = 1 << 18
# One odd 64-bit constant for each use, so that hashes of different kinds differ.
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)
STEP = np.uint64(0x9E3779B97F4A7C15)


# Rows of an Arrow batch: texts are long, so Spark's 10,000 would hold much at once.
BATCH_ROWS = 1000
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_table(df: DataFrame, path: str) -> None:
    """Write Parquet and drop the shuffle files that led to it."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(_CLEANUP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder and read again, as a checkpoint
    that leaves no shuffle files behind."""
    path, schema = scratch_path(df.sparkSession, name), df.schema
    write_table(df, path)
    return df.sparkSession.read.schema(schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers that do not have it on
    their path (Spark's own file distribution carries it, once a context), and
    keep Arrow batches small, where the session leaves their size open."""
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if getattr(sc, "_wattle_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    handle, path = tempfile.mkstemp(prefix="wattle-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)
    sc._wattle_shipped = True


def give_back() -> None:
    """Return what a finished task has freed to the system: a Python worker
    waits for its next task beside others, with all that it still holds."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_carried(out: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """The carried columns as one struct, so their names can't clash."""
    if not carry:
        return out
    names = [f"carry_{c}" for c in carry]
    one = F.struct(*[F.col(f"`carry_{c}`").alias(c) for c in carry]).alias("carried")
    return out.select(*[c for c in out.columns if c not in names], one)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets (length + 1) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)
    offsets = offsets[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    raw = raw[offsets[0]:offsets[-1]]
    return raw, offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes; a longer text is a range alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX_A
    x = x ^ (x >> np.uint64(27))
    x = x * MIX_B
    return x ^ (x >> np.uint64(31))


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * STEP)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n, kept for the next call."""
    have = _POWERS.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, SLICE_BYTES + 4096)
        both = []
        for base in (_BASE, _INVERSE):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            both.append(np.cumprod(steps, dtype=np.uint64))
        have = (both[0], both[1])
        if size <= 1 << 22:
            _POWERS[0] = have
    return have


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Running polynomial hash, length + 1; ``span_hash`` takes ranges of it."""
    power, _ = _powers(len(values) + 1)
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * power[:len(values)], dtype=np.uint64, out=out[1:])
    return out


def byte_prefix_hash(raw: np.ndarray) -> np.ndarray:
    return prefix_hash(_TABLE[raw])


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each range [start, end), equal for equal contents."""
    _, inverse = _powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64) * STEP)


def word_spans(raw: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
    """Starts and ends of the words of joined texts, and for each text the
    index of its first word (length + 1). ``is_word``: 256 flags by byte."""
    flags = np.zeros(len(raw) + 1, dtype=bool)
    flags[:-1] = is_word[raw]
    before = np.zeros(len(raw) + 1, dtype=bool)
    before[1:] = flags[:-1]
    cut = offsets[:-1][offsets[:-1] < len(raw)]
    before[cut] = False  # a text's first byte starts a word whatever stands before it
    starts = np.flatnonzero(flags & ~before)
    after = np.zeros(len(raw) + 1, dtype=bool)
    after[:-1] = flags[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    ends = np.flatnonzero(flags & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def space_words() -> np.ndarray:
    """Flags of the bytes of words ``[^\\x20\\x09-\\x0D]+``."""
    flags = np.ones(256, dtype=bool)
    flags[list(SPACES)] = False
    return flags


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    upper = (raw >= 65) & (raw <= 90)
    return raw + (upper.astype(np.uint8) << 5)
