"""Benchmark decontamination: one Aho-Corasick automaton over the normalised
windows of all test items scans every text once."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattle.functions.joins import null_safe_join
from wattle.llm.textkit import ship_package, stored, with_carried
from wattle.session import scratch_path

# Bytes that words keep, after A-Z are lower-cased: digits, letters and all of
# UTF-8 beyond ASCII. Every other byte is a separator.
_KEPT = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
              for b in range(256))
# The same words in a text whose A-Z are not lower-cased yet.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
# Window text of one automaton, which takes some fifty times that, and rows of a batch of windows.
PART_BYTES, ROWS = 8 << 20, 10_000
_AUTOMATA: dict[str, ahocorasick.Automaton] = {}

SCHEMA = ("doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, "
          "contaminated boolean, spans array<struct<start:long,end:long>>")


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_KEPT).split()


def window_rows(benchmark: DataFrame, width: int) -> DataFrame:
    """window (its words, a space around each), size and the items that hold
    it, one row for each different window. An item of fewer words than
    ``width``, but not none, is one window; null has none."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = normal_words(text)
                size = min(width, len(words))
                starts = range(len(words) - size + 1 if words else 0)
                for at in range(0, len(starts), ROWS):  # a long item is many windows
                    found = [(b" " + b" ".join(words[i:i + size]) + b" ").decode() for i in starts[at:at + ROWS]]
                    yield pa.RecordBatch.from_pydict({
                        "window": pa.array(found, pa.string()), "size": pa.array([size] * len(found), pa.int32()),
                        "item_id": pa.array([item] * len(found), pa.string())})

    rows = items.mapInArrow(cut, "window string, size int, item_id string").distinct()
    return rows.groupBy("window").agg(F.max("size").alias("size"), F.collect_list("item_id").alias("items"))


def _automaton(token: str, windows: list[tuple]) -> ahocorasick.Automaton:
    """Built once a Python worker; only the latest is kept."""
    if token not in _AUTOMATA:
        _AUTOMATA.clear()
        a = ahocorasick.Automaton()
        for window, size, items in windows:
            key = window.encode().decode("latin-1")
            a.add_word(key, (items, size, len(key)))
        if len(a):
            a.make_automaton()
        _AUTOMATA[token] = a
    return _AUTOMATA[token]


def runs_of(text: str | None, hit: np.ndarray) -> list[dict]:
    """Runs of hit words in code points of the original text."""
    where = [m.span() for m in _WORD.finditer(text or "")]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [{"start": where[i][0], "end": where[j - 1][1]} for i, j in zip(edges[::2], edges[1::2], strict=True)]


def hit_words(words: list[bytes], automaton: ahocorasick.Automaton) -> tuple[np.ndarray, set[str]]:
    """Which words lie in a window, and the items that have such windows."""
    found: set[str] = set()
    marks: list[tuple[int, int]] = []
    if len(automaton) and words:
        for end, (items, size, length) in automaton.iter((b" " + b" ".join(words) + b" ").decode("latin-1")):
            found.update(items)
            marks.append((end - length + 1, size))
    if not marks:
        return np.zeros(len(words), dtype=bool), found
    begins = np.cumsum([0, *(len(w) + 1 for w in words)])  # where the space before each word is
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.searchsorted(begins, [m[0] for m in marks])
    np.add.at(edge, at, 1)
    np.add.at(edge, at + np.array([m[1] for m in marks]), -1)
    return np.cumsum(edge[:-1]) > 0, found


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
HIT_SCHEMA = "doc_id long, key long, items array<string>, places array<struct<start:long,end:long>>"


def _report(doc_ids: pa.Array, found: list[tuple[str | None, np.ndarray, set[str]]]) -> dict[str, pa.Array]:
    """The output columns; found: text, flags of its words, items."""
    ids = [",".join(sorted(items)) for _, _, items in found]
    hits = [int(hit.sum()) for _, hit, _ in found]
    return {
        "doc_id": doc_ids.cast(pa.int64()), "n_words": pa.array([len(hit) for _, hit, _ in found], pa.int64()),
        "n_hit": pa.array(hits, pa.int64()), "n_items": pa.array([len(items) for *_, items in found], pa.int64()),
        "items_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in ids], pa.string()),
        "contaminated": pa.array([n > 0 for n in hits], pa.bool_()),
        "spans": pa.array([runs_of(t, hit) if n else [] for (t, hit, _), n in zip(found, hits, strict=True)], _RUNS)}


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10,
                  part_bytes: int = PART_BYTES, carry: tuple[str, ...] = ()) -> DataFrame:
    """Words of each text that lie in a window of a benchmark item.

    Returns doc_id, n_words, n_hit, n_items, items_sha256, contaminated and
    ``spans`` (hit runs of words in code points of the original text), one row
    for each input row, and the struct ``carried`` of the columns named in
    ``carry``. Other columns are ignored, whatever their names.

    Spark makes the different windows and stores them in parts of about
    ``part_bytes`` of window text. A benchmark of one part is one automaton, and
    texts pass it once, without a shuffle. A larger one takes a pass over the
    texts for each part; the driver and a worker hold one part at a time, and
    the passes' hits are put together by document. Null or empty texts have no
    words and no hits; an empty benchmark hits nothing; items that repeat count
    once by item_id, null item ids as the string ``null``.
    """
    spark = docs.sparkSession
    ship_package(spark)
    windows = stored(window_rows(benchmark, width), "benchmark-windows")
    total = windows.agg(F.sum(F.octet_length("window"))).first()[0] or 0
    parts = max(1, -(-total // part_bytes))
    kept = [docs.schema[c] for c in carry]
    schema = SCHEMA + "".join(f", `carry_{f.name}` {f.dataType.simpleString()}" for f in kept)

    def part(k: int) -> tuple[str, Broadcast]:
        rows = windows.where(F.pmod(F.xxhash64("window"), F.lit(parts)) == k).collect()
        return uuid.uuid4().hex, spark.sparkContext.broadcast([tuple(r) for r in rows])

    def carried(batch: pa.RecordBatch, first: int) -> dict[str, pa.Array]:
        return {f"carry_{c}": batch.column(first + i) for i, c in enumerate(carry)}

    if parts == 1:
        token, given = part(0)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(token, given.value)
            for batch in batches:
                texts = batch.column(1).to_pylist()
                found = [(t, *hit_words(normal_words(t), automaton)) for t in texts]
                yield pa.RecordBatch.from_pydict(_report(batch.column(0), found) | carried(batch, 2))

        return with_carried(docs.select("doc_id", "text", *carry).mapInArrow(run, schema), carry)

    def pass_of(token: str, given: Broadcast) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(token, given.value)
            for batch in batches:
                ids, keys, items, places = [], [], [], []
                for doc, key, text in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                    hit, found = hit_words(normal_words(text), automaton)
                    if found:
                        edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))).tolist()
                        ids.append(doc)
                        keys.append(key)
                        items.append(sorted(found))
                        places.append([{"start": i, "end": j} for i, j in zip(edges[::2], edges[1::2], strict=True)])
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(ids, pa.int64()), "key": pa.array(keys, pa.int64()),
                    "items": pa.array(items, pa.list_(pa.string())), "places": pa.array(places, _RUNS)})

        return run

    doc_id, key = F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit("")))
    hits = scratch_path(spark, "benchmark-hits")
    for k in range(parts):
        token, given = part(k)
        known = docs.select(doc_id.alias("doc_id"), key.alias("key"), "text")
        known.mapInArrow(pass_of(token, given), HIT_SCHEMA).write.mode("append").parquet(hits)
        given.destroy()
    found = spark.read.schema(HIT_SCHEMA).parquet(hits).distinct().groupBy("doc_id", "key").agg(
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        F.flatten(F.collect_list("places")).alias("places"))
    rows = docs.select(doc_id.alias("doc_id"), key.alias("key"), "text", F.struct(
        F.lit(0), *[F.col(f"`{c}`").alias(f"carry_{c}") for c in carry]).alias("carry"))
    rows = null_safe_join(rows, found, ["doc_id", "key"], "left").select(
        "doc_id", "text", "items", "places", *[F.col(f"carry.`carry_{c}`") for c in carry])

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for text, items, places in zip(*[batch.column(i).to_pylist() for i in range(1, 4)], strict=True):
                hit = np.zeros(len(normal_words(text)), dtype=bool)
                for p in places or ():
                    hit[p["start"]:p["end"]] = True
                done.append((text, hit, set(items or ())))
            yield pa.RecordBatch.from_pydict(_report(batch.column(0), done) | carried(batch, 4))

    return with_carried(rows.mapInArrow(put_together, schema), carry)
