"""Windows that repeat across documents: what the two exact removers share.

A window is ``size`` consecutive elements (bytes or words) of one text. Its
anchor is the run of ``gram`` elements in it with the least hash, so equal
windows have equal anchors at the same place, and the windows of a text fall
into segments of neighbours with one anchor. Segments, about one for sixteen
windows, are what is shuffled:

1. Each task hashes its segments, resolves those that it holds several times
   itself (all but the least doc_id are covered) and sends the others, packed
   in arrays, to the bucket of their anchor.
2. A bucket resolves equal segments the same way. Where different segments of
   different documents share an anchor, the one with the least doc_id of each
   kind goes on: its windows have to be compared.
3. These segments fetch their contents from their document and meet again by
   anchor (windows of very common anchors one by one, each by its own
   elements, which decides nothing but the task that compares them); a solver
   finds the windows that a smaller doc_id holds too.
4. Each document takes its covered windows together.

Equal segments are told by 88 bits of hashes; windows of different segments
by their contents.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattle.llm import textkit
from wattle.session import scratch_path

# Bytes of text whose segments a task packs together, and bytes of text a bucket stands for.
UNIT_BYTES, BUCKET_BYTES = 4 << 20, 6 << 20
# Different segments of one anchor from which on its windows are dealt one by one.
COMMON = 2048
_TO_SPACE = bytes(32 if b in textkit.SPACES else b for b in range(256))
NO_ID = np.iinfo(np.int64).max  # a null doc_id is larger than any other

MAP_SCHEMA = "bucket long, kind int, n long, blob binary"
HOME_SCHEMA = "home long, kind int, n long, blob binary"
CONTENT_SCHEMA = "bucket long, n long, blob binary, lengths binary, contents binary"

SEGMENT = (("a", 5), ("s", 6), ("doc", 8), ("key", 4), ("home", 4), ("pos", 4), ("wins", 2))
HIT = (("doc", 8), ("key", 4), ("pos", 4), ("wins", 4))
NEED = (("a", 5), ("salt", 1), ("doc", 8), ("key", 4), ("home", 4), ("pos", 4), ("wins", 2))
PLACE = (("doc", 8), ("key", 4), ("home", 4), ("pos", 4), ("wins", 2))


def pack(fields, arrays: dict[str, np.ndarray]) -> bytes:
    """Arrays one after the other, each as the planes of its field's low
    bytes: planes of high bytes are nearly constant and compress away."""
    out = []
    for name, width in fields:
        x = np.ascontiguousarray(arrays[name]).astype(np.int64, copy=False)
        out.append(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())
    return b"".join(out)


def unpack(fields, blobs: list[bytes], counts: list[int]) -> dict[str, np.ndarray]:
    """The arrays of many blobs, as int64."""
    total, width_of = sum(counts), dict(fields)
    out = {name: np.zeros((total, 8), dtype=np.uint8) for name in width_of}
    done = 0
    for blob, n in zip(blobs, counts, strict=True):
        raw, at = np.frombuffer(blob, dtype=np.uint8), 0
        for name, width in fields:
            out[name][done:done + n, :width] = raw[at:at + n * width].reshape(width, n).T
            at += n * width
        done += n
    return {name: x.view(np.int64).ravel() for name, x in out.items()}


def take(arrays: dict[str, np.ndarray], which) -> dict[str, np.ndarray]:
    return {k: v[which] for k, v in arrays.items()}


def by_value(arrays: dict[str, np.ndarray], values: np.ndarray) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """The rows of each value, in their order."""
    order = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.diff(values[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(values[part[0]]), take(arrays, part)


@dataclass(frozen=True)
class Elements:
    """What a window consists of: ``words`` or bytes, and the window's measures."""

    words: bool
    size: int
    gram: int

    def read(self, raw: np.ndarray, offsets: np.ndarray):
        """Running hash of the elements, each text's first element, and the
        byte ranges of the elements (None for bytes)."""
        hashed = textkit.byte_prefix_hash(raw)
        if not self.words:
            return hashed, offsets, None
        starts, ends, first = textkit.word_spans(raw, offsets, textkit.space_words())
        return textkit.prefix_hash(textkit.span_hash(hashed, starts, ends)), first, (starts, ends)

    def segments(self, hashed: np.ndarray, first: np.ndarray):
        """Anchor, content hash, text, first window and number of windows."""
        n = len(hashed) - 1
        starts_ok = np.zeros(n + 1, dtype=np.int8)
        long = np.flatnonzero(np.diff(first) >= self.size)
        np.add.at(starts_ok, first[long], 1)
        np.add.at(starts_ok, first[long + 1] - self.size + 1, -1)
        valid = np.cumsum(starts_ok[:max(0, n - self.size + 1)], dtype=np.int8) > 0
        if not valid.any():
            none = np.empty(0, np.int64)
            return none, none, none, none, none
        at = np.arange(n - self.gram + 1)
        grams = textkit.span_hash(hashed, at, at + self.gram)
        bits = np.uint64(int(n).bit_length())
        least = sliding_min((grams >> bits << bits) | at.astype(np.uint64), self.size - self.gram + 1)
        where = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        new = valid.copy()
        new[1:] &= ~(valid[:-1] & (where[1:] == where[:-1]))
        begin = np.flatnonzero(new)
        stop = valid.copy()
        stop[:-1] &= ~(valid[1:] & ~new[1:])
        wins = np.flatnonzero(stop) - begin + 1
        content = textkit.span_hash(hashed, begin, begin + wins - 1 + self.size)
        text = np.searchsorted(first, begin, side="right") - 1
        return grams[where[begin]], content, text, begin - first[text], wins


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    more = width - size
    return np.minimum(x[:len(x) - more], x[more:]) if more else x


def resolve(arrays: dict[str, np.ndarray]) -> np.ndarray:
    """Flags of the segments whose content a smaller doc_id holds too."""
    order = np.lexsort((arrays["doc"], arrays["s"], arrays["a"]))
    a, s, doc = arrays["a"][order], arrays["s"][order], arrays["doc"][order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (s[1:] != s[:-1])
    leader = np.flatnonzero(new)[np.cumsum(new) - 1]
    covered = np.zeros(len(order), dtype=bool)
    covered[order] = doc > doc[leader]
    return covered


def joined(hits: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Neighbouring runs of windows of one text as one."""
    order = np.lexsort((hits["pos"], hits["key"], hits["doc"]))
    h = take(hits, order)
    if not len(order):
        return h
    new = np.ones(len(order), dtype=bool)
    end = h["pos"] + h["wins"]
    # Segments of one text don't overlap, except where a row is repeated.
    new[1:] = (h["doc"][1:] != h["doc"][:-1]) | (h["key"][1:] != h["key"][:-1]) | (h["pos"][1:] > end[:-1])
    begin = np.flatnonzero(new)
    out = take(h, begin)
    out["wins"] = np.maximum.reduceat(end, begin) - out["pos"]
    return out


def rows_of(batches: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.Table:
    columns = list(zip(*batches, strict=True)) if batches else [[] for _ in schema]
    return pa.table({name: pa.array(list(c), kind) for (name, kind), c in zip(schema, columns, strict=True)})


_MAP = [("bucket", pa.int64()), ("kind", pa.int32()), ("n", pa.int64()), ("blob", pa.binary())]
_HOME = [("home", pa.int64()), ("kind", pa.int32()), ("n", pa.int64()), ("blob", pa.binary())]
_CONTENT = [("bucket", pa.int64()), ("n", pa.int64()), ("blob", pa.binary()), ("lengths", pa.binary()),
            ("contents", pa.binary())]


def homed_texts(docs: DataFrame, buckets: int) -> DataFrame:
    """doc_id (nulls as the largest), key, home and text of each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NO_ID)))
    return docs.select(doc.alias("doc"), F.xxhash64(text).bitwiseAND(0xFFFFFFFF).alias("key"),
                       F.pmod(F.xxhash64(doc), F.lit(buckets)).alias("home"), text.alias("text"))


def send_segments(elements: Elements, buckets: int, unit_bytes: int) -> Callable:
    """Step 1, for mapInArrow over ``homed_texts``."""

    def flush(held: list[dict]) -> Iterator[pa.RecordBatch]:
        all_ = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
        covered = resolve(all_)
        hits, rest = joined(take(all_, covered)), take(all_, ~covered)
        rows = [(b, 0, len(x["a"]), pack(SEGMENT, x)) for b, x in by_value(rest, rest["a"] % buckets)]
        rows += [(b, 1, len(x["doc"]), pack((("home", 4), *HIT), x)) for b, x in by_value(hits, hits["home"] % buckets)]
        yield from rows_of(rows, _MAP).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            raw, offsets = textkit.buffers(batch.column(3))
            doc, key, home = (batch.column(i).to_numpy() for i in range(3))
            for i, j in textkit.slices(offsets):
                part = raw[offsets[i]:offsets[j]]
                hashed, first, _ = elements.read(part, offsets[i:j + 1] - offsets[i])
                a, s, text, pos, wins = elements.segments(hashed, first)
                if len(a):
                    held.append({"a": (a & np.uint64(0xFFFFFFFFFF)).astype(np.int64),
                                 "s": (s & np.uint64(0xFFFFFFFFFFFF)).astype(np.int64), "doc": doc[i + text],
                                 "key": key[i + text], "home": home[i + text], "pos": pos, "wins": wins})
                size += len(part)
                if size >= unit_bytes and held:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)
        del held
        textkit.give_back()

    return run


def resolve_bucket(common: int) -> Callable:
    """Step 2: hits (kind 1) and segments to compare (kind 2), by home. The
    windows of an anchor of more than ``common`` different segments are marked
    to be dealt one by one."""

    def run(table: pa.Table) -> pa.Table:
        kind = np.array(table["kind"])
        blobs, counts = table["blob"].to_pylist(), table["n"].to_pylist()

        def of(k: int, fields) -> dict[str, np.ndarray]:
            mine = np.flatnonzero(kind == k)
            return unpack(fields, [blobs[i] for i in mine], [counts[i] for i in mine])

        x = of(0, SEGMENT)
        covered = resolve(x)
        hits, x = take(x, covered), take(x, ~covered)
        order = np.lexsort((x["doc"], x["s"], x["a"]))
        x = take(x, order)
        new = np.ones(len(order), dtype=bool)
        new[1:] = x["a"][1:] != x["a"][:-1]
        begin, group = np.flatnonzero(new), np.cumsum(new) - 1
        other = np.zeros(len(order), dtype=bool)
        other[1:] = ~new[1:] & (x["s"][1:] != x["s"][:-1])
        kinds = np.bincount(group, other, len(begin))[group] + 1 if len(order) else np.empty(0)
        low = np.minimum.reduceat(x["doc"], begin)[group] if len(order) else x["doc"]
        high = np.maximum.reduceat(x["doc"], begin)[group] if len(order) else x["doc"]
        x["salt"] = (kinds > common).astype(np.int64)
        need = take(x, (kinds > 1) & (low != high))
        local = of(1, (("home", 4), *HIT))
        hits = {k: np.concatenate([hits[k], local[k]]) for k in local}
        rows = [(h, 1, len(y["doc"]), pack(HIT, y)) for h, y in by_value(hits, hits["home"])]
        rows += [(h, 2, len(y["doc"]), pack(NEED, y)) for h, y in by_value(need, need["home"])]
        return rows_of(rows, _HOME)

    return run


def text_index(docs: pa.Table) -> dict[tuple[int, int], int]:
    return {k: i for i, k in enumerate(zip(docs["doc"].to_pylist(), docs["key"].to_pylist(), strict=True))}


def fetch_contents(elements: Elements, buckets: int) -> Callable:
    """Step 3a, for cogroups of texts and of segments to compare, by home."""

    def run(docs: pa.Table, needs: pa.Table) -> pa.Table:
        x = unpack(NEED, needs["blob"].to_pylist(), needs["n"].to_pylist())
        if not len(x["doc"]):
            return rows_of([], _CONTENT)
        index, texts = text_index(docs), docs["text"].combine_chunks()
        contents: list[bytes] = []
        places: list[tuple] = []
        to: list[int] = []
        order = np.lexsort((x["pos"], x["key"], x["doc"]))
        last, data, words = None, b"", []
        for i in order:
            doc, key, home, pos, wins = (int(x[f][i]) for f in ("doc", "key", "home", "pos", "wins"))
            if (doc, key) != last:
                last, data = (doc, key), texts[index[doc, key]].as_py().encode()
                if elements.words:
                    words = data.translate(_TO_SPACE).split()
            pieces = [(pos + w, 1) for w in range(wins)] if x["salt"][i] else [(pos, wins)]
            for at, count in pieces:
                end = at + count - 1 + elements.size
                # Words as they are compared: what stands between them is no part of a window.
                piece = b" ".join(words[at:end]) if elements.words else data[at:end]
                contents.append(piece)
                places.append((doc, key, home, at, count))
                to.append((zlib.crc32(piece) if x["salt"][i] else int(x["a"][i])) % buckets)
        columns = np.array(places, dtype=np.int64).T
        arrays = dict(zip([f for f, _ in PLACE], columns, strict=True)) | {"row": np.arange(len(to))}
        rows = []
        for bucket, y in by_value(arrays, np.array(to)):
            mine = [contents[i] for i in y["row"]]
            lengths = np.array([len(c) for c in mine], dtype=np.uint32)
            rows.append((bucket, len(mine), pack(PLACE, y), lengths.tobytes(), b"".join(mine)))
        return rows_of(rows, _CONTENT)

    return run


def solve_bucket(solver: Callable) -> Callable:
    """Step 3b. ``solver(contents, docs, wins)`` gives a boolean array for each
    segment: the windows that a smaller doc_id holds too."""

    def run(table: pa.Table) -> pa.Table:
        x = unpack(PLACE, table["blob"].to_pylist(), table["n"].to_pylist())
        contents: list[bytes] = []
        for lengths, data in zip(table["lengths"].to_pylist(), table["contents"].to_pylist(), strict=True):
            ends = np.cumsum(np.frombuffer(lengths, dtype=np.uint32)).tolist()
            contents += [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        covered = solver(contents, x["doc"], x["wins"])
        segment = np.repeat(np.arange(len(contents)), x["wins"])
        inside = np.arange(len(segment)) - np.repeat(np.cumsum(x["wins"]) - x["wins"], x["wins"])
        flat = np.concatenate(covered) if covered else np.empty(0, bool)
        segment, inside = segment[flat], inside[flat]
        hits = take(x, segment)
        hits["pos"], hits["wins"] = hits["pos"] + inside, np.ones(len(segment), np.int64)
        rows = [(h, 1, len(y["doc"]), pack(HIT, y)) for h, z in by_value(hits, hits["home"]) for y in [joined(z)]]
        return rows_of(rows, _HOME)

    return run


def covered_elements(docs: pa.Table, hits: pa.Table, elements: Elements) -> list[tuple[int, np.ndarray]]:
    """Row and sorted (start, end) element ranges of the texts with hits."""
    x = joined(unpack(HIT, hits["blob"].to_pylist(), hits["n"].to_pylist()))
    found: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for doc, key, pos, wins in zip(*(x[f].tolist() for f in ("doc", "key", "pos", "wins")), strict=True):
        runs = found.setdefault((doc, key), [])
        end = pos + wins - 1 + elements.size
        if runs and pos <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(end, runs[-1][1]))
        else:
            runs.append((pos, end))
    rows = zip(docs["doc"].to_pylist(), docs["key"].to_pylist(), strict=True)
    return [(i, np.array(found[k])) for i, k in enumerate(rows) if k in found]


def remove_repeats(docs: DataFrame, elements: Elements, solver: Callable, finish: Callable, schema: str,
                   common: int = COMMON, unit_bytes: int = UNIT_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Steps 1 to 4. ``finish(texts, ranges)`` makes the output table of a
    group of documents; ranges: row to covered element ranges. The last three
    arguments size the work and change no result."""
    spark = docs.sparkSession
    textkit.ship_package(spark)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(16, -(-total // bucket_bytes))
    texts = homed_texts(docs, buckets)
    sent = texts.mapInArrow(send_segments(elements, buckets, unit_bytes), MAP_SCHEMA)
    resolved = sent.groupBy("bucket").applyInArrow(resolve_bucket(common), HOME_SCHEMA)
    path = scratch_path(spark, "windows")
    textkit.write_table(resolved, path)
    known = spark.read.schema(HOME_SCHEMA).parquet(path)

    def at_home(left: DataFrame, right: DataFrame, run: Callable, out: str) -> DataFrame:
        return left.groupBy("home").cogroup(right.groupBy("home")).applyInArrow(run, out)

    contents = at_home(texts, known.where("kind = 2"), fetch_contents(elements, buckets), CONTENT_SCHEMA)
    solved = contents.groupBy("bucket").applyInArrow(solve_bucket(solver), HOME_SCHEMA)
    hits = known.where("kind = 1").unionByName(solved)

    def last(group: pa.Table, found: pa.Table) -> pa.Table:
        return finish(group, dict(covered_elements(group, found, elements)))

    return at_home(texts, hits, last, schema)
