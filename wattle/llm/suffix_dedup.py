"""Suffix-array dedup: repeated byte strings found by deep-shallow sorting of
the suffixes that may repeat. See ``windows`` for how they come together."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattle.llm.windows import NO_ID, Elements, remove_repeats

# Depth in bytes of the multikey quicksort; beyond it blind tries order.
SHALLOW, STEP = 24, 8


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """At each place the next eight bytes as one big-endian number."""
    n = len(data) - 7
    out = np.zeros(n, dtype=np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | data[i:n + i]
    return out


def shallow_sort(keys: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort over eight bytes at a time. Returns the order of the
    suffixes and, for each place in it, the number of its group: suffixes that
    agree in ``depth`` bytes."""
    order = np.argsort(keys[starts], kind="stable")
    group = np.zeros(len(starts), dtype=np.int64)
    k = keys[starts[order]]
    group[1:] = np.cumsum(k[1:] != k[:-1])
    for at in range(STEP, depth, STEP):
        sizes = np.bincount(group)
        tied = np.flatnonzero(sizes[group] > 1)
        if not len(tied):
            break
        k = keys[starts[order[tied]] + at]
        again = np.lexsort((k, group[tied]))
        order[tied] = order[tied[again]]
        k, g = k[again], group[tied]
        new = np.zeros(len(order), dtype=bool)
        new[1:] = group[1:] != group[:-1]
        new[tied[1:]] |= (k[1:] != k[:-1]) | (g[1:] != g[:-1])
        group = np.cumsum(new)
    return order, group


class BlindTrie:
    """Orders strings of one length. An inner node holds the place where its
    strings differ first and a child for each byte there; bytes between are
    not looked at on the way down, but compared once at a leaf."""

    def __init__(self):
        self.root = None
        self.leaves: dict[bytes, list[int]] = {}

    def add(self, text: bytes, item: int) -> None:
        same = self.leaves.get(text)
        if same is not None:
            same.append(item)
            return
        self.leaves[text] = [item]
        if self.root is None:
            self.root = text
            return
        node = self.root
        while isinstance(node, tuple):
            node = node[1].get(text[node[0]]) or next(iter(node[1].values()))
        at = next(i for i, (x, y) in enumerate(zip(node, text, strict=True)) if x != y)
        holder, byte, node, leaf = None, 0, self.root, node
        while isinstance(node, tuple) and node[0] < at:
            holder, byte = node, text[node[0]]
            node = node[1][byte]
        if isinstance(node, tuple) and node[0] == at:
            node[1][text[at]] = text
            return
        made = (at, {leaf[at]: node, text[at]: text})
        if holder is None:
            self.root = made
        else:
            holder[1][byte] = made

    def groups(self) -> list[list[int]]:
        """Items of equal strings, in the strings' order."""
        out, stack = [], [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
            else:
                out.append(self.leaves[node])
        return out


def equal_groups(data: bytes, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order, and the group of each place in it: suffixes that agree in
    ``size`` bytes."""
    raw = np.frombuffer(data + bytes(16), dtype=np.uint8)
    keys = eight_bytes(raw)
    depth = min(SHALLOW, size // STEP * STEP)
    if depth < STEP:
        depth, keys = STEP, keys >> np.uint64(8 * (STEP - size))
    order, group = shallow_sort(keys, starts, depth)
    if depth >= size or not len(order):
        return order, group
    # Deep: a group that agrees with its first suffix to the end is a trie of
    # one leaf; the others are ordered by a trie each.
    first = np.flatnonzero(np.r_[True, np.diff(group) > 0])
    place = starts[order]
    same = np.ones(len(order), dtype=bool)
    for at in [*range(depth, size - STEP, STEP), size - STEP]:
        same &= keys[place + at] == keys[place[first[group]] + at]
    mixed = np.unique(group[~same])
    new = np.zeros(len(order), dtype=np.int64)
    new[first] = 1
    ends = np.r_[first[1:], len(order)]
    for g in mixed.tolist():
        a, b = first[g], ends[g]
        trie = BlindTrie()
        for i in order[a:b].tolist():
            p = int(starts[i])
            trie.add(data[p + depth:p + size], i)
        at = a
        for items in trie.groups():
            order[at:at + len(items)] = items
            new[at] = 1
            at += len(items)
    return order, np.cumsum(new) - 1


def solve(size: int):
    def run(contents: list[bytes], docs: np.ndarray, wins: np.ndarray) -> list[np.ndarray]:
        if not contents:
            return []
        begin = np.cumsum([0, *map(len, contents[:-1])])
        first = np.cumsum(wins) - wins
        owner = np.repeat(np.arange(len(wins)), wins)
        starts = np.arange(len(owner)) - first[owner] + begin[owner]
        order, group = equal_groups(b"".join(contents), starts, size)
        doc = docs[owner[order]]
        least = np.full(group[-1] + 1, NO_ID) if len(group) else np.empty(0, np.int64)
        np.minimum.at(least, group, doc)
        covered = np.zeros(len(order), dtype=bool)
        covered[order] = doc > least[group]
        return np.split(covered, first[1:])

    return run


def _finish(texts: pa.Table, ranges: dict[int, np.ndarray]) -> pa.Table:
    n_bytes, n_removed, n_spans, digests, kept_texts = [], [], [], [], []
    for i, text in enumerate(texts["text"].to_pylist()):
        data = text.encode()
        spans = ranges.get(i)
        kept = data
        if spans is not None:
            edges = [0, *spans.ravel().tolist(), len(data)]
            kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
        n_bytes.append(len(data))
        n_removed.append(len(data) - len(kept))
        n_spans.append(0 if spans is None else len(spans))
        digests.append(hashlib.sha256(kept).hexdigest())
        kept_texts.append(kept)
    return pa.table({"doc": texts["doc"], "n_bytes": pa.array(n_bytes, pa.int64()),
                     "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()),
                     "kept_sha256": pa.array(digests, pa.string()), "kept": pa.array(kept_texts, pa.binary())})


def _id(out: DataFrame) -> DataFrame:
    doc = F.when(F.col("doc") != F.lit(int(NO_ID)), F.col("doc"))
    return out.select(doc.alias("doc_id"), *[c for c in out.columns if c != "doc"])


def remove_repeated_bytes(docs: DataFrame, size: int = 50, gram: int = 16, **sizes: int) -> DataFrame:
    """Remove each byte that a ``size``-byte string covers which also starts in
    a document with a smaller doc_id; all strings are judged on the input.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (bytes)
    of each row; other columns are ignored, whatever their names. Null texts
    are empty; texts shorter than ``size`` keep all; rows that share a doc_id
    don't cover each other; a null doc_id is larger than any other and is
    returned as null; an empty table gives no rows. ``sizes``: those of
    ``remove_repeats``.
    """
    return _id(remove_repeats(docs, Elements(False, size, gram), solve(size), _finish,
                              "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary",
                              **sizes))
