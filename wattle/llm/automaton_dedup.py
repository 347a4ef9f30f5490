"""Substring dedup: suffix automata of reference shards give the matching
statistics of the segments streamed through them. See ``windows`` for how
shards and segments come together: a shard's automaton is built where its
segments are, since automata of a whole corpus have no size bound that a
broadcast would need."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wattle.llm.suffix_dedup import _id
from wattle.llm.windows import _TO_SPACE, Elements, remove_repeats


class SuffixAutomaton:
    """Of many sequences; each state holds the least doc_id that it ends in."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.doc: list[int] = [np.iinfo(np.int64).max]

    def _state(self, length: int, edges: dict, link: int, doc: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        self.doc.append(doc)
        return len(self.next) - 1

    def _clone(self, p: int, q: int, word) -> int:
        """Split off of q the strings that reach it from p."""
        c = self._state(self.length[p] + 1, self.next[q].copy(), self.link[q], np.iinfo(np.int64).max)
        self.link[q] = c
        while p != -1 and self.next[p].get(word) == q:
            self.next[p][word] = c
            p = self.link[p]
        return c

    def add(self, words: list, doc: int) -> None:
        last = 0
        for word in words:
            q = self.next[last].get(word)
            if q is not None:
                if self.length[q] != self.length[last] + 1:
                    q = self._clone(last, q, word)
                last = q
            else:
                new, p = self._state(self.length[last] + 1, {}, 0, np.iinfo(np.int64).max), last
                while p != -1 and word not in self.next[p]:
                    self.next[p][word] = new
                    p = self.link[p]
                if p != -1:
                    q = self.next[p][word]
                    self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, word)
                last = new
            self.doc[last] = min(self.doc[last], doc)

    def close(self) -> None:
        """A state ends wherever those that link to it do."""
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            up = self.link[s]
            if self.doc[s] < self.doc[up]:
                self.doc[up] = self.doc[s]

    def least_docs(self, words: list, size: int) -> list[int]:
        """For each end of ``size`` words, the least doc_id that holds them."""
        state, matched, out = 0, 0, []
        for i, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            state = self.next[state].get(word, 0)
            matched = matched + 1 if state else 0
            while state and self.length[self.link[state]] >= size:
                state = self.link[state]
                matched = self.length[state]
            if i >= size - 1:
                out.append(self.doc[state] if matched >= size else np.iinfo(np.int64).max)
        return out


def solve(size: int):
    def run(contents: list[bytes], docs: np.ndarray, wins: np.ndarray) -> list[np.ndarray]:
        automaton = SuffixAutomaton()
        ids: dict[bytes, int] = {}
        # Equal words are one object, equal segments one reference.
        read = [[ids.setdefault(w, len(ids)) for w in data.translate(_TO_SPACE).split()] for data in contents]
        least: dict[tuple, int] = {}
        for words, doc in zip(read, docs.tolist(), strict=True):
            t = tuple(words)
            least[t] = min(doc, least.get(t, doc))
        for words, doc in least.items():
            automaton.add(list(words), doc)
        automaton.close()
        return [np.array(automaton.least_docs(words, size), dtype=np.int64) < doc
                for words, doc in zip(read, docs.tolist(), strict=True)]

    return run


def _finish(texts: pa.Table, ranges: dict[int, np.ndarray]) -> pa.Table:
    n_words, n_removed, digests, kept_texts = [], [], [], []
    for i, text in enumerate(texts["text"].to_pylist()):
        words = text.encode().translate(_TO_SPACE).split()
        kept, spans = words, ranges.get(i)
        if spans is not None:
            edges = [0, *spans.ravel().tolist(), len(words)]
            kept = [w for a, b in zip(edges[::2], edges[1::2], strict=True) for w in words[a:b]]
        joined = b" ".join(kept)
        n_words.append(len(words))
        n_removed.append(len(words) - len(kept))
        digests.append(hashlib.sha256(joined).hexdigest())
        kept_texts.append(joined.decode())
    return pa.table({"doc": texts["doc"], "n_words": pa.array(n_words, pa.int64()),
                     "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string()),
                     "kept": pa.array(kept_texts, pa.string())})


def remove_repeated_words(docs: DataFrame, size: int = 13, gram: int = 4, **sizes: int) -> DataFrame:
    """Remove each word that a window of ``size`` words covers whose sequence
    also starts in a document with a smaller doc_id; all windows are judged on
    the input.

    Returns doc_id, n_words, n_removed, kept_sha256 and kept (words joined by
    one space) of each row; other columns are ignored, whatever their names.
    Null texts have no words; texts of fewer words than ``size`` keep all;
    rows that share a doc_id don't cover each other; a null doc_id is larger
    than any other and is returned as null; an empty table gives no rows.
    """
    return _id(remove_repeats(docs, Elements(True, size, gram), solve(size), _finish,
                              "doc long, n_words long, n_removed long, kept_sha256 string, kept string", **sizes))
