"""Byte-pair encoding and decoding with a public vocabulary file.

Short words are merged in a contiguous rank array: part boundaries and the
rank of each neighbouring pair, repeatedly scanned for the minimum; the
boundary there is deleted and the two neighbouring ranks refreshed.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame

from wattle.llm.textkit import give_back, ship_package, with_carried

# Fixed values of the vocabulary file's normaliser and splitter.
WHITE = ("\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
         "\u2028\u2029\u202f\u205f\u3000")
LIBRARY_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{WHITE}\p{{L}}\p{{N}}]+"
END = "</w>"
PUNCTUATION = frozenset("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")
TO_SPACE = str.maketrans(dict.fromkeys(WHITE, " "))

# Below this code point every one is assigned.
_OLD = re.compile("[^\\x00-\u0377]")

NO_RANK = 1 << 60
PAIR_BITS = 32
# Longer words are merged with a heap: a scan for each merge would be quadratic.
SHORT_WORD = 200
# Entries of a worker's caches of words; a full cache is emptied.
CACHE_WORDS = 400_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where it is
    printable Latin-1, else the next unused letter from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


@lru_cache(maxsize=1)
def unassigned() -> re.Pattern:
    """Code points that this Python's Unicode tables don't know. Other tables,
    older or newer, may call them letters or numbers or lower-case them."""
    unknown = [unicodedata.category(chr(c)) == "Cn" for c in range(sys.maxunicode + 1)]
    edges = [c for c in range(len(unknown)) if unknown[c] != (c > 0 and unknown[c - 1])] + [len(unknown)]
    runs = zip(edges[::2], edges[1::2], strict=False)
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in runs) + "]")


class Vocabulary:
    """Ids, merges and added tokens of a tokenizer file, with word caches."""

    def __init__(self, spec: dict):
        # Says how texts with code points unknown here are normalised and split.
        self.library = tokenizers.Tokenizer.from_str(json.dumps(spec))
        self.split = tokenizers.pre_tokenizers.Split(tokenizers.Regex(LIBRARY_SPLIT), "removed", invert=True)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.strings = {i: s for s, i in self.ids.items()}
        self.rank: dict[int, int] = {}  # pair of ids, as one integer, to rank
        self.made: list[int] = []  # rank to the id that the merge makes
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[self.ids[a] << PAIR_BITS | self.ids[b]] = r
            self.made.append(self.ids[a + b])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings.update({i: s for s, i in self.added.items()})
        letters = byte_letters()
        self.inner = [self.ids.get(x) for x in letters]
        self.last = [self.ids.get(x + END) for x in letters]
        self.words = regex.compile(SPLIT)
        longest_first = sorted(self.added, key=len, reverse=True)
        self.specials = regex.compile("|".join(map(regex.escape, longest_first))) if self.added else None
        self.chunks: dict[str, tuple[bytes, str]] = {}
        self.known: dict[str, list[int]] = {}

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word of the splitter."""
        raw = word.encode()
        ids = [self.inner[b] for b in raw]
        ids[-1] = self.last[raw[-1]]
        if None in ids:
            ids = [i for i in ids if i is not None]
        merge = merge_short if len(ids) <= SHORT_WORD else merge_long
        return merge(ids, self.rank, self.made)

    def chunk(self, text: str) -> tuple[bytes, str]:
        """Little-endian ids and decoded tokens of text without white space."""
        if _OLD.search(text) and unassigned().search(text):
            words = [word for _, (a, b) in self.split.pre_tokenize_str(text) if (word := text[a:b])]
        elif text.isalpha():
            words = [text]
        elif text[:-1].isalpha() and text[-1] in PUNCTUATION:
            words = [text[:-1], text[-1]]
        else:
            words = self.words.findall(text)
        ids: list[int] = []
        for word in words:
            one = self.known.get(word)
            if one is None:
                one = self.encode_word(word)
                if len(word) <= SHORT_WORD:
                    if len(self.known) >= CACHE_WORDS:
                        self.known.clear()
                    self.known[word] = one
            ids += one
        got = (struct.pack(f"<{len(ids)}I", *ids), self.decode(ids))
        if len(text) <= SHORT_WORD:
            if len(self.chunks) >= CACHE_WORDS:
                self.chunks.clear()
            self.chunks[text] = got
        return got

    def encode(self, text: str | None) -> tuple[int, bytes, str]:
        """Count, ids as little-endian unsigned 32-bit integers, decoded text."""
        parts: list[tuple[bytes, str]] = []
        at = 0
        for m in self.specials.finditer(text or "") if self.specials else ():
            parts += self._plain(text[at:m.start()])
            parts.append((struct.pack("<I", self.added[m[0]]), m[0]))
            at = m.end()
        parts += self._plain((text or "")[at:])
        raw = b"".join([p[0] for p in parts])
        return len(raw) // 4, raw, " ".join([p[1] for p in parts if p[1]])

    def forget(self) -> None:
        """Empty the caches of words."""
        self.known.clear()
        self.chunks.clear()

    def _plain(self, text: str) -> list[tuple[bytes, str]]:
        if text.isascii():
            text = text.lower()
        elif _OLD.search(text) and unassigned().search(text):
            text = self.library.normalizer.normalize_str(text)
        else:
            text = lower(unicodedata.normalize("NFC", text))
        # split() also cuts at \x1c-\x1f, which are no white space to the file's rules.
        odd = any(c in text for c in "\x1c\x1d\x1e\x1f")
        words = text.translate(TO_SPACE).split(" ") if odd else text.split()
        get, make = self.chunks.get, self.chunk
        return [get(w) or make(w) for w in words if w]

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder, so tokens are joined by one space."""
        return " ".join(map(self.strings.__getitem__, ids))


def lower(text: str) -> str:
    """Each letter lower-cased by itself (no rule for a word's last sigma)."""
    return text.replace("Σ", "σ").lower()


def merge_short(ids: list[int], rank: dict[int, int], made: list[int]) -> list[int]:
    """Contiguous rank array. ``part[i]`` is the id that begins at boundary i,
    ``near[i]`` the rank of the pair of parts i and i + 1."""
    part, get = ids[:], rank.get
    near = [get(a << PAIR_BITS | b, NO_RANK) for a, b in zip(part, part[1:], strict=False)]
    while near:
        best = min(near)
        if best == NO_RANK:
            break
        i = near.index(best)
        new = part[i] = made[best]
        del part[i + 1], near[i]
        if i < len(near):
            near[i] = get(new << PAIR_BITS | part[i + 1], NO_RANK)
        if i:
            near[i - 1] = get(part[i - 1] << PAIR_BITS | new, NO_RANK)
    return part


def merge_long(ids: list[int], rank: dict[int, int], made: list[int]) -> list[int]:
    """The same merges in the same order with a heap over a linked list."""
    n = len(ids)
    part: list[int] = list(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, int]] = []

    def offer(i: int, j: int) -> None:
        pair = part[i] << PAIR_BITS | part[j]
        if pair in rank:
            heapq.heappush(heap, (rank[pair], i, pair))

    for i in range(n - 1):
        offer(i, i + 1)
    while heap:
        best, i, pair = heapq.heappop(heap)
        j = after[i]
        if part[i] < 0 or j >= n or part[i] << PAIR_BITS | part[j] != pair:
            continue
        part[i], part[j] = made[best], -1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            offer(i, after[i])
        if before[i] >= 0:
            offer(before[i], i)
    return [p for p in part if p >= 0]


_LOADED: dict[str, Vocabulary] = {}


def load(spec_text: str) -> Vocabulary:
    """One vocabulary a worker, kept between tasks."""
    key = hashlib.md5(spec_text.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Vocabulary(json.loads(spec_text))
    return _LOADED[key]


def encode_texts(docs: DataFrame, vocabulary_file: str, carry: tuple[str, ...] = (),
                 with_ids: bool = False) -> DataFrame:
    """Encode every whole text and decode the ids again.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256, with ``with_ids`` ids
    and decoded themselves, and the struct ``carried`` of the columns named in
    ``carry``; one row for
    each input row, other columns ignored whatever their names. Null and empty
    texts have no tokens and decode to the empty text; equal texts have equal
    results. Texts of any length are encoded whole. Where a text holds code
    points that Python's Unicode tables don't know, the tokenizers library
    normalises it and finds its words, so that its tables decide.

    The file (a few MB, whatever the corpus) is read by the driver and
    broadcast; its added tokens in a text become their ids.
    """
    spark = docs.sparkSession
    ship_package(spark)
    with open(vocabulary_file, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    kept = [docs.schema[c] for c in carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load(spec.value)
        for batch in batches:
            done = [vocabulary.encode(t) for t in batch.column(1).to_pylist()]
            out = {
                "doc_id": batch.column(0).cast(pa.int64()),
                "n_tokens": pa.array([d[0] for d in done], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(d[1]).hexdigest() for d in done], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(d[2].encode()).hexdigest() for d in done], pa.string()),
            }
            for i, c in enumerate(carry):
                out[f"carry_{c}"] = batch.column(2 + i)
            if with_ids:
                out["ids"] = pa.array([list(struct.unpack(f"<{d[0]}I", d[1])) for d in done], pa.list_(pa.int64()))
                out["decoded"] = pa.array([d[2] for d in done], pa.string())
            yield pa.RecordBatch.from_pydict(out)
        vocabulary.forget()
        give_back()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += "".join(f", `carry_{f.name}` {f.dataType.simpleString()}" for f in kept)
    schema += ", ids array<long>, decoded string" if with_ids else ""
    out = docs.select("doc_id", "text", *carry).mapInArrow(run, schema)
    return with_carried(out, carry)
