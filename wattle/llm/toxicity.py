"""Toxicity by a weighted finite-state pattern grammar.

Small transducers read a clause's words as symbols: negation, reported speech
and target keep a state each, insult and threat emit matches. Their product is
composed once into one table; a matched clause (not a word) gets a weight in
the feature of its kind, and a logistic regression over these features gives
the score. The insult lexicon (words and word stems) and all weights are
learned from labelled rows outside the held-out fold.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattle.llm.textkit import ship_package, with_carried

# Fixed values of the grammar: words of each symbol.
INSULTS = ("idiot idiots moron morons stupid scum trash worthless pathetic loser losers clown disgusting").split()
THREATS = ("kill kills killing murder hurt destroy shoot stab strangle "
           "töte töten ermorde ermorden umbringen erschieße erschießen erstechen erwürgen "
           "tuer tuerai tuerons tuez assassiner assassinerai étrangler étranglerai poignarder "
           "matar mataré mataremos matarte asesinar asesinaré estrangular apuñalar").split()
TARGETS = ("you your yours yourself he she him her they them this that these those it is are was were "
           "du dich dir ihr euch sie er ist sind tu toi te vous votre il elle est sont tú usted ustedes él ella es son "
           "ihn ihm ihnen leur lui ti vosotros ellos ellas"
           ).split()
NEGATIONS = ("not never isn aren wasn don doesn nobody nicht kein keine nie pas jamais nunca jamás").split()
REPORTS = ("said says say told called calls wrote quoted claimed sagte sagt dit disait dijo dice").split()

STEMS = (4, 5, 6)  # lengths of the word beginnings that may be lexicon entries
REACH = 3  # words that a negation reaches
KINDS = [f"{kind}_{how}" for kind in ("insult", "threat") for how in ("plain", "aimed", "negated", "reported")]
# Weights before any training: each kind's, then the intercept.
PRIOR = np.array([4.5, 5.0, 2.0, 2.0, 3.0, 5.5, 0.5, 1.0, -3.0])
# What training may not undo: an aimed clause weighs so much more than a match
# that no target stands by, and a negated or reported one no more than that.
GAP = 0.5
# Bounds of what is learned: labelled rows, lexicon entries, least documents of an
# entry, and how many toxic texts there must be for each other one that holds it.
SAMPLE_ROWS, ENTRIES, SUPPORT, ODDS = 20_000, 4_000, 12, 10

_WORD = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]|[,;:|]|[\"“”«»]")
_FIXED = {w: s for s, words in (("T", TARGETS), ("N", NEGATIONS), ("R", REPORTS), ("K", THREATS)) for w in words}


def negation(state: int, symbol: str) -> int:
    """Words that the last negation still reaches."""
    return {"N": REACH, "E": 0, "C": 0}.get(symbol, max(0, state - 1) if symbol != "Q" else state)


def reported(state: int, symbol: str) -> int:
    """1 from a verb of saying, or inside quotation marks, to the sentence's end."""
    return {"R": 1, "E": 0, "Q": 1 - state}.get(symbol, state)


def target(state: int, symbol: str) -> int:
    """1 once a target stood in the clause."""
    return {"T": 1, "E": 0, "C": 0}.get(symbol, state)


def compose() -> dict[tuple[tuple[int, int, int], str], tuple[tuple[int, int, int], str]]:
    """The product machine: (state, symbol) to (state, output). Output: the
    manner of a match at I and K, ``end`` where a clause ends, else nothing."""
    table = {}
    for state in product(range(REACH + 1), range(2), range(2)):
        for symbol in "NRTIKOCEQ":
            after = (negation(state[0], symbol), reported(state[1], symbol), target(state[2], symbol))
            out = "end" if symbol in "CE" else ""
            if symbol in "IK":
                out = "negated" if state[0] else "reported" if state[1] else "plain"
            table[state, symbol] = (after, out)
    return table


MACHINE = compose()
_MARKS = {**dict.fromkeys(".!?\n", "E"), **dict.fromkeys(",;:|", "C"), **dict.fromkeys('"“”«»', "Q")}


class Lexicon:
    """Weights of insult words and stems."""

    def __init__(self, entries: dict[str, float]):
        """``entries``: ``=word`` or ``stem*`` to weight."""
        self.words = {k[1:]: w for k, w in entries.items() if k[0] == "="}
        self.stems = {n: {k[:-1]: w for k, w in entries.items() if k[0] != "=" and len(k) == n + 1} for n in STEMS}

    def weight(self, word: str) -> float:
        best = self.words.get(word, 0.0)
        for n, stems in self.stems.items():
            w = stems.get(word[:n])
            if w is not None and w > best:
                best = w
        return best

    def found(self, words: set[str]) -> dict[str, float]:
        a, (b, c, d) = self.words, self.stems.values()
        return {w: self.weight(w) for w in words if w[:4] in b or w[:5] in c or w[:6] in d or w in a}


def clause_features(text: str | None, lexicon: Lexicon) -> list[float]:
    """Summed weights of the matched clauses of each kind, as 1 - exp(-2 sum)."""
    sums = dict.fromkeys(KINDS, 0.0)
    low = (text or "").lower()
    words = set(_WORD.findall(low))
    insults = lexicon.found(words)
    if insults or not words.isdisjoint(THREATS):
        state, pending = (0, 0, 0), []
        for token in [*_TOKEN.findall(low), "\n"]:
            symbol = _MARKS.get(token) or ("I" if token in insults else _FIXED.get(token, "O"))
            before = state
            state, out = MACHINE[state, symbol]
            if out == "end":
                for kind, how, w in pending:
                    sums[f"{kind}_{'aimed' if how == 'plain' and before[2] else how}"] += w
                pending = []
            elif out:
                pending.append(("insult", out, insults[token]) if symbol == "I" else ("threat", out, 1.0))
    return [1 - math.exp(-2 * sums[k]) for k in KINDS]


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_ROWS) -> DataFrame:
    """text and toxic of at most ``limit`` labelled rows outside the held-out
    fold, those with the least hash of doc_id."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
             .where("doc_id is not null and toxic is not null").where(fold(F.col("doc_id")) != 1)
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    return texts.join(F.broadcast(drawn), "doc_id").select("text", "toxic")


def learn_lexicon(rows: DataFrame, entries: int = ENTRIES, support: int = SUPPORT) -> dict[str, float]:
    """Words and stems that at least ``support`` toxic texts hold and hardly
    any other: at most one for every ODDS. Near copies count once: of the texts
    with the same least hash of five-word runs, one is counted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by = (Counter(), Counter())
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = set(_WORD.findall(text.lower()))
                by[toxic].update({f"={w}" for w in words} | {f"{w[:n]}*" for w in words for n in STEMS if len(w) >= n})
                by[toxic].update(["#"])
            keys = list(by[0].keys() | by[1].keys())
            yield pa.RecordBatch.from_pydict({
                "entry": pa.array(keys, pa.string()), "clean": pa.array([by[0][k] for k in keys], pa.int64()),
                "toxic": pa.array([by[1][k] for k in keys], pa.int64())})

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = []
            for text in batch.column(0).to_pylist():
                words = text.split()
                runs = range(max(1, len(words) - 4))
                least.append(min(zlib.crc32(" ".join(words[i:i + 5]).encode()) for i in runs))
            yield pa.RecordBatch.from_pydict({
                "text": batch.column(0), "toxic": batch.column(1).cast(pa.int32()), "near": pa.array(least, pa.int64())})

    once = rows.mapInArrow(near, "text string, toxic int, near long").groupBy("near").agg(
        F.max_by("text", F.xxhash64("text")).alias("text"), F.max("toxic").alias("toxic"))
    counts = once.select("text", "toxic").mapInArrow(
        count, "entry string, clean long, toxic long")
    sums = counts.groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    kept = (sums.where((F.col("toxic") >= support) & (F.col("clean") * ODDS <= F.col("toxic")))
            .orderBy(F.desc(F.col("toxic") - ODDS * F.col("clean")), "entry").limit(entries).collect())
    counted = {r["entry"]: (r["toxic"], r["clean"]) for r in kept if r["entry"] != "#"}
    return {e: min(1.0, math.log((t + 0.5) / (c + 0.5)) / 4) for e, (t, c) in longest(counted).items()}


def longest(counted: dict[str, tuple[int, int]]) -> dict[str, tuple[int, int]]:
    """Without the stems that a longer entry explains nearly whole: a short
    stem then only adds words that have nothing to do with it."""
    explained: dict[str, int] = {}
    for entry, (toxic, _) in counted.items():
        word = entry.strip("=*")
        ends = range(min(STEMS), len(word) + entry.startswith("="))
        for stem in (word[:n] for n in ends):
            explained[stem] = max(toxic, explained.get(stem, 0))
    return {e: n for e, n in counted.items() if e[0] == "=" or explained.get(e[:-1], 0) < 0.98 * n[0]}


def ordered(w: np.ndarray) -> np.ndarray:
    """The weights without negative ones, each kind's clauses in their order,
    and an aimed threat no less than an aimed insult: labels may hold none."""
    w[:-1] = np.maximum(w[:-1], 0)
    for at in (0, 4):
        w[at + 1] = max(w[at + 1], w[at] + GAP)
        w[at + 2:at + 4] = np.minimum(w[at + 2:at + 4], w[at])
    w[5] = max(w[5], w[1])
    return w


def fit_weights(x: np.ndarray, y: np.ndarray, rounds: int = 4000, rate: float = 2.0, pull: float = 5e-5) -> np.ndarray:
    """Logistic regression by gradient descent, drawn towards PRIOR; no kind
    of clause may lower a score, and clauses, not lone words, weigh most."""
    w = PRIOR.copy()
    if not len(y):
        return w
    for _ in range(rounds):
        miss = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1]))) - y
        step = np.append(x.T @ miss, miss.sum()) / len(y) + pull * (w - PRIOR)
        w = ordered(w - rate * step)
    return w


def train(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_ROWS) -> tuple[dict[str, float], np.ndarray]:
    """Lexicon and weights. The rows drawn are at most ``limit``; lexicon
    entries at most ENTRIES; so what the driver holds is bounded."""
    ship_package(docs.sparkSession)
    rows = training_rows(docs, labels, limit)
    entries = {f"={w}": 1.0 for w in INSULTS} | learn_lexicon(rows)
    lexicon = Lexicon(entries)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [clause_features(t, lexicon) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"x": pa.array(x, pa.list_(pa.float64())), "toxic": batch.column(1)})

    kind = rows.schema["toxic"].dataType.simpleString()
    # Equal (features, label) are counted, so few rows come back for many texts.
    got = (rows.mapInArrow(features, f"x array<double>, toxic {kind}").groupBy("x", "toxic")
           .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "x", "toxic").limit(limit).collect())
    x = np.array([r["x"] for r in got for _ in range(r["n"])], dtype=float).reshape(-1, len(KINDS))
    y = np.array([float(r["toxic"] > 0) for r in got for _ in range(r["n"])])
    order = np.lexsort((*x.T, y)) if len(y) else slice(None)
    return entries, fit_weights(x[order], y[order])


def score_texts(docs: DataFrame, entries: dict[str, float], weights: np.ndarray, threshold: float = 0.7,
                carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted and the struct ``carried`` of the
    columns named in ``carry`` for each row; whole texts are read, and nothing but the text is scored. Null
    and empty texts have the score of a text without matches; equal texts
    have equal scores; other columns are ignored, whatever their names."""
    spark = docs.sparkSession
    ship_package(spark)
    given = spark.sparkContext.broadcast((entries, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, w = Lexicon(given.value[0]), given.value[1]
        for batch in batches:
            x = np.array([clause_features(t, lexicon) for t in batch.column(1).to_pylist()]).reshape(-1, len(KINDS))
            score = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
            out = {"doc_id": batch.column(0).cast(pa.int64()), "score": pa.array(score, pa.float64()),
                   "predicted": pa.array((score >= threshold).astype(np.int32))}
            for i, c in enumerate(carry):
                out[f"carry_{c}"] = batch.column(2 + i)
            yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, score double, predicted int"
    schema += "".join(f", `carry_{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    out = with_carried(docs.select("doc_id", "text", *carry).mapInArrow(run, schema), carry)
    held_out = F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out")
    return out.select("doc_id", held_out, "score", "predicted", *(["carried"] if carry else []))


def score_documents(docs: DataFrame, labels: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Train on the labelled rows outside the held-out fold, score every row.
    Without any labelled row the fixed words and PRIOR alone give the score."""
    return score_texts(docs, *train(docs, labels), carry=carry)
