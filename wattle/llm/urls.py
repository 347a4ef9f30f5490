"""URL filters: host and path rules, and a logistic regression on hashed
character n-grams of host and path for the urls that no rule fits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattle.llm.textkit import STEP, mix, ship_package

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Features of the model: n-grams of these lengths, hashed into so many bins.
GRAMS, BINS = (3, 4, 5), 1 << 15

# Rules of the query: host and path, verdict.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

# The labelled table is built from common words of either kind, each joined with
# words that stand beside both kinds; `training_table` joins the hosts with the
# same prefixes and paths, so that only the host tells the kinds apart.
BLOCKED_WORDS = (
    "casino casinos poker bet bets betting gamble slots jackpot roulette pill pills viagra cialis pharma meds steroid "
    "ad ads adserver adclick track tracker popunder banner spam spammer linkfarm seofarm adult porn xxx cam escort "
    "loan loans payday warez crack keygen torrent replica phish malware scam prize lottery").split()
ALLOWED_WORDS = (
    "news weather library school university physics history museum garden cooking travel maps data health parliament "
    "art gallery reader forum docs wiki mountain river science music theatre poetry grammar railway harbour village "
    "council hospital biology chemistry astronomy language dictionary archive journal letters photo film theory method "
    "station bridge forest ocean desert island farm kitchen bakery orchestra stadium football tennis chess").split()
BESIDE = ("free best top win cheap royal lucky super mega online club zone hub world star now daily city old new "
          "my the our x pro").split()
ENDINGS = ("example.com", "example.org", "example.net")
PREFIXES = ("", "www.", "m.", "blog.")
PATHS = ("/en/12", "/de/480", "/fr/3317/", "/es/78.html", "/en/9051", "/index.html", "/", "/fr/6")
HOSTS_OF_A_WORD = 6


def hosts(words: list[str]) -> list[str]:
    """For each word some names that it makes with the words beside it."""
    out = []
    for i, word in enumerate(words):
        for k in range(HOSTS_OF_A_WORD):
            other = BESIDE[(7 * i + 4 * k + 3) % len(BESIDE)]
            name = (f"{other}-{word}", f"{word}-{other}", f"{other}{word}", f"{word}{other}", word, f"{word}s-{other}")[k]
            out.append(f"{name}.{ENDINGS[(i + k) % len(ENDINGS)]}")
    return out


def training_table() -> list[tuple[str, str, int]]:
    """host, path and label (1: block); each host with every prefix."""
    out = []
    for label, words in ((1, BLOCKED_WORDS), (0, ALLOWED_WORDS)):
        for i, host in enumerate(hosts(words)):
            out += [(p + host, PATHS[(i + k) % len(PATHS)], label) for k, p in enumerate(PREFIXES)]
    return out


def features(rows: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and bins of the different n-grams of host and path, all rows
    at once: one rolling hash over the bytes of all parts."""
    parts = [f"{kind}^{part}$".encode() for row in rows for kind, part in zip("hp", row, strict=True)]
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    raw = np.frombuffer(b"".join(parts), dtype=np.uint8).astype(np.uint64)
    sizes = np.array([len(p) for p in parts])
    ends = np.repeat(np.cumsum(sizes), sizes)
    row = np.repeat(np.arange(len(parts)) // 2, sizes)
    kind = np.repeat(np.arange(len(parts), dtype=np.uint64) % np.uint64(2), sizes)
    first = np.zeros(len(raw), dtype=bool)
    first[np.cumsum(sizes) - sizes] = True  # the letter of the kind begins no n-gram
    found = []
    for n in GRAMS:
        at = np.flatnonzero(~first & (np.arange(len(raw)) + n <= ends))
        value = kind[at] + np.uint64(2 * n)
        for k in range(n):
            value = value * STEP + raw[at + k]
        found.append(row[at] * BINS + (mix(value) % np.uint64(BINS)).astype(np.int64))
    both = np.unique(np.concatenate(found))
    return both // BINS, both % BINS


def logits(row: np.ndarray, col: np.ndarray, count: int, w: np.ndarray) -> np.ndarray:
    """Sums of the rows' weights, scaled to the length of one."""
    n = np.maximum(1, np.bincount(row, minlength=count))
    return np.bincount(row, w[col], count) / np.sqrt(n) + w[-1]


def train(rows: list[tuple[str, str, int]], rounds: int = 600, rate: float = 20.0, ridge: float = 2e-5) -> np.ndarray:
    """Weights by gradient descent; the last one is the intercept."""
    w = np.zeros(BINS + 1)
    if not rows:
        return w
    row, col = features([(h, p) for h, p, _ in rows])
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(row, minlength=len(rows))))
    y = np.array([label for *_, label in rows], dtype=float)
    for _ in range(rounds):
        miss = 1 / (1 + np.exp(-logits(row, col, len(rows), w))) - y
        w[:-1] -= rate * (np.bincount(col, (miss * scale)[row], BINS) / len(rows) + ridge * w[:-1])
        w[-1] -= rate * miss.mean()
    return w


def scores(rows: list[tuple[str, str]], weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-logits(*features(rows), len(rows), weights)))


def score(host: str, path: str, weights: np.ndarray) -> float:
    return float(scores([(host, path)], weights)[0])


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """Then up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: len(r[0])):
        own, _, start = rule.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(f"/{start}")
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def judge_urls(pages: DataFrame, rules=RULES, threshold: float = 0.6) -> DataFrame:
    """page_id, host, path, rule, verdict and ``spam_score`` (the model's) of
    each row; other columns are ignored, whatever their names.

    A null url or one without :// has empty host and path and no rule; the
    model judges it, as every url that no rule fits. Repeated rows are judged
    each. The training table is a constant of this module, so model and
    broadcast (256 KB) don't depend on the input.
    """
    ship_package(pages.sparkSession)
    weights = pages.sparkSession.sparkContext.broadcast(train(training_table()))

    @F.pandas_udf("double")
    def spam(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hosts, paths in parts:
            yield pd.Series(scores(list(zip(hosts, paths, strict=True)), weights.value), dtype=float)

    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    out = split.withColumns({"rule": rule, "says": says, "spam_score": spam("host", "path")})
    model = F.when(F.col("spam_score") >= threshold, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("says", model).alias("verdict"), "spam_score")
