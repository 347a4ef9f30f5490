"""Small tables and brute-force versions the operator tests share."""

import hashlib
import random
import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# Columns that clash with names the operators use inside.
EXTRA = "key string, home int, n long, bucket int, spans string, set long, doc string"
EXTRA_VALUES = ("k", 1, 2, 3, "s", 4, "d")


def documents(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", len(r[1] or ""), *EXTRA_VALUES) for r in rows]
    return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def corpus(seed=5, count=60, vocabulary=400):
    """Texts with exact copies, near copies and shared passages."""
    draw = random.Random(seed)
    words = [f"w{i}é" if i % 7 == 0 else f"Word{i}" for i in range(vocabulary)]
    passage = " ".join(draw.choice(words) for _ in range(40))
    texts = []
    for i in range(count):
        own = [draw.choice(words) for _ in range(draw.randint(0, 90))]
        if i % 5 == 1 and texts:
            own = (texts[draw.randrange(len(texts))] or "").split()
            if own and i % 2:
                own[draw.randrange(len(own))] = "changed"
        if i % 6 == 2:
            own.insert(draw.randint(0, len(own)), passage)
        texts.append(draw.choice([" ", "\n", "  \t"]).join(own))
    rows = [(3 * i, t) for i, t in enumerate(texts)]
    return rows + [(1000, None), (1001, ""), (1002, " \n"), (1003, "one two"), rows[1], rows[4], (None, texts[2]),
                   (1004, "a" * 3000), (1005, "ab" * 2000)]


def repeated(rows, elements, size):
    """For each row the flags of the elements that a window covers which also
    starts in a row of smaller doc_id; a null id is the largest."""
    rank = [float("inf") if d is None else d for d, _ in rows]
    read = [elements(t or "") for _, t in rows]
    first = {}
    for d, s in zip(rank, read):
        for i in range(len(s) - size + 1):
            w = s[i:i + size]
            first[w] = min(d, first.get(w, d))
    out = []
    for d, s in zip(rank, read):
        flags = [False] * len(s)
        for i in range(len(s) - size + 1):
            if first[s[i:i + size]] < d:
                flags[i:i + size] = [True] * size
        out.append(flags)
    return out
