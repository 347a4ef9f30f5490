"""Merkle manifest against a tree built row by row."""

import random
import zlib

import pytest
from helpers import EXTRA, EXTRA_VALUES, LOWER, sha

from wattle.llm import merkle

SCHEMA = f"doc_id long, source string, lang string, n_chars long, text string, {EXTRA}"


def leaf(doc_id, source, lang, n_chars, text):
    parts = []
    for v in (doc_id, source, lang, n_chars, text):
        parts.append("-" if v is None else f"{len(str(v).encode())}:{v}")
    return sha("".join(parts))


def siblings(nodes, pos):
    """Root of nodes, and the (left, right) siblings of one of them."""
    path = []
    while len(nodes) > 1:
        runs = [nodes[i:i + 16] for i in range(0, len(nodes), 16)]
        run, at = runs[pos // 16], pos % 16
        path.append(("".join(run[:at]), "".join(run[at + 1:])))
        nodes, pos = [sha("".join(r)) for r in runs], pos // 16
    return nodes[0], path


def brute(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r[1], []).append(r)
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        trees[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
    roots = [siblings([leaf(*r) for r in trees[s]], 0)[0] for s in order]
    out = []
    for i, s in enumerate(order):
        root, above = siblings(roots, i)
        leaves = [leaf(*r) for r in trees[s]]
        for k, r in enumerate(trees[s]):
            subroot, path = siblings(leaves, k)
            path = path + above
            h = leaves[k]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                h = leaf(*r[:4], None if r[4] is None else r[4].translate(LOWER))
            for left, right in path:
                h = sha(left + h + right)
            out.append((str(r[0]), leaves[k], subroot, root, sha("".join(a + b for a, b in path)), h, h == root))
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA_VALUES) for r in rows], SCHEMA)


def manifest(spark, rows):
    cols = ("leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted((str(r.doc_id), *[r[c] for c in cols]) for r in merkle.merkle_manifest(table(spark, rows)).collect())


@pytest.mark.parametrize("sizes", [[1], [1, 1], [16, 17], [300, 2, 257, 16], [4500, 1]])
def test_manifest_matches_brute_force(spark, sizes):
    draw = random.Random(len(sizes))
    rows = []
    for k, n in enumerate(sizes):
        rows += [(draw.randrange(10 ** 6), f"s{k}é", "en", i, f"Text {i % 50}" if i % 9 else None) for i in range(n)]
    assert manifest(spark, rows) == brute(rows)


def test_nulls_repeats_and_many_sources(spark):
    rows = [(i, f"s{i}", None, None, "A" * (i % 40)) for i in range(290)]
    rows += [(None, None, None, None, None)] * 40 + [(5, None, "fr", 3, "Été")] * 30 + [(None, "", "en", 0, "")]
    rows += [(-3, "s1", "en", 2 ** 40, "x" * 200_000), (5, "s1", "en", 1, "B"), (5, "s1", "en", 1, "A")]
    assert manifest(spark, rows) == brute(rows)


def test_empty_table_and_tamper_rule(spark):
    assert merkle.merkle_manifest(table(spark, [])).count() == 0
    from pyspark.sql import functions as F
    rows = [(1, "a", "en", 1, "Upper"), (2, "a", "en", 1, "lower")]
    got = merkle.merkle_manifest(table(spark, rows), tamper=F.lit(True)).collect()
    assert {r.doc_id: r.verified for r in got} == {1: False, 2: True}
