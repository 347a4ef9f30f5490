"""The Jaccard join against all pairs."""

import random
from collections import Counter

import pytest
from helpers import LOWER, WORDS, corpus, documents

from wattle.llm import jaccard


def brute(rows):
    sets = []
    for _, t in rows:
        w = WORDS.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows))


def near_copies(seed):
    draw = random.Random(seed)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(40):  # chains of edits: neighbours are linked, ends aren't
        base = base[:]
        for _ in range(draw.randint(0, 3)):
            base[draw.randrange(len(base))] = f"x{draw.random()}"
        rows.append((i, " ".join(base)))
    for i in range(30):  # short texts around the threshold
        words = [f"s{j}" for j in range(draw.randint(4, 14))]
        if draw.random() < 0.5:
            words[draw.randrange(len(words))] = "other"
        rows.append((100 + i, " ".join(words)))
    shared = " ".join(f"p{j}" for j in range(50))
    rows += [(200 + i, f"{shared} " + " ".join(f"q{i}_{j}" for j in range(draw.randint(2, 40)))) for i in range(40)]
    return rows


@pytest.mark.parametrize("rows", [corpus(seed=11), near_copies(1), near_copies(2)], ids=["corpus", "near1", "near2"])
def test_components_match_all_pairs(spark, rows):
    got = jaccard.jaccard_components(documents(spark, rows)).collect()
    assert Counter(map(tuple, got)) == brute(rows)


@pytest.mark.parametrize("edge", [1, 16, 1 << 40])
def test_every_boundary_gives_the_same_links(spark, monkeypatch, edge):
    """Lists alone, both, subsets alone; without the first round's help."""
    rows = near_copies(3)
    monkeypatch.setattr(jaccard, "boundary", lambda signed: edge)
    monkeypatch.setattr(jaccard, "leader_pairs", lambda nodes: nodes.selectExpr("set as a", "set as b").limit(0))
    got = jaccard.jaccard_components(documents(spark, rows)).collect()
    assert Counter(map(tuple, got)) == brute(rows)


def test_empty_table(spark):
    assert jaccard.jaccard_components(documents(spark, [])).count() == 0


def test_connected(spark):
    draw = random.Random(4)
    edges = [(draw.randrange(60), draw.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    from wattle.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    got = {r["node"]: r["root"] for r in jaccard.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for node, root in got.items():
        seen, todo = {node}, [node]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        assert root == min(seen)


def test_rounds_of_connected_are_few_and_small_plans(spark, monkeypatch):
    """The driver holds each round's plan, and something of each stage: edges
    are read four times a round, once for the result, and no round follows stars."""
    from wattle.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    kind, reads = type(spark.range(0)), []
    checkpoint = kind.checkpoint

    def noted(df, *args):
        reads.append(df._jdf.queryExecution().optimizedPlan().collectLeaves().size())
        return checkpoint(df, *args)

    monkeypatch.setattr(kind, "checkpoint", noted)

    def roots(pairs):
        reads.clear()
        return {tuple(r) for r in jaccard.connected(spark.createDataFrame(pairs, "a long, b long")).collect()}

    assert roots([(3, 1), (1, 2), (9, 7), (5, 5)]) == {(1, 1), (2, 1), (3, 1), (7, 7), (9, 7)}
    assert reads == [1, 1]
    assert roots([(i, i + 1) for i in range(20)] + [(30, 29), (30, 28)]) == {(i, 0) for i in range(21)} | {
        (i, 28) for i in (28, 29, 30)}
    assert len(reads) > 2 and max(reads) <= 4
    assert roots([(4, 4)]) == set()
