"""Suffix-array and suffix-automaton dedup against brute force."""

import random
from collections import Counter

import numpy as np
from helpers import WORDS, corpus, documents, repeated, sha

from wattle.llm import automaton_dedup, suffix_dedup


def runs(flags):
    return sum(1 for i, f in enumerate(flags) if f and not (i and flags[i - 1]))


def expected_bytes(rows, size=50):
    out = []
    for (d, t), flags in zip(rows, repeated(rows, lambda t: t.encode(), size)):
        data = (t or "").encode()
        out.append((d, len(data), sum(flags), runs(flags), sha(bytes(b for b, f in zip(data, flags) if not f))))
    return Counter(out)


def expected_words(rows, size=13):
    out = []
    for (d, t), flags in zip(rows, repeated(rows, lambda t: tuple(WORDS.findall(t)), size)):
        words = WORDS.findall(t or "")
        out.append((d, len(words), sum(flags), sha(" ".join(w for w, f in zip(words, flags) if not f))))
    return Counter(out)


def test_bytes_match_brute_force(spark):
    rows = corpus()
    got = suffix_dedup.remove_repeated_bytes(documents(spark, rows)).drop("kept").collect()
    assert Counter(map(tuple, got)) == expected_bytes(rows)


def test_words_match_brute_force(spark):
    rows = corpus(seed=8)
    got = automaton_dedup.remove_repeated_words(documents(spark, rows)).drop("kept").collect()
    assert Counter(map(tuple, got)) == expected_words(rows)


SMALL = {"common": 0, "unit_bytes": 1, "bucket_bytes": 500}


def test_small_buckets_units_and_common_anchors(spark):
    """Many buckets, one document a unit and every anchor dealt as common."""
    rows = corpus(seed=9, count=40, vocabulary=60)
    got = suffix_dedup.remove_repeated_bytes(documents(spark, rows), **SMALL).drop("kept").collect()
    assert Counter(map(tuple, got)) == expected_bytes(rows)
    got = automaton_dedup.remove_repeated_words(documents(spark, rows), **SMALL).drop("kept").collect()
    assert Counter(map(tuple, got)) == expected_words(rows)


def test_white_space_is_no_part_of_a_window(spark):
    """Twenty equal words with unlike blanks, apart and beside other words of one anchor."""
    words = [f"word{i}" for i in range(20)]
    rows = [(1, " ".join(words)), (2, "  ".join(words)), (3, "x \t" + "\n".join(words) + " y"),
            (4, " \x0b".join(words[3:17]) + " z")]
    for sizes in ({}, SMALL, {"common": 1}):
        got = automaton_dedup.remove_repeated_words(documents(spark, rows), **sizes).drop("kept").collect()
        assert Counter(map(tuple, got)) == expected_words(rows)


def test_very_common_anchor_without_small_sizes(spark):
    """More different documents around one anchor than ``COMMON``."""
    draw = random.Random(4)
    passage = [f"p{i}" for i in range(20)]
    other = [f"o{i}" for i in range(500)]

    def around(i, blank):
        head, tail = ([draw.choice(other) for _ in range(6)] for _ in range(2))
        return (i, blank.join([*head, *passage[4:16], *tail]))

    rows = [around(i, " ") for i in range(10, 2500)]
    rows += [(3000 + i, blank.join([*other[i:i + 9], *passage[3:17], *other[20 + i:29 + i]]))
             for i, blank in enumerate((" ", "  ", " \t ", "\n\n", " ", "   "))]
    got = automaton_dedup.remove_repeated_words(documents(spark, rows)).drop("kept").collect()
    assert Counter(map(tuple, got)) == expected_words(rows)


def test_empty_table_and_no_windows(spark):
    for f in (suffix_dedup.remove_repeated_bytes, automaton_dedup.remove_repeated_words):
        assert f(documents(spark, [])).count() == 0
        got = f(documents(spark, [(1, None), (2, "short"), (2, "short")])).orderBy("doc_id").collect()
        assert [r["n_removed"] for r in got] == [0, 0, 0]


def test_equal_groups_orders_suffixes():
    draw = random.Random(1)
    for alphabet in (b"a", b"ab", b"abcdefgh"):
        data = bytes(draw.choice(alphabet) for _ in range(600)) * 2
        starts = np.arange(len(data) - 50)
        order, group = suffix_dedup.equal_groups(data, starts, 50)
        keys = [data[s:s + 50] for s in starts[order].tolist()]
        assert keys == sorted(keys)
        assert [a == b for a, b in zip(keys, keys[1:])] == [a == b for a, b in zip(group, group[1:])]


def test_blind_trie_groups_equal_strings():
    draw = random.Random(2)
    items = [bytes(draw.choice(b"ab") for _ in range(6)) for _ in range(200)]
    trie = suffix_dedup.BlindTrie()
    for i, x in enumerate(items):
        trie.add(x, i)
    assert [items[g[0]] for g in trie.groups()] == sorted(set(items))
    assert all(len({items[i] for i in g}) == 1 for g in trie.groups())


def test_automaton_gives_least_documents():
    draw = random.Random(3)
    texts = [[draw.randrange(3) for _ in range(40)] for _ in range(12)]
    automaton = automaton_dedup.SuffixAutomaton()
    for doc, t in enumerate(texts):
        automaton.add(t, 100 - doc)
    automaton.close()
    for t in texts:
        want = [min(100 - d for d, o in enumerate(texts) if any(o[k:k + 4] == t[i:i + 4] for k in range(37)))
                for i in range(37)]
        assert automaton.least_docs(t, 4) == want
