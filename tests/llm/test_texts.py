"""Decontamination, tokens, secrets, toxicity."""

import json
import random
import re
import struct
import time
import unicodedata
import zlib

import public_tokenizers
import pytest
import regex
from helpers import LOWER, documents, sha
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wattle.llm import bpe, decontaminate, secret_scan, toxicity

KEPT = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(text, items, width=10):
    words = KEPT.findall((text or "").translate(LOWER))
    hit, found = [False] * len(words), set()
    for item, t in items:
        w = KEPT.findall((t or "").translate(LOWER))
        size = min(width, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            for k in range(len(words) - size + 1):
                if words[k:k + size] == w[i:i + size]:
                    hit[k:k + size] = [True] * size
                    found.add(str(item))
    return len(words), sum(hit), len(found), sha(",".join(sorted(found))), any(hit)


def leaky(seed=1):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)] + ["É", "ña", "7"]
    items = [(i, " ".join(draw.choice(vocabulary) for _ in range(draw.choice([0, 2, 5, 12, 30])))) for i in range(12)]
    items += [(12, None), (13, "!!!"), (2, items[2][1])]
    docs = []
    for i in range(40):
        own = [draw.choice(vocabulary) for _ in range(draw.randint(0, 40))]
        text = " ".join(own)
        if i % 3 == 0:
            text += "..." + (items[draw.randrange(12)][1] or "").upper().replace(" ", ", ") + "; " + " ".join(own)
        docs.append((i, text))
    return items, docs + [(100, None), (101, ""), docs[3], (None, docs[3][1])]


@pytest.mark.parametrize("part", [1 << 20, 40])
def test_decontamination_matches_brute_force(spark, part):
    items, docs = leaky()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminate(documents(spark, docs), bench, part_bytes=part).collect()
    assert len(got) == len(docs)
    if part == 40:  # put together by document, in no order
        got, docs = sorted(got, key=lambda r: str(r.doc_id)), sorted(docs, key=lambda d: str(d[0]))
    for r, (d, t) in zip(got, docs):
        assert (r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (d, *brute_hits(t, items))
        inside = [KEPT.findall((t or "").translate(LOWER)[s.start:s.end]) for s in r.spans]
        assert sum(map(len, inside)) == r.n_hit


def test_decontamination_in_parts_carries_columns(spark):
    items, docs = leaky(5)
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = documents(spark, docs)
    whole, parts = (decontaminate.decontaminate(table, bench, part_bytes=n, carry=("text", "key", "spans")).collect()
                    for n in (1 << 20, 1500))
    assert sorted(map(repr, whole)) == sorted(map(repr, parts))
    assert {(r.carried.key, r.carried.spans) for r in parts} == {("k", "s")}


def test_decontamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(documents(spark, []), none).count() == 0
    assert not decontaminate.decontaminate(documents(spark, [(1, "a b")]), none).first().contaminated


def test_unassigned_code_points_equal_the_library():
    """Every code point that one of the tables at hand calls a letter or a
    number and another one doesn't know, and some that none knows."""
    path = public_tokenizers.path("word_bpe_49k.json")
    library, ours = Tokenizer.from_file(path), bpe.Vocabulary(json.load(open(path, encoding="utf-8")))
    letter = regex.compile(r"[\p{L}\p{N}]")
    unknown = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) == "Cn"]
    odd = [c for c in unknown if letter.match(c)] + unknown[::997] + list("\ue000\u0558\U000191a1\U00010d50\ua7cb")
    assert len(odd) > 15_000
    for i in range(0, len(odd), 500):
        text = " ".join(f"a{c}b1{c}!{c}" for c in odd[i:i + 500])
        assert ours.encode(text)[1] == struct.pack(f"<{len(ids := library.encode(text, add_special_tokens=False).ids)}I",
                                                   *ids)


def test_tokens_equal_the_library(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    draw = random.Random(2)
    letters = list("abcXYZ'’ \t\n\x0b\x1c\x1f\x85\xa0\u2003\u200béÉΣσςİſ中文½١!?.,<|>_-😀\u0301") + [
        "<|endoftext|>", "'ll", " the "]
    rows = [(i, "".join(draw.choice(letters) for _ in range(draw.randint(0, 50)))) for i in range(300)]
    rows += [(400, None), (401, ""), (402, "x" * 5000 + " y"), (403, "".join(draw.choice("abcd") for _ in range(900)))]
    got = bpe.encode_texts(documents(spark, rows), path, with_ids=True).collect()
    for r, (_, t) in zip(got, rows):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids) == (len(ids), ids)
        assert r.ids_sha256 == sha(struct.pack(f"<{len(ids)}I", *ids))
        text = library.decode(ids, skip_special_tokens=False)
        assert (r.decoded, r.decoded_sha256) == (text, sha(text))


def test_short_and_long_merges_agree():
    v = bpe.Vocabulary(json.load(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8")))
    draw = random.Random(3)
    for _ in range(300):
        ids = [v.inner[draw.choice(b"abenorst")] for _ in range(draw.randint(1, 40))]
        assert bpe.merge_short(ids, v.rank, v.made) == bpe.merge_long(ids, v.rank, v.made)


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
HEX40 = "0123456789abcdef0123456789abcdef01234567"


def base_spans(t):
    t = t or ""
    a = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    b = [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    c = [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    order = ["assign", "access", "hex"]
    return a, b, c, ",".join(f"{k}:{x}:{y}" for k, x, y in sorted(a + b + c, key=lambda s: (s[1], order.index(s[0]))))


def test_secrets(spark):
    gh = "ghp_" + "a1B2" * 9
    rows = [(1, f'é😀 token = "{HEX40}" x', "a"), (2, "password: short, api_key=abcdef12 token=token:abcdefgh", "a"),
            (3, "AKIA" + "Z9" * 8 + " AKIAXY", "b"), (4, None, "b"), (5, "", None), (6, f"see {gh}.", "a"),
            (7, f"ſecret=abcdefgh K {HEX40[:23]} SECRET='Q+/=-_.'", "b"), (8, gh, "a"), (1, f'é😀 token = "{HEX40}" x', "a"),
            (9, "ghp_" + "z9Y8" * 9, "a"), (10, "ghp_" + "z9Y8" * 9, "b"), (None, f"passwd={HEX40}", "c")]
    got = secret_scan.scan_secrets(documents(spark, rows)).collect()
    by = {(r.doc_id, r.n_assign, r.base_sha256): r for r in got}
    assert len(got) == len(rows)
    for d, t, _ in rows:
        a, b, c, s = base_spans(t)
        r = by[d, len(a), sha(s)]
        assert (r.n_access, r.n_hex) == (len(b), len(c))
        assert set(s.split(",")) <= set(r.spans.split(",")) or not s
    spans = {r.doc_id: r.spans for r in got}
    assert spans[6] == "github:4:44" and spans[8] == "github:0:40"  # one owner's own
    assert spans[9] == spans[10] == ""  # the same value of two owners
    assert secret_scan.scan_secrets(documents(spark, [])).count() == 0


def test_redaction(spark):
    rows = [(1, f'é token = "{HEX40}" x', "a"), (2, "nothing", "a"), (3, None, "a"), (4, f"{HEX40} and {HEX40}", "b"),
            (None, f"passwd={HEX40}", "c"), (2, "nothing", "a")]
    docs = documents(spark, rows)
    got = secret_scan.redact(docs)
    assert got.columns == docs.columns
    texts = sorted((r.doc_id or 0, r.text or "", r.n_chars) for r in got.collect())
    assert texts == [(0, "[SECRET]", 8), (1, 'é [SECRET]" x', 13), (2, "nothing", 7), (2, "nothing", 7), (3, "", 0),
                     (4, "[SECRET] and [SECRET]", 21)]


def test_two_levels_of_ownership(spark):
    """A value in many different texts of one owner is boilerplate; in many
    copies of one text it is that owner's own."""
    often, own = "ghp_" + "q1W2" * 9, "ghp_" + "e3R4" * 9
    rows = [(i, f"text {i} {often}", "a") for i in range(60)] + [(100 + i, f"one text {own}", "a") for i in range(60)]
    got = {r.doc_id: r for r in secret_scan.scan_secrets(documents(spark, rows)).collect()}
    assert all(got[i].spans == "" and (got[i].n_live, got[i].n_copied) == (0, 1) for i in range(60))
    assert all(got[100 + i].spans == "github:9:49" for i in range(60))
    few = secret_scan.scan_secrets(documents(spark, rows), most_repositories=60).collect()
    assert all(r.spans for r in few)


def test_many_matches_in_one_text(spark):
    """Blocks of matches: spans and redaction as in plain Python, in linear time."""
    draw = random.Random(6)
    parts = ["é", " ", f"token={HEX40}", HEX40, "AKIA" + "Z9" * 8, "password: abc", "中文 ", "secret = 'longenough'", "\n"]
    text = " ".join(draw.choice(parts) for _ in range(12_000))
    rows = [(1, text, "a"), (2, " ".join([HEX40] * 129), "a"), (3, " ".join([HEX40] * 128), "b")]
    docs = documents(spark, rows).withColumn("found_spans_of_row", F.lit("mine"))
    start = time.time()
    got = {r.doc_id: r for r in secret_scan.scan_secrets(docs).collect()}
    clean = {r.doc_id: r for r in secret_scan.redact(docs).collect()}
    assert time.time() - start < 60
    for d, t, _ in rows:
        a, b, c, s = base_spans(t)
        assert (got[d].n_assign, got[d].n_access, got[d].n_hex) == (len(a), len(b), len(c))
        assert got[d].base_sha256 == sha(s)
        out, at = [], 0
        for x, y in sorted((int(p.split(":")[1]), int(p.split(":")[2])) for p in s.split(",")):
            if x >= at:
                out += [t[at:x], "[SECRET]"]
            at = max(at, y)
        want = "".join(out) + t[at:]
        assert clean[d].text == want and clean[d].n_chars == len(want) and clean[d].found_spans_of_row == "mine"


def test_redaction_of_copied_secrets(spark):
    gh, jwt = "ghp_" + "z9Y8" * 9, "eyJ" + "a1B2" * 4 + "." + "c3D4" * 4 + "." + "e5F6" * 4
    more = [gh, jwt, "Bearer " + "q7-R" * 6, "xoxb-" + "1a2B" * 5, "0123456789ABCDEF" * 2]
    rows = [(10 * i + j, f"é {t} in {j}", src) for i, t in enumerate(more) for j, src in enumerate(("a", "b", "c", "c"))]
    got = secret_scan.redact(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.text == f"é [SECRET] in {r.doc_id % 10}" and r.n_chars == len(r.text)


def test_proven_examples_stay(spark):
    """A value of several sources and many texts is an example; of several
    sources, or in many texts of one, it may be a secret. Base kinds all go."""
    example, two, one = "ghp_" + "q1W2" * 9, "ghp_" + "e3R4" * 9, "xoxb-" + "t5Y6" * 5
    rows = [(i, f"{i} use {example} or {HEX40}", "ab"[i % 2]) for i in range(51)]
    rows += [(100 + i, f"{i} has {two}", "ab"[i % 2]) for i in range(49)]
    rows += [(200 + i, f"{i} has {one}", "a") for i in range(60)]
    rows += [(300, f"both {example} {two}", "c"), (0, f"0 use {example} or {HEX40}", "a"), (301, None, None)]
    docs = documents(spark, rows)
    got = {r.doc_id: r.text for r in secret_scan.redact(docs).collect()}
    assert all(got[i] == f"{i} use {example} or [SECRET]" for i in range(51))
    assert all(got[100 + i] == f"{i} has [SECRET]" for i in range(49))
    assert all(got[200 + i] == f"{i} has [SECRET]" for i in range(60))
    assert got[300] == f"both {example} [SECRET]" and not got[301]
    assert secret_scan.redact(docs).count() == len(rows)
    assert secret_scan.redact(docs).columns == docs.columns


def labelled(spark, seed=4, count=900):
    draw = random.Random(seed)
    plain = [f"word{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(count):
        words = [draw.choice(plain) for _ in range(40)]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                words[draw.randrange(40)] = draw.choice(["zorgel", "zorgen", "idiot", "blarg"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    labels += [(None, 1, 1), (3, None, None), (9999, 0, 1)]
    return rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark):
    rows, labels = labelled(spark)
    rows += [(1600, None), (1601, ""), (None, "you idiot"), (rows[0][0], rows[0][1])]
    got = toxicity.score_documents(documents(spark, rows), labels).collect()
    assert len(got) == len(rows)
    for r, (d, _) in zip(got, rows):
        assert r.held_out == (d is not None and zlib.crc32(str(d).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
        if d is not None and d < 900:
            assert r.predicted == (d % 5 == 0)
    assert len({r.score for r in got if r.doc_id in (1600, 1601)}) == 1


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.score_documents(documents(spark, [(1, "you are a stupid idiot, moron"), (2, "fine")]), none).collect()
    assert got[0].score > got[1].score
    assert toxicity.score_documents(documents(spark, []), none).count() == 0


def test_a_lone_word_weighs_less_than_an_aimed_clause(spark):
    """Also after training on texts that hold words without any target."""
    rows, labels = labelled(spark)
    entries, weights = toxicity.train(documents(spark, rows), labels)
    said = ["take out the trash", "You are an idiot", "he said trash", "never trash", "Ich werde dich töten.",
            "Je vais te tuer.", "Voy a matarte, te lo digo.", "I will kill you", "nothing at all", "a very long text " * 20000]
    got = [r.score for r in toxicity.score_texts(documents(spark, list(enumerate(said))), entries, weights).collect()]
    assert got[1] > got[0] >= max(got[2:4])
    assert min(got[4], got[5], got[7]) >= 0.7 and got[6] > got[8] == got[9]


def test_clause_kinds():
    lexicon = toxicity.Lexicon({"=idiot": 1.0})

    def kind(text):
        x = toxicity.clause_features(text, lexicon)
        return {k for k, v in zip(toxicity.KINDS, x) if v}

    assert kind("an idiot") == {"insult_plain"}
    assert kind("an idiot you") == {"insult_aimed"}
    assert kind("never an idiot") == {"insult_negated"}
    assert kind("never mind. an idiot") == {"insult_plain"}
    assert kind("he said idiot") == {"insult_reported"}
    assert kind("kill you, fine") == {"threat_aimed"}
    assert kind("nothing here") == set()
