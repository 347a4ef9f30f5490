"""Personal data against the plain patterns of the base kinds."""

import random
import re
import time

from helpers import documents, sha

from wattle.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def digits(s):
    return re.sub("[^0-9]", "", s)


def brute(text):
    tests = [("email", EMAIL, lambda s: True),
             ("ip", IP, lambda s: all(int(p) <= 255 for p in s.split("."))),
             ("card", CARD, lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
             ("phone", PHONE, lambda s: 9 <= len(digits(s)) <= 15)]
    return [(k, *m.span()) for k, p, ok in tests for m in p.finditer(text or "") if ok(m.group())]


def check(spark, rows):
    got = pii.find_personal_data(documents(spark, rows), mask=True).collect()
    assert len(got) == len(rows)
    for r, (d, t) in zip(got, rows, strict=True):
        base = brute(t)
        assert r.doc_id == d
        for kind in ("email", "ip", "card", "phone"):
            assert r[f"n_{kind}"] == sum(b[0] == kind for b in base)
        assert r.base_sha256 == sha(",".join("%s:%d:%d" % b for b in base))
        spans = [tuple(s.split(":")) for s in r.spans.split(",") if s]
        assert [s for s in spans if s[0] in ("email", "ip", "card", "phone")] == [(k, str(a), str(b)) for k, a, b in base]
        assert r.n_added == len(spans) - len(base) == len(r.found) - len(base)
    return got


def test_base_kinds_match_brute_force(spark):
    draw = random.Random(3)
    pieces = ["a.b+c@d-e.fr", "@", "@@", "x@y", "x@y.z_w@q.r", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "007.0.0.255",
              "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111112", "5500005555555559", "0" * 13, "0" * 25,
              "+1 (017) 555-7713", "+12", "+1 2", "+1 . ( )", "+123456789012345", "+1234567890123456", "é", "\n", " ", ".",
              "-", "12", "foo", "中文", "%", "_", "a@b..c", "a@b.c.", "+1  555", "\t"]
    rows = [(i, "".join(draw.choice(pieces) + draw.choice(["", "", " "]) for _ in range(draw.randint(0, 14))))
            for i in range(400)]
    rows += [(900, None), (901, ""), (None, "mail a@b.cd now"), rows[3], rows[3]]
    check(spark, rows)


def test_checksums_and_context_add_spans(spark):
    rows = [(1, "IBAN GB82 WEST 1234 5698 7654 32 THE END"), (2, "IBAN GB82 WEST 1234 5698 7654 33"),
            (3, "my ssn is 123-45-6789."), (4, "part 123-45-6789."), (5, "ssn 000-45-6789"),
            (6, "She was born on 1980-02-29 in Rome"), (7, "released 1980-02-29"),
            (8, "order 4111 1111 1111 1111"), (9, "card 4111 1111 1111 1111")]
    got = {r.doc_id: r for r in check(spark, rows)}
    assert got[1].spans == "iban:5:32" and got[1].masked == "IBAN [IBAN] THE END"
    assert got[2].spans == "" and got[2].masked == rows[1][1]
    assert (got[3].spans, got[4].spans, got[5].spans) == ("ssn:10:21", "", "")
    assert (got[6].spans, got[7].spans) == ("birthdate:16:26", "")
    assert got[8].found[0].score < got[9].found[0].score
    assert got[9].masked == "card [CARD]"


def test_overlapping_spans_are_one_mark():
    assert pii.masked("abcdefgh", [("ip", 1, 4, 1.0), ("card", 3, 6, 1.0)]) == "a[IP]gh"


def test_long_runs_stay_linear():
    start = time.time()
    for text in ("a" * 2_000_000, "1" * 2_000_000, "1." * 1_000_000, "@" * 1_000_000, "+1" + " " * 2_000_000,
                 "+" * 1_000_000, "A1" * 1_000_000, "1 " * 1_000_000, "a@b" * 500_000):
        pii.personal_spans(text)
    assert time.time() - start < 60


def test_empty_table_and_carried_columns(spark):
    assert pii.find_personal_data(documents(spark, [])).count() == 0
    one = pii.find_personal_data(documents(spark, [(1, "x")]), carry=("spans", "doc")).first()
    assert (one.spans, one.carried.spans, one.carried.doc) == ("", "s", "d")
