"""Conversation repair against a dynamic programme that holds all audits."""

import random
import re
import zlib

import pytest
from helpers import sha

from wattle.llm import conversations as conv

NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
NAMES = {"u": "user", "a": "assistant"}
SCHEMA = "conv_id long, turn long, role string, text string, part long, piece int, cost string, at long"


def damaged(rows):
    out = []
    for c, t, r, x in rows:
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if h == 0:
            continue
        x = "" if h == 1 else re.sub("[.!?]", "", x) if h == 2 else x
        out += [(c, t, "user" if h == 4 else r, x)] * (2 if h == 3 else 1)
    return out


def brute(rows):
    """All numbers of one conversation's rows."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), sha(r[3])))
    seen, faults = set(), []
    for _, _, r, x in rows:
        bare = x.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (r, x) in seen else
                      "truncated" if bare[-1] not in ".!?" else "")
        seen.add((r, x))
    turns = {r[1] for r in rows if r[1] is not None}
    ways = {0: (0, "", ())}

    def offer(into, state, way):
        if state not in into or way[:2] < into[state][:2]:
            into[state] = way

    def inserted(ways):
        for _ in range(4):
            for s, (cost, audit, lines) in list(ways.items()):
                for role in NAMES:
                    if role in NEXT[s]:
                        offer(ways, NEXT[s][role], (cost + 2, audit + "I", (*lines, NAMES[role] + ":")))
        return ways

    def every(ways):
        """All ways with up to three inserts behind them, since audits that tie
        with the cheapest may part only later."""
        out = [(s, w) for s, w in ways.items()]
        for s, w in list(out):
            for _ in range(3):
                role = next(r for r in NAMES if r in NEXT[s])
                s, w = NEXT[s][role], (w[0] + 2, w[1] + "I", (*w[2], NAMES[role] + ":"))
                out.append((s, w))
        return out

    for (_, _, r, x), fault in zip(rows, faults, strict=True):
        new = {}
        for s, (cost, audit, lines) in every(ways):
            offer(new, s, (cost + 3, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            more = fault == "truncated"
            if r[:1] in NEXT[s]:
                offer(new, NEXT[s][r[:1]], (cost + more, audit + "K", (*lines, f"{r}:{x}")))
            for role in NAMES:
                if role in NEXT[s]:
                    offer(new, NEXT[s][role], (cost + 2 + more, audit + "R", (*lines, f"{NAMES[role]}:{x}")))
        ways = new
    cost, audit, lines = min((w for s, w in every(ways) if s in (0, 3)), key=lambda w: w[:2])
    pairs = [a[2][:1] + b[2][:1] for a, b in zip(rows, rows[1:], strict=False)]
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha("\n".join(lines)))


def expected(rows, damage=True):
    all_ = {r[0] for r in rows}
    left = damaged(rows) if damage else rows
    out = {}
    for c in all_:
        mine = [r for r in left if r[0] == c]
        out[c] = brute(mine) if mine else (0, 0, 0, 0, 0, 0, "", sha(""))
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, 9, 8, "c", 7) for r in rows], SCHEMA)


def got(df):
    cols = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r[c] for c in cols) for r in rows}


def random_rows(seed, conversations, longest):
    draw = random.Random(seed)
    rows = []
    for c in range(conversations):
        for t in range(draw.randint(1, longest)):
            role = draw.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None])
            text = draw.choice(["Hello.", "Yes", "No!", "Why?\n", " \t", "", None, "Été.", "中", f"t{t}."])
            rows.append((c, draw.choice([t, t, t, t + 1, None]), role, text))
    return rows


@pytest.mark.parametrize("piece_rows", [conv.PIECE, 3, 1])
def test_repair_matches_brute_force(spark, piece_rows):
    rows = random_rows(4, 120, 9) + [(None, 0, "user", "Hi."), (None, None, None, None), (None, 1, "assistant", "Ha.")]
    assert got(conv.repair_damaged(table(spark, rows), piece_rows)) == expected(rows)


@pytest.mark.parametrize("piece_rows", [conv.PIECE, 16])
def test_long_conversation_and_copies(spark, piece_rows):
    rows = random_rows(5, 1, 1) + random_rows(6, 3, 400)
    rows += [(1, 7, "user", "copy.")] * 90 + [(1, None, "assistant", " ")] * 40 + [(2, 5, "user", "x. " * 60_000)] * 3
    rows += [(3, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(300)]
    assert got(conv.repair_conversations(table(spark, [
        (c, t, r or " ", x or "") for c, t, r, x in rows]), piece_rows)) == expected(
        [(c, t, r or " ", x or "") for c, t, r, x in rows], damage=False)


def test_empty_and_fully_dropped(spark):
    assert conv.repair_damaged(table(spark, [])).count() == 0
    gone = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    assert got(conv.repair_damaged(table(spark, [(5, gone, "user", "x")]))) == {5: (0, 0, 0, 0, 0, 0, "", sha(""))}


def test_repaired_rows_are_well_formed(spark):
    rows = table(spark, random_rows(7, 40, 12))
    pieces, states = conv.plan_repair(rows, 4)
    lines = conv.repaired_rows(rows, pieces, states).orderBy("conv_id", "part", "piece", "at").collect()
    by = {}
    for r in lines:
        if r.wrote is not None:
            by.setdefault(r.conv_id, []).append(r.wrote[:1])
    assert all(re.fullmatch("(s?(ua)+)?", "".join(v)) for v in by.values())


def test_hirschberg_equals_the_whole_table():
    draw = random.Random(8)
    for _ in range(300):
        rows = [(draw.choice("sua-"), draw.randrange(4), draw.choice([1, 1, 1, 2, 5])) for _ in range(draw.randint(1, 9))]
        items = [i for r in rows for i in conv.row_items(*r)]
        states = conv.states_between(items, conv.START, conv.TAIL_COST)
        cut = draw.randint(0, len(items))
        halves = [(conv.compose(part), 0) for part in (items[:cut], items[cut:]) if part]
        assert conv.states_between(halves, conv.START, conv.TAIL_COST)[-1] == states[-1]
