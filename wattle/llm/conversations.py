"""Conversation structure repair: the cheapest edits that turn the roles of a
conversation into an optional system turn and pairs of user and assistant.

Hirschberg's divide and conquer over four states (nothing yet, after system,
after user, after assistant): a forward vector from the left and a backward
vector from the right meet in the middle, the audit-least of the cheapest
crossings is taken, and both halves go on alone. Vectors hold four costs and
the order of the four least audits that lead to them, never the audits.

A row's effect is a 4 x 4 matrix of (cost, order), and matrices compose. So a
conversation of any size is cut where the range partitions cut it: each
partition composes its rows, the conversation's few partition matrices are
crossed first, and each partition then solves its rows between known states.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattle.functions.joins import null_safe_join
from wattle.llm.textkit import ship_package, stored

# Fixed values of the edits.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
# States, the initials that lead on, and the states in which a conversation may end.
STATES, START, ENDS = 4, 0, (0, 3)
STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ROLES = {"u": "user", "a": "assistant"}
PAIRS = frozenset(("su", "ua", "au"))
# Faults of a row, in the order in which the first one counts.
SOUND, BLANK, DUPLICATE, CUT = range(4)

Vector = tuple[tuple[int, int] | None, ...]   # (cost, order among the four) for each state
Matrix = tuple[Vector, ...]                   # a vector for each state to come from
Item = tuple[Matrix, int]                     # a row or a run of rows: matrix, and a cost that all ways have
Costs = tuple[int | None, ...]
UNIT: Matrix = tuple(tuple((0, 0) if s == t else None for t in range(STATES)) for s in range(STATES))


def _inserts() -> list[list[tuple[int, str]]]:
    """For each state, the states that inserts reach: how many, and their roles."""
    out = []
    for s in range(STATES):
        found, at, roles = {s: ""}, s, ""
        while True:
            role = "a" if at == 2 else "u"
            at, roles = STEPS[at][role], roles + role
            if at in found:
                break
            found[at] = roles
        out.append([(t, r) for t, r in found.items()])
    return out


INSERTS = _inserts()


@lru_cache(maxsize=None)
def row_edits(initial: str, fault: int) -> tuple[tuple[tuple[int, str, str] | None, ...], ...]:
    """[from][to]: cost, audit and roles written by the cheapest way (ties:
    ASCII-least) to put inserts before a row and edit it; None if there is none.

    The row's own edit ends the audit, so no audit is a beginning of another
    one, and what comes first decides between two of them."""
    may = fault not in (BLANK, DUPLICATE)
    more = TRUNCATED if fault == CUT else 0
    table = []
    for s in range(STATES):
        best: list[tuple[int, str, str] | None] = [None] * STATES

        def offer(t: int, way: tuple[int, str, str]) -> None:
            if best[t] is None or way < best[t]:
                best[t] = way

        for mid, roles in INSERTS[s]:
            cost, audit = INSERT * len(roles), "I" * len(roles)
            offer(mid, (cost + DELETE, audit + "D", roles))
            if may and initial in STEPS[mid]:
                offer(STEPS[mid][initial], (cost + KEEP + more, audit + "K", roles + initial))
            if may:
                for role in ROLES:
                    if role in STEPS[mid]:
                        offer(STEPS[mid][role], (cost + REROLE + more, audit + "R", roles + role))
        table.append(tuple(best))
    return tuple(table)


@lru_cache(maxsize=None)
def row_matrix(initial: str, fault: int) -> Matrix:
    out = []
    for ways in row_edits(initial, fault):
        order = sorted((w[1], t) for t, w in enumerate(ways) if w)
        rank = {t: i for i, (_, t) in enumerate(order)}
        out.append(tuple((w[0], rank[t]) if w else None for t, w in enumerate(ways)))
    return tuple(out)


@lru_cache(maxsize=1 << 16)
def _advance(vector: Vector, matrix: Matrix) -> Vector:
    reached: list[tuple[int, int, int] | None] = [None] * STATES
    for s, have in enumerate(vector):
        if have is None:
            continue
        for t, way in enumerate(matrix[s]):
            if way is None:
                continue
            offer = (have[0] + way[0], have[1], way[1])
            if reached[t] is None or offer < reached[t]:
                reached[t] = offer
    order = sorted((r[1:], t) for t, r in enumerate(reached) if r)
    rank = {t: i for i, (_, t) in enumerate(order)}
    return tuple((r[0], rank[t]) if r else None for t, r in enumerate(reached))


def forward(vector: Vector, item: Item) -> Vector:
    """The vector after one more item. Least costs are taken out before the
    step, so few different steps exist and are remembered."""
    matrix, extra = item
    least = min(v[0] for v in vector if v)
    bare = _advance(tuple((v[0] - least, v[1]) if v else None for v in vector), matrix)
    return tuple((v[0] + least + extra, v[1]) if v else None for v in bare)


@lru_cache(maxsize=1 << 16)
def _retreat(costs: Costs, matrix: Matrix) -> Costs:
    out = []
    for row in matrix:
        sums = [w[0] + c for w, c in zip(row, costs, strict=True) if w is not None and c is not None]
        out.append(min(sums) if sums else None)
    return tuple(out)


def backward(costs: Costs, item: Item) -> Costs:
    """Costs from each state before an item to the end that ``costs`` describe."""
    matrix, extra = item
    least = min(c for c in costs if c is not None)
    bare = _retreat(tuple(None if c is None else c - least for c in costs), matrix)
    return tuple(None if c is None else c + least + extra for c in bare)


def crossing(left: Vector, right: Costs) -> int:
    """The state in which the cheapest ways meet, by the audit-least of them."""
    return min((v[0] + c, v[1], s) for s, (v, c) in enumerate(zip(left, right, strict=True))
               if v is not None and c is not None)[2]


def states_between(items: list[Item], start: int, end: Costs) -> list[int]:
    """The state after each item on the cheapest, audit-least way from
    ``start``; ``end``: the cost that each last state still brings.

    Hirschberg: linear space, since a half keeps nothing but its two states."""
    out = [0] * len(items)
    todo = [(0, len(items), start, end)]
    while todo:
        lo, hi, first, last = todo.pop()
        if lo == hi:
            continue
        mid = hi if hi - lo == 1 else (lo + hi) // 2
        ahead = UNIT[first]
        for i in range(lo, mid):
            ahead = forward(ahead, items[i])
        behind = last
        for i in range(hi - 1, mid - 1, -1):
            behind = backward(behind, items[i])
        state = crossing(ahead, behind)
        out[mid - 1] = state
        fixed = tuple(0 if s == state else None for s in range(STATES))
        if mid - lo > 1:
            todo.append((lo, mid, first, fixed))
        if mid < hi:
            todo.append((mid, hi, state, last))
    return out


# What the end of a conversation costs in each state, and the roles inserted for it.
TAIL = tuple(min((r for t, r in INSERTS[s] if t in ENDS), key=len) for s in range(STATES))
TAIL_COST = tuple(INSERT * len(r) for r in TAIL)


def row_items(initial: str, fault: int, copies: int) -> list[Item]:
    """A row and its further copies, which are all deleted: of m deletions and
    some inserts, the least audit deletes m - 1 times first, so one item stands
    for all of them."""
    may = fault not in (BLANK, DUPLICATE)
    items: list[Item] = [(row_matrix(initial, fault), 0)] if may else []
    rest = copies - 1 if may else copies
    return [*items, (row_matrix("-", DUPLICATE), DELETE * (rest - 1))] if rest else items


def run_items(run: dict) -> list[Item]:
    return [i for row in zip(run["initials"], run["faults"], run["copies"], strict=True) for i in row_items(*row)]


def compose(items: list[Item]) -> Matrix:
    """The matrix of a run of items."""
    out = []
    for s in range(STATES):
        v = UNIT[s]
        for item in items:
            v = forward(v, item)
        out.append(v)
    return tuple(out)


def written(run: dict, states: list[int], start: int) -> Iterator[tuple[str, int | None, str]]:
    """(edits, row, role initial written) for every row of a run, and for every
    insert before it; ``states``: those after each item. Row None: inserted;
    role "": deleted; role "=": kept as it is."""
    at = iter(states)
    for i, (initial, fault, copies) in enumerate(zip(run["initials"], run["faults"], run["copies"], strict=True)):
        may = fault not in (BLANK, DUPLICATE)
        for first in ([True] if may else []) + [False] * (copies > may):
            state = next(at)
            _, audit, roles = row_edits(initial if first else "-", fault if first else DUPLICATE)[start][state]
            start = state
            inserts = audit.count("I")
            if not first and copies > may + 1:
                yield "D" * (copies - may - 1), i, ""
            for role in roles[:inserts]:
                yield "I", None, role
            edit = audit[-1]
            yield edit, i, "" if edit == "D" else "=" if edit == "K" else roles[-1]


# ---- in Spark

# Rows of one conversation that one record of a range partition holds at most.
PIECE = 1 << 16
_KEYS = ["conv_id", "turn", "role", "sha"]
_WHITE = "\x20\x09\x0a\x0b\x0c\x0d"

_PIECE = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int64()), ("piece", pa.int64()),
    # for solving
    ("initials", pa.list_(pa.string())), ("faults", pa.list_(pa.int32())), ("copies", pa.list_(pa.int64())),
    ("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("shas", pa.list_(pa.binary())),
    # for crossing the pieces of a conversation
    ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())),
    ("n_turns", pa.int64())])
PIECE_SCHEMA = ("conv_id long, part long, piece long, initials array<string>, faults array<int>, "
                "copies array<long>, turns array<long>, roles array<string>, shas array<binary>, "
                "costs array<long>, ranks array<long>, counts array<long>, n_turns long")
_NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_CROSS = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("piece", pa.int64()), ("first", pa.int64()),
                    ("last", pa.int64()), ("tail", pa.string()), *[(c, pa.int64()) for c in _NUMBERS]])
CROSS_SCHEMA = "conv_id long, part long, piece long, first long, last long, tail string, " + ", ".join(
    f"{c} long" for c in _NUMBERS)
EDIT_SCHEMA = ("conv_id long, part long, piece long, at long, edits string, wrote string, turn long, role string, "
               "sha binary")
_EDIT = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("piece", pa.int64()), ("at", pa.int64()),
                   ("edits", pa.string()), ("wrote", pa.string()), ("turn", pa.int64()), ("role", pa.string()),
                   ("sha", pa.binary())])
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text with faults by crc32 of ``conv_id:turn``
    modulo 20: 0 drops a row, 1 empties its text, 2 takes its ``.!?`` away, 3
    repeats it, 4 makes its role user. A null is one space, in the hashed text
    as in role and text; conv_id and turn themselves stay null."""
    key = F.concat(*[F.coalesce(F.col(c).cast("long").cast("string"), F.lit(" ")) if c else F.lit(":")
                     for c in ("conv_id", "", "turn")])
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                       *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")], (F.crc32(key) % 20).alias("h"))
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.where("h <> 0").select(
        "conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(F.array_repeat(F.lit(1), F.when(F.col("h") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")]).withColumn("sha", F.unhex(F.sha2("text", 256)))


def judged(rows: DataFrame) -> DataFrame:
    """One row for each different row: its keys, how many copies it has and the
    fault of the first one. Whether it was seen earlier is a question to the
    least turn of its role and text, asked by all four keys: these are unique,
    so a text that fills a third of a conversation is not one join key."""
    bare = F.rtrim(F.col("text"), F.lit(_WHITE))
    rows = rows.withColumns({"blank": bare == "", "cut": ~F.substring(bare, -1, 1).isin(".", "!", "?")})
    rows = rows.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("copies"), F.bool_or("blank").alias("blank"),
                                    F.bool_or("cut").alias("cut"))
    least = rows.groupBy("conv_id", "role", "sha").agg(
        F.min("turn").alias("turn"), F.bool_or(F.col("turn").isNull()).alias("none"))
    least = least.select("conv_id", "role", "sha", F.when(~F.col("none"), F.col("turn")).alias("turn"),
                         F.lit(True).alias("new"))
    fault = F.when(F.col("blank"), BLANK).when(F.col("new").isNull(), DUPLICATE).when(
        F.col("cut"), CUT).otherwise(SOUND)
    return null_safe_join(rows, least, _KEYS, "left").select(*_KEYS, "copies", fault.cast("int").alias("fault"))


def _numbers(run: dict) -> tuple[list[int], int]:
    """Rows, blank, duplicate, truncated and illegal of a run, and its turns."""
    faults, copies = np.array(run["faults"]), np.array(run["copies"])
    blank = int(copies[faults == BLANK].sum())
    repeats = int(copies[faults == DUPLICATE].sum() + (copies - 1)[(faults == SOUND) | (faults == CUT)].sum())
    initials = run["initials"]
    illegal = int((copies - 1).sum()) + sum(a + b not in PAIRS for a, b in zip(initials, initials[1:], strict=False))
    turns = [t for t in run["turns"] if t is not None]
    distinct = len(turns[:1]) + sum(a != b for a, b in zip(turns, turns[1:], strict=False))
    return [int(copies.sum()), blank, repeats, int((faults == CUT).sum()), illegal], distinct


def cut_runs(most: int) -> Callable:
    """Sorted rows of a range partition to one record for each run of a
    conversation of at most ``most`` rows, for mapInArrow."""
    names = ("turns", "roles", "shas", "copies", "faults")

    def record(run: dict) -> dict:
        run["initials"] = [r[:1] if r[:1] in ("s", "u", "a") else "-" for r in run["roles"]]
        flat = [way for row in compose(run_items(run)) for way in row]
        counts, n_turns = _numbers(run)
        return {**run, "costs": [w[0] if w else -1 for w in flat], "ranks": [w[1] if w else -1 for w in flat],
                "counts": counts, "n_turns": n_turns}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run: dict = {}
        for batch in batches:
            out = []
            for conv, part, *values in zip(*[batch.column(i).to_pylist() for i in range(7)], strict=True):
                if run and (run["conv_id"] != conv or len(run["turns"]) >= most):
                    out.append(record(run))
                    run = {"piece": run["piece"] + 1 if run["conv_id"] == conv else 0}
                if len(run) < 2:
                    run = {"piece": 0, **run, "conv_id": conv, "part": part, **{n: [] for n in names}}
                for name, value in zip(names, values, strict=True):
                    run[name].append(value)
            if out:
                yield pa.RecordBatch.from_pylist(out, _PIECE)
        if run:
            yield pa.RecordBatch.from_pylist([record(run)], _PIECE)

    return cut


def cross_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The states between the pieces of each conversation (rows sorted by
    conv_id, part and piece), and its numbers on its last piece."""

    def solved(pieces: list[dict]) -> list[dict]:
        items = []
        for p in pieces:
            ways = [None if c < 0 else (c, r) for c, r in zip(p["costs"], p["ranks"], strict=True)]
            least = min(w[0] for w in ways if w)
            ways = [w and (w[0] - least, w[1]) for w in ways]
            items.append((tuple(tuple(ways[s * STATES:(s + 1) * STATES]) for s in range(STATES)), least))
        states = states_between(items, START, TAIL_COST)
        out, start, cost = [], START, 0
        for p, item, state in zip(pieces, items, states, strict=True):
            cost += item[0][start][state][0] + item[1]
            out.append({"conv_id": p["conv_id"], "part": p["part"], "piece": p["piece"], "first": start, "last": state})
            start = state
        counts = [sum(c) for c in zip(*[p["counts"] for p in pieces], strict=True)]
        counts[-1] += sum(a["end"] + b["begin"] not in PAIRS for a, b in zip(pieces, pieces[1:], strict=False))
        turned = [p for p in pieces if p["high"] is not None]
        gaps = 0
        if turned:
            distinct = sum(p["n_turns"] for p in turned) - sum(
                a["high"] == b["low"] for a, b in zip(turned, turned[1:], strict=False))
            gaps = turned[-1]["high"] - turned[0]["low"] + 1 - distinct
        out[-1] |= dict(zip(_NUMBERS, (gaps, *counts[1:], cost + TAIL_COST[start]), strict=True))
        out[-1]["tail"] = TAIL[start]
        return out

    pieces: list[dict] = []
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if pieces and pieces[0]["conv_id"] != row["conv_id"]:
                out += solved(pieces)
                pieces = []
            pieces.append(row)
        if out:
            yield pa.RecordBatch.from_pylist(out, _CROSS)
    if pieces:
        yield pa.RecordBatch.from_pylist(solved(pieces), _CROSS)


def write_edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every edit of a piece between its two known states, in order. An insert
    and the end of a conversation get keys that no text has and that differ."""
    for batch in batches:
        for run in batch.to_pylist():
            fixed = tuple(0 if s == run["last"] else None for s in range(STATES))
            states = states_between(run_items(run), run["first"], fixed)
            out = []

            def put(edits: str, i: int | None, wrote: str) -> None:
                own = {"turn": len(out), "role": "", "sha": b""}
                if i is not None and wrote:
                    own = {"turn": run["turns"][i], "role": run["roles"][i], "sha": run["shas"][i]}
                    wrote = run["roles"][i] if wrote == "=" else ROLES[wrote]
                elif wrote:
                    wrote = ROLES[wrote]
                out.append({"conv_id": run["conv_id"], "part": run["part"], "piece": run["piece"], "at": len(out),
                            "edits": edits, "wrote": wrote or None, **own})

            for edits, i, wrote in written(run, states, run["first"]):
                put(edits, i, wrote)
            for role in run["tail"] or "":
                put("I", None, role)
            if out:
                yield from pa.Table.from_pylist(out, _EDIT).to_batches(max_chunksize=10_000)


def digest_conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted edits to the audit and the digest of each conversation; texts
    pass by and are not held."""
    schema = pa.schema([("conv_id", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    conv, audit, digest, lines = None, [], None, 0
    for batch in batches:
        out = []
        for c, edits, wrote, text in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
            if digest is None or c != conv:
                if digest is not None:
                    out.append({"conv_id": conv, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()})
                conv, audit, digest, lines = c, [], hashlib.sha256(), 0
            audit.append(edits)
            if wrote is not None:
                digest.update(f"{chr(10) if lines else ''}{wrote}:{text or ''}".encode())
                lines += 1
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
    if digest is not None:
        yield pa.RecordBatch.from_pylist(
            [{"conv_id": conv, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}], schema)


def plan_repair(rows: DataFrame, piece_rows: int = PIECE) -> tuple[DataFrame, DataFrame]:
    """The pieces of all conversations, and their crossings with the numbers
    of each conversation (null but on its last piece); both stored."""
    ship_package(rows.sparkSession)
    order = [F.col(c) for c in _KEYS]
    dealt = judged(_keyed(rows)).repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = dealt.select("conv_id", F.spark_partition_id().cast("long").alias("part"), "turn", "role", "sha",
                         "copies", "fault")
    pieces = stored(dealt.mapInArrow(cut_runs(piece_rows), PIECE_SCHEMA), "conversation-pieces")
    ends = {"begin": F.element_at("initials", 1), "end": F.element_at("initials", -1),
            "low": F.array_min("turns"), "high": F.array_max("turns")}
    own = ["conv_id", "part", "piece"]
    met = pieces.select(*own, "costs", "ranks", "counts", "n_turns", *[c.alias(n) for n, c in ends.items()])
    met = met.repartition("conv_id").sortWithinPartitions(*own)
    return pieces, stored(met.mapInArrow(cross_pieces, CROSS_SCHEMA), "conversation-states")


def repaired_rows(rows: DataFrame, pieces: DataFrame, states: DataFrame) -> DataFrame:
    """conv_id, part, piece and at (their order), edits, wrote (the role, null
    if deleted) and text of every edit."""
    own = ["conv_id", "part", "piece"]
    both = null_safe_join(pieces, states, own).select(
        *own, "initials", "faults", "copies", "turns", "roles", "shas", "first", "last", "tail")
    edits = both.mapInArrow(write_edits, EDIT_SCHEMA)
    texts = _keyed(rows).select(*_KEYS, "text").distinct()
    return null_safe_join(edits, texts, _KEYS, "left").select(*own, "at", "edits", "wrote", "text")


def repair_conversations(rows: DataFrame, piece_rows: int = PIECE) -> DataFrame:
    """One row for each conv_id of ``rows``: gaps, blank, duplicate, truncated,
    illegal, cost, audit and repaired_sha256.

    Rows stand by turn, nulls first; rows that share a turn by role, then by
    the sha256 of their text, and equal rows side by side. A null role or text
    is one space (so the role has to change, and the text is blank), a null
    conv_id is a conversation of its own. gaps is 0 where all turns are null.
    An empty table gives no rows. Other columns are ignored, whatever their
    names. Digest and audit of a conversation are inherently sequential: one
    task reads its repaired texts as a stream and holds none of them.
    """
    pieces, states = plan_repair(rows, piece_rows)
    order = ["conv_id", "part", "piece", "at"]
    stream = repaired_rows(rows, pieces, states).repartition("conv_id").sortWithinPartitions(*order)
    digests = stream.select("conv_id", "edits", "wrote", "text").mapInArrow(
        digest_conversations, "conv_id long, audit string, repaired_sha256 string")
    numbers = states.where("cost is not null").select("conv_id", *_NUMBERS)
    return null_safe_join(numbers, digests, ["conv_id"])


def repair_damaged(rows: DataFrame, piece_rows: int = PIECE) -> DataFrame:
    """``repair_conversations`` of the damaged rows, with zeros, an empty audit
    and the digest of nothing for a conversation that lost all its rows."""
    known = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    found = repair_conversations(damage(rows), piece_rows)
    return null_safe_join(known, found, ["conv_id"], "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in _NUMBERS],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(EMPTY_SHA)).alias("repaired_sha256"))
