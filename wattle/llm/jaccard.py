"""N-gram Jaccard join: documents whose sets of word shingles agree in three
quarters of their union, and the components that these links make.

A size-aware heavy-light join. Each shingle meets its copies in a bucket and
learns how many different sets hold it; a set can only be linked if three
quarters of its shingles are shared, so all others are done. Of the rest, a
set's rarest shared shingles are its signature, ordered by frequency over the
corpus. Small sets are joined on all pairs of signature shingles (subsets of a
fixed size), large ones by scanning the inverted list of each signature
shingle; the boundary is the size at which the two cost the least together.

Links inside a component that is already known add nothing to the result, so
a first round links each set to the leader of its least shingles, and the
signature join then only proposes pairs between different components. A group
of many near copies thus costs about one comparison a member.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattle.llm import textkit
from wattle.llm.windows import MAP_SCHEMA, NO_ID, UNIT_BYTES, _HOME, _MAP, HOME_SCHEMA, by_value, pack, rows_of, take, unpack
from wattle.session import ensure_checkpoint_dir, scratch_path

WORDS = 5
BUCKET_BYTES = 8 << 20
LEADS = 3  # least shingles of a set by which the first round looks for a leader

TOKEN = (("tok", 6), ("set", 8))
DOC = (("doc", 8), ("key", 8), ("set", 8), ("n", 4))
SHARED = (("set", 8), ("tok", 6), ("df", 3))
MOST_DF = (1 << 23) - 1

NODE_SCHEMA = "kind int, doc long, key long, set long, n long, toks array<long>"
_NODE = [("kind", pa.int32()), ("doc", pa.int64()), ("key", pa.int64()), ("set", pa.int64()), ("n", pa.int64()),
         ("toks", pa.list_(pa.int64()))]


def shingle_sets(raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted different shingles of each text as 48-bit hashes."""
    raw = textkit.lower_ascii(raw)
    starts, ends, first = textkit.word_spans(raw, offsets, textkit.space_words())
    hashed = textkit.prefix_hash(textkit.span_hash(textkit.byte_prefix_hash(raw), starts, ends))
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if a == b:
            out.append(np.empty(0, np.int64))
            continue
        at = np.arange(a, max(a + 1, b - WORDS + 1))
        out.append(np.unique(textkit.span_hash(hashed, at, np.minimum(at + WORDS, b)) & np.uint64(0xFFFFFFFFFFFF))
                   .astype(np.int64))
    return out


def set_id(shingles: np.ndarray) -> int:
    """One number for a set, whatever the order of its shingles; 0: empty."""
    if not len(shingles):
        return 0
    total = int(textkit.mix(shingles.astype(np.uint64) * textkit.STEP).sum(dtype=np.uint64)) + len(shingles)
    return (int(textkit.mix(np.array([total % (1 << 64)], dtype=np.uint64))[0]) & (1 << 63) - 1) or 1


def send_shingles(buckets: int) -> Callable:
    """Shingles of the different sets of a unit, and its documents."""

    def flush(docs: list[tuple], sets: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows = []
        if sets:
            x = {"tok": np.concatenate(list(sets.values())),
                 "set": np.repeat(np.array(list(sets), np.int64), [len(s) for s in sets.values()])}
            rows += [(b, 0, len(y["tok"]), pack(TOKEN, y)) for b, y in by_value(x, x["tok"] % buckets)]
        d = dict(zip(("doc", "key", "set", "n"), np.array(docs, dtype=np.int64).T, strict=True))
        rows += [(b, 1, len(y["doc"]), pack(DOC, y)) for b, y in by_value(d, d["set"] % buckets)]
        yield from rows_of(rows, _MAP).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, sets, size = [], {}, 0
        for batch in batches:
            raw, offsets = textkit.buffers(batch.column(1))
            ids, keys = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for i, j in textkit.slices(offsets):
                found = shingle_sets(raw[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                for doc, key, shingles in zip(ids[i:j], keys[i:j], found, strict=True):
                    number = set_id(shingles)
                    docs.append((doc, key, number, len(shingles)))
                    if number:
                        sets[number] = shingles
                size += int(offsets[j] - offsets[i])
                if size >= UNIT_BYTES:
                    yield from flush(docs, sets)
                    docs, sets, size = [], {}, 0
        if docs:
            yield from flush(docs, sets)
        del docs, sets
        textkit.give_back()

    return run


def count_sets(buckets: int) -> Callable:
    """Shingles of a bucket that several sets hold go to the sets' homes."""

    def run(table: pa.Table) -> pa.Table:
        kind, blobs, counts = np.array(table["kind"]), table["blob"].to_pylist(), table["n"].to_pylist()
        mine = np.flatnonzero(kind == 0)
        x = unpack(TOKEN, [blobs[i] for i in mine], [counts[i] for i in mine])
        order = np.lexsort((x["set"], x["tok"]))
        x = take(x, order)
        if len(order):
            again = np.zeros(len(order), dtype=bool)
            again[1:] = (x["tok"][1:] == x["tok"][:-1]) & (x["set"][1:] == x["set"][:-1])
            x = take(x, ~again)
        new = np.ones(len(x["tok"]), dtype=bool)
        new[1:] = x["tok"][1:] != x["tok"][:-1]
        group = np.cumsum(new) - 1
        x["df"] = np.minimum(np.bincount(group)[group], MOST_DF) if len(group) else x["tok"]
        x = take(x, x["df"] > 1)
        x = take(x, np.argsort(x["set"], kind="stable"))
        rows = [(h, 0, len(y["set"]), pack(SHARED, y)) for h, y in by_value(x, x["set"] % buckets)]
        rows += [(table["bucket"][int(i)].as_py(), 1, counts[i], blobs[i]) for i in np.flatnonzero(kind == 1)]
        return rows_of(rows, _HOME)

    return run


def least_shared(n):
    """Shingles that a set of n must share with another to be linked."""
    return (3 * n + 3) // 4


def find_nodes(table: pa.Table) -> pa.Table:
    """Documents with their sets (kind 0), and the sets that may be linked
    with their shared shingles, rarest first (kind 1)."""
    kind, blobs, counts = np.array(table["kind"]), table["blob"].to_pylist(), table["n"].to_pylist()

    def of(k: int, fields) -> dict[str, np.ndarray]:
        return unpack(fields, [blobs[i] for i in np.flatnonzero(kind == k)],
                      [counts[i] for i in np.flatnonzero(kind == k)])

    docs, x = of(1, DOC), of(0, SHARED)
    rows = [(0, *row, None) for row in zip(*(docs[f].tolist() for f, _ in DOC), strict=True)]
    size = dict(zip(docs["set"].tolist(), docs["n"].tolist(), strict=True))
    x = take(x, np.lexsort((x["tok"], x["df"], x["set"])))
    for part in np.split(np.arange(len(x["set"])), np.flatnonzero(np.diff(x["set"])) + 1):
        if len(part):
            key = int(x["set"][part[0]])
            if len(part) >= least_shared(size[key]):
                rows.append((1, None, None, key, size[key], x["tok"][part]))
    return rows_of(rows, _NODE)


def verified(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked."""
    both = pairs
    for side in ("a", "b"):
        both = both.join(nodes.select(F.col("set").alias(side), F.col("n").alias(f"n_{side}"),
                                      F.col("toks").alias(f"t_{side}")), side)
    common = F.size(F.array_intersect("t_a", "t_b"))
    return both.where(100 * common >= 75 * (F.col("n_a") + F.col("n_b") - common)).select("a", "b")


def star_round(edges: DataFrame) -> DataFrame:
    """One large and one small star of edges (u, v), u > v. Each edge counts
    once: of a node's neighbours only those below it can be less than itself,
    and the edge to a node's least neighbour is the one with v = m."""
    least = edges.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
    large = edges.join(least, "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
    down = large.groupBy("u").agg(F.min("v").alias("m"))
    return large.join(down, "u").select(
        F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()


def all_stars(edges: DataFrame) -> bool:
    """Whether each u has one edge and is no other edge's v, so that rounds
    change nothing; counted by node before the shuffle."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")),
                                          F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("end"))
    held = ends.groupBy("end.node").agg(F.sum("end.up").alias("up"), F.count(F.lit(1)).alias("edges"))
    return held.where("up > 0 and edges > 1").agg(F.count(F.lit(1))).first()[0] == 0


def connected(edges: DataFrame) -> DataFrame:
    """node and root (the component's least node) of all nodes with edges, by
    alternating large and small stars; every round is checkpointed, and so is
    the result, which several plans read: the driver holds small plans, and
    few, since each of their stages takes its memory too."""
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = edges.checkpoint()
    while not all_stars(edges):
        edges = star_round(edges).checkpoint()
    return edges.select(F.explode(F.array("u", "v")).alias("node"), F.col("v").alias("root")).distinct().checkpoint()


def leader_pairs(nodes: DataFrame) -> DataFrame:
    """Each set with the leader of its least shingles: of the sets that hold
    one, that with the fewest shingles of its own, which is nearest to what a
    group of copies has in common."""
    least = nodes.select("set", (F.col("n") - F.size("toks")).alias("own"),
                         F.explode(F.slice(F.array_sort("toks"), 1, LEADS)).alias("tok"))
    lead = least.groupBy("tok").agg(F.min(F.struct("own", "set"))["set"].alias("a"))
    return least.join(lead, "tok").where("set <> a").select(
        F.least("a", "set").alias("a"), F.greatest("a", "set").alias("b")).distinct()


def boundary(live: DataFrame) -> int:
    """The size up to which sets count as small: of the powers of two, the one
    with the least cost, subsets of the small plus list entries that the large
    scan. ``live``: n, sig and scan (entries of its lists) of each set."""
    costs = live.groupBy(F.ceil(F.log2("n")).alias("size")).agg(
        F.sum(F.col("sig") * (F.col("sig") + 1) / 2).alias("light"), F.sum("scan").alias("heavy")).collect()
    by = {r["size"]: (r["light"], r["heavy"]) for r in costs}
    return min((sum(c[0] if s <= x else c[1] for s, c in by.items()), 1 << x) for x in range(0, 64))[1]


def within_reach(a: str, b: str) -> Column:
    """Sizes that allow a link, and shared shingles enough from the common one on."""
    n_a, n_b = F.col(f"{a}.n"), F.col(f"{b}.n")
    left = F.least(F.col(f"{a}.left"), F.col(f"{b}.left"))
    return (4 * n_a >= 3 * n_b) & (4 * n_b >= 3 * n_a) & (7 * left >= 3 * (n_a + n_b))


def outside_largest(keys: DataFrame) -> DataFrame:
    """The entries of each key that aren't in the component which holds most
    of its entries, with the number of all; counted before any shuffle."""
    held = keys.groupBy("key", "root").agg(F.count(F.lit(1)).alias("held"))
    by_key = held.groupBy("key").agg(F.max_by("root", F.struct("held", "root")).alias("largest"),
                                     F.count(F.lit(1)).alias("roots"), F.sum("held").alias("entries"))
    spread = by_key.where("roots > 1").select("key", "largest", "entries")
    return keys.join(spread, "key").where("root <> largest").drop("largest")


def proposed(few: DataFrame, keys: DataFrame, keep: Column) -> DataFrame:
    """Pairs of different components that share a key. Of two such sets one at
    least is outside the key's largest component, so only ``few``, the entries
    there, look through the lists."""
    return few.alias("x").join(keys.alias("y"), "key").where(
        (F.col("x.root") != F.col("y.root")) & within_reach("x", "y") & keep).select(
        F.least("x.set", "y.set").alias("a"), F.greatest("x.set", "y.set").alias("b")).distinct()


def signature_pairs(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs of different components that the signatures propose: sets that are
    linked share a signature shingle, small ones a pair of them."""
    shared, need = F.size("toks"), F.expr("(3 * n + 3) div 4")
    signed = nodes.join(roots.withColumnRenamed("node", "set"), "set", "left").select(
        "set", "n", "toks", F.coalesce("root", "set").alias("root"), shared.alias("shared"),
        (shared - need + 1).cast("int").alias("sig"))
    # left: shared shingles of the set from this one on, in the common order.
    lists = signed.select("set", "root", "n", "shared", "sig", F.posexplode(F.expr("slice(toks, 1, sig)")).alias(
        "at", "key")).withColumn("left", F.col("shared") - F.col("at"))
    few = outside_largest(lists).checkpoint()
    scans = few.groupBy("set").agg(F.sum("entries").alias("scan"))
    edge = boundary(signed.join(scans, "set", "left").select("n", "sig", F.coalesce("scan", F.lit(0)).alias("scan")))

    some_large = (F.col("x.n") > edge) | (F.col("y.n") > edge)
    tall = 4 * F.col("n") >= 3 * edge
    heavy = proposed(few.where(tall), lists.where(tall), some_large)
    small = signed.where((F.col("n") <= edge) & (F.col("n") > 1)).withColumn(
        "ranked", F.expr("transform(slice(toks, 1, sig + 1), (t, i) -> struct(t as t, i as i))"))
    ones = small.select("set", "root", "n", "shared", "ranked", F.explode("ranked").alias("one"))
    subsets = ones.select("set", "root", "n", "shared", "one", F.explode(F.expr(
        "filter(ranked, r -> r.i > one.i)")).alias("two")).select(
        "set", "root", "n", F.xxhash64("one.t", "two.t").alias("key"), (F.col("shared") - F.col("one.i")).alias("left"))
    light = proposed(outside_largest(subsets), subsets, F.lit(True))
    return heavy.unionByName(light).distinct()


def text_key(text: Column) -> Column:
    """Tells rows of one doc_id with unlike texts apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def linked_sets(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc (null ids as the largest), key (of the text), set and n of every
    row, and set and root of the sets that are linked with others."""
    spark = docs.sparkSession
    textkit.ship_package(spark)
    ensure_checkpoint_dir(spark)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(16, -(-total // BUCKET_BYTES))
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NO_ID))).alias("doc"),
                        F.coalesce("text", F.lit("")).alias("text"), text_key(F.col("text")).alias("key"))
    sent = texts.mapInArrow(send_shingles(buckets), MAP_SCHEMA)
    counted = sent.groupBy("bucket").applyInArrow(count_sets(buckets), HOME_SCHEMA)
    path = scratch_path(spark, "shingles")
    textkit.write_table(counted.groupBy("home").applyInArrow(find_nodes, NODE_SCHEMA), path)
    known = spark.read.schema(NODE_SCHEMA).parquet(path)
    rows = known.where("kind = 0").select("doc", "key", "set", "n")
    # A set of many documents is one node.
    nodes = known.where("kind = 1").select("set", "n", "toks")

    roots = connected(verified(leader_pairs(nodes), nodes))
    more = verified(signature_pairs(nodes, roots), nodes).checkpoint()
    if not more.isEmpty():
        roots = connected(more.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    return rows, roots.withColumnRenamed("node", "set")


def least_of_roots(rows: DataFrame, roots: DataFrame, least: Column) -> tuple[DataFrame, DataFrame]:
    """set and root of all sets that have shingles, and root and ``least`` over
    its rows: first by set, before the shuffle and the join."""
    by_set = rows.where("set <> 0").groupBy("set").agg(least.alias("least")).join(roots, "set", "left").withColumn(
        "root", F.coalesce("root", "set"))
    return by_set.select("set", "root"), by_set.groupBy("root").agg(F.min("least").alias("least"))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (least doc_id reachable by links,
    itself included) of each row; other columns are ignored, whatever their
    names.

    Null and empty texts and texts without words have 0 shingles and their own
    doc_id as component; a text of one to four words is one shingle. Rows with
    equal sets are linked, so repeated rows share a component; a null doc_id
    is larger than any other, and a component of such rows alone has a null
    id; an empty table gives no rows.
    """
    rows, roots = linked_sets(docs)
    sets, least = least_of_roots(rows, roots, F.min("doc"))
    by_set = sets.join(least, "root").select("set", F.col("least").alias("component"))
    out = rows.join(by_set, "set", "left").withColumn("component", F.coalesce("component", "doc"))
    null_id = F.lit(int(NO_ID))
    return out.select(F.when(F.col("doc") != null_id, F.col("doc")).alias("doc_id"), F.col("n").alias("n_shingles"),
                      F.when(F.col("component") != null_id, F.col("component")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the row
    of the least doc_id stays, of several the one with the least key of its
    text, and of rows that agree in both the least by its other columns.

    Rows without shingles are linked with nothing, so each different one stays;
    rows without a doc_id can't be told apart and all stay.
    """
    rows, roots = linked_sets(docs)
    rows = rows.where(F.col("doc") != F.lit(int(NO_ID)))
    _, first = least_of_roots(rows, roots, F.min(F.struct("doc", "key")))
    kept = first.select("least.doc", "least.key").unionByName(rows.where("set = 0").select("doc", "key"))
    kept = kept.withColumnsRenamed({"doc": "kept_doc", "key": "kept_key"}).distinct()
    known = docs.where(F.col("doc_id").isNotNull())
    marked = known.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast(
        "long").alias("kept_doc"), text_key(F.col("text")).alias("kept_key")).join(kept, ["kept_doc", "kept_key"], "left_semi")
    others = [F.col(f"row.`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    place = F.row_number().over(Window.partitionBy("kept_doc", "kept_key").orderBy(*(others or [F.lit(0)])))
    return marked.withColumn("place", place).where("place = 1").select("row.*").unionByName(
        docs.where(F.col("doc_id").isNull()))
