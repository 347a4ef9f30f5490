"""Merkle manifest of a dataset: one leaf for each row, a tree for each source,
and one tree over the sources' roots.

Rows are numbered inside their source by a range partitioning, and every
aligned block of 256 nodes keeps a level of its tree as one hex string.
Substrings of fixed width are what a parent hashes, and the substrings left
and right of a node are its siblings. The blocks' roots are the nodes of the
next round, so a source of any size is spread over blocks, and n nodes take
log256(n) rounds. No task holds more than a block of one tree at a time.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattle.functions.joins import null_safe_join
from wattle.llm.textkit import stored

# Nodes that share a parent, hex digits of a node.
FANOUT, WIDTH = 16, 64
RUN = FANOUT * WIDTH
# Nodes of a block: two levels of the tree.
BLOCK = FANOUT * FANOUT
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_ROW_BITS = 33  # of monotonically_increasing_id, below the partition's number


def field(value: Column) -> Column:
    """One input of a leaf: its size in bytes, a colon and the value; ``-`` for null."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def tampered_text(text: Column) -> Column:
    """The text with A-Z in lower case; nulls stay."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows in ``order`` (nulls first) with ``part``, the range partition
    they fall into, and ``at``, their place in it. Stored, since a second
    range partitioning could cut elsewhere."""
    out = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    out = out.withColumn("at", F.monotonically_increasing_id()).withColumns({
        "part": F.shiftright("at", _ROW_BITS), "at": F.col("at").bitwiseAND((1 << _ROW_BITS) - 1)})
    return stored(out, "merkle-order")


def runs_of(rows: DataFrame, group: list[str]) -> DataFrame:
    """For each (part, group) of numbered rows: ``n``, and ``shift``, what
    turns ``at`` into the place in the group. One row for each partition that a
    group reaches into."""
    runs = rows.groupBy("part", *group).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).drop("first")


def blocks_of(nodes: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Blocks of nodes (tree, pos, n, node): tree, block, n, ``nodes`` in
    order, ``low`` and ``high`` (the block's two levels, each as one string)
    and ``top`` (its root). A tree of one node has no level, one of up to
    FANOUT nodes has one."""
    one = F.struct("pos", "node", *carry)
    rows = nodes.groupBy("tree", F.floor(F.col("pos") / BLOCK).alias("block")).agg(
        F.max("n").alias("n"), F.array_sort(F.collect_list(one)).alias("nodes"))
    low = F.array_join("nodes.node", "")
    rows = rows.withColumn("low", low)
    steps = F.sequence(F.lit(0), F.floor((F.size("nodes") - 1) / FANOUT).cast("int"))
    parents = F.transform(steps, lambda i: F.sha2(F.substring("low", i * RUN + 1, F.lit(RUN)), 256))
    rows = rows.withColumn("high", F.when(F.col("n") > 1, F.array_join(parents, "")).otherwise(""))
    top = F.when(F.col("n") == 1, F.col("low")).when(F.col("n") <= FANOUT, F.col("high")).otherwise(F.sha2("high", 256))
    return rows.withColumn("top", top)


_NO_PATH = "array<struct<left:string,right:string>>"


def own_path(pos: Column) -> Column:
    """Siblings of a block's node, lower level first."""
    at = F.pmod(pos, F.lit(BLOCK)).cast("int")
    run = F.floor(at / FANOUT).cast("int")

    def flanks(level: str, first: Column, place: Column) -> Column:
        row = F.substring(level, first * WIDTH + 1, F.lit(RUN))
        return F.struct(F.substring(row, F.lit(1), place * WIDTH).alias("left"),
                        F.substring(row, (place + 1) * WIDTH + 1, F.lit(RUN)).alias("right"))

    lower = flanks("low", run * FANOUT, at - run * FANOUT)
    upper = flanks("high", F.lit(0), run)
    return (F.when(F.col("n") == 1, F.array().cast(_NO_PATH))
            .when(F.col("n") <= FANOUT, F.array(lower)).otherwise(F.array(lower, upper)))


def climb(nodes: DataFrame, carry: tuple[str, ...] = ()) -> list[DataFrame]:
    """Blocks of every round, stored: the roots of a round's blocks are the
    nodes of the next, until every tree is down to one block."""
    rounds = [stored(blocks_of(nodes, carry), "merkle-blocks")]
    largest = rounds[0].agg(F.max("n")).first()[0] or 0
    while largest > BLOCK:
        largest = -(-largest // BLOCK)
        above = rounds[-1].where(F.col("n") > BLOCK).select(
            "tree", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("top").alias("node"))
        rounds.append(stored(blocks_of(above), "merkle-blocks"))
    return rounds


def tree_roots(rounds: list[DataFrame]) -> DataFrame:
    """tree and root."""
    done = [r.where(F.col("n") <= BLOCK).select("tree", F.col("top").alias("root")) for r in rounds]
    return reduce(DataFrame.unionByName, done)


def with_paths(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """The first round's blocks with ``path``, the siblings of the block's
    root up to the top. ``above``: tree, path and further columns of the tree."""
    kept = ["tree", "path", *[c for c in above.columns if c not in ("tree", "path")]]
    higher: DataFrame | None = None
    for blocks in reversed(rounds):
        out = blocks.where(F.col("n") <= BLOCK).join(above.select(*kept), "tree")
        if higher is not None:
            more = higher.select("tree", F.explode("below").alias("one"), *kept[2:]).select(
                "tree", F.col("one.pos").alias("block"), F.col("one.path").alias("path"), *kept[2:])
            out = out.unionByName(blocks.where(F.col("n") > BLOCK).join(more, ["tree", "block"]))
        higher = out.withColumn("below", F.transform("nodes", lambda x: F.struct(
            x["pos"].alias("pos"), F.concat(own_path(x["pos"]), F.col("path")).alias("path"))))
    return higher.drop("below")


def proof(path: Column) -> Column:
    """Digest of all siblings, left to right and level by level."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(path: Column, node: Column) -> Column:
    """The root that a node and its siblings give."""
    return F.aggregate(path, node, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def sources_of(runs: DataFrame) -> DataFrame:
    """source, tree (its place in the order, null first) and ``size``."""
    sizes = runs.groupBy("source").agg(F.sum("n").alias("size"))
    ordered = numbered(sizes, ["source"])
    shift = runs_of(ordered, []).drop("n")
    return ordered.join(shift, "part").select("source", "size", (F.col("at") + F.col("shift")).alias("tree"))


def merkle_manifest(docs: DataFrame, tamper: Column | None = None) -> DataFrame:
    """One row for each input row: doc_id, leaf, subroot, root, proof_sha256,
    folded_root and verified.

    A leaf hashes doc_id, source, lang, n_chars and text. Leaves ascend by
    doc_id inside their source, a null doc_id first; rows that share one
    ascend by leaf, and rows equal in all fields can't be told apart. A null
    source is a source of its own, before all others. ``tamper`` (default: 5
    divides crc32 of the decimal doc_id, so never for a null one) tells whose
    text is lower-cased before folded_root is recomputed; a null text stays
    null. An empty table gives no rows. A source of one row is its own
    subroot, and a manifest of one row has no siblings (the digest of the
    empty string). Other columns are ignored, whatever their names.
    """
    if tamper is None:
        tamper = F.crc32(F.col("doc_id").cast("long").cast("string")) % 5 == 0
    fields = {c: F.col(c) for c in FIELDS} | {"doc_id": F.col("doc_id").cast("long")}
    other = leaf_hash(*(fields | {"text": tampered_text(F.col("text"))}).values())
    # The only pass over the texts. ``row`` sets rows of one key apart, so that
    # copies of one row fall into several ranges.
    leaves = stored(docs.select(
        fields["doc_id"].alias("doc_id"), "source", leaf_hash(*fields.values()).alias("node"),
        F.when(tamper, other).alias("changed"), F.monotonically_increasing_id().alias("row")), "merkle-leaves")
    rows = numbered(leaves, ["source", "doc_id", "node", "row"])
    runs = runs_of(rows, ["source"])
    sources = stored(sources_of(runs), "merkle-sources")
    runs = null_safe_join(runs.drop("n"), sources, ["source"])
    nodes = null_safe_join(rows, runs, ["part", "source"]).select(
        "tree", (F.col("at") + F.col("shift")).alias("pos"), F.col("size").alias("n"), "node", "changed", "doc_id")
    rounds = climb(nodes, ("changed", "doc_id"))

    # The same over the sources' roots: one tree, numbered 0.
    upper = climb(tree_roots(rounds).select(
        F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"),
        F.lit(sources.count()).cast("long").alias("n"), F.col("root").alias("node")))
    top = tree_roots(upper).select("tree", F.col("root").alias("top_root"))
    whole = with_paths(upper, top.withColumn("path", F.array().cast(_NO_PATH)))
    above = whole.select("top_root", F.inline(F.transform("nodes", lambda x: F.struct(
        x["pos"].alias("tree"), x["node"].alias("subroot"), F.concat(own_path(x["pos"]), F.col("path")).alias("path")))))

    found = with_paths(rounds, above).withColumn("found", F.transform(
        F.transform("nodes", lambda x: F.struct(
            x.alias("x"), F.concat(own_path(x["pos"]), F.col("path")).alias("path"))),
        lambda y: F.struct(
            y["x"]["doc_id"].alias("doc_id"), y["x"]["node"].alias("leaf"), proof(y["path"]).alias("proof_sha256"),
            folded(y["path"], F.coalesce(y["x"]["changed"], y["x"]["node"])).alias("folded_root"))))
    return found.select("subroot", F.col("top_root").alias("root"), F.inline("found")).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"))
