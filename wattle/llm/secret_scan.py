"""Secret scans with corpus-wide ownership frequency, in DataFrame functions
only: candidates are hashed and counted by distinct owners (``source``), which
separates widely copied examples from live-looking credentials of one owner."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattle.functions.joins import dealt_join
from wattle.session import ensure_checkpoint_dir

# The base kinds, in the order of the list: pattern, group that holds the value, its least length.
ASSIGN = (r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|"
          r"[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
# A run of one class of characters is as long as it can be, so for the kinds
# that are such a run the least length stands in the pattern itself. An assignment
# that fails its length still uses up its text, so that one is dropped afterwards.
BASE = (("assign", ASSIGN, 1, 6), ("access", r"(AKIA[A-Z0-9]{16,})", 1, 20), ("hex", r"([0-9a-f]{24,})", 1, 24))
# Further candidates, kept only where the corpus shows them as one owner's own.
MORE = (
    ("github", r"(gh[opsur]_[A-Za-z0-9]{32,})", 1, 36),
    ("jwt", r"(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", 1, 30),
    ("bearer", r"[Bb]earer\x20+([A-Za-z0-9+/_.=~-]{20,})", 1, 20),
    ("slack", r"(xox[abprs]-[A-Za-z0-9-]{15,})", 1, 20),
    ("upperhex", r"([0-9A-F]{32,})", 1, 32),
)
KINDS = BASE + MORE


# Elements that one fold runs over: what it has built is copied at each step, so
# a fold over all matches of a long text would be quadratic.
BLOCK = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it is named."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def in_blocks(array: Column, measure: Callable[[Column], Column], add: Callable[[Column, Column], Column]) -> Column:
    """Array of (items, from): the array cut into blocks, each with ``measure``
    of all elements before it, put together by ``add`` from 0 on."""
    zero = F.lit(0).cast("long")

    def cut(whole: Column) -> Column:
        last = F.greatest(F.size(whole) - 1, F.lit(0))
        return F.transform(F.sequence(F.lit(0), F.floor(last / BLOCK).cast("int")),
                           lambda b: F.slice(whole, b * BLOCK + 1, F.lit(BLOCK)))

    def total(block: Column) -> Column:
        return F.aggregate(block, zero, lambda a, x: add(a, measure(x)))

    def before(totals: Column) -> Column:
        return F.transform(totals, lambda t, i: F.aggregate(F.slice(totals, F.lit(1), i), zero, lambda a, x: add(a, x)))

    return let(let(array, cut), lambda blocks: F.zip_with(
        blocks, let(F.transform(blocks, total), before),
        lambda items, start: F.struct(items.alias("items"), start.alias("from"))))


def matches(text: Column, kind: str, order: int, pattern: str, group: int, least: int) -> Column:
    """Array of (start, end, order, kind, value) of the leftmost non-overlapping
    matches whose value is long enough; code points, end exclusive.

    The pieces between matches and the matches themselves, in turn, make up
    the text, so running lengths of both give the offsets.
    """
    pieces = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    none = F.array().cast("array<struct<start:long,end:long,order:int,kind:string,value:string>>")

    def step(state: Column, one: Column) -> Column:
        begin = state["at"] + F.length(one["piece"])
        end = begin + F.length(one["whole"])
        span = F.struct(begin.alias("start"), end.alias("end"), F.lit(order).alias("order"),
                        F.lit(kind).alias("kind"), one["value"].alias("value"))
        kept = F.when(F.length(one["value"]) >= least, F.concat(state["out"], F.array(span))).otherwise(state["out"])
        return F.struct(end.alias("at"), kept.alias("out"))

    zipped = F.arrays_zip(F.slice(pieces, 1, F.size(whole)).alias("piece"), whole.alias("whole"),
                          value.alias("value"))
    blocks = in_blocks(zipped, lambda one: (F.length(one["piece"]) + F.length(one["whole"])).cast("long"),
                       lambda a, b: a + b)
    found = F.flatten(F.transform(blocks, lambda block: F.aggregate(
        block["items"], F.struct(block["from"].alias("at"), none.alias("out")), step, lambda s: s["out"])))
    # Most texts hold no value of the kind, and one search tells.
    return F.when(text.rlike(pattern), found).otherwise(none)


def span_text(spans: Column) -> Column:
    """kind:start:end by start, then order of kinds, joined by commas."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), s["order"].alias("order"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def row_key() -> Column:
    """Hash of doc_id, text and source: equal rows are one."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")), F.coalesce("source", F.lit("")))


def all_matches(text: Column) -> Column:
    """The matches of all kinds in one array."""
    return F.concat(*[matches(text, kind, i, *rest) for i, (kind, *rest) in enumerate(KINDS)])


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, key (tells texts of one doc_id apart), owner, repository (equal
    texts are copies of one) and ``found``, the matches of all kinds."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"),
        F.coalesce("source", F.lit("")).alias("owner"), F.xxhash64(text).alias("repository"),
        all_matches(text).alias("found"))


def ownership(found: DataFrame) -> DataFrame:
    """Owners and repositories of each value. Copies of a text are one
    repository of their owner; pairs are made distinct and counted by (value,
    owner) first, so that a value in a third of all rows is pre-aggregated
    before every shuffle."""
    one = found.select("owner", "repository", F.explode(F.array_distinct(F.transform(
        "found", lambda s: F.sha2(s["value"], 256)))).alias("value")).distinct()
    by_owner = one.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("held"))
    return by_owner.groupBy("value").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("held").alias("n_repositories"))


def scan_secrets(docs: DataFrame, most_owners: int = 1, most_repositories: int = 50) -> DataFrame:
    """One row for each input row: doc_id, the counts of the base kinds,
    base_sha256, spans, n_live, n_copied, ``live`` (the spans as structs) and
    key (a hash of doc_id, text and source).

    A value is live-looking if at most ``most_owners`` different sources hold
    it, in at most ``most_repositories`` different texts, and widely copied
    otherwise: one owner's boilerplate is no credential either. Base spans always stay; spans of the
    further kinds are added where their value is live. Null texts are empty
    and have no spans; null sources count as one owner; repeated rows count
    once as owners. Columns other than doc_id, text and source are ignored,
    whatever their names.
    """
    # One pass over the texts; what it finds is small and is read three times.
    ensure_checkpoint_dir(docs.sparkSession)
    found = candidates(docs).checkpoint()
    base = F.filter("found", lambda s: s["order"] < len(BASE))
    def count(order: int) -> Column:
        return F.size(F.filter("found", lambda s: s["order"] == order)).cast("long")

    own = found.select(
        "doc_id", "key", *[count(i).alias(f"n_{kind[0]}") for i, kind in enumerate(BASE)],
        F.sha2(span_text(base), 256).alias("base_sha256"), base.alias("base"))
    spread = ownership(found)
    values = found.select("key", F.explode("found").alias("s")).select(
        "key", "s", F.sha2(F.col("s.value"), 256).alias("value"))
    judged = values.join(spread, "value").withColumn("live", (F.col("n_owners") <= most_owners) & (F.col("n_repositories") <= most_repositories))
    more = judged.groupBy("key").agg(
        F.collect_set(F.when((F.col("s.order") >= len(BASE)) & F.col("live"), F.col("s"))).alias("more"),
        F.count_distinct(F.when(F.col("live"), F.col("value"))).alias("n_live"),
        F.count_distinct(F.when(~F.col("live"), F.col("value"))).alias("n_copied"))
    spans = F.concat("base", F.coalesce("more", F.array().cast(own.schema["base"].dataType)))
    return own.join(more, "key", "left").select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", span_text(spans).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
        spans.alias("live"), "key")


def examples(docs: DataFrame, most_owners: int = 1, most_repositories: int = 50) -> DataFrame:
    """key (see ``row_key``) and ``examples``: the hashes of the values of
    further kinds in that row which the corpus proves to be copied examples,
    held by more than ``most_owners`` sources and in more than
    ``most_repositories`` different texts. Rows without any are left out."""
    ensure_checkpoint_dir(docs.sparkSession)
    found = candidates(docs).checkpoint()
    copied = ownership(found).where((F.col("n_owners") > most_owners) & (F.col("n_repositories") > most_repositories))
    further = F.filter("found", lambda s: s["order"] >= len(BASE))
    held = found.select("key", F.explode(F.array_distinct(F.transform(further, lambda s: F.sha2(
        s["value"], 256)))).alias("value")).distinct()
    return dealt_join(held, copied.select("value"), ["value"]).groupBy("key").agg(
        F.collect_set("value").alias("examples"))


def redact(docs: DataFrame, mark: str = "[SECRET]", most_owners: int = 1, most_repositories: int = 50) -> DataFrame:
    """The rows with their secrets replaced by ``mark``: every match of the
    base kinds, and those of the further kinds save values that the counts of
    owners and repositories prove to be examples (see ``examples``). Being
    copied on one level alone, by a few sources or in many texts of one, is no
    proof. Matches that overlap are one. n_chars, where there is one, is
    counted anew for the texts that change; other columns stay as they are."""
    found, key, known = (f"{name} of {uuid.uuid4().hex}" for name in ("spans", "key", "examples"))  # no column of the caller's
    text = F.col("text")
    proven = examples(docs, most_owners, most_repositories).select(
        F.col("key").alias(key), F.col("examples").alias(known))
    rows = dealt_join(docs.withColumn(key, row_key()), proven, [key], "left")
    live = F.filter(all_matches(F.coalesce(text, F.lit(""))), lambda s: (s["order"] < len(BASE)) | ~F.array_contains(
        F.coalesce(F.col(f"`{known}`"), F.array().cast("array<string>")), F.sha2(s["value"], 256)))
    rows = rows.withColumn(found, F.array_sort(live))
    spans = F.col(f"`{found}`")

    def clean_block(block: Column) -> Column:
        """The text from where the blocks before it end to where it ends; only
        this part of the text is gone through for each span."""
        base = block["from"]
        stop = F.greatest(base, F.array_max(F.transform(block["items"], lambda s: s["end"])))
        part = F.substring(text, (base + 1).cast("int"), (stop - base).cast("int"))
        start = F.struct(base.alias("at"), F.lit("").alias("out"), part.alias("part"))

        def step(state: Column, s: Column) -> Column:
            gap = F.substring(state["part"], (state["at"] - base + 1).cast("int"), (s["start"] - state["at"]).cast("int"))
            fresh = F.concat(state["out"], gap, F.lit(mark))
            return F.struct(F.greatest(state["at"], s["end"]).alias("at"),
                            F.when(s["start"] >= state["at"], fresh).otherwise(state["out"]).alias("out"),
                            state["part"].alias("part"))

        return F.aggregate(block["items"], start, step, lambda s: s["out"])

    blocks = in_blocks(spans, lambda s: s["end"], F.greatest)
    reach = F.array_max(F.transform(spans, lambda s: s["end"]))
    rest = F.substring(text, (reach + 1).cast("int"), F.length(text))
    clean = F.concat(F.array_join(F.transform(blocks, clean_block), ""), rest)
    changed = F.size(spans) > 0
    if "n_chars" in docs.columns:
        count = F.length(clean).cast(docs.schema["n_chars"].dataType)
        rows = rows.withColumn("n_chars", F.when(changed, count).otherwise(F.col("n_chars")))
    return rows.withColumn("text", F.when(changed, clean).otherwise(text)).select(
        *[F.col(f"`{c}`") for c in docs.columns])
