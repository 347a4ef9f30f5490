"""Session settings the operators rely on, and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every wattle job expects. Time zone is pinned so that wall-clock
# timestamps, epoch seconds and calendar labels do not depend on the host.
SESSION_DEFAULTS: dict[str, str] = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Target size of post-shuffle partitions when AQE coalesces (cluster runs).
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128MB",
    # Runtime (AQE) broadcast only for sides whose measured size is small.
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
    "spark.sql.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(
    master: str | None = None,
    app_name: str = "wattle",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or reuse) a session with the wattle defaults.

    On a cluster leave ``master`` as None so the launcher decides. The Spark
    UI stays off: nothing here needs a web server.
    """
    builder = SparkSession.builder.appName(app_name).config("spark.ui.enabled", "false")
    if master:
        builder = builder.master(master)
    for key, value in SESSION_DEFAULTS.items():
        builder = builder.config(key, value)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    pin_session(spark)
    return spark


# What results depend on; the rest of the defaults is tuning.
SESSION_SEMANTICS = ("spark.sql.session.timeZone", "spark.sql.ansi.enabled")


def pin_session(spark: SparkSession) -> None:
    """Apply to an existing session the settings that results depend on.

    Partition sizes, broadcast thresholds and the like stay as the cluster
    has set them: only ``build_session`` brings defaults for those. What
    ``widen_shuffles`` raised for the query before is taken back.
    """
    for key in SESSION_SEMANTICS:
        spark.conf.set(key, SESSION_DEFAULTS[key])
    for key, note in _WIDENED.items():
        widened = spark.conf.get(note, None)
        if widened is not None:
            before, ours = widened.split()
            if spark.conf.get(key) == ours:  # else the cluster has set it anew
                spark.conf.set(key, before)
            spark.conf.unset(note)


_SHUFFLES = "spark.sql.shuffle.partitions"
_MERGED = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
# Each with the key that notes its value before, and the one that we set.
_WIDENED = {_SHUFFLES: "wattle.shuffle.widened", _MERGED: "wattle.shuffle.merged"}

# Up to this size AQE merges the partitions of a widened shuffle. A pivot's
# table of groups takes about eight times the bytes that are read for it.
MERGED_BYTES = 16 << 20


def _widen(spark: SparkSession, key: str, value: str) -> None:
    now = spark.conf.get(key)
    before = spark.conf.get(_WIDENED[key], now).split()[0]
    spark.conf.set(key, value)
    spark.conf.set(_WIDENED[key], f"{before} {value}")


def _bytes(text: str) -> int:
    """Bytes of a size as Spark writes it (``64MB``, ``8m``, ``67108864b``)."""
    number, unit = re.fullmatch(r"(\d+)([bkmgtp]?)b?", text.strip().lower()).groups()
    return int(number) << 10 * "bkmgtp".index(unit or "b")


def widen_shuffles(spark: SparkSession, tasks: int) -> None:
    """Let shuffles deal their rows to ``tasks`` tasks at least, until the next
    ``pin_session``.

    An aggregate has no say in the number of tasks behind its own shuffle: with
    a fixed one, their tables of groups grow with the input. Dealing the rows
    out beforehand, by a number, would lose what is combined before the shuffle.
    AQE still merges small partitions, but only up to ``MERGED_BYTES``: with a
    large advisory size it would undo this and make a few large tasks again.
    """
    if tasks > int(spark.conf.get(_SHUFFLES)):
        _widen(spark, _SHUFFLES, str(tasks))
    if tasks > 1 and _bytes(spark.conf.get(_MERGED)) > MERGED_BYTES:
        _widen(spark, _MERGED, f"{MERGED_BYTES}b")


def _context(spark: SparkSession):
    """The SparkContext of a classic session, None for a Connect session."""
    try:
        return spark.sparkContext
    except Exception:
        return None


def default_parallelism(spark: SparkSession) -> int:
    """Task slots of the cluster (falls back to the shuffle partition count)."""
    sc = _context(spark)
    if sc is not None:
        return int(sc.defaultParallelism)
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and derived tables.

    Read from the session (``spark.checkpoint.dir``, as the cluster names
    it). Only a local-mode session without one gets a fresh folder of its
    own; a cluster without a shared folder is an error, since a machine-local
    folder would vanish with its executor.
    """
    sc = _context(spark)
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and sc is not None:
        root = sc.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if sc is None or not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; name a shared folder for checkpoints"
        )
    root = tempfile.mkdtemp(prefix="wattle-ckpt-")
    sc.setCheckpointDir(root)
    return root


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Make sure ``DataFrame.checkpoint()`` has a directory, return it."""
    root = checkpoint_root(spark)
    sc = _context(spark)
    if sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique folder under the shared root for one derived table."""
    root = checkpoint_root(spark)
    sep = "" if root.endswith("/") else "/"
    return f"{root}{sep}wattle/{name}-{uuid.uuid4().hex[:12]}"
