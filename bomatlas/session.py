"""Session settings and the shared folder that outlives an executor."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_CHECKPOINT_DIR = "spark.checkpoint.dir"

# Settings every job here relies on. Broadcast joins are never hinted: Spark takes one
# only when the measured size of a side is below the threshold, and falls back to a
# shuffled join with skew splitting beyond it.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A join whose smaller side measures at most this in every partition hashes that side
    # instead of sorting both; beyond it Spark sorts, as without the setting. Sizes are those
    # of compressed shuffles and a hashed side can't spill, so it is no more than one partition.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    # What an action shuffled is deleted when it ends, not when the driver happens to collect
    # garbage: a job of several steps has one step's shuffles on disk. Stages run again if a
    # frame is executed once more.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    # The JVM never compiles methods above 8000 bytes of byte code. Projections that
    # would generate one run with their expressions split into small methods instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(app_name: str, master: str | None = None, **extra: str) -> SparkSession:
    """Session with the settings above; ``extra`` keys use ``_`` for ``.``."""
    builder = SparkSession.builder.appName(app_name).config("spark.ui.enabled", "false")
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def apply_settings(spark: SparkSession) -> None:
    """Put the runtime settings on a session somebody else made."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it.

    Only a local-mode session may make one of its own.
    """
    named = spark.conf.get(_CHECKPOINT_DIR, None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_CHECKPOINT_DIR} to a folder all executors share")
    made = tempfile.mkdtemp(prefix="bomatlas-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set(_CHECKPOINT_DIR, made)
    return made


def run_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one run under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that was made at :func:`run_path`."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    root.getFileSystem(spark._jsc.hadoopConfiguration()).delete(root, True)
