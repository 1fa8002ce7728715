"""Session helpers: local session, shared work folder, written intermediates.

Lineage is cut by writing tables under ``spark.checkpoint.dir``, a folder every
executor can reach. The setting is read from the session. Where it is unset, a
local master (one machine: tests, bench) gets a folder of its own; on any other
master the work stops with an error, since executors would write to disks that
nobody else can read.
"""

from __future__ import annotations

import os
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: Spark removes the shuffle files of an execution when it ends.
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "linkwise",
                  checkpoint_dir: str | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if checkpoint_dir:
        builder = builder.config(CHECKPOINT_CONF, checkpoint_dir)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared work folder of the session.

    Unset on a local master: a folder under ``/tmp`` named after the application. Unset elsewhere: ``RuntimeError``.
    """
    current = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if not current:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError(
                f"{CHECKPOINT_CONF} is not set: name a folder that the driver and all executors share")
        current = f"/tmp/linkwise-{spark.sparkContext.applicationId}"
        spark.conf.set(CHECKPOINT_CONF, current)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(current)
    return current


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared work folder."""
    root = ensure_checkpoint_dir(spark)
    return f"{root.rstrip('/')}/linkwise/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the work folder and read it back.

    A reliable, lineage-free copy: a lost executor re-reads files instead of
    recomputing the plan, and the scan keeps column pruning and pushdown. The shuffle
    files behind the copy are removed as soon as it is written.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    before = spark.conf.get(CLEANUP_CONF, "false")
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.set(CLEANUP_CONF, before)
    _note(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


_scopes = threading.local()


def _note(path: str) -> None:
    """The innermost scope of this thread answers for the table."""
    made = getattr(_scopes, "made", None)
    if made:
        made[-1].append(path)


@contextmanager
def temporary_tables(spark: SparkSession):
    """Tables that ``materialize`` writes inside the block are removed at its end, also after an error.

    Yields ``keep``, which takes a materialized frame out of it (an outer block then answers for it).
    """
    if not hasattr(_scopes, "made"):
        _scopes.made = []
    mine: list[str] = []
    _scopes.made.append(mine)
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df.written_to)
        return df

    try:
        yield keep
    except BaseException:
        kept.clear()
        raise
    finally:
        _scopes.made.remove(mine)
        for path in mine:
            if path in kept:
                _note(path)
            else:
                drop_path(spark, path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table written by ``materialize`` through Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def ship_package(spark: SparkSession, folder: str | None = None) -> str:
    """Send this package to executors that do not have it on their path.

    UDFs are pickled by reference to their module, so every worker must be able
    to import ``linkwise``. Returns the zip file given to ``addPyFile``.
    """
    import shutil

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    base = os.path.join(folder or "/tmp", f"linkwise-{spark.sparkContext.applicationId}-package")
    path = shutil.make_archive(base, "zip", root_dir=root, base_dir="linkwise")
    spark.sparkContext.addPyFile(path)
    return path
