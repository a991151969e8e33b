"""Session helpers shared by the operators."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "terraprofile", master: str | None = None) -> SparkSession:
    """A session with the settings the operators are written for."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = (
            builder.master(master)
            .config("spark.sql.shuffle.partitions", "8")
            .config("spark.driver.memory", "8g")
            .config("spark.ui.enabled", "false")
        )
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session without that setting uses its warehouse instead;
    a cluster without it is an error, as executors do not share local disks.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"


_TO_DELETE: set[str] = set()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path for a written table below the shared folder; deleted when the driver ends."""
    context = spark.sparkContext
    own = f"{shared_dir(spark).rstrip('/')}/terraprofile/{context.applicationId}"
    if own not in _TO_DELETE:
        _TO_DELETE.add(own)
        folder = context._jvm.org.apache.hadoop.fs.Path(own)
        atexit.register(_delete, folder.getFileSystem(context._jsc.hadoopConfiguration()), folder)
    return f"{own}/{label}-{uuid.uuid4().hex}"


def _delete(store, folder) -> None:
    """Remove a session's written tables, if the JVM is still there."""
    with contextlib.suppress(Exception):
        store.delete(folder, True)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _write(df: DataFrame, label: str) -> str:
    """Write ``df`` below the shared folder; what it shuffled goes at the end, not when the driver collects garbage."""
    spark = df.sparkSession
    path, before = scratch_path(spark, label), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage by writing ``df`` to the shared folder and reading it back.

    A written table survives executor loss and gives later jobs column pruning.
    """
    return df.sparkSession.read.schema(df.schema).parquet(_write(df, label))


@contextlib.contextmanager
def passing(df: DataFrame, label: str) -> Iterator[DataFrame]:
    """``df`` written as :func:`materialize` does, and deleted when the block ends.

    What is read from it must be written by then.
    """
    spark, path = df.sparkSession, _write(df, label)
    yield spark.read.schema(df.schema).parquet(path)
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    _delete(folder.getFileSystem(context._jsc.hadoopConfiguration()), folder)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that has rows in proportion to the input, so it is never broadcast.

    Written and well packed tables are far smaller than read ones, and exploded rows count as much as
    the rows before, so estimates in bytes would send such a side through the driver.
    """
    return df.hint("merge")
