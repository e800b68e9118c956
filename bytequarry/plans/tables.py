"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


#: The folder below the shared one that ``written`` uses.
_FOLDER: ContextVar[str] = ContextVar("folder", default="tables")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and all runs in one local process, a new folder of this machine.

    On a cluster no folder of one machine would do, so there the setting is needed.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = f"file://{tempfile.mkdtemp(prefix='bytequarry-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table in the shared folder and read it back, which cuts lineage for good.

    A lost executor then costs only its own tasks. The schema is passed on, so
    that reading needs no inference, and empty tables work.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{_FOLDER.get()}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_rows(df: DataFrame, name: str) -> DataFrame:
    """``written``, for tables that joins shuffle whatever their size.

    Rows of few small numbers take a byte or two each in a file, so that a table
    whose files pass for small may be far too large to broadcast from the driver.
    """
    return written(df, name).hint("merge")


#: Rows of few small numbers that meet in one task, about, once there are more of them than all cores take so many of.
ROWS_A_TASK = 250_000


def dealt(df: DataFrame, key: str, rows: int) -> DataFrame:
    """A table of few small numbers, dealt out by a key over tasks that grow in number with its rows.

    Such rows take a byte or two each on their way, by which Spark would join so many parts of a shuffle into one task
    that its memory grows with the table. rows: about how many there are, from a count of the table they come from.
    """
    parts = -(-rows // ROWS_A_TASK)
    return df.repartition(parts, key) if parts > df.sparkSession.sparkContext.defaultParallelism else df


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder of its own for what ``written`` leaves within the block; it is deleted when the block ends.

    Results that read it must be written or collected within the block. Blocks may
    lie within blocks.
    """
    folder = f"{_FOLDER.get()}/run-{uuid.uuid4().hex}"
    token = _FOLDER.set(folder)
    try:
        yield f"{shared_dir(spark)}/{folder}"
    finally:
        _FOLDER.reset(token)
        drop(spark, f"{shared_dir(spark)}/{folder}")


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder, in whatever file system it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_tables(spark: SparkSession) -> None:
    """Delete all that ``written`` left outside of scratch blocks; call it when no result that reads it is needed."""
    drop(spark, f"{shared_dir(spark)}/tables")
