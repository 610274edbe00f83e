"""Tables that cut lineage, in the folder that the driver and all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.  Only on a local master, as in tests, is an unset one replaced by a temporary folder; a cluster has to name it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="marketframe-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Tables of the innermost ``temporary`` block, as it is the driver's program that makes them.
_made: list[list[str]] = []


@contextlib.contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Deletes what ``saved`` writes inside the block when it ends, also by an error.  What is made of these tables has to be written or
    counted inside; without a block they stay in the folder, as a lazy result may still read them."""
    _made.append([])
    try:
        yield
    finally:
        for path in _made.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside are deleted as soon as it has ended, and not when the driver happens to collect its garbage."""
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)


def saved(df: DataFrame) -> DataFrame:
    """The same rows, written once as Parquet and read from there."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    if _made:
        _made[-1].append(path)
    with shuffles_go(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
