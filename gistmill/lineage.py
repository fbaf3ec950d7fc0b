"""Where intermediate tables go: the folder that the cluster shares in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder.

    A local session without one, as in tests, gets a fresh temporary folder; on a cluster its absence is an error, since a
    temporary folder is one machine's.
    """
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="gistmill-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/gistmill-{spark.sparkContext.applicationId}"


_OPEN: list[list[str]] = []


def fresh(spark: SparkSession) -> str:
    """A path of this application in the shared folder where nothing is yet."""
    path = f"{_own_dir(spark)}/{uuid.uuid4().hex}"
    for paths in _OPEN:
        paths.append(path)
    return path


@contextmanager
def noted() -> Iterator[list[str]]:
    """The paths that are given out meanwhile, in order."""
    paths: list[str] = []
    _OPEN.append(paths)
    try:
        yield paths
    finally:
        _OPEN[:] = [x for x in _OPEN if x is not paths]


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Removes intermediate tables that nothing reads any more."""
    for x in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame) -> DataFrame:
    """The same rows read back from a Parquet table in the shared folder, so that lost executors cost no more than this table's reading."""
    path = fresh(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Removes what this application has written; results that were read from it and not yet stored are gone with it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
