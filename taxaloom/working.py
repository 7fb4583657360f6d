"""Working tables: results that several later steps read, written once to shared storage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints; a folder of this machine only where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext._jsc.sc().getCheckpointDir().getOrElse(None)
    if not named:
        named = tempfile.mkdtemp(prefix="taxaloom-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named


#: Working tables that this driver has written and not removed.
_written: list[str] = []


#: Has Spark remove the shuffle files of a write when it is done, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session for what is run within."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored(df: DataFrame) -> DataFrame:
    """The same rows from a written table: computed once, and again readable when executors are lost. Its shuffle files are gone then. See clear()."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    with setting(spark, _CLEANUP, "true"):
        df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def steps(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Gives a stored() whose tables are removed at the end: for steps on the way to a table that stays."""
    made: list[str] = []

    def step(df: DataFrame) -> DataFrame:
        out = stored(df)
        made.append(_written.pop())
        return out

    try:
        yield step
    finally:
        _remove(spark, made)


def _remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def clear(spark: SparkSession) -> int:
    """Removes all working tables that this driver has written, for when their results have been written elsewhere; how many there were."""
    paths, _written[:] = list(_written), []
    _remove(spark, paths)
    return len(paths)
