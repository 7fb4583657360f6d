"""Shared storage for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints; a folder of this machine only where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext._jsc.sc().getCheckpointDir().getOrElse(None)
    if not named:
        named = tempfile.mkdtemp(prefix="taxaloom-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named


def stored(df: DataFrame) -> DataFrame:
    """The same rows from a written table: computed once, and again readable when executors are lost."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Ids that a join may broadcast, at some 20 bytes each; beyond that both sides are shuffled.
BROADCAST_IDS = 500_000


def without(rows: DataFrame, ids: DataFrame, key: str | list[str]) -> DataFrame:
    """The rows whose key is not among the ids. The ids are counted first."""
    ids = stored(ids)
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, key, "left_anti").select(*rows.columns)


def within(rows: DataFrame, ids: DataFrame, key: str | list[str]) -> DataFrame:
    """The rows whose key is among the ids. The ids are counted first."""
    ids = stored(ids)
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, key, "left_semi").select(*rows.columns)


def cut(df: DataFrame) -> DataFrame:
    """The same rows without lineage, for loops."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
