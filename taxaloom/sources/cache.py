"""Answers about names that outlive a run: a log to which each run adds what it learnt, and whose last answer holds."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files

SCHEMA = "name_norm string, tax_id bigint, segment bigint, ord bigint"
BASE = "base"


def _commits(spark: SparkSession, folder: str) -> list[tuple[int, str, str]]:
    """Number, run and folder name of what has been added, in order."""
    out = []
    for name in files.names_in(spark, f"{folder}/commits"):
        number, _, rest = name.partition("-")
        run, _, token = rest.rpartition("-")
        out.append((int(number), run, token))
    return sorted(out)


def _commit(spark: SparkSession, folder: str, number: int, run: str, rows: DataFrame) -> None:
    token = uuid.uuid4().hex
    rows.write.parquet(f"{folder}/segments/{token}")
    files.create_empty(spark, f"{folder}/commits/{number:012d}-{run}-{token}")


def add(spark: SparkSession, folder: str, answers: DataFrame, run: str, order: str | None = None) -> bool:
    """Adds a run's answers (name_norm, tax_id; null: known to have none); false where that run has been added before.

    The answers are written first, and are not seen before an empty file names them: a
    run that ends early adds nothing, and may be repeated. Of several answers about a
    name the last by `order` counts, of as late ones that with the largest id.
    """
    commits = _commits(spark, folder)
    if any(r == run for _, r, _ in commits):
        return False
    number = max((n for n, _, _ in commits), default=0) + 1
    ord_ = F.col(order).cast("bigint") if order else F.lit(0).cast("bigint")
    _commit(spark, folder, number, run, answers.select(F.col("name_norm").cast("string"), F.col("tax_id").cast("bigint"), F.lit(number).cast("bigint").alias("segment"), ord_.alias("ord")))
    return True


def _last(rows: DataFrame) -> DataFrame:
    """The last answer about each name: later segments, then later in order; an id goes before none of the same time."""
    return rows.groupBy("name_norm").agg(F.max(F.struct("segment", "ord", "tax_id")).alias("x")).select("name_norm", "x.tax_id", "x.segment", "x.ord")


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    commits = _commits(spark, folder)
    first = max((k for k, (_, run, _) in enumerate(commits) if run == BASE), default=0)
    paths = [f"{folder}/segments/{token}" for _, _, token in commits[first:]]
    return _last(spark.read.schema(SCHEMA).parquet(*paths)) if paths else spark.createDataFrame([], SCHEMA)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """name_norm, tax_id of all names known, known misses too (see taxonomy.with_cache)."""
    return _rows(spark, folder).select("name_norm", "tax_id")


def compact(spark: SparkSession, folder: str) -> None:
    """Writes what holds as one segment, from which reading starts; runs added so far are still known as such."""
    commits = _commits(spark, folder)
    if commits:
        _commit(spark, folder, commits[-1][0], BASE, _rows(spark, folder))


def export(spark: SparkSession, folder: str, path: str) -> None:
    """The cache as JSON lines by name; a name without an id keeps its null."""
    read(spark, folder).repartitionByRange("name_norm").sortWithinPartitions("name_norm").write.mode("overwrite").option("ignoreNullFields", False).json(path)
