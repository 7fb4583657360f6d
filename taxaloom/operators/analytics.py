"""Queries on curated pages: glossary terms, regions, reviews, taxa."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def terms(rows: DataFrame, column: str, glossary: DataFrame, aliases: DataFrame) -> DataFrame:
    """The rows with `term`: the glossary's word, else that of the alias, else the word as it stands."""
    t = glossary.select(F.col("term").alias("__t"))
    a = aliases.select(F.col("alias").alias("__a"), F.col("term").alias("__of"))
    return rows.join(t, F.col(column) == F.col("__t"), "left").join(a, F.col(column) == F.col("__a"), "left").withColumn("term", F.coalesce("__t", "__of", column)).drop("__t", "__a", "__of")


def regions(rows: DataFrame) -> DataFrame:
    """A row for each region from low to high; a missing bound is the other one."""
    low, high = F.coalesce("low", "high").cast("int"), F.coalesce("high", "low").cast("int")
    return rows.select("*", F.explode(F.sequence(F.least(low, high), F.greatest(low, high))).alias("region"))


def changes(rows: DataFrame, by: str, order: str, columns: list[str]) -> DataFrame:
    """Each column's value, or null where it is the same as in the row before."""
    w = Window.partitionBy(by).orderBy(order)
    return rows.select(by, order, *[F.when(~F.col(c).eqNullSafe(F.lag(c).over(w)), F.col(c)).alias(c) for c in columns])


def child_pages(parents: DataFrame, pages: DataFrame) -> DataFrame:
    """Parents with their child pages in the order of the pages' numbers."""
    number = F.regexp_extract("page", r"(\d+)\s*$", 1).try_cast("int")
    kids = pages.groupBy("parent").agg(F.array_sort(F.collect_list(F.struct(number.alias("n"), "page"))).alias("c"))
    return parents.join(kids, "parent", "left").select(*parents.columns, F.coalesce(F.transform("c", lambda x: x["page"]), F.array().cast("array<string>")).alias("children"))


def stale_reviews(rows: DataFrame) -> DataFrame:
    """The rows with `stale`: the review is older than the last revision."""
    return rows.withColumn("stale", F.coalesce(F.col("review_date") < F.col("revision_date"), F.lit(False)))


def taxon_signatures(signatures: DataFrame, closure: DataFrame, tax_id: int, inherited: bool, limit: int = 10, **equal: str) -> DataFrame:
    """Signatures (taxa: array of ids) that hold a taxon, or with inherited any below it; a short list for a page, by three keys."""
    ids = closure.where(F.col("ancestor") == tax_id).select("tax_id") if inherited else closure.where((F.col("tax_id") == tax_id) & (F.col("depth") == 0)).select("tax_id")
    each = signatures.withColumn("tax_id", F.explode("taxa")).join(ids.distinct(), "tax_id", "left_semi").drop("tax_id").dropDuplicates(["signature_id"])
    for column, value in equal.items():
        each = each.where(F.array_contains(column, value))
    return each.orderBy("study_id", "experiment_id", "signature_id").limit(limit)


def studies_with(signatures: DataFrame, tax_id: int) -> DataFrame:
    return signatures.where(F.array_contains("taxa", tax_id)).agg(F.count_distinct("study_id").alias("studies"))


def unknown_values(rows: DataFrame, column: str, vocabulary: DataFrame) -> DataFrame:
    """Values outside an open vocabulary (value), with how often they come."""
    said = rows.select(F.explode(column).alias("value")) if rows.schema[column].dataType.typeName() == "array" else rows.select(F.col(column).alias("value"))
    return said.where("value is not null").join(vocabulary, "value", "left_anti").groupBy("value").agg(F.count("*").alias("n"))
