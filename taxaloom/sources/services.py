"""Listings and answers of remote services, as tables: what fetches them puts their text in a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import root_file_kind
from ..working import stored

LISTING = "struct<tree:array<struct<path:string,type:string,size:bigint>>>"
CONVERSION = "struct<status:string,message:string,records:array<struct<pmid:string,pmcid:string,doi:string>>>"
BATCH = 200


def listed_files(answers: DataFrame, dumps: tuple[str, ...], json: str = "json") -> DataFrame:
    """path, size (0 where absent) and kind of root-level files of a known kind."""
    each = answers.select(F.explode(F.from_json(json, LISTING)["tree"]).alias("x"))
    rows = each.where((F.col("x.type") == "blob") & ~F.contains(F.col("x.path"), F.lit("/")))
    return rows.select(F.col("x.path").alias("path"), F.coalesce("x.size", F.lit(0)).alias("size"), root_file_kind(F.col("x.path"), dumps).alias("kind")).where("kind is not null")


def of_kind(files: DataFrame, kind: str) -> DataFrame:
    return files if kind == "all" else files.where(F.col("kind") == kind)


def to_download(files: DataFrame, present: DataFrame, force: bool = False) -> DataFrame:
    """Files that are not there yet in the same size."""
    return files if force else files.join(present.select("path", "size"), ["path", "size"], "left_anti")


def batches(ids: DataFrame, size: int = BATCH, key: str = "id", order: str = "ord") -> DataFrame:
    """Ids in numbered batches of a fixed size, each as one comma-joined request.

    Numbering is by ranges of the order, counted per range first, so that no window
    runs over the whole table in one task. Ranges come from a sample and are not twice
    the same, so the rows are written with theirs and read for both.
    """
    if size <= 0:
        raise ValueError("a batch needs a positive size")
    ranged = stored(ids.select(order, key).repartitionByRange(order).withColumn("__part", F.spark_partition_id()))
    counts = ranged.groupBy("__part").count()
    before = counts.select("__part", (F.sum("count").over(Window.orderBy("__part")) - F.col("count")).alias("__before"))  # a row for each partition
    placed = ranged.withColumn("__i", F.row_number().over(Window.partitionBy("__part").orderBy(order, key))).join(F.broadcast(before), "__part")
    chunk = F.floor((F.col("__before") + F.col("__i") - 1) / size).cast("long").alias("batch")
    members = F.array_sort(F.collect_list(F.struct(order, key)))
    return placed.select(chunk, key, order).groupBy("batch").agg(members.alias("m")).select("batch", F.array_join(F.transform("m", lambda x: x[key].cast("string")), ",").alias("request"), F.size("m").cast("long").alias("n"))


def conversions(answers: DataFrame, json: str = "json") -> DataFrame:
    """pmid, pmcid and doi of a conversion service's answers; an answer that says error raises with its message."""
    said = answers.select(F.from_json(json, CONVERSION).alias("a"))
    checked = said.select(F.when(F.col("a.status") == "error", F.raise_error(F.col("a.message")).cast("string")).alias("__fail"), "a").where("__fail is null")
    return checked.select(F.inline("a.records")).where("pmid is not null")


def full_text_license(xml: Column) -> Column:
    """The licence of an open-access record; null where the answer is an error or has none."""
    return F.when(F.xpath_boolean(xml, F.lit("boolean(//error)")), None).otherwise(F.nullif(F.xpath_string(xml, F.lit("//record/@license")), F.lit("")))


def cached_names(spark, path: str) -> DataFrame:
    """name_norm, tax_id (null: known to have none) from a file of one JSON object."""
    raw = spark.read.option("wholetext", True).text(path)
    return raw.select(F.explode(F.from_json("value", "map<string,bigint>")).alias("name_norm", "tax_id"))
