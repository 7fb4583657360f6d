"""The flat dump: one row per signature, parents repeated, every cell a string."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from operator import itemgetter
from typing import NamedTuple

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# The dump's header.
COLUMNS = (
    "BSDB ID", "Study", "Study design", "PMID", "DOI", "URL", "Authors list", "Title", "Journal", "Year", "Keywords", "Experiment",
    "Location of subjects", "Host species", "Body site", "UBERON ID", "Condition", "EFO ID", "Group 0 name", "Group 1 name",
    "Group 1 definition", "Group 0 sample size", "Group 1 sample size", "Antibiotics exclusion", "Sequencing type", "16S variable region",
    "Sequencing platform", "Data transformation", "Statistical test", "Significance threshold", "MHT correction", "LDA Score above",
    "Matched on", "Confounders controlled for", "Pielou", "Shannon", "Chao1", "Simpson", "Inverse Simpson", "Richness",
    "Signature page name", "Source", "Curated date", "Curator", "Revision editor", "Description", "Abundance in Group 1",
    "MetaPhlAn taxon names", "NCBI Taxonomy IDs", "State", "Reviewer",
)
ORDER = "row_idx"


def schema() -> StructType:
    return StructType([StructField(c, StringType()) for c in COLUMNS])


#: How cells are written.
CSV = {"multiLine": "true", "quote": '"', "escape": '"'}
PIECE = pa.schema([("at", pa.int64()), ("first", pa.bool_()), ("opens", pa.bool_()), ("closes", pa.bool_()), ("text", pa.string())])
PIECE_DDL = "at bigint, first boolean, opens boolean, closes boolean, text string"
#: Records of a range are numbered in this many low bits of their place.
RANGE_BITS = 33


class Range(NamedTuple):
    """A byte range of a file: its number in the order of the input, and whether it begins within a quoted cell."""

    number: int
    inside: bool


def _is_banner(value: str, start: int) -> bool:
    return start == 0 and value.lstrip("\ufeff").startswith("#")


def _ranges(lines: DataFrame) -> dict[tuple[str, int], Range]:
    """All ranges with lines, by path and first byte. A range begins within a cell if the quotes before it in its file are odd in number."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    head = F.when(F.col("start") == 0, F.min_by("value", "n")).alias("head")
    found = lines.withColumn("n", F.monotonically_increasing_id()).groupBy("path", "start").agg(F.sum(quotes).alias("quotes"), head).orderBy("path", "start").collect()  # a row for each range
    out, before, inside = {}, None, False
    for number, r in enumerate(found):
        inside = inside and r["path"] == before
        out[r["path"], r["start"]] = Range(number, inside)
        inside ^= (r["quotes"] - (r["head"].count('"') if r["head"] and _is_banner(r["head"], r["start"]) else 0)) % 2 == 1
        before = r["path"]
    return out


def _cut(known: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Joins a range's lines to records. What continues a record of the range before does not open it, what the next range continues does not close it."""

    def pieces(lines: Iterator[tuple[str, int, str]]) -> Iterator[tuple]:
        for (path, start), group in itertools.groupby(lines, key=itemgetter(0, 1)):
            number, inside = known.value[path, start]
            place, held, opens, top = number << RANGE_BITS, [], not inside, True
            for _, _, value in group:
                if top:
                    value, banner = (value.lstrip("\ufeff") if start == 0 else value), _is_banner(value, start)
                    inside ^= not banner and value.count('"') % 2 == 1
                else:
                    inside ^= value.count('"') % 2 == 1
                top = False
                held.append(value)
                if not inside:
                    text = "\n".join(held).removesuffix("\r")
                    if text:
                        yield place, start == 0 and place == number << RANGE_BITS, opens, True, text
                        place += 1
                    held, opens = [], True
            if held:
                yield place, start == 0 and place == number << RANGE_BITS, opens, False, "\n".join(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = pieces(line for b in batches for line in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for some in itertools.batched(found, 2_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), PIECE.types, strict=True)], schema=PIECE)

    return run


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """at (ascending in the order of the input), first (of its file) and text of each record of CSV files whose quoted cells may hold line breaks.

    A file is read in byte ranges, by as many tasks. A first pass counts quotes; the
    parities of the ranges before tell whether a range begins within a cell. The second
    cuts each range into records where it lies. Records that run over the end of a range
    are put together from the parts that the ranges beside it hold, and nothing else is
    shuffled. Quotes are taken as they are written by CSV writers: around cells, and
    doubled within; a banner line may hold any.
    """
    raw = spark.read.option("lineSep", "\n").text(path)
    lines = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")
    ranges = _ranges(lines)
    known = spark.sparkContext.broadcast(ranges)  # a row for each range
    whole = lines.mapInArrow(_cut(known), PIECE_DDL).where("opens and closes").select("at", "first", "text")
    order = list(ranges)
    broken = [k for k, r in ranges.items() if r.inside] + [order[r.number - 1] for r in ranges.values() if r.inside]
    if not broken:
        return whole
    beside = spark.createDataFrame(sorted(set(broken)), "path string, start bigint")  # ranges that share a record
    parts = lines.join(F.broadcast(beside), ["path", "start"], "left_semi").mapInArrow(_cut(known), PIECE_DDL).where("not (opens and closes)")
    by_range = spark.createDataFrame([(r.number, p) for (p, _), r in ranges.items()], "number bigint, path string")
    placed = parts.withColumn("number", F.shiftright("at", RANGE_BITS)).join(by_range, "number")
    record = F.sum(F.col("opens").cast("int")).over(Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    joined = placed.withColumn("record", record).groupBy("path", "record").agg(F.min("at").alias("at"), F.bool_or("first").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return whole.unionByName(joined.select("at", "first", F.regexp_replace("text", "\r$", "").alias("text")))


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """The dump with row_idx, each row's place in the input. A banner line above the header is left out; cells may hold line breaks, and begin with #."""
    cells = ", ".join(f"`{c}` string" for c in COLUMNS)
    rows = read_lines(spark, path).select(F.col("at").alias(ORDER), "first", F.from_csv("text", cells, CSV).alias("r")).select("r.*", ORDER, "first")
    header = (F.col(COLUMNS[0]) == COLUMNS[0]) & (F.col(COLUMNS[1]) == COLUMNS[1])
    banner = F.startswith(COLUMNS[0], F.lit("#")) & (F.col("first") | F.col(COLUMNS[1]).isNull())
    return rows.where(~F.coalesce(header, F.lit(False)) & ~F.coalesce(banner, F.lit(False))).drop("first")


def read_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A header CSV of strings, as written by write_table."""
    return spark.read.schema(StructType([StructField(c, StringType()) for c in columns])).options(header=True, multiLine=True, quote='"', escape='"').csv(path).na.fill("")


def with_order(rows: DataFrame) -> DataFrame:
    """A column of ascending numbers in the order of the scan. They have gaps, and only their order means anything."""
    return rows.withColumn(ORDER, F.monotonically_increasing_id())


def study_ids(rows: DataFrame) -> DataFrame:
    """study_id and pmid of rows whose pmid is all digits; repeats stay."""
    return rows.select("study_id", F.btrim("pmid").alias("pmid")).where(F.col("pmid").rlike("^[0-9]+$"))
