"""Taxonomy dump files and the store made of them."""

from __future__ import annotations

import uuid
import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import taxon_key
from ..operators import labels
from . import archive, files
from .records import checksums

TABLES = ("names", "nodes", "merged", "meta")
DMP = ("names.dmp", "nodes.dmp", "merged.dmp")


def _fields(lines: DataFrame) -> DataFrame:
    """Lines (value) as arrays of fields: tab, bar, tab between fields, tab and bar at the end, however many there are."""
    return lines.select(F.split(F.regexp_replace("value", r"\t\|\s*$", ""), r"\t\|\t").alias("f")).where(F.size("f") > 1)


def read_dmp(spark: SparkSession, path: str) -> DataFrame:
    return _fields(spark.read.text(path))


class Dump:
    """The files of a taxonomy dump: in a folder or any below it, or in a zip or tar archive; of several of one name the first by path."""

    def __init__(self, spark: SparkSession, source: str) -> None:
        self.spark, self.source, self.packed = spark, source, archive.is_archive(source) and not files.is_folder(spark, source)
        self.members = sorted(archive.members(source)) if self.packed else []

    def path(self, name: str) -> str | None:
        if self.packed:
            return next((m for m in self.members if m.rpartition("/")[2] == name), None)
        return files.find(self.spark, self.source, name)

    def lines(self, name: str) -> DataFrame:
        path = self.path(name)
        if path is None:
            raise FileNotFoundError(f"no {name} in {self.source}")
        return _fields(archive.read_archive(self.spark, self.source, path)) if self.packed else read_dmp(self.spark, path)

    def checksums(self) -> DataFrame:
        """file and sha256 of the dump's files, or of the archive."""
        paths = [self.source] if self.packed else [p for p in map(self.path, DMP) if p]
        hashed = [checksums(self.spark, p) for p in paths]
        return reduce(DataFrame.unionByName, hashed).select(F.element_at(F.split("path", "/"), -1).alias("file"), "sha256")


def _field(k: int) -> Column:
    return F.btrim(F.get("f", F.lit(k)))


def names(lines: DataFrame) -> DataFrame:
    name = _field(1)
    return lines.select(_field(0).cast("bigint").alias("tax_id"), name.alias("name_txt"), taxon_key(name).alias("name_norm"), _field(3).alias("name_class"))


def nodes(lines: DataFrame) -> DataFrame:
    return lines.select(_field(0).cast("bigint").alias("tax_id"), _field(1).cast("bigint").alias("parent_tax_id"), _field(2).alias("rank"))


def merged(lines: DataFrame) -> DataFrame:
    return lines.select(_field(0).cast("bigint").alias("old_tax_id"), _field(1).cast("bigint").alias("new_tax_id"))


def build(spark: SparkSession, source: str, store: str, built_at: str, release: str = "") -> DataFrame:
    """Builds a store from a dump (see Dump); its meta: rows of names, nodes and merged, then what it was built of and when.

    Tables are written to a folder of this build's own and are not seen before they are
    all there: last of all an empty file under commits names the folder. A build that
    ends early leaves the store as it was, and readers of an earlier build keep their
    files (see prune). Nodes have their labels (operators.labels). Repeated ids in nodes
    or merged are an error; merged is empty where its file is missing.
    """
    dump, version = Dump(spark, source), uuid.uuid4().hex
    retired = merged(dump.lines("merged.dmp")) if dump.path("merged.dmp") else spark.createDataFrame([], "old_tax_id bigint, new_tax_id bigint")
    tables = {"names": names(dump.lines("names.dmp")), "nodes": nodes(dump.lines("nodes.dmp")), "merged": retired}
    folder = f"{store}/versions/{version}"
    seen = {name: Observation() for name in tables}
    for name, table in tables.items():
        raw = f"{folder}/{'unlabelled' if name == 'nodes' else name}"
        table.observe(seen[name], F.count(F.lit(1)).alias("n")).write.parquet(raw)
        tables[name] = spark.read.schema(table.schema).parquet(raw)
    for name, key in (("nodes", "tax_id"), ("merged", "old_tax_id")):
        repeated = tables[name].groupBy(key).count().where("count > 1").limit(5).collect()
        if repeated:
            raise ValueError(f"{name}: repeated {key}, among them {[r[0] for r in repeated]}")
    labels.labelled(tables["nodes"]).write.parquet(f"{folder}/nodes")
    files.delete(spark, f"{folder}/unlabelled")
    sources = F.array_sort(F.collect_list(F.struct("file", "sha256"))).alias("files")
    counts = [F.lit(seen[name].get["n"]).cast("long").alias(name) for name in tables]
    meta = dump.checksums().agg(sources).select(*counts, F.lit(built_at).alias("built_at"), F.lit(release).alias("release"), F.lit(source).alias("source"), "files")
    meta.write.parquet(f"{folder}/meta")
    number = max((int(c.partition("-")[0]) for c in _commits(spark, store)), default=0) + 1
    files.create_empty(spark, f"{store}/commits/{number:012d}-{version}")
    return spark.read.parquet(f"{folder}/meta")


def _commits(spark: SparkSession, store: str) -> list[str]:
    return files.names_in(spark, f"{store}/commits")


def open_store(spark: SparkSession, store: str) -> dict[str, DataFrame]:
    """The tables of the store's last finished build. They stay readable when a later build is finished. A store whose meta is empty is damaged."""
    commits = _commits(spark, store)
    if not commits:
        raise FileNotFoundError(f"no finished taxonomy store at {store}")
    folder = f"{store}/versions/{commits[-1].partition('-')[2]}"
    tables = {n: spark.read.parquet(f"{folder}/{n}") for n in TABLES}
    if tables["meta"].isEmpty():
        raise ValueError(f"the taxonomy store at {store} has an empty meta table")
    return tables


def open_optional(spark: SparkSession, store: str | None) -> dict[str, DataFrame] | None:
    """The store's tables, or none with a warning where there is no finished or no sound store: what needs names then goes without."""
    try:
        if store is None:
            raise FileNotFoundError("no taxonomy store is named")
        return open_store(spark, store)
    except Exception as e:  # noqa: BLE001  whatever keeps a store from being read
        warnings.warn(f"names cannot be resolved: {e}", RuntimeWarning, stacklevel=2)
        return None


def prune(spark: SparkSession, store: str, keep: int = 1, abandoned: bool = False) -> int:
    """Deletes all finished builds but the last `keep`, for when nobody reads them any more, and with `abandoned` what unfinished ones have left, for when none is under way; how many went."""
    commits = _commits(spark, store)
    gone = [c.partition("-")[2] for c in commits[: -max(keep, 1)]]
    for commit in commits[: -max(keep, 1)]:
        files.delete(spark, f"{store}/commits/{commit}")
    if abandoned:
        named = {c.partition("-")[2] for c in commits}
        gone += [v for v in files.names_in(spark, f"{store}/versions") if v not in named]
    for version in gone:
        files.delete(spark, f"{store}/versions/{version}")
    return len(gone)
