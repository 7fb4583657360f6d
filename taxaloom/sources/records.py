"""Files of nested records: JSON or YAML, one object or a list of them each."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "file string, idx int, record string, error string"


def _objects(text: str, yaml: bool) -> list:
    if yaml:
        try:
            import yaml as reader
        except ImportError as e:
            raise ValueError("no YAML reader is installed") from e
        found = reader.safe_load(text)
    else:
        found = json.loads(text)
    if found is None or found == []:
        raise ValueError("empty")
    if not isinstance(found, dict | list):
        raise ValueError("not an object or a list")
    return found if isinstance(found, list) else [found]


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """file, idx, record (JSON) of each top-level object of the .json, .yaml and .yml files at a path; error where a file can't be read as such."""
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_name").alias("file"), "value")
    wanted = raw.where(F.lower("file").rlike(r"\.(json|ya?ml)$"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    rows += [(name, k, json.dumps(x, default=str), None) for k, x in enumerate(_objects(text, not name.lower().endswith("json")))]
                except Exception as e:  # noqa: BLE001  whatever a reader raises is the file's error
                    rows.append((name, 0, None, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.string()))], ["file", "idx", "record", "error"])

    return wanted.mapInArrow(run, SCHEMA)


def predictions(records: DataFrame) -> DataFrame:
    """study_id and record: the id is the record's study_id, else its uid, else the file's stem if it holds one record; the last file by name holds."""
    counted = records.where("error is null").join(records.groupBy("file").agg(F.count("*").alias("n")), "file")
    stem = F.when(F.col("n") == 1, F.regexp_replace("file", r"\.[^.]*$", ""))
    ident = F.coalesce(F.get_json_object("record", "$.study_id"), F.get_json_object("record", "$.uid"), stem)
    keyed = counted.withColumn("study_id", ident).where("study_id is not null")
    return keyed.groupBy("study_id").agg(F.max_by("record", F.struct("file", "idx")).alias("record"))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """path and SHA-256 of files, each hashed where it is read."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def newest(spark: SparkSession, path: str) -> DataFrame:
    """The file changed last; of several the last by name."""
    files = spark.read.format("binaryFile").load(path).select("path", "modificationTime")
    return files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))


def text_list(record: Column, path: str) -> Column:
    """A JSON field that holds a string or a list of strings, as an array."""
    many = F.from_json(F.get_json_object(record, path), "array<string>")
    return F.coalesce(many, F.when(F.get_json_object(record, path).isNotNull(), F.array(F.get_json_object(record, path))), F.array().cast("array<string>"))
