"""Files and folders through the file system that Spark reads, whatever it is."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where) and fs.getFileStatus(where).isDirectory()


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder, sorted; none where there is no such folder."""
    fs, where = _at(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def find(spark: SparkSession, folder: str, name: str) -> str | None:
    """The first file of a name, by path, in a folder or any below it."""
    fs, where = _at(spark, folder)
    found, files = [], fs.listFiles(where, True)
    while files.hasNext():
        path = files.next().getPath()
        if path.getName() == name:
            found.append(path.toString())
    return min(found, default=None)


def create_empty(spark: SparkSession, path: str) -> bool:
    """Creates an empty file in one step; false where there is one already."""
    fs, where = _at(spark, path)
    fs.mkdirs(where.getParent())
    return fs.createNewFile(where)


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)
