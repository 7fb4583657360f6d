"""Images of figures: their files are listed with the articles, their bytes are read only where they are asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds of images by the ends of their names.
MIME = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "tif": "image/tiff", "tiff": "image/tiff", "svg": "image/svg+xml"}


def _file(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(name: Column) -> Column:
    """A file's name without its folder and the end that tells an image's kind; other dots are parts of a name."""
    return F.regexp_replace(_file(name), rf"(?i)\.({'|'.join(MIME)})$", "")


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """path, stem, mime, length and content of the image files in a folder and below it. Content is read only if it is selected."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    end = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    mime = F.try_element_at(F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair]), end)
    return raw.where(end.isin(*MIME)).select("path", stem(F.col("path")).alias("stem"), mime.alias("mime"), "length", "content")


def image_paths(figures: DataFrame, images: DataFrame, name: str = "graphic_filename") -> DataFrame:
    """The figures with `path` and `mime` of their image: the first by path of those with the figure's file name, null where there is none. No bytes are read."""
    first = images.groupBy("stem").agg(F.min(F.struct("path", "mime")).alias("x")).select(F.col("stem").alias("__stem"), "x.path", "x.mime")
    return figures.join(first, stem(F.col(name)) == F.col("__stem"), "left").drop("__stem")


def with_images(figures: DataFrame, images: DataFrame, name: str = "graphic_filename") -> DataFrame:
    """The figures with path, mime and content; figures without an image have nulls.

    Which file belongs to a figure is settled without the bytes; these are read of the
    files that belong to one. As long as nothing takes content, nothing reads it.
    """
    placed = image_paths(figures, images, name)
    bytes_of = images.select(F.col("path").alias("__path"), "content")
    return placed.join(bytes_of, F.col("path") == F.col("__path"), "left").drop("__path")


def data_url(content: Column, mime: Column) -> Column:
    """An image as part of a prompt; null without an image."""
    return F.concat(F.lit("data:"), F.coalesce(mime, F.lit("image/jpeg")), F.lit(";base64,"), F.regexp_replace(F.base64(content), r"\s", ""))
