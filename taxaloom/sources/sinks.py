"""Files that jobs leave behind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import escape_html


def write_table(table: DataFrame, path: str) -> int:
    """A header CSV of strings, nulls and booleans as the readers expect them; how many rows it has."""
    text = [F.coalesce(F.lower(F.col(f"`{c}`").cast("string")) if kind == "boolean" else F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c, kind in table.dtypes]
    from pyspark.sql import Observation

    seen = Observation()
    table.select(*text).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("header", True).option("emptyValue", "").option("escape", '"').csv(path)
    return seen.get["n"]


def write_tables(tables: dict[str, DataFrame], folder: str) -> dict[str, int]:
    return {name: write_table(t, f"{folder}/{name}") for name, t in tables.items()}


def write_nested(studies: DataFrame, path: str) -> None:
    """Nested records as JSON lines; null fields are absent."""
    studies.write.mode("overwrite").json(path)


def write_lines(lines: DataFrame, path: str, order: str = "study_id") -> None:
    """A `line` column in order of a key. Files follow one another in that order; none is gathered in one task."""
    lines.repartitionByRange(order).sortWithinPartitions(order).select("line").write.mode("overwrite").text(path)


def unresolved_names(names: DataFrame, path: str) -> None:
    names.select(F.col("name").alias("line")).distinct().repartitionByRange("line").sortWithinPartitions("line").write.mode("overwrite").text(path)


def markdown_table(table: DataFrame, order: list[str]) -> DataFrame:
    """A roll-up as lines of a Markdown table (ord, line): header, rule, then rows in order."""
    bar = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    cell = lambda c: F.regexp_replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), r"[\r\n]+", " ")
    head = table.sparkSession.createDataFrame([(0, "| " + " | ".join(table.columns) + " |"), (1, "|" + "---|" * len(table.columns))], "part int, line string").withColumn("ord", F.array().cast("array<string>"))
    body = table.select(F.lit(2).alias("part"), bar([cell(c) for c in table.columns]).alias("line"), F.array(*[F.col(c).cast("string") for c in order]).alias("ord"))
    return head.unionByName(body)


def html_rows(table: DataFrame) -> DataFrame:
    """A roll-up's rows as HTML table rows, escaped."""
    cells = [F.concat(F.lit("<td>"), escape_html(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>")) for c in table.columns]
    return table.select(F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("line"))
