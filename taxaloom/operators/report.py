"""Reports of scored studies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.text import escape_html
from ..sources import sinks
from . import scoring, sets

STYLE = "body{font-family:sans-serif}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:2px 6px}"


def write_reports(scored: DataFrame, per_study: DataFrame, absent: DataFrame, errors: DataFrame, folder: str) -> None:
    """scores (JSON lines by study), report as Markdown and as one HTML page's rows, under a folder.

    The page's head and its roll-ups have a few rows; per-study rows are written by as many tasks as they need.
    """
    sinks.write_lines(scoring.records(per_study, absent, errors), f"{folder}/scores")
    strata = scoring.by_stratum(scored)
    total = scoring.roll_up(scored)
    lines = [("# Scores", sinks.markdown_table(total, [])), ("## By stratum", sinks.markdown_table(strata, ["stratum", "level"])), ("## By study", sinks.markdown_table(per_study, ["study_id"]))]
    whole = None
    for k, (title, table) in enumerate(lines):
        head = table.sparkSession.createDataFrame([(k, -1, f"\n{title}\n")], "section int, part int, line string").withColumn("ord", F.array().cast("array<string>"))
        part = head.unionByName(table.withColumn("section", F.lit(k)))
        whole = part if whole is None else whole.unionByName(part)
    whole.repartitionByRange("section", "part", "ord").sortWithinPartitions("section", "part", "ord").select("line").write.mode("overwrite").text(f"{folder}/report_md")
    header = lambda t: t.sparkSession.createDataFrame([("<tr>" + "".join(f"<th>{c}</th>" for c in t.columns) + "</tr>",)], "line string").withColumn("part", F.lit(0))
    page = scored.sparkSession.createDataFrame([(0, -1, f"<!doctype html><style>{STYLE}</style><table>"), (1, 9, "</table>")], "section int, part int, line string")
    body = header(strata).unionByName(sinks.html_rows(strata).withColumn("part", F.lit(1))).withColumn("section", F.lit(0))
    page.unionByName(body).repartitionByRange("section", "part", "line").sortWithinPartitions("section", "part", "line").select("line").write.mode("overwrite").text(f"{folder}/report_html")


#: The orders in which the levels of a stratum are shown.
LEVELS = {"source_type": ("main-table", "figure", "supplement", "other"), "experiments": ("1", "2-5", "6-20", "21+")}
PAGE_STYLE = (
    "body{font-family:sans-serif;margin:2rem;max-width:72rem}table{border-collapse:collapse;width:100%}td,th{border:1px solid #bbb;padding:.3rem .5rem;text-align:right}"
    "td:first-child,th:first-child{text-align:left}.facts{display:flex;flex-wrap:wrap;gap:1rem}.fact b{display:block;font-size:1.3rem}.warning{border:1px solid #c33;padding:.6rem}"
)
NO_STORE = "No taxonomy store was there: names could not be resolved, and what rests on names (genera, name to id) counts only predictions with ids."
MEASURES = ("precision", "recall", "f1", "jaccard")


def _number(c: str, digits: int = 3) -> Column:
    return F.format_string(f"%.{digits}f", F.col(c).cast("double"))


def headline(found: dict[str, DataFrame]) -> DataFrame:
    """place, label, value: the facts at the head of a report, from the results of study_scores.score_corpus."""
    counted = found["totals"].crossJoin(found["missing"].agg(F.count("*").alias("n_missing"))).crossJoin(found["errors"].agg(F.count("*").alias("n_errors")))  # a row each
    whole = lambda c: F.col(c).cast("string")
    detail = F.concat(_number("f1"), F.lit(" (precision "), _number("precision"), F.lit(", recall "), _number("recall"), F.lit(", Jaccard "), _number("jaccard"), F.lit(")"))
    facts = [
        ("Studies scored", whole("n_studies")),
        ("Studies without a prediction, scored as all missed", whole("n_missing")),
        ("Predictions that could not be scored, left out of all figures", whole("n_errors")),
        ("F1 of taxa, all pairs together", detail),
        ("F1 of taxa, mean over pairs", _number("macro_f1")),
        ("Directions right, of matched signatures", T.percent(F.col("direction_accuracy"))),
        ("Names that came to the right id, of curated taxa that were named", T.percent(F.col("name_to_id_accuracy"))),
        ("Experiments too many", whole("over_segmentation")),
        ("Experiments too few", whole("under_segmentation")),
        ("Predicted names without an id", whole("unresolved_pred")),
        ("Curated ids without a name", whole("unresolved_gold")),
    ]
    rows = F.array(*[F.struct(F.lit(k).alias("place"), F.lit(label).alias("label"), value.alias("value")) for k, (label, value) in enumerate(facts)])
    return counted.select(F.inline(rows))


def _tables(found: dict[str, DataFrame], tree: DataFrame) -> list[tuple[str, list[str], DataFrame]]:
    """Title, column heads and rows (ord: array of strings, cells: array of strings) of each table of a report."""
    out = []
    for stratum, title in (("source_type", "By type of source"), ("experiments", "By number of experiments")):
        rows = found["by_stratum"].where(F.col("stratum") == stratum)
        place = F.format_string("%02d", F.array_position(F.array(*map(F.lit, LEVELS[stratum])), F.col("level")))
        cells = F.array(F.col("level"), (F.col("tp") + F.col("fn")).cast("string"), *map(_number, MEASURES))
        out.append((title, ["level", "curated taxa", *MEASURES], rows.select(F.array(place, "level").alias("ord"), cells.alias("cells"))))
    studies = found["studies"].join(tree.select("study_id", "has_pmc"), "study_id", "left")
    genus = sets.measures(F.col("genus_tp"), F.col("genus_fp"), F.col("genus_fn"))["f1"]
    directions = F.when(F.col("direction_judged") > 0, F.concat_ws("/", "direction_right", "direction_judged")).otherwise("-")
    numbers = [F.col(c).cast("string") for c in ("n_gold", "n_pred", "n_matched", "over_segmentation", "under_segmentation")]
    cells = F.array(F.col("study_id"), F.coalesce(F.initcap(F.col("has_pmc").cast("string")), F.lit("?")), *numbers, _number("f1"), F.format_string("%.3f", genus), directions)
    heads = ["study", "full text", "curated experiments", "predicted", "matched", "too many", "too few", "F1", "F1 of genera", "directions"]
    out.append(("By study", heads, studies.select(F.array("study_id").alias("ord"), cells.alias("cells"))))
    out.append(("Without a prediction", ["study"], found["missing"].select(F.array("study_id").alias("ord"), F.array("study_id").alias("cells"))))
    out.append(("Not scored", ["study", "error"], found["errors"].select(F.array("study_id").alias("ord"), F.array("study_id", "error").alias("cells"))))
    return out


def _line(spark: SparkSession, section: int, part: int, *lines: str) -> DataFrame:
    return spark.createDataFrame([(section, part, k, line) for k, line in enumerate(lines)], "section int, part int, k int, line string").select("section", "part", F.array(F.format_string("%06d", "k")).alias("ord"), "line")


def page(found: dict[str, DataFrame], tree: DataFrame, html: bool, has_store: bool = True, title: str = "Scores") -> DataFrame:
    """section, part, ord, line: a whole report, as Markdown or as an HTML page that needs nothing else.

    found: results of study_scores.score_corpus. Facts, strata and lists of studies are
    lines of a table until they are written in order; none is collected. Cells are
    escaped; a list without rows says so.
    """
    spark = tree.sparkSession
    cell = (lambda c: escape_html(c)) if html else (lambda c: F.regexp_replace(F.replace(c, F.lit("|"), F.lit("\\|")), r"[\r\n]+", " "))
    row = lambda cells, tag: F.concat(F.lit("<tr>"), F.array_join(F.transform(cells, lambda c: F.concat(F.lit(f"<{tag}>"), cell(F.coalesce(c, F.lit(""))), F.lit(f"</{tag}>"))), ""), F.lit("</tr>")) if html else F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: cell(F.coalesce(c, F.lit("")))), " | "), F.lit(" |"))
    opening = [f"<!doctype html><html><head><meta charset=\"utf-8\"><title>{title}</title><style>{PAGE_STYLE}</style></head><body>", f"<h1>{title}</h1>"] if html else [f"# {title}", ""]
    if not has_store:
        opening += [f'<p class="warning">{NO_STORE}</p>'] if html else [f"> {NO_STORE}", ""]
    facts = headline(found)
    said = F.concat(F.lit('<div class="fact"><b>'), cell(F.col("value")), F.lit("</b>"), cell(F.col("label")), F.lit("</div>")) if html else F.concat(F.lit("- "), F.col("label"), F.lit(": **"), F.col("value"), F.lit("**"))
    parts = [_line(spark, 0, 0, *opening, *(['<div class="facts">'] if html else []))]
    parts.append(facts.select(F.lit(0).alias("section"), F.lit(1).alias("part"), F.array(F.format_string("%06d", "place")).alias("ord"), said.alias("line")))
    if html:
        parts.append(_line(spark, 0, 2, "</div>"))
    for k, (name, heads, rows) in enumerate(_tables(found, tree), 1):
        listed = F.array(*map(F.lit, heads))
        top = spark.range(1).select(F.lit(k).alias("section"), F.lit(1).alias("part"), F.array(F.lit("0")).alias("ord"), row(listed, "th").alias("line"))
        none = rows.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(k).alias("section"), F.lit(2).alias("part"), F.array(F.lit("")).alias("ord"), row(F.array(F.lit("(none)"), *[F.lit("")] * (len(heads) - 1)), "td").alias("line"))
        body = rows.select(F.lit(k).alias("section"), F.lit(2).alias("part"), "ord", row(F.col("cells"), "td").alias("line"))
        before = [f"<h2>{name}</h2>", "<table>"] if html else ["", f"## {name}", ""]
        parts += [_line(spark, k, 0, *before), top, none, body]
        if html:
            parts.append(_line(spark, k, 3, "</table>"))
        else:
            parts.append(_line(spark, k, 1, "|" + "|".join(["---", *["---:"] * (len(heads) - 1)]) + "|").withColumn("ord", F.array(F.lit("1"))))
    if html:
        parts.append(_line(spark, 99, 0, "</body></html>"))
    return reduce(DataFrame.unionByName, parts)


def write_pages(found: dict[str, DataFrame], tree: DataFrame, folder: str, has_store: bool = True) -> None:
    """scores (JSON lines), report_md and report_html under a folder; files of a report follow one another."""
    sinks.write_lines(scoring.records(found["studies"], found["missing"], found["errors"]), f"{folder}/scores")
    for name, html in (("report_md", False), ("report_html", True)):
        order = ["section", "part", "ord"]
        page(found, tree, html, has_store).repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.mode("overwrite").text(f"{folder}/{name}")


def _figure_numbers(rows: DataFrame) -> DataFrame:
    """gold, pred, p, r, f and genus F of counts; the genus precision is that of all predicted names."""
    gold, pred = F.col("tp") + F.col("fn"), F.col("tp") + F.col("fp")
    p, r = sets.ratio(F.col("tp"), pred), sets.ratio(F.col("tp"), gold)
    gp, gr = sets.ratio(F.col("genus_tp"), pred), sets.ratio(F.col("genus_tp"), gold)
    return rows.withColumns({"gold": gold, "pred": pred, "p": p, "r": r, "f": sets.ratio(2 * p * r, p + r), "gf": sets.ratio(2 * gp * gr, gp + gr)})


def figure_page(scores: DataFrame) -> DataFrame:
    """section, part, ord, line: a report on scoring.figure_scores(), by figure and by type of figure, as Markdown."""
    spark = scores.sparkSession
    two = lambda c: F.format_string("%.2f", c)
    bar = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *[F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), r"[\r\n]+", " ") for c in cells]), F.lit(" |"))
    judged = F.concat_ws("/", "direction_right", "direction_judged")
    one = _figure_numbers(scores)
    unknown = F.when(F.col("direction_unknown") > 0, F.concat(F.lit(" (+"), "direction_unknown", F.lit(" unknown)"))).otherwise("")
    each = bar([F.col("figure").cast("string"), F.col("figure_type"), F.col("gold").cast("string"), F.col("pred").cast("string"), F.concat_ws("/", two("p"), two("r"), two("f")), two("gf"), F.concat(judged, unknown)])
    by_figure = one.select(F.lit(0).alias("section"), F.lit(1).alias("part"), F.array(F.coalesce("figure_type", F.lit("")), F.col("figure").cast("string")).alias("ord"), each.alias("line"))
    summed = scores.groupBy("figure_type").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "genus_tp", "direction_right", "direction_judged")])
    share = F.when(F.col("direction_judged") > 0, F.concat(judged, F.format_string(" (%.0f%%)", 100 * F.col("direction_right") / F.col("direction_judged")))).otherwise("-")
    of_type = bar([F.col("figure_type"), F.col("n").cast("string"), two("f"), two("gf"), share])
    by_type = _figure_numbers(summed).select(F.lit(1).alias("section"), F.lit(1).alias("part"), F.array(F.coalesce("figure_type", F.lit(""))).alias("ord"), of_type.alias("line"))
    heads = [_line(spark, 0, 0, "| figure | type | curated | predicted | P/R/F1 | F1 of genera | directions |", "|---|---|---:|---:|---|---:|---|"), _line(spark, 1, 0, "", "## By type of figure", "", "| type | n | F1 | F1 of genera | directions |", "|---|---:|---:|---:|---|")]
    return reduce(DataFrame.unionByName, [*heads, by_figure, by_type])


def write_figures(scores: DataFrame, folder: str) -> None:
    """results (JSON lines by figure) and report_md under a folder."""
    sinks.write_lines(scores.select(F.col("figure").alias("study_id"), F.to_json(F.struct(*scores.columns)).alias("line")), f"{folder}/results")
    order = ["section", "part", "ord"]
    figure_page(scores).repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.mode("overwrite").text(f"{folder}/report_md")
