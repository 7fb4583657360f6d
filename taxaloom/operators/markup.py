"""Articles: JATS XML to sections, tables, figures and metadata."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

FIGURE = pa.struct([(c, pa.string()) for c in ("label", "number", "legend", "graphic_filename")])
SECTION = pa.struct([(c, pa.string()) for c in ("section_id", "title", "text")])
TABLE = pa.struct([*[(c, pa.string()) for c in ("table_id", "label", "number", "caption")], ("rows", pa.list_(pa.list_(pa.string())))])
META = pa.struct([("title", pa.string()), ("journal", pa.string()), ("year", pa.int64()), ("authors", pa.list_(pa.string())), ("doi", pa.string())])
SCHEMA = (
    "figures array<struct<label:string,number:string,legend:string,graphic_filename:string>>, sections array<struct<section_id:string,title:string,text:string>>, "
    "tables array<struct<table_id:string,label:string,number:string,caption:string,rows:array<array<string>>>>, meta struct<title:string,journal:string,year:bigint,authors:array<string>,doi:string>, parse_error string"
)
HREF = "{http://www.w3.org/1999/xlink}href"


def _said(node: ElementTree.Element | None) -> str:
    """All text below a node, on one line."""
    return " ".join("".join(node.itertext()).split()) if node is not None else ""


def _number(label: str) -> str | None:
    m = re.search(r"\d+", label)
    return m[0] if m else None


def parse_article(xml: str | None) -> dict:
    """An article's parts; a null or blank text is an article without any, broken XML too, with the parser's message."""
    empty = {"figures": [], "sections": [], "tables": [], "meta": None, "parse_error": None}
    if not (xml or "").strip():
        return empty
    try:
        root = ElementTree.fromstring(xml)
    except ElementTree.ParseError as e:
        return empty | {"parse_error": str(e)}
    figures = []
    for fig in root.iter("fig"):
        label, graphic = _said(fig.find("label")), fig.find(".//graphic")
        figures.append({"label": label, "number": _number(label), "legend": _said(fig.find("caption")), "graphic_filename": graphic.get(HREF) if graphic is not None else None})
    sections = []
    for k, sec in enumerate(root.iter("sec"), 1):
        own = [_said(p) for p in sec.findall("p")]
        sections.append({"section_id": sec.get("id") or f"sec-{k}", "title": _said(sec.find("title")), "text": "\n".join(p for p in own if p)})
    tables = []
    for k, wrap in enumerate(root.iter("table-wrap"), 1):
        label = _said(wrap.find("label"))
        rows = [[_said(c) for c in tr if c.tag in ("td", "th")] for tr in wrap.iter("tr")]
        tables.append({"table_id": wrap.get("id") or f"table-{k}", "label": label, "number": _number(label), "caption": _said(wrap.find("caption")), "rows": [r for r in rows if r]})
    years = [y.text.strip() for d in root.iter("pub-date") for y in d.findall("year") if (y.text or "").strip().isdigit()]
    authors = [" ".join(x for x in (_said(c.find("name/given-names")), _said(c.find("name/surname"))) if x) for c in root.iter("contrib") if c.get("contrib-type") == "author"]
    dois = [_said(i) for i in root.iter("article-id") if i.get("pub-id-type") == "doi"]
    meta = {"title": _said(root.find(".//article-title")) or None, "journal": _said(root.find(".//journal-title")) or None, "year": int(years[0]) if years else None, "authors": [a for a in authors if a], "doi": dois[0] if dois else None}
    return {"figures": figures, "sections": sections, "tables": tables, "meta": meta, "parse_error": None}


def parse_articles(rows: DataFrame, key: str, xml: str = "xml") -> DataFrame:
    """key, figures, sections, tables, meta and parse_error of each row's XML. Only the two columns are read; nothing is shuffled."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [parse_article(x) for x in b.column(1).to_pylist()]
            cols = [pa.array([m[c] for m in made], t) for c, t in (("figures", pa.list_(FIGURE)), ("sections", pa.list_(SECTION)), ("tables", pa.list_(TABLE)), ("meta", META), ("parse_error", pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], [b.schema.field(0).name, "figures", "sections", "tables", "meta", "parse_error"])

    return rows.select(key, xml).mapInArrow(run, f"{key} {kind}, {SCHEMA}")


#: Addresses of images on the article page.
BLOB = r"""https?://[^\s"'<>]*?/blobs/[^\s"'<>]+\.(?:jpg|jpeg|png|gif)"""


def evidence(articles: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """The parsed articles with each figure's image address, looked up by file name on the article's page (key, html), if there is one."""
    urls = pages.select(key, T.distinct_matches(F.col("html"), BLOB).alias("__urls"))
    joined = articles.join(urls, key, "left")
    with_url = F.transform("figures", lambda f: f.withField("image_url", T.match_file(f["graphic_filename"], F.coalesce("__urls", F.array().cast("array<string>")))))
    return joined.withColumn("figures", with_url).drop("__urls")


def located(tables: Column, figures: Column) -> Column:
    """The artifact to read: the first table, else figure, that speaks of differential abundance, else the first of either."""
    say = lambda x, caption: T.differential_signal(F.concat_ws(" ", x["label"], x[caption]))
    t = F.transform(tables, lambda x, i: F.struct(F.when(say(x, "caption"), 0).otherwise(2).alias("priority"), i.alias("place"), F.lit("table").alias("kind"), x["table_id"].alias("id"), T.provenance("Table", x["number"], x["label"], x["table_id"]).alias("said")))
    f = F.transform(figures, lambda x, i: F.struct(F.when(say(x, "legend"), 1).otherwise(3).alias("priority"), i.alias("place"), F.lit("figure").alias("kind"), x["graphic_filename"].alias("id"), T.provenance("Figure", x["number"], x["label"], x["graphic_filename"]).alias("said")))
    return F.array_min(F.concat(t, f))


def figure_of(label: Column, figures: Column) -> Column:
    """The first figure with the number that a source label names."""
    return F.get(F.filter(figures, lambda x: x["number"] == T.figure_number(label)), F.lit(0))
