"""Queries on keyed normalisation, the curated tree and set joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import curated, normalize
from ..operators import analytics
from ..sources.dump import COLUMNS, ORDER
from ..sources.services import batches
from ..streaming import events
from .registry import Tables, query

LINE_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag")


@query(
    """SELECT l_orderkey, l_partkey AS first_part, l_returnflag AS first_flag FROM
      (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_returnflag) AS r FROM lineitem) WHERE r = 1"""
)
def first_wins_dedupe(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("o", F.struct(*LINE_ORDER[1:]))
    first = normalize.first_wins(rows, "l_orderkey", "o", ["l_partkey", "l_returnflag"])
    return first.select("l_orderkey", F.col("l_partkey").alias("first_part"), F.col("l_returnflag").alias("first_flag"))


@query(
    """SELECT l_partkey, arg_max(p_name || '#' || l_linenumber, k) AS last_name, count(*) AS links FROM (SELECT l_partkey, p_name, l_linenumber, l_orderkey * 100 + l_linenumber AS k FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1"""
)
def explode_lineage_last_wins(t: Tables) -> DataFrame:
    name = F.concat("p_name", F.lit("#"), "l_linenumber")
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("l_partkey", name.alias("last_name"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("k"))
    last = normalize.last_wins(rows, "l_partkey", F.col("k"), ["last_name"]).drop("__first")
    return last.join(rows.groupBy("l_partkey").agg(F.count("*").alias("links")), "l_partkey")


def _dump(t: Tables) -> DataFrame:
    """The lines as a flat dump: a customer is a study, an order an experiment, a line a signature unless its flag is N."""
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    text = lambda c: F.col(c).cast("string")
    given = {
        "Study": text("o_custkey"), "PMID": text("o_custkey"), "Experiment": text("o_orderkey"), "BSDB ID": F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "Condition": F.concat_ws(",", "o_orderpriority", "o_orderstatus"),
        "Signature page name": F.when(F.col("l_returnflag") != "N", F.concat(F.lit("Signature "), "l_linenumber")).otherwise("NA"), "Abundance in Group 1": F.when(F.col("l_returnflag") == "A", "increased").otherwise("decreased"), "NCBI Taxonomy IDs": F.concat_ws(";", F.concat(F.lit("1|"), "l_partkey"), text("l_suppkey")), "MetaPhlAn taxon names": F.lit("k__root|s__part,s__supplier"),
    }
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return rows.select(order.alias(ORDER), *[given.get(c, F.lit("NA")).alias(c) for c in COLUMNS])


SIGNED = "count(*) FILTER (WHERE l_returnflag <> 'N')"


@query(f"SELECT CAST(o_custkey AS VARCHAR) AS uid, o_custkey AS pmid, count(DISTINCT o_orderkey) AS experiments, {SIGNED} AS signatures, 2 * {SIGNED} AS taxa FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2")
def nested_summary(t: Tables) -> DataFrame:
    """Studies as the loader nests them."""
    s = normalize.load_studies(_dump(t))
    total = lambda f: F.aggregate("experiments", F.lit(0).cast("long"), lambda n, e: n + f(e))
    none = F.lit(0).cast("long")
    return s.select("uid", "pmid", F.size("experiments").cast("long").alias("experiments"), total(lambda e: F.when(e["signatures"].isNull(), none).otherwise(F.size(e["signatures"]).cast("long"))).alias("signatures"), total(lambda e: F.when(e["signatures"].isNull(), none).otherwise(F.aggregate(e["signatures"], none, lambda n, g: n + F.size(g["taxa"])))).alias("taxa"))


@query(f"SELECT count(DISTINCT o_custkey) AS studies, count(DISTINCT o_orderkey) AS experiments, {SIGNED} AS signatures FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def summarize_studies(t: Tables) -> DataFrame:
    return normalize.summarize(normalize.load_studies(_dump(t)))


@query(
    f"""WITH f AS (SELECT o_custkey AS c, min(o_orderkey) AS first FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY 1), stop AS (SELECT first FROM f ORDER BY first LIMIT 1 OFFSET 25)
    SELECT count(DISTINCT o_custkey) AS studies, count(DISTINCT o_orderkey) AS experiments, {SIGNED} AS signatures FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey < coalesce((SELECT first FROM stop), 9223372036854775807)"""
)
def limit_studies(t: Tables) -> DataFrame:
    """Reading stops at the row of a 26th study."""
    return normalize.summarize(normalize.load_studies(_dump(t), limit=25))


@query(
    """SELECT count(DISTINCT o_custkey) AS studies, count(DISTINCT o_orderkey) AS experiments, count(DISTINCT (l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS signatures, 2 * count(*) AS signatures_taxa,
      (SELECT count(*) FROM (SELECT 1 UNION SELECT l_partkey FROM lineitem UNION SELECT l_suppkey FROM lineitem)) AS taxa FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
)
def split_dump_counts(t: Tables) -> DataFrame:
    """Rows of the five relational tables."""
    tables = normalize.split_dump(_dump(t))
    out = None
    for name, rows in tables.items():
        one = rows.agg(F.count("*").alias(name))
        out = one if out is None else out.crossJoin(one)  # a row on each side
    return out


def _tables(t: Tables) -> dict[str, DataFrame]:
    """The test tables as a dump's relational tables."""
    blank = lambda *names: [F.lit("").alias(n) for n in names]
    o = t.orders.select(F.col("o_orderkey").cast("string").alias("experiment_id"), F.col("o_custkey").cast("string").alias("study_id"), F.col("o_orderpriority").alias("experiment_name"), F.col("o_orderstatus").alias("body_site"), F.concat_ws(",", "o_orderpriority", "o_orderstatus").alias("condition"), *blank("statistical_test", "group_0_name", "group_1_name", "sequencing_type", "mht_correction"))
    ids = F.concat_ws("/", "l_orderkey", "l_returnflag")
    flag = F.when(F.col("l_returnflag") == "A", "increased").when(F.col("l_returnflag") == "R", "decreased").otherwise("NA")
    s = t.lineitem.select(ids.alias("signature_id"), F.col("l_orderkey").cast("string").alias("experiment_id"), F.col("l_returnflag").alias("signature_name"), F.lit("Figure 1").alias("source"), flag.alias("abundance_in_group_1"), F.lit("Complete").alias("curation_state")).distinct()
    link = t.lineitem.select(ids.alias("signature_id"), F.col("l_partkey").cast("string").alias("ncbi_id"))
    return {"studies": t.customer.select(F.col("c_custkey").cast("string").alias("study_id"), F.col("c_name").alias("pmid")), "experiments": o, "signatures": s, "signatures_taxa": link}


@query(
    """SELECT CAST(c_custkey AS VARCHAR) AS study_id, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 2 = 1 END AS has_pmc, count(DISTINCT o_orderkey) AS n_experiments, count(DISTINCT (o_orderkey, l_returnflag)) FILTER (WHERE l_returnflag IS NOT NULL) AS n_signatures,
      count(DISTINCT (o_orderkey, l_returnflag)) FILTER (WHERE l_returnflag IN ('A', 'R')) AS n_directed, count(DISTINCT (o_orderkey, l_returnflag, l_partkey)) FILTER (WHERE l_partkey IS NOT NULL) AS n_taxa
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2"""
)
def gold_join(t: Tables) -> DataFrame:
    id_map = t.customer.where("c_custkey % 3 <> 0").select(F.col("c_custkey").cast("string").alias("study_id"), F.lit("x").alias("pmcid"), F.when(F.col("c_custkey") % 2 == 1, "true").otherwise("false").alias("has_pmc"))
    tree = curated.curated_tree(_tables(t), id_map)
    count = lambda f: F.aggregate("experiments", F.lit(0).cast("long"), lambda s, e: s + F.aggregate(e["signatures"], F.lit(0).cast("long"), lambda x, g: x + f(g)))
    return tree.select(
        "study_id",
        "has_pmc",
        F.size("experiments").cast("long").alias("n_experiments"),
        count(lambda g: F.lit(1)).alias("n_signatures"),
        count(lambda g: F.when(g["direction"].isNotNull(), 1).otherwise(0)).alias("n_directed"),
        count(lambda g: F.size(g["taxa"])).alias("n_taxa"),
    )


@query(
    """WITH s AS (SELECT o_orderkey AS study_id, o_custkey AS pmid FROM orders), r AS (SELECT c_custkey AS pmid, CASE WHEN c_custkey % 4 <> 0 THEN 'PMC' || c_custkey END AS pmcid FROM customer WHERE c_custkey % 5 <> 0),
    m AS (SELECT study_id, pmcid FROM s JOIN r USING (pmid)) SELECT count(*) AS total, count(pmcid) AS with_pmc, count(*) - count(pmcid) AS without_pmc, round(count(pmcid) * 100.0 / count(*), 6) AS pct FROM m"""
)
def map_inner_dups(t: Tables) -> DataFrame:
    studies = t.orders.select(F.col("o_orderkey").alias("study_id"), F.col("o_custkey").alias("pmid"))
    c = t.customer.where("c_custkey % 5 <> 0")
    pmcid = F.when(F.col("c_custkey") % 4 != 0, F.concat(F.lit("PMC"), "c_custkey"))
    old = c.select(F.col("c_custkey").alias("pmid"), F.lit("old").alias("pmcid"), F.lit("").alias("doi"), F.lit(0).alias("ord"))
    new = c.select(F.col("c_custkey").alias("pmid"), pmcid.alias("pmcid"), F.lit("").alias("doi"), F.lit(1).alias("ord"))
    return curated.coverage(curated.mapped_studies(studies, old.unionByName(new))).withColumn("pct", F.round("pct", 6))


@query("SELECT c_custkey AS study_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def missing_pred_anti(t: Tables) -> DataFrame:
    predicted = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("study_id"))
    return curated.missing(t.customer.select(F.col("c_custkey").alias("study_id")), predicted)


@query("SELECT c_custkey AS study_id, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def smoke_semi(t: Tables) -> DataFrame:
    wanted = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("study_id"))
    return curated.selected(t.customer.select(F.col("c_custkey").alias("study_id"), "c_name"), wanted)


@query(
    """WITH b AS (SELECT o_custkey, l_partkey, l_returnflag, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    a AS (SELECT o_custkey, l_partkey, max(CASE WHEN l_linenumber % 2 = 0 THEN 'increased' ELSE 'decreased' END) AS d1 FROM b WHERE l_returnflag = 'A' GROUP BY 1, 2), r AS (SELECT o_custkey, l_partkey, max(CASE WHEN l_linenumber % 2 = 0 THEN 'increased' ELSE 'decreased' END) AS d2 FROM b WHERE l_returnflag = 'R' GROUP BY 1, 2)
    SELECT CASE WHEN d2 IS NULL THEN 'check-extracted' WHEN d1 IS NULL THEN 'resolve-reviewed' WHEN d1 = d2 THEN 'keep' ELSE 'repair' END AS verdict, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS parts FROM a FULL JOIN r USING (o_custkey, l_partkey) GROUP BY 1"""
)
def full_outer_arbitration(t: Tables) -> DataFrame:
    b = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    said = F.when(F.col("l_linenumber") % 2 == 0, "increased").otherwise("decreased")
    side = lambda f: b.where(F.col("l_returnflag") == f).groupBy("o_custkey", F.col("l_partkey").alias("name_norm")).agg(F.max(said).alias("direction"))
    return curated.arbitration(side("A"), side("R"), ["o_custkey"]).groupBy("verdict").agg(F.count("*").alias("n"), F.sum("name_norm").alias("parts"))


@query(
    """WITH d AS (SELECT d.doc_id, lower(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), ' ')) AS k, l.doc_id AS has FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) WHERE text IS NOT NULL)
    SELECT min(has) AS ncbi_id, min(doc_id) AS place FROM d GROUP BY k"""
)
def dedup_prefers_labelled(t: Tables) -> DataFrame:
    d = t.documents.where("text is not null").join(t.labels.select("doc_id", F.col("doc_id").alias("ncbi_id")).distinct(), "doc_id", "left")
    rows = d.select(F.lit(1).alias("study"), F.col("text").alias("taxon_name"), "ncbi_id", F.lit("increased").alias("direction"), F.col("doc_id").alias("ord"))
    return curated.dedup_taxa(rows, ["study"]).select("ncbi_id", F.col("ord").alias("place"))


@query(
    """WITH d AS (SELECT l_orderkey, lower(p_name) AS k, l_partkey, row_number() OVER (PARTITION BY l_orderkey, l_returnflag, lower(p_name) ORDER BY l_linenumber, l_partkey) AS r, l_returnflag FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag IN ('A', 'R'))
    SELECT l_orderkey, CASE l_returnflag WHEN 'A' THEN 0 ELSE 1 END AS place, count(*) FILTER (WHERE r = 1) AS n_taxa FROM d GROUP BY 1, 2"""
)
def signatures_of_directions(t: Tables) -> DataFrame:
    """At most two signatures an order, increased and decreased, of taxa named once each."""
    said = F.when(F.col("l_returnflag") == "A", "increased").when(F.col("l_returnflag") == "R", "decreased").otherwise("unclear")
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", said.alias("direction"), F.col("p_name").alias("taxon_name"), F.col("l_partkey").alias("ncbi_id"), F.struct("l_linenumber", "l_partkey").alias("ord"))
    made = curated.signatures_by_direction(curated.dedup_taxa(rows, ["l_orderkey"]), ["l_orderkey"])
    return made.select("l_orderkey", "place", F.size("taxa").cast("long").alias("n_taxa"))


@query("SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def grounding_contains(t: Tables) -> DataFrame:
    items = t.benchmark.select("item_id", F.col("text").alias("item"))
    return curated.grounded(t.documents.select("doc_id", "text"), items).select("doc_id", "item_id")


@query("SELECT (row_number() OVER (ORDER BY c_custkey) - 1) // 200 AS batch, c_custkey FROM customer")
def chunk_members(t: Tables) -> DataFrame:
    made = batches(t.customer.select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("ord")))
    return made.select("batch", F.explode(F.split("request", ",")).alias("id")).select("batch", F.col("id").cast("long").alias("c_custkey"))


@query(
    """WITH n AS (SELECT n_nationkey, n_name, n_regionkey, CASE WHEN n_nationkey % 2 = 0 THEN r_name ELSE 'alias' || n_nationkey END AS said FROM nation JOIN region ON n_regionkey = r_regionkey)
    SELECT n_nationkey, coalesce(r_name, n_name) AS term FROM n LEFT JOIN region ON said = r_name"""
)
def glossary_coalesce(t: Tables) -> DataFrame:
    n = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, F.col("r_name")).otherwise(F.concat(F.lit("alias"), "n_nationkey")).alias("said"))
    aliases = t.nation.select(F.concat(F.lit("alias"), "n_nationkey").alias("alias"), F.col("n_name").alias("term"))
    return analytics.terms(n, "said", t.region.select(F.col("r_name").alias("term")), aliases).select("n_nationkey", "term")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus IS DISTINCT FROM lag(o_orderstatus) OVER w THEN o_orderstatus END AS changed FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def lag_difference(t: Tables) -> DataFrame:
    return analytics.changes(t.orders, "o_custkey", "o_orderkey", ["o_orderstatus"]).select("o_orderkey", F.col("o_orderstatus").alias("changed"))


@query(
    """WITH d AS (SELECT conv_id, turn, CASE WHEN length(text) % 4 <> 3 THEN length(text) % 4 END AS v FROM conversations), b AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM d)
    SELECT conv_id, min(turn) AS round, CAST(arg_min(v, turn) AS BIGINT) AS value FROM b WHERE v = p GROUP BY 1"""
)
def two_round_agreement(t: Tables) -> DataFrame:
    code = (F.length("text") % 4).cast("long")
    return curated.agreed_value(t.conversations.select("conv_id", F.col("turn").alias("round"), F.when(code != 3, code).alias("value")), ["conv_id"])


@query("SELECT user_id, count(*) AS n, count(*) FILTER (WHERE gap < 60) AS too_soon FROM (SELECT user_id, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events) GROUP BY 1")
def rate_gap(t: Tables) -> DataFrame:
    found = events.too_soon(t.events.select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id"), "user_id", 60.0, "event_id")
    return found.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if("too_soon").alias("too_soon"))


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def daily_event_counts(t: Tables) -> DataFrame:
    given = t.events.select(F.col("ts").cast("timestamp").alias("ts"), F.lit("S1").alias("stage"), F.col("event_type").alias("event"), F.col("user_id").cast("string").alias("study_id"), F.col("value").alias("latency_ms"))
    return events.stage_counts(given).select(F.date_format("start", "yyyy-MM-dd").alias("day"), F.col("event").alias("event_type"), "n", F.round("mean_latency_ms", 6).alias("mean"))


def _page_signatures(t: Tables) -> DataFrame:
    """Orders' signatures by return flag, their parts being taxa below their brand's taxon."""
    s = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "o_orderkey", "l_returnflag", "o_orderstatus").agg(F.collect_set("l_partkey").alias("taxa"))
    return s.select(F.col("o_custkey").alias("study_id"), F.col("o_orderkey").alias("experiment_id"), F.concat_ws("/", "o_orderkey", "l_returnflag").alias("signature_id"), "taxa", F.array("o_orderstatus").alias("body_site"))


#: The first brand's name in SQL and its taxon: an id no part has.
BRAND = "(SELECT min(p_brand) FROM part)"


def _closure(t: Tables) -> DataFrame:
    first = t.part.agg(F.min("p_brand").alias("b"))
    own = t.part.select(F.col("p_partkey").alias("tax_id"), F.col("p_partkey").alias("ancestor"), F.lit(0).alias("depth"))
    up = t.part.join(F.broadcast(first), F.col("p_brand") == F.col("b")).select(F.col("p_partkey").alias("tax_id"), F.lit(-1).cast("bigint").alias("ancestor"), F.lit(1).alias("depth"))  # one row
    return own.unionByName(up)


@query(f"SELECT DISTINCT o_custkey AS study_id, o_orderkey AS experiment_id, o_orderkey || '/' || l_returnflag AS signature_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE p_brand = {BRAND} AND o_orderstatus = 'F' ORDER BY 1, 2, 3 LIMIT 10")
def taxon_lookup_top(t: Tables) -> DataFrame:
    """The first ten signatures, for a page, that hold any taxon below a given one."""
    return analytics.taxon_signatures(_page_signatures(t), _closure(t), -1, True, body_site="F").select("study_id", "experiment_id", "signature_id")


@query("SELECT count(DISTINCT o_custkey) AS studies FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_partkey = 7")
def studies_with_taxon(t: Tables) -> DataFrame:
    return analytics.studies_with(_page_signatures(t), 7)


@query("SELECT o_orderpriority AS value, count(*) AS n FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH') GROUP BY 1")
def unknown_terms(t: Tables) -> DataFrame:
    known = t.spark.createDataFrame([("1-URGENT",), ("2-HIGH",)], "value string")
    return analytics.unknown_values(t.orders, "o_orderpriority", known)


@query("SELECT o_orderkey, coalesce(o_orderdate < max(l_shipdate), false) AS stale FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate")
def stale_pages(t: Tables) -> DataFrame:
    last = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("revision_date"))
    return analytics.stale_reviews(t.orders.withColumnRenamed("o_orderdate", "review_date").join(last, "o_orderkey", "left")).select("o_orderkey", "stale")


@query("SELECT r_regionkey, coalesce(string_agg(page, '|' ORDER BY n_nationkey), '') AS pages FROM region LEFT JOIN (SELECT *, 'Study/Experiment ' || n_nationkey AS page FROM nation) ON n_regionkey = r_regionkey GROUP BY 1")
def pages_in_order(t: Tables) -> DataFrame:
    pages = t.nation.select(F.col("n_regionkey").alias("parent"), F.concat(F.lit("Study/Experiment "), "n_nationkey").alias("page"))
    kids = analytics.child_pages(t.region.select(F.col("r_regionkey").alias("parent")), pages)
    return kids.select(F.col("parent").alias("r_regionkey"), F.array_join("children", "|").alias("pages"))
