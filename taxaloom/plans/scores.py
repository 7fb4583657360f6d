"""Queries on set scores, alignment and roll-ups. Orders stand for experiments and parts for taxa."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import count_bucket
from ..operators import alignment, scoring, sets, study_scores, taxonomy
from .joins import _tables
from .registry import Tables, query

COUNTS = """g AS (SELECT DISTINCT l_orderkey, l_partkey AS k FROM lineitem), p AS (SELECT DISTINCT l_orderkey, l_partkey AS k FROM lineitem WHERE l_discount <= 0.07 UNION SELECT DISTINCT l_orderkey, l_partkey + 1 FROM lineitem WHERE l_quantity > 45),
    c AS (SELECT l_orderkey, count(*) FILTER (WHERE a AND b) AS tp, count(*) FILTER (WHERE NOT a AND b) AS fp, count(*) FILTER (WHERE a AND NOT b) AS fn FROM
      (SELECT coalesce(g.l_orderkey, p.l_orderkey) AS l_orderkey, g.k IS NOT NULL AS a, p.k IS NOT NULL AS b FROM g FULL JOIN p ON g.l_orderkey = p.l_orderkey AND g.k = p.k) GROUP BY 1)"""


def measured(tp: str = "tp", fp: str = "fp", fn: str = "fn") -> str:
    part = lambda a, b, name: f"round(CASE WHEN {b} = 0 THEN 0.0::DOUBLE ELSE ({a})::DOUBLE / ({b}) END, 6) AS {name}"
    return ", ".join([part(tp, f"{tp} + {fp}", "precision"), part(tp, f"{tp} + {fn}", "recall"), part(f"2 * {tp}", f"2 * {tp} + {fp} + {fn}", "f1"), part(tp, f"{tp} + {fp} + {fn}", "jaccard")])


RATIOS = ("precision", "recall", "f1", "jaccard")


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in names or RATIOS})


def per_order(t: Tables) -> DataFrame:
    """l_orderkey, tp, fp, fn: a single aggregation of the lines builds both sets."""
    predicted = F.concat(F.collect_set(F.when(F.col("l_discount") <= 0.07, F.col("l_partkey"))), F.collect_set(F.when(F.col("l_quantity") > 45, F.col("l_partkey") + 1)))
    both = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("g"), predicted.alias("p"))
    return both.select("l_orderkey", *[v.alias(k) for k, v in sets.hits(F.col("g"), F.col("p")).items()])


@query(f"WITH {COUNTS} SELECT l_orderkey, tp, fp, fn, {measured()} FROM c")
def prf_per_signature(t: Tables) -> DataFrame:
    return rounded(per_order(t).withColumns(sets.measures(F.col("tp"), F.col("fp"), F.col("fn"))))


@query(f"WITH {COUNTS}, s AS (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, round(avg(CASE WHEN 2*tp+fp+fn = 0 THEN 0.0::DOUBLE ELSE 2*tp::DOUBLE/(2*tp+fp+fn) END), 6) AS macro_f1 FROM c) SELECT tp, fp, fn, macro_f1, {measured()} FROM s")
def micro_macro(t: Tables) -> DataFrame:
    scored = per_order(t).withColumns(sets.measures(F.col("tp"), F.col("fp"), F.col("fn")))
    total = scored.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], F.round(sets.macro_f1(F.col("f1")), 6).alias("macro_f1"))
    return rounded(total.withColumns(sets.measures(F.col("tp"), F.col("fp"), F.col("fn"))))


@query(
    f"""WITH {COUNTS}, o AS (SELECT c.*, o_orderpriority, count(*) OVER (PARTITION BY o_custkey) AS n FROM c JOIN orders ON l_orderkey = o_orderkey),
    s AS (SELECT 'source_type' AS stratum, o_orderpriority AS level, tp, fp, fn FROM o UNION ALL SELECT 'experiments', CASE WHEN n <= 1 THEN '1' WHEN n <= 5 THEN '2-5' WHEN n <= 20 THEN '6-20' ELSE '21+' END, tp, fp, fn FROM o),
    a AS (SELECT stratum, level, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM s GROUP BY 1, 2) SELECT stratum, level, tp, fp, fn, {measured()} FROM a"""
)
def stratified_prf(t: Tables) -> DataFrame:
    orders = t.orders.select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("source_type"))
    scored = per_order(t).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    sizes = scored.groupBy("o_custkey").agg(F.count("*").alias("n_experiments"))
    return rounded(scoring.by_stratum(scored.join(sizes, "o_custkey")))


@query(
    f"""WITH {COUNTS}, b AS (SELECT tp, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE fp END AS fp, fn FROM c JOIN orders ON l_orderkey = o_orderkey), s AS (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM b) SELECT tp, fp, fn, {measured()} FROM s"""
)
def discount_known_bad(t: Tables) -> DataFrame:
    state = F.when(F.col("o_orderstatus") != "P", "Complete")
    rows = per_order(t).join(t.orders.select("o_orderkey", state.alias("state")), F.col("l_orderkey") == F.col("o_orderkey"))
    return rounded(sets.micro(rows.withColumn("fp", sets.discounted(F.col("fp"), sets.known_bad(F.lit(True), F.col("state"))))))


@query(
    f"""WITH r AS (SELECT CASE WHEN length(text) > 1000 THEN 1 ELSE 0 END AS p, quality AS y FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL AND quality IS NOT NULL), s AS (SELECT count(*) FILTER (WHERE p = 1 AND y = 1) AS tp, count(*) FILTER (WHERE p = 1 AND y = 0) AS fp, count(*) FILTER (WHERE p = 0 AND y = 1) AS fn FROM r) SELECT tp, fp, fn, {measured()} FROM s"""
)
def label_prf(t: Tables) -> DataFrame:
    r = t.documents.where("text is not null").join(t.labels.where("quality is not null"), "doc_id").select((F.length("text") > 1000).alias("p"), (F.col("quality") == 1).alias("y"))
    s = r.agg(F.count_if(F.col("p") & F.col("y")).alias("tp"), F.count_if(F.col("p") & ~F.col("y")).alias("fp"), F.count_if(~F.col("p") & F.col("y")).alias("fn"))
    return rounded(s.withColumns(sets.measures(F.col("tp"), F.col("fp"), F.col("fn"))))


@query(
    """WITH s AS (SELECT o_orderkey, coalesce(list(DISTINCT l_partkey) FILTER (WHERE l_returnflag = 'A'), []) AS a, coalesce(list(DISTINCT l_partkey) FILTER (WHERE l_returnflag = 'R'), []) AS r FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1),
    j AS (SELECT o_orderkey, len(list_intersect(a, r)) AS i, len(list_distinct(list_concat(a, r))) AS u FROM s)
    SELECT o_orderkey, CASE WHEN u > 0 THEN round(i::DOUBLE / u, 6) END AS neutral, CASE WHEN u = 0 THEN 1.0::DOUBLE ELSE round(i::DOUBLE / u, 6) END AS agreeing FROM j"""
)
def jaccard_policies(t: Tables) -> DataFrame:
    side = lambda f: F.collect_set(F.when(F.col("l_returnflag") == f, F.col("l_partkey")))
    s = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"), "left").groupBy("o_orderkey").agg(side("A").alias("a"), side("R").alias("r"))
    return s.select("o_orderkey", F.round(sets.jaccard(F.col("a"), F.col("r"), None), 6).alias("neutral"), F.round(sets.jaccard(F.col("a"), F.col("r"), 1.0), 6).alias("agreeing"))


def _pairs(t: Tables) -> DataFrame:
    """All predicted (even keys) and curated (odd) orders of each customer, each with each."""
    ranked = t.orders.withColumn("side", F.col("o_orderkey") % 2)
    item = F.struct(F.array(F.col("o_orderpriority")).alias("body_site"), F.array(F.col("o_orderstatus")).alias("condition"), F.lit(None).cast("string").alias("group_0_name"), F.lit("").alias("group_1_name"), F.when(F.col("o_orderkey") % 3 == 0, "16S").alias("sequencing_type"))
    with_item = ranked.withColumn("item", item).withColumn("like", alignment.comparable(F.col("item")))
    p = with_item.where("side = 0").select("o_custkey", F.col("o_orderkey").alias("p"), F.col("item").alias("x"), F.col("like").alias("u"))
    g = with_item.where("side = 1").select("o_custkey", F.col("o_orderkey").alias("g"), F.col("item").alias("y"), F.col("like").alias("v"))
    return p.join(g, "o_custkey").select("o_custkey", "p", "g", "x", "y", alignment.similarity(F.col("v"), F.col("u")).alias("score"))


PAIRS = """r AS (SELECT *, o_orderkey % 2 AS side, CASE WHEN o_orderkey % 3 = 0 THEN '16S' END AS seq FROM orders),
    pairs AS (SELECT a.o_custkey, a.o_orderkey AS p, b.o_orderkey AS g, ((lower(a.o_orderpriority) = lower(b.o_orderpriority))::INT + (lower(a.o_orderstatus) = lower(b.o_orderstatus))::INT + CASE WHEN a.seq IS NULL AND b.seq IS NULL THEN 0 WHEN a.seq = b.seq THEN 1 ELSE 0 END)::DOUBLE / CASE WHEN a.seq IS NULL AND b.seq IS NULL THEN 2 ELSE 3 END AS score
      FROM r a JOIN r b ON a.o_custkey = b.o_custkey AND a.side = 0 AND b.side = 1)"""


@query(f"WITH {PAIRS} SELECT o_custkey, p, g, round(score, 6) AS score FROM pairs")
def field_overlap_matrix(t: Tables) -> DataFrame:
    return _pairs(t).select("o_custkey", "p", "g", F.round("score", 6).alias("score"))


@query()
def hungarian_alignment(t: Tables) -> DataFrame:
    """The weight of the best assignment; which pairs make it up is not unique."""
    return alignment.align(_pairs(t), ["o_custkey"], 0.0).groupBy("o_custkey").agg(F.round(F.sum("score"), 6).alias("total"))


@query(
    f"""WITH {PAIRS}, m AS (SELECT p, g, pairs.o_custkey, score FROM pairs WHERE score >= 0.15) SELECT count(*) AS n, round(count(*) FILTER (WHERE a.o_orderpriority = b.o_orderpriority)::DOUBLE / count(*), 6) AS body_site, round(count(*) FILTER (WHERE a.o_orderstatus = b.o_orderstatus)::DOUBLE / count(*), 6) AS condition,
      round(count(*) FILTER (WHERE a.o_orderkey % 3 = 0 AND b.o_orderkey % 3 = 0)::DOUBLE / count(*) FILTER (WHERE a.o_orderkey % 3 = 0 OR b.o_orderkey % 3 = 0), 6) AS sequencing_type, 0.0::DOUBLE AS group_orientation FROM m JOIN orders a ON a.o_orderkey = p JOIN orders b ON b.o_orderkey = g"""
)
def field_accuracy(t: Tables) -> DataFrame:
    pairs = _pairs(t).where(F.col("score") >= alignment.EXPERIMENT_FLOOR)
    same = lambda c: (F.col(f"y.{c}"), F.col(f"x.{c}"), F.col(f"y.{c}").isNotNull() | F.col(f"x.{c}").isNotNull())
    group = F.concat_ws("/", "x.group_0_name", "x.group_1_name")
    fields = {"body_site": same("body_site"), "condition": same("condition"), "sequencing_type": same("sequencing_type"), "group_orientation": (group, group, group != "")}
    return rounded(alignment.field_accuracy(pairs, fields).crossJoin(pairs.agg(F.count("*").alias("n"))), *fields)  # a row on each side


@query()
def signature_alignment(t: Tables) -> DataFrame:
    """All of each customer's orders, predicted (even keys) and curated (odd), aligned by their parts, with what stays alone on either side."""
    taxa = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("taxa"))
    side = lambda k, name: t.orders.where(F.col("o_orderkey") % 2 == k).select("o_custkey", F.col("o_orderkey").alias(name))
    pairs = side(0, "p").join(side(1, "g"), "o_custkey")
    with_taxa = pairs.join(taxa.select(F.col("l_orderkey").alias("p"), F.col("taxa").alias("a")), "p", "left").join(taxa.select(F.col("l_orderkey").alias("g"), F.col("taxa").alias("b")), "g", "left")
    none = F.array().cast("array<bigint>")
    scores = with_taxa.select("o_custkey", "p", "g", sets.jaccard(F.coalesce("a", none), F.coalesce("b", none), 1.0).alias("score"))
    kept = alignment.align(scores, ["o_custkey"], alignment.SIGNATURE_FLOOR)
    return alignment.completed(kept, side(0, "p"), side(1, "g"), ["o_custkey"])


@query(
    f"""WITH b AS (SELECT l_orderkey AS figure, 'part ' || l_partkey AS name, max(CASE WHEN l_returnflag = 'A' THEN 'increased' ELSE 'decreased' END) AS gd FROM lineitem GROUP BY 1, 2),
    p AS (SELECT l_orderkey AS figure, 'part ' || (l_partkey + CASE WHEN l_quantity > 45 THEN 1 ELSE 0 END) AS name, max(CASE WHEN l_linenumber = 1 THEN 'unknown' WHEN l_discount > 0.05 THEN 'increased' ELSE 'decreased' END) AS pd FROM lineitem GROUP BY 1, 2),
    j AS (SELECT coalesce(b.figure, p.figure) AS figure, gd, pd FROM b FULL JOIN p ON b.figure = p.figure AND b.name = p.name),
    f AS (SELECT o_orderpriority AS figure_type, count(*) FILTER (WHERE gd IS NOT NULL AND pd IS NOT NULL) AS tp, count(*) FILTER (WHERE gd IS NULL) AS fp, count(*) FILTER (WHERE pd IS NULL) AS fn, count(*) FILTER (WHERE gd = pd) AS direction_right, count(*) FILTER (WHERE gd IS NOT NULL AND pd <> 'unknown') AS direction_judged, count(*) FILTER (WHERE gd IS NOT NULL AND pd = 'unknown') AS direction_unknown,
      count(DISTINCT figure) FILTER (WHERE gd IS NOT NULL) AS genus_tp FROM j JOIN orders ON figure = o_orderkey GROUP BY 1)
    SELECT *, {measured()} FROM f"""
)
def figbench_score(t: Tables) -> DataFrame:
    kinds = t.orders.select(F.col("o_orderkey").alias("figure"), F.col("o_orderpriority").alias("figure_type"))
    gold = t.lineitem.select(F.col("l_orderkey").alias("figure"), F.concat(F.lit("part "), "l_partkey").alias("name"), F.when(F.col("l_returnflag") == "A", "increased").otherwise("decreased").alias("direction")).join(kinds, "figure")
    said = F.when(F.col("l_linenumber") == 1, "unknown").when(F.col("l_discount") > 0.05, "increased").otherwise("decreased")
    moved = F.col("l_partkey") + F.when(F.col("l_quantity") > 45, 1).otherwise(0)
    predicted = t.lineitem.select(F.col("l_orderkey").alias("figure"), F.concat(F.lit("part "), moved).alias("name"), said.alias("direction"))
    sums = ("tp", "fp", "fn", "direction_right", "direction_judged", "direction_unknown", "genus_tp")
    by_type = scoring.figure_scores(gold, predicted).groupBy("figure_type").agg(*[F.sum(c).alias(c) for c in sums])
    return rounded(by_type.withColumns(sets.measures(F.col("tp"), F.col("fp"), F.col("fn"))))


@query(
    """SELECT CASE WHEN c_custkey % 3 = 0 THEN 'missing_prediction' WHEN c_custkey % 7 = 1 THEN 'scoring_error' ELSE 'study_score' END AS record_type, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS studies FROM customer GROUP BY 1"""
)
def report_records(t: Tables) -> DataFrame:
    c = t.customer.select(F.col("c_custkey").alias("study_id"))
    absent, errors = c.where("study_id % 3 = 0"), c.where("study_id % 3 <> 0 and study_id % 7 = 1").withColumn("error", F.lit("x"))
    lines = scoring.records(c.where("study_id % 3 <> 0 and study_id % 7 <> 1").withColumn("f1", F.lit(0.5)), absent, errors)
    parsed = lines.select(F.get_json_object("line", "$.record_type").alias("record_type"), F.get_json_object("line", "$.study_id").cast("long").alias("s"))
    return parsed.groupBy("record_type").agg(F.count("*").alias("n"), F.sum("s").alias("studies"))


FLAG = "CASE l_returnflag WHEN 'A' THEN 1000000 WHEN 'R' THEN 2000000 ELSE 3000000 END"


def _corpus(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """A tree, predictions, names and retired ids: customers with orders with a signature a return flag.

    The predicted experiment of an open order (status O) has its order's fields; of a
    status P other ones, so that it matches none; of a finished one (F) there is none. A
    predicted signature has the parts of little discount, those of one line by a retired
    id, those of the next by name; and one part that is not known for each large line.
    Ids that hold are even and retired ones odd, so that no key makes one the other.
    """
    flag = F.expr(FLAG)
    held, retired = lambda key: F.col(key) * 2, lambda key: F.col(key) * 2 + 1
    tables = _tables(t)
    own = F.concat(F.lit("o"), "experiment_id")
    tables["experiments"] = tables["experiments"].withColumns({"body_site": own, "condition": own})
    tables["signatures_taxa"] = t.lineitem.select(F.concat_ws("/", "l_orderkey", "l_returnflag").alias("signature_id"), ((F.col("l_partkey") + flag) * 2).cast("string").alias("ncbi_id"))
    tables["signatures"] = tables["signatures"].withColumn("curation_state", F.when(F.col("signature_name") == "N", "Incomplete").otherwise("Complete"))
    from ..operators import curated

    tree = curated.curated_tree(tables)
    name = lambda key: F.concat(F.lit("g"), F.col(key) % 100, F.lit(" s"), F.col(key))
    parts = t.part.select(F.explode(F.array(*[F.col("p_partkey") + k for k in (1000000, 2000000, 3000000)])).alias("tax_id")).distinct()
    names = parts.select(held("tax_id").alias("tax_id"), name("tax_id").alias("name_txt"), name("tax_id").alias("name_norm"), F.lit(taxonomy.SCIENTIFIC).alias("name_class"))
    merged = parts.select(retired("tax_id").alias("old_tax_id"), held("tax_id").alias("new_tax_id"))
    needed = ("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag")
    lines = t.lineitem.select(*needed).repartition("l_orderkey").withColumn("tax_id", F.col("l_partkey") + flag)  # dealt once for both groupings
    by_name = F.col("l_linenumber") % 3 == 2
    given = F.when(F.col("l_linenumber") % 3 == 1, retired("tax_id")).when(~by_name, held("tax_id")).cast("string")
    taxon = F.struct(F.when(by_name, name("tax_id")).alias("taxon_name"), given.alias("ncbi_id"))
    odd = F.when(F.col("l_quantity") > 45, F.struct(F.concat(F.lit("nobody "), "l_linenumber").alias("taxon_name"), F.lit(None).cast("string").alias("ncbi_id")))
    low = F.when(F.col("l_discount") <= 0.07, taxon)
    said = F.when(F.col("l_returnflag") == "R", "decreased").otherwise("increased")
    signatures = lines.groupBy("l_orderkey", "l_returnflag").agg(F.first(said).alias("abundance_in_group_1"), F.array_sort(F.concat(F.collect_set(low), F.collect_set(odd))).alias("taxa"))
    experiments = signatures.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("abundance_in_group_1", "taxa"))).alias("signatures"))
    place = F.array(F.concat(F.when(F.col("o_orderstatus") == "P", "x").otherwise("o"), "o_orderkey"))
    none = lambda kind: F.lit(None).cast(kind)
    e = F.struct(
        place.alias("body_site"), place.alias("condition"), none("string").alias("group_0_name"), none("string").alias("group_1_name"), none("string").alias("sequencing_type"), none("array<string>").alias("statistical_test"), none("boolean").alias("mht_correction"), F.coalesce("signatures", F.array().cast(experiments.schema["signatures"].dataType)).alias("signatures")
    )
    said_orders = t.orders.where("o_orderstatus <> 'F'").join(experiments, "o_orderkey", "left")
    predictions = said_orders.groupBy(F.col("o_custkey").cast("string").alias("study_id")).agg(F.array_sort(F.collect_list(e)).cast(study_scores.PREDICTED).alias("experiments"))
    return tree, predictions, names, merged


CORPUS = f"""l AS (SELECT l.*, l_partkey + {FLAG} AS tax, o_custkey, o_orderstatus AS st FROM lineitem l JOIN orders ON l_orderkey = o_orderkey),
    g AS (SELECT DISTINCT o_custkey, l_orderkey, l_returnflag, st, tax FROM l), p AS (SELECT DISTINCT o_custkey, l_orderkey, l_returnflag, st, tax FROM l WHERE l_discount <= 0.07 AND st <> 'F'),
    pn AS (SELECT l_orderkey, l_returnflag, count(DISTINCT tax) AS named FROM l WHERE l_discount <= 0.07 AND st <> 'F' AND l_linenumber % 3 = 2 GROUP BY 1, 2),
    u AS (SELECT l_orderkey, l_returnflag, count(DISTINCT l_linenumber) AS odd FROM l WHERE l_quantity > 45 AND st <> 'F' GROUP BY 1, 2),
    s AS (SELECT o_custkey, l_orderkey, l_returnflag, any_value(st) AS st, count(DISTINCT tax) AS ng, count(DISTINCT tax % 100) AS gg FROM l GROUP BY 1, 2, 3),
    q AS (SELECT l_orderkey, l_returnflag, count(*) AS np, count(DISTINCT tax % 100) AS gp FROM p GROUP BY 1, 2),
    z AS (SELECT s.*, coalesce(np, 0) AS np, coalesce(gp, 0) AS gp, coalesce(odd, 0) AS odd, coalesce(named, 0) AS named, st = 'O' AND coalesce(np, 0)::DOUBLE / ng >= 0.1 AS hit FROM s LEFT JOIN q USING (l_orderkey, l_returnflag) LEFT JOIN u USING (l_orderkey, l_returnflag) LEFT JOIN pn USING (l_orderkey, l_returnflag)),
    e AS (SELECT o_custkey, l_returnflag, np AS tp, 0 AS fp, ng - np AS fn, gp AS gtp, 0 AS gfp, gg - gp AS gfn, odd AS unknown, named AS found, 1 AS judged FROM z WHERE hit
      UNION ALL SELECT o_custkey, l_returnflag, 0, 0, ng, 0, 0, gg, 0, 0, 0 FROM z WHERE NOT hit
      UNION ALL SELECT o_custkey, l_returnflag, 0, np, 0, 0, gp, 0, odd, 0, 0 FROM z WHERE NOT hit AND st <> 'F'),
    f AS (SELECT *, CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0::DOUBLE ELSE 2 * tp::DOUBLE / (2 * tp + fp + fn) END AS f1, judged = 1 AND l_returnflag IN ('A', 'R') AS dir FROM e)"""


@query(
    f"""WITH {CORPUS}, n AS (SELECT c_custkey, count(o_orderkey) AS n_gold, count(*) FILTER (WHERE o_orderstatus <> 'F') AS n_pred, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_matched FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1),
    a AS (SELECT o_custkey, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(gtp) AS BIGINT) AS genus_tp, CAST(sum(gfp) AS BIGINT) AS genus_fp, CAST(sum(gfn) AS BIGINT) AS genus_fn, CAST(sum(unknown) AS BIGINT) AS unresolved_pred, CAST(sum(found) AS BIGINT) AS names_found, count(*) FILTER (WHERE dir) AS direction_judged, avg(f1) AS macro_f1 FROM f GROUP BY 1),
    b AS (SELECT CAST(c_custkey AS VARCHAR) AS study_id, n_gold, n_pred, n_matched, greatest(n_pred - n_gold, 0) AS over_segmentation, greatest(n_gold - n_pred, 0) AS under_segmentation, {", ".join(f"coalesce({c}, 0) AS {c}" for c in ("tp", "fp", "fn", "genus_tp", "genus_fp", "genus_fn", "unresolved_pred", "names_found", "direction_judged"))}, round(coalesce(macro_f1, 0.0::DOUBLE), 6) AS macro_f1 FROM n LEFT JOIN a ON o_custkey = c_custkey)
    SELECT *, names_found AS names_right, direction_judged AS direction_right, {measured()} FROM b"""
)
def score_studies(t: Tables) -> DataFrame:
    """Every customer as a study, from alignment to its sums."""
    found = study_scores.score_corpus(*_corpus(t))["studies"]
    return rounded(found.drop("unresolved_gold", "macro_genus_f1"), "macro_f1", *RATIOS)


@query(
    f"""WITH {CORPUS}, k AS (SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY 1), d AS (SELECT f.*, n FROM f JOIN k ON c = o_custkey),
    strata AS (SELECT 'source_type' AS stratum, 'figure' AS level, tp, fp, fn FROM d WHERE NOT (tp = 0 AND fn = 0) UNION ALL SELECT 'experiments', CASE WHEN n <= 1 THEN '1' WHEN n <= 5 THEN '2-5' WHEN n <= 20 THEN '6-20' ELSE '21+' END, tp, fp, fn FROM d),
    sums AS (SELECT stratum, level, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM strata GROUP BY 1, 2) SELECT stratum, level, tp, fp, fn, {measured()} FROM sums"""
)
def score_corpus(t: Tables) -> DataFrame:
    return rounded(study_scores.score_corpus(*_corpus(t))["by_stratum"])


@query("SELECT CAST(o_custkey AS VARCHAR) AS study_id, 'figure' AS source_type, count(DISTINCT (l_orderkey, l_returnflag)) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def source_types_of_studies(t: Tables) -> DataFrame:
    return study_scores.source_type_counts(_corpus(t)[0])


@query(
    f"""WITH {CORPUS}, said AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus <> 'F'), ids AS (SELECT DISTINCT o_custkey AS k FROM l WHERE l_discount <= 0.07 AND st <> 'F' AND l_linenumber % 3 <> 2),
    b AS (SELECT c_custkey, CASE WHEN said.k IS NULL THEN 'scored' WHEN c_custkey % 7 = 1 THEN '/experiments: string where array is expected' WHEN c_custkey % 7 = 5 THEN '/: no JSON'
      WHEN c_custkey % 7 = 3 AND ids.k IS NOT NULL THEN '/experiments/#/signatures/#/taxa/#/ncbi_id: array where string or bigint or decimal or double or boolean is expected' ELSE 'scored' END AS outcome FROM customer LEFT JOIN said ON said.k = c_custkey LEFT JOIN ids ON ids.k = c_custkey),
    a AS (SELECT o_custkey, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM f GROUP BY 1)
    SELECT CAST(c_custkey AS VARCHAR) AS study_id, outcome, CASE WHEN outcome = 'scored' THEN coalesce(tp, 0) END AS tp, CASE WHEN outcome = 'scored' THEN coalesce(fp, 0) END AS fp, CASE WHEN outcome = 'scored' THEN coalesce(fn, 0) END AS fn FROM b LEFT JOIN a ON o_custkey = c_custkey"""
)
def scoring_errors(t: Tables) -> DataFrame:
    """Records as they were written, three studies in seven of them faulty: each of these gives an error, all others are scored."""
    tree, predictions, names, merged = _corpus(t)
    whole = F.to_json(F.struct("experiments"))
    turn = F.col("study_id").cast("long") % 7
    record = F.when(turn == 1, '{"experiments": "none found"}').when(turn == 5, F.lit("{")).when(turn == 3, F.regexp_replace(whole, r'"ncbi_id":("\d+")', r'"ncbi_id":[$1]')).otherwise(whole)
    out = study_scores.score_corpus(tree, predictions.select("study_id", record.alias("record")), names, merged)
    failed = out["errors"].select("study_id", F.regexp_replace("error", r"/\d+", "/#").alias("outcome"), *[F.lit(None).cast("long").alias(c) for c in ("tp", "fp", "fn")])
    return out["studies"].select("study_id", F.lit("scored").alias("outcome"), "tp", "fp", "fn").unionByName(failed)
