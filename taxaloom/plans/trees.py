"""Queries on names, retired ids and lineages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import taxonomy
from .registry import Tables, query

NAMES = "names AS (SELECT p_partkey AS tax_id, p_name AS name_txt, CASE WHEN p_type LIKE 'STANDARD%' THEN 'scientific name' ELSE 'synonym' END AS name_class FROM part)"
TREE = """nodes AS (SELECT CAST(0 AS BIGINT) AS tax_id, CAST(0 AS BIGINT) AS parent_tax_id, 'root' AS rank UNION ALL SELECT 10 + r_regionkey, 0, 'region' FROM region UNION ALL SELECT 100 + n_nationkey, 10 + n_regionkey, 'nation' FROM nation
      UNION ALL SELECT 1000 + c_custkey, 100 + c_nationkey, 'customer' FROM customer)"""


def _names(t: Tables) -> DataFrame:
    kind = F.when(F.startswith("p_type", F.lit("STANDARD")), taxonomy.SCIENTIFIC).otherwise("synonym")
    return t.part.select(F.col("p_partkey").alias("tax_id"), F.col("p_name").alias("name_txt"), taxonomy.taxon_key(F.col("p_name")).alias("name_norm"), kind.alias("name_class"))


def _nodes(t: Tables) -> DataFrame:
    node = lambda i, p, r: [i.cast("bigint").alias("tax_id"), p.cast("bigint").alias("parent_tax_id"), F.lit(r).alias("rank")]
    root = t.spark.range(1).select(*node(F.lit(0), F.lit(0), "root"))
    out = root.unionByName(t.region.select(*node(F.col("r_regionkey") + 10, F.lit(0), "region")))
    out = out.unionByName(t.nation.select(*node(F.col("n_nationkey") + 100, F.col("n_regionkey") + 10, "nation")))
    return out.unionByName(t.customer.select(*node(F.col("c_custkey") + 1000, F.col("c_nationkey") + 100, "customer")))


@query(
    f"""WITH {NAMES}, q AS (SELECT DISTINCT 's__' || replace(p_name, ' ', '_') AS query, lower(p_name) AS k FROM part),
    j AS (SELECT query, tax_id, name_txt, name_class, row_number() OVER (PARTITION BY query ORDER BY name_class <> 'scientific name', tax_id, name_txt) AS r FROM q JOIN names ON k = lower(name_txt)),
    c AS (SELECT query, count(DISTINCT tax_id) > 1 AS ambiguous, array_to_string(list_sort(list(DISTINCT tax_id)), ',') AS candidates FROM j GROUP BY 1)
    SELECT query, tax_id, name_txt AS matched_name, name_class, CASE WHEN tax_id % 2 = 0 THEN 'species' END AS rank, ambiguous, candidates FROM j JOIN c USING (query) WHERE r = 1"""
)
def resolve_name(t: Tables) -> DataFrame:
    asked = t.part.select(F.concat(F.lit("s__"), F.replace("p_name", F.lit(" "), F.lit("_"))).alias("query"))
    nodes = t.part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("tax_id"), F.lit("species").alias("rank"))
    found = taxonomy.resolve(asked, _names(t), nodes)
    return found.withColumn("candidates", F.array_join(F.transform("candidates", lambda x: x.cast("string")), ","))


@query(
    """WITH m AS (SELECT p_partkey AS old, min(p_partkey) OVER (PARTITION BY p_name, p_brand) AS new FROM part)
    SELECT l_orderkey, count(DISTINCT coalesce(new, l_partkey)) AS taxa, CAST(sum(coalesce(new, l_partkey)) AS BIGINT) AS total FROM lineitem LEFT JOIN m ON l_partkey = old AND old <> new GROUP BY 1"""
)
def canonical_id(t: Tables) -> DataFrame:
    first = t.part.groupBy("p_name", "p_brand").agg(F.min("p_partkey").alias("new_tax_id"))
    merged = t.part.join(first, ["p_name", "p_brand"]).where("p_partkey <> new_tax_id").select(F.col("p_partkey").alias("old_tax_id"), "new_tax_id")
    return taxonomy.canonical(t.lineitem.select("l_orderkey", F.col("l_partkey").alias("tax_id")), merged).groupBy("l_orderkey").agg(F.count_distinct("tax_id").alias("taxa"), F.sum("tax_id").alias("total"))


@query(
    f"""WITH RECURSIVE {TREE}, path AS (SELECT tax_id, tax_id AS ancestor, parent_tax_id AS up, rank, 0 AS depth FROM nodes UNION ALL SELECT p.tax_id, n.tax_id, n.parent_tax_id, n.rank, depth + 1 FROM path p JOIN nodes n ON p.up = n.tax_id WHERE p.ancestor <> p.up)
    SELECT tax_id, string_agg(ancestor || ':' || rank, '>' ORDER BY depth DESC) AS path, arg_min(ancestor, depth) FILTER (WHERE rank = 'nation') AS nation FROM path GROUP BY 1"""
)
def lineage(t: Tables) -> DataFrame:
    nodes = _nodes(t)
    closure = taxonomy.ancestors(nodes, nodes)
    names = nodes.select("tax_id", F.col("rank").alias("name_txt"), F.lit(taxonomy.SCIENTIFIC).alias("name_class"))
    paths = taxonomy.lineage(closure, names).select("tax_id", F.array_join(F.transform("lineage", lambda x: F.concat_ws(":", x["tax_id"], x["name"])), ">").alias("path"))
    return paths.join(taxonomy.nearest(closure, "nation"), "tax_id", "left")


@query(
    f"""WITH RECURSIVE {TREE}, path AS (SELECT tax_id, tax_id AS ancestor, parent_tax_id AS up FROM nodes UNION ALL SELECT p.tax_id, n.tax_id, n.parent_tax_id FROM path p JOIN nodes n ON p.up = n.tax_id WHERE p.ancestor <> p.up),
    k AS (SELECT parent_tax_id AS ancestor, count(*) AS children FROM nodes WHERE tax_id <> parent_tax_id GROUP BY 1)
    SELECT ancestor AS tax_id, count(DISTINCT o_custkey) AS studies, count(*) AS orders, coalesce(any_value(children), 0) AS children FROM path JOIN orders ON tax_id = 1000 + o_custkey LEFT JOIN k USING (ancestor) GROUP BY 1"""
)
def inherited_taxa_count(t: Tables) -> DataFrame:
    nodes = _nodes(t)
    closure = taxonomy.ancestors(nodes.where("rank = 'customer'"), nodes).select("tax_id", "ancestor")
    orders = t.orders.select((F.col("o_custkey") + 1000).alias("tax_id"), "o_custkey").groupBy("tax_id").agg(F.count("*").alias("n"))
    per = closure.join(orders, "tax_id").groupBy(F.col("ancestor").alias("tax_id")).agg(F.count("*").alias("studies"), F.sum("n").alias("orders"))
    kids = taxonomy.children(nodes).groupBy("tax_id").agg(F.count("*").alias("children"))
    return per.join(kids, "tax_id", "left").select("tax_id", "studies", "orders", F.coalesce("children", F.lit(0)).alias("children"))


@query(
    f"""WITH RECURSIVE {TREE}, path AS (SELECT tax_id, tax_id AS ancestor, parent_tax_id AS up FROM nodes UNION ALL SELECT p.tax_id, n.tax_id, n.parent_tax_id FROM path p JOIN nodes n ON p.up = n.tax_id WHERE p.ancestor <> p.up)
    SELECT tax_id, bool_or(ancestor IN (10, 105)) AS flagged FROM path WHERE tax_id >= 1000 GROUP BY 1"""
)
def taxon_quality(t: Tables) -> DataFrame:
    nodes = _nodes(t)
    ours = nodes.where("rank = 'customer'").select("tax_id")
    listed = t.spark.createDataFrame([(10,), (105,)], "tax_id bigint")
    return taxonomy.quality_flags(ours, nodes, listed)
