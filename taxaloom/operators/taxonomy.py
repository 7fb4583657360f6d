"""Names, retired ids and lineages of a taxonomy store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import taxon_key
from . import labels

SCIENTIFIC = "scientific name"


def resolve(queries: DataFrame, names: DataFrame, nodes: DataFrame) -> DataFrame:
    """query, tax_id, matched_name, name_class, rank, ambiguous, candidates (a row for each distinct query; null id: none).

    Names are compared by their key. Scientific names go before others; within them
    the smallest id, then name, is taken; more than one candidate id is ambiguous.
    """
    asked = queries.select("query").distinct().withColumn("name_norm", taxon_key(F.col("query")))
    pick = F.min(F.struct((F.col("name_class") != SCIENTIFIC).alias("other"), "tax_id", "name_txt", "name_class"))
    found = asked.join(names, "name_norm").groupBy("query").agg(pick.alias("p"), F.array_sort(F.collect_set("tax_id")).alias("candidates"))
    ranked = found.select("query", F.col("p.tax_id").alias("tax_id"), F.col("p.name_txt").alias("matched_name"), F.col("p.name_class").alias("name_class"), (F.size("candidates") > 1).alias("ambiguous"), "candidates")
    return asked.select("query").join(ranked, "query", "left").join(nodes.select("tax_id", "rank"), "tax_id", "left").select("query", "tax_id", "matched_name", "name_class", "rank", "ambiguous", "candidates")


def canonical(rows: DataFrame, merged: DataFrame, column: str = "tax_id") -> DataFrame:
    """The rows with retired ids replaced: one hop, ids that were not retired stay."""
    hop = merged.select(F.col("old_tax_id").alias(column), F.col("new_tax_id").alias("__new"))
    return rows.join(hop, column, "left").withColumn(column, F.coalesce("__new", column)).drop("__new")


def ranks(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows (tax_id) with `rank`, as the id stands: a retired one has none."""
    return rows.join(nodes.select("tax_id", "rank"), "tax_id", "left")


def verified(rows: DataFrame, names: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """The rows (taxon_name, ncbi_id) with `confirmed`, and the id only where it is: where the authority comes to it by the name.

    The cache (name_norm, tax_id; null: known to have none) answers before the store.
    An id that is not that of its name is dropped, not mended.
    """
    keyed = rows.withColumn("name_norm", taxon_key(F.col("taxon_name")))
    pick = F.min(F.struct((F.col("name_class") != SCIENTIFIC).alias("o"), "tax_id"))
    store = names.groupBy("name_norm").agg(pick.alias("p")).select("name_norm", F.col("p.tax_id").alias("tax_id"))
    known = store if cache is None else with_cache(keyed.select("name_norm").distinct(), cache, store)
    found = keyed.join(known.select("name_norm", F.col("tax_id").alias("__id")), "name_norm", "left")
    same = F.coalesce(F.col("ncbi_id").try_cast("bigint") == F.col("__id"), F.lit(False))
    return found.withColumn("confirmed", same).withColumn("ncbi_id", F.when(same, F.col("ncbi_id"))).select(*rows.columns, "confirmed")


def scientific_names(names: DataFrame) -> DataFrame:
    return names.where(F.col("name_class") == SCIENTIFIC).groupBy("tax_id").agg(F.min("name_txt").alias("name"))


def ancestors(taxa: DataFrame, nodes: DataFrame) -> DataFrame:
    """tax_id, ancestor, depth (0: itself) and rank, for each known taxon asked for.

    A path ends at a node that is its own parent, at a parent that is missing, or where
    it would come back to a node it has been at. Ancestors are the nodes whose interval
    (see labels) holds the taxon's; a store's nodes have theirs, others get them here.
    """
    tree = labels.labelled(nodes)
    asked = taxa.select(F.col("tax_id").cast("bigint")).distinct().join(tree.select("tax_id", F.col("depth").alias("deep"), F.col("low").alias("at")), "tax_id")
    found = labels.containing(asked, tree.select(F.col("tax_id").alias("ancestor"), "depth", "low", "high", "rank"))
    out = found.select("tax_id", "ancestor", (F.col("deep") - F.col("depth")).cast("int").alias("depth"), "rank")
    looped = tree.where("low is null").count()
    return out if not looped else out.unionByName(_walked(asked.where("at is null").select("tax_id"), tree.where("low is null"), looped))


def _walked(taxa: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """ancestors() of taxa whose paths run into a loop: all paths take each step together, until none can go on."""
    sql = """
        WITH RECURSIVE path(tax_id, ancestor, up, rank, depth, seen) MAX RECURSION LEVEL {most} AS (
          SELECT a.tax_id, n.tax_id, n.parent_tax_id, n.rank, 0, array(n.tax_id) FROM {taxa} a JOIN {nodes} n ON a.tax_id = n.tax_id
          UNION ALL
          SELECT p.tax_id, n.tax_id, n.parent_tax_id, n.rank, p.depth + 1, concat(p.seen, array(n.tax_id))
          FROM path p JOIN {nodes} n ON p.up = n.tax_id WHERE NOT array_contains(p.seen, n.tax_id))
        SELECT tax_id, ancestor, depth, rank FROM path"""
    return taxa.sparkSession.sql(sql, taxa=taxa, nodes=nodes.select("tax_id", "parent_tax_id", "rank"), most=most + 1)


def subtree(nodes: DataFrame, tax_id: int) -> DataFrame:
    """tax_id of a taxon and of all that lie below it: the numbers of its interval. In a loop it is every node whose path comes by."""
    tree = labels.labelled(nodes)
    own = tree.where(F.col("tax_id") == tax_id).select(F.col("low").alias("first"), F.col("high").alias("last")).first()
    if own is None:
        return tree.select("tax_id").limit(0)
    if own["first"] is not None:
        return tree.where(F.col("low").between(own["first"], own["last"])).select("tax_id")
    return ancestors(tree.where("low is null"), tree).where(F.col("ancestor") == tax_id).select("tax_id")


def below(taxa: DataFrame, tops: DataFrame, nodes: DataFrame) -> DataFrame:
    """The distinct taxa (tax_id) that are among the tops, or lie below one. Their paths are not laid out."""
    tree = labels.labelled(nodes)
    top = tree.join(tops.select("tax_id").distinct(), "tax_id", "left_semi")
    asked = taxa.select(F.col("tax_id").cast("bigint")).distinct().join(tree.select("tax_id", F.col("low").alias("at")), "tax_id")
    found = labels.containing(asked, top.select("low", "high")).select("tax_id").distinct()
    looped = tree.where("low is null").count()
    if not looped:
        return found
    walked = _walked(asked.where("at is null").select("tax_id"), tree.where("low is null"), looped)
    return found.unionByName(walked.join(tops.select(F.col("tax_id").alias("ancestor")), "ancestor", "left_semi").select("tax_id").distinct())


def lineage(closure: DataFrame, names: DataFrame) -> DataFrame:
    """tax_id and its path from the root down, as structs of tax_id, rank and name."""
    step = F.struct((-F.col("depth")).alias("o"), F.col("ancestor").alias("tax_id"), "rank", "name")
    named = closure.join(scientific_names(names).withColumnRenamed("tax_id", "ancestor"), "ancestor", "left")
    return named.groupBy("tax_id").agg(F.array_sort(F.collect_list(step)).alias("l")).select("tax_id", F.transform("l", lambda x: x.dropFields("o")).alias("lineage"))


def looked_up(asked: DataFrame, store: dict[str, DataFrame]) -> DataFrame:
    """asked (name or tax_id, as text) with tax_id (canonical), name, rank, ambiguous, candidates and lineage, from a store's tables.

    A name is resolved, an id is taken as it stands, or replaced where it was retired;
    what is not known has only nulls. lineage: the path from the root, names joined.
    """
    given = asked.select("asked").distinct().withColumn("id", F.when(F.col("asked").rlike(r"^\s*[0-9]+\s*$"), F.trim("asked").try_cast("bigint")))
    by_name = resolve(given.where("id is null").select(F.col("asked").alias("query")), store["names"], store["nodes"]).select(F.col("query").alias("asked"), "tax_id", "ambiguous", "candidates")
    by_id = canonical(given.where("id is not null").select("asked", F.col("id").alias("tax_id")), store["merged"]).withColumns({"ambiguous": F.lit(False), "candidates": F.array("tax_id")})
    found = by_name.unionByName(by_id)
    paths = lineage(ancestors(found.where("tax_id is not null").select("tax_id"), store["nodes"]), store["names"])
    text = F.array_join(F.transform("lineage", lambda x: F.coalesce(x["name"], x["tax_id"].cast("string"))), " > ")
    named = scientific_names(store["names"])
    return ranks(found, store["nodes"]).join(named, "tax_id", "left").join(paths.select("tax_id", text.alias("lineage")), "tax_id", "left").select("asked", "tax_id", "name", "rank", "ambiguous", "candidates", "lineage")


def nearest(closure: DataFrame, rank: str) -> DataFrame:
    """tax_id and its nearest ancestor, itself included, of the rank."""
    return closure.where(F.col("rank") == rank).groupBy("tax_id").agg(F.min_by("ancestor", "depth").alias(rank))


def children(nodes: DataFrame) -> DataFrame:
    """Each taxon's children; a root is not its own child."""
    return nodes.where("tax_id <> parent_tax_id").select(F.col("parent_tax_id").alias("tax_id"), F.col("tax_id").alias("child"), F.col("rank").alias("child_rank"))


def with_cache(asked: DataFrame, cache: DataFrame, resolved: DataFrame) -> DataFrame:
    """name_norm, tax_id: what the cache knows holds, a known miss too; the store answers the rest."""
    known = cache.select("name_norm", F.col("tax_id").alias("c"), F.lit(True).alias("known"))
    return asked.join(known, "name_norm", "left").join(resolved.select("name_norm", F.col("tax_id").alias("r")), "name_norm", "left").select("name_norm", F.when(F.col("known"), F.col("c")).otherwise(F.col("r")).alias("tax_id"))


def taxon_id(value: Column, kind: Column) -> Column:
    """An id given as a number or as digits; booleans and names have none."""
    return F.when((kind == "number") | value.rlike("^[0-9]+$"), value.try_cast("bigint"))


def chosen(candidates: Column, choice: Column) -> Column:
    """A choice among several candidates holds only if it is one of them."""
    return F.when(F.array_contains(candidates, choice), choice)


def quality_flags(rows: DataFrame, nodes: DataFrame, listed: DataFrame) -> DataFrame:
    """Rows (tax_id) with `flagged`: the taxon or any ancestor of it is on the list."""
    bad = below(rows, listed, nodes).withColumn("flagged", F.lit(True))
    return rows.join(bad, "tax_id", "left").withColumn("flagged", F.coalesce("flagged", F.lit(False)))
