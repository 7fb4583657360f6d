"""Interval labels of a tree: a node's interval holds those of all nodes below it, so that ancestry is a comparison of numbers."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..working import stored

#: Ids that are counted by one window among the children of one node; the counts of such stretches are added up apart.
STRETCH = 1 << 16
#: Copies of the intervals of a size class over which the points are dealt, at most.
SALTS = 64
#: Nodes with children, at 40 bytes each, that are labelled on the driver; more are labelled by the cluster.
LOCAL = 1 << 20


def _earlier(value: str, *by: str) -> Column:
    """The sum of a column over the rows before, of the same group in the order of the last column."""
    return F.coalesce(F.sum(value).over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _before(rows: DataFrame, value: str) -> DataFrame:
    """The rows (tax_id, up, value) with `before`: the sum of the value over siblings of smaller id. A family is added up by stretches of ids."""
    family = {"top": F.col("up").isNull(), "of": F.coalesce("up", F.lit(0)), "stretch": F.expr(f"tax_id div {STRETCH}")}
    near = rows.withColumns(family).withColumn("near", _earlier(value, "top", "of", "stretch", "tax_id"))
    sums = rows.withColumns(family).groupBy("top", "of", "stretch").agg(F.sum(value).alias("sum"))
    far = sums.select("top", "of", "stretch", _earlier("sum", "top", "of", "stretch").alias("far"))
    return near.join(far, ["top", "of", "stretch"]).select(*rows.columns, (F.col("near") + F.col("far")).alias("before"))


def _inner_by_cluster(inner: DataFrame, n: int) -> DataFrame:
    """tax_id, size, depth, low of the nodes with children (tax_id, up, own: itself and the children that have none); nodes in or below a loop are missing.

    In each round every node learns what the node that it points to knows and points to
    where that one points, so that rounds grow with the logarithm of the depth. A node
    that still points somewhere when no path can be that long is in a loop, or below one.
    """
    t = inner.select("tax_id", F.col("up").alias("j"), F.col("own").alias("size"), F.col("up").isNotNull().cast("long").alias("depth"))
    jumps, most = [], math.ceil(math.log2(max(n, 1))) + 1
    while True:
        t = stored(t)
        live = t.where("j is not null")
        if len(jumps) > most or live.isEmpty():
            break
        jumps.append(live.select("tax_id", "j"))
        there = t.select(F.col("tax_id").alias("j"), F.col("j").alias("jj"), F.col("depth").alias("further"))
        moved = live.join(there, "j").select("tax_id", F.col("jj").alias("j"), "size", (F.col("depth") + F.col("further")).alias("depth"))
        below = live.groupBy(F.col("j").alias("tax_id")).agg(F.sum("size").alias("below"))
        t = moved.unionByName(t.where("j is null")).join(below, "tax_id", "left").select("tax_id", "j", (F.col("size") + F.coalesce("below", F.lit(0))).alias("size"), "depth")
    sized = stored(t.where("j is null").join(inner.select("tax_id", "up"), "tax_id").select("tax_id", "up", "size", "depth"))
    place = _before(sized, "size").select("tax_id", (F.col("before") + F.col("up").isNotNull().cast("long")).alias("low"))
    for jump in jumps:
        place = stored(place)
        add = jump.join(place.select(F.col("tax_id").alias("j"), F.col("low").alias("more")), "j").select("tax_id", "more")
        place = place.join(add, "tax_id", "left").select("tax_id", (F.col("low") + F.coalesce("more", F.lit(0))).alias("low"))
    return stored(place.join(sized, "tax_id").select("tax_id", "size", "depth", "low"))


def _inner_on_driver(inner: DataFrame) -> DataFrame:
    """The same sums over at most LOCAL nodes, in arrays."""
    table = inner.select("tax_id", "up", "own").toArrow()
    ids, up, size = table["tax_id"].to_numpy(), table["up"].to_pandas().to_numpy(np.float64, na_value=np.nan), table["own"].to_numpy()
    order = np.argsort(ids)
    ids, size, n = ids[order], size[order].astype(np.int64), len(ids)
    above = table["up"].fill_null(0).to_numpy()[order]
    rooted = np.isnan(up[order])
    j = np.where(rooted, n, np.searchsorted(ids, above))  # n: nowhere
    first, depth, jumps = j, (j < n).astype(np.int64), []
    for _ in range(math.ceil(math.log2(max(n, 1))) + 2):
        live = np.flatnonzero(j < n)
        if not len(live):
            break
        jumps.append((live, j[live]))
        below = np.bincount(j[live], size[live], minlength=n).astype(np.int64)
        depth[live] += depth[j[live]]
        j, size = np.append(j, n)[j], size + below
    good = j == n
    siblings = np.lexsort((ids, first))
    running = np.cumsum(np.where(good, size, 0)[siblings])
    heads = np.searchsorted(first[siblings], first[siblings])
    low = np.empty(n, np.int64)
    low[siblings] = running - np.where(good, size, 0)[siblings] - np.concatenate([[0], running])[heads]
    low += first < n
    for live, to in jumps:
        add = low[to]
        low[live] += add
    return inner.sparkSession.createDataFrame(pa.table({"tax_id": ids[good], "size": size[good], "depth": depth[good], "low": low[good]}))


def labelled(nodes: DataFrame) -> DataFrame:
    """The nodes (tax_id, parent_tax_id, rank; ids are distinct) with depth, low and high.

    Nodes are numbered in preorder, siblings by id, those without children behind the
    others: `low` is a node's number and `high` the largest below it. A node that is its
    own parent, or whose parent is missing, is a root of depth 0; roots follow one
    another. Nodes in a loop or below one have no labels. No depth is too large, and no
    path is ever held: sizes, depths and numbers are sums that double their reach in
    each round. Nodes with children, in most trees a small part, are labelled first.
    """
    if {"depth", "low", "high"} <= set(nodes.columns):
        return nodes
    tree = nodes.select(F.col("tax_id").cast("long"), F.col("parent_tax_id").cast("long"), "rank")
    parents = tree.where("parent_tax_id <> tax_id").select(F.col("parent_tax_id").alias("tax_id")).distinct()
    missing = parents.join(tree.select("tax_id"), "tax_id", "left_anti").select(F.col("tax_id").alias("parent_tax_id"), F.lit(True).alias("missing"))
    marked = tree.join(parents.withColumn("inner", F.lit(True)), "tax_id", "left").join(missing, "parent_tax_id", "left")
    up = F.when((F.col("parent_tax_id") != F.col("tax_id")) & F.col("missing").isNull(), F.col("parent_tax_id"))
    steps = stored(marked.select("tax_id", "parent_tax_id", "rank", up.alias("up"), F.col("inner").isNotNull().alias("inner")))
    leaves = steps.where("not inner")
    own = leaves.where("up is not null").groupBy(F.col("up").alias("tax_id")).agg(F.count("*").alias("n"))
    inner = stored(steps.where("inner").join(own, "tax_id", "left").select("tax_id", "up", (1 + F.coalesce("n", F.lit(0))).alias("own"), F.coalesce("n", F.lit(0)).alias("n_leaves")))
    n = inner.count()
    labels = _inner_on_driver(inner) if n <= LOCAL else _inner_by_cluster(inner, n)
    behind = labels.join(inner, "tax_id").select(F.col("tax_id").alias("up"), (F.col("low") + F.col("size") - F.col("n_leaves")).alias("from"), (F.col("depth") + 1).alias("depth"))
    roots = labels.where("depth = 0").agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    placed = _before(leaves.select("tax_id", "up", F.lit(1).cast("long").alias("one")), "one").join(behind, "up", "left")
    at = F.col("before") + F.when(F.col("up").isNull(), F.lit(roots)).otherwise(F.col("from"))  # null below a loop
    of_leaves = placed.select("tax_id", F.when(F.col("up").isNull(), 0).otherwise(F.col("depth")).cast("long").alias("depth"), at.alias("low"), at.alias("high"))
    of_inner = labels.select("tax_id", F.col("depth").cast("long").alias("depth"), "low", (F.col("low") + F.col("size") - 1).alias("high"))
    return stored(steps.select("tax_id", "parent_tax_id", "rank").join(of_leaves.unionByName(of_inner), "tax_id", "left"))


def _copies(size_class: Column) -> Column:
    """Over how many copies a size class is dealt: large intervals are few, and many points lie in each."""
    return F.least(F.lit(SALTS), F.pow(F.lit(2), F.greatest(size_class - 8, F.lit(0)))).cast("int")


def containing(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """Each point (column `at`) beside each interval (`low`, `high`) that it lies in: a join on equal keys.

    An interval of a size from 2^c to below 2^(c+1) touches at most two blocks of 2^(c+1)
    numbers; it has a row for each, and a point a row for each size class that occurs (at
    most 63). Classes of large intervals are dealt over copies.
    """
    size_class = F.floor(F.log2((F.col("high") - F.col("low") + 1).cast("double"))).cast("int")
    classed = intervals.where("low is not null").withColumn("class", size_class)
    present = [r["class"] for r in classed.select("class").distinct().collect()]
    if not present:
        return points.limit(0).join(intervals.limit(0))
    block = lambda at, c: F.call_function("shiftright", at, (c + 1).cast("int"))
    blocks = F.array_distinct(F.array(block(F.col("low"), F.col("class")), block(F.col("high"), F.col("class"))))
    right = classed.withColumn("block", F.explode(blocks)).withColumn("salt", F.explode(F.sequence(F.lit(0), _copies(F.col("class")) - 1)))
    left = points.where("at is not null").withColumn("class", F.explode(F.array(*map(F.lit, sorted(present)))))
    left = left.withColumn("block", block(F.col("at"), F.col("class"))).withColumn("salt", F.pmod(F.xxhash64("at"), _copies(F.col("class"))).cast("int"))
    return left.join(right, ["class", "block", "salt"]).where("at between low and high").drop("class", "block", "salt")
