"""Embedding near-duplicates by dual traversal of cover trees."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph, storage
from .exchange import BATCH_BYTES

SIMILARITY = 0.98
#: Vectors in a block; each block has a tree of its own.
BLOCK = 2048
#: Cells that all vectors of one length are dealt into, at most; their centres, a sample of so many vectors, go to every task.
CELLS = 256
#: A node of at most so many points has no levels below it.
LEAF = 12
#: Balls of a cover tree opened at once.
OPENED = 256
#: Links held before they are merged into components.
HELD = 1 << 18
#: Slack for rounding in bounds; pairs within it are compared one by one.
SLACK = 1e-7


@dataclass
class Node:
    centre: int
    radius: float  # the farthest point of the node, exactly
    points: np.ndarray
    children: list[Node]


def tree(unit: np.ndarray) -> Node:
    """A cover tree of unit vectors: each level's balls have half the radius of the level above and cover their node.

    A point of a node opens a ball unless an earlier ball covers it. Balls are opened
    from the next points in order, many at a time, so that distances are matrix products.
    """
    top = Node(0, 0.0, np.arange(len(unit)), [])
    top.radius = float(_far(unit, np.zeros(1, np.int64), top.points).max())
    todo = [top]
    while todo:
        node = todo.pop()
        if len(node.points) <= LEAF or node.radius <= SLACK:
            continue
        left, centres, reach = node.points, np.array([node.centre]), node.radius / 2
        while len(left):
            if not len(node.children):
                left = np.concatenate([centres, left[left != node.centre]])
            centres = left[:OPENED]
            covers = _far(unit, centres, centres) <= reach
            opens: list[int] = []
            for k in range(len(centres)):
                if not covers[opens, k].any():
                    opens.append(k)
            d = _far(unit, centres[opens], left)
            near = d <= reach
            near[np.arange(len(opens)), opens] = True
            owner = np.where(near.any(axis=0), near.argmax(axis=0), len(opens))
            order = np.argsort(owner, kind="stable")
            ends = np.searchsorted(owner[order], np.arange(len(opens) + 1))
            for k in range(len(opens)):
                of = order[ends[k] : ends[k + 1]]
                child = Node(int(centres[opens[k]]), float(d[k, of].max()) if len(of) > 1 else 0.0, left[of], [])
                node.children.append(child)
                if len(of) > LEAF:
                    todo.append(child)
            left = left[np.sort(order[ends[-1] :])]
    return top


def _far(unit: np.ndarray, centres: np.ndarray, points: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (unit[centres] @ unit[points].T), 0))


def _below(node: Node) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[Node] | None]:
    """Centres, radii and numbers of points one level down; a node without levels gives its points."""
    if not node.children:
        n = len(node.points)
        return node.points, np.zeros(n), np.ones(n, np.int64), None
    below = node.children
    return np.array([c.centre for c in below]), np.array([c.radius for c in below]), np.array([len(c.points) for c in below]), below


def links(raw_a: np.ndarray, tree_a: Node, raw_b: np.ndarray, tree_b: Node, similarity: float) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
    """(False, x, y): x[k] in a links with y[k] in b for each k. (True, x, y): each of x links with each of y.

    A pair of nodes is left when its centres lie farther apart than both radii and the
    threshold's distance allow; it is taken whole when even its farthest points are near
    enough. Single points are compared at once.
    """
    bound = np.sqrt(2 - 2 * similarity)
    norm_a, norm_b = np.linalg.norm(raw_a, axis=1), np.linalg.norm(raw_b, axis=1)
    unit_a, unit_b = raw_a / norm_a[:, None], raw_b / norm_b[:, None]
    todo = [(tree_a, tree_b)]
    while todo:
        a, b = todo.pop()
        (ca, ra, na, below_a), (cb, rb, nb, below_b) = _below(a), _below(b)
        d = np.sqrt(np.maximum(2 - 2 * (unit_a[ca] @ unit_b[cb].T), 0))
        reach = ra[:, None] + rb[None, :]
        i, j = np.nonzero(d <= bound + reach + SLACK)
        near = d[i, j] + reach[i, j] < bound - SLACK
        single = (na[i] == 1) & (nb[j] == 1)
        yield False, ca[i[single & near]], cb[j[single & near]]
        doubt = single & ~near
        x, y = ca[i[doubt]], cb[j[doubt]]
        cos = np.einsum("ij,ij->i", raw_a[x], raw_b[y]) / (norm_a[x] * norm_b[y])
        yield False, x[cos >= similarity], y[cos >= similarity]
        of = lambda below, k, c: below[k] if below else Node(int(c[k]), 0.0, c[k : k + 1], [])
        rest = np.flatnonzero(~single)
        rows, starts = np.unique(i[rest], return_index=True)
        # What one node meets is taken together: nodes wholly near it, and nodes without levels, whose points are looked at.
        for row, ks in zip(rows, np.split(rest, starts[1:]), strict=False):
            node_a = of(below_a, row, ca)
            sure = [of(below_b, k, cb).points for k in j[ks[near[ks]]]]
            if sure:
                yield True, node_a.points, np.concatenate(sure)
            others = [of(below_b, k, cb) for k in j[ks[~near[ks]]]]
            todo += [(node_a, other) for other in others if other.children]
            points = [other.points for other in others if not other.children]
            if points:
                todo.append((node_a, Node(int(points[0][0]), 0.0, np.concatenate(points), [])))


class Forest:
    """Components of points, by the smallest of each; links are taken in as arrays."""

    def __init__(self, n: int) -> None:
        self.root, self.held, self.size = np.arange(n), [], 0

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        self.held.append((x, y))
        self.size += len(x)
        if self.size > HELD:
            self.merge()

    def merge(self) -> None:
        if self.held:
            x, y = (np.concatenate(side) for side in zip(*self.held, strict=True))
            self.held, self.size = [], 0
            while True:
                p, q = self.root[x], self.root[y]
                apart = p != q
                if not apart.any():
                    break
                x, y, p, q = x[apart], y[apart], p[apart], q[apart]
                np.minimum.at(self.root, np.maximum(p, q), np.minimum(p, q))
                while (self.root != (up := self.root[self.root])).any():
                    self.root = up


def _pairs_task(similarity: float):
    def run(table: pa.Table) -> pa.Table:
        blocks = np.unique(table.column("block").to_numpy())
        same = table.column("low")[0].as_py() == table.column("high")[0].as_py()
        if not same and len(blocks) < 2:
            return _rows(*[np.zeros(0, np.int64)] * 3)
        sides = []
        for b in blocks:
            part = table.filter(pa.compute.equal(table.column("block"), int(b)))
            vectors = part.column("vector").combine_chunks()
            raw = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
            sides.append((part.column("node").to_numpy(), part.column("copies").to_numpy(), raw, tree(raw / np.linalg.norm(raw, axis=1)[:, None])))
        (node_a, copies_a, raw_a, tree_a), (node_b, copies_b, raw_b, tree_b) = sides[0], sides[-1]
        count_a, count_b = np.zeros(len(node_a), np.int64), np.zeros(len(node_b), np.int64)
        shift = 0 if same else len(node_a)
        forest = Forest(len(node_a) if same else len(node_a) + len(node_b))
        for whole, x, y in links(raw_a, tree_a, raw_b, tree_b, similarity):
            if whole:
                count_a[x] += copies_b[y].sum()
                if same:
                    both = np.intersect1d(x, y)
                    count_a[both] -= copies_a[both]
                else:
                    count_b[y] += copies_a[x].sum()
                forest.add(x, np.full(len(x), y[0] + shift))
                forest.add(np.full(len(y), x[0]), y + shift)
                continue
            if same:
                x, y = x[x != y], y[x != y]
            if not len(x):
                continue
            count_a += np.bincount(x, copies_b[y], len(count_a)).astype(np.int64)
            if not same:
                count_b += np.bincount(y, copies_a[x], len(count_b)).astype(np.int64)
            forest.add(x, y + shift)
        forest.merge()
        node = node_a if same else np.concatenate([node_a, node_b])
        count = count_a if same else np.concatenate([count_a, count_b])
        linked = count > 0
        return _rows(node[linked], count[linked], node[forest.root[linked]])

    return run


def _deal(pivots: dict[int, np.ndarray], similarity: float):
    """Rows (label, dim, node, copies, vector, cells) as (label, dim, node, copies, vector, cell, guest).

    A vector lives in the cell of the nearest of the first `cells` centres. It is also a
    guest in each cell of a lesser number in which a link of it may live: such a link lies
    beyond the plane midway between both centres, so that plane must be within the
    threshold's distance.
    """
    reach = np.sqrt(2 - 2 * similarity) + SLACK

    def one(batch: pa.RecordBatch, dim: int, cells: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        centres = pivots[dim][:cells]
        raw = batch.column("vector").take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        along = (raw / np.linalg.norm(raw, axis=1)[:, None]) @ centres.T
        home = along.argmax(axis=1)
        apart = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 0))
        visits = (along[np.arange(len(rows)), home][:, None] - along <= reach * apart[home] + SLACK) & (np.arange(len(centres)) < home[:, None])
        who, where = np.nonzero(visits)
        return np.concatenate([rows, rows[who]]), np.concatenate([home, where]), np.concatenate([np.zeros(len(rows), bool), np.ones(len(who), bool)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, cells = batch.column("dim").to_numpy(), batch.column("cells").to_numpy()
            for dim, n in np.unique(np.stack([dims, cells]), axis=1).T.tolist() if batch.num_rows else []:
                rows = np.flatnonzero((dims == dim) & (cells == n))
                if n > 1 and dim in pivots:
                    rows, cell, guest = one(batch, dim, n, rows)
                else:
                    cell, guest = np.zeros(len(rows), np.int64), np.zeros(len(rows), bool)
                out = batch.select(["label", "dim", "node", "copies", "vector"]).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(cell, pa.int32()), pa.array(guest)], [*out.schema.names, "cell", "guest"])

    return run


def _meeting(points: DataFrame, similarity: float, block: int) -> DataFrame:
    """A row of each point for each two blocks (low, high) of a cell that it takes part in."""
    sized = points.withColumn("dim", F.size("vector"))
    cells = F.least(F.ceil(F.count("*") / block), F.lit(CELLS)).cast("int")
    sized = sized.join(sized.groupBy("label", "dim").agg(cells.alias("cells")), ["label", "dim"])
    pivots: dict[int, list] = {}
    for row in points.orderBy(F.xxhash64("vector", "node")).limit(CELLS).select("vector").collect():
        pivots.setdefault(len(row.vector), []).append(row.vector)
    units = {dim: np.array(v) / np.linalg.norm(np.array(v), axis=1)[:, None] for dim, v in pivots.items()}
    kind = points.schema["label"].dataType.simpleString()
    schema = f"label {kind}, dim int, node long, copies long, vector array<double>, cell int, guest boolean"
    dealt = sized.select("label", "dim", "node", "copies", "vector", "cells").mapInArrow(_deal(units, similarity), schema)
    # Blocks of the cell's own vectors come first; each meets itself, the later ones, and the blocks of guests.
    blocks = lambda who: F.ceil(F.count_if(who) / block).cast("int")
    n_blocks = dealt.groupBy("label", "dim", "cell").agg(blocks(~F.col("guest")).alias("own"), blocks(F.col("guest")).alias("guests")).where("own > 0")
    placed = dealt.join(n_blocks, ["label", "dim", "cell"])
    hashed = F.xxhash64("node")
    placed = placed.withColumn("block", F.when(F.col("guest"), F.col("own") + F.pmod(hashed, F.col("guests"))).otherwise(F.pmod(hashed, F.col("own"))).cast("int"))
    last = F.when(F.col("guest"), F.col("own")).otherwise(F.col("own") + F.col("guests")) - 1
    meeting = placed.select("label", "dim", "cell", "node", "copies", "vector", "block", F.explode(F.sequence(F.lit(0), last)).alias("other"))
    meeting = meeting.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("other")
    # Without this, the join's dealing by cell alone would serve, and put all pairs of blocks of a cell in one task.
    return meeting.repartition("label", "dim", "cell", "low", "high")


def _rows(node: np.ndarray, count: np.ndarray, to: np.ndarray) -> pa.Table:
    return pa.table({"node": pa.array(node, pa.int64()), "n": pa.array(count, pa.int64()), "to": pa.array(to, pa.int64())})


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links (other vectors of the same label with cosine >= similarity), component_id, kept.

    Equal vectors of a label are one point with a number of copies. A label of more than
    `block` points is dealt into cells around sampled centres (the top level of its cover
    tree), and a vector also visits the cells in which its links may live. A cell's points
    and guests are dealt into blocks of bounded size, so that neither a label nor a cell is
    gathered whole; each two blocks meet once, and their trees are traversed together. A
    task gives back counts and a spanning forest of its links, never the pairs, so that a
    cluster of thousands costs rows in proportion to it. The sample of centres decides
    what is compared, never what is found. Exact comparison of unstructured
    high-dimensional vectors stays quadratic in a label's points; cells and trees spare
    the comparisons that planes and covering radii rule out.

    Vectors that are null, zero, hold null or non-finite components, or have no label
    link with nothing: no links, a component of their own. Vectors of different length
    never link. Repeated rows are vectors of their own. A null id keeps its row; it is
    nobody's component id and never kept. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("vector"), vectors[label_col].alias("label"))
    # Nulls count as infinite; NaN is greater than any number.
    largest = F.array_max(F.transform("vector", lambda x: F.coalesce(F.abs(x), F.lit(float("inf")))))
    valid = F.coalesce(F.col("label").isNotNull() & (largest > 0) & (largest < float("inf")), F.lit(False))
    # Where squares might leave the range of doubles, the vector over its largest component, which has the same direction, is taken.
    in_range = (largest > 1e-100) & (largest < 1e100)
    rows = rows.withColumn("vector", F.when(valid & ~in_range, F.transform("vector", lambda x: x / largest)).otherwise(F.col("vector")))
    points = rows.where(valid).groupBy("label", "vector").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    points = storage.stored(points.withColumn("node", F.monotonically_increasing_id()))
    meeting = _meeting(points, similarity, block)
    found = storage.stored(meeting.groupBy("label", "dim", "cell", "low", "high").applyInArrow(_pairs_task(similarity), "node long, n long, to long"))
    joined = graph.components(found.select(F.col("node").alias("a"), F.col("to").alias("b")))
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    of_point = points.join(counts, "node", "left").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = of_point.groupBy("component").agg(F.min("first").alias("component_id"))
    known = of_point.join(names, "component").select("label", "vector", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    good = rows.where(valid).join(known, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~valid).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
