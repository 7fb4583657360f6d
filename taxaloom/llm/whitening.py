"""PCA whitening of embeddings: exact sums, a distributed centred scatter, cyclic Jacobi rotations on the driver."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange, storage

SCALE, SHIFT = 1024.0, 100_000
COMPONENTS = 8
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
#: Whole numbers below this are safe in sums and products of longs.
SAFE = 2.0**62
#: Sweeps in which Jacobi rotations surely converge; some ten are usual.
SWEEPS = 60


class Model(NamedTuple):
    n: int
    sums: list[int]  # of each dimension
    matrix: np.ndarray  # dimension x component: eigenvectors over the roots of their eigenvalues
    explained: np.ndarray


def whole(lists: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are vectors of this many finite entries, and their entries as whole numbers."""
    rows = np.flatnonzero(pc.equal(pc.fill_null(pc.list_value_length(lists), -1), size).to_numpy(zero_copy_only=False))
    flat = pc.list_flatten(lists.take(pa.array(rows))).cast(pa.float64())
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(flat.to_numpy(zero_copy_only=False).reshape(-1, size) * SCALE)
        good = (np.abs(x) < SAFE).all(axis=1)
    return rows[good], x[good].astype(np.int64) + SHIFT


def sizes(lists: pa.Array) -> list[int]:
    return [n for n in pc.unique(pc.list_value_length(lists)).to_pylist() if n]


def total(x: np.ndarray) -> list[int]:
    """The exact sum of each column."""
    fits = not len(x) or float(np.abs(x).max()) * len(x) < SAFE
    return [int(v) for v in (x if fits else x.astype(object)).sum(axis=0)]


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exact: as longs, or as Python's integers where they may not fit."""
    fits = not len(x) or float(np.abs(x).max()) * n < SAFE / 2
    return x * np.int64(n) - np.array(sums, np.int64) if fits else x.astype(object) * n - np.array(sums, object)


def squared(y: np.ndarray) -> pa.Array:
    """The exact sum of squares of each row; null where it exceeds a long."""
    if not len(y):
        return pa.array([], pa.int64())
    top = max(abs(int(y.max())), abs(int(y.min())))
    if float(top) ** 2 * y.shape[1] < SAFE:
        return pa.array((y * y).sum(axis=1))
    exact = (y.astype(object) ** 2).sum(axis=1)
    return pa.array([int(v) if v < 2**63 else None for v in exact], pa.int64())


def centred(y: np.ndarray, n: int) -> np.ndarray:
    return (y / n).astype(np.float64)


def jacobi(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix.

    A sweep meets each pair of axes once, in rounds of disjoint pairs. A pair is turned
    while its entry matters beside the root of its two diagonal entries, which keeps
    small eigenvalues accurate; sweeps end when no pair is turned. The largest entry of
    an eigenvector is positive.
    """
    a, size = np.array(a, np.float64), len(a)
    vectors, eps = np.eye(size), np.finfo(np.float64).eps
    floor = eps**3 * max(np.abs(a).max(initial=0.0), np.finfo(np.float64).tiny)
    ring = np.arange(size + size % 2)
    for _ in range(SWEEPS):
        turned = False
        for _ in range(len(ring) - 1):
            p, q = ring[: len(ring) // 2], ring[len(ring) // 2 :][::-1]
            p, q = np.minimum(p, q), np.maximum(p, q)
            p, q = p[q < size], q[q < size]
            on = np.abs(a[p, q]) > np.maximum(eps * np.sqrt(np.abs(a[p, p] * a[q, q])), floor)
            p, q = p[on], q[on]
            if len(p):
                turned = True
                theta = (a[q, q] - a[p, p]) / (2 * a[p, q])
                t = np.where(theta < 0, -1.0, 1.0) / (np.abs(theta) + np.hypot(theta, 1.0))
                c = 1 / np.hypot(t, 1.0)
                s = t * c
                a[p], a[q] = c[:, None] * a[p] - s[:, None] * a[q], s[:, None] * a[p] + c[:, None] * a[q]
                for m in (a, vectors):
                    m[:, p], m[:, q] = m[:, p] * c - m[:, q] * s, m[:, p] * s + m[:, q] * c
                a[p, q] = a[q, p] = 0.0
            ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
        if not turned:
            break
    values = np.diag(a)
    order = np.argsort(-values, kind="stable")
    vectors = vectors[:, order]
    signs = np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(size)] < 0, -1.0, 1.0) if size else np.ones(0)
    return values[order], vectors * signs


def _sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """How many vectors there are of the commonest length, and the sums of their dimensions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list[int]] = {}
        for batch in batches:
            for size in sizes(batch.column(0)):
                x = whole(batch.column(0), size)[1]
                add = [len(x), *total(x)]
                seen[size] = [a + b for a, b in zip(seen.get(size, [0] * (size + 1)), add, strict=True)]
        for size, values in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array([size] * (size + 1), pa.int32()), pa.array(range(size + 1), pa.int32()), pa.array(list(map(Decimal, values)), pa.decimal128(38, 0))], ["size", "place", "value"])

    added = storage.stored(vectors.mapInArrow(run, "size int, place int, value decimal(38,0)").groupBy("size", "place").agg(F.sum("value").alias("value")))
    most = added.where("place = 0 and value > 0").orderBy(F.desc("value"), F.desc("size")).first()
    if most is None:
        return 0, []
    sums = added.where((F.col("size") == most["size"]) & (F.col("place") > 0)).orderBy("place").collect()  # a row a dimension
    return int(most["value"]), [int(r["value"]) for r in sums]


def _products(vectors: DataFrame, size: int, of) -> np.ndarray:
    """The sum over all vectors of the outer product of of(entries) with itself; a task sends one matrix, entry by entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            y = of(batch.column(0))
            held = y.T @ y if held is None else held + y.T @ y
        if held is not None:
            i, j = np.triu_indices(len(held))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(held[i, j])], ["i", "j", "value"])

    out = np.zeros((size, size))
    for r in vectors.mapInArrow(run, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect():  # half the square of a dimension
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["value"]
    return out


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Model | None:
    """The whitening of a table of one column of vectors; None where there are none."""
    n, sums = _sums(vectors)
    if not n:
        return None
    size = len(sums)
    scatter = _products(vectors, size, lambda lists: centred(deviations(whole(lists, size)[1], n, sums), n))
    values, axes = jacobi(scatter / n)
    trace = float(np.trace(scatter) / n)
    real = (values > trace * size * np.finfo(np.float64).eps) & (np.arange(size) < min(components, n - 1))
    return Model(n, sums, axes[:, real] / np.sqrt(values[real]), values[real] / trace if trace else values[real])


def project(lists: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows are vectors, their n * x - S, and their whitened components."""
    rows, x = whole(lists, len(model.sums))
    y = deviations(x, model.n, model.sums)
    return rows, y, centred(y, model.n) @ model.matrix


def whiten(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component.

    Entries become whole numbers x = floor(1024 c) + 100000, whose sums S are exact. The
    covariance is a sum of products of (n x - S) / n, which is free of the shift's
    rounding; its eigenvectors come from cyclic Jacobi rotations on the driver, which
    sees one number for each pair of dimensions, and go out as a matrix of components.
    identity_error is measured by one more pass over all whitened vectors.

    Rows whose vector is null, empty, or has null or non-finite entries or such that
    are not longs when scaled, give nothing; nor do vectors of another length than most
    have (of lengths as frequent, the largest). Components without variance (more than
    the rank) are left out, so equal vectors alone give no rows, and an empty table
    none. deviation is null where it exceeds a long. Null and repeated ids are rows
    like others; other columns are not read.
    """
    spark = table.sparkSession
    exchange.bound_batches(table)
    model = fit(table.select(table[vector_col]), components)
    if model is None or not model.matrix.shape[1]:
        return spark.createDataFrame([], SCHEMA)
    shared = spark.sparkContext.broadcast(model)  # dimensions times components
    k = model.matrix.shape[1]

    def with_one(lists: pa.Array) -> np.ndarray:
        w = project(lists, shared.value)[2]
        return np.column_stack([w, np.ones(len(w))])

    products = _products(table.select(table[vector_col]), k + 1, with_one) / model.n
    error = float(np.abs(products[:k, :k] - np.outer(products[k, :k], products[k, :k]) - np.eye(k)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            rows, y, w = project(batch.column(1), m)
            at = pa.array(np.repeat(np.arange(len(rows)), k))
            columns = [batch.column(0).take(pa.array(rows)).take(at), np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows)), np.full(len(at), m.n), squared(y).take(at), w.ravel(), np.tile(m.explained, len(rows)), np.full(len(at), error)]
            yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return table.select(table[id_col].cast("long"), table[vector_col]).mapInArrow(run, SCHEMA)
