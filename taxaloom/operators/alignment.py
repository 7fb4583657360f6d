"""Optimal one-to-one alignment of predicted and curated items, group by group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .sets import jaccard_of_sets, ratio

EXPERIMENT_FLOOR, SIGNATURE_FLOOR, TIE_WEIGHT = 0.15, 0.1, 0.01


def assign(weights: np.ndarray) -> list[int]:
    """The column of each row (-1: none) so that the sum of weights is largest.

    Shortest augmenting paths over reduced costs; of equal columns the first is taken.
    With more rows than columns, the columns are assigned to rows.
    """
    n, m = weights.shape
    if n > m:
        out = [-1] * n
        for column, row in enumerate(assign(weights.T)):
            if row >= 0:
                out[row] = column
        return out
    cost = weights.max(initial=0.0) - weights
    row_pot, col_pot = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for row in range(n):
        slack, via, seen = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        here, column = row, -1
        rows_in, cols_in = [row], []
        while True:
            reduced = cost[here] - row_pot[here] - col_pot
            better = ~seen & (reduced < slack)
            slack[better], via[better] = reduced[better], column
            column_next = int(np.where(seen, np.inf, slack).argmin())
            step = slack[column_next]
            row_pot[rows_in] += step
            col_pot[cols_in] -= step
            slack[~seen] -= step
            seen[column_next] = True
            cols_in.append(column_next)
            column = column_next
            if owner[column] < 0:
                break
            here = int(owner[column])
            rows_in.append(here)
        while column >= 0:
            before = int(via[column])
            owner[column] = owner[before] if before >= 0 else row
            column = before
    out = [-1] * n
    for column, row in enumerate(owner):
        if row >= 0:
            out[row] = column
    return out


def _above(weights: np.ndarray, floor: float) -> list[int]:
    """The column of each row in the best assignment, -1 where there is none or it weighs less than the floor.

    Where no two weights above zero share a row or column, all of them are assigned and nothing is searched.
    """
    if floor > 0 and weights.size and weights.min() >= 0:
        rows, columns = (k.tolist() for k in weights.nonzero())
        if len(set(rows)) == len(rows) == len(set(columns)):
            out = [-1] * len(weights)
            for i, j in zip(rows, columns, strict=True):
                out[i] = j if weights[i, j] >= floor else -1
            return out
    return [j if j >= 0 and weights[i, j] >= floor else -1 for i, j in enumerate(assign(weights))]


def best(matrix: Column, floor: float) -> Column:
    """For each row of a matrix (array<array<double>>) its column in the best assignment, or -1; a matrix to a row of the table, many to a batch."""

    @F.pandas_udf("array<int>")
    def run(matrices: pd.Series) -> pd.Series:
        weights = (np.array([list(r) for r in m], np.float64) if m is not None and len(m) else np.zeros((0, 0)) for m in matrices)
        return pd.Series([_above(w, floor) if w.size else [-1] * len(w) for w in weights], dtype=object)

    return run(matrix)


def align(scores: DataFrame, by: list[str], floor: float) -> DataFrame:
    """The pairs of the best assignment whose score reaches the floor: by, p, g, score.

    scores has a row for each pair of a group's predicted (p) and curated (g) places.
    Groups are a study's experiments or an experiment's signatures, at most a few
    hundred on a side, and are dealt over the cluster by their key.
    """
    fields = scores.select(*by, "p", "g", F.col("score").cast("double").alias("score")).schema
    cells = F.collect_list(F.struct("p", "g", F.col("score").cast("double").alias("score")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(by))
            ends, (p, g, s) = lists.offsets.to_numpy(), (lists.values.field(k).to_numpy() for k in range(3))
            of, out = [], [[], [], []]
            for k, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                ps, i = np.unique(p[a:b], return_inverse=True)
                gs, j = np.unique(g[a:b], return_inverse=True)
                weights = np.zeros((len(ps), len(gs)))
                weights[i, j] = s[a:b]
                for row, column in enumerate(_above(weights, floor)):
                    if column >= 0:
                        of.append(k)
                        for values, v in zip(out, (ps[row], gs[column], weights[row, column]), strict=True):
                            values.append(v)
            keys = [batch.column(c).take(pa.array(of, pa.int32())) for c in range(len(by))]
            found = [pa.array(v, t) for v, t in zip(out, (lists.values.field(k).type for k in range(3)), strict=True)]
            yield pa.RecordBatch.from_arrays([*keys, *found], [*by, "p", "g", "score"])

    return scores.groupBy(*by).agg(cells.alias("cells")).mapInArrow(run, fields)


def completed(pairs: DataFrame, predicted: DataFrame, curated: DataFrame, by: list[str]) -> DataFrame:
    """The pairs, with a row for each unmatched item of either side."""
    one = predicted.select(*by, "p").join(pairs, [*by, "p"], "left").select(*by, "p", "g", "score")
    rest = curated.select(*by, "g").join(pairs.select(*by, "g"), [*by, "g"], "left_anti")
    return one.unionByName(rest, allowMissingColumns=True)


def comparable(e: Column) -> Column:
    """What is compared of an experiment: its body sites, conditions and groups as sets of plain names, and its sequencing type. Worked out once for each experiment, not for each pair."""
    none = F.array().cast("array<string>")
    return F.struct(
        *[T.normal_set(F.coalesce(e[c], none)).alias(c) for c in ("body_site", "condition")],
        T.normal_set(F.array(e["group_0_name"], e["group_1_name"])).alias("groups"),
        F.nullif(e["sequencing_type"], F.lit("")).alias("sequencing_type"),
    )


def similarity(g: Column, p: Column, taxa_g: Column | None = None, taxa_p: Column | None = None) -> Column:
    """How alike two experiments are (see comparable), 0 to 1: the mean of those of body site, condition, groups and sequencing type that either side has.

    With taxa a small addition breaks ties.
    """
    a, b = g["sequencing_type"], p["sequencing_type"]
    parts = [jaccard_of_sets(g[c], p[c], None) for c in ("body_site", "condition", "groups")]
    parts.append(F.when(a.isNotNull() | b.isNotNull(), F.coalesce((a == b).cast("double"), F.lit(0.0))))
    have = F.filter(F.array(*parts), lambda x: x.isNotNull())
    mean = ratio(F.aggregate(have, F.lit(0.0), lambda s, x: s + x), F.size(have))
    return mean if taxa_g is None else mean + TIE_WEIGHT * jaccard_of_sets(taxa_g, taxa_p, 1.0)


def experiment_score(g: Column, p: Column, taxa_g: Column | None = None, taxa_p: Column | None = None) -> Column:
    """similarity() of two experiments as they are."""
    return similarity(comparable(g), comparable(p), taxa_g, taxa_p)


def field_accuracy(pairs: DataFrame, fields: dict[str, tuple[Column, Column, Column]]) -> DataFrame:
    """The share of matched pairs that agree, by field; pairs with neither side are left out, a field without any gives 0.

    fields: name to (curated, predicted, whether either side has a value).
    """
    return pairs.agg(*[ratio(F.count_if(either & g.eqNullSafe(p)), F.count_if(either)).alias(name) for name, (g, p, either) in fields.items()])
