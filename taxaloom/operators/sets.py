"""Counts and ratios of set comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import let


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def hits(gold: Column, predicted: Column) -> dict[str, Column]:
    """tp, fp and fn of two arrays taken as sets."""
    return {
        "tp": F.size(F.array_intersect(gold, predicted)).cast("long"),
        "fp": F.size(F.array_except(predicted, gold)).cast("long"),
        "fn": F.size(F.array_except(gold, predicted)).cast("long"),
    }


def measures(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Precision, recall, F1 and Jaccard; 0 where there is nothing to divide by."""
    return {"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn), "jaccard": ratio(tp, tp + fp + fn)}


def jaccard(a: Column, b: Column, both_empty: float | None) -> Column:
    """Of two arrays as sets. Two policies exist for two empty sets: null (no signal) and 1 (agreement)."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(both_empty).cast("double")).otherwise(F.size(F.array_intersect(a, b)).cast("double") / union)


def jaccard_of_sets(a: Column, b: Column, both_empty: float | None) -> Column:
    """jaccard() of arrays that repeat nothing: their sizes tell that of the union, and without a common item neither is compared further."""
    shared = F.when(F.arrays_overlap(a, b), F.size(F.array_intersect(a, b))).otherwise(0)
    none = F.when(F.size(a) + F.size(b) == 0, F.lit(both_empty).cast("double")).otherwise(0.0)
    return let(shared, lambda n: F.when(n > 0, n.cast("double") / (F.size(a) + F.size(b) - n)).otherwise(none))


def micro(rows: DataFrame, *by: str) -> DataFrame:
    """Measures of summed counts, for each group."""
    summed = rows.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return summed.select(*by, "tp", "fp", "fn", *[v.alias(k) for k, v in measures(F.col("tp"), F.col("fp"), F.col("fn")).items()])


def macro_f1(f1: Column) -> Column:
    """The mean over pairs; pairs without any member count as 0, no pairs give 0. Summed as decimals, so that the order of the rows does not tell."""
    return F.coalesce(F.round(F.avg(f1.cast("decimal(20,18)")), 15).cast("double"), F.lit(0.0))


def discounted(fp: Column, known_bad: Column) -> Column:
    """No false positives where the curated side is known to be incomplete."""
    return F.when(known_bad, F.lit(0).cast("long")).otherwise(fp)


def known_bad(has_gold: Column, state: Column) -> Column:
    return has_gold & (state.isNull() | (state == "Incomplete"))
