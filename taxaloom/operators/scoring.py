"""Scores of predicted against curated studies, and their roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import count_bucket, first_word
from . import sets


def score_pairs(pairs: DataFrame) -> DataFrame:
    """Aligned and unaligned signatures with counts on taxa and genera, and whether directions agree.

    pairs: gold_taxa, pred_taxa, gold_genera, pred_genera (null: no such side), gold_direction,
    pred_direction, gold_state, source_type. Known-bad curated sides of a pair bear no
    false positives; unmatched items are not discounted.
    """
    empty_ids, empty_words = F.array().cast("array<bigint>"), F.array().cast("array<string>")
    both = F.col("gold_taxa").isNotNull() & F.col("pred_taxa").isNotNull()
    bad = both & sets.known_bad(F.col("gold_taxa").isNotNull(), F.col("gold_state"))
    t = sets.hits(F.coalesce("gold_taxa", empty_ids), F.coalesce("pred_taxa", empty_ids))
    g = sets.hits(F.coalesce("gold_genera", empty_words), F.coalesce("pred_genera", empty_words))
    out = pairs.withColumns({"tp": t["tp"], "fp": sets.discounted(t["fp"], bad), "fn": t["fn"], "genus_tp": g["tp"], "genus_fp": sets.discounted(g["fp"], bad), "genus_fn": g["fn"]})
    judged = both & F.col("gold_direction").isNotNull()
    return out.withColumns({**{k: v for k, v in sets.measures(F.col("tp"), F.col("fp"), F.col("fn")).items()}, "direction_judged": judged, "direction_right": judged & F.coalesce(F.col("gold_direction") == F.col("pred_direction"), F.lit(False))})


def roll_up(scored: DataFrame) -> DataFrame:
    """One row: summed counts, micro measures, macro F1 over pairs, and the share of right directions."""
    m = scored.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")], sets.macro_f1(F.col("f1")).alias("macro_f1"), sets.ratio(F.count_if("direction_right"), F.count_if("direction_judged")).alias("direction_accuracy"))
    return m.select("*", *[v.alias(k) for k, v in sets.measures(F.col("tp"), F.col("fp"), F.col("fn")).items()])


def by_stratum(scored: DataFrame) -> DataFrame:
    """Micro measures by source type (unmatched predictions have none) and by the study's number of curated experiments."""
    source = sets.micro(scored.where("source_type is not null"), "source_type").select(F.lit("source_type").alias("stratum"), F.col("source_type").alias("level"), "*").drop("source_type")
    bucket = sets.micro(scored.withColumn("bucket", count_bucket(F.col("n_experiments"))), "bucket").select(F.lit("experiments").alias("stratum"), F.col("bucket").alias("level"), "*").drop("bucket")
    return source.unionByName(bucket)


def figure_scores(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Per figure: strict and genus matches of names, and directions judged over strict matches.

    gold and predicted: figure, figure_type (gold), name, direction. A prediction
    without a known direction counts apart and not as wrong.
    """
    g = gold.groupBy("figure", "figure_type", "name").agg(F.max("direction").alias("gd"))
    p = predicted.groupBy("figure", "name").agg(F.max("direction").alias("pd"))
    types = g.select("figure", "figure_type").distinct()
    both = g.drop("figure_type").join(p, ["figure", "name"], "full_outer").join(types, "figure")
    names = both.groupBy("figure", "figure_type").agg(
        F.count_if(F.col("gd").isNotNull() & F.col("pd").isNotNull()).alias("tp"),
        F.count_if(F.col("gd").isNull()).alias("fp"),
        F.count_if(F.col("pd").isNull()).alias("fn"),
        F.count_if(F.col("gd") == F.col("pd")).alias("direction_right"),
        F.count_if(F.col("gd").isNotNull() & F.col("pd").isNotNull() & (F.col("pd") != "unknown")).alias("direction_judged"),
        F.count_if(F.col("gd").isNotNull() & (F.col("pd") == "unknown")).alias("direction_unknown"),
        F.collect_set(F.when(F.col("gd").isNotNull(), first_word(F.col("name")))).alias("gg"),
        F.collect_set(F.when(F.col("pd").isNotNull(), first_word(F.col("name")))).alias("pg"),
    )
    return names.withColumn("genus_tp", F.size(F.array_intersect("gg", "pg")).cast("long")).drop("gg", "pg")


def records(scores: DataFrame, absent: DataFrame, errors: DataFrame) -> DataFrame:
    """Three kinds of report lines as JSON, for one file: scores, missing predictions and errors."""
    tagged = lambda df, kind: df.select("study_id", F.lit(kind).alias("record_type"), F.to_json(F.struct(F.lit(kind).alias("record_type"), *df.columns)).alias("line"))
    return tagged(scores, "study_score").unionByName(tagged(absent, "missing_prediction")).unionByName(tagged(errors, "scoring_error"))
