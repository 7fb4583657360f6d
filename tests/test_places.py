"""Scores where the lists of a prediction come in another order each time they are read, as those of a shuffle do."""

import random

from pyspark.sql import functions as F

from taxaloom.operators import study_scores, taxonomy

SIGNATURE = "signature_id string, signature_name string, source string, source_type string, direction string, curation_state string, taxa array<bigint>"
EXPERIMENT = f"experiment_id string, experiment_name string, body_site array<string>, condition array<string>, statistical_test array<string>, group_0_name string, group_1_name string, sequencing_type string, mht_correction boolean, signatures array<struct<{SIGNATURE.replace(' string', ':string').replace(' array', ':array')}>>"
TREE = f"study_id string, pmid string, has_pmc boolean, experiments array<struct<{EXPERIMENT.replace(' string', ':string').replace(' array', ':array').replace(' boolean', ':boolean')}>>"


def corpus(spark, studies=20, n=4):
    """Studies of n experiments with two taxa each, one told by its id and one by a name that only a synonym has; as predicted, and put aside by turns."""
    signature = lambda k: (f"s{k}", "s", "Figure 1", "figure", "increased", "Complete", [k, 100 + k])
    experiment = lambda k: (f"e{k}", "e", [f"site {k}"], [], [], None, None, None, None, [signature(k)])
    tree = spark.createDataFrame([(f"t{s}", "1", None, [experiment(k) for k in range(n)]) for s in range(studies)], TREE)
    said = lambda k: ([f"site {k}"], [], None, None, None, [], None, [("increased", [(None, str(1000 + k)), (f"other {k}", None)])])
    predictions = spark.createDataFrame([(f"t{s}", [said(k) for k in range(n)]) for s in range(studies)] + [("unknown", [said(0)])], f"study_id string, experiments {study_scores.PREDICTED}")
    names = [(k, f"Alpha {k}", f"alpha {k}", taxonomy.SCIENTIFIC) for k in range(n)] + [(100 + k, f"Other {k}", f"other {k}", "synonym") for k in range(n)]
    return tree, predictions, spark.createDataFrame(names, "tax_id bigint, name_txt string, name_norm string, name_class string"), spark.createDataFrame([(1000 + k, k) for k in range(n)], "old_tax_id bigint, new_tax_id bigint")


def test_places_need_not_come_out_alike_twice(spark):
    tree, predictions, names, merged = corpus(spark)
    mixed = F.udf(lambda a: random.sample(a, len(a)), study_scores.PREDICTED).asNondeterministic()
    found = study_scores.score_corpus(tree, predictions.withColumn("experiments", mixed("experiments")), names, merged)
    assert {(r.tp, r.fp, r.fn, r.n_matched, r.unresolved_gold) for r in found["studies"].collect()} == {(8, 0, 0, 4, 4)}
    assert found["missing"].count() == found["errors"].count() == 0 and found["pairs"].count() == 80


def test_names_are_not_broadcast(spark, tmp_path, monkeypatch):
    """Files look small beside what they hold: neither names nor retired ids nor errors go by the driver."""
    from taxaloom import working

    tree, predictions, *tables = corpus(spark, 3, 2)
    for k, table in enumerate(tables):
        table.write.parquet(f"{tmp_path}/{k}")
    tables = [spark.read.parquet(f"{tmp_path}/{k}") for k in range(2)]
    plans, real = [], working.stored

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df)

    monkeypatch.setattr(working, "stored", noted)
    monkeypatch.setattr(study_scores, "stored", noted)
    records = predictions.select("study_id", F.when(F.col("study_id") == "t1", "{").otherwise(F.to_json(F.struct("experiments"))).alias("record"))
    found = study_scores.score_corpus(tree, records, *tables)
    assert [tuple(r) for r in found["errors"].collect()] == [("t1", "/: no JSON")]
    assert {(r.study_id, r.tp, r.fp) for r in found["studies"].collect()} == {("t0", 4, 0), ("t2", 4, 0)}
    assert plans and not any("Broadcast" in p for p in plans)


def test_the_last_step_sorts_once(spark, monkeypatch):
    """All groupings of a study's rows follow one order, and none falls back to a sort of its own, which spills."""
    plans, real = [], study_scores.stored

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df)

    monkeypatch.setattr(study_scores, "stored", noted)
    found = study_scores.score_corpus(*corpus(spark, 3, 2))
    assert {(r.tp, r.fp, r.fn) for r in found["studies"].collect()} == {(4, 0, 0)}
    assert "ObjectHashAggregate" not in plans[-1] and plans[-1].count("- Sort [") == 1
