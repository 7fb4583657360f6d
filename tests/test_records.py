import json
import logging

import pytest
from pyspark.sql import functions as F

from taxaloom import config
from taxaloom.operators import analytics, report, scoring, sets
from taxaloom.sources import records


def test_records(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"study_id": "s1", "v": 1}, {"uid": "s2"}]))
    (tmp_path / "b.json").write_text(json.dumps({"study_id": "s1", "v": 2}))
    (tmp_path / "s9.json").write_text('{"v": 9}')
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "none.json").write_text("[]")
    (tmp_path / "x.txt").write_text("{}")
    read = records.read_records(spark, str(tmp_path))
    assert {r.file for r in read.where("error is not null").collect()} == {"bad.json", "none.json"}
    assert {r.study_id: json.loads(r.record).get("v") for r in records.predictions(read).collect()} == {"s1": 2, "s2": None, "s9": 9}
    assert records.checksums(spark, str(tmp_path / "x.txt")).first().sha256 == "44136fa355b3678a1146ad16f7e8649e94fb4fc21fe77e8310c060f61caaff8a"
    said = spark.createDataFrame([('{"a": "x", "b": ["y", "z"]}',)], "r string").select(records.text_list(F.col("r"), "$.a").alias("a"), records.text_list(F.col("r"), "$.b").alias("b"), records.text_list(F.col("r"), "$.c").alias("c")).first()
    assert tuple(said) == (["x"], ["y", "z"], [])


def test_analytics(spark):
    rows = spark.createDataFrame([("x", "gut"), ("x", "feces"), ("y", "other")], "k string, site string")
    got = analytics.terms(rows, "site", spark.createDataFrame([("feces",)], "term string"), spark.createDataFrame([("gut", "intestine")], "alias string, term string"))
    assert sorted(r.term for r in got.collect()) == ["feces", "intestine", "other"]
    assert sorted(r.region for r in analytics.regions(spark.createDataFrame([("3", "5"), ("1", None)], "low string, high string")).collect()) == [1, 3, 4, 5]
    pages = spark.createDataFrame([("p", "Signature 10"), ("p", "Signature 2")], "parent string, page string")
    assert analytics.child_pages(spark.createDataFrame([("p",), ("q",)], "parent string"), pages).orderBy("parent").first().children == ["Signature 2", "Signature 10"]
    closure = spark.createDataFrame([(1, 1, 0), (2, 2, 0), (2, 1, 1)], "tax_id bigint, ancestor bigint, depth int")
    s = spark.createDataFrame([("a", "e", "s1", [2], ["gut"]), ("b", "e", "s2", [1], ["skin"])], "study_id string, experiment_id string, signature_id string, taxa array<bigint>, body_site array<string>")
    assert [r.signature_id for r in analytics.taxon_signatures(s, closure, 1, True).collect()] == ["s1", "s2"]
    assert [r.signature_id for r in analytics.taxon_signatures(s, closure, 1, False).collect()] == ["s2"]
    assert [r.signature_id for r in analytics.taxon_signatures(s, closure, 1, True, body_site="gut").collect()] == ["s1"]
    assert [tuple(r) for r in analytics.unknown_values(s, "body_site", spark.createDataFrame([("gut",)], "value string")).collect()] == [("skin", 1)]
    dates = spark.createDataFrame([("2020-01-01", "2020-02-01"), (None, "2020-01-01")], "review_date string, revision_date string")
    assert sorted(r.stale for r in analytics.stale_reviews(dates).collect()) == [False, True]


def test_report(spark, tmp_path):
    scored = spark.createDataFrame([("s1", 1, 0, 1, "figure", 1, True, True)], "study_id string, tp bigint, fp bigint, fn bigint, source_type string, n_experiments int, direction_judged boolean, direction_right boolean")
    scored = scored.withColumns(sets.measures(F.col("tp"), F.col("fp"), F.col("fn")))
    none = spark.createDataFrame([], "study_id string")
    report.write_reports(scored, scored.select("study_id", "f1"), none, none, str(tmp_path))
    lines = [r.value for r in spark.read.text(f"{tmp_path}/report_md").collect()]
    assert [x for x in lines if x.startswith("#")] == ["# Scores", "## By stratum", "## By study"] and any("figure" in x for x in lines)
    assert json.loads(spark.read.text(f"{tmp_path}/scores").first().value)["record_type"] == "study_score"
    assert spark.read.text(f"{tmp_path}/report_html").count() == 2 + 1 + 2
    assert scoring.roll_up(scored).first().recall == 0.5


def test_config(monkeypatch, tmp_path, capsys):
    monkeypatch.setenv("TAXALOOM_CACHE", str(tmp_path))
    assert config.cache_root() == tmp_path and str(config.cache_root("/x")) == "/x"
    record = logging.LogRecord("taxaloom", logging.INFO, "", 0, "hi %s", ("you",), None)
    record.stage = "S1"
    assert json.loads(config.JsonLines().format(record)) | {"ts": 0} == {"ts": 0, "level": "INFO", "message": "hi you", "stage": "S1"}


def test_faulty_predictions_are_put_aside(spark):
    """One error for each record that cannot be scored, its first fault by path; what can be read is read."""
    from taxaloom.operators import predictions

    good = '{"experiments": [{"body_site": "Feces", "condition": ["a", "b"], "group_0_name": 3, "mht_correction": true, "signatures": [{"abundance_in_group_1": "increased", "taxa": [{"ncbi_id": 12}, {"ncbi_id": " 7 ", "taxon_name": "x"}, {"ncbi_id": true, "taxon_name": "y"}, {"ncbi_id": 1.5, "taxon_name": "z"}, {"taxon_name": null}]}, {"taxa": null}]}, {}]}'
    rows = {
        "good": (good, None),
        "none": (None, None),
        "empty": ("{}", None),
        "null": ('{"experiments": null}', None),
        "cut": ('{"experiments": [', "/: no JSON"),
        "list": ("[1]", "/: array where object is expected"),
        "text": ('{"experiments": "many"}', "/experiments: string where array is expected"),
        "member": ('{"experiments": [{}, 4]}', "/experiments/1: bigint where object is expected"),
        "site": ('{"experiments": [{"body_site": {"a": 1}}]}', "/experiments/0/body_site: object where string or array is expected"),
        "taxa": ('{"experiments": [{"signatures": [{}, {"taxa": {"ncbi_id": 3}}]}]}', "/experiments/0/signatures/1/taxa: object where array is expected"),
        "id": ('{"experiments": [{}, {"signatures": [{"taxa": [{"ncbi_id": 1}, {"ncbi_id": [1]}]}]}, 5]}', "/experiments/1/signatures/0/taxa/1/ncbi_id: array where string or bigint or decimal or double or boolean is expected"),
        "name": ('{"experiments": [{"signatures": [{"taxa": [{"taxon_name": 9}]}]}]}', "/experiments/0/signatures/0/taxa/0/taxon_name: bigint where string is expected"),
    }
    got = {r.study_id: r for r in predictions.checked(spark.createDataFrame([(k, v[0]) for k, v in rows.items()], "study_id string, record string")).collect()}
    assert {k: r.error for k, r in got.items()} == {k: v[1] for k, v in rows.items()}
    assert all((r.experiments is None) == (r.error is not None) for r in got.values())
    e, other = got["good"].experiments
    assert (e.body_site, e.condition, e.group_0_name, e.mht_correction, other.body_site, other.signatures) == (["Feces"], ["a", "b"], "3", True, None, [])
    assert [(t.taxon_name, t.ncbi_id) for t in e.signatures[0].taxa] == [(None, "12"), ("x", "7"), (None, None), ("z", None), (None, None)] and e.signatures[1].taxa == []
    assert got["none"].experiments == got["null"].experiments == got["empty"].experiments == []


def test_scoring_goes_on_without_faulty_studies(spark):
    from taxaloom.operators import study_scores, taxonomy

    kind = "study_id string, pmid string, has_pmc boolean, experiments array<struct<experiment_id:string,experiment_name:string,body_site:array<string>,condition:array<string>,statistical_test:array<string>,group_0_name:string,group_1_name:string,sequencing_type:string,mht_correction:boolean,signatures:array<struct<signature_id:string,signature_name:string,source:string,source_type:string,direction:string,curation_state:string,taxa:array<bigint>>>>>"
    experiment = ("e", "e", ["Feces"], [], [], None, None, None, None, [("s", "s", "Figure 1", "figure", "increased", "Complete", [1])])
    tree = spark.createDataFrame([(k, "1", True, [experiment]) for k in "abc"], kind)
    said = '{"experiments": [{"body_site": ["feces"], "signatures": [{"taxa": [{"ncbi_id": 1}]}]}]}'
    records = spark.createDataFrame([("a", said), ("b", '{"experiments": "x"}'), ("z", "{")], "study_id string, record string")
    names = spark.createDataFrame([(1, "Alpha x", "alpha x", taxonomy.SCIENTIFIC)], "tax_id bigint, name_txt string, name_norm string, name_class string")
    out = study_scores.score_corpus(tree, records, names, spark.createDataFrame([], "old_tax_id bigint, new_tax_id bigint"))
    assert [tuple(r) for r in out["errors"].collect()] == [("b", "/experiments: string where array is expected")]
    assert {r.study_id: (r.tp, r.fn, r.n_pred) for r in out["studies"].collect()} == {"a": (1, 0, 1), "c": (0, 1, 0)}
    assert [r.study_id for r in out["missing"].collect()] == ["c"]
    assert out["totals"].first().n_studies == 2
    lines = scoring.records(out["studies"], out["missing"], out["errors"]).collect()
    assert sorted((r.study_id, r.record_type) for r in lines) == [("a", "study_score"), ("b", "scoring_error"), ("c", "missing_prediction"), ("c", "study_score")]


def test_grounding_equals_a_search_of_every_text(spark):
    """Items of any length, of parts of words and of spaces, repeated rows on both sides."""
    import random

    from taxaloom.operators import curated

    r = random.Random(2)
    words = ["alpha", "beta", "be", "a", "", "gamma-delta", "é日", "x" * 30, "beta.", "s__Beta"]
    texts = [(k, " ".join(r.choice(words) for _ in range(r.randrange(0, 14)))) for k in range(60)] + [(100, None), (101, ""), (3, "alpha beta"), (3, "alpha beta")]
    items = [(k, " ".join(r.choice(words) for _ in range(r.randrange(1, 8)))) for k in range(80)]
    items += [(200 + k, t[r.randrange(len(t)) :][: r.randrange(1, 12)]) for k, (_, t) in enumerate(texts) if t] + [(300, " "), (301, "   "), (302, ""), (303, None), (304, "eta al"), (304, "eta al"), (305, "日")]
    got = curated.grounded(spark.createDataFrame(texts, "d int, text string"), spark.createDataFrame(items, "i int, item string")).select("d", "i").collect()
    assert sorted(map(tuple, got)) == sorted((d, i) for d, t in texts for i, x in items if t is not None and x and x in t)


def test_whole_report(spark, tmp_path):
    """Facts, strata, studies, missing predictions and errors, in order, escaped, as Markdown and as a page."""
    from taxaloom.operators import study_scores, taxonomy

    kind = "study_id string, pmid string, has_pmc boolean, experiments array<struct<experiment_id:string,experiment_name:string,body_site:array<string>,condition:array<string>,statistical_test:array<string>,group_0_name:string,group_1_name:string,sequencing_type:string,mht_correction:boolean,signatures:array<struct<signature_id:string,signature_name:string,source:string,source_type:string,direction:string,curation_state:string,taxa:array<bigint>>>>>"
    experiment = lambda source: ("e", "e", ["Feces"], [], [], None, None, None, None, [("s", "s", "x", source, "increased", "Complete", [1, 2])])
    tree = spark.createDataFrame([("s<1>|x", "1", True, [experiment("figure")]), ("s2", "1", None, [experiment("main-table")]), ("s3", "1", False, [])], kind)
    said = '{"experiments": [{"body_site": ["feces"], "signatures": [{"abundance_in_group_1": "increased", "taxa": [{"ncbi_id": 1}]}]}]}'
    records = spark.createDataFrame([("s<1>|x", said), ("s3", "[]")], "study_id string, record string")
    names = spark.createDataFrame([(1, "Alpha x", "alpha x", taxonomy.SCIENTIFIC)], "tax_id bigint, name_txt string, name_norm string, name_class string")
    found = study_scores.score_corpus(tree, records, names, spark.createDataFrame([], "old_tax_id bigint, new_tax_id bigint"))
    report.write_pages(found, tree, str(tmp_path), has_store=False)
    md = [r.value for r in report.page(found, tree, False).orderBy("section", "part", "ord").select("line").withColumnRenamed("line", "value").collect()]
    assert [x for x in md if x.startswith("#")] == ["# Scores", "## By type of source", "## By number of experiments", "## By study", "## Without a prediction", "## Not scored"]
    facts = dict(x[2:].rsplit(": **", 1) for x in md if x.startswith("- "))
    assert facts["Studies scored"] == "2**" and facts["Studies without a prediction, scored as all missed"] == "1**" and facts["Predictions that could not be scored, left out of all figures"] == "1**"
    assert facts["F1 of taxa, all pairs together"] == "0.400 (precision 1.000, recall 0.250, Jaccard 0.250)**" and facts["Directions right, of matched signatures"] == "100.0%**"
    assert "| main-table | 2 | 0.000 | 0.000 | 0.000 | 0.000 |" in md and md.index("| main-table | 2 | 0.000 | 0.000 | 0.000 | 0.000 |") < md.index("| figure | 2 | 1.000 | 0.500 | 0.667 | 0.500 |")
    assert "| s<1>\\|x | True | 1 | 1 | 1 | 0 | 0 | 0.667 | 1.000 | 1/1 |" in md and "| s2 | ? | 1 | 0 | 0 | 0 | 1 | 0.000 | 0.000 | - |" in md
    assert "| s3 | /: array where object is expected |" in md and "(none)" not in "".join(md)
    page = "\n".join(r.value for r in spark.read.text(f"{tmp_path}/report_html").collect())
    assert page.startswith("<!doctype html>") and page.endswith("</body></html>") and "s&lt;1&gt;|x" in page and report.NO_STORE in page and page.count("<table>") == page.count("</table>") == 5
    assert [json.loads(r.value)["record_type"] for r in spark.read.text(f"{tmp_path}/scores").collect()].count("scoring_error") == 1
    empty = study_scores.score_corpus(tree.limit(0), records, names, spark.createDataFrame([], "old_tax_id bigint, new_tax_id bigint"))
    assert "".join(r.line for r in report.page(empty, tree, False).collect()).count("(none)") == 5


def test_ids_ranks_and_an_optional_store(spark, tmp_path):
    from taxaloom.functions import text as T
    from taxaloom.operators import curated, taxonomy
    from taxaloom.sources import taxdump

    names = spark.createDataFrame([(1, "Alpha x", "alpha x", "scientific name"), (2, "Alpha x", "alpha x", "synonym"), (3, "Beta", "beta", "synonym")], "tax_id bigint, name_txt string, name_norm string, name_class string")
    rows = spark.createDataFrame([(1, "s__Alpha_x", 1), (2, "Alpha x", 2), (3, "beta", 3), (4, "none", 3), (5, "beta", None), (6, "kept", 9), (7, "missed", 4)], "k int, taxon_name string, ncbi_id bigint")
    cache = spark.createDataFrame([("kept", 9), ("missed", None)], "name_norm string, tax_id bigint")
    got = {r.k: (r.ncbi_id, r.confirmed) for r in taxonomy.verified(rows, names, cache).collect()}
    assert got == {1: (1, True), 2: (None, False), 3: (3, True), 4: (None, False), 5: (None, False), 6: (9, True), 7: (None, False)}
    nodes = spark.createDataFrame([(1, 1, "genus")], "tax_id bigint, parent_tax_id bigint, rank string")
    assert {r.tax_id: r.rank for r in taxonomy.ranks(spark.createDataFrame([(1,), (33,)], "tax_id bigint"), nodes).collect()} == {1: "genus", 33: None}
    seen = curated.distinct_ids(spark.createDataFrame([(5, "b"), (1, "a"), (2, "b"), (3, None)], "at int, pmid string"), "pmid", "at")
    assert [(r.pmid, r.at) for r in seen.orderBy("at").collect()] == [("a", 1), ("b", 2)]
    for store in (None, str(tmp_path / "none")):
        with pytest.warns(RuntimeWarning, match="names cannot be resolved"):
            assert taxdump.open_optional(spark, store) is None
    says = {"Differentially abundant": True, "by LEfSe": True, "LDA score": True, "valda x": False, "significantly  enriched taxa": True, "significant taxa": False, "insignificant different": True, "": False}
    assert {r.v: r.s for r in spark.createDataFrame([(v,) for v in says], "v string").select("v", T.differential_signal(F.col("v")).alias("s")).collect()} == says
    assert spark.range(1).select(T.context(F.lit("é" * 9), 4).alias("a"), T.context(F.lit(None).cast("string"), 4).alias("b")).first() == ("éééé", "")


def test_working_tables_can_be_removed(spark):
    from taxaloom import working

    working.clear(spark)
    one = working.stored(spark.range(5))
    assert one.count() == 5 and working.clear(spark) == 1 and working.clear(spark) == 0
    with pytest.raises(Exception, match="table-"):
        one.count()


def test_figure_report(spark, tmp_path):
    gold = spark.createDataFrame([("f1", "heatmap", "alpha x", "increased"), ("f1", "heatmap", "beta y", "decreased"), ("f2", "bar", "alpha x", "increased")], "figure string, figure_type string, name string, direction string")
    said = spark.createDataFrame([("f1", "alpha x", "increased"), ("f1", "beta z", "unknown"), ("f1", "beta y", "unknown")], "figure string, name string, direction string")
    scores = scoring.figure_scores(gold, said)
    report.write_figures(scores, str(tmp_path))
    lines = [r.line for r in report.figure_page(scores).orderBy("section", "part", "ord").collect()]
    assert "| f1 | heatmap | 2 | 3 | 0.67/1.00/0.80 | 0.80 | 1/1 (+1 unknown) |" in lines and "| f2 | bar | 1 | 0 | 0.00/0.00/0.00 | 0.00 | 0/0 |" in lines
    assert lines[-2:] == ["| bar | 1 | 0.00 | 0.00 | - |", "| heatmap | 1 | 0.80 | 0.80 | 1/1 (100%) |"]
    assert sorted(json.loads(r.value)["figure"] for r in spark.read.text(f"{tmp_path}/results").collect()) == ["f1", "f2"]


def test_looking_up_names_and_ids(spark, monkeypatch):
    from taxaloom.operators import taxonomy

    store = {
        "names": spark.createDataFrame([(1, "root", "root", "scientific name"), (2, "Alpha", "alpha", "scientific name"), (3, "Alpha beta", "alpha beta", "scientific name"), (4, "alpha", "alpha", "synonym")], "tax_id bigint, name_txt string, name_norm string, name_class string"),
        "nodes": spark.createDataFrame([(1, 1, "no rank"), (2, 1, "genus"), (3, 2, "species"), (4, 1, "genus")], "tax_id bigint, parent_tax_id bigint, rank string"),
        "merged": spark.createDataFrame([(33, 3)], "old_tax_id bigint, new_tax_id bigint"),
    }
    got = {r.asked: r for r in taxonomy.looked_up(spark.createDataFrame([("g__Alpha",), ("33",), ("nothing",), ("77",), ("4",)], "asked string"), store).collect()}
    assert (got["g__Alpha"].tax_id, got["g__Alpha"].ambiguous, got["g__Alpha"].candidates, got["g__Alpha"].lineage) == (2, True, [2, 4], "root > Alpha")
    assert (got["33"].tax_id, got["33"].name, got["33"].rank, got["33"].lineage) == (3, "Alpha beta", "species", "root > Alpha > Alpha beta")
    assert (got["nothing"].tax_id, got["nothing"].lineage) == (None, None) and (got["77"].tax_id, got["77"].rank) == (77, None) and got["4"].lineage == "root > 4"
    monkeypatch.delenv("GOOGLE_API_KEY", raising=False)
    monkeypatch.setenv("GEMINI_API_KEY", "k")
    assert config.service_key(config.MODEL_KEYS) == "k"
    monkeypatch.setenv("GOOGLE_API_KEY", "g")
    assert config.service_key(config.MODEL_KEYS) == "g" and config.service_key(("NO_SUCH_KEY_HERE",)) is None
