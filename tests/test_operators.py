import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from taxaloom.operators import alignment, curated, curation, markup, review, scoring, sets, study_scores, taxonomy, validation
from taxaloom.sources import services, sinks, taxdump
from taxaloom.streaming import events

XML = """<article xmlns:xlink="http://www.w3.org/1999/xlink"><front><journal-title>J</journal-title><article-id pub-id-type="doi">10.1/x</article-id><article-title>A <i>title</i></article-title>
<contrib contrib-type="author"><name><surname>Doe</surname><given-names>Jane</given-names></name></contrib><pub-date><year>2020</year></pub-date></front>
<body><sec id="s1"><title>One</title><p>First  text.</p><sec><title>Sub</title><p>Inner.</p></sec></sec>
<fig><label>Figure 2</label><caption><p>LEfSe of taxa</p></caption><graphic xlink:href="f2"/></fig>
<table-wrap><label>Table 1</label><caption><p>Ages</p></caption><table><tr><th>a</th><td>b</td></tr><tr/></table></table-wrap></body></article>"""


@pytest.mark.parametrize("seed", range(4))
def test_assignment_is_optimal(seed):
    rng = np.random.default_rng(seed)
    for _ in range(60):
        n, m = rng.integers(1, 6, 2)
        w = np.round(rng.random((n, m)) * rng.choice([0, 1], (n, m)), 2)
        got = alignment.assign(w)
        used = [c for c in got if c >= 0]
        assert len(set(used)) == len(used) == min(n, m)
        total = sum(w[i, c] for i, c in enumerate(got) if c >= 0)
        small, large = (w, m) if n <= m else (w.T, n)
        assert total == pytest.approx(max(sum(small[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(large), len(small))))


def test_alignment_floor_and_rest(spark):
    rows = [("s", 0, 0, 0.9), ("s", 0, 1, 0.8), ("s", 1, 0, 0.85), ("s", 1, 1, 0.05), ("t", 0, 0, 0.1)]
    scores = spark.createDataFrame(rows, "k string, p int, g int, score double")
    kept = alignment.align(scores, ["k"], 0.15)
    assert sorted((r.k, r.p, r.g) for r in kept.collect()) == [("s", 0, 1), ("s", 1, 0)]
    whole = alignment.completed(kept, scores.select("k", "p").distinct(), scores.select("k", "g").distinct(), ["k"])
    assert sorted(((r.k, r.p, r.g) for r in whole.collect()), key=str) == sorted([("s", 0, 1), ("s", 1, 0), ("t", 0, None), ("t", None, 0)], key=str)


def test_group_totals_are_optimal(spark):
    """Totals of many groups of up to four a side, against all assignments."""
    rnd = random.Random(6)
    rows = [(k, p, g, rnd.choice([0.0, 0.25, 0.5, round(rnd.random(), 3)])) for k in range(60) for n, m in [(rnd.randrange(1, 5), rnd.randrange(1, 5))] for p in range(n) for g in range(m)]
    kept = alignment.align(spark.createDataFrame(rows, "k int, p int, g int, score double"), ["k"], 0.0).groupBy("k").agg(F.sum("score").alias("t")).collect()
    for r in kept:
        w = {(p, g): s for k, p, g, s in rows if k == r.k}
        ps, gs = sorted({p for p, _ in w}), sorted({g for _, g in w})
        small, large, flip = (ps, gs, False) if len(ps) <= len(gs) else (gs, ps, True)
        best = max(sum(w[(b, a) if flip else (a, b)] for a, b in zip(small, c, strict=True)) for c in itertools.permutations(large, len(small)))
        assert r.t == pytest.approx(best)
    assert len(kept) == 60


def test_score_corpus(spark):
    """Two studies by hand: a retired id, a taxon told by name, an incomplete signature, a merged experiment, a missing prediction."""
    signature = lambda i, taxa, d, state="Complete": (i, "Signature", "Figure 1", "figure", d, state, taxa)
    experiment = lambda i, site, *s: (i, i, [site], [], [], None, None, "16S", None, list(s))
    kind = "study_id string, pmid string, has_pmc boolean, experiments array<struct<experiment_id:string,experiment_name:string,body_site:array<string>,condition:array<string>,statistical_test:array<string>,group_0_name:string,group_1_name:string,sequencing_type:string,mht_correction:boolean,signatures:array<struct<signature_id:string,signature_name:string,source:string,source_type:string,direction:string,curation_state:string,taxa:array<bigint>>>>>"
    tree = spark.createDataFrame([
        ("a", "1", True, [experiment("e1", "Feces", signature("s1", [1, 2], "increased"), signature("s2", [3], "decreased", None)), experiment("e2", "Skin", signature("s3", [4], None))]),
        ("b", "2", None, [experiment("e3", "Mouth", signature("s4", [1], "increased"))]),
        ("c", "3", None, []),
    ], kind)
    said = lambda site, *s: ([site], [], None, None, "16S", [], None, list(s))
    predictions = spark.createDataFrame([
        ("a", [said("feces", ("increased", [(None, "11"), ("g__Beta x", None), ("nobody", None)]), ("increased", [(None, "3"), (None, "9")]))]),
        ("c", [said("Liver", ("increased", [(None, "1")]))]),
        ("z", [said("Liver")]),
    ], f"study_id string, experiments {study_scores.PREDICTED}")
    names = spark.createDataFrame([(1, "Alpha x"), (2, "Beta x"), (3, "Alpha y"), (4, "Delta z"), (9, "Alpha q")], "tax_id bigint, name_txt string")
    names = names.select("tax_id", "name_txt", F.lower("name_txt").alias("name_norm"), F.lit(taxonomy.SCIENTIFIC).alias("name_class"))
    out = study_scores.score_corpus(tree, predictions, names, spark.createDataFrame([(11, 1)], "old_tax_id bigint, new_tax_id bigint"))
    got = {r.study_id: r for r in out["studies"].collect()}
    a, b, c = got["a"], got["b"], got["c"]
    # s1: both found; s2 is incomplete, so id 9 does not count; s3 of the unmatched experiment is missed.
    assert (a.tp, a.fp, a.fn, a.n_matched, a.under_segmentation, a.unresolved_pred) == (3, 0, 1, 1, 1, 1)
    assert (a.genus_tp, a.genus_fp, a.genus_fn) == (3, 0, 1) and (a.direction_right, a.direction_judged) == (1, 2)
    assert (a.names_found, a.names_right) == (1, 1) and a.macro_f1 == pytest.approx(2 / 3)
    assert (b.tp, b.fn, b.n_pred) == (0, 1, 0) and (c.fp, c.over_segmentation) == (1, 1)
    assert [r.study_id for r in out["missing"].collect()] == ["b"]
    total = out["totals"].first()
    assert (total.tp, total.fp, total.fn, total.n_studies, total.name_to_id_accuracy, total.direction_accuracy) == (3, 1, 2, 3, 1.0, 0.5)
    assert {(r.study_id, r.n) for r in study_scores.source_type_counts(tree).collect()} == {("a", 3), ("b", 1)}
    assert {r.f1 for r in out["pairs"].where("study_id = 'a'").collect()} == {0.0, 1.0}


def test_scores(spark):
    rows = [([1, 2], [2, 3], ["a"], ["a"], "increased", "decreased", "Complete", "figure", 1), ([1], None, ["a"], None, None, None, None, "figure", 1), ([5], [6], ["x"], ["y"], "increased", "increased", None, "table", 7), (None, [9], None, ["q"], None, "increased", None, None, 7)]
    pairs = spark.createDataFrame(rows, "gold_taxa array<bigint>, pred_taxa array<bigint>, gold_genera array<string>, pred_genera array<string>, gold_direction string, pred_direction string, gold_state string, source_type string, n_experiments int")
    scored = scoring.score_pairs(pairs)
    assert sorted((r.tp, r.fp, r.fn) for r in scored.collect()) == [(0, 0, 1), (0, 0, 1), (0, 1, 0), (1, 1, 1)]
    total = scoring.roll_up(scored).first()
    assert (total.tp, total.fp, total.fn, total.direction_accuracy) == (1, 2, 3, 0.5)
    assert {(r.stratum, r.level): r.tp for r in scoring.by_stratum(scored).collect()} == {("source_type", "figure"): 1, ("source_type", "table"): 0, ("experiments", "1"): 1, ("experiments", "6-20"): 0}
    empty = spark.range(1).select(sets.jaccard(F.array().cast("array<int>"), F.array().cast("array<int>"), None).alias("a"), sets.jaccard(F.array().cast("array<int>"), F.array().cast("array<int>"), 1.0).alias("b")).first()
    assert tuple(empty) == (None, 1.0)


def test_taxonomy_store(spark, tmp_path):
    line = lambda *f: "\t|\t".join(map(str, f)) + "\t|\n"
    (tmp_path / "names.dmp").write_text(line(1, "root", "", "scientific name") + line(2, "Alpha", "", "scientific name") + line(3, "Alpha beta", "", "scientific name") + line(4, "alpha", "", "synonym") + line(5, "Loop", "", "scientific name"))
    (tmp_path / "nodes.dmp").write_text(line(1, 1, "no rank", "x") + line(2, 1, "genus", "") + line(3, 2, "species") + line(4, 99, "genus") + line(5, 6, "a") + line(6, 5, "b"))
    (tmp_path / "merged.dmp").write_text(line(33, 3))
    store = str(tmp_path / "store")
    taxdump.build(spark, str(tmp_path), store, "2020-01-01")
    t = taxdump.open_store(spark, store)
    assert tuple(t["meta"].first())[:3] == (5, 6, 1)
    asked = spark.createDataFrame([("g__Alpha",), ("nothing",)], "query string")
    got = {r.query: r for r in taxonomy.resolve(asked, t["names"], t["nodes"]).collect()}
    assert (got["g__Alpha"].tax_id, got["g__Alpha"].ambiguous, got["g__Alpha"].candidates, got["g__Alpha"].rank) == (2, True, [2, 4], "genus")
    assert got["nothing"].tax_id is None
    ids = taxonomy.canonical(spark.createDataFrame([(33,), (4,), (5,), (77,)], "tax_id bigint"), t["merged"])
    closure = taxonomy.ancestors(ids, t["nodes"])
    paths = {r.tax_id: [x.tax_id for x in r.lineage] for r in taxonomy.lineage(closure, t["names"]).collect()}
    assert paths == {3: [1, 2, 3], 4: [4], 5: [6, 5]}
    assert {r.tax_id: r.genus for r in taxonomy.nearest(closure, "genus").collect()} == {3: 2, 4: 4}
    with pytest.raises(FileNotFoundError):
        taxdump.open_store(spark, str(tmp_path / "none"))
    (tmp_path / "nodes.dmp").write_text(line(1, 1, "x") + line(1, 1, "x"))
    with pytest.raises(ValueError, match="nodes"):
        taxdump.build(spark, str(tmp_path), store + "2", "x")


def test_services(spark):
    ids = spark.createDataFrame([(i, i) for i in range(7)], "id int, ord int")
    assert [r.request for r in services.batches(ids, 3).orderBy("batch").collect()] == ["0,1,2", "3,4,5", "6"]
    with pytest.raises(ValueError):
        services.batches(ids, 0)
    tree = json.dumps({"tree": [{"path": "a.gmt", "type": "blob", "size": 3}, {"path": "d.csv", "type": "blob"}, {"path": "x/b.gmt", "type": "blob"}, {"path": "y", "type": "tree"}]})
    files = services.listed_files(spark.createDataFrame([(tree,)], "json string"), ("d.csv",))
    assert sorted(map(tuple, files.collect())) == [("a.gmt", 3, "gmt"), ("d.csv", 0, "dump")]
    assert services.to_download(files, spark.createDataFrame([("a.gmt", 3)], "path string, size bigint")).count() == 1
    said = json.dumps({"status": "ok", "records": [{"pmid": "1", "pmcid": "PMC1"}, {"pmcid": "x"}]})
    assert services.conversions(spark.createDataFrame([(said,)], "json string")).count() == 1
    with pytest.raises(Exception, match="no good"):
        services.conversions(spark.createDataFrame([('{"status": "error", "message": "no good"}',)], "json string")).collect()


def test_markup(spark):
    rows = spark.createDataFrame([("P1", XML), ("P2", None), ("P3", "<broken")], "pmcid string, xml string")
    got = {r.pmcid: r for r in markup.parse_articles(rows, "pmcid").collect()}
    a = got["P1"]
    assert [tuple(f) for f in a.figures] == [("Figure 2", "2", "LEfSe of taxa", "f2")]
    assert [tuple(s) for s in a.sections] == [("s1", "One", "First text."), ("sec-2", "Sub", "Inner.")]
    assert [t.rows for t in a.tables] == [[["a", "b"]]] and a.tables[0].table_id == "table-1"
    assert tuple(a.meta) == ("A title", "J", 2020, ["Jane Doe"], "10.1/x")
    assert got["P2"].figures == [] and got["P2"].parse_error is None and got["P3"].parse_error
    pages = spark.createDataFrame([("P1", '<img src="https://cdn.x/blobs/a1/f2.jpg">')], "pmcid string, html string")
    found = markup.evidence(markup.parse_articles(rows, "pmcid"), pages, "pmcid").where("pmcid = 'P1'")
    assert found.first().figures[0].image_url == "https://cdn.x/blobs/a1/f2.jpg"
    assert found.select(markup.located(F.col("tables"), F.col("figures")).alias("x")).first().x.said == "Figure 2"


@pytest.mark.parametrize("design", list(curation.Design))
def test_curation_with_a_mock_model(spark, design):
    taxa = [{"taxon_name": "LEfSe", "direction": "Increased", "ncbi_id": 7}, {"taxon_name": "lefse", "direction": "increased", "ncbi_id": None}, {"taxon_name": "Absent", "direction": "decreased"}, {"taxon_name": "Ages", "direction": "sideways"}]
    review = taxa[:1] + [{"taxon_name": "Recalled", "direction": "decreased"}, "malformed", {"taxon_name": "Ages", "direction": "increased"}]
    answers = {"review": {"taxa": review}, "ground": 'Sure: ```json\n{"grounded": ["Ages"]}\n```', "study": {"study_design": ["case-control", "no such"]}, "segment": {"experiments": ["one", "two"]}, "experiment": {"body_site": ["Feces"], "sequencing_type": "16S"}, "taxa": {"taxa": taxa}, "names": {"taxa": taxa}}
    studies = spark.createDataFrame([("1",), ("2",)], "pmid string")
    id_map = spark.createDataFrame([("1", "P1")], "pmid string, pmcid string")
    docs = spark.createDataFrame([("P1", XML)], "pmcid string, xml string")
    got = {r.pmid: r for r in curation.curate(studies, id_map, docs, lambda: curation.MockModel(answers), design).collect()}
    record = json.loads(got["1"].record)
    assert got["1"].valid and not got["2"].has_pmc and got["2"].valid
    assert record["study_design"] == ["case-control"] and len(record["experiments"]) == 2
    names = [[t["taxon_name"] for t in s["taxa"]] for s in record["experiments"][0]["signatures"]]
    want = {curation.Design.FUSED_LEAN: [["LEfSe"], ["Absent"]], curation.Design.SPLIT_VERIFY: [["LEfSe"]], curation.Design.SPLIT_PANEL: [["LEfSe", "Ages"]]}[design]
    assert [sorted(n, reverse=True) for n in names] == [sorted(n, reverse=True) for n in want]


def test_panel_and_repair(spark):
    """Directions by round, from a table: confirmed at once, flipped after two rounds, never settled, settled back on the claim."""
    rounds = {"A": ["increased"], "B": ["decreased", "decreased"], "C": ["decreased", None, "increased"], "D": ["decreased", "increased", "increased"]}

    class Scripted:
        def complete(self, stage, prompt):
            if stage == "ground":
                return {"grounded": ["only e", "only r"]}
            number, name = int(prompt.split("Round ")[1][0]), prompt.split("# taxon\n")[1][0]
            return {"direction": rounds[name][number - 1]} if number <= len(rounds[name]) else "no idea"

    asking = lambda rows, stage: curation.ask(rows, stage, Scripted)
    kind = "k int, taxon_name string, direction string, ncbi_id bigint, ord int, artifact_text string"
    claims = spark.createDataFrame([(1, n, "increased", 7, i, "text") for i, n in enumerate(rounds)], kind)
    got = {r.taxon_name: (r.settled, r.changed) for r in review.repaired(claims, asking).collect()}
    assert got == {"A": ("increased", False), "B": ("decreased", True), "C": (None, True), "D": ("increased", False)}
    extracted = spark.createDataFrame([(1, "g__Same", "increased", 5, 0, "t"), (1, "B", "increased", 6, 1, "t"), (1, "C", "increased", 6, 2, "t"), (1, "only e", "decreased", 8, 3, "t"), (1, "lost", "decreased", 9, 4, "t")], kind)
    reviewed = spark.createDataFrame([(1, "same", "increased", None, 0, "t"), (1, "B", "decreased", None, 1, "t"), (1, "C", "decreased", None, 2, "t"), (1, "only r", "increased", 3, 3, "t"), (1, "unsure", "increased", 3, 4, "t")], kind)
    kept, flags = review.panel(extracted, reviewed, ["k"], asking)
    assert sorted((r.taxon_name, r.direction, r.ncbi_id) for r in kept.collect()) == [("B", "decreased", 6), ("g__Same", "increased", 5), ("only e", "decreased", 8), ("only r", "increased", None)]
    assert sorted(r.flag for r in flags.collect()) == ["direction not settled: C", "not confirmed: lost"]
    assert {r.name_norm: r.verdict for r in review.verdicts(extracted, reviewed, ["k"]).collect()}["b"] == "repair"


def test_reconciled(spark):
    class Chooser:
        def complete(self, stage, prompt):
            return 'I think {"ncbi_id": 12}' if "Twice" in prompt else {"ncbi_id": 99}

    names = spark.createDataFrame([("Once", "t"), ("g__Twice", "t"), ("Thrice", "t"), ("Never", "t")], "taxon_name string, artifact_text string")
    taxa = spark.createDataFrame([("once", 1), ("twice", 11), ("twice", 12), ("thrice", 21), ("thrice", 22)], "name_norm string, tax_id bigint")
    got = review.reconciled(names, taxa, spark.createDataFrame([(12, 13)], "old_tax_id bigint, new_tax_id bigint"), lambda rows, stage: curation.ask(rows, stage, Chooser))
    assert {r.taxon_name: (r.ncbi_id, r.disambiguated) for r in got.collect()} == {"Once": (1, False), "g__Twice": (13, True), "Thrice": (None, False), "Never": (None, False)}


def test_a_failing_call_fails_its_row(spark):
    class Broken:
        def complete(self, stage, prompt):
            if prompt == "bad":
                raise ValueError("no")
            return {"ok": 1}

    got = curation.ask(spark.createDataFrame([("good",), ("bad",)], "prompt string"), "x", Broken).collect()
    assert {r.prompt: (r.answer, r.failure) for r in got} == {"good": ('{"ok": 1}', None), "bad": (None, "ValueError: no")}


def test_curated_helpers(spark):
    rows = [("s", "increased", "A  b", None, 1), ("s", "increased", "a B", 5, 2), ("s", "decreased", "a b", None, 3), ("s", "increased", "c", None, 4)]
    d = curated.dedup_taxa(spark.createDataFrame(rows, "k string, direction string, taxon_name string, ncbi_id bigint, ord int"), ["k"])
    assert sorted((r.direction, r.taxon_name, r.ncbi_id, r.ord) for r in d.collect()) == [("decreased", "a b", None, 3), ("increased", "a B", 5, 1), ("increased", "c", None, 4)]
    rounds = spark.createDataFrame([("a", 1, None), ("a", 2, "x"), ("a", 3, None), ("a", 4, "x"), ("b", 1, "x"), ("b", 2, "y")], "k string, round int, value string")
    assert [tuple(r) for r in curated.agreed_value(rounds, ["k"]).collect()] == [("a", 4, "x")]
    items = spark.createDataFrame([(1, "w1 w2 w3 w4 w5"), (2, "w2"), (3, "")], "i int, item string")
    texts = spark.createDataFrame([(1, "(w1 w2 w3 w4 w5)"), (2, "w1 w2"), (3, None)], "d int, text string")
    assert sorted((r.d, r.i) for r in curated.grounded(texts, items).collect()) == [(1, 1), (1, 2), (2, 2)]


def test_validation(spark):
    schema = {"uid": validation.Slot(required=True), "n": validation.Slot("integer"), "x": validation.Slot("float"), "state": validation.Slot(("a", "b")), "tags": validation.Slot(("p", "q"), many=True)}
    cases = {'{"uid": "u", "n": 1, "x": 2.5, "state": "a", "tags": ["p"]}': [], "{}": ["/"], '{"uid": "u", "n": "1"}': ["/n"], '{"uid": "u", "state": "c"}': ["/state"], '{"uid": "u", "tags": ["p", "z"]}': ["/tags"], '{"uid": "u", "tags": "p"}': ["/tags"], '{"uid": "u", "other": 1}': ["/"], "[1]": ["/"], "no": ["/"], '{"uid": "u", "x": 1}': []}
    checked = validation.validate(spark.createDataFrame([(c,) for c in cases], "record string"), schema)
    assert {r.record: [p.path for p in r.problems] for r in checked.collect()} == cases
    assert validation.exit_code(checked) == 2 and validation.exit_code(checked.where("valid")) == 0 and validation.exit_code(checked.where("record like '%other%'")) == 1


def test_stream_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [{"ts": f"2020-01-0{d}T10:00:00Z", "stage": "S1", "event": "study_done", "study_id": str(d), "n": 1, "latency_ms": 2.0} for d in (1, 1, 2, 8)]
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, lines)) + "\nbroken\n")
    q = events.write_counts(events.stage_counts(events.read_events(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert sorted((r.start.day, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, 2), (2, 1)]
    frame = spark.createDataFrame([("b", None, True), ("a", 'x "q", y', None)], "study_id string, v string, f boolean")
    assert sinks.write_table(frame, str(tmp_path / "t")) == 2
    assert sorted(map(tuple, spark.read.csv(str(tmp_path / "t"), header=True, escape='"').na.fill("").collect())) == [("a", 'x "q", y', ""), ("b", "", "true")]
    sinks.write_lines(frame.withColumn("line", F.col("study_id")), str(tmp_path / "l"))
    assert [r.value for r in spark.read.text(str(tmp_path / "l")).collect()] == ["a", "b"]
    assert [r.line for r in sinks.markdown_table(frame.select("study_id", "v"), ["study_id"]).orderBy("part", "ord").collect()][2:] == ['| a | x "q", y |', "| b |  |"]


def test_random_groups_of_first_and_last(spark):
    from taxaloom.operators import normalize

    rnd = random.Random(1)
    rows = [(rnd.randrange(5), k, str(k)) for k in rnd.sample(range(100), 40)]
    frame = spark.createDataFrame(rows, "k int, o int, v string")
    ordered = sorted(rows, key=lambda r: r[1])
    first, last = {}, {}
    for k, _, v in ordered:
        first.setdefault(k, v)
        last[k] = v
    assert {r.k: r.v for r in normalize.first_wins(frame, "k", "o", ["v"]).collect()} == first
    assert {r.k: r.v for r in normalize.last_wins(frame, "k", F.col("o"), ["v"]).collect()} == last


def test_names_are_checked_and_directions_derived_anew(spark):
    class Scripted:
        def complete(self, stage, prompt):
            if stage == "ground":
                return {"grounded": ["alpha", " BETA ", "gamma"]}
            name, number = prompt.split("# taxon\n")[1].split("\n")[0], int(prompt.split("Round ")[1][0])
            return {"direction": {"Alpha": ["increased"] * 3, "Beta": ["decreased"] * 3, "Gamma": ["decreased", "increased", "decreased"]}[name][number - 1]}

    asking = lambda rows, stage: curation.ask(rows, stage, Scripted)
    rows = spark.createDataFrame([(1, n, "increased", None, k, "t") for k, n in enumerate(["Alpha", "Beta", "Gamma", "Delta"])], "k int, taxon_name string, direction string, ncbi_id bigint, ord int, artifact_text string")
    kept, flags = review.checked(rows, ["k"], asking)
    assert sorted((r.taxon_name, r.direction) for r in kept.collect()) == [("Alpha", "increased"), ("Beta", "decreased")]
    assert sorted(r.flag for r in flags.collect()) == ["direction not settled: Gamma", "not confirmed: Delta"]


def test_records_that_were_made_can_be_scored(spark):
    """From articles to scores: fields lie beside the signatures, and nothing is blank."""
    experiment = {"host_species": " Homo sapiens ", "body_site": "Feces", "condition": ["x", ""], "group_0_name": "", "sequencing_type": "16s", "statistical_test": ["lefse", "no such"], "mht_correction": "yes"}
    answers = {"study": {"study_design": []}, "segment": {"experiments": ["one"]}, "experiment": experiment, "taxa": {"taxa": [{"taxon_name": "LEfSe", "direction": "increased", "ncbi_id": 1}, {"taxon_name": "Beta", "direction": "increased", "ncbi_id": 5}]}}
    studies, id_map, docs = spark.createDataFrame([("1",), ("x2",)], "pmid string"), spark.createDataFrame([("1", "P1")], "pmid string, pmcid string"), spark.createDataFrame([("P1", XML)], "pmcid string, xml string").withColumn("html", F.lit(""))
    names = spark.createDataFrame([(1, "LEfSe", "lefse", taxonomy.SCIENTIFIC), (2, "Beta", "beta", taxonomy.SCIENTIFIC)], "tax_id bigint, name_txt string, name_norm string, name_class string")
    made = curation.curate(studies, id_map, docs, lambda: curation.MockModel(answers), verify=lambda rows: taxonomy.verified(rows, names).drop("confirmed")).select("pmid", "record", "valid").collect()
    records = {r.pmid: json.loads(r.record) for r in made}
    assert all(r.valid for r in made) and records["x2"] == {"uid": "x2", "citation_mode": "Manual", "experiments": []}
    one = records["1"]["experiments"][0]
    assert {k: v for k, v in one.items() if k != "signatures"} == {"host_species": "Homo sapiens", "body_site": ["Feces"], "condition": ["x"], "sequencing_type": "16S", "statistical_test": ["LEfSe"]}
    assert one["signatures"][0]["taxa"] == [{"taxon_name": "LEfSe", "ncbi_id": 1}, {"taxon_name": "Beta"}] and "study_design" not in records["1"]
    kind = "study_id string, pmid string, has_pmc boolean, experiments array<struct<experiment_id:string,experiment_name:string,body_site:array<string>,condition:array<string>,statistical_test:array<string>,group_0_name:string,group_1_name:string,sequencing_type:string,mht_correction:boolean,signatures:array<struct<signature_id:string,signature_name:string,source:string,source_type:string,direction:string,curation_state:string,taxa:array<bigint>>>>>"
    tree = spark.createDataFrame([("1", "1", True, [("e", "e", ["Feces"], [], [], None, None, "16S", None, [("s", "s", "x", "figure", "increased", "Complete", [1, 2])])])], kind)
    found = study_scores.score_corpus(tree, spark.createDataFrame([(r.pmid, r.record) for r in made], "study_id string, record string"), names, spark.createDataFrame([], "old_tax_id bigint, new_tax_id bigint"))
    assert found["errors"].count() == 0 and {(r.tp, r.fp, r.fn, r.n_matched) for r in found["studies"].collect()} == {(2, 0, 0, 1)}
