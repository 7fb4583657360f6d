import csv
import json

import pytest
from pyspark.sql import functions as F

from taxaloom.functions import coerce as C
from taxaloom.functions import text as T
from taxaloom.operators import normalize
from taxaloom.sources import dump


@pytest.fixture(scope="module")
def sample(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("dump") / "dump.csv"
    base = dict.fromkeys(dump.COLUMNS, "NA")
    one = {"Study": "S1", "PMID": "+5", "Experiment": "Experiment 1", "Authors list": "Doe, J., Roe, R.A. and Poe, E.", "Location of subjects": "Korea, Republic of,China", "16S variable region": "34", "MHT correction": "FALSE", "State": "Complete"}
    rows = [
        base | one | {"BSDB ID": "b/1", "Signature page name": "Signature 1", "Abundance in Group 1": "Increased", "MetaPhlAn taxon names": "k__Bacteria|g__Alpha,s__beta", "NCBI Taxonomy IDs": "2|10;20", "Curated date": "5 March 2020", "Description": 'a "quoted"\n# line'},
        base | {"Study": "S2", "Experiment": "Experiment 1", "BSDB ID": "b/9", "Signature page name": "Signature 1", "MetaPhlAn taxon names": "x,y", "NCBI Taxonomy IDs": "7"},
        base | one | {"PMID": "6", "BSDB ID": "b/2", "Signature page name": "Signature 2", "MetaPhlAn taxon names": "renamed", "NCBI Taxonomy IDs": "20"},
        base | one | {"Experiment": "Experiment 2", "BSDB ID": "b/3/NA"},
        base | {"Study": "null", "Experiment": "E"},
    ]
    with open(path, "w", newline="") as f:
        f.write("# banner\n")
        w = csv.DictWriter(f, dump.COLUMNS)
        w.writeheader()
        w.writerows(rows)
    return dump.read_dump(spark, str(path)).cache()


def test_split(sample):
    t = normalize.split_dump(sample)
    assert {k: v.count() for k, v in t.items()} == {"studies": 2, "experiments": 3, "signatures": 4, "taxa": 4, "signatures_taxa": 4}
    assert {r.study_id: r.pmid for r in t["studies"].collect()} == {"S1": "+5", "S2": ""}
    assert {r.ncbi_id: r.taxon_name for r in t["taxa"].collect()} == {"2": "k__Bacteria", "10": "g__Alpha", "20": "renamed", "7": "x"}
    assert sorted(map(tuple, t["signatures_taxa"].collect())) == [("b/1", "10"), ("b/1", "20"), ("b/2", "20"), ("b/9", "7")]


def test_nested(sample):
    studies = {r.uid: json.loads(r.j) for r in normalize.load_studies(sample).select("uid", F.to_json(F.struct("*")).alias("j")).collect()}
    s = studies["S1"]
    assert s["pmid"] == 5 and s["citation_mode"] == "Auto" and s["authors"] == ["Doe J.", "Roe R.A.", "Poe E."]
    first = s["experiments"][0]
    assert first["location_of_subjects"] == ["Korea, Republic of", "China"] and first["mht_correction"] is False
    assert (first["variable_region_lower_bound"], first["variable_region_upper_bound"]) == ("3", "4")
    signature = first["signatures"][0]
    assert signature["abundance_in_group_1"] == "increased" and signature["curated_date"] == "2020-03-05" and signature["description"] == 'a "quoted"\n# line'
    assert signature["taxa"][0]["ncbi_id"] == 10 and signature["taxa"][0]["rank"] == "genus" and "lineage" not in signature["taxa"][1]
    assert "signatures" not in s["experiments"][1]
    assert [t.get("taxon_name") for t in studies["S2"]["experiments"][0]["signatures"][0]["taxa"]] == [None]
    assert tuple(normalize.summarize(normalize.load_studies(sample)).first()) == (3, 4, 3)
    assert tuple(normalize.summarize(normalize.load_studies(sample, limit=1)).first()) == (1, 1, 1)


@pytest.mark.parametrize(
    ("f", "cases"),
    [
        (C.to_int, {"5": 5, "+5": 5, "-3": -3, "1_000": 1000, "5.7": None, "": None, "NA": None, " 7\t": 7, "1__0": None, None: None}),
        (C.to_float, {"0.05": 0.05, ".5": 0.5, "1e-3": 0.001, "1.0d": None, "0.05f": None, "x": None, "inf": float("inf")}),
        (C.to_bool, {"TRUE": True, "no": False, "t": None, "1": None}),
        (C.to_date_text, {"5 March 2020": "2020-03-05", "March 2020": "March 2020", "NA": None}),
        (lambda c: C.to_member(c, ("PCR", "16S")), {"pcr": "PCR", "16S": "16S", "x": None}),
        (C.clean_text, {"null": "", "Na": "", " a ": "a", None: ""}),
        (C.clean, {"null": "null", "NA": None, " a ": "a"}),
        (C.human_size, {0: "0 B", 1536: "1.5 KB", 5 * 1024**2: "5.0 MB"}),
        (T.split_strict, {"a,b": ["a", "b"], "Korea, Republic of,x": ["Korea, Republic of", "x"], "NA": []}),
        (T.split_loose, {"a, b,,c": ["a", "b", "c"]}),
        (T.split_authors, {"Doe, J., Roe, R. A.": ["Doe J.", "Roe R. A."], "Doe, Jane": ["Doe", "Jane"], "A, B, C": ["A", "B", "C"]}),
        (T.taxon_key, {" g__Faecalibacterium__prausnitzii ": "faecalibacterium prausnitzii", "G__X": "g x", "s_Ab_c": "ab c"}),
        (T.source_type, {"Suppl. Table 2": "supplement", "Table S3": "supplement", "Fig. 2": "figure", "Figs 2": "other", "Table 1": "main-table", "NA": "other"}),
        (T.figure_number, {"Figure 3A": "3", "fig 3": None}),
        (T.count_bucket, {0: "1", 1: "1", 5: "2-5", 20: "6-20", 21: "21+"}),
        (T.ontology_id, {"http://x/obo/uberon_0001988": "UBERON:0001988", "x": None}),
        (T.message_path, {"bad thing in /a/b": "/a/b", "bad": None}),
        (T.escape_html, {"a<b&c": "a&lt;b&amp;c"}),
    ],
)
def test_functions(spark, f, cases):
    kind = "long" if all(isinstance(k, int) for k in cases) else "string"
    frame = spark.createDataFrame([(i, k) for i, k in enumerate(cases)], f"i int, v {kind}")
    got = [r.x for r in frame.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]
    assert got == list(cases.values())


def test_loose_json(spark):
    texts = ['{"a": 1}', 'text ```json\n{"a": 2}\n``` more', 'so {"a": 3} it is', "none", "[1]"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string")
    got = [r.x.a if r.x else None for r in frame.select("i", T.loose_json(F.col("v"), "a int").alias("x")).orderBy("i").collect()]
    assert got == [1, 2, 3, None, None]


@pytest.mark.parametrize("banner", ["# v1, of a day\n", ""])
def test_only_the_banner_is_left_out(spark, tmp_path, banner):
    rows = [dict.fromkeys(dump.COLUMNS, "NA") | {"BSDB ID": i, "Study": "S"} for i in ("# not a comment", "b/2")]
    with open(tmp_path / "d.csv", "w", newline="") as f:
        f.write(banner)
        w = csv.DictWriter(f, dump.COLUMNS)
        w.writeheader()
        w.writerows(rows)
    assert [r["BSDB ID"] for r in dump.read_dump(spark, str(tmp_path / "d.csv")).orderBy(dump.ORDER).collect()] == ["# not a comment", "b/2"]
