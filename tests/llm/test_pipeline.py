import hashlib
import random
import re

import numpy as np

from taxaloom.llm import simhash


def test_stages_take_effect(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    rnd = random.Random(7)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 9))) for _ in range(600)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    bench = [text(30) for _ in range(3)]
    insults = ["loser", "idiot", "moron", "scum"]
    rows, labels = [], []
    for i in range(300):
        body = text(rnd.randrange(20, 80)).split()
        if i % 6 == 0:
            for _ in range(4):
                body.insert(rnd.randrange(len(body)), rnd.choice(insults))
        rows.append((i, " ".join(body)))
        labels.append((i, 1, int(i % 6 == 0)))
    long = text(400).split()
    near = list(long)
    near[200] = "changed"
    rows += [(1000, " ".join(long)), (1001, " ".join(long)), (1002, " ".join(near)), (1003, f"{text(10)} {bench[0]} {text(5)}"), (1004, f"{text(20)} token=abcdefgh {text(3)}"), (1005, None), (1006, "")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    clean = {i for i, _ in rows if i >= 300 or i % 6}
    assert set(got) == clean - {1001, 1002, 1003}
    tokenizer = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    for i, t in rows:
        if i in got:
            kept = re.sub("token=abcdefgh", "[secret]", t or "")
            ids = tokenizer.encode(kept, add_special_tokens=False).ids
            assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, str(tmp_path))
        assert frame.schema.simpleString() == spark.read.parquet(f"{tmp_path}/documents.parquet").schema.simpleString()


def test_similar_groups_against_jaccard(make_docs):
    rnd = random.Random(3)
    new = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    rows = []
    for g in range(60):
        body = new(300)
        for c in range(3):
            copy = list(body)
            for _ in range((0, 2, 4)[c]):
                copy[rnd.randrange(300)] = "x"
            rows.append((g * 10 + c, " ".join(copy)))
    rows += [(2000 + k, " ".join(new(100))) for k in range(100)] + [(5000, ""), (5001, None), (None, "a b"), (5002, "one"), (5003, "one")]
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(make_docs(rows)).collect()}
    assert all(got[2000 + k] == 2000 + k for k in range(100))
    assert sum(got[g * 10 + c] == g * 10 for g in range(60) for c in (1, 2)) >= 114
    assert got[5003] == 5002 and got[5000] == 5000
    assert {got[g * 10] for g in range(60)} == {g * 10 for g in range(60)}


def jaccard_groups(rows, k=5):
    """The smallest id of each text's component, by comparing all pairs."""
    sets = {i: {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} for i, t in rows if (w := t.lower().split())}
    best = {i: i for i in sets}

    def find(i):
        while best[i] != i:
            i = best[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                best[b] = a
    return {i: find(i) for i in sets}


def test_near_copies_in_a_crowd_meet(make_docs):
    """Texts of one long passage: buckets hold many that are not similar, and copies must meet whoever is smallest."""
    rnd = random.Random(11)
    new = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    passage, rows = new(320), [(2, "")]
    rows += [(10 + k, " ".join(passage + new(44))) for k in range(400)]
    for g in range(40):
        own = new(44)
        copy = own[:19] + new(25)
        rows += [(1000 + g, " ".join(passage + own)), (2000 + g, " ".join(passage + copy))]
    want = jaccard_groups(rows)
    assert all(want[2000 + g] == 1000 + g for g in range(40)) and len(set(want.values())) == 440
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(make_docs(rows)).collect()}
    assert got == want | {2: 2}


def test_all_pairs_just_over_the_similarity(make_docs):
    """Copies at 0.8 to 0.83, just under it, and texts that differ only in how often a paragraph comes."""
    rnd = random.Random(12)
    new = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    rows = []
    for g in range(150):
        base = new(204)  # 200 shingles; a changed end of c words keeps 200 - c
        rows += [(g, " ".join(base)), (1000 + g, " ".join(base[: 204 - (c := 18 + g % 6)] + new(c)))]
    for g in range(5):
        lead, paragraph = new(60), new(60)
        rows += [(2000 + g, " ".join(lead + paragraph * 2)), (3000 + g, " ".join(lead + paragraph * 50))]
    want = jaccard_groups(rows)
    assert sum(want[1000 + g] == g for g in range(150)) == 125 and all(want[3000 + g] == 2000 + g for g in range(5))
    assert {r.doc_id: r.component_id for r in simhash.similar_groups(make_docs(rows)).collect()} == want
