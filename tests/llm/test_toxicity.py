import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from taxaloom.llm import toxicity


def corpus(n, seed=0):
    rnd = random.Random(seed)
    plain = [f"w{k}ord" for k in range(400)]
    rows, labels = [], []
    for i in range(n):
        words = [rnd.choice(plain) + rnd.choice(["", "", ".", ","]) for _ in range(rnd.randrange(5, 60))]
        toxic = i % 5 == 0
        for _ in range(rnd.randrange(2, 5) if toxic else 0):
            words.insert(rnd.randrange(len(words)), rnd.choice(["Loser!", "idiot", "scum,", "blarg" + rnd.choice("abcdefgh")]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_spans(make_docs, spark):
    rows, labels = corpus(800)
    extra = [(None, "loser idiot scum"), (5000, None), (5001, ""), (5002, " \n"), (5003, "w1ord " * 60_000), (5004, "LOSER idiot scum blargz"), (5004, "LOSER idiot scum blargz")]
    table = spark.createDataFrame([(i, 1, t) for i, t in labels] + [(None, 1, 1), (5000, None, None), (0, 0, None)], "doc_id long, quality int, toxic int")
    out = toxicity.score(make_docs(rows + extra), table).collect()
    assert len(out) == len(rows) + len(extra)
    got = {r.doc_id: r for r in out}
    held = [(i, t) for i, t in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((got[i].score >= 0.3) == (t == 1) for i, t in held) / len(held) > 0.97
    assert got[5000].score == got[5001].score == got[5002].score < 0.3
    assert got[5003].score < 0.3 <= got[5004].score
    assert got[None].score >= 0.3
    text = dict(rows)
    found = {text[i][s.start : s.end].strip(".,!").lower()[:5] for i, t in labels if t for s in got[i].spans}
    assert {"loser", "idiot", "scum", "blarg"} <= found


def test_marginals_against_enumeration():
    chains = toxicity.Chains(pa.array(["a b c d", "e. f", None, "", "g"]))
    rnd = np.random.default_rng(1)
    pull, moves = rnd.normal(size=len(chains.word)), np.exp(rnd.normal(size=(2, 2)))
    m, pairs = chains.marginals(pull, moves, pairs=True)
    want, counts = np.zeros(len(pull)), np.zeros((2, 2))
    for s, n in zip(chains.starts, chains.lengths, strict=True):
        total, part, moved = 0.0, np.zeros(n), np.zeros((2, 2))
        for code in range(2**n):
            y = [code >> k & 1 for k in range(n)]
            w = np.exp(sum(pull[s + k] for k in range(n) if y[k])) * np.prod([moves[a, b] for a, b in zip(y[:-1], y[1:], strict=True)])
            total += w
            part += w * np.array(y)
            for a, b in zip(y[:-1], y[1:], strict=True):
                moved[a, b] += w
        want[s : s + n] = part / total
        counts += moved / total
    assert np.allclose(m, want) and np.allclose(pairs, counts)


def test_no_labels_and_empty_tables(make_docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score(make_docs([]), none).count() == 0
    assert toxicity.score(make_docs([(1, "a b")]), none).first().score < 0.3


def test_the_model_does_not_depend_on_the_order_of_repeated_ids(make_docs, spark):
    rows, labels = corpus(200)
    rows += [(0, "zz yy xx"), (5, None), (5, "aa bb")]
    table = spark.createDataFrame([(i, 1, t) for i, t in labels], "doc_id long, quality int, toxic int")
    models = [toxicity.train(make_docs(r).repartition(n), table) for r, n in ((rows, 3), (rows[::-1], 2))]
    assert all(np.array_equal(a, b) for a, b in zip(vars(models[0]).values(), vars(models[1]).values(), strict=True))


def test_a_long_text_does_not_fill_the_sample(make_docs, spark):
    rows, labels = corpus(300)
    rows = [(i, t + " pad" * 40_000 if i % 7 == 0 else t) for i, t in rows]
    table = spark.createDataFrame([(i, 1, t) for i, t in labels], "doc_id long, quality int, toxic int")
    model = toxicity.train(make_docs(rows), table, sample_bytes=150_000)
    chains = toxicity.Chains(pa.array([t for i, t in rows if i % 7]))
    got = toxicity.document_scores(chains, model)[0] >= 0.3
    want = np.array([i % 5 == 0 for i, _ in rows if i % 7])
    assert (got == want).mean() > 0.9


def test_clean_rows_stay(spark):
    rows, labels = corpus(300)
    frame = spark.createDataFrame([("b", t, 1, i, 0.5) for i, t in [*rows, (None, None), (900, ""), (901, "w1ord"), (901, "w1ord"), (None, "loser idiot scum")]], "p string, text string, score int, doc_id long, toxic double")
    table = spark.createDataFrame([(i, 1, t) for i, t in labels], "doc_id long, quality int, toxic int")
    out = toxicity.keep_clean(frame, table)
    assert out.schema == frame.schema
    ids = sorted((r.doc_id, r.text) for r in out.where("doc_id >= 900 or doc_id is null").collect() if r.doc_id)
    assert ids == [(900, ""), (901, "w1ord"), (901, "w1ord")] and [r.text for r in out.where("doc_id is null").collect()] == [None]
    assert toxicity.keep_clean(frame.limit(0), table).count() == 0


def test_long_sentences_are_one_chain(monkeypatch):
    """Sentences of any length against a plain forward-backward pass, and against stretches of another size."""
    rng = np.random.default_rng(9)
    words = [f"w{k}" for k in range(40)]
    sentences = [int(n) for n in rng.integers(1, 20, size=30)] + [128, 129, 256, 257, 1000]
    texts = [" ".join(rng.choice(words, size=n)) + "." for n in sentences] + ["", " ".join(rng.choice(words, size=700))]
    moves = np.array([[1.3, 0.4], [0.7, 2.5]])
    chains = toxicity.Chains(pa.array(texts))
    pull = rng.normal(size=len(chains.word)) * 2
    got, counts = chains.marginals(pull, moves, pairs=True)
    want, total, at = [], np.zeros((2, 2)), 0
    for n in [*sentences, 700]:
        up = np.stack([np.ones(n), np.exp(pull[at : at + n])], axis=1)
        a, b = np.empty((n, 2)), np.ones((n, 2))
        a[0] = up[0] / up[0].sum()
        for t in range(1, n):
            a[t] = a[t - 1] @ moves * up[t]
            a[t] /= a[t].sum()
        for t in range(n - 2, -1, -1):
            b[t] = moves @ (up[t + 1] * b[t + 1])
            b[t] /= b[t].sum()
        want.append((a * b)[:, 1] / (a * b).sum(axis=1))
        for t in range(1, n):
            joint = a[t - 1][:, None] * moves * (up[t] * b[t])
            total += joint / joint.sum()
        at += n
    assert np.allclose(got, np.concatenate(want)) and np.allclose(counts, total)
    monkeypatch.setattr(toxicity, "STRETCH", 7)
    again, counts_again = toxicity.Chains(pa.array(texts)).marginals(pull, moves, pairs=True)
    assert np.allclose(got, again) and np.allclose(counts, counts_again)


def test_a_sentence_of_a_million_words():
    import time

    chains = toxicity.Chains(pa.array(["word " * 1_000_000]))
    began = time.time()
    assert chains.marginals(np.zeros(1_000_000), np.ones((2, 2)))[0].max() == pytest.approx(0.5)
    assert time.time() - began < 20
