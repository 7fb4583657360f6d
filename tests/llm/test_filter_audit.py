import itertools
import re

from taxaloom.llm import filter_audit


def brute(docs, labels):
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    rows = []
    for i, text, lang in docs:
        text, words = text or "", re.findall("[^\x20\x09-\x0d]+", text or "")
        rows.append((i, lang or "", {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": any(c in text for c in "#$%&*|"),
            "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs),
        }))
    out = {}
    for part in {p for _, p, _ in rows}:
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = [(i, f) for i, p, f in rows if p == part]
            everyone = left
            for step, letter in enumerate(order, 1):
                removed = [i for i, f in left if f[letter]]
                failing = sum(f[letter] for _, f in everyone)
                left = [(i, f) for i, f in left if not f[letter]]
                shapley[letter] += len(removed)
                unique = sum(f[letter] and sum(f.values()) == 1 for _, f in everyone)
                out[part, "".join(order), step] = [len(left), len(removed), failing - len(removed), unique, sum(i in good for i in removed), sum(i in toxic for i in removed), letter]
        for key, row in out.items():
            if key[0] == part:
                row[-1] = shapley[row[-1]]
    return {k: tuple(v) for k, v in out.items()}


def same(spark, docs, labels):
    table = spark.createDataFrame([(i, t, lang, "x", 1) for i, t, lang in docs], "doc_id long, text string, lang string, part string, mask int")
    got = filter_audit.audit(table, spark.createDataFrame([(*r, 9) for r in labels], "doc_id long, quality int, toxic int, n int")).collect()
    found = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got}
    assert len(found) == len(got)
    assert found == brute(docs, labels)


def test_against_brute_force(spark):
    varied = " ".join(f"w{k}" for k in range(210))
    texts = [varied, varied + " #", "a b c", "AAAA b", "x " * 250, "X# " * 250, None, "", varied + "\u000b\u0085é" * 3, "w w " * 100 + varied, "\U0001f600 " * 220, "%" * 5000]
    docs = [(k * 7 % 97, texts[k * k % len(texts)], ["en", "de", None, ""][k % 4]) for k in range(97)]
    docs += [(None, varied, "en"), (None, varied, "en"), (3, varied, "en"), (3, varied, "en"), (3, "other", "de"), (-5, varied, "fr")]
    labels = [(k, k % 3 % 2, int(k % 5 == 0)) for k in range(0, 97, 2)] + [(None, 1, 1), (4, 1, 1), (4, None, 0), (6, None, None), (500, 1, 1)]
    same(spark, docs, labels)


def test_one_text_everywhere(spark):
    same(spark, [(k, "one two", "en" if k % 2 else "de") for k in range(40)], [])


def test_empty_table(spark):
    same(spark, [], [(1, 1, 1)])
