import random
import resource
import time

import numpy as np
import pytest

from taxaloom.llm import decontaminate as D


def distance(item, text):
    """Least edits of the item against any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_finds_what_brute_force_finds(make_docs, spark):
    rnd = random.Random(11)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(2, 8))) for _ in range(200)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    items = [(k, text(rnd.randrange(12, 30))) for k in range(12)] + [(50, None), (51, "  "), (52, "tiny"), (None, items0 := text(20))]
    rows = [(1000, None), (1001, ""), (1002, "short"), (1003, "x " * 50_000), (1004, f"some TINY thing {items0.upper()}"), (None, "tiny")]
    for i in range(80):
        body = list(rnd.choice(items[:12])[1])
        for _ in range(rnd.randrange(26)):
            at = rnd.randrange(len(body))
            body[at : at + 1] = rnd.choice([[], ["q"], [body[at], "q"]])
        rows.append((i, text(rnd.randrange(30)) + " " + "".join(body) + "\n" + text(rnd.randrange(30))))
    rows += [rows[-1], (90, text(100))]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = D.find(make_docs(rows), bench).collect()
    again = D.find(make_docs(rows), bench, pass_bytes=200).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    found = {(r.doc_id, r.item_id) for r in got}
    raw = lambda t: D.fold(t or "").strip()
    want = set()
    for d, t in rows:
        for k, item in items:
            if raw(item) and d != 1003 and distance(raw(item), raw(t)) <= D.budget(len(raw(item))):
                want.add((d, k))
    assert found == want and len(want) > 20
    whole = dict(rows)
    for r in got:
        assert distance(raw(dict(items)[r.item_id]), raw(whole[r.doc_id][r.start : r.end])) <= r.edits


@pytest.mark.parametrize("unit", ["-", "ab", "– "])
def test_repetitive_texts(unit):
    """Half a million characters of a repeated unit, against items of it, in bounded time and memory."""
    items = [(1, unit * (300 // len(unit))), (2, "x" + unit * (60 // len(unit)) + "something else altogether, of some length, that is not there")]
    index = D.Index.of(items)
    n = 500_000 // len(unit)
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    got = {(i, s) for _, i, s, _, _ in D.scan(index, [unit * n, "none"])}
    assert {i for i, _ in got} == {0} and len(got) > 1000
    assert {d for d, *_ in D.scan(index, ["none", unit * n], first_only=True)} == {1}
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 600_000 and time.time() - began < 60


def test_edits_are_of_characters(make_docs, spark):
    item = "ein Satz über Äpfel und Öfen, der lang genug für fünf Änderungen ist, weil er so weitergeht"
    plain = item.translate(str.maketrans("üÄÖäö", "uAOao"))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [(r.doc_id, r.start, r.end, r.edits) for r in D.find(make_docs([(1, "é " + plain)]), bench).collect()] == [(1, 2, 2 + len(item), sum(a != b for a, b in zip(D.fold(item), D.fold(plain), strict=True)))]


def test_keep_clean_and_empty(make_docs, spark):
    bench = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog again and again")], "item_id long, text string")
    rows = [(1, "so The quick brown fox jumps over the lazy dog again\nand again."), (2, "clean"), (None, "null id"), (3, None)]
    assert sorted((r.doc_id for r in D.keep_clean(make_docs(rows), bench).collect()), key=str) == [2, 3, None]
    assert sorted((r.doc_id for r in D.keep_clean(make_docs([*rows, rows[1], (4, "w " * 100_000)]), bench, pass_bytes=8).collect()), key=str) == [2, 2, 3, 4, None]
    assert D.keep_clean(make_docs([]), bench).count() == 0 and D.keep_clean(make_docs(rows), bench.limit(0)).count() == 4
    assert D.find(make_docs([]), bench).count() == 0
    assert D.find(make_docs(rows), bench.limit(0)).count() == 0


def test_a_run_of_bands_is_aligned_once():
    """Ends, edits and starts of all diagonals at once, against one band at a time and a plain distance."""
    rng = np.random.default_rng(4)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j - 1] + (x != y), last[j] + 1, row[-1] + 1))
        return row[-1]

    for _ in range(40):
        item = rng.integers(0, 3, size=int(rng.integers(3, 12))).astype(np.uint32)
        text = rng.integers(0, 3, size=int(rng.integers(0, 40))).astype(np.uint32)
        low, width = int(rng.integers(-4, 6)), int(rng.integers(1, 30))
        edits, start = D.align_run(item, text, low, width)
        best, end = D.align(item, text, low, width)
        if best < 1000:
            assert edits.min() == best and low + int(edits.argmin()) + len(item) == end
        for k in np.flatnonzero(edits < 100):
            stop = low + int(k) + len(item)
            assert 0 <= start[k] <= stop <= len(text) and distance(item.tolist(), text[start[k] : stop].tolist()) <= edits[k]


@pytest.mark.parametrize("unit", ["-", "-=", "the ", "ab c"])
def test_hostile_repetition_ends(unit):
    """A megabyte of one unit, against items of it: every stretch is found, in seconds."""
    import time

    words = "one two six"
    items = [(unit * 300)[:300] + words, (unit * 400)[:400]]
    index, text = D.Index.of(list(enumerate(items))), (unit * 1_000_000)[:1_000_000]
    began = time.time()
    assert next(D.scan(index, [text], first_only=True))[0] == 0
    assert time.time() - began < 20
    began = time.time()
    found = list(D.scan(index, [text[:100_000]]))
    assert time.time() - began < 40
    for item, size in ((0, 300 + len(words)), (1, 400)):
        starts = sorted(s for _, i, s, _, _ in found if i == item)
        assert starts[0] < 100 and starts[-1] > 100_000 - size - 100 and max(np.diff(starts)) < 200
