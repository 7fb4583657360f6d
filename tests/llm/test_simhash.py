import random

import xxhash

from taxaloom.llm import simhash


def fingerprint(text, k=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = [fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    best = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            best[find(i)] = min(best.get(find(i), doc), doc)
    return sorted(((doc, prints[i], best.get(find(i))) for i, (doc, _) in enumerate(rows)), key=str)


def test_against_brute_force(make_docs):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    base = [rnd.choice(words) for _ in range(2000)]
    rows = [(None, "no id"), (900, None), (901, ""), (902, " \n\t"), (903, "one"), (904, "One TWO"), (905, "É é"), (906, "x " * 60_000), (903, "one")]
    for i in range(60):
        w = list(base)
        for _ in range(i % 5):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        rows.append((i, " ".join(w)))
    got = simhash.near_duplicates(make_docs(rows)).collect()
    want = brute(rows)
    assert len({w[2] for w in want}) < len(rows) - 10
    assert sorted(((r[0], r[1] & (2**64 - 1), r[2]) for r in got), key=str) == want


def test_links_are_all_found(spark):
    rnd = random.Random(6)
    centre = rnd.getrandbits(64)
    values = {0, 2**64 - 1, centre} | {centre ^ (1 << i) ^ (1 << j) for i in range(0, 64, 3) for j in range(1, 64, 5)} | {rnd.getrandbits(64) for _ in range(50)}
    signed = {v - (1 << 64) if v >> 63 else v: v for v in values}
    got = {frozenset((signed[r.a], signed[r.b])) for r in simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()}
    assert got == {frozenset((x, y)) for x in values for y in values if 1 <= (x ^ y).bit_count() <= 2}


def test_empty_table(make_docs):
    assert simhash.near_duplicates(make_docs([])).count() == 0


def test_no_text_is_lost_with_an_id(spark):
    """Ids with several texts, texts with several ids, repeated rows, names of columns that are used inside."""
    rnd = random.Random(8)
    new = lambda n: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))
    a, b, c, d = new(50), new(50), new(50), new(100)
    near = " ".join(d.split()[:96] + ["x"] * 4)
    rows = [(3, a), (5, a), (5, b), (7, b), (8, c), (8, c), (8, c), (9, d), (9, near), (9, near), (4, near), (None, a), (None, a), (11, None), (11, None), (12, ""), (13, ""), (3, a)]
    for shift in (0, (1 << 63) - 14):
        moved = [(None if i is None else i + shift, t) for i, t in rows]
        got = sorted(((r["doc_id"], r["text"]) for r in simhash.keep_first(spark.createDataFrame([(i, t, 1, "x") for i, t in moved], "doc_id long, text string, same int, node string")).collect()), key=str)
        want = [(3, a), (5, b), (8, c), (4, near), (None, a), (None, a), (11, None), (11, None), (12, "")]
        assert got == sorted([(None if i is None else i + shift, t) for i, t in want], key=str)
    groups = sorted((r.doc_id, r.component_id) for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert groups == sorted([(3, 3), (5, 3), (5, 5), (7, 5), (8, 8), (8, 8), (8, 8), (9, 4), (9, 4), (9, 4), (4, 4), (12, 12), (13, 12), (3, 3)])


def test_one_text_of_two_similar_ones_at_the_smallest_id(spark):
    words = [f"v{k}" for k in range(100)]
    one, two = " ".join(words), " ".join(words[:97] + ["x", "y", "z"])
    rows = [(1, one), (1, two), (2, one)]
    got = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 1 and got[0].doc_id == 1 and got[0].text in (one, two)


def test_near_copies_meet_by_fingerprint(make_docs, monkeypatch):
    """The stage's first step is SimHash: copies within two bits go without the prefix join, texts that only share a fingerprint stay."""
    rnd = random.Random(5)
    new = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    body = new(4000)
    rows = [(1, " ".join(body)), (2, " ".join(body + ["end"])), (3, " ".join(new(50)))]
    rows += [(4, " ".join(["same"] * 300 + new(60))), (5, " ".join(["same"] * 300 + new(60)))]
    docs = make_docs(rows)
    prints = {r.doc_id: r.fingerprint for r in simhash.fingerprints(docs).collect()}
    assert bin((prints[1] ^ prints[2]) & (1 << 64) - 1).count("1") <= 2 and prints[4] == prints[5]
    whole = simhash.prefixes
    monkeypatch.setattr(simhash, "prefixes", lambda *given: whole(*given).limit(0))
    assert sorted(r.doc_id for r in simhash.keep_first(docs).collect()) == [1, 3, 4, 5]
