import math
import random
import zlib
from collections import Counter

import pytest

from taxaloom.llm import ngram_lm


def words(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()


def brute(rows, priors):
    """Probabilities by the recursion, one token at a time; contexts never seen back off at no cost."""
    out_of = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    grams, contexts, n_docs = Counter(), Counter(), 0
    for i, text in rows:
        if not out_of(i):
            seq = ["<s>", *words(text), None]
            n_docs += 1
            for at in range(1, len(seq)):
                for length in range(3):
                    if at - length >= 0:
                        h = tuple(seq[at - length : at])
                        grams[h, seq[at]] += 1
                        contexts[h] += 1
    unigrams = {w: c for (h, w), c in grams.items() if not h}
    n, v = sum(unigrams.values()), len(unigrams)

    def p(h, w):
        if not h:
            return (unigrams.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))
        lower = p(h[1:], w)
        return (grams[h, w] + priors[len(h) - 1] * lower) / (contexts[h] + priors[len(h) - 1]) if contexts[h] else lower

    result = []
    for i, text in rows:
        seq = ["<s>", *words(text), None]
        base = sum(math.log10(p((), w)) for w in seq[1:])
        score = sum(math.log10(p(tuple(seq[max(0, at - 2) : at]), seq[at])) for at in range(1, len(seq)))
        result.append((i, out_of(i), len(seq) - 1, sum(unigrams.get(w, 0) > 0 for w in seq[1:]), n, base, score))
    return result


@pytest.mark.parametrize("block_bytes", [200, 1 << 20])
def test_against_brute_force(make_docs, block_bytes):
    rnd = random.Random(2)
    vocabulary = [f"Wort{k}" for k in range(40)] + ["É", "é", "\x1cx"]
    rows = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(60)))) for i in range(80)]
    rows += [(None, "null id Wort1"), (5, "again again"), (5, "again again"), (500, None), (501, ""), (502, " \n "), (503, "long " * 50_000)]
    got = sorted((tuple(r) for r in ngram_lm.score(make_docs(rows), priors=(7.0, 1.5), block_bytes=block_bytes).collect()), key=str)
    want = sorted(brute(rows, (7.0, 1.5)), key=str)
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=lambda r: str(r[:5])), sorted(want, key=lambda r: str(r[:5])), strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:])


def test_empty_table(make_docs):
    assert ngram_lm.score(make_docs([])).count() == 0
