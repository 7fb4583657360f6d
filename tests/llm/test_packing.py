import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from taxaloom.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def best_fit_decreasing(lengths, capacity):
    """One piece at a time, into the fullest sequence that has room."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


def spread(p, lengths):
    """Every piece's (sequence, offset, length) from the ranges of ranks."""
    keys, out = list(zip(p.length.tolist(), p.rank.tolist(), strict=True)), []
    for length, n in lengths.items():
        mine = [i for i, k in enumerate(keys) if k[0] == length]
        for rank in range(n):
            at = max((i for i in mine if keys[i][1] <= rank), key=lambda i: keys[i][1])
            within = rank - keys[at][1]
            out.append((p.sequence[at] + within // p.per[at], p.offset[at] + within % p.per[at] * length, length))
    return out


def whole(rows, capacity):
    """Sequences have no holes and are not too long; how many there are."""
    by = defaultdict(list)
    for s, o, n in rows:
        by[int(s)].append((int(o), int(n)))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("seed", range(12))
def test_rounds_are_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.choice([8, 50, 100]))
    high = int(rng.integers(1, capacity + 1))
    lengths = Counter((rng.integers(1, high + 1, size=400) if seed % 3 else np.maximum(1, rng.geometric(0.2, size=400) % capacity)).tolist())
    lengths[int(rng.integers(1, capacity + 1))] += 300
    rows = spread(packing.rounds(dict(lengths), capacity), lengths)
    assert Counter(n for *_, n in rows) == lengths
    assert whole(rows, capacity) == best_fit_decreasing(list(lengths.elements()), capacity)


def test_cuts():
    assert packing.cuts(5, 4) == [(0, 1), (1, 5)] and packing.cuts(8, 4) == [(0, 4), (4, 8)] and packing.cuts(4, 4) == [(0, 4)] and packing.cuts(1, 4) == [(0, 1)]


def test_against_the_tokenizer(spark, make_docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    rng = np.random.default_rng(2)
    words = ["the", "Antelope", "  ", "über", "\n\n", "<|endoftext|>", "x" * 40, "日本語", "9,81"]
    texts = [" ".join(rng.choice(words, size=int(n))) for n in rng.integers(0, 60, size=80)] + [None, "", " ", "word " * 9000, "a b c"]
    rows = [(i, x) for i, x in enumerate(texts)] + [(None, "no id"), (3, texts[3]), (3, texts[4])]
    docs = make_docs(rows).repartition(3)
    got = packing.pack(docs, PATH, 2, capacity=64).collect()
    want = []
    for i, x in rows:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        first = len(ids) if len(ids) <= 64 else len(ids) % 64 or 64
        ends = [first, *range(first + 64, len(ids) + 1, 64)]
        want += [(i, k, s, e - s, zlib.crc32(np.array(ids[s:e], "<u4").tobytes())) for k, (s, e) in enumerate(zip([0, *ends], ends))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    n = whole([(r.sequence_id, r.offset, r.length) for r in got], 64)
    total = sum(r.length for r in got)
    assert n == best_fit_decreasing([r.length for r in got], 64) and n <= math.ceil(total / 64) * 1.02 + 1


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_words_are_encoded_as_if_alone(most):
    import pyarrow as pa
    from tokenizers import Tokenizer

    from taxaloom.llm import bpe

    t, table, rng = Tokenizer.from_file(PATH), bpe.WordTable(PATH, most), np.random.default_rng(7)
    letters = list("ab 'sé\u2028\n\t.,<|1") + ["<|endoftext|>", "<|endof", "text|>", "日"]
    for _ in range(4):
        texts = ["".join(rng.choice(letters, size=int(n))) for n in rng.integers(0, 40, size=300)] + [None, ""]
        ids, ends = table.ids(pa.table({"text": pa.array(texts, pa.string())}))
        got = [ids[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        assert got == [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_empty_table(spark, make_docs):
    assert packing.pack(make_docs([]), PATH, 2).count() == 0
