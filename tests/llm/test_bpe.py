import hashlib

import numpy as np
import pytest

from taxaloom.llm import bpe

PATH = "/opt/tokenizers/byte_bpe_50k.json"
TEXTS = [
    "Hello world, it's 2024!", "", None, "   ", "a  b\n\n c \n", "\n\nx\t\ty  ", " lead", "trail \n", "don't I'll we've 'S", "naïve café — “x” Ⅷ² ٣", "nb\xa0sp  em\x1cfs　wide", "a<|endoftext|>b <|endoftext|> c", "  <|endoftext|>  x",
    "x" * 5000, "word " * 4000, "🤖🏽 emoji\U0010ffff", "same text", "same text", "'s's 's", "<|endoftext", "\x85a\x85 b", "a<|endoftext|><|endoftext|>",
    "a \n \nb", "x \n ", "x\n b", "x \nb", "a   b", "   b", "  b", " \nb", "a  ", "a ", "a \u3000 \u3000b", "a\n\n b c", "\n", " ", "  ", "a\t \tb", "l1.\nL2 'll it's\n",
]


@pytest.mark.parametrize("block_bytes", [50, 1 << 20])
def test_same_as_the_tokenizer(make_docs, block_bytes):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "null id"), (3, "   ")]
    got = bpe.digests(bpe.encode(make_docs(rows), PATH, block_bytes=block_bytes)).collect()
    want = []
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_empty_table(make_docs):
    assert bpe.encode(make_docs([]), PATH).count() == 0


def test_random_white_space(make_docs):
    import random

    from tokenizers import Tokenizer

    rnd = random.Random(3)
    rows = [(i, "".join(rnd.choice([" ", " ", "\n", "\t", "\xa0", "a", "b1", "!", "é", "<|endoftext|>" if i % 9 == 0 else "'s"]) for _ in range(rnd.randrange(30)))) for i in range(1500)]
    tokenizer = Tokenizer.from_file(PATH)
    got = dict(bpe.encode(make_docs(rows), PATH).select("doc_id", "ids").collect())
    assert {i: got[i] for i, _ in rows} == {i: tokenizer.encode(t, add_special_tokens=False).ids for i, t in rows}
