"""What the one task that fits the field holds for each word."""

import tracemalloc

import numpy as np
import pyarrow as pa

from taxaloom.llm import toxicity


def test_marginals_hold_few_numbers_a_word():
    chains = toxicity.Chains(pa.array(["one two three four five six. " * 20] * 1000))
    pull, n = np.zeros(len(chains.word)), len(chains.word)
    tracemalloc.start()
    _, counts = chains.marginals(pull, np.ones((2, 2)), pairs=True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(counts, counts.sum() / 4) and round(counts.sum()) == n - len(chains.first)
    assert peak < 112 * n  # 14 numbers
