"""What grows with the dump is not shuffled or searched more often than it must be."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from taxaloom.operators import alignment, normalize, sets

DATA = Path("/root/testdata/sf0.001")


def test_weights_that_do_not_compete_are_not_searched(monkeypatch):
    rnd = np.random.default_rng(3)
    for _ in range(300):
        w = rnd.random((rnd.integers(1, 6), rnd.integers(1, 6))) * (rnd.random() < 0.5)
        w[rnd.random(w.shape) < 0.8] = 0
        best = alignment.assign(w)
        got = alignment._above(w, 0.1)
        assert sum(w[i, j] for i, j in enumerate(got) if j >= 0) == pytest.approx(sum(w[i, j] for i, j in enumerate(best) if j >= 0 and w[i, j] >= 0.1))
    monkeypatch.setattr(alignment, "assign", None)
    assert alignment._above(np.array([[0, 0.5, 0], [0.05, 0, 0], [0, 0, 0]]), 0.1) == [1, -1, -1]


def test_jaccard_of_sets_is_that_of_arrays(spark):
    rows = spark.createDataFrame([([1, 2, 3], [2, 3, 4]), ([1], [2]), ([], []), ([], [1]), ([5, 6], [6, 5])], "a array<int>, b array<int>")
    for empty in (None, 1.0):
        for r in rows.select(sets.jaccard(F.col("a"), F.col("b"), empty).alias("x"), sets.jaccard_of_sets(F.col("a"), F.col("b"), empty).alias("y")).collect():
            assert r.x == r.y


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_shuffles_of_a_dump(spark):
    from taxaloom.plans import registry

    dump = registry.joins._dump(registry.Tables(spark, str(DATA)))
    shuffles = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    own = shuffles(dump)
    assert shuffles(normalize.split_dump(dump)["signatures_taxa"]) == own
    assert shuffles(normalize.load_studies(dump)) == own + 1
