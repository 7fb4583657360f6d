import math

import numpy as np
import pytest

from taxaloom.llm import covertree


def brute(rows):
    ok = [v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, label in rows]
    vec = [np.array(v, float) if k else None for (_, v, _), k in zip(rows, ok, strict=True)]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    n = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(vec[i]) == len(vec[j]) and vec[i] @ vec[j] / (np.linalg.norm(vec[i]) * np.linalg.norm(vec[j])) >= 0.98:
                n[i] += 1
                n[j] += 1
                parent[find(i)] = find(j)
    best = {}
    for i, (name, _, _) in enumerate(rows):
        if name is not None:
            best[find(i)] = min(best.get(find(i), name), name)
    return sorted(((name, n[i], best.get(find(i)), name is not None and name == best.get(find(i))) for i, (name, _, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("block", [16, 2048])
def test_against_brute_force(spark, block):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    rows = []
    for i in range(260):
        c = centres[int(rng.integers(12)) if i % 3 else 0]
        v = c + rng.normal(size=16) * rng.choice([0, 0.05, 0.12, 0.3, 1.0])
        rows.append((i, (v * rng.choice([1, 1, 3.5])).astype(np.float32).tolist(), int(rng.integers(2)) if i % 3 else 0))
    bad = float("nan")
    rows += [(300, None, 0), (301, [0.0] * 16, 0), (302, [1.0, None] * 8, 0), (303, [bad] * 16, 0), (304, [float("inf")] + [1.0] * 15, 0), (305, [1.0] * 16, None), (None, rows[5][1], rows[5][2]), (5, rows[5][1], rows[5][2]), (306, [], 0), (307, [1.0, 0.0], 0), (308, [1.0, 0.1], 0), (309, [2.0, 0.0], 1)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, node string, block int")
    got = sorted((tuple(r) for r in covertree.near_duplicates(table, block=block).select("vec_id", "n_links", "component_id", "kept").collect()), key=str)
    assert got == brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows])


def test_covering_radii_hold():
    rng = np.random.default_rng(4)
    unit = rng.normal(size=(500, 5))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    todo = [covertree.tree(unit)]
    while todo:
        node = todo.pop()
        assert np.linalg.norm(unit[node.points] - unit[node.centre], axis=1).max() <= node.radius + 1e-6
        if node.children:
            assert sorted(np.concatenate([c.points for c in node.children])) == sorted(node.points)
            assert all(c.radius <= node.radius / 2 + 1e-6 for c in node.children)
        todo += node.children


def test_empty_table(spark):
    assert covertree.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_tiny_and_huge_vectors(spark):
    rows = [(1, [1e-200, 1e-200], 0), (2, [2e-200, 2e-200], 0), (3, [1e200, 1e200], 0), (4, [3.0, 3.0], 0), (5, [1e-200, -1e-200], 0), (6, [0.0, 0.0], 0)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in covertree.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (0, 5), 6: (0, 6)}


def test_cells_keep_every_link_and_spare_far_clusters(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(8, 16))
    near, far = rng.choice([0.02, 0.2, 1.0], size=(400, 1)), rng.normal(size=(400, 16))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(centres[rng.integers(8, size=400)] + near * far * 0.3)]
    points = spark.createDataFrame([(0, v, i, 1, i) for i, v, _ in rows], "label int, vector array<double>, first long, copies long, node long")
    dealt = covertree._meeting(points, 0.98, 20).select("node", "cell", "low", "high").collect()
    together = {}
    for r in dealt:
        together.setdefault((r.cell, r.low, r.high), []).append(r.node)
    assert max(map(len, together.values())) <= 100
    assert sum(len(v) ** 2 for v in together.values()) < 400**2  # each two blocks would be over twice as much
    got = sorted((tuple(r) for r in covertree.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), block=20).select("vec_id", "n_links", "component_id", "kept").collect()), key=str)
    assert got == brute(rows)
