import random

import pytest

from taxaloom.operators import labels, taxonomy


def paths(parents):
    """Each node's ancestors from itself up, to a root, a missing parent or a node already met."""
    out = {}
    for node in parents:
        path, at = [], node
        while at in parents and at not in path:
            path.append(at)
            at = parents[at] if parents[at] != at else None
        out[node] = path
    return out


def forest(seed):
    r = random.Random(seed)
    ids = r.sample(range(1, 500_000), 120)
    parents = {ids[0]: ids[0], ids[1]: 700_000}
    for k, node in enumerate(ids[2:90], 2):
        parents[node] = r.choice(ids[max(0, k - r.choice([1, 5, 200])) : k])
    for a, b in zip(ids[90:93], ids[91:94], strict=True):  # a loop of three, and nodes below it
        parents[a] = b if b != ids[93] else ids[90]
    for k, node in enumerate(ids[93:], 93):
        parents[node] = r.choice(ids[90:k])
    return parents


@pytest.mark.parametrize(("seed", "local"), [(1, 1 << 20), (2, 0), (3, 1 << 20)])
def test_ancestors_equal_a_walk(spark, monkeypatch, seed, local):
    monkeypatch.setattr(labels, "LOCAL", local)
    parents = forest(seed)
    want = paths(parents)
    nodes = spark.createDataFrame([(k, v, f"r{k % 7}") for k, v in parents.items()], "tax_id bigint, parent_tax_id bigint, rank string").repartition(3)
    tree = labels.labelled(nodes)
    got = {}
    for r in taxonomy.ancestors(nodes, tree).collect():
        assert r.rank == f"r{r.ancestor % 7}"
        got.setdefault(r.tax_id, {})[r.depth] = r.ancestor
    assert {k: [v[d] for d in range(len(v))] for k, v in got.items()} == want
    label = {r.tax_id: r for r in tree.collect()}
    for node, path in want.items():
        own, loops = label[node], parents.get(parents[path[-1]], None) is not None and parents[path[-1]] in path and parents[path[-1]] != path[-1]
        assert (own.low is None) == loops
        if not loops:
            assert own.depth == len(path) - 1
            assert own.high - own.low + 1 == sum(node in p for p in want.values())
            assert {k for k, r in label.items() if r.low is not None and own.low <= r.low <= own.high} == {k for k, p in want.items() if node in p}
    lows = sorted(r.low for r in label.values() if r.low is not None)
    assert lows == list(range(len(lows)))
    tops = spark.createDataFrame([(k,) for k in list(parents)[5:100:17]], "tax_id bigint")
    chosen = {r.tax_id for r in tops.collect()}
    assert {r.tax_id for r in taxonomy.below(nodes, tops, tree).collect()} == {k for k, p in want.items() if chosen & set(p)}
    for top in (list(parents)[3], list(parents)[91], 999_999):
        assert {r.tax_id for r in taxonomy.subtree(tree, top).collect()} == {k for k, p in want.items() if top in p}


@pytest.mark.parametrize("local", [0, 1 << 20])
def test_deep_chains_and_wide_families(spark, monkeypatch, local):
    monkeypatch.setattr(labels, "LOCAL", local)
    chain = spark.range(1, 1001).selectExpr("id AS tax_id", "greatest(id - 1, 1) AS parent_tax_id", "'x' AS rank")
    tree = labels.labelled(chain)
    assert tree.where("depth <> tax_id - 1 OR low <> tax_id - 1 OR high <> 999").count() == 0
    assert taxonomy.ancestors(chain.where("tax_id = 1000"), tree).count() == 1000
    wide = spark.range(0, 200_000).selectExpr("id AS tax_id", "0 AS parent_tax_id", "'x' AS rank")
    tree = labels.labelled(wide)
    assert tree.where("low <> tax_id OR depth <> if(tax_id = 0, 0, 1) OR high <> if(tax_id = 0, 199999, tax_id)").count() == 0


def test_empty_tree(spark):
    nodes = spark.createDataFrame([], "tax_id bigint, parent_tax_id bigint, rank string")
    assert labels.labelled(nodes).count() == 0 and taxonomy.ancestors(spark.range(3).selectExpr("id AS tax_id"), nodes).count() == 0
