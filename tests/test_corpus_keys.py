"""Scores of studies where keys of parts lie far apart, against their SQL."""

from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")
DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_scores_with_keys_far_apart(spark, tmp_path):
    """A second copy of the tables, its keys 50,000,000 higher, must not turn the first one's ids into retired ones."""
    from taxaloom.plans import registry

    keys = {"customer": ["c_custkey"], "part": ["p_partkey"], "orders": ["o_orderkey", "o_custkey"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey"]}
    con = duckdb.connect()
    for t, columns in keys.items():
        moved = ", ".join(f"{c} + i * 50000000 AS {c}" for c in columns)
        con.execute(f"copy (select * replace ({moved}) from '{DATA}/{t}.parquet', range(2) r(i)) to '{tmp_path}/{t}.parquet' (format parquet)")
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    for name in ("score_corpus", "score_studies"):
        frame = registry.QUERIES[name](spark, str(tmp_path))
        result = con.execute(registry.ORACLES[name])
        names = [d[0] for d in result.description]
        assert sorted(map(tuple, frame.select(*names).collect())) == sorted(result.fetchall()), name
