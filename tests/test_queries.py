"""Every registered query of the library against its SQL, on the smallest tables; and what may import what."""

import ast
import math
from decimal import Decimal
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")
ROOT = Path(__file__).resolve().parents[1]
DATA = Path("/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, Decimal):
        return float(v)
    return "nan" if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_queries_equal_their_sql(spark):
    from taxaloom.plans import registry

    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    for name, run in registry.QUERIES.items():
        frame = run(spark, str(DATA))
        columns = sorted(frame.columns)
        got = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=str)
        if name in registry.ORACLES:
            result = con.execute(registry.ORACLES[name])
            names = [d[0] for d in result.description]
            assert sorted(names) == columns, name
            assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=str), name


def imports(path):
    for node in ast.walk(ast.parse(path.read_text())):
        if isinstance(node, ast.Import):
            yield from (a.name for a in node.names)
        elif isinstance(node, ast.ImportFrom):
            yield "." * node.level + (node.module or "")
            yield from (f"{'.' * node.level}{node.module or ''}.{a.name}" for a in node.names)


def test_nothing_imports_the_optional_subpackage():
    for path in (ROOT / "taxaloom").rglob("*.py"):
        if "llm" not in path.parts:
            assert not any("llm" in i for i in imports(path)), path


def test_extraction_does_not_read_curated_data():
    found = set(imports(ROOT / "taxaloom/operators/curation.py"))
    assert not any(w in i for i in found for w in ("scoring", "sets", "alignment")) and ".curated.curated_tree" not in found


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_signature_alignment_has_every_order(spark):
    from taxaloom.plans import registry

    rows = registry.QUERIES["signature_alignment"](spark, str(DATA)).collect()
    keys = {r[0] for r in spark.read.parquet(f"{DATA}/orders.parquet").select("o_orderkey").collect()}
    assert sorted(k for r in rows for k in (r.p, r.g) if k is not None) == sorted(keys)
