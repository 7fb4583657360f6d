import random

import pytest
from pyspark.sql import functions as F

from taxaloom.streaming import schedule


@pytest.mark.parametrize("stretch", [1, 50, 1 << 40])
def test_releases_equal_a_loop(spark, stretch):
    r = random.Random(3)
    rows = [(k, r.choice(["a", "a", "a", "b", None]), r.randrange(2_000), r.choice([0, 1, 7, 300])) for k in range(400)]
    rows = [(k, by, at, at if k % 5 else None, gap) for k, by, at, gap in rows]
    want, last = {}, {}
    for k, by, at, own, gap in sorted(rows, key=lambda x: (str(x[1]), x[2], x[0])):
        if by not in last and own is None:
            own = at
        last[by] = max([x for x in (own, last[by] + gap if by in last else None) if x is not None])
        want[k] = last[by]
    firsts = {min((x for x in rows if x[1] == by), key=lambda x: (x[2], x[0]))[0] for by in ("a", "b", None)}
    table = spark.createDataFrame([(k, by, at, at if k in firsts else own, gap) for k, by, at, own, gap in rows], "id long, caller string, t long, at long, gap long")
    got = schedule.released(table, "caller", ["t", "id"], stretch=stretch).collect()
    assert {x.id: x.release for x in got} == want


def test_waits_and_outcomes(spark):
    calls = [
        ("a", 0, [(429, 2.0), (503, 9.0), (200, None)]),  # asked for 2 s, then 1 s of its own; a 503 asks for nothing
        ("b", 0, [(429, 900.0), (200, None)]),  # at most 30 s
        ("c", 0, [(500, None), (502, None), (504, None), (200, None)]),  # three calls in all
        ("d", 0, [(404, None), (200, None)]),
        ("e", 0, [(200, None)]),
    ]
    table = spark.createDataFrame(calls, "id string, t long, answers array<struct<status:int,retry_after:double>>").select("id", F.col("id").alias("who"), F.timestamp_seconds("t").alias("at"), "answers")
    got = {}
    for r in schedule.retried(table, "who", "at", "id").select("id", "attempt", "status", "outcome", F.unix_millis("release").alias("ms")).orderBy("id", "attempt").collect():
        got.setdefault(r.id, []).append((r.ms, r.status, r.outcome))
    assert got == {
        "a": [(0, 429, None), (2000, 503, None), (3000, 200, "answered")],
        "b": [(0, 429, None), (30000, 200, "answered")],
        "c": [(0, 500, None), (500, 502, None), (1500, 504, "given up")],
        "d": [(0, 404, "refused")],
        "e": [(0, 200, "answered")],
    }


def test_one_caller_in_line(spark):
    table = spark.createDataFrame([(1, 0, [(503, None), (200, None)]), (2, 0, [(200, None)]), (3, 9, [(200, None)])], "id long, t long, answers array<struct<status:int,retry_after:double>>").select("id", F.lit("x").alias("who"), F.timestamp_seconds("t").alias("at"), "answers")
    got = [(r.id, r.ms) for r in schedule.retried(table, "who", "at", "id").select("id", F.unix_millis("release").alias("ms")).orderBy("ms").collect()]
    assert got == [(1, 0), (1, 500), (2, 850), (3, 9000)]
    assert schedule.limited(table.limit(0).drop("answers"), "who", "at", "id").count() == 0
