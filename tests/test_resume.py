import json

import pytest
from pyspark.errors.exceptions.captured import StreamingQueryException
from pyspark.sql import functions as F

from taxaloom.operators import taxonomy
from taxaloom.sources import cache, figures
from taxaloom.streaming import batches


def work(rows):
    """Studies fail as often as their number says."""
    fails = F.col("study_id").cast("int") % 4
    return rows.where("study_id <> '16'").select("study_id", F.concat(F.lit("r"), "study_id").alias("result"), F.when(F.col("attempt") < fails, F.lit("busy")).alias("error"))


def test_each_study_ends_once_although_runs_die(spark, tmp_path, monkeypatch):
    inbox, outbox, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    ids = spark.range(1, 17).select(F.col("id").cast("string").alias("study_id"))
    batches.submit(ids.repartition(3), inbox, "a")
    batches.submit(ids.where("study_id in ('3', '4')"), inbox, "b")  # asked for twice
    deaths = {"n": 0}

    def dying(rows):
        """Dies in the middle of several micro-batches: before, and after some of their rows are written."""
        deaths["n"] += 1
        if deaths["n"] in (2, 4):
            raise RuntimeError("the machine is gone")
        out = work(rows)
        if deaths["n"] in (3, 5):
            rows.sparkSession.range(1).write.mode("overwrite").parquet(f"{outbox}/batch={deaths['n']}")  # a half-written folder of a later one
        return out

    died = 0
    for _ in range(12):
        try:
            batches.drain(spark, inbox, outbox, checkpoint, dying, files=1)
            break
        except StreamingQueryException:
            died += 1
    assert died == 2
    batches.drain(spark, inbox, outbox, checkpoint, work, files=1)
    got = {}
    for r in batches.outcomes(spark, outbox).collect():
        assert r.study_id not in got
        got[r.study_id] = (r.attempts, r.result, r.error)
    want = {str(k): (k % 4 + 1, f"r{k}", None) if k % 4 < 3 else (3, None, "busy") for k in range(1, 17)}
    want["16"] = (3, None, "no answer")
    assert got == want
    batches.submit(ids.where("study_id = '8'"), inbox, "c")
    batches.drain(spark, inbox, outbox, checkpoint, work)
    assert batches.outcomes(spark, outbox).count() == 16


def test_caches_of_two_runs_are_as_of_one(spark, tmp_path, monkeypatch):
    answers = lambda rows: spark.createDataFrame(rows, "name_norm string, tax_id bigint, at int")
    one, two = [("a", 1, 0), ("b", None, 0), ("c", 3, 0), ("c", 4, 1)], [("b", 2, 0), ("d", None, 0), ("a", None, 0), ("a", 9, 0)]
    split, whole = str(tmp_path / "split"), str(tmp_path / "whole")
    assert cache.read(spark, split).count() == 0
    assert cache.add(spark, split, answers(one), "r-1", "at") and cache.add(spark, split, answers(two), "r-2", "at")
    assert not cache.add(spark, split, answers([("a", 77, 5)]), "r-1", "at")
    cache.add(spark, whole, answers(one + [(n, t, at + 10) for n, t, at in two]), "r", "at")
    want = {"a": 9, "b": 2, "c": 4, "d": None}
    for folder in (split, whole):
        assert {r.name_norm: r.tax_id for r in cache.read(spark, folder).collect()} == want
    cache.compact(spark, split)
    assert {r.name_norm: r.tax_id for r in cache.read(spark, split).collect()} == want
    assert not cache.add(spark, split, answers(one), "r-2", "at") and cache.add(spark, split, answers([("d", 5, 0)]), "r-3")
    assert {r.name_norm: r.tax_id for r in cache.read(spark, split).collect()} == want | {"d": 5}
    monkeypatch.setattr(cache.files, "create_empty", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        cache.add(spark, split, answers([("a", 0, 0)]), "r-4")
    monkeypatch.undo()
    assert {r.name_norm: r.tax_id for r in cache.read(spark, split).collect()} == want | {"d": 5}
    asked = spark.createDataFrame([("d",), ("b",), ("new",)], "name_norm string")
    found = taxonomy.with_cache(asked, cache.read(spark, whole), spark.createDataFrame([("new", 8), ("d", 6)], "name_norm string, tax_id bigint"))
    assert {r.name_norm: r.tax_id for r in found.collect()} == {"d": None, "b": 2, "new": 8}
    cache.export(spark, whole, str(tmp_path / "json"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "json")).collect()]
    assert {x["name_norm"]: x["tax_id"] for x in lines} == want


def test_bytes_of_images_are_read_when_asked_for(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x/fig1.v2.JPG").write_bytes(b"\xff\xd8one")
    (tmp_path / "x/fig2.png").write_bytes(b"two" * 60)
    (tmp_path / "fig2.png").write_bytes(b"first")
    (tmp_path / "notes.txt").write_text("x")
    images = figures.read_images(spark, str(tmp_path))
    rows = spark.createDataFrame([(1, "fig1.v2"), (2, "fig2.png"), (3, "fig3"), (4, None)], "id int, graphic_filename string")
    full = figures.with_images(rows, images)
    got = {r.id: (r.mime, bytes(r.content) if r.content is not None else None, r.url) for r in full.select("id", "mime", "content", figures.data_url(F.col("content"), F.col("mime")).alias("url")).collect()}
    assert got[1] == ("image/jpeg", b"\xff\xd8one", "data:image/jpeg;base64,/9hvbmU=") and got[2][1] == b"first" and got[3] == got[4] == (None, None, None)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "content" in plan(full) and "content" not in plan(full.select("id", "path")) and "content" not in plan(figures.image_paths(rows, images))
