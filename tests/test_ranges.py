"""The dump in byte ranges equals the dump in one task."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from taxaloom.sources import dump


def one_task(spark, path):
    """The rows as a single reader of each file sees them."""
    return spark.read.schema(dump.schema()).options(multiLine=True, quote='"', escape='"', encoding="UTF-8").csv(path)


def cells(r):
    return tuple(r[c] for c in dump.COLUMNS)


@pytest.fixture(params=["\n", "\r\n"])
def files(tmp_path, request):
    r = random.Random(4)
    odd = ["", "a", 'say "yes"', "two\nlines", '"\n"', "# no banner", 'a,b\n\n\n"c",', "x" * 300, "line\r\nend", "é\n日本", '""', "\n" * 9]
    want = []
    for name, banner in (("a.csv", '# a "banner, with a quote\n'), ("b.csv", ""), ("c.csv", "﻿# other\n")):
        with open(tmp_path / name, "w", newline="", encoding="utf-8") as f:
            f.write(banner)
            w = csv.writer(f, lineterminator=request.param)
            w.writerow(dump.COLUMNS)
            for k in range(6):
                row = [f"{name}/{k}", f"S{k}"] + [r.choice(odd) if r.random() < 0.3 else "NA" for _ in dump.COLUMNS[2:]]
                want.append(tuple(c or None for c in row))
                w.writerow(row)
    return tmp_path, want


@pytest.mark.parametrize("size", [150, 2_000, 50_000])
def test_ranges_of_any_size_give_the_same_rows(spark, files, size):
    folder, want = files
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = dump.read_dump(spark, str(folder)).orderBy(dump.ORDER).collect()
        n_tasks = dump.read_lines(spark, str(folder)).rdd.getNumPartitions()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert [cells(r) for r in got] == want
    assert len({r[dump.ORDER] for r in got}) == len(got)
    assert n_tasks > 1 or size > 2_000


def test_one_reader_sees_the_same(spark, tmp_path):
    with open(tmp_path / "d.csv", "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(dump.COLUMNS)
        w.writerows([[f"{k}", "S", *(["a\n b, \"c\""] if k % 2 else ["NA"]) * (len(dump.COLUMNS) - 2)] for k in range(30)])
    alone = one_task(spark, str(tmp_path)).where(F.col(dump.COLUMNS[0]) != dump.COLUMNS[0])
    assert sorted(map(cells, dump.read_dump(spark, str(tmp_path)).collect()), key=str) == sorted(map(cells, alone.collect()), key=str)


def test_an_open_quote_at_the_end_and_an_empty_file(spark, tmp_path):
    (tmp_path / "e.csv").write_text("")
    assert dump.read_dump(spark, str(tmp_path / "e.csv")).count() == 0
    (tmp_path / "f.csv").write_text('b/1,S1\nb/2,"S2\nand on')
    assert [(r["BSDB ID"], r["Study"]) for r in dump.read_dump(spark, str(tmp_path / "f.csv")).orderBy(dump.ORDER).collect()][0] == ("b/1", "S1")
