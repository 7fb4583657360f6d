"""What working tables leave on disk."""

import time
from pathlib import Path

from pyspark.sql import functions as F

from taxaloom import working


def test_a_stored_table_leaves_no_shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: {f for d in disk.localDirs() for f in Path(d.getPath()).rglob("shuffle_*.data")}
    before, until = held(), time.time() + 20
    out = working.stored(spark.range(1000).repartition(5).groupBy((F.col("id") % 10).alias("k")).count())
    while not held() <= before and time.time() < until:
        time.sleep(0.1)
    assert held() <= before and out.count() == 10
    assert spark.conf.get(working._CLEANUP) == "false"


def test_steps_are_removed_and_their_result_stays(spark):
    with working.steps(spark) as step:
        first = step(spark.range(3))
        (path,) = {f.rsplit("/", 1)[0] for f in first.inputFiles()}
        kept = working.stored(first.select(F.col("id") + 1))
    assert not Path(path.removeprefix("file:").replace("//", "/")).exists() and kept.count() == 3
