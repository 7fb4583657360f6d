"""Batches of many ids: every batch but the last is full, and ids go in order."""

from pyspark.sql import functions as F

from taxaloom.sources import services


def test_batches_of_many_ranges(spark):
    """Ranges of a sample differ from one evaluation to the next; so do those that are put together."""
    small = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.shuffle.partitions": "40"}
    before = {k: spark.conf.get(k, None) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        n = 300_000
        ids = spark.range(n).select(((F.col("id") * 7919) % n).alias("id")).select("id", F.col("id").alias("ord"))
        made = services.batches(ids, 200).select("batch", "n", F.split("request", ",").alias("ids")).select("batch", "n", F.col("ids")[0].cast("long").alias("first"), F.element_at("ids", -1).cast("long").alias("last")).collect()
        assert sorted((r.batch, r.n, r.first, r.last) for r in made) == [(b, 200, 200 * b, 200 * b + 199) for b in range(n // 200)]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
