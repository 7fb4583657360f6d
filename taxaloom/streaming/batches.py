"""Work on studies that may be stopped and started again: each study comes to one end, whatever happens in between."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

TASK = "study_id string, attempt int"
#: Times a study is tried in all.
ATTEMPTS = 3


def submit(studies: DataFrame, inbox: str, name: str) -> None:
    """Puts studies (study_id) into the inbox under a name of their own; the same name again replaces what no run has read yet."""
    studies.select(F.col("study_id").cast("string"), F.lit(0).alias("attempt")).write.mode("overwrite").json(f"{inbox}/new-{name}")


def start(spark: SparkSession, inbox: str, outbox: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], attempts: int = ATTEMPTS, files: int = 100, every: str | None = None) -> StreamingQuery:
    """Works through the inbox as a stream; without `every` (an interval) the query ends when it has gone through what is there.

    work maps rows of study_id, attempt to study_id, result, error (null where it went
    well); a study that it says nothing about has failed. A micro-batch writes its
    outcomes under its own number, and studies to be tried again as another submission
    under that number, both in place of what an earlier run of the same micro-batch may
    have left. A run that dies is started again with the same checkpoint: the micro-batch
    it was in is worked through anew, with the same studies, and nothing else is. A
    study submitted twice is worked on once.
    """
    tasks = spark.readStream.schema(TASK).option("maxFilesPerTrigger", files).json(f"{inbox}/*").where("study_id is not null").dropDuplicates(["study_id", "attempt"])

    def process(batch: DataFrame, number: int) -> None:
        said = work(batch).groupBy("study_id").agg(F.min(F.struct(F.col("error").isNotNull(), "result", "error")).alias("x")).select(F.col("study_id").alias("__id"), "x.result", F.col("x.error").alias("error"), F.lit(True).alias("__said"))
        joined = batch.join(said, F.col("study_id") == F.col("__id"), "left")
        error = F.when(F.col("__said").isNull(), "no answer").otherwise(F.col("error"))
        out = joined.select("study_id", "attempt", F.when(error.isNull(), F.col("result")).alias("result"), error.alias("error"))
        out = out.withColumn("done", F.col("error").isNull() | (F.col("attempt") + 1 >= attempts))
        path = f"{outbox}/batch={number}"
        out.write.mode("overwrite").parquet(path)
        written = batch.sparkSession.read.schema(out.schema).parquet(path)
        written.where("not done").select("study_id", (F.col("attempt") + 1).alias("attempt")).write.mode("overwrite").json(f"{inbox}/again-{number}")

    query = tasks.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    return (query.trigger(processingTime=every) if every else query.trigger(availableNow=True)).start()


def drain(spark: SparkSession, inbox: str, outbox: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], attempts: int = ATTEMPTS, files: int = 100) -> None:
    """Works through the inbox until no study is left to be tried again: each pass ends one attempt of all."""
    for _ in range(attempts):
        start(spark, inbox, outbox, checkpoint, work, attempts, files).awaitTermination()


def outcomes(spark: SparkSession, outbox: str) -> DataFrame:
    """study_id, attempts, result, error: one row for each study that has come to its end."""
    return spark.read.schema("study_id string, attempt int, result string, error string, done boolean").parquet(outbox).where("done").select("study_id", (F.col("attempt") + 1).alias("attempts"), "result", "error")
