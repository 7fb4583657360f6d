import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark import cloudpickle
    from pyspark.sql import SparkSession

    import taxaloom

    cloudpickle.register_pickle_by_value(taxaloom)
    session = (
        SparkSession.builder.master("local[4]").appName("llm-tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    if session.conf.get("spark.checkpoint.dir", None) is None:
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    return session


DOCS = "doc_id long, text string, bucket string, block int"


@pytest.fixture
def make_docs(spark):
    """(id, text) pairs as a table with two more columns whose names operators use inside."""
    return lambda rows: spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS)
