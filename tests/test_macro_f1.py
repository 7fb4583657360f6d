"""The mean of F1s that lies halfway between two rounded values."""

from pyspark.sql import functions as F

from taxaloom.operators import sets

#: Their mean is 301/640 = 0.4703125; as doubles they add up to less in this order.
F1S = [(1, 3), (2, 3), (2, 3), (1, 3), (1, 3), (2, 3), (1, 10), (9, 10), (8, 9), (1, 9), (6, 7), (1, 7), (1, 3), (2, 3), (1, 8), (2, 5)]


def test_mean_does_not_depend_on_order(spark):
    for order in (F1S, F1S[::-1]):
        rows = spark.createDataFrame([(a / b,) for a, b in order], "f1 double").coalesce(1)
        assert rows.agg(F.round(sets.macro_f1(F.col("f1")), 6)).first()[0] == 0.470313
    assert spark.createDataFrame([], "f1 double").agg(sets.macro_f1(F.col("f1"))).first()[0] == 0.0
