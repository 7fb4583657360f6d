"""Audit of filters that follow each other: what each removes, repeats and loses, in every order of the filters."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
ORDERS = tuple(map("".join, permutations(FILTERS)))
WHITE = "\t\n\x0b\x0c\r"
#: Join keys that rows without an id are dealt over.
SALTS = 1024


def _bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def own_failures(text: Column) -> Column:
    """The bits of filters A to D that a text, not null, fails; E needs the other texts."""
    words = F.array_remove(F.split(F.translate(text, WHITE, " " * len(WHITE)), " "), "")
    n, capitals = F.size(words), F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = {"A": n < 200, "B": 100 * F.size(F.array_distinct(words)) < 50 * n, "C": 100 * capitals.cast("long") > 3 * F.length(text).cast("long"), "D": text.rlike("[#$%&*|]")}
    return sum((F.when(failed, _bit(letter)).otherwise(0) for letter, failed in fails.items()), F.lit(0))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic, n: how many documents of a part have each set of failures and labels.

    A text is known by its SHA-256. Copies are counted by text, part and label before
    they meet, so that a group of copies of any size is a few rows.
    """
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(docs["doc_id"].cast("long").alias("id"), F.coalesce(docs["lang"].cast("string"), F.lit("")).alias("part"), text.alias("text"))
    judged = rows.select("id", "part", F.unhex(F.sha2("text", 256)).alias("same"), own_failures(F.col("text")).alias("mask"))
    once = judged.groupBy("id", "part", "same", "mask").count()
    salt = F.when(F.col("id").isNull(), F.pmod(F.xxhash64("same"), F.lit(SALTS))).otherwise(0)
    known = labels.where(labels["doc_id"].isNotNull()).groupBy(labels["doc_id"].cast("long").alias("id")).agg(
        *[F.coalesce(F.max((labels[c] == 1).cast("int")), F.lit(0)).alias(new) for c, new in (("quality", "good"), ("toxic", "toxic"))]
    )
    labelled = once.withColumn("salt", salt.cast("long")).join(known.withColumn("salt", F.lit(0).cast("long")), ["id", "salt"], "left").fillna(0, ["good", "toxic"])
    groups = labelled.groupBy("same", "part", "mask", "good", "toxic", F.col("id").isNull().alias("nameless")).agg(F.sum("count").alias("n"), F.min("id").alias("first"), F.min_by("count", "id").alias("n_first"))
    first = F.min("first").over(Window.partitionBy("same"))
    later = F.when(F.col("nameless"), 0).when(F.col("first") == first, F.col("n") - F.col("n_first")).otherwise(F.col("n"))
    split = groups.withColumn("later", later).select("part", "good", "toxic", F.explode(F.array(F.struct("mask", (F.col("n") - F.col("later")).alias("n")), F.struct((F.col("mask") + _bit("E")).alias("mask"), F.col("later").alias("n")))).alias("x"))
    return split.groupBy("part", "x.mask", "good", "toxic").agg(F.sum("x.n").alias("n")).where("n > 0")


def evaluate(cells: DataFrame) -> DataFrame:
    """The audit of cells(): a row for each part, order and step.

    Cells are laid out against the steps of every order; a running bit-or over the steps
    before says whether a cell is already gone, sums under conditions count, and a
    window over all orders of a filter adds up what it removes.
    """
    ordered = cells.withColumn("filter_order", F.explode(F.array(*map(F.lit, ORDERS))))
    steps = F.array(*map(F.lit, range(1, len(FILTERS) + 1)))
    long = ordered.withColumn("step", F.explode(steps)).withColumn("letter", F.substr("filter_order", F.col("step"), F.lit(1)))
    bit = F.element_at(F.create_map(*[F.lit(x) for f in FILTERS for x in (f, _bit(f))]), F.col("letter"))
    long = long.withColumn("bit", bit).withColumn("failed", F.col("mask").bitwiseAND(F.col("bit")))
    before = Window.partitionBy("part", "mask", "good", "toxic", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    seen = long.withColumn("gone", F.coalesce(F.bit_or("failed").over(before), F.lit(0)) != 0)
    fails, gone = F.col("failed") != 0, F.col("gone")
    count = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0)).cast("long")
    counted = seen.groupBy("part", "filter_order", "step", "letter").agg(
        count(~fails & ~gone).alias("kept"),
        count(fails & ~gone).alias("removed"),
        count(fails & gone).alias("redundant"),
        count(F.col("mask") == F.col("bit")).alias("unique_fails"),
        count(fails & ~gone & (F.col("good") == 1)).alias("good_lost"),
        count(fails & ~gone & (F.col("toxic") == 1)).alias("toxic_lost"),
    )
    return counted.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter"))).drop("letter")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Five filters, failed by: A under 200 words; B fewer than half of the words distinct;
    C over 3 % capitals; D any of #$%&*|; E a text that a smaller doc_id also has.
    Every order of the five is a row for each step and each value of lang.

    A null text is an empty one, a null lang the empty string. A row without an id
    cannot be later than another: it never fails E, makes no other fail it and has no
    label. Repeated rows count as often as they occur and do not fail E for each other.
    Of repeated labels one that is 1 suffices; null labels are none. Empty documents
    give no rows. Other columns of either table are not read.
    """
    return evaluate(cells(docs, labels))
