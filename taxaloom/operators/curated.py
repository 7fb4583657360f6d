"""The curated tree: studies with experiments, signatures and their sets of taxa."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import coerce as C
from ..functions import text as T


def signature_taxa(links: DataFrame) -> DataFrame:
    """Each signature's taxa as an ascending set; ids that are no numbers are left out."""
    return links.select("signature_id", C.to_int(F.col("ncbi_id")).alias("t")).where("t is not null").groupBy("signature_id").agg(F.array_sort(F.collect_set("t")).alias("taxa"))


def curated_tree(tables: dict[str, DataFrame], id_map: DataFrame | None = None) -> DataFrame:
    """study_id, pmid, has_pmc and experiments[signatures[taxa]]; parents without children stay.

    has_pmc is true or false where the map knows the study, else null; of several rows
    of the map the largest holds. Without a map all are null. Children join by id
    columns, never by a part of another id.
    """
    empty = F.array().cast("array<bigint>")
    s = tables["signatures"].join(signature_taxa(tables["signatures_taxa"]), "signature_id", "left")
    signature = F.struct(
        "signature_id",
        C.clean(F.col("signature_name")).alias("signature_name"),
        C.clean(F.col("source")).alias("source"),
        T.source_type(F.col("source")).alias("source_type"),
        F.when(C.clean(F.col("abundance_in_group_1")).isin("increased", "decreased"), C.clean(F.col("abundance_in_group_1"))).alias("direction"),
        C.clean(F.col("curation_state")).alias("curation_state"),
        F.coalesce("taxa", empty).alias("taxa"),
    )
    per_experiment = s.groupBy("experiment_id").agg(F.array_sort(F.collect_list(signature)).alias("signatures"))
    e = tables["experiments"].join(per_experiment, "experiment_id", "left")
    experiment = F.struct(
        "experiment_id",
        C.clean(F.col("experiment_name")).alias("experiment_name"),
        *[T.split_strict(F.col(c)).alias(c) for c in ("body_site", "condition", "statistical_test")],
        *[C.clean(F.col(c)).alias(c) for c in ("group_0_name", "group_1_name", "sequencing_type")],
        C.to_bool(F.col("mht_correction")).alias("mht_correction"),
        F.coalesce("signatures", F.array().cast(per_experiment.schema["signatures"].dataType)).alias("signatures"),
    )
    per_study = e.withColumn("__e", experiment).groupBy("study_id").agg(F.array_sort(F.collect_list("__e")).alias("experiments"))
    studies = tables["studies"].select("study_id", C.clean(F.col("pmid")).alias("pmid")).join(per_study, "study_id", "left")
    if id_map is None:
        studies = studies.withColumn("has_pmc", F.lit(None).cast("boolean"))
    else:
        known = id_map.groupBy("study_id").agg(F.max_by(C.to_bool(F.col("has_pmc").cast("string")), F.struct("pmcid")).alias("has_pmc"))
        studies = studies.join(known, "study_id", "left")
    return studies.select("study_id", "pmid", "has_pmc", F.coalesce("experiments", F.array().cast(per_study.schema["experiments"].dataType)).alias("experiments"))


def selected(tree: DataFrame, wanted: DataFrame) -> DataFrame:
    return tree.join(wanted.select("study_id").distinct(), "study_id", "left_semi")


def missing(tree: DataFrame, predictions: DataFrame) -> DataFrame:
    return tree.join(predictions, "study_id", "left_anti").select("study_id")


def mapped_studies(studies: DataFrame, records: DataFrame) -> DataFrame:
    """Studies with the last record of their pmid; repeated studies stay."""
    last = records.groupBy("pmid").agg(F.max_by(F.struct("pmcid", "doi"), F.col("ord")).alias("r"))
    return studies.join(last, "pmid").select("study_id", "pmid", "r.pmcid", "r.doi", F.col("r.pmcid").isNotNull().alias("has_pmc"))


def coverage(mapped: DataFrame) -> DataFrame:
    n, with_pmc = F.count("*"), F.count_if("has_pmc")
    return mapped.agg(n.alias("total"), with_pmc.alias("with_pmc"), (n - with_pmc).alias("without_pmc"), F.when(n == 0, 0.0).otherwise(with_pmc * 100.0 / n).alias("pct"))


def distinct_ids(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Each value of a column once, with the place where it is first seen; nulls are none."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias(order))


def dedup_taxa(rows: DataFrame, by: list[str]) -> DataFrame:
    """One taxon per direction and compared name: the first that has an id, else the first, at the first's place (ord)."""
    key = F.lower(T.one_line(F.col("taxon_name")))
    picked = rows.withColumn("__k", key).groupBy(*by, "direction", "__k").agg(F.min_by(F.struct("taxon_name", "ncbi_id"), F.struct(F.col("ncbi_id").isNull(), "ord")).alias("t"), F.min("ord").alias("ord"))
    return picked.select(*by, "direction", "t.*", "ord")


def signatures_by_direction(rows: DataFrame, by: list[str]) -> DataFrame:
    """At most two signatures: increased, then decreased; rows without a direction are left out."""
    taxa = F.array_sort(F.collect_list(F.struct("ord", "taxon_name", "ncbi_id")))
    made = rows.where(F.col("direction").isin("increased", "decreased")).groupBy(*by, "direction").agg(taxa.alias("taxa"))
    return made.withColumn("place", F.when(F.col("direction") == "increased", 0).otherwise(1))


def arbitration(extracted: DataFrame, reviewed: DataFrame, by: list[str]) -> DataFrame:
    """Names of an extractor and a reviewer side by side, with what to do about each."""
    key = [*by, "name_norm"]
    both = extracted.withColumnRenamed("direction", "d1").join(reviewed.withColumnRenamed("direction", "d2"), key, "full_outer")
    verdict = F.when(F.col("d2").isNull(), "check-extracted").when(F.col("d1").isNull(), "resolve-reviewed").when(F.col("d1") == F.col("d2"), "keep").otherwise("repair")
    return both.select(*key, "d1", "d2", verdict.alias("verdict"))


def agreed_value(rounds: DataFrame, by: list[str]) -> DataFrame:
    """The first value that equals the last one parsed before it; unparsed rounds (null) change nothing. `round`, `value` in."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy("round")
    before = F.last("value", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    agreed = rounds.withColumn("__b", before).where(F.col("value") == F.col("__b"))
    return agreed.groupBy(*by).agg(F.min("round").alias("round"), F.min_by("value", "round").alias("value"))


#: Words of an item by which it is looked up: all but its first and last are whole words of any text that holds it.
LOOKUP = 3
#: Characters of a word by which shorter items are looked up among the words of all texts.
GRAM = 3


def _grams(word: Column) -> Column:
    """The distinct pieces of a word of one to GRAM characters."""
    at = lambda n: F.when(F.length(word) >= n, F.transform(F.sequence(F.lit(1), F.length(word) - n + 1), lambda i: F.substr(word, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*map(at, range(1, GRAM + 1))))


def grounded(texts: DataFrame, items: DataFrame) -> DataFrame:
    """Each row of texts (text) beside each row of items (item; not empty) that the text holds as it stands; rows that repeat meet as often as they come.

    Texts and items meet by keys, and only what may hold is searched. Words between
    single spaces inside an item are words of the text too: items of five words or more
    meet texts by their second to fourth. Shorter items meet the distinct words of all
    texts by the first characters of their longest word, and texts by the words that
    hold it. An item of spaces alone is held against every text; there are as few of
    these as lengths. Texts are known by their SHA-256 until they are searched.
    """
    whole = texts.where("text is not null").select(F.sha2("text", 256).alias("__text"), "text").dropDuplicates(["__text"])
    asked = items.where("item <> ''").select("item").distinct().withColumn("w", F.split("item", " "))
    words = F.split("text", " ")
    inner = asked.where(F.size("w") > LOOKUP + 1).select("item", F.array_join(F.slice("w", 2, LOOKUP), " ").alias("key"))
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - LOOKUP + 1), lambda i: F.array_join(F.slice(w, i, LOOKUP), " "))
    of_run = whole.where(F.size(words) >= LOOKUP).select("__text", F.explode(F.array_distinct(C.let(words, runs))).alias("key"))
    longest = F.array_max(F.transform("w", lambda x: F.struct(F.length(x).alias("n"), x.alias("part"))))["part"]
    short = asked.where(F.size("w") <= LOOKUP + 1).select("item", longest.alias("part"))
    parts = short.where("part <> ''").withColumn("gram", F.left("part", F.lit(GRAM)))
    of_word = whole.select("__text", F.explode(F.array_distinct(words)).alias("word"))
    lengths = [r[0] for r in parts.select(F.length("gram")).distinct().collect()]  # at most GRAM
    known = of_word.select("word").distinct().select("word", F.explode(F.filter(_grams(F.col("word")), lambda g: F.length(g).isin(*lengths))).alias("gram"))
    held = known.join(parts, "gram").where(F.contains("word", "part")).select("word", "item")
    maybe = of_run.join(inner, "key").select("__text", "item")
    if lengths:
        maybe = maybe.unionByName(of_word.join(held, "word").select("__text", "item"))
    blank = short.where("part = ''").select("item")
    found = whole.join(maybe.distinct(), "__text").where(F.contains("text", "item")).select("__text", "item")
    if not blank.isEmpty():
        found = found.unionByName(whole.join(F.broadcast(blank), F.contains("text", "item")).select("__text", "item"))  # a few lengths
    by_item = found.withColumnRenamed("item", "__item").join(items, F.col("__item") == F.col("item")).drop("__item")
    return texts.withColumn("__key", F.sha2("text", 256)).join(by_item, F.col("__key") == F.col("__text")).select(*texts.columns, *items.columns)


def ungrounded(items: DataFrame, found: DataFrame, key: str) -> DataFrame:
    return items.join(found, key, "left_anti")
