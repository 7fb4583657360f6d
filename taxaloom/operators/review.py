"""Second opinions on extracted names: grounding, direction repair, a reviewer's panel, and reconciliation with a taxonomy.

All tables are keyed by the columns `by` (a study and an experiment), with the text of
the artifact that was read in `artifact_text`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import coerce as C
from ..functions import text as T
from . import prompts, taxonomy
from .curated import arbitration

#: Calls that a direction in doubt may take.
ROUNDS = 3
DIRECTIONS = ("increased", "decreased")


def answered(answer: Column, field: str, kind: str) -> Column:
    """The items of a list in a model's answer, however it is wrapped; items that are not of the kind are left out."""
    raw = F.coalesce(T.loose_json(answer, f"{field} array<string>")[field], F.array().cast("array<string>"))
    items = raw if kind == "string" else F.transform(raw, lambda x: F.from_json(x, kind))
    return F.filter(items, lambda x: x.isNotNull())


def names_in(answer: Column) -> Column:
    """Names with a direction: blank names and other directions are left out."""
    given = F.transform(answered(answer, "taxa", "taxon_name string, direction string, ncbi_id bigint"), lambda t: F.struct(C.strip(t["taxon_name"]).alias("taxon_name"), F.lower(C.strip(t["direction"])).alias("direction"), t["ncbi_id"].alias("ncbi_id")))
    return F.filter(given, lambda t: (t["taxon_name"] != "") & t["direction"].isin(*DIRECTIONS))


def grounded_names(names: DataFrame, by: list[str], ask: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """by, name_norm of names (taxon_name, artifact_text) that a check of the source confirms. One call for each artifact."""
    asked = names.groupBy(*by).agg(F.any_value("artifact_text").alias("artifact_text"), F.array_sort(F.collect_set("taxon_name")).alias("names"))
    said = ask(asked.select(*by, "names", prompts.ground(F.col("names"), F.col("artifact_text")).alias("prompt")), "ground")
    low = lambda names: F.transform(names, lambda x: F.lower(C.strip(x)))
    confirmed = F.filter("names", lambda x: F.array_contains(low(answered(F.col("answer"), "grounded", "string")), F.lower(C.strip(x))))
    return said.select(*by, F.explode(confirmed).alias("taxon_name")).select(*by, T.taxon_key(F.col("taxon_name")).alias("name_norm")).distinct()


def repaired(rows: DataFrame, ask: Callable[[DataFrame, str], DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """The rows (taxon_name, direction, artifact_text) with `settled` and `changed`.

    The first round may confirm the claim; after that the value that two rounds running
    give is taken, rounds without an answer aside. Where none is, settled is null.
    """
    out = rows.withColumns({"settled": F.lit(None).cast("string"), "last": F.lit(None).cast("string")})
    for k in range(1, rounds + 1):
        prompt = F.when(F.col("settled").isNull(), prompts.rederive(F.col("taxon_name"), F.col("artifact_text"), k))
        said = ask(out.withColumn("prompt", prompt), "repair")
        derived = F.lower(C.strip(T.loose_json(F.col("answer"), "direction string")["direction"]))
        derived = F.when(derived.isin(*DIRECTIONS), derived)
        said = said.withColumn("derived", derived)
        agreed = F.col("derived") == (F.col("direction") if k == 1 else F.col("last"))
        out = said.withColumn("settled", F.coalesce("settled", F.when(agreed, F.col("derived")))).withColumn("last", F.coalesce("derived", "last")).drop("prompt", "answer", "failure", "derived")
    return out.drop("last").withColumn("changed", ~F.col("settled").eqNullSafe(F.col("direction")))


def checked(names: DataFrame, by: list[str], ask: Callable[[DataFrame, str], DataFrame], rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Names (taxon_name, direction, ncbi_id, ord, artifact_text) that a check of the source confirms, with the direction that is derived anew; and flags (by, flag) on what was dropped.

    A name is confirmed whatever the case of the answer's letters. A direction that does
    not settle takes its name with it.
    """
    columns = [*by, "taxon_name", "direction", "ncbi_id", "ord", "artifact_text"]
    key = [*by, "name_norm"]
    keyed = names.select(*columns).withColumn("name_norm", T.taxon_key(F.col("taxon_name")))
    confirmed = grounded_names(names.select(*columns), by, ask)
    settled = repaired(keyed.join(confirmed, key, "left_semi").select(*columns), ask, rounds)
    kept = settled.where("settled is not null").withColumn("direction", F.col("settled")).select(*columns)
    lost = settled.where("settled is null").select(*by, F.concat(F.lit("direction not settled: "), "taxon_name").alias("flag"))
    return kept, lost.unionByName(keyed.join(confirmed, key, "left_anti").select(*by, F.concat(F.lit("not confirmed: "), "taxon_name").alias("flag")))


def panel(extracted: DataFrame, reviewed: DataFrame, by: list[str], ask: Callable[[DataFrame, str], DataFrame], rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Names after a reviewer's pass, and flags (by, flag) on what was dropped.

    extracted and reviewed: taxon_name, direction, ncbi_id, ord, artifact_text. A name
    that only one side has stays if the source confirms it, an extracted one with its
    id; a direction that the reviewer has nowhere for a name is repaired, or the name is
    dropped.
    """
    key = [*by, "name_norm"]
    e, r = (rows.withColumn("name_norm", T.taxon_key(F.col("taxon_name"))) for rows in (extracted, reviewed))
    of = r.groupBy(*key).agg(F.collect_set("direction").alias("theirs"))
    sided = e.join(of, key, "left")
    both = sided.where("theirs is not null")
    settled = repaired(both.where(~F.array_contains("theirs", F.col("direction"))), ask, rounds)
    alone = sided.where("theirs is null").drop("theirs")
    added = r.join(e.select(*key).distinct(), key, "left_anti").withColumn("ncbi_id", F.lit(None).cast("bigint"))
    columns = [*by, "taxon_name", "direction", "ncbi_id", "ord", "artifact_text"]
    confirmed = grounded_names(alone.select(*columns).unionByName(added.select(*columns)), by, ask)
    kept = both.where(F.array_contains("theirs", F.col("direction"))).select(*columns)
    kept = kept.unionByName(settled.where("settled is not null").withColumn("direction", F.col("settled")).select(*columns))
    for rows in (alone, added):
        kept = kept.unionByName(rows.join(confirmed, key, "left_semi").select(*columns))
    lost = settled.where("settled is null").select(*by, F.concat(F.lit("direction not settled: "), "taxon_name").alias("flag"))
    lost = lost.unionByName(alone.join(confirmed, key, "left_anti").select(*by, F.concat(F.lit("not confirmed: "), "taxon_name").alias("flag")))
    return kept, lost


def verdicts(extracted: DataFrame, reviewed: DataFrame, by: list[str]) -> DataFrame:
    """What the panel does about each name of either side, one direction each."""
    one = lambda rows: rows.withColumn("name_norm", T.taxon_key(F.col("taxon_name"))).groupBy(*by, "name_norm").agg(F.max("direction").alias("direction"))
    return arbitration(one(extracted), one(reviewed), by)


def reconciled(names: DataFrame, taxa: DataFrame, merged: DataFrame, ask: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The rows (taxon_name) with ncbi_id and `disambiguated`: the one taxon of the name, the model's choice among several of them, or null.

    taxa: a taxonomy store's names. A choice that is none of the candidates does not count.
    """
    of = taxa.groupBy("name_norm").agg(F.array_sort(F.collect_set("tax_id")).alias("candidates"))
    keyed = names.drop("ncbi_id").withColumn("name_norm", T.taxon_key(F.col("taxon_name"))).join(of, "name_norm", "left")
    prompt = F.when(F.size("candidates") > 1, prompts.disambiguate(F.col("taxon_name"), F.col("candidates"), F.col("artifact_text")))
    said = ask(keyed.withColumn("prompt", prompt), "reconcile")
    choice = taxonomy.chosen(F.col("candidates"), T.loose_json(F.col("answer"), "ncbi_id bigint")["ncbi_id"])
    picked = said.withColumn("tax_id", F.when(F.size("candidates") == 1, F.col("candidates")[0]).when(F.size("candidates") > 1, choice)).withColumn("disambiguated", (F.size("candidates") > 1) & F.col("tax_id").isNotNull())
    out = taxonomy.canonical(picked.drop("prompt", "answer", "failure", "candidates", "name_norm"), merged)
    return out.withColumnRenamed("tax_id", "ncbi_id").withColumn("disambiguated", F.coalesce("disambiguated", F.lit(False)))
