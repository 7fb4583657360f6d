"""Predicted records as they were written: checked value by value, one faulty record at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A predicted study: study_id and experiments of this type.
PREDICTED = (
    "array<struct<body_site:array<string>,condition:array<string>,group_0_name:string,group_1_name:string,sequencing_type:string,statistical_test:array<string>,mht_correction:boolean,"
    "signatures:array<struct<abundance_in_group_1:string,taxa:array<struct<taxon_name:string,ncbi_id:string>>>>>>"
)
SCALARS = ("string", "bigint", "decimal", "double", "boolean")
LISTS = ("body_site", "condition", "statistical_test")


def kind(value: Column) -> Column:
    """What a VARIANT is: object, array, string, bigint, decimal, double, boolean; null where it is missing or null."""
    return F.nullif(F.lower(F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)), F.lit("void"))


def _at(value: Column, key: str, kind_of: str = "variant") -> Column:
    return F.try_variant_get(value, f"$.{key}", kind_of)


def _fault(value: Column, path: Column, *kinds: str) -> Column:
    found = kind(value)
    return F.when(~found.isin(*kinds), F.concat(path, F.lit(": "), found, F.lit(f" where {' or '.join(kinds)} is expected")))


def _step(path: Column | None, key: str | Column) -> Column:
    return F.concat(*([path] if path is not None else []), F.lit("/"), F.lit(key) if isinstance(key, str) else key.cast("string"))


def _each(value: Column, key: str, path: Column | None, of) -> Column:
    """The faults of a list under a key: its own, or those of its members."""
    here = _step(path, key)
    members = F.coalesce(F.flatten(F.transform(_at(value, key, "array<variant>"), lambda x, i: of(x, _step(here, i)))), F.array().cast("array<string>"))
    return F.concat(F.array(_fault(_at(value, key), here, "array")), members)


def faults(record: Column) -> Column:
    """What keeps a record (a VARIANT) from being scored, as "/path: found where expected", in the order of the record's schema."""

    def taxon(t: Column, path: Column) -> Column:
        return F.array(_fault(t, path, "object"), _fault(_at(t, "taxon_name"), _step(path, "taxon_name"), "string"), _fault(_at(t, "ncbi_id"), _step(path, "ncbi_id"), *SCALARS))

    def signature(s: Column, path: Column) -> Column:
        return F.concat(F.array(_fault(s, path, "object"), _fault(_at(s, "abundance_in_group_1"), _step(path, "abundance_in_group_1"), *SCALARS)), _each(s, "taxa", path, taxon))

    def experiment(e: Column, path: Column) -> Column:
        own = [_fault(_at(e, c), _step(path, c), "string", "array") for c in LISTS]
        own += [_fault(_at(e, c), _step(path, c), *SCALARS) for c in ("group_0_name", "group_1_name", "sequencing_type", "mht_correction")]
        return F.concat(F.array(_fault(e, path, "object"), *own), _each(e, "signatures", path, signature))

    return F.array_compact(F.concat(F.array(_fault(record, F.lit("/"), "object")), _each(record, "experiments", None, experiment)))


def experiments(record: Column) -> Column:
    """The record's experiments as PREDICTED; an id that is a boolean names no taxon, nor does its name."""

    def strings(e: Column, key: str) -> Column:
        return F.when(kind(_at(e, key)) == "string", F.array(_at(e, key, "string"))).otherwise(_at(e, key, "array<string>"))

    def taxon(t: Column) -> Column:
        of = kind(_at(t, "ncbi_id"))
        name = F.when(F.coalesce(of, F.lit("")) != "boolean", _at(t, "taxon_name", "string"))
        return F.struct(name.alias("taxon_name"), F.when(of.isin("string", "bigint"), F.btrim(_at(t, "ncbi_id", "string"))).alias("ncbi_id"))

    def signature(s: Column) -> Column:
        return F.struct(_at(s, "abundance_in_group_1", "string").alias("abundance_in_group_1"), F.coalesce(F.transform(_at(s, "taxa", "array<variant>"), taxon), F.array().cast("array<struct<taxon_name:string,ncbi_id:string>>")).alias("taxa"))

    def experiment(e: Column) -> Column:
        text = [_at(e, c, "string").alias(c) for c in ("group_0_name", "group_1_name", "sequencing_type")]
        lists = {c: strings(e, c).alias(c) for c in LISTS}
        signatures = F.coalesce(F.transform(_at(e, "signatures", "array<variant>"), signature), F.array().cast("array<struct<abundance_in_group_1:string,taxa:array<struct<taxon_name:string,ncbi_id:string>>>>"))
        return F.struct(lists["body_site"], lists["condition"], *text, lists["statistical_test"], _at(e, "mht_correction", "boolean").alias("mht_correction"), signatures.alias("signatures"))

    return F.coalesce(F.transform(_at(record, "experiments", "array<variant>"), experiment).cast(PREDICTED), F.array().cast(PREDICTED))


def checked(records: DataFrame) -> DataFrame:
    """study_id, experiments, error of records (study_id, record: JSON): one of the two last is null.

    A record is judged by itself, in one pass: what can't be read as an object of
    experiments, signatures and taxa has an error, its first fault, and no experiments.
    A null record is one without experiments.
    """
    parsed = records.select("study_id", "record", F.try_parse_json(F.coalesce("record", F.lit("{}"))).alias("v"))
    error = F.when(F.col("v").isNull(), F.lit("/: no JSON")).otherwise(F.get(faults(F.col("v")), F.lit(0)))
    judged = parsed.select("study_id", "v", error.alias("error"))
    return judged.select("study_id", F.when(F.col("error").isNull(), experiments(F.col("v"))).alias("experiments"), "error")
