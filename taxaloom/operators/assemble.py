"""Records put together from what the stages found: nested, and without blanks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import coerce as C
from ..functions import vocabulary as V
from .predictions import kind


def _text(answer: Column, key: str) -> Column:
    """A field's text; lists, objects and blanks are none."""
    value = F.try_variant_get(answer, f"$.{key}", "variant")
    return F.nullif(C.strip(F.when(~kind(value).isin("array", "object"), F.try_variant_get(value, "$", "string"))), F.lit(""))


def _texts(answer: Column, key: str) -> Column:
    """A field that is a list, or one text instead of a list; blanks are left out."""
    value = F.try_variant_get(answer, f"$.{key}", "variant")
    given = F.when(kind(value) == "array", F.try_variant_get(value, "$", "array<string>")).when(kind(value) == "string", F.array(F.try_variant_get(value, "$", "string")))
    return F.filter(F.transform(given, C.strip), lambda x: x.isNotNull() & (x != ""))


def experiment_fields(answer: Column) -> Column:
    """An experiment's fields from a model's answer (a VARIANT): values outside a vocabulary and blanks are null, only booleans are booleans."""
    corrected = F.try_variant_get(answer, "$.mht_correction", "variant")
    return F.struct(
        _text(answer, "host_species").alias("host_species"),
        C.none_if_empty(_texts(answer, "body_site")).alias("body_site"),
        C.none_if_empty(_texts(answer, "condition")).alias("condition"),
        _text(answer, "group_0_name").alias("group_0_name"),
        _text(answer, "group_1_name").alias("group_1_name"),
        C.to_member(_text(answer, "sequencing_type"), V.SEQUENCING_TYPE).alias("sequencing_type"),
        C.none_if_empty(C.to_members(_texts(answer, "statistical_test"), V.STATISTICAL_TEST)).alias("statistical_test"),
        F.when(kind(corrected) == "boolean", F.try_variant_get(corrected, "$", "boolean")).alias("mht_correction"),
    )


def experiments(rows: DataFrame, by: str) -> DataFrame:
    """by, experiments: the rows (by, e: their place, x: experiment_fields(), signatures) of each study in order, a field beside the signatures."""
    one = F.struct("e", "x.*", C.none_if_empty(F.col("signatures")).alias("signatures"))
    return rows.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(one)), lambda e: e.dropFields("e")).alias("experiments"))


def record(pmid: Column, meta: Column, study_design: Column, found: Column) -> Column:
    """A study as JSON. A study whose id is no number is cited by hand; absent fields and empty lists are absent, but the list of experiments is always there."""
    number = pmid.try_cast("bigint")
    return F.to_json(
        F.struct(
            pmid.cast("string").alias("uid"),
            number.alias("pmid"),
            F.when(number.isNotNull(), "Auto").otherwise("Manual").alias("citation_mode"),
            meta["doi"].alias("doi"),
            meta["title"].alias("title"),
            C.none_if_empty(meta["authors"]).alias("authors"),
            meta["journal"].alias("journal"),
            meta["year"].alias("year"),
            C.none_if_empty(study_design).alias("study_design"),
            F.coalesce(found, F.array()).alias("experiments"),
        )
    )
