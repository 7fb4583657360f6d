"""The staged extraction of records from articles, with a model that is plugged in.

Each stage is a DataFrame keyed by study; only calls of the model run in Python, a
partition at a time. Nothing here reads curated data.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from enum import Enum
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import text as T
from ..functions import vocabulary as V
from . import assemble, markup, prompts, review
from .validation import Slot, problems

#: Characters of an article that a prompt holds; a model's context is bounded.
CONTEXT = 8000


class Design(Enum):
    FUSED_LEAN = "fused-lean"
    SPLIT_VERIFY = "split-verify"
    SPLIT_PANEL = "split-panel"


class Model(Protocol):
    def complete(self, stage: str, prompt: str) -> dict | str: ...


class MockModel:
    """Answers by stage, from a table; the same each time."""

    def __init__(self, answers: dict[str, dict] | None = None) -> None:
        self.answers = answers or {}

    def complete(self, stage: str, prompt: str) -> dict:
        return self.answers.get(stage, {})


def ask(rows: DataFrame, stage: str, make: Callable[[], Model], prompt: str = "prompt") -> DataFrame:
    """The rows with `answer`, the model's text or JSON for their prompt, and `failure`. One model serves a partition; a failing call fails its row only, a null prompt takes no call."""
    place, names = rows.columns.index(prompt), [*rows.columns, "answer", "failure"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for b in batches:
            answers, failures = [], []
            for p in b.column(place).to_pylist():
                if p is None:
                    answers.append(None)
                    failures.append(None)
                    continue
                try:
                    said = model.complete(stage, p)
                    answers.append(said if isinstance(said, str) else json.dumps(said))
                    failures.append(None)
                except Exception as e:  # noqa: BLE001  whatever a model raises belongs to its row
                    answers.append(None)
                    failures.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(answers, pa.string()), pa.array(failures, pa.string())], names)

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("answer", StringType()), StructField("failure", StringType())]))


def resolved(studies: DataFrame, id_map: DataFrame) -> DataFrame:
    """Studies (pmid) with pmcid and whether there is a full text."""
    return studies.join(id_map.select("pmid", "pmcid"), "pmid", "left").withColumn("has_pmc", F.col("pmcid").isNotNull())


RECORD = {"uid": Slot(required=True), "pmid": Slot("integer"), "title": Slot(), "journal": Slot(), "year": Slot("integer"), "doi": Slot(), "authors": Slot(many=True), "study_design": Slot(V.STUDY_DESIGN, many=True), "citation_mode": Slot(V.CITATION_MODE, required=True), "experiments": Slot(many=True)}


def curate(studies: DataFrame, id_map: DataFrame, documents: DataFrame, make: Callable[[], Model], design: Design = Design.FUSED_LEAN, verify: Callable[[DataFrame], DataFrame] | None = None, model_check: bool = False) -> DataFrame:
    """pmid, has_pmc, record (JSON), valid, problems and design for each study (pmid bigint as string).

    documents: pmcid, xml, html. A study without full text, or whose text cannot be
    parsed, has an empty record. verify maps rows of names and proposed ids to
    accepted ids (review.reconciled is one, taxonomy.verified another); without it
    proposed ids are dropped, as none is confirmed. With model_check the verifying
    design asks the model which names the artifact speaks of, and has their directions
    derived anew (review.checked). The split designs keep only names that occur in the located artifact;
    the panel design has a reviewer read it again and settles what the two differ on
    (review.panel). Answers may be wrapped in prose or fences, and an item that is not as
    asked is left out alone. Records that are not valid are still returned.
    """
    found = resolved(studies, id_map)
    parsed = markup.parse_articles(documents, "pmcid")
    article = found.join(parsed, "pmcid", "left").withColumn("full_text", T.context(T.sections_text(F.col("sections")), CONTEXT))
    artifact = markup.located(F.coalesce("tables", F.array().cast(parsed.schema["tables"].dataType)), F.coalesce("figures", F.array().cast(parsed.schema["figures"].dataType)))
    base = article.withColumn("artifact", artifact).withColumn("artifact_text", F.concat_ws("\n", F.aggregate(F.coalesce("tables", F.array().cast(parsed.schema["tables"].dataType)), F.lit(""), lambda s, t: F.concat_ws("\n", s, T.table_text(t["label"], t["caption"], t["rows"]))), F.array_join(F.transform("figures", lambda f: f["legend"]), "\n")))
    text = base.where("has_pmc")
    asking = lambda rows, stage: ask(rows, stage, make)
    of_text = F.coalesce("full_text", F.lit(""))
    designs = F.filter(review.answered(F.col("answer"), "study_design", "string"), lambda x: x.isin(*V.STUDY_DESIGN))
    study = asking(text.select("pmid", prompts.study(of_text, V.STUDY_DESIGN).alias("prompt")), "study").select("pmid", F.array_distinct(designs).alias("study_design"))
    stubs = asking(text.select("pmid", prompts.segment(of_text).alias("prompt")), "segment").select("pmid", F.posexplode(review.answered(F.col("answer"), "experiments", "string")).alias("e", "stub"))
    with_text = stubs.join(text.select("pmid", "full_text", "artifact", "artifact_text"), "pmid")
    fields = asking(with_text.select("pmid", "e", prompts.experiment(F.col("stub"), F.col("full_text")).alias("prompt")), "experiment").select("pmid", "e", assemble.experiment_fields(F.try_parse_json(T.loose_text(F.col("answer")))).alias("x"))
    lean = design is Design.FUSED_LEAN
    said = (prompts.taxa(F.col("stub"), F.col("artifact_text"), F.col("full_text")) if lean else prompts.names(F.col("stub"), F.col("artifact_text"))).alias("prompt")
    named = lambda stage: asking(with_text.select("pmid", "e", "artifact", "artifact_text", said), stage).select("pmid", "e", "artifact", "artifact_text", F.posexplode(review.names_in(F.col("answer"))).alias("ord", "t")).select("pmid", "e", "artifact", "artifact_text", "ord", "t.*")
    taxa = named("taxa" if lean else "names")
    if not lean:
        taxa = taxa.where(F.contains(F.lower("artifact_text"), F.lower("taxon_name")))
    if design is Design.SPLIT_VERIFY and model_check:
        kept, _ = review.checked(taxa.drop("artifact"), ["pmid", "e"], asking)
        taxa = kept.join(with_text.select("pmid", "e", "artifact"), ["pmid", "e"])
    if design is Design.SPLIT_PANEL:
        kept, _ = review.panel(taxa.drop("artifact"), named("review").drop("artifact"), ["pmid", "e"], asking)
        taxa = kept.join(with_text.select("pmid", "e", "artifact"), ["pmid", "e"])
    taxa = verify(taxa) if verify else taxa.withColumn("ncbi_id", F.lit(None).cast("bigint"))
    from .curated import dedup_taxa

    unique = dedup_taxa(taxa.withColumn("source", F.col("artifact.said")), ["pmid", "e", "source"])
    signatures = unique.groupBy("pmid", "e", "source", "direction").agg(F.array_sort(F.collect_list(F.struct("ord", "ncbi_id", "taxon_name"))).alias("t"))
    signature = F.struct(F.when(F.col("direction") == "increased", 0).otherwise(1).alias("place"), "source", F.col("direction").alias("abundance_in_group_1"), F.transform("t", lambda x: F.struct(x["taxon_name"], x["ncbi_id"])).alias("taxa"))
    by_experiment = signatures.groupBy("pmid", "e").agg(F.transform(F.array_sort(F.collect_list(signature)), lambda x: x.dropFields("place")).alias("signatures"))
    experiments = assemble.experiments(fields.join(by_experiment, ["pmid", "e"], "left"), "pmid")
    whole = base.select("pmid", "pmcid", "has_pmc", "meta").join(study, "pmid", "left").join(experiments, "pmid", "left")
    record = assemble.record(F.col("pmid"), F.col("meta"), F.col("study_design"), F.col("experiments"))
    out = whole.withColumn("record", record).withColumn("problems", problems(F.col("record"), RECORD))
    return out.select("pmid", "pmcid", "has_pmc", "record", (F.size("problems") == 0).alias("valid"), "problems", F.lit(design.value).alias("design"))
