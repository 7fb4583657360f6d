"""What a model is asked at each stage, as text columns. Each prompt names the JSON that is wanted; none holds curated data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _said(task: str, wanted: str, **parts: Column) -> Column:
    """The task, the form of the answer, and each part under its heading; parts that are null are left out."""
    blocks = [F.concat(F.lit(f"# {name.replace('_', ' ')}\n"), part) for name, part in parts.items()]
    return F.concat_ws("\n\n", F.lit(task), F.lit(f"Answer with one JSON object: {wanted}"), *blocks)


def study(article: Column, designs: Sequence[str]) -> Column:
    return _said("Which of these study designs does the article have? " + "; ".join(designs), '{"study_design": [text]}', article=article)


def segment(article: Column) -> Column:
    return _said("List the comparisons of two groups that the article reports, a short description for each. Do not split one comparison or merge two.", '{"experiments": [text]}', article=article)


def experiment(stub: Column, article: Column) -> Column:
    wanted = '{"host_species": text, "body_site": [text], "condition": [text], "group_0_name": text, "group_1_name": text, "sequencing_type": text, "statistical_test": [text], "mht_correction": true or false}'
    return _said("Describe this comparison; group 1 is the one whose abundance is reported. Leave out what the article does not say.", wanted, comparison=stub, article=article)


def taxa(stub: Column, artifact: Column, context: Column | None = None) -> Column:
    parts = {"comparison": stub, "table_or_figure": artifact} | ({"context": context} if context is not None else {})
    return _said("List the taxa that differ between the groups, and whether each is more or less abundant in group 1. Give an NCBI id only if you are sure.", '{"taxa": [{"taxon_name": text, "direction": "increased" or "decreased", "ncbi_id": number or null}]}', **parts)


def names(stub: Column, artifact: Column) -> Column:
    return _said("Copy the names of the taxa that differ between the groups as they are written, with the direction in group 1.", '{"taxa": [{"taxon_name": text, "direction": "increased" or "decreased"}]}', comparison=stub, table_or_figure=artifact)


def ground(listed: Column, artifact: Column) -> Column:
    return _said("Which of these names does the source speak of?", '{"grounded": [text]}', names=F.array_join(listed, "\n"), source=artifact)


def rederive(name: Column, artifact: Column, number: int) -> Column:
    return _said(f"Round {number}. Is this taxon more or less abundant in group 1, by the source alone?", '{"direction": "increased" or "decreased"}', taxon=name, source=artifact)


def disambiguate(name: Column, candidates: Column, context: Column) -> Column:
    return _said("Which of these NCBI ids is meant by the name?", '{"ncbi_id": number or null}', name=name, ids=F.array_join(F.transform(candidates, lambda c: c.cast("string")), "\n"), context=context)
