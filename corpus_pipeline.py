"""The corpus pipeline: each stage works on all that the one before kept.

All stages take documents with any further columns. Each row of an empty table is none
of the result; null and empty texts and rows without an id pass the filters (of equal
empty texts with ids one stays), and no stage needs distinct ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from taxaloom.llm import bpe, decontaminate, secrets, simhash, storage, toxicity
from taxaloom.llm.queries import TOKENIZER, table


def toxic_documents_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the field, fitted on the folder's labels, scores below the threshold."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of similar texts, linked by SimHash and, beyond its ball, by shared shingles: that of the smallest id; no other text of that id goes with it."""
    return simhash.keep_first(docs)


def benchmark_passages_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in whose text no item of the folder's benchmark is found."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def secrets_redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets in their texts replaced, n_chars set anew where a text changed."""
    return secrets.redact(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and hashes of ids and decoded text, a row for each row; a null text counts as empty."""
    return bpe.encode(docs, TOKENIZER, digest=True)


STAGES = [
    ("toxicity", toxic_documents_out),
    ("near_dedup", near_copies_out),
    ("benchmark_decontamination", benchmark_passages_out),
    ("secret_scans", secrets_redacted),
    ("bpe", encoded),
]

#: SQL has no field, fingerprint, alignment or tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over the documents of a folder, each stage's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = storage.stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
