"""From raw documents to packed training sequences, stage by stage.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame
with the columns of documents, the last one the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import jaccard, language, mixing, packing, secrets
from quillon.llm.common import discard, documents, ready, shared_folder, stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier rejects go, those without a letter among them; nulls, ties, long texts, repeated rows and empty tables as in language.known_language."""
    ready(spark)
    return language.known_language(docs, language.fit(language.training_rows(docs)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of least id stays; nulls, ties, long texts, repeated rows and empty tables as in jaccard.one_of_each."""
    ready(spark)
    return jaccard.one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays; nulls, ties, long texts, repeated rows and empty tables as in secrets.redact."""
    ready(spark)
    return secrets.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, the last time in part; nulls, ties, long texts, repeated rows and empty tables as in mixing.mixed_rows."""
    ready(spark)
    return mixing.mixed_rows(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and offsets; nulls, ties, long texts, repeated rows and empty tables as in packing.pack."""
    ready(spark)
    return packing.pack(docs)


STAGES = [
    ("language", language_id),
    ("near_duplicates", near_duplicates),
    ("secrets", secret_scan),
    ("mixing", source_mix),
    ("packing", packing_stage),
]

#: Tokens and trained centroids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's table is written before the next one begins, and the one before it deleted."""
    docs, before = documents(spark, sf_dir), None
    for _, stage in STAGES[:-1]:
        folder = shared_folder(spark)
        docs = stored(stage(spark, docs, sf_dir), folder)
        if before:
            discard(spark, before)
        before = folder
    return STAGES[-1][1](spark, docs, sf_dir)
