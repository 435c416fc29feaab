"""A training corpus from raw documents: quality, near duplicates, personal data, mixture, packing.

Each stage takes the documents its predecessor kept; all but the last return the columns of documents. The mixture's
decision is the order of its rows. Reading files does not keep an order, so packing works the places out again, from the same
documents, and sorts by them: its tasks, and so its sequence ids, follow the mixture.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from blendscope.llm import mixing, neardup, packing, pii, quality
from blendscope.llm.queries import prepare
from blendscope.session import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the base rules or the log ratio reject; fitted on these documents."""
    prepare(spark)
    return quality.keep(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest doc_id."""
    prepare(spark)
    return neardup.deduplicate(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data replaced by their kind; ``n_chars`` is that of the new text."""
    prepare(spark)
    return pii.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order that gives each source its target weight all along."""
    prepare(spark)
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens, packed in the order of the mixture whatever order the files are read in."""
    prepare(spark)
    return packing.pack(mixing.mixed(docs), public_tokenizers.path("byte_bpe_50k.json"), end_id=1)


STAGES = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("personal data", personal_data),
    ("mixture", mixture),
    ("packing", pack),
]

# The near-duplicate candidates and token ids have no SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
