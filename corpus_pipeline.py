"""The corpus pipeline: five stages over ``documents``, each on all that the one before kept.

Every stage takes and returns rows of ``documents`` (the last returns token ids), and each result is
a table in the shared folder before the next stage reads it.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roundscope.llm import bpe, phrases, pii, rules, setsketch
from roundscope.llm.queries import table
from roundscope.session import materialize

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Near-duplicates share this many hundredths of their five-word shingles.
NEAR_HUNDREDTHS = 80
#: Rows of whole texts that go to a Python worker at once, unless the session has its own number.
BATCH_ROWS = "500"
_BATCH_SETTING, _SPARK_DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def _small_batches(spark: SparkSession) -> None:
    """Ten thousand whole texts at once would be held on both sides of each Python worker."""
    if spark.conf.get(_BATCH_SETTING) == _SPARK_DEFAULT:
        spark.conf.set(_BATCH_SETTING, BATCH_ROWS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail the base rule or are probably bad by the weighed votes."""
    _small_batches(spark)
    return rules.filter_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the least doc_id of each group of near-duplicates."""
    _small_batches(spark)
    return setsketch.representatives(docs, NEAR_HUNDREDTHS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item."""
    _small_batches(spark)
    return phrases.without_hits(docs, table(spark, sf_dir, "benchmark"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put the kind of each personal datum in its place."""
    _small_batches(spark)
    return pii.masked(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, decoded again as a check: ``doc_id, n_tokens, ids, decoded_sha256``."""
    _small_batches(spark)
    path = public_tokenizers.path(VOCABULARY)
    return bpe.round_trip(docs, path, public_tokenizers.PATTERN).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii", private_data),
    ("bpe", tokens),
]

#: SQL can express neither the learned rule weights nor the merges. Tests compare the operators behind
#: the stages with plain versions; the stages together have no such test yet.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
