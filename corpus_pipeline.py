"""From raw documents to packed training sequences, in five stages.

Edge cases, by the stages' own definitions: a null or empty text fails the base rules and goes. Rows without
an id are judged like others; near-dedup never drops them. Rows that repeat an id are one document there: one of
them stays. Null labels, labels of unknown ids and labels other than 0 and 1 are ignored; without labels only
the base rules reject and every document is taken once. Columns of any name are carried as they are up to
packing. A table without rows gives a table without rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lanegraph.llm import mixing, packing, quality_classifier, quality_rules, simhash
from lanegraph.llm.common import GROUP_BYTES
from lanegraph.shared import materialize

#: An Arrow batch takes rows until it has so many bytes, so that most batches are one group of texts.
BATCH_BYTES = GROUP_BYTES * 9 // 10


def bounded_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches have about BATCH_BYTES at most (Spark's default is 64 MB), in an executor as in its workers."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or a certified cutoff go."""
    bounded_batches(spark)
    return quality_rules.filter_documents(docs, _labels(spark, sf_dir))


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality network scores below its threshold go."""
    bounded_batches(spark)
    return quality_classifier.filter_documents(docs, _labels(spark, sf_dir))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (5-word shingle sets of similarity 0.8 or more) the document with the smallest id stays."""
    bounded_batches(spark)
    return simhash.keep_one(docs)


#: Token shares that mixing aims for. The stages before have taken the poor documents out, so none are asked for: a share
#: for them would be met by repeating the few that are left.
TARGETS = {"good": 0.98, "good_toxic": 0.02, "poor": 0.0, "poor_toxic": 0.0}


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken as often as their rates say, so that the domains meet their targets."""
    bounded_batches(spark)
    return mixing.mixed_documents(docs, _labels(spark, sf_dir), TARGETS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every remaining document, tokenised and packed into sequences."""
    bounded_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("quality_rules", rules_stage),
    ("quality_classifier", classifier_stage),
    ("simhash_near_dedup", dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Certified cutoffs, trained classifiers and bin packing have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each one's rows written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
