"""A training-data pipeline over ``documents``: each stage reads the table that the one before wrote.

All stages but the last return the columns of their input, whatever else it holds beside doc_id,
text and source; an empty table passes through as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotegraph.llm import bpe, exact, mixing, quality, simhash
from quotegraph.llm.queries import vocabulary_path
from quotegraph.llm.tables import own_columns
from quotegraph.plans.shared import materialize

#: Documents whose calibrated quality score is below this go.
LEAST_QUALITY = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject.

    A null or empty text is scored like any other, by the empty vector. Rows that repeat an id have
    scores of their own. A column of the table's own that is named score stays as it is.
    """
    models = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored, score = quality.score_documents(docs, *models)
    return scored.filter(F.col(score) >= LEAST_QUALITY).select(*own_columns(docs))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, a null text being empty: the one with the least id, an id before none."""
    return exact.exact_dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least id, an id before none. Texts without words are equal."""
    return simhash.near_dedup(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; repeats are repeated rows. Documents without words aren't taken; a null source is a source."""
    return mixing.mix_rows(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of them and of what they decode to. A null text has none."""
    return bpe.encode_documents(docs, vocabulary_path()).drop("decoded")


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("simhash near-dedup", near_stage),
    ("mixing sources", mixing_stage),
    ("bpe encoding", encoding_stage),
]

#: The first stage is a trained model, which SQL can't express; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
