"""A training-corpus pipeline: each stage reads what the stage before wrote.

Toxic documents go; of near-duplicates the one with the smallest id stays;
benchmark passages are cut out (a document that is mostly benchmark goes);
personal data is replaced by its kind; what is left is tokenized and packed.
All stages but the last return the columns of ``documents``, ``n_chars`` being
that of the text as it now is. Null texts and ids, empty tables and repeated rows are
treated as each operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlift.llm import decontaminate, near_dedup, packing, private_data, toxicity
from arborlift.llm.base import table
from arborlift.llm.token_queries import vocabulary
from arborlift.session import stage


def _sized(docs: DataFrame) -> DataFrame:
    """``n_chars``, if there is such a column, from the text as it is."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.with_severity(docs, model).where(~F.col("_toxicity.toxic")).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs).select(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _sized(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _sized(private_data.redact(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(docs, vocabulary("word_bpe_49k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_copies),
    ("decontamination", drop_benchmark),
    ("pii", mask_private),
    ("packing", pack_sequences),
]

#: The trained and signature-based stages cannot be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
