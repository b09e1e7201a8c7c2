"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.llm import common, decontamination, ngram_jaccard, packing, pii, quality_fm


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject (score of at least 0.5)."""
    machine = quality_fm.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return common.apart(docs, ["doc_id", "text", "n_chars"], lambda d: quality_fm.score_quality(d, machine, "_score").where("_score >= 0.5"))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the smallest doc_id."""
    return common.apart(docs, ["doc_id", "text"], ngram_jaccard.drop_near_duplicates)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return common.apart(docs, ["doc_id", "text"], lambda d: decontamination.contamination(d, bench).where(~F.col("contaminated")))


def hide_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced; n_chars is that of the new text."""
    model = pii.train(docs)
    n_chars = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long"))
    return common.apart(docs, ["text", "n_chars"], lambda d: pii.redact(d, model).withColumn("n_chars", n_chars))


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its length in tokens, bucket, batch and slot."""
    return packing.pack_texts(docs)


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_distinct),
    ("decontamination", keep_clean),
    ("pii", hide_personal),
    ("packing", pack_tokens),
]

#: The classifier, the reliabilities and the dynamic program are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs, _ = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
