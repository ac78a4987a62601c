"""The corpus pipeline: language, near duplicates, benchmark leaks, mixture, records.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next stage's ``docs``. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelwright.llm import decontaminate, language, mixing, records, registered, simhash
from reelwright.session import shared_folder, small_batches


def recognised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the model is fitted on a bounded sample of labelled rows."""
    small_batches(spark)
    return language.without_rejected(docs, language.fit(docs))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class that SimHash fingerprints link (three differing bits or fewer), the one with the least id."""
    small_batches(spark)
    return simhash.keep_one_per_class(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of the benchmark."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The parts of documents that the mixture of the sources takes, as often as it takes them."""
    parts = mixing.mixed_documents(docs)
    return parts.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else parts


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The records written for the documents, as read back."""
    small_batches(spark)
    return records.encoded(docs, registered.tokenizer_path(), registered.END_ID)


STAGES = [
    ("language", recognised),
    ("near_duplicates", deduplicated),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("records", encoded),
]

#: Language identification and SimHash cannot be said in SQL; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, applied to the table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
