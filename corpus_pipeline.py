"""A corpus pipeline over `documents`: five stages, each written as Parquet and read as the next one's docs.

All but the last return the columns of documents; the last returns each document's place in
the packed batches. Rows are never sampled; models are fitted on bounded samples of labels.

Null and empty texts go in the first stage, as they have no letter; null ids stay, and of rows
alike in id and text one stays. Empty tables give empty results; other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.llm import langid, packing, simhash, suffix_dedup, toxicity
from aerolith.llm.common import stored, text_batches

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _kept(docs: DataFrame, said: Column, condition: str) -> DataFrame:
    """The rows whose verdict `said` meets the condition; only the columns of documents are read, whatever else docs has."""
    return docs.select(F.struct(*COLUMNS).alias("row"), said.alias("said")).where(condition).select("row.*")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in no language the model knows, go."""
    text_batches(spark)
    model = langid.fit(docs)
    return _kept(docs, langid.predictor(model)("text"), "not said.rejected")


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    text_batches(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _kept(docs, toxicity.scorer(model)("text"), "said.predicted = 0")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    text_batches(spark)
    return simhash.drop_near_duplicates(docs).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes and more that occur more than once are cut out of every text; characters cut in two go whole."""
    text_batches(spark)
    kept = suffix_dedup.dedup(docs, carry=("lang", "source"))
    return kept.select("doc_id", suffix_dedup.readable("kept").alias("text"), "lang", "source").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets and token-budget batches."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("toxicity", toxicity_filter), ("near_dedup", near_dedup), ("suffix_dedup", repeated_passages), ("packing", batches)]

#: The stages train models and hash texts, which SQL can't express; tests/llm compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
