"""A cleaning pipeline over `documents`: five stages, each on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet and rereads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievework.llm import common, decontaminate, ngram_join, packing, pii, toxicity


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half. Null and empty texts have the score of texts without terms; without labels
    of both classes every document has the share of toxic labels as its score. Repeated rows stay or go together."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates: five-word shingles, Jaccard similarity of 0.8 or more. Documents
    without words are in no group and stay."""
    return ngram_join.one_per_component(docs, words=5, threshold=(8, 10))


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten words of a benchmark item. Null, empty and word-less texts stay; an empty benchmark removes
    nothing."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind and n_chars set anew; null and empty texts stay as they are."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training sequences: which words of which document stand where. Documents without words aren't placed; null sources never
    conflict; repeated rows are items of their own."""
    return packing.pack(docs)


STAGES = [("toxicity", reject_toxic), ("ngram_jaccard", one_of_each_group), ("decontamination", remove_benchmark), ("pii", redact_personal_data), ("packing", pack)]

#: No SQL expresses the learnt stages; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.settled(stage(spark, docs, sf_dir), name)
    return docs
