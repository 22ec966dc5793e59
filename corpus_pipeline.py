"""From documents to token ids: language, line and near-duplicate removal, decontamination, BPE.

Stages take (spark, docs, sf_dir) and return a DataFrame; each one's result is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelspark.llm import bpe, decontaminate, language, line_dedup, ngram_join
from panelspark.sources.sinks import new_path

MIN_SCORE = 0.1  # of a language: below it a text is unlike every language learned


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter that are like one of the languages of the labelled documents."""
    profiles = language.train(docs.where(language.learns()))
    judged = language.identify(docs, profiles)
    return judged.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= MIN_SCORE)).select(docs.columns)


def remove_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that have a similar earlier line; one that loses its last word goes, n_chars follows."""
    cut = line_dedup.dedup_lines(docs)
    left = cut.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))).select(
        docs.columns)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose 5-word shingles have a Jaccard similarity of 0.8 or more: the smallest doc_id."""
    return ngram_join.keep_one(docs, n=5, percent=80)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lies in 13-word windows of the benchmark."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document left, and the digest of the text that they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), path, decoded_sha256="decoded_sha256")
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded_sha256")


STAGES = [
    ("language", identify_language),
    ("line_dedup", remove_lines),
    ("near_duplicates", remove_near_duplicates),
    ("decontamination", remove_contaminated),
    ("bpe", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
