"""The registered queries of the text operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelspark.llm import bpe, decontaminate, host_quality, language, line_dedup, ngram_join, sharding, spelling, sql, substring_dedup, suffix_dedup, token_alignment, token_store, url_filter
from panelspark.sources.sinks import new_path

BUILD: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(fn):
    BUILD[fn.__name__] = fn
    check = getattr(sql, fn.__name__.split("_")[0].upper(), None)
    if check:
        SQL[fn.__name__] = check
    return fn


URL_RULES = [
    ("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


@query
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url by the rules, else by trees trained on the urls that the rules decide."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    _, verdict = url_filter.rule_of(url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url")), URL_RULES)
    model = url_filter.train(pages.select("url", (verdict == "block").cast("int").alias("blocked")))
    return url_filter.judge(pages, model, URL_RULES).select(
        "page_id", "host", "path", "rule", "verdict", F.round("block_score", 6).alias("block_score"))


@query
def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, written as wavelet-matrix shards and read back from them."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    path = new_path(spark, "tokens")
    token_store.write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_store.read_documents(spark, path, digest=True)


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that have a similar earlier line."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


@query
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 20-word sequences that start earlier."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.remove_repeats(docs, digest=True).drop("text")


@query
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language by profiles of three quarters of the documents."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = language.train(docs.where(language.learns()))
    return language.identify(docs.select("doc_id", "text", (~language.learns()).alias("held_out")), profiles).select(
        "doc_id", "held_out", "lang_pred", "score")


@query
def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose sets of 3-word shingles have a Jaccard similarity of 0.9 or more."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join.near_duplicates(docs, n=3, percent=90, count=False).drop("n_links")


def op6_ngram_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same groups with the number of documents that each document links with."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join.near_duplicates(docs, n=3, percent=90)


BUILD["op6_ngram_links"], SQL["op6_ngram_links"] = op6_ngram_links, sql.OP6_LINKS


@query
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded with a byte-level vocabulary."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("text")


@query
def op8_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of every document and the verdict on its source."""
    out = host_quality.judge(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      "kept")


@query
def op9_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, shuffled uniformly into shards 0 to 7 whose row counts differ by one at most."""
    text = F.coalesce("text", F.lit(""))
    docs = _table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = sharding.shuffle_into_shards(docs, ["doc_id", "text_crc32"], 8)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))


@query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document searched for all 13-word windows of the benchmark."""
    found = decontaminate.find_windows(
        _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return decontaminate.contamination(found.drop("text", "hits")).drop("item_ids")


@query
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's byte-level and sentencepiece tokens, aligned."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return token_alignment.align(docs, a, b, digest=True, keep=["doc_id"])


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents, some of them misspelt by rule, with its more frequent variant."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling.group_variants(spelling.word_counts(docs, misspell=97))


@query
def op13_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes that a repeated string of 200 bytes covers."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.remove_repeats(docs, digest=True).drop("text")


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline over all documents."""
    return corpus_pipeline.run(spark, sf_dir)
