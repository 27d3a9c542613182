"""The registered queries of this subpackage: thin wrappers with production parameters over whole tables."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import decontaminate, html, jpeg, mixing, ngram_join, oracle, quality, store, substring, tokens, toxicity, warc
from siftwell.sources import shared


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    # a cache for each state of the table, so that the first run over a table shows the whole work; the variable names one for all
    state = hashlib.sha256((sf_dir + shared.stamp(spark, f"{sf_dir}/documents.parquet")).encode()).hexdigest()[:32]
    cache = tokens.DigestCache(spark, os.environ.get("SIFTWELL_TOKEN_CACHE") or f"{store.shared_dir(spark)}/siftwell/token-cache/{state}")
    counts = tokens.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), cache)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("spans")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = store.Table(jpeg.stored_media(_table(spark, sf_dir, "documents")), "media")
    columns = store.Table(jpeg.media_columns(media.read()), "media-columns")
    media.drop()
    return columns.read()


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(_table(spark, sf_dir, "pages"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "source"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(_table(spark, sf_dir, "documents")).drop("class_id")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.report(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_decontaminate, op3_toxicity, op4_quality, op5_media, op6_warc, op7_html_text, op8_mix_sources, op9_ngram_join, op10_substring_dedup)}
ORACLE: dict[str, str] = oracle.ORACLE
