"""The corpus pipeline: stages over documents, each written as Parquet and reread as the next one's input.

toxicity          documents scored 0.5 or more go
ngram_join        of documents linked at Jaccard 0.8 on five-word shingles the smallest doc_id stays
substring_dedup   words in 13-word windows that start in a smaller document go, documents left empty go
decontaminate     documents with windows of two or more benchmark items go, single items' spans are cut
mix_sources       every row gets its slot in the mixture of sources
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftwell.llm import decontaminate, mixing, ngram_join, store, substring, toxicity


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring.remove(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [("toxicity", toxicity_stage), ("ngram_join", ngram_join_stage), ("substring_dedup", substring_stage), ("decontaminate", decontaminate_stage), ("mix_sources", mixing_stage)]
#: The first and the fifth stage can't be put in SQL; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's table goes once the next one is written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        table = store.Table(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if last is not None:
            last.drop()
        docs, last = table.read(), table
    return docs
