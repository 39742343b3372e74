"""The corpus pipeline: each stage calls one operator and hands what it keeps to the next.

1. ``language``: documents whose score is under ``langid.LEAST`` (of no language that was learned) go, whatever ``lang`` says; a
   missing ``lang`` is filled in.
2. ``near_dedup``: one document of each group of near copies (sets of five-word shingles, Jaccard similarity of 0.8 or more) stays;
   they meet at the anchors of SimHash fingerprints, and every link is verified.
3. ``decontaminate``: documents that hold a benchmark item go.
4. ``secrets``: secrets in the texts are replaced; documents stay.
5. ``tokens``: the texts as token ids.

Null texts go in stage 1 (they have no letters); null ids are a document each; an empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm import bpe, decontam, langid, secrets, simhash, store


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.learned(docs, langid.train(docs, F.lit(True)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.dedup(docs, words=5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.masked(docs).withColumn("n_chars", F.length("text").cast("long"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), outputs=("n_tokens", "ids", "ids_sha256"))


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("secrets", mask_secrets), ("tokens", tokens)]

#: Kernels, fingerprints and merges have no SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = store.written(stage(spark, docs, sf_dir), f"stage-{name}")
        if last is not None:
            store.drop(spark, last)
        last = docs.inputFiles()[0].rpartition("/")[0] if docs.inputFiles() else None
    return docs
