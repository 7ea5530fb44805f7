"""A training-corpus pipeline of five stages, each a Spark job over all its predecessor kept.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of
``documents``.  Stages are written as Parquet and read again.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martlens.llm import near_dup, packing, secret_scan, substring, toxicity
from martlens.llm.common import packed, unpacked
from martlens.session import checkpoint_dir
from martlens.sources.tables import read_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go."""
    model = toxicity.train_model(docs, read_table(spark, sf_dir, "labels"))
    scored = toxicity.score(packed(docs), model, ["doc_id", "text", "rest"])
    return unpacked(scored.where(F.col("_score") < 0.5), docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays, the one with the smallest doc_id; equal rows become one."""
    return near_dup.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words and more that repeat anywhere are cut from the texts."""
    return substring.remove_repeats(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark."""
    clean = secret_scan.redact(docs, read_table(spark, sf_dir, "labels"))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining texts as packed token sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", drop_toxic), ("near_dedup", one_of_near_copies), ("substring_dedup", cut_repeats),
          ("secret_scan", hide_secrets), ("packing", pack_sequences)]

#: No SQL can express the classifier, the tokenizer or the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    root = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{root}/{k}-{name}")
        docs = spark.read.schema(out.schema).parquet(f"{root}/{k}-{name}")
    return docs
