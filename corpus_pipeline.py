"""A training corpus from raw documents: five stages, each one operator.

Each stage works on all documents that the one before it kept, is written as
Parquet and read again as the next one's input.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import langid, packing, simhash, suffix_dedup, toxicity
from millrace.llm._shared import shared_dir, small_batches

#: Least posterior of a language that is kept.
SURE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned; those without text or letters, or
    of no clear language, go, and texts of a language that was not learned (see
    langid.rate_bounds). The language column stays as it was; repeated rows are judged each."""
    small_batches(spark)
    return langid.accepted(docs, SURE)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model does not grade toxic. Null and empty texts stay, repeated
    rows are judged each; without labels of both kinds all stay."""
    small_batches(spark)
    return toxicity.accepted(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row (of the smallest id) of each group of near duplicates. A row without an id
    stays where its group has no row with one (one such row a group). Different texts
    under one id are different documents: each is the first of its own group or goes."""
    small_batches(spark)
    kept = simhash.first_rows(docs)
    return docs.withColumn("row_key", simhash.row_key()).join(kept, "row_key", "left_semi").dropDuplicates(["row_key", "doc_id", "text"]).select(*docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document of smaller id holds. Documents
    stay, n_chars counts what is left."""
    small_batches(spark)
    return suffix_dedup.without_repeats(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens. A null text is an empty one, repeated rows
    are packed each."""
    small_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("toxicity", clean), ("near_duplicates", distinct), ("repeated_passages", without_repeats), ("packing", packed)]

#: No stage of learned, hashed or packed results can be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = f"{shared_dir(spark)}/millrace/pipeline-{name}-{uuid.uuid4().hex}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
