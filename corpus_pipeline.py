"""A corpus pipeline: quality, exact duplicates, near duplicates, personal data, packing.

Each stage takes what the one before it kept, written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringlore.llm import exact_dedup, minhash, packing, pii, quality
from ringlore.llm.common import written


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from the labels of these documents, scores 0.7 or more.

    Null and empty texts score by the bias alone; repeated rows are each judged; without labels of both classes all stay.
    """
    # texts go to Python workers a thousand at a time: a batch of Spark's default of ten thousand whole documents is held several times over
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id.

    Null and empty texts are equal; a null id loses to every other; of repeated rows one stays.
    """
    return exact_dedup.drop_exact_duplicates(docs)


def dissimilar_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a Jaccard similarity of 0.8 of five-word shingles the one with the smallest id.

    Candidates come from SimHash fingerprints linked by pivot distance tables, then from MinHash; each is checked on its whole sets.
    Fewer than five words are one shingle; texts without words are linked; a null id loses to every other; of repeated rows one stays.
    """
    return minhash.drop_near_duplicates(docs)


def redacted_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by the name of its kind. Null texts stay null; every row stays."""
    return pii.redact_pii(docs)


def packed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1,024 tokens. Null and empty texts are the end id alone; of no documents there are no pieces."""
    pieces = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [
    ("quality", good_documents),
    ("exact_dedup", distinct_documents),
    ("near_dedup", dissimilar_documents),
    ("pii", redacted_documents),
    ("packing", packed_documents),
]

#: A learned classifier, fingerprints and a tokenizer are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        rows = written(stage(spark, rows, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, rows, sf_dir)
