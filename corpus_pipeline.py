"""A corpus pipeline: language ID, exact dedup, near dedup, secret redaction, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents.  Language ID drops texts without letters or with an uncertain
language; the dedup stages keep one row of each group; secrets are replaced in the text;
packing returns one row for each piece of a document in a sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weft.llm import dedup, langid, minhash, packing, secretscan
from weft.llm.common import Scratch
from weft.llm.queries import vocabulary


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accept(docs, vocabulary("piece_bpe_32k.model"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs, words=5, percent=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secretscan.redact(docs, vocabulary("word_bpe_49k.json"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.tiktoken"))


STAGES = [("language ID", language), ("exact dedup", exact), ("MinHash near-dedup", near), ("secret scans", secrets), ("packing", pack)]
#: SQL can express neither the language model nor packing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage-{i}", keep=True)
    return docs
