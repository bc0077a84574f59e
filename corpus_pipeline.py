"""Corpus pipeline over ``documents``: each stage works on what the one before kept.

All stages but the last return the columns of ``documents``. A text that is null has no words: it fails the
quality rules. An empty table goes through every stage and gives no piece. Columns beyond those of
``documents`` are carried along up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pressroom.llm.files import new_folder, small_batches
from pressroom.llm.fm_index import drop_contaminated
from pressroom.llm.jaccard_join import keep_one
from pressroom.llm.packing import pack_documents
from pressroom.llm.pii import redact_personal
from pressroom.llm.repetition import keep_good
from pressroom.llm.unitcodes import tokenizer_file


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are too short or repeat themselves go."""
    small_batches(spark)
    return keep_good(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of smallest id."""
    small_batches(spark)
    return keep_one(docs, size=5, percent=75)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages make up a twentieth or more go."""
    small_batches(spark)
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=13, share=0.05)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the name of its kind; every document stays."""
    small_batches(spark)
    return redact_personal(docs, sample_docs=2000)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents left, as pieces of windows of 2048 tokens."""
    small_batches(spark)
    return pack_documents(docs, tokenizer_file("byte_bpe_50k.json"), end_id=1, window=2048, slice_bytes=2 << 20)


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", jaccard_join), ("benchmark decontamination", decontamination),
          ("PII", personal_data), ("packing", packing)]

#: Tokenizers and the fitted field can't be expressed in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_folder(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
