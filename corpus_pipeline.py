"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, byte-level BPE.

Each stage reads what the one before it wrote. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repograph.llm import bpe, decontam, kernel, langid, linededup, neardup
from repograph.llm.queries import vocabulary

#: Texts whose best language is less likely than this are rejected, as are texts without a letter.
LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows with a recognised language; the model is fitted on a bounded sample of the rows' own labels.

    A null lang is filled in. Rows with equal ids are kept or go each by itself.
    """
    return langid.recognised(docs, langid.fit(docs), LEAST_SCORE)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes repeated runs of lines; n_chars follows the text. A row may end up with an empty text and stays."""
    out = linededup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long"))
    return out if "n_removed_lines" in docs.columns else out.drop("n_removed_lines")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays. Only texts that may go are shuffled."""
    found = kernel.stored(neardup.components(docs).where(~F.col("kept")).select(F.col("doc_id").alias("__id")).distinct())
    doubtful = kernel.held(docs, found)
    return kernel.held(docs, found, inside=False).unionAll(doubtful.join(found, doubtful["doc_id"] == found["__id"], "left_anti"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark window."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontam.clean_rows(docs, items)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its ids, and whether decoding them gives back the text."""
    path, pattern = vocabulary()
    out = bpe.decode(bpe.encode(docs, path, pattern), path)
    return out.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("data", 256).alias("decoded_sha256"))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("byte_bpe", tokenise)]

#: A fitted language model and rank merges aren't expressible in SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = kernel.stored(docs)
    return docs
