"""From raw documents to packed training sequences, stage by stage.

Every stage takes ``(spark, docs, sf_dir)`` and works on what its predecessor kept:

1. quality_rules: refused documents go.
2. line_dedup: repeated lines go; a document that had text and has none left, because all its
   lines stay elsewhere, goes too.
3. near_duplicates: of every group of near duplicates the lowest (doc_id, hash of the text) stays, and of repeated
   rows one. Two texts under one doc_id are two documents; rows without a doc_id stay.
4. decontamination: documents that hold a benchmark item go.
5. packing: what is left becomes pieces of packed sequences.

All but the last return the columns of their input, whatever their names. Null texts fall at the first stage, which counts them as
empty; very long texts go through whole; an empty table goes through empty. Some stages have no SQL form, so there is no ORACLE_SQL; the tests hold each stage against a brute-force version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from florin.llm.decontaminate import drop_contaminated
from florin.llm.line_dedup import dedup_lines
from florin.llm.ngram_join import near_duplicates
from florin.llm.packing import pack
from florin.llm.quality_rules import quality_rules
from florin.llm.queries import tokenizer_path
from florin.llm.spark import materialise, read_table, shared_folder


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules(docs, read_table(spark, sf_dir, "labels")).where("kept").select("document.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup_lines(docs).where((F.col("n_removed_lines") == 0) | F.col("document.text").rlike(r"\S")).select("document.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = near_duplicates(docs).where("doc_id IS NOT NULL").groupBy("doc_id", "text_key").agg(F.first("first").alias("first"), F.count("*").alias("n"))
    found = materialise(found.where("NOT first OR n > 1"))
    rows = docs.select(F.struct("*").alias("document"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("key"))
    same = (F.col("id") == F.col("doc_id")) & (F.col("key") == F.col("text_key"))
    repeated = rows.join(found.where("first"), same).dropDuplicates(["id", "key"])
    return rows.join(found, same, "left_anti").select("document.*").union(repeated.select("document.*"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet in the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    folder = shared_folder(spark, "corpus-pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{folder}/{k}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
