"""The registered queries of the text operators: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .conversation_repair import conversation_report
from .decontaminate import contained_items
from .html_text import extract_text
from .language_id import identify_languages
from .line_dedup import dedup_lines
from .ngram_join import near_duplicates
from .oracles import conversation_repair_sql, quality_rules_sql
from .packing import pack
from .piece_codec import decode_ids, encode_texts
from .quality_rules import quality_report
from .spark import read_table
from .substring_dedup import repeated_spans
from .token_alignment import alignment_scores
from .token_counts import token_counts
from .toxicity import toxicity_scores


def tokenizer_path(name: str) -> str:
    from public_tokenizers import path

    return path(name)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = quality_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return report.select("document.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def _fold(n: int) -> Column:
    """Fold of a document, by the checksum of its id as text; null ids are in fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n)), F.lit(0))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = _fold(4) == 2
    found = identify_languages(read_table(spark, sf_dir, "documents"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read_table(spark, sf_dir, "pages"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(read_table(spark, sf_dir, "documents"))
    text = F.col("document.text")
    return kept.select("document.doc_id", "n_removed_lines", F.length(text).cast("long").alias("n_chars_left"), F.crc32(text.cast("binary")).alias("text_crc32"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = repeated_spans(read_table(spark, sf_dir, "documents"), across_documents=False).drop("text_no")
    return spans.withColumn("across", F.col("first_doc_id") < F.col("doc_id"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = _fold(5) == 0
    scored = toxicity_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with faults that depend on a checksum of ``conv_id:turn``; nulls read as one space."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat_ws(":", name("conv_id"), name("turn")).cast("binary")), F.lit(20))
    rows = conversations.select("conv_id", "turn", name("role").alias("role"), name("text").alias("text"), kind.alias("kind"))
    copies = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), copies)).alias("copy")).drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read_table(spark, sf_dir, "conversations")
    return conversation_report(damaged(conversations), conversations)


def op12_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("piece_bpe_32k.model")
    decoded = decode_ids(encode_texts(read_table(spark, sf_dir, "documents"), path), path)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_scores(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_ngram_join, op2_quality_rules, op3_decontamination, op4_language_id, op5_token_counts, op6_html_text, op7_line_dedup, op8_substring_dedup, op9_toxicity, op10_packing, op11_conversation_repair, op12_piece_codec, op13_token_alignment)}


def oracle_sql() -> dict:
    return {"op2_quality_rules": quality_rules_sql(), "op11_conversation_repair": conversation_repair_sql()}
