"""Substring deduplication by content-defined chunks.

A gear hash rolls over the UTF-8 bytes of a text; a chunk ends where its low bits are
zero. The bits depend on the last few bytes alone, so an
insertion moves no boundary beyond its neighbourhood, and a passage that occurs in two documents is
cut into the same chunks in both but for its edges. Chunks with the same digest are
duplicates; the occurrence with the lowest (doc_id, start) is the original.
Adjacent duplicate chunks of a document form a span, and spans of at least ``min_words``
words are reported or cut out. In text without spaces, words do not measure a span; there it
is long enough with ``min_wide`` characters of three or more UTF-8 bytes.

Chunks are counted with map-side aggregation, so a passage in a third of all
documents reaches the reducers as one row per task. The chunks then
meet the table of repeated digests, which has one row per digest, in a
plain equi-join that adaptive execution splits where a digest is hot.

Chunks are matched by 64-bit digests, so among n distinct chunks about n^2 / 2^65 pairs meet by chance; a span takes several such chunks in a row.

Defined results: null and empty texts have no chunks; rows with the same doc_id and text are one
document; rows with one doc_id and different texts are told apart by ``text_no``, 24 bits of the text's hash; rows without a doc_id are
ignored; ties go to the lowest (doc_id, text_no, start); very long texts are chunked whole; an empty table gives an empty result; other
columns, whatever their names, are not read, and pass through ``without_repeats``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text import string_column


@dataclass(frozen=True)
class Chunking:
    """Chunks have at least ``least`` bytes, on average ``2 ** bits`` more, and never over ``most``."""

    least: int = 16
    bits: int = 4
    most: int = 512
    #: Words a span of duplicate chunks must have; the passage around it is longer by parts of two chunks.
    min_words: int = 25
    #: Characters of three or more UTF-8 bytes that do as well, for scripts without spaces.
    min_wide: int = 75
    seed: int = 20


def gear_table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear_hash(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """After every byte the rolling sum of its last 32 gear values, each shifted by its age; by doubling."""
    h, span = table[data], 1
    while span < 32:
        older = np.zeros_like(h)
        older[span:] = h[:-span] if len(h) > span else 0
        h = h + (older << np.uint32(span))
        span *= 2
    return h


def chunk_ends(raw: bytes, options: Chunking, table: np.ndarray) -> list[int]:
    """Where the chunks of a text end."""
    if not raw:
        return []
    h = gear_hash(np.frombuffer(raw, np.uint8), table)
    # the hash's high bits see the most bytes
    ready = (np.flatnonzero(h >> np.uint32(32 - options.bits) == 0) + 1).tolist()
    ends, last = [], 0
    for end in [*ready, len(raw)]:
        while end - last > options.most:
            last += options.most
            ends.append(last)
        if end - last >= options.least:
            ends.append(end)
            last = end
    if last < len(raw):
        ends.append(len(raw))
    return ends


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.pmod(F.xxhash64("text"), F.lit(1 << 24)).cast("int").alias("text_no"), "text")


def chunks(docs: DataFrame, options: Chunking = Chunking()) -> DataFrame:
    """``(doc_id, text_no, start, length, words, wide, digest)``: the chunks of every text, in bytes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = gear_table(options.seed)
        space = np.zeros(256, bool)
        space[[9, 10, 11, 12, 13, 32]] = True
        # first bytes of UTF-8 sequences of three or four bytes: alphabets with spaces have mostly two
        first = np.arange(256) >= 0xE0
        for batch in batches:
            ids, numbers, starts, lengths, words, wide, digests = [], [], [], [], [], [], []
            for doc_id, text_no, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), string_column(batch, "text")):
                raw = (text or "").encode("utf-8", "replace")
                ends = chunk_ends(raw, options, table)
                if not ends or doc_id is None:
                    continue
                begins = [0, *ends[:-1]]
                data = np.frombuffer(raw, np.uint8)
                gaps, wides = (np.concatenate([[0], np.cumsum(of[data])]) for of in (space, first))
                b, e = np.array(begins), np.array(ends)
                ids.append(np.full(len(e), doc_id))
                numbers.append(np.full(len(e), text_no))
                starts.append(b)
                lengths.append(e - b)
                words.append(gaps[e] - gaps[b])
                wide.append(wides[e] - wides[b])
                digests.append(np.array([xxhash.xxh3_64_intdigest(raw[i:j]) for i, j in zip(begins, ends)], np.uint64).view(np.int64))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), t) for x, t in ((ids, pa.int64()), (numbers, pa.int32()), (starts, pa.int32()), (lengths, pa.int32()), (words, pa.int32()), (wide, pa.int32()), (digests, pa.int64()))], ["doc_id", "text_no", "start", "length", "words", "wide", "digest"])

    return _numbered(docs).mapInArrow(cut, "doc_id long, text_no int, start int, length int, words int, wide int, digest long")


def repeated_spans(docs: DataFrame, options: Chunking = Chunking(), across_documents: bool = True) -> DataFrame:
    """``(doc_id, text_no, start, length, words, n_chunks, first_doc_id, first_start)``: spans that an earlier place holds too.

    Offsets are UTF-8 bytes. With ``across_documents`` the earlier place is in another document;
    without, a repetition within a document counts as well.
    """
    found = chunks(docs, options)
    place = F.struct("doc_id", "text_no", "start")
    original = found.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    original = original.where(F.col("first") != F.col("last")).select(F.col("digest").alias("_digest"), "first")
    copies = found.join(original, F.col("digest") == F.col("_digest")).where(
        (F.struct("first.doc_id", "first.text_no") < F.struct("doc_id", "text_no")) if across_documents else (F.col("first") != place)
    )
    key = ["doc_id", "text_no"]
    copies = copies.select(*key, "start", "length", "words", "wide", F.col("first.doc_id").alias("first_doc_id"), F.col("first.start").alias("first_start")).dropDuplicates([*key, "start"])
    in_order = Window.partitionBy(*key).orderBy("start")
    begins = F.coalesce((F.lag(F.col("start") + F.col("length")).over(in_order) != F.col("start")).cast("int"), F.lit(1))
    spans = copies.withColumn("begins", begins).withColumn("span", F.sum("begins").over(in_order))
    return (
        spans.groupBy(*key, "span")
        .agg(
            F.min("start").alias("start"), F.sum("length").alias("length"), F.sum("words").alias("words"), F.sum("wide").alias("wide"), F.count("*").alias("n_chunks"),
            F.min(F.struct("start", "first_doc_id", "first_start")).alias("f"),
        )
        .where((F.col("words") >= options.min_words) | (F.col("wide") >= options.min_wide))
        .select(*key, "start", "length", "words", "n_chunks", "f.first_doc_id", "f.first_start")
    )


def without_repeats(docs: DataFrame, options: Chunking = Chunking(), across_documents: bool = True) -> DataFrame:
    """``docs`` with the repeated spans cut out of ``text``."""
    spans = repeated_spans(docs, options, across_documents).groupBy(F.col("doc_id").alias("span_id"), F.col("text_no").alias("span_no")).agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("spans"))
    rows = docs.select(F.struct("*").alias("document"), F.col("doc_id").cast("long").alias("id"), F.pmod(F.xxhash64("text"), F.lit(1 << 24)).cast("int").alias("text_no"))
    joined = rows.join(spans, (F.col("id") == F.col("span_id")) & (F.col("text_no") == F.col("span_no")), "left").select("document", "spans")
    columns, schema = docs.columns, docs.schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = batch.column(0).flatten()
            at = columns.index("text")
            texts = []
            for text, spans in zip(arrays[at].to_pylist(), batch.column(1).to_pylist()):
                if text and spans:
                    raw, kept, begin = text.encode("utf-8", "replace"), [], 0
                    for s in spans:
                        kept.append(raw[begin : s["start"]])
                        begin = s["start"] + s["length"]
                    text = b"".join([*kept, raw[begin:]]).decode("utf-8", "ignore")
                texts.append(text)
            arrays[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, columns)

    return joined.mapInArrow(cut, schema)
