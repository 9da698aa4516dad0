"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are short and documents long, so a sketch of a whole document says
nothing about an item inside it. Items are partitioned by size into classes of
at most 2^c shingles. For class c a document is seen as overlapping windows of
2 * 2^c shingles, 2^c apart, so that a passage as long as an item lies whole in
some window, and the containment threshold becomes a Jaccard similarity of at
least about 0.2 between item and window. Both are sketched by one-permutation MinHash with
BINS bins: the smallest shingle value of every bin. A window and an item that
agree in one bin are a candidate, which a containment of 0.8 misses with
a probability below 1e-5. Candidates are verified exactly: the share of the
item's distinct word 5-grams that the whole document holds.

A window can only agree with an item if it holds a shingle of the item's sketch,
so windows without any are not sketched; this changes no result.

The search is one pass over the documents without a shuffle. The items go to the
tasks in blocks of bounded size (BLOCK_CHARS characters of text each); a larger
benchmark takes more passes, never a larger broadcast.

An item of fewer than five words has one shingle, of all its words, and is looked up among the document's runs of as many words.

Defined results: null or empty texts, and texts without a word, match nothing; repeated documents each give their own rows, and repeated items
(one item_id and text) one; two texts under one item_id are two items; rows with a
null doc_id or item_id are searched like others; a text that holds an item several times has it once; very long texts are searched whole; an empty table of either kind gives no match; other columns,
whatever their names, are not read, and pass through ``drop_contaminated``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import SHINGLE, shingle_sequence, string_column, word_hashes, words_of

BINS = 256
THRESHOLD = 0.8
BLOCK_CHARS = 32_000_000
MATCH_SCHEMA = "doc_id long, item_id long, shared long, item_shingles long, containment double"


def sketch(shingles: np.ndarray) -> np.ndarray:
    """One-permutation MinHash: the smallest value of every bin that has one."""
    shingles = np.unique(shingles)
    _, first = np.unique(shingles % np.uint64(BINS), return_index=True)
    return shingles[first]


def word_grams(text: str | None, n: int = SHINGLE) -> set[tuple[bytes, ...]]:
    words = words_of(text)
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def _among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values are in a sorted table that has at least one."""
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


class ItemIndex:
    """The sketches of one block of items, by size class."""

    def __init__(self, items: list[tuple[int, str | None]], threshold: float):
        self.threshold, self.items = threshold, []
        self.classes: dict[int, dict[int, list[int]]] = {}
        self.short: dict[int, dict[int, list[int]]] = {}
        for (item_id, text), hashes in zip(items, word_hashes([t for _, t in items])):
            shingles = np.unique(shingle_sequence(hashes))
            if len(shingles):
                size_class = int(len(shingles) - 1).bit_length()
                by_value = self.classes.setdefault(size_class, {})
                for value in sketch(shingles).tolist():
                    by_value.setdefault(value, []).append(len(self.items))
                self.items.append((item_id, word_grams(text)))
            elif len(hashes):  # one shingle, of all its words
                self.short.setdefault(len(hashes), {}).setdefault(int(shingle_sequence(hashes, len(hashes))[0]), []).append(len(self.items))
                self.items.append((item_id, word_grams(text, len(hashes))))
        self.short_values = {n: np.array(sorted(v), np.uint64) for n, v in self.short.items()}
        self.values = {c: np.array(sorted(v), np.uint64) for c, v in self.classes.items()}
        self.all_values = np.unique(np.concatenate([*self.values.values(), np.empty(0, np.uint64)]))
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.all_values >> np.uint64(44)).astype(np.int64)] = True

    def candidates(self, sequence: np.ndarray) -> set[int]:
        near = np.flatnonzero(self.filter[(sequence >> np.uint64(44)).astype(np.int64)])
        near = near[_among(sequence[near], self.all_values)] if len(near) else near
        found: set[int] = set()
        for size_class, values in self.values.items() if len(near) else ():
            hits = near[_among(sequence[near], values)]
            stride = 1 << size_class
            for w in np.unique(np.concatenate([hits // stride, hits // stride - 1])).tolist():
                begin = max(0, w * stride)
                for value in sketch(sequence[begin : (w + 2) * stride]).tolist():
                    found.update(self.classes[size_class].get(value, ()))
        return found

    def matches(self, texts: list[str | None]) -> Iterator[list[tuple[int, int, int]]]:
        """Per text (item_id, shared shingles, shingles of the item) for every item that it contains."""
        for text, hashes in zip(texts, word_hashes(texts)):
            candidates, out = self.candidates(shingle_sequence(hashes)), []
            grams = word_grams(text) if candidates else set()
            for n, values in self.short_values.items():
                runs = shingle_sequence(hashes, n)
                found = {k for value in np.unique(runs[_among(runs, values)]).tolist() for k in self.short[n][value]}
                if found:
                    candidates |= found
                    grams |= word_grams(text, n)
            for k in sorted(candidates):
                item_id, wanted = self.items[k]
                shared = len(wanted & grams)
                if shared >= self.threshold * len(wanted) - 1e-9:
                    out.append((item_id, shared, len(wanted)))
            yield out


def _item_blocks(benchmark: DataFrame, threshold: float) -> Iterator:
    """Broadcast item indexes, each over a bounded amount of text."""
    items = benchmark.select("item_id", "text").where(F.col("text").isNotNull()).distinct()
    context = benchmark.sparkSession.sparkContext
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = int(-(-chars // BLOCK_CHARS)) or 1
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        yield context.broadcast(ItemIndex([tuple(r) for r in block.collect()], threshold))


def contained_items(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document and test item whose shingles the document holds to ``threshold`` or more."""
    found = None
    for index in _item_blocks(benchmark, threshold):
        def search(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(d, i, s, n, s / n) for d, found in zip(batch.column(0).to_pylist(), index.value.matches(string_column(batch, "text"))) for i, s, n in found]
                columns = list(zip(*rows)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.float64()])], ["doc_id", "item_id", "shared", "item_shingles", "containment"])

        part = docs.select("doc_id", "text").mapInArrow(search, MATCH_SCHEMA)
        found = part if found is None else found.union(part)
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that contain no test item; all columns, one pass per block, no shuffle."""
    for index in _item_blocks(benchmark, threshold):
        def clean(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not found for found in index.value.matches(string_column(batch, "text"))], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
