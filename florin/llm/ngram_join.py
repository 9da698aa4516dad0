"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of word 5-grams; two documents are linked if the Jaccard similarity of
their sets is ``threshold`` or more. Documents with equal sets form a class and are compared
once. The steps:

1. One-permutation MinHash of every class: BINS values, densified for the bands.
   Classes that agree in a band of ROWS values share a bucket; a pair at the threshold shares
   none of the BANDS buckets with a probability of 3e-6.
2. Classes that share a bucket meet in one unit of work: blocks of classes around a common lowest neighbour,
   and pairs of such blocks only where a bucket spans them (see ``comparison_units``). A chain of texts that
   are alike only from one to the next costs work in proportion to its length.
3. Inside a unit the MinHash values of each pair are compared STEP at a time; a pair is dropped when the
   posterior probability that its similarity reaches the threshold, after m agreements
   in n bins and a uniform prior, falls below ``tolerance``. The rest is verified on
   the whole sets.
4. Links are counted per class and connected into classes of near duplicates.

A unit holds at most ``limit`` bytes of text on either side, unless one text alone is longer, and returns one row per member: a spanning forest
and counts, never pairs. The work inside a family of *different* near copies grows with the square of
its size over the number of tasks, because every link is counted. Copies of one text, however many, are one member.

Defined results: a null text or one without words has no shingles and no links; a text of one to four
words has one shingle, all its words; a repeated row counts as a copy; rows with one doc_id and different texts are
told apart by ``text_key`` and linked each by its own; ties in a class go to the lowest (doc_id, text_key); a null doc_id has a null class and no
links; a very long text is compared whole; an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark import UNIT, comparison_units, connected_groups, materialise, rows_by_unit
from .text import mix, shingle_sets, string_column

BANDS, ROWS = 32, 5
BINS = BANDS * ROWS
#: Weight of a short text in a block; bounds the number of texts that are compared at once.
LEAST_BYTES = 16 << 10
STEP = 32
_PROBES = np.random.default_rng(11).integers(0, BINS, (BINS, 48))
_BOUNDS = np.array([(b << 64) // BINS + (b > 0) for b in range(BINS)], np.uint64)


@dataclass(frozen=True)
class JoinOptions:
    threshold: float = 0.8
    tolerance: float = 1e-6
    #: Bytes of text, and LEAST_BYTES at least for each one, that one block of a unit may hold.
    limit: int = 16 << 20


def minhash(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, filled): the smallest value of every bin of a sorted set."""
    first = np.searchsorted(shingles, _BOUNDS)
    filled = first < np.append(first[1:], len(shingles))
    return np.where(filled, shingles[np.minimum(first, len(shingles) - 1)], np.uint64(0)), filled


def band_keys(values: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """One key per band; an empty bin borrows the value of a filled one that its own probes find first."""
    empty = np.flatnonzero(~filled)
    if len(empty):
        probes = _PROBES[empty]
        hit = filled[probes]
        source = probes[np.arange(len(empty)), hit.argmax(axis=1)]
        values = values.copy()
        values[empty] = values[np.where(hit.any(axis=1), source, np.flatnonzero(filled)[0])]
    rows = values.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return key.view(np.int64)


def set_digest(shingles: np.ndarray) -> tuple[int, int]:
    raw = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def signatures(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_key, size, d1, d2, keys)``: digest of the shingle set and band keys; nulls for a text without words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            high, low, keys = [], [], []
            for shingles in shingle_sets(string_column(batch, "text")):
                if len(shingles):
                    d1, d2 = set_digest(shingles)
                    high.append(d1), low.append(d2), keys.append(band_keys(*minhash(shingles)))
                else:
                    high.append(None), low.append(None), keys.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "text_key", "size", "d1", "d2", "keys"])

    return identified(docs).select("doc_id", "text_key", F.octet_length("text").alias("size"), "text").mapInArrow(sign, "doc_id long, text_key long, size int, d1 long, d2 long, keys array<long>")


def identified(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_key, text)``: rows of one doc_id with different texts are told apart by a hash of the text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")


def least_agreements(threshold: float, tolerance: float) -> np.ndarray:
    """Per number n of compared bins the fewest agreements that keep a pair.

    After m agreements in n and a uniform prior the similarity is Beta(m + 1, n - m + 1), and
    its chance to reach t is that of at most m successes in n + 1 trials of probability t.
    """
    least = np.zeros(BINS + 1, np.int64)
    for n in range(BINS + 1):
        chance, m = 0.0, -1
        while chance < tolerance:
            m += 1
            chance += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        least[n] = m
    return least


def surviving_pairs(left: np.ndarray, left_filled: np.ndarray, right: np.ndarray, right_filled: np.ndarray, sizes: tuple[np.ndarray, np.ndarray], least: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the pairs that incremental comparison doesn't drop. Only bins filled on both sides are compared."""
    small = np.minimum(sizes[0][:, None], sizes[1][None, :])
    large = np.maximum(sizes[0][:, None], sizes[1][None, :])
    alive = small >= threshold * large - 1e-9
    if same:
        alive &= np.tri(len(left), len(right), -1, dtype=bool).T
    i, j = np.nonzero(alive)
    agreed, compared = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
    for begin in range(0, BINS, STEP):
        part = slice(begin, begin + STEP)
        for at in range(0, len(i), 200_000):  # bounded memory
            p = slice(at, at + 200_000)
            both = left_filled[i[p], part] & right_filled[j[p], part]
            compared[p] += both.sum(axis=1)
            agreed[p] += (both & (left[i[p], part] == right[j[p], part])).sum(axis=1)
        keep = agreed >= least[compared]
        i, j, agreed, compared = i[keep], j[keep], agreed[keep], compared[keep]
    return i, j


def linked_pairs(sets: list[np.ndarray], split: int, options: JoinOptions, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs between sets[:split] and sets[split:], or among all sets where split is 0."""
    values, filled = map(np.array, zip(*map(minhash, sets)))
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    a, b = (slice(0, split), slice(split, None)) if split else (slice(None), slice(None))
    i, j = surviving_pairs(values[a], filled[a], values[b], filled[b], (sizes[a], sizes[b]), least, options.threshold, not split)
    if not len(i):
        return i, j
    right = sets[split:]
    every, local = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    begin_right = ends[split - 1] if split else 0
    flat, starts = local[begin_right:], np.concatenate([[0], np.cumsum(sizes[b])[:-1]])
    mark = np.zeros(len(every), np.int32)
    shared = np.zeros(len(i), np.int64)
    cuts = np.searchsorted(i, np.arange(i[0], i[-1] + 2))
    for row, lo, hi in zip(range(i[0], i[-1] + 1), cuts[:-1], cuts[1:]):
        if lo == hi:
            continue
        own = local[ends[row] - sizes[row] : ends[row]]
        mark[own] = 1
        if (hi - lo) * 8 < len(right):
            shared[lo:hi] = [mark[flat[starts[k] : starts[k] + sizes[b][k]]].sum() for k in j[lo:hi]]
        else:
            shared[lo:hi] = np.add.reduceat(mark[flat], starts)[j[lo:hi]]
        mark[own] = 0
    union = sizes[a][i] + sizes[b][j] - shared
    keep = shared >= options.threshold * union - 1e-9
    return i[keep], j[keep] + split


def lowest_reached(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Per node the smallest node of its connected group."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _compare(rows: list[dict], options: JoinOptions, least: np.ndarray) -> list[tuple[int, int, int]]:
    """(node, linked documents, smallest node reached) for the rows of one unit."""
    rows = list({r["node"]: r for r in rows}.values())  # repeated rows of a document
    rows.sort(key=lambda r: (r["side"], r["node"]))
    split = sum(r["side"] == 0 for r in rows) % len(rows)  # 0: all are on side 0 and compared with each other
    sets = list(shingle_sets([r["text"] for r in rows]))
    i, j = linked_pairs(sets, split, options, least) if len(rows) > 1 else (np.empty(0, np.int64),) * 2
    copies, ids = (np.array([r[c] for r in rows], np.int64) for c in ("copies", "node"))
    counts = np.zeros(len(rows), np.int64)
    np.add.at(counts, i, copies[j])
    np.add.at(counts, j, copies[i])
    by_id = np.argsort(ids)
    rank = np.argsort(by_id)
    reached = lowest_reached(len(rows), rank[i], rank[j])[rank]
    return list(zip(ids.tolist(), counts.tolist(), ids[by_id][reached].tolist()))


def near_duplicates(docs: DataFrame, options: JoinOptions = JoinOptions()) -> DataFrame:
    """``(doc_id, text_key, class_id, n_links, n_copies, first)`` per row of ``docs``.

    class_id is the smallest doc_id of the connected group; n_links the number of other
    documents whose similarity with this one is ``threshold`` or more, copies included; n_copies
    the number of other documents with the same shingle set; first tells whether the row is the group's lowest (doc_id, text_key).
    """
    least = least_agreements(options.threshold, options.tolerance)
    signed = materialise(signatures(docs))
    usable = signed.where(F.col("d1").isNotNull() & F.col("doc_id").isNotNull())
    classes = usable.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "text_key", "size")).alias("first"), F.count("*").alias("copies"), F.min("keys").alias("keys"))  # equal sets have equal keys
    classes = materialise(classes.withColumn("node", F.monotonically_increasing_id()))

    buckets = classes.select(F.explode("keys").alias("bucket"), "node")
    weights = classes.select("node", F.greatest(F.col("first.size"), F.lit(LEAST_BYTES)).cast("long").alias("weight"))
    units = comparison_units(buckets, weights, options.limit)
    wanted = units.join(classes.select(F.col("node").alias("_node"), "first", "copies"), F.col("node") == F.col("_node"))
    texts = identified(docs).select(F.col("doc_id").alias("_doc_id"), F.col("text_key").alias("_text_key"), "text")
    work = wanted.join(texts, (F.col("first.doc_id") == F.col("_doc_id")) & (F.col("first.text_key") == F.col("_text_key"))).select("node", *UNIT, "side", "call", "copies", "text")

    def verify(table: pa.Table) -> pa.Table:
        rows = [row for unit in rows_by_unit(table) for row in _compare(unit, options, least)]
        columns = list(zip(*rows)) if rows else [[]] * 3
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["node", "links", "low"])

    found = materialise(work.groupBy("call").applyInArrow(verify, "node long, links long, low long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links")).select(F.col("node").alias("_node"), "links")
    groups = connected_groups(found.where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b"))).select(F.col("node").alias("_member"), "root")
    placed = materialise(
        classes.select("d1", "d2", "copies", "node", F.struct("first.doc_id", "first.text_key").alias("first"))
        .join(links, F.col("node") == F.col("_node"), "left").join(groups, F.col("node") == F.col("_member"), "left")
        .select("d1", "d2", "copies", "first", "root", F.coalesce("links", F.lit(0)).alias("links"))
    )
    lowest = placed.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("first").alias("lowest")).select(F.col("root").alias("_root"), "lowest")
    by_set = placed.join(lowest, F.col("root") == F.col("_root"), "left").select(F.col("d1").alias("_d1"), F.col("d2").alias("_d2"), "copies", F.coalesce("lowest", "first").alias("lowest"), "links")
    return (
        signed.select("doc_id", "text_key", "d1", "d2").join(by_set, (F.col("d1") == F.col("_d1")) & (F.col("d2") == F.col("_d2")) & F.col("doc_id").isNotNull(), "left")
        .select(
            "doc_id", "text_key", F.coalesce("lowest.doc_id", "doc_id").alias("class_id"), F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
            F.coalesce(F.col("copies") - 1, F.lit(0)).cast("long").alias("n_copies"), F.coalesce(F.col("lowest") == F.struct("doc_id", "text_key"), F.lit(True)).alias("first"),
        )
    )
