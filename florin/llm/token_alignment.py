"""Cross-tokenizer alignment with an inverted index of pair bitmaps.

A text behind a space is tokenized twice, by a byte-level BPE (A) and by a marked piece vocabulary (B). Places where a
token of both ends cut the bytes into groups; the two tokens that end there are linked. Texts are
cut into units that both tokenizers treat alone; a task aligns every distinct unit once.

Documents are numbered inside blocks of at most ``BLOCK`` documents and about 4 MB of text. A block holds for every linked pair of ids one
bitmap of its documents per binary digit of the links per document: the planes. A plane of few documents is a list of their
numbers, a fuller one is ``BLOCK`` bits. Planes OR-ed together are the pair's documents, and their population count is the pair's document count;
2^k times the population count of plane k, summed, is its link count. Blocks hold different documents, so what is shuffled to be merged per pair is counts,
never a bitmap of the whole corpus, and a pair in all documents is one short row per block. The corpus-wide counts go back to the blocks of
their pairs, where the bitmaps are the postings from which every document's scores are added up.

Blocks are written once, as Parquet in the shared folder. Per block and pair one row of numbers is shuffled three times (to be summed,
to meet its sum, back to its block), and the blocks once. A join splits pairs that occur in very many blocks (adaptive execution); the highest count of a B id
is over at most one row per id of A.

Defined results: a text that is null, empty, or that a tokenizer's bytes do not give back (one that holds U+2581, the mark) has no tokens, and its row
holds zeros and an empty digest; repeated rows and repeated or null doc_ids keep their rows, for documents are told apart by their place; a very long text is a block of
its own; of several pairs with the highest count of a B id all are best; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .packing import slices
from .piece_codec import load_model, piece_bytes
from .spark import shared_folder
from .units import MARK, cut_units, piece_ids, pieces_may_be_cut, ranges

#: Documents in a block, a power of two, and bytes of text from which a block is full.
BLOCK = 4096
BLOCK_BYTES = 4 << 20
#: Documents from which a plane is written as bits.
DENSE = BLOCK // 16
CACHE = 200_000
#: Units that the libraries take at once.
STEP = 20_000
DOCUMENT = "doc_id: bigint, n_a: bigint, n_b: bigint, n_groups: bigint, n_links: bigint, groups_sha256: string"
BLOCKS = f"block long, docs array<struct<{DOCUMENT}>>, pair array<long>, plane array<byte>, size array<int>, n_docs array<int>, sparse binary, dense binary"
_TABLES: dict[tuple[str, str], "UnitAlignments"] = {}


def byte_level_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable Latin-1 characters stand for themselves, the other bytes for the characters from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}


class UnitAlignments:
    """Every distinct unit of a task, aligned."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), load_model(b_path)
        self.a.encode_special_tokens = True
        alphabet = byte_level_alphabet()
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            self.a_bytes[k] = bytes(alphabet[c] for c in token if c in alphabet)
        self.b_bytes = [piece_bytes(self.b, k) for k in range(self.b.vocab_size())]
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in side]) for side in (self.a_bytes, self.b_bytes))
        self.names = [f"{k}{end}" for end in ",|;" for k in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.cuts, self.mark = pieces_may_be_cut(self.b), self.b.piece_to_id(MARK)
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[str, int] = {}
        self.groups: list[str] = []
        self.tokens = np.empty((0, 2), np.int64)
        self.pairs, self.ends = np.empty(0, np.int64), np.zeros(1, np.int64)

    def learn(self, new: list[str]) -> None:
        for at in range(0, len(new), STEP):
            self._learn(new[at : at + STEP])

    def _learn(self, new: list[str]) -> None:
        """Aligns units, laid one after another, by the places where tokens of both sides end."""
        sides = ([e.ids for e in self.a.encode_batch_fast(new, add_special_tokens=False)], piece_ids(self.b, self.mark, new))
        sizes = [np.fromiter(map(len, ids), np.int64, len(ids)) for ids in sides]
        totals = [np.add.reduceat(np.append(table[np.fromiter(itertools.chain.from_iterable(ids), np.int64, int(n.sum()))], 0), np.cumsum(n) - n) for ids, n, table in zip(sides, sizes, (self.a_sizes, self.b_sizes))]
        whole = (totals[0] == totals[1]) & (totals[0] == [len(u.encode()) for u in new])
        right = [ok and MARK not in u for ok, u in zip(whole.tolist(), new)]  # nothing else changes a text's bytes and keeps their number
        flat, counts, ends = [], [], []
        for side, table in zip(sides, (self.a_sizes, self.b_sizes)):
            ids = [x if ok else [] for x, ok in zip(side, right)]
            counts.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            flat.append(np.fromiter(itertools.chain.from_iterable(ids), np.int64, int(counts[-1].sum())))
            ends.append(np.cumsum(table[flat[-1]]))
        common = np.intersect1d(*ends, assume_unique=True)
        at = [np.searchsorted(e, common) for e in ends]  # the tokens that end there
        unit_ends = np.concatenate([[0], ends[0]])[np.cumsum(counts[0])]
        links = np.diff(np.searchsorted(common, unit_ends, side="right"), prepend=0)
        # every token with what follows its number, in the order of groups, A before B
        end = [np.zeros(len(ids), np.int64) for ids in flat]
        for e, places, kind in zip(end, at, (1, 2)):
            e[places] = kind
        group = [np.searchsorted(common, e) for e in ends]
        order = np.argsort(np.concatenate([2 * group[0], 2 * group[1] + 1]), kind="stable")
        n = len(self.names) // 3
        names = list(map(self.names.__getitem__, np.concatenate([flat[k] + n * end[k] for k in (0, 1)])[order].tolist()))
        stops = np.cumsum(counts[0] + counts[1]).tolist()
        self.groups += ["".join(names[x:y])[:-1] for x, y in itertools.pairwise([0, *stops])]
        self.numbers.update(zip(new, range(len(self.numbers), len(self.numbers) + len(new))))
        self.tokens = np.concatenate([self.tokens, np.stack(counts, axis=1)])
        self.pairs = np.concatenate([self.pairs, flat[0][at[0]] << 32 | flat[1][at[1]]])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(links)])

    def units(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The number of every unit of all texts, and where each text's begin (with the end of all). A text with a unit that is not given back has none."""
        if len(self.numbers) > CACHE:
            self.forget()
        units, places, counts = cut_units(texts, self.cuts)
        self.learn([u for u in units if u not in self.numbers])
        number = np.fromiter(map(self.numbers.__getitem__, units), np.int64, len(units))[places]
        owner = np.repeat(np.arange(len(counts)), counts)
        whole = np.ones(len(counts), bool)
        whole[owner[self.tokens[number, 0] == 0]] = False
        return number[whole[owner]], np.concatenate([[0], np.cumsum(np.where(whole, counts, 0))])


def planes_of(pairs: np.ndarray, docs: np.ndarray) -> dict[str, object]:
    """The bitmaps of one block from its links, a pair's code and a document's number each."""
    keys, times = np.unique(pairs * BLOCK + docs, return_counts=True)
    first = np.diff(keys // BLOCK, prepend=-1) != 0
    codes, own = (keys // BLOCK)[first], np.cumsum(first) - 1
    doc = (keys % BLOCK).astype("<u2")
    entries, members = [], []
    for k in range(int(times.max(initial=0)).bit_length()):
        inside = np.flatnonzero(times >> k & 1)
        entries.append(own[inside] << 8 | k)
        members.append(doc[inside])
    entry, member = np.concatenate([*entries, np.empty(0, np.int64)]), np.concatenate([*members, np.empty(0, "<u2")])
    order = np.argsort(entry, kind="stable")
    entry, member = entry[order], member[order]
    begins = np.flatnonzero(np.diff(entry, prepend=-1))
    size = np.diff(np.append(begins, len(entry)))
    full = np.flatnonzero(size >= DENSE)
    bits = np.zeros((len(full), BLOCK), bool)
    dense = np.repeat(size >= DENSE, size)
    bits[np.repeat(np.arange(len(full)), size[full]), member[dense]] = True
    pair, plane = entry[begins] >> 8, entry[begins] & 255
    n_docs = np.where(np.diff(pair, prepend=-1) != 0, np.bincount(own, minlength=len(codes))[pair], 0)  # of the OR of the planes, once per pair
    return {"pair": codes[pair], "plane": plane.astype(np.int8), "size": size.astype(np.int32), "n_docs": n_docs.astype(np.int32), "sparse": member[~dense].tobytes(), "dense": np.packbits(bits, axis=1).tobytes()}


def blocks_of(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row per block: its documents with what is known without the corpus, and its bitmaps."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (a_path, b_path) not in _TABLES:
            _TABLES[a_path, b_path] = UnitAlignments(a_path, b_path)
        table = _TABLES[a_path, b_path]
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = batch.column(1)
            for first, last in ((x, min(x + BLOCK, end)) for begin, end in slices(texts, BLOCK_BYTES) for x in range(begin, end, BLOCK)):
                units, begins = table.units(texts.slice(first, last - first))
                groups = list(map(table.groups.__getitem__, units.tolist()))
                totals = lambda values: np.diff(np.concatenate([[0], np.cumsum(values)])[begins])  # noqa: E731, B023
                links = totals(table.ends[units + 1] - table.ends[units])
                digests = [hashlib.sha256(";".join(groups[x:y]).encode()).hexdigest() if x < y else "" for x, y in itertools.pairwise(begins.tolist())]
                documents = pa.StructArray.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(totals(table.tokens[units, 0])), pa.array(totals(table.tokens[units, 1])), pa.array(links), pa.array(links), pa.array(digests, pa.string())],
                    ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"],
                )
                picked, _ = ranges(table.ends[units], table.ends[units + 1] - table.ends[units])
                made = planes_of(table.pairs[picked], np.repeat(np.arange(last - first), links))
                whole = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                lists = [whole(pa.array(made[c])) for c in ("pair", "plane", "size", "n_docs")]
                yield pa.RecordBatch.from_arrays([pa.array([block]), whole(documents), *lists, pa.array([made["sparse"]]), pa.array([made["dense"]])], ["block", "docs", "pair", "plane", "size", "n_docs", "sparse", "dense"])
                block += 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(build, BLOCKS)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``(pair, b, n_docs, n_links, best)``: in how many documents a pair is linked, how often, and whether no pair of its B id is linked more often."""
    rows = blocks.select(F.explode(F.arrays_zip("pair", "plane", "size", "n_docs")).alias("x"))
    links = F.col("x.size").cast("long") * F.element_at(F.array(*(F.lit(1 << k) for k in range(63))), F.col("x.plane").cast("int") + 1)
    counted = rows.groupBy(F.col("x.pair").alias("pair")).agg(F.sum("x.n_docs").alias("n_docs"), F.sum(links).alias("n_links"))
    counted = counted.withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF))
    return counted.withColumn("best", F.col("n_links") == F.max("n_links").over(Window.partitionBy("b")))


def linked_pairs(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``(a_id, b_id, n_docs, n_links, best)`` of the corpus."""
    return pair_counts(blocks_of(docs, a_path, b_path)).select(F.shiftright("pair", 32).alias("a_id"), F.col("b").alias("b_id"), "n_docs", "n_links", "best")


def aligned_groups(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``(doc_id, groups)``: the groups themselves, ``a1,a2|b1;a3|b2,b3``; empty without tokens."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (a_path, b_path) not in _TABLES:
            _TABLES[a_path, b_path] = UnitAlignments(a_path, b_path)
        table = _TABLES[a_path, b_path]
        for batch in batches:
            for first, last in slices(batch.column(1), BLOCK_BYTES):
                units, begins = table.units(batch.column(1).slice(first, last - first))
                groups = list(map(table.groups.__getitem__, units.tolist()))
                texts = [";".join(groups[x:y]) for x, y in itertools.pairwise(begins.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(texts, pa.string())], ["doc_id", "groups"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(align, "doc_id long, groups string")


def block_scores(block: dict, place: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Per document of a block the sums of ``values`` (one row per plane's place, several columns) over its links."""
    size, plane = block["size"], block["plane"].astype(np.int64)
    weights = np.zeros((len(size), values.shape[1]), np.int64)
    weights[place] = values
    weights <<= plane[:, None]
    full = size >= DENSE
    out = np.zeros((BLOCK, values.shape[1]), np.int64)
    np.add.at(out, np.frombuffer(block["sparse"], "<u2"), np.repeat(weights[~full], size[~full], axis=0))
    bits = np.unpackbits(np.frombuffer(block["dense"], np.uint8)).reshape(-1, BLOCK)
    for row, w in zip(bits, weights[full]):
        out += row[:, None] * w
    return out


def alignment_scores(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per document ``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)``: ``n_best`` of its links have their B id's highest corpus-wide
    count, and ``count_sum`` is the sum of the counts of all."""
    spark = docs.sparkSession
    path = shared_folder(spark, "alignment")
    blocks_of(docs, a_path, b_path).write.parquet(path)
    blocks = spark.read.parquet(path)
    places = blocks.select("block", F.posexplode("pair").alias("place", "_pair"))
    counts = pair_counts(blocks).select("pair", "n_links", F.col("best").cast("long").alias("best"))
    back = places.join(counts, F.col("_pair") == F.col("pair")).select("block", "place", "n_links", "best")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.column("docs").combine_chunks()
        block = {c: left.column(c)[0].values.to_numpy() if c in ("size", "plane") else left.column(c)[0].as_py() for c in ("size", "plane", "sparse", "dense")}
        values = np.stack([right.column(c).to_numpy() for c in ("best", "n_links")], axis=1)
        sums = block_scores(block, right.column("place").to_numpy(), values)[: len(rows.values)]
        fields = dict(zip(("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"), rows.values.flatten()))
        return pa.table({**{c: fields[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}, "n_best": sums[:, 0], "count_sum": sums[:, 1], "groups_sha256": fields["groups_sha256"]})

    whole = spark.read.parquet(path).select("block", "docs", "plane", "size", "sparse", "dense").groupBy("block")
    out = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return whole.cogroup(back.groupBy("block")).applyInArrow(score, out)
