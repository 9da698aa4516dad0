"""Packing: shortest-pack-first over the length histogram.

Documents are tokenized, closed with an end id and cut every ``max_len`` ids. Only the
histogram of piece lengths, at most ``max_len`` rows, reaches the driver. There the lengths are
placed longest first: each goes to the packs with the most room, and what
changes is the count of a packing pattern, not a pack. The pattern table has
at most a few entries per length whatever the corpus holds. Pieces find their
slot by their rank among pieces of equal length.

Ranks need no task to see all pieces of one length: pieces are dealt by
(length, salt), ranked there, and shifted by a prefix sum over the salts' counts.

Defined results: a null text is an empty text, whose only id is the end id;
repeated rows are packed each, and ties between pieces of one length are broken by doc_id, start and checksum; a
very long text is cut into pieces in one task, a slice of its own; a null doc_id is packed as such; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import itertools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spark import materialise

MAX_LEN = 2048
END_ID = 1
SALTS = 4096
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
WORD_CACHE = 1_000_000
#: Bytes of text that are split into words together.
SLICE_BYTES = 8 << 20
#: Where a letter or digit ends before punctuation. Only letters whose lower case is one letter are named, and no character that a combining mark could join across the cut.
CUT = r"([0-9A-Za-zÀ-ÖØ-öø-ÿ])([!-/:-@\[-`{-~])"
_TOKENIZERS: dict[str, "WordIds"] = {}


class WordIds:
    """The ids of every word, kept across the texts of a task.

    The vocabulary's rules never join characters across white space, nor a Latin letter or digit with
    ASCII punctuation behind it, so a text's ids are those of its words cut there.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = "|".join(re.escape(token.content) for token in self.tokenizer.get_added_tokens_decoder().values()) or r"\z."
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[str, int] = {}
        self.flat, self.ends = np.empty(0, "<u4"), np.zeros(1, np.int64)

    def learn(self, new: list[str]) -> None:
        """Number new words and keep their ids; words of ASCII letters skip the rules that change nothing in them."""
        plain, model = {}, self.tokenizer.model
        for word in new:
            if word.isascii() and word.isalpha():
                plain[word.lower()] = None
        for word in plain:
            plain[word] = [token.id for token in model.tokenize(word)]
        other = [word for word in new if not (word.isascii() and word.isalpha())]
        made = dict(zip(other, (encoded.ids for encoded in self.tokenizer.encode_batch(other, add_special_tokens=False))))
        ids = [made[word] if word in made else plain[word.lower()] for word in new]
        self.numbers.update(zip(new, range(len(self.numbers), len(self.numbers) + len(new))))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.flat = np.concatenate([self.flat, np.fromiter(itertools.chain.from_iterable(ids), "<u4", int(sizes.sum()))])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])

    def ids(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each text has."""
        if len(self.numbers) > WORD_CACHE:
            self.forget()
        texts = pc.fill_null(texts, "")
        # the name of a special token has punctuation inside
        cut = pc.if_else(pc.match_substring_regex(texts, self.special), texts, pc.replace_substring_regex(texts, CUT, r"\1 \2"))
        lists = pc.split_pattern(pc.replace_substring(cut, "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        self.learn([word for word in words if word not in self.numbers])
        number = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))[coded.indices.to_numpy()]
        starts, sizes = self.ends[number], self.ends[number + 1] - self.ends[number]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        flat = self.flat[np.arange(ends[-1]) + np.repeat(starts - ends[:-1], sizes)]
        per_text = ends[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])]
        return flat, np.diff(per_text)


def _tokens(path: str) -> WordIds:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordIds(path)
    return _TOKENIZERS[path]


def slices(texts: pa.StringArray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of neighbouring texts of about ``most`` bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64))
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most, side="right"))
        last = max(first + 1, last)
        yield first, last
        first = last


def pieces(docs: DataFrame, tokenizer_path: str, max_len: int = MAX_LEN, end_id: int = END_ID) -> DataFrame:
    """Every document cut into pieces of at most ``max_len`` ids, with a checksum of each piece's ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _tokens(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            for first, last in slices(texts):
                doc_ids = batch.column(0).slice(first, last - first).to_pylist()
                flat, counts = words.ids(texts.slice(first, last - first))
                raw, at, rows = flat.tobytes(), 0, []
                for doc_id, n in zip(doc_ids, counts.tolist()):
                    ids = raw[4 * at : 4 * (at + n)] + end
                    at += n
                    for start in range(0, n + 1, max_len):
                        length = min(max_len, n + 1 - start)
                        rows.append((doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n + 1))
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def packing_patterns(histogram: dict[int, int], max_len: int = MAX_LEN) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(packs, [(length, times), ...])]: shortest-pack-first, longest lengths placed first."""
    by_room: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    most = max_len
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        room = max_len
        while left > 0:
            while room >= length and not by_room.get(room):
                room -= 1
            if room < length:  # no pack has room: open new ones, several to a pack where they fit
                times = max(1, min(most // length, left)) if length * 2 <= max_len else 1
                packs = left // times
                by_room.setdefault(max_len - times * length, []).append((packs, [(length, times)]))
                left -= packs * times
                room = max_len
                continue
            packs, inside = by_room[room].pop()
            times = max(1, min(room // length, left // packs)) if left >= packs else 1
            used = min(packs, left // times)
            if used < packs:
                by_room[room].append((packs - used, inside))
            by_room.setdefault(room - times * length, []).append((used, [*inside, (length, times)]))
            left -= used * times
    return [x for room in sorted(by_room) for x in by_room[room]]


def slot_table(patterns: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """Per pattern and length: the ranks it takes, its first sequence and its offset, sorted by (length, rank)."""
    rows, taken, sequence = [], {}, 0
    for packs, inside in patterns:
        offset = 0
        for length, times in inside:
            rank = taken.get(length, 0)
            rows.append((length, rank, packs, sequence, offset))
            taken[length] = rank + packs * times
            offset += length * times
        sequence += packs
    rows.sort()
    return dict(zip(("length", "rank", "packs", "sequence", "offset"), np.array(rows, np.int64).reshape(-1, 5).T))


def pack(docs: DataFrame, tokenizer_path: str, max_len: int = MAX_LEN, end_id: int = END_ID) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; the pieces of a sequence lie gapless from 0."""
    cut = materialise(pieces(docs, tokenizer_path, max_len, end_id))
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most max_len rows
    table = slot_table(packing_patterns(histogram, max_len))
    keys = (table["length"] << 40) + table["rank"]

    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(SALTS)).cast("int"))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).drop("n")
    ranked = salted.withColumn("local", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")) - 1)
    ranked = ranked.join(before, ["length", "salt"]).withColumn("rank", F.col("local") + F.col("before"))

    @F.pandas_udf("sequence_id long, offset long")
    def slot(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        length, rank = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        k = np.searchsorted(keys, (length << 40) + rank, side="right") - 1
        local = rank - table["rank"][k]
        packs = table["packs"][k]
        return pd.DataFrame({"sequence_id": table["sequence"][k] + local % packs, "offset": table["offset"][k] + local // packs * length})

    placed = ranked.withColumn("slot", slot("length", "rank"))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "slot.sequence_id", "slot.offset")
