"""SentencePiece encoding and decoding by a table of distinct chunks.

The library puts a mark before a text, turns every space into a mark and then joins symbols into
pieces. No piece of the vocabulary holds a mark behind another
character, and none holds a line feed, so joins never reach over the start of a run of marks nor over a line feed. A text is
cut there, each distinct chunk of a task is segmented once by the library, and a text's ids are
those of its chunks, taken from the table by position. A model whose pieces do cross is segmented by whole texts, with the same table.

Decoding looks up every id's bytes and joins them: a mark becomes a space, a byte piece its byte, and the mark
that stands before the whole text goes. Ids that this does not cover (control ids, bytes that are no UTF-8) are decoded by the library.

One pass over the texts each, no shuffle; a task keeps at most ``CACHE`` chunks besides those of the texts at hand.

Defined results: a null or empty text has no ids, and no ids decode to an empty text; null ids decode to null; repeated
rows keep their rows; a very long text is a slice of its own, and a chunk is never cut further; a null
doc_id keeps its row; an empty table gives an empty result; other columns are not read. The model must not change characters
(identity normaliser, mark in front), else the encoder raises ValueError; U+2581 in a text is a mark like a space and decodes to a space.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import slices
from .units import MARK, cut_units, piece_ids, pieces_may_be_cut, ranges

#: Chunks in a task's table before it is begun anew.
CACHE = 1_000_000
_PROBE = "Ａ  ﬁ\té ①"
_ENCODERS: dict[str, "ChunkIds"] = {}
_DECODERS: dict[str, "PieceBytes"] = {}


def load_model(path: str):
    """The library's model, which must keep all characters and put a mark in front."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    if model.decode(model.encode(_PROBE)) != _PROBE or not model.id_to_piece(model.encode("a")[0]).startswith(MARK):
        raise ValueError("the model changes characters or puts no mark before a text")
    return model


class ChunkIds:
    """Ids of every distinct chunk that a task has met."""

    def __init__(self, path: str):
        self.model = load_model(path)
        self.cuts, self.mark = pieces_may_be_cut(self.model), self.model.piece_to_id(MARK)
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[str, int] = {}
        self.flat, self.ends = np.empty(0, np.int32), np.zeros(1, np.int64)

    def learn(self, new: list[str]) -> None:
        ids = piece_ids(self.model, self.mark, new)
        self.numbers.update(zip(new, range(len(self.numbers), len(self.numbers) + len(new))))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.flat = np.concatenate([self.flat, np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(sizes.sum()))])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])

    def ids(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's begin (with the end of all)."""
        if len(self.numbers) > CACHE:
            self.forget()
        chunks, places, counts = cut_units(texts, self.cuts)
        self.learn([c for c in chunks if c not in self.numbers])
        number = np.fromiter(map(self.numbers.__getitem__, chunks), np.int64, len(chunks))[places]
        picked, ends = ranges(self.ends[number], self.ends[number + 1] - self.ends[number])
        return self.flat[picked], ends[np.concatenate([[0], np.cumsum(counts)])]


class PieceBytes:
    """The bytes of every id."""

    def __init__(self, path: str):
        self.model = load_model(path)
        n = self.model.vocab_size()
        self.bytes = [piece_bytes(self.model, k) for k in range(n)]
        self.own = np.array([self.model.is_control(k) or self.model.is_unknown(k) for k in range(n)])
        self.marked = np.array([not self.model.is_byte(k) and self.model.id_to_piece(k).startswith(MARK) for k in range(n)])

    def text(self, ids: np.ndarray) -> str:
        if not len(ids):
            return ""
        if not self.own[ids].any():
            try:
                return b"".join(map(self.bytes.__getitem__, ids.tolist()))[int(self.marked[ids[0]]) :].decode()
            except UnicodeDecodeError:
                pass
        return self.model.decode(ids.tolist())


def piece_bytes(model, k: int) -> bytes:
    piece = model.id_to_piece(k)
    return bytes([int(piece[3:5], 16)]) if model.is_byte(k) else piece.replace(MARK, " ").encode()


def encode_texts(docs: DataFrame, model_path: str) -> DataFrame:
    """``(doc_id, ids array<int>)`` per row, exactly as the library encodes the whole text without begin or end ids."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model_path not in _ENCODERS:
            _ENCODERS[model_path] = ChunkIds(model_path)
        for batch in batches:
            texts = batch.column(1)
            for first, last in slices(texts):
                ids, ends = _ENCODERS[model_path].ids(texts.slice(first, last - first))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), lists], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, model_path: str) -> DataFrame:
    """``(doc_id, ids, text)``: the text that the library decodes from ``ids``."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model_path not in _DECODERS:
            _DECODERS[model_path] = PieceBytes(model_path)
        pieces = _DECODERS[model_path]
        for batch in batches:
            lists = batch.column(1)
            flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            texts = [pieces.text(flat[a:b]) if valid else None for a, b, valid in zip(ends[:-1].tolist(), ends[1:].tolist(), lists.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(decode, "doc_id long, ids array<int>, text string")
