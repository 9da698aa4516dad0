"""Token counts under a unigram model, by dynamic programming over a trie.

A text is cut at white space into pre-tokens, each with the word mark in front. The tokens of
a pre-token are its best segmentation into vocabulary pieces: the one with
the largest sum of unigram log-probabilities, the fewest tokens on ties. The
pieces come from a public vocabulary file whose order is their frequency order; their
log-probabilities follow from their ranks by Zipf's law, so nothing is trained. A
character that no piece covers falls back to its UTF-8 bytes.

A task inserts the distinct pre-tokens of a batch into a trie, which is kept
implicitly: in sorted order the pre-tokens with a common prefix are neighbours. Level by level, every
distinct prefix gets its forward score and count once, from its ancestors and the
pieces that end there; where a pre-token ends, the count is stored.
Documents then add up stored counts. One pass, no shuffle.

Defined results: a null or blank text has 0 tokens; repeated rows are counted each;
very long pre-tokens are cut nowhere and scored by themselves; of segmentations with equal scores the one with the fewest tokens counts; a null
doc_id keeps its row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import string_column

WORD_MARK = "▁"
#: Log-probability of a fallback byte, below that of every piece.
BYTE_SCORE = -25.0
CACHE = 1_000_000
#: Characters of a pre-token from which it is scored by itself: so long ones share few prefixes, and a trie level of one node is slow.
LONG = 200
_BASE = np.uint64(0x100000001B3)
_MODELS: dict[str, "UnigramCounts"] = {}


def zipf_scores(pieces: list[str]) -> dict[str, float]:
    """Piece -> log-probability, by its place in the list."""
    norm = np.log(sum(1.0 / r for r in range(1, len(pieces) + 1)))
    return {p: float(-np.log(r) - norm) for r, p in reversed(list(enumerate(pieces, 1)))}


def vocabulary(path: str) -> list[str]:
    """The pieces of a vocabulary file in rank order, without control, unknown and byte pieces."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


def _codes(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")


def _hash(codes: np.ndarray) -> int:
    value = 0
    for c in codes.tolist():
        value = (value * int(_BASE) + c + 1) & 0xFFFFFFFFFFFFFFFF
    return value


class UnigramCounts(dict):
    """Pre-token (without its mark) -> number of tokens; learns batches of new ones."""

    def __init__(self, pieces: list[str]):
        scores = self.scores = zipf_scores(pieces)
        by_length: dict[int, list[tuple[int, float]]] = {}
        for piece, score in scores.items():
            by_length.setdefault(len(piece), []).append((_hash(_codes([piece])), score))
        self.tables = {}
        for length, rows in by_length.items():
            rows.sort()
            self.tables[length] = (np.array([h for h, _ in rows], np.uint64), np.array([s for _, s in rows]))
        self.longest = max(self.tables, default=1)

    def learn(self, words: list[str]) -> None:
        short = [w for w in words if len(w) < LONG]
        self.update(zip(*self.count([WORD_MARK + w for w in short], short)))
        self.update((w, self.count_long(WORD_MARK + w)) for w in words if len(w) >= LONG)

    def count_long(self, marked: str) -> int:
        """The forward scores of one pre-token, in time proportional to its length."""
        best, count = [0.0], [0]
        for end in range(1, len(marked) + 1):
            code = ord(marked[end - 1])
            size = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
            score = self.scores.get(marked[end - 1])
            top, tokens = (best[-1] + score, count[-1] + 1) if score is not None else (best[-1] + BYTE_SCORE * size, count[-1] + size)
            for begin in range(max(0, end - self.longest), end - 1):
                score = self.scores.get(marked[begin:end])
                if score is not None and ((total := best[begin] + score) > top or (total == top and count[begin] + 1 < tokens)):
                    top, tokens = total, count[begin] + 1
            best.append(top), count.append(tokens)
        return count[-1]

    def count(self, marked: list[str], keys: list[str]) -> tuple[list[str], list[int]]:
        """Forward scores over the trie of ``marked``; returns the keys with their terminal counts."""
        order = sorted(range(len(marked)), key=marked.__getitem__)
        marked = [marked[k] for k in order]
        flat, lengths = _codes(marked), np.fromiter(map(len, marked), np.int64, len(marked))
        offsets = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        terminal = np.zeros(len(marked), np.int64)
        # per depth of the last `longest` ones: prefix hash, score, count of every word's node
        n = len(marked)
        alive = np.arange(n)
        levels = [(alive, np.zeros(n, np.uint64), np.zeros(n), np.zeros(n, np.int64))]  # of the root, by word
        powers = [np.uint64(pow(int(_BASE), k, 1 << 64)) for k in range(self.longest + 1)]
        depth = 0
        while len(alive):
            depth += 1
            alive = alive[lengths[alive] >= depth]
            if not len(alive):
                break
            last = levels[-1]
            back = lambda level: np.searchsorted(level[0], alive)  # noqa: E731  alive words are in every earlier level
            code = flat[offsets[alive] + depth - 1]
            prefix = last[1][back(last)] * _BASE + code.astype(np.uint64) + np.uint64(1)
            # one node per distinct prefix: words with equal prefixes are neighbours
            first = np.concatenate([[True], prefix[1:] != prefix[:-1]])
            node = np.cumsum(first) - 1
            heads = np.flatnonzero(first)
            best, count = np.full(len(heads), -np.inf), np.zeros(len(heads), np.int64)
            for length in range(1, min(depth, self.longest) + 1):
                if length not in self.tables and length > 1:
                    continue
                level = levels[-length]
                at = np.searchsorted(level[0], alive[heads])
                hashes, scores = self.tables.get(length, (np.empty(0, np.uint64), np.empty(0)))
                wanted = prefix[heads] - level[1][at] * powers[length]
                k = np.minimum(np.searchsorted(hashes, wanted), max(0, len(hashes) - 1))
                known = hashes[k] == wanted if len(hashes) else np.zeros(len(heads), bool)
                piece, tokens = np.where(known, scores[k] if len(hashes) else 0.0, -np.inf), np.ones(len(heads), np.int64)
                if length == 1:
                    c = code[heads]
                    size = 1 + (c > 0x7F).astype(np.int64) + (c > 0x7FF) + (c > 0xFFFF)
                    piece, tokens = np.where(known, piece, BYTE_SCORE * size), np.where(known, 1, size)
                total, tokens = level[2][at] + piece, level[3][at] + tokens
                better = (total > best) | ((total == best) & (tokens < count))
                best, count = np.where(better, total, best), np.where(better, tokens, count)
            levels.append((alive, prefix, best[node], count[node]))
            if len(levels) > self.longest:
                levels.pop(0)
            ends = lengths[alive] == depth
            terminal[alive[ends]] = count[node][ends]
        return [keys[k] for k in order], terminal.tolist()


def _model(path: str) -> UnigramCounts:
    if path not in _MODELS:
        _MODELS[path] = UnigramCounts(vocabulary(path))
    return _MODELS[path]


def token_counts(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """``(doc_id, n_pretokens, n_tokens)`` per row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(vocabulary_path)
        for batch in batches:
            texts = string_column(batch, "text")
            sizes, totals = [0] * len(texts), [0] * len(texts)
            begin = 0
            while begin < len(texts):
                # as many texts as bring a bounded number of new pre-tokens
                new: set[str] = set()
                end = begin
                while end < len(texts) and (end == begin or len(new) < CACHE // 8):
                    new.update(w for w in set((texts[end] or "").split()) if w not in model)
                    end += 1
                if len(model) + len(new) > CACHE:
                    model.clear()
                    new = {w for t in texts[begin:end] for w in (t or "").split()}
                if new:
                    model.learn(list(new))
                for k in range(begin, end):
                    words = (texts[k] or "").split()
                    sizes[k], totals[k] = len(words), sum(map(model.__getitem__, words))
                begin = end
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64())], ["doc_id", "n_pretokens", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "doc_id long, n_pretokens long, n_tokens long")
