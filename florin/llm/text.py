"""Words, shingles and small numpy helpers shared by the text operators.

A word is a run of letters and digits in lower case; white space and ASCII
punctuation separate words, and every character beyond ASCII counts as a letter. Words are hashed
for whole lists of texts at once. Everything runs inside Spark tasks, over a bounded
number of characters at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

SHINGLE = 5
#: Characters that are hashed together; bounds a task's working arrays.
SLICE = 1 << 19
_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_INSIDE = np.array([bool(_WORD.fullmatch(bytes([b]))) for b in range(256)])
_BYTES = np.random.default_rng(5).integers(0, 1 << 64, 256, dtype=np.uint64)
_POWERS = np.cumprod(np.full(1024, _MUL, np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values evenly."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    """The words themselves, as UTF-8."""
    return _WORD.findall((text or "").lower().encode("utf-8", "replace"))


def _hash_slice(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words of the parts, how many each part has, and the words' bytes."""
    global _POWERS
    data = np.frombuffer(b" ".join([*parts, b""]), np.uint8)
    inside = _INSIDE[data]
    change = np.diff(inside.view(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    begins = np.cumsum([0, *(len(p) + 1 for p in parts)])
    counts = np.diff(np.searchsorted(starts, begins))
    if not len(starts):
        return np.empty(0, np.uint64), counts, np.empty(0, np.int64)
    lengths = ends - starts
    if (longest := int(lengths.max())) > len(_POWERS):
        _POWERS = np.cumprod(np.full(2 * longest, _MUL, np.uint64))
    first = np.cumsum(lengths) - lengths
    place = np.arange(first[-1] + lengths[-1]) - np.repeat(first, lengths)
    return mix(np.add.reduceat(_BYTES[data[inside]] * _POWERS[place], first)), counts, lengths


def _parts(text: str | None) -> Iterator[bytes]:
    """A text's bytes, cut between words if it is very long."""
    raw = (text or "").lower().encode("utf-8", "replace")
    while len(raw) > 2 * SLICE:
        cut = raw.find(b" ", SLICE)
        if cut < 0:
            break
        yield raw[:cut]
        raw = raw[cut + 1 :]
    yield raw


def word_hashes_of(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of neighbouring texts: the hashes of their words, and how many words each text has."""
    return ((hashes, counts) for hashes, counts, _ in measured_words_of(texts))


def measured_words_of(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """As word_hashes_of, and the words' lengths in bytes."""
    parts: list[bytes] = []
    owners: list[int] = []
    size = first = 0

    def done(last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        hashes, counts, lengths = _hash_slice(parts)
        total = np.zeros(last - first, np.int64)
        np.add.at(total, np.array(owners, np.int64) - first, counts)
        parts.clear(), owners.clear()
        return hashes, total, lengths

    for k, text in enumerate(texts):
        for part in _parts(text):
            parts.append(part)
            owners.append(k)
            size += len(part) + 1
        if size >= SLICE:
            yield done(k + 1)
            first, size = k + 1, 0
    if parts:
        yield done(len(texts))


def word_hashes(texts: list[str | None]) -> Iterator[np.ndarray]:
    """Hashes of the words of every text, in order."""
    for hashes, counts in word_hashes_of(texts):
        ends = np.cumsum(counts)
        for begin, end in zip((ends - counts).tolist(), ends.tolist()):
            yield hashes[begin:end]


def shingle_sequence(hashes: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """One 64-bit value per run of n words; a text of fewer words has none."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    m = len(hashes) - n + 1
    out = hashes[:m].copy()
    for k in range(1, n):
        out *= _MUL
        out ^= out >> np.uint64(29)
        out += hashes[k : k + m]
    return mix(out)


def shingle_sets(texts: list[str | None], n: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct shingles of every text. A text of 1 to n - 1 words has one shingle: all its words."""
    for hashes in word_hashes(texts):
        yield shingle_sequence(hashes, len(hashes)) if 0 < len(hashes) < n else np.unique(shingle_sequence(hashes, n))


class WordTable(dict):
    """Raw word -> a number in order of first sight; ``new`` has the words numbered since they were last taken."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number

    def numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def take_new(self) -> list[str]:
        new, self.new = self.new, []
        return new


def string_column(batch, name: str) -> list[str | None]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()
