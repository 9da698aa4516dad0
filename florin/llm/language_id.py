"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of a text in segments of SEGMENT bytes from both
sides, labels every position with a distribution over languages, and the
mean over all positions of the text is the document's distribution. It is trained
in numpy by backpropagation through time, with the document's language as the
target of every position.

Training sees a bounded sample, ``Training.docs_per_language`` documents of each
language and SEGMENTS_PER_DOC segments of each; the sample is drawn by hash from
all rows that may be learned from. Prediction reads every byte of every
text, in one pass without a shuffle; the weights are a few thousand numbers.

Defined results: ``und`` with score 0 for a null text or one without a letter, and for all
texts when there is nothing to learn from; null languages are not learned; repeated rows
are predicted each; a null doc_id keeps its row and is one id when the sample is drawn; of languages with equal scores the first in alphabetical order counts;
very long texts are read whole, segment by segment; an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import string_column

SEGMENT = 64
SEGMENTS_PER_DOC = 4
UNDETERMINED = "und"
#: Segments that are read together; bounds a task's memory.
TOGETHER = 1024


@dataclass(frozen=True)
class Training:
    docs_per_language: int = 500
    hidden: int = 8
    steps: int = 600
    batch: int = 128
    rate: float = 0.01
    seed: int = 7


class ByteNetwork:
    """Arrays are feature-major: (features, segments). Gates in the order update, reset, candidate."""

    def __init__(self, languages: list[str], hidden: int, seed: int):
        rng = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {"out": draw(len(languages), 2 * hidden, scale=0.3), "out_bias": np.zeros((len(languages), 1), np.float32)}
        for side in ("f", "b"):
            self.p[f"in_{side}"] = draw(3 * hidden, 257, scale=0.3)  # byte 256 pads
            self.p[f"rec_{side}"] = draw(3 * hidden, hidden, scale=0.3)

    def _run(self, bytes_: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
        """States after every position, in the order of the text: (positions, hidden, segments).

        A gate is (1 + tanh(a / 2)) / 2; the halves are taken into the weights beforehand.
        """
        H, (B, T) = self.hidden, bytes_.shape
        half = np.ones((3 * H, 1), np.float32)
        half[: 2 * H] = 0.5
        E, U = np.ascontiguousarray((self.p[f"in_{side}"] * half).T), self.p[f"rec_{side}"] * np.float32(0.5)
        states, h = np.empty((T, H, B), np.float32), np.zeros((H, B), np.float32)
        columns = np.ascontiguousarray(bytes_.T)
        rows, x, u, d = np.empty((B, 3 * H), np.float32), np.empty((3 * H, B), np.float32), np.empty((3 * H, B), np.float32), np.empty((H, B), np.float32)
        gates, n, back = x[: 2 * H], x[2 * H :], u[2 * H :]
        for t in range(T) if side == "f" else range(T - 1, -1, -1):
            np.take(E, columns[t], axis=0, out=rows, mode="clip")
            x[:] = rows.T
            np.matmul(U, h, out=u)
            gates += u[: 2 * H]
            np.tanh(gates, out=gates)
            gates += 1  # twice the update and reset gates
            z, r = gates[:H], gates[H:]
            np.multiply(r, back, out=d)
            n += d
            np.tanh(n, out=n)
            np.subtract(h, n, out=d)
            d *= z
            d *= 0.5
            if keep is not None:
                keep.append((t, h, z * 0.5, r * 0.5, n.copy(), back * 2))
            h = states[t]
            np.add(n, d, out=h)
        return states

    def _distributions(self, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
        H, (T, _, B) = self.hidden, forward.shape
        out = self.p["out"]
        scores = np.matmul(out[:, :H], forward) + np.matmul(out[:, H:], backward) + self.p["out_bias"]
        scores -= scores.max(axis=1, keepdims=True)
        np.exp(scores, out=scores)
        scores /= scores.sum(axis=1, keepdims=True)
        return scores  # (positions, languages, segments)

    def label(self, bytes_: np.ndarray) -> np.ndarray:
        return self._distributions(self._run(bytes_, "f"), self._run(bytes_, "b"))

    def gradients(self, bytes_: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        """Backpropagation through time of the mean cross-entropy over all positions that are no padding."""
        H, (B, T) = self.hidden, bytes_.shape
        kept = {"f": [], "b": []}
        states = {s: self._run(bytes_, s, kept[s]) for s in kept}
        error = self._distributions(states["f"], states["b"])
        error[:, target, np.arange(B)] -= 1
        real = (bytes_.T < 256)[:, None, :]
        error *= real / max(1, real.sum())
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["out_bias"] = error.sum(axis=(0, 2))[:, None]
        one_hot = np.zeros((257, B), np.float32)
        for k, s in enumerate(("f", "b")):
            mine = slice(k * H, (k + 1) * H)
            g["out"][:, mine] = np.einsum("tkb,thb->kh", error, states[s], optimize=True)
            U, dh = self.p[f"rec_{s}"], np.zeros((H, B), np.float32)
            for t, h, z, r, n, u in reversed(kept[s]):
                dh = dh + self.p["out"][:, mine].T @ error[t]
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (h - n) * z * (1 - z)
                dr = dn * u * r * (1 - r)
                to_input = np.concatenate([dz, dr, dn])
                to_state = np.concatenate([dz, dr, dn * r])
                one_hot[:] = 0
                one_hot[bytes_[:, t], np.arange(B)] = 1
                g[f"in_{s}"] += to_input @ one_hot.T
                g[f"rec_{s}"] += to_state @ h.T
                dh = dh * z + U.T @ to_state
        return g


def train(samples: list[tuple[str, bytes]], options: Training = Training()) -> ByteNetwork | None:
    """Adam over shuffled batches of segments; None if there is nothing to learn from."""
    languages = sorted({language for language, _ in samples})
    if not languages:
        return None
    net = ByteNetwork(languages, options.hidden, options.seed)
    data, target = padded([s for _, s in samples]), np.array([languages.index(x) for x, _ in samples])
    rng = np.random.default_rng(options.seed)
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    waiting = np.empty(0, np.int64)
    for step in range(1, options.steps + 1):
        while len(waiting) < options.batch:
            waiting = np.concatenate([waiting, rng.permutation(len(data))])
        rows, waiting = waiting[: options.batch], waiting[options.batch :]
        rate = options.rate * (1 - step / (options.steps + 1))
        for k, g in net.gradients(data[rows], target[rows]).items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            net.p[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def padded(segments: list[bytes]) -> np.ndarray:
    """Segments as rows of byte values, filled up with 256."""
    lengths = np.fromiter(map(len, segments), np.int64, len(segments))
    out = np.full((len(segments), SEGMENT), 256, np.int64)
    out[np.arange(SEGMENT) < lengths[:, None]] = np.frombuffer(b"".join(segments), np.uint8)
    return out


def document_distributions(net: ByteNetwork, texts: list[str]) -> np.ndarray:
    """Mean distribution over all positions of each text; texts are read in blocks of TOGETHER segments."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    counts = np.array([-(-len(r) // SEGMENT) for r in raw], np.int64)
    owner = np.repeat(np.arange(len(raw)), counts)
    sums = np.zeros((len(raw), len(net.languages)))
    segments = [r[i : i + SEGMENT] for r in raw for i in range(0, len(r), SEGMENT)]
    for begin in range(0, len(segments), TOGETHER):
        block = padded(segments[begin : begin + TOGETHER])
        p = net.label(block)
        p *= (block.T < 256)[:, None, :]
        np.add.at(sums, owner[begin : begin + TOGETHER], p.sum(axis=0).T)
    return sums / np.maximum([len(r) for r in raw], 1)[:, None]


def training_sample(docs: DataFrame, may_learn: Column, options: Training) -> list[tuple[str, bytes]]:
    """A bounded, deterministic sample: per language the share of rows by hash that gives about ``docs_per_language``, at most twice that many."""
    usable = docs.where(may_learn & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", "text")
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}  # one row per language
    draw = F.pmod(F.xxhash64("doc_id", F.lit(options.seed)), F.lit(1_000_000))
    share = F.lit(False)
    for language, count in counts.items():
        share = share | ((F.col("lang") == language) & (draw < min(1_000_000, int(1.2e6 * options.docs_per_language / count) + 1)))
    span = F.greatest(F.length("text") - SEGMENT, F.lit(0)) + 1
    spots = F.transform(F.sequence(F.lit(0), F.lit(SEGMENTS_PER_DOC - 1)), lambda k: F.substring(F.col("text"), (F.pmod(F.xxhash64(F.col("doc_id"), k), span) + 1).cast("int"), F.lit(SEGMENT)))
    rows = usable.where(share).select("lang", "doc_id", F.array_distinct(spots).alias("spots")).limit(2 * options.docs_per_language * max(1, len(counts))).collect()
    rows.sort(key=lambda r: (r["lang"], r["doc_id"] if r["doc_id"] is not None else -1, r["spots"]))
    return [(r["lang"], s.encode("utf-8", "replace")[:SEGMENT]) for r in rows for s in r["spots"] if s]


def identify_languages(docs: DataFrame, may_learn: Column, options: Training = Training()) -> DataFrame:
    """``(doc_id, lang_pred, score)`` per row; ``lang`` is read only where ``may_learn`` holds."""
    net = docs.sparkSession.sparkContext.broadcast(train(training_sample(docs, may_learn, options), options))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = string_column(batch, "text")
            lettered = [k for k, t in enumerate(texts) if t and net.value is not None and any(map(str.isalpha, t))]
            labels, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            if lettered:
                p = document_distributions(net.value, [texts[k] for k in lettered])
                for k, best, score in zip(lettered, p.argmax(axis=1).tolist(), p.max(axis=1).tolist()):
                    labels[k], scores[k] = net.value.languages[best], min(1.0, score)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(labels, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(predict, "doc_id long, lang_pred string, score double")
