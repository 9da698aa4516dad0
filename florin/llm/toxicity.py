"""Toxicity by class-conditional Kneser-Ney models.

Both classes have a byte model of order ``n`` over the words of a text (lower case, stripped of
punctuation; padded with blanks in front and one blank behind). Each class discounts its own
counts of n-grams and backs off to one interpolated Kneser-Ney model that both share: the pooled
n-gram counts, and below them continuation counts. An expression that is rare in a class is so
smoothed alike in both and says nothing. A text's evidence is the difference of its two log-likelihoods divided
by its number of characters. Languages differ in the small differences that ordinary words
add up to, so two more length-normalised differences stand beside it: that of the words which
speak clearly for the toxic model (by over CLEAR), per word, and that of the clearest word.
A logistic curve turns the three into a score.

Counting covers all labelled rows that may be learned from, except the draw on which the curve is fitted (four numbers): a quarter of them,
by hash, and of many at most about CALIBRATION_ROWS. The counts are summed by Spark, and the
probabilities are joins over the n-gram tables. What scoring needs is one number per n-gram and one per context; both grow with the
input. Up to MAX_TABLE rows in all they go to the tasks as arrays, and scoring is one pass without a shuffle in which a task scores each
distinct word once. Beyond, the tables stay in Spark: the distinct words of all documents meet them in equi-joins by n-gram, and the
words' evidence meets the documents' words in another one. Both ways give the same scores; the order of the model never changes.

Defined results: a null text or one without words has evidence 0 and the score of
that; null or missing labels are not learned, several labels of one document count as the highest; with only one
class to learn from every score is that class's share; repeated rows are scored each; ties have equal scores; very long texts are scored
whole; a null doc_id is scored; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spark import materialise
from .text import WordTable, string_column

#: Bytes of an n-gram.
ORDER = 6
#: Rows of the evidence tables (12 bytes each) that are broadcast; more are joined.
MAX_TABLE = 4_000_000
CALIBRATION_ROWS = 20_000
#: Log ratio of a word beyond which it counts as speaking for the toxic model.
CLEAR = 2.0
EVIDENCE = ("evidence", "clear_evidence", "clearest")
DISCOUNT = 0.75
#: Taken off every n-gram count of a class; an n-gram that a class has once counts as unseen there.
CLASS_DISCOUNT = 1.0
WORD_CACHE = 500_000
#: Texts that are scored together.
TOGETHER = 500


def normal_word(raw: str) -> str:
    """Lower case, without punctuation at either end; may be empty."""
    word = raw.lower()
    start, end = 0, len(word)
    while start < end and not word[start].isalnum():
        start += 1
    while end > start and not word[end - 1].isalnum():
        end -= 1
    return word[start:end]


def packed_grams(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of padded words as integers, byte by byte, and how many each word has."""
    raw = [w.encode("utf-8", "replace") + b" " for w in words]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    pad = b" " * (order - 1)
    flat = np.frombuffer(b"".join([pad + r for r in raw]), np.uint8).astype(np.int64)
    keys = np.zeros(max(0, len(flat) - order + 1), np.int64)
    for k in range(order):
        keys = (keys << 8) | flat[k : k + len(keys)]
    # a word of s bytes takes s + order - 1 places, of which the first s start one of its n-grams
    starts = np.cumsum(sizes + order - 1) - (sizes + order - 1)
    take = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
    return keys[take], sizes


def class_counts(rows: DataFrame, order: int) -> DataFrame:
    """``(gram, toxic, plain)`` summed over all rows ``(text, toxic)``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for text, toxic in zip(string_column(batch, "text"), batch.column(1).to_pylist()):
                words[int(toxic > 0)].update((text or "").split())
            tables = []
            for toxic, counter in words.items():
                if counter:
                    normal: Counter = Counter()
                    for raw, n in counter.items():
                        normal[normal_word(raw)] += n
                    normal.pop("", None)
                    keys, sizes = packed_grams(list(normal), order)
                    weights = np.repeat(np.fromiter(normal.values(), np.int64, len(normal)), sizes)
                    grams, where = np.unique(keys, return_inverse=True)
                    tables.append((toxic, grams, np.bincount(where, weights, len(grams)).astype(np.int64)))
            for toxic, grams, n in tables:
                zero = np.zeros(len(grams), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(n if toxic else zero), pa.array(zero if toxic else n)], ["gram", "toxic", "plain"])

    counted = rows.select("text", "toxic").mapInArrow(count, "gram long, toxic long, plain long")
    return counted.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain"))


def _shared_backoff(grams: DataFrame, order: int) -> DataFrame:
    """``(gram, p)``: interpolated Kneser-Ney probabilities of order ``order - 1`` from the distinct n-grams of both classes."""
    levels, distinct = {}, grams.select("gram")
    for k in range(order - 1, 0, -1):
        suffix = F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1))
        levels[k] = distinct.groupBy(suffix.alias("gram")).agg(F.count("*").alias("n"))
        distinct = levels[k].select("gram")
    below = None
    for k in range(1, order):
        level = levels[k].withColumn("context", F.shiftright("gram", 8))
        totals = level.groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        level = level.join(totals, "context")
        if below is None:
            lower = F.lit(1 / 256)
        else:
            level = level.withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1))).join(below, "suffix")
            lower = F.col("lower")
        p = F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) / F.col("total") + DISCOUNT * F.col("kinds") / F.col("total") * lower
        below = level.select(F.col("gram").alias("suffix"), p.alias("lower"))
    return below


def evidence_tables(rows: DataFrame, order: int = ORDER) -> tuple[DataFrame, DataFrame]:
    """``(gram, evidence)``: the log ratio of every seen n-gram, and that of an unseen n-gram after every seen context."""
    grams = materialise(class_counts(rows, order))
    seen = lambda c: F.sum((F.col(c) > 0).cast("long"))
    contexts = materialise(grams.groupBy(F.shiftright("gram", 8).alias("context")).agg(F.sum("toxic").alias("all_toxic"), F.sum("plain").alias("all_plain"), seen("toxic").alias("kinds_toxic"), seen("plain").alias("kinds_plain"), F.count("*").alias("kinds")))
    backoff = _shared_backoff(grams, order)
    joined = grams.withColumns({"context": F.shiftright("gram", 8), "suffix": F.col("gram").bitwiseAND(F.lit((1 << 8 * (order - 1)) - 1))}).join(contexts, "context").join(backoff, "suffix")

    everything = F.col("all_toxic") + F.col("all_plain")
    pooled = F.greatest(F.col("toxic") + F.col("plain") - DISCOUNT, F.lit(0.0)) / everything + DISCOUNT * F.col("kinds") / everything * F.col("lower")

    def weight(c: str) -> Column:
        return F.when(F.col(f"all_{c}") > 0, CLASS_DISCOUNT * F.col(f"kinds_{c}") / F.col(f"all_{c}")).otherwise(1.0)

    def probability(c: str) -> Column:
        own = F.when(F.col(f"all_{c}") > 0, F.greatest(F.col(c) - CLASS_DISCOUNT, F.lit(0.0)) / F.col(f"all_{c}")).otherwise(0.0)
        return own + weight(c) * pooled

    ratio = lambda f: F.log(f("toxic") / f("plain")).cast("float")
    return materialise(joined.select("gram", ratio(probability).alias("evidence"))), contexts.select(F.col("context").alias("gram"), ratio(weight).alias("evidence"))


class WordEvidence:
    """Sum of log ratios and number of characters of every word, each computed once."""

    def __init__(self, order: int, grams: np.ndarray, values: np.ndarray, contexts: np.ndarray, defaults: np.ndarray):
        self.order, self.grams, self.values, self.contexts, self.defaults = order, grams, values, contexts, defaults
        self.forget()

    def forget(self) -> None:
        self.table, self.totals, self.places = WordTable(), np.empty(0), np.empty(0, np.int64)

    def learn(self, raw: list[str]) -> None:
        words = [normal_word(w) for w in raw]
        real = np.array([bool(w) for w in words])
        keys, sizes = packed_grams([w for w in words if w], self.order)
        out = np.zeros(len(keys))
        if len(self.contexts):
            context = keys >> 8
            at = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
            out = np.where(self.contexts[at] == context, self.defaults[at], 0.0)
            at = np.minimum(np.searchsorted(self.grams, keys), len(self.grams) - 1)
            out = np.where(self.grams[at] == keys, self.values[at], out)
        ends = np.cumsum(sizes)
        sums = np.concatenate([[0.0], np.cumsum(out)])
        totals, places = np.zeros(len(raw)), np.zeros(len(raw), np.int64)
        totals[real], places[real] = sums[ends] - sums[ends - sizes], sizes
        self.totals, self.places = np.concatenate([self.totals, totals]), np.concatenate([self.places, places])

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        """Per text the difference of the log-likelihoods per character; that of clear words per word; that of the clearest word."""
        if len(self.table) > WORD_CACHE:
            self.forget()
        numbers = [self.table.numbers((t or "").split()) for t in texts]
        if new := self.table.take_new():
            self.learn(new)
        out = np.zeros((len(texts), len(EVIDENCE)))
        for k, own in enumerate(numbers):
            if len(own):
                values = self.totals[own]
                out[k] = values.sum() / max(1, self.places[own].sum()), np.maximum(values - CLEAR, 0).mean(), max(0.0, values.max())
        return out


def with_evidence(docs: DataFrame, model) -> DataFrame:
    """``(doc_id, *EVIDENCE)`` per row; ``model`` is a broadcast of WordEvidence's arguments."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordEvidence(*model.value)
        for batch in batches:
            for first in range(0, len(batch), TOGETHER):
                part = batch.slice(first, TOGETHER)
                values = words.evidence(string_column(part, "text"))
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, values.T.copy())], ["doc_id", *EVIDENCE])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, " + ", ".join(f"{c} double" for c in EVIDENCE))


def with_joined_evidence(docs: DataFrame, by_gram: DataFrame, by_context: DataFrame, order: int = ORDER) -> DataFrame:
    """As with_evidence, for tables of any size: words and n-grams meet them in equi-joins."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), string_column(batch, "text")):
                counter = Counter((text or "").split())
                normal: Counter = Counter()
                for raw, n in counter.items():
                    normal[normal_word(raw)] += n
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(normal), pa.int64()), pa.array(list(normal), pa.string()), pa.array(list(normal.values()), pa.int64())], ["row", "word", "n"])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            keys, sizes = packed_grams(words, order)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(words)), sizes))), pa.array(keys), pa.array(keys >> 8)], ["word", "key", "context"])

    rows = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row", F.monotonically_increasing_id()))
    words = materialise(rows.select("row", "text").mapInArrow(count, "row long, word string, n long"))
    grams = words.where("word <> ''").select("word").distinct().mapInArrow(spell, "word string, key long, context long")
    seen = by_gram.select(F.col("gram").alias("_gram"), F.col("evidence").cast("double").alias("own"))
    after = by_context.select(F.col("gram").alias("_context"), F.col("evidence").cast("double").alias("unseen"))
    values = (
        grams.join(seen, F.col("key") == F.col("_gram"), "left").join(after, F.col("context") == F.col("_context"), "left")
        .groupBy("word").agg(F.sum(F.coalesce("own", "unseen", F.lit(0.0))).alias("value"), F.count("*").alias("places")).withColumnRenamed("word", "_word")
    )
    value, n = F.coalesce("value", F.lit(0.0)), F.col("n")
    sums = (
        words.join(values, F.col("word") == F.col("_word"), "left").groupBy("row")
        .agg(F.sum(value * n).alias("all"), F.sum(F.coalesce("places", F.lit(0)) * n).alias("places"), F.sum(F.greatest(value - CLEAR, F.lit(0.0)) * n).alias("clear"), F.sum(n).alias("words"), F.max(value).alias("most"))
        .select(F.col("row").alias("_row"), (F.col("all") / F.greatest("places", F.lit(1))).alias("evidence"), (F.col("clear") / F.col("words")).alias("clear_evidence"), F.greatest("most", F.lit(0.0)).alias("clearest"))
    )
    return rows.select("row", "doc_id").join(sums, F.col("row") == F.col("_row"), "left").select("doc_id", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in EVIDENCE))


def fit_curve(evidence: np.ndarray, toxic: np.ndarray) -> tuple[list[float], float] | float:
    """(slopes, offset) of a logistic curve in which the classes weigh equally; the toxic share where there is one class only."""
    if len(toxic) == 0 or toxic.min() == toxic.max():
        return float(toxic.mean()) if len(toxic) else 0.0
    weight = np.where(toxic == 1, 0.5 / (toxic == 1).sum(), 0.5 / (toxic == 0).sum())
    unit = np.maximum(evidence.std(axis=0), 1e-9)
    x = np.column_stack([evidence / unit, np.ones(len(evidence))])
    beta, hold = np.zeros(x.shape[1]), 1e-4
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (toxic - p)) - hold * beta
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + hold * np.eye(x.shape[1])
        step = np.linalg.solve(hessian, gradient)
        beta += step * min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return (beta[:-1] / unit).tolist(), float(beta[-1])


def toxicity_scores(docs: DataFrame, labels: DataFrame, may_learn: Column) -> DataFrame:
    """``(doc_id, score, predicted)`` and EVIDENCE for every row of ``docs``.

    ``may_learn`` is a condition on doc_id. The evidence of all rows is computed once and checkpointed.
    """
    spark = docs.sparkSession
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("toxic"))
    share = min(1.0, 4.0 * CALIBRATION_ROWS / max(1, marks.count()))
    curve_only = (F.pmod(F.xxhash64("doc_id", F.lit("curve")), F.lit(4)) == 0) & (F.pmod(F.xxhash64("doc_id", F.lit("draw")), F.lit(1_000_000)) < int(share * 1_000_000))
    # a merge join at every size: the labels may be many, and the plan should not change with them
    learn = docs.where(may_learn & ~curve_only).select("doc_id", "text").join(marks.hint("merge"), F.col("doc_id") == F.col("_id")).select("text", "toxic")
    by_gram, by_context = evidence_tables(learn)
    if by_gram.count() + by_context.count() <= MAX_TABLE:
        tables = [t.toArrow().sort_by("gram") for t in (by_gram, by_context)]
        model = spark.sparkContext.broadcast((ORDER, *(t[c].to_numpy() for t in tables for c in ("gram", "evidence"))))
        scored = materialise(with_evidence(docs, model))
        model.unpersist()
    else:
        scored = materialise(with_joined_evidence(docs, by_gram, by_context))
    drawn = scored.where(may_learn & curve_only)
    sample = drawn.join(marks, F.col("doc_id") == F.col("_id")).select(*EVIDENCE, "toxic").limit(2 * CALIBRATION_ROWS).toArrow()
    curve = fit_curve(np.column_stack([sample[c].to_numpy() for c in EVIDENCE]), sample["toxic"].to_numpy().astype(np.int64))
    if isinstance(curve, float):
        score = F.lit(curve)
    else:
        score = 1.0 / (1.0 + F.exp(-sum((w * F.col(c) for w, c in zip(curve[0], EVIDENCE)), F.lit(curve[1]))))
    return scored.select("doc_id", score.alias("score"), *EVIDENCE).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
