"""Quality rules whose cutoffs carry an exact risk guarantee.

Every document gets counts that are plain DataFrame expressions. A rule is a
ratio of these counts that grows with junk, in bins of a fixed step. Cutoffs are chosen per stratum (language) on the
labelled documents that pass the base rules, each text once:

1. A third of them, by a hash of the text, orders the policies. Policy q takes for every rule the lowest cutoff that refuses at most
   q * STEP of the third's good documents and more junk than good ones. Policies are nested: the next one refuses all that this one does.
2. The other two thirds are the holdout. Policies are tested there in this fixed order with an exact binomial test of "this policy
   refuses more than ``alpha`` of the stratum's good documents", a document counting once however many rules refuse it. The sequence stops at
   the first policy that is not rejected, so it needs no correction along the path; the level is ``delta`` divided by the
   number of strata (Bonferroni). The last policy that passes is used.

With probability ``1 - delta`` no stratum's rules refuse more than ``alpha`` of the good documents that the base rules leave, if
labelled documents are drawn like the others. A stratum with too few labels to certify a policy (86 good ones in the holdout of four strata)
keeps its documents.

Defined results: a null text counts as empty (0 words, so the base rules refuse
it); a null stratum and an empty one are strata of their own; labels that are null or have no
document are ignored; several labels of one document or text count as its lowest; repeated rows are judged each; ties in a bin
fall on the same side; a very long text is one row like any other; an empty table gives an empty result; other columns, whatever their
names, pass through in ``document``.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spark import materialise

#: Fixed values of the contract: white space between words, and the symbols that are counted.
SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

MIN_WORDS = 50
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_lines")


#: Policies after the strictest one, and the share of good documents that each may refuse more per rule than the one before.
PATH, STEP = 20, 0.0025
#: Strata up to which the cutoffs are broadcast (under 200 bytes each); beyond, they are joined under salts.
FEW_STRATA = 10_000


@dataclass(frozen=True)
class RiskControl:
    """alpha: share of good documents that may be refused per stratum; delta: chance that this fails."""

    alpha: float = 0.05
    delta: float = 0.05
    #: rule -> (numerator, denominator, step of the cutoff grid)
    rules: dict = field(
        default_factory=lambda: {
            "symbols": ("n_symbols", "n_words", 0.05),
            "duplicate_lines": ("n_dup_lines", "n_lines", 0.02),
            "repeats": ("n_repeat_words", "n_words", 0.02),
            "capitals": ("n_capitals", "word_chars", 0.02),
            "word_length": ("word_chars", "n_words", 0.4),
        }
    )
    grid: int = 50


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated_words(words: Column) -> Column:
    """Words that lie in a three-word window which occurs twice or more in the text."""
    def windows(w: Column) -> Column:
        return F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        return F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1))

    def covered(d: Column) -> Column:
        return F.size(F.array_distinct(F.flatten(F.transform(d, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    counted = _let(words, lambda w: _let(windows(w), lambda s: _let(repeated(s), covered)))
    return F.when(F.size(words) >= 4, counted).otherwise(F.lit(0)).cast("long")


def with_counts(docs: DataFrame, stratum: str, keep: Sequence[str]) -> DataFrame:
    """``(document, stratum, text_key, *COUNTS, base_failed)``; ``document`` has the columns ``keep``. No shuffle, no Python."""
    # a null stratum is "", an empty one "="
    rows = docs.select(F.struct(*keep).alias("document"), F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("")).alias("stratum"), F.coalesce("text", F.lit("")).alias("body"))
    body = F.col("body")
    rows = rows.select(
        "document", "stratum", "body", F.filter(F.split(body, SPACE + "+"), lambda w: w != "").alias("words"),
        F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    rows = rows.select(
        "document", "stratum", F.md5(body).alias("text_key"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate(body, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length(body) - F.length(F.translate(body, CAPITALS, ""))).cast("long").alias("n_capitals"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeated_words(F.col("words")).alias("n_repeat_words"),
    )
    return rows.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _log_gamma(x: Column) -> Column:
    """Stirling's series, shifted by eight; within 1e-11 for x >= 1."""
    z = x + 8.0
    shift = x
    for k in range(1, 8):
        shift = shift * (x + float(k))
    return (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1.0 / (12.0 * z) - 1.0 / (360.0 * z * z * z) + 1.0 / (1260.0 * z * z * z * z * z) - F.log(shift)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), summed from k downward; 1 where k >= n p.

    Terms more than 12 standard deviations below k are under 1e-30 of the largest and change no digit.
    """
    k, n = k.cast("double"), n.cast("double")
    log_term = _log_gamma(n + 1.0) - _log_gamma(k + 1.0) - _log_gamma(n - k + 1.0) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1.0 - p))
    odds = (1.0 - p) / p
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] * (k - i + 1.0) * odds / (n - k + i)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    terms = F.least(k, F.ceil(12.0 * F.sqrt(n * (p * (1.0 - p)))) + 60.0).cast("int")
    steps = F.when(terms >= 1, F.sequence(F.lit(1), terms)).otherwise(F.array().cast("array<int>"))
    tail = F.aggregate(steps, start, step, lambda acc: acc["total"])
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(log_term) * tail))


def _bins(control: RiskControl) -> Column:
    """Per row one entry per rule: the number of grid points its ratio reaches."""
    entries = []
    for rule, (top, bottom, step) in control.rules.items():
        ratio = F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(0.0)
        entries.append(F.struct(F.lit(rule).alias("rule"), F.least(F.floor(ratio / step + 1e-9), F.lit(control.grid)).cast("int").alias("bin")))
    return F.array(*entries)


def certified_cutoffs(counted: DataFrame, labels: DataFrame, control: RiskControl) -> DataFrame:
    """``(stratum, cutoffs)``: a map from rule to its cutoff bin, for strata with a certified policy.

    Documents meet the labels in one equi-join on doc_id. What goes on is one histogram row per stratum, rule and
    bin, and for the holdout one row per stratum and combination of bins.
    """
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("label_id")).agg(F.min("quality").alias("good"))
    slim = counted.where(~F.col("base_failed")).select(F.col("document.doc_id").alias("doc_id"), "stratum", "text_key", _bins(control).alias("bins"))
    labelled = (
        slim.join(marks, F.col("doc_id") == F.col("label_id")).groupBy("stratum", "text_key").agg(F.min("good").alias("good"), F.first("bins").alias("bins"))
        .groupBy("stratum", (F.pmod(F.conv(F.substring("text_key", 1, 8), 16, 10).cast("long"), F.lit(3)) == 0).alias("tuning"), "bins")
        .agg(F.count_if(F.col("good") == 1).alias("good"), F.count_if(F.col("good") == 0).alias("junk"))
    )
    labelled = materialise(labelled)
    # cutoff c refuses every bin >= c: each histogram row feeds the cutoffs up to its own bin
    refused = (
        labelled.where("tuning").select("stratum", "good", "junk", F.explode("bins").alias("b"))
        .groupBy("stratum", F.col("b.rule").alias("rule"), F.col("b.bin").alias("bin")).agg(F.sum("good").alias("good"), F.sum("junk").alias("junk"))
        .select("stratum", "rule", "good", "junk", F.explode(F.sequence(F.lit(0), F.col("bin"))).alias("cutoff"))
        .groupBy("stratum", "rule", "cutoff").agg(F.sum("good").alias("good"), F.sum("junk").alias("junk"))
    )
    base = refused.where("cutoff = 0").select(F.col("stratum").alias("_s"), F.col("rule").alias("_r"), F.col("good").alias("n_good"))
    policy = F.ceil(F.when(F.col("n_good") > 0, F.col("good") / (STEP * F.col("n_good"))).otherwise(0.0) - 1e-9).cast("int")
    first_policy = materialise(
        refused.where("cutoff > 0 AND junk > good").join(base, (F.col("stratum") == F.col("_s")) & (F.col("rule") == F.col("_r")))
        .select("stratum", "rule", "cutoff", policy.alias("policy")).where(F.col("policy") <= PATH)
    )
    # the first policy that refuses a bin
    by_bin = (
        first_policy.select(F.col("stratum").alias("_s"), F.col("rule").alias("_r"), "policy", F.explode(F.sequence(F.col("cutoff"), F.lit(control.grid))).alias("_b"))
        .groupBy("_s", "_r", "_b").agg(F.min("policy").alias("policy"))
    )
    holdout = labelled.where("NOT tuning AND good > 0").select("stratum", "bins", "good")
    fired = (
        holdout.select("stratum", "bins", "good", F.explode("bins").alias("b")).join(by_bin, (F.col("stratum") == F.col("_s")) & (F.col("b.rule") == F.col("_r")) & (F.col("b.bin") == F.col("_b")))
        .groupBy("stratum", "bins").agg(F.min("policy").alias("policy"), F.first("good").alias("good"))
        .select("stratum", "good", F.explode(F.sequence(F.col("policy"), F.lit(PATH))).alias("policy")).groupBy("stratum", "policy").agg(F.sum("good").alias("refused"))
        .select(F.col("stratum").alias("_s"), F.col("policy").alias("_p"), "refused")
    )
    path = holdout.groupBy("stratum").agg(F.sum("good").alias("n_good")).select("stratum", "n_good", F.explode(F.sequence(F.lit(0), F.lit(PATH))).alias("policy"))
    strata = labelled.agg(F.countDistinct("stratum").alias("n_strata"))
    tested = path.join(fired, (F.col("stratum") == F.col("_s")) & (F.col("policy") == F.col("_p")), "left").join(strata)  # one row
    # refusals never fall along the path, nor does the p-value: the last policy that passes is where the sequence stops
    last = (
        tested.where(binomial_tail(F.coalesce("refused", F.lit(0)), F.col("n_good"), control.alpha) <= F.lit(control.delta) / F.col("n_strata"))
        .groupBy(F.col("stratum").alias("_s")).agg(F.max("policy").alias("last"))
    )
    chosen = first_policy.join(last, (F.col("stratum") == F.col("_s")) & (F.col("policy") <= F.col("last"))).groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))
    return chosen.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))


def quality_rules(docs: DataFrame, labels: DataFrame, control: RiskControl = RiskControl(), stratum: str = "lang") -> DataFrame:
    """``(document, *COUNTS, base_failed, refused_by, kept)``: ``document`` has all columns of ``docs``, ``refused_by`` the rules that fired.

    The counted rows are checkpointed once and used twice: to certify the cutoffs and to apply them.
    """
    counted = materialise(with_counts(docs, stratum, docs.columns))
    return apply_rules(counted, certified_cutoffs(counted, labels, control), control)


def quality_report(docs: DataFrame, labels: DataFrame, control: RiskControl = RiskControl(), stratum: str = "lang") -> DataFrame:
    """As quality_rules, with doc_id alone in ``document``: only it and the counts are stored between."""
    counted = materialise(with_counts(docs, stratum, ["doc_id"]))
    return apply_rules(counted, certified_cutoffs(counted, labels, control), control)


def apply_rules(counted: DataFrame, cutoffs: DataFrame, control: RiskControl, few: int = FEW_STRATA) -> DataFrame:
    """Rows never move to their stratum: few strata are broadcast, and of many each is joined in ``salts`` copies."""
    cutoffs = materialise(cutoffs.select(F.col("stratum").alias("_s"), "cutoffs"))
    if cutoffs.count() <= few:
        joined = counted.join(F.broadcast(cutoffs), F.col("stratum") == F.col("_s"), "left")
    else:
        salts = 256
        salted = counted.withColumn("salt", F.pmod(F.xxhash64("text_key"), F.lit(salts)).cast("int"))
        copies = cutoffs.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = salted.join(copies, (F.col("stratum") == F.col("_s")) & (F.col("salt") == F.col("_salt")), "left")
    fired = F.filter(_bins(control), lambda b: F.coalesce(b["bin"] >= F.element_at(F.col("cutoffs"), b["rule"]), F.lit(False)))
    judged = joined.select("document", *COUNTS, "base_failed", F.transform(fired, lambda b: b["rule"]).alias("refused_by"))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("refused_by") == 0))
