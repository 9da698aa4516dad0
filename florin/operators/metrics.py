"""Metrics of scores against labels from counts per distinct score, and intervals from replicates over groups."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 10
#: Width of the bands that scores are dealt to.
BAND = 1.0 / 128
SEED, REPLICATES = 1729, 300
INTERVAL = (0.025, 0.975)


def score_counts(rows: DataFrame, keys: Sequence[str], score: str, label: str) -> DataFrame:
    """``(*keys, score, n, pos, n_above, pos_above)`` per distinct score, ties together; ``above`` counts strictly higher scores.

    Rows are counted before anything is ordered. A window runs inside one band of scores, another over the bands' totals, so no task orders all scores of a key.
    """
    counted = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*keys, F.col(score).alias("score")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos")).withColumn("_band", F.floor(F.col("score") / BAND))
    higher = Window.partitionBy(*keys).orderBy(F.desc("_band")).rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*keys, "_band").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c, over: F.coalesce(F.sum(c).over(over), F.lit(0))
    bands = counted.groupBy(*keys, "_band").agg(F.sum("n").alias("_n"), F.sum("pos").alias("_pos")).withColumns({"_n_band": before("_n", higher), "_pos_band": before("_pos", higher)}).drop("_n", "_pos")
    local = counted.withColumns({"_n_in": before("n", inside), "_pos_in": before("pos", inside)})
    return local.join(bands, [*keys, "_band"]).select(*keys, "score", "n", "pos", (F.col("_n_band") + F.col("_n_in")).alias("n_above"), (F.col("_pos_band") + F.col("_pos_in")).alias("pos_above"))


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom)


def probability_metrics(rows: DataFrame, keys: Sequence[str], score: str, label: str, reference: str) -> DataFrame:
    """Average precision, Brier score and its skill over a constant ``reference`` probability, ROC-AUC, precision and recall at 0.5, and the expected calibration error.

    Ties of a score are one threshold; ranking metrics are null where only one class occurs.
    """
    counts = score_counts(rows, keys, score, label).join(rows.groupBy(*keys).agg(F.max(reference).alias("_constant")), list(keys))
    p, n, pos, neg = F.col("score"), F.col("n"), F.col("pos"), F.col("n") - F.col("pos")
    squares = pos * (p - 1) * (p - 1) + neg * p * p
    constant = pos * (F.col("_constant") - 1) * (F.col("_constant") - 1) + neg * F.col("_constant") * F.col("_constant")
    high = p >= 0.5
    sums = counts.groupBy(*keys).agg(
        F.sum("n").alias("n_rows"), F.sum("pos").alias("n_positive"), F.sum(pos * (F.col("pos_above") + pos) / (F.col("n_above") + n)).alias("_ap"), F.sum(neg * (F.col("pos_above") + pos / 2.0)).alias("_pairs"),
        F.sum(squares).alias("_squares"), F.sum(constant).alias("_constant_squares"), F.sum(F.when(high, pos).otherwise(0)).alias("true_alerts"), F.sum(F.when(high, neg).otherwise(0)).alias("false_alerts"),
    )
    gaps = reliability(rows, keys, score, label).groupBy(*keys).agg(F.sum(F.col("n") * F.abs(F.col("mean_score") - F.col("observed"))).alias("_gap"))
    total, positive = F.col("n_rows"), F.col("n_positive")
    negative, alerts = total - positive, F.col("true_alerts") + F.col("false_alerts")
    return sums.join(gaps, list(keys)).select(
        *keys, "n_rows", "n_positive", F.when(negative > 0, _ratio(F.col("_ap"), positive)).alias("average_precision"), _ratio(F.col("_pairs"), positive * negative).alias("roc_auc"), (F.col("_squares") / total).alias("brier"),
        _ratio(F.col("_constant_squares") - F.col("_squares"), F.col("_constant_squares")).alias("brier_skill"), "true_alerts", "false_alerts", F.coalesce(_ratio(F.col("true_alerts"), alerts), F.lit(0.0)).alias("precision"), F.coalesce(_ratio(F.col("true_alerts"), positive), F.lit(0.0)).alias("recall"), (F.col("_gap") / total).alias("calibration_error"),
    )


def reliability(rows: DataFrame, keys: Sequence[str], score: str, label: str) -> DataFrame:
    """Ten bins of probability: rows, mean score and observed share of each that has any."""
    known = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    place = F.least(F.floor(F.col(score) * BINS), F.lit(BINS - 1)).cast("int")
    return known.groupBy(*keys, place.alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("observed"))


def replicate_weight(replicate: Column, group: Column, seed: int = SEED) -> Column:
    """How often a group is drawn in a replicate: a Poisson number of mean one from a hash of seed, replicate and group."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), replicate, group)), 1, 8), 16, 10).cast("double") / float(1 << 32)
    total, out = 0.0, F.lit(0)
    for k in range(9):
        total += math.exp(-1) / math.factorial(k)
        out = out + F.when(u >= total, 1).otherwise(0)
    return out


def group_bootstrap(groups: DataFrame, group: str, values: Sequence[str], baseline: str, replicates: int = REPLICATES) -> DataFrame:
    """``(name, low, high, n_finite)``: intervals of the mean over groups of every column of values, and of its improvement over ``baseline``.

    Every replicate weighs groups by ``replicate_weight``, the same for all columns, so differences are paired. Draws need no numbering of groups: a group's weights follow from its name,
    and one row per group is summed into the replicates. The number drawn varies from replicate to replicate around the number of groups.
    """
    drawn = groups.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("_w", replicate_weight(F.col("replicate"), F.col(group)))
    drawn = drawn.where("_w > 0").groupBy("replicate").agg(*(F.sum(F.when(F.col(c).isNotNull(), F.col("_w") * F.col(c))).alias(c) for c in [*values, baseline]), F.sum("_w").alias("_total"))
    means = [(c, F.col(c) / F.col("_total")) for c in [*values, baseline]] + [(f"{c}_improvement", (F.col(baseline) - F.col(c)) / F.col("_total")) for c in values]
    long = drawn.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in means))).alias("_mean")).select("_mean.*")
    return long.groupBy("name").agg(F.percentile("value", F.lit(INTERVAL[0])).alias("low"), F.percentile("value", F.lit(INTERVAL[1])).alias("high"), F.count("value").alias("n_finite"))
