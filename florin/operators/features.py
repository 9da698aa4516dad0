"""Features of a company's month for models, over strict contiguous windows, and the folds that they may enter."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from florin.functions.core import deficit_state, flags

# Windows in months, months of history that an origin needs, months until a label is mature.
WINDOWS = (3, 6)
HISTORY_MONTHS, MATURITY_MONTHS = 3, 3
RATIOS = {"operating_min_ratio": ("operating_min",), "operating_max_ratio": ("operating_max",), "net_ratio": ("net_known",), "operating_in_ratio": ("receipts_known",), "operating_out_ratio": ("payments_known",), "financing_in_ratio": ("financing_in_known",), "financing_out_ratio": ("financing_out_known",), "uncertainty_ratio": ("ambiguous_in_known", "ambiguous_out_known")}
LOGS = {"log_gross": "volume_known", "log_tx": "n_cash", "log_accounts": "n_accounts"}
BASE = (*RATIOS, *LOGS, "operating_identified_ratio")
#: (source, statistic) over a window that ends with the month.
STATISTICS = (("net_ratio", "mean"), ("net_ratio", "std"), ("net_ratio", "slope"), ("operating_min_ratio", "mean"), ("operating_max_ratio", "mean"), ("log_gross", "mean"), ("log_gross", "std"))
DELTAS = ("net_ratio", "log_gross")
NAMES = (*BASE, *(f"{name}_{n}m" for n in WINDOWS for name in (*(f"{c}_{s}" for c, s in STATISTICS), "deficit_frequency", *(f"{c}_delta_prior" for c in DELTAS))))


def month_problem() -> Column:
    """Why a month gives no values; null if it does."""
    return F.when(~F.col("has_cash_activity"), "no_cash_activity").when(F.col("n_without_eur") != 0, "unknown_fx").when(F.col("volume_known").isNull() | (F.col("volume_known") <= 0), "nonpositive_or_unknown_gross")


def _slope(source: str, n: int, order: Window) -> Column:
    """Least-squares slope over n months, the current one last."""
    center = (n - 1) / 2
    terms = [(k - center) * F.lag(source, n - 1 - k).over(order) if k < n - 1 else (k - center) * F.col(source) for k in range(n)]
    return sum(terms[1:], terms[0]) / sum((k - center) ** 2 for k in range(n))


def model_features(panel: DataFrame) -> DataFrame:
    """The features of every company and month of a panel with all months, null where a window is not whole; what makes it so, and whether the month may be an origin.

    Windows are rows of one company's calendar: a window is whole if it has all its months and none has a problem. ``reason_nm`` and ``prior_reason_nm`` are the
    oldest problem of the window that ends with the month and of the one before it.
    """
    order = Window.partitionBy("company_id").orderBy("month")
    gross = F.col("volume_known")
    sane = F.col("problem").isNull()
    rows = panel.withColumn("problem", month_problem())
    base = {name: F.when(sane, sum((F.col(c) for c in columns[1:]), F.col(columns[0])) / gross) for name, columns in RATIOS.items()} | {name: F.when(sane & (F.col(c) >= 0), F.log1p(F.col(c).cast("double"))) for name, c in LOGS.items()}
    whole, plain = deficit_state(F.col("operating_min"), F.col("operating_max")), deficit_state(F.col("operating_min_plain"), F.col("operating_max_plain"))
    rows = rows.withColumns(base).withColumns({"operating_identified_ratio": F.col("operating_in_ratio") - F.col("operating_out_ratio"), "deficit": F.when(sane & (whole == plain), whole.cast("double"))})
    reason = lambda k: F.when(F.lag("month", k).over(order).isNull(), "missing_month").otherwise(F.lag("problem", k).over(order)) if k else F.col("problem")
    found: dict[str, Column] = {}
    for n in WINDOWS:
        now, prior = order.rowsBetween(1 - n, 0), order.rowsBetween(-n, -1)
        full = lambda c, over: F.count(c).over(over) == n  # noqa: B023, E731
        for source, kind in STATISTICS:
            value = F.avg(source).over(now) if kind == "mean" else F.stddev_pop(source).over(now) if kind == "std" else _slope(source, n, order)
            found[f"{source}_{kind}_{n}m"] = F.when(full(source, now), value)
        found[f"deficit_frequency_{n}m"] = F.when(full("deficit", now), F.avg("deficit").over(now))
        for source in DELTAS:
            found[f"{source}_delta_prior_{n}m"] = F.when(full(source, prior), F.col(source) - F.avg(source).over(prior))
        found[f"valid_months_{n}m"] = F.sum(sane.cast("int")).over(now)
        found[f"reason_{n}m"] = F.coalesce(*(reason(k) for k in range(n - 1, -1, -1)))
        found[f"prior_reason_{n}m"] = F.coalesce(*(reason(k) for k in range(n, 0, -1)))
    recent = F.array_compact(F.array(*(reason(k) for k in range(HISTORY_MONTHS))))
    first = F.min(F.when(F.col("has_cash_activity"), F.col("month"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    young = F.coalesce(F.col("is_warm_up"), F.lit(True)) | first.isNull() | (first > F.add_months("month", -HISTORY_MONTHS))
    found["eligibility_reasons"] = F.array_union(F.array_sort(F.array_distinct(recent)), flags((young, "less_than_three_prior_months")))
    rows = rows.withColumns(found).withColumn("known_as_of", F.last_day("month"))
    kept = [f"{c}_{n}m" for n in WINDOWS for c in ("valid_months", "reason", "prior_reason")]
    return rows.select("company_id", "group_id", "month", "known_as_of", (F.size("eligibility_reasons") == 0).alias("is_eligible"), "eligibility_reasons", *NAMES, *kept)


@dataclass(frozen=True)
class Fold:
    """Groups and months of a split, and the day by which its labels are known."""

    name: str
    groups: tuple[str, ...]
    first: str
    last: str
    labels_as_of: str


def fold_keys(features: DataFrame, groups: DataFrame, folds: Sequence[Fold]) -> DataFrame:
    """``(fold, company_id, group_id, month, label_available_at)``: eligible origins of every fold whose labels are mature by its day.

    A label is known three months after its month; an origin whose label matures later is purged from the fold. Folds are a handful of constants, and ``groups`` is (group_id, partition).
    """
    day = lambda x: F.lit(x).cast("date")
    asked = F.array(*(F.struct(F.lit(f.name).alias("fold"), F.array(*map(F.lit, f.groups)).alias("groups"), day(f.first).alias("first"), day(f.last).alias("last"), day(f.labels_as_of).alias("by")) for f in folds))
    rows = features.where("is_eligible").select("company_id", "group_id", "month", F.last_day(F.add_months("month", MATURITY_MONTHS)).alias("label_available_at")).join(groups, "group_id").withColumn("_fold", F.explode(asked))
    fits = F.array_contains("_fold.groups", F.col("partition")) & F.col("month").between(F.col("_fold.first"), F.col("_fold.last")) & (F.col("label_available_at") <= F.col("_fold.by"))
    return rows.where(fits).select("_fold.fold", "company_id", "group_id", "month", "label_available_at")
