"""Counts and checks over the layers: contracts of flow rows, value dates, populations, jumps, and what an excluded company still does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from florin.functions.core import exact_quantiles, is_finite, month_start

# Days of value-date delay that are normal, the tolerance of a breakdown.
NORMAL_DELAY = 2
TOLERANCE, RELATIVE = 1e-6, 1e-9


def position_against_anchor(forward: DataFrame, anchor: DataFrame, month: str) -> DataFrame:
    """The forward position of a month beside the balance that is known; they differ by the unknown start."""
    rows = forward.where(F.col("month") == F.lit(month).cast("date")).select("company_id", "position").join(anchor, "company_id")
    return rows.where("anchor IS NOT NULL").select("company_id", "position", "anchor", (F.col("anchor") - F.col("position")).alias("gap"))


def panel_until(panel: DataFrame, cut: str, day: str = "day") -> DataFrame:
    """The rows of a panel that a cut may read."""
    return panel.where(F.col(day) <= F.lit(cut).cast("date"))


def value_date_census(tx: DataFrame) -> DataFrame:
    """Per company: movements by the distance of value date and date, and the EUR that fall in another month by value date."""
    delay = F.datediff("value_date_ok", "date_ok")
    kind = F.when(F.col("value_date_ok").isNull(), "missing").when(delay < 0, "before").when(delay == 0, "same").when(delay <= NORMAL_DELAY, "normal").otherwise("late")
    moved = F.col("value_date_ok").isNotNull() & (month_start(F.col("value_date_ok")) != F.col("month"))
    rows = tx.select("company_id", kind.alias("kind"), moved.alias("moved"), "amount_eur")
    counts = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("missing", "before", "same", "normal", "late")]
    return rows.groupBy("company_id").agg(*counts, F.coalesce(F.sum(F.when(F.col("moved"), F.col("amount_eur"))), F.lit(0.0)).alias("moved_eur"), F.coalesce(F.sum(F.abs("amount_eur")), F.lit(0.0)).alias("all_eur"))


def flow_contract(flows: DataFrame) -> DataFrame:
    """Rows that break the contract of monthly flows, per rule: first of month, finite amounts, inflow less outflow equals net."""
    finite = F.coalesce(is_finite(F.col("net")) & is_finite(F.col("inflow")) & is_finite(F.col("outflow")), F.lit(False))
    apart = F.abs(F.col("inflow") - F.col("outflow") - F.col("net")) > TOLERANCE + RELATIVE * F.abs("net")
    broken: dict[str, Column] = {"first_of_month": F.col("month") != month_start(F.col("month")), "finite": ~finite, "breakdown": apart, "signs": (F.col("inflow") < 0) | (F.col("outflow") < 0)}
    return flows.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in broken.items())).unpivot([], list(broken), "rule", "n_broken")


def anchor_identity(panel: DataFrame, anchor: DataFrame, day: str) -> DataFrame:
    """Companies whose reconstructed balance on the anchor's day is not the anchor."""
    at = panel.where(F.col("day") == F.lit(day).cast("date")).select("company_id", "balance").join(anchor, "company_id", "left")
    return at.agg(F.count("*").alias("n_companies"), F.count("anchor").alias("n_anchored"), F.count_if(F.abs(F.col("balance") - F.col("anchor")) > TOLERANCE).alias("n_apart"))


def evaluable_population(scored: DataFrame, excluded: DataFrame) -> DataFrame:
    """Companies per month that have a score and are not excluded."""
    kept = scored.where("score IS NOT NULL").join(excluded.select("company_id"), "company_id", "left_anti")
    return kept.groupBy("month").agg(F.count("*").alias("n_evaluable"))


def unpaid_criteria(invoices: DataFrame, first: str, last: str) -> DataFrame:
    """Invoices due and unpaid per month end under two readings of the payment date: real only with a paid status, or literal."""
    rows = invoices.where((F.col("document_type_norm") == "invoice") & (F.col("status_norm") != "cancel") & F.col("due_date_ok").isNotNull())
    start, end = F.lit(first).cast("date"), F.lit(last).cast("date")

    def counted(paid: Column, name: str) -> DataFrame:
        stop = F.least(F.when(paid.isNull(), end).otherwise(F.add_months(month_start(paid), -1)), end)
        begin = F.greatest(month_start(F.col("due_date_ok")), start)
        months = F.explode(F.when(begin <= stop, F.sequence(begin, stop, F.expr("INTERVAL 1 MONTH"))))
        return rows.select(months.alias("month")).groupBy("month").agg(F.count("*").alias(name))

    aware = counted(F.when(F.col("status_norm") == "paid", F.col("payment_date_ok")), "n_status_aware")
    both = aware.join(counted(F.col("payment_date_ok"), "n_literal"), "month", "full")
    return both.select("month", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_status_aware", "n_literal")))


def channel_correlations(points: DataFrame) -> DataFrame:
    """Pearson correlations between what the three channels take off."""
    pairs = (("obligation", "arrears"), ("obligation", "debt"), ("arrears", "debt"))
    sums = points.agg(*(F.corr(f"{a}_points", f"{b}_points").alias(f"{a}_{b}") for a, b in pairs))
    return sums.unpivot([], [f"{a}_{b}" for a, b in pairs], "channels", "pearson")


def activity_of(tx: DataFrame, companies: DataFrame) -> DataFrame:
    """All movements of some companies, how many bring money, and how much of it is known."""
    rows = tx.join(companies.select("company_id"), "company_id", "left_semi")
    into = F.col("direction") == "in"
    return rows.groupBy("company_id").agg(F.count("*").alias("n_movements"), F.count_if(into).alias("n_inflows"), F.coalesce(F.sum(F.when(into, F.col("amount_eur"))), F.lit(0.0)).alias("inflow_eur"))


def jumps(rows: DataFrame, value: str, width: float = 1e-4) -> DataFrame:
    """Quantiles of the month-to-month changes of a value between 0 and 1, and how many exceed a tenth and a half."""
    change = F.abs(F.col(value) - F.lag(value).over(Window.partitionBy("company_id").orderBy("month")))
    moved = rows.select(change.alias("x")).where("x IS NOT NULL")
    counts = moved.agg(F.count_if(F.col("x") > 0.1).alias("n_over_tenth"), F.count_if(F.col("x") > 0.5).alias("n_over_half"))
    found = exact_quantiles(moved, [], "x", (0.5, 0.9), width)
    return found.join(counts).select(F.col("total").alias("n"), F.col("q")[0].alias("p50"), F.col("q")[1].alias("p90"), "n_over_tenth", "n_over_half")


def pair_census(scored: DataFrame, horizons: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Per origin and horizon: pairs with a score at both ends, and those lost because the target has none or lies behind the calendar."""
    seen = scored.select("company_id", "month", F.col("score").isNotNull().alias("has"))
    target = seen.select(F.col("company_id").alias("_c"), F.col("month").alias("_m"), F.col("has").alias("_has"))
    origins = seen.where("has").withColumn("h", F.explode(F.array(*map(F.lit, horizons)))).withColumn("target_month", F.add_months("month", F.col("h")))
    pairs = origins.join(target, (F.col("company_id") == F.col("_c")) & (F.col("target_month") == F.col("_m")), "left")
    return pairs.groupBy("month", "h").agg(F.count("*").alias("n_origins"), F.count_if("_has").alias("n_pairs"), F.count_if(~F.col("_has")).alias("n_unscored"), F.count_if(F.col("_has").isNull()).alias("n_beyond"))


def latest_assessment(scored: DataFrame, last: str) -> DataFrame:
    """The newest scored month of every company, and how many months old it is."""
    rows = scored.where("score IS NOT NULL").groupBy("company_id").agg(F.max(F.struct("month", "score", "confidence")).alias("r"))
    age = (F.year(F.lit(last).cast("date")) * 12 + F.month(F.lit(last).cast("date"))) - (F.year("r.month") * 12 + F.month("r.month"))
    return rows.select("company_id", "r.month", "r.score", "r.confidence", age.alias("age_months"))


def too_early(features: DataFrame, cut: str) -> DataFrame:
    """Point-in-time assertion: rows per horizon, and those that were not known at the cut, which must be none."""
    return features.groupBy("horizon_days").agg(F.count("*").alias("n"), F.count_if(F.col("available_at") > F.lit(cut).cast("date")).alias("n_too_early"))
