"""Evidence states, labels, directions and episodes on the company-by-month panels, and checks of the panels themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from florin.functions.core import deficit_state, flags, known_if

# Fixed values of evidence and labels.
HISTORY_MONTHS = 3
COHORT_INVOICES = 5
COHORT_DAYS = 90
HORIZON = 3
DEFICIT_MONTHS = 2
DIRECTION_STEP = 0.05


def _by_company(*order: str):
    return Window.partitionBy("company_id").orderBy(*(order or ("month",)))


def latest_matured_cohort(grid: DataFrame, cohorts: DataFrame, first: str, horizon: int = 60) -> DataFrame:
    """The newest receipt cohort that had matured at each month end.

    A cohort enters in the month of its maturity, at the earliest the calendar's first, and is carried forward by a window, so no
    month meets all earlier cohorts.
    """
    value, known = F.col(f"conversion_{horizon}d"), F.col(f"available_at_{horizon}d")
    entering = cohorts.where(value.isNotNull() & known.isNotNull()).groupBy("company_id", F.greatest(F.trunc(known, "MM"), F.lit(first).cast("date")).alias("month")).agg(F.max(F.struct(known.alias("known"), F.col("month").alias("cohort"), value.alias("conversion"), "n_issued")).alias("c"))
    carried = F.last("c", ignorenulls=True).over(_by_company().rowsBetween(Window.unboundedPreceding, 0))
    return grid.join(entering, ["company_id", "month"], "left").withColumn("c", carried).select("company_id", "month", "available_at", F.col("c.cohort").alias("cohort_month"), F.col("c.conversion").alias("conversion"), F.col("c.n_issued").alias("n_issued"), F.datediff("available_at", "c.known").alias("cohort_age"))


def evidence(flows: DataFrame, debt: DataFrame, cohorts: DataFrame, first: str) -> DataFrame:
    """What can be published per company and month: reasons against, and a state, per dimension."""
    key = ["company_id", "month"]
    past = latest_matured_cohort(flows.select(*key, "available_at"), cohorts, first).drop("available_at")
    rows = flows.join(debt.select(*key, "n_service", "n_service_without_eur", "n_other_financing"), key).join(past, key)
    base, plain = deficit_state(F.col("operating_min"), F.col("operating_max")), deficit_state(F.col("operating_min_plain"), F.col("operating_max_plain"))
    sensitive = F.when(F.col("n_outliers") == 0, False).when(base.isNotNull() & plain.isNotNull(), base != plain)
    short = F.coalesce(F.col("months_observed") < HISTORY_MONTHS, F.lit(True)) | (F.col("active_months_so_far") < HISTORY_MONTHS)
    idle, blind = ~F.col("has_cash_activity"), (F.col("n_cash") > 0) & (F.col("n_cash") == F.col("n_without_eur"))
    rows = rows.withColumns({
        "operating_reasons": flags((idle, "no_cash"), (blind, "no_eur"), (short, "short_history"), (F.col("n_operating_without_eur") + F.col("n_ambiguous_without_eur") > 0, "unknown_fx"), (F.col("n_ambiguous") > 0, "incomplete_classes"), ((F.col("n_outliers") > 0) & ~F.coalesce(~sensitive, F.lit(False)), "outlier_sensitive")),
        "debt_reasons": flags((idle, "no_cash"), (short, "short_history"), (F.col("n_service_without_eur") > 0, "unknown_fx"), (F.col("n_ambiguous_out") > 0, "possible_payments"), (F.col("n_other_financing") > 0, "other_financing")),
        "collection_reasons": flags((F.col("conversion").isNull(), "no_matured_cohort"), (F.col("n_issued") < COHORT_INVOICES, "small_cohort"), (F.col("cohort_age") > COHORT_DAYS, "old_cohort")),
    })
    state = lambda none, reasons: F.when(none, "insufficient").when(F.size(reasons) > 0, "partial").otherwise("publishable")
    return rows.select(
        *key, "cohort_month", "conversion", "cohort_age", base.alias("deficit"), "operating_reasons", "debt_reasons", "collection_reasons",
        state(idle | blind, "operating_reasons").alias("operating_state"), state(idle | ((F.col("n_service") > 0) & (F.col("n_service") == F.col("n_service_without_eur"))), "debt_reasons").alias("debt_state"), state(F.col("conversion").isNull(), "collection_reasons").alias("collection_state"),
    )


def deficit_targets(flows: DataFrame, last_day: str) -> DataFrame:
    """Deficit in at least two of the next three months, only if it holds however ambiguous movements fall and with or without outliers."""
    rows = flows.withColumns({"base": deficit_state(F.col("operating_min"), F.col("operating_max")), "plain": deficit_state(F.col("operating_min_plain"), F.col("operating_max_plain"))})
    ahead = lambda c: [F.lead(c, k).over(_by_company()) for k in range(1, HORIZON + 1)]
    count = lambda cs: sum((c.cast("int") for c in cs), F.lit(0))
    sure = lambda c: count(F.coalesce(x, F.lit(False)) for x in ahead(c))
    possible = lambda c: count(F.coalesce(x, F.lit(True)) for x in ahead(c))
    rows = rows.withColumns({"base_min": sure("base"), "base_max": possible("base"), "plain_min": sure("plain"), "plain_max": possible("plain"), "active_ahead": sure("has_cash_activity"), "known_on": F.last_day(F.add_months("month", HORIZON))})
    label = lambda v: F.when(F.col(f"{v}_min") >= DEFICIT_MONTHS, F.lit(True)).when(F.col(f"{v}_max") < DEFICIT_MONTHS, F.lit(False))
    reason = (
        F.when(~F.col("has_cash_activity"), "no_cash_at_origin").when(F.coalesce("is_warm_up", F.lit(True)), "warm_up").when(F.col("known_on") > F.lit(last_day).cast("date"), "no_horizon").when(F.col("active_ahead") < HORIZON, "inactive_horizon")
        .when(label("base").isNull(), "material_uncertainty").when(~label("base").eqNullSafe(label("plain")), "outlier_sensitive")
    )
    return rows.select("company_id", "month", "known_on", "base_min", "base_max", reason.alias("reason"), F.when(reason.isNull(), label("base")).alias("target"))


def directions(flows: DataFrame) -> DataFrame:
    """Improving, deteriorating or stable: the last three months' operating flow per gross volume against the three before, as intervals."""
    gross = F.col("volume_known")
    usable = F.col("has_cash_activity") & (F.col("n_without_eur") == 0) & (gross > 0) & F.col("operating_min").isNotNull()
    rows = flows.select("company_id", "month", *(known_if(usable, F.col(c) / F.nullif(gross, F.lit(0.0))).alias(n) for n, c in (("low", "operating_min"), ("high", "operating_max"), ("low_plain", "operating_min_plain"), ("high_plain", "operating_max_plain"))))
    recent, prior = _by_company().rowsBetween(-2, 0), _by_company().rowsBetween(-5, -3)
    whole = lambda c, w: F.when(F.count(c).over(w) == 3, F.avg(c).over(w))
    deltas = {}
    for v in ("", "_plain"):
        deltas[f"delta_low{v}"] = whole(f"low{v}", recent) - whole(f"high{v}", prior)
        deltas[f"delta_high{v}"] = whole(f"high{v}", recent) - whole(f"low{v}", prior)
    rows = rows.withColumns(deltas)
    up = (F.col("delta_low") >= DIRECTION_STEP) & (F.col("delta_low_plain") >= DIRECTION_STEP)
    down = (F.col("delta_high") <= -DIRECTION_STEP) & (F.col("delta_high_plain") <= -DIRECTION_STEP)
    still = (F.greatest(F.abs("delta_low"), F.abs("delta_high"), F.abs("delta_low_plain"), F.abs("delta_high_plain")) < DIRECTION_STEP) & F.col("delta_low").isNotNull() & F.col("delta_low_plain").isNotNull()
    return rows.select("company_id", "month", "delta_low", "delta_high", F.when(up, "improving").when(down, "deteriorating").when(still, "stable").otherwise("insufficient").alias("direction"))


def episodes(directed: DataFrame) -> DataFrame:
    """Runs of months with one sign: the first month is a watch, the second confirms."""
    moved = F.col("direction").isin("improving", "deteriorating")
    begins = moved & ~F.coalesce(F.lag("direction").over(_by_company()) == F.col("direction"), F.lit(False))
    rows = directed.withColumn("run", F.sum(begins.cast("int")).over(_by_company().rowsBetween(Window.unboundedPreceding, 0))).where(moved)
    return rows.groupBy("company_id", "run", "direction").agg(F.min("month").alias("watch_month"), F.max("month").alias("last_month"), F.count("*").alias("n_months")).select("company_id", "direction", "watch_month", F.when(F.col("n_months") >= 2, F.add_months("watch_month", 1)).alias("confirmed_month"), "last_month", "n_months")


def panel_checks(panel: DataFrame, key: list[str], invariants: dict[str, Column]) -> DataFrame:
    """One row per check with the number of rows that break it; a sound panel has zeros."""
    repeated = panel.groupBy(*key).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("n")).select(F.lit("unique_key").alias("check"), "n")
    counts = panel.agg(*(F.count_if(F.coalesce(broken, F.lit(False))).alias(name) for name, broken in invariants.items()))
    return repeated.union(counts.unpivot([], list(invariants), "check", "n"))


def compare_panels(old: DataFrame, new: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Per column: rows only in one panel, null changes, differences beyond tolerance, sign changes, largest difference."""
    a, b = old.select(*key, *(F.col(c).alias(f"old_{c}") for c in columns), F.lit(1).alias("_o")), new.select(*key, *(F.col(c).alias(f"new_{c}") for c in columns), F.lit(1).alias("_n"))
    both = a.join(b, key, "full")
    parts = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"old_{c}").cast("double").alias("x"), F.col(f"new_{c}").cast("double").alias("y")) for c in columns))
    rows = both.select("_o", "_n", F.explode(parts).alias("p")).select("_o", "_n", "p.*")
    beyond = F.abs(F.col("x") - F.col("y")) > F.greatest(F.lit(1e-8), 1e-12 * F.abs("x"))
    return rows.groupBy("column").agg(
        F.count_if(F.col("_n").isNull()).alias("only_old"), F.count_if(F.col("_o").isNull()).alias("only_new"), F.count_if(F.col("x").isNull() & F.col("y").isNotNull()).alias("now_known"), F.count_if(F.col("x").isNotNull() & F.col("y").isNull()).alias("now_unknown"),
        F.count_if(beyond).alias("n_changed"), F.count_if(F.sign("x") * F.sign("y") < 0).alias("n_sign_changes"), F.max(F.abs(F.col("x") - F.col("y"))).alias("max_difference"))


def attention(scored: DataFrame, receivables: DataFrame, low: float = 40.0, fall: float = 5.0) -> DataFrame:
    """The latest scored month of every company with what calls for attention; ``receivables`` is ``(company_id, month, overdue_ar)``."""
    rows = scored.withColumn("change", F.col("score") - F.lag("score").over(_by_company())).where("score IS NOT NULL").join(receivables, ["company_id", "month"], "left")
    last = rows.groupBy("company_id").agg(F.max_by(F.struct("month", "score", "change", "balance", "stock", "c", "p", "d", "shortfall", "overdue_ar"), "month").alias("r")).select("company_id", "r.*")
    net = F.col("c") - F.col("p") - F.coalesce("d", F.lit(0.0))
    noted = flags(
        (F.col("score") < low, "low_score"), (F.col("change") <= -fall, "falling_score"), (F.col("balance") < 0, "negative_cash"), (F.col("stock") > 0, "overdue_payables"), (F.col("overdue_ar") > 0, "overdue_receivables"), (net < 0, "net_outflow"), (F.col("shortfall") > 0, "service_shortfall"))
    return last.select("company_id", "month", "score", noted.alias("attention"))
