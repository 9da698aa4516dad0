"""What can be observed and published: activity, horizons, matured cohorts and labels, masked totals, exclusion counts, the rate registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from florin.functions.core import known_if, month_index, share

# Months of warm-up, of the horizon, of a baseline of cohorts, and days until a cohort has matured.
WARM_UP = 3
HORIZON = 3
COHORT_MONTHS = 3
COHORT_DAYS = 60


def _order() -> Window:
    return Window.partitionBy("company_id").orderBy("month")


def observability(grid: DataFrame, classified: DataFrame, last_month: str) -> DataFrame:
    """Per company and month: activity, share of rows unclassified or without EUR, history, and whether a three-month target can be observed, else why not."""
    active = classified.where(F.col("is_booked") & ~F.col("is_open_month")).groupBy("company_id", "month").agg(
        F.count("*").alias("n_tx"), F.count_distinct("product_id").alias("n_accounts"), (100.0 * F.avg((F.col("flow_class") == "unknown").cast("double"))).alias("unknown_pct"), (100.0 * F.avg(F.col("amount_eur").isNull().cast("double"))).alias("without_eur_pct"))
    spans = active.groupBy("company_id").agg(F.min("month").alias("first_month"), F.max("month").alias("last_month"))
    rows = grid.select("company_id", "group_id", "month").join(active, ["company_id", "month"], "left").join(spans, "company_id", "left")
    rows = rows.withColumns({"n_tx": F.coalesce("n_tx", F.lit(0)), "n_accounts": F.coalesce("n_accounts", F.lit(0))}).withColumn("is_active", F.col("n_tx") > 0)
    observed = F.when(F.col("month") >= F.col("first_month"), month_index(F.col("month")) - month_index(F.col("first_month")))
    rows = rows.withColumns({"months_observed": observed, "active_so_far": F.count_if("is_active").over(_order().rowsBetween(Window.unboundedPreceding, 0)), **{f"_ahead{k}": F.coalesce(F.lead("is_active", k).over(_order()), F.lit(False)) for k in range(1, HORIZON + 1)}})
    ahead = F.col("_ahead1")
    for k in range(2, HORIZON + 1):
        ahead = ahead & F.col(f"_ahead{k}")
    complete = F.col("month") <= F.add_months(F.lit(last_month).cast("date"), -HORIZON)
    warm = F.coalesce(F.col("months_observed") < WARM_UP, F.lit(True))
    observable = F.col("is_active") & complete & ahead & ~warm
    reason = F.when(observable, F.lit(None)).when(~F.col("is_active"), "no_activity").when(warm, "warm_up").when(~complete, "no_horizon").otherwise("incomplete_horizon")
    return rows.select("company_id", "group_id", "month", "n_tx", "n_accounts", "unknown_pct", "without_eur_pct", "first_month", "last_month", "months_observed", "active_so_far", complete.alias("has_horizon"), observable.alias("is_observable"), reason.alias("reason"))


def observable_series(observed: DataFrame) -> DataFrame:
    """Observable companies per month; months without any are kept."""
    return observed.groupBy("month").agg(F.count_if("is_observable").alias("n_observable"), F.count("*").alias("n_companies"))


def cohort_features_at(cohorts: DataFrame, cut: str) -> DataFrame:
    """Matured receipt cohorts that were known at the cut, in long form."""
    parts = F.array(*(F.struct(F.lit(n).alias("horizon_days"), F.col(f"conversion_{n}d").alias("value"), F.col(f"available_at_{n}d").alias("available_at")) for n in (30, 60, 90)))
    return cohorts.select("company_id", F.col("month").alias("cohort_month"), F.explode(parts).alias("p")).select("company_id", "cohort_month", "p.*").where((F.col("available_at") <= F.lit(cut).cast("date")) & F.col("value").isNotNull())


def exclusion_funnel(invoices: DataFrame) -> DataFrame:
    """Invoices that fall at each step on the way to the universe, with their known amount."""
    cancelled, plain, dated = F.col("status_norm") == "cancel", F.col("document_type_norm") == "invoice", F.col("issuance_date_ok").isNotNull()
    steps = {"cancelled": cancelled, "no_invoice": ~cancelled & ~plain, "no_issue_date": ~cancelled & plain & ~dated, "without_eur": ~cancelled & plain & dated & F.col("amount_eur").isNull(), "paid_in_part": (F.col("status_norm") == "paid") & plain & (F.coalesce("pending_amount", F.lit(0.0)) != 0), "zero_amount": ~cancelled & plain & dated & (F.col("amount") == 0), "universe": ~cancelled & plain & dated}
    found = F.explode(F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in steps.items()))))
    return invoices.select(found.alias("step"), F.abs("amount_eur").alias("eur")).groupBy("step").agg(F.count("*").alias("n"), F.sum("eur").alias("known_eur"))


def masked_stock(stock: DataFrame, issued: DataFrame) -> DataFrame:
    """Open, overdue and issued amounts, null unless every document behind them has an amount and a certain state; coverage beside them; open against the mean issue of three months."""
    rows = stock.join(issued.select("company_id", "month", "side", "issued_eur", "n_issued", "n_issued_eur"), ["company_id", "month", "side"], "full")
    count = lambda c: F.coalesce(c, F.lit(0))
    whole = (count("n_possible") == count("n_eur")) & (count("n_uncertain") == 0)
    aged = whole & (count("n_without_due") == 0)
    rows = rows.withColumns({
        "open_total": known_if(whole, F.coalesce("open_eur", F.lit(0.0))), "overdue_total": known_if(aged, F.coalesce("overdue_eur", F.lit(0.0))), "over_180_total": known_if(aged, F.coalesce("over_180_eur", F.lit(0.0))),
        "issued_total": known_if(count("n_issued") == count("n_issued_eur"), F.coalesce("issued_eur", F.lit(0.0))), "open_known": F.coalesce("open_eur", F.lit(0.0)), "open_coverage": F.coalesce(share(F.col("n_eur"), F.col("n_possible")), F.lit(1.0)),
    })
    rows = rows.withColumn("overdue_share", F.when(F.col("open_total") > 0, F.col("overdue_total") / F.col("open_total")))
    w = Window.partitionBy("company_id", "side").orderBy("month")
    near = (month_index(F.col("month")) - month_index(F.lag("month", 2).over(w))) == 2
    mean3 = F.when(near, (F.col("issued_total") + F.lag("issued_total", 1).over(w) + F.lag("issued_total", 2).over(w)) / 3.0)
    return rows.withColumn("open_to_issued", F.when(mean3 > 0, F.col("open_total") / mean3))


def collection_targets(grid: DataFrame, cohorts: DataFrame, last_day: str, first: str) -> DataFrame:
    """Change of the 60-day conversion, weighted by issued amount: the three newest cohorts known at a month's end against the three issued after it.

    Every cohort is dealt to the three rows it can be baseline or future of, so that the join is an equi-join.
    """
    # the newest month whose cohort has matured by the end of this one
    end = F.when(F.date_add(F.last_day(F.add_months("month", -2)), COHORT_DAYS) <= F.last_day("month"), F.add_months("month", -2)).otherwise(F.add_months("month", -3))
    rows = grid.select("company_id", "month", F.when(end >= F.lit(first).cast("date"), end).alias("baseline_end"))
    usable = cohorts.where(F.col("conversion_60d").isNotNull() & (F.col("issued_eur") > 0)).select(F.col("company_id").alias("_c"), F.col("month").alias("_m"), F.col("issued_eur").alias("_e"), F.col("conversion_60d").alias("_v"), F.col("available_at_60d").alias("_known"))

    def window_of(first_offset: Column, base: str, known: Column, name: str) -> DataFrame:
        months = rows.where(F.col(base).isNotNull()).select("company_id", "month", F.explode(F.array(*(F.add_months(base, first_offset + k) for k in range(COHORT_MONTHS)))).alias("cohort"))
        found = months.join(usable, (F.col("company_id") == F.col("_c")) & (F.col("cohort") == F.col("_m"))).where(known)
        return found.groupBy("company_id", "month").agg(F.count("*").alias(f"{name}_months"), (F.sum(F.col("_e") * F.col("_v")) / F.nullif(F.sum("_e"), F.lit(0.0))).alias(f"{name}_conversion"))

    baseline = window_of(1 - COHORT_MONTHS, "baseline_end", F.col("_known") <= F.last_day("month"), "baseline")
    future = window_of(1, "month", F.col("_known") <= F.lit(last_day).cast("date"), "future")
    rows = rows.join(baseline, ["company_id", "month"], "left").join(future, ["company_id", "month"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("baseline_months", "future_months")})
    known_on = F.date_add(F.last_day(F.add_months("month", HORIZON)), COHORT_DAYS)
    reason = F.when(known_on > F.lit(last_day).cast("date"), "no_cohort_horizon").when(F.col("baseline_months") < COHORT_MONTHS, "incomplete_baseline").when(F.col("future_months") < HORIZON, "incomplete_future")
    return rows.select("company_id", "month", known_on.alias("known_on"), "baseline_months", "future_months", reason.alias("reason"), F.when(reason.isNull(), 100.0 * (F.col("baseline_conversion") - F.col("future_conversion"))).alias("worsening"))


def targets_at(deficit: DataFrame, collection: DataFrame, cut: str) -> DataFrame:
    """Labels that had matured at the cut, in long form."""
    a = deficit.where("target IS NOT NULL").select("company_id", "month", F.lit("deficit").alias("target_name"), F.col("target").cast("double").alias("value"), "known_on")
    b = collection.where("worsening IS NOT NULL").select("company_id", "month", F.lit("collection").alias("target_name"), F.col("worsening").alias("value"), "known_on")
    return a.unionByName(b).where(F.col("known_on") <= F.lit(cut).cast("date"))


def rate_registry(tx: DataFrame, first: str, last: str) -> DataFrame:
    """Evidence of reported rates per currency and month; the rate itself stays unknown, but for EUR, which is one by identity."""
    months = F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("INTERVAL 1 MONTH"))
    inside = F.col("is_booked") & (F.col("exchange_rate") > 0) & (F.col("exchange_rate") != 1) & F.col("product_currency").isNotNull() & F.col("month").between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    foreign = tx.where(inside & (F.col("product_currency") != "EUR")).groupBy(F.col("product_currency").alias("currency"), "month").agg(F.count("*").alias("n_observed"))
    foreign = foreign.select("currency", "month", F.lit(None).cast("double").alias("rate"), "n_observed", F.lit("unknown").alias("source"), F.last_day("month").alias("available_at"))
    identity = tx.sparkSession.range(1).select(F.lit("EUR").alias("currency"), F.explode(months).alias("month")).select("currency", "month", F.lit(1.0).alias("rate"), F.lit(0).cast("long").alias("n_observed"), F.lit("identity").alias("source"), F.col("month").alias("available_at"))
    return foreign.unionByName(identity)
