"""Exposure of live receivables to currencies, and rates that are published late."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from florin.functions.core import flags, known_if, month_index, month_start

# What a high confidence needs.
LEAST_EUR, LEAST_INVOICES = 1000.0, 3


def receivables(invoices: DataFrame, first: str, last: str) -> DataFrame:
    """Receivables with ``begin`` and ``end``, the first and last month at whose end each is issued and not paid; only a paid status makes a payment date real."""
    paid = F.when(F.col("status_norm") == "paid", F.col("payment_date_ok"))
    rows = invoices.where((F.col("document_type_norm") == "invoice") & (F.col("status_norm") != "cancel") & (F.col("amount") > 0) & F.col("issuance_date_ok").isNotNull())
    end = F.least(F.when(paid.isNull(), F.lit(last).cast("date")).otherwise(F.add_months(month_start(paid), -1)), F.lit(last).cast("date"))
    begin = F.greatest(month_start(F.col("issuance_date_ok")), F.lit(first).cast("date"))
    return rows.withColumns({"begin": begin, "end": end}).where("begin <= end")


def at_cuts(rows: DataFrame) -> DataFrame:
    """One row per receivable and cut (month end) at which it is live. Receivables are dealt by company before they make their months, so what groups these within a company shuffles none of them."""
    return rows.repartition("company_id").withColumn("month", F.explode(F.sequence("begin", "end", F.expr("INTERVAL 1 MONTH")))).drop("begin", "end")


def live_receivables(invoices: DataFrame, first: str, last: str) -> DataFrame:
    return at_cuts(receivables(invoices, first, last))


def currency_exposure(live: DataFrame) -> DataFrame:
    """Per company, month and currency: invoices, own-currency amount, what is known in EUR, and what cannot be valued."""
    doubtful = F.coalesce("fx_ambiguous", F.lit(False)) & (F.col("currency") != "EUR")
    valued = F.col("amount_eur").isNotNull() & ~doubtful
    return live.groupBy("company_id", "month", "currency").agg(
        F.count("*").alias("n"), F.sum("amount").alias("original"), F.coalesce(F.sum(F.when(valued, F.col("amount_eur"))), F.lit(0.0)).alias("eur"), F.count_if(valued & (F.col("amount_eur_source") == "reported")).alias("n_reported"),
        F.count_if(~valued).alias("n_unvalued"), F.coalesce(F.sum(F.when(~valued, F.col("amount"))), F.lit(0.0)).alias("unvalued_original"), F.count_if(~valued & F.coalesce("fx_ambiguous", F.lit(False))).alias("n_ambiguous"))


def exposure_summary(by_currency: DataFrame) -> DataFrame:
    """Per company and month: what is live in EUR and in other currencies, what cannot be valued, and the confidence."""
    euro = F.col("currency") == "EUR"
    sums = by_currency.groupBy("company_id", "month").agg(
        F.sum("n").alias("n_live"), F.sum("n_unvalued").alias("n_unvalued"), F.sum(F.when(euro, F.col("n") - F.col("n_unvalued")).otherwise(0)).alias("n_eur"), F.sum(F.when(~euro, F.col("n") - F.col("n_unvalued")).otherwise(0)).alias("n_other"),
        F.sum(F.when(euro, F.col("eur")).otherwise(0.0)).alias("eur_eur"), F.sum(F.when(~euro, F.col("eur")).otherwise(0.0)).alias("other_eur"), F.count("*").alias("n_currencies"), F.count_if(F.col("n_unvalued") > 0).alias("n_unvalued_currencies"), F.sum("n_reported").alias("n_reported"), F.count_if(euro).alias("has_eur"))
    total, valued = F.col("eur_eur") + F.col("other_eur"), F.col("n_live") - F.col("n_unvalued")
    thin = (total < LEAST_EUR) | (valued < LEAST_INVOICES)
    confidence = F.when(F.col("n_unvalued") / F.col("n_live") >= 0.5, "low").when((F.col("n_unvalued") > 0) | thin, "medium").otherwise("high")
    noted = flags(((F.col("n_unvalued") > 0), "unvalued_exposure"), ((F.col("has_eur") > 0) & (F.col("n_currencies") > 1), "several_currencies"), ((F.col("has_eur") > 0) & (F.col("n_currencies") == 1), "eur_only"), (F.col("other_eur") > 0, "foreign_exposure"), (F.col("n_reported") > 0, "reported_rates"))
    return sums.select("company_id", "month", "n_live", "n_unvalued", "n_currencies", "n_unvalued_currencies", known_if(valued > 0, total).alias("live_eur"), known_if(F.col("n_eur") > 0, F.col("eur_eur")).alias("eur_eur"), known_if(F.col("n_other") > 0, F.col("other_eur")).alias("other_eur"), confidence.alias("confidence"), noted.alias("flags"))


def exposure_census(by_currency: DataFrame) -> DataFrame:
    """Companies, invoices and amounts per currency over all cuts."""
    return by_currency.groupBy("currency").agg(F.count_distinct("company_id").alias("n_companies"), F.sum("n").alias("n_rows"), F.sum("n_unvalued").alias("n_unvalued"), F.sum("eur").alias("eur"))


def published_rates(daily: DataFrame, lag_days: dict[str, int]) -> DataFrame:
    """The last quote of every month and the day on which it is published, by currency."""
    lag = F.lit(None).cast("int")
    for currency, days in lag_days.items():
        lag = F.when(F.col("currency") == currency, days).otherwise(lag)
    ends = daily.groupBy("currency", F.trunc("day", "MM").alias("month")).agg(F.max_by("rate", "day").alias("rate"))
    return ends.withColumn("available_at", F.date_add(F.last_day("month"), lag))


def latest_published(published: DataFrame, first: str, last: str) -> DataFrame:
    """At every month end the newest month that is published by then, and how many months old it is; carried by a window per currency."""
    months = F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("INTERVAL 1 MONTH"))
    grid = published.select("currency").distinct().withColumn("cut_month", F.explode(months))
    entering = published.groupBy("currency", F.greatest(F.trunc("available_at", "MM"), F.lit(first).cast("date")).alias("cut_month")).agg(F.max(F.struct("month", "rate")).alias("p"))
    order = Window.partitionBy("currency").orderBy("cut_month").rowsBetween(Window.unboundedPreceding, 0)
    rows = grid.join(entering, ["currency", "cut_month"], "left").withColumn("p", F.max("p").over(order))
    return rows.select("currency", F.last_day("cut_month").alias("cut"), F.col("p.month").alias("rate_month"), F.col("p.rate").alias("rate"), (month_index(F.col("cut_month")) - month_index(F.col("p.month"))).alias("age_months"))


def nearest_published(asked: DataFrame, published: DataFrame, cut: str) -> DataFrame:
    """For every currency and month asked the published month nearest to it, the earlier one on a tie; only what is published by the cut.

    Questions are distinct months and a currency has one rate a month, so both sides are small whatever the number of invoices.
    """
    questions = asked.select("currency", "month").distinct()
    known = published.where(F.col("available_at") <= F.lit(cut).cast("date")).select(F.col("currency").alias("_c"), F.col("month").alias("_m"), F.col("rate").alias("_r"))
    apart = F.abs(month_index(F.col("month")) - month_index(F.col("_m")))
    found = questions.join(known, F.col("currency") == F.col("_c")).groupBy("currency", "month").agg(F.min_by(F.struct("_m", "_r", apart.alias("lag")), F.struct(apart, "_m")).alias("p"))
    return questions.join(found, ["currency", "month"], "left").select("currency", "month", F.col("p._m").alias("rate_month"), F.col("p._r").alias("rate"), F.col("p.lag").alias("lag_months"))


def valuations(invoices: DataFrame, daily: DataFrame, monthly: DataFrame) -> DataFrame:
    """EUR value at issue by the best source there is: reported, a daily rate, a monthly one, else none."""
    rows = invoices.join(daily, "operation_id", "left").join(monthly, ["currency", "month"], "left")
    reported = F.when(~F.coalesce("fx_ambiguous", F.lit(False)) | (F.col("currency") == "EUR"), F.col("amount_eur"))
    by_day, by_month = F.col("amount") / F.col("daily_rate"), F.col("amount") / F.col("monthly_rate")
    source: Column = F.when(reported.isNotNull(), "reported").when(by_day.isNotNull(), "daily").when(by_month.isNotNull(), "monthly").otherwise("none")
    return rows.select("operation_id", "currency", F.coalesce(reported, by_day, by_month).alias("value_eur"), source.alias("source"))
