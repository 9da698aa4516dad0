"""Exchange rates: returns, volatility, drift, tiers, and the rate known on a day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from florin.functions.core import month_start

# Fixed values of the index.
IQR_OF_NORMAL = 1.349
TRADING_DAYS = 252
LEAST_RETURNS = 10
DRIFT_MONTHS = 12
VOLATILITY_TIERS = ((0.025, "stable"), (0.10, "volatile"))
DRIFT_TIERS = ((0.025, "stable"), (0.06, "volatile"))
WORST = "hyper"
SEVERITY = {"stable": 0.0, "volatile": 0.5, "hyper": 1.0}


def log_returns(quotes: DataFrame) -> DataFrame:
    """Daily log returns, in the month of the later day."""
    before = F.lag("rate").over(Window.partitionBy("currency").orderBy("day"))
    rows = quotes.withColumn("before", before).where((F.col("before") > 0) & (F.col("rate") > 0))
    return rows.select("currency", "day", month_start(F.col("day")).alias("month"), F.log(F.col("rate") / F.col("before")).alias("log_return"))


def monthly_volatility(returns: DataFrame) -> DataFrame:
    """Annualised robust volatility per currency and month; null below ten returns."""
    q = F.percentile("log_return", F.array(F.lit(0.25), F.lit(0.75)))
    rows = returns.groupBy("currency", "month").agg(F.count("*").alias("n_returns"), q.alias("q"))
    spread = (F.col("q")[1] - F.col("q")[0]) / IQR_OF_NORMAL * TRADING_DAYS**0.5
    return rows.select("currency", "month", "n_returns", F.when(F.col("n_returns") >= LEAST_RETURNS, spread).alias("volatility"))


def sustained_drift(quotes: DataFrame) -> DataFrame:
    """Change of a currency's value over twelve months, from the last quotes inside both months."""
    ends = quotes.groupBy("currency", month_start(F.col("day")).alias("month")).agg(F.max_by("rate", "day").alias("rate"))
    start = ends.select("currency", F.add_months("month", DRIFT_MONTHS).alias("month"), F.col("rate").alias("start_rate"))
    both = ends.join(start, ["currency", "month"], "left")
    return both.select("currency", "month", F.when((F.col("rate") > 0) & (F.col("start_rate") > 0), F.col("start_rate") / F.col("rate") - 1).alias("drift"))


def _tier(value, tiers):
    out = F.when(value.isNull(), F.lit(None))
    for edge, name in tiers:
        out = out.when(value < edge, name)
    return out.otherwise(WORST)


def fx_index(quotes: DataFrame) -> DataFrame:
    """Tier by volatility, tier by erosion, and the worse of both, per currency and month; unknown volatility is worst."""
    rows = monthly_volatility(log_returns(quotes)).join(sustained_drift(quotes), ["currency", "month"], "full")
    erosion = F.when(F.col("drift").isNotNull(), F.greatest(F.lit(0.0), -F.col("drift")))
    rows = rows.withColumns({"volatility_tier": _tier(F.col("volatility"), VOLATILITY_TIERS), "drift_tier": _tier(erosion, DRIFT_TIERS)})
    severity = lambda c: F.coalesce(F.create_map(*(F.lit(x) for kv in SEVERITY.items() for x in kv))[F.col(c)], F.lit(0.0))
    worst = F.when(F.col("volatility_tier").isNull(), 1.0).otherwise(F.greatest(severity("volatility_tier"), severity("drift_tier")))
    return rows.withColumns({"severity": worst, "tier": F.when(worst == 0, "stable").when(worst == 0.5, "volatile").otherwise(WORST), "available_at": F.last_day("month")})


def rate_on_or_before(events: DataFrame, quotes: DataFrame, day: str) -> DataFrame:
    """Each event with the last quote of its currency on or before its day.

    Quotes and distinct event days are put in one order per currency and year-month-bounded
    windows carry the last quote forward, so there is no range join and no list of pairs.
    """
    asked = events.select("currency", F.col(day).alias("day")).distinct()
    line = quotes.select("currency", "day", F.struct("day", "rate").alias("quote")).unionByName(asked.select("currency", "day", F.lit(None).cast("struct<day:date,rate:double>").alias("quote")))
    month = line.withColumn("month", month_start(F.col("day")))
    # the last quote of earlier months, then the last one inside the month
    ends = month.groupBy("currency", "month").agg(F.max("quote").alias("last"))
    carried = ends.withColumn("carried", F.last("last", ignorenulls=True).over(Window.partitionBy("currency").orderBy("month").rowsBetween(Window.unboundedPreceding, -1))).drop("last")
    inside = F.last("quote", ignorenulls=True).over(Window.partitionBy("currency", "month").orderBy("day", F.col("quote").isNull()).rowsBetween(Window.unboundedPreceding, 0))
    known = month.withColumn("inside", inside).where("quote IS NULL").join(carried, ["currency", "month"])
    known = known.select(F.col("currency").alias("_currency"), F.col("day").alias("_day"), F.coalesce("inside", "carried").alias("known"))
    return events.join(known, (F.col("currency") == F.col("_currency")) & (F.col(day) == F.col("_day")), "left").select(*events.columns, F.col("known.day").alias("rate_day"), F.col("known.rate").alias("rate"))
