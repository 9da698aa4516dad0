"""Dated calendars at month ends: punctuality so far, chances to be collected or paid by age, expected amounts by day and horizon.

A cut knows what was issued and paid by then. Invoices generate their own cuts; what is needed of the past is counted per cut, age
and side before it meets anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from florin.functions.core import known_if, month_start

# Lower edges of the ages in days, the window of a cure, the fewest observations; maturity and prior of payments.
AGES = (("1_30", 1), ("31_60", 31), ("61_90", 61), ("91_180", 91), ("over_180", 181))
CURE_DAYS, CURE_LEAST = 180, 100
MATURITY_DAYS, PAYMENT_LEAST, PAYMENT_PRIOR = 365, 200, 1.0
HORIZONS = (30, 60, 90)


def _months(begin: Column, end: Column) -> Column:
    return F.when(begin <= end, F.sequence(begin, end, F.expr("INTERVAL 1 MONTH")))


def _cuts_after(day: Column, first: str, last: str) -> Column:
    """The month ends on or after a day, as months."""
    return _months(F.greatest(month_start(day), F.lit(first).cast("date")), F.lit(last).cast("date"))


def punctuality(rows: DataFrame, first: str, last: str) -> DataFrame:
    """What was due by each month end: paid on time, late, or in arrears; the arrears ratio, or its bounds where amounts are unknown.

    An invoice counts as due from its month on. It is dealt once to the month in which it falls due, once to the month in which it is
    paid late, and the windows carry the sums on, so that no invoice is dealt to all later months.
    """
    known, paid, due = F.col("eur").isNotNull(), F.col("paid"), F.col("due")
    start = F.lit(first).cast("date")
    slot = lambda day: F.greatest(month_start(day), start)
    late = paid.isNotNull() & (paid > due)
    events = F.array_compact(F.array(
        F.struct(slot(due).alias("month"), F.lit(1).alias("n"), (~known).cast("int").alias("holes"), F.coalesce("eur", F.lit(0.0)).alias("due_eur"), F.when(known & paid.isNotNull() & (paid <= due), F.col("eur")).otherwise(0.0).alias("on_time"), F.lit(0.0).alias("late"), F.lit(0.0).alias("late_days")),
        F.when(known & late, F.struct(slot(paid).alias("month"), F.lit(0).alias("n"), F.lit(0).alias("holes"), F.lit(0.0).alias("due_eur"), F.lit(0.0).alias("on_time"), F.col("eur").alias("late"), (F.col("eur") * F.datediff(paid, due)).alias("late_days"))),
    ))
    sums = ("n", "holes", "due_eur", "on_time", "late", "late_days")
    monthly = rows.select("company_id", "side", F.explode(events).alias("e")).where(F.col("e.month") <= F.lit(last).cast("date")).groupBy("company_id", "side", "e.month").agg(*(F.sum(f"e.{c}").alias(c) for c in sums))
    grid = monthly.select("company_id", "side").distinct().withColumn("month", F.explode(F.sequence(start, F.lit(last).cast("date"), F.expr("INTERVAL 1 MONTH"))))
    so_far = Window.partitionBy("company_id", "side").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    out = grid.join(monthly, ["company_id", "side", "month"], "left").withColumns({c: F.coalesce(F.sum(c).over(so_far), F.lit(0)) for c in sums})
    arrears = F.col("due_eur") - F.col("on_time") - F.col("late")
    ratio = F.when(F.col("due_eur") > 0, arrears / F.col("due_eur"))
    whole = F.col("holes") == 0
    return out.where("n > 0").select(
        "company_id", "side", "month", F.col("n").alias("n_due"), F.col("holes").alias("n_holes"), "due_eur", "on_time", "late", arrears.alias("arrears_eur"), known_if(whole, ratio).alias("arrears_ratio"),
        F.when(whole, ratio).otherwise(F.coalesce(ratio, F.lit(0.0))).alias("ratio_min"), F.when(whole, ratio).otherwise(1.0).alias("ratio_max"), F.when(F.col("late") > 0, F.col("late_days") / F.col("late")).alias("mean_days_late"),
        F.when(whole, "high").when(F.col("holes") / F.col("n") >= 0.5, "low").otherwise("medium").alias("confidence"),
    )


def cure_rates(rows: DataFrame, first: str, last: str) -> DataFrame:
    """Per cut and age: the share of invoices unpaid at that age which were paid within CURE_DAYS more, over those whose window has closed.

    With fewer than CURE_LEAST of them the rate of all due invoices stands in; the ages' rates never rise, and the first one is at most the overall rate.
    """
    ages = F.array(F.struct(F.lit("not_due").alias("age"), F.lit(0).alias("edge"), F.lit(0).alias("place")), *(F.struct(F.lit(n).alias("age"), F.lit(edge).alias("edge"), F.lit(k).alias("place")) for k, (n, edge) in enumerate(AGES, 1)))
    dealt = rows.select("due", "paid", F.explode(ages).alias("a")).withColumn("reference", F.date_add("due", F.col("a.edge")))
    at_risk = dealt.where(F.col("paid").isNull() | (F.col("a.place") == 0) | (F.col("paid") > F.col("reference")))
    closes = F.date_add("reference", CURE_DAYS)
    cured = F.col("paid").isNotNull() & (F.col("paid") <= closes)
    # counted in the month in which the window closes, then carried on
    closing = F.greatest(month_start(closes), F.lit(first).cast("date"))
    # a cut is a month's last day, so a window that closes within the month has closed at it
    monthly = at_risk.groupBy(closing.alias("month"), F.col("a.age").alias("age"), F.col("a.place").alias("place")).agg(F.count("*").alias("n"), F.count_if(cured).alias("k")).where(F.col("month") <= F.lit(last).cast("date"))
    grid = rows.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("INTERVAL 1 MONTH"))).alias("month")).select("month", F.explode(ages).alias("a")).select("month", "a.age", "a.place")
    so_far = Window.partitionBy("age").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    table = grid.join(monthly, ["month", "age", "place"], "left").withColumns({c: F.coalesce(F.sum(c).over(so_far), F.lit(0)) for c in ("n", "k")})
    by_cut = Window.partitionBy("month")
    overall = F.max(F.when((F.col("place") == 0) & (F.col("n") > 0), F.col("k") / F.col("n"))).over(by_cut)
    table = table.withColumn("own", F.when((F.col("place") > 0) & (F.col("n") < CURE_LEAST), F.lit(None)).when(F.col("n") > 0, F.col("k") / F.col("n"))).withColumn("rate", F.coalesce("own", overall, F.lit(0.0)))
    table = table.withColumn("base", F.max(F.when(F.col("place") == 0, F.col("rate"))).over(by_cut))
    falling = F.min(F.when(F.col("place") > 0, F.col("rate"))).over(by_cut.orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    clamped = F.when(F.col("place") == 0, F.col("rate")).when(F.col("place") == 1, F.least("rate", "base")).otherwise(falling)
    return table.select(F.last_day("month").alias("cut"), "age", F.col("n").alias("n_observed"), F.col("own").isNull().alias("is_fallback"), clamped.alias("rate"))


def payment_survival(rows: DataFrame, first: str, last: str) -> DataFrame:
    """Per cut and age: the share of mature invoices still unpaid at that age which were paid before maturity; the prior where nothing has matured."""
    ages = F.array(F.struct(F.lit("not_due").alias("age"), F.lit(None).cast("int").alias("edge"), F.lit(0).alias("place")), *(F.struct(F.lit(n).alias("age"), F.lit(edge).alias("edge"), F.lit(k).alias("place")) for k, (n, edge) in enumerate(AGES, 1)))
    delay = F.datediff("paid", "due")
    final = F.when(F.col("paid").isNotNull() & (delay <= MATURITY_DAYS), delay).otherwise(MATURITY_DAYS + 1)
    dealt = rows.select("due", final.alias("d"), F.explode(ages).alias("a")).where(F.col("a.edge").isNull() | (F.col("d") > F.col("a.edge")))
    matures = F.greatest(month_start(F.date_add("due", MATURITY_DAYS)), F.lit(first).cast("date"))
    monthly = dealt.groupBy(matures.alias("month"), F.col("a.age").alias("age"), F.col("a.place").alias("place")).agg(F.count("*").alias("n"), F.count_if(F.col("d") <= MATURITY_DAYS).alias("k")).where(F.col("month") <= F.lit(last).cast("date"))
    grid = rows.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("INTERVAL 1 MONTH"))).alias("month")).select("month", F.explode(ages).alias("a")).select("month", "a.age", "a.place")
    so_far = Window.partitionBy("age").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    table = grid.join(monthly, ["month", "age", "place"], "left").withColumns({c: F.coalesce(F.sum(c).over(so_far), F.lit(0)) for c in ("n", "k")})
    overall = F.max(F.when((F.col("place") == 0) & (F.col("n") > 0), F.col("k") / F.col("n"))).over(Window.partitionBy("month"))
    rate = F.when(F.col("n") >= PAYMENT_LEAST, F.col("k") / F.col("n")).otherwise(F.coalesce(overall, F.lit(PAYMENT_PRIOR)))
    return table.select(F.last_day("month").alias("cut"), "age", F.col("n").alias("n_at_risk"), F.col("k").alias("n_paid"), rate.alias("rate"))


def age_of(days: Column) -> Column:
    """Age of an invoice by days past due."""
    out = F.lit("not_due")
    for name, edge in AGES:
        out = F.when(days >= edge, name).otherwise(out)
    return out


def receivable_rows(invoices: DataFrame, side: str) -> DataFrame:
    """Invoices of a side that count, with issue, due and real payment days and a known amount or none."""
    real = F.when(F.col("status_norm") == "paid", F.col("payment_date_ok"))
    known = F.when(~F.coalesce("fx_ambiguous", F.lit(False)), F.abs("amount_eur"))
    sign = F.col("amount") > 0 if side == "ar" else F.col("amount") < 0
    rows = invoices.where((F.col("document_type_norm") == "invoice") & (F.col("status_norm") != "cancel") & sign & F.col("issuance_date_ok").isNotNull() & F.col("due_date_ok").isNotNull())
    return rows.select("company_id", F.lit(side).alias("side"), F.col("issuance_date_ok").alias("issued"), F.col("due_date_ok").alias("due"), real.alias("paid"), known.alias("eur"))


def live_at_cuts(rows: DataFrame, first: str, last: str) -> DataFrame:
    """One row per invoice and cut at which it is issued and not paid."""
    end = F.least(F.when(F.col("paid").isNull(), F.lit(last).cast("date")).otherwise(F.add_months(month_start(F.col("paid")), -1)), F.lit(last).cast("date"))
    dealt = rows.withColumn("month", F.explode(_months(F.greatest(month_start(F.col("issued")), F.lit(first).cast("date")), end)))
    return dealt.withColumn("cut", F.last_day("month")).where((F.col("issued") <= F.col("cut")) & (F.col("paid").isNull() | (F.col("paid") > F.col("cut"))))


def expected_rows(rows: DataFrame, rates: DataFrame, delays: DataFrame, sides: DataFrame, first: str, last: str) -> DataFrame:
    """Invoices live at cuts (live_at_cuts) with the day on which they are expected, never before the day after the cut, and the expected amount.

    ``delays`` is ``(cut, company_id, expected_delay)`` of one side, for companies with payments of their own, ``sides`` the side's ``(cut, side_delay)``; the others are expected after the side's median delay, and on the due day where nobody has paid yet.
    A company's delays are one array, which meets its invoices before they make their cuts; rates and the sides' medians are a row per cut and age, and broadcast. So live invoices are neither shuffled nor dealt to the few cuts.
    """
    sides = sides.select("cut", F.col("side_delay").alias("_side"))
    own = delays.groupBy("company_id").agg(F.map_from_entries(F.collect_list(F.struct("cut", "expected_delay"))).alias("_own"))
    live = live_at_cuts(rows.join(own.hint("merge"), "company_id", "left"), first, last)
    aged = live.withColumns({"age": age_of(F.datediff("cut", "due")), "expected_delay": F.try_element_at("_own", F.col("cut"))}).drop("_own")
    aged = aged.join(F.broadcast(rates.select("cut", "age", "rate")), ["cut", "age"]).join(F.broadcast(sides), "cut", "left")
    day = F.date_add("due", F.round(F.coalesce("expected_delay", "_side", F.lit(0.0))).cast("int"))
    return aged.select("company_id", "cut", "age", "eur", "due", "rate", F.greatest(day, F.date_add("cut", 1)).alias("day"), (F.col("eur") * F.col("rate")).alias("expected_eur"))


def dated_calendar(expected: DataFrame, days: int = max(HORIZONS)) -> DataFrame:
    """Expected amount per company, cut and day."""
    inside = expected.where(F.col("eur").isNotNull() & (F.col("day") <= F.date_add("cut", days)))
    return inside.groupBy("company_id", "cut", "day").agg(F.sum("expected_eur").alias("expected_eur"), F.count("*").alias("n_invoices"))


def horizon_totals(expected: DataFrame, last_day: str) -> DataFrame:
    """Expected amount within each horizon per company and cut, what is live, and what cannot be valued; whether the horizon can be checked."""
    valued = F.col("eur").isNotNull()
    dealt = expected.withColumn("h", F.explode(F.array(*map(F.lit, HORIZONS))))
    inside = valued & (F.col("day") <= F.date_add("cut", F.col("h")))
    sums = dealt.groupBy("company_id", "cut", "h").agg(F.count("*").alias("n_live"), F.coalesce(F.sum("eur"), F.lit(0.0)).alias("live_eur"), F.count_if(inside).alias("n_expected"), F.coalesce(F.sum(F.when(inside, F.col("expected_eur"))), F.lit(0.0)).alias("expected_eur"), F.count_if(~valued).alias("n_without_value"))
    return sums.withColumn("can_be_checked", F.date_add("cut", F.col("h")) <= F.lit(last_day).cast("date"))


def cut_census(expected: DataFrame) -> DataFrame:
    """Live invoices and expected amounts per cut and age."""
    return expected.groupBy("cut", "age").agg(F.count("*").alias("n_live"), F.count_distinct("company_id").alias("n_companies"), F.sum("eur").alias("live_eur"), F.sum("expected_eur").alias("expected_eur"))


def projection_union(receipts: DataFrame, payments: DataFrame, start: DataFrame) -> DataFrame:
    """Daily balance from the balance at the cut, expected receipts and payments, and the first day on which it is negative."""
    r = receipts.select("company_id", "cut", "day", F.col("expected_eur").alias("receipts"))
    p = payments.select("company_id", "cut", "day", F.col("expected_eur").alias("payments"))
    days = r.join(p, ["company_id", "cut", "day"], "full").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("receipts", "payments")}).join(start, ["company_id", "cut"], "left")
    w = Window.partitionBy("company_id", "cut").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    days = days.withColumn("balance", F.col("balance_at_cut") + F.sum(F.col("receipts") - F.col("payments")).over(w))
    return days.withColumn("first_negative", F.min(F.when(F.col("balance") < 0, F.col("day"))).over(Window.partitionBy("company_id", "cut"))).select("company_id", "cut", "day", "receipts", "payments", "balance", "first_negative")
