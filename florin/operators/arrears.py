"""Arrears and obligations at month ends, point in time: what was due by then, and paid by then only if the payment is real."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from florin.functions.core import known_if, month_index, month_start

# Fixed values of the arrears index and of the obligation multiplier.
SEVERITY_WEIGHTS = (0.10, 0.25, 0.45, 0.70, 1.00)
KAPPA = 4178.45
SMOOTHING = 0.35
SIDE_WEIGHTS = {"ap": 0.7, "ar": 0.3}
OBLIGATION_WEIGHTS = (1.0, 1.5, 2.0, 3.0, 5.0)
LEAST_MULTIPLIER = 0.5
LEAST_SERVICE_MONTHS = 3
NORMAL_MONTHS = 6


def payables(invoices: DataFrame) -> DataFrame:
    """Due, not cancelled invoices by side, with the real payment date and a known amount or none."""
    real = F.when(F.col("status_norm") == "paid", F.col("payment_date_ok"))
    known = F.when(~F.coalesce("fx_ambiguous", F.lit(False)), F.abs("amount_eur"))
    return invoices.where((F.col("document_type_norm") == "invoice") & (F.col("status_norm") != "cancel") & F.col("due_date_ok").isNotNull() & (F.col("amount") != 0)).select(
        "company_id", F.when(F.col("amount") > 0, "ar").otherwise("ap").alias("side"), F.col("due_date_ok").alias("due"), real.alias("paid"), known.alias("eur"))


def _first_month(day: Column, first: str) -> Column:
    return F.greatest(month_start(day), F.lit(first).cast("date"))


def due_so_far(rows: DataFrame, first: str, last: str) -> DataFrame:
    """Portfolio, holes and exposure due up to each month end.

    What was once due stays in the portfolio, so it is summed per month and then
    accumulated over the months, instead of dealing every invoice to all later months.
    """
    added = rows.where(F.col("due") <= F.last_day(F.lit(last).cast("date"))).groupBy("company_id", "side", _first_month(F.col("due"), first).alias("month")).agg(
        F.count("*").alias("n"), F.count_if(F.col("eur").isNull()).alias("holes"), F.coalesce(F.sum("eur"), F.lit(0.0)).alias("eur"))
    months = F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("INTERVAL 1 MONTH"))
    grid = added.select("company_id", "side").distinct().withColumn("month", F.explode(months))
    so_far = Window.partitionBy("company_id", "side").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    total = lambda c: F.coalesce(F.sum(c).over(so_far), F.lit(0))
    return grid.join(added, ["company_id", "side", "month"], "left").select("company_id", "side", "month", total("n").alias("n_portfolio"), total("holes").alias("n_holes"), total("eur").alias("exposure"))


def overdue_rows(rows: DataFrame, first: str, last: str) -> DataFrame:
    """One row per invoice and month end at which it is due and not yet paid."""
    end = F.least(F.when(F.col("paid").isNull(), F.lit(last).cast("date")).otherwise(F.add_months(month_start(F.col("paid")), -1)), F.lit(last).cast("date"))
    begin = _first_month(F.col("due"), first)
    dealt = rows.withColumn("month", F.explode(F.when(begin <= end, F.sequence(begin, end, F.expr("INTERVAL 1 MONTH")))))
    return dealt.withColumn("days", F.datediff(F.last_day("month"), "due"))


def _bucket(days: Column, last_edge: int) -> Column:
    return F.when(days <= 30, 0).when(days <= 60, 1).when(days <= 90, 2).when(days <= last_edge, 3).otherwise(4)


def severity(rows: DataFrame, first: str, last: str) -> DataFrame:
    """Overdue amounts in five ages per company, side and month, and the weighted severity over what was due."""
    late = overdue_rows(rows, first, last).where("eur IS NOT NULL").withColumn("bucket", _bucket(F.col("days"), 180))
    weight = F.element_at(F.array(*map(F.lit, SEVERITY_WEIGHTS)), F.col("bucket") + 1)
    sums = late.groupBy("company_id", "side", "month").agg(F.sum("eur").alias("overdue"), F.sum(weight * F.col("eur")).alias("weighted"), *(F.coalesce(F.sum(F.when(F.col("bucket") == k, F.col("eur"))), F.lit(0.0)).alias(f"bucket_{k}") for k in range(5)))
    out = due_so_far(rows, first, last).join(sums, ["company_id", "side", "month"], "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("overdue", "weighted", *(f"bucket_{k}" for k in range(5)))})
    return out.withColumn("severity", F.when(F.col("exposure") > 0, F.col("weighted") / F.col("exposure")))


def _with_robust(severities: DataFrame) -> DataFrame:
    order = Window.partitionBy("company_id", "side").orderBy("month")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    seen = F.col("severity").isNotNull()
    past = F.sum(F.when(seen, F.col("weighted"))).over(before) / F.sum(F.when(seen, F.col("exposure"))).over(before)
    drawn = F.when(past.isNull(), F.col("severity")).otherwise((F.col("weighted") + KAPPA * past) / (F.col("exposure") + KAPPA))
    rows = severities.withColumn("drawn", known_if(seen, drawn))
    # smoothing over observed months as one running sum: each value counts by the power of its place, so that no month goes over all earlier ones again;
    # the powers stay finite up to some 1,600 months
    decay = F.lit(1 - SMOOTHING)
    rows = rows.withColumn("_place", F.count("drawn").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    part = F.when(F.col("_place") == 0, F.col("drawn")).otherwise(SMOOTHING * F.col("drawn") * F.pow(decay, -F.col("_place")))
    smooth = F.pow(decay, F.col("_place")) * F.sum(part).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("robust", known_if(F.col("drawn").isNotNull(), smooth)).drop("_place")


def _both_sides() -> Column:
    return F.coalesce(SIDE_WEIGHTS["ap"] * F.col("ap") + SIDE_WEIGHTS["ar"] * F.col("ar"), F.col("ap"), F.col("ar"))


def arrears_index(severities: DataFrame) -> DataFrame:
    """Severity drawn to the company's own earlier one, smoothed over observed months, and both sides combined; one side alone stands for both."""
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("robust")))
    both = _with_robust(severities).groupBy("company_id", "month").agg(side("ap").alias("ap"), side("ar").alias("ar"))
    return both.withColumn("arrears", _both_sides())


def arrears_panel(rows: DataFrame, first: str, last: str) -> DataFrame:
    """``(company_id, month, ap, ar, arrears, overdue_ar, n_overdue, overdue_eur, bucket_0 to bucket_4)`` wherever something was due: arrears_index and overdue_obligation in one.

    Invoices are dealt by company once. Each then makes the month from which it is due, in which it enters the exposure that a window carries on, and the later ones
    in which it is late; all that follows groups within a company, so months are never shuffled. Months are counted from ``first`` until they are grouped.
    """
    start, end = F.lit(first).cast("date"), F.lit(last).cast("date")
    starts = F.sequence(start, F.add_months(end, 1), F.expr("INTERVAL 1 MONTH"))
    count = lambda day: F.greatest(F.lit(0), month_index(day) - month_index(start))
    last_k = month_index(end) - month_index(start)
    until = F.when(F.col("paid").isNull(), last_k).otherwise(F.least(last_k, month_index(F.col("paid")) - month_index(start) - 1))
    due = rows.where(F.col("due") <= F.last_day(end)).repartition("company_id").withColumns({"begin": count(F.col("due")), "until": until})
    due = due.withColumn("k", F.explode(F.sequence("begin", F.greatest("begin", "until"))))
    due = due.withColumns({"days": F.datediff(F.date_sub(F.element_at(starts, F.col("k") + 2), 1), "due"), "late": F.col("k") <= F.col("until")})
    weight = F.element_at(F.array(*map(F.lit, SEVERITY_WEIGHTS)), _bucket(F.col("days"), 180) + 1)
    when_late = lambda value, c=F.lit(True): F.sum(F.when(F.col("late") & c, value))
    zero, eur = F.lit(0.0), F.col("eur")
    sums = due.groupBy("company_id", "side", "k").agg(
        F.coalesce(F.sum(F.when(F.col("k") == F.col("begin"), eur)), zero).alias("entered"), F.coalesce(when_late(weight * eur), zero).alias("weighted"), F.count_if("late").alias("n_overdue"), when_late(eur).alias("overdue_eur"),
        *(F.coalesce(when_late(eur, _bucket(F.col("days"), 179) == k), zero).alias(f"bucket_{k}") for k in range(5)),
    )
    order = Window.partitionBy("company_id", "side").orderBy("k")
    sums = sums.withColumns({"exposure": F.sum("entered").over(order.rowsBetween(Window.unboundedPreceding, 0)), "next": F.coalesce(F.lead("k").over(order), last_k + 1)})
    # a month in which nothing enters and nothing is late has the exposure of the one before
    sums = sums.withColumn("at", F.explode(F.sequence("k", F.col("next") - 1)))
    here = F.col("at") == F.col("k")
    sums = sums.select("company_id", "side", F.element_at(starts, F.col("at") + 1).alias("month"), "exposure", F.when(here, F.col("overdue_eur")).alias("overdue_eur"), F.when(here, F.col("n_overdue")).otherwise(0).alias("n_overdue"), *(F.when(here, F.col(c)).otherwise(0.0).alias(c) for c in ("weighted", *(f"bucket_{k}" for k in range(5)))))
    robust = _with_robust(sums.withColumn("severity", F.when(F.col("exposure") > 0, F.col("weighted") / F.col("exposure"))))
    of = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))  # noqa: E731  one row a side
    both = robust.groupBy("company_id", "month").agg(of("ap", "robust").alias("ap"), of("ar", "robust").alias("ar"), of("ar", "overdue_eur").alias("overdue_ar"), of("ap", "n_overdue").alias("n_overdue"), of("ap", "overdue_eur").alias("overdue_eur"), *(of("ap", f"bucket_{k}").alias(f"bucket_{k}") for k in range(5)))
    return both.withColumn("arrears", _both_sides())


def overdue_obligation(rows: DataFrame, first: str, last: str) -> DataFrame:
    """Overdue payables in five ages at every month end, with the number of them whose amount is unknown."""
    late = overdue_rows(rows.where("side = 'ap'"), first, last).withColumn("bucket", _bucket(F.col("days"), 179))
    amounts = [F.coalesce(F.sum(F.when(F.col("bucket") == k, F.col("eur"))), F.lit(0.0)).alias(f"bucket_{k}") for k in range(5)]
    return late.groupBy("company_id", "month").agg(F.count("*").alias("n_overdue"), F.count_if(F.col("eur").isNull()).alias("n_unknown"), F.sum("eur").alias("overdue_eur"), *amounts)


def with_expected_service(rows: DataFrame) -> DataFrame:
    """``expected`` and ``shortfall`` beside ``service_eur``."""
    before = Window.partitionBy("company_id").orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    positive = F.when(F.col("service_eur") > 0, F.col("service_eur"))
    rows = rows.withColumns({"_median": F.percentile(positive, F.lit(0.5)).over(before), "_n": F.count(positive).over(before)})
    rows = rows.withColumn("expected", known_if(F.col("_n") >= LEAST_SERVICE_MONTHS, F.col("_median"))).drop("_median", "_n")
    return rows.withColumn("shortfall", F.when(F.col("expected").isNotNull() & F.col("service_eur").isNotNull(), F.greatest(F.lit(0.0), F.col("expected") - F.col("service_eur"))))


def expected_service(debt: DataFrame) -> DataFrame:
    """Debt service to expect: the median of the earlier positive months, if there are three; and what is missing of it."""
    return with_expected_service(debt.select("company_id", "month", "service_eur"))


def with_multiplier(rows: DataFrame) -> DataFrame:
    """``multiplier`` and T6 of rows that have payments, expected service and overdue payables."""
    window = Window.partitionBy("company_id").orderBy("month").rowsBetween(1 - NORMAL_MONTHS, 0)
    known = F.col("payments_eur").isNotNull() | F.col("service_eur").isNotNull()
    rows = rows.withColumns({"paid6": F.sum(F.coalesce("payments_eur", F.lit(0.0)) + F.coalesce("service_eur", F.lit(0.0))).over(window), "known6": F.count_if(known).over(window)})
    t6 = F.when((F.col("known6") > 0) & (F.col("paid6") > 0), F.col("paid6")).when(F.col("expected") > 0, F.col("expected") * NORMAL_MONTHS).when(F.col("known6") > 0, 0.0)
    rows = rows.withColumns({"n_overdue": F.coalesce("n_overdue", F.lit(0)), "t6": t6})
    weighted = sum((w * F.col(f"bucket_{k}") for k, w in enumerate(OBLIGATION_WEIGHTS)), F.lit(0.0))
    multiplier = (
        F.when((F.col("n_overdue") == 0) | (F.col("overdue_eur") == 0), 1.0).when(F.col("overdue_eur").isNull() | F.col("t6").isNull(), F.lit(None)).when(weighted <= 0, 1.0)
        .when(F.col("t6") <= 0, LEAST_MULTIPLIER).otherwise(F.greatest(F.lit(LEAST_MULTIPLIER), 1.0 - weighted / F.nullif("t6", F.lit(0.0))))
    )
    return rows.withColumn("multiplier", multiplier)


def obligation_multiplier(obligation: DataFrame, flows: DataFrame, service: DataFrame) -> DataFrame:
    """max(0.5, 1 - severity / T6) where T6 is what the company paid in six months, known parts only."""
    paid = flows.select("company_id", "month", "payments_eur").join(service, ["company_id", "month"])
    rows = with_multiplier(paid.join(obligation, ["company_id", "month"], "left"))
    return rows.select("company_id", "month", "n_overdue", "overdue_eur", "t6", "expected", "shortfall", "multiplier")


def live_invoices(rows: DataFrame, issued: str, first: str, last: str) -> DataFrame:
    """Invoices that a cut knows and has not seen paid: issued by the cut, paid later or never."""
    end = F.least(F.when(F.col("paid").isNull(), F.lit(last).cast("date")).otherwise(F.add_months(month_start(F.col("paid")), -1)), F.lit(last).cast("date"))
    begin = _first_month(F.col(issued), first)
    return rows.withColumn("cut", F.explode(F.when(begin <= end, F.sequence(begin, end, F.expr("INTERVAL 1 MONTH"))))).withColumn("cut", F.last_day("cut"))


def _cuts_from(day: Column, first: str, last: str) -> Column:
    return F.sequence(_first_month(day, first), F.lit(last).cast("date"), F.expr("INTERVAL 1 MONTH"))


def delay_profile(rows: DataFrame, first: str, last: str, least: int = 10) -> DataFrame:
    """Expected delay per cut, company and side: the company's median over payments by the cut if it has ten, else its side's, which is given as well.

    Payments are dealt by company and counted per month and delay before they make their cuts, which are not shuffled; the sides' counts are a row per month and delay.
    """
    counted = _paid_delays(rows, first, last).repartition("company_id").groupBy("company_id", "side", "month", "delay").agg(F.count("*").alias("n")).withColumn("cut", F.explode(_cuts_from(F.col("month"), first, last)))
    # exact medians from counts per delay
    own = counted.groupBy("company_id", "side", "cut").agg(F.sum("n").alias("n_paid"), F.percentile("delay", F.lit(0.5), F.col("n")).alias("own")).withColumn("cut", F.last_day("cut"))
    return own.join(F.broadcast(side_delays(rows, first, last)), ["cut", "side"]).select("cut", "side", "company_id", "n_paid", F.when(F.col("n_paid") >= least, F.col("own")).otherwise(F.col("side_delay")).alias("expected_delay"), "side_delay")


def _paid_delays(rows: DataFrame, first: str, last: str) -> DataFrame:
    return rows.where(F.col("paid") <= F.last_day(F.lit(last).cast("date"))).select("company_id", "side", _first_month(F.col("paid"), first).alias("month"), F.datediff("paid", "due").alias("delay"))


def side_delays(rows: DataFrame, first: str, last: str) -> DataFrame:
    """``(cut, side, side_delay)``: the side's median over payments by the cut, a row per cut and side."""
    counted = _paid_delays(rows, first, last).groupBy("side", "month", "delay").agg(F.count("*").alias("n")).withColumn("cut", F.explode(_cuts_from(F.col("month"), first, last)))
    return counted.groupBy(F.last_day("cut").alias("cut"), "side").agg(F.percentile("delay", F.lit(0.5), F.col("n")).alias("side_delay"))
