"""Cash layers: monthly and daily flows, position forward from the first month, balance backward from an anchor.

All of it is windows over a company's months or days; the largest window holds one company's calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from florin.functions.core import flags, known_if, sum_where

#: Account types that count as cash; the anchored layers add the terminals.
CASH = ("checking", "saving", "wallet")
ANCHORED = (*CASH, "tpv")
COVER_MONTHS = 6
COVER_DAYS = 180


def anchored_sums() -> list[Column]:
    """Known flow, its volume and volume of holes of the anchored accounts, among booked movements of closed months."""
    eur, inside = F.col("amount_eur"), (F.col("product_source") == "banking") & F.col("product_type").isin(*ANCHORED)
    return [sum_where(eur, inside).alias("net"), sum_where(F.abs(eur), inside).alias("known_volume"), sum_where(F.abs("amount"), inside & eur.isNull()).alias("hole_volume")]


def cash_flows(tx: DataFrame, by: str, products: tuple[str, ...] = CASH) -> DataFrame:
    """Known flow, inflow, outflow, known volume and volume of holes per company and ``by`` ('month' or 'date_ok').

    A hole is a movement without EUR amount; its own-currency size stands for it.
    """
    eur = F.col("amount_eur")
    inside = F.col("is_booked") & ~F.col("is_open_month") & (F.col("product_source") == "banking") & F.col("product_type").isin(*products)
    return tx.where(inside).groupBy("company_id", by).agg(
        sum_where(eur).alias("net"), sum_where(eur, eur > 0).alias("inflow"), sum_where(-eur, eur < 0).alias("outflow"), sum_where(F.abs(eur)).alias("known_volume"), sum_where(F.abs("amount"), eur.isNull()).alias("hole_volume"), F.count("*").alias("n_movements"))


def _cover(cushion: Column, mean_out: Column) -> Column:
    return F.when(mean_out > 0, cushion / mean_out)


def hole_confidence(known: Column, hole: Column) -> Column:
    """high to 5 % holes, medium to 25 %, low to 50 %, else none."""
    part = F.when(known + hole > 0, hole / (known + hole))
    return F.when(part <= 0.05, "high").when(part <= 0.25, "medium").when(part <= 0.5, "low").otherwise("none")


def forward_position(monthly: DataFrame) -> DataFrame:
    """Cumulative flow from a company's first active month, its band from holes, cushion above the running minimum, and months of cover."""
    span = monthly.groupBy("company_id").agg(F.min("month").alias("first"), F.max("month").alias("last"))
    grid = span.select("company_id", F.explode(F.sequence("first", "last", F.expr("INTERVAL 1 MONTH"))).alias("month"))
    amounts = ("net", "outflow", "known_volume", "hole_volume")
    rows = grid.join(monthly, ["company_id", "month"], "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in amounts})
    order = Window.partitionBy("company_id").orderBy("month")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"position": F.sum("net").over(so_far), "holes": F.sum("hole_volume").over(so_far), "known": F.sum("known_volume").over(so_far), "mean_out": F.avg("outflow").over(order.rowsBetween(1 - COVER_MONTHS, 0)), "n_months": F.count("*").over(so_far), "n_active_months": F.count("n_movements").over(so_far)})
    rows = rows.withColumn("lowest", F.min("position").over(so_far))
    cushion = F.col("position") - F.col("lowest")
    return rows.select(
        "company_id", "month", "net", "position", (F.col("position") - F.col("holes")).alias("position_min"), (F.col("position") + F.col("holes")).alias("position_max"), cushion.alias("cushion"),
        known_if(F.col("mean_out") > 0, F.col("mean_out")).alias("mean_monthly_out"), _cover(cushion, F.col("mean_out")).alias("months_of_cover"), hole_confidence(F.col("known"), F.col("holes")).alias("confidence"), "n_months", "n_active_months",
        flags((F.col("position") < 0, "negative_position"), (F.col("holes") > 0, "holes_in_span"), (F.col("mean_out") <= 0, "no_known_outflow")).alias("flags"),
    )


def anchors(balances: DataFrame) -> DataFrame:
    """Balance per company at the anchor; null if any account's balance is unknown."""
    cash = balances.where((F.col("product_source") == "banking") & (F.col("product_currency") == "EUR"))
    total = cash.groupBy("company_id").agg(F.sum("balance_ok").alias("known"), F.count_if(F.col("balance_ok").isNull()).alias("unknown"))
    return total.select("company_id", known_if(F.col("unknown") == 0, F.col("known")).alias("anchor"))


def with_balance(rows: DataFrame, key: str) -> DataFrame:
    """Balance as the anchor less all later flows; null without an anchor or across a hole."""
    # from the last day backward, so that the sums run on; a frame from the next row to the end would be summed anew for every row
    later = Window.partitionBy("company_id").orderBy(F.col(key).desc()).rowsBetween(Window.unboundedPreceding, -1)
    after = lambda c: F.coalesce(F.sum(c).over(later), F.lit(0.0))
    rows = rows.withColumns({"later_net": after("net"), "later_holes": after("hole_volume"), "later_known": after("known_volume")})
    return rows.withColumn("balance", known_if(F.col("later_holes") == 0, F.col("anchor") - F.col("later_net")))


def _backward(rows: DataFrame, key: str, mean_out: Column) -> DataFrame:
    """``rows`` with the balance, and the lowest one so far, by ``key``; only known balances have a lowest one."""
    order = Window.partitionBy("company_id").orderBy(key)
    rows = with_balance(rows.withColumn("mean_out", mean_out), key)
    return rows.withColumn("lowest", F.when(F.col("balance").isNotNull(), F.min("balance").over(order.rowsBetween(Window.unboundedPreceding, 0))))


def _described(rows: DataFrame, key: str) -> DataFrame:
    cushion = F.col("balance") - F.col("lowest")
    part = F.when(F.col("later_known") + F.col("later_holes") > 0, F.col("later_holes") / (F.col("later_known") + F.col("later_holes"))).otherwise(0.0)
    confidence = F.when(F.col("anchor").isNull(), "none").when(part == 0, "high").when(part <= 0.25, "medium").when(part <= 0.5, "low").otherwise("none")
    reason = F.when(F.col("anchor").isNull(), "no_anchor").when(F.col("later_holes") > 0, "holes_in_span").when(F.col("mean_out") <= 0, "no_known_outflow")
    return rows.select("company_id", key, "net", "balance", cushion.alias("cushion"), known_if(F.col("mean_out") > 0, F.col("mean_out")).alias("mean_monthly_out"), _cover(cushion, F.col("mean_out")).alias("months_of_cover"), confidence.alias("confidence"), reason.alias("reason"))


def backward_balance(monthly: DataFrame, anchor: DataFrame, companies: DataFrame, first: str, anchor_month: str) -> DataFrame:
    """Month-end balances of every company from the anchor backward, over the whole calendar and the anchor month."""
    months = F.sequence(F.lit(first).cast("date"), F.lit(anchor_month).cast("date"), F.expr("INTERVAL 1 MONTH"))
    rows = companies.select("company_id", F.explode(months).alias("month")).join(monthly, ["company_id", "month"], "left").join(anchor, "company_id", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("net", "outflow", "known_volume", "hole_volume")})
    return _described(_backward(rows, "month", F.avg("outflow").over(Window.partitionBy("company_id").orderBy("month").rowsBetween(1 - COVER_MONTHS, 0))), "month")


def daily_panel(daily: DataFrame, anchor: DataFrame, anchor_day: str) -> DataFrame:
    """Dense days from a company's first to its last movement and the anchor day, with the balance backward and cover over 180 days.

    Sums change only on days with movements, and 180 days after one, when it leaves the cover. The windows run over these days and the
    anchor day; each then makes the days up to the next one, which are neither shuffled nor sorted.
    """
    amounts = ("net", "outflow", "known_volume", "hole_volume")
    moved = daily.where("date_ok IS NOT NULL").groupBy("company_id").agg(F.min("date_ok").alias("first"), F.max("date_ok").alias("last"), F.collect_list(F.struct(F.col("date_ok").alias("day"), *amounts)).alias("moved"))
    at = F.lit(anchor_day).cast("date")
    leaving = F.filter(F.transform("moved", lambda d: F.date_add(d["day"], COVER_DAYS)), lambda day: day <= F.col("last"))
    idle = F.array_except(F.array_append(leaving, at), F.transform("moved", lambda d: d["day"]))
    zero = [F.lit(0.0).alias(c) for c in amounts]
    turns = F.concat("moved", F.transform(idle, lambda day: F.struct(day.alias("day"), *zero)))
    rows = moved.select("company_id", "first", "last", F.explode(turns).alias("turn")).select("company_id", "first", "last", "turn.*").join(anchor.hint("merge"), "company_id", "left")
    rows = rows.withColumn("n", F.datediff("day", F.lit("1970-01-01").cast("date")))
    by_day = Window.partitionBy("company_id").orderBy("n")
    rows = _backward(rows, "n", F.sum("outflow").over(by_day.rangeBetween(1 - COVER_DAYS, 0)))
    inside = F.col("day").between(F.col("first"), F.col("last"))
    until = F.when(inside, F.least(F.date_sub(F.lead("day").over(by_day), 1), "last")).otherwise(F.col("day"))
    rows = rows.withColumn("until", until).withColumnRenamed("day", "turn")
    kept = ("company_id", "first", "turn", "anchor", "balance", "lowest", "later_known", "later_holes")
    rows = rows.select(*kept, F.col("net").alias("moved"), F.col("mean_out").alias("out"), F.explode(F.sequence("turn", "until")).alias("day"))
    months = F.greatest(F.lit(1.0), F.least(F.lit(6.0), (F.datediff("day", "first") + 1) / 30.0))
    return _described(rows.withColumns({"net": F.when(F.col("day") == F.col("turn"), F.col("moved")).otherwise(0.0), "mean_out": F.col("out") / months}), "day")


def forward_backward_difference(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """How the two reconstructions differ per month: levels differ by the unknown start, changes should not."""
    step = lambda c: F.col(c) - F.lag(c).over(Window.partitionBy("company_id").orderBy("month"))
    f = forward.select("company_id", "month", "position", step("position").alias("f_change"))
    b = backward.select("company_id", "month", "balance", step("balance").alias("b_change"))
    both = f.join(b, ["company_id", "month"]).where("balance IS NOT NULL")
    return both.groupBy("month").agg(F.count("*").alias("n"), F.median(F.col("balance") - F.col("position")).alias("median_level_gap"), F.max(F.abs(F.col("f_change") - F.col("b_change"))).alias("max_change_gap"), F.corr("position", "balance").alias("pearson"))


def density_census(daily: DataFrame, anchor_day: str) -> DataFrame:
    """Per company: active days, most active days in any 30, 60 and 90 days, and the longest gap."""
    days = daily.select("company_id", F.col("date_ok").alias("day"), F.datediff("date_ok", F.lit("1970-01-01").cast("date")).alias("n"))
    order = Window.partitionBy("company_id").orderBy("n")
    days = days.withColumns({f"in_{w}": F.count("*").over(order.rangeBetween(1 - w, 0)) for w in (30, 60, 90)}).withColumn("gap", F.col("n") - F.lag("n").over(order) - 1)
    return days.groupBy("company_id").agg(F.count("*").alias("n_active_days"), *(F.max(f"in_{w}").alias(f"most_in_{w}") for w in (30, 60, 90)), F.coalesce(F.max("gap"), F.lit(0)).alias("longest_gap"), F.datediff(F.lit(anchor_day).cast("date"), F.max("day")).alias("days_since_last"))


def daily_monthly_difference(daily: DataFrame, monthly: DataFrame) -> DataFrame:
    """Largest absolute difference between a month's flow and the sum of its days."""
    summed = daily.groupBy("company_id", F.trunc("date_ok", "MM").alias("month")).agg(F.sum("net").alias("from_days"))
    both = monthly.join(summed, ["company_id", "month"], "full")
    return both.agg(F.count("*").alias("n_months"), F.max(F.abs(F.coalesce("net", F.lit(0.0)) - F.coalesce("from_days", F.lit(0.0)))).alias("max_difference"))
