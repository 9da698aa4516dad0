"""State machines over a company's months: economic events against a fixed reference, and alerts issued from probabilities.

Both are folds with ``aggregate`` over one company's ordered months, which are as many as the calendar has; companies are independent.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Months of reference, least change in EUR and as a share of receipts; the alert threshold, and origins below it that end an alert.
REFERENCE_MONTHS = 3
LEAST_CHANGE, CHANGE_SHARE = 1000.0, 0.05
THRESHOLD, RESET_AFTER = 0.60, 2
EVENT_SIGNS = ("deterioration", "improvement")
ARREARS, GENERATION = 1, 2


def economic_months(obligations: DataFrame, receipts: DataFrame) -> DataFrame:
    """``(company_id, month, is_complete, receipts, generation, late, newly_late, paid_late)``: receipts less what operations owe by due date, what is over 30 days late, what
    became so in the month, and payments so far on what was so before. A month with a reason against its obligations is not complete."""
    rows = obligations.join(receipts.select("company_id", "month", "receipts"), ["company_id", "month"], "left")
    money = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    so_far = Window.partitionBy("company_id").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    paid = F.sum(F.coalesce(F.col("paid_late"), F.lit(0).cast("decimal(38, 8)"))).over(so_far)
    return rows.select("company_id", "month", "is_complete", money("receipts").alias("receipts"), (money("receipts") - money("operating_due")).alias("generation"), money("late_over_30").alias("late"), money("newly_late").alias("newly_late"), paid.cast("double").alias("paid_late"))


def _branches(sign: str, ref: Column, row: Column) -> Column:
    """Bits of the branches that hold in a month against a reference; null where the month is not complete."""
    f, q, z = row["generation"], row["late"], row["newly_late"]
    if sign == "deterioration":
        arrears, generation = q - ref["q"] >= ref["a"], (f <= ref["f"] - ref["a"]) & (f < 0)
    else:
        arrears = (ref["q"] >= ref["a"]) & (q <= ref["q"] / 2) & (row["paid_late"] - ref["p"] >= ref["a"]) & (z < ref["a"]) & (f >= ref["f"] - ref["a"])
        generation = (f >= ref["f"] + ref["a"]) & (f > 0) & (q <= ref["q"]) & (z < ref["a"])
    return F.when(row["is_complete"], F.when(arrears, ARREARS).otherwise(0) + F.when(generation, GENERATION).otherwise(0))


def with_reference(months: DataFrame) -> DataFrame:
    """Every month with the next one and its reference: mean receipts and generation of the three months before, if all are complete and something was received; ``a`` is the least change that counts."""
    order = Window.partitionBy("company_id").orderBy("month")
    back = lambda c: [F.lag(c, k).over(order) for k in range(REFERENCE_MONTHS, 0, -1)]
    mean = lambda c: sum(back(c)[1:], back(c)[0]) / float(REFERENCE_MONTHS)
    complete = back("is_complete")
    known = F.coalesce(complete[0] & complete[1] & complete[2], F.lit(False)) & (mean("receipts") > 0)
    values = ["is_complete", "generation", "late", "newly_late", "paid_late"]
    out = months.withColumns({
        "now": F.struct(*values), "next": F.lead(F.struct(*values)).over(order), "_place": F.row_number().over(order),
        "ref": F.when(known, F.struct(mean("generation").alias("f"), F.lag("late").over(order).alias("q"), F.greatest(F.lit(LEAST_CHANGE), CHANGE_SHARE * mean("receipts")).alias("a"), F.lag("paid_late").over(order).alias("p"))),
    })
    return out.where(F.col("_place") > REFERENCE_MONTHS).select("company_id", "month", "now", "next", "ref")


def _scan(sign: str) -> Column:
    """Decisions of one sign, month by month.

    Outside an episode a month and the next one are held against the month's own reference: a branch that holds in both is an event, and
    what cannot be told begins an unknown episode. Inside, months are held against the episode's reference until no branch holds twice running.
    """
    found = "array<struct<month: date, decision: string, branches: int>>"
    none = F.struct(F.lit(None).cast("struct<f: double, q: double, a: double, p: double>").alias("ref"), F.lit(False).alias("unknown"), F.lit(0).alias("failures"), F.array().cast(found).alias("found"))

    def step(state: Column, row: Column) -> Column:
        inside = state["ref"].isNotNull()
        held = _branches(sign, state["ref"], row["now"])
        failures = F.when(held == 0, state["failures"] + 1).otherwise(0)
        ends, unknown = failures == 2, state["unknown"] | held.isNull()
        first = F.when(row["ref"].isNotNull(), _branches(sign, row["ref"], row["now"]))
        second = F.when(row["ref"].isNotNull(), _branches(sign, row["ref"], row["next"]))
        common = F.coalesce(first.bitwiseAND(second), F.lit(0))
        hidden = first.isNull() | ((first != 0) & second.isNull())
        decision = F.when(inside, F.when(~ends & unknown, "unknown").otherwise("no_event")).when(common != 0, "event").when(hidden, "unknown").otherwise("no_event")
        ref = F.when(inside, F.when(~ends, state["ref"])).when((common != 0) | hidden, row["ref"])
        return F.struct(
            ref.alias("ref"), F.when(inside, ~ends & unknown).otherwise((common == 0) & hidden & row["ref"].isNotNull()).alias("unknown"), F.when(inside & ~ends, failures).otherwise(0).alias("failures"),
            F.concat(state["found"], F.array(F.struct(row["month"].alias("month"), decision.alias("decision"), F.when(~inside, common).otherwise(0).alias("branches")))).alias("found"),
        )

    return F.transform(F.aggregate("rows", none, step)["found"], lambda x: F.struct(F.lit(sign).alias("sign"), x["month"].alias("month"), x["decision"].alias("decision"), x["branches"].alias("branches")))


def scanned_events(months: DataFrame) -> DataFrame:
    """``(company_id, sign, month, decision, branches)``: event, no_event or unknown for every month from the fourth on."""
    rows = with_reference(months).groupBy("company_id").agg(F.array_sort(F.collect_list(F.struct("month", "now", "next", "ref"))).alias("rows"))
    return rows.select("company_id", F.explode(F.concat(*(_scan(s) for s in EVENT_SIGNS))).alias("_found")).select("company_id", "_found.*")


def issued_signals(origins: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Origins (month, issued_on, probability, headline, is_eligible) of every key with their status.

    A probability over the threshold is watched, the next one confirms, and further ones are suppressed until two origins in a row lie below. A missing
    month or an origin that cannot be judged ends the watch and the count below.
    """
    found = "array<struct<month: date, status: string, first_signal_on: date, confirmed_on: date>>"
    start = F.struct(F.lit(None).cast("date").alias("before"), F.lit(None).cast("date").alias("watch"), F.lit(False).alias("active"), F.lit(0).alias("below"), F.array().cast(found).alias("found"))

    def step(state: Column, row: Column) -> Column:
        apart = F.coalesce(F.add_months(state["before"], 1) != row["month"], F.lit(False))
        watch, below = F.when(~apart, state["watch"]), F.when(apart, 0).otherwise(state["below"])
        usable = row["is_eligible"] & row["headline"].isNotNull() & row["probability"].isNotNull()
        low = usable & (row["probability"] < THRESHOLD)
        count = F.when(low, below + 1).otherwise(0)
        status = F.when(~usable, "unavailable").when(low, "below_threshold").when(state["active"], "suppressed").when(watch.isNull(), "watch").otherwise("confirmed")
        seen = F.when(status == "watch", row["issued_on"]).when(status == "confirmed", watch)
        confirmed = F.when(status == "confirmed", row["issued_on"])
        active = F.when(status == "confirmed", True).when(low & (count >= RESET_AFTER), False).otherwise(state["active"])
        still = F.when(status == "watch", row["issued_on"]).when(status == "suppressed", watch)
        return F.struct(row["month"].alias("before"), still.alias("watch"), active.alias("active"), count.alias("below"), F.concat(state["found"], F.array(F.struct(row["month"].alias("month"), status.alias("status"), seen.alias("first_signal_on"), confirmed.alias("confirmed_on")))).alias("found"))

    rows = origins.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("month", "issued_on", "probability", "headline", "is_eligible"))).alias("rows"))
    return rows.select(*keys, F.explode(F.aggregate("rows", start, step)["found"]).alias("_found")).select(*keys, "_found.*")
