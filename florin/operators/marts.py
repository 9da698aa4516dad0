"""Company by month panels: cash flows, debt service, receivables and payables. An unknown amount makes a total null, never zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from florin.functions.core import known_if, month_index, month_start, share, sum_where

CASH_PRODUCTS = ("checking", "saving", "wallet")
AMBIGUOUS = ("unknown", "transfer", "non_economic")
PRINCIPAL_RULES = ("cat:debt_repayment", "transf:debt_repayment")
INTEREST_RULES = ("cat:interest_charge", "transf:interest_charge")


def company_months(companies: DataFrame, first: str, last: str) -> DataFrame:
    """Dense grid with the day on which a month's data are known; built by generation, not by a join."""
    months = F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("INTERVAL 1 MONTH"))
    return companies.select("company_id", "group_id", F.explode(months).alias("month")).withColumn("available_at", F.last_day("month"))


def closed_movements(rows: DataFrame, first: str, last: str) -> DataFrame:
    """Booked movements of closed months."""
    return rows.where(F.col("is_booked") & ~F.col("is_open_month") & F.col("month").between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def cash_perimeter(classified: DataFrame, first: str, last: str) -> DataFrame:
    """Booked movements of closed months, marked as cash account or not and as ambiguous or not."""
    return closed_movements(classified, first, last).withColumns({
        "is_cash": F.coalesce((F.col("product_source") == "banking") & F.col("product_type").isin(*CASH_PRODUCTS), F.lit(False)),
        "is_ambiguous": F.col("flow_class").isin(*AMBIGUOUS) & ~F.col("direction").eqNullSafe("zero"),
    })


def _flow_sums() -> list[Column]:
    eur, size, kind = F.col("amount_eur"), F.abs("amount_eur"), F.col("flow_class")
    cash, ambiguous, direction = F.col("is_cash"), F.col("is_ambiguous"), F.col("direction")
    operating, plain = kind.isin("operating_in", "operating_out"), ~F.coalesce(F.col("is_outlier"), F.lit(False))
    into, out = ambiguous & (direction == "in"), ambiguous & (direction == "out")
    count = lambda c: F.count_if(cash & F.coalesce(c, F.lit(False)))
    total = lambda v, c=F.lit(True): sum_where(v, cash & c)
    return [
        F.count("*").alias("n_tx"), F.count_if(cash).alias("n_cash"), F.count_if(F.col("product_source") == "debt").alias("n_debt_product"), F.count_if(F.col("product_source") == "orphan").alias("n_orphans"),
        F.count_distinct(F.when(cash, F.col("product_id"))).alias("n_accounts"),
        count(eur.isNull()).alias("n_without_eur"), count(ambiguous).alias("n_ambiguous"), count(ambiguous & ((direction == "in") | direction.isNull())).alias("n_ambiguous_in"), count(ambiguous & ((direction == "out") | direction.isNull())).alias("n_ambiguous_out"),
        count(operating & eur.isNull()).alias("n_operating_without_eur"), count((kind == "operating_in") & eur.isNull()).alias("n_receipts_without_eur"), count((kind == "operating_out") & eur.isNull()).alias("n_payments_without_eur"), count(ambiguous & eur.isNull()).alias("n_ambiguous_without_eur"),
        count(F.col("is_outlier") & (operating | ambiguous)).alias("n_outliers"), count(F.col("direction_conflict")).alias("n_conflicts"),
        total(eur).alias("net_known"), total(size).alias("volume_known"), total(size, kind == "operating_in").alias("receipts_known"), total(size, kind == "operating_out").alias("payments_known"),
        total(size, kind == "financing_in").alias("financing_in_known"), total(size, kind == "financing_out").alias("financing_out_known"), total(size, kind == "investment_in").alias("investment_in_known"), total(size, kind == "investment_out").alias("investment_out_known"),
        total(size, into).alias("ambiguous_in_known"), total(size, out).alias("ambiguous_out_known"),
        total(eur, operating & plain).alias("operating_plain"), total(size, into & plain).alias("ambiguous_in_plain"), total(size, out & plain).alias("ambiguous_out_plain"),
    ]


def _by_month(grid: DataFrame, rows: DataFrame, sums: list[Column]) -> DataFrame:
    # the size of a generated grid is unknown to the optimizer, which would take it for small enough to broadcast
    return grid.join(rows.groupBy("company_id", "month").agg(*sums).hint("merge"), ["company_id", "month"], "left")


def _with_flows(panel: DataFrame, months: list[str]) -> DataFrame:
    amounts = [c for c in months if not c.startswith("n_")]
    counts = [c for c in months if c.startswith("n_")]
    panel = panel.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in counts})
    panel = panel.withColumn("has_cash_activity", F.col("n_cash") > 0).withColumns({c: known_if(F.col("has_cash_activity"), F.col(c)) for c in amounts})
    by_company = Window.partitionBy("company_id")
    so_far = by_company.orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    first = F.min(F.when(F.col("has_cash_activity"), F.col("month"))).over(so_far)
    active = F.col("has_cash_activity")
    complete = active & (F.col("n_operating_without_eur") + F.col("n_ambiguous_without_eur") == 0)
    identified = F.col("receipts_known") - F.col("payments_known")
    low, high = known_if(complete, identified - F.col("ambiguous_out_known")), known_if(complete, identified + F.col("ambiguous_in_known"))
    panel = panel.withColumns({
        "first_cash_month": first, "active_months_so_far": F.sum(active.cast("long")).over(so_far),
        "eur_coverage": share(F.col("n_cash") - F.col("n_without_eur"), F.col("n_cash")), "class_coverage": share(F.col("n_cash") - F.col("n_ambiguous"), F.col("n_cash")),
        "ambiguous_share": F.when(F.col("volume_known") > 0, (F.col("ambiguous_in_known") + F.col("ambiguous_out_known")) / F.col("volume_known")),
        "net_eur": known_if(active & (F.col("n_without_eur") == 0), F.col("net_known")),
        "receipts_eur": known_if(active & (F.col("n_receipts_without_eur") == 0) & (F.col("n_ambiguous_in") == 0), F.col("receipts_known")),
        "payments_eur": known_if(active & (F.col("n_payments_without_eur") == 0) & (F.col("n_ambiguous_out") == 0), F.col("payments_known")),
        "operating_min": low, "operating_max": high,
        "operating_min_plain": F.when(F.col("n_outliers") == 0, low).otherwise(known_if(complete, F.col("operating_plain") - F.col("ambiguous_out_plain"))),
        "operating_max_plain": F.when(F.col("n_outliers") == 0, high).otherwise(known_if(complete, F.col("operating_plain") + F.col("ambiguous_in_plain"))),
    })
    observed = month_index(F.col("month")) - month_index(F.col("first_cash_month"))
    return panel.withColumns({"months_observed": observed, "is_warm_up": observed < 3, "operating_eur": F.col("receipts_eur") - F.col("payments_eur")})


def flow_panel(grid: DataFrame, perimeter: DataFrame) -> DataFrame:
    """Known subtotals per company and month, exact totals where complete, and bounds of the operating flow.

    One grouped pass over the movements; the grid joins its few rows per company.
    """
    panel = _by_month(grid, perimeter, _flow_sums())
    return _with_flows(panel, [c for c in panel.columns if c not in grid.columns])


def _debt_sums() -> list[Column]:
    eur, size, kind, rule = F.col("amount_eur"), F.abs("amount_eur"), F.col("flow_class"), F.col("rule_id")
    service = rule.isin(*PRINCIPAL_RULES, *INTEREST_RULES)
    paid, back = (kind == "financing_out") & F.col("is_cash"), (kind == "financing_in") & F.col("is_cash")
    own = F.col("product_source") == "debt"
    return [
        sum_where(size, paid & rule.isin(*PRINCIPAL_RULES)).alias("principal_known"), sum_where(size, paid & rule.isin(*INTEREST_RULES)).alias("interest_known"),
        sum_where(size, paid & ~service).alias("other_financing_known"), sum_where(eur, back & service).alias("refunds_known"),
        F.count_if(paid & service).alias("n_service"), F.count_if(paid & service & eur.isNull()).alias("n_service_without_eur"), F.count_if(paid & ~service).alias("n_other_financing"),
        F.count_if(back & service & eur.isNull()).alias("n_refunds_without_eur"), F.count_if(back & ~service).alias("n_other_inflows"),
        F.count_if(own).alias("n_ledger"), F.when(F.count_if(own) > 0, sum_where(eur, own)).alias("ledger_net_known"), F.count_if(own & eur.isNull()).alias("n_ledger_without_eur"),
    ]


def _with_debt(panel: DataFrame, months: list[str]) -> DataFrame:
    active = F.col("has_cash_activity")
    panel = panel.withColumns({c: known_if(active, F.col(c)) for c in ("principal_known", "interest_known", "other_financing_known", "refunds_known")})
    known = F.col("principal_known") + F.col("interest_known")
    panel = panel.withColumns({c: F.coalesce(c, F.lit(0)) for c in months if c.startswith("n_")}).withColumns({
        "service_known": known,
        "service_eur": known_if(active & (F.col("n_service_without_eur") == 0) & (F.col("n_other_financing") == 0) & (F.col("n_ambiguous_out") == 0), known),
        "refunds_eur": known_if(active & (F.col("n_refunds_without_eur") == 0) & (F.col("n_other_inflows") == 0) & (F.col("n_ambiguous_in") == 0), F.col("refunds_known")),
        "service_coverage": share(F.col("n_service") - F.col("n_service_without_eur"), F.col("n_service")),
    })
    return panel.withColumn("net_service_eur", F.col("service_eur") - F.col("refunds_eur"))


def debt_panel(flows: DataFrame, perimeter: DataFrame) -> DataFrame:
    """Debt service paid from cash accounts: principal, interest, refunds; the debt accounts' own ledger apart."""
    keep = flows.select("company_id", "group_id", "month", "available_at", "has_cash_activity", "n_ambiguous_in", "n_ambiguous_out")
    panel = _by_month(keep, perimeter.where(F.col("is_cash") | (F.col("product_source") == "debt")), _debt_sums())
    return _with_debt(panel, [c for c in panel.columns if c not in keep.columns])


def flow_and_debt_panel(grid: DataFrame, perimeter: DataFrame, *more: Column) -> DataFrame:
    """The columns of both panels, and ``more`` sums, from one grouped pass over the movements, so that these need not be kept."""
    flows, debt = _flow_sums(), _debt_sums()
    panel = _by_month(grid, perimeter, [*flows, *debt, *more])
    names = [c for c in panel.columns if c not in grid.columns]
    return _with_debt(_with_flows(panel, names[: len(flows)]), names[len(flows) : len(flows) + len(debt)])


def invoice_universe(invoices: DataFrame) -> DataFrame:
    """Invoices that count: no credit notes, no cancelled ones, issued on a known day; with side and certainty of their state."""
    status, pending = F.col("status_norm"), F.abs("pending_amount")
    uncertain = (status == "unknown") | ((status == "paid") & F.col("settlement_date_ok").isNull()) | ((status != "paid") & (pending < F.abs("amount")))
    return invoices.where((status != "cancel") & (F.col("document_type_norm") == "invoice") & F.col("issuance_date_ok").isNotNull()).select(
        "company_id", "counterparty_id", F.col("issuance_date_ok").alias("issued"), F.col("maturity_date_ok").alias("due"), F.col("settlement_date_ok").alias("settled"),
        F.coalesce(uncertain, F.lit(False)).alias("is_uncertain"), F.when(F.col("amount") > 0, "ar").when(F.col("amount") < 0, "ap").alias("side"), F.col("amount_eur").alias("eur"),
    )


def open_at_month_ends(universe: DataFrame, first: str, last: str) -> DataFrame:
    """One row per invoice and month end at which it is open: issued by then and not settled by then.

    Each invoice generates its own months, so there is no range join; a settled one generates few.
    """
    begin = F.greatest(month_start(F.col("issued")), F.lit(first).cast("date"))
    last_open = F.when(F.col("settled").isNull(), F.lit(last).cast("date")).otherwise(F.add_months(month_start(F.col("settled")), -1))
    end = F.least(last_open, F.lit(last).cast("date"))
    months = F.when(begin <= end, F.sequence(begin, end, F.expr("INTERVAL 1 MONTH")))
    rows = universe.withColumn("month", F.explode(months)).withColumn("month_end", F.last_day("month"))
    # an invoice settled on the last day of a month is not open at that month's end; one settled later is
    return rows.withColumn("days_overdue", F.datediff("month_end", "due"))


def open_stock(open_rows: DataFrame) -> DataFrame:
    """Open, overdue and ageing amounts per company, month and side."""
    size, late, days = F.abs("eur"), F.col("due") < F.col("month_end"), F.col("days_overdue")
    known = lambda c: F.sum(F.when(c, size))
    bins = (("0_30", None, 30), ("31_60", 31, 60), ("61_90", 61, 90), ("91_180", 91, 180), ("181_360", 181, 360), ("over_360", 361, None))
    ages = [known(late & (F.lit(True) if lo is None else days >= lo) & (F.lit(True) if hi is None else days <= hi)).alias(f"ageing_{name}") for name, lo, hi in bins]
    return open_rows.groupBy("company_id", "month", "side").agg(
        known(~F.col("is_uncertain")).alias("open_eur"), F.count_if(~F.col("is_uncertain")).alias("n_open"), F.count("*").alias("n_possible"), F.count("eur").alias("n_eur"), F.count_if("is_uncertain").alias("n_uncertain"),
        F.count_if(F.col("due").isNull()).alias("n_without_due"), known(late).alias("overdue_eur"), known(days > 180).alias("over_180_eur"), *ages, F.count_distinct("counterparty_id").alias("n_counterparties"),
    )


def top_counterparty(open_rows: DataFrame) -> DataFrame:
    """The largest open receivable per company and month, and its share; counterparties are summed first."""
    per = open_rows.where((F.col("side") == "ar") & F.col("counterparty_id").isNotNull()).groupBy("company_id", "month", "counterparty_id").agg(F.sum(F.abs("eur")).alias("eur"))
    return per.groupBy("company_id", "month").agg(F.max("eur").alias("top1_eur"), F.sum("eur").alias("all_eur")).withColumn("top1_share", share(F.col("top1_eur"), F.col("all_eur"))).drop("all_eur")


def issued_and_settled(universe: DataFrame) -> DataFrame:
    """Issued and settled amounts per company, month and side, from one pass over the invoices."""
    size = F.abs("eur")
    events = universe.select("company_id", "side", F.explode(F.array_compact(F.array(
        F.struct(month_start(F.col("issued")).alias("month"), F.lit("issued").alias("what"), size.alias("eur")),
        F.when(F.col("settled").isNotNull(), F.struct(month_start(F.col("settled")).alias("month"), F.lit("settled").alias("what"), size.alias("eur")))))).alias("e"))
    when = lambda w, v: F.when(F.col("e.what") == w, v)
    return events.groupBy("company_id", F.col("e.month").alias("month"), "side").agg(
        F.sum(when("issued", F.col("e.eur"))).alias("issued_eur"), F.count(when("issued", F.lit(1))).alias("n_issued"), F.sum(when("settled", F.col("e.eur"))).alias("settled_eur"), F.count(when("settled", F.lit(1))).alias("n_settled"))


def receipt_cohorts(universe: DataFrame, last_day: str) -> DataFrame:
    """Share of the receivables issued in a month that was received within 30, 60 and 90 days; null until the window has closed."""
    days, size = F.datediff("settled", "issued"), F.abs("eur")
    cohorts = universe.where("side = 'ar'").groupBy("company_id", month_start(F.col("issued")).alias("month")).agg(
        F.count("*").alias("n_issued"), F.count("eur").alias("n_eur"), F.count_if("is_uncertain").alias("n_uncertain"), F.sum(size).alias("issued_eur"), *(sum_where(size, days <= n).alias(f"received_{n}d") for n in (30, 60, 90)))
    end = F.last_day("month")
    for n in (30, 60, 90):
        matured = F.date_add(end, n) <= F.lit(last_day).cast("date")
        whole = matured & (F.col("n_eur") == F.col("n_issued")) & (F.col("n_uncertain") == 0)
        cohorts = cohorts.withColumns({f"conversion_{n}d": known_if(whole, share(F.col(f"received_{n}d"), F.col("issued_eur"))), f"available_at_{n}d": F.when(matured, F.date_add(end, n))})
    return cohorts


def settlement_medians(universe: DataFrame, first: str, last: str, least: int = 5) -> DataFrame:
    """Median days to receipt and median delay over settlements of a month and the two before; each settlement is dealt to its three months."""
    months = F.sequence(month_start(F.col("settled")), F.add_months(month_start(F.col("settled")), 2), F.expr("INTERVAL 1 MONTH"))
    dealt = universe.where("side = 'ar' AND settled IS NOT NULL").select("company_id", F.explode(months).alias("month"), F.datediff("settled", "issued").alias("days"), F.datediff("settled", "due").alias("delay"))
    dealt = dealt.where(F.col("month").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    found = dealt.groupBy("company_id", "month").agg(F.median("days").alias("days"), F.median("delay").alias("delay"), F.count("*").alias("n_settled"), F.count("delay").alias("n_with_due"))
    return found.select("company_id", "month", known_if(F.col("n_settled") >= least, F.col("days")).alias("dso_days"), known_if(F.col("n_with_due") >= least, F.col("delay")).alias("median_delay_days"), "n_settled", "n_with_due")


def side_series(stock: DataFrame) -> DataFrame:
    """Open and overdue amounts of all companies per month and side."""
    return stock.groupBy("month", "side").agg(F.sum("open_eur").alias("open_eur"), F.sum("overdue_eur").alias("overdue_eur"), F.sum("n_open").alias("n_open"), F.count("*").alias("n_companies"))
