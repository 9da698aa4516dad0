"""Cleaning: dates in range, normal forms, EUR amounts, and a flag for whatever is doubtful. No row is lost and no amount changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from florin.functions.core import flags, in_window, is_finite, joined, missing_text, month_start, out_of_window

# The window of plausible dates, the extreme amount, sentinel balances.
FIRST_DAY, AFTER_LAST_DAY = "1990-01-01", "2031-01-01"
EXTREME = 1e9
#: Balances at or beyond these are placeholders of the source.
SENTINEL_LOW, SENTINEL_HIGH = -999999999.0, 1000000000.0


def day_ok(day: Column) -> Column:
    return in_window(day, FIRST_DAY, AFTER_LAST_DAY)


def day_bad(day: Column) -> Column:
    return out_of_window(day, FIRST_DAY, AFTER_LAST_DAY)


def usable_rate(rate: Column) -> Column:
    """A reported rate that says something: finite, positive, and not the placeholder 1."""
    return F.coalesce(is_finite(rate) & (rate > 0) & (rate != 1), F.lit(False))


def normal_currency(currency: Column) -> Column:
    code = F.upper(F.trim(currency))
    return F.when(code.rlike("^[A-Z]{3}$"), code)


def normal_text(text: Column) -> Column:
    return F.when(missing_text(text), "unknown").otherwise(F.lower(F.trim(text)))


def normal_movements(tx: DataFrame, open_month: str) -> DataFrame:
    """Transactions with what needs no product: days in range, month, direction, normal status and category."""
    category, amount = F.trim("category"), F.col("amount")
    rows = tx.withColumns({
        "date_ok": day_ok(F.col("date")), "value_date_ok": day_ok(F.col("value_date")), "status_norm": normal_text(F.col("status")),
        "category_norm": F.when(category.isNotNull() & (category != "") & (category != "-"), F.lower(category)),
        "direction": F.when(amount > 0, "in").when(amount < 0, "out").when(amount.isNotNull(), "zero"),
    })
    rows = rows.withColumns({"month": month_start(F.col("date_ok"))})
    return rows.withColumns({"is_open_month": F.col("month") >= F.lit(open_month).cast("date"), "is_booked": F.col("status_norm") == "booked"})


def with_products(rows: DataFrame, banking: DataFrame, debt: DataFrame) -> DataFrame:
    """Normal movements with product source, EUR amount by source, and ``quality_flags``.

    The two product tables have one row per product. They are merged with, never broadcast: where they are generated from a
    smaller table, the optimizer takes them for as small as that one.
    """
    products = banking.select("product_id", F.lit("banking").alias("product_source"), "type", "currency").unionByName(debt.select("product_id", F.lit("debt").alias("product_source"), "type", "currency"))
    products = products.select(F.col("product_id").alias("_product"), "product_source", F.lower(F.trim("type")).alias("product_type"), F.upper(F.trim("currency")).alias("product_currency"))
    rows = rows.join(products.hint("merge"), F.col("product_id") == F.col("_product"), "left").drop("_product")
    currency, category, amount = F.col("product_currency"), F.trim("category"), F.col("amount")
    rows = rows.withColumns({
        "amount_eur": F.when(currency == "EUR", amount).when(currency.isNotNull() & usable_rate(F.col("exchange_rate")), F.try_divide(amount, F.col("exchange_rate"))),
        "fx_ambiguous": (currency != "EUR") & (F.col("exchange_rate") == 1),
        "product_source": F.coalesce("product_source", F.lit("orphan")),
    })
    rows = rows.withColumn("amount_eur_source", F.when(F.col("amount_eur").isNull(), "unknown").when(currency == "EUR", "identity").otherwise("reported"))
    return rows.withColumn("quality_flags", flags(
        (day_bad(F.col("date")), "date_out_of_range"), (day_bad(F.col("value_date")), "date_out_of_range"), (F.col("is_open_month"), "open_month"), (missing_text(F.col("status")), "status_missing"),
        (category.isin("", "-"), "category_missing"), (amount.isNull(), "amount_missing"), (F.abs(amount) >= EXTREME, "amount_extreme"), (F.col("exchange_rate") <= 0, "fx_rate_invalid"),
        (F.col("amount_eur").isNull(), "fx_not_convertible"), (F.col("product_source") == "orphan", "fk_orphan"),
    ))


def clean_transactions(tx: DataFrame, banking: DataFrame, debt: DataFrame, open_month: str) -> DataFrame:
    """Transactions with normal forms, product source, EUR amount by source, and ``quality_flags``."""
    return with_products(normal_movements(tx, open_month), banking, debt)


def clean_invoices(invoices: DataFrame, open_month: str) -> DataFrame:
    """Invoices with effective rate, EUR amount, settlement and maturity dates, flow side, and ``quality_flags``."""
    currency, accounting, rate, amount = F.upper(F.trim("currency")), F.upper(F.trim("accounting_currency")), F.col("exchange_rate"), F.col("amount")
    effective = F.when(currency == accounting, F.lit(1.0)).when(currency.isNotNull() & accounting.isNotNull() & usable_rate(rate), rate)
    rows = invoices.withColumns({
        "issuance_date_ok": day_ok(F.col("issuance_date")), "due_date_ok": day_ok(F.col("due_date")), "payment_date_ok": day_ok(F.col("payment_date")),
        "status_norm": normal_text(F.col("status")), "document_type_norm": F.lower(F.trim("document_type")), "currency_norm": currency, "accounting_currency_norm": accounting,
        "amount_acct": F.try_divide(amount, effective), "flow_side": F.when(amount > 0, "inflow").when(amount < 0, "outflow").when(amount.isNotNull(), "zero"),
        "fx_ambiguous": (currency != accounting) & (rate == 1),
    })
    settled = (F.col("status_norm") == "paid") & (F.col("payment_date_ok") >= F.col("issuance_date_ok")) & (F.coalesce("pending_amount", F.lit(0.0)) == 0)
    rows = rows.withColumns({
        "month": month_start(F.col("issuance_date_ok")),
        "amount_eur": F.when(currency == "EUR", amount).when(accounting == "EUR", F.col("amount_acct")),
        "settlement_date_ok": F.when(settled, F.col("payment_date_ok")),
        "maturity_date_ok": F.when(F.col("due_date_ok") >= F.col("issuance_date_ok"), F.col("due_date_ok")),
    })
    rows = rows.withColumns({
        "days_to_due": F.datediff("maturity_date_ok", "issuance_date_ok"), "days_to_payment": F.datediff("settlement_date_ok", "issuance_date_ok"),
        "is_open_month": F.col("month") >= F.lit(open_month).cast("date"),
        "amount_eur_source": F.when(F.col("amount_eur").isNull(), "unknown").when(currency == "EUR", "identity").otherwise("reported"),
    })
    disorder = (F.col("due_date_ok") < F.col("issuance_date_ok")) | (F.col("payment_date_ok") < F.col("issuance_date_ok"))
    bad_rate = rate.isNull() | ~is_finite(rate) | (rate <= 0) | ((currency == accounting) & (rate != 1))
    return rows.withColumn("quality_flags", flags(
        *((day_bad(F.col(c)), "date_out_of_range") for c in ("issuance_date", "due_date", "payment_date")), (disorder, "date_order_invalid"), (F.col("is_open_month"), "open_month"), (missing_text(F.col("status")), "status_missing"),
        ((F.col("status_norm") == "paid") & (F.col("pending_amount") != 0), "paid_with_pending"), (amount.isNull(), "amount_missing"), (F.abs(amount) >= EXTREME, "amount_extreme"), (bad_rate, "fx_rate_invalid"), (F.col("amount_eur").isNull(), "fx_not_convertible"),
    ))


def clean_banking_products(products: DataFrame) -> DataFrame:
    """Normal type and currency, and how liquid the account is."""
    kind = F.lower(F.trim("type"))
    liquidity = (
        F.when(kind.isin("checking", "saving", "wallet"), "cash").when(kind == "tpv", "collection").when(kind.isin("card", "expensesplatform"), "card")
        .when(kind == "investment", "investment").when(kind.isin("risk", "lineofcomex"), "other").otherwise("unknown")
    )
    return products.select("product_id", "company_id", kind.alias("type_norm"), normal_currency(F.col("currency")).alias("currency_norm"), liquidity.alias("liquidity_class"))


def clean_debt_products(products: DataFrame) -> DataFrame:
    """Absolute amounts, the sign they came with, whether anything is drawn, and the class of debt."""
    kind = F.lower(F.trim("type"))
    sign = F.when(F.col("outstanding") > 0, "positive").when(F.col("outstanding") < 0, "negative").when(F.col("outstanding").isNotNull(), "zero").otherwise("missing")
    return products.select(
        "product_id", "company_id", kind.alias("type_norm"), F.abs("granted").alias("granted_abs"), F.abs("outstanding").alias("outstanding_abs"), sign.alias("outstanding_sign"),
        F.coalesce(F.abs("outstanding") > 0.01, F.lit(False)).alias("is_drawn"),
        F.when(kind.isin("loan", "leasing", "mortgage", "renting"), "term").when(kind == "lineofcredit", "revolving").when(kind.isin("factoring", "confirming"), "receivables").when(kind == "guarantee", "offbalance").otherwise("unknown").alias("debt_class"),
    )


def clean_balances(balances: DataFrame, banking: DataFrame, debt: DataFrame) -> DataFrame:
    """Sentinel balances become null and are flagged; the product's source is looked up."""
    products = banking.select("product_id", F.lit("banking").alias("source"), F.col("currency").alias("product_currency")).unionByName(debt.select("product_id", F.lit("debt").alias("source"), F.col("currency").alias("product_currency")))
    sentinel = (F.col("balance") <= SENTINEL_LOW) | (F.col("balance") >= SENTINEL_HIGH)
    return balances.join(products.hint("merge"), "product_id", "left").select(
        "product_id", "company_id", "date", F.when(~sentinel, F.col("balance")).alias("balance_ok"), F.coalesce("source", F.lit("orphan")).alias("product_source"), "product_currency",
        flags((sentinel, "sentinel_hidden_balance"), (F.col("source").isNull(), "fk_orphan")).alias("quality_flags"),
    )


def flag_counts(rows: DataFrame) -> DataFrame:
    """Rows per flag."""
    return rows.select(F.explode("quality_flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


def typed(rows: DataFrame, types: dict[str, str]) -> DataFrame:
    """Text columns cast where they can be, with ``_cast_failures``: columns that held text and became null."""
    failed = F.array_compact(F.array(*(F.when(~missing_text(F.col(c)) & F.col(c).try_cast(t).isNull(), F.lit(c)) for c, t in types.items())))
    return rows.withColumn("_cast_failures", failed).withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})


def cast_failure_counts(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("_cast_failures").alias("column")).groupBy("column").agg(F.count("*").alias("n"))


def flag_text(rows: DataFrame) -> DataFrame:
    """Flags as sorted text, for outputs that hold no arrays."""
    return rows.withColumn("quality_flags", joined(F.array_distinct("quality_flags")))
