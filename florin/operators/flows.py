"""Classification of cash movements: bank category, learned patterns, then description rules; first match wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from florin.functions.core import exact_quantiles, month_index

# Fixed values of the classification.
INCOME = ("collection", "bulk_collection", "pos_settlement", "cash_settlement", "cash_settlements", "tax_refund")
EXPENSE = ("payment", "bulk_payment", "utility", "salary", "tax", "social_security", "fee")
REFUND = ("collection_refund", "payment_refund")
DEBT_SERVICE = ("debt_repayment", "interest_charge")
MOVES = ("transfer", "cash_withdrawal", "pos_withdrawal")
OUTLIER = 1e7
#: (rule, class, LIKE patterns, required direction), in order.
DESCRIPTION_RULES = (
    ("desc:ajuste_saldo", "transfer", ("SCF-AJUS.SALDO%",), None),
    ("desc:compensacion_conciliacion", "non_economic", ("%COMPENSATION FOR MISSING OR EXCESS%",), None),
    ("desc:ajuste_retencion", "non_economic", ("%MANUAL QUITAR RETENCION%", "AJUSTE RETENCION%"), None),
    ("desc:disposicion_efectivo", "transfer", ("DISP.ENTREG.EFECT.%",), None),
    ("desc:comision", "operating_out", ("%STRIPE_FEE%", "% FEE%"), None),
    ("desc:venta", "operating_in", ("VT.A %",), None),
    ("desc:compra", "operating_out", ("PR.A %",), None),
    ("desc:cierre_tpv", "operating_in", ("FECHO POS-PERIODO%", "FECHO TPA%"), None),
    ("desc:liquidacion", "operating_in", ("LIQUIDACION EFECTUADA EL%",), None),
    ("desc:abono_menor", "operating_in", ("AB.NT.BZ%",), None),
    ("desc:cobro_menor", "operating_in", ("ON %",), "in"),
    ("desc:cobro_deudor", "operating_in", ("%DEBTOR NUMBER%",), None),
    ("desc:comision_banco", "operating_out", ("%CHARGE FOR%",), None),
    ("desc:cobro_pasarela", "operating_in", ("% CHARGE",), None),
    ("desc:cobro_pasarela_pago", "operating_in", ("% PAYMENT",), None),
    ("desc:barrido_pasarela", "transfer", ("% PAYOUT",), None),
    ("desc:cobro_tarjeta", "operating_in", ("%******%",), None),
)


def category_class(category: Column, direction: Column) -> Column:
    """Flow class of a bank category; a refund follows the movement's direction; unmapped ones are unknown."""
    return (
        F.when(category.isin(*INCOME), "operating_in").when(category.isin(*EXPENSE), "operating_out")
        .when(category.isin(*REFUND), F.when(direction == "in", "operating_in").otherwise("operating_out"))
        .when(category.isin(*DEBT_SERVICE), "financing_out").when(category == "investment_return", "investment_in").when(category == "investment_deployment", "investment_out")
        .when(category.isin(*MOVES), "transfer").when(category.isNotNull(), "unknown")
    )


def pattern(description: Column) -> Column:
    """Upper case, trimmed, runs of digits as #."""
    return F.regexp_replace(F.upper(F.trim(F.coalesce(description, F.lit("")))), "[0-9]+", "#")


def description_rule(description: Column, direction: Column) -> Column:
    """(rule, class) of the first rule that matches, else null."""
    text = F.upper(F.trim(description))
    out = F.lit(None).cast("struct<rule:string,class:string>")
    for rule, flow_class, likes, needed in reversed(DESCRIPTION_RULES):
        hit = F.lit(False)
        for like in likes:
            hit = hit | text.like(like)
        if needed:
            hit = hit & (direction == needed)
        out = F.when(hit, F.struct(F.lit(rule).alias("rule"), F.lit(flow_class).alias("class"))).otherwise(out)
    return out


def with_learned(rows: DataFrame) -> DataFrame:
    """``rows`` with their ``pattern``, and ``learned`` and ``evidence_month`` where a movement without a category has a pattern whose category is known.

    Evidence is the same company's booked, categorised movements of the same direction and
    pattern in strictly earlier months, and only if they name one category. A running window over
    the pattern's months sees it, so movements are read and dealt once and meet no second copy of themselves.
    """
    rows = rows.withColumn("pattern", pattern(F.col("description")))
    keys = ("company_id", "direction", "pattern")
    earlier = Window.partitionBy(*keys).orderBy(month_index(F.col("month"))).rangeBetween(Window.unboundedPreceding, -1)
    seen = ~F.col("is_open_month") & F.col("is_booked") & F.col("category_norm").isNotNull()
    rows = rows.withColumn("_evidence", F.when(seen, F.col("category_norm")))
    rows = rows.withColumns({"_least": F.min("_evidence").over(earlier), "_most": F.max("_evidence").over(earlier), "_since": F.min(F.when(F.col("_evidence").isNotNull(), F.col("month"))).over(earlier)})
    asks = F.col("category_norm").isNull() & (F.col("pattern") != "") & F.col("company_id").isNotNull() & F.col("direction").isNotNull() & F.col("month").isNotNull()
    one = asks & (F.col("_least") == F.col("_most"))
    return rows.withColumns({"learned": F.when(one, F.col("_least")), "evidence_month": F.when(one, F.col("_since"))}).drop("_evidence", "_least", "_most", "_since")


def classify_flows(tx: DataFrame) -> DataFrame:
    """``tx`` with flow_class, flow_source, rule_id, is_outlier, direction_conflict, evidence_month."""
    return classified(with_learned(tx))


def classified(asked: DataFrame) -> DataFrame:
    """classify_flows of movements that have their learned category; what no longer is evidence can be left out before.

    The description rules hold no digits, so they read the pattern, and the description itself is dealt no further.
    """
    direction, category, learned_one = F.col("direction"), F.col("category_norm"), F.col("learned")
    mapped = category.isin(*INCOME, *EXPENSE, *REFUND, *DEBT_SERVICE, *MOVES, "investment_return", "investment_deployment")
    asked = asked.withColumn("_rule", F.when(category.isNull() & learned_one.isNull(), description_rule(F.col("pattern"), direction)))
    asked = asked.withColumns({
        "_class": F.coalesce(category_class(F.coalesce(category, learned_one), direction), F.col("_rule.class"), F.lit("unknown")),
        "rule_id": F.when(mapped, F.concat(F.lit("cat:"), category)).when(category.isNotNull(), "cat:no_mapeada").when(learned_one.isNotNull(), F.concat(F.lit("transf:"), learned_one)).otherwise(F.coalesce(F.col("_rule.rule"), F.lit("unknown"))),
        "flow_source": F.when(category.isNotNull(), "category").when(learned_one.isNotNull(), "transferida").when(F.col("_rule").isNotNull(), "rule"),
        "is_outlier": F.abs("amount_eur") >= OUTLIER,
    })
    signed = F.col("_class").endswith("_in") | F.col("_class").endswith("_out")
    conflict = (F.col("_class").endswith("_in") & (direction != "in")) | (F.col("_class").endswith("_out") & (direction != "out"))
    resigned = F.when(direction.isin("in", "out"), F.concat_ws("_", F.split_part("_class", F.lit("_"), F.lit(1)), direction)).otherwise("unknown")
    return asked.withColumns({"direction_conflict": F.coalesce(conflict, F.lit(False)), "flow_class": F.when(signed, resigned).otherwise(F.col("_class"))}).drop("_class", "_rule", "learned")


def flow_report(classified: DataFrame) -> DataFrame:
    """Movements per class, source and rule."""
    return classified.groupBy("flow_class", "flow_source", "rule_id").agg(F.count("*").alias("n"), F.count_if("direction_conflict").alias("n_conflicts"))


def unknown_share_quantiles(classified: DataFrame) -> DataFrame:
    """Distribution over companies of the share of movements that stay unknown, and how many exceed 40 %."""
    per = classified.groupBy("company_id").agg((F.count_if(F.col("flow_class") == "unknown") / F.count("*")).alias("unknown_share"))
    quantiles = exact_quantiles(per, [], "unknown_share", (0.25, 0.5, 0.75, 0.9), 1e-4)
    sums = per.agg(F.max("unknown_share").alias("max_share"), F.count_if(F.col("unknown_share") > 0.4).alias("n_over_40"))
    return quantiles.join(sums).select(F.col("total").alias("n_companies"), *(F.round(F.col("q")[k], 6).alias(n) for k, n in enumerate(("p25", "p50", "p75", "p90"))), F.round("max_share", 6).alias("max_share"), "n_over_40")


def rule_comparison(before: DataFrame, after: DataFrame) -> DataFrame:
    """Counts per rule under two classifications."""
    a = before.groupBy("rule_id").agg(F.count("*").alias("n_before"))
    b = after.groupBy("rule_id").agg(F.count("*").alias("n_after"))
    return a.join(b, "rule_id", "full").select("rule_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_before", "n_after")))
