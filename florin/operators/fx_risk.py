"""Exchange-rate risk of live receivables per company and month: loss already incurred, and an index of unstable money as a value or an interval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from florin.functions.core import flags
from florin.operators.exposure import at_cuts
from florin.operators.fx import SEVERITY, rate_on_or_before

# What a high confidence needs, the weight of the index in the score and the weights tried, and the points that are material.
LEAST_EUR, LEAST_INVOICES = 2000.0, 3
BETA, BETAS = 0.05, (0.05, 0.10, 0.25)
MATERIAL_POINTS = 1.0
_KEY = ["company_id", "month"]


def _severity(tier: str) -> Column:
    """Of a tier; an unknown one is the worst."""
    out = F.lit(1.0)
    for name, value in SEVERITY.items():
        out = F.when(F.col(tier) == name, value).otherwise(out)
    return F.when(F.col("currency") == "EUR", 0.0).otherwise(out)


def valued_receivables(receivables: DataFrame, quotes: DataFrame, first: str, last: str) -> DataFrame:
    """Live receivables with their EUR value at issue (own conversion if reported and not doubtful, else the rate on or before the issue) and at the month's end.

    A currency has one rate per day asked, whatever the number of invoices, so rates are broadcast: those of the issue to the receivables, before these are
    dealt by company, and those of the cuts to the months that they make.
    """
    covered = quotes.select(F.col("currency").alias("_covered")).distinct()
    issued = rate_on_or_before(receivables.select("currency", "issuance_date_ok").distinct(), quotes, "issuance_date_ok").select(F.col("currency").alias("_c"), F.col("issuance_date_ok").alias("_day"), F.col("rate").alias("issue_rate"))
    months = F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("INTERVAL 1 MONTH"))
    asked = quotes.select("currency").distinct().select("currency", F.explode(months).alias("month")).withColumn("cut", F.last_day("month"))
    cuts = rate_on_or_before(asked, quotes, "cut").select(F.col("currency").alias("_c"), F.col("month").alias("_month"), F.col("rate").alias("cut_rate"))
    rows = receivables.join(F.broadcast(covered), F.col("currency") == F.col("_covered"), "left").join(F.broadcast(issued), (F.col("currency") == F.col("_c")) & (F.col("issuance_date_ok") == F.col("_day")), "left")
    euro = F.col("currency") == "EUR"
    own = F.when(euro, F.col("amount")).when((F.col("amount_eur_source") == "reported") & ~F.coalesce("fx_ambiguous", F.lit(False)), F.col("amount_eur"))
    rows = rows.select(
        "company_id", "currency", "amount", (F.col("_covered").isNull() & (F.col("currency") != "EUR")).alias("is_opaque"), F.coalesce(own, F.col("amount") / F.col("issue_rate")).alias("issue_eur"),
        (own.isNull() & F.col("issue_rate").isNotNull()).alias("is_rescued"), "begin", "end",
    )
    rows = at_cuts(rows).join(F.broadcast(cuts), (F.col("currency") == F.col("_c")) & (F.col("month") == F.col("_month")), "left")
    return rows.select(*_KEY, "currency", "amount", "is_opaque", "issue_eur", "is_rescued", F.when(euro, F.col("amount")).otherwise(F.col("amount") / F.col("cut_rate")).alias("cut_eur"))


def risk_by_currency(valued: DataFrame, index: DataFrame) -> DataFrame:
    """Per company, month and currency: values, loss since issue, and the severity of the currency's tiers; the weight is the value at the cut, that at issue where none is known, and nothing for a currency without any rate."""
    loss = F.col("issue_eur") - F.col("cut_eur")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    sums = valued.groupBy(*_KEY, "currency", "is_opaque").agg(
        F.count("*").alias("n"), total("amount").alias("original"), F.count("issue_eur").alias("n_at_issue"), total("issue_eur").alias("issue_eur"), F.count_if("is_rescued").alias("n_rescued"),
        F.count("cut_eur").alias("n_at_cut"), total("cut_eur").alias("cut_eur"), F.count(loss).alias("n_loss"), total(loss).alias("loss_eur"),
    )
    tiers = F.broadcast(index.select(F.col("currency").alias("_c"), F.col("month").alias("_m"), "tier", "volatility_tier", "drift_tier"))  # a row per currency and month
    rows = sums.join(tiers, (F.col("currency") == F.col("_c")) & (F.col("month") == F.col("_m")), "left").drop("_c", "_m")
    weight = F.when(F.col("is_opaque"), 0.0).when((F.col("n_at_cut") == 0) & (F.col("n_at_issue") > 0), F.col("issue_eur")).otherwise(F.col("cut_eur"))
    return rows.withColumns({"weight": F.greatest(weight, F.lit(0.0)), "severity": _severity("tier"), "by_volatility": _severity("volatility_tier"), "by_drift": _severity("drift_tier")})


def fx_risk(by_currency: DataFrame) -> DataFrame:
    """Per company and month: the money-weighted index; where money of a currency without rates is mixed in, only its bounds, up to one, and where there is no other, one."""
    weighted = lambda c: F.sum(F.col("weight") * F.col(c)) / F.nullif(F.sum("weight"), F.lit(0.0))
    part = lambda value: F.sum(F.when(F.col("severity") == value, F.col("weight")).otherwise(0.0)) / F.nullif(F.sum("weight"), F.lit(0.0))
    rows = by_currency.groupBy(*_KEY).agg(
        F.sum("n").alias("n_live"), F.sum("n_at_cut").alias("n_valued"), F.sum(F.when(F.col("is_opaque"), F.col("n")).otherwise(0)).alias("n_opaque"), F.sum("n_rescued").alias("n_rescued"), F.sum("cut_eur").alias("cut_eur"), F.sum("n_loss").alias("n_loss"), F.sum("loss_eur").alias("_loss"),
        weighted("severity").alias("_index"), weighted("by_volatility").alias("by_volatility"), weighted("by_drift").alias("by_drift"), part(0.0).alias("stable_share"), part(0.5).alias("volatile_share"), part(1.0).alias("hyper_share"),
        F.count("*").alias("_n"), F.count_if(F.col("currency") == "EUR").alias("_euro"),
    )
    opaque, known = F.col("n_opaque") > 0, F.col("_index").isNotNull()
    unvalued = F.col("n_live") - F.col("n_valued")
    thin = (F.col("cut_eur") < LEAST_EUR) | (F.col("n_valued") < LEAST_INVOICES)
    only = F.when(opaque, 1.0)
    noted = flags(
        (unvalued > 0, "unvalued_exposure"), (opaque, "opaque_exposure"), (opaque & known, "index_interval"), (opaque & ~known, "only_opaque"), ((F.col("_euro") > 0) & (F.col("_n") > 1), "several_currencies"),
        ((F.col("_euro") > 0) & (F.col("_n") == 1), "eur_only"), (F.col("n_rescued") > 0, "valued_by_rate"), (F.col("n_loss") > 0, "incurred_loss"),
    )
    return rows.select(
        *_KEY, "n_live", unvalued.alias("n_unvalued"), "n_opaque", F.when(F.col("n_valued") > 0, F.col("cut_eur")).alias("live_eur"), F.when(F.col("n_loss") > 0, F.col("_loss")).alias("loss_eur"), "by_volatility", "by_drift", "stable_share", "volatile_share", "hyper_share",
        F.when(known & ~opaque, F.col("_index")).when(~known, only).alias("fx_index"), F.coalesce(F.col("_index"), only).alias("fx_index_min"), F.when(opaque, 1.0).otherwise(F.col("_index")).alias("fx_index_max"), (opaque & known).alias("is_interval"),
        F.when(unvalued / F.col("n_live") >= 0.5, "low").when((unvalued > 0) | thin, "medium").otherwise("high").alias("confidence"), noted.alias("flags"),
    )


def with_risk(rows: DataFrame, risk: DataFrame, *columns: str) -> DataFrame:
    """Rows of company and month with the named columns of their risk and ``has_risk``.

    Both sides are dealt by company, so a company's months of risk meet its rows as one map, and neither is shuffled by month.
    """
    months = F.map_from_entries(F.collect_list(F.struct("month", F.struct(*columns))))
    known = risk.groupBy("company_id").agg(months.alias("_months")).select(F.col("company_id").alias("_company"), "_months").hint("merge")
    rows = rows.join(known, F.col("company_id") == F.col("_company"), "left").withColumn("_risk", F.try_element_at("_months", F.col("month")))
    return rows.select(*rows.drop("_company", "_months", "_risk").columns, *(F.col("_risk")[c].alias(c) for c in columns), F.col("_risk").isNotNull().alias("has_risk"))


def applied_index(risk: DataFrame) -> DataFrame:
    """The index that takes points off: the lower bound of an interval, which is the least that fits what is known."""
    return risk.select(*_KEY, F.when(F.col("is_interval"), F.col("fx_index_min")).otherwise(F.col("fx_index")).alias("fx_index"))


def counterfactual(scores: DataFrame, risk: DataFrame, betas: tuple[float, ...] = BETAS) -> DataFrame:
    """Per weight: how many scored months lose points to the index, exactly or within bounds, how many materially, and how many companies.

    A company's months are summed before the companies are counted.
    """
    rows = with_risk(scores.where("score IS NOT NULL"), risk, "fx_index", "fx_index_max", "is_interval").where("has_risk").withColumn("beta", F.explode(F.array(*map(F.lit, betas))))
    exact = F.col("fx_index").isNotNull()
    lose = F.when(exact, F.col("beta") * F.col("score") * F.col("fx_index"))
    most = F.when(exact, lose).when(F.col("is_interval"), F.col("beta") * F.col("score") * F.col("fx_index_max"))
    own = rows.groupBy("beta", "company_id").agg(
        F.count(lose).alias("n_exact"), F.count_if(lose > 0).alias("n_affected"), F.count_if("is_interval").alias("n_interval"), F.count_if(F.col("is_interval") & (most > 0)).alias("n_affected_interval"), F.count_if(most >= MATERIAL_POINTS).alias("n_material"),
        F.coalesce(F.sum(lose), F.lit(0.0)).alias("_sum"), F.max(most).alias("_max"),
    )
    return own.groupBy("beta").agg(
        *(F.sum(c).alias(c) for c in ("n_exact", "n_affected", "n_interval", "n_affected_interval", "n_material")), F.count_if(F.col("_max") > 0).alias("n_companies_affected"), F.count_if(F.col("n_material") > 0).alias("n_companies_material"),
        (F.sum("_sum") / F.nullif(F.sum("n_exact"), F.lit(0))).alias("mean_points"), F.max("_max").alias("most_points"),
    )
