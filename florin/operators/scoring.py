"""Health score per company and month, its decomposition, and how stable and forecastable it is."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from florin.functions.core import exact_quantiles, kept_quantiles, month_index
from florin.operators.arrears import with_expected_service, with_multiplier
from florin.operators.cash import with_balance

# Fixed values of the score.
WINDOW_MONTHS = 6
#: Width of the bands in which scores and their differences, at most 100, are ranked.
BAND = 0.01
#: Baselines and the column that holds their prediction.
BASELINES = {"persistence": "score", "mean3": "mean3", "median": "median"}


@dataclass(frozen=True)
class ScoreParams:
    k: float = 4178.45
    alpha: float = 3.0
    beta: float = 0.25
    beta_fx: float = 0.05


def score_inputs(panel: DataFrame, due: DataFrame, anchor: DataFrame) -> DataFrame:
    """One row per company and month of what the score reads; unknown stays null.

    ``panel`` has flows, debt and anchored sums of a month, ``due`` is the arrears panel, ``anchor`` the balance per company. Months meet by key first; then one shuffle by company serves all windows.
    """
    key = ["company_id", "month"]
    rows = panel.select(*key, "has_cash_activity", "receipts_known", "payments_known", "service_known", "payments_eur", "service_eur", "net", "known_volume", "hole_volume")
    rows = rows.join(due.drop("ap", "ar", "overdue_ar").hint("merge"), key, "left").join(anchor.hint("merge"), "company_id", "left")
    rows = with_balance(rows.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("net", "known_volume", "hole_volume")}), "month")
    rows = with_multiplier(with_expected_service(rows))
    stock = F.when(F.col("n_overdue") == 0, 0.0).otherwise(F.col("overdue_eur"))
    return rows.select(*key, "has_cash_activity", F.col("receipts_known").alias("c"), F.col("payments_known").alias("p"), F.col("service_known").alias("d"), "shortfall", stock.alias("stock"), "multiplier", "arrears", "balance")


def with_sums(rows: DataFrame) -> DataFrame:
    """Six-month sums, T6, own history and cushion; only known parts enter a sum."""
    order = Window.partitionBy("company_id").orderBy("month")
    six, ever = order.rowsBetween(1 - WINDOW_MONTHS, 0), order.rowsBetween(Window.unboundedPreceding, 0)
    total = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0.0))
    rows = rows.withColumns({f"{c}6": total(c, six) for c in ("c", "p", "d", "shortfall")}).withColumns({f"{c}_ever": total(c, ever) for c in ("c", "p", "d", "shortfall")})
    rows = rows.withColumns({"any_activity": F.max("has_cash_activity").over(ever), "active6": F.sum(F.col("has_cash_activity").cast("int")).over(six), "n_window": F.count("*").over(six)})
    return with_totals(rows)


def with_totals(rows: DataFrame) -> DataFrame:
    """T6, own history and cushion from the sums and the stock."""
    stock = F.coalesce("stock", F.lit(0.0))
    owed = F.col("p_ever") + F.col("d_ever") + F.col("shortfall_ever") + stock
    return rows.withColumns({"t6": F.col("p6") + F.col("d6") + F.col("shortfall6") + stock, "r_hist": F.when(F.col("c_ever") + owed > 0, F.col("c_ever") / F.nullif(F.col("c_ever") + owed, F.lit(0.0))), "cash": F.greatest(F.lit(0.0), F.coalesce("balance", F.lit(0.0)))})


def base_score(params: ScoreParams | dict[str, Column]) -> Column:
    """Score before the downward factors; null without activity, without flows, or without any demonstrated payment or debt."""
    k, alpha = (F.lit(params.k), F.lit(params.alpha)) if isinstance(params, ScoreParams) else (params["k"], params["alpha"])
    cushion = F.least(F.col("cash"), alpha * F.col("t6"))
    k = F.when(F.col("r_hist").isNull(), 0.0).otherwise(k)
    below = F.col("c6") + cushion + F.col("t6") + k
    allowed = F.col("any_activity") & ~((F.col("c6") == 0) & (F.col("t6") == 0)) & ((F.col("p6") > 0) | (F.coalesce("stock", F.lit(0.0)) > 0))
    return F.when(allowed, 100.0 * (F.col("c6") + cushion + k * F.coalesce("r_hist", F.lit(0.0))) / F.nullif(below, F.lit(0.0)))


def health_score(rows: DataFrame, params: ScoreParams = ScoreParams()) -> DataFrame:
    """``score`` after arrears, debt multiplier and, if there is a column ``fx_index``, exchange rates; an unknown factor takes nothing off."""
    by_fx = F.coalesce(1.0 - params.beta_fx * F.col("fx_index"), F.lit(1.0)) if "fx_index" in rows.columns else F.lit(1.0)
    rows = with_sums(rows).withColumn("before", base_score(params))
    by_arrears, by_debt = F.coalesce(1.0 - params.beta * F.col("arrears"), F.lit(1.0)), F.coalesce("multiplier", F.lit(1.0))
    reason = F.when(~F.col("any_activity"), "no_cash_activity").when((F.col("c6") == 0) & (F.col("t6") == 0), "no_flows_in_window").when(F.col("before").isNull(), "no_demonstrated_payments")
    missing = sum((c.cast("int") for c in (F.col("n_window") < WINDOW_MONTHS, F.col("arrears").isNull(), F.col("balance").isNull())), F.lit(0))
    return rows.withColumns({
        "score": F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("before") * by_arrears * by_debt * by_fx)), "unscored_reason": reason,
        "confidence": F.element_at(F.array(*map(F.lit, ("high", "medium", "low", "none"))), F.least(F.lit(4), missing + 1)),
    })


def shapley(rows: DataFrame, params: ScoreParams = ScoreParams()) -> DataFrame:
    """What each of three channels takes off the score, averaged over all orders in which they can act: overdue payables among what is owed, arrears, debt multiplier.

    The score is evaluated under all eight combinations; rows without a score under any of them are left out.
    """
    owing = with_sums(rows).withColumn("_owing", base_score(params))
    scored = with_totals(owing.withColumn("stock", F.lit(None).cast("double"))).withColumn("_plain", base_score(params))
    factors = (F.coalesce(1.0 - params.beta * F.col("arrears"), F.lit(1.0)), F.coalesce("multiplier", F.lit(1.0)))
    names, out = ("obligation", "arrears", "debt"), {}

    def value(on: tuple[bool, ...]) -> Column:
        result = F.col("_owing") if on[0] else F.col("_plain")
        for factor, active in zip(factors, on[1:]):
            result = result * factor if active else result
        return F.least(F.lit(100.0), F.greatest(F.lit(0.0), result))

    for k, name in enumerate(names):
        parts = []
        for others in product((False, True), repeat=2):
            weight = (1 / 3, 1 / 6, 1 / 3)[sum(others)]
            parts.append(weight * (value((*others[:k], False, *others[k:])) - value((*others[:k], True, *others[k:]))))
        out[f"{name}_points"] = F.greatest(F.lit(0.0), sum(parts[1:], parts[0]))
    whole = scored.where("_owing IS NOT NULL AND _plain IS NOT NULL")
    return whole.select("company_id", "month", value((False,) * 3).alias("free_score"), value((True,) * 3).alias("score"), *(c.alias(n) for n, c in out.items()))


def parameter_sweep(rows: DataFrame, ks: tuple[float, ...], alphas: tuple[float, ...]) -> DataFrame:
    """The score before factors under every pair of parameters: distribution per pair, from one pass over the rows."""
    grid = F.array(*(F.struct(F.lit(float(k)).alias("k"), F.lit(float(a)).alias("alpha")) for k in ks for a in alphas))
    dealt = with_sums(rows).withColumn("g", F.explode(grid)).withColumn("s", base_score({"k": F.col("g.k"), "alpha": F.col("g.alpha")})).where("s IS NOT NULL")
    return dealt.groupBy(F.col("g.k").alias("k"), F.col("g.alpha").alias("alpha")).agg(F.count("*").alias("n"), F.avg("s").alias("mean"), F.stddev_pop("s").alias("std"), F.avg(F.col("s").between(45, 55).cast("double")).alias("share_45_55"))


def stability(scored: DataFrame) -> DataFrame:
    """Month-to-month changes of the score over consecutive scored months."""
    change = F.abs(F.col("score") - F.lag("score").over(Window.partitionBy("company_id").orderBy("month")))
    found = exact_quantiles(scored.select(change.alias("x")), [], "x", (0.5, 0.75, 0.9), BAND)
    return found.select(F.col("total").alias("n_pairs"), *(F.round(F.col("q")[k], 6).alias(n) for k, n in enumerate(("p50", "p75", "p90"))))


def dispersion(scored: DataFrame) -> DataFrame:
    """Spread of the score at every cut."""
    seen = scored.where("score IS NOT NULL")
    rows = seen.groupBy("month").agg(F.count("*").alias("n"), F.stddev_pop("score").alias("std"), F.avg(F.col("score").between(45, 55).cast("double")).alias("share_45_55"))
    rows = rows.join(exact_quantiles(seen, ["month"], "score", (0.25, 0.5, 0.75), BAND), "month")
    return rows.select("month", "n", "std", F.col("q")[1].alias("median"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"), "share_45_55")


def persistent_zeros(scored: DataFrame, reference: str, share: float = 0.95) -> DataFrame:
    """Companies to be masked, their rows kept: A, nearly all scored months below one; B, exactly zero in the reference month."""
    at = F.col("month") == F.lit(reference).cast("date")
    rows = scored.groupBy("company_id").agg(F.count("score").alias("n_scored"), F.count_if(F.col("score") < 1).alias("n_zero"), F.max(F.when(at, F.col("score"))).alias("reference_score"))
    a = (F.col("n_scored") > 0) & (F.col("n_zero") >= share * F.col("n_scored"))
    b = F.coalesce(F.col("reference_score") == 0, F.lit(False))
    return rows.withColumn("criterion", F.when(a & b, "A and B").when(a, "A").when(b, "B")).where("criterion IS NOT NULL").select("company_id", "criterion", "n_scored", "n_zero", "reference_score")


def cut_summary(scored: DataFrame, excluded: DataFrame) -> DataFrame:
    """Per cut: companies scored, excluded, and unscored by their reason; every company counts once."""
    gone = excluded.select(F.col("company_id").alias("_gone"))
    rows = scored.join(gone, F.col("company_id") == F.col("_gone"), "left")
    state = F.when(F.col("_gone").isNotNull(), "excluded").when(F.col("score").isNotNull(), "scored").otherwise(F.coalesce("unscored_reason", F.lit("unknown")))
    return rows.groupBy("month", state.alias("state"), "confidence").agg(F.count("*").alias("n"))


def _later(h: int, column: str = "score") -> Column:
    """The column of the same company h months later, or before if h is negative, null if there is none."""
    return F.max(column).over(Window.partitionBy("company_id").orderBy(month_index(F.col("month"))).rangeBetween(h, h))


def _with_baselines(scored: DataFrame, horizons: tuple[int, ...] = ()) -> DataFrame:
    """Scored months with their predictions and, per horizon, the actual score. Two windows of one company, kept since the medians read them, too; these are a row a month."""
    order = Window.partitionBy("company_id").orderBy("month")
    name = [] if horizons else ["company_id"]
    seen = scored.where("score IS NOT NULL").select(*name, "month", "score", F.avg("score").over(order.rowsBetween(-2, 0)).alias("mean3"), *(_later(h).alias(f"later_{h}") for h in horizons)).persist()
    middle = kept_quantiles(seen, ["month"], "score", (0.5,), BAND).select(F.col("month").alias("_month"), F.col("q")[0].alias("median"))
    return seen.join(F.broadcast(middle), F.col("month") == F.col("_month")).drop("_month")


def baseline_predictions(scored: DataFrame) -> DataFrame:
    """``(company_id, month, baseline, value)``: persistence, the mean of the last three scores there are, and the median of all companies at the origin."""
    named = F.array(*(F.struct(F.lit(n).alias("baseline"), F.col(c).alias("value")) for n, c in BASELINES.items()))
    return _with_baselines(scored).select("company_id", "month", F.explode(named).alias("f")).select("company_id", "month", "f.*")


def baseline_errors(scored: DataFrame, horizons: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Errors of the baselines per horizon in months: those of pairs with a score at both ends, and how many pairs have none at the target."""
    each = F.array(*(F.struct(F.lit(n).alias("baseline"), F.lit(h).alias("h"), F.col(c).alias("value"), F.col(f"later_{h}").alias("actual")) for n, c in BASELINES.items() for h in horizons))
    pairs = _with_baselines(scored, horizons).select(F.explode(each).alias("f")).select("f.*").withColumn("error", F.col("value") - F.col("actual")).withColumn("size", F.abs("error"))
    sums = pairs.groupBy("baseline", "h").agg(F.count("actual").alias("n"), F.count_if(F.col("actual").isNull()).alias("n_without_target"), F.avg("size").alias("mae"), F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"), F.avg("error").alias("bias"))
    sizes = kept_quantiles(pairs, ["baseline", "h"], "size", (0.5, 0.75, 0.9), BAND).select(F.col("baseline").alias("_baseline"), F.col("h").alias("_h"), "q")
    rows = sums.join(sizes, (F.col("baseline") == F.col("_baseline")) & (F.col("h") == F.col("_h")))
    return rows.select(*sums.columns, *(F.col("q")[k].alias(n) for k, n in enumerate(("p50", "p75", "p90"))))


def autocorrelation(scored: DataFrame, horizons: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Pearson and Spearman correlation and the regression of the score on itself h months before; ranks average ties.

    A score is an origin or a target at every horizon, so distinct scores are ranked once for all of them: how many origins and targets have a lower one.
    Months then meet the ranks of their score, and go back to their company, where pairs are windows.
    """
    roles = {f"{side}{h}": F.col(f"_{side}{h}") for h in horizons for side in "xy"}
    seen = scored.where("score IS NOT NULL").select("company_id", "month", "score", *(F.when(_later(h if side == "x" else -h).isNotNull(), 1).otherwise(0).alias(f"_{side}{h}") for h in horizons for side in "xy"))
    seen = seen.persist()  # counted and ranked
    counted = seen.groupBy("score").agg(*(F.sum(c).alias(n) for n, c in roles.items())).withColumn("_band", F.floor(F.col("score") / BAND))
    bands = counted.groupBy("_band").agg(*(F.sum(n).alias(f"_all_{n}") for n in roles))
    whole, inside = Window.partitionBy(F.lit(0)).orderBy("_band"), Window.partitionBy("_band").orderBy("score")  # a row a band
    bands = bands.select(F.col("_band").alias("_of_band"), *((F.sum(f"_all_{n}").over(whole) - F.col(f"_all_{n}")).alias(f"_before_{n}") for n in roles))
    # twice the mean place of equal scores, a whole number
    ranks = counted.withColumns({f"_to_{n}": F.sum(n).over(inside) for n in roles}).join(F.broadcast(bands), F.col("_band") == F.col("_of_band"))
    ranks = ranks.select(F.col("score").alias("_score"), *((2 * (F.col(f"_before_{n}") + F.col(f"_to_{n}")) - F.col(n) + 1).alias(f"r{n}") for n in roles))
    ranked = seen.select("company_id", "month", "score").join(ranks.hint("merge"), F.col("score") == F.col("_score")).drop("_score")
    each = F.array(*(F.struct(F.lit(h).alias("h"), F.col("score").alias("x"), F.col(f"later_{h}").alias("y"), (F.col(f"rx{h}") / 2).alias("rx"), (F.col(f"_ry{h}") / 2).alias("ry")) for h in horizons))
    pairs = ranked.select("score", *(f"rx{h}" for h in horizons), *(_later(h).alias(f"later_{h}") for h in horizons), *(_later(h, f"ry{h}").alias(f"_ry{h}") for h in horizons))
    pairs = pairs.select(F.explode(each).alias("f")).select("f.*").where("y IS NOT NULL")
    return pairs.groupBy("h").agg(F.count("*").alias("n"), F.corr("x", "y").alias("pearson"), F.corr("rx", "ry").alias("spearman"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"))
