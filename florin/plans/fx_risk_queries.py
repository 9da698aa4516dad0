"""Registered queries of exchange-rate risk and of the score that reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from florin.functions.core import joined
from florin.operators import exposure as E
from florin.operators import fx as X
from florin.operators import fx_risk as R
from florin.operators import scoring as H
from florin.plans import arrears_queries  # noqa: F401  the volatility and drift of its oracles
from florin.plans.queries import STEPS, _inv, money, query
from florin.plans.score_queries import _inputs, rounded
from florin.sources.treasury import FIRST_MONTH, LAST_MONTH, Treasury

STEPS["tiers"] = """SELECT currency, month, vt, dt, CASE WHEN vt IS NULL OR 'hyper' IN (vt, coalesce(dt, '')) THEN 'hyper' WHEN 'volatile' IN (vt, coalesce(dt, '')) THEN 'volatile' ELSE 'stable' END AS tier FROM (SELECT currency, month, CASE WHEN volatility IS NULL THEN NULL WHEN volatility < 0.025 THEN 'stable' WHEN volatility < 0.1 THEN 'volatile' ELSE 'hyper' END AS vt,
    CASE WHEN drift IS NULL THEN NULL WHEN -drift < 0.025 THEN 'stable' WHEN -drift < 0.06 THEN 'volatile' ELSE 'hyper' END AS dt FROM volatility FULL JOIN drifts USING (currency, month))"""
_RATE = "(SELECT f.rate FROM fx_daily f WHERE f.currency = i.currency AND f.day <= {day} ORDER BY f.day DESC LIMIT 1)"
STEPS["valued_live"] = f"""SELECT *, CASE WHEN currency = 'EUR' THEN amount ELSE coalesce(own, amount / issue_rate) END AS issue_eur, currency <> 'EUR' AND own IS NULL AND issue_rate IS NOT NULL AS rescued, CASE WHEN currency = 'EUR' THEN amount ELSE amount / cut_rate END AS cut_eur FROM (SELECT i.company_id, m.month, i.currency, i.amount, i.currency NOT IN ('EUR', 'USD', 'GBP') AS opaque,
    CASE WHEN i.amount_eur IS NOT NULL AND NOT coalesce(i.currency <> i.accounting_currency AND i.exchange_rate = 1, false) THEN i.amount_eur END AS own, {_RATE.format(day='i.issuance_date')} AS issue_rate, {_RATE.format(day='m.month_end')} AS cut_rate
    FROM inv i JOIN months m ON i.issuance_date <= m.month_end AND (i.status_norm <> 'paid' OR i.payment_date > m.month_end) WHERE document_type = 'invoice' AND status_norm <> 'cancel' AND amount > 0)"""
_SEV = "CASE WHEN r.currency = 'EUR' THEN 0.0 WHEN {t} = 'stable' THEN 0.0 WHEN {t} = 'volatile' THEN 0.5 ELSE 1.0 END::DOUBLE"
STEPS["risk_rows"] = f"""SELECT r.*, greatest(0, CASE WHEN opaque THEN 0 WHEN n_at_cut = 0 AND n_at_issue > 0 THEN issue_eur ELSE cut_eur END) AS weight, {_SEV.format(t='t.tier')} AS sev, {_SEV.format(t='t.vt')} AS sev_v, {_SEV.format(t='t.dt')} AS sev_d FROM (SELECT company_id, month, currency, opaque, count(*) AS n, sum(amount) AS original, count(issue_eur) AS n_at_issue, coalesce(sum(issue_eur), 0) AS issue_eur,
    count(*) FILTER (rescued) AS n_rescued, count(cut_eur) AS n_at_cut, coalesce(sum(cut_eur), 0) AS cut_eur, count(issue_eur - cut_eur) AS n_loss, coalesce(sum(issue_eur - cut_eur), 0) AS loss FROM valued_live GROUP BY ALL) r LEFT JOIN tiers t ON t.currency = r.currency AND t.month = r.month"""
STEPS["risk_sums"] = """SELECT company_id, month, sum(n) AS n_live, sum(n_at_cut) AS n_valued, coalesce(sum(n) FILTER (opaque), 0) AS n_opaque, sum(n_rescued) AS n_rescued, sum(cut_eur) AS cut_eur, sum(n_loss) AS n_loss, sum(loss) AS loss, sum(weight * sev) / nullif(sum(weight), 0) AS idx, sum(weight * sev_v) / nullif(sum(weight), 0) AS by_volatility, sum(weight * sev_d) / nullif(sum(weight), 0) AS by_drift,
    coalesce(sum(weight) FILTER (sev = 0), 0) / nullif(sum(weight), 0) AS stable_share, coalesce(sum(weight) FILTER (sev = 0.5), 0) / nullif(sum(weight), 0) AS volatile_share, coalesce(sum(weight) FILTER (sev = 1), 0) / nullif(sum(weight), 0) AS hyper_share, count(*) AS n_currencies, count(*) FILTER (currency = 'EUR') AS n_euro FROM risk_rows GROUP BY company_id, month"""
STEPS["fx_risks"] = """SELECT *, CASE WHEN idx IS NOT NULL AND n_opaque = 0 THEN idx WHEN idx IS NULL AND n_opaque > 0 THEN 1.0 END AS fx_index, CASE WHEN idx IS NULL AND n_opaque > 0 THEN 1.0 ELSE idx END AS fx_index_min, CASE WHEN n_opaque > 0 THEN 1.0 ELSE idx END AS fx_index_max, n_opaque > 0 AND idx IS NOT NULL AS is_interval FROM risk_sums"""


def _risk(t: Treasury) -> DataFrame:
    receivables = E.receivables(_inv(t), FIRST_MONTH, LAST_MONTH)
    return R.fx_risk(R.risk_by_currency(R.valued_receivables(receivables, t.fx_daily, FIRST_MONTH, LAST_MONTH), X.fx_index(t.fx_daily)))


_INDICES = ("by_volatility", "by_drift", "stable_share", "volatile_share", "hyper_share", "fx_index", "fx_index_min", "fx_index_max")


@query(f"""SELECT company_id, month, CAST(n_live AS BIGINT) AS n_live, CAST(n_live - n_valued AS BIGINT) AS n_unvalued, CAST(n_opaque AS BIGINT) AS n_opaque, CASE WHEN n_valued > 0 THEN round(cut_eur, 2) END AS live_eur, CASE WHEN n_loss > 0 THEN round(loss, 2) END AS loss_eur, {', '.join(f'round({c}, 6) AS {c}' for c in _INDICES)}, is_interval,
    CASE WHEN (n_live - n_valued) / n_live >= 0.5 THEN 'low' WHEN n_live > n_valued OR cut_eur < 2000 OR n_valued < 3 THEN 'medium' ELSE 'high' END AS confidence, array_to_string(list_sort(list_filter([CASE WHEN n_live > n_valued THEN 'unvalued_exposure' END, CASE WHEN n_opaque > 0 THEN 'opaque_exposure' END, CASE WHEN is_interval THEN 'index_interval' END, CASE WHEN n_opaque > 0 AND idx IS NULL THEN 'only_opaque' END,
        CASE WHEN n_euro > 0 AND n_currencies > 1 THEN 'several_currencies' END, CASE WHEN n_euro > 0 AND n_currencies = 1 THEN 'eur_only' END, CASE WHEN n_rescued > 0 THEN 'valued_by_rate' END, CASE WHEN n_loss > 0 THEN 'incurred_loss' END], lambda x: x IS NOT NULL)), ',') AS flags FROM fx_risks""")
def r12_fx_risk(t: Treasury) -> DataFrame:
    return _risk(t).select("company_id", "month", "n_live", "n_unvalued", "n_opaque", *money("live_eur", "loss_eur"), *rounded(*_INDICES, digits=6), "is_interval", "confidence", joined(F.col("flags")).alias("flags"))


_LOSS = "CASE WHEN fx_index IS NOT NULL THEN beta * score * fx_index END"
_MOST = "CASE WHEN fx_index IS NOT NULL THEN beta * score * fx_index WHEN is_interval THEN beta * score * fx_index_max END"


@query(f"""SELECT beta, count(l) AS n_exact, count(*) FILTER (l > 0) AS n_affected, count(*) FILTER (is_interval) AS n_interval, count(*) FILTER (is_interval AND m > 0) AS n_affected_interval, count(*) FILTER (m >= 1.0) AS n_material, count(DISTINCT CASE WHEN m > 0 THEN company_id END) AS n_companies_affected, count(DISTINCT CASE WHEN m >= 1.0 THEN company_id END) AS n_companies_material,
    round(avg(l), 6) AS mean_points, round(max(m), 6) AS most_points FROM (SELECT beta, company_id, is_interval, {_LOSS} AS l, {_MOST} AS m FROM scored JOIN fx_risks USING (company_id, month) CROSS JOIN (VALUES (0.05::DOUBLE), (0.10::DOUBLE), (0.25::DOUBLE)) b(beta) WHERE score IS NOT NULL) GROUP BY beta""")
def r13_fx_counterfactual(t: Treasury) -> DataFrame:
    out = R.counterfactual(H.health_score(_inputs(t)).select("company_id", "month", "score"), _risk(t))
    return out.withColumns({c: F.round(c, 6) for c in ("mean_points", "most_points")})


@query("""SELECT company_id, month, round(least(100, greatest(0, before * coalesce(1 - 0.25 * arrears, 1) * coalesce(multiplier, 1) * coalesce(1 - 0.05 * applied, 1))), 4) AS score, round(applied, 6) AS fx_index FROM (SELECT s.*, CASE WHEN is_interval THEN fx_index_min ELSE r.fx_index END AS applied FROM scored s LEFT JOIN fx_risks r USING (company_id, month))""")
def h03_score_with_fx(t: Treasury) -> DataFrame:
    rows = R.with_risk(_inputs(t), R.applied_index(_risk(t)), "fx_index").drop("has_risk")
    return H.health_score(rows).select("company_id", "month", *rounded("score"), *rounded("fx_index", digits=6))
