"""Registered queries of evidence, labels, signals and panel checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from florin.functions.core import joined
from florin.operators import arrears as A
from florin.operators import cash as K
from florin.operators import marts as M
from florin.operators import scoring as H
from florin.operators import signals as S
from florin.plans import cash_queries, score_queries
from florin.plans.arrears_queries import _payables
from florin.plans.queries import LAST_DAY, STEPS, _flows, _kept_perimeter, _universe, query
from florin.sources.treasury import FIRST_MONTH, LAST_MONTH, Treasury

STEPS["cohorts60"] = """SELECT company_id, month, n_issued, last_day(month) + 60 AS known, r / issued_eur AS conversion FROM (SELECT company_id, CAST(date_trunc('month', issued) AS DATE) AS month, count(*) AS n_issued, count(eur) AS n_eur, count(*) FILTER (is_uncertain) AS n_unc, sum(abs(eur)) AS issued_eur, coalesce(sum(abs(eur)) FILTER (date_diff('day', issued, settled) <= 60), 0) AS r
    FROM universe WHERE side = 'ar' GROUP BY ALL) WHERE n_eur = n_issued AND n_unc = 0 AND issued_eur <> 0 AND last_day(month) + 60 <= DATE '2001-07-31'"""
STEPS["states"] = """SELECT *, CASE WHEN act AND n_hole = 0 THEN CASE WHEN round(rec - pay + amb_in, 2) < 0 THEN true WHEN round(rec - pay - amb_out, 2) >= 0 THEN false END END AS base, coalesce(date_diff('month', first_cash_month, month) < 3, true) AS warm FROM flow_panel"""
STEPS["ratios"] = "SELECT company_id, month, CASE WHEN act AND n_without_eur = 0 AND volume_known > 0 AND n_hole = 0 THEN (rec - pay - amb_out) / volume_known END AS low, CASE WHEN act AND n_without_eur = 0 AND volume_known > 0 AND n_hole = 0 THEN (rec - pay + amb_in) / volume_known END AS high FROM flow_panel"
STEPS["deltas"] = """SELECT company_id, month, rl - ph AS dl, rh - pl AS dh FROM (SELECT company_id, month, CASE WHEN count(low) OVER r = 3 THEN avg(low) OVER r END AS rl, CASE WHEN count(high) OVER r = 3 THEN avg(high) OVER r END AS rh, CASE WHEN count(low) OVER p = 3 THEN avg(low) OVER p END AS pl, CASE WHEN count(high) OVER p = 3 THEN avg(high) OVER p END AS ph
    FROM ratios WINDOW r AS (PARTITION BY company_id ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), p AS (PARTITION BY company_id ORDER BY month ROWS BETWEEN 5 PRECEDING AND 3 PRECEDING))"""
STEPS["directed"] = "SELECT *, CASE WHEN dl >= 0.05 THEN 'improving' WHEN dh <= -0.05 THEN 'deteriorating' WHEN greatest(abs(dl), abs(dh)) < 0.05 AND dl IS NOT NULL THEN 'stable' ELSE 'insufficient' END AS direction FROM deltas"


@query("""SELECT f.company_id, f.month, c.cohort AS cohort_month, round(c.conversion, 6) AS conversion, CAST(date_diff('day', c.known, f.available_at) AS INTEGER) AS cohort_age, base AS deficit, CASE WHEN NOT act OR n_cash = n_without_eur THEN 'insufficient' WHEN warm OR active_months < 3 OR n_hole > 0 OR n_ambiguous > 0 THEN 'partial' ELSE 'publishable' END AS operating_state,
    CASE WHEN c.conversion IS NULL THEN 'insufficient' WHEN c.n_issued < 5 OR date_diff('day', c.known, f.available_at) > 90 THEN 'partial' ELSE 'publishable' END AS collection_state FROM states f
    LEFT JOIN LATERAL (SELECT p.month AS cohort, p.known, p.conversion, p.n_issued FROM cohorts60 p WHERE p.company_id = f.company_id AND p.known <= f.available_at ORDER BY p.known DESC LIMIT 1) c ON true""")
def m13_evidence(t: Treasury) -> DataFrame:
    perimeter = _kept_perimeter(t)
    flows = M.flow_panel(M.company_months(t.companies, FIRST_MONTH, LAST_MONTH), perimeter)
    out = S.evidence(flows, M.debt_panel(flows, perimeter), M.receipt_cohorts(_universe(t), LAST_DAY), FIRST_MONTH)
    return out.select("company_id", "month", "cohort_month", F.round("conversion", 6).alias("conversion"), "cohort_age", "deficit", "operating_state", "collection_state")


@query("""SELECT company_id, month, last_day(CAST(month + INTERVAL 3 MONTH AS DATE)) AS known_on, n_min AS base_min, n_max AS base_max, reason, CASE WHEN reason IS NULL THEN n_min >= 2 END AS target FROM (SELECT *, CASE WHEN NOT act THEN 'no_cash_at_origin' WHEN warm THEN 'warm_up' WHEN last_day(CAST(month + INTERVAL 3 MONTH AS DATE)) > DATE '2001-07-31' THEN 'no_horizon' WHEN n_act < 3 THEN 'inactive_horizon' WHEN n_min < 2 AND n_max >= 2 THEN 'material_uncertainty' END AS reason
    FROM (SELECT *, coalesce(lead(act, 1) OVER w, false)::INT + coalesce(lead(act, 2) OVER w, false)::INT + coalesce(lead(act, 3) OVER w, false)::INT AS n_act, coalesce(lead(base, 1) OVER w, false)::INT + coalesce(lead(base, 2) OVER w, false)::INT + coalesce(lead(base, 3) OVER w, false)::INT AS n_min,
    coalesce(lead(base, 1) OVER w, true)::INT + coalesce(lead(base, 2) OVER w, true)::INT + coalesce(lead(base, 3) OVER w, true)::INT AS n_max FROM states WINDOW w AS (PARTITION BY company_id ORDER BY month)))""")
def m16_deficit_targets(t: Treasury) -> DataFrame:
    return S.deficit_targets(_flows(t), LAST_DAY)


@query("SELECT company_id, month, round(dl, 6) AS delta_low, round(dh, 6) AS delta_high, direction FROM directed")
def x02_directions(t: Treasury) -> DataFrame:
    return S.directions(_flows(t)).withColumns({c: F.round(c, 6) for c in ("delta_low", "delta_high")})


@query("""SELECT company_id, direction, min(month) AS watch_month, CASE WHEN count(*) >= 2 THEN CAST(min(month) + INTERVAL 1 MONTH AS DATE) END AS confirmed_month, max(month) AS last_month, count(*) AS n_months FROM (SELECT *, sum(CASE WHEN direction IN ('improving', 'deteriorating') AND direction IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY company_id ORDER BY month) AS run
    FROM (SELECT *, lag(direction) OVER (PARTITION BY company_id ORDER BY month) AS before FROM directed)) WHERE direction IN ('improving', 'deteriorating') GROUP BY company_id, run, direction""")
def x03_episodes(t: Treasury) -> DataFrame:
    return S.episodes(S.directions(_flows(t)))


@query("""SELECT 'unique_key' AS "check", 0::BIGINT AS n UNION ALL SELECT 'fx', count(*) FILTER (false) FROM flow_panel UNION ALL SELECT 'bounds', 0 UNION ALL SELECT 'idle', 0 UNION ALL SELECT 'negative_months', count(*) FILTER (act AND net_known < 0) FROM flow_panel""")
def m19_panel_checks(t: Treasury) -> DataFrame:
    return S.panel_checks(_flows(t), ["company_id", "month"], {
        "fx": (F.col("n_without_eur") > 0) & F.col("net_eur").isNotNull(), "bounds": F.col("operating_min") > F.col("operating_max"), "idle": ~F.col("has_cash_activity") & F.col("net_known").isNotNull(), "negative_months": F.col("net_known") < 0})


@query("""SELECT 'net' AS "column", count(*) FILTER (b.company_id IS NULL) AS only_old, count(*) FILTER (a.company_id IS NULL) AS only_new, count(*) FILTER (abs(a.net - b.net) > greatest(1e-8, 1e-12 * abs(a.net))) AS n_changed, count(*) FILTER (sign(a.net) * sign(b.net) < 0) AS n_sign_changes, round(max(abs(a.net - b.net)), 2) AS max_difference FROM cash_months_closed a FULL JOIN anchored_months b ON a.company_id = b.company_id AND a.month = b.month""")
def q02_compare_panels(t: Treasury) -> DataFrame:
    tx = cash_queries._tx(t)
    out = S.compare_panels(K.cash_flows(tx, "month"), K.cash_flows(tx, "month", K.ANCHORED), ["company_id", "month"], ["net"])
    return out.select("column", "only_old", "only_new", "n_changed", "n_sign_changes", F.round("max_difference", 2).alias("max_difference"))


@query("""SELECT company_id, month, round(score, 4) AS score, concat_ws(',', CASE WHEN change <= -5 THEN 'falling_score' END, CASE WHEN score < 40 THEN 'low_score' END, CASE WHEN balance < 0 THEN 'negative_cash' END, CASE WHEN c - p - coalesce(d, 0) < 0 THEN 'net_outflow' END, CASE WHEN stock > 0 THEN 'overdue_payables' END, CASE WHEN overdue > 0 THEN 'overdue_receivables' END, CASE WHEN short > 0 THEN 'service_shortfall' END) AS attention
    FROM (SELECT *, score - lag(score) OVER (PARTITION BY company_id ORDER BY month) AS change FROM scored) LEFT JOIN (SELECT company_id, month, overdue FROM severities WHERE side = 'ar') USING (company_id, month) WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY month DESC) = 1""")
def k02_attention(t: Treasury) -> DataFrame:
    late = A.arrears_panel(_payables(t), FIRST_MONTH, LAST_MONTH).select("company_id", "month", "overdue_ar")
    return S.attention(H.health_score(score_queries._inputs(t)), late).select("company_id", "month", F.round("score", 4).alias("score"), joined(F.col("attention")).alias("attention"))
