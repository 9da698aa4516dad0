"""Registered queries of counts and checks over the layers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from florin.operators import arrears as A
from florin.operators import cash as K
from florin.operators import census as N
from florin.operators import coverage as O
from florin.operators import scoring as H
from florin.plans import cash_queries, coverage_queries, score_queries
from florin.plans.arrears_queries import _payables
from florin.plans.queries import STEPS, _inv, _tx, money, query
from florin.sources.treasury import ANCHOR_DAY, FIRST_MONTH, LAST_MONTH, Treasury

CUT = coverage_queries.CUT
STEPS["points"] = """SELECT greatest(0, (v000 - v100) / 3 + (v010 - v110) / 6 + (v001 - v101) / 6 + (v011 - v111) / 3) AS o, greatest(0, (v000 - v010) / 3 + (v100 - v110) / 6 + (v001 - v011) / 6 + (v101 - v111) / 3) AS a, greatest(0, (v000 - v001) / 3 + (v100 - v101) / 6 + (v010 - v011) / 6 + (v110 - v111) / 3) AS d
    FROM (SELECT company_id, month, least(100, greatest(0, plain)) AS v000, least(100, greatest(0, owing)) AS v100, least(100, greatest(0, plain * fa)) AS v010, least(100, greatest(0, plain * fd)) AS v001, least(100, greatest(0, owing * fa)) AS v110, least(100, greatest(0, owing * fd)) AS v101, least(100, greatest(0, plain * fa * fd)) AS v011, least(100, greatest(0, owing * fa * fd)) AS v111 FROM channels)"""
STEPS["arrears_rows"] = "SELECT company_id, month, coalesce(0.7 * ap + 0.3 * ar, ap, ar) AS arrears FROM (SELECT company_id, month, max(r) FILTER (side = 'ap') AS ap, max(r) FILTER (side = 'ar') AS ar FROM robust GROUP BY ALL)"


def _daily(t: Treasury) -> DataFrame:
    return K.daily_panel(K.cash_flows(cash_queries._tx(t), "date_ok", K.ANCHORED), cash_queries._anchor(t), ANCHOR_DAY)


@query("SELECT f.company_id, round(position, 2) AS position, round(anchor, 2) AS anchor, round(anchor - position + 1e-6, 2) AS gap FROM forward f JOIN anchor_of USING (company_id) WHERE month = DATE '2001-07-01' AND anchor IS NOT NULL")
def l06_position_against_anchor(t: Treasury) -> DataFrame:
    found = N.position_against_anchor(K.forward_position(K.cash_flows(cash_queries._tx(t), "month")), cash_queries._anchor(t), LAST_MONTH)
    return found.select("company_id", *money("position", "anchor"), F.round(F.col("gap") + 1e-6, 2).alias("gap"))


@query(f"SELECT company_id, count(*) AS n_days, max(day) AS last_day FROM daily_rows WHERE day <= DATE '{CUT}' GROUP BY company_id")
def l10_panel_until(t: Treasury) -> DataFrame:
    return N.panel_until(_daily(t), CUT).groupBy("company_id").agg(F.count("*").alias("n_days"), F.max("day").alias("last_day"))


@query("""SELECT company_id, count(*) FILTER (value_date IS NULL) AS n_missing, count(*) FILTER (value_date < date) AS n_before, count(*) FILTER (value_date = date) AS n_same, count(*) FILTER (value_date - date BETWEEN 1 AND 2) AS n_normal, count(*) FILTER (value_date - date > 2) AS n_late,
    round(coalesce(sum(amount_eur) FILTER (date_trunc('month', value_date) <> date_trunc('month', date)), 0), 2) AS moved_eur, round(coalesce(sum(abs(amount_eur)), 0), 2) AS all_eur FROM tx GROUP BY company_id""")
def l12_value_dates(t: Treasury) -> DataFrame:
    return N.value_date_census(_tx(t)).withColumns({c: F.round(c, 2) for c in ("moved_eur", "all_eur")})


@query("""SELECT 'first_of_month' AS rule, count(*) FILTER (month <> date_trunc('month', month)) AS n_broken FROM cash_months UNION ALL SELECT 'finite', count(*) FILTER (NOT isfinite(net)) FROM cash_months UNION ALL SELECT 'breakdown', count(*) FILTER (abs(inflow - outflow - net) > 1e-6 + 1e-9 * abs(net)) FROM cash_months UNION ALL SELECT 'signs', count(*) FILTER (inflow < 0 OR outflow < 0) FROM cash_months""")
def l17_flow_contract(t: Treasury) -> DataFrame:
    return N.flow_contract(K.cash_flows(cash_queries._tx(t), "month"))


@query("SELECT count(*) AS n_companies, count(anchor) AS n_anchored, count(*) FILTER (abs(balance - anchor) > 1e-6) AS n_apart FROM daily_rows WHERE day = DATE '2001-08-01'")
def l14_anchor_identity(t: Treasury) -> DataFrame:
    return N.anchor_identity(_daily(t), cash_queries._anchor(t), ANCHOR_DAY)


@query("SELECT month, count(*) AS n_evaluable FROM scored WHERE score IS NOT NULL AND company_id NOT IN (SELECT company_id FROM zeros) GROUP BY month")
def l18_evaluable_population(t: Treasury) -> DataFrame:
    scored = score_queries._scored(t)
    return N.evaluable_population(scored, H.persistent_zeros(scored, LAST_MONTH))


@query("""SELECT m.month, count(*) FILTER (status_norm <> 'paid' OR payment_date > month_end) AS n_status_aware, count(*) FILTER (payment_date > month_end) AS n_literal FROM inv JOIN months m ON due_date <= month_end WHERE document_type = 'invoice' AND status_norm <> 'cancel' GROUP BY m.month""")
def p11_unpaid_criteria(t: Treasury) -> DataFrame:
    return N.unpaid_criteria(_inv(t), FIRST_MONTH, LAST_MONTH)


@query("""SELECT 'obligation_arrears' AS channels, round(corr(o, a), 4) AS pearson FROM points UNION ALL SELECT 'obligation_debt', round(corr(o, d), 4) FROM points UNION ALL SELECT 'arrears_debt', round(corr(a, d), 4) FROM points""")
def h08_channel_correlations(t: Treasury) -> DataFrame:
    return N.channel_correlations(H.shapley(score_queries._inputs(t))).withColumn("pearson", F.round("pearson", 4))


@query("SELECT company_id, count(*) AS n_movements, count(*) FILTER (direction = 'in') AS n_inflows, round(coalesce(sum(amount_eur) FILTER (direction = 'in'), 0), 2) AS inflow_eur FROM tx WHERE company_id IN (SELECT company_id FROM zeros) GROUP BY company_id")
def h10_excluded_activity(t: Treasury) -> DataFrame:
    return N.activity_of(_tx(t), H.persistent_zeros(score_queries._scored(t), LAST_MONTH)).withColumn("inflow_eur", F.round("inflow_eur", 2))


@query("""SELECT count(*) AS n, round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.9), 6) AS p90, count(*) FILTER (x > 0.1) AS n_over_tenth, count(*) FILTER (x > 0.5) AS n_over_half FROM (SELECT abs(arrears - lag(arrears) OVER (PARTITION BY company_id ORDER BY month)) AS x FROM arrears_rows) WHERE x IS NOT NULL""")
def h18_arrears_jumps(t: Treasury) -> DataFrame:
    rows = A.arrears_index(A.severity(_payables(t), FIRST_MONTH, LAST_MONTH))
    return N.jumps(rows, "arrears").withColumns({c: F.round(c, 6) for c in ("p50", "p90")})


@query("""SELECT o.month, h, count(*) AS n_origins, count(*) FILTER (s.score IS NOT NULL) AS n_pairs, count(*) FILTER (s.company_id IS NOT NULL AND s.score IS NULL) AS n_unscored, count(*) FILTER (s.company_id IS NULL) AS n_beyond FROM (SELECT * FROM scored WHERE score IS NOT NULL) o CROSS JOIN (VALUES (1), (2), (3)) v(h) LEFT JOIN scored s ON s.company_id = o.company_id AND s.month = CAST(o.month + to_months(h) AS DATE) GROUP BY o.month, h""")
def b02_pair_census(t: Treasury) -> DataFrame:
    return N.pair_census(score_queries._scored(t))


@query("""SELECT company_id, month, round(score, 4) AS score, CASE least(4, 1 + CASE WHEN nw < 6 THEN 1 ELSE 0 END + CASE WHEN arrears IS NULL THEN 1 ELSE 0 END + CASE WHEN balance IS NULL THEN 1 ELSE 0 END) WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'none' END AS confidence,
    CAST(date_diff('month', month, DATE '2001-07-01') AS INTEGER) AS age_months FROM scored WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY month DESC) = 1""")
def k03_latest_assessment(t: Treasury) -> DataFrame:
    return N.latest_assessment(H.health_score(score_queries._inputs(t)), LAST_MONTH).withColumn("score", F.round("score", 4))


@query(" UNION ALL ".join(f"SELECT {n} AS horizon_days, count(*) AS n, count(*) FILTER (available_at_{n}d > DATE '{CUT}') AS n_too_early FROM cohorts WHERE conversion_{n}d IS NOT NULL AND available_at_{n}d <= DATE '{CUT}'" for n in (30, 60, 90)))
def q06_too_early(t: Treasury) -> DataFrame:
    return N.too_early(O.cohort_features_at(coverage_queries._cohorts(t), CUT), CUT)
