"""Registered queries of the health score and its evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from florin.operators import arrears as A
from florin.operators import cash as K
from florin.operators import marts as M
from florin.operators import scoring as H
from florin.plans import arrears_queries, cash_queries
from florin.plans.queries import STEPS, _perimeter, query
from florin.sources.treasury import FIRST_MONTH, LAST_MONTH, Treasury

STEPS["score_in"] = """SELECT f.company_id, f.month, f.act, CASE WHEN act THEN f.rec END AS c, CASE WHEN act THEN f.pay END AS p, CASE WHEN act THEN coalesce(d.service, 0) END AS d, CASE WHEN s.expected IS NOT NULL AND s.service_eur IS NOT NULL THEN greatest(0, s.expected - s.service_eur) END AS short,
    CASE WHEN coalesce(o.n_overdue, 0) = 0 THEN 0.0 ELSE o.overdue_eur END AS stock, CASE WHEN coalesce(o.n_overdue, 0) = 0 OR o.overdue_eur = 0 THEN 1.0 WHEN o.overdue_eur IS NULL OR n.t6 IS NULL THEN NULL WHEN o.weighted <= 0 THEN 1.0 WHEN n.t6 <= 0 THEN 0.5 ELSE greatest(0.5, 1.0 - o.weighted / n.t6) END AS multiplier,
    coalesce(0.7 * a.ap + 0.3 * a.ar, a.ap, a.ar) AS arrears, b.balance FROM flow_panel f
    LEFT JOIN (SELECT company_id, month, sum(abs(amount_eur)) AS service FROM perimeter WHERE is_cash AND flow_class = 'financing_out' AND rule_id IN ('cat:debt_repayment', 'transf:debt_repayment', 'cat:interest_charge', 'transf:interest_charge') GROUP BY ALL) d USING (company_id, month)
    JOIN service s USING (company_id, month) JOIN normal n USING (company_id, month) LEFT JOIN overdue_ap o USING (company_id, month) LEFT JOIN (SELECT company_id, month, max(r) FILTER (side = 'ap') AS ap, max(r) FILTER (side = 'ar') AS ar FROM robust GROUP BY ALL) a USING (company_id, month) LEFT JOIN back_rows b USING (company_id, month)"""
STEPS["score_sums"] = """SELECT *, p6 + d6 + s6 + coalesce(stock, 0) AS t6, CASE WHEN ch + ph + dh + sh + coalesce(stock, 0) > 0 THEN ch / (ch + ph + dh + sh + coalesce(stock, 0)) END AS r_hist, greatest(0, coalesce(balance, 0)) AS cash FROM (SELECT *, coalesce(sum(c) OVER w, 0) AS c6, coalesce(sum(p) OVER w, 0) AS p6, coalesce(sum(d) OVER w, 0) AS d6, coalesce(sum(short) OVER w, 0) AS s6,
    coalesce(sum(c) OVER e, 0) AS ch, coalesce(sum(p) OVER e, 0) AS ph, coalesce(sum(d) OVER e, 0) AS dh, coalesce(sum(short) OVER e, 0) AS sh, bool_or(act) OVER e AS any_act, count(*) OVER w AS nw FROM score_in WINDOW w AS (PARTITION BY company_id ORDER BY month ROWS 5 PRECEDING), e AS (PARTITION BY company_id ORDER BY month ROWS UNBOUNDED PRECEDING))"""
_BEFORE = """CASE WHEN any_act AND NOT (c6 = 0 AND t6 = 0) AND (p6 > 0 OR coalesce(stock, 0) > 0) THEN 100.0 * (c6 + least(cash, {a} * t6) + coalesce({k} * r_hist, 0)) / (c6 + least(cash, {a} * t6) + t6 + CASE WHEN r_hist IS NULL THEN 0 ELSE {k} END) END"""
STEPS["scored"] = f"""SELECT *, least(100, greatest(0, before * coalesce(1 - 0.25 * arrears, 1) * coalesce(multiplier, 1))) AS score FROM (SELECT *, {_BEFORE.format(k='4178.45', a='3.0')} AS before FROM score_sums)"""


def _inputs(t: Treasury) -> DataFrame:
    panel = M.flow_and_debt_panel(M.company_months(t.companies, FIRST_MONTH, LAST_MONTH), _perimeter(t), *K.anchored_sums())
    return H.score_inputs(panel, A.arrears_panel(arrears_queries._payables(t), FIRST_MONTH, LAST_MONTH), cash_queries._anchor(t))


def _scored(t: Treasury) -> DataFrame:
    """What the queries read of the score, kept for those that read it more than once."""
    return H.health_score(_inputs(t)).select("company_id", "month", "before", "score", "unscored_reason", "confidence").persist()


def _scored_once(t: Treasury) -> DataFrame:
    """Companies' scores, for what keeps no more of them than it reads again."""
    return H.health_score(_inputs(t)).select("company_id", "month", "score")


def rounded(*names: str, digits: int = 4):
    return [F.round(n, digits).alias(n) for n in names]


@query("""SELECT company_id, month, round(before, 4) AS before, round(score, 4) AS score, CASE WHEN NOT any_act THEN 'no_cash_activity' WHEN c6 = 0 AND t6 = 0 THEN 'no_flows_in_window' WHEN before IS NULL THEN 'no_demonstrated_payments' END AS unscored_reason,
    CASE least(4, 1 + CASE WHEN nw < 6 THEN 1 ELSE 0 END + CASE WHEN arrears IS NULL THEN 1 ELSE 0 END + CASE WHEN balance IS NULL THEN 1 ELSE 0 END) WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'none' END AS confidence FROM scored""")
def h03_health_score(t: Treasury) -> DataFrame:
    return H.health_score(_inputs(t)).select("company_id", "month", *rounded("before", "score"), "unscored_reason", "confidence")


STEPS["channels"] = f"""SELECT o.company_id, o.month, o.before AS owing, p.before AS plain, coalesce(1 - 0.25 * o.arrears, 1) AS fa, coalesce(o.multiplier, 1) AS fd FROM scored o JOIN (SELECT company_id, month, {_BEFORE.format(k='4178.45', a='3.0')} AS before FROM (SELECT * EXCLUDE (t6, r_hist, stock), NULL::DOUBLE AS stock, p6 + d6 + s6 AS t6, CASE WHEN ch + ph + dh + sh > 0 THEN ch / (ch + ph + dh + sh) END AS r_hist FROM score_sums)) p USING (company_id, month)
    WHERE o.before IS NOT NULL AND p.before IS NOT NULL"""


@query("""SELECT company_id, month, round(v000, 4) AS free_score, round(v111, 4) AS score, round(greatest(0, (v000 - v100) / 3 + (v010 - v110) / 6 + (v001 - v101) / 6 + (v011 - v111) / 3), 4) AS obligation_points, round(greatest(0, (v000 - v010) / 3 + (v100 - v110) / 6 + (v001 - v011) / 6 + (v101 - v111) / 3), 4) AS arrears_points, round(greatest(0, (v000 - v001) / 3 + (v100 - v101) / 6 + (v010 - v011) / 6 + (v110 - v111) / 3), 4) AS debt_points
    FROM (SELECT company_id, month, least(100, greatest(0, plain)) AS v000, least(100, greatest(0, owing)) AS v100, least(100, greatest(0, plain * fa)) AS v010, least(100, greatest(0, plain * fd)) AS v001, least(100, greatest(0, owing * fa)) AS v110, least(100, greatest(0, owing * fd)) AS v101, least(100, greatest(0, plain * fa * fd)) AS v011, least(100, greatest(0, owing * fa * fd)) AS v111 FROM channels)""")
def h07_shapley(t: Treasury) -> DataFrame:
    return H.shapley(_inputs(t)).select("company_id", "month", *rounded("free_score", "score", "obligation_points", "arrears_points", "debt_points"))


STEPS["zeros"] = """SELECT *, CASE WHEN a AND b THEN 'A and B' WHEN a THEN 'A' ELSE 'B' END AS criterion FROM (SELECT *, n_scored > 0 AND n_zero >= 0.95 * n_scored AS a, coalesce(reference_score = 0, false) AS b FROM (SELECT company_id, count(score) AS n_scored, count(*) FILTER (score < 1) AS n_zero, max(CASE WHEN month = DATE '2001-07-01' THEN score END) AS reference_score FROM scored GROUP BY company_id)) WHERE a OR b"""


@query("SELECT company_id, criterion, n_scored, n_zero, round(reference_score, 4) AS reference_score FROM zeros")
def h09_persistent_zeros(t: Treasury) -> DataFrame:
    return H.persistent_zeros(H.health_score(_inputs(t)), LAST_MONTH).withColumn("reference_score", F.round("reference_score", 4))


@query("""SELECT month, CASE WHEN z.company_id IS NOT NULL THEN 'excluded' WHEN score IS NOT NULL THEN 'scored' WHEN NOT any_act THEN 'no_cash_activity' WHEN c6 = 0 AND t6 = 0 THEN 'no_flows_in_window' ELSE 'no_demonstrated_payments' END AS state,
    CASE least(4, 1 + CASE WHEN nw < 6 THEN 1 ELSE 0 END + CASE WHEN arrears IS NULL THEN 1 ELSE 0 END + CASE WHEN balance IS NULL THEN 1 ELSE 0 END) WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'none' END AS confidence, count(*) AS n FROM scored s LEFT JOIN zeros z USING (company_id) GROUP BY ALL""")
def h20_cut_summary(t: Treasury) -> DataFrame:
    scored = _scored(t)
    return H.cut_summary(scored, H.persistent_zeros(scored, LAST_MONTH))


@query(f"""SELECT k, alpha, count(*) AS n, round(avg(s), 4) AS mean, round(stddev_pop(s), 4) AS std, round(avg(CASE WHEN s BETWEEN 45 AND 55 THEN 1.0 ELSE 0.0 END), 6) AS share_45_55 FROM (SELECT k, alpha, {_BEFORE.format(k='k', a='alpha')} AS s FROM score_sums CROSS JOIN (VALUES (500.0::DOUBLE), (4178.45), (20000.0)) x(k) CROSS JOIN (VALUES (1.0::DOUBLE), (3.0)) y(alpha)) WHERE s IS NOT NULL GROUP BY k, alpha""")
def h11_parameter_sweep(t: Treasury) -> DataFrame:
    return H.parameter_sweep(_inputs(t), (500.0, 4178.45, 20000.0), (1.0, 3.0)).select("k", "alpha", "n", *rounded("mean", "std"), *rounded("share_45_55", digits=6))


@query("""SELECT count(*) AS n_pairs, round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.75), 6) AS p75, round(quantile_cont(x, 0.9), 6) AS p90 FROM (SELECT abs(score - lag(score) OVER (PARTITION BY company_id ORDER BY month)) AS x FROM scored) WHERE x IS NOT NULL""")
def h12_stability(t: Treasury) -> DataFrame:
    return H.stability(_scored(t))


@query("""SELECT month, count(*) AS n, round(stddev_pop(score), 4) AS std, round(median(score), 4) AS median, round(quantile_cont(score, 0.75) - quantile_cont(score, 0.25), 4) AS iqr, round(avg(CASE WHEN score BETWEEN 45 AND 55 THEN 1.0 ELSE 0.0 END), 6) AS share_45_55 FROM scored WHERE score IS NOT NULL GROUP BY month""")
def h13_dispersion(t: Treasury) -> DataFrame:
    return H.dispersion(_scored(t)).select("month", "n", *rounded("std", "median", "iqr"), *rounded("share_45_55", digits=6))


STEPS["forecasts"] = """SELECT company_id, month, unnest(['persistence', 'mean3', 'median']) AS baseline, unnest([score, mean3, med]) AS value FROM (SELECT company_id, month, score, avg(score) OVER (PARTITION BY company_id ORDER BY month ROWS 2 PRECEDING) AS mean3, median(score) OVER (PARTITION BY month) AS med FROM scored WHERE score IS NOT NULL)"""


@query("SELECT company_id, month, baseline, round(value, 4) AS value FROM forecasts")
def b03_baselines(t: Treasury) -> DataFrame:
    return H.baseline_predictions(_scored_once(t)).withColumn("value", F.round("value", 4))


@query("""SELECT baseline, h, count(y) AS n, count(*) - count(y) AS n_without_target, round(avg(abs(v - y)), 4) AS mae, round(sqrt(avg((v - y) * (v - y))), 4) AS rmse, round(avg(v - y), 4) AS bias, round(quantile_cont(abs(v - y), 0.5), 4) AS p50, round(quantile_cont(abs(v - y), 0.75), 4) AS p75, round(quantile_cont(abs(v - y), 0.9), 4) AS p90
    FROM (SELECT o.baseline, x.h, o.value AS v, s.score AS y FROM forecasts o CROSS JOIN (VALUES (1), (2), (3)) x(h) LEFT JOIN (SELECT company_id, month, score FROM scored WHERE score IS NOT NULL) s ON s.company_id = o.company_id AND s.month = CAST(o.month + to_months(x.h) AS DATE)) GROUP BY baseline, h""")
def b04_baseline_errors(t: Treasury) -> DataFrame:
    return H.baseline_errors(_scored_once(t)).select("baseline", "h", "n", "n_without_target", *rounded("mae", "rmse", "bias", "p50", "p75", "p90"))


@query("""SELECT h, count(*) AS n, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 4) AS spearman, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 4) AS intercept FROM (SELECT h, x, y, rank() OVER (PARTITION BY h ORDER BY x) + (count(*) OVER (PARTITION BY h, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY h ORDER BY y) + (count(*) OVER (PARTITION BY h, y) - 1) / 2 AS ry
    FROM (SELECT h, a.score AS x, b.score AS y FROM (SELECT * FROM scored WHERE score IS NOT NULL) a CROSS JOIN (VALUES (1), (2), (3)) v(h) JOIN (SELECT * FROM scored WHERE score IS NOT NULL) b ON b.company_id = a.company_id AND b.month = CAST(a.month + to_months(h) AS DATE))) GROUP BY h""")
def b05_autocorrelation(t: Treasury) -> DataFrame:
    return H.autocorrelation(_scored_once(t)).select("h", "n", *rounded("pearson", "slope", digits=6), *rounded("spearman"), *rounded("intercept"))
