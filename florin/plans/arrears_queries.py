"""Registered queries of arrears, obligations and exchange rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from florin.operators import arrears as A
from florin.operators import fx as X
from florin.operators import marts as M
from florin.plans.queries import STEPS, _inv, _perimeter, money, query
from florin.sources.treasury import FIRST_MONTH, LAST_MONTH, Treasury

STEPS["payables"] = """SELECT company_id, CASE WHEN amount > 0 THEN 'ar' ELSE 'ap' END AS side, issuance_date AS issued, due_date AS due, CASE WHEN status_norm = 'paid' THEN payment_date END AS paid, CASE WHEN NOT (currency <> accounting_currency AND exchange_rate = 1) THEN abs(amount_eur) END AS eur
    FROM inv WHERE document_type = 'invoice' AND status_norm <> 'cancel' AND amount <> 0"""
_BUCKET = "CASE WHEN d <= 30 THEN 0 WHEN d <= 60 THEN 1 WHEN d <= 90 THEN 2 WHEN d {edge} THEN 3 ELSE 4 END"
STEPS["at_cut"] = f"""SELECT *, {_BUCKET.format(edge='<= 180')} AS b2, {_BUCKET.format(edge='< 180')} AS b1 FROM (SELECT p.*, m.month, m.month_end, date_diff('day', due, month_end) AS d, paid IS NULL OR paid > month_end AS late FROM payables p JOIN months m ON p.due <= m.month_end)"""
_W = "(CASE b2 WHEN 0 THEN 0.10 WHEN 1 THEN 0.25 WHEN 2 THEN 0.45 WHEN 3 THEN 0.70 ELSE 1.00 END)::DOUBLE"
STEPS["severities"] = f"""SELECT *, CASE WHEN exposure > 0 THEN weighted / exposure END AS severity FROM (SELECT s.company_id, s.side, m.month, count(c.due) AS n_portfolio, count(c.due) FILTER (eur IS NULL) AS n_holes, coalesce(sum(eur), 0) AS exposure, coalesce(sum(eur) FILTER (late), 0) AS overdue, coalesce(sum({_W} * eur) FILTER (late), 0) AS weighted
    FROM (SELECT DISTINCT company_id, side FROM payables WHERE due <= DATE '2001-07-31') s CROSS JOIN months m LEFT JOIN at_cut c ON c.company_id = s.company_id AND c.side = s.side AND c.month = m.month GROUP BY s.company_id, s.side, m.month)"""
STEPS["drawn"] = """SELECT *, CASE WHEN severity IS NULL THEN NULL WHEN past IS NULL THEN severity ELSE (weighted + 4178.45 * past) / (exposure + 4178.45) END AS s FROM (SELECT *, sum(weighted) FILTER (severity IS NOT NULL) OVER w / sum(exposure) FILTER (severity IS NOT NULL) OVER w AS past
    FROM severities WINDOW w AS (PARTITION BY company_id, side ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
STEPS["robust"] = """SELECT company_id, side, month, CASE WHEN s IS NOT NULL THEN list_reduce(values_so_far, lambda a, x: 0.35 * x + 0.65 * a) END AS r FROM (SELECT *, list(s) FILTER (s IS NOT NULL) OVER (PARTITION BY company_id, side ORDER BY month) AS values_so_far FROM drawn)"""
STEPS["overdue_ap"] = """SELECT company_id, month, count(*) AS n_overdue, count(*) FILTER (eur IS NULL) AS n_unknown, sum(eur) AS overdue_eur, coalesce(sum((CASE b1 WHEN 0 THEN 1.0 WHEN 1 THEN 1.5 WHEN 2 THEN 2.0 WHEN 3 THEN 3.0 ELSE 5.0 END)::DOUBLE * eur), 0) AS weighted FROM at_cut WHERE side = 'ap' AND late GROUP BY ALL"""
STEPS["debt_months"] = """SELECT f.company_id, f.month, CASE WHEN act AND n_pay_hole = 0 AND n_ambiguous_out = 0 THEN pay END AS payments_eur, CASE WHEN act AND d.n_hole = 0 AND d.n_other = 0 AND f.n_ambiguous_out = 0 THEN d.service END AS service_eur FROM flow_panel f
    LEFT JOIN (SELECT company_id, month, coalesce(sum(abs(amount_eur)) FILTER (svc), 0) AS service, count(*) FILTER (svc AND amount_eur IS NULL) AS n_hole, count(*) FILTER (NOT svc) AS n_other FROM (SELECT *, rule_id IN ('cat:debt_repayment', 'transf:debt_repayment', 'cat:interest_charge', 'transf:interest_charge') AS svc
        FROM perimeter WHERE is_cash AND flow_class = 'financing_out') GROUP BY ALL) d0 USING (company_id, month) LEFT JOIN (SELECT company_id, month, coalesce(sum(abs(amount_eur)) FILTER (flow_class = 'financing_out' AND svc), 0) AS service, count(*) FILTER (flow_class = 'financing_out' AND svc AND amount_eur IS NULL) AS n_hole,
        count(*) FILTER (flow_class = 'financing_out' AND NOT svc) AS n_other FROM (SELECT *, rule_id IN ('cat:debt_repayment', 'transf:debt_repayment', 'cat:interest_charge', 'transf:interest_charge') AS svc FROM perimeter WHERE is_cash) GROUP BY ALL) d USING (company_id, month)"""
STEPS["service"] = """SELECT *, CASE WHEN n >= 3 THEN med END AS expected FROM (SELECT *, median(CASE WHEN service_eur > 0 THEN service_eur END) OVER w AS med, count(CASE WHEN service_eur > 0 THEN 1 END) OVER w AS n FROM debt_months WINDOW w AS (PARTITION BY company_id ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
STEPS["normal"] = """SELECT *, CASE WHEN known6 > 0 AND paid6 > 0 THEN paid6 WHEN expected > 0 THEN expected * 6 WHEN known6 > 0 THEN 0.0 END AS t6 FROM (SELECT *, sum(coalesce(payments_eur, 0) + coalesce(service_eur, 0)) OVER w AS paid6, count(coalesce(payments_eur, service_eur)) OVER w AS known6 FROM service WINDOW w AS (PARTITION BY company_id ORDER BY month ROWS 5 PRECEDING))"""
STEPS["returns"] = "SELECT currency, day, CAST(date_trunc('month', day) AS DATE) AS month, ln(rate / before) AS log_return FROM (SELECT *, lag(rate) OVER (PARTITION BY currency ORDER BY day) AS before FROM fx_daily) WHERE before > 0"
STEPS["volatility"] = "SELECT currency, month, count(*) AS n_returns, CASE WHEN count(*) >= 10 THEN (quantile_cont(log_return, 0.75) - quantile_cont(log_return, 0.25)) / 1.349 * sqrt(252) END AS volatility FROM returns GROUP BY ALL"
STEPS["ends"] = "SELECT currency, CAST(date_trunc('month', day) AS DATE) AS month, max_by(rate, day) AS rate FROM fx_daily GROUP BY ALL"
STEPS["drifts"] = "SELECT e.currency, e.month, s.rate / e.rate - 1 AS drift FROM ends e LEFT JOIN ends s ON s.currency = e.currency AND s.month = e.month - INTERVAL 12 MONTH"


def _payables(t: Treasury) -> DataFrame:
    return A.payables(_inv(t))


def _service(t: Treasury) -> tuple[DataFrame, DataFrame]:
    panel = M.flow_and_debt_panel(M.company_months(t.companies, FIRST_MONTH, LAST_MONTH), _perimeter(t)).select("company_id", "month", "payments_eur", "service_eur").persist()
    return panel, A.expected_service(panel)


@query("SELECT company_id, side, month, n_portfolio, n_holes, round(exposure, 2) AS exposure, round(overdue, 2) AS overdue, round(weighted, 4) AS weighted, round(severity, 6) AS severity FROM severities")
def p03_severity(t: Treasury) -> DataFrame:
    out = A.severity(_payables(t), FIRST_MONTH, LAST_MONTH)
    return out.select("company_id", "side", "month", "n_portfolio", "n_holes", *money("exposure", "overdue"), F.round("weighted", 4).alias("weighted"), F.round("severity", 6).alias("severity"))


@query("""SELECT company_id, month, round(ap, 6) AS ap, round(ar, 6) AS ar, round(coalesce(0.7 * ap + 0.3 * ar, ap, ar), 6) AS arrears FROM (SELECT company_id, month, max(r) FILTER (side = 'ap') AS ap, max(r) FILTER (side = 'ar') AS ar FROM robust GROUP BY ALL)""")
def p05_arrears_index(t: Treasury) -> DataFrame:
    out = A.arrears_index(A.severity(_payables(t), FIRST_MONTH, LAST_MONTH))
    return out.select("company_id", "month", *(F.round(c, 6).alias(c) for c in ("ap", "ar", "arrears")))


@query("SELECT company_id, month, n_overdue, n_unknown, round(overdue_eur, 2) AS overdue_eur FROM overdue_ap")
def p07_overdue_obligation(t: Treasury) -> DataFrame:
    return A.overdue_obligation(_payables(t), FIRST_MONTH, LAST_MONTH).select("company_id", "month", "n_overdue", "n_unknown", *money("overdue_eur"))


@query("SELECT company_id, month, round(service_eur, 2) AS service_eur, round(expected, 4) AS expected, CASE WHEN expected IS NOT NULL AND service_eur IS NOT NULL THEN round(greatest(0, expected - service_eur), 4) END AS shortfall FROM service")
def p08_expected_service(t: Treasury) -> DataFrame:
    return _service(t)[1].select("company_id", "month", *money("service_eur"), *(F.round(c, 4).alias(c) for c in ("expected", "shortfall")))


@query("""SELECT n.company_id, n.month, CAST(coalesce(o.n_overdue, 0) AS BIGINT) AS n_overdue, round(t6, 2) AS t6, round(CASE WHEN coalesce(o.n_overdue, 0) = 0 OR overdue_eur = 0 THEN 1.0 WHEN overdue_eur IS NULL OR t6 IS NULL THEN NULL WHEN weighted <= 0 THEN 1.0 WHEN t6 <= 0 THEN 0.5 ELSE greatest(0.5, 1.0 - weighted / t6) END, 6) AS multiplier
    FROM normal n LEFT JOIN overdue_ap o USING (company_id, month)""")
def p09_obligation_multiplier(t: Treasury) -> DataFrame:
    flows, service = _service(t)
    out = A.obligation_multiplier(A.overdue_obligation(_payables(t), FIRST_MONTH, LAST_MONTH), flows, service)
    return out.select("company_id", "month", F.col("n_overdue").cast("long").alias("n_overdue"), *money("t6"), F.round("multiplier", 6).alias("multiplier"))


@query("""SELECT company_id, side, month_end AS cut, count(*) AS n_live, round(sum(eur), 2) AS live_eur FROM payables JOIN months ON issued <= month_end AND (paid IS NULL OR paid > month_end) GROUP BY ALL""")
def p12_live_invoices(t: Treasury) -> DataFrame:
    rows = A.payables(_inv(t).withColumn("due_date_ok", F.col("issuance_date_ok")))  # live from the day of issue, whether due or not
    live = A.live_invoices(rows, "due", FIRST_MONTH, LAST_MONTH)
    return live.groupBy("company_id", "side", "cut").agg(F.count("*").alias("n_live"), F.round(F.sum("eur"), 2).alias("live_eur"))


@query("""SELECT m.month_end AS cut, side, company_id, n AS n_paid, CASE WHEN n >= 10 THEN own ELSE everyone END AS expected_delay FROM (SELECT month_end, side, company_id, count(*) AS n, median(date_diff('day', due, paid)) AS own FROM payables JOIN months ON paid <= month_end GROUP BY ALL) m
    JOIN (SELECT month_end, side, median(date_diff('day', due, paid)) AS everyone FROM payables JOIN months ON paid <= month_end GROUP BY ALL) s USING (month_end, side)""")
def p13_expected_delay(t: Treasury) -> DataFrame:
    return A.delay_profile(_payables(t), FIRST_MONTH, LAST_MONTH).drop("side_delay")


@query("SELECT currency, day, month, round(log_return, 8) AS log_return FROM returns")
def r01_log_returns(t: Treasury) -> DataFrame:
    return X.log_returns(t.fx_daily).withColumn("log_return", F.round("log_return", 8))


@query("SELECT currency, month, n_returns, round(volatility, 6) AS volatility FROM volatility")
def r02_volatility(t: Treasury) -> DataFrame:
    return X.monthly_volatility(X.log_returns(t.fx_daily)).withColumn("volatility", F.round("volatility", 6))


@query("SELECT currency, month, round(drift, 6) AS drift FROM drifts")
def r03_sustained_drift(t: Treasury) -> DataFrame:
    return X.sustained_drift(t.fx_daily).withColumn("drift", F.round("drift", 6))


@query("""SELECT currency, month, vt AS volatility_tier, dt AS drift_tier, CASE WHEN vt IS NULL OR 'hyper' IN (vt, coalesce(dt, '')) THEN 'hyper' WHEN 'volatile' IN (vt, coalesce(dt, '')) THEN 'volatile' ELSE 'stable' END AS tier FROM (SELECT currency, month, CASE WHEN volatility IS NULL THEN NULL WHEN volatility < 0.025 THEN 'stable' WHEN volatility < 0.1 THEN 'volatile' ELSE 'hyper' END AS vt,
    CASE WHEN drift IS NULL THEN NULL WHEN -drift < 0.025 THEN 'stable' WHEN -drift < 0.06 THEN 'volatile' ELSE 'hyper' END AS dt FROM volatility FULL JOIN drifts USING (currency, month))""")
def r04_fx_index(t: Treasury) -> DataFrame:
    return X.fx_index(t.fx_daily).select("currency", "month", "volatility_tier", "drift_tier", "tier")


@query("""SELECT operation_id, q.day AS rate_day, round(q.rate, 6) AS rate FROM (SELECT operation_id, currency, issuance_date FROM inv WHERE currency IN ('USD', 'GBP')) i LEFT JOIN LATERAL (SELECT f.day, f.rate FROM fx_daily f WHERE f.currency = i.currency AND f.day <= i.issuance_date ORDER BY f.day DESC LIMIT 1) q ON true""")
def r09_rate_on_or_before(t: Treasury) -> DataFrame:
    foreign = _inv(t).where(F.col("currency").isin("USD", "GBP")).select("operation_id", "currency", "issuance_date_ok")
    return X.rate_on_or_before(foreign, t.fx_daily, "issuance_date_ok").select("operation_id", "rate_day", F.round("rate", 6).alias("rate"))
