"""Registered queries of the cash layers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from florin.functions.core import joined
from florin.operators import cash as K
from florin.operators import cleaning as C
from florin.plans.queries import STEPS, money, query
from florin.plans.queries import _tx as _all_tx
from florin.sources.treasury import ANCHOR_DAY, FIRST_MONTH, LAST_MONTH, Treasury

_FLOWS = """SELECT company_id, {by}, coalesce(sum(amount_eur), 0) AS net, coalesce(sum(amount_eur) FILTER (amount_eur > 0), 0) AS inflow, coalesce(sum(-amount_eur) FILTER (amount_eur < 0), 0) AS outflow, coalesce(sum(abs(amount_eur)), 0) AS known_volume,
    coalesce(sum(abs(amount)) FILTER (amount_eur IS NULL), 0) AS hole_volume, count(*) AS n_movements FROM tx WHERE is_booked AND month BETWEEN DATE '1999-08-01' AND DATE '2001-07-01' AND product_source = 'banking' AND product_type IN ({types}) GROUP BY company_id, {by}"""
_CASH, _ANCHORED = "'checking', 'saving', 'wallet'", "'checking', 'saving', 'wallet', 'tpv'"
STEPS["cash_months"] = _FLOWS.format(by="month", types=_CASH)
STEPS["anchored_months"] = _FLOWS.format(by="month", types=_ANCHORED)
STEPS["anchored_days"] = _FLOWS.format(by="date_ok", types=_ANCHORED)
STEPS["cash_months_closed"] = "SELECT * FROM cash_months"
STEPS["forward"] = """SELECT *, min(position) OVER (PARTITION BY company_id ORDER BY month) AS lowest FROM (SELECT g.company_id, g.month, coalesce(net, 0) AS net, sum(coalesce(net, 0)) OVER w AS position, sum(coalesce(hole_volume, 0)) OVER w AS holes, sum(coalesce(known_volume, 0)) OVER w AS known,
    avg(coalesce(outflow, 0)) OVER (PARTITION BY g.company_id ORDER BY g.month ROWS 5 PRECEDING) AS mean_out, count(*) OVER w AS n_months, count(n_movements) OVER w AS n_active_months
    FROM (SELECT company_id, CAST(unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS DATE) AS month FROM (SELECT company_id, min(month) AS a, max(month) AS b FROM cash_months GROUP BY company_id)) g LEFT JOIN cash_months USING (company_id, month) WINDOW w AS (PARTITION BY g.company_id ORDER BY g.month ROWS UNBOUNDED PRECEDING))"""
STEPS["anchor_of"] = """SELECT company_id, CASE WHEN count(*) FILTER (balance = -999999999.0) = 0 THEN sum(balance) END AS anchor FROM balances JOIN banking_products USING (product_id, company_id) WHERE currency = 'EUR' GROUP BY company_id"""
_BACK = """SELECT *, CASE WHEN later_holes = 0 THEN anchor - later_net END AS balance FROM (SELECT *, coalesce(sum(net) OVER l, 0) AS later_net, coalesce(sum(hole_volume) OVER l, 0) AS later_holes, coalesce(sum(known_volume) OVER l, 0) AS later_known FROM ({rows}) WINDOW l AS (PARTITION BY company_id ORDER BY {key} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))"""
_FILL = "coalesce(net, 0) AS net, coalesce(outflow, 0) AS outflow, coalesce(known_volume, 0) AS known_volume, coalesce(hole_volume, 0) AS hole_volume, anchor"
STEPS["back_rows"] = _BACK.format(key="month", rows=f"""SELECT *, avg(outflow) OVER (PARTITION BY company_id ORDER BY month ROWS 5 PRECEDING) AS mean_out FROM (SELECT c.company_id, CAST(m AS DATE) AS month, {_FILL} FROM companies c
    CROSS JOIN generate_series(DATE '1999-08-01', DATE '2001-08-01', INTERVAL 1 MONTH) g(m) LEFT JOIN anchored_months a ON a.company_id = c.company_id AND a.month = CAST(m AS DATE) LEFT JOIN anchor_of o ON o.company_id = c.company_id)""")
STEPS["daily_rows"] = _BACK.format(key="day", rows=f"""SELECT *, sum(outflow) OVER (PARTITION BY company_id ORDER BY day RANGE BETWEEN INTERVAL 179 DAY PRECEDING AND CURRENT ROW) / greatest(1.0, least(6.0, (date_diff('day', first, day) + 1) / 30.0)) AS mean_out FROM (SELECT g.company_id, g.first, g.day, {_FILL}
    FROM (SELECT DISTINCT company_id, a AS first, CAST(unnest(list_append(generate_series(a, b, INTERVAL 1 DAY), TIMESTAMP '2001-08-01')) AS DATE) AS day FROM (SELECT company_id, min(date_ok) AS a, max(date_ok) AS b FROM anchored_days GROUP BY company_id)) g
    LEFT JOIN anchored_days d ON d.company_id = g.company_id AND d.date_ok = g.day LEFT JOIN anchor_of o ON o.company_id = g.company_id)""")


def _back(key: str, rows: str) -> str:
    return f"""SELECT company_id, {key}, round(net, 2) AS net, round(balance, 2) AS balance, round(balance - lowest, 2) AS cushion, CASE WHEN mean_out > 0 THEN round(mean_out, 4) END AS mean_monthly_out, CASE WHEN anchor IS NULL THEN 'none' WHEN part = 0 THEN 'high' WHEN part <= 0.25 THEN 'medium' WHEN part <= 0.5 THEN 'low' ELSE 'none' END AS confidence,
        CASE WHEN anchor IS NULL THEN 'no_anchor' WHEN later_holes > 0 THEN 'holes_in_span' WHEN mean_out <= 0 THEN 'no_known_outflow' END AS reason
        FROM (SELECT *, min(balance) OVER (PARTITION BY company_id ORDER BY {key}) AS lowest, CASE WHEN later_known + later_holes > 0 THEN later_holes / (later_known + later_holes) ELSE 0 END AS part FROM {rows})"""


def _tx(t: Treasury) -> DataFrame:
    """Movements of the closed calendar."""
    return _all_tx(t).where(F.col("month").between(F.lit(FIRST_MONTH).cast("date"), F.lit(LAST_MONTH).cast("date")))


def _anchor(t: Treasury) -> DataFrame:
    return K.anchors(C.clean_balances(t.balances, t.banking_products, t.debt_products))


@query("SELECT company_id, month, round(net, 2) AS net, round(inflow, 2) AS inflow, round(outflow, 2) AS outflow, round(known_volume, 2) AS known_volume, round(hole_volume, 2) AS hole_volume, n_movements FROM cash_months")
def l01_monthly_cash_flows(t: Treasury) -> DataFrame:
    return K.cash_flows(_tx(t), "month").select("company_id", "month", *money("net", "inflow", "outflow", "known_volume", "hole_volume"), "n_movements")


@query("""SELECT company_id, month, round(net, 2) AS net, round(position, 2) AS position, round(position - holes, 2) AS position_min, round(position + holes, 2) AS position_max, round(position - lowest, 2) AS cushion, CASE WHEN mean_out > 0 THEN round(mean_out, 4) END AS mean_monthly_out, CASE WHEN mean_out > 0 THEN round((position - lowest) / mean_out, 4) END AS months_of_cover,
    CASE WHEN known + holes <= 0 THEN 'none' WHEN holes / (known + holes) <= 0.05 THEN 'high' WHEN holes / (known + holes) <= 0.25 THEN 'medium' WHEN holes / (known + holes) <= 0.5 THEN 'low' ELSE 'none' END AS confidence, n_months, n_active_months,
    concat_ws(',', CASE WHEN holes > 0 THEN 'holes_in_span' END, CASE WHEN position < 0 THEN 'negative_position' END, CASE WHEN mean_out <= 0 THEN 'no_known_outflow' END) AS flags FROM forward""")
def l02_forward_position(t: Treasury) -> DataFrame:
    out = K.forward_position(K.cash_flows(_tx(t), "month"))
    return out.select("company_id", "month", *money("net", "position", "position_min", "position_max", "cushion"), F.round("mean_monthly_out", 4).alias("mean_monthly_out"), F.round("months_of_cover", 4).alias("months_of_cover"), "confidence", "n_months", "n_active_months", joined(F.col("flags")).alias("flags"))


@query("SELECT company_id, round(anchor, 2) AS anchor FROM anchor_of")
def l03_anchors(t: Treasury) -> DataFrame:
    return _anchor(t).select("company_id", *money("anchor"))


@query(_back("month", "back_rows"))
def l04_backward_balance(t: Treasury) -> DataFrame:
    out = K.backward_balance(K.cash_flows(_tx(t), "month", K.ANCHORED), _anchor(t), t.companies, FIRST_MONTH, ANCHOR_DAY)
    return out.select("company_id", "month", *money("net", "balance", "cushion"), F.round("mean_monthly_out", 4).alias("mean_monthly_out"), "confidence", "reason")


@query("SELECT company_id, date_ok AS day, round(net, 2) AS net, round(inflow, 2) AS inflow, round(outflow, 2) AS outflow, round(hole_volume, 2) AS hole_volume, n_movements FROM anchored_days")
def l08_daily_flows(t: Treasury) -> DataFrame:
    return K.cash_flows(_tx(t), "date_ok", K.ANCHORED).select("company_id", F.col("date_ok").alias("day"), *money("net", "inflow", "outflow", "hole_volume"), "n_movements")


@query(_back("day", "daily_rows").replace("CASE WHEN mean_out > 0 THEN round(mean_out, 4) END AS mean_monthly_out, ", ""))
def l09_daily_panel(t: Treasury) -> DataFrame:
    out = K.daily_panel(K.cash_flows(_tx(t), "date_ok", K.ANCHORED), _anchor(t), ANCHOR_DAY)
    return out.select("company_id", "day", *money("net", "balance", "cushion"), "confidence", "reason")


@query("""SELECT company_id, count(*) AS n_active_days, max(a) AS most_in_30, max(b) AS most_in_60, max(c) AS most_in_90, CAST(coalesce(max(gap), 0) AS INTEGER) AS longest_gap, CAST(date_diff('day', max(date_ok), DATE '2001-08-01') AS INTEGER) AS days_since_last FROM (SELECT company_id, date_ok,
    count(*) OVER (PARTITION BY company_id ORDER BY date_ok RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW) AS a, count(*) OVER (PARTITION BY company_id ORDER BY date_ok RANGE BETWEEN INTERVAL 59 DAY PRECEDING AND CURRENT ROW) AS b,
    count(*) OVER (PARTITION BY company_id ORDER BY date_ok RANGE BETWEEN INTERVAL 89 DAY PRECEDING AND CURRENT ROW) AS c, date_diff('day', lag(date_ok) OVER (PARTITION BY company_id ORDER BY date_ok), date_ok) - 1 AS gap FROM anchored_days) GROUP BY company_id""")
def l11_density_census(t: Treasury) -> DataFrame:
    return K.density_census(K.cash_flows(_tx(t), "date_ok", K.ANCHORED), ANCHOR_DAY)


@query("SELECT count(*) AS n_months, round(max(abs(coalesce(m.net, 0) - coalesce(d.net, 0))), 4) AS max_difference FROM anchored_months m FULL JOIN (SELECT company_id, CAST(date_trunc('month', date_ok) AS DATE) AS month, sum(net) AS net FROM anchored_days GROUP BY ALL) d USING (company_id, month)")
def l13_daily_monthly_difference(t: Treasury) -> DataFrame:
    tx = _tx(t)
    return K.daily_monthly_difference(K.cash_flows(tx, "date_ok", K.ANCHORED), K.cash_flows(tx, "month", K.ANCHORED)).withColumn("max_difference", F.round("max_difference", 4))
