"""Registered queries of observability, masked totals, matured labels, calendars, exposure and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from florin.functions.core import joined
from florin.operators import arrears as A
from florin.operators import calendars as D
from florin.operators import cash as K
from florin.operators import coverage as O
from florin.operators import events as E
from florin.operators import exposure as X
from florin.operators import fx
from florin.operators import marts as M
from florin.operators import signals as S
from florin.plans import cash_queries, signal_queries  # noqa: F401  their definitions are used
from florin.plans.arrears_queries import _payables
from florin.plans.queries import _ORACLES, LAST_DAY, STEPS, _flows, _inv, _open, _tx, _universe, money, query
from florin.operators.flows import classify_flows
from florin.sources.treasury import ANCHOR_DAY, FIRST_MONTH, LAST_MONTH, Treasury

CUT = "2001-03-31"
LAGS = {"USD": 20, "GBP": 75}
_CALENDAR = "generate_series(DATE '1999-08-01', DATE '2001-07-01', INTERVAL 1 MONTH)"

STEPS["active"] = """SELECT company_id, month, count(*) AS n_tx, count(DISTINCT product_id) AS n_accounts, 100.0 * avg(CASE WHEN flow_class = 'unknown' THEN 1.0 ELSE 0.0 END) AS unknown_pct, 100.0 * avg(CASE WHEN amount_eur IS NULL THEN 1.0 ELSE 0.0 END) AS without_eur_pct FROM classified WHERE is_booked AND NOT is_open_month GROUP BY ALL"""
STEPS["observed"] = """SELECT *, CASE WHEN is_active AND has_horizon AND a1 AND a2 AND a3 AND months_observed >= 3 THEN NULL WHEN NOT is_active THEN 'no_activity' WHEN coalesce(months_observed < 3, true) THEN 'warm_up' WHEN NOT has_horizon THEN 'no_horizon' ELSE 'incomplete_horizon' END AS reason FROM (
    SELECT g.company_id, g.group_id, g.month, coalesce(n_tx, 0) AS n_tx, coalesce(n_accounts, 0) AS n_accounts, unknown_pct, without_eur_pct, first_month, last_month, CASE WHEN g.month >= first_month THEN CAST(date_diff('month', first_month, g.month) AS INTEGER) END AS months_observed, n_tx IS NOT NULL AS is_active,
    count(n_tx) OVER (PARTITION BY g.company_id ORDER BY g.month ROWS UNBOUNDED PRECEDING) AS active_so_far, g.month <= DATE '2001-04-01' AS has_horizon, coalesce(lead(n_tx IS NOT NULL, 1) OVER w, false) AS a1, coalesce(lead(n_tx IS NOT NULL, 2) OVER w, false) AS a2, coalesce(lead(n_tx IS NOT NULL, 3) OVER w, false) AS a3
    FROM grid g LEFT JOIN active a USING (company_id, month) LEFT JOIN (SELECT company_id, min(month) AS first_month, max(month) AS last_month FROM active GROUP BY company_id) USING (company_id) WINDOW w AS (PARTITION BY g.company_id ORDER BY g.month))"""
STEPS["cohorts"] = f"""SELECT company_id, month, n_issued, n_uncertain, n_eur, issued_eur, {', '.join(f"CASE WHEN last_day(month) + {n} <= DATE '{LAST_DAY}' AND n_eur = n_issued AND n_uncertain = 0 AND issued_eur <> 0 THEN r{n} / issued_eur END AS conversion_{n}d, CASE WHEN last_day(month) + {n} <= DATE '{LAST_DAY}' THEN last_day(month) + {n} END AS available_at_{n}d" for n in (30, 60, 90))}
    FROM (SELECT company_id, CAST(date_trunc('month', issued) AS DATE) AS month, count(*) AS n_issued, count(eur) AS n_eur, count(*) FILTER (is_uncertain) AS n_uncertain, sum(abs(eur)) AS issued_eur, {', '.join(f"coalesce(sum(abs(eur)) FILTER (date_diff('day', issued, settled) <= {n}), 0) AS r{n}" for n in (30, 60, 90))} FROM universe WHERE side = 'ar' GROUP BY ALL)"""
STEPS["collection_rows"] = """SELECT g.company_id, g.month, last_day(CAST(g.month + INTERVAL 3 MONTH AS DATE)) + 60 AS known_on, (SELECT max(m.month) FROM months m WHERE m.month_end + 60 <= g.available_at) AS baseline_end FROM grid g"""
STEPS["collection_targets"] = f"""SELECT *, CASE WHEN known_on > DATE '{LAST_DAY}' THEN 'no_cohort_horizon' WHEN baseline_months < 3 THEN 'incomplete_baseline' WHEN future_months < 3 THEN 'incomplete_future' END AS reason FROM (SELECT w.company_id, w.month, w.known_on, coalesce(b.n, 0) AS baseline_months, coalesce(f.n, 0) AS future_months, b.v AS bv, f.v AS fv FROM collection_rows w
    LEFT JOIN (SELECT w.company_id, w.month, count(*) AS n, sum(p.issued_eur * p.conversion_60d) / sum(p.issued_eur) AS v FROM collection_rows w JOIN cohorts p ON p.company_id = w.company_id AND p.month BETWEEN w.baseline_end - INTERVAL 2 MONTH AND w.baseline_end AND p.available_at_60d <= last_day(w.month) AND p.conversion_60d IS NOT NULL AND p.issued_eur > 0 GROUP BY ALL) b ON b.company_id = w.company_id AND b.month = w.month
    LEFT JOIN (SELECT w.company_id, w.month, count(*) AS n, sum(p.issued_eur * p.conversion_60d) / sum(p.issued_eur) AS v FROM collection_rows w JOIN cohorts p ON p.company_id = w.company_id AND p.month BETWEEN w.month + INTERVAL 1 MONTH AND w.month + INTERVAL 3 MONTH AND p.available_at_60d <= DATE '{LAST_DAY}' AND p.conversion_60d IS NOT NULL AND p.issued_eur > 0 GROUP BY ALL) f ON f.company_id = w.company_id AND f.month = w.month)"""
STEPS["ages"] = "SELECT * FROM (VALUES ('not_due', 0, 0), ('1_30', 1, 1), ('31_60', 31, 2), ('61_90', 61, 3), ('91_180', 91, 4), ('over_180', 181, 5)) v(age, edge, place)"
STEPS["receivables"] = """SELECT company_id, CASE WHEN amount > 0 THEN 'ar' ELSE 'ap' END AS side, issuance_date AS issued, due_date AS due, CASE WHEN status_norm = 'paid' THEN payment_date END AS paid, CASE WHEN NOT (currency <> accounting_currency AND exchange_rate = 1) THEN abs(amount_eur) END AS eur FROM inv WHERE document_type = 'invoice' AND status_norm <> 'cancel' AND amount <> 0"""
STEPS["cure_counts"] = """SELECT m.month_end AS cut, a.age, a.place, count(r.due) FILTER (a.place = 0 OR paid IS NULL OR paid > due + a.edge) AS n, count(r.due) FILTER ((a.place = 0 OR paid IS NULL OR paid > due + a.edge) AND paid <= due + a.edge + 180) AS k FROM months m CROSS JOIN ages a LEFT JOIN (SELECT * FROM receivables WHERE side = 'ar') r ON r.due + a.edge + 180 <= m.month_end GROUP BY ALL"""
STEPS["cure_raw"] = """SELECT *, coalesce(own, overall, 0.0) AS raw FROM (SELECT *, CASE WHEN (place = 0 OR n >= 100) AND n > 0 THEN k / n END AS own, max(CASE WHEN place = 0 AND n > 0 THEN k / n END) OVER (PARTITION BY cut) AS overall FROM cure_counts)"""
STEPS["cures"] = """SELECT cut, age, n AS n_observed, own IS NULL AS is_fallback, CASE WHEN place = 0 THEN raw WHEN place = 1 THEN least(raw, max(CASE WHEN place = 0 THEN raw END) OVER (PARTITION BY cut)) ELSE min(CASE WHEN place > 0 THEN raw END) OVER (PARTITION BY cut ORDER BY place) END AS rate FROM cure_raw"""
STEPS["survivals"] = """SELECT cut, age, n AS n_at_risk, k AS n_paid, CASE WHEN n >= 200 THEN k / n ELSE coalesce(max(CASE WHEN place = 0 AND n > 0 THEN k / n END) OVER (PARTITION BY cut), 1.0) END AS rate FROM (SELECT m.month_end AS cut, a.age, a.place, count(r.due) FILTER (a.place = 0 OR d > a.edge) AS n, count(r.due) FILTER ((a.place = 0 OR d > a.edge) AND d <= 365) AS k
    FROM months m CROSS JOIN ages a LEFT JOIN (SELECT due, CASE WHEN date_diff('day', due, paid) <= 365 THEN date_diff('day', due, paid) ELSE 366 END AS d FROM receivables WHERE side = 'ap') r ON r.due + 365 <= m.month_end GROUP BY ALL)"""
STEPS["delays"] = """SELECT m.month_end AS cut, side, company_id, CASE WHEN n >= 10 THEN own ELSE everyone END AS expected_delay FROM (SELECT month_end, side, company_id, count(*) AS n, median(date_diff('day', due, paid)) AS own FROM payables JOIN months ON paid <= month_end GROUP BY ALL) m
    JOIN (SELECT month_end, side, median(date_diff('day', due, paid)) AS everyone FROM payables JOIN months ON paid <= month_end GROUP BY ALL) s USING (month_end, side)"""
_EXPECTED = """SELECT r.company_id, m.month_end AS cut, t.age, r.eur, greatest(r.due + CAST(round(coalesce(d.expected_delay, x.everyone, 0)) AS INTEGER), m.month_end + 1) AS day, r.eur * t.rate AS expected_eur FROM (SELECT * FROM receivables WHERE side = '{side}') r JOIN months m ON r.issued <= m.month_end AND (r.paid IS NULL OR r.paid > m.month_end)
    JOIN {table} t ON t.cut = m.month_end AND t.age = CASE WHEN m.month_end - r.due >= 181 THEN 'over_180' WHEN m.month_end - r.due >= 91 THEN '91_180' WHEN m.month_end - r.due >= 61 THEN '61_90' WHEN m.month_end - r.due >= 31 THEN '31_60' WHEN m.month_end - r.due >= 1 THEN '1_30' ELSE 'not_due' END LEFT JOIN (SELECT * FROM delays WHERE side = '{side}') d ON d.cut = m.month_end AND d.company_id = r.company_id
    LEFT JOIN (SELECT month_end, median(date_diff('day', due, paid)) AS everyone FROM payables JOIN months ON paid <= month_end WHERE side = '{side}' GROUP BY month_end) x ON x.month_end = m.month_end"""
STEPS["expected_ar"], STEPS["expected_ap"] = _EXPECTED.format(side="ar", table="cures"), _EXPECTED.format(side="ap", table="survivals")
STEPS["live_foreign"] = """SELECT i.*, m.month AS cut_month, m.month_end FROM inv i JOIN months m ON i.issuance_date <= m.month_end AND (i.status_norm <> 'paid' OR i.payment_date > m.month_end) WHERE document_type = 'invoice' AND status_norm <> 'cancel' AND amount > 0"""
STEPS["by_currency"] = """SELECT company_id, cut_month AS month, currency, count(*) AS n, sum(amount) AS original, coalesce(sum(amount_eur) FILTER (v), 0) AS eur, count(*) FILTER (v AND currency <> 'EUR') AS n_reported, count(*) FILTER (NOT v) AS n_unvalued, coalesce(sum(amount) FILTER (NOT v), 0) AS unvalued_original, count(*) FILTER (NOT v AND amb) AS n_ambiguous
    FROM (SELECT *, amount_eur IS NOT NULL AND NOT (amb AND currency <> 'EUR') AS v FROM (SELECT *, currency <> accounting_currency AND exchange_rate = 1 AS amb FROM live_foreign)) GROUP BY ALL"""
STEPS["published"] = f"SELECT currency, month, rate, last_day(month) + CASE currency WHEN 'USD' THEN {LAGS['USD']} ELSE {LAGS['GBP']} END AS available_at FROM ends"
STEPS["state_rows"] = "SELECT company_id, month, CASE WHEN n_hole = 0 AND act THEN CASE WHEN round(rec - pay + amb_in, 2) < 0 THEN true WHEN round(rec - pay - amb_out, 2) >= 0 THEN false END END AS deficit FROM flow_panel"
STEPS["around"] = "SELECT company_id, month, lag(deficit, 2) OVER w AS s0, lag(deficit, 1) OVER w AS s1, deficit AS s2, lead(deficit, 1) OVER w AS s3, lead(deficit, 2) OVER w AS s4 FROM state_rows WINDOW w AS (PARTITION BY company_id ORDER BY month)"
STEPS["events_found"] = """SELECT company_id, month AS onset_month, 'deterioration' AS sign, last_day(CAST(month + INTERVAL 1 MONTH AS DATE)) AS confirmed_at FROM around WHERE NOT s0 AND NOT s1 AND s2 AND s3 UNION ALL SELECT company_id, month, 'improvement', last_day(CAST(month + INTERVAL 1 MONTH AS DATE)) FROM around WHERE s0 AND s1 AND NOT s2 AND NOT s3
    UNION ALL SELECT company_id, month, 'recovered_dip', last_day(CAST(month + INTERVAL 2 MONTH AS DATE)) FROM around WHERE NOT s0 AND NOT s1 AND s2 AND NOT s3 AND NOT s4"""
STEPS["episode_rows"] = """SELECT company_id, direction, min(month) AS watch_month, CASE WHEN count(*) >= 2 THEN CAST(min(month) + INTERVAL 1 MONTH AS DATE) END AS confirmed_month FROM (SELECT *, sum(CASE WHEN direction IN ('improving', 'deteriorating') AND direction IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY company_id ORDER BY month) AS run
    FROM (SELECT *, lag(direction) OVER (PARTITION BY company_id ORDER BY month) AS before FROM directed)) WHERE direction IN ('improving', 'deteriorating') GROUP BY company_id, run, direction"""
STEPS["issued_alerts"] = """SELECT company_id, CASE direction WHEN 'improving' THEN 'improvement' ELSE 'deterioration' END AS sign, method, origin_month FROM (SELECT company_id, direction, 'baseline' AS method, watch_month AS origin_month FROM episode_rows UNION ALL SELECT company_id, direction, 'candidate', confirmed_month FROM episode_rows) WHERE origin_month IS NOT NULL"""


def _grid(t: Treasury) -> DataFrame:
    return M.company_months(t.companies, FIRST_MONTH, LAST_MONTH)


def _cohorts(t: Treasury) -> DataFrame:
    return M.receipt_cohorts(_universe(t), LAST_DAY)


def _observed(t: Treasury) -> DataFrame:
    return O.observability(_grid(t), classify_flows(_tx(t)), LAST_MONTH)


def _rates(t: Treasury, side: str) -> DataFrame:
    rows = D.receivable_rows(_inv(t), side)
    return D.cure_rates(rows, FIRST_MONTH, LAST_MONTH) if side == "ar" else D.payment_survival(rows, FIRST_MONTH, LAST_MONTH)


def _expected(t: Treasury, side: str) -> DataFrame:
    delays, sides = (found(_payables(t), FIRST_MONTH, LAST_MONTH).where(F.col("side") == side) for found in (A.delay_profile, A.side_delays))
    return D.expected_rows(D.receivable_rows(_inv(t), side), _rates(t, side), delays, sides, FIRST_MONTH, LAST_MONTH)


def _by_currency(t: Treasury) -> DataFrame:
    return X.currency_exposure(X.live_receivables(_inv(t), FIRST_MONTH, LAST_MONTH))


def _states(t: Treasury) -> DataFrame:
    from florin.functions.core import deficit_state

    return _flows(t).select("company_id", "month", deficit_state(F.col("operating_min"), F.col("operating_max")).alias("deficit"))


@query("SELECT company_id, group_id, month, n_tx, n_accounts, round(unknown_pct, 4) AS unknown_pct, round(without_eur_pct, 4) AS without_eur_pct, first_month, last_month, months_observed, active_so_far, has_horizon, reason IS NULL AS is_observable, reason FROM observed")
def m15_observability(t: Treasury) -> DataFrame:
    return _observed(t).withColumns({c: F.round(c, 4) for c in ("unknown_pct", "without_eur_pct")})


@query("SELECT month, count(*) FILTER (reason IS NULL) AS n_observable, count(*) AS n_companies FROM observed GROUP BY month")
def m20_observable_series(t: Treasury) -> DataFrame:
    return O.observable_series(_observed(t))


@query(" UNION ALL ".join(f"SELECT company_id, month AS cohort_month, {n} AS horizon_days, round(conversion_{n}d, 6) AS value, available_at_{n}d AS available_at FROM cohorts WHERE conversion_{n}d IS NOT NULL AND available_at_{n}d <= DATE '{CUT}'" for n in (30, 60, 90)))
def m10_cohort_features_at(t: Treasury) -> DataFrame:
    return O.cohort_features_at(_cohorts(t), CUT).withColumn("value", F.round("value", 6))


@query("""SELECT step, count(*) AS n, round(sum(abs(amount_eur)), 2) AS known_eur FROM (SELECT *, unnest(list_filter([CASE WHEN status_norm = 'cancel' THEN 'cancelled' END, CASE WHEN status_norm <> 'cancel' AND document_type <> 'invoice' THEN 'no_invoice' END, CASE WHEN status_norm <> 'cancel' AND document_type = 'invoice' AND amount_eur IS NULL THEN 'without_eur' END,
    CASE WHEN status_norm = 'paid' AND document_type = 'invoice' AND pending_amount <> 0 THEN 'paid_in_part' END, CASE WHEN status_norm <> 'cancel' AND document_type = 'invoice' AND amount = 0 THEN 'zero_amount' END, CASE WHEN status_norm <> 'cancel' AND document_type = 'invoice' THEN 'universe' END], lambda x: x IS NOT NULL)) AS step FROM inv) GROUP BY step""")
def m11_exclusion_funnel(t: Treasury) -> DataFrame:
    return O.exclusion_funnel(_inv(t)).withColumn("known_eur", F.round("known_eur", 2))


@query("""SELECT company_id, month, side, CASE WHEN coalesce(n_possible, 0) = coalesce(n_eur, 0) AND coalesce(n_uncertain, 0) = 0 THEN round(coalesce(open_eur, 0), 2) END AS open_total, CASE WHEN coalesce(n_possible, 0) = coalesce(n_eur, 0) AND coalesce(n_uncertain, 0) = 0 AND coalesce(n_without_due, 0) = 0 THEN round(coalesce(overdue_eur, 0), 2) END AS overdue_total,
    CASE WHEN coalesce(n_issued, 0) = coalesce(n_issued_eur, 0) THEN round(coalesce(issued_eur, 0), 2) END AS issued_total, round(coalesce(open_eur, 0), 2) AS open_known, round(coalesce(n_eur / n_possible, 1), 6) AS open_coverage
    FROM (SELECT company_id, month, side, sum(abs(eur)) FILTER (NOT is_uncertain) AS open_eur, sum(abs(eur)) FILTER (due < month_end) AS overdue_eur, count(*) AS n_possible, count(eur) AS n_eur, count(*) FILTER (is_uncertain) AS n_uncertain, count(*) FILTER (due IS NULL) AS n_without_due FROM open_rows GROUP BY company_id, month, side)
    FULL JOIN (SELECT company_id, CAST(date_trunc('month', issued) AS DATE) AS month, side, sum(abs(eur)) AS issued_eur, count(*) AS n_issued, count(eur) AS n_issued_eur FROM universe GROUP BY ALL) USING (company_id, month, side)""")
def m09_masked_stock(t: Treasury) -> DataFrame:
    universe = _universe(t)
    issued = universe.groupBy("company_id", F.trunc("issued", "MM").alias("month"), "side").agg(F.sum(F.abs("eur")).alias("issued_eur"), F.count("*").alias("n_issued"), F.count("eur").alias("n_issued_eur"))
    return O.masked_stock(M.open_stock(_open(t)), issued).select("company_id", "month", "side", *money("open_total", "overdue_total", "issued_total", "open_known"), F.round("open_coverage", 6).alias("open_coverage"))


@query("SELECT company_id, month, known_on, baseline_months, future_months, reason, CASE WHEN reason IS NULL THEN round(100.0 * (bv - fv), 4) END AS worsening FROM collection_targets")
def m16_collection_targets(t: Treasury) -> DataFrame:
    return O.collection_targets(_grid(t), _cohorts(t), LAST_DAY, FIRST_MONTH).withColumn("worsening", F.round("worsening", 4))


@query(f"""SELECT company_id, month, 'collection' AS target_name, round(100.0 * (bv - fv), 4) AS value, known_on FROM collection_targets WHERE reason IS NULL AND bv - fv IS NOT NULL AND known_on <= DATE '{CUT}'
    UNION ALL SELECT company_id, month, 'deficit', CAST(target AS DOUBLE), known_on FROM ({_ORACLES['m16_deficit_targets']}) WHERE target IS NOT NULL AND known_on <= DATE '{CUT}'""")
def m17_labels_at(t: Treasury) -> DataFrame:
    found = O.targets_at(S.deficit_targets(_flows(t), LAST_DAY), O.collection_targets(_grid(t), _cohorts(t), LAST_DAY, FIRST_MONTH), CUT)
    return found.withColumn("value", F.round("value", 4))


@query(f"""SELECT product_currency AS currency, month, CAST(NULL AS DOUBLE) AS rate, count(*) AS n_observed, 'unknown' AS source, last_day(month) AS available_at FROM tx WHERE is_booked AND exchange_rate > 0 AND exchange_rate <> 1 AND product_currency <> 'EUR' AND month BETWEEN DATE '1999-08-01' AND DATE '2001-07-01' GROUP BY product_currency, month
    UNION ALL SELECT 'EUR', CAST(m AS DATE), 1.0, 0, 'identity', CAST(m AS DATE) FROM {_CALENDAR} g(m)""")
def m18_rate_registry(t: Treasury) -> DataFrame:
    return O.rate_registry(_tx(t), FIRST_MONTH, LAST_MONTH)


@query("""SELECT company_id, side, month, n AS n_due, holes AS n_holes, round(due_eur, 2) AS due_eur, round(on_time, 2) AS on_time, round(late, 2) AS late, CASE WHEN holes = 0 AND due_eur > 0 THEN round((due_eur - on_time - late) / due_eur, 6) END AS arrears_ratio, round(CASE WHEN due_eur > 0 THEN (due_eur - on_time - late) / due_eur WHEN holes > 0 THEN 0 END, 6) AS ratio_min,
    round(CASE WHEN holes > 0 THEN 1.0 WHEN due_eur > 0 THEN (due_eur - on_time - late) / due_eur END, 6) AS ratio_max, CASE WHEN late > 0 THEN round(late_days / late, 4) END AS mean_days_late, CASE WHEN holes = 0 THEN 'high' WHEN holes / n >= 0.5 THEN 'low' ELSE 'medium' END AS confidence
    FROM (SELECT company_id, side, m.month, count(*) AS n, count(*) FILTER (eur IS NULL) AS holes, coalesce(sum(eur), 0) AS due_eur, coalesce(sum(eur) FILTER (paid <= due), 0) AS on_time, coalesce(sum(eur) FILTER (paid > due AND paid <= month_end), 0) AS late, coalesce(sum(eur * date_diff('day', due, paid)) FILTER (paid > due AND paid <= month_end), 0) AS late_days FROM payables JOIN months m ON due <= month_end GROUP BY ALL)""")
def p01_punctuality(t: Treasury) -> DataFrame:
    out = D.punctuality(_payables(t), FIRST_MONTH, LAST_MONTH)
    return out.select("company_id", "side", "month", "n_due", "n_holes", *money("due_eur", "on_time", "late"), *(F.round(c, 6).alias(c) for c in ("arrears_ratio", "ratio_min", "ratio_max")), F.round("mean_days_late", 4).alias("mean_days_late"), "confidence")


@query("SELECT cut, age, n_observed, is_fallback, round(rate, 6) AS rate FROM cures")
def p14_cure_rates(t: Treasury) -> DataFrame:
    return _rates(t, "ar").withColumn("rate", F.round("rate", 6))


@query("SELECT cut, age, n_at_risk, n_paid, round(rate, 6) AS rate FROM survivals")
def p15_payment_survival(t: Treasury) -> DataFrame:
    return _rates(t, "ap").withColumn("rate", F.round("rate", 6))


_DAILY = "SELECT company_id, cut, day, round(sum(expected_eur), 4) AS expected_eur, count(*) AS n_invoices FROM {0} WHERE eur IS NOT NULL AND day <= cut + 90 GROUP BY ALL"
_HORIZON = f"""SELECT company_id, cut, h, count(*) AS n_live, round(coalesce(sum(eur), 0), 2) AS live_eur, count(*) FILTER (eur IS NOT NULL AND day <= cut + h) AS n_expected, round(coalesce(sum(expected_eur) FILTER (day <= cut + h), 0), 4) AS expected_eur, count(*) FILTER (eur IS NULL) AS n_without_value, cut + h <= DATE '{LAST_DAY}' AS can_be_checked FROM {{0}} CROSS JOIN (VALUES (30), (60), (90)) v(h) GROUP BY company_id, cut, h"""


@query(_DAILY.format("expected_ar"))
def p16_collections_calendar(t: Treasury) -> DataFrame:
    return D.dated_calendar(_expected(t, "ar")).withColumn("expected_eur", F.round("expected_eur", 4))


@query(_HORIZON.format("expected_ar"))
def p17_collections_by_horizon(t: Treasury) -> DataFrame:
    return D.horizon_totals(_expected(t, "ar"), LAST_DAY).withColumns({"live_eur": F.round("live_eur", 2), "expected_eur": F.round("expected_eur", 4)})


@query(_DAILY.format("expected_ap"))
def p18_payments_calendar(t: Treasury) -> DataFrame:
    return D.dated_calendar(_expected(t, "ap")).withColumn("expected_eur", F.round("expected_eur", 4))


@query(_HORIZON.format("expected_ap"))
def p18_payments_by_horizon(t: Treasury) -> DataFrame:
    return D.horizon_totals(_expected(t, "ap"), LAST_DAY).withColumns({"live_eur": F.round("live_eur", 2), "expected_eur": F.round("expected_eur", 4)})


@query("SELECT cut, age, count(*) AS n_live, count(DISTINCT company_id) AS n_companies, round(sum(eur), 2) AS live_eur, round(sum(expected_eur), 2) AS expected_eur FROM expected_ar GROUP BY cut, age")
def p19_cut_census(t: Treasury) -> DataFrame:
    return D.cut_census(_expected(t, "ar")).withColumns({c: F.round(c, 2) for c in ("live_eur", "expected_eur")})


@query("""SELECT *, min(CASE WHEN balance < 0 THEN day END) OVER (PARTITION BY company_id, cut) AS first_negative FROM (SELECT company_id, cut, day, round(receipts, 4) AS receipts, round(payments, 4) AS payments, round(start + sum(receipts - payments) OVER (PARTITION BY company_id, cut ORDER BY day) + 1e-6, 2) AS balance
    FROM (SELECT company_id, cut, day, coalesce(r.e, 0) AS receipts, coalesce(p.e, 0) AS payments FROM (SELECT company_id, cut, day, sum(expected_eur) AS e FROM expected_ar WHERE eur IS NOT NULL AND day <= cut + 90 GROUP BY ALL) r FULL JOIN (SELECT company_id, cut, day, sum(expected_eur) AS e FROM expected_ap WHERE eur IS NOT NULL AND day <= cut + 90 GROUP BY ALL) p USING (company_id, cut, day))
    LEFT JOIN (SELECT company_id, last_day(month) AS cut, balance AS start FROM back_rows) USING (company_id, cut))""")
def b11_projection(t: Treasury) -> DataFrame:
    start = K.backward_balance(K.cash_flows(cash_queries._tx(t), "month", K.ANCHORED), cash_queries._anchor(t), t.companies, FIRST_MONTH, ANCHOR_DAY).select("company_id", F.last_day("month").alias("cut"), F.col("balance").alias("balance_at_cut"))
    out = D.projection_union(D.dated_calendar(_expected(t, "ar")), D.dated_calendar(_expected(t, "ap")), start)
    return out.withColumns({"receipts": F.round("receipts", 4), "payments": F.round("payments", 4), "balance": F.round(F.col("balance") + 1e-6, 2)}).withColumn("first_negative", F.min(F.when(F.col("balance") < 0, F.col("day"))).over(_per_cut()))


def _per_cut():
    from pyspark.sql import Window

    return Window.partitionBy("company_id", "cut")


@query("SELECT company_id, month, currency, n, round(original, 2) AS original, round(eur, 2) AS eur, n_reported, n_unvalued, round(unvalued_original, 2) AS unvalued_original, n_ambiguous FROM by_currency")
def r06_currency_exposure(t: Treasury) -> DataFrame:
    return _by_currency(t).withColumns({c: F.round(c, 2) for c in ("original", "eur", "unvalued_original")})


@query("""SELECT company_id, month, n_live, n_unvalued, n_currencies, n_unvalued_currencies, CASE WHEN n_live > n_unvalued THEN round(eur_eur + other_eur, 2) END AS live_eur, CASE WHEN n_eur > 0 THEN round(eur_eur, 2) END AS eur_eur, CASE WHEN n_other > 0 THEN round(other_eur, 2) END AS other_eur,
    CASE WHEN n_unvalued / n_live >= 0.5 THEN 'low' WHEN n_unvalued > 0 OR eur_eur + other_eur < 1000 OR n_live - n_unvalued < 3 THEN 'medium' ELSE 'high' END AS confidence, concat_ws(',', CASE WHEN has_eur > 0 AND n_currencies = 1 THEN 'eur_only' END, CASE WHEN other_eur > 0 THEN 'foreign_exposure' END, CASE WHEN n_reported > 0 THEN 'reported_rates' END, CASE WHEN has_eur > 0 AND n_currencies > 1 THEN 'several_currencies' END, CASE WHEN n_unvalued > 0 THEN 'unvalued_exposure' END) AS flags
    FROM (SELECT company_id, month, CAST(sum(n) AS BIGINT) AS n_live, CAST(sum(n_unvalued) AS BIGINT) AS n_unvalued, sum(n - n_unvalued) FILTER (currency = 'EUR') AS n_eur, sum(n - n_unvalued) FILTER (currency <> 'EUR') AS n_other, coalesce(sum(eur) FILTER (currency = 'EUR'), 0) AS eur_eur, coalesce(sum(eur) FILTER (currency <> 'EUR'), 0) AS other_eur, count(*) AS n_currencies, count(*) FILTER (n_unvalued > 0) AS n_unvalued_currencies, sum(n_reported) AS n_reported, count(*) FILTER (currency = 'EUR') AS has_eur FROM by_currency GROUP BY ALL)""")
def r07_exposure_summary(t: Treasury) -> DataFrame:
    return X.exposure_summary(_by_currency(t)).withColumns({c: F.round(c, 2) for c in ("live_eur", "eur_eur", "other_eur")}).withColumn("flags", joined(F.col("flags")))


@query("SELECT currency, count(DISTINCT company_id) AS n_companies, CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n_unvalued) AS BIGINT) AS n_unvalued, round(sum(eur), 2) AS eur FROM by_currency GROUP BY currency")
def r15_exposure_census(t: Treasury) -> DataFrame:
    return X.exposure_census(_by_currency(t)).withColumn("eur", F.round("eur", 2))


@query("""SELECT c.currency, m.month_end AS cut, p.month AS rate_month, round(p.rate, 6) AS rate, CAST(date_diff('month', p.month, m.month) AS INTEGER) AS age_months FROM (SELECT DISTINCT currency FROM published) c CROSS JOIN months m LEFT JOIN LATERAL (SELECT q.month, q.rate FROM published q WHERE q.currency = c.currency AND q.available_at <= m.month_end ORDER BY q.month DESC LIMIT 1) p ON true""")
def r08_latest_published(t: Treasury) -> DataFrame:
    return X.latest_published(X.published_rates(t.fx_daily, LAGS), FIRST_MONTH, LAST_MONTH).withColumn("rate", F.round("rate", 6))


@query(f"""SELECT q.currency, q.month, p.month AS rate_month, round(p.rate, 6) AS rate, CAST(p.lag AS INTEGER) AS lag_months FROM (SELECT DISTINCT currency, month FROM inv WHERE currency <> 'EUR') q LEFT JOIN LATERAL (SELECT u.month, u.rate, abs(date_diff('month', u.month, q.month)) AS lag FROM published u WHERE u.currency = q.currency AND u.available_at <= DATE '{CUT}' ORDER BY abs(date_diff('month', u.month, q.month)), u.month LIMIT 1) p ON true""")
def r10_nearest_published(t: Treasury) -> DataFrame:
    asked = _inv(t).where("currency <> 'EUR'").select("currency", "month")
    return X.nearest_published(asked, X.published_rates(t.fx_daily, LAGS), CUT).withColumn("rate", F.round("rate", 6))


@query(f"""SELECT i.operation_id, i.currency, round(coalesce(rep, amount / d.rate, amount / m.rate), 2) AS value_eur, CASE WHEN rep IS NOT NULL THEN 'reported' WHEN d.rate IS NOT NULL THEN 'daily' WHEN m.rate IS NOT NULL THEN 'monthly' ELSE 'none' END AS source FROM (SELECT *, CASE WHEN NOT (currency <> accounting_currency AND exchange_rate = 1) OR currency = 'EUR' THEN amount_eur END AS rep FROM inv) i
    LEFT JOIN LATERAL (SELECT f.rate FROM fx_daily f WHERE f.currency = i.currency AND f.day <= i.issuance_date ORDER BY f.day DESC LIMIT 1) d ON true
    LEFT JOIN (SELECT q.currency, q.month, p.rate FROM (SELECT DISTINCT currency, month FROM inv WHERE currency <> 'EUR') q LEFT JOIN LATERAL (SELECT u.rate FROM published u WHERE u.currency = q.currency AND u.available_at <= DATE '{CUT}' ORDER BY abs(date_diff('month', u.month, q.month)), u.month LIMIT 1) p ON true) m ON m.currency = i.currency AND m.month = i.month""")
def r11_valuations(t: Treasury) -> DataFrame:
    invoices = _inv(t)
    daily = fx.rate_on_or_before(invoices.where(F.col("currency").isin(*LAGS)).select("operation_id", "currency", "issuance_date_ok"), t.fx_daily, "issuance_date_ok").select("operation_id", F.col("rate").alias("daily_rate"))
    monthly = X.nearest_published(invoices.where("currency <> 'EUR'").select("currency", "month"), X.published_rates(t.fx_daily, LAGS), CUT).select("currency", "month", F.col("rate").alias("monthly_rate"))
    return X.valuations(invoices, daily, monthly).withColumn("value_eur", F.round("value_eur", 2))


@query("SELECT company_id, onset_month, sign, confirmed_at FROM events_found")
def x05_transitions(t: Treasury) -> DataFrame:
    return E.transitions(_states(t))


@query("SELECT company_id, sign, method, origin_month FROM issued_alerts")
def x04_alerts(t: Treasury) -> DataFrame:
    return E.alerts(S.episodes(S.directions(_flows(t))))


def _matched(t: Treasury) -> tuple[DataFrame, DataFrame]:
    states = _states(t)
    events = E.transitions(states)
    return E.matched_alerts(E.alerts(S.episodes(S.directions(_flows(t)))), events, states), events


@query()
def x06_matched_alerts(t: Treasury) -> DataFrame:
    return _matched(t)[0]


@query()
def x07_alert_report(t: Treasury) -> DataFrame:
    return E.alert_report(*_matched(t)).withColumns({c: F.round(c, 6) for c in ("false_share", "recall")})


@query("SELECT sign, count(*) AS n_cases, min(s).confirmed_at AS confirmed_at, min(s).company_id AS company_id, min(s).onset_month AS onset_month FROM (SELECT sign, {'confirmed_at': confirmed_at, 'company_id': company_id, 'onset_month': onset_month} AS s FROM events_found) GROUP BY sign")
def x10_first_cases(t: Treasury) -> DataFrame:
    return E.first_cases(E.transitions(_states(t)))
