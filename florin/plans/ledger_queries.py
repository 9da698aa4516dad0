"""Registered queries of the evidence ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from florin.functions.core import joined
from florin.operators import ledger as G
from florin.operators.marts import company_months
from florin.plans.queries import STEPS, query
from florin.sources.ledger import RECORDS, Ledger
from florin.sources.treasury import FIRST_MONTH, LAST_MONTH, Treasury

_KNOWN = "2000-12-31"
STEPS.update(RECORDS)


def _once(name: str, identity: str, rest: str) -> None:
    """Oracle of deduplicated records: the least one by its columns in order."""
    same = " OR ".join(f"min({c}) IS DISTINCT FROM max({c}) OR count({c}) NOT IN (0, count(*))" for c in rest.split(", "))
    STEPS[f"{name}_once"] = f"SELECT {identity}, n_records, is_conflict, {rest} FROM (SELECT *, row_number() OVER (PARTITION BY {identity} ORDER BY {', '.join(f'{c} NULLS FIRST' for c in rest.split(', '))}) AS _n FROM {name}) x JOIN (SELECT {identity}, count(*) AS n_records, {same} AS is_conflict FROM {name} GROUP BY {identity}) y USING ({identity}) WHERE _n = 1"


_once("statements", "coverage_id", "account_id, from_day, to_day, is_complete, known_on, basis")
_once("settlements", "allocation_id", "obligation_id, paid_on, amount, policy")
STEPS["periods"] = "SELECT *, CAST(month + INTERVAL 1 MONTH AS DATE) AS next_month, CAST(month + INTERVAL 3 MONTH AS DATE) AS cutoff FROM ledger_accounts CROSS JOIN (SELECT month FROM months)"
STEPS["ordered_statements"] = """SELECT p.account_id, p.month, s.from_day, s.to_day, max(s.to_day) OVER (PARTITION BY p.account_id, p.month ORDER BY s.from_day, s.to_day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended
    FROM periods p JOIN statements_once s ON s.account_id = p.account_id AND s.known_on < p.cutoff WHERE s.is_complete AND NOT s.is_conflict AND s.basis = 'verified'"""
STEPS["islands"] = """SELECT account_id, month, min(from_day) AS from_day, max(to_day) AS to_day FROM (SELECT *, sum(CASE WHEN ended IS NULL OR from_day > ended THEN 1 ELSE 0 END) OVER (PARTITION BY account_id, month ORDER BY from_day, to_day ROWS UNBOUNDED PRECEDING) AS n FROM ordered_statements) GROUP BY account_id, month, n"""


def _periods(l: Ledger) -> DataFrame:
    return G.report_months(l.ledger_accounts, FIRST_MONTH, LAST_MONTH)


def _statements(l: Ledger) -> DataFrame:
    return G.deduplicated(l.statements, ["coverage_id"])


def _islands(l: Ledger) -> DataFrame:
    return G.coverage_islands(_statements(l), _periods(l))


@query("SELECT coverage_id, CAST(n_records AS BIGINT) AS n_records, is_conflict, from_day, to_day FROM statements_once")
def e02_deduplicated_records(t: Treasury) -> DataFrame:
    return _statements(Ledger(t)).select("coverage_id", "n_records", "is_conflict", "from_day", "to_day")


@query(f"SELECT coverage_id, concat_ws(',', CASE WHEN known_on IS NULL THEN 'unknown_known_on' END, CASE WHEN known_on >= DATE '{_KNOWN}' THEN 'future_known_on' END, CASE WHEN basis <> 'verified' THEN 'unverified_availability' END) AS reasons FROM statements_once")
def e03_knowledge_time(t: Treasury) -> DataFrame:
    reasons = G.unavailable_reasons(F.lit(_KNOWN).cast("date"))
    return _statements(Ledger(t)).select("coverage_id", F.array_join(reasons, ",").alias("reasons"))


@query("""SELECT p.account_id, p.month, coalesce(is_covered, false) AS is_covered, CAST(coalesce(days, 0) AS BIGINT) AS days_covered FROM periods p LEFT JOIN (SELECT i.account_id, i.month, bool_or(i.from_day <= p.month AND i.to_day >= p.next_month) AS is_covered, sum(date_diff('day', greatest(i.from_day, p.month), least(i.to_day, p.next_month))) AS days
    FROM islands i JOIN periods p USING (account_id, month) WHERE i.from_day < p.next_month AND i.to_day > p.month GROUP BY ALL) x USING (account_id, month)""")
def e04_covered_months(t: Treasury) -> DataFrame:
    l = Ledger(t)
    return G.covered_months(_islands(l), _periods(l)).select("account_id", "month", "is_covered", F.col("days_covered").cast("long").alias("days_covered"))


@query("SELECT account_id, month, from_day, to_day FROM islands")
def e04_coverage_islands(t: Treasury) -> DataFrame:
    return _islands(Ledger(t))


STEPS["cuts"] = "SELECT *, CASE WHEN semantics = 'closing' THEN measured_on + 1 WHEN semantics <> 'unknown' THEN measured_on END AS cut FROM anchors"
STEPS["known_cuts"] = "SELECT p.month, p.next_month, p.cutoff, c.* FROM periods p JOIN cuts c ON c.account_id = p.account_id AND c.known_on < p.cutoff AND c.basis = 'verified' AND (c.cut IS NULL OR c.cut <= p.cutoff)"
STEPS["account_ends"] = """SELECT p.*, l.anchor_id AS late_id, l.cut AS late_cut, l.amount AS late_amount, l.is_independent AS late_independent, e.anchor_id AS early_id, e.cut AS early_cut, e.amount AS early_amount, coalesce(u.n, 0) AS n_uncut FROM periods p
    LEFT JOIN (SELECT * FROM known_cuts WHERE cut >= next_month QUALIFY row_number() OVER (PARTITION BY account_id, month ORDER BY cut, anchor_id) = 1) l USING (account_id, month)
    LEFT JOIN (SELECT * FROM known_cuts WHERE cut < next_month AND is_independent QUALIFY row_number() OVER (PARTITION BY account_id, month ORDER BY cut DESC, anchor_id DESC) = 1) e USING (account_id, month)
    LEFT JOIN (SELECT account_id, month, count(*) AS n FROM known_cuts WHERE cut IS NULL GROUP BY ALL) u USING (account_id, month)"""
STEPS["account_sums"] = """SELECT a.*, late_independent AND early_id IS NOT NULL AS checked,
    (SELECT bool_or(i.from_day <= a.month AND i.to_day >= a.late_cut) FROM islands i WHERE i.account_id = a.account_id AND i.month = a.month) AS bridge_covered, (SELECT bool_or(i.from_day <= a.early_cut AND i.to_day >= a.late_cut) FROM islands i WHERE i.account_id = a.account_id AND i.month = a.month) AS between_covered,
    (SELECT coalesce(sum(m.amount), 0) FROM ledger_movements m WHERE m.account_id = a.account_id AND m.known_on < a.cutoff AND m.booking = 'booked' AND m.booked_on >= a.next_month AND m.booked_on < a.late_cut) AS bridge, (SELECT count(*) FROM ledger_movements m WHERE m.account_id = a.account_id AND m.known_on < a.cutoff AND m.booking = 'unknown' AND m.booked_on >= a.next_month AND m.booked_on < a.late_cut) AS bridge_unknown,
    (SELECT coalesce(sum(m.amount), 0) FROM ledger_movements m WHERE m.account_id = a.account_id AND m.known_on < a.cutoff AND m.booking = 'booked' AND m.booked_on >= a.early_cut AND m.booked_on < a.late_cut) AS between_sum, (SELECT count(*) FROM ledger_movements m WHERE m.account_id = a.account_id AND m.known_on < a.cutoff AND m.booking = 'unknown' AND m.booked_on >= a.early_cut AND m.booked_on < a.late_cut) AS between_unknown FROM account_ends a"""
STEPS["account_states"] = """SELECT *, bridged AND coalesce(checked, false) AS reconciled, CASE WHEN bridged THEN late_amount - bridge END AS native, CASE WHEN bridged AND checked AND between_covered THEN late_amount - early_amount - between_sum END AS residual,
    CASE WHEN bridged AND checked AND between_covered THEN greatest(0.01, 0.000001 * greatest(abs(late_amount), abs(early_amount), 1)) END AS tolerance FROM (SELECT *, late_id IS NOT NULL AND coalesce(bridge_covered, false) AND bridge_unknown = 0 AS bridged FROM account_sums)"""


@query("""SELECT account_id, company_id, s.currency, month, late_id AS anchor_id, CASE WHEN reconciled THEN early_id END AS reconciliation_anchor_id, round(CAST(native AS DOUBLE), 2) AS ledger_native, round(CAST(residual AS DOUBLE), 2) AS residual, round(CAST(tolerance AS DOUBLE), 6) AS tolerance, round(CAST(native AS DOUBLE) / CASE WHEN s.currency = 'EUR' THEN 1 ELSE f.rate END, 2) AS ledger_eur,
    concat_ws(',', CASE WHEN late_id IS NULL AND n_uncut > 0 THEN 'anchor_cutoff_unknown' END, CASE WHEN late_id IS NULL AND n_uncut = 0 THEN 'missing_source' END, CASE WHEN (late_id IS NOT NULL AND NOT bridged) OR (reconciled AND NOT (coalesce(between_covered, false) AND between_unknown = 0)) THEN 'ledger_gap' END,
        CASE WHEN bridged AND NOT reconciled THEN 'reconciliation_unverified' END, CASE WHEN abs(residual) > tolerance THEN 'reconciliation_mismatch' END, CASE WHEN bridged AND s.currency <> 'EUR' AND f.rate IS NULL THEN 'fx_missing' END) AS reasons
    FROM account_states s LEFT JOIN fx_daily f ON f.currency = s.currency AND f.day = s.next_month - 1""")
def e05_reconstructed_accounts(t: Treasury) -> DataFrame:
    l = Ledger(t)
    anchors, movements = G.deduplicated(l.anchors, ["anchor_id"]), G.deduplicated(l.ledger_movements, ["movement_id"])
    rows = G.reconstructed_accounts(_periods(l), anchors, movements, _islands(l), t.fx_daily)
    rounded = [F.round(F.col(c).cast("double"), n).alias(c) for c, n in (("ledger_native", 2), ("residual", 2), ("tolerance", 6), ("ledger_eur", 2))]
    return rows.select("account_id", "company_id", "currency", "month", "anchor_id", "reconciliation_anchor_id", *rounded, F.array_join("reasons", ",").alias("reasons"))


STEPS["legal"] = "SELECT obligation_id, any_value(company_id) AS company_id, any_value(kind) AS kind, any_value(currency) AS currency, any_value(face) AS face, any_value(due_on) AS due_on, min(effective_from) AS effective_from, bool_and(role_verified) AS role_verified FROM obligations GROUP BY obligation_id"
STEPS["ob_events"] = """SELECT obligation_id, 0 AS ord, effective_from AS day, obligation_id AS event_id, face AS delta, 0 AS paid, 0 AS written, false AS unstated, false AS adjusts FROM legal
    UNION ALL SELECT obligation_id, 2, paid_on, allocation_id, CASE WHEN policy = 'explicit' AND NOT is_conflict THEN -amount ELSE 0 END, CASE WHEN policy = 'explicit' AND NOT is_conflict THEN amount ELSE 0 END, 0, NOT (policy = 'explicit' AND NOT is_conflict), false FROM settlements_once
    UNION ALL SELECT obligation_id, 1, effective_on, amendment_id, CASE kind WHEN 'reverse' THEN amount WHEN 'writeoff' THEN 0 ELSE -amount END, 0, CASE WHEN kind = 'writeoff' THEN amount ELSE 0 END, false, true FROM amendments"""
STEPS["ob_running"] = "SELECT e.*, company_id, kind, currency, due_on, sum(delta) OVER (PARTITION BY e.obligation_id ORDER BY day, ord, event_id ROWS UNBOUNDED PRECEDING) AS running FROM ob_events e JOIN legal USING (obligation_id)"
STEPS["ob_months"] = """SELECT m.month, m.month_end, o.obligation_id, any_value(o.company_id) AS company_id, any_value(o.kind) AS kind, any_value(o.due_on) AS due_on, sum(o.delta) AS remaining, min(o.running) AS lowest, greatest(coalesce(date_diff('day', any_value(o.due_on), m.month_end), 0), 0) AS late
    FROM months m JOIN ob_running o ON o.day <= m.month_end WHERE o.currency = 'EUR' GROUP BY m.month, m.month_end, o.obligation_id"""
_W = "CASE WHEN late >= 181 THEN 4.0 WHEN late >= 91 THEN 3.0 WHEN late >= 61 THEN 2.0 WHEN late >= 31 THEN 1.5 WHEN late >= 8 THEN 1.25 WHEN late >= 1 THEN 1.0 ELSE 0.0 END"
_AGE = ", ".join(f"coalesce(sum(remaining) FILTER (kind <> 'ar' AND late >= {a} AND late < {b}), 0) AS age_{a}" for a, b in ((1, 8), (8, 31), (31, 61), (61, 91), (91, 181), (181, 999999)))
STEPS["ob_stocks"] = f"""SELECT company_id, month, {', '.join(f"coalesce(sum(remaining) FILTER (kind = '{k}'), 0) AS unpaid_{k}" for k in G.KINDS)}, coalesce(sum(remaining) FILTER (kind <> 'ar' AND due_on <= month_end), 0) AS unpaid_due, coalesce(sum(remaining) FILTER (kind <> 'ar' AND due_on > month_end), 0) AS not_due,
    coalesce(sum(remaining) FILTER (kind <> 'ar' AND late > 0), 0) AS overdue, coalesce(sum(CAST(remaining AS DECIMAL(28, 2)) * {_W}) FILTER (kind <> 'ar'), 0) AS weighted, coalesce(sum(remaining) FILTER (kind IN ('financial_principal', 'financial_interest') AND due_on > month_end AND due_on < month + INTERVAL 4 MONTH), 0) AS service, min(due_on) FILTER (kind <> 'ar' AND due_on <= month_end) AS earliest_due, {_AGE},
    coalesce(sum(remaining) FILTER (kind <> 'ar' AND late > 30), 0) AS late_over_30, coalesce(sum(remaining) FILTER (kind <> 'ar' AND late > 30 AND date_diff('day', due_on, month - 1) <= 30), 0) AS newly_late FROM ob_months WHERE remaining > 0 AND lowest >= 0 GROUP BY company_id, month"""
STEPS["ob_flows"] = "SELECT company_id, CAST(date_trunc('month', day) AS DATE) AS month, sum(paid) AS paid, sum(written) AS written, sum(paid) FILTER (date_diff('day', due_on, CAST(date_trunc('month', day) AS DATE) - 1) > 30) AS paid_late FROM ob_running WHERE currency = 'EUR' AND kind <> 'ar' GROUP BY ALL"
STEPS["ob_due"] = "SELECT company_id, CAST(date_trunc('month', due_on) AS DATE) AS month, sum(delta) AS operating_due FROM ob_running WHERE currency = 'EUR' AND kind = 'operating_ap' AND (ord = 0 OR (adjusts AND day <= due_on)) GROUP BY ALL"
STEPS["ob_problems"] = """SELECT company_id, reason, min(since) AS since FROM (SELECT company_id, 'role_unverified' AS reason, effective_from AS since FROM legal WHERE NOT role_verified UNION ALL SELECT company_id, 'due_date_unknown', effective_from FROM legal WHERE due_on IS NULL UNION ALL SELECT company_id, 'fx_missing', effective_from FROM legal WHERE currency <> 'EUR'
    UNION ALL SELECT company_id, 'allocation_conflict', day FROM ob_running WHERE unstated OR running < 0) GROUP BY ALL"""
STEPS["obligation_panel"] = f"""SELECT g.company_id, g.month, {', '.join(f'coalesce({c}, 0) AS {c}' for c in [*(f"unpaid_{k}" for k in G.KINDS), "unpaid_due", "not_due", "overdue", "weighted", "late_over_30", "newly_late", "paid", "paid_late", "operating_due", *(f"age_{a}" for a, _ in G.AGES)])}, coalesce(service, 0) / 3.0::DOUBLE AS next_service_mean, earliest_due,
    (SELECT coalesce(sum(written), 0) FROM ob_flows w WHERE w.company_id = g.company_id AND w.month <= g.month) AS written_off, coalesce((SELECT string_agg(reason, ',' ORDER BY reason) FROM ob_problems p WHERE p.company_id = g.company_id AND date_trunc('month', p.since) <= g.month), '') AS reasons
    FROM grid g LEFT JOIN ob_stocks s USING (company_id, month) LEFT JOIN ob_flows f USING (company_id, month) LEFT JOIN ob_due d USING (company_id, month)"""
_OB = [*(f"unpaid_{k}" for k in G.KINDS), "unpaid_due", "not_due", "overdue", "weighted", "late_over_30", "newly_late", "paid", "paid_late", "operating_due", *(f"age_{a}" for a, _ in G.AGES), "next_service_mean", "written_off"]


def obligation_panel(l: Ledger) -> DataFrame:
    return G.obligation_months(company_months(l.companies, FIRST_MONTH, LAST_MONTH), G.legal_obligations(l.obligations), G.deduplicated(l.settlements, ["allocation_id"]), l.amendments, FIRST_MONTH, LAST_MONTH)


@query(f"SELECT company_id, month, earliest_due, reasons, reasons = '' AS is_complete, {', '.join(f'round(CAST({c} AS DOUBLE), {4 if c == "weighted" else 2}) AS {c}' for c in _OB)} FROM obligation_panel")
def e07_obligation_months(t: Treasury) -> DataFrame:
    return obligation_panel(Ledger(t)).select("company_id", "month", "earliest_due", joined(F.col("reasons")).alias("reasons"), "is_complete", *(F.round(F.col(c).cast("double"), 4 if c == "weighted" else 2).alias(c) for c in _OB))
