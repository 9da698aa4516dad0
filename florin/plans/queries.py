"""Registered treasury queries with their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from florin.functions.core import deficit_state
from florin.operators import cleaning as C
from florin.operators import flows as W
from florin.operators import marts as M
from florin.sources.treasury import FIRST_MONTH, LAST_MONTH, OPEN_MONTH, ORACLE, Treasury

LAST_DAY = "2001-07-31"
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}

#: Oracle definitions beyond the raw tables, in order of dependence.
STEPS = dict(ORACLE)
STEPS["products"] = "SELECT product_id, 'banking' AS src, type, currency FROM banking_products UNION ALL SELECT product_id, 'debt', type, currency FROM debt_products"
STEPS["tx"] = """SELECT t.*, coalesce(p.src, 'orphan') AS product_source, lower(trim(p.type)) AS product_type, upper(trim(p.currency)) AS product_currency,
    CASE WHEN t.date >= DATE '1990-01-01' AND t.date < DATE '2031-01-01' THEN t.date END AS date_ok, CAST(date_trunc('month', t.date) AS DATE) AS month, date_trunc('month', t.date) >= DATE '2001-08-01' AS is_open_month,
    CASE WHEN t.status IS NULL OR trim(t.status) = '' THEN 'unknown' ELSE lower(trim(t.status)) END AS status_norm, coalesce(lower(trim(t.status)) = 'booked', false) AS is_booked,
    CASE WHEN t.category IS NULL OR trim(t.category) IN ('', '-') THEN NULL ELSE lower(trim(t.category)) END AS category_norm,
    CASE WHEN t.amount > 0 THEN 'in' WHEN t.amount < 0 THEN 'out' WHEN t.amount = 0 THEN 'zero' END AS direction,
    CASE WHEN p.currency IS NULL THEN NULL WHEN p.currency = 'EUR' THEN t.amount WHEN t.exchange_rate IS NULL OR t.exchange_rate <= 0 OR t.exchange_rate = 1 THEN NULL ELSE t.amount / t.exchange_rate END AS amount_eur,
    (p.currency <> 'EUR' AND t.exchange_rate = 1) AS fx_ambiguous
    FROM transactions t LEFT JOIN products p ON p.product_id = t.product_id"""
STEPS["inv"] = """SELECT i.*, lower(trim(status)) AS status_norm, CASE WHEN i.amount > 0 THEN 'inflow' WHEN i.amount < 0 THEN 'outflow' WHEN i.amount = 0 THEN 'zero' END AS flow_side,
    CAST(date_trunc('month', issuance_date) AS DATE) AS month, date_trunc('month', issuance_date) >= DATE '2001-08-01' AS is_open_month,
    CASE WHEN currency = accounting_currency THEN amount WHEN exchange_rate > 0 AND exchange_rate <> 1 THEN amount / exchange_rate END AS amount_acct,
    CASE WHEN currency = 'EUR' THEN amount WHEN accounting_currency = 'EUR' AND exchange_rate > 0 AND exchange_rate <> 1 THEN amount / exchange_rate END AS amount_eur,
    CASE WHEN status = 'paid' AND payment_date >= issuance_date AND coalesce(pending_amount, 0) = 0 THEN payment_date END AS settlement_date, CASE WHEN due_date >= issuance_date THEN due_date END AS maturity_date
    FROM invoices i"""
_IN, _OUT, _REF, _FIN = (", ".join(f"'{x}'" for x in xs) for xs in (W.INCOME, W.EXPENSE, W.REFUND, W.DEBT_SERVICE))
_CLASS = f"""CASE WHEN {{c}} IN ({_IN}) THEN 'operating_in' WHEN {{c}} IN ({_OUT}) THEN 'operating_out' WHEN {{c}} IN ({_REF}) THEN CASE WHEN direction = 'in' THEN 'operating_in' ELSE 'operating_out' END
    WHEN {{c}} IN ({_FIN}) THEN 'financing_out' WHEN {{c}} = 'investment_return' THEN 'investment_in' WHEN {{c}} = 'investment_deployment' THEN 'investment_out' WHEN {{c}} IN ('transfer', 'cash_withdrawal', 'pos_withdrawal') THEN 'transfer' WHEN {{c}} IS NOT NULL THEN 'unknown' END"""
STEPS["patterned"] = "SELECT *, regexp_replace(upper(trim(coalesce(description, ''))), '[0-9]+', '#', 'g') AS pattern FROM tx"
STEPS["learned"] = """SELECT s.transaction_id, min(e.category_norm) AS learned, max(e.first_month) AS evidence_month FROM patterned s
    JOIN (SELECT company_id, direction, pattern, category_norm, min(month) AS first_month FROM patterned WHERE NOT is_open_month AND is_booked AND category_norm IS NOT NULL GROUP BY ALL) e
    ON e.company_id = s.company_id AND e.direction = s.direction AND e.pattern = s.pattern AND e.first_month < s.month WHERE s.category_norm IS NULL AND s.pattern <> '' GROUP BY s.transaction_id HAVING count(DISTINCT e.category_norm) = 1"""
_DESC_HITS = [
    ("(" + " OR ".join(f"upper(trim(description)) LIKE '{like}'" for like in likes) + ")" + (f" AND direction = '{needed}'" if needed else ""), rule, flow_class)
    for rule, flow_class, likes, needed in W.DESCRIPTION_RULES
]
_DESC_RULE, _DESC_CLASS = ("CASE " + " ".join(f"WHEN {hit[0]} THEN '{hit[k]}'" for hit in _DESC_HITS) + " END" for k in (1, 2))
STEPS["staged"] = f"""SELECT p.*, l.learned, l.evidence_month, CASE WHEN category_norm IS NULL AND learned IS NULL THEN {_DESC_RULE} END AS desc_rule,
    coalesce({_CLASS.format(c='coalesce(category_norm, learned)')}, {_DESC_CLASS}, 'unknown') AS class0 FROM patterned p LEFT JOIN learned l USING (transaction_id)"""
STEPS["classified"] = f"""SELECT *, CASE WHEN ends_with(class0, '_in') OR ends_with(class0, '_out') THEN CASE WHEN direction IN ('in', 'out') THEN split_part(class0, '_', 1) || '_' || direction ELSE 'unknown' END ELSE class0 END AS flow_class,
    CASE WHEN category_norm IN ({_IN}, {_OUT}, {_REF}, {_FIN}, 'investment_return', 'investment_deployment', 'transfer', 'cash_withdrawal', 'pos_withdrawal') THEN 'cat:' || category_norm WHEN category_norm IS NOT NULL THEN 'cat:no_mapeada'
        WHEN learned IS NOT NULL THEN 'transf:' || learned ELSE coalesce(desc_rule, 'unknown') END AS rule_id,
    CASE WHEN category_norm IS NOT NULL THEN 'category' WHEN learned IS NOT NULL THEN 'transferida' WHEN desc_rule IS NOT NULL THEN 'rule' END AS flow_source, abs(amount_eur) >= 1e7 AS is_outlier,
    coalesce((ends_with(class0, '_in') AND direction <> 'in') OR (ends_with(class0, '_out') AND direction <> 'out'), false) AS direction_conflict FROM staged"""
STEPS["grid"] = "SELECT company_id, group_id, month, month_end AS available_at FROM companies CROSS JOIN months"
STEPS["perimeter"] = """SELECT *, coalesce(product_source = 'banking' AND product_type IN ('checking', 'saving', 'wallet'), false) AS is_cash, flow_class IN ('unknown', 'transfer', 'non_economic') AND direction IS DISTINCT FROM 'zero' AS is_ambiguous
    FROM classified WHERE is_booked AND NOT is_open_month AND month BETWEEN DATE '1999-08-01' AND DATE '2001-07-01'"""
STEPS["flow_months"] = """SELECT company_id, month, count(*) AS n_tx, count(*) FILTER (is_cash) AS n_cash, count(*) FILTER (is_cash AND amount_eur IS NULL) AS n_without_eur, count(*) FILTER (is_cash AND is_ambiguous) AS n_ambiguous,
    count(*) FILTER (is_cash AND is_ambiguous AND coalesce(direction = 'in', true)) AS n_ambiguous_in, count(*) FILTER (is_cash AND is_ambiguous AND coalesce(direction = 'out', true)) AS n_ambiguous_out,
    count(*) FILTER (is_cash AND (flow_class IN ('operating_in', 'operating_out') OR is_ambiguous) AND amount_eur IS NULL) AS n_hole, count(*) FILTER (is_cash AND flow_class = 'operating_in' AND amount_eur IS NULL) AS n_rec_hole, count(*) FILTER (is_cash AND flow_class = 'operating_out' AND amount_eur IS NULL) AS n_pay_hole,
    coalesce(sum(amount_eur) FILTER (is_cash), 0) AS net_known, coalesce(sum(abs(amount_eur)) FILTER (is_cash), 0) AS volume_known, coalesce(sum(abs(amount_eur)) FILTER (is_cash AND flow_class = 'operating_in'), 0) AS rec, coalesce(sum(abs(amount_eur)) FILTER (is_cash AND flow_class = 'operating_out'), 0) AS pay,
    coalesce(sum(abs(amount_eur)) FILTER (is_cash AND is_ambiguous AND direction = 'in'), 0) AS amb_in, coalesce(sum(abs(amount_eur)) FILTER (is_cash AND is_ambiguous AND direction = 'out'), 0) AS amb_out FROM perimeter GROUP BY ALL"""
STEPS["flow_panel"] = """SELECT g.*, coalesce(n_cash, 0) > 0 AS act, coalesce(n_tx, 0) AS n_tx0, coalesce(n_cash, 0) AS n_cash0, f.* EXCLUDE (company_id, month),
    min(CASE WHEN n_cash > 0 THEN g.month END) OVER w AS first_cash_month, count(CASE WHEN n_cash > 0 THEN 1 END) OVER w AS active_months FROM grid g LEFT JOIN flow_months f USING (company_id, month) WINDOW w AS (PARTITION BY g.company_id ORDER BY g.month ROWS UNBOUNDED PRECEDING)"""
STEPS["universe"] = """SELECT company_id, counterparty_id, issuance_date AS issued, maturity_date AS due, settlement_date AS settled, coalesce(status_norm = 'unknown' OR (status_norm = 'paid' AND settlement_date IS NULL) OR (status_norm <> 'paid' AND abs(pending_amount) < abs(amount)), false) AS is_uncertain,
    CASE WHEN amount > 0 THEN 'ar' WHEN amount < 0 THEN 'ap' END AS side, amount_eur AS eur FROM inv WHERE status_norm <> 'cancel' AND document_type = 'invoice'"""
STEPS["open_rows"] = "SELECT u.*, m.month, m.month_end, date_diff('day', u.due, m.month_end) AS days_overdue FROM universe u JOIN months m ON u.issued <= m.month_end AND (u.settled IS NULL OR u.settled > m.month_end)"


def _with(sql: str) -> str:
    """The query behind the definitions it needs."""
    import re

    needed: list[str] = []

    def visit(text: str) -> None:
        for name in STEPS:
            if name not in needed and re.search(rf"(FROM|JOIN)\s+{name}\b", text):
                visit(STEPS[name])
                needed.append(name)

    visit(sql)
    if not needed:
        return sql
    return "WITH " + ", ".join(f"{n} AS ({STEPS[n]})" for n in dict.fromkeys(needed)) + " " + sql


def query(sql: str | None = None):
    """Register a function of the Treasury under its own name, with its oracle."""

    def add(f: Callable[[Treasury], DataFrame]):
        _QUERIES[f.__name__] = lambda spark, folder: f(Treasury(spark, folder))
        if sql is not None:
            _ORACLES[f.__name__] = _with(sql)
        return f

    return add


def _tx(t: Treasury) -> DataFrame:
    return C.clean_transactions(t.transactions, t.banking_products, t.debt_products, OPEN_MONTH)


def _inv(t: Treasury) -> DataFrame:
    return C.clean_invoices(t.invoices, OPEN_MONTH)


def _perimeter(t: Treasury) -> DataFrame:
    """Earlier months are evidence of categories only, so they are left out before movements meet their products."""
    asked = M.closed_movements(W.with_learned(C.normal_movements(t.transactions, OPEN_MONTH)), FIRST_MONTH, LAST_MONTH)
    return M.cash_perimeter(W.classified(C.with_products(asked, t.banking_products, t.debt_products)), FIRST_MONTH, LAST_MONTH)


def _kept_perimeter(t: Treasury) -> DataFrame:
    """The columns that the panels read, kept for the queries that read them more than once."""
    return _perimeter(t).select("company_id", "month", "product_id", "direction", "amount_eur", "product_source", "flow_class", "rule_id", "is_outlier", "direction_conflict", "is_cash", "is_ambiguous").persist()


def _flows(t: Treasury) -> DataFrame:
    return M.flow_panel(M.company_months(t.companies, FIRST_MONTH, LAST_MONTH), _perimeter(t))


def _universe(t: Treasury) -> DataFrame:
    return M.invoice_universe(_inv(t))


def _open(t: Treasury) -> DataFrame:
    return M.open_at_month_ends(_universe(t), FIRST_MONTH, LAST_MONTH)


def money(*names: str):
    return [F.round(n, 2).alias(n) for n in names]


@query("""SELECT transaction_id, month, is_open_month, status_norm, category_norm, direction, product_source, product_type, product_currency, round(amount_eur, 2) AS amount_eur,
    CASE WHEN amount_eur IS NULL THEN 'unknown' WHEN product_currency = 'EUR' THEN 'identity' ELSE 'reported' END AS amount_eur_source, fx_ambiguous,
    array_to_string(list_sort(list_filter([CASE WHEN is_open_month THEN 'open_month' END, CASE WHEN trim(category) IN ('', '-') THEN 'category_missing' END, CASE WHEN exchange_rate <= 0 THEN 'fx_rate_invalid' END, CASE WHEN amount_eur IS NULL THEN 'fx_not_convertible' END, CASE WHEN product_source = 'orphan' THEN 'fk_orphan' END], lambda x: x IS NOT NULL)), ',') AS quality_flags FROM tx""")
def c03_clean_transactions(t: Treasury) -> DataFrame:
    return C.flag_text(_tx(t)).select("transaction_id", "month", "is_open_month", "status_norm", "category_norm", "direction", "product_source", "product_type", "product_currency", *money("amount_eur"), "amount_eur_source", "fx_ambiguous", "quality_flags")


@query("""SELECT operation_id, month, status_norm, flow_side, round(amount_acct, 2) AS amount_acct, round(amount_eur, 2) AS amount_eur, CASE WHEN amount_eur IS NULL THEN 'unknown' WHEN currency = 'EUR' THEN 'identity' ELSE 'reported' END AS amount_eur_source,
    CAST(date_diff('day', issuance_date, maturity_date) AS INTEGER) AS days_to_due, CAST(date_diff('day', issuance_date, settlement_date) AS INTEGER) AS days_to_payment, settlement_date AS settlement_date_ok, maturity_date AS maturity_date_ok, (currency <> accounting_currency AND exchange_rate = 1) AS fx_ambiguous FROM inv""")
def c04_clean_invoices(t: Treasury) -> DataFrame:
    return _inv(t).select("operation_id", "month", "status_norm", "flow_side", *money("amount_acct", "amount_eur"), "amount_eur_source", "days_to_due", "days_to_payment", "settlement_date_ok", "maturity_date_ok", "fx_ambiguous")


@query("""SELECT product_id, company_id, type AS type_norm, currency AS currency_norm, CASE WHEN type IN ('checking', 'saving') THEN 'cash' WHEN type = 'tpv' THEN 'collection' ELSE 'card' END AS liquidity_class FROM banking_products""")
def c09_clean_banking_products(t: Treasury) -> DataFrame:
    return C.clean_banking_products(t.banking_products)


@query("""SELECT product_id, company_id, type AS type_norm, round(abs(granted), 2) AS granted_abs, round(abs(outstanding), 2) AS outstanding_abs, CASE WHEN outstanding > 0 THEN 'positive' WHEN outstanding < 0 THEN 'negative' WHEN outstanding = 0 THEN 'zero' ELSE 'missing' END AS outstanding_sign,
    coalesce(abs(outstanding) > 0.01, false) AS is_drawn, CASE type WHEN 'loan' THEN 'term' WHEN 'leasing' THEN 'term' WHEN 'lineofcredit' THEN 'revolving' ELSE 'receivables' END AS debt_class FROM debt_products""")
def c10_clean_debt_products(t: Treasury) -> DataFrame:
    return C.clean_debt_products(t.debt_products).withColumns({c: F.round(c, 2) for c in ("granted_abs", "outstanding_abs")})


@query("""SELECT b.product_id, b.company_id, b.date, round(CASE WHEN balance <> -999999999.0 THEN balance END, 2) AS balance_ok, coalesce(p.src, 'orphan') AS product_source, p.currency AS product_currency,
    concat_ws(',', CASE WHEN p.src IS NULL THEN 'fk_orphan' END, CASE WHEN balance <= -999999999.0 OR balance >= 1000000000.0 THEN 'sentinel_hidden_balance' END) AS quality_flags FROM balances b LEFT JOIN products p ON p.product_id = b.product_id""")
def c12_clean_balances(t: Treasury) -> DataFrame:
    return C.flag_text(C.clean_balances(t.balances, t.banking_products, t.debt_products)).withColumn("balance_ok", F.round("balance_ok", 2))


@query("""SELECT flag, count(*) AS n FROM (SELECT unnest([CASE WHEN is_open_month THEN 'open_month' END, CASE WHEN trim(category) IN ('', '-') THEN 'category_missing' END, CASE WHEN exchange_rate <= 0 THEN 'fx_rate_invalid' END, CASE WHEN amount_eur IS NULL THEN 'fx_not_convertible' END,
    CASE WHEN product_source = 'orphan' THEN 'fk_orphan' END]) AS flag FROM tx) WHERE flag IS NOT NULL GROUP BY flag""")
def c14_flag_counts(t: Treasury) -> DataFrame:
    return C.flag_counts(_tx(t))


@query("""SELECT count(*) FILTER (product_source = 'orphan') AS n_orphan, count(*) FILTER (product_source <> 'orphan' AND product_currency <> 'EUR' AND (exchange_rate IS NULL OR exchange_rate <= 0)) AS n_bad_rate, count(*) FILTER (fx_ambiguous) AS n_ambiguous, count(*) FILTER (amount_eur IS NULL) AS n_unconvertible FROM tx""")
def c15_not_convertible_reasons(t: Treasury) -> DataFrame:
    known, rate = F.col("product_source") != "orphan", F.col("exchange_rate")
    return _tx(t).agg(F.count_if(~known).alias("n_orphan"), F.count_if(known & (F.col("product_currency") != "EUR") & (rate.isNull() | (rate <= 0))).alias("n_bad_rate"), F.count_if("fx_ambiguous").alias("n_ambiguous"), F.count_if(F.col("amount_eur").isNull()).alias("n_unconvertible"))


@query("SELECT transaction_id, flow_class, flow_source, rule_id, is_outlier, direction_conflict, evidence_month FROM classified")
def f07_classify_flows(t: Treasury) -> DataFrame:
    return W.classify_flows(_tx(t)).select("transaction_id", "flow_class", "flow_source", "rule_id", "is_outlier", "direction_conflict", "evidence_month")


@query("SELECT flow_class, flow_source, rule_id, count(*) AS n, count(*) FILTER (direction_conflict) AS n_conflicts FROM classified GROUP BY ALL")
def f08_flow_report(t: Treasury) -> DataFrame:
    return W.flow_report(W.classify_flows(_tx(t)))


@query("""SELECT count(*) AS n_companies, round(quantile_cont(u, 0.25), 6) AS p25, round(quantile_cont(u, 0.5), 6) AS p50, round(quantile_cont(u, 0.75), 6) AS p75, round(quantile_cont(u, 0.9), 6) AS p90, round(max(u), 6) AS max_share, count(*) FILTER (u > 0.4) AS n_over_40
    FROM (SELECT company_id, count(*) FILTER (flow_class = 'unknown') / count(*) AS u FROM classified GROUP BY company_id)""")
def f08_unknown_share(t: Treasury) -> DataFrame:
    return W.unknown_share_quantiles(W.classify_flows(_tx(t)))


@query("SELECT company_id, group_id, month, available_at FROM grid")
def m01_company_months(t: Treasury) -> DataFrame:
    return M.company_months(t.companies, FIRST_MONTH, LAST_MONTH)


@query("SELECT transaction_id, company_id, month, flow_class, is_cash, is_ambiguous FROM perimeter")
def m02_cash_transactions(t: Treasury) -> DataFrame:
    return _perimeter(t).select("transaction_id", "company_id", "month", "flow_class", "is_cash", "is_ambiguous")


@query("""SELECT company_id, month, available_at, CAST(n_tx0 AS BIGINT) AS n_tx, CAST(n_cash0 AS BIGINT) AS n_cash, act AS has_cash_activity, CAST(active_months AS BIGINT) AS active_months_so_far, CAST(date_diff('month', first_cash_month, month) AS INTEGER) AS months_observed,
    CASE WHEN act THEN round(net_known, 2) END AS net_known, CASE WHEN act AND n_without_eur = 0 THEN round(net_known, 2) END AS net_eur, CASE WHEN act AND n_rec_hole = 0 AND n_ambiguous_in = 0 THEN round(rec, 2) END AS receipts_eur, CASE WHEN act AND n_pay_hole = 0 AND n_ambiguous_out = 0 THEN round(pay, 2) END AS payments_eur,
    CASE WHEN act AND n_hole = 0 THEN round(rec - pay - amb_out, 2) END AS operating_min, CASE WHEN act AND n_hole = 0 THEN round(rec - pay + amb_in, 2) END AS operating_max, CASE WHEN act THEN round((n_cash - n_ambiguous) / n_cash, 6) END AS class_coverage, CASE WHEN act AND volume_known > 0 THEN round((amb_in + amb_out) / volume_known, 6) END AS ambiguous_share FROM flow_panel""")
def m03_flow_panel(t: Treasury) -> DataFrame:
    return _flows(t).select("company_id", "month", "available_at", "n_tx", "n_cash", "has_cash_activity", "active_months_so_far", "months_observed", *money("net_known", "net_eur", "receipts_eur", "payments_eur", "operating_min", "operating_max"), *(F.round(c, 6).alias(c) for c in ("class_coverage", "ambiguous_share")))


_DEBT = """SELECT f.company_id, f.month, act AS has_cash_activity, CAST(coalesce(d.n_service, 0) AS BIGINT) AS n_service, CASE WHEN act THEN round(d.principal, 2) END AS principal_known, CASE WHEN act THEN round(d.interest, 2) END AS interest_known, CASE WHEN act THEN round(d.refunds, 2) END AS refunds_known,
    CASE WHEN act AND d.n_hole = 0 AND d.n_other = 0 AND f.n_ambiguous_out = 0 THEN round(d.principal + d.interest, 2) END AS service_eur, round(l.net, 2) AS ledger_net_known
    FROM flow_panel f LEFT JOIN (SELECT company_id, month, coalesce(sum(abs(amount_eur)) FILTER (flow_class = 'financing_out' AND rule_id IN ('cat:debt_repayment', 'transf:debt_repayment')), 0) AS principal,
        coalesce(sum(abs(amount_eur)) FILTER (flow_class = 'financing_out' AND rule_id IN ('cat:interest_charge', 'transf:interest_charge')), 0) AS interest, coalesce(sum(amount_eur) FILTER (flow_class = 'financing_in' AND service), 0) AS refunds,
        count(*) FILTER (flow_class = 'financing_out' AND service) AS n_service, count(*) FILTER (flow_class = 'financing_out' AND service AND amount_eur IS NULL) AS n_hole, count(*) FILTER (flow_class = 'financing_out' AND NOT service) AS n_other
        FROM (SELECT *, rule_id IN ('cat:debt_repayment', 'transf:debt_repayment', 'cat:interest_charge', 'transf:interest_charge') AS service FROM perimeter) WHERE is_cash GROUP BY ALL) d USING (company_id, month)
    LEFT JOIN (SELECT company_id, month, coalesce(sum(amount_eur), 0) AS net FROM perimeter WHERE product_source = 'debt' GROUP BY ALL) l USING (company_id, month)"""


@query(_DEBT)
def m04_debt_panel(t: Treasury) -> DataFrame:
    panel = M.flow_and_debt_panel(M.company_months(t.companies, FIRST_MONTH, LAST_MONTH), _perimeter(t))
    return panel.select("company_id", "month", "has_cash_activity", F.col("n_service").cast("long").alias("n_service"), *money("principal_known", "interest_known", "refunds_known", "service_eur", "ledger_net_known"))


_AGES = ", ".join(f"round(sum(abs(eur)) FILTER (due < month_end AND days_overdue {c}), 2) AS ageing_{n}" for n, c in (("0_30", "<= 30"), ("31_60", "BETWEEN 31 AND 60"), ("61_90", "BETWEEN 61 AND 90"), ("91_180", "BETWEEN 91 AND 180"), ("181_360", "BETWEEN 181 AND 360"), ("over_360", "> 360")))


@query(f"""SELECT company_id, month, side, round(sum(abs(eur)) FILTER (NOT is_uncertain), 2) AS open_eur, count(*) FILTER (NOT is_uncertain) AS n_open, count(*) AS n_possible, count(eur) AS n_eur, round(sum(abs(eur)) FILTER (due < month_end), 2) AS overdue_eur, round(sum(abs(eur)) FILTER (days_overdue > 180), 2) AS over_180_eur, {_AGES},
    count(DISTINCT counterparty_id) AS n_counterparties FROM open_rows GROUP BY company_id, month, side""")
def m05_open_stock(t: Treasury) -> DataFrame:
    stock = M.open_stock(_open(t))
    return stock.select("company_id", "month", "side", "n_open", "n_possible", "n_eur", "n_counterparties", *money("open_eur", "overdue_eur", "over_180_eur", *(c for c in stock.columns if c.startswith("ageing_"))))


@query("""SELECT company_id, month, side, CAST(sum(i) AS BIGINT) AS n_issued, CAST(sum(s) AS BIGINT) AS n_settled, round(sum(CASE WHEN i = 1 THEN e END), 2) AS issued_eur, round(sum(CASE WHEN s = 1 THEN e END), 2) AS settled_eur FROM (SELECT company_id, CAST(date_trunc('month', issued) AS DATE) AS month, side, 1 AS i, 0 AS s, abs(eur) AS e FROM universe
    UNION ALL SELECT company_id, CAST(date_trunc('month', settled) AS DATE), side, 0, 1, abs(eur) FROM universe WHERE settled IS NOT NULL) GROUP BY ALL""")
def m05_issued_and_settled(t: Treasury) -> DataFrame:
    return M.issued_and_settled(_universe(t)).select("company_id", "month", "side", "n_issued", "n_settled", *money("issued_eur", "settled_eur"))


def _cohort(n: int) -> str:
    return f"""CASE WHEN last_day(month) + {n} <= DATE '{LAST_DAY}' AND n_eur = n_issued AND n_uncertain = 0 AND issued_eur <> 0 THEN round(r{n} / issued_eur, 6) END AS conversion_{n}d, CASE WHEN last_day(month) + {n} <= DATE '{LAST_DAY}' THEN last_day(month) + {n} END AS available_at_{n}d"""


@query(f"""SELECT company_id, month, n_issued, {_cohort(30)}, {_cohort(60)}, {_cohort(90)} FROM (SELECT company_id, CAST(date_trunc('month', issued) AS DATE) AS month, count(*) AS n_issued, count(eur) AS n_eur, count(*) FILTER (is_uncertain) AS n_uncertain, sum(abs(eur)) AS issued_eur,
    {', '.join(f"coalesce(sum(abs(eur)) FILTER (date_diff('day', issued, settled) <= {n}), 0) AS r{n}" for n in (30, 60, 90))} FROM universe WHERE side = 'ar' GROUP BY ALL)""")
def m06_receipt_cohorts(t: Treasury) -> DataFrame:
    cohorts = M.receipt_cohorts(_universe(t), LAST_DAY)
    return cohorts.select("company_id", "month", "n_issued", *(c for n in (30, 60, 90) for c in (F.round(f"conversion_{n}d", 6).alias(f"conversion_{n}d"), f"available_at_{n}d")))


@query("""SELECT company_id, month, CASE WHEN n >= 5 THEN a END AS dso_days, CASE WHEN nd >= 5 THEN b END AS median_delay_days, n AS n_settled, nd AS n_with_due FROM (SELECT company_id, m.month, median(date_diff('day', issued, settled)) AS a, median(date_diff('day', due, settled)) AS b, count(*) AS n, count(due) AS nd
    FROM universe JOIN months m ON settled >= m.month - INTERVAL 2 MONTH AND settled <= m.month_end WHERE side = 'ar' GROUP BY company_id, m.month)""")
def m07_settlement_medians(t: Treasury) -> DataFrame:
    return M.settlement_medians(_universe(t), FIRST_MONTH, LAST_MONTH)


@query("""SELECT company_id, month, round(max(e), 2) AS top1_eur, CASE WHEN sum(e) <> 0 THEN round(max(e) / sum(e), 6) END AS top1_share FROM (SELECT company_id, month, counterparty_id, sum(abs(eur)) AS e FROM open_rows WHERE side = 'ar' AND counterparty_id IS NOT NULL GROUP BY ALL) GROUP BY ALL""")
def m08_top_counterparty(t: Treasury) -> DataFrame:
    return M.top_counterparty(_open(t)).select("company_id", "month", *money("top1_eur"), F.round("top1_share", 6).alias("top1_share"))


@query("""SELECT month, side, round(sum(o), 2) AS open_eur, round(sum(v), 2) AS overdue_eur, CAST(sum(n) AS BIGINT) AS n_open, count(*) AS n_companies FROM (SELECT company_id, month, side, sum(abs(eur)) FILTER (NOT is_uncertain) AS o, sum(abs(eur)) FILTER (due < month_end) AS v, count(*) FILTER (NOT is_uncertain) AS n FROM open_rows GROUP BY ALL) GROUP BY month, side""")
def m12_side_series(t: Treasury) -> DataFrame:
    return M.side_series(M.open_stock(_open(t))).select("month", "side", *money("open_eur", "overdue_eur"), "n_open", "n_companies")


@query("""SELECT company_id, month, CASE WHEN round(rec - pay + amb_in, 2) < 0 THEN true WHEN round(rec - pay - amb_out, 2) >= 0 THEN false END AS deficit FROM flow_panel WHERE act AND n_hole = 0""")
def m14_deficit_state(t: Treasury) -> DataFrame:
    return _flows(t).where(F.col("operating_min").isNotNull()).select("company_id", "month", deficit_state(F.col("operating_min"), F.col("operating_max")).alias("deficit"))


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly net cash per company, null where a movement has no EUR amount."""
    return _flows(Treasury(spark, folder)).select("company_id", "month", "n_cash", *money("net_known", "net_eur"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
