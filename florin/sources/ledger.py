"""Evidence records over the treasury views: accounts, statements, movements, balance anchors, obligations, settlements and amendments, with the faults that such records have.

The texts run in Spark and in DuckDB alike; every table reads the ones named in its FROM.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from florin.sources.treasury import Treasury

RECORDS = {
    "ledger_keys": "SELECT product_id, company_id, type, currency, CAST(split_part(product_id, '_', 2) AS BIGINT) AS k, CASE WHEN type = 'saving' THEN 1 ELSE 0 END AS i FROM banking_products WHERE type IN ('checking', 'saving')",
    "ledger_accounts": "SELECT product_id AS account_id, company_id, currency FROM ledger_keys",
    # statements of 61 days: some missing, some overlapping, incomplete, late, unverified, sent twice, or sent twice with another end
    "statements": """SELECT concat('S_', product_id, '_', CAST(s AS STRING)) AS coverage_id, product_id AS account_id, DATE '1999-08-01' + CAST(s * 61 AS INT) AS from_day, DATE '1999-08-01' + CAST(s * 61 + 61 + CASE WHEN k % 4 = 0 THEN 5 ELSE 0 END + CASE WHEN (k + s) % 43 = 0 AND copy = 1 THEN 10 ELSE 0 END AS INT) AS to_day,
        (k + s) % 37 <> 0 AS is_complete, CASE WHEN (k + s) % 47 <> 0 THEN DATE '1999-08-01' + CAST(s * 61 + 61 + (k * 5 + s) % 20 + CASE WHEN (k + s) % 19 = 0 THEN 200 ELSE 0 END AS INT) END AS known_on, CASE WHEN (k + s * 2) % 41 = 0 THEN 'assumed' ELSE 'verified' END AS basis
        FROM ledger_keys CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9), (10), (11)) AS n(s) CROSS JOIN (VALUES (0), (1)) AS c(copy) WHERE (k * 7 + s * 3 + i) % 23 <> 0 AND (copy = 0 OR (k + s) % 11 = 0 OR (k + s) % 43 = 0)""",
    "ledger_movements": """SELECT transaction_id AS movement_id, product_id AS account_id, company_id, date AS booked_on, CAST(amount AS DECIMAL(18, 2)) AS amount, CASE WHEN status = 'booked' THEN 'booked' WHEN amount > 40000 THEN 'unknown' ELSE 'pending' END AS booking,
        date + CAST(length(transaction_id) % 9 AS INT) AS known_on, 'verified' AS basis FROM transactions WHERE product_id LIKE 'P0%' OR product_id LIKE 'P1%'""",
    "anchor_keys": """SELECT concat('A_', product_id, '_', CAST(q AS STRING)) AS anchor_id, product_id AS account_id, k, q, DATE '1999-08-01' + CAST(q * 92 AS INT) AS measured_on, CASE WHEN (k + q) % 12 = 3 THEN 'unknown' WHEN (k + q) % 4 = 0 THEN 'closing' ELSE 'opening' END AS semantics
        FROM ledger_keys CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8)) AS n(q) WHERE (k + q * 5) % 17 <> 0""",
    # what the account really held, but for some wrong by five units and some by a cent
    "anchors": """SELECT a.anchor_id, a.account_id, a.measured_on, a.semantics, CAST((a.k * 997) % 100000 AS DECIMAL(18, 2)) + coalesce(sum(m.amount), CAST(0 AS DECIMAL(18, 2))) + CASE WHEN (a.k + a.q) % 10 = 0 THEN CAST(5 AS DECIMAL(18, 2)) WHEN (a.k + a.q) % 15 = 1 THEN CAST(0.01 AS DECIMAL(18, 2)) ELSE CAST(0 AS DECIMAL(18, 2)) END AS amount,
        (a.k + a.q) % 5 <> 2 AS is_independent, a.measured_on + CAST((a.k + a.q) % 10 AS INT) AS known_on, CASE WHEN (a.k + a.q) % 29 = 0 THEN 'assumed' ELSE 'verified' END AS basis
        FROM anchor_keys a LEFT JOIN ledger_movements m ON m.account_id = a.account_id AND m.booking = 'booked' AND m.booked_on < a.measured_on + CASE WHEN a.semantics = 'closing' THEN 1 ELSE 0 END GROUP BY a.anchor_id, a.account_id, a.measured_on, a.semantics, a.k, a.q""",
    "obligation_keys": """SELECT o.operation_id, CAST(split_part(o.operation_id, '_', 2) AS BIGINT) AS k, o.company_id, o.issuance_date AS issued, o.due_date, CASE WHEN o.currency = 'EUR' THEN 'EUR' ELSE 'USD' END AS currency, CAST(abs(o.amount) AS DECIMAL(18, 2)) AS face FROM invoices o WHERE o.issuance_date >= DATE '1999-01-01'""",
    # two versions of some; the balance of a renegotiated one goes on under another identity
    "obligations": """SELECT operation_id AS obligation_id, v AS version, company_id, CASE k % 5 WHEN 0 THEN 'ar' WHEN 1 THEN 'financial_principal' WHEN 2 THEN 'financial_interest' WHEN 3 THEN 'other_payable' ELSE 'operating_ap' END AS kind, currency, face, CASE WHEN k % 71 <> 0 THEN due_date END AS due_on,
        issued + CAST(v * 30 AS INT) AS effective_from, k % 67 <> 0 AS role_verified FROM obligation_keys CROSS JOIN (VALUES (0), (1)) AS n(v) WHERE v = 0 OR k % 9 = 0
        UNION ALL SELECT concat(operation_id, '_R'), 0, company_id, CASE k % 5 WHEN 0 THEN 'ar' WHEN 1 THEN 'financial_principal' WHEN 2 THEN 'financial_interest' WHEN 3 THEN 'other_payable' ELSE 'operating_ap' END, currency, CAST(face * 0.5 AS DECIMAL(18, 2)), due_date + 120, issued + 25, k % 67 <> 0 FROM obligation_keys WHERE k % 61 = 0""",
    # up to two payments each; some in excess, some without a stated allocation, some recorded twice, the same or with other amounts
    "settlements": """SELECT concat(operation_id, '_', CAST(p AS STRING)) AS allocation_id, operation_id AS obligation_id, issued + CAST(CASE p WHEN 0 THEN 40 + k % 50 ELSE 95 + k % 90 END AS INT) AS paid_on, CAST(face * CASE WHEN k % 83 = 0 AND p = 1 THEN 0.9 WHEN p = 0 THEN 0.4 ELSE 0.55 + (k % 3) * 0.025 END + CASE WHEN copy = 1 AND k % 31 = 0 THEN 1 ELSE 0 END AS DECIMAL(18, 2)) AS amount,
        CASE WHEN k % 73 = 0 THEN 'oldest_due_assumed' ELSE 'explicit' END AS policy FROM obligation_keys CROSS JOIN (VALUES (0), (1)) AS n(p) CROSS JOIN (VALUES (0), (1)) AS c(copy) WHERE k % 61 <> 0 AND k % 6 > p AND (copy = 0 OR k % 29 = 0 OR k % 31 = 0)""",
    "amendments": """SELECT concat('AM_', operation_id, '_', kind) AS amendment_id, operation_id AS obligation_id, kind, issued + CAST(days AS INT) AS effective_on, CAST(face * part AS DECIMAL(18, 2)) AS amount FROM obligation_keys
        CROSS JOIN (VALUES ('cancel', 20, 0.1, 47), ('reverse', 60, 0.05, 53), ('writeoff', 70, 0.03, 59), ('renegotiate', 25, 0.5, 61)) AS n(kind, days, part, every) WHERE k % every = 0""",
    "ledger_cash": """SELECT company_id, CAST(date_trunc('month', booked_on) AS DATE) AS month, sum(CASE WHEN amount > 0 THEN amount ELSE 0 END) AS inflow, sum(CASE WHEN amount < 0 THEN -amount ELSE 0 END) AS outflow, count(*) AS n FROM ledger_movements WHERE booking = 'booked' GROUP BY company_id, CAST(date_trunc('month', booked_on) AS DATE)""",
    # a month's share of outflow in hundredths, its mean with the month before, and whether the next active month flows out; some are not known
    "scored_months": """SELECT x.company_id, c.group_id, month, CASE WHEN n % 7 <> 0 OR n < 7 THEN p END AS last, (p + coalesce(before, p)) / 2 AS mean, label FROM (SELECT company_id, month, n, p, lag(p) OVER (PARTITION BY company_id ORDER BY month) AS before, CASE WHEN lead(month) OVER (PARTITION BY company_id ORDER BY month) IS NOT NULL THEN CASE WHEN lead(outflow) OVER (PARTITION BY company_id ORDER BY month) > lead(inflow) OVER (PARTITION BY company_id ORDER BY month) THEN 1 ELSE 0 END END AS label
        FROM (SELECT *, floor(CAST(outflow AS DOUBLE) / CAST(inflow + outflow AS DOUBLE) * 100) / 100 AS p FROM ledger_cash) y) x JOIN companies c ON c.company_id = x.company_id""",
    "origins": """SELECT company_id, sign, month, CAST(month + INTERVAL 1 MONTH AS DATE) + CAST(n % 5 AS INT) AS issued_on, CASE WHEN n % 5 <> 4 THEN CASE WHEN sign = 'deterioration' THEN p ELSE 1 - p END END AS probability, CASE WHEN n % 13 <> 12 THEN 50.0 END AS headline, inflow + outflow > 20000 AS is_eligible
        FROM (SELECT *, floor(CAST(outflow AS DOUBLE) / CAST(inflow + outflow AS DOUBLE) * 100) / 100 AS p FROM ledger_cash) x CROSS JOIN (VALUES ('deterioration'), ('improvement')) AS s(sign)""",
}


class Ledger:
    """The records as DataFrames; nothing is read before a query runs."""

    def __init__(self, treasury: Treasury):
        self._treasury = treasury
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in RECORDS:
            return getattr(self._treasury, name)
        if name not in self._made:
            text = RECORDS[name]
            needed = {n for n in re.findall(r"(?:FROM|JOIN)\s+([a-z_]+)", text)}
            for n in needed:
                text = re.sub(rf"((?:FROM|JOIN)\s+){n}\b", rf"\1{{{n}}}", text)
            self._made[name] = self._treasury.spark.sql(text, **{n: getattr(self, n) for n in needed})
        return self._made[name]
