"""Registered queries of audits and batch reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from florin.operators import arrears as A
from florin.operators import audit as Q
from florin.operators import cash as K
from florin.operators import cleaning as C
from florin.plans import arrears_queries, cash_queries
from florin.plans.queries import LAST_DAY, _perimeter, _tx, money, query
from florin.sources.treasury import ANCHOR_DAY, FIRST_MONTH, Treasury


@query("""SELECT 'o_orderpriority' AS "column", count(*) AS n FROM orders WHERE try_cast(o_orderpriority AS BIGINT) IS NULL AND trim(o_orderpriority) <> '' HAVING count(*) > 0""")
def s04_cast_failures(t: Treasury) -> DataFrame:
    text = t.raw("orders").select(F.col("o_orderkey").cast("string").alias("o_orderkey"), "o_orderpriority")
    return C.cast_failure_counts(C.typed(text, {"o_orderkey": "long", "o_orderpriority": "long"}))


@query("""SELECT step, count(*) AS n, round(sum(abs(amount)), 2) AS amount FROM (SELECT amount, CASE WHEN month IS NULL THEN 'no_valid_date' WHEN is_open_month THEN 'open_month' WHEN NOT is_booked THEN 'not_booked' WHEN product_source = 'orphan' THEN 'orphan' WHEN product_source = 'debt' THEN 'debt_product' WHEN product_type NOT IN ('checking', 'saving', 'wallet') THEN 'other_account'
    WHEN amount_eur IS NULL THEN 'no_eur' ELSE 'in_perimeter' END AS step FROM tx) GROUP BY step""")
def q04_disposition(t: Treasury) -> DataFrame:
    return Q.disposition(_tx(t), K.CASH).select("step", "n", *money("amount"))


@query("SELECT company_id, month, round(sum(amount_eur) FILTER (amount_eur > 0), 2) AS gross_in, round(sum(-amount_eur) FILTER (amount_eur < 0), 2) AS gross_out, count(*) FILTER (amount_eur IS NULL) AS n_unknown FROM tx GROUP BY ALL")
def q03_gross_exposure(t: Treasury) -> DataFrame:
    return Q.gross_exposure(_tx(t)).select("company_id", "month", *money("gross_in", "gross_out"), "n_unknown")


@query("""SELECT CASE WHEN gap IS NULL THEN 'single' WHEN gap <= 7 THEN '7' WHEN gap <= 30 THEN '30' WHEN gap <= 90 THEN '90' ELSE 'over_90' END AS longest_gap, count(*) AS n_products FROM (SELECT product_id, max(gap) AS gap FROM (SELECT product_id, date_diff('day', lag(date_ok) OVER (PARTITION BY product_id ORDER BY date_ok), date_ok) AS gap FROM tx WHERE date_ok IS NOT NULL) GROUP BY product_id) GROUP BY ALL""")
def q05_gap_histogram(t: Treasury) -> DataFrame:
    return Q.gap_histogram(_tx(t))


@query("SELECT transaction_id, company_id, month, round(amount_eur, 2) AS amount_eur, CASE WHEN category_norm IN ('cash_withdrawal', 'pos_withdrawal') THEN 'operating_out' ELSE 'ambiguous' END AS resolved_class, CASE WHEN category_norm IN ('cash_withdrawal', 'pos_withdrawal') THEN 'R1' END AS rule FROM perimeter WHERE is_cash AND flow_class = 'transfer'")
def t06_transfer_scope(t: Treasury) -> DataFrame:
    return Q.transfer_scope(_perimeter(t)).withColumn("amount_eur", F.round("amount_eur", 2))


@query("SELECT month, count(*) AS n, count(*) FILTER (r) AS n_resolved, round(coalesce(sum(abs(amount_eur)) FILTER (r), 0), 2) AS resolved_eur, round(sum(abs(amount_eur)), 2) AS all_eur FROM (SELECT *, coalesce(category_norm IN ('cash_withdrawal', 'pos_withdrawal'), false) AS r FROM perimeter WHERE is_cash AND flow_class = 'transfer') GROUP BY month")
def t04_resolution_coverage(t: Treasury) -> DataFrame:
    return Q.resolution_coverage(Q.transfer_scope(_perimeter(t))).select("month", "n", "n_resolved", *money("resolved_eur", "all_eur"))


@query("SELECT group_id, CASE WHEN place <= 0.6 THEN 'develop' WHEN place <= 0.8 THEN 'select' ELSE 'test' END AS part FROM (SELECT group_id, row_number() OVER (ORDER BY sha256('split:' || group_id), group_id) / count(*) OVER () AS place FROM (SELECT DISTINCT group_id FROM companies))")
def v02_group_split(t: Treasury) -> DataFrame:
    return Q.group_split(t.companies, "split")


@query("SELECT confidence, count(DISTINCT company_id) AS n_companies, count(*) AS n_months FROM (SELECT *, CASE WHEN known + holes <= 0 THEN 'none' WHEN holes / (known + holes) <= 0.05 THEN 'high' WHEN holes / (known + holes) <= 0.25 THEN 'medium' WHEN holes / (known + holes) <= 0.5 THEN 'low' ELSE 'none' END AS confidence FROM forward) GROUP BY confidence")
def l07_coverage(t: Treasury) -> DataFrame:
    return Q.coverage(K.forward_position(K.cash_flows(cash_queries._tx(t), "month")))


@query("""SELECT month, count(*) AS n, round(median(balance - position), 4) AS median_level_gap, round(max(abs(fc - bc)), 2) AS max_change_gap FROM (SELECT f.month, position, balance, fc, bc FROM (SELECT company_id, month, position, position - lag(position) OVER (PARTITION BY company_id ORDER BY month) AS fc FROM forward) f
    JOIN (SELECT company_id, month, balance, balance - lag(balance) OVER (PARTITION BY company_id ORDER BY month) AS bc FROM back_rows) b USING (company_id, month) WHERE balance IS NOT NULL) GROUP BY month""")
def l05_forward_backward(t: Treasury) -> DataFrame:
    tx = cash_queries._tx(t)
    back = K.backward_balance(K.cash_flows(tx, "month", K.ANCHORED), cash_queries._anchor(t), t.companies, FIRST_MONTH, ANCHOR_DAY)
    return K.forward_backward_difference(K.forward_position(K.cash_flows(tx, "month")), back).select("month", "n", F.round("median_level_gap", 4).alias("median_level_gap"), *money("max_change_gap"))


@query(f"""SELECT company_id, round(min(balance), 2) AS lowest, min(day) FILTER (balance < 0) AS first_shortfall, round(greatest(0, -min(balance)), 2) AS funding_needed, CAST(sum(n_unknown) AS BIGINT) AS n_unknown FROM (SELECT m.company_id, day, n_unknown, anchor + sum(coalesce(net, 0)) OVER (PARTITION BY m.company_id ORDER BY day) AS balance FROM (SELECT company_id, greatest(due, DATE '2001-08-01') AS day,
    sum(CASE WHEN side = 'ar' THEN eur ELSE -eur END) AS net, count(*) FILTER (eur IS NULL) AS n_unknown FROM payables WHERE issued <= DATE '{LAST_DAY}' AND (paid IS NULL OR paid > DATE '{LAST_DAY}') AND due <= DATE '{LAST_DAY}' + 90 GROUP BY ALL) m JOIN anchor_of USING (company_id) WHERE anchor IS NOT NULL) GROUP BY company_id""")
def k04_committed_path(t: Treasury) -> DataFrame:
    rows = A.payables(arrears_queries._inv(t).where(F.col("issuance_date_ok") <= F.lit(LAST_DAY).cast("date")))
    live = rows.where(F.col("paid").isNull() | (F.col("paid") > F.lit(LAST_DAY).cast("date")))
    return Q.committed_path(live, cash_queries._anchor(t), LAST_DAY).select("company_id", *money("lowest", "funding_needed"), "first_shortfall", "n_unknown")
