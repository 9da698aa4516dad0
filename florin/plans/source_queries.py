"""Registered queries of sources, sinks, dimension tables and transfers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from florin.functions.core import joined
from florin.operators import ingest as I
from florin.operators import transfers as R
from florin.plans.queries import _DESC_RULE, STEPS, _perimeter, _tx, money, query
from florin.sources.files import shared_path
from florin.sources.treasury import Treasury

_KINDS = {"id": "bigint", "amount": "double", "stamp": "timestamp", "note": "string"}
_TYPED = """SELECT TRY_CAST(id AS BIGINT) AS id, TRY_CAST(amount AS DOUBLE) AS amount, strftime(coalesce(TRY_CAST(stamp AS TIMESTAMP), try_strptime(stamp, '%Y-%m-%d %H:%M:%S'), try_strptime(stamp, '%Y-%m-%d')), '%Y-%m-%d %H:%M:%S') AS stamp, note,
    concat_ws(',', CASE WHEN amount <> '' AND TRY_CAST(amount AS DOUBLE) IS NULL THEN 'amount' END, CASE WHEN id <> '' AND TRY_CAST(id AS BIGINT) IS NULL THEN 'id' END, CASE WHEN stamp <> '' AND TRY_CAST(stamp AS TIMESTAMP) IS NULL THEN 'stamp' END) AS cast_failures FROM text_rows"""
STEPS["transfer_rows"] = "SELECT * FROM perimeter WHERE is_cash AND flow_class = 'transfer'"


def _transfers(t: Treasury) -> DataFrame:
    return _perimeter(t).where("is_cash AND flow_class = 'transfer'")


def _texted(rows: DataFrame) -> DataFrame:
    return rows.select("id", "amount", F.date_format("stamp", "yyyy-MM-dd HH:mm:ss").alias("stamp"), "note", joined(F.col("cast_failures")).alias("cast_failures"))


@query("SELECT id, amount, stamp, note FROM text_rows")
def s01_csv_scan(t: Treasury) -> DataFrame:
    path = shared_path(t.spark, "orders-csv")
    t.text_rows.write.csv(path, header=True, quoteAll=True, escape='"', emptyValue="", nullValue="\\N", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return I.csv_scan(t.spark, path, list(_KINDS))


@query(_TYPED)
def s02_typed_table(t: Treasury) -> DataFrame:
    return _texted(I.typed_table(t.text_rows, _KINDS))


@query("SELECT company_id, month, round(net, 2) AS net FROM cash_months")
def s06_parquet_sink(t: Treasury) -> DataFrame:
    from florin.operators.cash import cash_flows
    from florin.plans.cash_queries import _tx as closed

    rows = cash_flows(closed(t), "month").select("company_id", "month", *money("net"))
    return I.zstd_parquet(rows, shared_path(t.spark, "monthly-flows"), ["company_id", "month"])


@query("""SELECT currency, day, rate FROM (SELECT currency, day, round(rate, 6) AS rate, date_diff('day', DATE '1995-01-01', day) AS n FROM fx_daily) WHERE n % 11 <> 0""")
def s08_long_rates(t: Treasury) -> DataFrame:
    text = F.when(F.datediff("day", F.lit("1995-01-01").cast("date")) % 11 == 0, "N/A").otherwise(F.round("rate", 6).cast("string"))
    wide = t.fx_daily.select(F.col("day").cast("string").alias("Date"), "currency", text.alias("text")).groupBy("Date").pivot("currency", ["USD", "GBP"]).agg(F.first("text")).withColumn("_c43", F.lit(""))
    return I.long_rates(wide)


@query("""SELECT 'transactions' AS table_name, (SELECT count(*) FROM lineitem) AS n_source, (SELECT count(*) FROM transactions) AS n_stored, (SELECT count(*) FROM lineitem) = (SELECT count(*) FROM transactions) AS equal
    UNION ALL SELECT 'invoices', (SELECT count(*) FROM orders), (SELECT count(*) FROM inv), (SELECT count(*) FROM orders) = (SELECT count(*) FROM inv) UNION ALL SELECT 'companies', (SELECT count(*) FROM customer), (SELECT count(*) FROM companies), (SELECT count(*) FROM customer) = (SELECT count(*) FROM companies)""")
def s11_record_counts(t: Treasury) -> DataFrame:
    source = {"transactions": t.raw("lineitem"), "invoices": t.raw("orders"), "companies": t.raw("customer")}
    return I.record_counts({"transactions": t.transactions, "invoices": t.invoices, "companies": t.companies}, source)


@query("""SELECT company_id, count(*) AS n_points, '[' || string_agg('{"month":"' || strftime(month, '%Y-%m-%d') || '","n_movements":' || n_movements || ',"net_cents":' || CAST(round(net * 100) AS BIGINT) || '}', ',' ORDER BY month) || ']' AS points FROM cash_months GROUP BY company_id""")
def s12_nested_profiles(t: Treasury) -> DataFrame:
    from florin.operators.cash import cash_flows
    from florin.plans.cash_queries import _tx as closed

    points = cash_flows(closed(t), "month").select("company_id", "month", "n_movements", F.round(F.col("net") * 100).cast("long").alias("net_cents"))
    return I.nested_profiles(points, "company_id", "month")


@query("""SELECT g.group_id, lower(erp) AS erp_norm, coalesce(n, 0) AS n_companies, CASE WHEN coalesce(n, 0) <= 0 THEN 'amount_missing' ELSE '' END AS quality_flags FROM groups g LEFT JOIN (SELECT group_id, count(*) AS n FROM companies GROUP BY group_id) USING (group_id)""")
def c07_clean_groups(t: Treasury) -> DataFrame:
    sizes = t.companies.groupBy("group_id").agg(F.count("*").alias("n_companies"))
    groups = t.groups.join(sizes, "group_id", "left").withColumn("n_companies", F.coalesce("n_companies", F.lit(0)))
    return I.clean_groups(groups).withColumn("quality_flags", joined(F.col("quality_flags")))


@query("""SELECT company_id, group_id, CASE trim(country) WHEN 'España' THEN 'ES' WHEN 'spain' THEN 'ES' WHEN 'pt' THEN 'PT' WHEN 'Alemania' THEN 'DE' WHEN 'Malaysia' THEN 'MY' END AS country_norm, currency AS currency_norm,
    CASE WHEN trim(country) = 'Atlantis' THEN 'country_unknown' WHEN trim(country) <> '' THEN 'country_normalized' ELSE '' END AS quality_flags FROM companies""")
def c08_clean_companies(t: Treasury) -> DataFrame:
    return I.clean_companies(t.companies).withColumn("quality_flags", joined(F.col("quality_flags")))


@query("""SELECT s.product_id, s.company_id, CASE WHEN next_payment_date < DATE '2031-01-01' THEN next_payment_date END AS next_payment_date_ok, CASE WHEN annual_rate >= 0 AND annual_rate <= 0.5 THEN round(annual_rate, 4) END AS interest_rate_ok, b.product_id IS NOT NULL AS settlement_product_found,
    concat_ws(',', CASE WHEN annual_rate < 0 OR annual_rate > 0.5 THEN 'amount_extreme' END, CASE WHEN total_periods <= 0 OR total_periods > 600 THEN 'amount_missing' END, CASE WHEN next_payment_date >= DATE '2031-01-01' THEN 'date_out_of_range' END, CASE WHEN b.product_id IS NULL THEN 'fk_orphan' END) AS quality_flags
    FROM loan_schedules s LEFT JOIN banking_products b ON b.product_id = s.settlement_product_id""")
def c11_clean_loan_schedules(t: Treasury) -> DataFrame:
    return I.clean_loan_schedules(t.loan_schedules, t.banking_products).withColumns({"interest_rate_ok": F.round("interest_rate_ok", 4), "quality_flags": joined(F.col("quality_flags"))})


@query("""SELECT company_id, count(*) AS n_orphans, count(DISTINCT product_id) AS n_products FROM transactions t WHERE NOT EXISTS (SELECT 1 FROM products p WHERE p.product_id = t.product_id) GROUP BY company_id""")
def j04_orphan_movements(t: Treasury) -> DataFrame:
    known = t.banking_products.select("product_id").union(t.debt_products.select("product_id"))
    return t.transactions.join(known, "product_id", "left_anti").groupBy("company_id").agg(F.count("*").alias("n_orphans"), F.count_distinct("product_id").alias("n_products"))


@query(f"""SELECT rule_id, CAST(sum(b) AS BIGINT) AS n_before, CAST(sum(a) AS BIGINT) AS n_after FROM (SELECT rule_id, 0 AS b, 1 AS a FROM classified UNION ALL SELECT CASE WHEN flow_source = 'transferida' THEN coalesce({_DESC_RULE}, 'unknown') ELSE rule_id END, 1, 0 FROM classified) GROUP BY rule_id""")
def f09_rule_comparison(t: Treasury) -> DataFrame:
    """Rules with and without the categories learned from a company's own earlier movements."""
    from florin.operators import flows as W

    after = W.classify_flows(_tx(t))
    before = after.withColumn("rule_id", F.when(F.col("flow_source") == "transferida", F.coalesce(W.description_rule(F.col("description"), F.col("direction"))["rule"], F.lit("unknown"))).otherwise(F.col("rule_id")))
    return W.rule_comparison(before, after)


def t02_transfer_pairs(t: Treasury) -> DataFrame:
    """Transfers and mirrored legs of a third of them, a few days later on another account."""
    rows = _transfers(t).select("transaction_id", "company_id", "product_id", "date_ok", "amount_eur", "counterparty_id", "category_norm", "fx_ambiguous")
    third = F.pmod(F.crc32(F.col("transaction_id").cast("binary")), F.lit(3)) == 0
    legs = rows.where(third & F.col("amount_eur").isNotNull()).withColumns({"transaction_id": F.concat("transaction_id", F.lit("_leg")), "product_id": F.concat("product_id", F.lit("_other")), "date_ok": F.date_add("date_ok", F.pmod(F.crc32(F.col("company_id").cast("binary")), F.lit(9)).cast("int")), "amount_eur": -F.col("amount_eur")})
    return R.transfer_pairs(rows.unionByName(legs))


query()(t02_transfer_pairs)

STEPS["described"] = "SELECT *, " + ", ".join(
    "CASE " + " ".join(f"WHEN regexp_matches(normal, '{p}') THEN '{(kind, confidence)[k]}'" for p, kind, confidence in R.DESCRIPTIONS) + f" END AS {name}" for k, name in enumerate(("kind", "words"))
) + " FROM (SELECT *, trim(regexp_replace(strip_accents(upper(coalesce(description, ''))), '\\s+', ' ', 'g')) AS normal FROM transfer_rows)"
STEPS["described_class"] = "SELECT *, CASE WHEN kind = 'por_signo' THEN CASE WHEN amount_eur > 0 THEN 'operating_in' WHEN amount_eur < 0 THEN 'operating_out' END ELSE kind END AS found FROM described"


@query("""SELECT transaction_id, found AS described_class, CASE WHEN found IS NOT NULL THEN CASE kind WHEN 'internal_transfer' THEN 'desc:traspaso' WHEN 'operating_out' THEN 'desc:efectivo_fuera_de_perimetro' WHEN 'operating_in' THEN 'desc:pasarela_cobro' ELSE 'desc:transferencia_tercero' END END AS described_rule,
    CASE WHEN found IS NOT NULL THEN words END AS described_confidence FROM described_class""")
def t03_described_transfers(t: Treasury) -> DataFrame:
    return R.described_transfers(_transfers(t)).select("transaction_id", "described_class", "described_rule", "described_confidence")


def t05_rule_sensitivity(t: Treasury) -> DataFrame:
    """What every rule of the resolution adds to a company's receipts and payments."""
    return R.rule_sensitivity(R.resolved_transfers(_transfers(t))).select("company_id", "rule", "n", *money("added_receipts", "added_payments"))


query()(t05_rule_sensitivity)


_PROFILED = ["id", "amount", "stamp", "code", "blank"]
STEPS["csv_lines"] = """SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE CAST(CAST(o_orderkey % 1000 / 4.0 AS DECIMAL(12, 2)) AS VARCHAR) END AS amount, strftime(o_orderdate, '%Y-%m-%d') AS stamp, CASE WHEN o_orderkey % 3 = 0 THEN 'A' || (o_orderkey % 5) ELSE CAST(o_orderkey % 9 AS VARCHAR) END AS code FROM orders"""


def _csv_lines(t: Treasury) -> DataFrame:
    """Orders as lines of text: every 37th lacks its last two fields, and every 41st has one too many."""
    key = F.col("o_orderkey")
    amount = F.when(key % 7 == 0, "").otherwise((key % 1000 / 4.0).cast("decimal(12,2)").cast("string"))
    code = F.when(key % 3 == 0, F.concat(F.lit("A"), (key % 5).cast("string"))).otherwise((key % 9).cast("string"))
    fields = [key.cast("string"), amount, F.date_format("o_orderdate", "yyyy-MM-dd"), code, F.lit("")]
    line = F.when(key % 37 == 0, F.concat_ws(",", *fields[:3])).when(key % 41 == 0, F.concat_ws(",", *fields, F.lit("more"))).otherwise(F.concat_ws(",", *fields))
    return t.raw("orders").select(line.alias("value"))


@query("""SELECT "column", inferred_type, (SELECT count(*) FROM csv_lines) AS n_rows, (SELECT count(*) FROM csv_lines WHERE k % 37 = 0 OR k % 41 = 0) AS n_malformed FROM (VALUES ('id', 'integer'), ('amount', 'number'), ('stamp', 'string'), ('code', CASE WHEN (SELECT count(DISTINCT left(code, 1) = 'A') FROM csv_lines WHERE k % 37 <> 0) = 2 THEN 'mixed' ELSE 'integer' END), ('blank', 'null')) x("column", inferred_type)""")
def s10_csv_profile(t: Treasury) -> DataFrame:
    path = shared_path(t.spark, "orders-lines")
    _csv_lines(t).write.text(path)
    return I.csv_profile(t.spark, path, _PROFILED)


STEPS["observed"] = """SELECT currency, month, kind, rate + CASE WHEN copy = 1 AND n % 7 = 3 THEN 0.5 ELSE 0 END AS value FROM (SELECT currency, CAST(date_trunc('month', day) AS DATE) AS month, round(arg_max(rate, day), 6) AS last, round(avg(rate), 6) AS mean, date_diff('month', DATE '1995-01-01', date_trunc('month', min(day))) AS n FROM fx_daily GROUP BY currency, date_trunc('month', day))
    CROSS JOIN LATERAL (SELECT unnest(['end', 'average']) AS kind, unnest([last, mean]) AS rate) CROSS JOIN (VALUES (0), (1)) c(copy) WHERE copy = 0 OR n % 7 IN (2, 3)"""


@query("""SELECT currency, month, kind, count(*) AS n, CASE WHEN min(value) = max(value) THEN round(min(value), 6) END AS rate, min(value) <> max(value) AS is_contradiction, last_day(month) + 45 AS available_on FROM observed GROUP BY currency, month, kind""")
def s09_monthly_rates(t: Treasury) -> DataFrame:
    """From a CSV file: some months stand in it twice, some with two values, and some lines name no month."""
    months = t.fx_daily.groupBy("currency", F.trunc("day", "MM").alias("month")).agg(F.round(F.max_by("rate", "day"), 6).alias("end"), I.exact_mean(F.col("rate"), 6).alias("average"))
    n = F.months_between("month", F.lit("1995-01-01").cast("date")).cast("int")
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("rate")) for k in ("end", "average"))))
    copies = F.explode(F.when((n % 7).isin(2, 3), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    rows = months.select("currency", "month", n.alias("n"), kinds.alias("x")).select("currency", "month", "n", "x.*").withColumn("copy", copies)
    value = F.col("rate") + F.when((F.col("copy") == 1) & (F.col("n") % 7 == 3), 0.5).otherwise(0.0)
    lines = rows.select("currency", F.date_format("month", "yyyy-'M'MM").alias("period"), "kind", value.cast("string").alias("value"))
    bad = rows.where("copy = 0").select("currency", F.date_format("month", "yyyy-MM").alias("period"), "kind", F.lit("1.5").alias("value"))
    path = shared_path(t.spark, "monthly-rates")
    lines.union(bad).write.csv(path, header=True, quoteAll=True, escape='"')
    return I.monthly_observations(I.csv_scan(t.spark, path, ["currency", "period", "kind", "value"]), 45).withColumn("rate", F.round("rate", 6))
