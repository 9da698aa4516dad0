"""The treasury tables, as views over the generic test tables.

Every table is a DataFrame function over (spark, folder); ORACLE holds the same
definitions as DuckDB common table expressions for the oracle queries.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed calendar of the views: 24 closed months, then the open one.
FIRST_MONTH = "1999-08-01"
LAST_MONTH = "2001-07-01"
OPEN_MONTH = "2001-08-01"
ANCHOR_DAY = "2001-08-01"
#: Bank texts of the movements, one per description rule and some that name transfers; the last three end as they are, the others in a number.
DESCRIPTIONS = (
    "SCF-AJUS.SALDO", "Compensation for missing or excess", "Ajuste retencion", "DISP.ENTREG.EFECT. CAJERO", "MONTHLY FEE", "VT.A TIENDA", "PR.A REF", "FECHO TPA", "LIQUIDACION EFECTUADA EL", "AB.NT.BZ", "ON LINE", "DEBTOR NUMBER",
    "CHARGE FOR SERVICE", "ACCOUNT ******", "Traspaso  propio", "Transferéncia a tercero", "RETIRADA", "STRIPE PAYOUT", "Transf interna", "CARD CHARGE", "CARD PAYMENT", "WEEKLY PAYOUT",
)
COUNTRIES = ("España", " spain ", "pt", "Alemania", "Atlantis", "", "Malaysia")


def _named(prefix: str, key: str) -> Column:
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


def _pick(key: Column, *cases: tuple[int, object], otherwise: object) -> Column:
    out = F.when(key == cases[0][0], F.lit(cases[0][1]))
    for value, result in cases[1:]:
        out = out.when(key == value, F.lit(result))
    return out.otherwise(F.lit(otherwise))


@dataclass
class Treasury:
    """Lazy tables; nothing is read before a query runs."""

    spark: SparkSession
    folder: str

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def groups(self) -> DataFrame:
        return self.raw("nation").join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(_named("GRP_", "n_nationkey").alias("group_id"), F.col("r_name").alias("erp"))

    @cached_property
    def companies(self) -> DataFrame:
        last = F.col("c_custkey") % 10
        return self.raw("customer").join(self.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
            _named("COMP_", "c_custkey").alias("company_id"), _named("GRP_", "c_nationkey").alias("group_id"), F.element_at(F.array(*map(F.lit, COUNTRIES)), (F.col("c_custkey") % 7 + 1).cast("int")).alias("country"), _pick(last, (0, "USD"), (1, "GBP"), otherwise="EUR").alias("currency")
        )

    def _accounts(self, *numbers: int) -> DataFrame:
        return self.raw("customer").withColumn("i", F.explode(F.array(*map(F.lit, numbers)))).withColumn("product_id", F.concat(F.lit("P"), F.col("i").cast("string"), F.lit("_"), F.col("c_custkey").cast("string")))

    @cached_property
    def banking_products(self) -> DataFrame:
        last, second = F.col("c_custkey") % 10, F.col("i") == 1
        return self._accounts(0, 1, 2, 3).select(
            "product_id", _named("COMP_", "c_custkey").alias("company_id"), _pick(F.col("i"), (0, "checking"), (1, "saving"), (2, "card"), otherwise="tpv").alias("type"),
            F.when(second & (last == 0), "USD").when(second & (last == 1), "GBP").otherwise("EUR").alias("currency"),
        )

    @cached_property
    def debt_products(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.raw("customer").where(key % 3 != 2).select(
            _named("P4_", "c_custkey").alias("product_id"), _named("COMP_", "c_custkey").alias("company_id"), _pick(key % 4, (0, "loan"), (1, "leasing"), (2, "lineofcredit"), otherwise="factoring").alias("type"),
            F.lit("EUR").alias("currency"), (F.col("c_acctbal") * 10).alias("granted"), F.when(key % 7 != 0, F.col("c_acctbal") * 4).alias("outstanding"),
        )

    @cached_property
    def transactions(self) -> DataFrame:
        order = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
        lines = self.raw("lineitem").select("l_orderkey", "l_linenumber", *order)
        lines = lines.withColumn("rn", F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*order)))
        part, supplier = F.col("l_partkey") % 10, F.col("l_suppkey")
        income = (F.col("l_returnflag") == "A") | ((F.col("l_returnflag") == "N") & (F.col("l_linenumber") % 2 == 0))
        text = lambda c: F.col(c).cast("string")
        category = ("transfer", "debt_repayment", "interest_charge", None, "-", "investment_return", "cash_withdrawal", "salary", "payment", "tax")
        return lines.join(self.raw("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.concat_ws("_", F.lit("TX"), text("l_orderkey"), text("l_linenumber"), text("rn")).alias("transaction_id"),
            _named("COMP_", "o_custkey").alias("company_id"),
            F.concat(F.lit("P"), F.when(part < 6, 0).otherwise(part - 5).cast("string"), F.lit("_"), text("o_custkey")).alias("product_id"),
            F.col("l_shipdate").cast("date").alias("date"), F.when(supplier % 9 != 0, F.date_add(F.col("l_shipdate").cast("date"), (supplier % 9 - 2).cast("int"))).alias("value_date"),
            (F.when(income, 1).otherwise(-1) * F.round("l_extendedprice", 2)).alias("amount"),
            F.when(supplier % 5 == 0, 1.0).when(supplier % 11 == 0, -1.0).otherwise(1.1).alias("exchange_rate"),
            F.when((F.col("l_linestatus") == "F") | (F.col("l_quantity") > 5), "booked").otherwise("pending").alias("status"),
            _pick(supplier % 12, *enumerate(category), otherwise="collection").alias("category"),
            F.concat(F.element_at(F.array(*map(F.lit, DESCRIPTIONS)), (supplier % 22 + 1).cast("int")), F.when(supplier % 22 < 19, F.concat(F.lit(" "), (supplier % 7).cast("string"))).otherwise("")).alias("description"),
            _named("CP_", "l_suppkey").alias("counterparty_id"),
        )

    @cached_property
    def loan_schedules(self) -> DataFrame:
        key = F.col("c_custkey")
        account = F.when(key % 5 == 0, _named("P9_", "c_custkey")).when(key % 11 != 0, _named("P0_", "c_custkey"))
        return self.raw("customer").where("c_custkey % 3 <> 2").select(
            _named("P4_", "c_custkey").alias("product_id"), _named("COMP_", "c_custkey").alias("company_id"), account.alias("settlement_product_id"),
            F.when(key % 13 != 0, (key % 80) / 100.0 - 0.05).alias("annual_rate"), (key % 700).cast("int").alias("total_periods"), F.date_add(F.lit("1999-01-01").cast("date"), ((key % 97) * 200).cast("int")).alias("next_payment_date"),
        )

    @cached_property
    def text_rows(self) -> DataFrame:
        """Orders as a text table of a source would hold them: three formats of time, some values that are none."""
        key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
        time = F.when(key % 4 == 0, F.date_format(day, "yyyy-MM-dd")).when(key % 4 == 1, F.date_format(day, "yyyy-MM-dd HH:mm:ss")).when(key % 4 == 2, F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss")).otherwise("31/12/1999")
        return self.raw("orders").select(
            F.when(key % 29 == 0, "n.a.").otherwise(key.cast("string")).alias("id"), F.when(key % 7 == 0, "").when(key % 11 == 0, "1.2.3").otherwise((key % 1000 / 4.0).cast("decimal(12,2)").cast("string")).alias("amount"),
            F.when(key % 17 != 0, time).alias("stamp"), F.concat(F.lit('say "'), F.col("o_orderpriority"), F.lit('"\n, then ')).alias("note"),
        )

    @cached_property
    def invoices(self) -> DataFrame:
        key = F.col("o_orderkey")
        due_days = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), 30).when(F.col("o_orderpriority") == "3-MEDIUM", 60).otherwise(90)
        status = F.when(key % 31 == 0, "cancel").when((F.col("o_orderstatus") == "F") | (key % 4 == 1), "paid").when(F.col("o_orderstatus") == "P", "overdue").otherwise("pending")
        issued = F.col("o_orderdate").cast("date")
        orders = self.raw("orders").withColumns({"issued": issued, "st": status}).withColumn("due", F.date_add("issued", due_days))
        return orders.select(
            _named("INV_", "o_orderkey").alias("operation_id"), _named("COMP_", "o_custkey").alias("company_id"),
            F.when(key % 20 == 0, "credit_note").otherwise("invoice").alias("document_type"), F.col("issued").alias("issuance_date"), F.col("due").alias("due_date"),
            F.when(F.col("st") == "paid", F.date_add("issued", ((key * 37) % 150).cast("int"))).otherwise(F.col("due")).alias("payment_date"),
            F.when(key % 3 == 0, -F.col("o_totalprice")).otherwise(F.col("o_totalprice")).alias("amount"),
            F.when(F.col("st") == "paid", 0.0).otherwise(F.col("o_totalprice")).alias("pending_amount"),
            F.when(key % 10 == 0, "USD").when(key % 10 == 1, "GBP").when(key % 50 == 7, "XAF").otherwise("EUR").alias("currency"),
            F.when(key % 20 == 1, "USD").otherwise("EUR").alias("accounting_currency"),
            F.when(key % 10 > 1, 1.0).when(key % 4 == 0, 1.0).otherwise(1.15).alias("exchange_rate"),
            F.col("st").alias("status"), F.concat(F.lit("CP_"), (key % 40).cast("string")).alias("counterparty_id"),
        )

    @cached_property
    def balances(self) -> DataFrame:
        return self._accounts(0, 1, 3).where(F.col("c_custkey") % 13 != 5).select(
            "product_id", _named("COMP_", "c_custkey").alias("company_id"), F.lit(ANCHOR_DAY).cast("date").alias("date"), F.when(F.col("c_custkey") % 97 == 0, -999999999.0).otherwise(F.col("c_acctbal") * (F.col("i") + 1)).alias("balance")
        )

    @cached_property
    def fx_daily(self) -> DataFrame:
        days = self.raw("orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct().withColumn("n", F.datediff("day", F.lit("1995-01-01").cast("date"))).where("n % 7 < 5")
        quotes = F.array(*(F.struct(F.lit(c).alias("currency"), F.lit(b).alias("base"), F.lit(m).alias("mul"), F.lit(d).alias("drift")) for c, b, m, d in (("USD", 1.05, 7919, 0.0), ("GBP", 0.82, 6101, 0.00005))))
        rate = F.col("q.base") + ((F.col("n") * F.col("q.mul")) % 997) / 20000.0 + F.col("q.drift") * F.col("n")
        return days.withColumn("q", F.explode(quotes)).select("q.currency", "day", rate.alias("rate"))


def _list(texts: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in texts) + "]"


#: DuckDB definitions of the same tables.
ORACLE = {
    "companies": """SELECT concat('COMP_', CAST(c_custkey AS VARCHAR)) AS company_id, concat('GRP_', CAST(c_nationkey AS VARCHAR)) AS group_id, (__COUNTRIES__)[c_custkey % 7 + 1] AS country,
        CASE c_custkey % 10 WHEN 0 THEN 'USD' WHEN 1 THEN 'GBP' ELSE 'EUR' END AS currency FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "banking_products": """SELECT concat('P', CAST(i AS VARCHAR), '_', CAST(c_custkey AS VARCHAR)) AS product_id, concat('COMP_', CAST(c_custkey AS VARCHAR)) AS company_id,
        CASE i WHEN 0 THEN 'checking' WHEN 1 THEN 'saving' WHEN 2 THEN 'card' ELSE 'tpv' END AS type,
        CASE WHEN i = 1 AND c_custkey % 10 = 0 THEN 'USD' WHEN i = 1 AND c_custkey % 10 = 1 THEN 'GBP' ELSE 'EUR' END AS currency FROM customer CROSS JOIN (VALUES (0), (1), (2), (3)) x(i)""",
    "debt_products": """SELECT concat('P4_', CAST(c_custkey AS VARCHAR)) AS product_id, concat('COMP_', CAST(c_custkey AS VARCHAR)) AS company_id,
        CASE c_custkey % 4 WHEN 0 THEN 'loan' WHEN 1 THEN 'leasing' WHEN 2 THEN 'lineofcredit' ELSE 'factoring' END AS type, 'EUR' AS currency, c_acctbal * 10 AS granted,
        CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal * 4 END AS outstanding FROM customer WHERE c_custkey % 3 <> 2""",
    "transactions": """SELECT concat('TX_', CAST(l_orderkey AS VARCHAR), '_', CAST(l_linenumber AS VARCHAR), '_', CAST(rn AS VARCHAR)) AS transaction_id, concat('COMP_', CAST(o_custkey AS VARCHAR)) AS company_id,
        concat('P', CAST(CASE WHEN l_partkey % 10 < 6 THEN 0 ELSE l_partkey % 10 - 5 END AS VARCHAR), '_', CAST(o_custkey AS VARCHAR)) AS product_id, CAST(l_shipdate AS DATE) AS date, CASE WHEN l_suppkey % 9 <> 0 THEN CAST(l_shipdate AS DATE) + CAST(l_suppkey % 9 - 2 AS INTEGER) END AS value_date,
        CASE WHEN l_returnflag = 'A' OR (l_returnflag = 'N' AND l_linenumber % 2 = 0) THEN 1 ELSE -1 END * round(l_extendedprice, 2) AS amount,
        CASE WHEN l_suppkey % 5 = 0 THEN 1.0 WHEN l_suppkey % 11 = 0 THEN -1.0 ELSE 1.1 END::DOUBLE AS exchange_rate,
        CASE WHEN l_linestatus = 'F' OR l_quantity > 5 THEN 'booked' ELSE 'pending' END AS status,
        CASE l_suppkey % 12 WHEN 0 THEN 'transfer' WHEN 1 THEN 'debt_repayment' WHEN 2 THEN 'interest_charge' WHEN 3 THEN NULL WHEN 4 THEN '-' WHEN 5 THEN 'investment_return' WHEN 6 THEN 'cash_withdrawal'
            WHEN 7 THEN 'salary' WHEN 8 THEN 'payment' WHEN 9 THEN 'tax' ELSE 'collection' END AS category,
        concat((__DESCRIPTIONS__)[l_suppkey % 22 + 1], CASE WHEN l_suppkey % 22 < 19 THEN concat(' ', CAST(l_suppkey % 7 AS VARCHAR)) ELSE '' END) AS description, concat('CP_', CAST(l_suppkey AS VARCHAR)) AS counterparty_id
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax, l_returnflag, l_linestatus) AS rn FROM lineitem) l
        JOIN orders ON l_orderkey = o_orderkey""",
    "invoices": """SELECT concat('INV_', CAST(o_orderkey AS VARCHAR)) AS operation_id, concat('COMP_', CAST(o_custkey AS VARCHAR)) AS company_id, CASE WHEN o_orderkey % 20 = 0 THEN 'credit_note' ELSE 'invoice' END AS document_type,
        issued AS issuance_date, issued + due_days AS due_date, CASE WHEN st = 'paid' THEN issued + CAST((o_orderkey * 37) % 150 AS INTEGER) ELSE issued + due_days END AS payment_date,
        CASE WHEN o_orderkey % 3 = 0 THEN -o_totalprice ELSE o_totalprice END AS amount, CASE WHEN st = 'paid' THEN 0.0 ELSE o_totalprice END AS pending_amount,
        CASE WHEN o_orderkey % 10 = 0 THEN 'USD' WHEN o_orderkey % 10 = 1 THEN 'GBP' WHEN o_orderkey % 50 = 7 THEN 'XAF' ELSE 'EUR' END AS currency,
        CASE WHEN o_orderkey % 20 = 1 THEN 'USD' ELSE 'EUR' END AS accounting_currency, CASE WHEN o_orderkey % 10 > 1 THEN 1.0 WHEN o_orderkey % 4 = 0 THEN 1.0 ELSE 1.15 END::DOUBLE AS exchange_rate,
        st AS status, concat('CP_', CAST(o_orderkey % 40 AS VARCHAR)) AS counterparty_id
        FROM (SELECT *, CAST(o_orderdate AS DATE) AS issued, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 30 WHEN o_orderpriority = '3-MEDIUM' THEN 60 ELSE 90 END AS due_days,
            CASE WHEN o_orderkey % 31 = 0 THEN 'cancel' WHEN o_orderstatus = 'F' OR o_orderkey % 4 = 1 THEN 'paid' WHEN o_orderstatus = 'P' THEN 'overdue' ELSE 'pending' END AS st FROM orders) o""",
    "balances": """SELECT concat('P', CAST(i AS VARCHAR), '_', CAST(c_custkey AS VARCHAR)) AS product_id, concat('COMP_', CAST(c_custkey AS VARCHAR)) AS company_id, DATE '2001-08-01' AS date,
        CASE WHEN c_custkey % 97 = 0 THEN -999999999.0 ELSE c_acctbal * (i + 1) END AS balance FROM customer CROSS JOIN (VALUES (0), (1), (3)) x(i) WHERE c_custkey % 13 <> 5""",
    "fx_daily": """SELECT c.currency, d.day, c.base + ((d.n * c.mul) % 997) / 20000.0 + c.drift * d.n AS rate FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS n FROM orders) d
        CROSS JOIN (VALUES ('USD', 1.05::DOUBLE, 7919, 0.0::DOUBLE), ('GBP', 0.82::DOUBLE, 6101, 0.00005::DOUBLE)) c(currency, base, mul, drift) WHERE d.n % 7 < 5""",
    "months": "SELECT CAST(m AS DATE) AS month, last_day(CAST(m AS DATE)) AS month_end FROM generate_series(DATE '1999-08-01', DATE '2001-07-01', INTERVAL 1 MONTH) g(m)",
}
ORACLE["companies"] = ORACLE["companies"].replace("__COUNTRIES__", _list(COUNTRIES))
ORACLE["transactions"] = ORACLE["transactions"].replace("__DESCRIPTIONS__", _list(DESCRIPTIONS))
ORACLE["groups"] = "SELECT concat('GRP_', CAST(n_nationkey AS VARCHAR)) AS group_id, r_name AS erp FROM nation JOIN region ON n_regionkey = r_regionkey"
ORACLE["loan_schedules"] = """SELECT concat('P4_', CAST(c_custkey AS VARCHAR)) AS product_id, concat('COMP_', CAST(c_custkey AS VARCHAR)) AS company_id, CASE WHEN c_custkey % 5 = 0 THEN concat('P9_', CAST(c_custkey AS VARCHAR)) WHEN c_custkey % 11 <> 0 THEN concat('P0_', CAST(c_custkey AS VARCHAR)) END AS settlement_product_id,
    CASE WHEN c_custkey % 13 <> 0 THEN (c_custkey % 80) / 100.0::DOUBLE - 0.05::DOUBLE END AS annual_rate, CAST(c_custkey % 700 AS INTEGER) AS total_periods, DATE '1999-01-01' + CAST((c_custkey % 97) * 200 AS INTEGER) AS next_payment_date FROM customer WHERE c_custkey % 3 <> 2"""
ORACLE["text_rows"] = """SELECT CASE WHEN o_orderkey % 29 = 0 THEN 'n.a.' ELSE CAST(o_orderkey AS VARCHAR) END AS id, CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 11 = 0 THEN '1.2.3' ELSE CAST(CAST(o_orderkey % 1000 / 4.0 AS DECIMAL(12, 2)) AS VARCHAR) END AS amount,
    CASE WHEN o_orderkey % 17 <> 0 THEN CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') ELSE '31/12/1999' END END AS stamp, concat('say "', o_orderpriority, '"', chr(10), ', then ') AS note FROM orders"""
