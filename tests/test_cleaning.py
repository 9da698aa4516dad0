"""Rules of cleaning and classification on rows made by hand."""

import random
import re
from datetime import date

from pyspark.sql import functions as F

from florin.operators import cleaning as C
from florin.operators import flows as W
from florin.operators import marts as M

TX = "transaction_id string, company_id string, product_id string, date date, value_date date, amount double, exchange_rate double, status string, category string, description string, counterparty_id string"
PRODUCT = "product_id string, company_id string, type string, currency string"


def tx(spark, *rows):
    banking = spark.createDataFrame([("E", "c", "checking", " eur "), ("U", "c", "Saving", "USD")], PRODUCT)
    debt = spark.createDataFrame([("D", "c", "loan", "EUR")], PRODUCT)
    return C.clean_transactions(spark.createDataFrame([(str(k), "c", p, d, None, a, r, s, cat, text, None) for k, (p, d, a, r, s, cat, text) in enumerate(rows)], TX), banking, debt, "2001-08-01")


def test_unknown_amounts_stay_unknown(spark):
    day = date(2001, 1, 5)
    out = tx(spark, ("E", day, 10.0, None, "Booked ", "tax", ""), ("U", day, 10.0, 2.0, None, "-", ""), ("U", day, 10.0, 1.0, "", None, ""), ("U", day, 10.0, -1.0, "booked", "x", ""), ("X", day, 10.0, 2.0, "booked", "x", ""), ("U", date(1980, 1, 1), None, 2.0, "booked", "x", "")).orderBy("transaction_id").collect()
    assert [r.amount_eur for r in out] == [10.0, 5.0, None, None, None, None]
    assert [r.product_source for r in out] == ["banking"] * 4 + ["orphan", "banking"]
    assert out[2].fx_ambiguous and out[1].status_norm == "unknown" and out[1].category_norm is None
    assert out[5].month is None and set(out[5].quality_flags) == {"date_out_of_range", "amount_missing", "fx_not_convertible"}
    assert "fx_rate_invalid" in out[3].quality_flags and "fk_orphan" in out[4].quality_flags


def test_patterns_are_learned_from_earlier_months_only(spark):
    jan, feb, mar = date(2001, 1, 3), date(2001, 2, 3), date(2001, 3, 3)
    out = W.classify_flows(tx(spark, ("E", jan, -5.0, None, "booked", None, "rent 12"), ("E", feb, -5.0, None, "booked", "tax", "rent 7"), ("E", mar, -5.0, None, "booked", None, "rent 99"), ("E", mar, -5.0, None, "booked", None, "PR.A shop"), ("E", mar, 5.0, None, "booked", "fee", "x"))).orderBy("transaction_id").collect()
    assert [r.rule_id for r in out] == ["unknown", "cat:tax", "transf:tax", "desc:compra", "cat:fee"]
    assert out[2].evidence_month == date(2001, 2, 1) and out[4].flow_class == "operating_in" and out[4].direction_conflict


def test_learned_categories_against_a_loop(spark):
    """Learned by a window over a pattern's months, which saw a join before."""
    rng = random.Random(2)
    rows = [("E", date(2001, rng.randrange(1, 10), 2) if rng.random() < 0.95 else None, rng.choice([5.0, -5.0, 0.0, None]), None, rng.choice(["booked", "pending"]), rng.choice([None, "-", "tax", "fee"]), rng.choice(["a 1", "a 22", "b", "", None])) for _ in range(300)]
    found = {int(r.transaction_id): (r.rule_id.removeprefix("transf:"), r.evidence_month) for r in W.classify_flows(tx(spark, *rows)).collect() if r.flow_source == "transferida"}
    shape = lambda text: re.sub("[0-9]+", "#", (text or "").upper())
    direction = lambda a: None if a is None else (a > 0) - (a < 0)
    wanted = {}
    for k, (_, day, amount, _, _, category, text) in enumerate(rows):
        if category in (None, "-") and shape(text) and day and amount is not None:
            seen = [(c, d) for _, d, a, _, status, c, t in rows if d and d.month < day.month and d.month < 8 and status == "booked" and c not in (None, "-") and direction(a) == direction(amount) and shape(t) == shape(text)]
            if len({c for c, _ in seen}) == 1:
                wanted[k] = (seen[0][0], min(d for _, d in seen).replace(day=1))
    assert found == wanted and len(wanted) > 5


def test_open_invoices(spark):
    rows = spark.createDataFrame([("c", "x", date(2001, 1, 10), date(2001, 2, 1), date(2001, 3, 31), False, "ar", 5.0), ("c", "x", date(2001, 1, 10), None, None, True, "ap", None), ("c", "x", date(2001, 1, 10), None, date(2001, 1, 20), False, "ar", 1.0)], "company_id string, counterparty_id string, issued date, due date, settled date, is_uncertain boolean, side string, eur double")
    out = M.open_at_month_ends(rows, "2001-01-01", "2001-04-01")
    months = {s: [r.month.month for r in out.where(F.col("side") == s).orderBy("month").collect()] for s in ("ar", "ap")}
    assert months == {"ar": [1, 2], "ap": [1, 2, 3, 4]}


def test_typed_reports_what_it_lost(spark):
    out = C.typed(spark.createDataFrame([("1", "x"), ("b", None), (" ", "2001-01-01")], "n string, d string"), {"n": "long", "d": "date"})
    assert [r._cast_failures for r in out.collect()] == [["d"], ["n"], []]
    assert {r.column: r.n for r in C.cast_failure_counts(out).collect()} == {"n": 1, "d": 1}
