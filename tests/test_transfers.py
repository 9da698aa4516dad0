"""Pairing and matching, which follow an order that SQL does not express, against plain loops over whole companies."""

import datetime
import random

from pyspark.sql import functions as F

from florin.operators import events as E
from florin.operators import transfers as R

DAY = datetime.date(2000, 1, 1)


def greedy(rows):
    paired, out = set(), set()
    for rule, confidence, most, other_account in R.PASSES:
        free = [r for r in rows if r["transaction_id"] not in paired]
        for a in sorted(free, key=lambda r: (-abs(r["amount_eur"]), r["date_ok"], r["transaction_id"])):
            if a["transaction_id"] in paired:
                continue
            for b in sorted(free, key=lambda r: (r["date_ok"], r["transaction_id"])):
                if b["transaction_id"] in paired or b["company_id"] != a["company_id"] or a["amount_eur"] * b["amount_eur"] >= 0 or abs((a["date_ok"] - b["date_ok"]).days) > most:
                    continue
                if other_account and a["product_id"] == b["product_id"] or abs(abs(a["amount_eur"]) - abs(b["amount_eur"])) > 0.01 + 1e-9:
                    continue
                if a["counterparty_id"] and b["counterparty_id"] and a["counterparty_id"] != b["counterparty_id"]:
                    continue
                paired |= {a["transaction_id"], b["transaction_id"]}
                out |= {(a["transaction_id"], b["transaction_id"], rule, confidence), (b["transaction_id"], a["transaction_id"], rule, confidence)}
                break
    return out


def test_pairs_are_those_of_the_whole_company(spark):
    rng = random.Random(3)
    rows = [
        {"company_id": f"C{rng.randrange(4)}", "transaction_id": f"T{k:04}", "product_id": rng.choice(["P1", "P2"]), "date_ok": DAY + datetime.timedelta(days=rng.randrange(40)), "amount_eur": rng.choice([-1, 1]) * rng.choice([100.0, 100.01, 100.02, 250.5, 90.0]), "counterparty_id": rng.choice([None, "", "X", "Y"]), "category_norm": rng.choice([None, "transfer"]), "fx_ambiguous": False}
        for k in range(400)
    ]
    frame = spark.createDataFrame(rows, "company_id string, transaction_id string, product_id string, date_ok date, amount_eur double, counterparty_id string, category_norm string, fx_ambiguous boolean")
    got = {tuple(r) for r in R.transfer_pairs(frame).collect()}
    assert got == greedy(rows) and len(got) > 100
    usable = frame.withColumn("amount_eur", F.when(F.col("transaction_id") < "T0200", F.col("amount_eur")))
    assert {r.transaction_id for r in R.transfer_pairs(usable).collect()} <= {f"T{k:04}" for k in range(200)}


def test_one_amount_repeated_takes_time_in_proportion():
    import time

    import pandas as pd

    rng = random.Random(8)
    for days, accounts in ((9000, 2), (1, 1), (1, 3)):
        rows = [(f"T{k:05}", f"P{k // 2 % accounts}", k * days // 20_000, 50.0 if k % 2 else -50.0, rng.choice(["", "X"])) for k in range(20_000)]
        frame = pd.DataFrame(rows, columns=["transaction_id", "product_id", "day", "eur", "counterparty_id"])
        begin = time.perf_counter()
        assert len(list(R._greedy(frame))) == 20_000
        assert time.perf_counter() - begin < 10


def test_resolution_prefers_pairs_to_words(spark):
    rows = [("a", "C", "P1", DAY, 10.0, "TRANSFERENCIA X", "transfer"), ("b", "C", "P2", DAY, -10.0, "TRASPASO", "transfer"), ("c", "C", "P1", DAY, -3.0, "x", "cash_withdrawal"), ("d", "C", "P1", DAY, -7.0, "transferéncia  y", None), ("e", "C", "P1", DAY, -8.0, "else", None)]
    frame = spark.createDataFrame([(*r, None, False, DAY) for r in rows], "transaction_id string, company_id string, product_id string, date_ok date, amount_eur double, description string, category_norm string, counterparty_id string, fx_ambiguous boolean, month date")
    got = {r.transaction_id: (r.resolved_class, r.rule, r.matched_with) for r in R.resolved_transfers(frame).collect()}
    assert got == {"a": ("internal_transfer", "par_interno_estricto", "b"), "b": ("internal_transfer", "par_interno_estricto", "a"), "c": ("operating_out", "cash_withdrawal_sale_de_perimetro", None), "d": ("operating_out", "desc:transferencia_tercero", None), "e": ("ambiguo", None, None)}
    assert {r.rule: (r.added_receipts, r.added_payments) for r in R.rule_sensitivity(R.resolved_transfers(frame)).collect()}["desc:transferencia_tercero"] == (0.0, 7.0)


def test_alerts_meet_events_one_to_one(spark):
    month = lambda k: datetime.date(2000 + (k - 1) // 12, (k - 1) % 12 + 1, 1)
    states = spark.createDataFrame([("C", month(k), k % 2 == 0 if k != 9 else None) for k in range(1, 13)], "company_id string, month date, deficit boolean")
    issued = spark.createDataFrame([("C", "improvement", "baseline", month(k)) for k in (2, 3, 5, 8)], "company_id string, sign string, method string, origin_month date")
    events = spark.createDataFrame([("C", month(4), "improvement", month(5)), ("C", month(3), "deterioration", month(4))], "company_id string, onset_month date, sign string, confirmed_at date")
    got = {r.origin_month.month: (r.status, r.lead_months) for r in E.matched_alerts(issued, events, states).collect()}
    assert got == {2: ("matched", 2), 3: ("false_alarm", None), 5: ("false_alarm", None), 8: ("censored", None)}
    report = E.alert_report(E.matched_alerts(issued, events, states), events).collect()
    assert [(r.n_alerts, r.n_matched, r.n_false_alarm, r.n_censored, r.recall) for r in report] == [(4, 1, 2, 1, 1.0)]
