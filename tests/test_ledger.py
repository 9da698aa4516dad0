"""The evidence ledger, state machines and metrics against plain loops on hand-made and random records."""

import datetime
import itertools
import random
from collections import defaultdict
from decimal import Decimal

import pytest

from florin.operators import episodes as P
from florin.operators import ledger as G
from florin.operators import metrics as X

DAY = datetime.date(2000, 1, 1)
day = lambda k: DAY + datetime.timedelta(days=k)
month = lambda k: datetime.date(2000 + k // 12, k % 12 + 1, 1)


def test_records_that_repeat_are_one_and_others_conflict(spark):
    rows = [("a", 1, "x"), ("a", 1, "x"), ("b", 1, "x"), ("b", 2, "x"), ("c", None, "x"), ("c", None, "x"), ("d", None, "x"), ("d", 1, None)]
    got = {r.id: (r.n_records, r.is_conflict) for r in G.deduplicated(spark.createDataFrame(rows, "id string, v int, w string"), ["id"]).collect()}
    assert got == {"a": (2, False), "b": (2, True), "c": (2, False), "d": (2, True)}


def test_coverage_by_days(spark):
    """Islands and covered months against sets of days."""
    rng = random.Random(1)
    rows = [(f"S{k}", f"A{rng.randrange(5)}", day(b := rng.randrange(120)), day(b + rng.choice([1, 10, 31, 60])), rng.random() < 0.9, rng.choice([None, day(rng.randrange(200))]), rng.choice(["verified", "verified", "assumed"]), rng.random() < 0.1) for k in range(120)]
    statements = spark.createDataFrame(rows, "coverage_id string, account_id string, from_day date, to_day date, is_complete boolean, known_on date, basis string, is_conflict boolean")
    periods = G.report_months(spark.createDataFrame([(f"A{k}",) for k in range(6)], "account_id string"), "2000-01-01", "2000-06-01")
    islands = G.coverage_islands(statements, periods)
    wanted = defaultdict(set)
    for a, m in itertools.product([f"A{k}" for k in range(6)], range(6)):
        for _, account, b, e, complete, known, basis, conflict in rows:
            if account == a and complete and not conflict and basis == "verified" and known and known < month(m + 3):
                wanted[a, month(m)] |= {b + datetime.timedelta(days=k) for k in range((e - b).days)}
    got, runs = defaultdict(set), 0
    for r in islands.collect():
        days = {r.from_day + datetime.timedelta(days=k) for k in range((r.to_day - r.from_day).days)}
        assert not days & got[r.account_id, r.month] and r.to_day not in wanted[r.account_id, r.month] and r.from_day - datetime.timedelta(days=1) not in wanted[r.account_id, r.month]
        got[r.account_id, r.month] |= days
        runs += 1
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in wanted.items() if v} and runs > 30
    covered = {(r.account_id, r.month): (r.is_covered, r.days_covered) for r in G.covered_months(islands, periods).collect()}
    assert len(covered) == 36 and {c for c, _ in covered.values()} == {True, False}
    for (a, m), found in covered.items():
        inside = {d for d in wanted[a, m] if (d.year, d.month) == (m.year, m.month)}
        length = ((m.replace(day=28) + datetime.timedelta(days=4)).replace(day=1) - m).days
        assert found == (len(inside) == length, len(inside))


def test_accounts_that_reconcile_and_that_do_not(spark):
    periods = G.report_months(spark.createDataFrame([(a, "C", "EUR" if a != "usd" else "USD") for a in ("good", "off", "cent", "gap", "alone", "hidden", "late", "none", "usd")], "account_id string, company_id string, currency string"), "2000-02-01", "2000-02-01")
    accounts = ["good", "off", "cent", "gap", "alone", "hidden", "late", "usd"]
    anchors = []
    for a in accounts:
        end = {"off": "1070.00", "cent": "1050.01"}.get(a, "1050.00")
        anchors += [(f"{a}1", a, day(10), "opening", Decimal("1000.00"), a != "alone", day(11), "verified", False), (f"{a}2", a, day(75), "closing", Decimal(end), True, day(400) if a == "late" else day(76), "verified", False)]
    anchors.append(("none1", "none", day(70), "unknown", Decimal("1.00"), True, day(71), "verified", False))
    moves = [(f"{a}{k}", a, day(d), Decimal(x), status, day(d + 1), "verified", False) for a in accounts for k, (d, x, status) in enumerate([(9, "7.00", "booked"), (10, "20.00", "booked"), (60, "30.00", "booked"), (75, "0.00", "booked"), (76, "9.00", "booked"), (61, "5.00", "pending"), *([(62, "1.00", "unknown")] if a == "hidden" else [])])]
    statements = [(f"s{a}", a, day(0), day(40 if a == "gap" else 90), True, day(1), "verified", False) for a in accounts]
    islands = G.coverage_islands(spark.createDataFrame(statements, "coverage_id string, account_id string, from_day date, to_day date, is_complete boolean, known_on date, basis string, is_conflict boolean"), periods)
    rates = spark.createDataFrame([("USD", day(59), 2.0)], "currency string, day date, rate double")
    found = G.reconstructed_accounts(
        periods, spark.createDataFrame(anchors, "anchor_id string, account_id string, measured_on date, semantics string, amount decimal(18,2), is_independent boolean, known_on date, basis string, is_conflict boolean"),
        spark.createDataFrame(moves, "movement_id string, account_id string, booked_on date, amount decimal(18,2), booking string, known_on date, basis string, is_conflict boolean"), islands, rates,
    )
    got = {r.account_id: (r.ledger_native and float(r.ledger_native), r.residual is not None and float(r.residual), r.reasons, r.is_usable) for r in found.collect()}
    assert got["good"] == (1020.0, 0.0, [], True) and got["off"] == (1040.0, 20.0, ["reconciliation_mismatch"], False) and got["cent"] == (1020.01, 0.01, [], True)
    assert got["gap"] == (None, False, ["ledger_gap"], False) and got["alone"] == (1020.0, False, ["reconciliation_unverified"], False) and got["hidden"] == (None, False, ["ledger_gap"], False)
    assert got["late"] == (None, False, ["missing_source"], False) and got["none"] == (None, False, ["anchor_cutoff_unknown"], False)
    assert [r.ledger_eur for r in found.where("account_id = 'usd'").collect()] == [510.0]


def test_states_of_obligations_day_by_day(spark):
    rng = random.Random(2)
    schema = "obligation_id string, version int, company_id string, kind string, currency string, face decimal(18,2), due_on date, effective_from date, role_verified boolean"
    faces = [(f"O{k}", 0, f"C{k % 4}", rng.choice(G.KINDS), "EUR", Decimal(rng.randrange(100, 900)), day(rng.randrange(20, 200)), day(rng.randrange(60)), True) for k in range(40)]
    pays = [(f"P{k}", f"O{rng.randrange(40)}", day(rng.randrange(60, 300)), Decimal(rng.randrange(10, 400)), "explicit", False) for k in range(60)]
    changes = [(f"M{k}", f"O{rng.randrange(40)}", rng.choice(["cancel", "reverse", "writeoff"]), day(rng.randrange(60, 300)), Decimal(rng.randrange(5, 60))) for k in range(20)]
    obligations = G.legal_obligations(spark.createDataFrame(faces, schema))
    events = G.obligation_events(obligations, spark.createDataFrame(pays, "allocation_id string, obligation_id string, paid_on date, amount decimal(18,2), policy string, is_conflict boolean"), spark.createDataFrame(changes, "amendment_id string, obligation_id string, kind string, effective_on date, amount decimal(18,2)"))
    got = {(r.obligation_id, r.month): (r.remaining, r.late_days) for r in G.obligation_states(events, "2000-02-01", "2000-09-01").collect()}
    want, overdrawn = {}, 0
    for o, _, _, _, _, face, due, since, _ in faces:
        steps = sorted([(d, 2, i, -x) for i, w, d, x, _, _ in pays if w == o] + [(d, 1, i, {"cancel": -x, "reverse": x, "writeoff": 0}[k]) for i, w, k, d, x in changes if w == o])
        for m in range(1, 9):
            end = month(m + 1) - datetime.timedelta(days=1)
            left, low = face, face
            for d, _, _, x in steps:
                if d <= end:
                    left += x
                    low = min(low, left)
            overdrawn += low < 0
            if since <= end and left > 0 and low >= 0:
                want[o, month(m)] = (left, max(0, (end - due).days))
    assert {k: (Decimal(a), b) for k, (a, b) in got.items()} == want and overdrawn > 0 and len(want) > 100


def bits(sign, ref, row):
    if row is None or not row["ok"]:
        return None
    f0, q0, a, p0 = ref
    if sign == "deterioration":
        tests = (row["q"] - q0 >= a, row["f"] <= f0 - a and row["f"] < 0)
    else:
        tests = (q0 >= a and row["q"] <= q0 / 2 and row["p"] - p0 >= a and row["z"] < a and row["f"] >= f0 - a, row["f"] >= f0 + a and row["f"] > 0 and row["q"] <= q0 and row["z"] < a)
    return tests[0] + 2 * tests[1]


def scanned(rows, sign):
    held, unknown, failures, out = None, False, 0, []
    for k in range(3, len(rows)):
        before, after = rows[k - 3 : k], rows[k + 1] if k + 1 < len(rows) else None
        branch = 0
        if held is not None:
            now = bits(sign, held, rows[k])
            if now is None:
                unknown, failures, decision = True, 0, "unknown"
            else:
                failures = failures + 1 if now == 0 else 0
                decision = "unknown" if unknown else "no_event"
                if failures == 2:
                    held, unknown, failures, decision = None, False, 0, "no_event"
        else:
            ref = None
            if all(r["ok"] for r in before) and sum(r["r"] for r in before) > 0:
                ref = (sum(r["f"] for r in before) / 3, before[-1]["q"], max(1000.0, 0.05 * (sum(r["r"] for r in before) / 3)), before[-1]["p"])
            first = bits(sign, ref, rows[k]) if ref else None
            second = bits(sign, ref, after) if ref else None
            hidden = first is None or (first != 0 and second is None)
            branch = (first or 0) & (second or 0)
            decision = "event" if branch else "unknown" if hidden else "no_event"
            if ref and (branch or hidden):
                held, unknown, failures = ref, not branch, 0
        out.append((sign, month(k), decision, branch))
    return out


def test_events_by_a_plain_loop(spark):
    rng = random.Random(3)
    data = {}
    for c in range(40):
        level, paid, data[f"C{c}"] = rng.choice([5e3, 5e4]), 0.0, []
        late = 0.0
        for _ in range(24):
            late = max(0.0, rng.choice([late, late, late * 0.3, late + level * 0.2]))
            paid += rng.choice([0.0, level * 0.1])
            data[f"C{c}"].append({"ok": rng.random() < 0.95, "r": level, "f": round(rng.choice([0.4, 0.4, -0.3, 0.9]) * level, 2), "q": round(late, 2), "z": rng.choice([0.0, 0.0, 2000.0]), "p": round(paid, 2)})
    rows = [(c, month(k), r["ok"], r["r"], r["f"], r["q"], r["z"], r["p"]) for c, series in data.items() for k, r in enumerate(series)]
    months = spark.createDataFrame(rows, "company_id string, month date, is_complete boolean, receipts double, generation double, late double, newly_late double, paid_late double")
    got = {(r.company_id, r.sign, r.month, r.decision, r.branches) for r in P.scanned_events(months).collect()}
    want = {(c, *x) for c, series in data.items() for sign in P.EVENT_SIGNS for x in scanned(series, sign)}
    assert got == want and sum(x[3] == "event" for x in want) > 20 and sum(x[3] == "unknown" for x in want) > 20


def test_signals_by_a_plain_loop(spark):
    rng = random.Random(4)
    rows = [(f"C{c}", month(k), month(k + 1), rng.choice([None, 0.2, 0.6, 0.7, 0.9]), rng.choice([None, 50.0, 50.0, 50.0]), rng.random() < 0.95) for c in range(30) for k in range(30) if rng.random() < 0.9]
    want, states = set(), {}
    for c, m, issued, p, headline, eligible in rows:
        s = states.setdefault(c, {"before": None, "watch": None, "active": False, "below": 0})
        if s["before"] is not None and (m.year - s["before"].year) * 12 + m.month - s["before"].month != 1:
            s["watch"], s["below"] = None, 0
        first = confirmed = None
        if not eligible or p is None or headline is None:
            status, s["watch"], s["below"] = "unavailable", None, 0
        elif p < 0.6:
            status, s["watch"] = "below_threshold", None
            s["below"] += 1
            s["active"] = s["active"] and s["below"] < 2
        else:
            s["below"] = 0
            if s["active"]:
                status = "suppressed"
            elif s["watch"] is None:
                status, s["watch"], first = "watch", issued, issued
            else:
                status, first, confirmed, s["active"], s["watch"] = "confirmed", s["watch"], issued, True, None
        s["before"] = m
        want.add((c, m, status, first, confirmed))
    frame = spark.createDataFrame(rows, "company_id string, month date, issued_on date, probability double, headline double, is_eligible boolean")
    got = {tuple(r) for r in P.issued_signals(frame, ["company_id"]).collect()}
    assert got == want and len({x[2] for x in want}) == 5


@pytest.mark.parametrize("values", [[0.5], [0.0, 1.0], [k / 7 for k in range(8)], None])
def test_metrics_with_ties(spark, values):
    rng = random.Random(5)
    rows = [("k", 0.3, p := rng.choice(values) if values else rng.random(), int(rng.random() < p)) for _ in range(400)] + [("one", 0.3, 0.4, 1), ("one", 0.3, None, 1), ("one", 0.3, 0.4, None)]
    got = {r.key: r for r in X.probability_metrics(spark.createDataFrame(rows, "key string, base double, p double, y int"), ["key"], "p", "y", "base").collect()}
    own = [(p, y) for k, _, p, y in rows if k == "k"]
    positive, negative = [p for p, y in own if y], [p for p, y in own if not y]
    ap = last = 0.0
    for threshold in sorted({p for p, _ in own}, reverse=True):
        seen = [y for p, y in own if p >= threshold]
        recall = sum(seen) / len(positive)
        ap += (recall - last) * sum(seen) / len(seen)
        last = recall
    r = got["k"]
    assert (r.n_rows, r.n_positive) == (400, len(positive)) and r.average_precision == pytest.approx(ap)
    assert r.brier == pytest.approx(sum((p - y) ** 2 for p, y in own) / 400) and r.brier_skill == pytest.approx(1 - sum((p - y) ** 2 for p, y in own) / sum((0.3 - y) ** 2 for _, y in own))
    if negative:
        assert r.roc_auc == pytest.approx(sum((a > b) + 0.5 * (a == b) for a in positive for b in negative) / len(positive) / len(negative))
    assert got["one"].n_rows == 1 and got["one"].average_precision is None and got["one"].roc_auc is None
    bins = defaultdict(list)
    for p, y in own:
        bins[min(int(p * 10), 9)].append((p, y))
    assert r.calibration_error == pytest.approx(sum(abs(sum(p - y for p, y in b)) for b in bins.values()) / 400)


def test_replicates_are_shared_and_cover_the_mean(spark):
    rng = random.Random(6)
    rows = [(f"G{k}", 0.2 + rng.random() / 10, 0.3 + rng.random() / 10) for k in range(400)]
    groups = spark.createDataFrame(rows, "g string, a double, base double").withColumns({"same": X.F.col("a")})
    got = {r.name: r for r in X.group_bootstrap(groups, "g", ["a", "same"], "base").collect()}
    mean = sum(a for _, a, _ in rows) / 400
    assert got["a"].low < mean < got["a"].high and (got["a"].low, got["a"].high) == (got["same"].low, got["same"].high)
    # the spread of a mean of 400 values
    spread = (sum((a - mean) ** 2 for _, a, _ in rows) / 400 / 400) ** 0.5
    assert got["a"].high - got["a"].low == pytest.approx(3.92 * spread, rel=0.2) and got["a_improvement"].low > 0.08
    weights = spark.range(20_000).select(X.replicate_weight(X.F.lit(1), X.F.col("id").cast("string")).alias("w")).groupBy().agg(X.F.avg("w").alias("m"), X.F.var_pop("w").alias("v")).first()
    assert weights.m == pytest.approx(1, abs=0.03) and weights.v == pytest.approx(1, abs=0.05)


def plan_of(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_records_are_dealt_before_they_are_sorted(spark):
    """the few tasks that read a small file must not sort all the records that it generates."""
    plan = plan_of(G.deduplicated(spark.range(9).selectExpr("id", "string(id) w"), ["id"]))
    assert "Aggregate" in plan and "Aggregate" not in plan[plan.index("Exchange hashpartitioning"):]


def statements_of(spark):
    rows = [("s1", "A0", day(0), day(40), True, day(1), "verified", False)]
    return spark.createDataFrame(rows, "coverage_id string, account_id string, from_day date, to_day date, is_complete boolean, known_on date, basis string, is_conflict boolean")


def test_months_of_accounts_are_never_broadcast(spark):
    """the optimizer takes generated months for as small as the accounts, and the join by month multiplied statements before a window sorted them."""
    periods = G.report_months(spark.createDataFrame([("A0",)], "account_id string"), "2000-01-01", "2000-06-01")
    islands = G.coverage_islands(statements_of(spark), periods)
    for rows in (islands, G.covered_months(islands, periods)):
        plan = plan_of(rows)
        assert "Broadcast" not in plan and "SortMergeJoin" in plan
    assert all("month" not in line for line in plan_of(islands).splitlines() if "Window [" in line)


def test_accounts_meet_their_anchors_without_a_broadcast(spark):
    """months of accounts went to the driver with every anchor and with every movement."""
    periods = G.report_months(spark.createDataFrame([("A0", "C0", "EUR")], "account_id string, company_id string, currency string"), "2000-01-01", "2000-06-01")
    anchors = spark.createDataFrame([("n", "A0", day(70), "opening", Decimal("1.00"), True, day(71), "verified", False)], "anchor_id string, account_id string, measured_on date, semantics string, amount decimal(18,2), is_independent boolean, known_on date, basis string, is_conflict boolean")
    moves = spark.createDataFrame([("m", "A0", day(9), Decimal("7.00"), "booked", day(10), "verified", False)], "movement_id string, account_id string, booked_on date, amount decimal(18,2), booking string, known_on date, basis string, is_conflict boolean")
    rates = spark.createDataFrame([("USD", day(59), 2.0)], "currency string, day date, rate double")
    found = G.reconstructed_accounts(periods, anchors, moves, G.coverage_islands(statements_of(spark), periods), rates)
    joins = [line for line in plan_of(found).splitlines() if "BroadcastHashJoin" in line]
    assert all("account_id" not in line for line in joins) and found.count() == 6


def test_no_month_of_accounts_goes_through_the_driver(spark):
    """F1 on stored tables, whose sizes the optimizer knows."""
    from florin.plans import ledger_queries, queries

    assert ledger_queries
    plan = plan_of(queries.queries()["e05_reconstructed_accounts"](spark, "/root/testdata/sf0.001"))
    assert not [line for line in plan.splitlines() if "BroadcastHashJoin [account_id" in line and ("month" in line or "cutoff" in line)]
