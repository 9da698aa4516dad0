"""The score's shared steps: what is computed once, and where nothing generated is broadcast."""

import datetime
import random
import re

from florin.functions.core import exact_quantiles, kept_quantiles
from florin.operators import arrears as A
from florin.operators import scoring as H
from florin.operators import exposure as E
from florin.operators import fx_risk as R
from florin.operators.fx import fx_index
from florin.plans import coverage_queries, fx_risk_queries, score_queries
from florin.sources.treasury import Treasury

SMALL = "/root/testdata/sf0.001"


def plan_of(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_inputs_read_invoices_once_and_keep_no_panel(spark):
    """Panels of 60 columns were kept, and months of companies broadcast."""
    plan = plan_of(score_queries._inputs(Treasury(spark, SMALL)))
    assert "InMemoryTableScan" not in plan
    assert not [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "[company_id" in line and "month" in line and "pattern" not in line]
    assert plan.count("o_orderpriority") and plan.count("DataFilters: [isnotnull(o_orderstatus") <= 1


def test_movements_are_read_once_and_products_are_not_broadcast(spark):
    """Movements were read three times to learn categories, and products, generated from customers, were taken for small and broadcast."""
    plan = plan_of(score_queries._inputs(Treasury(spark, SMALL)))
    assert plan.count("lineitem.parquet") == 1
    assert not [line for line in plan.splitlines() if "BroadcastHashJoin [product_id" in line]


def test_arrears_of_months_in_which_nothing_happens(spark):
    """Invoices are dealt to months in which they are late only; against the panel that deals every month, with gaps."""
    rng = random.Random(5)
    day = lambda k: datetime.date(2000, 1, 1) + datetime.timedelta(days=k)
    rows = [(f"C{rng.randrange(8)}", rng.choice(["ap", "ar"]), day(due := rng.randrange(-200, 500)), rng.choice([None, day(due + rng.randrange(-40, 260)), day(due)]), rng.choice([None, 0.0, float(rng.randrange(1, 9000))])) for _ in range(60)]
    due = spark.createDataFrame(rows, "company_id string, side string, due date, paid date, eur double")
    first, last = "2000-02-01", "2001-04-01"
    panel = {(r.company_id, r.month): r for r in A.arrears_panel(due, first, last).collect()}
    index = A.arrears_index(A.severity(due, first, last)).collect()
    near = lambda a, b: a is None and b is None or abs(a - b) < 1e-9 * max(1.0, abs(b))
    for r in index:
        found = panel[r.company_id, r.month]
        assert near(found.ap, r.ap) and near(found.ar, r.ar) and near(found.arrears, r.arrears)
    owed = {(r.company_id, r.month): r for r in A.overdue_obligation(due, first, last).collect()}
    for key, found in panel.items():
        assert (found.n_overdue or 0) == (owed[key].n_overdue if key in owed else 0)
        assert key not in owed or near(found.overdue_eur, owed[key].overdue_eur) and all(near(found[f"bucket_{k}"], owed[key][f"bucket_{k}"]) for k in range(5))
    # the smoothing against a plain loop
    for side in ("ap", "ar"):
        for company in {r[0] for r in rows}:
            drawn = [r for r in A._with_robust(A.severity(due, first, last)).where(f"company_id = '{company}' AND side = '{side}'").orderBy("month").collect()] if company == "C0" else []
            smooth = None
            for r in drawn:
                smooth = smooth if r.drawn is None else r.drawn if smooth is None else A.SMOOTHING * r.drawn + (1 - A.SMOOTHING) * smooth
                assert near(r.robust, None if r.drawn is None else smooth)


def test_later_scores_are_not_joined(spark):
    """Scored months met themselves in a join that was made three times; here against a plain loop, with gaps."""
    rng = random.Random(3)
    month = lambda k: datetime.date(2000 + k // 12, k % 12 + 1, 1)
    rows = [(f"C{c}", month(k), rng.choice([None, 1.0, 2.0, float(rng.randrange(100))])) for c in range(6) for k in range(20) if rng.random() < 0.8]
    scored = spark.createDataFrame(rows, "company_id string, month date, score double")
    known = {(c, m): s for c, m, s in rows if s is not None}
    for name, found in (("errors", H.baseline_errors(scored)), ("auto", H.autocorrelation(scored))):
        assert not [line for line in plan_of(found).splitlines() if "Join [company_id" in line]
        got = {r.h: r.n for r in found.collect() if name == "auto" or r.baseline == "median"}
        assert got == {h: sum((c, month(12 * (m.year - 2000) + m.month - 1 + h)) in known for c, m in known) for h in (1, 2, 3)}


def test_calendars_shuffle_no_cuts_of_invoices(spark):
    """every paid invoice was shuffled once a cut, and every live one twice, by its cut and by its cut and age."""
    plan = plan_of(coverage_queries.p16_collections_calendar(Treasury(spark, SMALL)))
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert dealt and not [keys for keys in dealt if "cut" in keys and ("company_id" in keys or "age" in keys)]


def test_months_of_receivables_are_not_shuffled(spark):
    """live receivables were shuffled once a month, twice, and by their company and month, and so were the scores that they met."""
    t = Treasury(spark, SMALL)
    keys = lambda rows: [re.sub(r"#\d+", "", k) for k in re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan_of(rows))]
    by_month = lambda rows: len([k for k in keys(rows) if "company_id" in k and "month" in k])
    risk = keys(fx_risk_queries._risk(t))
    assert "company_id" in risk and not [k for k in risk if "operation_id" in k or ("company_id" in k and "," in k)]
    assert not [k for k in keys(coverage_queries.r06_currency_exposure(t)) if "company_id" in k and "," in k]
    score = by_month(score_queries.h03_health_score(t))
    assert score and by_month(fx_risk_queries.r13_fx_counterfactual(t)) == by_month(fx_risk_queries.h03_score_with_fx(t)) == score


def test_receivables_of_one_operation_keep_their_own_rates(spark):
    """the rate at issue was looked up by operation, so that one booked in two rows had each row twice and one without a number none; here against a plain loop."""
    rng = random.Random(5)
    day = lambda k: datetime.date(2000, 1, 1) + datetime.timedelta(k)
    rates = {(c, day(k)): rng.randrange(50, 200) / 100 for c in ("USD", "GBP") for k in range(20, 150) if rng.random() < 0.3}
    rows = []
    for k in range(300):
        issued, paid = rng.randrange(120), rng.random() < 0.5
        own = rng.choice([None, float(rng.randrange(1, 500))])
        rows.append((rng.choice(["O1", "O2", None, f"O{k}"]), f"C{rng.randrange(5)}", rng.choice(["EUR", "USD", "GBP", "XAF"]), float(rng.randrange(-100, 900)), day(issued), day(issued + rng.randrange(90)), "paid" if paid else "pending", "invoice", own, "unknown" if own is None else "reported", rng.random() < 0.3))
    invoices = spark.createDataFrame(rows, "operation_id string, company_id string, currency string, amount double, issuance_date_ok date, payment_date_ok date, status_norm string, document_type_norm string, amount_eur double, amount_eur_source string, fx_ambiguous boolean")
    quotes = spark.createDataFrame([(*k, r) for k, r in rates.items()], "currency string, day date, rate double")
    found = R.risk_by_currency(R.valued_receivables(E.receivables(invoices, "2000-01-01", "2000-05-01"), quotes, "2000-01-01", "2000-05-01"), fx_index(quotes))
    at = lambda c, d: next((rates[c, x] for x in (d - datetime.timedelta(n) for n in range(200)) if (c, x) in rates), None)
    wanted = {}
    for _, company, currency, amount, issued, paid, status, _, own, _, doubtful in rows:
        for m in range(1, 6):
            end = datetime.date(2000, m + 1, 1) - datetime.timedelta(1)
            if amount <= 0 or issued > end or (status == "paid" and paid <= end):
                continue
            first, cut = at(currency, issued), at(currency, end)
            value = amount if currency == "EUR" else own if own is not None and not doubtful else amount / first if first else None
            then = amount if currency == "EUR" else amount / cut if cut else None
            sums = wanted.setdefault((company, datetime.date(2000, m, 1), currency), [0, 0, 0.0, 0, 0.0])
            for k, x in enumerate((1, value is not None, value or 0.0, then is not None, then or 0.0)):
                sums[k] += x
    got = {(r.company_id, r.month, r.currency): (r.n, r.n_at_issue, round(r.issue_eur, 6), r.n_at_cut, round(r.cut_eur, 6)) for r in found.collect()}
    assert len(got) > 50 and got == {k: tuple(round(x, 6) if isinstance(x, float) else x for x in v) for k, v in wanted.items()}


def test_quantiles_of_kept_rows_are_those_of_all_values(spark):
    """b04_baseline_errors dealt every error, nine times a scored month, to count its distinct values; counts of bands tell first which few are asked."""
    rng = random.Random(6)
    rows = [(g, v) for g in ("a", "b", None) for v in [None, 0.0, 0.0, *(rng.choice([round(rng.uniform(-3, 3), 3), rng.expovariate(0.02), float(rng.randrange(4))]) for _ in range(rng.randrange(200, 400)))]] + [("one", 7.25), ("none", None)]
    kept = spark.createDataFrame(rows, "g string, v double").persist()
    for keys, asked in (["g"], (0.0, 0.25, 0.5, 0.9, 1.0)), ([], (0.5, 0.75)):
        got, want = ({tuple(r[k] for k in [*keys, "total"]): r.q for r in quantiles(kept, keys, "v", asked, 0.01).collect()} for quantiles in (kept_quantiles, exact_quantiles))
        assert got == want and len(got) == (3 if keys else 1)
    plan = plan_of(kept_quantiles(kept, ["g"], "v", (0.5,), 0.01))
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan


def test_errors_and_ranks_are_not_dealt_once_a_horizon(spark):
    """Scored months were dealt three times by their horizon and value, for x and for y, and errors nine times."""
    t = Treasury(spark, SMALL)
    keys = lambda rows: [re.sub(r"#\d+", "", k) for k in re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan_of(rows))]
    dealt = keys(score_queries.b05_autocorrelation(t))
    assert dealt.count("score") >= 2 and not [k for k in dealt if re.match(r"h, |x, |y, |.*, [xy]$", k)]
    plan = plan_of(score_queries.b04_baseline_errors(t))
    assert "size" not in [k.split(", ")[-1] for k in keys(score_queries.b04_baseline_errors(t))] and "BroadcastHashJoin" in plan


def test_correlations_of_ranks_against_a_plain_loop(spark):
    rng = random.Random(8)
    month = lambda k: datetime.date(2000 + k // 12, k % 12 + 1, 1)
    known = {(c, k): rng.choice([0.0, 100.0, float(rng.randrange(6)), rng.uniform(0, 100)]) for c in range(30) for k in range(15) if rng.random() < 0.8}
    scored = spark.createDataFrame([(f"C{c}", month(k), s) for (c, k), s in known.items()] + [("C0", month(20), None)], "company_id string, month date, score double")
    mean_rank = lambda values: {v: sum(w < v for w in values) + (values.count(v) + 1) / 2 for v in set(values)}

    def corr(xs, ys):
        mx, my = sum(xs) / len(xs), sum(ys) / len(ys)
        return sum((x - mx) * (y - my) for x, y in zip(xs, ys)) / (sum((x - mx) ** 2 for x in xs) * sum((y - my) ** 2 for y in ys)) ** 0.5

    for r in H.autocorrelation(scored).collect():
        pairs = [(s, known[c, k + r.h]) for (c, k), s in known.items() if (c, k + r.h) in known]
        xs, ys = map(list, zip(*pairs))
        rx, ry = mean_rank(xs), mean_rank(ys)
        assert r.n == len(pairs) and abs(r.pearson - corr(xs, ys)) < 1e-9 and abs(r.spearman - corr([rx[x] for x in xs], [ry[y] for y in ys])) < 1e-9
