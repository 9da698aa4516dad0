"""Registered queries of economic events, issued signals, metrics of scores and their intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from florin.operators import episodes as P
from florin.operators import metrics as X
from florin.plans.ledger_queries import obligation_panel
from florin.plans.queries import STEPS, query
from florin.sources.ledger import Ledger
from florin.sources.treasury import Treasury

_NAMES = ("last", "mean")
STEPS["economic"] = """SELECT o.company_id, o.month, reasons = '' AS ok, CAST(coalesce(inflow, 0) AS DOUBLE) AS r, CAST(coalesce(inflow, 0) AS DOUBLE) - CAST(operating_due AS DOUBLE) AS f, CAST(late_over_30 AS DOUBLE) AS q, CAST(newly_late AS DOUBLE) AS z,
    CAST(sum(paid_late) OVER (PARTITION BY o.company_id ORDER BY o.month) AS DOUBLE) AS p FROM obligation_panel o LEFT JOIN ledger_cash c ON c.company_id = o.company_id AND c.month = o.month"""
STEPS["referenced"] = """SELECT *, lead(ok) OVER w AS n_ok, lead(f) OVER w AS n_f, lead(q) OVER w AS n_q, lead(z) OVER w AS n_z, lead(p) OVER w AS n_p, row_number() OVER w AS i, CASE WHEN lag(ok, 3) OVER w AND lag(ok, 2) OVER w AND lag(ok, 1) OVER w AND (lag(r, 3) OVER w + lag(r, 2) OVER w + lag(r, 1) OVER w) / 3.0::DOUBLE > 0
    THEN {'f': (lag(f, 3) OVER w + lag(f, 2) OVER w + lag(f, 1) OVER w) / 3.0::DOUBLE, 'q': lag(q) OVER w, 'a': greatest(1000.0::DOUBLE, 0.05::DOUBLE * ((lag(r, 3) OVER w + lag(r, 2) OVER w + lag(r, 1) OVER w) / 3.0::DOUBLE)), 'p': lag(p) OVER w} END AS ref FROM economic WINDOW w AS (PARTITION BY company_id ORDER BY month)"""


def _bits(ref: str, row: str) -> str:
    c = lambda name: f"{row}{name}"
    worse = f"(CASE WHEN {c('q')} - {ref}.q >= {ref}.a THEN 1 ELSE 0 END + CASE WHEN {c('f')} <= {ref}.f - {ref}.a AND {c('f')} < 0 THEN 2 ELSE 0 END)"
    better = f"(CASE WHEN {ref}.q >= {ref}.a AND {c('q')} <= {ref}.q / 2 AND {c('p')} - {ref}.p >= {ref}.a AND {c('z')} < {ref}.a AND {c('f')} >= {ref}.f - {ref}.a THEN 1 ELSE 0 END + CASE WHEN {c('f')} >= {ref}.f + {ref}.a AND {c('f')} > 0 AND {c('q')} <= {ref}.q AND {c('z')} < {ref}.a THEN 2 ELSE 0 END)"
    return f"CASE WHEN {ref} IS NOT NULL AND {c('ok')} THEN CASE WHEN sign = 'deterioration' THEN {worse} ELSE {better} END END"


STEPS["scan_steps"] = f"""WITH RECURSIVE scan AS (SELECT company_id, sign, 3::BIGINT AS i, NULL::DATE AS month, CAST(NULL AS STRUCT(f DOUBLE, q DOUBLE, a DOUBLE, p DOUBLE)) AS held, false AS unk, 0 AS fails, '' AS decision, 0 AS branches FROM (SELECT DISTINCT company_id FROM referenced) CROSS JOIN (VALUES ('deterioration'), ('improvement')) s(sign)
    UNION ALL SELECT company_id, sign, i, month, CASE WHEN held IS NOT NULL THEN CASE WHEN fails2 <> 2 THEN held END WHEN common <> 0 OR hidden THEN ref END, CASE WHEN held IS NOT NULL THEN fails2 <> 2 AND (unk OR now_bits IS NULL) ELSE common = 0 AND hidden AND ref IS NOT NULL END, CASE WHEN held IS NOT NULL AND fails2 <> 2 THEN fails2 ELSE 0 END,
        CASE WHEN held IS NOT NULL THEN CASE WHEN fails2 <> 2 AND (unk OR now_bits IS NULL) THEN 'unknown' ELSE 'no_event' END WHEN common <> 0 THEN 'event' WHEN hidden THEN 'unknown' ELSE 'no_event' END, CASE WHEN held IS NULL THEN common ELSE 0 END
    FROM (SELECT *, CASE WHEN now_bits = 0 THEN fails + 1 ELSE 0 END AS fails2, coalesce(first_bits & second_bits, 0) AS common, first_bits IS NULL OR (first_bits <> 0 AND second_bits IS NULL) AS hidden
        FROM (SELECT s.company_id, s.sign, r.i, r.month, s.held, s.unk, s.fails, r.ref, {_bits('held', 'r.')} AS now_bits, {_bits('ref', 'r.')} AS first_bits, {_bits('ref', 'r.n_')} AS second_bits FROM scan s JOIN referenced r ON r.company_id = s.company_id AND r.i = s.i + 1)))
    SELECT company_id, sign, month, decision, branches FROM scan WHERE i > 3"""


def _economic(l: Ledger) -> DataFrame:
    return P.economic_months(obligation_panel(l), l.ledger_cash.withColumnRenamed("inflow", "receipts"))


@query("SELECT company_id, month, ok AS is_complete, round(r, 2) AS receipts, round(f, 2) AS generation, round(q, 2) AS late, round(z, 2) AS newly_late, round(p, 2) AS paid_late FROM economic")
def e17_economic_months(t: Treasury) -> DataFrame:
    return _economic(Ledger(t)).select("company_id", "month", "is_complete", *(F.round(c, 2).alias(c) for c in ("receipts", "generation", "late", "newly_late", "paid_late")))


@query("SELECT company_id, sign, month, decision, CAST(branches AS INTEGER) AS branches FROM scan_steps")
def e11_scanned_events(t: Treasury) -> DataFrame:
    return P.scanned_events(_economic(Ledger(t)))


STEPS["numbered_origins"] = "SELECT *, row_number() OVER (PARTITION BY company_id, sign ORDER BY month) AS i FROM origins"
STEPS["signal_steps"] = """WITH RECURSIVE fold AS (SELECT company_id, sign, 0::BIGINT AS i, NULL::DATE AS month, NULL::DATE AS watch, false AS active, 0 AS below, '' AS status, NULL::DATE AS first_on, NULL::DATE AS confirmed_on FROM (SELECT DISTINCT company_id, sign FROM origins)
    UNION ALL SELECT company_id, sign, i, month, CASE status WHEN 'watch' THEN issued_on WHEN 'suppressed' THEN watch1 END, CASE WHEN status = 'confirmed' THEN true WHEN status = 'below_threshold' AND below1 + 1 >= 2 THEN false ELSE active END, CASE WHEN status = 'below_threshold' THEN below1 + 1 ELSE 0 END, status,
        CASE status WHEN 'watch' THEN issued_on WHEN 'confirmed' THEN watch1 END, CASE status WHEN 'confirmed' THEN issued_on END
    FROM (SELECT *, CASE WHEN NOT usable THEN 'unavailable' WHEN probability < 0.6 THEN 'below_threshold' WHEN active THEN 'suppressed' WHEN watch1 IS NULL THEN 'watch' ELSE 'confirmed' END AS status
        FROM (SELECT o.*, f.active, CASE WHEN f.month IS NULL OR f.month + INTERVAL 1 MONTH = o.month THEN f.watch END AS watch1, CASE WHEN f.month IS NULL OR f.month + INTERVAL 1 MONTH = o.month THEN f.below ELSE 0 END AS below1, o.is_eligible AND o.headline IS NOT NULL AND o.probability IS NOT NULL AS usable
            FROM fold f JOIN numbered_origins o ON o.company_id = f.company_id AND o.sign = f.sign AND o.i = f.i + 1)))
    SELECT company_id, sign, month, status, first_on AS first_signal_on, confirmed_on FROM fold WHERE i > 0"""


@query("SELECT * FROM signal_steps")
def x08_issued_signals(t: Treasury) -> DataFrame:
    return P.issued_signals(Ledger(t).origins, ["company_id", "sign"])


STEPS["candidates"] = "SELECT company_id, group_id, month, 'last' AS candidate, last AS score, label FROM scored_months UNION ALL SELECT company_id, group_id, month, 'mean', mean, label FROM scored_months"
STEPS["judged"] = "SELECT * FROM candidates WHERE score IS NOT NULL AND label IS NOT NULL"


def _candidates(l: Ledger) -> DataFrame:
    either = F.array(*(F.struct(F.lit(n).alias("candidate"), F.col(n).alias("score")) for n in _NAMES))
    return l.scored_months.select("company_id", "group_id", "month", "label", F.explode(either).alias("_one")).select("company_id", "group_id", "month", "label", "_one.*").withColumn("reference", F.lit(0.5))


STEPS["ranked"] = """SELECT candidate, score, count(*) AS n, sum(label) AS pos, sum(sum(label)) OVER (PARTITION BY candidate ORDER BY score DESC) AS tp, sum(count(*)) OVER (PARTITION BY candidate ORDER BY score DESC) AS seen FROM judged GROUP BY candidate, score"""
STEPS["bins"] = "SELECT candidate, CAST(least(floor(score * 10), 9) AS INTEGER) AS bin, count(*) AS n, avg(score) AS mean_score, avg(label) AS observed FROM judged GROUP BY ALL"


@query("""SELECT candidate, n AS n_rows, CAST(p AS BIGINT) AS n_positive, round(ap, 6) AS average_precision, round(auc, 6) AS roc_auc, round(brier, 6) AS brier, round(1 - brier / base, 6) AS brier_skill, CAST(ta AS BIGINT) AS true_alerts, CAST(fa AS BIGINT) AS false_alerts, round(ta / (ta + fa), 6) AS precision, round(ta / p, 6) AS recall, round(ece, 6) AS calibration_error
    FROM (SELECT candidate, count(*) AS n, sum(label) AS p, avg((score - label) * (score - label)) AS brier, avg((0.5 - label) * (0.5 - label)) AS base, count(*) FILTER (score >= 0.5 AND label = 1) AS ta, count(*) FILTER (score >= 0.5 AND label = 0) AS fa FROM judged GROUP BY candidate) a
    JOIN (SELECT candidate, sum(pos * tp / seen) / sum(pos) AS ap FROM ranked GROUP BY candidate) b USING (candidate) JOIN (SELECT candidate, sum(n * abs(mean_score - observed)) / sum(n) AS ece FROM bins GROUP BY candidate) c USING (candidate)
    JOIN (SELECT x.candidate, sum(CASE WHEN x.score > y.score THEN 1.0 WHEN x.score = y.score THEN 0.5 ELSE 0 END * x.pos * (y.n - y.pos)) / (sum(x.pos * (y.n - y.pos))) AS auc FROM ranked x JOIN ranked y USING (candidate) GROUP BY x.candidate) d USING (candidate)""")
def v07_probability_metrics(t: Treasury) -> DataFrame:
    found = X.probability_metrics(_candidates(Ledger(t)), ["candidate"], "score", "label", "reference")
    exact = ("candidate", "n_rows", "n_positive", "true_alerts", "false_alerts")
    return found.select(*exact, *(F.round(c, 6).alias(c) for c in found.columns if c not in exact))


@query("SELECT candidate, bin, n, round(mean_score, 6) AS mean_score, round(observed, 6) AS observed FROM bins")
def v07_reliability(t: Treasury) -> DataFrame:
    found = X.reliability(_candidates(Ledger(t)), ["candidate"], "score", "label")
    return found.select("candidate", "bin", "n", *(F.round(c, 6).alias(c) for c in ("mean_score", "observed")))


STEPS["group_scores"] = "SELECT company_id, avg((last - label) * (last - label)) AS last, avg((mean - label) * (mean - label)) AS mean, avg((0.5 - label) * (0.5 - label)) AS base FROM scored_months WHERE last IS NOT NULL AND label IS NOT NULL GROUP BY company_id"
_CDF = ", ".join(f"({x!r}::DOUBLE)" for x in (sum(X.math.exp(-1) / X.math.factorial(j) for j in range(k + 1)) for k in range(9)))
STEPS["replicate_draws"] = f"SELECT r, g.*, (SELECT count(*) FROM (VALUES {_CDF}) c(x) WHERE CAST('0x' || substr(md5(concat('{X.SEED}:', r, ':', company_id)), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE >= x) AS w FROM group_scores g CROSS JOIN range({X.REPLICATES}) n(r)"
STEPS["replicate_means"] = "SELECT r, sum(w * last) / sum(w) AS last, sum(w * mean) / sum(w) AS mean, sum(w * base) / sum(w) AS base FROM replicate_draws GROUP BY r"


@query("""SELECT name, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high, count(v) AS n_finite FROM (SELECT unnest(['last', 'mean', 'base', 'last_improvement', 'mean_improvement']) AS name, unnest([last, mean, base, base - last, base - mean]) AS v FROM replicate_means) GROUP BY name""")
def v08_group_bootstrap(t: Treasury) -> DataFrame:
    rows = Ledger(t).scored_months.where("last IS NOT NULL AND label IS NOT NULL").withColumn("base", F.lit(0.5))
    groups = rows.groupBy("company_id").agg(*(F.avg((F.col(c) - F.col("label")) * (F.col(c) - F.col("label"))).alias(c) for c in (*_NAMES, "base")))
    return X.group_bootstrap(groups, "company_id", _NAMES, "base").select("name", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "n_finite")
