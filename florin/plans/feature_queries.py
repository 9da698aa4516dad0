"""Registered queries of model features and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from florin.operators import features as V
from florin.operators.audit import group_split
from florin.plans.queries import STEPS, _flows, query
from florin.sources.treasury import Treasury

FOLDS = (
    V.Fold("fold1_train", ("develop",), "1999-08-01", "2000-06-01", "2000-06-30"), V.Fold("fold1_validation", ("select",), "2000-07-01", "2000-09-01", "2000-12-31"), V.Fold("fold2_train", ("develop",), "1999-08-01", "2000-09-01", "2000-09-30"),
    V.Fold("fold2_validation", ("select",), "2000-10-01", "2000-12-01", "2001-03-31"), V.Fold("final_test", ("test",), "2001-03-01", "2001-04-01", "2001-07-31"),
)
STEPS["account_months"] = "SELECT company_id, month, count(DISTINCT product_id) FILTER (is_cash) AS n_accounts, count(*) FILTER (is_cash AND is_outlier AND (flow_class IN ('operating_in', 'operating_out') OR is_ambiguous)) AS n_outliers, coalesce(sum(abs(amount_eur)) FILTER (is_cash AND flow_class = 'financing_in'), 0) AS fin_in, coalesce(sum(abs(amount_eur)) FILTER (is_cash AND flow_class = 'financing_out'), 0) AS fin_out, coalesce(sum(amount_eur) FILTER (is_cash AND flow_class IN ('operating_in', 'operating_out') AND NOT coalesce(is_outlier, false)), 0) AS op_plain, coalesce(sum(abs(amount_eur)) FILTER (is_cash AND is_ambiguous AND direction = 'in' AND NOT coalesce(is_outlier, false)), 0) AS in_plain, coalesce(sum(abs(amount_eur)) FILTER (is_cash AND is_ambiguous AND direction = 'out' AND NOT coalesce(is_outlier, false)), 0) AS out_plain FROM perimeter GROUP BY ALL"
_STATE = "CASE WHEN round({hi}, 2) < 0 THEN 1.0 WHEN round({lo}, 2) >= 0 THEN 0.0 END"
STEPS["feature_months"] = """SELECT f.company_id, f.group_id, f.month, act, first_cash_month, CASE WHEN NOT act THEN 'no_cash_activity' WHEN n_without_eur <> 0 THEN 'unknown_fx' WHEN volume_known <= 0 THEN 'nonpositive_or_unknown_gross' END AS problem, volume_known AS g, net_known, rec, pay, amb_in, amb_out, n_cash0, n_accounts, fin_in, fin_out,
    CASE WHEN n_hole = 0 THEN rec - pay - amb_out END AS lo, CASE WHEN n_hole = 0 THEN rec - pay + amb_in END AS hi, CASE WHEN n_outliers = 0 THEN CASE WHEN n_hole = 0 THEN rec - pay - amb_out END WHEN n_hole = 0 THEN op_plain - out_plain END AS lo2, CASE WHEN n_outliers = 0 THEN CASE WHEN n_hole = 0 THEN rec - pay + amb_in END WHEN n_hole = 0 THEN op_plain + in_plain END AS hi2 FROM flow_panel f LEFT JOIN account_months a USING (company_id, month)"""
_BASE = {"operating_min_ratio": "lo / g", "operating_max_ratio": "hi / g", "net_ratio": "net_known / g", "operating_in_ratio": "rec / g", "operating_out_ratio": "pay / g", "financing_in_ratio": "fin_in / g", "financing_out_ratio": "fin_out / g", "uncertainty_ratio": "(amb_in + amb_out) / g", "log_gross": "ln(1 + g)", "log_tx": "ln(1 + n_cash0)", "log_accounts": "ln(1 + n_accounts)"}
STEPS["feature_base"] = f"SELECT *, operating_in_ratio - operating_out_ratio AS operating_identified_ratio, CASE WHEN problem IS NULL AND s1 = s2 THEN s1 END AS deficit FROM (SELECT *, {', '.join(f'CASE WHEN problem IS NULL THEN {x} END AS {n}' for n, x in _BASE.items())}, {_STATE.format(lo='lo', hi='hi')} AS s1, {_STATE.format(lo='lo2', hi='hi2')} AS s2 FROM feature_months)"


def _windows(n: int) -> str:
    now, prior = f"(PARTITION BY company_id ORDER BY month ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)", f"(PARTITION BY company_id ORDER BY month ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    place = "month_no"
    fits = {"mean": "avg({c}) OVER {w}", "std": "stddev_pop({c}) OVER {w}", "slope": "regr_slope({c}, " + place + ") OVER {w}"}
    out = [f"CASE WHEN count({c}) OVER {now} = {n} THEN {fits[s].format(c=c, w=now)} END AS {c}_{s}_{n}m" for c, s in V.STATISTICS]
    out += [f"CASE WHEN count(deficit) OVER {now} = {n} THEN avg(deficit) OVER {now} END AS deficit_frequency_{n}m"] + [f"CASE WHEN count({c}) OVER {prior} = {n} THEN {c} - avg({c}) OVER {prior} END AS {c}_delta_prior_{n}m" for c in V.DELTAS]
    lag = lambda k: f"CASE WHEN lag(month, {k}) OVER o IS NULL THEN 'missing_month' ELSE lag(problem, {k}) OVER o END" if k else "problem"
    out += [f"count(*) FILTER (problem IS NULL) OVER {now} AS valid_months_{n}m", f"coalesce({', '.join(lag(k) for k in range(n - 1, -1, -1))}) AS reason_{n}m", f"coalesce({', '.join(lag(k) for k in range(n, 0, -1))}) AS prior_reason_{n}m"]
    return ", ".join(out)


STEPS["features"] = f"""SELECT *, list_concat(list_sort(list_distinct(list_filter([problem, CASE WHEN before1 IS NULL THEN 'missing_month' ELSE problem1 END, CASE WHEN before2 IS NULL THEN 'missing_month' ELSE problem2 END], lambda x: x IS NOT NULL))), CASE WHEN first_cash_month IS NULL OR date_diff('month', first_cash_month, month) < 3 THEN ['less_than_three_prior_months'] ELSE [] END) AS reasons
    FROM (SELECT *, lag(month) OVER o AS before1, lag(month, 2) OVER o AS before2, lag(problem) OVER o AS problem1, lag(problem, 2) OVER o AS problem2, {_windows(3)}, {_windows(6)} FROM (SELECT *, date_diff('month', DATE '1999-08-01', month) AS month_no FROM feature_base) WINDOW o AS (PARTITION BY company_id ORDER BY month))"""
_COUNTS = [f"valid_months_{n}m" for n in V.WINDOWS]
_REASONS = [f"{c}_{n}m" for n in V.WINDOWS for c in ("reason", "prior_reason")]


@query(f"SELECT company_id, group_id, month, last_day(month) AS known_as_of, len(reasons) = 0 AS is_eligible, array_to_string(reasons, ',') AS eligibility_reasons, {', '.join(f'round({n}, 6) AS {n}' for n in V.NAMES)}, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in _COUNTS)}, {', '.join(_REASONS)} FROM features")
def v01_model_features(t: Treasury) -> DataFrame:
    rows = V.model_features(_flows(t))
    return rows.select("company_id", "group_id", "month", "known_as_of", "is_eligible", F.array_join("eligibility_reasons", ",").alias("eligibility_reasons"), *(F.round(n, 6).alias(n) for n in V.NAMES), *(F.col(c).cast("long").alias(c) for c in _COUNTS), *_REASONS)


STEPS["parts"] = "SELECT group_id, CASE WHEN place <= 0.6 THEN 'develop' WHEN place <= 0.8 THEN 'select' ELSE 'test' END AS part FROM (SELECT group_id, row_number() OVER (ORDER BY sha256('split:' || group_id), group_id) / count(*) OVER () AS place FROM (SELECT DISTINCT group_id FROM companies))"
_FOLDS = ", ".join(f"('{f.name}', '{f.groups[0]}', DATE '{f.first}', DATE '{f.last}', DATE '{f.labels_as_of}')" for f in FOLDS)


@query(f"SELECT fold, company_id, f.group_id, month, last_day(month + INTERVAL 3 MONTH) AS label_available_at FROM features f JOIN parts USING (group_id) JOIN (VALUES {_FOLDS}) s(fold, wanted, first, last, labels) ON part = wanted AND month BETWEEN first AND last AND last_day(month + INTERVAL 3 MONTH) <= labels WHERE len(reasons) = 0")
def v03_fold_keys(t: Treasury) -> DataFrame:
    groups = group_split(t.companies, "split").withColumnRenamed("part", "partition")
    return V.fold_keys(V.model_features(_flows(t)), groups, FOLDS)
