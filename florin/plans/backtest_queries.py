"""Registered queries of the cash backtest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from florin.operators import backtest as B
from florin.operators import cash as K
from florin.plans.cash_queries import _tx
from florin.plans.queries import LAST_DAY, STEPS, query
from florin.sources.treasury import Treasury

_FIRST_CUT = "1999-08-31"
STEPS["day_span"] = "SELECT company_id, min(date_ok) AS b, max(date_ok) AS e FROM anchored_days GROUP BY company_id"
STEPS["near_days"] = "SELECT month_end AS cut, d.company_id, d.net, date_diff('day', d.date_ok, month_end) AS ago FROM months JOIN anchored_days d ON d.date_ok > month_end - 90 AND d.date_ok <= month_end + 90"
STEPS["trios"] = """SELECT s.company_id, m.month_end AS cut, h, coalesce(sum(net) FILTER (ago >= 0 AND ago < h), 0) AS persistence, coalesce(sum(net) FILTER (ago >= 0 AND ago < 28), 0) / 28 * h AS moving_mean, coalesce(sum(abs(net)) FILTER (ago >= 0 AND ago < h), 0) AS scale, coalesce(sum(net) FILTER (ago < 0 AND ago >= -h), 0) AS target,
    any_value(s.b <= m.month_end - h AND m.month_end >= (SELECT min(date_ok) FROM anchored_days) + 90) AS is_cut FROM day_span s CROSS JOIN months m CROSS JOIN (VALUES (30), (60), (90)) hs(h) LEFT JOIN near_days d ON d.company_id = s.company_id AND d.cut = m.month_end
    WHERE s.b <= m.month_end AND s.e >= m.month_end + h AND m.month_end + h <= DATE '2001-07-31' GROUP BY s.company_id, m.month_end, h"""
STEPS["pools"] = "SELECT c.h, c.cut, median(t.target) AS global_median FROM (SELECT DISTINCT h, cut FROM trios WHERE is_cut) c JOIN trios t ON t.h = c.h AND t.cut + t.h <= c.cut GROUP BY c.h, c.cut"
STEPS["predicted"] = """SELECT t.*, global_median, CASE WHEN least(persistence, moving_mean) > 0 THEN 'positive' WHEN greatest(persistence, moving_mean) < 0 THEN 'negative' ELSE 'neutral' END AS trend, CASE WHEN target > 0 THEN 'positive' WHEN target < 0 THEN 'negative' ELSE 'neutral' END AS observed FROM trios t LEFT JOIN pools USING (h, cut) WHERE is_cut"""
STEPS["errors"] = "SELECT h, baseline, v - target AS error, abs(v - target) AS size, abs(v - target) / greatest(scale, 1) AS scaled, scale FROM (SELECT *, unnest(['persistence', 'moving_mean', 'global_median']) AS baseline, unnest([persistence, moving_mean, global_median]) AS v FROM predicted WHERE global_median IS NOT NULL)"


def _trios(t: Treasury) -> DataFrame:
    daily = K.cash_flows(_tx(t), "date_ok", K.ANCHORED).select("company_id", F.col("date_ok").alias("day"), "net")
    return B.forecast_trios(daily, _FIRST_CUT, LAST_DAY)


def _rounded(*names: str, digits: int = 4):
    return [F.round(n, digits).alias(n) for n in names]


@query("SELECT h, cut, count(*) AS n_trios, count(global_median) AS n_common FROM predicted GROUP BY h, cut")
def b06_trio_census(t: Treasury) -> DataFrame:
    return B.census(B.predictions(_trios(t)))


@query("SELECT company_id, cut, h, round(persistence, 4) AS persistence, round(moving_mean, 4) AS moving_mean, round(global_median, 4) AS global_median, round(scale, 4) AS scale FROM predicted")
def b07_cash_baselines(t: Treasury) -> DataFrame:
    return B.predictions(_trios(t)).select("company_id", "cut", "h", *_rounded("persistence", "moving_mean", "global_median", "scale"))


@query("SELECT company_id, cut, h, round(target, 4) AS target, is_cut FROM trios")
def b08_observed_targets(t: Treasury) -> DataFrame:
    return _trios(t).select("company_id", "cut", "h", *_rounded("target"), "is_cut")


@query("SELECT h, trend, observed, n, round(n / sum(n) OVER (PARTITION BY h, observed), 6) AS share_of_observed, round(n / sum(n) OVER (PARTITION BY h, trend), 6) AS share_of_trend, round(n / sum(n) OVER (PARTITION BY h), 6) AS share_of_all FROM (SELECT h, trend, observed, count(*) AS n FROM predicted GROUP BY ALL)")
def b09_trend_confusion(t: Treasury) -> DataFrame:
    return B.trend_confusion(B.predictions(_trios(t))).select("h", "trend", "observed", "n", *_rounded("share_of_observed", "share_of_trend", "share_of_all", digits=6))


@query("""SELECT *, rank() OVER (PARTITION BY h ORDER BY mae) AS place_by_mae, rank() OVER (PARTITION BY h ORDER BY median_scaled) AS place_by_scaled FROM (SELECT h, baseline, count(*) AS n, round(avg(size), 4) AS mae, round(avg(error), 4) AS bias, round(sqrt(avg(error * error)), 4) AS rmse, round(median(size), 4) AS p50, round(quantile_cont(size, 0.75), 4) AS p75, round(quantile_cont(size, 0.9), 4) AS p90,
    round(avg(scaled), 4) AS mean_scaled, round(median(scaled), 4) AS median_scaled, count(*) FILTER (scale < 1) AS n_least_scale FROM errors GROUP BY h, baseline)""")
def b10_error_metrics(t: Treasury) -> DataFrame:
    found = B.error_metrics(B.predictions(_trios(t)).persist())
    return found.select("h", "baseline", "n", *_rounded("mae", "bias", "rmse", "p50", "p75", "p90"), *_rounded("mean_scaled", "median_scaled", digits=4), "n_least_scale", F.col("place_by_mae").cast("long").alias("place_by_mae"), F.col("place_by_scaled").cast("long").alias("place_by_scaled"))
