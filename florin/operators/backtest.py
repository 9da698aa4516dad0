"""Backtest of cash-flow baselines: what was known at a month's end against what followed in 30, 60 and 90 days.

A cut is a closed month's end. Everything a company needs at its cuts is summed in one pass: every day of movements goes to the few cuts within 90 days of it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from florin.functions.core import exact_quantiles

# Horizons in days, days of the moving average, history before the first cut, least scale of an error.
HORIZONS = (30, 60, 90)
MEAN_DAYS, WARMUP_DAYS, LEAST_SCALE = 28, 90, 1.0
BASELINES = ("persistence", "moving_mean", "global_median")
#: Bands of a value per doubling, where medians of growing pools are looked for.
BANDS = 16
#: Widths of the bands that errors are ranked in.
ERROR_WIDTH, SCALED_WIDTH = 20_000.0, 0.05


def cut_windows(daily: DataFrame, first: str, last: str) -> DataFrame:
    """``(company_id, cut, seen_28, and seen_h, scale_h, ahead_h per horizon)``: net flow of the days up to a cut, its gross volume, and net flow of the days after it."""
    reach = HORIZONS[-1] // 28 + 1
    cut = F.explode(F.array(*(F.last_day(F.add_months("day", k)) for k in range(-reach, reach + 1))))
    near = daily.select("company_id", "day", "net", cut.alias("cut")).withColumn("ago", F.datediff("cut", "day"))
    near = near.where((F.col("ago") < HORIZONS[-1]) & (F.col("ago") >= -HORIZONS[-1]) & (F.col("cut") >= F.lit(first).cast("date")) & (F.col("cut") <= F.lit(last).cast("date")))
    ago, net = F.col("ago"), F.col("net")
    total = lambda condition, value=net: F.coalesce(F.sum(F.when(condition, value)), F.lit(0.0))
    back = lambda days: (ago >= 0) & (ago < days)
    sums = [total(back(MEAN_DAYS)).alias("seen_28")]
    for h in HORIZONS:
        sums += [total(back(h)).alias(f"seen_{h}"), total(back(h), F.abs(net)).alias(f"scale_{h}"), total((ago < 0) & (ago >= -h)).alias(f"ahead_{h}")]
    return near.groupBy("company_id", "cut").agg(*sums)


def forecast_trios(daily: DataFrame, first: str, last: str) -> DataFrame:
    """``(company_id, cut, h, ...)``: predictions and target wherever h days before and after a cut lie within a company's span of days, and those after before ``last``.

    ``is_cut`` marks cuts with enough history in the panel; the others only feed the pools.
    """
    span = daily.groupBy("company_id").agg(F.min("day").alias("begin"), F.max("day").alias("end"))
    start = daily.agg(F.min("day").alias("_start"))
    months = F.sequence(F.trunc("begin", "MM"), F.trunc("end", "MM"), F.expr("INTERVAL 1 MONTH"))
    grid = span.select("company_id", "begin", "end", F.explode(months).alias("_month")).select("company_id", "begin", "end", F.last_day("_month").alias("cut"))
    grid = grid.where((F.col("cut") >= F.lit(first).cast("date")) & (F.col("begin") <= F.col("cut")))
    rows = grid.join(cut_windows(daily, first, last), ["company_id", "cut"], "left").crossJoin(F.broadcast(start))  # one row
    value = lambda name, h: F.coalesce(f"{name}_{h}", F.lit(0.0))
    each = F.array(*(F.struct(F.lit(h).alias("h"), value("seen", h).alias("persistence"), (F.coalesce("seen_28", F.lit(0.0)) / MEAN_DAYS * h).alias("moving_mean"), value("scale", h).alias("scale"), value("ahead", h).alias("target")) for h in HORIZONS))
    trios = rows.withColumn("_one", F.explode(each)).select("company_id", "cut", "begin", "end", "_start", "_one.*")
    ahead = F.date_add("cut", F.col("h"))
    trios = trios.where((F.col("end") >= ahead) & (ahead <= F.lit(last).cast("date")))
    return trios.withColumn("is_cut", (F.col("begin") <= F.date_sub("cut", F.col("h"))) & (F.col("cut") >= F.date_add("_start", WARMUP_DAYS))).drop("begin", "end", "_start")


def _band(value: Column) -> Column:
    """Bands that rise with the value, a few per doubling of its size."""
    return (F.signum(value) * F.floor(BANDS * F.log2(1 + F.abs(value)))).cast("long")


def pooled_medians(trios: DataFrame) -> DataFrame:
    """``(cut, h, global_median)``: the median over all companies of the flows after earlier cuts whose h days had passed by this one.

    The pool grows from cut to cut, so it is never built. Counts per cut and band of values are carried on to later cuts, which shows the bands of the two middle
    ranks; only the values of those bands are counted and ranked.
    """
    values = trios.select("h", F.col("cut").alias("origin"), F.col("target").alias("value"), _band(F.col("target")).alias("band"))
    origins = values.groupBy("h", "origin", "band").agg(F.count("*").alias("n"))
    cuts = trios.where("is_cut").select("h", "cut").distinct()
    carried = origins.join(cuts, "h").where(F.date_add("origin", F.col("h")) <= F.col("cut")).groupBy("h", "cut", "band").agg(F.sum("n").alias("n"))
    pool = Window.partitionBy("h", "cut")
    placed = carried.withColumns({"start": F.sum("n").over(pool.orderBy("band")) - F.col("n"), "total": F.sum("n").over(pool)})
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    wanted = placed.where((F.col("start") <= high) & (F.col("start") + F.col("n") > low)).select("h", "cut", "band", "start", "total")
    counted = values.groupBy("h", "origin", "band", "value").agg(F.count("*").alias("n"))
    inside = wanted.join(counted, ["h", "band"]).where(F.date_add("origin", F.col("h")) <= F.col("cut")).groupBy("h", "cut", "band", "start", "total", "value").agg(F.sum("n").alias("n"))
    ranked = inside.withColumn("_from", F.col("start") + F.sum("n").over(Window.partitionBy("h", "cut", "band").orderBy("value")) - F.col("n"))
    at = lambda rank: F.max(F.when((F.col("_from") <= rank) & (F.col("_from") + F.col("n") > rank), F.col("value")))
    return ranked.groupBy("h", "cut").agg(at(low).alias("_a"), at(high).alias("_b")).select("h", "cut", ((F.col("_a") + F.col("_b")) / 2).alias("global_median"))


def predictions(trios: DataFrame) -> DataFrame:
    """The trios at cuts with all baselines, and the direction that the company's own two agree on."""
    rows = trios.where("is_cut").join(pooled_medians(trios), ["h", "cut"], "left").drop("is_cut")
    lower, upper = F.least("persistence", "moving_mean"), F.greatest("persistence", "moving_mean")
    sign = lambda low, high: F.when(low > 0, "positive").when(high < 0, "negative").otherwise("neutral")
    return rows.withColumns({"trend": sign(lower, upper), "observed": sign(F.col("target"), F.col("target"))})


def census(rows: DataFrame) -> DataFrame:
    """Trios, companies and how many have every baseline, per horizon and cut."""
    return rows.groupBy("h", "cut").agg(F.count("*").alias("n_trios"), F.count("global_median").alias("n_common"))


def error_metrics(rows: DataFrame) -> DataFrame:
    """Per horizon and baseline, over the trios that all baselines predict: absolute errors, bias, root mean square, and errors over the company's own volume; with the places by mean error and by median scaled error."""
    common = rows.where(F.col("global_median").isNotNull())
    each = F.array(*(F.struct(F.lit(b).alias("baseline"), (F.col(b) - F.col("target")).alias("error")) for b in BASELINES))
    errors = common.withColumn("_one", F.explode(each)).select("h", "_one.*", "scale").withColumns({"size": F.abs("error"), "scaled": F.abs("error") / F.greatest("scale", F.lit(LEAST_SCALE))})
    keys = ["h", "baseline"]
    means = errors.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("size").alias("mae"), F.avg("error").alias("bias"), F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"), F.avg("scaled").alias("mean_scaled"), F.count_if(F.col("scale") < LEAST_SCALE).alias("n_least_scale"))
    sizes = exact_quantiles(errors, keys, "size", (0.5, 0.75, 0.9), ERROR_WIDTH).select(*keys, *(F.col("q")[k].alias(f"p{p}") for k, p in enumerate((50, 75, 90))))
    scaled = exact_quantiles(errors, keys, "scaled", (0.5,), SCALED_WIDTH).select(*keys, F.col("q")[0].alias("median_scaled"))
    place = lambda c: F.rank().over(Window.partitionBy("h").orderBy(c))  # noqa: E731  three rows a horizon
    return means.join(sizes, keys).join(scaled, keys).withColumns({"place_by_mae": place("mae"), "place_by_scaled": place("median_scaled")})


def trend_confusion(rows: DataFrame) -> DataFrame:
    """How often a trend met each observed direction, with recall and precision of the pair and whether it is right."""
    pairs = rows.groupBy("h", "trend", "observed").agg(F.count("*").alias("n"))
    whole = lambda *keys: F.sum("n").over(Window.partitionBy("h", *keys))  # noqa: E731  nine rows a horizon
    return pairs.withColumns({"share_of_observed": F.col("n") / whole("observed"), "share_of_trend": F.col("n") / whole("trend"), "share_of_all": F.col("n") / whole()})
