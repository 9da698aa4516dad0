"""Column helpers that every treasury operator shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def is_finite(x: Column) -> Column:
    """True for a number that is neither NaN nor infinite; null for null."""
    return F.when(x.isNotNull(), ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def month_start(day: Column) -> Column:
    return F.trunc(day, "MM")


def month_index(day: Column) -> Column:
    """Calendar months since year 0; differences count month boundaries, not 30-day spans."""
    return F.year(day) * 12 + F.month(day)


def missing_text(text: Column) -> Column:
    return text.isNull() | (F.trim(text) == "")


def flags(*terms: tuple[Column, str]) -> Column:
    """Array of the names whose condition is true, in the order given."""
    return F.array_compact(F.array(*(F.when(condition, F.lit(name)) for condition, name in terms)))


def in_window(day: Column, first: str, after: str) -> Column:
    """The day if it is in [first, after), else null."""
    return F.when((day >= F.lit(first).cast("date")) & (day < F.lit(after).cast("date")), day)


def out_of_window(day: Column, first: str, after: str) -> Column:
    return day.isNotNull() & ((day < F.lit(first).cast("date")) | (day >= F.lit(after).cast("date")))


def sum_where(value: Column, condition: Column | None = None) -> Column:
    """Known subtotal: 0 if no row counts."""
    return F.coalesce(F.sum(value if condition is None else F.when(condition, value)), F.lit(0.0))


def known_if(condition: Column, value: Column) -> Column:
    """The total only where nothing in it is unknown; null is never zero."""
    return F.when(condition, value)


def deficit_state(lower: Column, upper: Column) -> Column:
    """True if even the upper bound is negative to the cent, false if the lower one is not, else null."""
    return F.when(F.round(upper, 2) < 0, F.lit(True)).when(F.round(lower, 2) >= 0, F.lit(False))


def joined(names: Column) -> Column:
    """A set of names as sorted text."""
    return F.array_join(F.sort_array(names), ",")


def share(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, part / whole)


def value_positions(rows: DataFrame, keys: Sequence[str], value: str, width: float) -> DataFrame:
    """``(*keys, value, n, start, total)``: per distinct value how often it occurs, how many smaller ones there are, and how many in all.

    Values are counted first and dealt to bands of ``width``; a window runs inside one band of one key, and another over the bands'
    totals, so no task holds all values of a key. Values have to be bounded, so that the bands are.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n")).withColumn("_band", F.floor(F.col(value) / width))
    bands = counted.groupBy(*keys, "_band").agg(F.sum("n").alias("_n"))
    whole = Window.partitionBy(*keys, F.lit(0)) if keys else Window.partitionBy(F.lit(0))
    bands = bands.withColumns({"_before": F.sum("_n").over(whole.orderBy("_band")) - F.col("_n"), "total": F.sum("_n").over(whole)}).drop("_n")
    inside = Window.partitionBy(*keys, "_band").orderBy(value)
    bands = bands.select(*(F.col(k).alias(f"_of_{k}") for k in [*keys, "_band"]), "_before", "total")
    same = [F.col(k) == F.col(f"_of_{k}") for k in [*keys, "_band"]]
    return counted.withColumn("_local", F.sum("n").over(inside) - F.col("n")).join(bands, same).select(*keys, value, "n", (F.col("_before") + F.col("_local")).alias("start"), "total")


def exact_quantiles(rows: DataFrame, keys: Sequence[str], value: str, quantiles: Sequence[float], width: float) -> DataFrame:
    """``(*keys, total, q)``: interpolated quantiles as an array, from value_positions."""
    return _interpolated(value_positions(rows, keys, value, width), keys, value, quantiles)


def _interpolated(positions: DataFrame, keys: Sequence[str], value: str, quantiles: Sequence[float]) -> DataFrame:
    """``(*keys, total, q)`` from the positions of all values, or of those at the asked ranks."""
    asked = F.array(*(F.struct(F.lit(k).alias("k"), (F.lit(float(q)) * (F.col("total") - 1)).alias("at")) for k, q in enumerate(quantiles)))
    dealt = positions.withColumn("a", F.explode(asked))
    holds = lambda place: (place >= F.col("start")) & (place < F.col("start") + F.col("n"))
    low, high = F.floor("a.at"), F.ceil("a.at")
    ends = dealt.groupBy(*keys, "total", "a").agg(F.max(F.when(holds(low), F.col(value))).alias("x"), F.max(F.when(holds(high), F.col(value))).alias("y"))
    ends = ends.select(*keys, "total", F.col("a.k").alias("k"), (F.col("x") + (F.col("y") - F.col("x")) * (F.col("a.at") - F.floor("a.at"))).alias("v"))
    return ends.groupBy(*keys, "total").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda p: p["v"]).alias("q"))


#: Widths that a wide band has, where bands are counted twice.
WIDE = 128


def _ranks_held(bands: DataFrame, keys: Sequence[str], quantiles: Sequence[float]) -> DataFrame:
    """Those of ``(*keys, band, n, start, total)`` that hold a rank which a quantile asks for."""
    at = [F.lit(float(q)) * (F.col("total") - 1) for q in quantiles]
    held = [(rank >= F.col("start")) & (rank < F.col("start") + F.col("n")) for a in at for rank in (F.floor(a), F.ceil(a))]
    return bands.where(F.array_contains(F.array(*held), True))


def kept_quantiles(rows: DataFrame, keys: Sequence[str], value: str, quantiles: Sequence[float], width: float) -> DataFrame:
    """exact_quantiles of rows that are kept (persisted), a few groups of very many rows each: they are read three times and hardly dealt.

    Counts of wide bands, and inside those that hold an asked rank of bands of ``width``, tell which few bands hold the ranks; only their values are counted and ranked.
    """
    fine = F.floor(F.col(value) / width)
    seen = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_value"), fine.alias("_fine"), F.floor(fine / WIDE).alias("_wide"))
    group = lambda *more: Window.partitionBy(*keys, F.lit(0), *more)
    wide = seen.groupBy(*keys, "_wide").agg(F.count("*").alias("n"))
    wide = wide.withColumns({"start": F.sum("n").over(group().orderBy("_wide")) - F.col("n"), "total": F.sum("n").over(group())})

    def inside(bands: DataFrame, band: str) -> DataFrame:
        few = bands.select(*(F.col(k).alias(f"_of_{k}") for k in [*keys, band]), "start", "total")
        return seen.join(F.broadcast(few), [F.col(k) == F.col(f"_of_{k}") for k in [*keys, band]]).drop(*(f"_of_{k}" for k in [*keys, band]))

    def counted(rows: DataFrame, outer: str, by: str) -> DataFrame:
        n = rows.groupBy(*keys, outer, "start", "total", by).agg(F.count("*").alias("n"))
        return n.withColumn("start", F.col("start") + F.sum("n").over(group(outer).orderBy(by)) - F.col("n"))

    bands = _ranks_held(counted(inside(_ranks_held(wide, keys, quantiles), "_wide"), "_wide", "_fine"), keys, quantiles)
    values = counted(inside(bands, "_fine"), "_fine", "_value")
    return _interpolated(values, keys, "_value", quantiles)
