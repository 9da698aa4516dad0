"""Audits and small batch reports over the treasury tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CASH_CATEGORIES = ("cash_withdrawal", "pos_withdrawal")


def disposition(tx: DataFrame, cash: tuple[str, ...]) -> DataFrame:
    """Where every movement ends up: the first reason that keeps it out of the cash perimeter, or that it is in; counts add up to all rows."""
    step = (
        F.when(F.col("month").isNull(), "no_valid_date").when(F.col("is_open_month"), "open_month").when(~F.col("is_booked"), "not_booked").when(F.col("product_source") == "orphan", "orphan")
        .when(F.col("product_source") == "debt", "debt_product").when(~F.coalesce(F.col("product_type").isin(*cash), F.lit(False)), "other_account").when(F.col("amount_eur").isNull(), "no_eur").otherwise("in_perimeter")
    )
    return tx.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.sum(F.abs("amount")).alias("amount"))


def gross_exposure(tx: DataFrame) -> DataFrame:
    """Gross known inflow and outflow per company and month, and the movements without a known amount."""
    eur = F.col("amount_eur")
    return tx.groupBy("company_id", "month").agg(F.sum(F.when(eur > 0, eur)).alias("gross_in"), F.sum(F.when(eur < 0, -eur)).alias("gross_out"), F.count_if(eur.isNull()).alias("n_unknown"))


def gap_histogram(tx: DataFrame) -> DataFrame:
    """How many accounts have a longest gap between movements of up to 7, 30, 90 days or more."""
    gaps = tx.where("date_ok IS NOT NULL").select("product_id", F.datediff("date_ok", F.lag("date_ok").over(Window.partitionBy("product_id").orderBy("date_ok"))).alias("gap"))
    longest = gaps.groupBy("product_id").agg(F.max("gap").alias("gap"))
    band = F.when(F.col("gap").isNull(), "single").when(F.col("gap") <= 7, "7").when(F.col("gap") <= 30, "30").when(F.col("gap") <= 90, "90").otherwise("over_90")
    return longest.groupBy(band.alias("longest_gap")).agg(F.count("*").alias("n_products"))


def transfer_scope(perimeter: DataFrame) -> DataFrame:
    """Cash movements classed as transfers; withdrawals count as operating payments, the rest stays ambiguous."""
    rows = perimeter.where(F.col("is_cash") & (F.col("flow_class") == "transfer"))
    cash = F.coalesce(F.col("category_norm").isin(*CASH_CATEGORIES), F.lit(False))
    return rows.select("transaction_id", "company_id", "month", "amount_eur", F.when(cash, "operating_out").otherwise("ambiguous").alias("resolved_class"), F.when(cash, "R1").alias("rule"))


def resolution_coverage(resolved: DataFrame) -> DataFrame:
    """Share of the transfer volume that is resolved, per month."""
    size, done = F.abs("amount_eur"), F.col("rule").isNotNull()
    return resolved.groupBy("month").agg(F.count("*").alias("n"), F.count_if(done).alias("n_resolved"), F.coalesce(F.sum(F.when(done, size)), F.lit(0.0)).alias("resolved_eur"), F.sum(size).alias("all_eur"))


def group_split(companies: DataFrame, seed: str, shares: tuple[float, float] = (0.6, 0.8)) -> DataFrame:
    """Groups in the order of a hash, the first 60 % for development, 20 % for selection, the rest for the final test."""
    groups = companies.select("group_id").distinct().withColumn("digest", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("group_id")), 256))
    # ranked inside bands of the digest and shifted by the bands before, so that no task sorts all groups
    groups = groups.withColumn("band", F.substring("digest", 1, 3))
    bands = groups.groupBy("band").agg(F.count("*").alias("n"))
    bands = bands.select("band", (F.sum("n").over(Window.orderBy("band")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("all"))
    place = F.row_number().over(Window.partitionBy("band").orderBy("digest", "group_id")) + F.col("before")
    ranked = groups.join(bands, "band").withColumn("place", place / F.col("all"))
    return ranked.select("group_id", F.when(F.col("place") <= shares[0], "develop").when(F.col("place") <= shares[1], "select").otherwise("test").alias("part"))


def committed_path(live: DataFrame, start: DataFrame, cut: str, days: int = 90) -> DataFrame:
    """Cash of every company over the days after a cut if what is open is paid when due: lowest balance, first shortfall, funding needed.

    ``live`` has (company_id, side, due, eur); what is already due counts on the first day.
    """
    first, last = F.date_add(F.lit(cut).cast("date"), 1), F.date_add(F.lit(cut).cast("date"), days)
    moves = live.where(F.col("due") <= last).groupBy("company_id", F.greatest("due", first).alias("day")).agg(F.sum(F.when(F.col("side") == "ar", F.col("eur")).otherwise(-F.col("eur"))).alias("net"), F.count_if(F.col("eur").isNull()).alias("n_unknown"))
    so_far = Window.partitionBy("company_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    path = moves.join(start.where("anchor IS NOT NULL"), "company_id").withColumn("balance", F.col("anchor") + F.sum(F.coalesce("net", F.lit(0.0))).over(so_far))
    return path.groupBy("company_id").agg(
        F.min("balance").alias("lowest"), F.min_by("day", F.struct("balance", "day")).alias("lowest_day"), F.min(F.when(F.col("balance") < 0, F.col("day"))).alias("first_shortfall"), F.greatest(F.lit(0.0), -F.min("balance")).alias("funding_needed"), F.sum("n_unknown").alias("n_unknown"))


def coverage(position: DataFrame) -> DataFrame:
    """Companies and months per confidence."""
    return position.groupBy("confidence").agg(F.count_distinct("company_id").alias("n_companies"), F.count("*").alias("n_months"))
