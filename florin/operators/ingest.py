"""Reading text tables tolerantly, rate files, sinks, and the dimension tables that are cleaned from them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from florin.functions.core import flags
from florin.operators.cleaning import day_bad, day_ok, normal_currency

#: Formats of a time stamp besides the ISO one, in the order tried.
TIME_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")
# Country names and their ISO codes, the plausible interest rate, the longest schedule.
COUNTRY_CODES = {"ESPANA": "ES", "ESPANYA": "ES", "SPAIN": "ES", "PORTUGAL": "PT", "ITALIA": "IT", "ALEMANIA": "DE", "MALAYSIA": "MY"}
HIGHEST_RATE = 0.5
LONGEST_SCHEDULE = 600
_ACCENTED, _PLAIN = "ÁÀÂÄÃÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇ", "AAAAAEEEEIIIIOOOOOUUUUNC"


def csv_scan(spark: SparkSession, path: str, columns: Sequence[str], null_text: str = "\\N") -> DataFrame:
    """A CSV file with a header and quoted fields that may span lines; every column is text, an empty field is empty text, and ``null_text`` is null."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"', nullValue=null_text, emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, schema=", ".join(f"`{c}` string" for c in columns))


def typed(text: Column, kind: str) -> Column:
    """Text as ``kind``; null where it does not fit."""
    if kind == "timestamp":
        return F.coalesce(text.try_cast("timestamp"), *(F.try_to_timestamp(text, F.lit(f)) for f in TIME_FORMATS))
    return text if kind == "string" else text.try_cast(kind)


def typed_table(rows: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """Typed columns and ``cast_failures``: the names of columns with a text that did not fit. No row is lost."""
    out = {c: typed(F.col(c), kind) for c, kind in kinds.items()}
    failed = flags(*((F.col(c).isNotNull() & (F.col(c) != "") & out[c].isNull(), c) for c, kind in kinds.items() if kind != "string"))
    return rows.select(*(value.alias(c) for c, value in out.items()), failed.alias("cast_failures"))


def long_rates(wide: DataFrame, day: str = "Date") -> DataFrame:
    """One row per currency and day of a wide rate file; ``N/A`` and columns that are no currency code fall."""
    currencies = [c for c in wide.columns if c != day and len(c) == 3 and c.isupper()]
    long = wide.unpivot(day, currencies, "currency", "text")
    return long.select("currency", F.col(day).try_cast("date").alias("day"), F.col("text").try_cast("double").alias("rate")).where("day IS NOT NULL AND rate > 0")


def record_counts(stored: Mapping[str, DataFrame], source: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per table in the source and as stored."""
    count = lambda frames, column: [f.select(F.lit(name).alias("table_name")).groupBy("table_name").agg(F.count("*").alias(column)) for name, f in frames.items()]

    def together(frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    both = together(count(source, "n_source")).join(together(count(stored, "n_stored")), "table_name", "full")
    return both.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_source", "n_stored")}).withColumn("equal", F.col("n_source") == F.col("n_stored"))


def clean_groups(groups: DataFrame) -> DataFrame:
    erp = F.trim("erp")
    missing = F.col("n_companies").isNull() | (F.col("n_companies") <= 0)
    return groups.select("group_id", F.when(erp != "", F.lower(erp)).alias("erp_norm"), "n_companies", flags((missing, "amount_missing")).alias("quality_flags"))


def country_code(country: Column) -> Column:
    """ISO code of a country name or of two letters, accents and case apart; null if it is neither."""
    key = F.translate(F.upper(F.trim(country)), _ACCENTED, _PLAIN)
    named = F.lit(None).cast("string")
    for name, code in COUNTRY_CODES.items():
        named = F.when(key == name, code).otherwise(named)
    return F.coalesce(named, F.when(key.rlike("^[A-Z]{2}$"), key))


def clean_companies(companies: DataFrame) -> DataFrame:
    present, code = F.col("country").isNotNull() & (F.trim("country") != ""), country_code(F.col("country"))
    found = flags((present & code.isNotNull() & (F.col("country") != code), "country_normalized"), (present & code.isNull(), "country_unknown"))
    return companies.select("company_id", "group_id", F.when(present, code).alias("country_norm"), normal_currency(F.col("currency")).alias("currency_norm"), found.alias("quality_flags"))


def clean_loan_schedules(schedules: DataFrame, banking: DataFrame) -> DataFrame:
    """Schedules with a plausible rate, valid dates, and whether the account that settles them exists."""
    accounts = banking.select(F.col("product_id").alias("_account")).distinct()
    rows = schedules.join(accounts, F.col("settlement_product_id") == F.col("_account"), "left")
    rate, found = F.col("annual_rate"), F.col("_account").isNotNull()
    periods = F.col("total_periods")
    noted = flags(
        (day_bad(F.col("next_payment_date")), "date_out_of_range"), (rate.isNotNull() & ((rate < 0) | (rate > HIGHEST_RATE)), "amount_extreme"),
        (periods.isNull() | (periods <= 0) | (periods > LONGEST_SCHEDULE), "amount_missing"), (~found, "fk_orphan"),
    )
    return rows.select("product_id", "company_id", day_ok(F.col("next_payment_date")).alias("next_payment_date_ok"), F.when((rate >= 0) & (rate <= HIGHEST_RATE), rate).alias("interest_rate_ok"), found.alias("settlement_product_found"), noted.alias("quality_flags"))


def zstd_parquet(rows: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """Write rows ordered by key within files, ZSTD-compressed, and read them back."""
    rows.repartition(*keys).sortWithinPartitions(*keys).write.mode("overwrite").option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.parquet(path)


def nested_profiles(points: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key with its points in order; the text is JSON."""
    rest = [c for c in points.columns if c != key]
    listed = F.sort_array(F.collect_list(F.struct(order, *(c for c in rest if c != order))))
    return points.groupBy(key).agg(F.count("*").alias("n_points"), F.to_json(listed).alias("points"))


# Texts that stand for nothing.
NULL_TEXTS = ("", "null", "none", "na", "n/a")
CORRUPT = "_corrupt_record"


def csv_profile(spark: SparkSession, path: str, columns: Sequence[str], separator: str = ",") -> DataFrame:
    """Per column of a CSV file without header the type that its values have, with the file's rows and malformed rows; one pass.

    A row with more or fewer fields than columns is malformed; the fields that it has count. Types are null, integer, number, string, or mixed where several occur.
    """
    schema = ", ".join(f"`{c}` string" for c in [*columns, CORRUPT])
    rows = spark.read.csv(path, schema=schema, sep=separator, escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, emptyValue="", enforceSchema=True)

    def kind(c: str) -> Column:
        text = F.trim(F.col(c))
        nothing = text.isNull() | F.lower(text).isin(*NULL_TEXTS)
        return F.when(nothing, None).when(text.rlike(r"^[+-]?[0-9]+$"), "integer").when(text.try_cast("double").isNotNull(), "number").otherwise("string")

    seen = rows.agg(F.count("*").alias("n_rows"), F.count(CORRUPT).alias("n_malformed"), *(F.collect_set(kind(c)).alias(c) for c in columns))
    each = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("kinds")) for c in columns))
    found = seen.select("n_rows", "n_malformed", F.explode(each).alias("_one")).select("_one.*", "n_rows", "n_malformed")
    only = F.when(F.size("kinds") == 0, "null").when(F.size("kinds") == 1, F.col("kinds")[0]).otherwise("mixed")
    return found.select("column", only.alias("inferred_type"), "n_rows", "n_malformed")


def exact_mean(rate: Column, digits: int) -> Column:
    """Mean of quotes, which are decimals of at most ten places, rounded half up. A sum of doubles depends on the order of its rows, which shows where the mean is a half."""
    return F.round(F.avg(F.round(rate, 10).cast("decimal(20, 10)")), digits).cast("double")


def monthly_observations(rows: DataFrame, lag_days: int) -> DataFrame:
    """Rates per currency, month and kind from text observations with periods like ``2026-M08``; what cannot be read falls.

    Observations that repeat one another are one; those that contradict are marked and have no rate. A rate is available some days after its month's end.
    """
    parts = F.regexp_extract("period", r"^([0-9]{4})-M(0[1-9]|1[0-2])$", 1), F.regexp_extract("period", r"^([0-9]{4})-M(0[1-9]|1[0-2])$", 2)
    month = F.when(parts[0] != "", F.make_date(parts[0].try_cast("int"), parts[1].try_cast("int"), F.lit(1)))
    read = rows.select("currency", month.alias("month"), "kind", F.col("value").try_cast("double").alias("value")).where("month IS NOT NULL AND value > 0")
    found = read.groupBy("currency", "month", "kind").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    contradicts = F.col("low") != F.col("high")
    return found.select("currency", "month", "kind", "n", F.when(~contradicts, F.col("low")).alias("rate"), contradicts.alias("is_contradiction"), F.date_add(F.last_day("month"), lag_days).alias("available_on"))
