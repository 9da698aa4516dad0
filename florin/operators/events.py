"""Transitions of the operating state, alerts from episodes, and how alerts meet events."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The states around an onset, and the months that an alert may lead.
PATTERNS = {"deterioration": (False, False, True, True), "improvement": (True, True, False, False), "recovered_dip": (False, False, True, False, False)}
SIGNS = {"improving": "improvement", "deteriorating": "deterioration"}
LEADS = (1, 2)
_MATCH = "company_id string, sign string, method string, origin_month date, event_month date, lead_months int"


def _by_company() -> Window:
    return Window.partitionBy("company_id").orderBy("month")


def transitions(states: DataFrame) -> DataFrame:
    """Onsets of a pattern of deficit states (true, false, null) from two months before; months without a robust state match nothing."""
    around = {k: F.lead("deficit", k).over(_by_company()) for k in range(-2, 3)}
    rows = states.select("company_id", "month", *(c.alias(f"s{k + 2}") for k, c in around.items()))
    found = []
    for name, pattern in PATTERNS.items():
        same = F.lit(True)
        for k, state in enumerate(pattern):
            same = same & F.coalesce(F.col(f"s{k}") == state, F.lit(False))
        found.append(F.when(same, F.struct(F.lit(name).alias("sign"), F.last_day(F.add_months("month", len(pattern) - 3)).alias("confirmed_at"))))
    return rows.select("company_id", F.col("month").alias("onset_month"), F.explode(F.array_compact(F.array(*found))).alias("e")).select("company_id", "onset_month", "e.*")


def alerts(episodes: DataFrame) -> DataFrame:
    """Two alerts per episode: the candidate when it is confirmed, the baseline at its first month."""
    sign = F.lit(None).cast("string")
    for direction, name in SIGNS.items():
        sign = F.when(F.col("direction") == direction, name).otherwise(sign)
    issued = F.array(F.struct(F.lit("baseline").alias("method"), F.col("watch_month").alias("origin_month")), F.struct(F.lit("candidate").alias("method"), F.col("confirmed_month").alias("origin_month")))
    return episodes.select("company_id", sign.alias("sign"), F.explode(issued).alias("a")).select("company_id", "sign", "a.*").where("origin_month IS NOT NULL")


def matched_alerts(issued: DataFrame, events: DataFrame, states: DataFrame) -> DataFrame:
    """Every alert with the event it leads by one or two months, each event once per method, in order of issue; else a false alarm, or censored where the following months are not observed.

    The order matters only inside one company, sign and method, which has at most one alert a month.
    """
    keyed = events.where(F.col("sign") != "recovered_dip").select(F.col("company_id").alias("_c"), F.col("sign").alias("_s"), "onset_month")
    lists = keyed.groupBy("_c", "_s").agg(F.sort_array(F.collect_list("onset_month")).alias("onsets"))
    asked = issued.join(lists, (F.col("company_id") == F.col("_c")) & (F.col("sign") == F.col("_s"))).select("company_id", "sign", "method", "origin_month", "onsets")

    def match(group: pd.DataFrame) -> pd.DataFrame:
        used, rows = set(), []
        for r in group.sort_values("origin_month").itertuples():
            for onset in r.onsets:
                lead = (onset.year - r.origin_month.year) * 12 + onset.month - r.origin_month.month
                if lead in LEADS and onset not in used:
                    used.add(onset)
                    rows.append((r.company_id, r.sign, r.method, r.origin_month, onset, lead))
                    break
        return pd.DataFrame(rows, columns=["company_id", "sign", "method", "origin_month", "event_month", "lead_months"])

    found = asked.groupBy("company_id", "sign", "method").applyInPandas(match, _MATCH)
    seen = states.select("company_id", "month", F.min(F.col("deficit").isNotNull()).over(_by_company().rowsBetween(-1, 3)).alias("whole"), F.count("*").over(_by_company().rowsBetween(-1, 3)).alias("n"))
    seen = seen.select(F.col("company_id").alias("_c"), F.col("month").alias("_m"), (F.col("whole") & (F.col("n") == 5)).alias("followed"))
    rows = issued.join(found, ["company_id", "sign", "method", "origin_month"], "left").join(seen, (F.col("company_id") == F.col("_c")) & (F.col("origin_month") == F.col("_m")), "left")
    status = F.when(F.col("event_month").isNotNull(), "matched").when(F.coalesce("followed", F.lit(False)), "false_alarm").otherwise("censored")
    return rows.select("company_id", "sign", "method", "origin_month", "event_month", "lead_months", status.alias("status"))


def alert_report(matched: DataFrame, events: DataFrame) -> DataFrame:
    """Per sign and method: alerts by outcome, share of false ones among those decided, recall of the events, median lead."""
    sums = matched.groupBy("sign", "method").agg(
        F.count("*").alias("n_alerts"), *(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("matched", "false_alarm", "censored")), F.median("lead_months").alias("median_lead"))
    total = events.where(F.col("sign") != "recovered_dip").groupBy("sign").agg(F.count("*").alias("n_events"))
    rows = sums.join(total, "sign", "left").withColumn("n_events", F.coalesce("n_events", F.lit(0)))
    decided = F.col("n_matched") + F.col("n_false_alarm")
    return rows.withColumns({"false_share": F.when(decided > 0, F.col("n_false_alarm") / decided), "recall": F.when(F.col("n_events") > 0, F.col("n_matched") / F.col("n_events"))})


def first_cases(events: DataFrame) -> DataFrame:
    """The first case of every pattern: by confirmation, then company, then onset."""
    order = F.struct("confirmed_at", "company_id", "onset_month")
    return events.groupBy("sign").agg(F.min(order).alias("c"), F.count("*").alias("n_cases")).select("sign", "n_cases", "c.confirmed_at", "c.company_id", "c.onset_month")
