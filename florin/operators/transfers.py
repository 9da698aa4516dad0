"""Transfers between a company's own accounts: cash withdrawals, pairs of equal and opposite amounts, then the bank's words."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Categories of cash withdrawals, the two passes of the pairing, and the description patterns in order.
CASH_CATEGORIES = ("cash_withdrawal", "pos_withdrawal")
TOLERANCE = 0.01
#: (rule, confidence, most days apart, whether the accounts must differ)
PASSES = (("par_interno_estricto", "alta", 3, True), ("par_interno_laxo", "baja", 7, False))
#: (pattern at the start, class, confidence); ``por_signo`` follows the sign of the amount.
DESCRIPTIONS = (
    (r"^TRANSF INTERNA", "internal_transfer", "media"),
    (r"^TRASPASO", "internal_transfer", "media"),
    (r"^TRASP\. ", "internal_transfer", "media"),
    (r"^SCF-TRASPASO", "internal_transfer", "media"),
    (r"^RETORNO TRASPASO", "internal_transfer", "media"),
    (r"^PAGO TRASPASO", "internal_transfer", "media"),
    (r"^\[NUM\] RETORNO TRASPASO", "internal_transfer", "media"),
    (r"^\[NUM\] TRASPASO", "internal_transfer", "media"),
    (r"^\[NUM\] [0-9]+ 04 TRASP\. CT", "internal_transfer", "media"),
    (r"^DISP\.ENTREG\.EFECT", "operating_out", "media"),
    (r"^RETIRADA", "operating_out", "media"),
    (r"^STRIPE PAYOUT", "operating_in", "media"),
    (r"^VIR SEPA RECU /FRM STRIPE", "operating_in", "media"),
    (r"^TRANSFERENCIA", "por_signo", "baja"),
    (r"^TRANSFER", "por_signo", "baja"),
    (r"^TRANSF", "por_signo", "baja"),
)
DESCRIPTION_RULES = {"internal_transfer": "desc:traspaso", "operating_out": "desc:efectivo_fuera_de_perimetro", "operating_in": "desc:pasarela_cobro", "por_signo": "desc:transferencia_tercero"}
_PAIRS = "transaction_id string, matched_with string, rule string, confidence string"


def normal_description(text: Column) -> Column:
    """Upper case, without accents, white space collapsed."""
    plain = F.translate(F.upper(F.coalesce(text, F.lit(""))), "ÁÀÂÄÃÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇ", "AAAAAEEEEIIIIOOOOOUUUUNC")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


class _Free:
    """Movements of one sign, amount, account and counterparty in order of day and identity; those that are paired are passed over once."""

    def __init__(self) -> None:
        self.rows: list[tuple[int, str]] = []
        self.next: list[int] = []

    def first(self, begin: int, end: int, paired: set[str]) -> tuple[int, str] | None:
        """The first free movement from day ``begin`` to ``end``."""
        if not self.next:
            self.rows.sort()
            self.next = list(range(len(self.rows) + 1))
        start = at = bisect_left(self.rows, (begin, ""))
        while at < len(self.rows) and (self.next[at] > at or self.rows[at][1] in paired):
            at = max(self.next[at], at + 1)
        while start < at:
            start, self.next[start] = max(self.next[start], start + 1), at
        return self.rows[at] if at < len(self.rows) and self.rows[at][0] <= end else None


def _greedy(rows: pd.DataFrame) -> Iterator[tuple[str, str, str, str]]:
    """Pairs of one group in order: the largest amount first, each with the earliest candidate that fits.

    Candidates wait by sign, amount, account and counterparty, so an anchor looks at one place in each list that it may take from.
    """
    records = list(zip(rows.transaction_id, rows.product_id.fillna(""), rows.day, rows.eur, rows.counterparty_id.fillna("")))
    paired: set[str] = set()
    for rule, confidence, most_days, other_account in PASSES:
        free = [r for r in records if r[0] not in paired]
        waiting: dict[tuple, dict[tuple, _Free]] = {}
        for name, account, day, eur, partner in free:
            lists = waiting.setdefault((eur > 0, account), {})
            for key in {(abs(eur), partner), (abs(eur), None)}:
                lists.setdefault(key, _Free()).rows.append((day, name))
        sizes = sorted({abs(r[3]) for r in free})
        for name, account, day, eur, partner in sorted(free, key=lambda r: (-abs(r[3]), r[2], r[0])):
            if name in paired:
                continue
            near = sizes[bisect_left(sizes, abs(eur) - TOLERANCE - 1e-9) : bisect_right(sizes, abs(eur) + TOLERANCE + 1e-9)]
            found = []
            for (positive, place), lists in waiting.items():
                if positive == (eur > 0) or (other_account and place == account):
                    continue
                for key in ((size, who) for size in near for who in ((partner, "") if partner else (None,))):
                    if key in lists and (one := lists[key].first(day - most_days, day + most_days, paired)):
                        found.append(one)
            if found:
                other = min(found)[1]
                paired |= {name, other}
                yield name, other, rule, confidence
                yield other, name, rule, confidence


def transfer_pairs(transfers: DataFrame) -> DataFrame:
    """``(transaction_id, matched_with, rule, confidence)`` for both sides of every pair.

    Only amounts within a cent of each other can pair and only days within a week, so a company's movements are first dealt to
    chains of neighbouring amounts and, inside these, of neighbouring days, by two windows; the greedy order runs inside
    such a chain and gives what it would give over the whole company.
    """
    usable = transfers.where(~F.col("category_norm").isin(*CASH_CATEGORIES) | F.col("category_norm").isNull()).where(F.col("amount_eur").isNotNull() & (F.col("amount_eur") != 0) & F.col("date_ok").isNotNull() & ~F.coalesce("fx_ambiguous", F.lit(False)))
    rows = usable.select("company_id", "transaction_id", "product_id", F.datediff("date_ok", F.lit("1970-01-01").cast("date")).alias("day"), F.col("amount_eur").alias("eur"), F.trim("counterparty_id").alias("counterparty_id"))
    by_size = Window.partitionBy("company_id").orderBy("size")
    gap = lambda c, w, most: (F.col(c) - F.lag(c).over(w) > most).cast("int")
    rows = rows.withColumn("size", F.abs("eur")).withColumn("new", F.coalesce(gap("size", by_size, TOLERANCE + 1e-9), F.lit(1))).withColumn("chain", F.sum("new").over(by_size))
    by_day = Window.partitionBy("company_id", "chain").orderBy("day")
    rows = rows.withColumn("new", F.coalesce(gap("day", by_day, PASSES[-1][2]), F.lit(1))).withColumn("run", F.sum("new").over(by_day))

    def pair(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(list(_greedy(group)), columns=["transaction_id", "matched_with", "rule", "confidence"])

    return rows.groupBy("company_id", "chain", "run").applyInPandas(pair, _PAIRS)


def described_transfers(rows: DataFrame) -> DataFrame:
    """``rows`` with described_class, described_rule and described_confidence by the first pattern that matches; null where none does or the sign is unknown."""
    text = normal_description(F.col("description"))
    hit = F.lit(None).cast("struct<kind:string,confidence:string>")
    for pattern, kind, confidence in reversed(DESCRIPTIONS):
        hit = F.when(text.rlike(pattern), F.struct(F.lit(kind).alias("kind"), F.lit(confidence).alias("confidence"))).otherwise(hit)
    rows = rows.withColumn("_hit", hit)
    kind = F.col("_hit.kind")
    by_sign = F.when(F.col("amount_eur") > 0, "operating_in").when(F.col("amount_eur") < 0, "operating_out")
    found = F.when(kind == "por_signo", by_sign).otherwise(kind)
    rule = F.lit(None).cast("string")
    for name, named in DESCRIPTION_RULES.items():
        rule = F.when(kind == name, named).otherwise(rule)
    return rows.withColumns({"described_class": found, "described_rule": F.when(found.isNotNull(), rule), "described_confidence": F.when(found.isNotNull(), F.col("_hit.confidence"))}).drop("_hit")


def resolved_transfers(transfers: DataFrame) -> DataFrame:
    """Every transfer with its resolved class: withdrawal, pair, description, else ``ambiguo``; evidence of a pair goes before words."""
    pairs = transfer_pairs(transfers).select(F.col("transaction_id").alias("_id"), "matched_with", F.col("rule").alias("_rule"), F.col("confidence").alias("_confidence"))
    rows = described_transfers(transfers).join(pairs, F.col("transaction_id") == F.col("_id"), "left")
    cash, paired = F.col("category_norm").isin(*CASH_CATEGORIES), F.col("_rule").isNotNull()
    pick = lambda withdrawal, pair, words, none: F.when(cash, withdrawal).when(paired, pair).otherwise(F.coalesce(words, F.lit(none)))
    return rows.select(
        "transaction_id", "company_id", "month", "amount_eur",
        pick(F.lit("operating_out"), F.lit("internal_transfer"), F.col("described_class"), "ambiguo").alias("resolved_class"),
        F.when(cash, "cash_withdrawal_sale_de_perimetro").when(paired, F.col("_rule")).otherwise(F.col("described_rule")).alias("rule"),
        pick(F.lit("media"), F.col("_confidence"), F.col("described_confidence"), "ninguna").alias("confidence"), F.when(~F.coalesce(cash, F.lit(False)), F.col("matched_with")).alias("matched_with"),
    )


def rule_sensitivity(resolved: DataFrame) -> DataFrame:
    """Receipts and payments that every rule adds, by company."""
    amount = F.abs("amount_eur")
    return resolved.where("rule IS NOT NULL").groupBy("company_id", "rule").agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("resolved_class") == "operating_in", amount)), F.lit(0.0)).alias("added_receipts"), F.coalesce(F.sum(F.when(F.col("resolved_class") == "operating_out", amount)), F.lit(0.0)).alias("added_payments"))
