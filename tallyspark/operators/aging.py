"""Aging buckets as data (§8 #4: edges differ between reports).

A ``BucketSet`` is an ordered list of (label, output column, low, high)
with inclusive bounds in days past due; the first match wins.  The oracle
SQL of the reports spells its edges out by hand (``sql_buckets``) and shares
nothing with the definition here.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.scalars import TOTAL


@dataclass(frozen=True)
class BucketSet:
    name: str
    buckets: tuple[tuple[str, str, int | None, int | None], ...]

    def label(self, days) -> Column:
        d = F.col(days) if isinstance(days, str) else days
        expr = None
        for label, _, lo, hi in self.buckets:
            cond = F.lit(True)
            if lo is not None:
                cond = cond & (d >= lo)
            if hi is not None:
                cond = cond & (d <= hi)
            expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
        return expr

    def sums(self, days, amount) -> list[Column]:
        d = F.col(days) if isinstance(days, str) else days
        a = F.col(amount) if isinstance(amount, str) else amount
        lab = self.label(d)
        return [F.sum(F.when(lab == F.lit(label), a).otherwise(F.lit(0))).cast(TOTAL).alias(col)
                for label, col, _, _ in self.buckets]

    @property
    def columns(self) -> list[str]:
        return [c for _, c, _, _ in self.buckets]


# The bucket sets of the aging reports.
AR_FIVE = BucketSet("ar_five", (
    ("Current", "current_amt", None, 0),
    ("1-30", "b1_30", 1, 30),
    ("31-60", "b31_60", 31, 60),
    ("61-90", "b61_90", 61, 90),
    (">90", "b90_plus", 91, None),
))

AR_SEVEN = BucketSet("ar_seven", (
    ("Current", "current_amt", None, 0),
    ("1-30", "b1_30", 1, 30),
    ("31-60", "b31_60", 31, 60),
    ("61-90", "b61_90", 61, 90),
    ("91-180", "b91_180", 91, 180),
    ("181-360", "b181_360", 181, 360),
    ("360+", "b360_plus", 361, None),
))

AR_EIGHT = BucketSet("ar_eight", (
    ("Not Yet Due", "not_yet_due", None, -1),
    ("Bucket 0-30", "b0_30", 0, 30),
    ("Bucket 31-60", "b31_60", 31, 60),
    ("Bucket 61-90", "b61_90", 61, 90),
    ("Bucket 91-120", "b91_120", 91, 120),
    ("Bucket 121-180", "b121_180", 121, 180),
    ("Bucket 181-360", "b181_360", 181, 360),
    ("Above 360", "above_360", 361, None),
))

AR_SIX_NOT_DUE = BucketSet("ar_six", (
    ("Not Due", "not_due", None, -1),
    ("0-30", "b0_30", 0, 30),
    ("31-60", "b31_60", 31, 60),
    ("61-90", "b61_90", 61, 90),
    ("91-120", "b91_120", 91, 120),
    (">120", "b120_plus", 121, None),
))

UNAPPLIED_EIGHT = BucketSet("unapplied_eight", (
    ("Current", "current_amt", None, 0),
    ("1-30", "b1_30", 1, 30),
    ("31-60", "b31_60", 31, 60),
    ("61-90", "b61_90", 61, 90),
    ("91-120", "b91_120", 91, 120),
    ("121-180", "b121_180", 121, 180),
    ("181-365", "b181_365", 181, 365),
    (">365", "b365_plus", 366, None),
))

AP_FOURTEEN = BucketSet("ap_fourteen", (
    ("Not Yet Due", "not_due", None, -1),
    ("0-7", "b0_7", 0, 7),
    ("8-15", "b8_15", 8, 15),
    ("16-30", "b16_30", 16, 30),
    ("31-45", "b31_45", 31, 45),
    ("46-60", "b46_60", 46, 60),
    ("61-75", "b61_75", 61, 75),
    ("76-90", "b76_90", 76, 90),
    ("91-120", "b91_120", 91, 120),
    ("121-150", "b121_150", 121, 150),
    ("151-180", "b151_180", 151, 180),
    ("181-360", "b181_360", 181, 360),
    ("361-720", "b361_720", 361, 720),
    ("Above 720", "above_720", 721, None),
))


def ar_widened(widen: int) -> BucketSet:
    """Five buckets whose first one begins ``widen`` days before the date;
    earlier documents fall in no bucket."""
    return BucketSet("ar_widened", (
        ("0-30", "b0_30", -widen, 30),
        ("31-60", "b31_60", 31, 60),
        ("61-90", "b61_90", 61, 90),
        ("91-120", "b91_120", 91, 120),
        (">120", "b120_plus", 121, None),
    ))


def bucket_totals(df: DataFrame, keys: Sequence[str], days, amount, bset: BucketSet,
                  total_name: str = "total_due") -> DataFrame:
    """Sum of the amount and the per-bucket sums per group (A2 pivot)."""
    a = F.col(amount) if isinstance(amount, str) else amount
    return df.groupBy(*keys).agg(F.sum(a).cast(TOTAL).alias(total_name), *bset.sums(days, a))


def sql_buckets(days: str, amount: str, conditions: dict[str, str], total: bool = True) -> str:
    """Oracle columns from hand-written conditions on the days, e.g.
    ``{"b0_7": "BETWEEN 0 AND 7"}``; without ``total`` they are row amounts."""
    open_, close = ("SUM(", ")") if total else ("", "")
    return ", ".join(f"CAST({open_}CASE WHEN {days} {cond} THEN {amount} ELSE 0 END{close} AS DECIMAL(38,2)) AS {col}"
                     for col, cond in conditions.items())
