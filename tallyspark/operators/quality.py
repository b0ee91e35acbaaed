"""Data-quality operators (Q1-Q6).  Each returns the offending rows (an
empty result means the check passed), so checks compose with the rest of a
plan and never pull data to the driver."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Q1: child rows whose parent key does not exist (NOT EXISTS)."""
    p = parent.select(F.col(parent_key).alias("__pk")).distinct()
    return child.join(p, child[child_key] == p["__pk"], "left_anti")


def outside_domain(df: DataFrame, col: str, allowed: Sequence) -> DataFrame:
    """Q2: distinct values not in the allowed list, with their row counts."""
    return (df.filter(~F.col(col).isin(list(allowed)) | F.col(col).isNull())
              .groupBy(col).agg(F.count(F.lit(1)).alias("row_count")))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Q3: keys that occur more than once at the declared grain."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count")).filter(F.col("row_count") > 1)


def identity_breaks(df: DataFrame, parts: Sequence[str], reported: str, tolerance: str = "0.01") -> DataFrame:
    """Q4: rows where the parts do not add up to the reported value."""
    total = None
    for p in parts:
        c = F.coalesce(F.col(p), F.lit(0))
        total = c if total is None else total + c
    return (df.withColumn("difference", F.col(reported) - total)
              .filter(F.abs(F.col("difference")) > F.lit(tolerance).cast("decimal(18,2)")))


def tie_out(left: DataFrame, right: DataFrame, keys: Sequence[str], left_val: str, right_val: str,
            tolerance: str = "0.01") -> DataFrame:
    """Q5/Q6: full outer compare of two totals per key; rows that differ."""
    j = left.join(right, list(keys), "full_outer")
    diff = F.coalesce(F.col(left_val), F.lit(0)) - F.coalesce(F.col(right_val), F.lit(0))
    return j.withColumn("difference", diff).filter(
        F.abs(F.col("difference")) > F.lit(tolerance).cast("decimal(18,2)"))
