"""Sinks: Parquet/CSV writers and the burst sink.

Delivery (mail, pdf/xlsx rendering) is the BI tool's matter and is not
built; the burst ends at one output folder per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_report(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write a report as Parquet or CSV (with header)."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", "true").csv(path)
    else:
        w.parquet(path)


def burst(df: DataFrame, path: str, key: str = "burst_key", fmt: str = "csv") -> None:
    """Split one report into one folder per key value.

    The rebalance hint clusters rows by the key for few files per key; AQE
    splits a key that is larger than a partition should be over several tasks.
    """
    w = df.hint("rebalance", key).write.mode("overwrite").partitionBy(key)
    if fmt == "csv":
        w.option("header", "true").csv(path)
    else:
        w.parquet(path)
