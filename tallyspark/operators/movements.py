"""Signed movements, unions and opening/detail blocks.

A balance is the sum of one long fact ``(entity, doc, date, kind, amount)``
built as a UNION ALL of typed branches; each branch carries a rank column
so the output order is stable.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_branches(branches: Sequence[tuple[str, int, DataFrame]], kind_col: str = "movement_type",
                   rank_col: str = "branch_rank") -> DataFrame:
    """UNION ALL of typed branches by column name, with a branch rank."""
    out = None
    for kind, rank, df in branches:
        d = df.withColumn(kind_col, F.lit(kind)).withColumn(rank_col, F.lit(rank))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def opening_and_detail(opening: DataFrame, detail: DataFrame, block_col: str = "block") -> DataFrame:
    """Opening row(s) and detail rows as one result with a block number."""
    return (opening.withColumn(block_col, F.lit(1))
            .unionByName(detail.withColumn(block_col, F.lit(2)), allowMissingColumns=True))
