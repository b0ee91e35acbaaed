"""Aggregations.

All are single ``groupBy().agg()`` passes (partial aggregation on the map
side).  Several measures of one fact are conditional sums in the same pass
rather than one scan per measure (A2, A13, A15).
"""

from __future__ import annotations

import datetime as _dt
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.scalars import TOTAL


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def summarize(df: DataFrame, keys: Sequence[str], value: str, prefix: str = "") -> DataFrame:
    """A1: count, sum, avg (exact, 2 dp), min, max of one measure."""
    from tallyspark.functions.scalars import cents, div_round
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias(f"{prefix}cnt"),
        F.sum(value).cast(TOTAL).alias(f"{prefix}total"),
        div_round(F.sum(cents(value)), F.count(value) * 100, 2).alias(f"{prefix}avg"),
        F.min(value).alias(f"{prefix}min"),
        F.max(value).alias(f"{prefix}max"),
    )


def conditional_sums(conds: Mapping[str, Column], value, zero_default: bool = True) -> list[Column]:
    """A2: ``SUM(CASE WHEN cond THEN value ELSE 0 END)`` per output column."""
    v = _c(value)
    out = []
    for name, cond in conds.items():
        e = F.when(cond, v)
        if zero_default:
            e = e.otherwise(F.lit(0))
        out.append(F.sum(e).cast(TOTAL).alias(name))
    return out


def pivot_sum(df: DataFrame, keys: Sequence[str], category: str, value: str,
              categories: Sequence[str], names: Mapping[str, str] | None = None) -> DataFrame:
    """A2 (pivot form): fixed-column pivot, values listed so no extra job runs."""
    conds = {(names or {}).get(c, c): F.col(category) == F.lit(c) for c in categories}
    return df.groupBy(*keys).agg(*conditional_sums(conds, value))


def attribute_pivot(df: DataFrame, keys: Sequence[str], category: str, value: str,
                    categories: Sequence[str], names: Mapping[str, str] | None = None) -> DataFrame:
    """A3: key/value rows to columns with MAX(CASE ...).

    The category list is given, so Spark does not run a distinct job to
    discover it and the output schema is fixed.
    """
    aggs = [F.max(F.when(F.col(category) == F.lit(c), F.col(value))).alias((names or {}).get(c, c))
            for c in categories]
    return df.groupBy(*keys).agg(*aggs)


def having(df: DataFrame, cond: Column) -> DataFrame:
    """A4: filter on an aggregate (applied after ``agg``)."""
    return df.filter(cond)


def funnel(df: DataFrame, keys: Sequence[str], id_col: str, stages: Mapping[str, Column]) -> DataFrame:
    """A5: conditional COUNT(DISTINCT id) per stage."""
    return df.groupBy(*keys).agg(*[
        F.count_distinct(F.when(cond, F.col(id_col))).alias(name) for name, cond in stages.items()])


def ordered_list(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str],
                 sep: str = ", ", out: str = "value_list") -> DataFrame:
    """LISTAGG(value, sep) WITHIN GROUP (ORDER BY order).

    Two levels: partial strings are built per (key, first order column) in
    parallel, then the partial strings of a key are joined in order.  The
    final row holds the key's whole list -- that is the result -- but no
    task sorts the key's raw rows as one group.
    """
    lead, rest = order[0], list(order[1:])
    inner = F.struct(*[F.col(c) for c in rest], F.col(value).alias("__v"))
    part = df.groupBy(*keys, lead).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(inner)), lambda x: x["__v"]), sep).alias("__part"))
    outer = F.struct(F.col(lead), F.col("__part"))
    return part.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(outer)), lambda x: x["__part"]), sep).alias(out))




def list_pieces(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], size: int = 1000,
                sep: str = ", ", out: str = "value_list") -> DataFrame:
    """A6 for keys of any size: the ordered list in pieces of at most ``size``
    values, (keys, piece, first_position, values, out).

    Positions come from the two-level running count, and a piece is one group,
    so a hot key is as many groups as it has pieces; its pieces in order,
    joined by ``sep``, are the whole list.
    """
    from tallyspark.operators.windows import running_total

    placed = running_total(df, keys, order, F.lit(1), "__pos", chunk=order[0])
    placed = placed.withColumn("piece", F.floor((F.col("__pos") - 1) / size) + 1)
    values = F.transform(F.array_sort(F.collect_list(F.struct("__pos", F.col(value).alias("__v")))), lambda x: x["__v"])
    return placed.groupBy(*keys, "piece").agg(F.min("__pos").cast("bigint").alias("first_position"), F.count(F.lit(1)).alias("values"),
                                              F.array_join(values, sep).alias(out))


def debit_credit(sum_col) -> tuple[Column, Column]:
    """A10: split a signed total into debit (positive) and credit (negative)."""
    s = _c(sum_col)
    return (F.when(s > 0, s).otherwise(F.lit(0)), F.when(s < 0, -s).otherwise(F.lit(0)))




def as_of_sum(value, date_col, as_of: _dt.date) -> Column:
    """Sum only rows dated on or before the date."""
    return F.sum(F.when(_c(date_col) <= F.lit(as_of), _c(value)).otherwise(F.lit(0))).cast(TOTAL)


def to_date_sums(date_col, value, as_of: _dt.date, prefix: str = "") -> list[Column]:
    """Inception-, year- and period(month)-to-date sums in one pass."""
    d, v = _c(date_col), _c(value)
    ys = _dt.date(as_of.year, 1, 1)
    ps = _dt.date(as_of.year, as_of.month, 1)
    upto = d <= F.lit(as_of)
    return [
        F.sum(F.when(upto, v).otherwise(0)).cast(TOTAL).alias(f"{prefix}itd"),
        F.sum(F.when(upto & (d >= F.lit(ys)), v).otherwise(0)).cast(TOTAL).alias(f"{prefix}ytd"),
        F.sum(F.when(upto & (d >= F.lit(ps)), v).otherwise(0)).cast(TOTAL).alias(f"{prefix}ptd"),
    ]


def year_split(date_col, value, year: int, prefix: str = "") -> list[Column]:
    """Earlier years vs the given year."""
    y = F.year(_c(date_col))
    v = _c(value)
    return [F.sum(F.when(y < year, v).otherwise(0)).cast(TOTAL).alias(f"{prefix}prior_years"),
            F.sum(F.when(y == year, v).otherwise(0)).cast(TOTAL).alias(f"{prefix}current_year")]


def max_text_label(label: str) -> Column:
    """A16 (reference mode): MAX over text -- not the latest row's label."""
    return F.max(label)


def latest_label(label: str, date_col: str) -> Column:
    """A16 (correct mode): label of the latest row."""
    return F.max_by(label, date_col)
