"""Window operators (W1-W11), written so that no entity key ends up whole
in one task.

* Running totals (W1/W2) are computed in two levels: the running sum inside
  a chunk ``(key, chunk)`` -- ``chunk`` being the leading, coarse order
  column such as the date -- plus the total of all earlier chunks of the key,
  which comes from a small aggregated table (one row per key and chunk).  A
  customer with a third of all rows is spread over as many tasks as it has
  dates.
* Partition totals (W3/W11) are a grouped aggregate joined back: the
  aggregate is partial on the map side, and the join back is split by AQE's
  skew-join handling when one key is hot.  Grand totals (W4) are a scalar
  subquery, never a window over one partition.
* Serial numbers (W10) are a two-level running count as well (per leading
  order value, then offsets from one row per value).
* Top-1 per key (W6/W7) is a ranking window filtered to rank 1; Catalyst's
  ``InferWindowGroupLimit`` inserts a partial group limit before the shuffle,
  so each map task sends at most the top rows per key.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cols(cols) -> list:
    if cols is None:
        return []
    if isinstance(cols, (str, Column)):
        return [cols]
    return list(cols)


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence, value,
                  out: str, chunk: str | None = None) -> DataFrame:
    """``SUM(value) OVER (PARTITION BY keys ORDER BY order ROWS UNBOUNDED
    PRECEDING)``.

    ``order`` must be a total order within ``keys`` (add a unique tie-break).
    With ``chunk`` (the first element of ``order``, e.g. the date) the sum is
    computed in two levels so that the window groups are (key, chunk) and
    never a whole key.
    """
    return running_totals(df, keys, order, {out: value}, chunk=chunk)


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence, values: dict,
                   chunk: str | None = None, totals: dict | None = None) -> DataFrame:
    """Several running sums (``values``: output -> column) in one pass, and
    optionally group totals (``totals``: output -> column) beside each row.

    Two-level form (``chunk`` given): one window over (keys, chunk) gives the
    running sums inside each chunk; a small table of chunk totals (one row
    per key and chunk) gives, by a window over its rows, each chunk's offset
    and the key's grand totals; one join brings both back.  The input is
    read twice (the chunk totals read only keys, chunk and the values) and
    no task ever holds a whole key.
    """
    keys, order = _cols(keys), _cols(order)
    totals = totals or {}
    vals = {o: (F.col(v) if isinstance(v, str) else v) for o, v in values.items()}
    tots = {o: (F.col(v) if isinstance(v, str) else v) for o, v in totals.items()}
    if chunk is None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        out = df
        for o, v in vals.items():
            out = out.withColumn(o, F.sum(v).over(w))
        if tots:
            wk = Window.partitionBy(*keys)
            for o, v in tots.items():
                out = out.withColumn(o, F.sum(v).over(wk))
        return out
    tmp = {o: f"__{o}_v" for o in [*vals, *tots]}
    base = df
    for o, v in {**vals, **tots}.items():
        base = base.withColumn(tmp[o], v)
    within = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    for o in vals:
        base = base.withColumn(f"__{o}_in", F.sum(tmp[o]).over(within))
    chunk_tot = base.groupBy(*keys, chunk).agg(*[F.sum(tmp[o]).alias(f"__{o}_ct") for o in tmp])
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offs = chunk_tot
    for o in vals:
        offs = offs.withColumn(f"__{o}_off", F.coalesce(F.sum(f"__{o}_ct").over(before), F.lit(0)))
    for o in tots:
        offs = offs.withColumn(o, F.sum(f"__{o}_ct").over(whole))
    offs = offs.drop(*[f"__{o}_ct" for o in tmp])
    joined = base.join(offs, [*keys, chunk], "inner")
    for o in vals:
        joined = joined.withColumn(o, F.col(f"__{o}_off") + F.col(f"__{o}_in"))
    drop = [*tmp.values(), *[f"__{o}_in" for o in vals], *[f"__{o}_off" for o in vals]]
    return joined.drop(*drop)


def running_total_range(df: DataFrame, keys: Sequence[str], order: str, value, out: str) -> DataFrame:
    """W2 compatibility mode: default RANGE frame, tied rows share the total.

    Computed as per-(key, order value) sums, a running sum over those (one
    row per key and order value), joined back -- no window over raw rows.
    """
    keys = _cols(keys)
    v = F.col(value) if isinstance(value, str) else value
    per = df.groupBy(*keys, order).agg(F.sum(v).alias(f"__{out}_s"))
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    per = per.withColumn(out, F.sum(f"__{out}_s").over(w)).drop(f"__{out}_s")
    return df.join(per, [*keys, order], "inner")


SALTS = 8


def join_back(df: DataFrame, per_key: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join of detail rows with one row per key, salted; ``how="left"`` keeps
    details without a match.

    An aggregate is no bare shuffle, so AQE would not split a hot key here.
    Each detail row takes a salt from a hash of its own columns (the same
    after a retry), each per-key row appears once per salt, and the join
    hashes on key and salt: a hot key lands in up to ``SALTS`` tasks.
    """
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(SALTS)).cast("int")
    copies = per_key.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return df.withColumn("__salt", salt).join(copies, [*keys, "__salt"], how).drop("__salt")


def partition_total(df: DataFrame, keys: Sequence[str], value, out: str, bounded: bool = False) -> DataFrame:
    """Group total beside each detail row.

    For a fact (``bounded=False``) the total is a partial aggregate joined
    back with salt (:func:`join_back`), so a hot key is never whole in one
    task.  For an input whose size does not grow with the
    data -- an aggregate per account, region or month (``bounded=True``) --
    a window is used instead, so the input is computed once, not twice.
    """
    keys = _cols(keys)
    v = F.col(value) if isinstance(value, str) else value
    if bounded:
        return df.withColumn(out, F.sum(v).over(Window.partitionBy(*keys)))
    return join_back(df, df.groupBy(*keys).agg(F.sum(v).alias(out)), keys)




def grand_total(df: DataFrame, value, out: str, bounded: bool = False) -> DataFrame:
    """``SUM(x) OVER ()``.

    For a fact, the global aggregate (partial sums per task, one final row)
    runs as a scalar subquery whose single value is attached to every row
    -- no single-partition window over the data.  For a bounded input (an
    aggregate per account or region) the plain ``OVER ()`` window is used
    so the input is not computed twice.
    """
    v = F.col(value) if isinstance(value, str) else value
    if bounded:
        return df.withColumn(out, F.sum(v).over(Window.partitionBy()))
    return df.withColumn(out, df.agg(F.sum(v)).scalar())


def line_number(df: DataFrame, keys: Sequence[str], order: Sequence, out: str = "line_num",
                chunk: str | None = None, count_out: str | None = None) -> DataFrame:
    """Row number within a group (and, with ``count_out``, the group's
    row count beside it).

    With ``chunk`` (the leading order column) the ordinal is a running count
    computed in two levels like :func:`running_totals`, so a hot group is
    numbered by many tasks, and the count comes from the same pass.
    """
    if chunk is None:
        w = Window.partitionBy(*_cols(keys)).orderBy(*_cols(order))
        out_df = df.withColumn(out, F.row_number().over(w))
        if count_out:
            out_df = out_df.withColumn(count_out, F.count(F.lit(1)).over(Window.partitionBy(*_cols(keys))))
        return out_df
    out_df = running_totals(df, keys, order, {out: F.lit(1)}, chunk=chunk,
                            totals={count_out: F.lit(1)} if count_out else None)
    out_df = out_df.withColumn(out, F.col(out).cast("int"))
    if count_out:
        out_df = out_df.withColumn(count_out, F.col(count_out).cast("bigint"))
    return out_df


def line_number_of(df: DataFrame, widen, keys: Sequence[str], order: Sequence, picked: str, chunk: str,
                   out: str = "line_num", count_out: str | None = None) -> DataFrame:
    """W5 for the rows of ``widen(df)`` whose ``picked`` (a column of ``df``,
    never null) is true: the numbers that :func:`line_number` gives them among
    all rows of ``widen(df)``; only they are returned.

    ``widen`` joins dimensions, which may drop or repeat a row.  All rows pass
    it with keys and ``chunk`` only, to count each chunk's rows; whole rows are
    shuffled once, by (keys, chunk), and those of chunks with a picked row are
    widened and ranked.  A chunk with a picked row is whole in that rank.
    """
    keys = _cols(keys)
    per = widen(df).groupBy(*keys, chunk).agg(F.count(F.lit(1)).alias("__n"), F.max(picked).alias("__any"))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    if count_out:
        per = per.withColumn(count_out, F.sum("__n").over(whole).cast("bigint"))
    rows = widen(df.join(per.filter("__any").drop("__n", "__any"), [*keys, chunk]))
    own = F.row_number().over(Window.partitionBy(*keys, chunk).orderBy(*_cols(order)))
    return rows.withColumn(out, (F.col("__before") + own).cast("int")).filter(picked).drop("__before", picked)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """One row per key in preference order (``row_number() = 1``)."""
    w = Window.partitionBy(*_cols(keys)).orderBy(*_cols(order))
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") == 1).drop("__rn")


def keep_ties(df: DataFrame, keys: Sequence[str], order_col: str, descending: bool = True) -> DataFrame:
    """Rows with the top value per key, ties kept (``rank() = 1``).

    Written as max per key joined back on (key, value): the join hashes on
    both columns, so a hot key's rows spread over many tasks.
    """
    keys = _cols(keys)
    agg = F.max(order_col) if descending else F.min(order_col)
    top = df.groupBy(*keys).agg(agg.alias(order_col))
    return df.join(top, [*keys, order_col], "left_semi")


def lag_change(df: DataFrame, keys: Sequence[str], order: Sequence, value: str,
               prev: str = "previous_value", change: str = "change_amount") -> DataFrame:
    """Previous value and change (LAG) along one entity's history."""
    w = Window.partitionBy(*_cols(keys)).orderBy(*_cols(order))
    return (df.withColumn(prev, F.lag(value).over(w))
              .withColumn(change, F.col(value) - F.col(prev)))


def rows_at_max(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows equal to the group maximum (``MAX() OVER`` + filter)."""
    return keep_ties(df, keys, value, descending=True)


def magnitude_bucket(c) -> Column:
    """A bucket that rises with a number: its sign and sixteen steps to each
    power of two, so at most some two thousand whatever the data."""
    c = F.col(c) if isinstance(c, str) else c
    return (F.signum(c) * F.when(c > 0, F.floor(F.log2(F.abs(c) + 1) * 16)).otherwise(F.ceil(F.log2(F.abs(c) + 1) * 16))).cast("int")


def serial_number(df: DataFrame, order: Sequence, out: str = "serial_no", bucket: Column | None = None) -> DataFrame:
    """1..n over the whole result in ``order`` (a total order) without
    a single-task window over the rows.

    A two-level running count: the ordinal inside each value of the leading
    order column (e.g. the date) plus the count of all earlier values, taken
    from a table with one row per leading value -- bounded by the number of
    distinct values (the calendar), not by the data.  Deterministic: no
    sampled range boundaries are involved, so a re-executed stage yields
    the same numbers.

    Where the leading column has about a value a row, give ``bucket``: a
    column that never falls as the leading one rises, of few values (see
    :func:`magnitude_bucket`).  Values are then counted within their bucket
    and only the buckets' totals go through one window.
    """
    order = _cols(order)
    lead = order[0] if isinstance(order[0], str) else None
    if lead is None:
        raise ValueError("serial_number needs the leading order column by name")
    if bucket is not None:
        return _serial_by_bucket(df, lead, order, out, bucket)
    out_df = running_totals(df, [], order, {out: F.lit(1)}, chunk=lead)
    return out_df.withColumn(out, F.col(out).cast("bigint"))


def _serial_by_bucket(df: DataFrame, lead: str, order: Sequence, out: str, bucket: Column) -> DataFrame:
    rows = df.withColumn("__b", bucket)
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    values = rows.groupBy("__b", lead).agg(F.count(F.lit(1)).alias("__n"))
    totals = values.groupBy("__b").agg(F.sum("__n").alias("__n"))
    totals = totals.select("__b", F.coalesce(F.sum("__n").over(earlier(Window.orderBy("__b"))), F.lit(0)).alias("__before"))
    inside = F.coalesce(F.sum("__n").over(earlier(Window.partitionBy("__b").orderBy(lead))), F.lit(0))
    values = values.select("__b", lead, inside.alias("__inside")).join(totals, "__b")
    own = F.row_number().over(Window.partitionBy("__b", lead).orderBy(*order[1:]))
    rows = rows.withColumn("__own", own).join(values, ["__b", lead])
    number = (F.col("__own") + F.col("__inside") + F.col("__before")).cast("bigint")
    return rows.select(*df.columns, number.alias(out))
