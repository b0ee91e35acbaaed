"""Effective dating and latest-version selection.

Date-effective rows carry ``eff_start``/``eff_end`` (both inclusive, open end
4712-12-31).  Latest-version selection never uses a correlated MAX: it is a
grouped ``max_by`` over a struct (a partial aggregate, so a hot key costs
one row per map task), or a max per key joined back on (key, value) when
ties must be kept.
"""

from __future__ import annotations

import datetime as _dt
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.params import END_OF_TIME


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_of(dim: DataFrame, date, start: str = "eff_start", end: str = "eff_end") -> DataFrame:
    """J7 (first half): the dimension rows valid at one report date.

    Filtering the dimension before the join is the cheapest form: the range
    predicate is pushed toward the scan and the join becomes an equi-join.
    """
    d = F.lit(date) if isinstance(date, _dt.date) else _c(date)
    return dim.filter((_c(start) <= d) & (F.coalesce(_c(end), F.lit(END_OF_TIME)) >= d))


def join_as_of(fact: DataFrame, dim: DataFrame, keys: Sequence[str], date,
               how: str = "left", start: str = "eff_start", end: str = "eff_end") -> DataFrame:
    """Join a fact to the dimension version valid at one report date."""
    return fact.join(as_of(dim, date, start, end).drop(start, end), list(keys), how)


def join_effective(fact: DataFrame, dim: DataFrame, keys: Sequence[str], fact_date: str,
                   how: str = "left", start: str = "eff_start", end: str = "eff_end",
                   month_buckets: bool = True, within: tuple | None = None) -> DataFrame:
    """Join each fact row to the version valid at the fact's own date.

    Versions do not overlap, so at most one matches.  With
    ``month_buckets`` (default) each version is expanded to the calendar
    months it covers -- open ends capped at the latest fact date, starts at
    the earliest -- and the join is an equi-join on (keys, month) with the
    range test only confirming the match.  A fact row then meets the few
    versions of its own month instead of the key's whole history, and a hot
    key's facts spread over as many join partitions as it has months.
    ``within`` gives bounds of the fact dates (dates or scalar columns, wider
    ones do no harm); without it the fact is run once more to find them.
    """
    d = dim.withColumnRenamed(start, "__es").withColumnRenamed(end, "__ee")
    es, ee = F.col("__es"), F.coalesce(F.col("__ee"), F.lit(END_OF_TIME))
    if month_buckets:
        lo_fact, hi_fact = within or (fact.agg(F.min(fact_date)).scalar(), fact.agg(F.max(fact_date)).scalar())
        lo = F.trunc(F.greatest(es, lo_fact), "month")
        hi = F.trunc(F.least(ee, hi_fact), "month")
        d = (d.filter(lo <= hi)
              .withColumn("__m", F.explode(F.sequence(lo, hi, F.expr("interval 1 month")))))
    cond = [fact[k] == d[k] for k in keys]
    if month_buckets:
        cond.append(F.trunc(fact[fact_date], "month") == d["__m"])
    cond.append(fact[fact_date] >= d["__es"])
    cond.append(fact[fact_date] <= F.coalesce(d["__ee"], F.lit(END_OF_TIME)))
    out = fact.join(d, cond, how)
    for k in keys:
        out = out.drop(d[k])
    return out.drop("__es", "__ee", "__m")


def capped_as_of(term, date) -> Column:
    """``LEAST(NVL(term, d), d)`` -- as-of date capped by termination."""
    d = F.lit(date) if isinstance(date, _dt.date) else _c(date)
    return F.least(F.coalesce(_c(term), d), d)


def join_period(fact: DataFrame, periods: DataFrame, keys: Sequence[str], fact_date: str,
                start: str, end: str, exclude_end: bool = True, how: str = "inner",
                calendar_month: bool = False) -> DataFrame:
    """Range join of a fact date into a period, equi keys first.

    ``exclude_end`` keeps the reference's rule that a date equal to the
    period end does not belong to the period.  With ``calendar_month``
    (periods are calendar months) the period start is computed from the
    fact date and joined by equality too -- the range test then only
    confirms the match, instead of comparing each fact row with every
    period of its key.
    """
    cond = [fact[k] == periods[k] for k in keys]
    if calendar_month:
        cond.append(F.trunc(fact[fact_date], "month") == periods[start])
    cond.append(fact[fact_date] >= periods[start])
    cond.append(fact[fact_date] <= periods[end])
    if exclude_end:
        cond.append(fact[fact_date] != periods[end])
    out = fact.join(periods, cond, how)
    for k in keys:
        out = out.drop(periods[k])
    return out


def explode_interval(df: DataFrame, start: str, end: str, out: str = "day") -> DataFrame:
    """One row per day of each [start, end] interval (bounded by its length)."""
    return df.withColumn(out, F.explode(F.sequence(_c(start), _c(end))))


def anti_interval(days: DataFrame, intervals: DataFrame, key: str, day: str,
                  start: str, end: str) -> DataFrame:
    """Days not inside any interval of the same key.

    Intervals are expanded to days and removed by an equi anti-join on
    (key, day) -- linear in the data, where a range anti-join compares every
    day with every interval of the key.
    """
    covered = explode_interval(intervals.select(key, start, end), start, end, "__day")
    covered = covered.select(F.col(key), F.col("__day").alias(day)).distinct()
    return days.join(covered, [key, day], "left_anti")


def overlaps(start, end, window_from, window_to) -> Column:
    """interval [start, end] overlaps the window [from, to]."""
    wf = F.lit(window_from) if isinstance(window_from, _dt.date) else _c(window_from)
    wt = F.lit(window_to) if isinstance(window_to, _dt.date) else _c(window_to)
    return (_c(start) <= wt) & (F.coalesce(_c(end), F.lit(END_OF_TIME)) >= wf)


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """V1/V3/V8: the row with the greatest ``order`` tuple per key.

    ``max_by(struct(all columns), struct(order))`` is a partial aggregate:
    each map task keeps one candidate per key.  ``order`` should end in a
    unique column so that the choice is deterministic.
    """
    keys = list(keys)
    payload = [c for c in df.columns if c not in keys]
    agg = F.max_by(F.struct(*payload), F.struct(*[F.col(c) for c in order])).alias("__latest")
    return df.groupBy(*keys).agg(agg).select(*keys, "__latest.*")


def earliest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    keys = list(keys)
    payload = [c for c in df.columns if c not in keys]
    agg = F.min_by(F.struct(*payload), F.struct(*[F.col(c) for c in order])).alias("__first")
    return df.groupBy(*keys).agg(agg).select(*keys, "__first.*")


def latest_at_or_before(df: DataFrame, keys: Sequence[str], date_col: str, date,
                        order: Sequence[str] | None = None) -> DataFrame:
    """V1/V2: latest row dated on or before ``date`` (no future rows)."""
    d = F.lit(date) if isinstance(date, _dt.date) else _c(date)
    return latest(df.filter(_c(date_col) <= d), keys, order or [date_col])


def latest_pair(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """V4: rows matching both independent maxima (max a, max b) of the key.

    May return nothing for a key when no row holds both maxima -- that is
    the reference's rule, kept on purpose.
    """
    keys = list(keys)
    m = df.groupBy(*keys).agg(F.max(a).alias(a), F.max(b).alias(b))
    return df.join(m, [*keys, a, b], "left_semi")


def latest_day_whole(df: DataFrame, keys: Sequence[str], ts_col: str) -> DataFrame:
    """V7: all rows of the latest update day per key (ties kept)."""
    keys = list(keys)
    d = df.withColumn("__day", F.to_date(ts_col))
    m = d.groupBy(*keys).agg(F.max("__day").alias("__day"))
    return d.join(m, [*keys, "__day"], "left_semi").drop("__day")


def current_rows(df: DataFrame, null_cols: Sequence[str] = (), flag_col: str | None = None) -> DataFrame:
    """V6: current-row markers (end transaction / ineffective date NULL, flag Y)."""
    cond = F.lit(True)
    for c in null_cols:
        cond = cond & F.col(c).isNull()
    if flag_col:
        cond = cond & (F.col(flag_col) == "Y")
    return df.filter(cond)
