"""Join operators.

Equality keys always; a range condition only as a residual on top of an
equality key (never a join on ranges alone, which Spark would plan as a
nested loop).  ``broadcast`` is applied only to relations whose size is
fixed by definition (constant tables, nation/region); everything else is
left to the optimiser and AQE, which converts a join to a broadcast at
runtime only after measuring the side.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.operators import windows


def lookup(df: DataFrame, table: DataFrame, keys: Sequence[str], fixed_size: bool = False,
           how: str = "left") -> DataFrame:
    """Code -> meaning lookup.  ``fixed_size`` marks a constant table
    (safe to broadcast); other lookups are left to AQE."""
    right = F.broadcast(table) if fixed_size else table
    return df.join(right, list(keys), how)


def left_with_filter(df: DataFrame, other: DataFrame, keys: Sequence[str], extra: Column) -> DataFrame:
    """Left join with the optional side's predicates applied *before* the
    join (after it they would turn the outer join into an inner one)."""
    return df.join(other.filter(extra), list(keys), "left")


def semi(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """EXISTS."""
    return df.join(other.select(*keys), list(keys), "left_semi")


def anti(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """NOT EXISTS."""
    return df.join(other.select(*keys), list(keys), "left_anti")


def not_in(df: DataFrame, col: str, other: DataFrame, other_col: str) -> DataFrame:
    """Null-aware ``col NOT IN (subquery)``.

    SQL semantics: no row survives when the subquery holds a NULL, and a
    NULL ``col`` never survives a non-empty subquery.  Written as an
    ordinary (shuffled or AQE-broadcast) anti join plus one scalar
    subquery returning (has a NULL, row count) -- no null-aware broadcast of
    the whole subquery, which Spark would otherwise need.
    """
    sub = other.select(F.col(other_col).alias("__k"))
    flags = sub.agg(F.struct(F.max(F.when(F.col("__k").isNull(), 1).otherwise(0)).alias("has_null"),
                             F.count(F.lit(1)).alias("n"))).scalar()
    kept = df.join(sub.filter(F.col("__k").isNotNull()), df[col] == F.col("__k"), "left_anti")
    cond = (flags["n"] == 0) | ((F.coalesce(flags["has_null"], F.lit(0)) == 0) & F.col(col).isNotNull())
    return kept.filter(cond)


def semi_or(df: DataFrame, other: DataFrame, keys: Sequence[str], cond: Column) -> DataFrame:
    """``cond OR EXISTS(...)`` -- left join on the distinct keys with a
    flag, then one filter (a semi join cannot express the OR)."""
    flag = other.select(*keys).distinct().withColumn("__hit", F.lit(True))
    return df.join(flag, list(keys), "left").filter(cond | F.col("__hit").isNotNull()).drop("__hit")


def self_join(df: DataFrame, left_key: str, right_key: str, right_prefix: str = "r_",
              how: str = "inner") -> DataFrame:
    """Aliased self join (e.g. tax line -> its revenue line)."""
    right = df.select(*[F.col(c).alias(right_prefix + c) for c in df.columns])
    return df.join(right, df[left_key] == right[right_prefix + right_key], how)


def resolve_first(df: DataFrame, sources: Sequence[tuple[DataFrame, str, str]], out: str,
                  default: str | None = None) -> DataFrame:
    """Left join several sources, first non-null wins, else default.

    ``sources`` = (frame, key in df, value column); each source must be one
    row per key (deduplicate before)."""
    vals = []
    for i, (src, key, value) in enumerate(sources):
        alias = f"__src{i}"
        df = df.join(src.select(F.col(key), F.col(value).alias(alias)), key, "left")
        vals.append(F.col(alias))
    if default is not None:
        vals.append(F.lit(default))
    return df.withColumn(out, F.coalesce(*vals)).drop(*[f"__src{i}" for i in range(len(sources))])


def override_union(level2: DataFrame, level1: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Level-2 rows win; level-1 rows only where no level-2 row exists."""
    return level2.unionByName(level1.join(level2.select(*keys).distinct(), list(keys), "left_anti"),
                              allowMissingColumns=True)


def fallback_chain(cols: Sequence[Column]) -> Column:
    """Hierarchy fallback (task -> project -> line manager)."""
    return F.coalesce(*cols)


def stretch_overlaps(left: DataFrame, right: DataFrame, keys: Sequence[str], amount: str = "cents", upto: str = "upto",
                     width: int = 1 << 23) -> DataFrame:
    """Pairs of rows whose stretches ``[upto - amount, upto)`` overlap within a
    key, with the ``overlap``; amounts are whole and above 0, and neither side
    overlaps itself.

    Stretches are cut into cells of ``width`` and met by equality on (key,
    cell), so a hot key is as many groups as it has cells; a pair counts in
    the cell in which its overlap starts.  Choose ``width`` near a usual
    amount: a cell then holds a few rows of either side.
    """
    def celled(df: DataFrame, side: str) -> DataFrame:
        low = F.col(upto) - F.col(amount)
        own = [F.col(c).alias(f"{side}{c}") for c in df.columns if c not in (*keys, amount, upto)]
        cells = F.explode(F.sequence(F.floor(low / width), F.floor((F.col(upto) - 1) / width))).alias("__cell")
        return df.select(*keys, *own, low.alias(f"__{side}low"), F.col(upto).alias(f"__{side}upto"), cells)

    both = celled(left, "l__").join(celled(right, "r__"), [*keys, "__cell"])
    start, end = F.greatest("__l__low", "__r__low"), F.least("__l__upto", "__r__upto")
    both = both.where((start < end) & (F.floor(start / width) == F.col("__cell")))
    names = [F.col(f"{side}{c}").alias(c) for side, df in (("l__", left), ("r__", right)) for c in df.columns if c not in (*keys, amount, upto)]
    return both.select(*keys, *names, (end - start).alias("overlap"))


def link_chain(df: DataFrame, hops: Sequence[tuple], tenant: Sequence[str] = ()) -> DataFrame:
    """Follow rows through bridge tables, hop by hop.

    A hop is ``(table, keys, how)``; its table has one row per key, so no hop
    can fan out, and is joined with salt (a hot document spreads over tasks).
    Salt copies the table ``windows.SALTS`` times, so a table about as long as
    the rows is better joined plain, ``(table, keys, how, True)``: where a key
    has few rows by its nature, or where both sides are shuffled for the join
    alone (no aggregate by the same keys) and AQE splits a hot key.
    Every ``tenant`` column that both sides hold must be among the keys (F6):
    ids repeat across tenants, and a hop without it would mix them.
    Follow the short tables to their document first and join the fact last.
    """
    for table, keys, how, *plain in hops:
        loose = [c for c in tenant if c in df.columns and c in table.columns and c not in keys]
        if loose:
            raise ValueError(f"a hop on {', '.join(keys)} leaves out the tenant key {', '.join(loose)}")
        df = df.join(table, list(keys), how) if any(plain) else windows.join_back(df, table, keys, how)
    return df
