"""Query catalogue: one Spark callable and (where expressible) one oracle SQL
text per registered key.

A key is registered with :func:`register`; the Spark callable takes
``(spark, sf_dir)`` and returns a lazy DataFrame, the SQL text runs on DuckDB
against views named like the source tables.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyspark.functions.params import Params, apply_filters, listed, render
from tallyspark.session import tune_session
from tallyspark.sources.tables import Tables

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}
DESCRIPTIONS: dict[str, str] = {}
PLANS: dict[str, Callable[[Tables], DataFrame]] = {}


_TABLES: dict[tuple[int, str], tuple[SparkSession, Tables]] = {}


def tables_for(spark: SparkSession, sf_dir: str) -> Tables:
    """One ``Tables`` per (session, folder): the source DataFrames (file
    listing, Parquet footers) are resolved once and shared by every query
    run against the same folder in the same session."""
    key = (id(spark), sf_dir)
    hit = _TABLES.get(key)
    if hit is None or hit[0] is not spark:
        hit = (spark, Tables(spark, sf_dir))
        _TABLES[key] = hit
    return hit[1]


def register(name: str, sql: str | None = None):
    """Decorator: ``fn(t: Tables) -> DataFrame`` becomes query ``name``."""

    def deco(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query key {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            tune_session(spark)
            return fn(tables_for(spark, sf_dir))

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        PLANS[name] = fn
        DESCRIPTIONS[name] = (fn.__doc__ or "").strip().splitlines()[0] if fn.__doc__ else ""
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def report(name: str, spark: SparkSession, sf_dir: str, params: Params) -> DataFrame:
    """A report for other parameters than the defaults.

    Dates reach the plan as literals, so they are pushed into the scans as
    the defaults are; a filter on a report column is one on the result, which
    Catalyst pushes as far down as the plan allows.
    """
    load_all()
    tune_session(spark)
    df = PLANS[name](tables_for(spark, sf_dir).with_params(params))
    wanted = {c: v for c, v in params.filters.items() if listed(v) is not None}
    if missing := sorted(set(wanted) - set(df.columns)):
        raise ValueError(f"{name} has no column {', '.join(missing)} to filter; it has {', '.join(df.columns)}")
    return apply_filters(df, wanted)


def report_sql(name: str, params: Params) -> str:
    """The DuckDB text of :func:`report`."""
    load_all()
    return render(ORACLE[name], params)


def load_all() -> None:
    """Import every plan module so that its queries register."""
    from tallyspark.plans import (  # noqa: F401
        generic, receivables, payables, ledger, cash_assets, supply, projects,
        time_labor, payroll, people, quality_checks, cross_module, recruiting, supplier_ledger, link_chain,
    )
