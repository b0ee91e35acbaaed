"""Scalar helpers where Oracle and Spark semantics differ.

All helpers return ``Column`` expressions, so they stay inside whole-stage
code generation.  Money is DECIMAL throughout; ratios that are reported
rounded use exact integer arithmetic (``div``) so that the value does not
depend on floating-point rounding of the engine.
"""

from __future__ import annotations

import datetime as _dt
from decimal import Decimal
from typing import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
TOTAL = "decimal(38,2)"
RATE = "decimal(18,6)"

_CENT = Decimal("0.01")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- X1 null handling -----------------------------------------------------

def nvl(c, default) -> Column:
    return F.coalesce(col(c), default if isinstance(default, Column) else F.lit(default))


def nvl2(c, if_not_null, if_null) -> Column:
    return F.when(col(c).isNotNull(), if_not_null).otherwise(if_null)


def nullif(c, value) -> Column:
    return F.nullif(col(c), value if isinstance(value, Column) else F.lit(value))


# -- X2 DECODE ---------------------------------------------------------------

def decode(c, pairs: Sequence[tuple], default=None) -> Column:
    """Oracle DECODE: first match wins and NULL matches a NULL search value."""
    c = col(c)
    expr = None
    for search, result in pairs:
        cond = c.isNull() if search is None else c == F.lit(search)
        res = result if isinstance(result, Column) else F.lit(result)
        expr = F.when(cond, res) if expr is None else expr.when(cond, res)
    dflt = default if isinstance(default, Column) else F.lit(default)
    return dflt if expr is None else expr.otherwise(dflt)


# -- X3 money and rounding ----------------------------------------------------

def money(c) -> Column:
    """Cast to DECIMAL(18,2) (never sum doubles)."""
    return col(c).cast(MONEY)


def total(c) -> Column:
    """A summed money amount, widened so large ledgers do not overflow."""
    return col(c).cast(TOTAL)


def round_money(c) -> Column:
    """Oracle ROUND(x, 2) on a decimal: half away from zero."""
    return F.round(col(c), 2).cast(MONEY)


def cents(c) -> Column:
    """Money as integer cents (exact)."""
    return (col(c) * 100).cast("bigint")


def div_round(num, den, scale: int = 2) -> Column:
    """Exact ``round(num / den, scale)`` for integral num/den, half away from zero.

    NULL when ``den`` is 0 (X15 zero guard).  Result is DECIMAL(18, scale).
    Integer ``div`` keeps it exact (a double quotient would round differently
    from engine to engine).
    """
    n, d = col(num).cast("decimal(38,0)"), col(den).cast("decimal(38,0)")  # wide: totals times 200 pass BIGINT
    k = 10 ** scale
    sign = (F.signum(n) * F.signum(d)).cast("bigint")
    mag = F.abs(n) * F.lit(2 * k) + F.abs(d)
    safe_d = F.when(d == 0, F.lit(1).cast("decimal(38,0)")).otherwise(F.abs(d) * 2)
    units = (sign * F.call_function("div", mag, safe_d)).cast("decimal(18,0)")
    scaled = (units * F.lit(Decimal(1).scaleb(-scale))).cast(f"decimal(18,{scale})")
    return F.when(d == 0, F.lit(None).cast(f"decimal(18,{scale})")).otherwise(scaled)


def percent(num, den, scale: int = 2) -> Column:
    """100 * num / den rounded, NULL when den = 0 (integral inputs)."""
    return div_round(col(num).cast("decimal(38,0)") * 100, den, scale)


def sql_div_round(num: str, den: str, scale: int = 2) -> str:
    """DuckDB twin of :func:`div_round`."""
    k = 10 ** scale
    return (
        f"CASE WHEN ({den}) = 0 THEN NULL ELSE CAST(CAST(sign({num}) * sign({den}) * "
        f"((abs(CAST({num} AS BIGINT)) * {2 * k} + abs(CAST({den} AS BIGINT))) // "
        f"(2 * abs(CAST({den} AS BIGINT)))) AS DECIMAL(18,0)) * "
        f"CAST({Decimal(1).scaleb(-scale)} AS DECIMAL(18,{scale})) AS DECIMAL(18,{scale})) END"
    )


def sql_percent(num: str, den: str, scale: int = 2) -> str:
    return sql_div_round(f"(CAST({num} AS BIGINT) * 100)", den, scale)


# -- X4/X5 dates ---------------------------------------------------------------

def days_between(later, earlier) -> Column:
    """DATE - DATE in days."""
    return F.datediff(col(later), col(earlier))


def service_years(as_of, start) -> Column:
    """Service in years to 2 dp: MONTHS_BETWEEN / 12.

    Counted in 31sts of a month, so it is exact: equal days of the month, or
    two month ends, are whole months.
    """
    a, b = col(as_of), col(start)
    months = (F.year(a) - F.year(b)) * 12 + F.month(a) - F.month(b)
    whole = (F.dayofmonth(a) == F.dayofmonth(b)) | ((a == F.last_day(a)) & (b == F.last_day(b)))
    days = F.when(whole, 0).otherwise(F.dayofmonth(a) - F.dayofmonth(b))
    return div_round(months * 31 + days, F.lit(372), 2)


def sql_service_years(as_of: str, start: str) -> str:
    """DuckDB twin of :func:`service_years`."""
    days = (f"CASE WHEN day({as_of}) = day({start}) OR ({as_of} = last_day({as_of}) AND {start} = last_day({start})) "
            f"THEN 0 ELSE day({as_of}) - day({start}) END")
    return sql_div_round(f"(((year({as_of}) - year({start})) * 12 + month({as_of}) - month({start})) * 31 + {days})", "372")


def months_between_sql(later: str, earlier: str) -> str:
    """DuckDB twin of Oracle/Spark MONTHS_BETWEEN for DATE inputs.

    Whole months when the days of month match or both are month ends,
    else the day difference divided by 31.
    """
    return (
        f"(CASE WHEN day({later}) = day({earlier}) OR "
        f"({later} = last_day({later}) AND {earlier} = last_day({earlier})) "
        f"THEN CAST((year({later}) - year({earlier})) * 12 + month({later}) - month({earlier}) AS DOUBLE) "
        f"ELSE (year({later}) - year({earlier})) * 12 + month({later}) - month({earlier}) "
        f"+ (day({later}) - day({earlier})) / 31.0 END)"
    )


def month_start(c) -> Column:
    return F.trunc(col(c), "month")




# -- X7 weekday -----------------------------------------------------------------

def iso_weekday(c) -> Column:
    """Monday = 1 ... Sunday = 7."""
    return F.weekday(col(c)) + 1


# -- X8 milliseconds of day ------------------------------------------------------

def ms_to_hours(c) -> Column:
    """Whole hours of a milliseconds-of-day value."""
    return F.floor(col(c) / 3600000).cast("bigint")


def ms_to_minutes(c) -> Column:
    """Minutes past the hour of a milliseconds-of-day value."""
    return F.floor(F.pmod(col(c), F.lit(3600000)) / 60000).cast("bigint")


def shift_timestamp(day, ms) -> Column:
    """Day + milliseconds of day; 24 h and more roll into the next day."""
    return F.timestamp_add("MILLISECOND", col(ms), col(day).cast("timestamp_ntz"))


# -- X9 anniversary ---------------------------------------------------------------

def plan_year_start(as_of, hire=None) -> Column:
    """Calendar year start, or the last hire anniversary on or before as_of.

    29 February hires anniversary on 28 February in common years
    (``make_date`` is avoided: ``add_months`` clamps to month end).
    """
    a = col(as_of)
    if hire is None:
        return F.trunc(a, "year")
    h = col(hire)
    years = F.year(a) - F.year(h)
    this_year = F.add_months(h, years * 12)
    return F.when(this_year <= a, this_year).otherwise(F.add_months(h, (years - 1) * 12))


# -- X10 greatest/least with Oracle NULL semantics ---------------------------------

def greatest_strict(*cols) -> Column:
    cs = [col(c) for c in cols]
    any_null = F.lit(False)
    for c in cs:
        any_null = any_null | c.isNull()
    return F.when(any_null, F.lit(None)).otherwise(F.greatest(*cs))




# -- X11/X12 text --------------------------------------------------------------------

def concat_oracle(*cols) -> Column:
    """``a || b``: NULL acts as the empty string."""
    return F.concat(*[F.coalesce(col(c).cast("string"), F.lit("")) for c in cols])




# -- X13 safe number ----------------------------------------------------------------





# -- X14 bands --------------------------------------------------------------------------

def band(c, bands: Iterable[tuple], default=None) -> Column:
    """First-match banding: ``bands`` is a sequence of (label, lo, hi) with
    inclusive bounds, None meaning open."""
    c = col(c)
    expr = None
    for label, lo, hi in bands:
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (c >= F.lit(lo))
        if hi is not None:
            cond = cond & (c <= F.lit(hi))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(default)) if expr is not None else F.lit(default)


def sql_band(c: str, bands: Iterable[tuple], default=None) -> str:
    parts = []
    for label, lo, hi in bands:
        conds = []
        if lo is not None:
            conds.append(f"{c} >= {lo}")
        if hi is not None:
            conds.append(f"{c} <= {hi}")
        cond = " AND ".join(conds) or "TRUE"
        parts.append(f"WHEN {cond} THEN '{label}'")
    dflt = "NULL" if default is None else f"'{default}'"
    return "CASE " + " ".join(parts) + f" ELSE {dflt} END"
