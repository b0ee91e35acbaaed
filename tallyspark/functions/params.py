"""Report parameters and the optional-filter modes.

Reports take a ``Params`` value rather than bind variables.  Filters are
added to the plan only when a parameter is given, so that an "All" report has
no predicate at all and Catalyst keeps the Parquet scan unfiltered; a given
parameter becomes a literal predicate that is pushed into the scan.
"""

from __future__ import annotations

import datetime as _dt
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

class Bind(_dt.date):
    """A date that stands for a report parameter: its default value, and in
    SQL a marked literal which :func:`render` replaces by the parameter's."""

    def __new__(cls, name: str, value: _dt.date, of: str = "", shift: int = 0):
        self = super().__new__(cls, value.year, value.month, value.day)
        self.name, self.of, self.shift = name, of, shift
        return self

    def __reduce__(self):
        return Bind, (self.name, _dt.date(self.year, self.month, self.day), self.of, self.shift)

    def _plain(self) -> _dt.date:
        return _dt.date(self.year, self.month, self.day)

    def __add__(self, other):
        return Bind(self.name, self._plain() + other, self.of, self.shift + other.days)

    def __sub__(self, other):
        if isinstance(other, _dt.timedelta):
            return self + (-other)
        return self._plain() - other

    def start(self, of: str) -> Bind:
        """The first day of the date's ``year`` or ``month``."""
        return Bind(self.name, _start(self._plain(), of), of)

    def sql(self) -> str:
        return f"/*{self.name}{'@' + self.of if self.of else ''}{f'{self.shift:+d}' if self.shift else ''}*/{literal(self._plain())}"


def _start(d: _dt.date, of: str) -> _dt.date:
    return d.replace(day=1) if of == "month" else d.replace(month=1, day=1) if of == "year" else d


def literal(d: _dt.date) -> str:
    """A date in SQL."""
    return d.sql() if isinstance(d, Bind) else f"DATE '{d.isoformat()}'"


# The parameter dates' defaults.
AS_OF = Bind("as_of", _dt.date(2000, 12, 31))
PERIOD_FROM = Bind("date_from", _dt.date(2000, 1, 1))
PERIOD_TO = Bind("date_to", _dt.date(2000, 12, 31))
EVENTS_FROM = Bind("events_from", _dt.date(2024, 1, 1))
EVENTS_TO = Bind("events_to", _dt.date(2024, 1, 30))
# Open end of a date-effective row.
END_OF_TIME = _dt.date(4712, 12, 31)

ALL = "All"


@dataclass(frozen=True)
class Params:
    """The parameter block of a report.

    Dates may be given as dates, timestamps or text and are truncated to the
    day; a missing one defaults to today (S2), a missing period to the year up
    to today (S3).  ``org_ids`` and ``customer_ids`` (F1, F6) restrict the
    customers of the run; ``filters`` maps a column of the report to a value, a
    list, ``"All"`` or None (F1).
    """

    date_from: _dt.date | None = PERIOD_FROM
    date_to: _dt.date | None = PERIOD_TO
    as_of: _dt.date | None = AS_OF
    events_from: _dt.date | None = EVENTS_FROM
    events_to: _dt.date | None = EVENTS_TO
    org_ids: object = ALL
    customer_ids: object = ALL
    filters: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        start, today = year_to_date()
        for name, default in (("date_from", start), ("date_to", today), ("as_of", today), ("events_from", start), ("events_to", today)):
            value = as_date(getattr(self, name))
            object.__setattr__(self, name, default if value is None else value)
        if self.date_from > self.date_to or self.events_from > self.events_to:
            raise ValueError("a period must not end before it starts")

    def customer_limits(self) -> dict[str, list]:
        """Columns of ``customer`` with the values that a run is limited to."""
        both = {"c_nationkey": listed(self.org_ids), "c_custkey": listed(self.customer_ids)}
        return {c: v for c, v in both.items() if v is not None}


def listed(value) -> list | None:
    """The values of a multi-select parameter; None for All."""
    values = [value] if value is None or isinstance(value, (str, int, float, _dt.date)) else list(value)
    return None if any(_is_all(v) for v in values) else values


_MARK = re.compile(r"/\*(\w+?)(?:@(year|month))?([+-]\d+)?\*/DATE '\d{4}-\d\d-\d\d'")


def sql_value(value) -> str:
    if isinstance(value, _dt.date):
        return literal(as_date(value))
    return str(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"


def render(sql: str, params: Params) -> str:
    """The DuckDB text of a report for ``params``: marked dates replaced, the
    customer table limited, the report's columns filtered."""
    def date(m):
        return literal(_start(as_date(getattr(params, m[1])), m[2] or "") + _dt.timedelta(days=int(m[3] or 0)))

    out = _MARK.sub(date, sql)
    wanted = {c: v for c, v in ((c, listed(v)) for c, v in params.filters.items()) if v is not None}
    within = lambda limits: " AND ".join(f"{c} IN ({', '.join(map(sql_value, v))})" for c, v in limits.items())
    limits = params.customer_limits()
    if wanted or limits:
        only = f"WITH customer AS (SELECT * FROM main.customer WHERE {within(limits)}) " if limits else ""
        out = f"{only}SELECT * FROM ({out}) report" + (f" WHERE {within(wanted)}" if wanted else "")
    return out


def as_date(value) -> _dt.date | None:
    """Truncate a timestamp or a 'YYYY-MM-DD...' string to a date."""
    if value is None:
        return None
    if isinstance(value, _dt.datetime):
        return value.date()
    if isinstance(value, _dt.date):
        return _dt.date(value.year, value.month, value.day)
    return _dt.date.fromisoformat(str(value)[:10])


def year_to_date(today: _dt.date | None = None) -> tuple[_dt.date, _dt.date]:
    """S3: default window from 1 January to today."""
    today = today or _dt.date.today()
    return _dt.date(today.year, 1, 1), today


def previous_month(today: _dt.date | None = None) -> tuple[_dt.date, _dt.date]:
    """S3: the whole previous calendar month."""
    today = today or _dt.date.today()
    first_this = today.replace(day=1)
    last_prev = first_this - _dt.timedelta(days=1)
    return last_prev.replace(day=1), last_prev


def _is_all(value) -> bool:
    return value is None or (isinstance(value, str) and value.upper() == ALL.upper())


def filter_in(df: DataFrame, col: str, values) -> DataFrame:
    """multi-select with All bypass; no predicate at all for All/None."""
    if _is_all(value := values):
        return df
    if isinstance(value, (str, int, float, _dt.date)):
        value = [value]
    value = list(value)
    if any(_is_all(v) for v in value):
        return df
    return df.filter(F.col(col).isin(value))


def filter_ci(df: DataFrame, col: str, value: str | None) -> DataFrame:
    """case-insensitive equality, NULL or 'ALL' meaning no filter."""
    if _is_all(value):
        return df
    return df.filter(F.upper(F.col(col)) == F.lit(str(value).upper()))


def filter_optional(df: DataFrame, col: str, value) -> DataFrame:
    """``p IS NULL OR col = p`` -- rows with a NULL column survive All."""
    if value is None:
        return df
    return df.filter(F.col(col) == F.lit(value))


def filter_nvl(df: DataFrame, col: str, value) -> DataFrame:
    """``col = NVL(p, col)`` -- unlike F3 a NULL column never matches."""
    if value is None:
        return df.filter(F.col(col).isNotNull())
    return df.filter(F.col(col) == F.lit(value))


def date_range(col: str | Column, date_from: _dt.date | None,
               date_to: _dt.date | None) -> Column:
    """optional inclusive date range on the date part of ``col``.

    Written as a half-open range on the raw column (``>= from`` and
    ``< to + 1 day``) so that Parquet min/max statistics can prune row groups
    even when the column is a timestamp.
    """
    c = F.col(col) if isinstance(col, str) else col
    cond = F.lit(True)
    if date_from is not None:
        cond = cond & (c >= F.lit(date_from))
    if date_to is not None:
        cond = cond & (c < F.lit(date_to + _dt.timedelta(days=1)))
    return cond


def apply_filters(df: DataFrame, filters: dict, mode: str = "in") -> DataFrame:
    """Apply a mapping of column -> parameter with one filter mode."""
    fn = {"in": filter_in, "ci": filter_ci, "optional": filter_optional,
          "nvl": filter_nvl}[mode]
    for col, value in filters.items():
        df = fn(df, col, value)
    return df
