"""Inline constant tables.

Each table is tiny and its size is fixed by this file, not by the data, so
it is the one kind of relation that is broadcast unconditionally.  Every
table is rendered twice from the same Python list: as a Spark SQL inline
table (``VALUES``) and as a DuckDB ``VALUES`` clause for the SQL oracle.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Payment terms keyed by the first character of the order
# priority (term 5 has no row: its due date falls back to the trx date).
PAYMENT_TERMS = [
    (1, "IMMEDIATE", 0),
    (2, "NET 15", 15),
    (3, "NET 30", 30),
    (4, "NET 45", 45),
]
PAYMENT_TERMS_SCHEMA = "term_id int, term_name string, due_days int"

# Public holidays and who they apply to.
HOLIDAYS = [
    (_dt.date(2024, 1, 1), "New Year", "ALL"),
    (_dt.date(2024, 1, 15), "Founders Day", "EVEN"),
]
HOLIDAYS_SCHEMA = "holiday_date date, holiday_name string, scope string"

# Work schedules and their working weekdays (Monday = 1).
SCHEDULE_DAYS = [("STD", d) for d in (1, 2, 3, 4, 5)] + [("SHIFT", d) for d in (1, 2, 3, 4, 5, 6)]
SCHEDULE_DAYS_SCHEMA = "schedule_id string, weekday int"

# Event type -> payroll element, classification.
PAY_ELEMENTS = [
    ("view", "Basic", "Earnings"),
    ("click", "Housing", "Earnings"),
    ("purchase", "Transport", "Earnings"),
    ("error", "Deduction", "Deductions"),
    ("signup", "Information", "Information"),
]
PAY_ELEMENTS_SCHEMA = "event_type string, element string, classification string"

# Event type -> absence accrual entry type.
ACCRUAL_TYPES = [
    ("view", "ACRL"),
    ("click", "ABS"),
    ("purchase", "CSH"),
    ("signup", "COVR"),
    ("error", "ADJOTH"),
]
ACCRUAL_TYPES_SCHEMA = "event_type string, entry_type string"

# Recruiting stage reached by an event type.
FUNNEL_STAGES = [
    ("view", "APPLIED"),
    ("click", "OFFERED"),
    ("purchase", "ACCEPTED"),
    ("signup", "HIRED"),
]

# Account ranges of the natural account.
ACCOUNT_CLASSES = [
    ("ASSET", 1000, 1999),
    ("LIABILITY", 2000, 2999),
    ("EQUITY", 3000, 3999),
    ("REVENUE", 4000, 4999),
    ("EXPENSE", 5000, 9999),
]

# Passenger kinds of a rate card and their share of the adult
# rate, in percent.
RATE_KINDS = [("ADULT", 100), ("CHILD", 50), ("INFANT", 10)]
MARKET_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
RATE_PERIODS = [
    (_dt.date(1995, 1, 1), _dt.date(2000, 12, 31), 0),
    (_dt.date(2001, 1, 1), _dt.date(4712, 12, 31), 10),
]
RATE_CARD_SCHEMA = ("region_id int, segment string, kind string, rate decimal(18,2), "
                    "valid_from date, valid_to date")


def rate_card_rows() -> list[tuple]:
    """S7 rate card generated by rule: region x segment x kind x validity.

    Adult rate = 100 + 10 * region + segment index (+10 from 2001); other
    kinds take their percentage of it.
    """
    from decimal import Decimal
    rows = []
    for region in range(5):
        for s_idx, seg in enumerate(MARKET_SEGMENTS):
            for vfrom, vto, uplift in RATE_PERIODS:
                adult = 100 + 10 * region + s_idx + uplift
                for kind, pct in RATE_KINDS:
                    rate = (Decimal(adult) * pct / 100).quantize(Decimal("0.01"))
                    rows.append((region, seg, kind, rate, vfrom, vto))
    return rows


def frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A constant table, marked for broadcast (its size is fixed above).

    Built as a SQL inline table (``VALUES``), so the rows live in the plan
    as literals: no Python-side data conversion, nothing to ship."""
    cols = [c.strip().split(" ", 1) for c in _split_schema(schema)]
    body = ", ".join("(" + ", ".join(_sql_value(v) for v in r) + ")" for r in rows)
    names = ", ".join(n for n, _ in cols)
    casts = ", ".join(f"CAST({n} AS {t.strip()}) AS {n}" for n, t in cols)
    return F.broadcast(spark.sql(f"SELECT {casts} FROM VALUES {body} AS v({names})"))


def _sql_value(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, _dt.date):
        return f"DATE '{v.isoformat()}'"
    return str(v)


def sql_values(rows: list[tuple], schema: str) -> str:
    """``SELECT * FROM (VALUES ...) t(cols)`` with casts matching ``schema``."""
    cols = [c.strip().split(" ", 1) for c in _split_schema(schema)]
    body = ", ".join("(" + ", ".join(_sql_value(v) for v in r) + ")" for r in rows)
    names = ", ".join(c[0] for c in cols)
    casts = ", ".join(f"CAST({n} AS {_duck_type(t)}) AS {n}" for n, t in cols)
    return f"SELECT {casts} FROM (VALUES {body}) v({names})"


def _split_schema(schema: str) -> list[str]:
    parts, depth, cur = [], 0, ""
    for ch in schema:
        if ch == "(":
            depth += 1
        elif ch == ")":
            depth -= 1
        if ch == "," and depth == 0:
            parts.append(cur)
            cur = ""
        else:
            cur += ch
    parts.append(cur)
    return [p.strip() for p in parts if p.strip()]


def _duck_type(t: str) -> str:
    t = t.strip().lower()
    return {"int": "INTEGER", "string": "VARCHAR", "date": "DATE", "bigint": "BIGINT"}.get(t, t.upper())


def payment_terms(spark):
    return frame(spark, PAYMENT_TERMS, PAYMENT_TERMS_SCHEMA)


def holidays(spark):
    return frame(spark, HOLIDAYS, HOLIDAYS_SCHEMA)


def schedule_days(spark):
    return frame(spark, SCHEDULE_DAYS, SCHEDULE_DAYS_SCHEMA)


def pay_elements(spark):
    return frame(spark, PAY_ELEMENTS, PAY_ELEMENTS_SCHEMA)


def accrual_types(spark):
    return frame(spark, ACCRUAL_TYPES, ACCRUAL_TYPES_SCHEMA)


def rate_card(spark):
    return frame(spark, rate_card_rows(), RATE_CARD_SCHEMA)
