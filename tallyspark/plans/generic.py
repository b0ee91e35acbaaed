"""

Each applies the operator from :mod:`tallyspark.operators` to a stand-in
table over the whole input, with its DuckDB twin.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import params as P
from tallyspark.functions import scalars as X
from tallyspark.functions.params import AS_OF, END_OF_TIME, EVENTS_FROM, EVENTS_TO, PERIOD_FROM, PERIOD_TO
from tallyspark.functions.scalars import MONEY, TOTAL
from tallyspark.operators import effective as E
from tallyspark.operators import joins as J
from tallyspark.operators import rollup as A
from tallyspark.operators import windows as W
from tallyspark.plans.registry import register
from tallyspark.sources import constants as K
from tallyspark.sources import standins as S
from tallyspark.sources.tables import Tables

D = S._d

SPINE_SQL = (f"unnest(generate_series({D(EVENTS_FROM)}::TIMESTAMP, {D(EVENTS_TO)}::TIMESTAMP, "
             f"INTERVAL 1 DAY))")

# ---------------------------------------------------------------------------
# Sources (S)
# ---------------------------------------------------------------------------


@register("s5_date_spine", S.with_sql(f"""
SELECT p.person_id, CAST(d.day AS DATE) AS day
FROM people p CROSS JOIN LATERAL (SELECT {SPINE_SQL} AS day) d""", "people"))
def date_spine(t: Tables) -> DataFrame:
    """One row per person and day of the window (explode, no cartesian product)."""
    return S.people(t).select("person_id", F.explode(F.sequence(F.lit(t.params.events_from), F.lit(t.params.events_to))).alias("day"))


@register("s6_working_calendar", S.with_sql("SELECT * FROM schedule_days", "schedule_days"))
def working_calendar(t: Tables) -> DataFrame:
    """Working days per person's (overridden) schedule in the window."""
    return S.schedule_days(t)


@register("s4_inline_terms_lookup", S.with_sql("""
SELECT COALESCE(term_name, 'NONE') AS term_name, COUNT(*) AS trx_count,
       CAST(SUM(amount) AS DECIMAL(38,2)) AS amount
FROM invoices GROUP BY COALESCE(term_name, 'NONE')""", "invoices"))
def inline_terms(t: Tables) -> DataFrame:
    """Inline constant table used as a broadcast lookup (payment terms)."""
    inv = S.invoices(t)
    return inv.groupBy(F.coalesce(F.col("term_name"), F.lit("NONE")).alias("term_name")).agg(
        F.count(F.lit(1)).alias("trx_count"), F.sum("amount").cast(TOTAL).alias("amount"))


_S7_SQL = S.with_sql(f"""
SELECT c.customer_id,
       MAX(CASE WHEN r.kind = 'ADULT' THEN r.rate END) AS adult_rate,
       MAX(CASE WHEN r.kind = 'CHILD' THEN r.rate END) AS child_rate,
       MAX(CASE WHEN r.kind = 'INFANT' THEN r.rate END) AS infant_rate
FROM customers c JOIN rate_card r ON r.region_id = c.ledger_id AND r.segment = c.segment
 AND {D(AS_OF)} BETWEEN r.valid_from AND r.valid_to
GROUP BY c.customer_id""", "customers", "rate_card")


@register("s7_rate_card", _S7_SQL)
def rate_card_lookup(t: Tables) -> DataFrame:
    """S7 + J20: rate card valid at the date, one column per passenger kind.

    The rate card (fixed size) is filtered at the date and pivoted once,
    then joined to each customer on (region, segment)."""
    rc = E.as_of(K.rate_card(t.spark), t.params.as_of, "valid_from", "valid_to")
    piv = A.attribute_pivot(rc, ["region_id", "segment"], "kind", "rate", ["ADULT", "CHILD", "INFANT"],
                            {"ADULT": "adult_rate", "CHILD": "child_rate", "INFANT": "infant_rate"})
    c = S.customers(t).select("customer_id", F.col("ledger_id").alias("region_id"), "segment")
    return c.join(F.broadcast(piv), ["region_id", "segment"]).drop("region_id", "segment")


_S8_SQL = S.with_sql("""
SELECT r.receipt_id, CAST(COALESCE(x.rate, 1) AS DECIMAL(18,6)) AS rate,
       CAST(ROUND(r.amount * COALESCE(x.rate, 1), 2) AS DECIMAL(38,2)) AS functional_amount
FROM receipts r LEFT JOIN (SELECT DISTINCT trx_date AS conversion_date, 'CUR' || CAST(org_id AS VARCHAR) AS from_currency,
                                  'USD' AS to_currency, 'Corporate' AS rate_type, exchange_rate AS rate
                           FROM invoices WHERE exchange_rate IS NOT NULL) x
  ON x.conversion_date = r.receipt_date AND x.from_currency = 'CUR' || CAST(r.org_id AS VARCHAR)
 AND x.to_currency = 'USD' AND x.rate_type = 'Corporate'""", "receipts", "invoices")


@register("s8_daily_rate_lookup", _S8_SQL)
def daily_rate(t: Tables) -> DataFrame:
    """Daily rate on (date, type, from, to), defaulting to 1."""
    rates = (S.invoices(t).filter(F.col("exchange_rate").isNotNull())
             .select(F.col("trx_date").alias("conversion_date"),
                     F.concat(F.lit("CUR"), F.col("org_id").cast("string")).alias("from_currency"),
                     F.lit("USD").alias("to_currency"), F.lit("Corporate").alias("rate_type"),
                     F.col("exchange_rate").alias("rate")).distinct())
    r = S.receipts(t).select("receipt_id", "amount", F.col("receipt_date").alias("conversion_date"),
                             F.concat(F.lit("CUR"), F.col("org_id").cast("string")).alias("from_currency"),
                             F.lit("USD").alias("to_currency"), F.lit("Corporate").alias("rate_type"))
    j = r.join(rates, ["conversion_date", "from_currency", "to_currency", "rate_type"], "left")
    rate = F.coalesce(F.col("rate"), F.lit(1))
    return j.select("receipt_id", rate.cast("decimal(18,6)").alias("rate"),
                    F.round(F.col("amount") * rate, 2).cast(TOTAL).alias("functional_amount"))


@register("s9_burst_keys", S.with_sql("""
SELECT c.unit_name AS burst_key, 'csv' AS output_format,
       'statement_' || lower(c.unit_name) || '.csv' AS file_name, c.customer_id, c.party_name,
       CAST(SUM(i.amount) AS DECIMAL(38,2)) AS billed
FROM invoices i JOIN customers c ON i.customer_id = c.customer_id
GROUP BY c.unit_name, c.customer_id, c.party_name""", "invoices", "customers"))
def burst_keys(t: Tables) -> DataFrame:
    """A report with its burst key and delivery columns; the sink
    (:func:`tallyspark.sources.sinks.burst`) writes one folder per key."""
    per = S.invoices(t).groupBy("customer_id").agg(F.sum("amount").cast(TOTAL).alias("billed"))
    c = S.customers(t).select("customer_id", "party_name", "unit_name")
    return per.join(c, "customer_id").select(
        F.col("unit_name").alias("burst_key"), F.lit("csv").alias("output_format"),
        F.concat(F.lit("statement_"), F.lower("unit_name"), F.lit(".csv")).alias("file_name"),
        "customer_id", "party_name", "billed")


@register("s10_optional_source", S.with_sql("""
SELECT person_id, CAST(0 AS DECIMAL(18,2)) AS custom_coverage FROM service_periods""", "service_periods"))
def optional_source(t: Tables) -> DataFrame:
    """The report still runs when a customer-specific table is absent;
    its column falls back to 0."""
    sp = S.service_periods(t).select("person_id")
    if t.exists("benefit_coverage"):
        cov = t.table("benefit_coverage").groupBy("person_id").agg(F.sum("amount").alias("custom_coverage"))
        return sp.join(cov, "person_id", "left").select(
            "person_id", F.coalesce("custom_coverage", F.lit(0)).cast(MONEY).alias("custom_coverage"))
    return sp.withColumn("custom_coverage", F.lit(0).cast(MONEY))


# Generic attribute columns and their business names.
ATTRIBUTE_MAP = {"segment": "market_segment", "acctbal": "account_balance", "unit_name": "business_unit"}


@register("s11_attribute_map", S.with_sql("""
SELECT customer_id, segment AS market_segment, acctbal AS account_balance, unit_name AS business_unit
FROM customers""", "customers"))
def attribute_map(t: Tables) -> DataFrame:
    """Rename generic attribute columns to business names from metadata."""
    c = S.customers(t).select("customer_id", *ATTRIBUTE_MAP)
    return c.withColumnsRenamed(ATTRIBUTE_MAP)


# ---------------------------------------------------------------------------
# Filters (F)
# ---------------------------------------------------------------------------

@register("f1_f5_parameter_filters", S.with_sql(f"""
SELECT org_id, class, COUNT(*) AS trx_count, CAST(SUM(amount) AS DECIMAL(38,2)) AS amount
FROM invoices
WHERE org_id IN (1, 2, 3) AND trx_date >= {D(PERIOD_FROM)} AND trx_date < {D(PERIOD_TO + _dt.timedelta(days=1))}
GROUP BY org_id, class""", "invoices"))
def parameter_filters(t: Tables) -> DataFrame:
    """F1 + F5: multi-select list (class = All adds no predicate) and an
    optional date range written as a half-open range on the raw column."""
    inv = S.invoices(t)
    inv = P.filter_in(inv, "org_id", [1, 2, 3])
    inv = P.filter_in(inv, "class", "All")
    inv = inv.filter(P.date_range("trx_date", t.params.date_from, t.params.date_to))
    return inv.groupBy("org_id", "class").agg(F.count(F.lit(1)).alias("trx_count"),
                                              F.sum("amount").cast(TOTAL).alias("amount"))


@register("f2_f4_optional_filter_modes", S.with_sql("""
SELECT 'F2' AS mode, COUNT(*) AS row_count FROM customers WHERE upper(segment) = upper('building')
UNION ALL SELECT 'F3', COUNT(*) FROM invoices
UNION ALL SELECT 'F4', COUNT(*) FROM invoices WHERE term_name IS NOT NULL""", "customers", "invoices"))
def optional_filter_modes(t: Tables) -> DataFrame:
    """case-insensitive All filter; NULL-bypass (keeps NULL
    columns) vs NVL form (drops them) with the parameter left empty."""
    c = P.filter_ci(S.customers(t), "segment", "building")
    inv = S.invoices(t)
    f3 = P.filter_optional(inv, "term_name", None)
    f4 = P.filter_nvl(inv, "term_name", None)
    cnt = lambda df, m: df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(m).alias("mode"), "row_count")
    return cnt(c, "F2").unionByName(cnt(f3, "F3")).unionByName(cnt(f4, "F4"))


@register("f7_f8_validity_status", S.with_sql("""
SELECT app_type, line_status, COUNT(*) AS row_count, CAST(SUM(amount) AS DECIMAL(38,2)) AS amount
FROM applications WHERE status = 'APP' AND app_type IN ('CASH', 'CM') AND line_status NOT IN ('O')
GROUP BY app_type, line_status""", "applications"))
def validity_status(t: Tables) -> DataFrame:
    """Validity rule (applied) and status include/exclude lists."""
    a = S.applications(t).filter((F.col("status") == "APP") & F.col("app_type").isin("CASH", "CM")
                                 & ~F.col("line_status").isin("O"))
    return a.groupBy("app_type", "line_status").agg(F.count(F.lit(1)).alias("row_count"),
                                                    F.sum("amount").cast(TOTAL).alias("amount"))


@register("f9_pattern_filter", """
SELECT p_brand, COUNT(*) AS part_count FROM part
WHERE upper(p_type) LIKE '%PROMO%' OR upper(p_type) LIKE '%ECONOMY%' GROUP BY p_brand""")
def pattern_filter(t: Tables) -> DataFrame:
    """upper-case pattern filters (contains PROMO or ECONOMY)."""
    p = t.part.filter(F.upper("p_type").like("%PROMO%") | F.upper("p_type").like("%ECONOMY%"))
    return p.groupBy("p_brand").agg(F.count(F.lit(1)).alias("part_count"))


@register("f11_placeholder_time", S.with_sql("""
SELECT work_date, COUNT(*) AS punches FROM time_records
WHERE NOT (hour(start_time) = 0 AND minute(start_time) = 0 AND second(start_time) = 0)
GROUP BY work_date""", "time_records"))
def placeholder_time(t: Tables) -> DataFrame:
    """drop placeholder 00:00:00 entries."""
    tr = S.time_records(t)
    zero = (F.hour("start_time") == 0) & (F.minute("start_time") == 0) & (F.second("start_time") == 0)
    return tr.filter(~zero).groupBy("work_date").agg(F.count(F.lit(1)).alias("punches"))


_OV_FROM, _OV_TO = _dt.date(2024, 1, 10), _dt.date(2024, 1, 12)
_EXP_AS_OF = _dt.date(2024, 1, 20)


@register("f12_f13_interval_windows", S.with_sql(f"""
SELECT 'OVERLAP' AS test, absence_id, person_id, start_date, end_date FROM leaves
WHERE start_date <= {D(_OV_TO)} AND end_date >= {D(_OV_FROM)}
UNION ALL
SELECT 'EXPIRY', absence_id, person_id, start_date, end_date FROM leaves
WHERE end_date BETWEEN {D(_EXP_AS_OF)} AND {D(_EXP_AS_OF + _dt.timedelta(days=7))}""", "leaves"))
def interval_windows(t: Tables) -> DataFrame:
    """interval overlaps the window (true overlap, §8 #19); F13: ends
    within today..today+N."""
    lv = S.leaves(t).select("absence_id", "person_id", "start_date", "end_date")
    ov = lv.filter(E.overlaps("start_date", "end_date", _OV_FROM, _OV_TO)).withColumn("test", F.lit("OVERLAP"))
    ex = lv.filter(F.col("end_date").between(F.lit(_EXP_AS_OF), F.date_add(F.lit(_EXP_AS_OF), 7))) \
           .withColumn("test", F.lit("EXPIRY"))
    return ov.unionByName(ex)


def _account_class_sql(c: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} BETWEEN {lo} AND {hi} THEN '{n}'" for n, lo, hi in K.ACCOUNT_CLASSES) + " ELSE 'Other' END"


def account_class(c) -> F.Column:
    """natural-account range classification."""
    expr = None
    for n, lo, hi in K.ACCOUNT_CLASSES:
        cond = F.col(c).between(lo, hi)
        expr = F.when(cond, n) if expr is None else expr.when(cond, n)
    return expr.otherwise("Other")


@register("f15_account_class", S.with_sql(f"""
SELECT {_account_class_sql('account')} AS account_class,
       CAST(SUM(COALESCE(accounted_dr, 0)) AS DECIMAL(38,2)) AS total_dr,
       CAST(SUM(COALESCE(accounted_cr, 0)) AS DECIMAL(38,2)) AS total_cr
FROM journal_lines GROUP BY 1""", "journal_lines"))
def account_classes(t: Tables) -> DataFrame:
    """totals per natural-account class."""
    jl = S.journal_lines(t)
    return jl.groupBy(account_class("account").alias("account_class")).agg(
        F.sum(F.coalesce("accounted_dr", F.lit(0))).cast(TOTAL).alias("total_dr"),
        F.sum(F.coalesce("accounted_cr", F.lit(0))).cast(TOTAL).alias("total_cr"))


@register("f10_near_zero_suppression", S.with_sql(f"""
SELECT customer_id, CAST(SUM(remaining) AS DECIMAL(38,2)) AS balance
FROM (SELECT b.customer_id, ROUND(b.amount * COALESCE(b.exchange_rate, 1), 2)
             - ROUND(CAST(COALESCE(a.applied_amt, 0) AS DECIMAL(18,2)) * COALESCE(b.exchange_rate, 1), 2) AS remaining
      FROM invoices b LEFT JOIN (SELECT applied_trx_id, SUM(amount) AS applied_amt FROM applications
                                 WHERE apply_date <= {D(AS_OF)} AND app_type IN ('CASH', 'CM') AND status = 'APP'
                                 GROUP BY applied_trx_id) a ON b.trx_id = a.applied_trx_id
      WHERE b.trx_date <= {D(AS_OF)} AND b.amount <> 0) x
GROUP BY customer_id HAVING NOT (SUM(remaining) BETWEEN 0 AND 0.5)""", "invoices", "applications"))
def near_zero(t: Tables) -> DataFrame:
    """balances within 0..0.5 are suppressed."""
    from tallyspark.plans.receivables import open_balances
    per = open_balances(t).groupBy("customer_id").agg(F.sum("remaining").cast(TOTAL).alias("balance"))
    return per.filter(~F.col("balance").between(0, 0.5))


# ---------------------------------------------------------------------------
# Joins (J)
# ---------------------------------------------------------------------------

@register("j1_inner_chain", """
SELECT r.r_name AS region, year(l.l_shipdate) AS ship_year,
       CAST(SUM(ROUND(CAST(l.l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l.l_discount AS DECIMAL(4,2))), 2)) AS DECIMAL(38,2)) AS revenue
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
GROUP BY r.r_name, year(l.l_shipdate)""")
def inner_chain(t: Tables) -> DataFrame:
    """Inner equi-join over five tables; nation and region (fixed size)
    broadcast, the fact joins shuffle on their keys."""
    li, o, c = t.lineitem, t.orders, t.customer
    n, r = F.broadcast(t.nation), F.broadcast(t.region)
    rev = F.round(X.money("l_extendedprice") * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)")), 2)
    j = (li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
           .join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey))
    return j.groupBy(F.col("r_name").alias("region"), F.year("l_shipdate").cast("bigint").alias("ship_year")).agg(
        F.sum(rev).cast(TOTAL).alias("revenue"))


@register("j2_left_join_filtered", S.with_sql("""
SELECT i.trx_id, COUNT(a.applied_trx_id) AS cash_lines, CAST(COALESCE(SUM(a.amount), 0) AS DECIMAL(38,2)) AS cash_amount
FROM invoices i LEFT JOIN applications a ON a.applied_trx_id = i.trx_id AND a.app_type = 'CASH'
GROUP BY i.trx_id""", "invoices", "applications"))
def left_join_filtered(t: Tables) -> DataFrame:
    """Left join keeping the optional side's predicate before the join."""
    a = S.applications(t).groupBy(F.col("applied_trx_id").alias("trx_id"), "app_type") \
        .agg(F.count(F.lit(1)).alias("cash_lines"), F.sum("amount").alias("cash_amount"))
    out = J.left_with_filter(S.invoices(t).select("trx_id"), a, ["trx_id"], F.col("app_type") == "CASH")
    return out.select("trx_id", F.coalesce("cash_lines", F.lit(0)).alias("cash_lines"),
                      F.coalesce("cash_amount", F.lit(0)).cast(TOTAL).alias("cash_amount"))


@register("j3_j4_semi_anti", S.with_sql(f"""
SELECT 'WITH_ACTIVITY' AS kind, customer_id FROM customers c
WHERE EXISTS (SELECT 1 FROM invoices i WHERE i.customer_id = c.customer_id AND i.trx_date BETWEEN {D(PERIOD_FROM)} AND {D(PERIOD_TO)})
UNION ALL
SELECT 'WITHOUT_ACTIVITY', customer_id FROM customers c
WHERE NOT EXISTS (SELECT 1 FROM invoices i WHERE i.customer_id = c.customer_id AND i.trx_date BETWEEN {D(PERIOD_FROM)} AND {D(PERIOD_TO)})""",
                                          "customers", "invoices"))
def semi_anti(t: Tables) -> DataFrame:
    """Customers with and without an invoice in the period."""
    inv = S.invoices(t).filter(F.col("trx_date").between(F.lit(t.params.date_from), F.lit(t.params.date_to)))
    c = S.customers(t).select("customer_id")
    return (J.semi(c, inv, ["customer_id"]).withColumn("kind", F.lit("WITH_ACTIVITY"))
            .unionByName(J.anti(c, inv, ["customer_id"]).withColumn("kind", F.lit("WITHOUT_ACTIVITY"))))


@register("j5_null_aware_not_in", S.with_sql("""
SELECT receipt_id, amount FROM receipts
WHERE receipt_id NOT IN (SELECT receipt_id FROM receipt_history WHERE status = 'REVERSED')""",
                                             "receipts", "receipt_history"))
def null_aware_not_in(t: Tables) -> DataFrame:
    """NOT IN with SQL null semantics (anti join + one-row null flag)."""
    rev = S.receipt_history(t).filter(F.col("status") == "REVERSED")
    return J.not_in(S.receipts(t).select("receipt_id", "amount"), "receipt_id", rev, "receipt_id")


@register("j6_disjunctive_semi", S.with_sql("""
SELECT receipt_id, amount FROM receipts r
WHERE r.amount > 300000 OR EXISTS (SELECT 1 FROM receipt_history h WHERE h.receipt_id = r.receipt_id)""",
                                            "receipts", "receipt_history"))
def disjunctive_semi(t: Tables) -> DataFrame:
    """Status test OR EXISTS -- left join on distinct keys + flag."""
    r = S.receipts(t).select("receipt_id", "amount")
    return J.semi_or(r, S.receipt_history(t), ["receipt_id"], F.col("amount") > 300000)


@register("j7_asof_dimension", S.with_sql(f"""
SELECT s.person_id, s.person_number, v.salary, v.grade_id
FROM service_periods s JOIN person_versions v ON v.person_id = s.person_id
 AND {D(AS_OF)} BETWEEN v.eff_start AND v.eff_end""", "service_periods", "person_versions"))
def asof_dimension(t: Tables) -> DataFrame:
    """Dimension version valid at one report date (filter, then equi-join)."""
    sp = S.service_periods(t).select("person_id", "person_number")
    return E.join_as_of(sp, S.person_versions(t), ["person_id"], t.params.as_of, how="inner")


@register("j8_effective_at_row_date", S.with_sql("""
SELECT i.trx_id, i.trx_date, v.salary, v.grade_id
FROM invoices i LEFT JOIN person_versions v ON v.person_id = i.customer_id
 AND i.trx_date BETWEEN v.eff_start AND v.eff_end""", "invoices", "person_versions"))
def effective_at_row_date(t: Tables) -> DataFrame:
    """Each fact row joined to the version valid at its own date."""
    inv = S.invoices(t).select("trx_id", "trx_date", F.col("customer_id").alias("person_id"))
    out = E.join_effective(inv, S.person_versions(t), ["person_id"], "trx_date", within=S.order_date_bounds(t))
    return out.select("trx_id", "trx_date", "salary", "grade_id")


@register("j9_capped_as_of", S.with_sql(f"""
SELECT s.person_id, LEAST(COALESCE(s.actual_termination_date, {D(AS_OF)}), {D(AS_OF)}) AS effective_date,
       v.salary
FROM service_periods s LEFT JOIN person_versions v ON v.person_id = s.person_id
 AND LEAST(COALESCE(s.actual_termination_date, {D(AS_OF)}), {D(AS_OF)}) BETWEEN v.eff_start AND v.eff_end""",
                                        "service_periods", "person_versions"))
def capped_as_of(t: Tables) -> DataFrame:
    """As-of date capped by termination, then the version at that date."""
    sp = S.service_periods(t).select("person_id", E.capped_as_of("actual_termination_date", t.params.as_of).alias("effective_date"))
    out = E.join_effective(sp, S.person_versions(t), ["person_id"], "effective_date",
                           within=(S.order_date_bounds(t)[0], F.lit(t.params.as_of)))
    return out.select("person_id", "effective_date", "salary")


@register("j11_interval_anti", S.with_sql("""
SELECT d.person_id, COUNT(*) AS days_not_on_leave
FROM schedule_days d
WHERE NOT EXISTS (SELECT 1 FROM leaves l WHERE l.person_id = d.person_id
                  AND d.work_date BETWEEN l.start_date AND l.end_date)
GROUP BY d.person_id""", "schedule_days", "leaves"))
def interval_anti(t: Tables) -> DataFrame:
    """Scheduled days not inside any leave interval of the same person."""
    days = S.schedule_days(t)
    left = E.anti_interval(days, S.leaves(t), "person_id", "work_date", "start_date", "end_date")
    return left.groupBy("person_id").agg(F.count(F.lit(1)).alias("days_not_on_leave"))


@register("j12_self_join", S.with_sql("""
SELECT l.je_header_id, l.je_line_num, l.account, f.account AS first_line_account
FROM journal_lines l JOIN journal_lines f ON f.je_header_id = l.je_header_id AND f.je_line_num = 1
WHERE l.je_line_num > 1""", "journal_lines"))
def self_join(t: Tables) -> DataFrame:
    """Aliased self join -- each later line to the first line of its journal."""
    jl = S.journal_lines(t, numbered=True).select("je_header_id", "je_line_num", "account")
    first = jl.filter(F.col("je_line_num") == 1).select("je_header_id", F.col("account").alias("first_line_account"))
    return jl.filter(F.col("je_line_num") > 1).join(first, "je_header_id")


@register("j15_party_fallback", S.with_sql("""
SELECT s.supplier_id, s.vendor_id, COALESCE(CASE WHEN s.vendor_id < 0 THEN c.party_name END, s.vendor_name) AS party_name,
       CASE WHEN s.vendor_id < 0 AND c.party_name IS NOT NULL THEN 'PARTY' ELSE 'SUPPLIER' END AS name_source
FROM suppliers s LEFT JOIN customers c ON c.customer_id = -s.vendor_id""", "suppliers", "customers"))
def party_fallback(t: Tables) -> DataFrame:
    """Negative vendor id -> the party record, else the supplier name."""
    s = S.suppliers(t)
    c = S.customers(t).select(F.col("customer_id").alias("party_id"), "party_name")
    j = s.join(c, -s.vendor_id == c.party_id, "left")
    name = F.coalesce(F.when(F.col("vendor_id") < 0, F.col("party_name")), F.col("vendor_name"))
    src = F.when((F.col("vendor_id") < 0) & F.col("party_name").isNotNull(), "PARTY").otherwise("SUPPLIER")
    return j.select("supplier_id", "vendor_id", name.alias("party_name"), src.alias("name_source"))


@register("j16_override_union", S.with_sql("SELECT * FROM person_schedules", "person_schedules"))
def override_union(t: Tables) -> DataFrame:
    """Level-2 schedule rows win; level-1 rows only where none exists."""
    return S.person_schedules(t)


# Code lookup (type, code, language -> meaning).
APP_TYPE_LOOKUP = [
    ("APP_TYPE", "CASH", "US", "Cash receipt"),
    ("APP_TYPE", "CM", "US", "Credit memo"),
    ("APP_TYPE", "ADJ", "US", "Adjustment"),
    ("APP_TYPE", "CASH", "AR", "Cash receipt (ar)"),
]


@register("j19_code_lookup", S.with_sql(f"""
SELECT COALESCE(l.meaning, a.app_type) AS meaning, COUNT(*) AS row_count
FROM applications a LEFT JOIN ({K.sql_values(APP_TYPE_LOOKUP, 'lookup_type string, code string, lang string, meaning string')}) l
  ON l.lookup_type = 'APP_TYPE' AND l.code = a.app_type AND l.lang = 'US'
GROUP BY COALESCE(l.meaning, a.app_type)""", "applications"))
def code_lookup(t: Tables) -> DataFrame:
    """Code -> meaning with type and language filtered before a
    broadcast left join (the lookup's size is fixed)."""
    lk = K.frame(t.spark, APP_TYPE_LOOKUP, "lookup_type string, code string, lang string, meaning string")
    lk = lk.filter((F.col("lookup_type") == "APP_TYPE") & (F.col("lang") == "US")).select(
        F.col("code").alias("app_type"), "meaning")
    a = J.lookup(S.applications(t).select("app_type"), lk, ["app_type"], fixed_size=True)
    return a.groupBy(F.coalesce("meaning", "app_type").alias("meaning")).agg(F.count(F.lit(1)).alias("row_count"))


# ---------------------------------------------------------------------------
# Aggregations (A)
# ---------------------------------------------------------------------------

@register("a1_grouped_stats", S.with_sql(f"""
SELECT app_type, COUNT(*) AS cnt, CAST(SUM(amount) AS DECIMAL(38,2)) AS total,
       {X.sql_div_round('SUM(CAST(amount * 100 AS BIGINT))', 'COUNT(amount) * 100')} AS avg,
       MIN(amount) AS min, MAX(amount) AS max
FROM applications GROUP BY app_type""", "applications"))
def grouped_stats(t: Tables) -> DataFrame:
    """A1: count, sum, exact average, min, max per group."""
    return A.summarize(S.applications(t), ["app_type"], "amount")


@register("a2_conditional_pivot", S.with_sql("""
SELECT strftime(apply_date, '%Y-%m') AS period,
       CAST(SUM(CASE WHEN app_type = 'CASH' THEN amount ELSE 0 END) AS DECIMAL(38,2)) AS cash,
       CAST(SUM(CASE WHEN app_type = 'CM' THEN amount ELSE 0 END) AS DECIMAL(38,2)) AS credit_memo,
       CAST(SUM(CASE WHEN app_type = 'ADJ' THEN amount ELSE 0 END) AS DECIMAL(38,2)) AS adjustment
FROM applications GROUP BY 1""", "applications"))
def conditional_pivot(t: Tables) -> DataFrame:
    """A2: conditional-sum pivot to fixed columns."""
    a = S.applications(t).withColumn("period", F.date_format("apply_date", "yyyy-MM"))
    return A.pivot_sum(a, ["period"], "app_type", "amount", ["CASH", "CM", "ADJ"],
                       {"CASH": "cash", "CM": "credit_memo", "ADJ": "adjustment"})


@register("a3_attribute_pivot", S.with_sql("""
SELECT person_id,
       MAX(CASE WHEN element = 'Basic' THEN result_value END) AS basic,
       MAX(CASE WHEN element = 'Housing' THEN result_value END) AS housing,
       MAX(CASE WHEN element = 'Transport' THEN result_value END) AS transport,
       MAX(CASE WHEN element = 'Deduction' THEN result_value END) AS deduction
FROM run_results GROUP BY person_id""", "run_results"))
def attr_pivot(t: Tables) -> DataFrame:
    """A3: attribute rows to columns with MAX(CASE ...) (text values)."""
    return A.attribute_pivot(S.run_results(t), ["person_id"], "element", "result_value",
                             ["Basic", "Housing", "Transport", "Deduction"],
                             {"Basic": "basic", "Housing": "housing", "Transport": "transport",
                              "Deduction": "deduction"})


@register("a4_having", """
SELECT o_custkey AS customer_id, COUNT(*) AS order_count FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12""")
def having_filter(t: Tables) -> DataFrame:
    """A4: filter on an aggregate."""
    g = t.orders.groupBy(F.col("o_custkey").alias("customer_id")).agg(F.count(F.lit(1)).alias("order_count"))
    return A.having(g, F.col("order_count") > 12)


@register("a6_ordered_listagg", """
SELECT o_custkey AS customer_id,
       string_agg(CAST(o_orderkey AS VARCHAR), ', ' ORDER BY o_orderdate, o_orderkey) AS order_list
FROM orders GROUP BY o_custkey""")
def ordered_listagg(t: Tables) -> DataFrame:
    """Ordered string aggregation (orders of a customer by date, key)."""
    o = t.orders.select(F.col("o_custkey").alias("customer_id"), "o_orderdate", "o_orderkey",
                        F.col("o_orderkey").cast("string").alias("k"))
    return A.ordered_list(o, ["customer_id"], "k", ["o_orderdate", "o_orderkey"], ", ", "order_list")


PIECE = 8


@register("a6_listagg_pieces", f"""
SELECT customer_id, CAST((pos - 1) // {PIECE} + 1 AS BIGINT) AS piece, MIN(pos) AS first_position, COUNT(*) AS "values",
       string_agg(CAST(o_orderkey AS VARCHAR), ', ' ORDER BY pos) AS order_list
FROM (SELECT o_custkey AS customer_id, o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS pos FROM orders) o
GROUP BY customer_id, (pos - 1) // {PIECE}""")
def listagg_pieces(t: Tables) -> DataFrame:
    """A6 for keys of any size: the same list in numbered pieces with offsets."""
    o = t.orders.select(F.col("o_custkey").alias("customer_id"), "o_orderdate", "o_orderkey", F.col("o_orderkey").cast("string").alias("k"))
    return A.list_pieces(o, ["customer_id"], "k", ["o_orderdate", "o_orderkey"], PIECE, ", ", "order_list")


@register("a7_distinct", S.with_sql("SELECT DISTINCT customer_id, org_id, class FROM invoices", "invoices"))
def distinct_rows(t: Tables) -> DataFrame:
    """DISTINCT rows."""
    return S.invoices(t).select("customer_id", "org_id", "class").distinct()


@register("a9_first_latest", """
SELECT o_custkey AS customer_id, MIN(CAST(o_orderdate AS DATE)) AS first_order_date,
       MAX(CAST(o_orderdate AS DATE)) AS last_order_date,
       arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order_key
FROM orders GROUP BY o_custkey""")
def first_latest(t: Tables) -> DataFrame:
    """first/latest date per key, and a column of the latest row (max_by)."""
    o = t.orders
    return o.groupBy(F.col("o_custkey").alias("customer_id")).agg(
        F.min(F.to_date("o_orderdate")).alias("first_order_date"),
        F.max(F.to_date("o_orderdate")).alias("last_order_date"),
        F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last_order_key"))


@register("a10_debit_credit_split", S.with_sql("""
SELECT account, CAST(CASE WHEN s > 0 THEN s ELSE 0 END AS DECIMAL(38,2)) AS debit,
       CAST(CASE WHEN s < 0 THEN -s ELSE 0 END AS DECIMAL(38,2)) AS credit
FROM (SELECT account, SUM(COALESCE(accounted_dr, 0) - COALESCE(accounted_cr, 0)) AS s
      FROM journal_lines GROUP BY account) x""", "journal_lines"))
def debit_credit_split(t: Tables) -> DataFrame:
    """A10: debit/credit split by the sign of the grouped sum."""
    jl = S.journal_lines(t)
    g = jl.groupBy("account").agg(F.sum(F.coalesce("accounted_dr", F.lit(0)) - F.coalesce("accounted_cr", F.lit(0))).alias("s"))
    dr, cr = A.debit_credit("s")
    return g.select("account", dr.cast(TOTAL).alias("debit"), cr.cast(TOTAL).alias("credit"))


@register("a11_proration", S.with_sql(f"""
SELECT a.applied_trx_id, a.line_number, a.part_id, a.supplier_id, a.quantity,
       CAST({X.sql_div_round('CAST(i.amount * 100 AS BIGINT) * CAST(a.amount * 100 AS BIGINT)', 't.total_cents * 100')} AS DECIMAL(18,2)) AS prorated_amount
FROM applications a JOIN invoices i ON a.applied_trx_id = i.trx_id
JOIN (SELECT applied_trx_id, SUM(CAST(amount * 100 AS BIGINT)) AS total_cents FROM applications GROUP BY applied_trx_id) t
  ON t.applied_trx_id = a.applied_trx_id""", "applications", "invoices"))
def proration(t: Tables) -> DataFrame:
    """Invoice amount x line share of the invoice's lines (exact cents,
    zero-guarded)."""
    a = S.applications(t).select("applied_trx_id", "line_number", "part_id", "supplier_id", "quantity", "amount")
    a = W.partition_total(a.withColumn("c", X.cents("amount")), ["applied_trx_id"], "c", "total_cents")
    inv = S.invoices(t).select(F.col("trx_id").alias("applied_trx_id"), X.cents("amount").alias("inv_cents"))
    j = a.join(inv, "applied_trx_id")
    return j.select("applied_trx_id", "line_number", "part_id", "supplier_id", "quantity",
                    X.div_round(F.col("inv_cents") * F.col("c"), F.col("total_cents") * 100, 2)
                    .cast(MONEY).alias("prorated_amount"))


@register("a12_a13_asof_year_split", S.with_sql(f"""
SELECT applied_trx_id AS trx_id,
       CAST(SUM(CASE WHEN apply_date <= {D(AS_OF)} THEN amount ELSE 0 END) AS DECIMAL(38,2)) AS paid_at_date,
       CAST(SUM(CASE WHEN year(apply_date) < 2000 THEN amount ELSE 0 END) AS DECIMAL(38,2)) AS prior_years,
       CAST(SUM(CASE WHEN year(apply_date) = 2000 THEN amount ELSE 0 END) AS DECIMAL(38,2)) AS current_year
FROM applications WHERE app_type = 'CASH' GROUP BY applied_trx_id""", "applications"))
def asof_year_split(t: Tables) -> DataFrame:
    """A12 + A13: as-of conditional paid amount and an earlier-years /
    current-year split, in one pass."""
    a = S.applications(t).filter(F.col("app_type") == "CASH")
    return a.groupBy(F.col("applied_trx_id").alias("trx_id")).agg(
        A.as_of_sum("amount", "apply_date", t.params.as_of).alias("paid_at_date"),
        *A.year_split("apply_date", "amount", 2000))


@register("a16_text_max_vs_latest", S.with_sql("""
SELECT customer_id, MAX(trx_number) AS max_text_label,
       arg_max(trx_number, (trx_date, trx_id)) AS latest_label
FROM invoices GROUP BY customer_id""", "invoices"))
def text_max_vs_latest(t: Tables) -> DataFrame:
    """MAX over text (the reference's form) beside the true latest label."""
    inv = S.invoices(t)
    return inv.groupBy("customer_id").agg(
        A.max_text_label("trx_number").alias("max_text_label"),
        F.max_by("trx_number", F.struct("trx_date", "trx_id")).alias("latest_label"))


# ---------------------------------------------------------------------------
# Windows (W)
# ---------------------------------------------------------------------------

@register("w2_running_sum_range", S.with_sql("""
SELECT customer_id, trx_id, trx_date,
       CAST(SUM(amount) OVER (PARTITION BY customer_id ORDER BY trx_date) AS DECIMAL(38,2)) AS running_total
FROM invoices""", "invoices"))
def running_sum_range(t: Tables) -> DataFrame:
    """Running sum with the default RANGE frame (tied dates share the total)."""
    inv = S.invoices(t).select("customer_id", "trx_id", "trx_date", "amount")
    out = W.running_total_range(inv, ["customer_id"], "trx_date", "amount", "running_total")
    return out.select("customer_id", "trx_id", "trx_date", F.col("running_total").cast(TOTAL).alias("running_total"))


@register("w3_w4_partition_and_grand_total", S.with_sql("""
SELECT r.r_name AS region, x.revenue,
       CAST(SUM(x.revenue) OVER () AS DECIMAL(38,2)) AS grand_total
FROM (SELECT n_regionkey, CAST(SUM(amount) AS DECIMAL(38,2)) AS revenue
      FROM invoices i JOIN nation n ON i.org_id = n.n_nationkey GROUP BY n_regionkey) x
JOIN region r ON r.r_regionkey = x.n_regionkey""", "invoices"))
def partition_and_grand_total(t: Tables) -> DataFrame:
    """Group totals and the grand total beside each row (aggregate +
    one-row broadcast join, no single-partition window)."""
    inv = S.invoices(t).join(F.broadcast(t.nation.select(F.col("n_nationkey").alias("org_id"), "n_regionkey")), "org_id")
    g = inv.groupBy("n_regionkey").agg(F.sum("amount").cast(TOTAL).alias("revenue"))
    g = W.grand_total(g, "revenue", "grand_total", bounded=True)  # one row per region
    r = F.broadcast(t.region.select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("region")))
    return g.join(r, "n_regionkey").select("region", "revenue", F.col("grand_total").cast(TOTAL).alias("grand_total"))


@register("w5_line_number_count", S.with_sql("""
SELECT je_header_id, je_line_num, COUNT(*) OVER (PARTITION BY je_header_id) AS line_count
FROM journal_lines""", "journal_lines"))
def line_number_count(t: Tables) -> DataFrame:
    """Row number in the document and the document's line count (both
    from the journal builder's single two-level numbering pass)."""
    return S.journal_lines(t, numbered=True).select("je_header_id", "je_line_num", F.col("je_line_count").alias("line_count"))


@register("w6_keep_first", """
SELECT customer_id, o_orderkey, order_date FROM (
  SELECT o_custkey AS customer_id, o_orderkey, CAST(o_orderdate AS DATE) AS order_date,
         ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
  FROM orders) x WHERE rn = 1""")
def keep_first(t: Tables) -> DataFrame:
    """One row per key in preference order (latest order per customer)."""
    o = t.orders.select(F.col("o_custkey").alias("customer_id"), "o_orderkey",
                        F.to_date("o_orderdate").alias("order_date"), "o_orderdate")
    return W.keep_first(o, ["customer_id"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]).drop("o_orderdate")


@register("w7_keep_ties", """
SELECT customer_id, o_orderkey, order_date FROM (
  SELECT o_custkey AS customer_id, o_orderkey, CAST(o_orderdate AS DATE) AS order_date,
         RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) AS rk
  FROM orders) x WHERE rk = 1""")
def keep_ties(t: Tables) -> DataFrame:
    """Rows on the latest date per key with ties kept."""
    o = t.orders.select(F.col("o_custkey").alias("customer_id"), "o_orderkey",
                        F.to_date("o_orderdate").alias("order_date"))
    return W.keep_ties(o, ["customer_id"], "order_date")


@register("w9_rows_at_group_max", S.with_sql("""
SELECT applied_trx_id, line_number, amount FROM applications a
WHERE amount = (SELECT MAX(amount) FROM applications b WHERE b.applied_trx_id = a.applied_trx_id)""", "applications"))
def rows_at_group_max(t: Tables) -> DataFrame:
    """Rows equal to the group maximum."""
    a = S.applications(t).select("applied_trx_id", "line_number", "amount")
    return W.rows_at_max(a, ["applied_trx_id"], "amount")


@register("w10_serial_number", S.with_sql("""
SELECT ROW_NUMBER() OVER (ORDER BY trx_date, trx_id) AS serial_no, trx_id, trx_date
FROM invoices""", "invoices"))
def serial_numbers(t: Tables) -> DataFrame:
    """Report serial number over the whole (sorted) result, computed
    with per-partition offsets instead of a single-task window."""
    inv = S.invoices(t).select("trx_id", "trx_date")
    return W.serial_number(inv, ["trx_date", "trx_id"])


@register("w10_serial_by_amount", S.with_sql("""
SELECT ROW_NUMBER() OVER (ORDER BY amount DESC, trx_id) AS serial_no, trx_id, amount
FROM invoices""", "invoices"))
def serial_by_amount(t: Tables) -> DataFrame:
    """W10 where almost every row has a leading value of its own: the values'
    offsets are taken within buckets of their magnitude."""
    inv = S.invoices(t).select("trx_id", "amount", (-F.col("amount")).alias("falling"))
    return W.serial_number(inv, ["falling", "trx_id"], bucket=W.magnitude_bucket("falling")).drop("falling")


@register("w11_net_per_document", S.with_sql("""
SELECT applied_trx_id, line_number, app_type, amount,
       CAST(SUM(CASE WHEN app_type = 'CASH' THEN amount ELSE -amount END) OVER (PARTITION BY applied_trx_id) AS DECIMAL(38,2)) AS document_net
FROM applications""", "applications"))
def net_per_document(t: Tables) -> DataFrame:
    """Net per parent document across mixed movement types."""
    a = S.applications(t).select("applied_trx_id", "line_number", "app_type", "amount")
    signed = F.when(F.col("app_type") == "CASH", F.col("amount")).otherwise(-F.col("amount"))
    out = W.partition_total(a, ["applied_trx_id"], signed, "document_net")
    return out.withColumn("document_net", F.col("document_net").cast(TOTAL))


# ---------------------------------------------------------------------------
# Latest-version selection (V)
# ---------------------------------------------------------------------------

@register("v1_latest_at_or_before", S.with_sql(f"""
SELECT person_id, eff_start, salary FROM (
  SELECT person_id, eff_start, salary, ROW_NUMBER() OVER (PARTITION BY person_id ORDER BY eff_start DESC) AS rn
  FROM person_versions WHERE eff_start <= {D(AS_OF)}) x WHERE rn = 1""", "person_versions"))
def latest_at_or_before(t: Tables) -> DataFrame:
    """V1/V2: latest row at or before the date (grouped max_by, no correlated MAX)."""
    pv = S.person_versions(t).select("person_id", "eff_start", "salary")
    return E.latest_at_or_before(pv, ["person_id"], "eff_start", t.params.as_of)


@register("v3_latest_version", S.with_sql("""
SELECT resource_id, work_date, record_id, version, start_time FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY resource_id, work_date ORDER BY version DESC) AS rn FROM time_records) x
WHERE rn = 1""", "time_records"))
def latest_version(t: Tables) -> DataFrame:
    """V3: latest version per record group (person, day)."""
    tr = S.time_records(t).select("resource_id", "work_date", "record_id", "version", "start_time")
    return E.latest(tr, ["resource_id", "work_date"], ["version"])


@register("v4_two_maxima", S.with_sql("""
SELECT t.resource_id, t.work_date, t.record_id FROM time_records t
JOIN (SELECT resource_id, work_date, MAX(version) AS version, MAX(measure) AS measure
      FROM time_records GROUP BY resource_id, work_date) m
  ON t.resource_id = m.resource_id AND t.work_date = m.work_date AND t.version = m.version AND t.measure = m.measure""",
                                     "time_records"))
def two_maxima(t: Tables) -> DataFrame:
    """V4: rows holding both independent maxima (may match nothing by design)."""
    tr = S.time_records(t).select("resource_id", "work_date", "record_id", "version", "measure")
    return E.latest_pair(tr, ["resource_id", "work_date"], "version", "measure").select(
        "resource_id", "work_date", "record_id")


@register("v6_current_rows", S.with_sql(f"""
SELECT person_id, eff_start, salary FROM person_versions WHERE eff_end = {D(END_OF_TIME)}""", "person_versions"))
def current_rows(t: Tables) -> DataFrame:
    """V6: current-row marker (open end date)."""
    pv = S.person_versions(t)
    return pv.filter(F.col("eff_end") == F.lit(END_OF_TIME)).select("person_id", "eff_start", "salary")


@register("v7_latest_day_whole", S.with_sql("""
SELECT t.resource_id, t.record_id, t.start_time FROM time_records t
WHERE t.work_date = (SELECT MAX(work_date) FROM time_records u WHERE u.resource_id = t.resource_id)""", "time_records"))
def latest_day_whole(t: Tables) -> DataFrame:
    """V7: all rows of the latest update day per key."""
    tr = S.time_records(t).select("resource_id", "record_id", "start_time")
    return E.latest_day_whole(tr, ["resource_id"], "start_time")


@register("v8_any_one_row", S.with_sql("""
SELECT applied_trx_id, line_number, part_id, amount FROM (
  SELECT applied_trx_id, line_number, part_id, amount,
         ROW_NUMBER() OVER (PARTITION BY applied_trx_id ORDER BY line_number, part_id, supplier_id, amount) AS rn
  FROM applications) x WHERE rn = 1""", "applications"))
def any_one_row(t: Tables) -> DataFrame:
    """V8: ROWNUM = 1 made deterministic with an explicit order (min_by)."""
    a = S.applications(t).select("applied_trx_id", "line_number", "part_id", "supplier_id", "amount")
    return E.earliest(a, ["applied_trx_id"], ["line_number", "part_id", "supplier_id", "amount"]).drop("supplier_id")


# ---------------------------------------------------------------------------
# Sorts (O) and scalars (X)
# ---------------------------------------------------------------------------

@register("o3_numeric_text_sort", S.with_sql("""
SELECT run_result_id, result_value,
       COALESCE(TRY_CAST(TRY_CAST(result_value AS DECIMAL(18,2)) * 100 AS BIGINT), 9999999999) AS sort_key
FROM run_results""", "run_results"))
def numeric_text_sort(t: Tables) -> DataFrame:
    """O3: numeric sort key of a text number, bad text last."""
    rr = S.run_results(t)
    key = F.coalesce((F.col("result_value").try_cast("decimal(18,2)") * 100).try_cast("bigint"), F.lit(9999999999))
    return rr.select("run_result_id", "result_value", key.alias("sort_key")).orderBy("sort_key", "run_result_id")


_BANDS = [("Junior", None, 1999), ("Mid", 2000, 4999), ("Senior", 5000, 7999), ("Principal", 8000, None)]


@register("x_scalar_functions", S.with_sql(f"""
SELECT s.person_id,
       COALESCE(CAST(s.actual_termination_date AS VARCHAR), 'ACTIVE') AS nvl_status,
       CASE WHEN s.actual_termination_date IS NOT NULL THEN 'LEFT' ELSE 'ACTIVE' END AS nvl2_status,
       NULLIF(s.department, 'BUILDING') AS nullif_dept,
       CASE s.department WHEN 'BUILDING' THEN 'B' WHEN 'MACHINERY' THEN 'M' ELSE 'O' END AS decode_dept,
       CAST(sign(c.acctbal) AS INTEGER) AS sign_bal, abs(c.acctbal) AS abs_bal,
       CAST(ROUND(c.acctbal, 0) AS DECIMAL(18,0)) AS round_bal,
       CAST(date_trunc('month', s.date_start) AS DATE) AS month_start, last_day(s.date_start) AS month_end,
       CAST(s.date_start + INTERVAL 3 MONTH AS DATE) AS plus_3_months,
       {D(AS_OF)} - s.date_start AS service_days,
       CAST(floor({X.months_between_sql(D(AS_OF), 's.date_start')}) AS BIGINT) AS service_months,
       strftime(s.date_start, '%d-%m-%Y') AS start_text,
       isodow(s.date_start) AS start_weekday,
       CASE WHEN s.actual_termination_date IS NULL THEN NULL ELSE GREATEST(s.date_start, s.actual_termination_date) END AS greatest_strict,
       s.person_number || '-' || COALESCE(CAST(s.actual_termination_date AS VARCHAR), '') AS concat_text,
       upper(s.full_name) AS upper_name, lpad(CAST(s.person_id AS VARCHAR), 8, '0') AS padded_id,
       substr(s.full_name, 1, 8) AS name_prefix, regexp_replace(s.full_name, '[#]', ' ', 'g') AS clean_name,
       TRY_CAST(substr(s.full_name, 10) AS BIGINT) AS name_number,
       {X.sql_band('CAST(c.acctbal AS DECIMAL(18,2))', _BANDS, 'None')} AS balance_band,
       {X.sql_percent('(s.person_id % 97)', '(s.person_id % 13)')} AS pct_value
FROM service_periods s JOIN customers c ON c.customer_id = s.person_id""", "service_periods", "customers"))
def scalar_functions(t: Tables) -> DataFrame:
    """Oracle-compatible scalars (NVL/NVL2/NULLIF/DECODE, sign/abs/
    round, date truncation and arithmetic, months between, formatting,
    weekday, strict GREATEST, || concatenation, text functions, safe number,
    bands, zero-guarded percent)."""
    s = S.service_periods(t)
    c = S.customers(t).select(F.col("customer_id").alias("person_id"), "acctbal")
    j = s.join(c, "person_id")
    term = F.col("actual_termination_date")
    return j.select(
        "person_id",
        X.nvl(term.cast("string"), "ACTIVE").alias("nvl_status"),
        X.nvl2(term, F.lit("LEFT"), F.lit("ACTIVE")).alias("nvl2_status"),
        X.nullif("department", "BUILDING").alias("nullif_dept"),
        X.decode("department", [("BUILDING", "B"), ("MACHINERY", "M")], "O").alias("decode_dept"),
        F.signum("acctbal").cast("int").alias("sign_bal"), F.abs("acctbal").alias("abs_bal"),
        F.round("acctbal", 0).cast("decimal(18,0)").alias("round_bal"),
        X.month_start("date_start").alias("month_start"), F.last_day("date_start").alias("month_end"),
        F.add_months("date_start", 3).alias("plus_3_months"),
        X.days_between(F.lit(t.params.as_of), "date_start").cast("bigint").alias("service_days"),
        F.floor(F.months_between(F.lit(t.params.as_of), F.col("date_start"), False)).cast("bigint").alias("service_months"),
        F.date_format("date_start", "dd-MM-yyyy").alias("start_text"),
        X.iso_weekday("date_start").cast("bigint").alias("start_weekday"),
        X.greatest_strict("date_start", "actual_termination_date").alias("greatest_strict"),
        X.concat_oracle("person_number", F.lit("-"), term).alias("concat_text"),
        F.upper("full_name").alias("upper_name"), F.lpad(F.col("person_id").cast("string"), 8, "0").alias("padded_id"),
        F.substring("full_name", 1, 8).alias("name_prefix"),
        F.regexp_replace("full_name", "[#]", " ").alias("clean_name"),
        F.substring("full_name", 10, 1000).try_cast("bigint").alias("name_number"),
        X.band("acctbal", _BANDS, "None").alias("balance_band"),
        X.percent(F.col("person_id") % 97, F.col("person_id") % 13).alias("pct_value"),
    )


@register("v5_three_level_versions", S.with_sql("""
SELECT resource_id, week_start, record_id, version, start_time FROM (
  SELECT t.resource_id, CAST(date_trunc('week', t.work_date) AS DATE) AS week_start, t.record_id, t.version, t.start_time,
         ROW_NUMBER() OVER (PARTITION BY t.resource_id, date_trunc('week', t.work_date) ORDER BY t.start_time DESC, t.record_id DESC) AS rn
  FROM time_records t
  JOIN (SELECT resource_id, work_date, MAX(version) AS version, MAX(record_id) AS record_id
        FROM time_records WHERE measure > 0 GROUP BY resource_id, work_date) m
    ON m.resource_id = t.resource_id AND m.work_date = t.work_date AND m.version = t.version AND m.record_id = t.record_id
  WHERE t.measure > 0) x WHERE rn = 1""", "time_records"))
def three_level_versions(t: Tables) -> DataFrame:
    """V5: three-level version control -- row filter (measure > 0), then the
    tuple of two maxima per person and day (V4), then the latest creation
    per person and week (V1)."""
    tr = S.time_records(t).filter(F.col("measure") > 0).select("resource_id", "work_date", "record_id", "version", "start_time")
    lvl2 = E.latest_pair(tr, ["resource_id", "work_date"], "version", "record_id")
    lvl2 = lvl2.withColumn("week_start", F.trunc("work_date", "week"))
    return E.latest(lvl2.select("resource_id", "week_start", "start_time", "record_id", "version"),
                    ["resource_id", "week_start"], ["start_time", "record_id"])


# Shift start (milliseconds of day) and duration per schedule.
SHIFTS = [("STD", 32400000, 28800000), ("SHIFT", 79200000, 32400000)]


@register("x8_shift_times", S.with_sql(f"""
SELECT d.person_id, d.work_date, s.schedule_id, CAST(s.start_ms // 3600000 AS BIGINT) AS start_hour,
       CAST((s.start_ms % 3600000) // 60000 AS BIGINT) AS start_minute,
       CAST(d.work_date AS TIMESTAMP) + to_milliseconds(s.start_ms) AS shift_start,
       CAST(d.work_date AS TIMESTAMP) + to_milliseconds(s.start_ms + s.duration_ms) AS shift_end
FROM schedule_days d JOIN ({K.sql_values(SHIFTS, 'schedule_id string, start_ms bigint, duration_ms bigint')}) s
  ON s.schedule_id = d.schedule_id""", "schedule_days"))
def shift_times(t: Tables) -> DataFrame:
    """Milliseconds of day to hours/minutes and shift timestamps; a
    shift past midnight rolls into the next day."""
    sh = K.frame(t.spark, SHIFTS, "schedule_id string, start_ms bigint, duration_ms bigint")
    d = S.schedule_days(t).join(sh, "schedule_id")
    return d.select("person_id", "work_date", "schedule_id",
                    X.ms_to_hours("start_ms").alias("start_hour"), X.ms_to_minutes("start_ms").alias("start_minute"),
                    X.shift_timestamp("work_date", "start_ms").alias("shift_start"),
                    X.shift_timestamp("work_date", F.col("start_ms") + F.col("duration_ms")).alias("shift_end"))
