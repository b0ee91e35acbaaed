"""Business tables derived from the source tables (see FIXTURES.md, part 2).

Each stand-in is written twice, side by side: a Spark builder
``name(t: Tables) -> DataFrame`` and a DuckDB common-table expression in
``CTE[name] = (dependencies, sql)``.  Reports and oracle queries are both
composed from these, so a mismatch can only come from the report logic.

Join notes for scale: every builder joins on equality keys only.  The only
broadcast relations are the fixed-size ``nation``/``region`` tables and the
constant tables of :mod:`tallyspark.sources.constants`; customer, supplier
and part grow with the data and are left to the optimiser (AQE turns a join
into a broadcast at runtime when the measured side is small).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.params import END_OF_TIME, EVENTS_FROM, EVENTS_TO, literal
from tallyspark.functions.scalars import MONEY, RATE, cents, div_round, money, round_money, sql_div_round
from tallyspark.sources import constants as K
from tallyspark.sources.tables import Tables

CTE: dict[str, tuple[tuple[str, ...], str]] = {}


def _cte(name: str, deps: tuple[str, ...], sql: str) -> None:
    CTE[name] = (deps, sql)


def with_sql(body: str, *names: str) -> str:
    """Prefix ``body`` with the CTEs it needs (dependencies first)."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTE[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({CTE[n][1]})" for n in order) + "\n" + body


_d = literal


# ---------------------------------------------------------------------------
# Constants as CTEs
# ---------------------------------------------------------------------------
_cte("payment_terms", (), K.sql_values(K.PAYMENT_TERMS, K.PAYMENT_TERMS_SCHEMA))
_cte("holidays", (), K.sql_values(K.HOLIDAYS, K.HOLIDAYS_SCHEMA))
_cte("schedule_weekdays", (), K.sql_values(K.SCHEDULE_DAYS, K.SCHEDULE_DAYS_SCHEMA))
_cte("pay_elements", (), K.sql_values(K.PAY_ELEMENTS, K.PAY_ELEMENTS_SCHEMA))
_cte("accrual_types", (), K.sql_values(K.ACCRUAL_TYPES, K.ACCRUAL_TYPES_SCHEMA))
_cte("rate_card", (), K.sql_values(K.rate_card_rows(), K.RATE_CARD_SCHEMA))


# ---------------------------------------------------------------------------
# Parties
# ---------------------------------------------------------------------------

def customers(t: Tables) -> DataFrame:
    """Customer account = party; org = nation; ledger = region."""
    c = t.customer
    n = F.broadcast(t.nation.select("n_nationkey", "n_name", "n_regionkey"))
    return c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("c_custkey").alias("customer_id"),
        F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("account_number"),
        F.col("c_name").alias("party_name"),
        F.col("c_nationkey").alias("org_id"),
        F.col("n_name").alias("unit_name"),
        F.col("n_regionkey").alias("ledger_id"),
        money("c_acctbal").alias("acctbal"),
        F.col("c_mktsegment").alias("segment"),
        F.lit("A").alias("status"),
    )


_cte("customers", (), """
SELECT c_custkey AS customer_id, 'C' || CAST(c_custkey AS VARCHAR) AS account_number,
       c_name AS party_name, c_nationkey AS org_id, n_name AS unit_name,
       n_regionkey AS ledger_id, CAST(c_acctbal AS DECIMAL(18,2)) AS acctbal,
       c_mktsegment AS segment, 'A' AS status
FROM customer JOIN nation ON c_nationkey = n_nationkey""")


# ---------------------------------------------------------------------------
# Receivables: invoices, applications, receipts
# ---------------------------------------------------------------------------

def nation_rate() -> Column:
    """Exchange rate of a nation: NULL in region 0 else ``1 + nation * 0.01``."""
    return (F.when(F.col("n_regionkey") == 0, F.lit(None))
            .otherwise(F.lit(1) + F.col("n_nationkey") * F.lit(0.01).cast("decimal(3,2)")).cast(RATE))


def invoices(t: Tables) -> DataFrame:
    """One transaction (and payment schedule) per order.

    Credit memo (class CM, negative amount) when ``o_orderkey % 10 = 0``;
    incomplete when the order status is P; rate NULL in region 0 else
    ``1 + nation * 0.01``; due date from the payment terms lookup.
    """
    o = t.orders
    c = t.customer.select("c_custkey", "c_nationkey")
    n = F.broadcast(t.nation.select("n_nationkey", "n_regionkey"))
    terms = K.payment_terms(t.spark)
    is_cm = (F.col("o_orderkey") % 10) == 0
    trx_date = F.to_date("o_orderdate")
    base = (o.join(c, o.o_custkey == c.c_custkey)
             .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
             .withColumn("term_id", F.substring("o_orderpriority", 1, 1).cast("int"))
             .join(terms, "term_id", "left"))
    return base.select(
        F.col("o_orderkey").alias("trx_id"),
        F.concat(F.when(is_cm, F.lit("CM-")).otherwise(F.lit("INV-")),
                 F.col("o_orderkey").cast("string")).alias("trx_number"),
        F.col("o_custkey").alias("customer_id"),
        F.col("c_nationkey").alias("org_id"),
        F.col("n_regionkey").alias("ledger_id"),
        trx_date.alias("trx_date"),
        F.when(is_cm, F.lit("CM")).otherwise(F.lit("INV")).alias("class"),
        (money("o_totalprice") * F.when(is_cm, F.lit(-1)).otherwise(F.lit(1))).cast(MONEY).alias("amount"),
        F.when(F.col("o_orderstatus") == "P", F.lit("N")).otherwise(F.lit("Y")).alias("complete_flag"),
        nation_rate().alias("exchange_rate"),
        F.col("term_id"),
        F.col("term_name"),
        F.col("due_days"),
        F.date_add(trx_date, F.coalesce(F.col("due_days"), F.lit(0))).alias("due_date"),
        F.col("o_orderstatus").alias("order_status"),
        F.col("o_orderpriority").alias("priority"),
    )


_cte("invoices", ("payment_terms",), """
SELECT o_orderkey AS trx_id,
       CASE WHEN o_orderkey % 10 = 0 THEN 'CM-' ELSE 'INV-' END || CAST(o_orderkey AS VARCHAR) AS trx_number,
       o_custkey AS customer_id, c_nationkey AS org_id, n_regionkey AS ledger_id,
       CAST(o_orderdate AS DATE) AS trx_date,
       CASE WHEN o_orderkey % 10 = 0 THEN 'CM' ELSE 'INV' END AS class,
       CAST(CAST(o_totalprice AS DECIMAL(18,2)) * CASE WHEN o_orderkey % 10 = 0 THEN -1 ELSE 1 END AS DECIMAL(18,2)) AS amount,
       CASE WHEN o_orderstatus = 'P' THEN 'N' ELSE 'Y' END AS complete_flag,
       CAST(CASE WHEN n_regionkey = 0 THEN NULL ELSE 1 + n_nationkey * CAST(0.01 AS DECIMAL(3,2)) END AS DECIMAL(18,6)) AS exchange_rate,
       CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS term_id, pt.term_name, pt.due_days,
       CAST(o_orderdate AS DATE) + CAST(COALESCE(pt.due_days, 0) AS INTEGER) AS due_date,
       o_orderstatus AS order_status, o_orderpriority AS priority
FROM orders
JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN payment_terms pt ON pt.term_id = CAST(substr(o_orderpriority, 1, 1) AS INTEGER)""")


def application_amounts(gross: Column, disc: Column, tax: Column) -> tuple[Column, Column, Column]:
    """Amount, discount taken and amount with tax of a line."""
    amount = round_money(gross * (F.lit(1) - disc))
    return amount, round_money(gross * disc), round_money(amount * (F.lit(1) + tax))


def applications(t: Tables) -> DataFrame:
    """One application per line item: A = CASH, R = CM, N = ADJ."""
    li = t.lineitem
    tax = F.col("l_tax").cast("decimal(4,2)")
    amount, discount, with_tax = application_amounts(money("l_extendedprice"), F.col("l_discount").cast("decimal(4,2)"), tax)
    return li.select(
        F.col("l_orderkey").alias("applied_trx_id"),
        F.col("l_linenumber").alias("line_number"),
        F.col("l_partkey").alias("part_id"),
        F.col("l_suppkey").alias("supplier_id"),
        F.to_date("l_shipdate").alias("apply_date"),
        F.when(F.col("l_returnflag") == "A", "CASH").when(F.col("l_returnflag") == "R", "CM")
         .otherwise("ADJ").alias("app_type"),
        amount.alias("amount"),
        discount.alias("discount_taken"),
        with_tax.alias("acctd_amount"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
        money("l_extendedprice").alias("gross_amount"),
        tax.alias("tax_rate"),
        F.col("l_returnflag").alias("return_flag"),
        F.col("l_linestatus").alias("line_status"),
        F.lit("APP").alias("status"),
    )


_cte("applications", (), """
SELECT l_orderkey AS applied_trx_id, l_linenumber AS line_number, l_partkey AS part_id,
       l_suppkey AS supplier_id, CAST(l_shipdate AS DATE) AS apply_date,
       CASE l_returnflag WHEN 'A' THEN 'CASH' WHEN 'R' THEN 'CM' ELSE 'ADJ' END AS app_type,
       CAST(ROUND(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))), 2) AS DECIMAL(18,2)) AS amount,
       CAST(ROUND(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2)), 2) AS DECIMAL(18,2)) AS discount_taken,
       CAST(ROUND(CAST(ROUND(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))), 2) AS DECIMAL(18,2))
            * (1 + CAST(l_tax AS DECIMAL(4,2))), 2) AS DECIMAL(18,2)) AS acctd_amount,
       CAST(l_quantity AS BIGINT) AS quantity,
       CAST(l_extendedprice AS DECIMAL(18,2)) AS gross_amount, CAST(l_tax AS DECIMAL(4,2)) AS tax_rate,
       l_returnflag AS return_flag, l_linestatus AS line_status, 'APP' AS status
FROM lineitem""")


def receipts(t: Tables) -> DataFrame:
    """Cash applications summed per order form one receipt per order.

    Aggregated before the join to the invoice (partial aggregation on the
    map side, so a hot order key costs one row per task, not its lines).
    """
    cash = (applications(t).filter(F.col("app_type") == "CASH")
            .groupBy("applied_trx_id")
            .agg(F.min("apply_date").alias("receipt_date"),
                 F.sum("amount").cast(MONEY).alias("amount")))
    inv = invoices(t).select("trx_id", "customer_id", "org_id", "exchange_rate")
    return cash.join(inv, cash.applied_trx_id == inv.trx_id).select(
        F.col("applied_trx_id").alias("receipt_id"),
        F.concat(F.lit("RCPT-"), F.col("applied_trx_id").cast("string")).alias("receipt_number"),
        "receipt_date", "amount", "customer_id", "org_id", "exchange_rate",
        F.col("applied_trx_id").alias("applied_trx_id"),
        F.lit("APP").alias("status"),
    )


_cte("receipts", ("applications", "invoices"), """
SELECT c.applied_trx_id AS receipt_id, 'RCPT-' || CAST(c.applied_trx_id AS VARCHAR) AS receipt_number,
       c.receipt_date, c.amount, i.customer_id, i.org_id, i.exchange_rate,
       c.applied_trx_id AS applied_trx_id, 'APP' AS status
FROM (SELECT applied_trx_id, MIN(apply_date) AS receipt_date,
             CAST(SUM(amount) AS DECIMAL(18,2)) AS amount
      FROM applications WHERE app_type = 'CASH' GROUP BY applied_trx_id) c
JOIN invoices i ON c.applied_trx_id = i.trx_id""")


def receipt_history(t: Tables) -> DataFrame:
    """Receipts of orders with a returned and finished line are REVERSED."""
    li = t.lineitem
    return (li.filter((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"))
              .select(F.col("l_orderkey").alias("receipt_id")).distinct()
              .withColumn("status", F.lit("REVERSED"))
              .withColumn("current_record_flag", F.lit("Y")))


_cte("receipt_history", (), """
SELECT DISTINCT l_orderkey AS receipt_id, 'REVERSED' AS status, 'Y' AS current_record_flag
FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'""")


def unapplied_receipts(t: Tables) -> DataFrame:
    """Open (N, O) lines form an unapplied receipt amount per order (negative)."""
    un = (applications(t).filter((F.col("return_flag") == "N") & (F.col("line_status") == "O"))
          .groupBy("applied_trx_id")
          .agg(F.max("apply_date").alias("receipt_date"),
               (-F.sum("amount")).cast(MONEY).alias("amount")))
    inv = invoices(t).select("trx_id", "customer_id", "org_id")
    return un.join(inv, un.applied_trx_id == inv.trx_id).select(
        F.col("applied_trx_id").alias("receipt_id"),
        F.concat(F.lit("UNAPP-"), F.col("applied_trx_id").cast("string")).alias("receipt_number"),
        "receipt_date", "amount", "customer_id", "org_id")


_cte("unapplied_receipts", ("applications", "invoices"), """
SELECT u.applied_trx_id AS receipt_id, 'UNAPP-' || CAST(u.applied_trx_id AS VARCHAR) AS receipt_number,
       u.receipt_date, u.amount, i.customer_id, i.org_id
FROM (SELECT applied_trx_id, MAX(apply_date) AS receipt_date,
             CAST(-SUM(amount) AS DECIMAL(18,2)) AS amount
      FROM applications WHERE return_flag = 'N' AND line_status = 'O' GROUP BY applied_trx_id) u
JOIN invoices i ON u.applied_trx_id = i.trx_id""")


# ---------------------------------------------------------------------------
# Cash management: bank statement lines vs book transactions
# ---------------------------------------------------------------------------

def bank_statement_lines(t: Tables) -> DataFrame:
    """Statement line per invoice; bank account = org; control balance 0."""
    inv = invoices(t)
    return inv.select(
        F.col("trx_id").alias("statement_line_id"),
        F.col("org_id").alias("bank_account_id"),
        F.col("trx_date").alias("statement_date"),
        F.col("amount").alias("statement_amount"),
        F.col("trx_number").alias("reference"),
    )


_cte("bank_statement_lines", ("invoices",), """
SELECT trx_id AS statement_line_id, org_id AS bank_account_id, trx_date AS statement_date,
       amount AS statement_amount, trx_number AS reference
FROM invoices""")


def book_transactions(t: Tables) -> DataFrame:
    """Book side: equal when key % 3 = 0, +10.00 when 1, absent when 2."""
    inv = invoices(t).filter((F.col("trx_id") % 3) != 2)
    return inv.select(
        F.col("trx_id").alias("book_trx_id"),
        F.col("org_id").alias("bank_account_id"),
        F.col("trx_date").alias("book_date"),
        (F.col("amount") + F.when((F.col("trx_id") % 3) == 1, F.lit(10)).otherwise(F.lit(0)))
        .cast(MONEY).alias("book_amount"),
    )


_cte("book_transactions", ("invoices",), """
SELECT trx_id AS book_trx_id, org_id AS bank_account_id, trx_date AS book_date,
       CAST(amount + CASE WHEN trx_id % 3 = 1 THEN 10 ELSE 0 END AS DECIMAL(18,2)) AS book_amount
FROM invoices WHERE trx_id % 3 <> 2""")


# ---------------------------------------------------------------------------
# General ledger: journal lines and balances
# ---------------------------------------------------------------------------

def journal_lines(t: Tables, numbered: bool = False, before: _dt.date | None = None, only: Column | None = None) -> DataFrame:
    """One journal line per line item; header = order; ledger = the
    supplier's region.  Line number is an ordinal over all columns within
    the header, computed in (header, source line) chunks so that even a
    very large journal is numbered by many tasks (``numbered=True`` only:
    reports that do not show the line number do not pay for it).
    ``before`` keeps lines dated earlier, by a filter that reaches the scan.
    ``only`` (a condition on line items) keeps the lines where it holds, with
    their number among all lines.
    """
    li = t.lineitem if before is None else t.lineitem.filter(F.col("l_shipdate") < F.lit(before))
    s = t.supplier.select("s_suppkey", "s_nationkey")
    n = F.broadcast(t.nation.select("n_nationkey", "n_regionkey"))
    from tallyspark.operators.windows import line_number, line_number_of
    order_cols = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
                  "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    disc = F.col("l_discount").cast("decimal(4,2)")
    amount = round_money(money("l_extendedprice") * (F.lit(1) - disc))
    is_cr = F.col("l_returnflag") == "R"
    placed = lambda lines: lines.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    picked = None if only is None else F.coalesce(only, F.lit(False))
    base = placed(li if picked is None else li.filter(picked))
    numbering = []
    if numbered:
        # ordinal within the journal, numbered per (journal, source line) chunk;
        # only built when a report uses it (it costs a second pass and a join)
        how = {"out": "je_line_num", "chunk": "l_linenumber", "count_out": "je_line_count"}
        base = (line_number(base, ["l_orderkey"], order_cols, **how) if picked is None else
                line_number_of(li.withColumn("__picked", picked), placed, ["l_orderkey"], order_cols, "__picked", **how))
        numbering = [F.col("je_line_num").cast("bigint").alias("je_line_num"), F.col("je_line_count")]
    return base.select(
        F.col("l_orderkey").alias("je_header_id"),
        *numbering,
        F.col("n_regionkey").alias("ledger_id"),
        F.to_date("l_shipdate").alias("gl_date"),
        F.date_format("l_shipdate", "yyyy-MM").alias("period_name"),
        (F.year("l_shipdate") * 100 + F.month("l_shipdate")).alias("period_num"),
        (F.lit(1000) + (F.col("l_partkey") * 37) % 9000).alias("account"),
        F.when(is_cr, F.lit(None)).otherwise(amount).cast(MONEY).alias("accounted_dr"),
        F.when(is_cr, amount).otherwise(F.lit(None)).cast(MONEY).alias("accounted_cr"),
        F.when(F.col("l_linestatus") == "F", "P").otherwise("U").alias("status"),
        F.when(F.col("l_returnflag") == "A", "Receivables").when(is_cr, "Payables")
         .otherwise("Manual").alias("je_source"),
        F.col("l_suppkey").alias("supplier_id"),
        F.col("l_partkey").alias("part_id"),
    )


_cte("journal_lines", (), """
SELECT l_orderkey AS je_header_id,
       ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
                          l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS je_line_num,
       COUNT(*) OVER (PARTITION BY l_orderkey) AS je_line_count,
       n_regionkey AS ledger_id, CAST(l_shipdate AS DATE) AS gl_date,
       strftime(l_shipdate, '%Y-%m') AS period_name,
       year(l_shipdate) * 100 + month(l_shipdate) AS period_num,
       1000 + (l_partkey * 37) % 9000 AS account,
       CAST(CASE WHEN l_returnflag = 'R' THEN NULL ELSE
            ROUND(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))), 2) END AS DECIMAL(18,2)) AS accounted_dr,
       CAST(CASE WHEN l_returnflag = 'R' THEN
            ROUND(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))), 2) END AS DECIMAL(18,2)) AS accounted_cr,
       CASE WHEN l_linestatus = 'F' THEN 'P' ELSE 'U' END AS status,
       CASE WHEN l_returnflag = 'A' THEN 'Receivables' WHEN l_returnflag = 'R' THEN 'Payables' ELSE 'Manual' END AS je_source,
       l_suppkey AS supplier_id, l_partkey AS part_id
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""")


def gl_balances(t: Tables, last_period: int | None = None) -> DataFrame:
    """Net per ledger, account and month; begin = sum of earlier months.
    Up to ``last_period`` (yyyymm) only lines of earlier days are read: no
    balance needs later ones.

    The window runs over the aggregated balance table (one row per account
    and month), so its partitions are bounded by the number of periods.
    """
    before = None if last_period is None else _dt.date(last_period // 100 + last_period % 100 // 12, last_period % 100 % 12 + 1, 1)
    jl = journal_lines(t, before=before)
    agg = jl.groupBy("ledger_id", "account", "period_num", "period_name").agg(
        F.coalesce(F.sum("accounted_dr"), F.lit(0)).cast("decimal(38,2)").alias("period_net_dr"),
        F.coalesce(F.sum("accounted_cr"), F.lit(0)).cast("decimal(38,2)").alias("period_net_cr"))
    w = (Window.partitionBy("ledger_id", "account").orderBy("period_num")
         .rowsBetween(Window.unboundedPreceding, -1))
    return agg.withColumn(
        "begin_balance",
        F.coalesce(F.sum(F.col("period_net_dr") - F.col("period_net_cr")).over(w), F.lit(0)).cast("decimal(38,2)"))


_cte("gl_balances", ("journal_lines",), """
SELECT ledger_id, account, period_num, period_name, period_net_dr, period_net_cr,
       CAST(COALESCE(SUM(period_net_dr - period_net_cr) OVER (PARTITION BY ledger_id, account ORDER BY period_num
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DECIMAL(38,2)) AS begin_balance
FROM (SELECT ledger_id, account, period_num, period_name,
             CAST(COALESCE(SUM(accounted_dr), 0) AS DECIMAL(38,2)) AS period_net_dr,
             CAST(COALESCE(SUM(accounted_cr), 0) AS DECIMAL(38,2)) AS period_net_cr
      FROM journal_lines GROUP BY ledger_id, account, period_num, period_name) a""")


# ---------------------------------------------------------------------------
# People: dated person versions and service periods
# ---------------------------------------------------------------------------

def order_date_bounds(t: Tables) -> tuple:
    """First order date and the day after the last one, as scalars over the
    one column: bounds for :func:`effective.join_effective`."""
    day = F.to_date("o_orderdate")
    return t.orders.agg(F.min(day)).scalar(), F.date_add(t.orders.agg(F.max(day)).scalar(), 1)


def person_versions(t: Tables) -> DataFrame:
    """Date-effective salary rows: one version per customer and order date.

    ``eff_end`` = next start - 1, or the open end 4712-12-31.  The window is
    over the distinct dates of one person (bounded by the calendar).
    """
    daily = (t.orders.groupBy(F.col("o_custkey").alias("person_id"),
                              F.to_date("o_orderdate").alias("eff_start"))
             .agg(F.max(money("o_totalprice")).alias("salary"),
                  F.min(F.substring("o_orderpriority", 1, 1).cast("int")).alias("grade_id")))
    w = Window.partitionBy("person_id").orderBy("eff_start")
    return daily.withColumn(
        "eff_end",
        F.coalesce(F.date_sub(F.lead("eff_start").over(w), 1), F.lit(END_OF_TIME)))


_cte("person_versions", (), f"""
SELECT person_id, eff_start, salary, grade_id,
       COALESCE(CAST(LEAD(eff_start) OVER (PARTITION BY person_id ORDER BY eff_start) - 1 AS DATE), {_d(END_OF_TIME)}) AS eff_end
FROM (SELECT o_custkey AS person_id, CAST(o_orderdate AS DATE) AS eff_start,
             MAX(CAST(o_totalprice AS DECIMAL(18,2))) AS salary,
             MIN(CAST(substr(o_orderpriority, 1, 1) AS INTEGER)) AS grade_id
      FROM orders GROUP BY o_custkey, CAST(o_orderdate AS DATE)) d""")


def service_periods(t: Tables) -> DataFrame:
    """Hire = first order; termination = last order when the balance is negative."""
    first_last = t.orders.groupBy(F.col("o_custkey").alias("person_id")).agg(
        F.min(F.to_date("o_orderdate")).alias("date_start"),
        F.max(F.to_date("o_orderdate")).alias("last_date"))
    c = t.customer.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment", "c_nationkey")
    return first_last.join(c, first_last.person_id == c.c_custkey).select(
        "person_id",
        F.concat(F.lit("P"), F.col("person_id").cast("string")).alias("person_number"),
        F.col("c_name").alias("full_name"),
        F.col("c_mktsegment").alias("department"),
        F.col("c_nationkey").alias("country_id"),
        "date_start",
        F.when(F.col("c_acctbal") < 0, F.col("last_date")).alias("actual_termination_date"),
    )


_cte("service_periods", (), """
SELECT f.person_id, 'P' || CAST(f.person_id AS VARCHAR) AS person_number, c_name AS full_name,
       c_mktsegment AS department, c_nationkey AS country_id, f.date_start,
       CASE WHEN c_acctbal < 0 THEN f.last_date END AS actual_termination_date
FROM (SELECT o_custkey AS person_id, MIN(CAST(o_orderdate AS DATE)) AS date_start,
             MAX(CAST(o_orderdate AS DATE)) AS last_date FROM orders GROUP BY o_custkey) f
JOIN customer ON f.person_id = c_custkey""")


# ---------------------------------------------------------------------------
# Payroll, absence, time: from the events stream
# ---------------------------------------------------------------------------

def run_results(t: Tables) -> DataFrame:
    """Payroll run result per event; the value is text, as in the source."""
    e = t.events
    el = K.pay_elements(t.spark)
    return e.join(el, "event_type").select(
        F.col("event_id").alias("run_result_id"),
        F.col("user_id").alias("person_id"),
        F.col("element"),
        F.col("classification"),
        F.col("value").cast("decimal(18,2)").cast("string").alias("result_value"),
        F.to_date("ts").alias("effective_date"),
        F.lit("R").alias("action_type"),
        F.lit("C").alias("status"),
    )


_cte("run_results", ("pay_elements",), """
SELECT event_id AS run_result_id, user_id AS person_id, pe.element, pe.classification,
       CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS result_value,
       CAST(ts AS DATE) AS effective_date, 'R' AS action_type, 'C' AS status
FROM events JOIN pay_elements pe ON events.event_type = pe.event_type""")


def time_records(t: Tables) -> DataFrame:
    """Clock events (type click): one punch per event, version = event id."""
    e = t.events.filter(F.col("event_type") == "click")
    return e.select(
        F.col("event_id").alias("record_id"),
        F.col("user_id").alias("resource_id"),
        F.col("ts").alias("start_time"),
        F.to_date("ts").alias("work_date"),
        F.col("event_id").alias("version"),
        F.col("value").cast("decimal(18,2)").alias("measure"),
    )


_cte("time_records", (), """
SELECT event_id AS record_id, user_id AS resource_id, ts AS start_time, CAST(ts AS DATE) AS work_date,
       event_id AS version, CAST(value AS DECIMAL(18,2)) AS measure
FROM events WHERE event_type = 'click'""")


def people(t: Tables) -> DataFrame:
    """Distinct people of the events stream."""
    return t.events.select(F.col("user_id").alias("person_id")).distinct()


_cte("people", (), "SELECT DISTINCT user_id AS person_id FROM events")


def person_schedules(t: Tables) -> DataFrame:
    """J16 override union: a level-2 (person) schedule wins over the level-1
    (legal employer) default; level 2 exists when ``user_id % 5 = 0``."""
    p = people(t)
    level1 = p.select("person_id", F.lit("STD").alias("schedule_id"), F.lit(1).alias("level"))
    level2 = (p.filter((F.col("person_id") % 5) == 0)
               .select("person_id", F.lit("SHIFT").alias("schedule_id"), F.lit(2).alias("level")))
    return level2.unionByName(level1.join(level2.select("person_id"), "person_id", "left_anti"))


_cte("person_schedules", ("people",), """
SELECT person_id, 'SHIFT' AS schedule_id, 2 AS level FROM people WHERE person_id % 5 = 0
UNION ALL
SELECT person_id, 'STD' AS schedule_id, 1 AS level FROM people p
WHERE NOT EXISTS (SELECT 1 FROM people q WHERE q.person_id = p.person_id AND q.person_id % 5 = 0)""")


def schedule_days(t: Tables, date_from=None, date_to=None) -> DataFrame:
    """S5 + S6: working days of each person's schedule in the window.

    The day spine is generated per person with ``explode(sequence(...))``
    (bounded by the window length), then filtered by an equi-join to the
    fixed schedule/weekday table -- no cartesian product.
    """
    date_from = date_from or t.params.events_from
    date_to = date_to or t.params.events_to
    ps = person_schedules(t)
    days = ps.select("person_id", "schedule_id",
                     F.explode(F.sequence(F.lit(date_from), F.lit(date_to))).alias("work_date"))
    days = days.withColumn("weekday", F.weekday("work_date") + 1)
    return days.join(K.schedule_days(t.spark), ["schedule_id", "weekday"]).select(
        "person_id", "schedule_id", "work_date", "weekday")


_cte("schedule_days", ("person_schedules", "schedule_weekdays"), f"""
SELECT ps.person_id, ps.schedule_id, CAST(d.work_date AS DATE) AS work_date, CAST(isodow(d.work_date) AS INTEGER) AS weekday
FROM person_schedules ps
CROSS JOIN LATERAL (SELECT unnest(generate_series({_d(EVENTS_FROM)}::TIMESTAMP, {_d(EVENTS_TO)}::TIMESTAMP, INTERVAL 1 DAY)) AS work_date) d
JOIN schedule_weekdays sw ON sw.schedule_id = ps.schedule_id AND sw.weekday = isodow(d.work_date)""")


def leaves(t: Tables) -> DataFrame:
    """Leave intervals: signup events, start = date, end = start + id % 3."""
    e = t.events.filter(F.col("event_type") == "signup")
    start = F.to_date("ts")
    return e.select(
        F.col("event_id").alias("absence_id"),
        F.col("user_id").alias("person_id"),
        start.alias("start_date"),
        F.date_add(start, (F.col("event_id") % 3).cast("int")).alias("end_date"),
        F.lit("ANNUAL").alias("absence_type"),
        F.lit("APPROVED").alias("approval_status"),
    )


_cte("leaves", (), """
SELECT event_id AS absence_id, user_id AS person_id, CAST(ts AS DATE) AS start_date,
       CAST(ts AS DATE) + CAST(event_id % 3 AS INTEGER) AS end_date,
       'ANNUAL' AS absence_type, 'APPROVED' AS approval_status
FROM events WHERE event_type = 'signup'""")


def person_holidays(t: Tables) -> DataFrame:
    """Holidays per person: scope ALL for everyone, EVEN for even ids.

    Each person gets the array of scopes that apply; exploding it gives an
    equality key for the join with the fixed holiday table.
    """
    p = people(t)
    scopes = F.array(F.lit("ALL"), F.when((F.col("person_id") % 2) == 0, F.lit("EVEN")))
    keyed = p.select("person_id", F.explode(scopes).alias("scope")).filter(F.col("scope").isNotNull())
    return keyed.join(K.holidays(t.spark), "scope").select(
        "person_id", F.col("holiday_date"), "holiday_name")


_cte("person_holidays", ("people", "holidays"), """
SELECT p.person_id, h.holiday_date, h.holiday_name
FROM people p JOIN holidays h ON h.scope = 'ALL' OR (h.scope = 'EVEN' AND p.person_id % 2 = 0)""")


def accrual_entries(t: Tables) -> DataFrame:
    """Absence plan entries: one per event, typed by the event type."""
    e = t.events
    return e.join(K.accrual_types(t.spark), "event_type").select(
        F.col("event_id").alias("entry_id"),
        F.col("user_id").alias("person_id"),
        F.lit("Annual Leave").alias("plan_name"),
        F.col("entry_type"),
        F.col("value").cast("decimal(18,2)").alias("entry_value"),
        F.to_date("ts").alias("processed_date"),
    )


_cte("accrual_entries", ("accrual_types",), """
SELECT event_id AS entry_id, user_id AS person_id, 'Annual Leave' AS plan_name, aty.entry_type,
       CAST(value AS DECIMAL(18,2)) AS entry_value, CAST(ts AS DATE) AS processed_date
FROM events JOIN accrual_types aty ON events.event_type = aty.event_type""")


def submissions(t: Tables) -> DataFrame:
    """Recruiting submissions: one per person and day, with stage flags."""
    e = t.events
    flag = lambda typ: F.max(F.when(F.col("event_type") == typ, 1).otherwise(0))
    return (e.groupBy(F.col("user_id").alias("person_id"), F.to_date("ts").alias("submission_date"))
             .agg(flag("view").alias("applied"), flag("click").alias("offered"),
                  flag("purchase").alias("accepted"), flag("signup").alias("hired"),
                  F.min("event_id").alias("submission_id"))
             .withColumn("source", F.concat(F.lit("SRC-"), (F.col("person_id") % 7).cast("string"))))


_cte("submissions", (), """
SELECT user_id AS person_id, CAST(ts AS DATE) AS submission_date,
       MAX(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS applied,
       MAX(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS offered,
       MAX(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS accepted,
       MAX(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) AS hired,
       MIN(event_id) AS submission_id,
       'SRC-' || CAST(user_id % 7 AS VARCHAR) AS source
FROM events GROUP BY user_id, CAST(ts AS DATE)""")


# ---------------------------------------------------------------------------
# Supply chain
# ---------------------------------------------------------------------------

def movements(t: Tables) -> DataFrame:
    """Inventory movement per line item: item = part, org = supplier;
    returned quantity (R) is negative."""
    li = t.lineitem
    qty = F.col("l_quantity").cast("bigint")
    return li.select(
        F.col("l_orderkey").alias("source_doc_id"),
        F.col("l_partkey").alias("item_id"),
        F.col("l_suppkey").alias("org_id"),
        F.to_date("l_shipdate").alias("trx_date"),
        F.when(F.col("l_returnflag") == "R", -qty).otherwise(qty).alias("quantity"),
        money("l_extendedprice").alias("value"),
        F.when(F.col("l_returnflag") == "R", "RETURN").otherwise("ISSUE").alias("trx_type"),
    )


_cte("movements", (), """
SELECT l_orderkey AS source_doc_id, l_partkey AS item_id, l_suppkey AS org_id,
       CAST(l_shipdate AS DATE) AS trx_date,
       CASE WHEN l_returnflag = 'R' THEN -CAST(l_quantity AS BIGINT) ELSE CAST(l_quantity AS BIGINT) END AS quantity,
       CAST(l_extendedprice AS DECIMAL(18,2)) AS value,
       CASE WHEN l_returnflag = 'R' THEN 'RETURN' ELSE 'ISSUE' END AS trx_type
FROM lineitem""")


def cost_periods(t: Tables) -> DataFrame:
    """Average unit cost per item and month, rounded exactly to cents."""
    li = t.lineitem
    g = li.groupBy(F.col("l_partkey").alias("item_id"),
                   F.trunc(F.to_date("l_shipdate"), "month").alias("cost_date")).agg(
        F.sum(cents(money("l_extendedprice"))).alias("value_cents"),
        F.sum(F.col("l_quantity").cast("bigint")).alias("qty"))
    return g.select(
        "item_id", "cost_date", F.last_day("cost_date").alias("cost_end_date"),
        div_round(F.col("value_cents"), F.col("qty") * 100, 2).alias("unit_cost_average"))


_cte("cost_periods", (), f"""
SELECT item_id, cost_date, last_day(cost_date) AS cost_end_date,
       {sql_div_round('value_cents', 'qty * 100', 2)} AS unit_cost_average
FROM (SELECT l_partkey AS item_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS cost_date,
             SUM(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT)) AS value_cents,
             SUM(CAST(l_quantity AS BIGINT)) AS qty
      FROM lineitem GROUP BY l_partkey, CAST(date_trunc('month', l_shipdate) AS DATE)) g""")


# Invoice approval states; all but the last count as approved.
APPROVALS = ("Manually approved", "Workflow approved", "Approved", "Not required", "Required")


def p2p_stages(t: Tables) -> DataFrame:
    """Requisition -> order -> receipt -> invoice -> payment, per order.

    Each stage is aggregated per order *before* the join, so a stage with
    several lines cannot multiply another stage's sum (§8 #15); the three
    line stages come from ONE conditional aggregation of the lines and the
    requisition and order stages from one read of the orders.  Stand-ins: the
    requisition is approved on its date and the order as many days later as
    the priority's digit; urgent and high orders are inspected on receipt;
    invoices of every tenth requisition are not validated, and those whose
    id leaves 4 when divided by 5 await approval.
    """
    o = t.orders
    placed = F.col("o_orderstatus") != "P"
    req = o.select(F.col("o_orderkey").alias("req_id"), F.col("o_custkey").alias("requester_id"),
                   F.to_date("o_orderdate").alias("req_date"), money("o_totalprice").alias("req_amount"),
                   F.when(placed, F.to_date("o_orderdate")).alias("po_date"),
                   F.when(placed, money("o_totalprice")).alias("po_amount"),
                   F.when(placed, F.date_add(F.to_date("o_orderdate"), F.substring("o_orderpriority", 1, 1).cast("int")))
                   .alias("po_approved_date"),
                   F.when(placed & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "Y").otherwise("N").alias("inspected"),
                   F.when(F.col("o_orderkey") % 10 == 0, "NEEDS REVALIDATION").otherwise("VALIDATED").alias("validation_status"),
                   F.element_at(F.array(*[F.lit(x) for x in APPROVALS]), (F.col("o_orderkey") % 5 + 1).cast("int")).alias("approval_status"))
    app = applications(t)

    def stage(cond, prefix):
        return [F.sum(F.when(cond, F.col("amount"))).cast("decimal(38,2)").alias(f"{prefix}_amount"),
                F.max(F.when(cond, F.col("apply_date"))).alias(f"{prefix}_date")]

    lines = app.groupBy(F.col("applied_trx_id").alias("req_id")).agg(
        *stage(F.col("line_status") == "F", "rcv"), *stage(F.col("return_flag").isin("A", "R"), "inv"),
        *stage(F.col("return_flag") == "A", "pay"))
    return req.join(lines, "req_id", "left")


def _stage_sql(cond: str, prefix: str) -> str:
    return (f"(SELECT applied_trx_id AS req_id, CAST(SUM(amount) AS DECIMAL(38,2)) AS {prefix}_amount, "
            f"MAX(apply_date) AS {prefix}_date FROM applications WHERE {cond} GROUP BY applied_trx_id)")


_cte("p2p_stages", ("applications",), f"""
SELECT r.req_id, r.requester_id, r.req_date, r.req_amount, po.po_date, po.po_amount,
       rc.rcv_amount, rc.rcv_date, iv.inv_amount, iv.inv_date, py.pay_amount, py.pay_date, po.po_approved_date,
       CASE WHEN po.priority IN ('1-URGENT', '2-HIGH') THEN 'Y' ELSE 'N' END AS inspected,
       CASE WHEN r.req_id % 10 = 0 THEN 'NEEDS REVALIDATION' ELSE 'VALIDATED' END AS validation_status,
       CASE r.req_id % 5 WHEN 0 THEN 'Manually approved' WHEN 1 THEN 'Workflow approved' WHEN 2 THEN 'Approved'
                         WHEN 3 THEN 'Not required' ELSE 'Required' END AS approval_status
FROM (SELECT o_orderkey AS req_id, o_custkey AS requester_id, CAST(o_orderdate AS DATE) AS req_date,
             CAST(o_totalprice AS DECIMAL(18,2)) AS req_amount FROM orders) r
LEFT JOIN (SELECT o_orderkey AS req_id, CAST(o_orderdate AS DATE) AS po_date,
                  CAST(o_totalprice AS DECIMAL(18,2)) AS po_amount, o_orderpriority AS priority,
                  CAST(o_orderdate AS DATE) + CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS po_approved_date
           FROM orders WHERE o_orderstatus <> 'P') po
       ON r.req_id = po.req_id
LEFT JOIN {_stage_sql("line_status = 'F'", "rcv")} rc ON r.req_id = rc.req_id
LEFT JOIN {_stage_sql("return_flag IN ('A', 'R')", "inv")} iv ON r.req_id = iv.req_id
LEFT JOIN {_stage_sql("return_flag = 'A'", "pay")} py ON r.req_id = py.req_id""")


# ---------------------------------------------------------------------------
# Projects and costing
# ---------------------------------------------------------------------------

def project_costs(t: Tables) -> DataFrame:
    """Expenditure item per line item: project = supplier, task = line
    number; category from the part type (ECONOMY/STANDARD staff, PROMO
    burden, else expenses)."""
    li = t.lineitem
    p = t.part.select("p_partkey", "p_type")
    kind = F.split(F.col("p_type"), " ").getItem(0)
    raw = money("l_extendedprice")
    return li.join(p, li.l_partkey == p.p_partkey).select(
        F.col("l_orderkey").alias("expenditure_item_id"),
        F.col("l_suppkey").alias("project_id"),
        F.col("l_linenumber").alias("task_id"),
        F.col("l_partkey").alias("expenditure_type_id"),
        F.to_date("l_shipdate").alias("expenditure_date"),
        F.when(kind.isin("ECONOMY", "STANDARD"), "Staff").when(kind == "PROMO", "Burden")
         .otherwise("Expenses").alias("cost_category"),
        raw.alias("raw_cost"),
        round_money(raw * (F.lit(1) + F.col("l_tax").cast("decimal(4,2)"))).alias("burdened_cost"),
        F.col("l_quantity").cast("decimal(18,2)").alias("quantity"),
        F.when(F.col("l_returnflag") == "A", "F").when(F.col("l_returnflag") == "R", "P")
         .otherwise("U").alias("invoiced_flag"),
        F.when(F.col("l_linestatus") == "F", "F").otherwise("U").alias("revenue_recognized_flag"),
        F.when(F.col("l_returnflag") == "N", "N").otherwise("Y").alias("billable_flag"),
    )


_cte("project_costs", (), """
SELECT l_orderkey AS expenditure_item_id, l_suppkey AS project_id, l_linenumber AS task_id,
       l_partkey AS expenditure_type_id, CAST(l_shipdate AS DATE) AS expenditure_date,
       CASE WHEN split_part(p_type, ' ', 1) IN ('ECONOMY', 'STANDARD') THEN 'Staff'
            WHEN split_part(p_type, ' ', 1) = 'PROMO' THEN 'Burden' ELSE 'Expenses' END AS cost_category,
       CAST(l_extendedprice AS DECIMAL(18,2)) AS raw_cost,
       CAST(ROUND(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 + CAST(l_tax AS DECIMAL(4,2))), 2) AS DECIMAL(18,2)) AS burdened_cost,
       CAST(l_quantity AS DECIMAL(18,2)) AS quantity,
       CASE l_returnflag WHEN 'A' THEN 'F' WHEN 'R' THEN 'P' ELSE 'U' END AS invoiced_flag,
       CASE WHEN l_linestatus = 'F' THEN 'F' ELSE 'U' END AS revenue_recognized_flag,
       CASE WHEN l_returnflag = 'N' THEN 'N' ELSE 'Y' END AS billable_flag
FROM lineitem JOIN part ON l_partkey = p_partkey""")


def plan_versions(t: Tables) -> DataFrame:
    """Budget/forecast versions: project = customer; BUDGET for priority 1-2;
    the current (Y, N, P) and original (Y, N) flags go by the order's key."""
    o = t.orders
    pr = F.substring("o_orderpriority", 1, 1).cast("int")
    return o.select(
        F.col("o_orderkey").alias("plan_version_id"),
        F.col("o_custkey").alias("project_id"),
        F.when(pr <= 2, "BUDGET").otherwise("FORECAST").alias("plan_class"),
        F.when(F.col("o_orderstatus") == "F", "BASELINED").when(F.col("o_orderstatus") == "O", "SUBMITTED")
         .otherwise("WORKING").alias("plan_status"),
        F.to_date("o_orderdate").alias("submitted_date"),
        money("o_totalprice").alias("plan_amount"),
        F.element_at(F.array(F.lit("Y"), F.lit("N"), F.lit("P")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("current_plan_status_flag"),
        F.when(F.col("o_orderkey") % 2 == 0, "Y").otherwise("N").alias("original_flag"),
    )


_cte("plan_versions", (), """
SELECT o_orderkey AS plan_version_id, o_custkey AS project_id,
       CASE WHEN CAST(substr(o_orderpriority, 1, 1) AS INTEGER) <= 2 THEN 'BUDGET' ELSE 'FORECAST' END AS plan_class,
       CASE o_orderstatus WHEN 'F' THEN 'BASELINED' WHEN 'O' THEN 'SUBMITTED' ELSE 'WORKING' END AS plan_status,
       CAST(o_orderdate AS DATE) AS submitted_date, CAST(o_totalprice AS DECIMAL(18,2)) AS plan_amount,
       CASE o_orderkey % 3 WHEN 0 THEN 'Y' WHEN 1 THEN 'N' ELSE 'P' END AS current_plan_status_flag,
       CASE WHEN o_orderkey % 2 = 0 THEN 'Y' ELSE 'N' END AS original_flag
FROM orders""")


def suppliers(t: Tables) -> DataFrame:
    """Supplier master; a negative account balance marks a vendor id that
    points to a party (customer) record instead (J15)."""
    s = t.supplier
    return s.select(
        F.when(F.col("s_acctbal") < 0, -F.col("s_suppkey")).otherwise(F.col("s_suppkey")).alias("vendor_id"),
        F.col("s_suppkey").alias("supplier_id"),
        F.col("s_name").alias("vendor_name"),
        F.col("s_nationkey").alias("country_id"),
        money("s_acctbal").alias("acctbal"),
    )


_cte("suppliers", (), """
SELECT CASE WHEN s_acctbal < 0 THEN -s_suppkey ELSE s_suppkey END AS vendor_id, s_suppkey AS supplier_id,
       s_name AS vendor_name, s_nationkey AS country_id, CAST(s_acctbal AS DECIMAL(18,2)) AS acctbal
FROM supplier""")
