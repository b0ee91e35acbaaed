"""Receivables reports (R-AR*).

Shape of every report: filter each source at the parameter date, aggregate
the detail per document *before* joining (A8), join on document keys, and
aggregate per customer last.  Customer names are joined after the
aggregation, so the join carries one row per customer, not per document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.params import AS_OF, PERIOD_FROM, PERIOD_TO
from tallyspark.functions.scalars import MONEY, TOTAL, round_money
from tallyspark.operators import aging, windows
from tallyspark.operators.movements import opening_and_detail, union_branches
from tallyspark.plans.registry import register
from tallyspark.sources import standins as S
from tallyspark.sources.tables import Tables

D = S._d  # SQL date literal


# Oracle conditions on days past due, written out by hand per report.
_SQL_FIVE = {"current_amt": "<= 0", "b1_30": "BETWEEN 1 AND 30", "b31_60": "BETWEEN 31 AND 60",
             "b61_90": "BETWEEN 61 AND 90", "b90_plus": "> 90"}
_SQL_SEVEN = {"current_amt": "<= 0", "b1_30": "BETWEEN 1 AND 30", "b31_60": "BETWEEN 31 AND 60",
              "b61_90": "BETWEEN 61 AND 90", "b91_180": "BETWEEN 91 AND 180", "b181_360": "BETWEEN 181 AND 360",
              "b360_plus": "> 360"}
_SQL_SIX = {"not_due": "< 0", "b0_30": "BETWEEN 0 AND 30", "b31_60": "BETWEEN 31 AND 60",
            "b61_90": "BETWEEN 61 AND 90", "b91_120": "BETWEEN 91 AND 120", "b120_plus": "> 120"}
_SQL_UNAPPLIED = {"current_amt": "<= 0", "b1_30": "BETWEEN 1 AND 30", "b31_60": "BETWEEN 31 AND 60",
                  "b61_90": "BETWEEN 61 AND 90", "b91_120": "BETWEEN 91 AND 120", "b121_180": "BETWEEN 121 AND 180",
                  "b181_365": "BETWEEN 181 AND 365", "b365_plus": "> 365"}
_SQL_EIGHT = {"not_yet_due": "< 0", "b0_30": "BETWEEN 0 AND 30", "b31_60": "BETWEEN 31 AND 60",
              "b61_90": "BETWEEN 61 AND 90", "b91_120": "BETWEEN 91 AND 120", "b121_180": "BETWEEN 121 AND 180",
              "b181_360": "BETWEEN 181 AND 360", "above_360": "> 360"}


# ---------------------------------------------------------------------------
# Shared blocks
# ---------------------------------------------------------------------------

def applied_to_date(t: Tables, as_of=None) -> DataFrame:
    """Applied amount per transaction up to the date (cash + credit memo)."""
    as_of = as_of or t.params.as_of
    app = S.applications(t)
    return (app.filter((F.col("apply_date") <= F.lit(as_of)) & F.col("app_type").isin("CASH", "CM")
                       & (F.col("status") == "APP"))
               .groupBy("applied_trx_id").agg(F.sum("amount").alias("applied_amt")))


APPLIED_SQL = f"""(SELECT applied_trx_id, SUM(amount) AS applied_amt FROM applications
 WHERE apply_date <= {D(AS_OF)} AND app_type IN ('CASH', 'CM') AND status = 'APP'
 GROUP BY applied_trx_id)"""


def open_balances(t: Tables, as_of=None) -> DataFrame:
    """Remaining functional balance per transaction at the date: original and
    applications, both at the document's rate (default 1)."""
    as_of = as_of or t.params.as_of
    inv = S.invoices(t).filter((F.col("trx_date") <= F.lit(as_of)) & (F.col("amount") != 0))
    app = applied_to_date(t, as_of)
    bal = inv.join(app, inv.trx_id == app.applied_trx_id, "left")
    rate = F.coalesce(F.col("exchange_rate"), F.lit(1))
    remaining = (F.round(F.col("amount") * rate, 2)
                 - F.round(F.coalesce(F.col("applied_amt"), F.lit(0)).cast(MONEY) * rate, 2))
    return bal.select("trx_id", "trx_number", "customer_id", "org_id", "class", "trx_date", "due_date",
                      "complete_flag", remaining.alias("remaining"))


OPEN_BAL_SQL = f"""(SELECT b.trx_id, b.trx_number, b.customer_id, b.org_id, b.class, b.trx_date, b.due_date,
        ROUND(b.amount * COALESCE(b.exchange_rate, 1), 2)
          - ROUND(CAST(COALESCE(a.applied_amt, 0) AS DECIMAL(18,2)) * COALESCE(b.exchange_rate, 1), 2) AS remaining
 FROM invoices b LEFT JOIN {APPLIED_SQL} a ON b.trx_id = a.applied_trx_id
 WHERE b.trx_date <= {D(AS_OF)} AND b.amount <> 0)"""


def customer_movements(t: Tables, include_reversed: bool = False) -> DataFrame:
    """Every customer movement -- complete invoices/credit memos and applied,
    non-reversed receipts -- from ONE scan of the orders and ONE
    aggregation of the lines.

    The line aggregation per order yields the receipt (cash total and first
    cash date) and the reversal flag in the same pass; joined to the order's
    invoice facts, each order emits up to two movement rows (``explode``).
    Reports that need an opening balance and detail derive both from this
    one stream instead of re-reading invoices and receipts per block.
    Columns: customer_id, org_id, gl_date, doc_number, doc_type, source,
    type_name, raw_amount (debit positive), func_amount (functional),
    is_reversed (only reversed receipts, kept when ``include_reversed``).
    """
    inv = S.invoices(t).select("trx_id", "trx_number", "customer_id", "org_id", "trx_date", "class", "amount",
                               "exchange_rate", "complete_flag")
    a = S.applications(t)
    cash = F.col("app_type") == "CASH"
    per_order = a.groupBy(F.col("applied_trx_id").alias("trx_id")).agg(
        F.sum(F.when(cash, F.col("amount"))).cast(MONEY).alias("cash_amount"),
        F.min(F.when(cash, F.col("apply_date"))).alias("receipt_date"),
        F.max(F.when((F.col("return_flag") == "R") & (F.col("line_status") == "F"), 1).otherwise(0)).alias("reversed"))
    j = inv.join(per_order, "trx_id", "left")
    rate = F.coalesce(F.col("exchange_rate"), F.lit(1))
    is_cm = F.col("class") == "CM"
    inv_mv = F.when(F.col("complete_flag") == "Y", F.struct(
        F.col("trx_date").alias("gl_date"), F.col("trx_number").alias("doc_number"),
        F.when(is_cm, "CREDIT_MEMO").otherwise("INVOICE").alias("doc_type"), F.lit("INVOICE").alias("source"),
        F.when(is_cm, "Credit Memo").otherwise("Invoice").alias("type_name"),
        F.col("amount").cast("decimal(38,2)").alias("raw_amount"),
        F.round(F.col("amount") * rate, 2).cast("decimal(38,2)").alias("func_amount"),
        F.lit(False).alias("is_reversed")))
    keep_rc = F.col("cash_amount").isNotNull()
    if not include_reversed:
        keep_rc = keep_rc & (F.col("reversed") == 0)
    rc_mv = F.when(keep_rc, F.struct(
        F.col("receipt_date").alias("gl_date"),
        F.concat(F.lit("RCPT-"), F.col("trx_id").cast("string")).alias("doc_number"),
        F.lit("RECEIPT").alias("doc_type"), F.lit("RECEIPT").alias("source"), F.lit("Payment").alias("type_name"),
        (-F.col("cash_amount")).cast("decimal(38,2)").alias("raw_amount"),
        (-F.round(F.col("cash_amount") * rate, 2)).cast("decimal(38,2)").alias("func_amount"),
        (F.col("reversed") == 1).alias("is_reversed")))
    mv = j.select("customer_id", "org_id", F.explode(F.array(inv_mv, rc_mv)).alias("m"))
    return mv.filter(F.col("m").isNotNull()).select("customer_id", "org_id", "m.*")


# ---------------------------------------------------------------------------
# R-AR1: point-in-time customer aging, 5 buckets (flagship)
# ---------------------------------------------------------------------------

_AR1_SQL = S.with_sql(f"""
SELECT c.party_name, CAST(SUM(x.remaining) AS DECIMAL(38,2)) AS total_due,
       {aging.sql_buckets("x.days_due", "x.remaining", _SQL_FIVE)}
FROM (SELECT customer_id, remaining, {D(AS_OF)} - due_date AS days_due
      FROM {OPEN_BAL_SQL} ob WHERE remaining <> 0) x
JOIN customers c ON x.customer_id = c.customer_id AND c.status = 'A'
GROUP BY c.party_name""", "invoices", "applications", "customers")


@register("r_ar1_customer_aging_5", _AR1_SQL)
def customer_aging_5(t: Tables, as_of=None) -> DataFrame:
    """R-AR1: customer aging at a date, 5 buckets (Current, 1-30, 31-60, 61-90, >90).

    Balance = original x rate - applications up to the date; days due from
    the due date.  Bucket sums are taken per customer id first (partial
    aggregation), then named and re-summed per party name.
    """
    as_of = as_of or t.params.as_of
    bal = open_balances(t, as_of).filter(F.col("remaining") != 0)
    bal = bal.withColumn("days_due", F.datediff(F.lit(as_of), F.col("due_date")))
    per_cust = aging.bucket_totals(bal, ["customer_id"], "days_due", "remaining", aging.AR_FIVE)
    cust = S.customers(t).filter(F.col("status") == "A").select("customer_id", "party_name")
    named = per_cust.join(cust, "customer_id")
    cols = ["total_due", *aging.AR_FIVE.columns]
    return named.groupBy("party_name").agg(*[F.sum(c).cast(TOTAL).alias(c) for c in cols])


@register("r_ar1_customer_aging_ordered", f"""
SELECT *, ROW_NUMBER() OVER (ORDER BY total_due DESC, party_name) AS report_order FROM ({_AR1_SQL}) a""")
def customer_aging_ordered(t: Tables) -> DataFrame:
    """R-AR1 in report order (O1: largest total first, then the name), with
    the order as a column, so that it outlasts writing and regrouping; the
    rows are numbered without one window over all of them."""
    rows = customer_aging_5(t).withColumn("falling", -F.col("total_due"))
    out = windows.serial_number(rows, ["falling", "party_name"], "report_order", bucket=windows.magnitude_bucket("falling"))
    return out.drop("falling").sort("report_order")


# ---------------------------------------------------------------------------
# R-AR2: customer ledger with running balance
# ---------------------------------------------------------------------------

def _ledger_rows(t: Tables) -> DataFrame:
    mv = customer_movements(t).filter(F.col("gl_date").between(F.lit(t.params.date_from), F.lit(t.params.date_to)))
    is_rc = F.col("source") == "RECEIPT"
    return mv.select("org_id", "customer_id", "gl_date", F.col("doc_number").alias("trx_number"), "source",
                     F.col("type_name").alias("type"),
                     F.when(is_rc, F.lit(0)).otherwise(F.col("raw_amount")).cast(MONEY).alias("debit_amt"),
                     F.when(is_rc, -F.col("raw_amount")).otherwise(F.lit(0)).cast(MONEY).alias("credit_amt"))


_LEDGER_ROWS_SQL = f"""
(SELECT org_id, customer_id, trx_date AS gl_date, trx_number, 'INVOICE' AS source,
        CASE WHEN class = 'CM' THEN 'Credit Memo' ELSE 'Invoice' END AS type,
        amount AS debit_amt, CAST(0 AS DECIMAL(18,2)) AS credit_amt
 FROM invoices WHERE complete_flag = 'Y'
 UNION ALL
 SELECT org_id, customer_id, receipt_date, receipt_number, 'RECEIPT', 'Payment',
        CAST(0 AS DECIMAL(18,2)), amount
 FROM receipts r WHERE status = 'APP'
   AND NOT EXISTS (SELECT 1 FROM receipt_history h WHERE h.receipt_id = r.receipt_id AND h.status = 'REVERSED'))"""

_AR2_SQL = S.with_sql(f"""
SELECT c.party_name AS customer_name, c.account_number, u.gl_date, u.trx_number, u.source, u.type,
       u.debit_amt, u.credit_amt,
       CAST(SUM(COALESCE(u.debit_amt, 0) - COALESCE(u.credit_amt, 0)) OVER (
            PARTITION BY u.customer_id ORDER BY u.gl_date, u.trx_number
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DECIMAL(38,2)) AS running_balance
FROM {_LEDGER_ROWS_SQL} u JOIN customers c ON u.customer_id = c.customer_id
WHERE u.gl_date BETWEEN {D(PERIOD_FROM)} AND {D(PERIOD_TO)} AND c.status = 'A'
""", "invoices", "receipts", "receipt_history", "customers")


@register("r_ar2_customer_ledger", _AR2_SQL)
def customer_ledger(t: Tables) -> DataFrame:
    """R-AR2: customer ledger, invoices and applied (non-reversed) receipts,
    with a running balance per customer ordered by date and number.

    The running balance is computed per (customer, date) chunk plus the
    total of the customer's earlier dates (skew-safe W1)."""
    rows = _ledger_rows(t)
    cust = S.customers(t).filter(F.col("status") == "A").select(
        "customer_id", F.col("party_name").alias("customer_name"), "account_number")
    rows = rows.join(cust, "customer_id")
    net = F.coalesce(F.col("debit_amt"), F.lit(0)) - F.coalesce(F.col("credit_amt"), F.lit(0))
    out = windows.running_total(rows, ["customer_id"], ["gl_date", "trx_number"], net,
                                "running_balance", chunk="gl_date")
    return out.select("customer_name", "account_number", "gl_date", "trx_number", "source", "type",
                      "debit_amt", "credit_amt", F.col("running_balance").cast(TOTAL).alias("running_balance"))


# ---------------------------------------------------------------------------
# The signed-movement fact (R-AR8) and its reports
# ---------------------------------------------------------------------------

def movement_fact(t: Tables, as_of=None) -> DataFrame:
    """One long fact of signed movements per transaction up to the date.

    Components: invoice (original x rate), cash and credit-memo
    applications, adjustments, earned discount and exchange difference --
    the six typed branches of O4.  The application branches come from ONE
    join of the lines to their invoice: each line emits its movements with
    ``explode`` instead of one scan and join per branch.  Amounts are signed
    so that the balance is their plain sum (§8 #1: amounts are already
    signed).  Every row carries the invoice's customer and due date.
    """
    as_of = as_of or t.params.as_of
    inv = S.invoices(t).filter((F.col("trx_date") <= F.lit(as_of)) & (F.col("amount") != 0))
    inv_b = inv.select("trx_id", "customer_id", "due_date", F.col("trx_date").alias("mv_date"),
                       round_money(F.col("amount") * F.coalesce(F.col("exchange_rate"), F.lit(1))).alias("amount"),
                       F.lit("INVOICE").alias("movement_type"), F.lit(1).alias("branch_rank"))
    app = S.applications(t).filter(F.col("apply_date") <= F.lit(as_of))
    app = app.join(inv.select(F.col("trx_id").alias("applied_trx_id"), "customer_id", "due_date"), "applied_trx_id")
    typ = F.col("app_type")

    def mv(cond, kind, rank, amt):
        return F.when(cond, F.struct(F.lit(kind).alias("movement_type"), F.lit(rank).alias("branch_rank"),
                                     (-amt).cast(MONEY).alias("amount")))

    moves = F.array(
        mv(typ == "CASH", "CASH", 2, F.col("amount")),
        mv(typ == "CM", "CREDIT_MEMO", 3, F.col("amount")),
        mv(typ == "ADJ", "ADJUSTMENT", 4, F.col("amount")),
        mv(typ == "CASH", "DISCOUNT", 5, F.col("discount_taken")),
        mv(typ == "CASH", "EXCHANGE", 6, F.col("acctd_amount") - F.col("amount")))
    app_b = (app.select(F.col("applied_trx_id").alias("trx_id"), "customer_id", "due_date",
                        F.col("apply_date").alias("mv_date"), F.explode(moves).alias("m"))
             .filter(F.col("m").isNotNull())
             .select("trx_id", "customer_id", "due_date", "mv_date", "m.amount", "m.movement_type", "m.branch_rank"))
    return inv_b.unionByName(app_b)


def _mv_branch_sql(cond: str, amt: str, kind: str, rank: int) -> str:
    return (f"SELECT a.applied_trx_id AS trx_id, i.customer_id, a.apply_date AS mv_date, "
            f"CAST(-({amt}) AS DECIMAL(18,2)) AS amount, '{kind}' AS movement_type, {rank} AS branch_rank "
            f"FROM applications a JOIN invoices i ON a.applied_trx_id = i.trx_id "
            f"WHERE a.apply_date <= {D(AS_OF)} AND i.trx_date <= {D(AS_OF)} AND i.amount <> 0 AND {cond}")


MOVEMENTS_SQL = f"""(
SELECT trx_id, customer_id, trx_date AS mv_date,
       CAST(ROUND(amount * COALESCE(exchange_rate, 1), 2) AS DECIMAL(18,2)) AS amount,
       'INVOICE' AS movement_type, 1 AS branch_rank
FROM invoices WHERE trx_date <= {D(AS_OF)} AND amount <> 0
UNION ALL {_mv_branch_sql("a.app_type = 'CASH'", "a.amount", "CASH", 2)}
UNION ALL {_mv_branch_sql("a.app_type = 'CM'", "a.amount", "CREDIT_MEMO", 3)}
UNION ALL {_mv_branch_sql("a.app_type = 'ADJ'", "a.amount", "ADJUSTMENT", 4)}
UNION ALL {_mv_branch_sql("a.app_type = 'CASH'", "a.discount_taken", "DISCOUNT", 5)}
UNION ALL {_mv_branch_sql("a.app_type = 'CASH'", "a.acctd_amount - a.amount", "EXCHANGE", 6)})"""

_COMPONENTS = [("INVOICE", "invoice_amt"), ("CASH", "cash_amt"), ("CREDIT_MEMO", "credit_memo_amt"),
               ("ADJUSTMENT", "adjustment_amt"), ("DISCOUNT", "discount_amt"), ("EXCHANGE", "exchange_amt")]


def _component_sql(prefix: str = "") -> str:
    return ", ".join(f"CAST(SUM(CASE WHEN {prefix}movement_type = '{k}' THEN {prefix}amount ELSE 0 END) "
                     f"AS DECIMAL(38,2)) AS {c}" for k, c in _COMPONENTS)


_AR8_SQL = S.with_sql(f"""
SELECT m.customer_id, {_component_sql('m.')},
       CAST(SUM(m.amount) AS DECIMAL(38,2)) AS balance
FROM {MOVEMENTS_SQL} m GROUP BY m.customer_id""", "invoices", "applications")


@register("r_ar8_component_balance", _AR8_SQL)
def component_balance(t: Tables) -> DataFrame:
    """R-AR8: six-component balance per customer at the date (one movement
    fact, one conditional-sum pass)."""
    mv = movement_fact(t)
    comps = [F.sum(F.when(F.col("movement_type") == k, F.col("amount")).otherwise(0)).cast(TOTAL).alias(c)
             for k, c in _COMPONENTS]
    return mv.groupBy("customer_id").agg(*comps, F.sum("amount").cast(TOTAL).alias("balance"))


_AR9_SQL = S.with_sql(f"""
SELECT s.trx_id, s.balance, {aging.sql_buckets(f"({D(AS_OF)} - i.due_date)", "s.balance", _SQL_SIX)}
FROM (SELECT trx_id, SUM(amount) AS balance FROM {MOVEMENTS_SQL} m GROUP BY trx_id) s
JOIN invoices i ON s.trx_id = i.trx_id
GROUP BY s.trx_id, s.balance""", "invoices", "applications")


@register("r_ar9_transaction_buckets", _AR9_SQL)
def transaction_buckets(t: Tables) -> DataFrame:
    """R-AR9: aging buckets per transaction from the movement fact, with a
    not-due column so that the buckets add up to the balance (§8 #5)."""
    per_trx = movement_fact(t).groupBy("trx_id").agg(F.sum("amount").alias("balance"),
                                                     F.max("due_date").alias("due_date"))
    x = per_trx.withColumn("days_due", F.datediff(F.lit(t.params.as_of), F.col("due_date")))
    x = x.withColumn("balance", F.col("balance").cast(TOTAL))
    return x.groupBy("trx_id", "balance").agg(*aging.AR_SIX_NOT_DUE.sums("days_due", "balance"))


# ---------------------------------------------------------------------------
# R-AR11: opening balance of customers active in the period
# ---------------------------------------------------------------------------

def _func(amount: str = "amount") -> F.Column:
    return F.round(F.col(amount) * F.coalesce(F.col("exchange_rate"), F.lit(1)), 2)


_AR11_SQL = S.with_sql(f"""
SELECT a.customer_id, c.party_name,
       CAST(COALESCE(SUM(o.amount), 0) AS DECIMAL(38,2)) AS opening_balance
FROM (SELECT customer_id FROM invoices WHERE trx_date BETWEEN {D(PERIOD_FROM)} AND {D(PERIOD_TO)} AND complete_flag = 'Y'
      UNION
      SELECT customer_id FROM receipts WHERE receipt_date BETWEEN {D(PERIOD_FROM)} AND {D(PERIOD_TO)}) a
JOIN customers c ON a.customer_id = c.customer_id
LEFT JOIN (SELECT customer_id, ROUND(amount * COALESCE(exchange_rate, 1), 2) AS amount FROM invoices
           WHERE trx_date < {D(PERIOD_FROM)} AND complete_flag = 'Y'
           UNION ALL
           SELECT customer_id, -ROUND(amount * COALESCE(exchange_rate, 1), 2) FROM receipts r
           WHERE receipt_date < {D(PERIOD_FROM)}
             AND NOT EXISTS (SELECT 1 FROM receipt_history h WHERE h.receipt_id = r.receipt_id AND h.status = 'REVERSED')) o
  ON a.customer_id = o.customer_id
GROUP BY a.customer_id, c.party_name""", "invoices", "receipts", "receipt_history", "customers")




@register("r_ar11_opening_balance", _AR11_SQL)
def opening_balance(t: Tables) -> DataFrame:
    """R-AR11: opening balance (functional currency) of the customers active
    in the period.  One aggregation over the movement stream gives both the
    opening (movements before the period) and the activity flag."""
    # reversed receipts still make a customer active, but carry no balance
    mv = customer_movements(t, include_reversed=True).filter(F.col("gl_date") <= F.lit(t.params.date_to))
    before = F.col("gl_date") < F.lit(t.params.date_from)
    g = mv.groupBy("customer_id").agg(
        F.sum(F.when(before & ~F.col("is_reversed"), F.col("func_amount"))).alias("opening_balance"),
        F.max(F.when(~before, F.lit(1))).alias("active"))
    g = g.filter(F.col("active") == 1)
    cust = S.customers(t).select("customer_id", "party_name")
    return g.join(cust, "customer_id").select(
        "customer_id", "party_name", F.coalesce(F.col("opening_balance"), F.lit(0)).cast(TOTAL).alias("opening_balance"))


# ---------------------------------------------------------------------------
# R-AR12: production ledger -- opening row + detail rows + running balance
# ---------------------------------------------------------------------------

def _ar12_sql() -> str:
    detail = f"""
 SELECT customer_id, trx_date AS gl_date, trx_number AS doc_number,
        CASE WHEN class = 'CM' THEN 'CREDIT_MEMO' ELSE 'INVOICE' END AS doc_type,
        ROUND(amount * COALESCE(exchange_rate, 1), 2) AS amount
 FROM invoices WHERE complete_flag = 'Y' AND trx_date BETWEEN {D(PERIOD_FROM)} AND {D(PERIOD_TO)}
 UNION ALL
 SELECT customer_id, receipt_date, receipt_number, 'RECEIPT', -ROUND(amount * COALESCE(exchange_rate, 1), 2)
 FROM receipts r WHERE receipt_date BETWEEN {D(PERIOD_FROM)} AND {D(PERIOD_TO)}
   AND NOT EXISTS (SELECT 1 FROM receipt_history h WHERE h.receipt_id = r.receipt_id AND h.status = 'REVERSED')"""
    opening = f"""
 SELECT customer_id, SUM(amount) AS opening_balance FROM (
   SELECT customer_id, ROUND(amount * COALESCE(exchange_rate, 1), 2) AS amount FROM invoices
   WHERE trx_date < {D(PERIOD_FROM)} AND complete_flag = 'Y'
   UNION ALL
   SELECT customer_id, -ROUND(amount * COALESCE(exchange_rate, 1), 2) FROM receipts r
   WHERE receipt_date < {D(PERIOD_FROM)}
     AND NOT EXISTS (SELECT 1 FROM receipt_history h WHERE h.receipt_id = r.receipt_id AND h.status = 'REVERSED')) x
 GROUP BY customer_id"""
    body = f"""
SELECT d.customer_id, c.party_name, 2 AS block, d.gl_date, d.doc_number, d.doc_type,
       CAST(d.amount AS DECIMAL(38,2)) AS amount,
       CAST(COALESCE(o.opening_balance, 0) + SUM(d.amount) OVER (PARTITION BY d.customer_id
            ORDER BY d.gl_date, d.doc_type, d.doc_number ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
            AS DECIMAL(38,2)) AS running_balance
FROM ({detail}) d JOIN customers c ON d.customer_id = c.customer_id
LEFT JOIN ({opening}) o ON d.customer_id = o.customer_id
UNION ALL
SELECT o.customer_id, c.party_name, 1, CAST({D(PERIOD_FROM)} AS DATE), 'OPENING', 'OPENING',
       CAST(o.opening_balance AS DECIMAL(38,2)), CAST(o.opening_balance AS DECIMAL(38,2))
FROM ({opening}) o JOIN customers c ON o.customer_id = c.customer_id
WHERE o.customer_id IN (SELECT customer_id FROM ({detail}) dd)"""
    return S.with_sql(body, "invoices", "receipts", "receipt_history", "customers")


@register("r_ar12_production_ledger", _ar12_sql())
def production_ledger(t: Tables) -> DataFrame:
    """R-AR12: opening row (block 1) and period detail (block 2) per active
    customer; running balance = opening + running sum of the detail.

    The running total runs over every movement up to the period end, so the
    opening is simply the part of it before the period -- no separate
    opening join.  Skew-safe two-level W1 (chunk = date); the opening rows
    come from one aggregation over the same movement stream."""
    mv = customer_movements(t).filter(F.col("gl_date") <= F.lit(t.params.date_to)).select(
        "customer_id", "gl_date", "doc_number", "doc_type", F.col("func_amount").alias("amount"))
    run = windows.running_total(mv, ["customer_id"], ["gl_date", "doc_type", "doc_number"], "amount",
                                "running_balance", chunk="gl_date")
    cust = S.customers(t).select("customer_id", "party_name")
    det_out = run.filter(F.col("gl_date") >= F.lit(t.params.date_from)).join(cust, "customer_id").select(
        "customer_id", "party_name", "gl_date", "doc_number", "doc_type",
        F.col("amount").cast(TOTAL).alias("amount"), F.col("running_balance").cast(TOTAL).alias("running_balance"))
    before = F.col("gl_date") < F.lit(t.params.date_from)
    g = mv.groupBy("customer_id").agg(F.sum(F.when(before, F.col("amount"))).alias("opening"),
                                      F.max(F.when(~before, F.lit(1))).alias("active"))
    open_out = g.filter((F.col("active") == 1) & F.col("opening").isNotNull()).join(cust, "customer_id").select(
        "customer_id", "party_name", F.lit(t.params.date_from).alias("gl_date"),
        F.lit("OPENING").alias("doc_number"), F.lit("OPENING").alias("doc_type"),
        F.col("opening").cast(TOTAL).alias("amount"), F.col("opening").cast(TOTAL).alias("running_balance"))
    return opening_and_detail(open_out, det_out)


# ---------------------------------------------------------------------------
# R-AR13: unapplied receipts aging, 8 buckets, negative sign
# ---------------------------------------------------------------------------

_AR13_SQL = S.with_sql(f"""
SELECT u.customer_id, c.party_name, CAST(SUM(u.amount) AS DECIMAL(38,2)) AS unapplied_total,
       {aging.sql_buckets(f"({D(AS_OF)} - u.receipt_date)", "u.amount", _SQL_UNAPPLIED)}
FROM unapplied_receipts u JOIN customers c ON u.customer_id = c.customer_id
WHERE u.receipt_date <= {D(AS_OF)}
  AND NOT EXISTS (SELECT 1 FROM receipt_history h WHERE h.receipt_id = u.receipt_id AND h.status = 'REVERSED')
GROUP BY u.customer_id, c.party_name
HAVING SUM(u.amount) <> 0""", "unapplied_receipts", "receipt_history", "customers")


@register("r_ar13_unapplied_aging", _AR13_SQL)
def unapplied_aging(t: Tables) -> DataFrame:
    """R-AR13: unapplied receipts at the date, not reversed (J4), aged by
    receipt date into 8 buckets, negative amounts, non-zero customers (A4)."""
    u = S.unapplied_receipts(t).filter(F.col("receipt_date") <= F.lit(t.params.as_of))
    u = u.join(S.receipt_history(t).filter(F.col("status") == "REVERSED").select("receipt_id"),
               "receipt_id", "left_anti")
    u = u.withColumn("days", F.datediff(F.lit(t.params.as_of), F.col("receipt_date")))
    per = aging.bucket_totals(u, ["customer_id"], "days", "amount", aging.UNAPPLIED_EIGHT, "unapplied_total")
    per = per.filter(F.col("unapplied_total") != 0)
    return per.join(S.customers(t).select("customer_id", "party_name"), "customer_id")


# ---------------------------------------------------------------------------
# R-AR14: aging with unapplied receipts (7 components, 6 buckets, days text)
# ---------------------------------------------------------------------------

def _days_text(days) -> F.Column:
    """Text for documents that are not due yet, else NULL."""
    return F.when(days < 0, F.concat(F.lit("No Due Yet ("), (-days).cast("string"), F.lit(" days left)")))


_AR14_SQL = S.with_sql(f"""
SELECT x.doc_id, x.doc_kind, x.customer_id, c.party_name, x.ref_date,
       CAST(x.balance AS DECIMAL(38,2)) AS balance,
       CASE WHEN x.ref_date > {D(AS_OF)} THEN 'No Due Yet (' || CAST(x.ref_date - {D(AS_OF)} AS VARCHAR) || ' days left)' END AS days_text,
       {aging.sql_buckets(f"({D(AS_OF)} - x.ref_date)", "x.balance", _SQL_SIX, total=False)}
FROM (SELECT s.trx_id AS doc_id, 'TRX' AS doc_kind, i.customer_id, i.due_date AS ref_date, s.balance
      FROM (SELECT trx_id, SUM(amount) AS balance FROM {MOVEMENTS_SQL} m GROUP BY trx_id) s
      JOIN invoices i ON s.trx_id = i.trx_id
      UNION ALL
      SELECT receipt_id, 'UNAPPLIED', customer_id, receipt_date, amount FROM unapplied_receipts u
      WHERE receipt_date <= {D(AS_OF)}
        AND NOT EXISTS (SELECT 1 FROM receipt_history h WHERE h.receipt_id = u.receipt_id AND h.status = 'REVERSED')) x
JOIN customers c ON x.customer_id = c.customer_id
WHERE x.balance <> 0""", "invoices", "applications", "unapplied_receipts", "receipt_history", "customers")


@register("r_ar14_aging_with_unapplied", _AR14_SQL)
def aging_with_unapplied(t: Tables) -> DataFrame:
    """R-AR14: per open transaction (six movement components) and per
    unapplied receipt (the seventh), the balance, its not-due/overdue
    bucket and a days-left text; zero balances dropped."""
    per_trx = movement_fact(t).groupBy("trx_id").agg(F.sum("amount").alias("balance"),
                                                     F.max("customer_id").alias("customer_id"),
                                                     F.max("due_date").alias("ref_date"))
    trx = per_trx.select(F.col("trx_id").alias("doc_id"), F.lit("TRX").alias("doc_kind"), "customer_id",
                         "ref_date", "balance")
    u = S.unapplied_receipts(t).filter(F.col("receipt_date") <= F.lit(t.params.as_of))
    u = u.join(S.receipt_history(t).filter(F.col("status") == "REVERSED").select("receipt_id"),
               "receipt_id", "left_anti")
    un = u.select(F.col("receipt_id").alias("doc_id"), F.lit("UNAPPLIED").alias("doc_kind"), "customer_id",
                  F.col("receipt_date").alias("ref_date"), F.col("amount").alias("balance"))
    x = trx.unionByName(un).filter(F.col("balance") != 0)
    days = F.datediff(F.lit(t.params.as_of), F.col("ref_date"))
    lab = aging.AR_SIX_NOT_DUE.label(days)
    buckets = [F.when(lab == F.lit(label), F.col("balance")).otherwise(F.lit(0)).cast(TOTAL).alias(col)
               for label, col, _, _ in aging.AR_SIX_NOT_DUE.buckets]
    x = x.join(S.customers(t).select("customer_id", "party_name"), "customer_id")
    return x.select("doc_id", "doc_kind", "customer_id", "party_name", "ref_date",
                    F.col("balance").cast(TOTAL).alias("balance"), _days_text(days).alias("days_text"), *buckets)


# ---------------------------------------------------------------------------
# Smaller receivables blocks
# ---------------------------------------------------------------------------

_AR3_SQL = S.with_sql(f"""
SELECT ob.customer_id, c.party_name, CAST(SUM(ob.remaining) AS DECIMAL(38,2)) AS total_due,
       {aging.sql_buckets(f"({D(AS_OF)} - ob.due_date)", "ob.remaining", _SQL_SEVEN)}
FROM {OPEN_BAL_SQL} ob JOIN customers c ON ob.customer_id = c.customer_id
WHERE ob.remaining <> 0 GROUP BY ob.customer_id, c.party_name""", "invoices", "applications", "customers")


@register("r_ar3_aging_7_buckets", _AR3_SQL)
def aging_7(t: Tables) -> DataFrame:
    """R-AR3: aging by customer, all 7 buckets output (they add up, §8 #3)."""
    bal = open_balances(t).filter(F.col("remaining") != 0).withColumn(
        "days", F.datediff(F.lit(t.params.as_of), F.col("due_date")))
    per = aging.bucket_totals(bal, ["customer_id"], "days", "remaining", aging.AR_SEVEN)
    return per.join(S.customers(t).select("customer_id", "party_name"), "customer_id")


_AR4_SQL = S.with_sql(f"""
SELECT i.trx_id, i.trx_number, i.trx_date, i.class, c.party_name, c.unit_name, i.amount,
       i.due_date, COALESCE(i.term_name, 'NONE') AS term_name
FROM invoices i JOIN customers c ON i.customer_id = c.customer_id
WHERE i.trx_date >= {D(PERIOD_FROM)} AND i.trx_date <= {D(PERIOD_TO)} AND i.complete_flag = 'Y'
""", "invoices", "customers")


@register("r_ar4_transaction_register", _AR4_SQL)
def transaction_register(t: Tables) -> DataFrame:
    """R-AR4: complete transactions in the period with customer, unit and terms."""
    from tallyspark.functions.params import date_range
    inv = S.invoices(t).filter(date_range("trx_date", t.params.date_from, t.params.date_to) & (F.col("complete_flag") == "Y"))
    c = S.customers(t).select("customer_id", "party_name", "unit_name")
    return inv.join(c, "customer_id").select(
        "trx_id", "trx_number", "trx_date", "class", "party_name", "unit_name", "amount", "due_date",
        F.coalesce(F.col("term_name"), F.lit("NONE")).alias("term_name"))


_AR5_SQL = S.with_sql(f"""
SELECT r.receipt_id, r.receipt_number, r.receipt_date, c.party_name, r.amount,
       COALESCE(a.app_count, 0) AS app_count, CAST(COALESCE(a.applied, 0) AS DECIMAL(38,2)) AS applied_amount
FROM receipts r JOIN customers c ON r.customer_id = c.customer_id
LEFT JOIN (SELECT applied_trx_id, COUNT(*) AS app_count, SUM(amount) AS applied FROM applications
           WHERE app_type = 'CASH' GROUP BY applied_trx_id) a ON a.applied_trx_id = r.receipt_id
WHERE r.receipt_date BETWEEN {D(PERIOD_FROM)} AND {D(PERIOD_TO)}
  AND NOT EXISTS (SELECT 1 FROM receipt_history h WHERE h.receipt_id = r.receipt_id AND h.status = 'REVERSED')
""", "receipts", "applications", "receipt_history", "customers")


@register("r_ar5_receipt_register", _AR5_SQL)
def receipt_register(t: Tables) -> DataFrame:
    """R-AR5: receipts in the period, reversed ones excluded (J4), with
    their application count and amount (pre-aggregated, J2)."""
    r = S.receipts(t).filter((F.col("receipt_date") >= F.lit(t.params.date_from)) & (F.col("receipt_date") <= F.lit(t.params.date_to)))
    r = r.join(S.receipt_history(t).filter(F.col("status") == "REVERSED").select("receipt_id"), "receipt_id", "left_anti")
    apps = (S.applications(t).filter(F.col("app_type") == "CASH").groupBy(F.col("applied_trx_id").alias("receipt_id"))
            .agg(F.count(F.lit(1)).alias("app_count"), F.sum("amount").alias("applied")))
    out = r.join(apps, "receipt_id", "left").join(S.customers(t).select("customer_id", "party_name"), "customer_id")
    return out.select("receipt_id", "receipt_number", "receipt_date", "party_name", "amount",
                      F.coalesce(F.col("app_count"), F.lit(0)).alias("app_count"),
                      F.coalesce(F.col("applied"), F.lit(0)).cast(TOTAL).alias("applied_amount"))


_AR15_SQL = S.with_sql("""
SELECT applied_trx_id, line_number, apply_date,
       CAST(acctd_amount - amount AS DECIMAL(18,2)) AS gain_loss,
       CASE WHEN acctd_amount - amount > 0 THEN 'GAIN' ELSE 'LOSS' END AS gain_loss_type
FROM applications WHERE app_type = 'CASH' AND acctd_amount - amount <> 0""", "applications")


@register("r_ar15_exchange_gain_loss", _AR15_SQL)
def exchange_gain_loss(t: Tables) -> DataFrame:
    """R-AR15: exchange gain/loss per cash application, zero rows dropped."""
    a = S.applications(t).filter(F.col("app_type") == "CASH")
    gl = (F.col("acctd_amount") - F.col("amount")).cast(MONEY)
    return a.filter(gl != 0).select("applied_trx_id", "line_number", "apply_date", gl.alias("gain_loss"),
                                    F.when(gl > 0, "GAIN").otherwise("LOSS").alias("gain_loss_type"))


_AR17_SQL = S.with_sql("""
SELECT applied_trx_id AS trx_id,
       CAST(SUM(CASE WHEN line_status = 'O' THEN amount ELSE 0 END) AS DECIMAL(38,2)) AS tax_withheld,
       CAST(SUM(CASE WHEN line_status = 'F' THEN amount ELSE 0 END) AS DECIMAL(38,2)) AS bank_charges
FROM applications WHERE app_type = 'ADJ' GROUP BY applied_trx_id""", "applications")


@register("r_ar17_adjustments", _AR17_SQL)
def adjustments(t: Tables) -> DataFrame:
    """R-AR17: adjustments per transaction split into tax withheld (open)
    and bank charges (finished) -- conditional-sum pivot (A2)."""
    a = S.applications(t).filter(F.col("app_type") == "ADJ")
    return a.groupBy(F.col("applied_trx_id").alias("trx_id")).agg(
        F.sum(F.when(F.col("line_status") == "O", F.col("amount")).otherwise(0)).cast(TOTAL).alias("tax_withheld"),
        F.sum(F.when(F.col("line_status") == "F", F.col("amount")).otherwise(0)).cast(TOTAL).alias("bank_charges"))


_AR18_SQL = S.with_sql("""
SELECT applied_trx_id AS trx_id, MIN(apply_date) AS first_receipt_date,
       CAST(SUM(amount) AS DECIMAL(38,2)) AS total_received, COUNT(*) AS receipt_lines
FROM applications WHERE app_type = 'CASH' GROUP BY applied_trx_id""", "applications")


@register("r_ar18_first_receipt", _AR18_SQL)
def first_receipt(t: Tables) -> DataFrame:
    """R-AR18: first receipt date and total received per invoice."""
    a = S.applications(t).filter(F.col("app_type") == "CASH")
    return a.groupBy(F.col("applied_trx_id").alias("trx_id")).agg(
        F.min("apply_date").alias("first_receipt_date"), F.sum("amount").cast(TOTAL).alias("total_received"),
        F.count(F.lit(1)).alias("receipt_lines"))


_AR19_SQL = S.with_sql("""
SELECT i.trx_id, i.trx_number,
       CASE WHEN j.n IS NULL THEN 'UNACCOUNTED' WHEN j.posted = j.n THEN 'ACCOUNTED' ELSE 'PARTIAL' END AS accounting_status,
       COALESCE(j.n, 0) AS journal_lines, j.last_gl_date
FROM invoices i LEFT JOIN (SELECT je_header_id, COUNT(*) AS n, SUM(CASE WHEN status = 'P' THEN 1 ELSE 0 END) AS posted,
                                  MAX(gl_date) AS last_gl_date
                           FROM journal_lines GROUP BY je_header_id) j ON i.trx_id = j.je_header_id""",
                      "invoices", "journal_lines")


@register("r_ar19_accounting_status", _AR19_SQL)
def accounting_status(t: Tables) -> DataFrame:
    """R-AR19: accounted / partial / unaccounted per transaction from its
    journal lines (pre-aggregated, then left-joined)."""
    j = S.journal_lines(t).groupBy(F.col("je_header_id").alias("trx_id")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("status") == "P", 1).otherwise(0)).alias("posted"),
        F.max("gl_date").alias("last_gl_date"))
    out = S.invoices(t).select("trx_id", "trx_number").join(j, "trx_id", "left")
    status = (F.when(F.col("n").isNull(), "UNACCOUNTED").when(F.col("posted") == F.col("n"), "ACCOUNTED")
              .otherwise("PARTIAL"))
    return out.select("trx_id", "trx_number", status.alias("accounting_status"),
                      F.coalesce(F.col("n"), F.lit(0)).alias("journal_lines"), "last_gl_date")


_AR20_SQL = S.with_sql("""
SELECT trx_id, trx_date, COALESCE(term_name, 'NONE') AS term_name, COALESCE(due_days, 0) AS due_days, due_date
FROM invoices""", "invoices")


@register("r_ar20_due_date", _AR20_SQL)
def due_dates(t: Tables) -> DataFrame:
    """R-AR20: due date from the payment terms by join (not a scalar subquery)."""
    return S.invoices(t).select("trx_id", "trx_date", F.coalesce(F.col("term_name"), F.lit("NONE")).alias("term_name"),
                                F.coalesce(F.col("due_days"), F.lit(0)).alias("due_days"), "due_date")


_AR21_SQL = S.with_sql("""
SELECT i.trx_id, COALESCE(g.project_id, l.project_id, p.project_id) AS project_id,
       CASE WHEN g.project_id IS NOT NULL THEN 'LEDGER' WHEN l.project_id IS NOT NULL THEN 'LINE'
            WHEN p.project_id IS NOT NULL THEN 'CONTRACT' ELSE 'NONE' END AS project_route
FROM invoices i
LEFT JOIN (SELECT je_header_id, MIN(supplier_id) AS project_id FROM journal_lines WHERE je_source = 'Receivables'
           GROUP BY je_header_id) g ON i.trx_id = g.je_header_id
LEFT JOIN (SELECT applied_trx_id, MIN(supplier_id) AS project_id FROM applications GROUP BY applied_trx_id) l
       ON i.trx_id = l.applied_trx_id
LEFT JOIN (SELECT DISTINCT project_id FROM plan_versions) p ON i.customer_id = p.project_id""",
                      "invoices", "journal_lines", "applications", "plan_versions")


@register("r_ar21_project_attribution", _AR21_SQL)
def project_attribution(t: Tables) -> DataFrame:
    """R-AR21: project of a transaction by three routes (ledger segment,
    invoice line, contract); first route with a value wins (J14)."""
    g = (S.journal_lines(t).filter(F.col("je_source") == "Receivables")
         .groupBy(F.col("je_header_id").alias("trx_id")).agg(F.min("supplier_id").alias("p_gl")))
    ln = S.applications(t).groupBy(F.col("applied_trx_id").alias("trx_id")).agg(F.min("supplier_id").alias("p_line"))
    ct = S.plan_versions(t).select(F.col("project_id").alias("customer_id")).distinct().withColumn(
        "p_contract", F.col("customer_id"))
    x = S.invoices(t).select("trx_id", "customer_id").join(g, "trx_id", "left").join(ln, "trx_id", "left") \
        .join(ct, "customer_id", "left")
    route = (F.when(F.col("p_gl").isNotNull(), "LEDGER").when(F.col("p_line").isNotNull(), "LINE")
             .when(F.col("p_contract").isNotNull(), "CONTRACT").otherwise("NONE"))
    return x.select("trx_id", F.coalesce("p_gl", "p_line", "p_contract").alias("project_id"),
                    route.alias("project_route"))


def _ar22_sql(col: str) -> str:
    days = f"({D(AS_OF)} - ob.{col})"
    conditions = {"b0_30": "BETWEEN -60 AND 30", "b31_60": "BETWEEN 31 AND 60", "b61_90": "BETWEEN 61 AND 90",
                  "b91_120": "BETWEEN 91 AND 120", "b120_plus": "> 120"}
    return S.with_sql(f"""
SELECT ob.customer_id, CAST(SUM(ob.remaining) AS DECIMAL(38,2)) AS total_due,
       {aging.sql_buckets(days, "ob.remaining", conditions)}
FROM {OPEN_BAL_SQL} ob WHERE ob.remaining <> 0 GROUP BY ob.customer_id""", "invoices", "applications")


def _aging_basis(t: Tables, basis: str, widen: int) -> DataFrame:
    """Five buckets by due or invoice date; ``widen`` moves only the lower
    edge of the first bucket, earlier documents count in the total alone."""
    bal = open_balances(t).filter(F.col("remaining") != 0)
    bal = bal.withColumn("days", F.datediff(F.lit(t.params.as_of), F.col("due_date" if basis == "due" else "trx_date")))
    return aging.bucket_totals(bal, ["customer_id"], "days", "remaining", aging.ar_widened(widen))


@register("r_ar22_aging_invoice_date_widened", _ar22_sql("trx_date"))
def aging_invoice_basis(t: Tables) -> DataFrame:
    """R-AR22: aging by invoice date with the optional -60 day widening."""
    return _aging_basis(t, "invoice", 60)


@register("r_ar22_aging_due_date_widened", _ar22_sql("due_date"))
def aging_due_basis(t: Tables) -> DataFrame:
    """R-AR22: aging by due date with the optional -60 day widening."""
    return _aging_basis(t, "due", 60)


_AR7_SQL = S.with_sql(f"""
SELECT c.unit_name, c.account_number, c.party_name, ob.trx_number, ob.trx_date, ob.due_date, ob.class,
       CAST({D(AS_OF)} - ob.due_date AS INTEGER) AS days_overdue,
       CASE WHEN {D(AS_OF)} - ob.due_date < 0 THEN 'Not Yet Due'
            WHEN {D(AS_OF)} - ob.due_date <= 30 THEN 'Bucket 0-30'
            WHEN {D(AS_OF)} - ob.due_date <= 60 THEN 'Bucket 31-60'
            WHEN {D(AS_OF)} - ob.due_date <= 90 THEN 'Bucket 61-90'
            WHEN {D(AS_OF)} - ob.due_date <= 120 THEN 'Bucket 91-120'
            WHEN {D(AS_OF)} - ob.due_date <= 180 THEN 'Bucket 121-180'
            WHEN {D(AS_OF)} - ob.due_date <= 360 THEN 'Bucket 181-360'
            WHEN {D(AS_OF)} - ob.due_date > 360 THEN 'Above 360' ELSE 'Unknown' END AS aging_bucket,
       CAST(ob.remaining AS DECIMAL(38,2)) AS func_remaining,
       {aging.sql_buckets(f"({D(AS_OF)} - ob.due_date)", "ob.remaining", _SQL_EIGHT, total=False)}
FROM {OPEN_BAL_SQL} ob JOIN customers c ON ob.customer_id = c.customer_id
JOIN invoices i ON i.trx_id = ob.trx_id AND i.complete_flag = 'Y'
WHERE ob.remaining <> 0""", "invoices", "applications", "customers")


@register("r_ar7_transaction_aging_8", _AR7_SQL)
def transaction_aging_8(t: Tables) -> DataFrame:
    """R-AR7: one row per open complete transaction with its 8-bucket
    position; the test tables hold no sites, so the unit stands for the place."""
    bal = open_balances(t).filter((F.col("remaining") != 0) & (F.col("complete_flag") == "Y"))
    days = F.datediff(F.lit(t.params.as_of), F.col("due_date"))
    label = F.coalesce(aging.AR_EIGHT.label(days), F.lit("Unknown"))
    cols = [F.when(label == F.lit(name), F.col("remaining")).otherwise(F.lit(0)).cast(TOTAL).alias(col)
            for name, col, _, _ in aging.AR_EIGHT.buckets]
    j = bal.join(S.customers(t).select("customer_id", "unit_name", "account_number", "party_name"), "customer_id")
    return j.select("unit_name", "account_number", "party_name", "trx_number", "trx_date", "due_date", "class",
                    days.alias("days_overdue"), label.alias("aging_bucket"),
                    F.col("remaining").cast(TOTAL).alias("func_remaining"), *cols)


_AR23_SQL = S.with_sql("""
SELECT applied_trx_id, line_number, app_type,
       CASE WHEN acctd_amount <> amount THEN 'Y' ELSE 'N' END AS gain_loss_flag,
       CASE WHEN app_type = 'CM' AND line_status = 'F' THEN 'Y' ELSE 'N' END AS refund_flag,
       amount
FROM applications WHERE app_type IN ('CASH', 'CM')""", "applications")


@register("r_ar23_application_typing", _AR23_SQL)
def application_typing(t: Tables) -> DataFrame:
    """R-AR23: receipt application typing -- gain/loss and refund flags."""
    a = S.applications(t).filter(F.col("app_type").isin("CASH", "CM"))
    return a.select("applied_trx_id", "line_number", "app_type",
                    F.when(F.col("acctd_amount") != F.col("amount"), "Y").otherwise("N").alias("gain_loss_flag"),
                    F.when((F.col("app_type") == "CM") & (F.col("line_status") == "F"), "Y").otherwise("N")
                    .alias("refund_flag"), "amount")


_AR24_SQL = S.with_sql(f"""
SELECT r.customer_id, CAST(SUM(r.amount) AS DECIMAL(38,2)) AS received,
       {aging.sql_buckets(f"({D(AS_OF)} - r.receipt_date)", "r.amount", _SQL_FIVE)}
FROM receipts r WHERE r.receipt_date <= {D(AS_OF)} GROUP BY r.customer_id""", "receipts")


@register("r_ar24_aging_by_receipt_date", _AR24_SQL)
def aging_by_receipt(t: Tables) -> DataFrame:
    """R-AR24: receipts aged by receipt date, 5 buckets per customer."""
    r = S.receipts(t).filter(F.col("receipt_date") <= F.lit(t.params.as_of)).withColumn(
        "days", F.datediff(F.lit(t.params.as_of), F.col("receipt_date")))
    return aging.bucket_totals(r, ["customer_id"], "days", "amount", aging.AR_FIVE, "received")


# ---------------------------------------------------------------------------
# R-AR6: customer statement summary; R-AR10: statement of account
# ---------------------------------------------------------------------------

_AR6_SQL = S.with_sql(f"""
SELECT c.customer_id, c.party_name,
       CAST(COALESCE(o.opening_balance, 0) AS DECIMAL(38,2)) AS opening_balance,
       CAST(COALESCE(SUM(CASE WHEN d.doc_type = 'INVOICE' THEN d.amount END), 0) AS DECIMAL(38,2)) AS invoices,
       CAST(COALESCE(SUM(CASE WHEN d.doc_type = 'CREDIT_MEMO' THEN d.amount END), 0) AS DECIMAL(38,2)) AS credit_memos,
       CAST(COALESCE(SUM(CASE WHEN d.doc_type = 'RECEIPT' THEN d.amount END), 0) AS DECIMAL(38,2)) AS receipts,
       CAST(COALESCE(o.opening_balance, 0) + COALESCE(SUM(d.amount), 0) AS DECIMAL(38,2)) AS closing_balance
FROM (SELECT customer_id, CASE WHEN class = 'CM' THEN 'CREDIT_MEMO' ELSE 'INVOICE' END AS doc_type,
             ROUND(amount * COALESCE(exchange_rate, 1), 2) AS amount
      FROM invoices WHERE complete_flag = 'Y' AND trx_date BETWEEN {D(PERIOD_FROM)} AND {D(PERIOD_TO)}
      UNION ALL
      SELECT customer_id, 'RECEIPT', -ROUND(amount * COALESCE(exchange_rate, 1), 2) FROM receipts r
      WHERE receipt_date BETWEEN {D(PERIOD_FROM)} AND {D(PERIOD_TO)}
        AND NOT EXISTS (SELECT 1 FROM receipt_history h WHERE h.receipt_id = r.receipt_id AND h.status = 'REVERSED')) d
JOIN customers c ON c.customer_id = d.customer_id
LEFT JOIN (SELECT customer_id, SUM(amount) AS opening_balance FROM (
             SELECT customer_id, ROUND(amount * COALESCE(exchange_rate, 1), 2) AS amount FROM invoices
             WHERE trx_date < {D(PERIOD_FROM)} AND complete_flag = 'Y'
             UNION ALL
             SELECT customer_id, -ROUND(amount * COALESCE(exchange_rate, 1), 2) FROM receipts r
             WHERE receipt_date < {D(PERIOD_FROM)}
               AND NOT EXISTS (SELECT 1 FROM receipt_history h WHERE h.receipt_id = r.receipt_id AND h.status = 'REVERSED')) x
           GROUP BY customer_id) o ON o.customer_id = d.customer_id
GROUP BY c.customer_id, c.party_name, o.opening_balance""", "invoices", "receipts", "receipt_history", "customers")


@register("r_ar6_customer_statement", _AR6_SQL)
def customer_statement(t: Tables) -> DataFrame:
    """R-AR6: opening balance plus three movement types (invoices, credit
    memos, receipts) of the period and the closing balance per customer.
    The opening filters the transaction date itself (§8 #6).  One
    conditional-sum pass over the movement stream."""
    mv = customer_movements(t).filter(F.col("gl_date") <= F.lit(t.params.date_to))
    in_p = F.col("gl_date") >= F.lit(t.params.date_from)
    kind = lambda k: F.coalesce(F.sum(F.when(in_p & (F.col("doc_type") == k), F.col("func_amount"))),
                                F.lit(0)).cast(TOTAL)
    g = mv.groupBy("customer_id").agg(
        F.sum(F.when(~in_p, F.col("func_amount"))).alias("opening_raw"),
        kind("INVOICE").alias("invoices"), kind("CREDIT_MEMO").alias("credit_memos"), kind("RECEIPT").alias("receipts"),
        F.sum(F.when(in_p, F.col("func_amount"))).alias("moves"), F.max(F.when(in_p, F.lit(1))).alias("active"))
    g = g.filter(F.col("active") == 1).join(S.customers(t).select("customer_id", "party_name"), "customer_id")
    op = F.coalesce("opening_raw", F.lit(0))
    return g.select("customer_id", "party_name", op.cast(TOTAL).alias("opening_balance"), "invoices", "credit_memos",
                    "receipts", (op + F.col("moves")).cast(TOTAL).alias("closing_balance"))


_AR10_SQL = S.with_sql(f"""
SELECT i.trx_id, i.customer_id, CAST(ROUND(i.amount * COALESCE(i.exchange_rate, 1), 2) AS DECIMAL(38,2)) AS rec_amount,
       CAST(COALESCE(p.paid, 0) AS DECIMAL(38,2)) AS paid,
       CAST(ROUND(i.amount * COALESCE(i.exchange_rate, 1), 2) - COALESCE(p.paid, 0) AS DECIMAL(38,2)) AS balance,
       {aging.sql_buckets(f"({D(AS_OF)} - i.due_date)", "ROUND(i.amount * COALESCE(i.exchange_rate, 1), 2) - COALESCE(p.paid, 0)", _SQL_FIVE, total=False)}
FROM invoices i
LEFT JOIN (SELECT applied_trx_id, SUM(amount) AS paid FROM applications
           WHERE app_type = 'CASH' AND apply_date <= {D(AS_OF)}
             AND applied_trx_id NOT IN (SELECT receipt_id FROM receipt_history WHERE status = 'REVERSED')
           GROUP BY applied_trx_id) p ON p.applied_trx_id = i.trx_id
WHERE i.trx_date <= {D(AS_OF)} AND i.class = 'INV'
  AND NOT (ROUND(i.amount * COALESCE(i.exchange_rate, 1), 2) - COALESCE(p.paid, 0) BETWEEN 0 AND 0.5)""",
                       "invoices", "applications", "receipt_history")


@register("r_ar10_statement_of_account", _AR10_SQL)
def statement_of_account(t: Tables) -> DataFrame:
    """R-AR10: receivable amount, paid (receipts not reversed, null-aware
    NOT IN, J5), balance and its 5-bucket position per invoice; balances
    within 0..0.5 suppressed (F10)."""
    from tallyspark.operators.joins import not_in
    cash = S.applications(t).filter((F.col("app_type") == "CASH") & (F.col("apply_date") <= F.lit(t.params.as_of)))
    rev = S.receipt_history(t).filter(F.col("status") == "REVERSED")
    paid = not_in(cash, "applied_trx_id", rev, "receipt_id").groupBy(F.col("applied_trx_id").alias("trx_id")) \
        .agg(F.sum("amount").alias("paid"))
    inv = S.invoices(t).filter((F.col("trx_date") <= F.lit(t.params.as_of)) & (F.col("class") == "INV"))
    j = inv.join(paid, "trx_id", "left")
    rec = _func()
    bal = rec - F.coalesce("paid", F.lit(0))
    j = j.filter(~bal.between(0, 0.5))
    lab = aging.AR_FIVE.label(F.datediff(F.lit(t.params.as_of), F.col("due_date")))
    buckets = [F.when(lab == F.lit(label), bal).otherwise(F.lit(0)).cast(TOTAL).alias(c)
               for label, c, _, _ in aging.AR_FIVE.buckets]
    return j.select("trx_id", "customer_id", rec.cast(TOTAL).alias("rec_amount"),
                    F.coalesce("paid", F.lit(0)).cast(TOTAL).alias("paid"), bal.cast(TOTAL).alias("balance"), *buckets)


_CM3_SQL = S.with_sql(f"""
SELECT r.receipt_id, r.receipt_number, r.receipt_date, r.org_id AS bank_account_id, c.party_name, r.amount
FROM receipts r JOIN customers c ON c.customer_id = r.customer_id
WHERE r.receipt_date BETWEEN {D(PERIOD_FROM)} AND {D(PERIOD_TO)}
  AND NOT EXISTS (SELECT 1 FROM receipt_history h WHERE h.receipt_id = r.receipt_id AND h.status = 'REVERSED')""",
                      "receipts", "customers", "receipt_history")


@register("r_cm3_receipt_vouchers", _CM3_SQL)
def receipt_vouchers(t: Tables) -> DataFrame:
    """R-CM3: receipt voucher list of the period (J2 + J4)."""
    r = S.receipts(t).filter(F.col("receipt_date").between(F.lit(t.params.date_from), F.lit(t.params.date_to)))
    r = r.join(S.receipt_history(t).filter(F.col("status") == "REVERSED").select("receipt_id"), "receipt_id", "left_anti")
    c = S.customers(t).select("customer_id", "party_name")
    return r.join(c, "customer_id").select("receipt_id", "receipt_number", "receipt_date",
                                           F.col("org_id").alias("bank_account_id"), "party_name", "amount")


# Tax codes by rate (percent) used on the lines.
TAX_CODES = list(range(0, 9))


@register("r_ar16_tax_by_type", S.with_sql(", ".join(
    ["SELECT applied_trx_id AS trx_id"]
    + [f"CAST(SUM(CASE WHEN tax_rate = {p / 100:.2f} THEN acctd_amount - amount ELSE 0 END) AS DECIMAL(38,2)) AS tax_{p}pct"
       for p in TAX_CODES]
    + ["CAST(SUM(acctd_amount - amount) AS DECIMAL(38,2)) AS total_tax"]) + " FROM applications GROUP BY applied_trx_id",
    "applications"))
def tax_by_type(t: Tables) -> DataFrame:
    """R-AR16: tax per transaction split by tax type (rate code), one
    conditional-sum column per code (A2)."""
    from decimal import Decimal
    a = S.applications(t)
    tax = F.col("acctd_amount") - F.col("amount")
    cols = [F.sum(F.when(F.col("tax_rate") == F.lit(Decimal(p) / 100).cast("decimal(4,2)"), tax).otherwise(0))
            .cast(TOTAL).alias(f"tax_{p}pct") for p in TAX_CODES]
    return a.groupBy(F.col("applied_trx_id").alias("trx_id")).agg(*cols, F.sum(tax).cast(TOTAL).alias("total_tax"))
