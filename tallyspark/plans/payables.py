"""Payables reports (R-AP*).

Stand-ins (FIXTURES part 2 extended): a supplier invoice is the set of line
items of one order from one supplier; cash lines (A) are payments, open
adjustments (N) are prepayment applications.  Both are pre-aggregated per
invoice before any join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.params import AS_OF, PERIOD_FROM, PERIOD_TO
from tallyspark.functions.scalars import MONEY, TOTAL, cents
from tallyspark.operators import aging, joins, quality, windows
from tallyspark.operators.rollup import debit_credit
from tallyspark.plans.registry import register
from tallyspark.sources import standins as S
from tallyspark.sources.tables import Tables

D = S._d


def ap_invoices(t: Tables) -> DataFrame:
    """Supplier invoice per (order, supplier); due 30 days after the date."""
    a = S.applications(t)
    g = a.groupBy(F.col("applied_trx_id").alias("order_id"), F.col("supplier_id").alias("vendor_id")).agg(
        F.min("apply_date").alias("invoice_date"),
        F.sum("gross_amount").cast(MONEY).alias("invoice_amount"),
        F.max("line_status").alias("max_status"))
    return g.select(
        "order_id", "vendor_id",
        F.concat(F.col("order_id").cast("string"), F.lit("-"), F.col("vendor_id").cast("string")).alias("invoice_num"),
        "invoice_date", F.date_add("invoice_date", 30).alias("due_date"), "invoice_amount",
        F.when(F.col("max_status") == "F", "APPROVED").otherwise("PENDING").alias("approval_status"))


S._cte("ap_invoices", ("applications",), """
SELECT order_id, vendor_id, CAST(order_id AS VARCHAR) || '-' || CAST(vendor_id AS VARCHAR) AS invoice_num,
       invoice_date, CAST(invoice_date + 30 AS DATE) AS due_date, invoice_amount,
       CASE WHEN max_status = 'F' THEN 'APPROVED' ELSE 'PENDING' END AS approval_status
FROM (SELECT applied_trx_id AS order_id, supplier_id AS vendor_id, MIN(apply_date) AS invoice_date,
             CAST(SUM(gross_amount) AS DECIMAL(18,2)) AS invoice_amount, MAX(line_status) AS max_status
      FROM applications GROUP BY applied_trx_id, supplier_id) g""")


def ap_payments(t: Tables) -> DataFrame:
    """Payment lines (A) and prepayment applications (N) per invoice."""
    a = S.applications(t).filter(F.col("return_flag").isin("A", "N"))
    return a.select(F.col("applied_trx_id").alias("order_id"), F.col("supplier_id").alias("vendor_id"),
                    F.when(F.col("return_flag") == "A", "PAYMENT").otherwise("PREPAY").alias("pay_type"),
                    F.col("apply_date").alias("pay_date"), "amount", "discount_taken")


S._cte("ap_payments", ("applications",), """
SELECT applied_trx_id AS order_id, supplier_id AS vendor_id,
       CASE WHEN return_flag = 'A' THEN 'PAYMENT' ELSE 'PREPAY' END AS pay_type,
       apply_date AS pay_date, amount, discount_taken
FROM applications WHERE return_flag IN ('A', 'N')""")


def invoice_balances(t: Tables, as_of=None) -> DataFrame:
    """Invoice amount and what was paid / prepaid on it by the date, in ONE
    aggregation pass over the lines (invoice and payments share the key
    (order, supplier)), instead of two scans joined back together."""
    as_of = as_of or t.params.as_of
    a = S.applications(t)
    upto = F.col("apply_date") <= F.lit(as_of)
    g = a.groupBy(F.col("applied_trx_id").alias("order_id"), F.col("supplier_id").alias("vendor_id")).agg(
        F.min("apply_date").alias("invoice_date"),
        F.sum("gross_amount").cast(MONEY).alias("invoice_amount"),
        F.sum(F.when(upto & (F.col("return_flag") == "A"), F.col("amount")).otherwise(0)).alias("paid"),
        F.sum(F.when(upto & (F.col("return_flag") == "N"), F.col("amount")).otherwise(0)).alias("prepaid"))
    return g.withColumn("due_date", F.date_add("invoice_date", 30))


_PAID_SQL = f"""(SELECT order_id, vendor_id,
   SUM(CASE WHEN pay_type = 'PAYMENT' THEN amount ELSE 0 END) AS paid,
   SUM(CASE WHEN pay_type = 'PREPAY' THEN amount ELSE 0 END) AS prepaid
 FROM ap_payments WHERE pay_date <= {D(AS_OF)} GROUP BY order_id, vendor_id)"""


# Oracle conditions on days past due, written out by hand.
_SQL_FOURTEEN = {"not_due": "< 0", "b0_7": "BETWEEN 0 AND 7", "b8_15": "BETWEEN 8 AND 15",
                 "b16_30": "BETWEEN 16 AND 30", "b31_45": "BETWEEN 31 AND 45", "b46_60": "BETWEEN 46 AND 60",
                 "b61_75": "BETWEEN 61 AND 75", "b76_90": "BETWEEN 76 AND 90", "b91_120": "BETWEEN 91 AND 120",
                 "b121_150": "BETWEEN 121 AND 150", "b151_180": "BETWEEN 151 AND 180",
                 "b181_360": "BETWEEN 181 AND 360", "b361_720": "BETWEEN 361 AND 720", "above_720": "> 720"}

_AP1_SQL = S.with_sql(f"""
SELECT x.vendor_id, s.vendor_name, CAST(SUM(x.outstanding) AS DECIMAL(38,2)) AS total_outstanding,
       {aging.sql_buckets(f"({D(AS_OF)} - x.due_date)", "x.outstanding", _SQL_FOURTEEN)}
FROM (SELECT i.vendor_id, i.due_date,
             i.invoice_amount - COALESCE(p.paid, 0) - COALESCE(p.prepaid, 0) AS outstanding
      FROM ap_invoices i LEFT JOIN {_PAID_SQL} p ON i.order_id = p.order_id AND i.vendor_id = p.vendor_id
      WHERE i.invoice_date <= {D(AS_OF)}) x
JOIN suppliers s ON s.supplier_id = x.vendor_id
WHERE x.outstanding <> 0
GROUP BY x.vendor_id, s.vendor_name""", "ap_invoices", "ap_payments", "suppliers")


@register("r_ap1_supplier_aging_14", _AP1_SQL)
def supplier_aging(t: Tables) -> DataFrame:
    """R-AP1: supplier aging at a date, 14 buckets, prepayments netted.
    Invoice and payment amounts come from one aggregation pass."""
    x = invoice_balances(t).filter(F.col("invoice_date") <= F.lit(t.params.as_of))
    x = x.withColumn("outstanding", F.col("invoice_amount") - F.col("paid") - F.col("prepaid"))
    x = x.filter(F.col("outstanding") != 0).withColumn("days", F.datediff(F.lit(t.params.as_of), F.col("due_date")))
    per = aging.bucket_totals(x, ["vendor_id"], "days", "outstanding", aging.AP_FOURTEEN, "total_outstanding")
    s = S.suppliers(t).select(F.col("supplier_id").alias("vendor_id"), "vendor_name")
    return per.join(s, "vendor_id")


_AP2_SQL = S.with_sql(f"""
SELECT i.invoice_num, i.invoice_date, i.vendor_id, s.vendor_name, i.invoice_amount, i.approval_status,
       p.last_payment_date, CAST(COALESCE(p.paid, 0) AS DECIMAL(38,2)) AS paid_amount
FROM ap_invoices i JOIN suppliers s ON s.supplier_id = i.vendor_id
LEFT JOIN (SELECT order_id, vendor_id, MAX(pay_date) AS last_payment_date, SUM(amount) AS paid
           FROM ap_payments WHERE pay_type = 'PAYMENT' GROUP BY order_id, vendor_id) p
  ON p.order_id = i.order_id AND p.vendor_id = i.vendor_id
WHERE i.invoice_date BETWEEN {D(PERIOD_FROM)} AND {D(PERIOD_TO)}""", "ap_invoices", "ap_payments", "suppliers")


@register("r_ap2_invoice_register", _AP2_SQL)
def invoice_register(t: Tables) -> DataFrame:
    """R-AP2: invoices of the period with approval and payment status."""
    inv = ap_invoices(t).filter(F.col("invoice_date").between(F.lit(t.params.date_from), F.lit(t.params.date_to)))
    pay = (ap_payments(t).filter(F.col("pay_type") == "PAYMENT").groupBy("order_id", "vendor_id")
           .agg(F.max("pay_date").alias("last_payment_date"), F.sum("amount").alias("paid")))
    s = S.suppliers(t).select(F.col("supplier_id").alias("vendor_id"), "vendor_name")
    x = inv.join(s, "vendor_id").join(pay, ["order_id", "vendor_id"], "left")
    return x.select("invoice_num", "invoice_date", "vendor_id", "vendor_name", "invoice_amount", "approval_status",
                    "last_payment_date", F.coalesce("paid", F.lit(0)).cast(TOTAL).alias("paid_amount"))


_AP3_SQL = S.with_sql(f"""
SELECT vendor_id,
       CAST(SUM(CASE WHEN kind = 'INVOICE' THEN amount ELSE 0 END) AS DECIMAL(38,2)) AS invoiced,
       CAST(SUM(CASE WHEN kind = 'PAYMENT' THEN -amount ELSE 0 END) AS DECIMAL(38,2)) AS paid,
       CAST(CASE WHEN SUM(amount) > 0 THEN SUM(amount) ELSE 0 END AS DECIMAL(38,2)) AS net_credit,
       CAST(CASE WHEN SUM(amount) < 0 THEN -SUM(amount) ELSE 0 END AS DECIMAL(38,2)) AS net_debit
FROM (SELECT vendor_id, 'INVOICE' AS kind, invoice_amount AS amount FROM ap_invoices
      WHERE invoice_date BETWEEN {D(PERIOD_FROM)} AND {D(PERIOD_TO)}
      UNION ALL
      SELECT vendor_id, 'PAYMENT', -amount FROM ap_payments
      WHERE pay_type = 'PAYMENT' AND pay_date BETWEEN {D(PERIOD_FROM)} AND {D(PERIOD_TO)}) u
GROUP BY vendor_id""", "ap_invoices", "ap_payments")


@register("r_ap3_supplier_ledger", _AP3_SQL)
def supplier_ledger(t: Tables) -> DataFrame:
    """R-AP3: invoices and payments of the period per supplier (O4), with
    the net split into credit/debit by sign (A10)."""
    inv = ap_invoices(t).filter(F.col("invoice_date").between(F.lit(t.params.date_from), F.lit(t.params.date_to))) \
        .select("vendor_id", F.lit("INVOICE").alias("kind"), F.col("invoice_amount").alias("amount"))
    pay = ap_payments(t).filter((F.col("pay_type") == "PAYMENT") & F.col("pay_date").between(F.lit(t.params.date_from), F.lit(t.params.date_to))) \
        .select("vendor_id", F.lit("PAYMENT").alias("kind"), (-F.col("amount")).alias("amount"))
    g = inv.unionByName(pay).groupBy("vendor_id").agg(
        F.sum(F.when(F.col("kind") == "INVOICE", F.col("amount")).otherwise(0)).cast(TOTAL).alias("invoiced"),
        F.sum(F.when(F.col("kind") == "PAYMENT", -F.col("amount")).otherwise(0)).cast(TOTAL).alias("paid"),
        F.sum("amount").alias("net"))
    cr, dr = debit_credit("net")
    return g.select("vendor_id", "invoiced", "paid", cr.cast(TOTAL).alias("net_credit"), dr.cast(TOTAL).alias("net_debit"))


_AP6_SQL = S.with_sql(f"""
SELECT i.invoice_num, i.vendor_id, i.invoice_amount,
       CAST(COALESCE(p.paid, 0) AS DECIMAL(38,2)) AS paid_at_date,
       CAST(i.invoice_amount - COALESCE(p.paid, 0) AS DECIMAL(38,2)) AS outstanding,
       {D(AS_OF)} - i.due_date AS days_past_due
FROM ap_invoices i LEFT JOIN {_PAID_SQL} p ON i.order_id = p.order_id AND i.vendor_id = p.vendor_id
WHERE i.invoice_date <= {D(AS_OF)} AND i.invoice_amount - COALESCE(p.paid, 0) <> 0""", "ap_invoices", "ap_payments")


@register("r_ap6_outstanding_at_date", _AP6_SQL)
def outstanding_at_date(t: Tables) -> DataFrame:
    """R-AP6: invoice total less paid at the date (A12), days past due, non-zero (A4)."""
    x = invoice_balances(t).filter(F.col("invoice_date") <= F.lit(t.params.as_of))
    x = x.withColumn("invoice_num", F.concat(F.col("order_id").cast("string"), F.lit("-"), F.col("vendor_id").cast("string")))
    out = F.col("invoice_amount") - F.col("paid")
    return x.filter(out != 0).select(
        "invoice_num", "vendor_id", "invoice_amount", F.col("paid").cast(TOTAL).alias("paid_at_date"),
        out.cast(TOTAL).alias("outstanding"), F.datediff(F.lit(t.params.as_of), F.col("due_date")).cast("bigint").alias("days_past_due"))


_AP7_SQL = S.with_sql("""
SELECT order_id, vendor_id, CAST(SUM(amount) AS DECIMAL(38,2)) AS prepayment_applied, COUNT(*) AS applications
FROM ap_payments WHERE pay_type = 'PREPAY' GROUP BY order_id, vendor_id""", "ap_payments")


@register("r_ap7_prepayment_applied", _AP7_SQL)
def prepayment_applied(t: Tables) -> DataFrame:
    """R-AP7: prepayment applied per invoice pair (prepayment -> invoice)."""
    p = ap_payments(t).filter(F.col("pay_type") == "PREPAY")
    return p.groupBy("order_id", "vendor_id").agg(F.sum("amount").cast(TOTAL).alias("prepayment_applied"),
                                                  F.count(F.lit(1)).alias("applications"))


# Stand-ins: a supplier's prepayment invoices are its lines returned with
# flag R (money paid ahead, not yet used); its standard invoices take them up.
S._cte("prepayments", ("applications",), """
SELECT supplier_id AS vendor_id, applied_trx_id AS prepay_id, MIN(apply_date) AS prepay_date, CAST(SUM(gross_amount) AS DECIMAL(18,2)) AS amount
FROM applications WHERE return_flag = 'R' GROUP BY supplier_id, applied_trx_id HAVING SUM(gross_amount) > 0""")


def prepayments(t: Tables) -> DataFrame:
    """One prepayment per (order, supplier) with lines returned (flag R)."""
    a = S.applications(t).filter(F.col("return_flag") == "R")
    g = a.groupBy(F.col("supplier_id").alias("vendor_id"), F.col("applied_trx_id").alias("prepay_id")).agg(
        F.min("apply_date").alias("prepay_date"), F.sum("gross_amount").cast(MONEY).alias("amount"))
    return g.filter("amount > 0")


# In hundredths: a supplier's prepayments and invoices laid end to end, each a
# stretch of the supplier's money; a pair applies as much as the stretches share.
_PAIRS_SQL = S.with_sql(f"""
SELECT p.vendor_id, p.prepay_id, i.order_id AS invoice_id, p.prepay_date, i.invoice_date,
       CAST(CAST(LEAST(p.upto, i.upto) - GREATEST(p.upto - p.cents, i.upto - i.cents) AS DECIMAL(20,0)) * CAST(0.01 AS DECIMAL(2,2)) AS DECIMAL(38,2)) AS applied_amount
FROM (SELECT *, CAST(amount * 100 AS BIGINT) AS cents,
             SUM(CAST(amount * 100 AS BIGINT)) OVER (PARTITION BY vendor_id ORDER BY prepay_date, prepay_id ROWS UNBOUNDED PRECEDING) AS upto
      FROM prepayments WHERE prepay_date <= {D(AS_OF)}) p
JOIN (SELECT *, CAST(invoice_amount * 100 AS BIGINT) AS cents,
             SUM(CAST(invoice_amount * 100 AS BIGINT)) OVER (PARTITION BY vendor_id ORDER BY invoice_date, order_id ROWS UNBOUNDED PRECEDING) AS upto
      FROM ap_invoices WHERE invoice_date <= {D(AS_OF)} AND approval_status = 'APPROVED' AND invoice_amount > 0) i
  ON i.vendor_id = p.vendor_id AND p.upto - p.cents < i.upto AND i.upto - i.cents < p.upto""", "prepayments", "ap_invoices")


@register("r_ap7_prepayment_pairs", _PAIRS_SQL)
def prepayment_pairs(t: Tables) -> DataFrame:
    """R-AP7/J12: which prepayment pays how much of which invoice at the date.

    A supplier's prepayments, oldest first, are used up by its approved
    invoices, oldest first.  Both are laid end to end by skew-safe running
    totals; a pair applies the overlap of its two stretches, so a pair's sum
    is exact and neither side is overdrawn."""
    p = prepayments(t).filter(F.col("prepay_date") <= F.lit(t.params.as_of))
    i = ap_invoices(t).filter((F.col("invoice_date") <= F.lit(t.params.as_of)) & (F.col("approval_status") == "APPROVED") & (F.col("invoice_amount") > 0))
    left = p.select("vendor_id", "prepay_id", "prepay_date", cents("amount").alias("cents"))
    right = i.select("vendor_id", F.col("order_id").alias("invoice_id"), "invoice_date", cents("invoice_amount").alias("cents"))
    left = windows.running_total(left, ["vendor_id"], ["prepay_date", "prepay_id"], F.col("cents"), "upto", chunk="prepay_date")
    right = windows.running_total(right, ["vendor_id"], ["invoice_date", "invoice_id"], F.col("cents"), "upto", chunk="invoice_date")
    both = joins.stretch_overlaps(left, right, ["vendor_id"])
    return both.select("vendor_id", "prepay_id", "invoice_id", "prepay_date", "invoice_date",
                       (F.col("overlap").cast("decimal(20,0)") * F.lit("0.01").cast("decimal(2,2)")).cast(TOTAL).alias("applied_amount"))


_AP8_SQL = S.with_sql("""
SELECT applied_trx_id AS order_id, supplier_id AS vendor_id, COUNT(*) AS active_holds
FROM applications WHERE return_flag = 'R' AND line_status = 'O' GROUP BY applied_trx_id, supplier_id""", "applications")


@register("r_ap8_active_holds", _AP8_SQL)
def active_holds(t: Tables) -> DataFrame:
    """R-AP8: active (unreleased) holds per invoice -- returned, still open lines."""
    a = S.applications(t).filter((F.col("return_flag") == "R") & (F.col("line_status") == "O"))
    return a.groupBy(F.col("applied_trx_id").alias("order_id"), F.col("supplier_id").alias("vendor_id")) \
        .agg(F.count(F.lit(1)).alias("active_holds"))


@register("r_ap8_all_holds", S.with_sql("""
SELECT applied_trx_id AS order_id, supplier_id AS vendor_id, COUNT(*) AS holds,
       CAST(SUM(CASE WHEN line_status = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS active_holds,
       CAST(SUM(CASE WHEN line_status = 'O' THEN 0 ELSE 1 END) AS BIGINT) AS released_holds, MIN(apply_date) AS first_hold_date
FROM applications WHERE return_flag = 'R' GROUP BY applied_trx_id, supplier_id""", "applications"))
def all_holds(t: Tables) -> DataFrame:
    """R-AP8 in its "all" mode: active and released holds per invoice (a hold
    is a returned line, released once the line is no longer open)."""
    a = S.applications(t).filter(F.col("return_flag") == "R")
    open_ = F.when(F.col("line_status") == "O", 1).otherwise(0)
    return a.groupBy(F.col("applied_trx_id").alias("order_id"), F.col("supplier_id").alias("vendor_id")).agg(
        F.count(F.lit(1)).alias("holds"), F.sum(open_).alias("active_holds"), F.sum(1 - open_).alias("released_holds"),
        F.min("apply_date").alias("first_hold_date"))


_AP9_SQL = S.with_sql("""
SELECT COALESCE(i.order_id, j.order_id) AS order_id, CAST(i.inv AS DECIMAL(38,2)) AS invoice_total,
       CAST(j.liab AS DECIMAL(38,2)) AS liability_total,
       CAST(COALESCE(i.inv, 0) - COALESCE(j.liab, 0) AS DECIMAL(38,2)) AS difference
FROM (SELECT order_id, SUM(invoice_amount) AS inv FROM ap_invoices GROUP BY order_id) i
FULL OUTER JOIN (SELECT je_header_id AS order_id, SUM(COALESCE(accounted_dr, 0) + COALESCE(accounted_cr, 0)) AS liab
                 FROM journal_lines GROUP BY je_header_id) j ON i.order_id = j.order_id
WHERE abs(COALESCE(i.inv, 0) - COALESCE(j.liab, 0)) > 0.01""", "ap_invoices", "journal_lines")


@register("r_ap9_subledger_reconciliation", _AP9_SQL)
def subledger_reconciliation(t: Tables) -> DataFrame:
    """R-AP9 / Q6: invoice totals vs accounted liability lines per invoice
    (full outer compare, tolerance 0.01)."""
    inv = ap_invoices(t).groupBy("order_id").agg(F.sum("invoice_amount").alias("inv"))
    jl = S.journal_lines(t).groupBy(F.col("je_header_id").alias("order_id")).agg(
        F.sum(F.coalesce("accounted_dr", F.lit(0)) + F.coalesce("accounted_cr", F.lit(0))).alias("liab"))
    d = quality.tie_out(inv, jl, ["order_id"], "inv", "liab")
    return d.select("order_id", F.col("inv").cast(TOTAL).alias("invoice_total"),
                    F.col("liab").cast(TOTAL).alias("liability_total"), F.col("difference").cast(TOTAL).alias("difference"))


_AP10_SQL = S.with_sql("""
SELECT i.order_id, i.vendor_id, MAX(a.line_status || '-' || CAST(a.line_number AS VARCHAR)) AS max_text_approver,
       arg_max('APPROVER-' || CAST(a.part_id AS VARCHAR), (a.apply_date, a.line_number, a.part_id)) AS latest_approver
FROM ap_invoices i JOIN applications a ON a.applied_trx_id = i.order_id AND a.supplier_id = i.vendor_id
GROUP BY i.order_id, i.vendor_id""", "ap_invoices", "applications")


@register("r_ap10_latest_approver", _AP10_SQL)
def latest_approver(t: Tables) -> DataFrame:
    """R-AP10: latest approver per invoice (max_by), beside the reference's
    MAX-over-text label (A16)."""
    a = S.applications(t).select(F.col("applied_trx_id").alias("order_id"), F.col("supplier_id").alias("vendor_id"),
                                 "line_status", "line_number", "part_id", "apply_date")
    g = a.groupBy("order_id", "vendor_id").agg(
        F.max(F.concat(F.col("line_status"), F.lit("-"), F.col("line_number").cast("string"))).alias("max_text_approver"),
        F.max_by(F.concat(F.lit("APPROVER-"), F.col("part_id").cast("string")),
                 F.struct("apply_date", "line_number", "part_id")).alias("latest_approver"))
    return g.join(ap_invoices(t).select("order_id", "vendor_id"), ["order_id", "vendor_id"], "left_semi")


# ---------------------------------------------------------------------------
# R-AP5: complete supplier ledger -- opening block + period block
# ---------------------------------------------------------------------------

def _ap_movements(t: Tables) -> DataFrame:
    """Signed supplier movements (credit positive = owed to the supplier):
    invoice, debit memo (returned lines), payment, prepayment applied,
    discount taken, tax on payments.  The invoice rows come from the
    invoice aggregate; the five line-level movement types from ONE pass over
    the lines (each line emits its movements with ``explode``)."""
    a = S.applications(t)
    inv = ap_invoices(t).select("vendor_id", F.col("invoice_date").alias("mv_date"),
                                F.lit("INVOICE").alias("movement_type"), F.col("invoice_amount").alias("amount"))
    flag = F.col("return_flag")

    def mv(cond, kind, amt):
        return F.when(cond, F.struct(F.lit(kind).alias("movement_type"), (-amt).cast(MONEY).alias("amount")))

    moves = F.array(mv(flag == "R", "DEBIT_MEMO", F.col("gross_amount")),
                    mv(flag == "A", "PAYMENT", F.col("amount")),
                    mv(flag == "N", "PREPAYMENT", F.col("amount")),
                    mv(flag == "A", "DISCOUNT", F.col("discount_taken")),
                    mv(flag == "A", "TAX", F.col("acctd_amount") - F.col("amount")))
    lines = (a.select(F.col("supplier_id").alias("vendor_id"), F.col("apply_date").alias("mv_date"),
                      F.explode(moves).alias("m"))
             .filter(F.col("m").isNotNull()).select("vendor_id", "mv_date", "m.movement_type", "m.amount"))
    return inv.unionByName(lines)


def _ap_mv_sql() -> str:
    def br(cond, kind, amt):
        return (f"SELECT supplier_id AS vendor_id, apply_date AS mv_date, '{kind}' AS movement_type, "
                f"CAST(-({amt}) AS DECIMAL(18,2)) AS amount FROM applications WHERE {cond}")
    parts = [br("return_flag = 'R'", "DEBIT_MEMO", "gross_amount"),
             br("return_flag = 'A'", "PAYMENT", "amount"),
             br("return_flag = 'N'", "PREPAYMENT", "amount"),
             br("return_flag = 'A'", "DISCOUNT", "discount_taken"),
             br("return_flag = 'A'", "TAX", "acctd_amount - amount")]
    head = "SELECT vendor_id, invoice_date AS mv_date, 'INVOICE' AS movement_type, invoice_amount AS amount FROM ap_invoices"
    return "(" + " UNION ALL ".join([head, *parts]) + ")"


_AP5_SQL = S.with_sql(f"""
SELECT x.vendor_id, p.party_name, x.block, x.period, x.movement_type, x.amount,
       CAST(SUM(x.amount) OVER (PARTITION BY x.vendor_id ORDER BY x.block, x.period, x.movement_type
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DECIMAL(38,2)) AS running_balance
FROM (SELECT vendor_id, 1 AS block, 'OPENING' AS period, 'OPENING' AS movement_type, CAST(SUM(amount) AS DECIMAL(38,2)) AS amount
      FROM {_ap_mv_sql()} m WHERE mv_date < {D(PERIOD_FROM)} GROUP BY vendor_id
      UNION ALL
      SELECT vendor_id, 2, strftime(mv_date, '%Y-%m'), movement_type, CAST(SUM(amount) AS DECIMAL(38,2))
      FROM {_ap_mv_sql()} m WHERE mv_date BETWEEN {D(PERIOD_FROM)} AND {D(PERIOD_TO)} GROUP BY 1, 2, 3, 4) x
JOIN (SELECT s.supplier_id, COALESCE(CASE WHEN s.vendor_id < 0 THEN c.party_name END, s.vendor_name) AS party_name
      FROM suppliers s LEFT JOIN customers c ON c.customer_id = -s.vendor_id) p ON p.supplier_id = x.vendor_id""",
                      "ap_invoices", "applications", "suppliers", "customers")


@register("r_ap5_complete_supplier_ledger", _AP5_SQL)
def complete_supplier_ledger(t: Tables) -> DataFrame:
    """R-AP5: opening block (O5) and the period's movements by month and
    type (O4 of six signed types), a running balance per supplier (window
    over the aggregated rows: bounded by months x types) and the party
    name with the negative-vendor fallback (J15)."""
    from tallyspark.operators import windows as W
    mv = _ap_movements(t).filter(F.col("mv_date") <= F.lit(t.params.date_to))
    before = F.col("mv_date") < F.lit(t.params.date_from)
    # opening and period blocks from ONE aggregation: rows before the period
    # collapse into the opening key
    blocks = mv.select("vendor_id", F.when(before, 1).otherwise(2).alias("block"),
                       F.when(before, "OPENING").otherwise(F.date_format("mv_date", "yyyy-MM")).alias("period"),
                       F.when(before, "OPENING").otherwise(F.col("movement_type")).alias("movement_type"), "amount")
    agg = blocks.groupBy("vendor_id", "block", "period", "movement_type").agg(F.sum("amount").cast(TOTAL).alias("amount"))
    x = W.running_total(agg, ["vendor_id"], ["block", "period", "movement_type"], "amount", "running_balance")
    s = S.suppliers(t)
    c = S.customers(t).select(F.col("customer_id").alias("party_id"), "party_name")
    names = s.join(c, -s.vendor_id == c.party_id, "left").select(
        F.col("supplier_id").alias("vendor_id"),
        F.coalesce(F.when(F.col("vendor_id") < 0, F.col("party_name")), F.col("vendor_name")).alias("party_name"))
    return x.join(names, "vendor_id").select("vendor_id", "party_name", "block", "period", "movement_type", "amount",
                                             F.col("running_balance").cast(TOTAL).alias("running_balance"))


@register("r_ap4_payment_voucher_header", S.with_sql("""
SELECT p.order_id, p.vendor_id, s.vendor_name, MAX(p.pay_date) AS payment_date,
       CAST(SUM(p.amount) AS DECIMAL(38,2)) AS payment_amount, CAST(SUM(p.discount_taken) AS DECIMAL(38,2)) AS discount
FROM ap_payments p JOIN suppliers s ON s.supplier_id = p.vendor_id
WHERE p.pay_type = 'PAYMENT' GROUP BY p.order_id, p.vendor_id, s.vendor_name""", "ap_payments", "suppliers"))
def payment_voucher_header(t: Tables) -> DataFrame:
    """R-AP4 (header set): one voucher per payment with vendor and totals."""
    p = ap_payments(t).filter(F.col("pay_type") == "PAYMENT")
    s = S.suppliers(t).select(F.col("supplier_id").alias("vendor_id"), "vendor_name")
    g = p.groupBy("order_id", "vendor_id").agg(F.max("pay_date").alias("payment_date"),
                                               F.sum("amount").cast(TOTAL).alias("payment_amount"),
                                               F.sum("discount_taken").cast(TOTAL).alias("discount"))
    return g.join(s, "vendor_id")


@register("r_ap4_payment_voucher_lines", S.with_sql("""
SELECT j.je_header_id AS order_id, j.supplier_id AS vendor_id, j.account,
       CAST(SUM(COALESCE(j.accounted_dr, 0) - COALESCE(j.accounted_cr, 0)) AS DECIMAL(38,2)) AS net_debit
FROM journal_lines j
WHERE EXISTS (SELECT 1 FROM ap_payments p WHERE p.pay_type = 'PAYMENT' AND p.order_id = j.je_header_id AND p.vendor_id = j.supplier_id)
GROUP BY 1, 2, 3 HAVING SUM(COALESCE(j.accounted_dr, 0) - COALESCE(j.accounted_cr, 0)) <> 0""", "journal_lines", "ap_payments"))
def payment_voucher_lines(t: Tables) -> DataFrame:
    """R-AP4 (distribution set): accounting lines of paid invoices (J13
    link through the journal), net debit per account, non-zero (A4)."""
    pay = ap_payments(t).filter(F.col("pay_type") == "PAYMENT").select(
        F.col("order_id").alias("je_header_id"), F.col("vendor_id").alias("supplier_id")).distinct()
    jl = S.journal_lines(t).join(pay, ["je_header_id", "supplier_id"], "left_semi")
    g = jl.groupBy(F.col("je_header_id").alias("order_id"), F.col("supplier_id").alias("vendor_id"), "account").agg(
        F.sum(F.coalesce("accounted_dr", F.lit(0)) - F.coalesce("accounted_cr", F.lit(0))).cast(TOTAL).alias("net_debit"))
    return g.filter(F.col("net_debit") != 0)


@register("r_cm2_payment_vouchers", S.with_sql(f"""
SELECT p.order_id, p.vendor_id, s.vendor_name, n.n_name AS bank_country, p.pay_date, p.amount
FROM ap_payments p JOIN suppliers s ON s.supplier_id = p.vendor_id JOIN nation n ON n.n_nationkey = s.country_id
WHERE p.pay_type = 'PAYMENT' AND p.pay_date BETWEEN {D(PERIOD_FROM)} AND {D(PERIOD_TO)}""", "ap_payments", "suppliers"))
def payment_vouchers(t: Tables) -> DataFrame:
    """R-CM2: payment voucher list of the period (amount in words is a
    print formatter and is not built)."""
    p = ap_payments(t).filter((F.col("pay_type") == "PAYMENT") & F.col("pay_date").between(F.lit(t.params.date_from), F.lit(t.params.date_to)))
    s = S.suppliers(t).select(F.col("supplier_id").alias("vendor_id"), "vendor_name", "country_id")
    n = F.broadcast(t.nation.select(F.col("n_nationkey").alias("country_id"), F.col("n_name").alias("bank_country")))
    j = p.join(s, "vendor_id").join(n, "country_id")
    return j.select("order_id", "vendor_id", "vendor_name", "bank_country", "pay_date", "amount")
