"""Data-quality checks (Q1-Q5) as queries: each returns the offending rows
or per-check counts, never pulls data to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.scalars import TOTAL
from tallyspark.operators import quality as Q
from tallyspark.plans.registry import register
from tallyspark.sources import standins as S
from tallyspark.sources.tables import Tables


@register("q1_orphan_checks", S.with_sql("""
SELECT 'application_without_invoice' AS check_name, COUNT(*) AS orphans FROM applications a
WHERE NOT EXISTS (SELECT 1 FROM invoices i WHERE i.trx_id = a.applied_trx_id)
UNION ALL
SELECT 'receipt_without_invoice', COUNT(*) FROM receipts r WHERE NOT EXISTS (SELECT 1 FROM invoices i WHERE i.trx_id = r.applied_trx_id)
UNION ALL
SELECT 'order_without_line', COUNT(*) FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)""",
                                         "applications", "invoices", "receipts"))
def orphan_checks(t: Tables) -> DataFrame:
    """Q1: three orphan checks (child without parent), one count row each."""
    inv = S.invoices(t)
    c1 = Q.orphans(S.applications(t), inv, "applied_trx_id", "trx_id")
    c2 = Q.orphans(S.receipts(t), inv, "applied_trx_id", "trx_id")
    c3 = Q.orphans(t.orders, t.lineitem, "o_orderkey", "l_orderkey")
    cnt = lambda df, n: df.agg(F.count(F.lit(1)).alias("orphans")).select(F.lit(n).alias("check_name"), "orphans")
    return (cnt(c1, "application_without_invoice").unionByName(cnt(c2, "receipt_without_invoice"))
            .unionByName(cnt(c3, "order_without_line")))


@register("q2_domain_check", """
SELECT o_orderstatus AS value, COUNT(*) AS row_count FROM orders
WHERE o_orderstatus NOT IN ('F', 'O') OR o_orderstatus IS NULL GROUP BY o_orderstatus""")
def domain_check(t: Tables) -> DataFrame:
    """Q2: order status values outside the allowed list (F, O) -- P is
    reported as outside, as the rule is written for closed/open only."""
    return Q.outside_domain(t.orders.select(F.col("o_orderstatus").alias("value")), "value", ["F", "O"])


@register("q3_duplicate_grain", """
SELECT l_orderkey, l_linenumber, COUNT(*) AS row_count FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1""")
def duplicate_grain(t: Tables) -> DataFrame:
    """Q3: (order, line number) keys that repeat in the line table."""
    return Q.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


def _q4_sql() -> str:
    from tallyspark.plans.receivables import _AR3_SQL
    from tallyspark.operators.aging import AR_SEVEN
    parts = " + ".join(f"COALESCE({c}, 0)" for c in AR_SEVEN.columns)
    return (f"SELECT *, total_due - ({parts}) AS difference FROM ({_AR3_SQL}) x "
            f"WHERE abs(total_due - ({parts})) > 0.01")


@register("q4_bucket_identity", _q4_sql())
def bucket_identity(t: Tables) -> DataFrame:
    """Q4: the 7 aging buckets add up to the total (expect no rows)."""
    from tallyspark.plans.receivables import aging_7
    from tallyspark.operators.aging import AR_SEVEN
    return Q.identity_breaks(aging_7(t), AR_SEVEN.columns, "total_due")


@register("q5_order_totals_vs_lines", """
SELECT o.o_orderstatus, COUNT(*) AS orders_checked,
       CAST(SUM(CASE WHEN abs(CAST(o.o_totalprice AS DECIMAL(18,2)) - COALESCE(l.line_total, 0)) > 0.01 THEN 1 ELSE 0 END) AS BIGINT) AS mismatches
FROM orders o LEFT JOIN (SELECT l_orderkey, SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS line_total
                         FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey
GROUP BY o.o_orderstatus""")
def order_totals_vs_lines(t: Tables) -> DataFrame:
    """Q5: order totals against the sum of their lines (tolerance 0.01)."""
    from tallyspark.functions.scalars import money
    lines = t.lineitem.groupBy("l_orderkey").agg(F.sum(money("l_extendedprice")).alias("line_total"))
    j = t.orders.join(lines, t.orders.o_orderkey == lines.l_orderkey, "left")
    diff = F.abs(money("o_totalprice") - F.coalesce("line_total", F.lit(0)))
    return j.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("orders_checked"),
                                          F.sum(F.when(diff > F.lit(0.01).cast("decimal(3,2)"), 1).otherwise(0)).alias("mismatches"))
