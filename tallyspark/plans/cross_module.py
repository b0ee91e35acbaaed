"""Finance cross-module reports (R-FX1..R-FX3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.params import PERIOD_FROM, PERIOD_TO
from tallyspark.functions.scalars import TOTAL
from tallyspark.operators import windows as W
from tallyspark.plans.cash_assets import assets
from tallyspark.plans.payables import ap_invoices
from tallyspark.plans.registry import register
from tallyspark.sources import standins as S
from tallyspark.sources.tables import Tables

D = S._d

_FX1_SQL = S.with_sql("""
SELECT l.je_header_id, l.je_line_num, l.account, l.je_source,
       CASE WHEN l.je_source = 'Payables' AND ap.invoice_num IS NOT NULL THEN 'AP'
            WHEN l.je_source = 'Receivables' AND ar.trx_number IS NOT NULL THEN 'AR'
            WHEN l.je_source = 'Manual' AND l.account BETWEEN 1000 AND 1999 AND fa.description IS NOT NULL THEN 'FA'
            ELSE 'MANUAL' END AS source_type,
       COALESCE(CASE WHEN l.je_source = 'Payables' THEN ap.invoice_num END,
                CASE WHEN l.je_source = 'Receivables' THEN ar.trx_number END,
                CASE WHEN l.je_source = 'Manual' AND l.account BETWEEN 1000 AND 1999 THEN fa.description END,
                'Manual Journal') AS source_reference,
       CAST(COALESCE(l.accounted_dr, 0) - COALESCE(l.accounted_cr, 0) AS DECIMAL(18,2)) AS net_amount
FROM journal_lines l
LEFT JOIN ap_invoices ap ON ap.order_id = l.je_header_id AND ap.vendor_id = l.supplier_id
LEFT JOIN invoices ar ON ar.trx_id = l.je_header_id
LEFT JOIN assets fa ON fa.asset_id = l.part_id""", "journal_lines", "ap_invoices", "invoices", "assets")


@register("r_fx1_account_analysis", _FX1_SQL)
def account_analysis(t: Tables) -> DataFrame:
    """R-FX1 (J13 + J14): each journal line traced through its link chain
    to the payables invoice, the receivables transaction or the asset; the
    first source that resolves wins, else 'Manual Journal'.  Each source is
    one row per key, so the left joins cannot fan out."""
    jl = S.journal_lines(t, numbered=True)
    ap = ap_invoices(t).select(F.col("order_id").alias("je_header_id"), F.col("vendor_id").alias("supplier_id"), "invoice_num")
    ar = S.invoices(t).select(F.col("trx_id").alias("je_header_id"), "trx_number")
    fa = assets(t).select(F.col("asset_id").alias("part_id"), "description")
    j = jl.join(ap, ["je_header_id", "supplier_id"], "left").join(ar, "je_header_id", "left").join(fa, "part_id", "left")
    src = F.col("je_source")
    is_fa = (src == "Manual") & F.col("account").between(1000, 1999)
    ap_ref = F.when(src == "Payables", F.col("invoice_num"))
    ar_ref = F.when(src == "Receivables", F.col("trx_number"))
    fa_ref = F.when(is_fa, F.col("description"))
    stype = (F.when((src == "Payables") & F.col("invoice_num").isNotNull(), "AP")
             .when((src == "Receivables") & F.col("trx_number").isNotNull(), "AR")
             .when(is_fa & F.col("description").isNotNull(), "FA").otherwise("MANUAL"))
    return j.select("je_header_id", "je_line_num", "account", "je_source", stype.alias("source_type"),
                    F.coalesce(ap_ref, ar_ref, fa_ref, F.lit("Manual Journal")).alias("source_reference"),
                    (F.coalesce("accounted_dr", F.lit(0)) - F.coalesce("accounted_cr", F.lit(0))).cast("decimal(18,2)")
                    .alias("net_amount"))


_FX2_SQL = S.with_sql("""
SELECT o.o_orderkey AS order_id, CAST(o.o_totalprice AS DECIMAL(18,2)) AS ordered,
       CAST(COALESCE(i.invoiced, 0) AS DECIMAL(38,2)) AS invoiced, CAST(COALESCE(r.received, 0) AS DECIMAL(38,2)) AS received,
       CAST(CAST(o.o_totalprice AS DECIMAL(18,2)) - COALESCE(i.invoiced, 0) AS DECIMAL(38,2)) AS unbilled,
       CAST(COALESCE(i.invoiced, 0) - COALESCE(r.received, 0) AS DECIMAL(38,2)) AS outstanding
FROM orders o
LEFT JOIN (SELECT trx_id, SUM(amount) AS invoiced FROM invoices WHERE class = 'INV' AND complete_flag = 'Y' GROUP BY trx_id) i
  ON i.trx_id = o.o_orderkey
LEFT JOIN (SELECT applied_trx_id, SUM(amount) AS received FROM applications WHERE app_type = 'CASH' GROUP BY applied_trx_id) r
  ON r.applied_trx_id = o.o_orderkey""", "invoices", "applications")


@register("r_fx2_order_to_cash", _FX2_SQL)
def order_to_cash(t: Tables) -> DataFrame:
    """R-FX2 (J22 + A8): ordered, invoiced, received, unbilled and
    outstanding per sales order; each stage aggregated before the join."""
    o = t.orders.select(F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").cast("decimal(18,2)").alias("ordered"))
    inv = (S.invoices(t).filter((F.col("class") == "INV") & (F.col("complete_flag") == "Y"))
           .groupBy(F.col("trx_id").alias("order_id")).agg(F.sum("amount").alias("inv")))
    rc = (S.applications(t).filter(F.col("app_type") == "CASH").groupBy(F.col("applied_trx_id").alias("order_id"))
          .agg(F.sum("amount").alias("rec")))
    j = o.join(inv, "order_id", "left").join(rc, "order_id", "left")
    i, r = F.coalesce("inv", F.lit(0)), F.coalesce("rec", F.lit(0))
    return j.select("order_id", "ordered", i.cast(TOTAL).alias("invoiced"), r.cast(TOTAL).alias("received"),
                    (F.col("ordered") - i).cast(TOTAL).alias("unbilled"), (i - r).cast(TOTAL).alias("outstanding"))


_FX3_SQL = S.with_sql(f"""
SELECT x.*, CAST(SUM(tax_amount) OVER (PARTITION BY tax_type) AS DECIMAL(38,2)) AS type_total
FROM (SELECT 'COLLECTED' AS tax_type, strftime(apply_date, '%Y-%m') AS period,
             CAST(SUM(acctd_amount - amount) AS DECIMAL(38,2)) AS tax_amount
      FROM applications WHERE app_type = 'CASH' AND apply_date BETWEEN {D(PERIOD_FROM)} AND {D(PERIOD_TO)} GROUP BY 1, 2
      UNION ALL
      SELECT 'PAID', strftime(apply_date, '%Y-%m'), CAST(SUM(acctd_amount - amount) AS DECIMAL(38,2))
      FROM applications WHERE app_type = 'CM' AND apply_date BETWEEN {D(PERIOD_FROM)} AND {D(PERIOD_TO)} GROUP BY 1, 2) x""",
                      "applications")


@register("r_fx3_tax_register", _FX3_SQL)
def tax_register(t: Tables) -> DataFrame:
    """R-FX3 (O4 + W3): tax collected and paid per month with the total of
    each tax type beside every row."""
    a = S.applications(t).filter(F.col("apply_date").between(F.lit(t.params.date_from), F.lit(t.params.date_to)))
    tax = F.col("acctd_amount") - F.col("amount")

    def branch(kind, app_type):
        return (a.filter(F.col("app_type") == app_type)
                .groupBy(F.lit(kind).alias("tax_type"), F.date_format("apply_date", "yyyy-MM").alias("period"))
                .agg(F.sum(tax).cast(TOTAL).alias("tax_amount")))

    u = branch("COLLECTED", "CASH").unionByName(branch("PAID", "CM"))
    out = W.partition_total(u, ["tax_type"], "tax_amount", "type_total", bounded=True)  # type x month rows
    return out.withColumn("type_total", F.col("type_total").cast(TOTAL))
