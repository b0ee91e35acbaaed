"""Supply-chain reports: purchasing, inventory, order management and the
procure-to-pay chain (R-PO*, R-IV*, R-OM1, R-P2P*)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.params import AS_OF
from tallyspark.functions.scalars import MONEY, TOTAL, cents, div_round, money, round_money, sql_div_round
from tallyspark.operators import effective as E
from tallyspark.operators.windows import join_back
from tallyspark.plans.registry import register
from tallyspark.sources import standins as S
from tallyspark.sources.tables import Tables

D = S._d


@register("r_po1_open_purchase_orders", """
SELECT o.o_orderkey AS po_id, o.o_custkey AS buyer_id, q.ordered_qty, q.received_qty,
       q.ordered_qty - q.received_qty AS open_qty
FROM orders o JOIN (SELECT l_orderkey, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS ordered_qty,
                           CAST(SUM(CASE WHEN l_linestatus = 'F' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS received_qty
                    FROM lineitem GROUP BY l_orderkey) q ON q.l_orderkey = o.o_orderkey
WHERE o.o_orderstatus = 'O' AND q.ordered_qty - q.received_qty > 0""")
def open_purchase_orders(t: Tables) -> DataFrame:
    """R-PO1/F14: open (not closed, not cancelled) orders with open quantity > 0.

    Quantities are aggregated per order before the join."""
    q = t.lineitem.groupBy(F.col("l_orderkey").alias("po_id")).agg(
        F.sum(F.col("l_quantity").cast("bigint")).alias("ordered_qty"),
        F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_quantity").cast("bigint")).otherwise(0)).alias("received_qty"))
    o = t.orders.filter(F.col("o_orderstatus") == "O").select(F.col("o_orderkey").alias("po_id"),
                                                              F.col("o_custkey").alias("buyer_id"))
    j = o.join(q, "po_id").withColumn("open_qty", F.col("ordered_qty") - F.col("received_qty"))
    return j.filter(F.col("open_qty") > 0)


@register("r_po2_po_shipment_detail", """
SELECT l.l_orderkey AS po_id, l.l_linenumber AS shipment_num, l.l_partkey AS item_id, p.p_name AS item_name,
       s.s_name AS supplier_name, n.n_name AS supplier_country, c.c_name AS buyer_name,
       CAST(o.o_orderdate AS DATE) AS po_date, CAST(l.l_quantity AS BIGINT) AS quantity,
       CAST(l.l_extendedprice AS DECIMAL(18,2)) AS amount, f.first_buyer
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey
JOIN supplier s ON s.s_suppkey = l.l_suppkey JOIN nation n ON n.n_nationkey = s.s_nationkey
JOIN part p ON p.p_partkey = l.l_partkey
JOIN (SELECT l_suppkey, arg_min(o_custkey, (o_orderdate, o_orderkey, o_custkey)) AS first_buyer
      FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_suppkey) f ON f.l_suppkey = l.l_suppkey""")
def po_shipment_detail(t: Tables) -> DataFrame:
    """R-PO2/J21: one row per shipment stitched from order, buyer, supplier,
    country and item masters, plus the supplier's first buyer (W6 as a
    grouped min_by).

    What hangs on an order or a supplier is joined to that table first, so the
    lines are shuffled once for each of order, item and supplier."""
    # money and dates in their reported types: doubles hardly compress in a shuffle
    li = t.lineitem.select(F.col("l_orderkey").alias("po_id"), F.col("l_linenumber").alias("shipment_num"), F.col("l_partkey").alias("item_id"),
                           "l_suppkey", F.col("l_quantity").cast("bigint").alias("quantity"), money("l_extendedprice").alias("amount"))
    o = t.orders.select(F.col("o_orderkey").alias("po_id"), "o_custkey", "o_orderdate")
    buyers = o.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("buyer_name")), "o_custkey")
    first = li.join(o, "po_id").groupBy("l_suppkey").agg(
        F.min_by("o_custkey", F.struct("o_orderdate", "po_id", "o_custkey")).alias("first_buyer"))
    sellers = (t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("supplier_name"), "s_nationkey")
               .join(F.broadcast(t.nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("supplier_country"))), "s_nationkey")
               .join(first, "l_suppkey").drop("s_nationkey"))
    j = li.join(buyers.select("po_id", "buyer_name", F.to_date("o_orderdate").alias("po_date")), "po_id")
    j = j.join(t.part.select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("item_name")), "item_id")
    j = join_back(j, sellers, ["l_suppkey"])
    return j.select("po_id", "shipment_num", "item_id", "item_name", "supplier_name", "supplier_country", "buyer_name", "po_date", "quantity", "amount",
                    "first_buyer")


@register("r_po5_shipment_tax", S.with_sql("""
SELECT applied_trx_id AS po_id, CAST(SUM(gross_amount) AS DECIMAL(38,2)) AS order_amount,
       CAST(SUM(acctd_amount - amount) AS DECIMAL(38,2)) AS recoverable_tax
FROM applications GROUP BY applied_trx_id""", "applications"))
def shipment_tax(t: Tables) -> DataFrame:
    """R-PO5: order amount from its distributions and recoverable tax per order."""
    a = S.applications(t)
    return a.groupBy(F.col("applied_trx_id").alias("po_id")).agg(
        F.sum("gross_amount").cast(TOTAL).alias("order_amount"),
        F.sum(F.col("acctd_amount") - F.col("amount")).cast(TOTAL).alias("recoverable_tax"))


@register("r_om1_sales_order_lines", """
SELECT l.l_orderkey AS order_id, l.l_linenumber AS line_num, o.o_custkey AS customer_id,
       CASE l.l_linestatus WHEN 'F' THEN 'CLOSED' WHEN 'O' THEN 'AWAITING_SHIPPING' ELSE 'ENTERED' END AS line_status,
       CASE l.l_returnflag WHEN 'R' THEN 'RETURNED' WHEN 'A' THEN 'ACCEPTED' ELSE 'NONE' END AS return_status,
       CAST(l.l_quantity AS BIGINT) AS quantity
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey""")
def sales_order_lines(t: Tables) -> DataFrame:
    """R-OM1: sales order lines with a decoded line and return status."""
    from tallyspark.functions.scalars import decode
    li, o = t.lineitem, t.orders.select("o_orderkey", "o_custkey")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return j.select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_num"),
                    F.col("o_custkey").alias("customer_id"),
                    decode("l_linestatus", [("F", "CLOSED"), ("O", "AWAITING_SHIPPING")], "ENTERED").alias("line_status"),
                    decode("l_returnflag", [("R", "RETURNED"), ("A", "ACCEPTED")], "NONE").alias("return_status"),
                    F.col("l_quantity").cast("bigint").alias("quantity"))


@register("r_iv1_onhand", S.with_sql("""
SELECT item_id, org_id, CAST(SUM(quantity) AS BIGINT) AS onhand_qty, CAST(SUM(CASE WHEN quantity < 0 THEN -value ELSE value END) AS DECIMAL(38,2)) AS onhand_value
FROM movements GROUP BY item_id, org_id""", "movements"))
def onhand(t: Tables) -> DataFrame:
    """R-IV1: on-hand quantity and value by item and location."""
    m = S.movements(t)
    return m.groupBy("item_id", "org_id").agg(
        F.sum("quantity").alias("onhand_qty"),
        F.sum(F.when(F.col("quantity") < 0, -F.col("value")).otherwise(F.col("value"))).cast(TOTAL).alias("onhand_value"))


@register("r_iv3_movement_cost", S.with_sql("""
SELECT m.source_doc_id, m.item_id, m.org_id, m.trx_date, m.quantity, c.unit_cost_average,
       CAST(m.quantity * c.unit_cost_average AS DECIMAL(38,2)) AS movement_cost
FROM movements m JOIN cost_periods c ON c.item_id = m.item_id
 AND m.trx_date >= c.cost_date AND m.trx_date <= c.cost_end_date AND m.trx_date <> c.cost_end_date""",
                                           "movements", "cost_periods"))
def movement_cost(t: Tables) -> DataFrame:
    """R-IV3/J10: average cost of each movement from the item's cost period
    (equi key item + date range, the period end excluded as in the source)."""
    m = S.movements(t)
    c = S.cost_periods(t)
    j = E.join_period(m, c, ["item_id"], "trx_date", "cost_date", "cost_end_date", exclude_end=True,
                      calendar_month=True)
    return j.select("source_doc_id", "item_id", "org_id", "trx_date", "quantity", "unit_cost_average",
                    (F.col("quantity") * F.col("unit_cost_average")).cast(TOTAL).alias("movement_cost"))


def _stage_status() -> F.Column:
    return (F.when(F.col("pay_amount").isNotNull(), "PAID").when(F.col("inv_amount").isNotNull(), "INVOICED")
             .when(F.col("rcv_amount").isNotNull(), "RECEIVED").when(F.col("po_amount").isNotNull(), "ORDERED")
             .otherwise("REQUISITIONED"))


_STAGE_SQL = ("CASE WHEN pay_amount IS NOT NULL THEN 'PAID' WHEN inv_amount IS NOT NULL THEN 'INVOICED' "
              "WHEN rcv_amount IS NOT NULL THEN 'RECEIVED' WHEN po_amount IS NOT NULL THEN 'ORDERED' "
              "ELSE 'REQUISITIONED' END")


@register("r_p2p1_procure_to_pay", S.with_sql(f"""
SELECT req_id, req_date, req_amount, po_amount, rcv_amount, inv_amount, pay_amount, {_STAGE_SQL} AS stage
FROM p2p_stages""", "p2p_stages"))
def procure_to_pay(t: Tables) -> DataFrame:
    """R-P2P1/J22: requisition -> order -> receipt -> invoice -> payment with
    partial progress; every stage pre-aggregated per document (§8 #15)."""
    s = S.p2p_stages(t)
    return s.select("req_id", "req_date", "req_amount", "po_amount", "rcv_amount", "inv_amount", "pay_amount",
                    _stage_status().alias("stage"))


@register("r_p2p2_lead_time_savings", S.with_sql("""
SELECT req_id, po_approved_date - req_date AS lead_time_days,
       CAST(req_amount - po_amount AS DECIMAL(38,2)) AS savings,
       CAST(COALESCE(rcv_amount, 0) - COALESCE(inv_amount, 0) AS DECIMAL(38,2)) AS grn_pending_invoice
FROM p2p_stages WHERE po_amount IS NOT NULL""", "p2p_stages"))
def lead_time_savings(t: Tables) -> DataFrame:
    """R-P2P2: days from requisition approval to order approval, savings, and
    the received value that is not invoiced."""
    s = S.p2p_stages(t).filter(F.col("po_amount").isNotNull())
    pending = F.coalesce("rcv_amount", F.lit(0)) - F.coalesce("inv_amount", F.lit(0))
    return s.select("req_id", F.datediff("po_approved_date", "req_date").cast("bigint").alias("lead_time_days"),
                    (F.col("req_amount") - F.col("po_amount")).cast(TOTAL).alias("savings"),
                    pending.cast(TOTAL).alias("grn_pending_invoice"))


def grn_open(s: DataFrame) -> F.Column:
    """Y while a receipt waits for its invoice: an approved, validated invoice
    below the receipt's value, or none yet; else N."""
    rcv, inv = F.col("rcv_amount"), F.col("inv_amount")
    invoiced = (inv.isNotNull() & (F.col("validation_status") == "VALIDATED")
                & F.col("approval_status").isin(*S.APPROVALS[:-1]) & (rcv - inv > 0))
    return F.when(rcv.isNotNull() & (invoiced | (inv.isNull() & (rcv > 0))), "Y").otherwise("N")


@register("r_p2p3_p2p6_match_status", S.with_sql("""
SELECT CASE WHEN po_amount IS NULL THEN 'NO PO'
            WHEN rcv_amount IS NOT NULL AND inspected = 'Y' AND inv_amount IS NOT NULL THEN '4-WAY'
            WHEN rcv_amount IS NOT NULL AND inv_amount IS NOT NULL THEN '3-WAY'
            WHEN inv_amount IS NOT NULL THEN '2-WAY' ELSE 'UNMATCHED' END AS match_class,
       CASE WHEN rcv_amount IS NOT NULL AND inv_amount IS NOT NULL AND validation_status = 'VALIDATED'
             AND approval_status IN ('Manually approved', 'Workflow approved', 'Approved', 'Not required')
             AND rcv_amount - inv_amount > 0 THEN 'Y'
            WHEN rcv_amount IS NOT NULL AND inv_amount IS NULL AND rcv_amount > 0 THEN 'Y'
            ELSE 'N' END AS grn_open_status,
       COUNT(*) AS documents
FROM p2p_stages GROUP BY 1, 2""", "p2p_stages"))
def match_status(t: Tables) -> DataFrame:
    """R-P2P3/R-P2P6: 2-way (order, invoice), 3-way (with receipt) and 4-way
    (with inspection) match class, and whether the receipt is open."""
    s = S.p2p_stages(t)
    rcv, inv = F.col("rcv_amount").isNotNull(), F.col("inv_amount").isNotNull()
    cls = (F.when(F.col("po_amount").isNull(), "NO PO").when(rcv & (F.col("inspected") == "Y") & inv, "4-WAY")
           .when(rcv & inv, "3-WAY").when(inv, "2-WAY").otherwise("UNMATCHED"))
    return s.groupBy(cls.alias("match_class"), grn_open(s).alias("grn_open_status")).agg(F.count(F.lit(1)).alias("documents"))


@register("r_p2p5_supplier_qualification", S.with_sql(f"""
SELECT s.supplier_id, s.vendor_name, COUNT(DISTINCT a.applied_trx_id) AS orders_supplied,
       CASE WHEN s.acctbal >= 0 THEN 'QUALIFIED' ELSE 'ON HOLD' END AS qualification
FROM suppliers s LEFT JOIN applications a ON a.supplier_id = s.supplier_id AND a.apply_date <= {D(AS_OF)}
GROUP BY s.supplier_id, s.vendor_name, s.acctbal""", "suppliers", "applications"))
def supplier_qualification(t: Tables) -> DataFrame:
    """R-P2P5: supplier qualification list at a date."""
    s = S.suppliers(t)
    a = (S.applications(t).filter(F.col("apply_date") <= F.lit(t.params.as_of)).groupBy("supplier_id")
         .agg(F.count_distinct("applied_trx_id").alias("orders_supplied")))
    j = s.join(a, "supplier_id", "left")
    return j.select("supplier_id", "vendor_name", F.coalesce("orders_supplied", F.lit(0)).alias("orders_supplied"),
                    F.when(F.col("acctbal") >= 0, "QUALIFIED").otherwise("ON HOLD").alias("qualification"))


@register("r_iv2_movement_detail", S.with_sql("""
SELECT m.source_doc_id, m.item_id, p.p_name AS item_name, s.s_name AS org_name, m.trx_type, m.trx_date, m.quantity,
       c.unit_cost_average, CAST(m.quantity * c.unit_cost_average AS DECIMAL(38,2)) AS movement_cost,
       CASE WHEN m.trx_type = 'RETURN' THEN 'TRANSFER IN' ELSE 'ISSUE OUT' END AS transfer_direction
FROM movements m
JOIN part p ON p.p_partkey = m.item_id JOIN supplier s ON s.s_suppkey = m.org_id
LEFT JOIN cost_periods c ON c.item_id = m.item_id AND m.trx_date >= c.cost_date AND m.trx_date <= c.cost_end_date
 AND m.trx_date <> c.cost_end_date""", "movements", "cost_periods"))
def movement_detail(t: Tables) -> DataFrame:
    """R-IV2: movements with item and location names (J21), the cost of the
    cost period (J10, left) and the transfer direction."""
    m = S.movements(t)
    c = S.cost_periods(t)
    j = E.join_period(m, c, ["item_id"], "trx_date", "cost_date", "cost_end_date", exclude_end=True, how="left",
                      calendar_month=True)
    j = (j.join(t.part.select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("item_name")), "item_id")
          .join(t.supplier.select(F.col("s_suppkey").alias("org_id"), F.col("s_name").alias("org_name")), "org_id"))
    return j.select("source_doc_id", "item_id", "item_name", "org_name", "trx_type", "trx_date", "quantity",
                    "unit_cost_average", (F.col("quantity") * F.col("unit_cost_average")).cast(TOTAL).alias("movement_cost"),
                    F.when(F.col("trx_type") == "RETURN", "TRANSFER IN").otherwise("ISSUE OUT").alias("transfer_direction"))


@register("r_iv4_receipt_value", S.with_sql("""
SELECT applied_trx_id AS po_id, supplier_id, CAST(SUM(quantity) AS BIGINT) AS received_qty,
       CAST(SUM(gross_amount) AS DECIMAL(38,2)) AS received_value
FROM applications WHERE line_status = 'F' GROUP BY applied_trx_id, supplier_id""", "applications"))
def receipt_value(t: Tables) -> DataFrame:
    """R-IV4/R-PO6: received quantity and value (quantity x price) per order
    distribution (order, supplier)."""
    a = S.applications(t).filter(F.col("line_status") == "F")
    return a.groupBy(F.col("applied_trx_id").alias("po_id"), "supplier_id").agg(
        F.sum("quantity").alias("received_qty"), F.sum("gross_amount").cast(TOTAL).alias("received_value"))


@register("r_po3_requisition_detail", f"""
SELECT l.l_orderkey AS requisition_id, l.l_linenumber AS line_num, l.l_partkey AS item_id,
       CAST(l.l_quantity AS BIGINT) AS quantity,
       CAST(COALESCE(CAST(l.l_quantity AS BIGINT) * {sql_div_round('CAST(CAST(l.l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT)', 'CAST(l.l_quantity AS BIGINT) * 100')},
                     CAST(l.l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS line_amount,
       '01-' || lpad(CAST(s.s_nationkey AS VARCHAR), 2, '0') || '-' || CAST(1000 + (l.l_partkey * 37) % 9000 AS VARCHAR) AS charge_account
FROM lineitem l JOIN supplier s ON s.s_suppkey = l.l_suppkey""")
def requisition_detail(t: Tables) -> DataFrame:
    """R-PO3: requisition lines with the amount falling back to the line
    amount when quantity x unit price is missing (X1) and the charge
    account built from segments (X11)."""
    li = t.lineitem.join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    qty = F.col("l_quantity").cast("bigint")
    unit = div_round(cents(money("l_extendedprice")), qty * 100, 2)  # exact; NULL when quantity is 0
    amt = F.coalesce(qty * unit, money("l_extendedprice")).cast(TOTAL)
    acct = F.concat(F.lit("01-"), F.lpad(F.col("s_nationkey").cast("string"), 2, "0"), F.lit("-"),
                    (F.lit(1000) + (F.col("l_partkey") * 37) % 9000).cast("string"))
    return li.select(F.col("l_orderkey").alias("requisition_id"), F.col("l_linenumber").alias("line_num"),
                     F.col("l_partkey").alias("item_id"), qty.alias("quantity"), amt.alias("line_amount"),
                     acct.alias("charge_account"))


# Vendor type lookup (type, code -> meaning).
VENDOR_TYPES = [("VENDOR_TYPE", "SUPPLIER", "Supplier"), ("VENDOR_TYPE", "PARTY", "Party supplier")]


@register("r_po4_supplier_master", S.with_sql(f"""
SELECT s.supplier_id, s.vendor_name, n.n_name AS site_country, r.r_name AS site_region,
       'BANK-' || CAST(n.n_regionkey AS VARCHAR) AS bank_name, 'TRN-' || CAST(s.supplier_id AS VARCHAR) AS tax_registration,
       CASE WHEN s.acctbal > 5000 THEN 'LICENSED' ELSE 'NONE' END AS licence,
       vt.meaning AS vendor_type, b.economy, b.promo, b.standard
FROM suppliers s JOIN nation n ON n.n_nationkey = s.country_id JOIN region r ON r.r_regionkey = n.n_regionkey
LEFT JOIN (VALUES {", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in VENDOR_TYPES)}) vt(lookup_type, code, meaning)
  ON vt.lookup_type = 'VENDOR_TYPE' AND vt.code = CASE WHEN s.vendor_id < 0 THEN 'PARTY' ELSE 'SUPPLIER' END
LEFT JOIN (SELECT l.l_suppkey AS supplier_id,
                  MAX(CASE WHEN split_part(p.p_type, ' ', 1) = 'ECONOMY' THEN 'Y' END) AS economy,
                  MAX(CASE WHEN split_part(p.p_type, ' ', 1) = 'PROMO' THEN 'Y' END) AS promo,
                  MAX(CASE WHEN split_part(p.p_type, ' ', 1) = 'STANDARD' THEN 'Y' END) AS standard
           FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey GROUP BY l.l_suppkey) b ON b.supplier_id = s.supplier_id""",
                                          "suppliers"))
def supplier_master(t: Tables) -> DataFrame:
    """R-PO4: supplier master stitched with site country/region, bank, tax
    registration and licence (J21), the vendor-type meaning from a code
    lookup (J19) and business classifications pivoted with MAX(CASE) (A3)."""
    from tallyspark.operators import rollup as A
    from tallyspark.sources import constants as K
    s = S.suppliers(t)
    n = F.broadcast(t.nation.select(F.col("n_nationkey").alias("country_id"), F.col("n_name").alias("site_country"),
                                    "n_regionkey"))
    r = F.broadcast(t.region.select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("site_region")))
    vt = K.frame(t.spark, VENDOR_TYPES, "lookup_type string, code string, meaning string").filter(
        F.col("lookup_type") == "VENDOR_TYPE").select(F.col("code").alias("vt_code"), F.col("meaning").alias("vendor_type"))
    lines = t.lineitem.select("l_suppkey", "l_partkey").join(t.part.select("p_partkey", "p_type"),
                                                             F.col("l_partkey") == F.col("p_partkey"))
    cls = lines.select(F.col("l_suppkey").alias("supplier_id"), F.split("p_type", " ").getItem(0).alias("kind"),
                       F.lit("Y").alias("flag"))
    piv = A.attribute_pivot(cls, ["supplier_id"], "kind", "flag", ["ECONOMY", "PROMO", "STANDARD"],
                            {"ECONOMY": "economy", "PROMO": "promo", "STANDARD": "standard"})
    j = (s.join(n, "country_id").join(r, "n_regionkey")
          .withColumn("vt_code", F.when(F.col("vendor_id") < 0, "PARTY").otherwise("SUPPLIER"))
          .join(vt, "vt_code", "left").join(piv, "supplier_id", "left"))
    return j.select("supplier_id", "vendor_name", "site_country", "site_region",
                    F.concat(F.lit("BANK-"), F.col("n_regionkey").cast("string")).alias("bank_name"),
                    F.concat(F.lit("TRN-"), F.col("supplier_id").cast("string")).alias("tax_registration"),
                    F.when(F.col("acctbal") > 5000, "LICENSED").otherwise("NONE").alias("licence"),
                    "vendor_type", "economy", "promo", "standard")


@register("r_so1_negotiation_detail", """
SELECT o.o_orderkey AS negotiation_id, CAST(o.o_orderdate AS DATE) AS open_date, c.c_name AS buyer_name,
       l.l_linenumber AS line_num, l.l_partkey AS item_id, s.s_name AS bidder, CAST(l.l_extendedprice AS DECIMAL(18,2)) AS bid_amount
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN supplier s ON s.s_suppkey = l.l_suppkey
WHERE o.o_orderpriority = '1-URGENT'""")
def negotiation_detail(t: Tables) -> DataFrame:
    """R-SO1: negotiation lines (urgent orders as auctions) with buyer and
    bidders; the optional buyer filter (F3) is left empty."""
    from tallyspark.functions.params import filter_optional
    o = t.orders.filter(F.col("o_orderpriority") == "1-URGENT")
    o = filter_optional(o, "o_custkey", None)
    j = (o.join(t.customer.select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
          .join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"))
          .join(t.supplier.select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey")))
    return j.select(F.col("o_orderkey").alias("negotiation_id"), F.to_date("o_orderdate").alias("open_date"),
                    F.col("c_name").alias("buyer_name"), F.col("l_linenumber").alias("line_num"),
                    F.col("l_partkey").alias("item_id"), F.col("s_name").alias("bidder"),
                    money("l_extendedprice").alias("bid_amount"))


@register("r_p2p4_work_confirmation", S.with_sql("""
SELECT w.req_id, w.confirmed_amount, p.rcv_amount, p.rcv_date,
       CASE WHEN p.rcv_amount IS NULL THEN 'NO RECEIPT' ELSE 'LINKED' END AS receipt_link
FROM (SELECT a.applied_trx_id AS req_id, CAST(SUM(a.gross_amount) AS DECIMAL(38,2)) AS confirmed_amount
      FROM applications a JOIN part pt ON pt.p_partkey = a.part_id
      WHERE a.line_status = 'F' AND split_part(pt.p_type, ' ', 1) = 'STANDARD' GROUP BY a.applied_trx_id) w
LEFT JOIN p2p_stages p ON p.req_id = w.req_id""", "applications", "p2p_stages"))
def work_confirmation(t: Tables) -> DataFrame:
    """R-P2P4: work-confirmation amount (finished service lines) per order
    and its link to the receipt stage (A1 + J2)."""
    svc = t.part.filter(F.split("p_type", " ").getItem(0) == "STANDARD").select(F.col("p_partkey").alias("part_id"))
    w = (S.applications(t).filter(F.col("line_status") == "F").join(svc, "part_id", "left_semi")
         .groupBy(F.col("applied_trx_id").alias("req_id")).agg(F.sum("gross_amount").cast(TOTAL).alias("confirmed_amount")))
    p = S.p2p_stages(t).select("req_id", "rcv_amount", "rcv_date")
    j = w.join(p, "req_id", "left")
    return j.select("req_id", "confirmed_amount", "rcv_amount", "rcv_date",
                    F.when(F.col("rcv_amount").isNull(), "NO RECEIPT").otherwise("LINKED").alias("receipt_link"))
