"""Subledger link chain (J13): document, transaction entity, event, accounting
header, accounting line, journal line.

Stand-ins: a journal line of source Receivables or Payables is an accounting
line.  An entity is an order (222, TRANSACTIONS) or an order's supplier (200,
AP_INVOICES); it has an event for each month with lines, and an event a header
in each ledger with lines, so both hops are one to many, and only ledger and
application keep a header apart from another's.  Each second line links to two
distributions (item and tax), the others to one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.params import PERIOD_FROM, PERIOD_TO
from tallyspark.functions.scalars import MONEY, TOTAL
from tallyspark.operators.joins import link_chain, semi
from tallyspark.plans.cash_assets import assets
from tallyspark.plans.payables import ap_invoices
from tallyspark.plans.registry import register
from tallyspark.sources import standins as S
from tallyspark.sources.tables import Tables

D = S._d
TENANT = ("ledger_id", "application_id")

S._cte("xla_lines", ("journal_lines",), """
SELECT *, entity_id || '-' || period_num AS event_id, entity_id || '-' || period_num || '-' || ledger_id AS ae_header_id
FROM (SELECT CASE WHEN je_source = 'Payables' THEN 200 ELSE 222 END AS application_id, ledger_id,
             CASE WHEN je_source = 'Payables' THEN 'AP-' || je_header_id || '-' || supplier_id ELSE 'AR-' || je_header_id END AS entity_id,
             period_num, period_name, gl_date, je_line_num AS ae_line_num, je_header_id || '-' || je_line_num AS gl_sl_link_id,
             CASE WHEN je_source = 'Payables' THEN 'LIABILITY' ELSE 'RECEIVABLE' END AS accounting_class_code, account, accounted_dr, accounted_cr
      FROM journal_lines WHERE je_source IN ('Payables', 'Receivables')) l""")
S._cte("xla_headers", ("xla_lines",), """
SELECT application_id, ledger_id, event_id, ae_header_id, MAX(gl_date) AS accounting_date, MAX(period_name) AS period_name
FROM xla_lines GROUP BY application_id, ledger_id, event_id, ae_header_id""")
S._cte("xla_events", ("xla_lines",), """
SELECT DISTINCT application_id, entity_id, event_id, CASE application_id WHEN 200 THEN 'INVOICE VALIDATED' ELSE 'RECP_CREATE' END AS event_type_code
FROM xla_lines""")
S._cte("xla_entities", ("ap_invoices", "invoices"), """
SELECT 200 AS application_id, 'AP_INVOICES' AS entity_code, 'AP-' || order_id || '-' || vendor_id AS entity_id, order_id AS source_id, vendor_id FROM ap_invoices
UNION ALL SELECT 222, 'TRANSACTIONS', 'AR-' || trx_id, trx_id, NULL FROM invoices""")
S._cte("xla_links", ("xla_lines",), """
SELECT application_id, ledger_id, ae_header_id, ae_line_num, entity_id, unnest(CASE WHEN ae_line_num % 2 = 0 THEN ['ITEM', 'TAX'] ELSE ['ITEM'] END) AS distribution_type
FROM xla_lines""")


def period_months(t: Tables) -> tuple[Column, Column]:
    """First and last day of the months that the period touches.  An event,
    and so a header, lies in one month: lines of other months are on none of
    the period's headers and need not be followed."""
    return F.trunc(F.lit(t.params.date_from), "month"), F.last_day(F.lit(t.params.date_to))


def accounting_lines(t: Tables, numbered: bool = False, months: tuple | None = None, only: Column | None = None) -> DataFrame:
    """Accounting lines of the subledgers; ``numbered`` adds the line number
    and the link to the journal line, at the cost of numbering the journal;
    ``months`` keeps the lines of whole months (:func:`period_months`);
    ``only`` those where it holds, of which alone whole rows are numbered."""
    j = S.journal_lines(t, numbered=numbered, only=only).filter(F.col("je_source").isin("Payables", "Receivables"))
    j = j if months is None else j.filter(F.col("gl_date").between(*months))
    payable = F.col("je_source") == "Payables"
    order = F.col("je_header_id").cast("string")
    link = [F.col("je_line_num").alias("ae_line_num"), F.concat(order, F.lit("-"), F.col("je_line_num").cast("string")).alias("gl_sl_link_id")] if numbered else []
    x = j.select(
        F.when(payable, 200).otherwise(222).alias("application_id"), "ledger_id",
        F.when(payable, F.concat(F.lit("AP-"), order, F.lit("-"), F.col("supplier_id").cast("string"))).otherwise(F.concat(F.lit("AR-"), order)).alias("entity_id"),
        "period_num", "period_name", "gl_date", *link, F.when(payable, "LIABILITY").otherwise("RECEIVABLE").alias("accounting_class_code"),
        "account", "accounted_dr", "accounted_cr")
    event = F.concat(F.col("entity_id"), F.lit("-"), F.col("period_num").cast("string"))
    return x.withColumn("event_id", event).withColumn("ae_header_id", F.concat(event, F.lit("-"), F.col("ledger_id").cast("string")))


def accounting_headers(t: Tables, months: tuple | None = None) -> DataFrame:
    return accounting_lines(t, months=months).groupBy("application_id", "ledger_id", "event_id", "ae_header_id").agg(
        F.max("gl_date").alias("accounting_date"), F.max("period_name").alias("period_name"))


def accounting_events(t: Tables, months: tuple | None = None) -> DataFrame:
    kind = F.when(F.col("application_id") == 200, "INVOICE VALIDATED").otherwise("RECP_CREATE")
    return accounting_lines(t, months=months).select("application_id", "entity_id", "event_id").distinct().withColumn("event_type_code", kind)


def transaction_entities(t: Tables, application: int, months: tuple | None = None) -> DataFrame:
    """Entities of one application with their document.  Payables invoices are
    as many as lines; with ``months`` those without a line in them are dropped
    where they were added up, before their next shuffle."""
    if application == 200:
        o, v = F.col("order_id").cast("string"), F.col("vendor_id").cast("string")
        docs = ap_invoices(t)
        if months is not None:
            j = S.journal_lines(t).filter((F.col("je_source") == "Payables") & F.col("gl_date").between(*months))
            docs = semi(docs, j.select(F.col("je_header_id").alias("order_id"), F.col("supplier_id").alias("vendor_id")).distinct(), ["order_id", "vendor_id"])
        return docs.select(F.lit(200).alias("application_id"), F.concat(F.lit("AP-"), o, F.lit("-"), v).alias("entity_id"),
                                     F.col("order_id").alias("source_id"), "vendor_id", "invoice_num", "invoice_date", "invoice_amount")
    return S.invoices(t).select(F.lit(222).alias("application_id"), F.concat(F.lit("AR-"), F.col("trx_id").cast("string")).alias("entity_id"),
                                F.col("trx_id").alias("source_id"), "trx_number", "trx_date", "amount", "customer_id")


def source_documents(t: Tables, application: int, headers: DataFrame, months: tuple | None = None) -> DataFrame:
    """Headers of one application with event type, entity and document;
    ``months`` are those of the headers.  Both hops are plain: an event has a
    header in each ledger and an entity an event in each month, so no key is
    hot, and both tables are about as long as the headers."""
    only = F.col("application_id") == application
    return link_chain(headers.filter(only), [
        (accounting_events(t, months).filter(only), ["application_id", "event_id"], "inner", True),
        (transaction_entities(t, application, months), ["application_id", "entity_id"], "inner", True)], TENANT)


_HEADER_KEYS = ["application_id", "ledger_id", "ae_header_id"]


@register("j13_sla_distributions", S.with_sql(f"""
SELECT e.source_id AS customer_trx_id, i.trx_number, v.event_type_code, h.accounting_date, h.period_name, l.accounting_class_code,
       h.ledger_id, CAST(l.account AS BIGINT) AS gl_account, l.accounted_dr, l.accounted_cr
FROM xla_entities e JOIN xla_events v ON v.application_id = e.application_id AND v.entity_id = e.entity_id
JOIN xla_headers h ON h.application_id = v.application_id AND h.event_id = v.event_id
JOIN xla_lines l ON l.application_id = h.application_id AND l.ledger_id = h.ledger_id AND l.ae_header_id = h.ae_header_id
LEFT JOIN invoices i ON i.trx_id = e.source_id
WHERE e.application_id = 222 AND e.entity_code = 'TRANSACTIONS' AND h.accounting_date BETWEEN {D(PERIOD_FROM)} AND {D(PERIOD_TO)}""",
                                              "xla_entities", "xla_events", "xla_headers", "xla_lines", "invoices"))
def sla_distributions(t: Tables) -> DataFrame:
    """Accounting distributions of receivables transactions of the
    period.  The chain is followed from the header, one row each, to the
    document; the lines join last, once."""
    months = period_months(t)
    h = accounting_headers(t, months).filter(F.col("accounting_date").between(F.lit(t.params.date_from), F.lit(t.params.date_to)))
    docs = source_documents(t, 222, h, months).drop("event_id")
    lines = accounting_lines(t, months=months).filter(F.col("application_id") == 222)
    lines = lines.select(*_HEADER_KEYS, "accounting_class_code", "account", "accounted_dr", "accounted_cr")
    x = link_chain(lines, [(docs, _HEADER_KEYS, "inner", True)], TENANT)
    return x.select(F.col("source_id").alias("customer_trx_id"), "trx_number", "event_type_code", "accounting_date", "period_name",
                    "accounting_class_code", "ledger_id", F.col("account").alias("gl_account"), "accounted_dr", "accounted_cr")


@register("r_ap4_voucher_distributions", S.with_sql(f"""
SELECT e.source_id AS check_id, e.vendor_id, a.invoice_num, k.distributions, CAST(l.account AS BIGINT) AS account,
       CAST(COALESCE(SUM(l.accounted_dr), 0) - COALESCE(SUM(l.accounted_cr), 0) AS DECIMAL(38,2)) AS dist_debit
FROM xla_entities e JOIN xla_events v ON v.application_id = e.application_id AND v.entity_id = e.entity_id
JOIN xla_headers h ON h.application_id = v.application_id AND h.event_id = v.event_id
JOIN xla_lines l ON l.application_id = h.application_id AND l.ledger_id = h.ledger_id AND l.ae_header_id = h.ae_header_id
JOIN (SELECT application_id, ledger_id, ae_header_id, ae_line_num, COUNT(*) AS distributions FROM xla_links GROUP BY ALL) k
  ON k.application_id = l.application_id AND k.ledger_id = l.ledger_id AND k.ae_header_id = l.ae_header_id AND k.ae_line_num = l.ae_line_num
JOIN ap_invoices a ON a.order_id = e.source_id AND a.vendor_id = e.vendor_id
WHERE e.application_id = 200 AND v.event_type_code IN ('PAYMENT CREATED', 'INVOICE VALIDATED')
  AND l.accounting_class_code IN ('LIABILITY', 'LOSS', 'GAIN', 'ITEM EXPENSE') AND h.accounting_date BETWEEN {D(PERIOD_FROM)} AND {D(PERIOD_TO)}
GROUP BY e.source_id, e.vendor_id, a.invoice_num, k.distributions, l.account
HAVING COALESCE(SUM(l.accounted_dr), 0) - COALESCE(SUM(l.accounted_cr), 0) <> 0""", "xla_entities", "xla_events", "xla_headers", "xla_lines", "xla_links", "ap_invoices"))
def voucher_distributions(t: Tables) -> DataFrame:
    """R-AP4 (distribution set) over the chain: net debit per document and
    account, non-zero, with the number of distributions its lines link to.
    Links are counted per line before they are joined, so a line with two
    distributions counts once.  Lines and links number the same lines, the
    returned ones (payables) of the period's months, and share the shuffles."""
    months = period_months(t)
    h = accounting_headers(t, months).filter(F.col("accounting_date").between(F.lit(t.params.date_from), F.lit(t.params.date_to)))
    docs = source_documents(t, 200, h, months).filter(F.col("event_type_code").isin("PAYMENT CREATED", "INVOICE VALIDATED")).drop("event_id")
    returned = (F.col("l_returnflag") == "R") & F.to_date("l_shipdate").between(*months)
    lines = accounting_lines(t, numbered=True, months=months, only=returned).filter(
        (F.col("application_id") == 200) & F.col("accounting_class_code").isin("LIABILITY", "LOSS", "GAIN", "ITEM EXPENSE"))
    keys = [*_HEADER_KEYS, "ae_line_num"]
    links = distribution_links(t, months, returned).groupBy(*keys).agg(F.count(F.lit(1)).alias("distributions"))
    x = link_chain(lines.select(*keys, "account", "accounted_dr", "accounted_cr"), [(links, keys, "inner", True), (docs, _HEADER_KEYS, "inner", True)], TENANT)
    g = x.groupBy(F.col("source_id").alias("check_id"), "vendor_id", "invoice_num", "distributions", "account").agg(
        (F.coalesce(F.sum("accounted_dr"), F.lit(0)) - F.coalesce(F.sum("accounted_cr"), F.lit(0))).cast(TOTAL).alias("dist_debit"))
    return g.filter(F.col("dist_debit") != 0)


def distribution_links(t: Tables, months: tuple | None = None, only: Column | None = None) -> DataFrame:
    kinds = F.when(F.col("ae_line_num") % 2 == 0, F.array(F.lit("ITEM"), F.lit("TAX"))).otherwise(F.array(F.lit("ITEM")))
    return accounting_lines(t, numbered=True, months=months, only=only).select(*_HEADER_KEYS, "ae_line_num", "entity_id", F.explode(kinds).alias("distribution_type"))


@register("r_fx1_source_documents", S.with_sql(f"""
SELECT g.je_header_id, g.je_line_num, g.ledger_id, g.period_name, g.je_source, g.gl_date AS posted_date, CAST(g.account AS BIGINT) AS account,
       g.accounted_dr, g.accounted_cr,
       COALESCE(CASE WHEN s.application_id = 200 THEN 'AP Invoice' END, CASE WHEN s.application_id = 222 THEN 'AR Transaction' END,
                CASE WHEN fa.description IS NOT NULL THEN 'FA Transaction' END, 'Manual Journal') AS source_type,
       COALESCE(s.source_number, fa.asset_number) AS source_number, s.source_date, COALESCE(s.party_name, fa.description) AS party_name, s.source_amount
FROM journal_lines g
LEFT JOIN (SELECT l.gl_sl_link_id, l.ledger_id, l.application_id, COALESCE(a.invoice_num, i.trx_number) AS source_number,
                  COALESCE(a.invoice_date, i.trx_date) AS source_date, COALESCE(p.vendor_name, c.party_name) AS party_name,
                  CAST(COALESCE(a.invoice_amount, i.amount) AS DECIMAL(18,2)) AS source_amount
           FROM xla_lines l
           JOIN xla_headers h ON h.application_id = l.application_id AND h.ledger_id = l.ledger_id AND h.ae_header_id = l.ae_header_id
           JOIN xla_events v ON v.application_id = h.application_id AND v.event_id = h.event_id
           JOIN xla_entities e ON e.application_id = v.application_id AND e.entity_id = v.entity_id
           LEFT JOIN ap_invoices a ON e.application_id = 200 AND a.order_id = e.source_id AND a.vendor_id = e.vendor_id
           LEFT JOIN suppliers p ON p.supplier_id = a.vendor_id
           LEFT JOIN invoices i ON e.application_id = 222 AND i.trx_id = e.source_id
           LEFT JOIN customers c ON c.customer_id = i.customer_id) s ON s.gl_sl_link_id = g.je_header_id || '-' || g.je_line_num AND s.ledger_id = g.ledger_id
LEFT JOIN (SELECT asset_id, CAST(asset_id AS VARCHAR) AS asset_number, description FROM assets) fa
  ON g.je_source = 'Manual' AND g.account BETWEEN 1000 AND 1999 AND fa.asset_id = g.part_id
WHERE g.status = 'P' AND g.gl_date BETWEEN {D(PERIOD_FROM)} AND {D(PERIOD_TO)}""",
                                              "journal_lines", "xla_lines", "xla_headers", "xla_events", "xla_entities", "ap_invoices", "suppliers",
                                              "invoices", "customers", "assets"))
def fx1_source_documents(t: Tables) -> DataFrame:
    """R-FX1 over the chain: every posted journal line of the period with the
    payables invoice, receivables transaction or asset it came from (type,
    number, date, party, amount), else 'Manual Journal'.  Headers of the
    period's months are followed to their documents first."""
    months = period_months(t)
    g = S.journal_lines(t, numbered=True).filter((F.col("status") == "P") & F.col("gl_date").between(F.lit(t.params.date_from), F.lit(t.params.date_to)))
    link = F.concat(F.col("je_header_id").cast("string"), F.lit("-"), F.col("je_line_num").cast("string"))
    g = g.withColumn("gl_sl_link_id", link).withColumn("asset_id", F.when((F.col("je_source") == "Manual") & F.col("account").between(1000, 1999), F.col("part_id")))
    h = accounting_headers(t, months)

    def documents(application, number, date, amount, names, key):
        d = link_chain(source_documents(t, application, h, months), [(names, [key], "left")])
        return d.select(*_HEADER_KEYS, F.col(number).alias("source_number"), F.col(date).alias("source_date"), "party",
                        F.col(amount).cast(MONEY).alias("source_amount"))

    vendors = S.suppliers(t).select(F.col("supplier_id").alias("vendor_id"), F.col("vendor_name").alias("party"))
    buyers = S.customers(t).select("customer_id", F.col("party_name").alias("party"))
    docs = documents(200, "invoice_num", "invoice_date", "invoice_amount", vendors, "vendor_id").unionByName(
        documents(222, "trx_number", "trx_date", "amount", buyers, "customer_id"))
    refs = accounting_lines(t, numbered=True, months=months).select(*_HEADER_KEYS, "gl_sl_link_id")
    refs = link_chain(refs, [(docs, _HEADER_KEYS, "inner", True)], TENANT).drop("ae_header_id")
    fa = assets(t).select("asset_id", F.col("asset_id").cast("string").alias("asset_number"), F.col("description").alias("asset_text"))
    x = link_chain(g, [(refs, ["gl_sl_link_id", "ledger_id"], "left", True), (fa, ["asset_id"], "left")], ("ledger_id",))
    kind = (F.when(F.col("application_id") == 200, "AP Invoice").when(F.col("application_id") == 222, "AR Transaction")
            .when(F.col("asset_text").isNotNull(), "FA Transaction").otherwise("Manual Journal"))
    return x.select("je_header_id", "je_line_num", "ledger_id", "period_name", "je_source", F.col("gl_date").alias("posted_date"), "account",
                    "accounted_dr", "accounted_cr", kind.alias("source_type"), F.coalesce("source_number", "asset_number").alias("source_number"),
                    "source_date", F.coalesce("party", "asset_text").alias("party_name"), "source_amount")
