"""General-ledger reports (R-GL*) over the journal-line and balance stand-ins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.params import PERIOD_TO, literal
from tallyspark.functions.scalars import TOTAL
from tallyspark.operators import windows as W
from tallyspark.plans.generic import _account_class_sql, account_class
from tallyspark.plans.registry import register
from tallyspark.sources import standins as S
from tallyspark.sources.tables import Tables

# The trial-balance period is the month of the period parameter's end.
PERIOD = f"(year({literal(PERIOD_TO)}) * 100 + month({literal(PERIOD_TO)}))"
YEAR_START = f"(year({literal(PERIOD_TO)}) * 100 + 1)"


def _period(t: Tables) -> int:
    return t.params.date_to.year * 100 + t.params.date_to.month



_GL1_SQL = S.with_sql(f"""
SELECT r.r_name AS ledger_name, b.account, b.begin_balance, b.period_net_dr, b.period_net_cr,
       CAST(b.begin_balance + b.period_net_dr - b.period_net_cr AS DECIMAL(38,2)) AS end_balance
FROM gl_balances b JOIN region r ON r.r_regionkey = b.ledger_id
WHERE b.period_num = {PERIOD}""", "gl_balances")


@register("r_gl1_trial_balance", _GL1_SQL)
def trial_balance(t: Tables) -> DataFrame:
    """R-GL1: trial balance of one period: begin, period debit/credit, end."""
    b = S.gl_balances(t, _period(t)).filter(F.col("period_num") == _period(t))
    r = F.broadcast(t.region.select(F.col("r_regionkey").alias("ledger_id"), F.col("r_name").alias("ledger_name")))
    return b.join(r, "ledger_id").select(
        "ledger_name", "account", "begin_balance", "period_net_dr", "period_net_cr",
        (F.col("begin_balance") + F.col("period_net_dr") - F.col("period_net_cr")).cast(TOTAL).alias("end_balance"))


_GL2_SQL = S.with_sql("""
SELECT je_header_id, je_line_num, account, accounted_dr, accounted_cr,
       CAST(SUM(COALESCE(accounted_dr, 0)) OVER w AS DECIMAL(38,2)) AS running_dr,
       CAST(SUM(COALESCE(accounted_cr, 0)) OVER w AS DECIMAL(38,2)) AS running_cr,
       COUNT(*) OVER (PARTITION BY je_header_id) AS line_count
FROM journal_lines
WINDOW w AS (PARTITION BY je_header_id ORDER BY je_line_num ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
                      "journal_lines")


@register("r_gl2_journal_voucher", _GL2_SQL)
def journal_voucher(t: Tables) -> DataFrame:
    """R-GL2: journal voucher lines with running debit/credit and the line
    count; running sums in two levels (blocks of lines, then block offsets)."""
    jl = S.journal_lines(t, numbered=True).select("je_header_id", "je_line_num", F.col("je_line_count").alias("line_count"),
                                   "account", "accounted_dr", "accounted_cr")
    # chunks of 1024 lines: a huge journal is summed by many tasks; both
    # running sums come from the same two-level pass
    jl = jl.withColumn("line_block", F.floor(F.col("je_line_num") / 1024))
    jl = W.running_totals(jl, ["je_header_id"], ["line_block", "je_line_num"],
                          {"running_dr": F.coalesce("accounted_dr", F.lit(0)),
                           "running_cr": F.coalesce("accounted_cr", F.lit(0))}, chunk="line_block")
    return (jl.drop("line_block").withColumn("running_dr", F.col("running_dr").cast(TOTAL))
              .withColumn("running_cr", F.col("running_cr").cast(TOTAL)))


_GL3_SQL = S.with_sql("""
SELECT l.je_header_id, l.je_line_num, l.je_source, l.period_name, l.account, l.accounted_dr, l.accounted_cr,
       h.header_dr, h.header_cr
FROM journal_lines l JOIN (SELECT je_header_id, CAST(SUM(COALESCE(accounted_dr, 0)) AS DECIMAL(38,2)) AS header_dr,
                                  CAST(SUM(COALESCE(accounted_cr, 0)) AS DECIMAL(38,2)) AS header_cr
                           FROM journal_lines GROUP BY je_header_id) h ON h.je_header_id = l.je_header_id
WHERE l.status = 'P'""", "journal_lines")


@register("r_gl3_journal_register", _GL3_SQL)
def journal_register(t: Tables) -> DataFrame:
    """R-GL3: posted journal lines with their header totals beside them
    (pre-aggregated per header, then joined with salt: A8 + J1); the totals
    come from unnumbered lines, so that numbering runs once."""
    jl = S.journal_lines(t, numbered=True)
    hdr = S.journal_lines(t).groupBy("je_header_id").agg(
        F.sum(F.coalesce("accounted_dr", F.lit(0))).cast(TOTAL).alias("header_dr"),
        F.sum(F.coalesce("accounted_cr", F.lit(0))).cast(TOTAL).alias("header_cr"))
    lines = jl.filter(F.col("status") == "P").select("je_header_id", "je_line_num", "je_source", "period_name",
                                                     "account", "accounted_dr", "accounted_cr")
    return W.join_back(lines, hdr, ["je_header_id"])


_GL4_SQL = S.with_sql(f"""
SELECT x.*, CAST(SUM(end_balance) OVER (PARTITION BY account_type) AS DECIMAL(38,2)) AS type_total,
       CAST(SUM(end_balance) OVER () AS DECIMAL(38,2)) AS grand_total
FROM (SELECT {_account_class_sql('account')} AS account_type, account,
             CAST(SUM(begin_balance) AS DECIMAL(38,2)) AS begin_balance,
             CAST(SUM(period_net_dr - period_net_cr) AS DECIMAL(38,2)) AS activity,
             CAST(SUM(begin_balance + period_net_dr - period_net_cr) AS DECIMAL(38,2)) AS end_balance
      FROM gl_balances WHERE period_num = {PERIOD} GROUP BY 1, 2) x""", "gl_balances")


@register("r_gl4_enhanced_trial_balance", _GL4_SQL)
def enhanced_trial_balance(t: Tables) -> DataFrame:
    """R-GL4: account type, begin, activity, end, type total (W3) and grand
    total (W4) -- windows over the per-account aggregate (bounded by the
    chart of accounts), so the journal is aggregated once."""
    b = S.gl_balances(t, _period(t)).filter(F.col("period_num") == _period(t))
    g = b.groupBy(account_class("account").alias("account_type"), "account").agg(
        F.sum("begin_balance").cast(TOTAL).alias("begin_balance"),
        F.sum(F.col("period_net_dr") - F.col("period_net_cr")).cast(TOTAL).alias("activity"),
        F.sum(F.col("begin_balance") + F.col("period_net_dr") - F.col("period_net_cr")).cast(TOTAL).alias("end_balance"))
    # one row per account: bounded by the chart of accounts, not the data
    g = W.partition_total(g, ["account_type"], "end_balance", "type_total", bounded=True)
    g = W.grand_total(g, "end_balance", "grand_total", bounded=True)
    return g.withColumn("type_total", F.col("type_total").cast(TOTAL)).withColumn("grand_total", F.col("grand_total").cast(TOTAL))


_GL5_SQL = S.with_sql("""
SELECT je_source, CASE je_source WHEN 'Receivables' THEN 'AR Invoice' WHEN 'Payables' THEN 'AP Invoice'
                                 ELSE 'Manual Journal' END AS source_document_type,
       COUNT(*) AS line_count
FROM journal_lines GROUP BY 1, 2""", "journal_lines")


@register("r_gl5_source_document_type", _GL5_SQL)
def source_document_type(t: Tables) -> DataFrame:
    """R-GL5: source document type of journal lines (DECODE of the source)."""
    from tallyspark.functions.scalars import decode
    jl = S.journal_lines(t)
    doc = decode("je_source", [("Receivables", "AR Invoice"), ("Payables", "AP Invoice")], "Manual Journal")
    return jl.groupBy("je_source", doc.alias("source_document_type")).agg(F.count(F.lit(1)).alias("line_count"))


_GL6_SQL = S.with_sql(f"""
SELECT ledger_id, account, begin_balance,
       CAST(period_net_dr - period_net_cr AS DECIMAL(38,2)) AS period_balance,
       CAST(ytd AS DECIMAL(38,2)) AS ytd_activity,
       CAST(begin_balance + period_net_dr - period_net_cr AS DECIMAL(38,2)) AS end_balance
FROM (SELECT b.*, SUM(period_net_dr - period_net_cr) OVER (PARTITION BY ledger_id, account ORDER BY period_num
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ytd
      FROM gl_balances b WHERE period_num BETWEEN {YEAR_START} AND {PERIOD}) x
WHERE period_num = {PERIOD}""", "gl_balances")


@register("r_gl6_period_ytd_balances", _GL6_SQL)
def period_ytd_balances(t: Tables) -> DataFrame:
    """R-GL6: period, beginning, year-to-date and ending balance per account
    -- one aggregation over the year's balance rows (YTD as a sum, the
    period's own figures picked with conditional aggregates)."""
    b = S.gl_balances(t, _period(t)).filter(F.col("period_num").between(_period(t) // 100 * 100 + 1, _period(t)))
    cur = F.col("period_num") == _period(t)
    net = F.col("period_net_dr") - F.col("period_net_cr")
    g = b.groupBy("ledger_id", "account").agg(
        F.max(F.when(cur, F.col("begin_balance"))).alias("begin_balance"),
        F.max(F.when(cur, net)).alias("period_balance"),
        F.sum(net).alias("ytd_activity"), F.max(F.when(cur, F.lit(1))).alias("has_period"))
    g = g.filter(F.col("has_period") == 1)
    return g.select("ledger_id", "account", F.col("begin_balance").cast(TOTAL).alias("begin_balance"),
                    F.col("period_balance").cast(TOTAL).alias("period_balance"),
                    F.col("ytd_activity").cast(TOTAL).alias("ytd_activity"),
                    (F.col("begin_balance") + F.col("period_balance")).cast(TOTAL).alias("end_balance"))


_GL7_SQL = S.with_sql(f"""
SELECT DISTINCT account, CAST(account // 1000 AS BIGINT) AS segment1, CAST((account % 1000) // 100 AS BIGINT) AS segment2,
       CAST(account % 100 AS BIGINT) AS segment3, {_account_class_sql('account')} AS account_type,
       CASE WHEN account % 100 < 50 THEN 'TRADE' ELSE 'INTERCOMPANY' END AS trade_flag
FROM journal_lines""", "journal_lines")


@register("r_gl7_account_hierarchy", _GL7_SQL)
def account_hierarchy(t: Tables) -> DataFrame:
    """R-GL7/X16: account split into segments, type and trade/intercompany rule."""
    a = S.journal_lines(t).select("account").distinct()
    return a.select(
        "account", F.floor(F.col("account") / 1000).cast("bigint").alias("segment1"),
        F.floor((F.col("account") % 1000) / 100).cast("bigint").alias("segment2"),
        (F.col("account") % 100).cast("bigint").alias("segment3"),
        account_class("account").alias("account_type"),
        F.when(F.col("account") % 100 < 50, "TRADE").otherwise("INTERCOMPANY").alias("trade_flag"))


_GL8_SQL = S.with_sql("""
SELECT period_name, COUNT(*) AS posted_lines,
       CAST(SUM(COALESCE(accounted_dr, 0) - COALESCE(accounted_cr, 0)) AS DECIMAL(38,2)) AS net
FROM journal_lines WHERE status = 'P' AND period_num BETWEEN 200001 AND 200012
GROUP BY period_name""", "journal_lines")


@register("r_gl8_posted_open_periods", _GL8_SQL)
def posted_open_periods(t: Tables) -> DataFrame:
    """R-GL8: posted journals limited to the open periods (year 2000)."""
    jl = S.journal_lines(t).filter((F.col("status") == "P") & F.col("period_num").between(200001, 200012))
    return jl.groupBy("period_name").agg(
        F.count(F.lit(1)).alias("posted_lines"),
        F.sum(F.coalesce("accounted_dr", F.lit(0)) - F.coalesce("accounted_cr", F.lit(0))).cast(TOTAL).alias("net"))
