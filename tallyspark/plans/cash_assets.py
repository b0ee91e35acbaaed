"""Cash management (R-CM*) and fixed assets (R-FA*).

Bank side: statement lines per invoice, book transactions matched by id
(FIXTURES part 2).  Assets: one asset per part, placed in service at the
part's first shipment, cost = retail price, 60-month straight line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.params import AS_OF, PERIOD_FROM, PERIOD_TO
from tallyspark.functions.scalars import MONEY, TOTAL, cents, div_round, money, sql_div_round, sql_percent
from tallyspark.operators import windows as W
from tallyspark.plans.registry import register
from tallyspark.sources import standins as S
from tallyspark.sources.tables import Tables

D = S._d
LIFE_MONTHS = 60

_CM1_SQL = S.with_sql("""
SELECT DISTINCT b.bank_account_id, n.n_name AS bank_account_name, 'ACTIVE' AS status
FROM bank_statement_lines b JOIN nation n ON n.n_nationkey = b.bank_account_id""", "bank_statement_lines")


@register("r_cm1_active_bank_accounts", _CM1_SQL)
def active_bank_accounts(t: Tables) -> DataFrame:
    """R-CM1: bank accounts with statement activity and no end date."""
    b = S.bank_statement_lines(t).select("bank_account_id").distinct()
    n = F.broadcast(t.nation.select(F.col("n_nationkey").alias("bank_account_id"), F.col("n_name").alias("bank_account_name")))
    return b.join(n, "bank_account_id").withColumn("status", F.lit("ACTIVE"))


_CM4_SQL = S.with_sql(f"""
SELECT bank_account_id, statement_line_id, statement_date, statement_amount,
       CAST(SUM(statement_amount) OVER (PARTITION BY bank_account_id ORDER BY statement_date, statement_line_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DECIMAL(38,2)) AS running_balance
FROM bank_statement_lines WHERE statement_date BETWEEN {D(PERIOD_FROM)} AND {D(PERIOD_TO)}""", "bank_statement_lines")


@register("r_cm4_statement_running_balance", _CM4_SQL)
def statement_running_balance(t: Tables) -> DataFrame:
    """R-CM4: statement lines with a running balance from the control
    balance (0) per bank account; skew-safe W1 chunked by date."""
    b = S.bank_statement_lines(t).filter(F.col("statement_date").between(F.lit(t.params.date_from), F.lit(t.params.date_to)))
    b = b.select("bank_account_id", "statement_line_id", "statement_date", "statement_amount")
    out = W.running_total(b, ["bank_account_id"], ["statement_date", "statement_line_id"], "statement_amount",
                          "running_balance", chunk="statement_date")
    return out.withColumn("running_balance", F.col("running_balance").cast(TOTAL))


_CM5_SQL = S.with_sql("""
SELECT s.statement_line_id, s.statement_amount, b.book_amount,
       CASE WHEN b.book_trx_id IS NULL THEN 'UNMATCHED'
            WHEN abs(s.statement_amount - b.book_amount) < 0.01 THEN 'MATCHED' ELSE 'VARIANCE' END AS match_status,
       CAST(COALESCE(b.book_amount - s.statement_amount, 0) AS DECIMAL(18,2)) AS variance
FROM bank_statement_lines s LEFT JOIN book_transactions b ON b.book_trx_id = s.statement_line_id""",
                      "bank_statement_lines", "book_transactions")


def _reconcile(t: Tables) -> DataFrame:
    s = S.bank_statement_lines(t)
    b = S.book_transactions(t)
    j = s.join(b, s.statement_line_id == b.book_trx_id, "left")
    status = (F.when(F.col("book_trx_id").isNull(), "UNMATCHED")
              .when(F.abs(F.col("statement_amount") - F.col("book_amount")) < F.lit(0.01).cast("decimal(3,2)"), "MATCHED")
              .otherwise("VARIANCE"))
    return j.select("statement_line_id", "statement_amount", "book_amount", status.alias("match_status"),
                    F.coalesce(F.col("book_amount") - F.col("statement_amount"), F.lit(0)).cast(MONEY).alias("variance"))


@register("r_cm5_statement_reconciliation", _CM5_SQL)
def statement_reconciliation(t: Tables) -> DataFrame:
    """R-CM5: matched / variance (tolerance 0.01) / unmatched per statement line."""
    return _reconcile(t)


@register("r_cm7_reconciled_variances", S.with_sql("""
SELECT s.statement_line_id, CAST(b.book_amount - s.statement_amount AS DECIMAL(18,2)) AS variance
FROM bank_statement_lines s JOIN book_transactions b ON b.book_trx_id = s.statement_line_id
WHERE abs(s.statement_amount - b.book_amount) >= 0.01""", "bank_statement_lines", "book_transactions"))
def reconciled_variances(t: Tables) -> DataFrame:
    """R-CM7: reconciled lines that carry a variance."""
    r = _reconcile(t).filter(F.col("match_status") == "VARIANCE")
    return r.select("statement_line_id", "variance")


_CM6_SQL = S.with_sql(f"""
SELECT d.bank_account_id, d.statement_date, d.inflow, d.outflow,
       CAST(COALESCE(o.opening, 0) + SUM(d.inflow - d.outflow) OVER (PARTITION BY d.bank_account_id ORDER BY d.statement_date
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DECIMAL(38,2)) AS closing_balance
FROM (SELECT bank_account_id, statement_date,
             CAST(SUM(CASE WHEN statement_amount > 0 THEN statement_amount ELSE 0 END) AS DECIMAL(38,2)) AS inflow,
             CAST(SUM(CASE WHEN statement_amount < 0 THEN -statement_amount ELSE 0 END) AS DECIMAL(38,2)) AS outflow
      FROM bank_statement_lines WHERE statement_date BETWEEN {D(PERIOD_FROM)} AND {D(PERIOD_TO)}
      GROUP BY bank_account_id, statement_date) d
LEFT JOIN (SELECT bank_account_id, SUM(statement_amount) AS opening FROM bank_statement_lines
           WHERE statement_date < {D(PERIOD_FROM)} GROUP BY bank_account_id) o ON o.bank_account_id = d.bank_account_id""",
                      "bank_statement_lines")


@register("r_cm6_cash_book", _CM6_SQL)
def cash_book(t: Tables) -> DataFrame:
    """R-CM6: daily cash book per account: opening, inflow, outflow and a
    running closing balance (window over one row per account and day)."""
    s = S.bank_statement_lines(t)
    per_day = (s.filter(F.col("statement_date").between(F.lit(t.params.date_from), F.lit(t.params.date_to)))
               .groupBy("bank_account_id", "statement_date").agg(
                   F.sum(F.when(F.col("statement_amount") > 0, F.col("statement_amount")).otherwise(0)).cast(TOTAL).alias("inflow"),
                   F.sum(F.when(F.col("statement_amount") < 0, -F.col("statement_amount")).otherwise(0)).cast(TOTAL).alias("outflow")))
    opening = (s.filter(F.col("statement_date") < F.lit(t.params.date_from)).groupBy("bank_account_id")
               .agg(F.sum("statement_amount").alias("opening")))
    run = W.running_total(per_day, ["bank_account_id"], ["statement_date"], F.col("inflow") - F.col("outflow"), "run")
    run = run.join(opening, "bank_account_id", "left")
    return run.select("bank_account_id", "statement_date", "inflow", "outflow",
                      (F.coalesce("opening", F.lit(0)) + F.col("run")).cast(TOTAL).alias("closing_balance"))


# ---------------------------------------------------------------------------
# Fixed assets
# ---------------------------------------------------------------------------

def assets(t: Tables) -> DataFrame:
    """Asset per part: in service at its first shipment, cost = retail price."""
    first = t.lineitem.groupBy(F.col("l_partkey").alias("asset_id")).agg(
        F.min(F.to_date("l_shipdate")).alias("date_placed_in_service"))
    p = t.part.select(F.col("p_partkey").alias("asset_id"), F.col("p_name").alias("description"),
                      money("p_retailprice").alias("cost"), F.col("p_brand").alias("category"))
    return p.join(first, "asset_id").withColumn("book", F.lit("CORP")).withColumn("life_in_months", F.lit(LIFE_MONTHS))


S._cte("assets", (), f"""
SELECT p_partkey AS asset_id, p_name AS description, CAST(p_retailprice AS DECIMAL(18,2)) AS cost,
       p_brand AS category, f.date_placed_in_service, 'CORP' AS book, {LIFE_MONTHS} AS life_in_months
FROM part JOIN (SELECT l_partkey, MIN(CAST(l_shipdate AS DATE)) AS date_placed_in_service
                FROM lineitem GROUP BY l_partkey) f ON f.l_partkey = p_partkey""")


@register("r_fa1_asset_listing", S.with_sql("""
SELECT book, category, COUNT(*) AS asset_count, CAST(SUM(cost) AS DECIMAL(38,2)) AS total_cost
FROM assets GROUP BY book, category""", "assets"))
def asset_listing(t: Tables) -> DataFrame:
    """R-FA1: asset listing by book and category."""
    return assets(t).groupBy("book", "category").agg(F.count(F.lit(1)).alias("asset_count"),
                                                     F.sum("cost").cast(TOTAL).alias("total_cost"))


def _months_used(as_of_lit) -> F.Column:
    m = (F.year(as_of_lit) - F.year("date_placed_in_service")) * 12 + F.month(as_of_lit) - F.month("date_placed_in_service") + 1
    return F.greatest(F.least(m, F.col("life_in_months")), F.lit(0))


_MONTHS_SQL = (f"GREATEST(LEAST((year({D(AS_OF)}) - year(date_placed_in_service)) * 12 + month({D(AS_OF)}) "
               f"- month(date_placed_in_service) + 1, life_in_months), 0)")


@register("r_fa2_asset_register", S.with_sql(f"""
SELECT asset_id, cost, date_placed_in_service, months_used,
       CAST({sql_div_round('CAST(cost * 100 AS BIGINT) * months_used', 'life_in_months * 100')} AS DECIMAL(18,2)) AS reserve,
       CAST(cost - {sql_div_round('CAST(cost * 100 AS BIGINT) * months_used', 'life_in_months * 100')} AS DECIMAL(18,2)) AS net_book_value,
       life_in_months - months_used AS remaining_life
FROM (SELECT *, {_MONTHS_SQL} AS months_used FROM assets WHERE date_placed_in_service <= {D(AS_OF)}) a""", "assets"))
def asset_register(t: Tables) -> DataFrame:
    """R-FA2: cost, reserve at the period (straight line, exact cents),
    net book value and remaining life."""
    a = assets(t).filter(F.col("date_placed_in_service") <= F.lit(t.params.as_of))
    a = a.withColumn("months_used", _months_used(F.lit(t.params.as_of)).cast("bigint"))
    reserve = div_round(cents("cost") * F.col("months_used"), F.col("life_in_months") * 100, 2).cast(MONEY)
    return a.select("asset_id", "cost", "date_placed_in_service", "months_used", reserve.alias("reserve"),
                    (F.col("cost") - reserve).cast(MONEY).alias("net_book_value"),
                    (F.col("life_in_months") - F.col("months_used")).cast("bigint").alias("remaining_life"))


@register("r_fa3_depreciation_schedule", S.with_sql(f"""
SELECT asset_id, y AS fiscal_year,
       CAST({sql_div_round('CAST(cost * 100 AS BIGINT) * m', 'life_in_months * 100')} AS DECIMAL(18,2)) AS depreciation
FROM (SELECT asset_id, cost, life_in_months, y,
             GREATEST(LEAST(y * 12 + 12, year(date_placed_in_service) * 12 + month(date_placed_in_service) - 1 + life_in_months)
                      - GREATEST(y * 12, year(date_placed_in_service) * 12 + month(date_placed_in_service) - 1), 0) AS m
      FROM assets, unnest(generate_series(year(date_placed_in_service), year(date_placed_in_service) + 5)) AS g(y)) x
WHERE m > 0""", "assets"))
def depreciation_schedule(t: Tables) -> DataFrame:
    """R-FA3: depreciation per asset and fiscal year (months in the year x
    monthly rate, exact cents); one row per asset-year (bounded by life)."""
    a = assets(t)
    start = F.year("date_placed_in_service") * 12 + F.month("date_placed_in_service") - 1
    a = a.withColumn("y", F.explode(F.sequence(F.year("date_placed_in_service"), F.year("date_placed_in_service") + 5)))
    m = F.greatest(F.least(F.col("y") * 12 + 12, start + F.col("life_in_months")) - F.greatest(F.col("y") * 12, start), F.lit(0))
    a = a.withColumn("m", m).filter(F.col("m") > 0)
    return a.select("asset_id", F.col("y").cast("bigint").alias("fiscal_year"),
                    div_round(cents("cost") * F.col("m"), F.col("life_in_months") * 100, 2).cast(MONEY).alias("depreciation"))


# Retirement rule of the asset stand-in (parts of size 48+
# retire at their last shipment) and the proceeds share of cost, percent.
RETIRE_MIN_SIZE = 48
PROCEEDS_PCT = 40


def _retirements(t: Tables) -> DataFrame:
    last = t.lineitem.groupBy(F.col("l_partkey").alias("asset_id")).agg(F.max(F.to_date("l_shipdate")).alias("retire_date"))
    big = t.part.filter(F.col("p_size") >= RETIRE_MIN_SIZE).select(F.col("p_partkey").alias("asset_id"))
    return assets(t).join(big, "asset_id", "left_semi").join(last, "asset_id")


@register("r_fa4_retirements", S.with_sql(f"""
SELECT asset_id, retire_date, cost, nbv, proceeds, CAST(proceeds - nbv AS DECIMAL(18,2)) AS gain_loss,
       CASE WHEN proceeds - nbv > 0 THEN 'GAIN' WHEN proceeds - nbv < 0 THEN 'LOSS' ELSE 'NONE' END AS gain_loss_class
FROM (SELECT a.asset_id, r.retire_date, a.cost,
             CAST(a.cost - {sql_div_round('CAST(a.cost * 100 AS BIGINT) * LEAST((year(r.retire_date) - year(a.date_placed_in_service)) * 12 + month(r.retire_date) - month(a.date_placed_in_service) + 1, a.life_in_months)', 'a.life_in_months * 100')} AS DECIMAL(18,2)) AS nbv,
             {sql_div_round(f'CAST(a.cost * 100 AS BIGINT) * {PROCEEDS_PCT}', '10000')} AS proceeds
      FROM assets a JOIN part p ON p.p_partkey = a.asset_id AND p.p_size >= {RETIRE_MIN_SIZE}
      JOIN (SELECT l_partkey, MAX(CAST(l_shipdate AS DATE)) AS retire_date FROM lineitem GROUP BY l_partkey) r
        ON r.l_partkey = a.asset_id) x""", "assets"))
def retirements(t: Tables) -> DataFrame:
    """R-FA4: retirements with net book value at retirement, proceeds, and
    the gain/loss class (DECODE of the sign, X2)."""
    r = _retirements(t)
    used = F.least((F.year("retire_date") - F.year("date_placed_in_service")) * 12 + F.month("retire_date")
                   - F.month("date_placed_in_service") + 1, F.col("life_in_months"))
    nbv = (F.col("cost") - div_round(cents("cost") * used, F.col("life_in_months") * 100, 2)).cast(MONEY)
    proceeds = div_round(cents("cost") * PROCEEDS_PCT, F.lit(10000), 2)
    gl = (proceeds - nbv).cast(MONEY)
    cls = F.when(gl > 0, "GAIN").when(gl < 0, "LOSS").otherwise("NONE")
    return r.select("asset_id", "retire_date", "cost", nbv.alias("nbv"), proceeds.alias("proceeds"),
                    gl.alias("gain_loss"), cls.alias("gain_loss_class"))


@register("r_fa5_adjustment_history", S.with_sql("""
SELECT l_partkey AS asset_id, CAST(l_shipdate AS DATE) AS adjustment_date,
       CASE WHEN l_linestatus = 'F' THEN 'DR' ELSE 'CR' END AS debit_credit_flag,
       CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CASE WHEN l_linestatus = 'F' THEN 1 ELSE -1 END AS DECIMAL(18,2)) AS signed_amount
FROM lineitem WHERE l_returnflag = 'R'"""))
def adjustment_history(t: Tables) -> DataFrame:
    """R-FA5: cost adjustments per asset (returned lines), signed by the
    debit/credit flag."""
    from tallyspark.functions.scalars import decode
    li = t.lineitem.filter(F.col("l_returnflag") == "R")
    flag = F.when(F.col("l_linestatus") == "F", "DR").otherwise("CR")
    sign = decode(flag, [("DR", 1), ("CR", -1)], 0)
    return li.select(F.col("l_partkey").alias("asset_id"), F.to_date("l_shipdate").alias("adjustment_date"),
                     flag.alias("debit_credit_flag"), (money("l_extendedprice") * sign).cast(MONEY).alias("signed_amount"))


@register("r_fa6_asset_distribution", S.with_sql(f"""
SELECT d.asset_id, d.location_id, n.n_name AS location, s.s_name AS assignee, d.units,
       {sql_percent('d.units', 't.total_units')} AS unit_share_pct
FROM (SELECT l_partkey AS asset_id, l_suppkey AS location_id, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS units
      FROM lineitem WHERE CAST(l_shipdate AS DATE) <= {D(AS_OF)} GROUP BY 1, 2) d
JOIN (SELECT l_partkey AS asset_id, SUM(CAST(l_quantity AS BIGINT)) AS total_units FROM lineitem
      WHERE CAST(l_shipdate AS DATE) <= {D(AS_OF)} GROUP BY 1) t ON t.asset_id = d.asset_id
JOIN supplier s ON s.s_suppkey = d.location_id JOIN nation n ON n.n_nationkey = s.s_nationkey"""))
def asset_distribution(t: Tables) -> DataFrame:
    """R-FA6: units of each asset per location at the date, with its share
    of the asset's units (W3 as aggregate + join back), location and assignee."""
    from tallyspark.functions.scalars import percent
    li = t.lineitem.filter(F.to_date("l_shipdate") <= F.lit(t.params.as_of))
    d = li.groupBy(F.col("l_partkey").alias("asset_id"), F.col("l_suppkey").alias("location_id")).agg(
        F.sum(F.col("l_quantity").cast("bigint")).alias("units"))
    d = W.partition_total(d, ["asset_id"], "units", "total_units")
    s = t.supplier.select(F.col("s_suppkey").alias("location_id"), F.col("s_name").alias("assignee"), "s_nationkey")
    n = F.broadcast(t.nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("location")))
    j = d.join(s, "location_id").join(n, "s_nationkey")
    return j.select("asset_id", "location_id", "location", "assignee", "units",
                    percent("units", "total_units").alias("unit_share_pct"))


_REGISTER_RESERVE = sql_div_round("CAST(cost * 100 AS BIGINT) * months_used", "life_in_months * 100")


@register("r_fa2_asset_register_by_location", S.with_sql(f"""
SELECT a.asset_id, a.description, a.category, a.book, a.date_placed_in_service, a.life_in_months, a.life_in_months - a.months_used AS remaining_life,
       a.cost, CAST({_REGISTER_RESERVE} AS DECIMAL(18,2)) AS accumulated_depreciation, CAST(a.cost - {_REGISTER_RESERVE} AS DECIMAL(18,2)) AS net_book_value,
       p.location_id, n.n_name AS location, s.s_name AS employee_name, p.distribution_pct
FROM (SELECT *, {_MONTHS_SQL} AS months_used FROM assets WHERE date_placed_in_service <= {D(AS_OF)}) a
LEFT JOIN (SELECT asset_id, location_id, {sql_percent('units', 'total_units')} AS distribution_pct
           FROM (SELECT l_partkey AS asset_id, l_suppkey AS location_id, SUM(CAST(l_quantity AS BIGINT)) AS units,
                        SUM(SUM(CAST(l_quantity AS BIGINT))) OVER (PARTITION BY l_partkey) AS total_units,
                        ROW_NUMBER() OVER (PARTITION BY l_partkey ORDER BY l_suppkey) AS rn
                 FROM lineitem WHERE CAST(l_shipdate AS DATE) <= {D(AS_OF)} GROUP BY l_partkey, l_suppkey) d WHERE rn = 1) p ON p.asset_id = a.asset_id
LEFT JOIN supplier s ON s.s_suppkey = p.location_id LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey""", "assets"))
def asset_register_by_location(t: Tables) -> DataFrame:
    """R-FA2 with each asset's primary distribution: its first location, whom
    it is assigned to there, and that location's share of the asset's units.

    Location and total come from two partial aggregations, by asset and
    location and then by asset, without a window over an asset's rows."""
    from tallyspark.functions.scalars import percent
    as_of = F.lit(t.params.as_of)
    a = assets(t).filter(F.col("date_placed_in_service") <= as_of)
    a = a.withColumn("months_used", _months_used(as_of).cast("bigint"))
    reserve = div_round(cents("cost") * F.col("months_used"), F.col("life_in_months") * 100, 2).cast(MONEY)
    d = t.lineitem.filter(F.to_date("l_shipdate") <= as_of).groupBy(F.col("l_partkey").alias("asset_id"), F.col("l_suppkey").alias("at")).agg(
        F.sum(F.col("l_quantity").cast("bigint")).alias("units"))
    p = d.groupBy("asset_id").agg(F.min(F.struct("at", "units")).alias("first"), F.sum("units").alias("total_units"))
    p = p.select("asset_id", F.col("first.at").alias("location_id"), percent(F.col("first.units"), "total_units").alias("distribution_pct"))
    s = t.supplier.select(F.col("s_suppkey").alias("location_id"), F.col("s_name").alias("employee_name"), "s_nationkey")
    n = F.broadcast(t.nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("location")))
    j = a.join(p, "asset_id", "left").join(s, "location_id", "left").join(n, "s_nationkey", "left")
    return j.select("asset_id", "description", "category", "book", "date_placed_in_service", "life_in_months",
                    (F.col("life_in_months") - F.col("months_used")).cast("bigint").alias("remaining_life"), "cost",
                    reserve.alias("accumulated_depreciation"), (F.col("cost") - reserve).cast(MONEY).alias("net_book_value"),
                    "location_id", "location", "employee_name", "distribution_pct")
