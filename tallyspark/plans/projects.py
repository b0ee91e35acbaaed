"""Projects and costing (R-PJ*, R-CO*).

Cost items come from the project-cost stand-in; plan versions from the
plan-version stand-in.  Inception/year/period-to-date sums are one
conditional-sum pass (A15) instead of three scalar subqueries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.params import AS_OF
from tallyspark.functions.scalars import TOTAL, decode, money, round_money, sql_div_round
from tallyspark.operators import effective as E
from tallyspark.operators import rollup as A
from tallyspark.plans.registry import register
from tallyspark.sources import standins as S
from tallyspark.sources.tables import Tables

D = S._d
_Y0 = D(AS_OF.start("year"))
_M0 = D(AS_OF.start("month"))


def _td_sql(val: str, prefix: str) -> str:
    return (f"CAST(SUM(CASE WHEN expenditure_date <= {D(AS_OF)} THEN {val} ELSE 0 END) AS DECIMAL(38,2)) AS {prefix}itd, "
            f"CAST(SUM(CASE WHEN expenditure_date <= {D(AS_OF)} AND expenditure_date >= {_Y0} THEN {val} ELSE 0 END) AS DECIMAL(38,2)) AS {prefix}ytd, "
            f"CAST(SUM(CASE WHEN expenditure_date <= {D(AS_OF)} AND expenditure_date >= {_M0} THEN {val} ELSE 0 END) AS DECIMAL(38,2)) AS {prefix}ptd")


@register("r_co5_actual_cost_to_date", S.with_sql(f"""
SELECT project_id, {_td_sql('raw_cost', 'raw_')}, {_td_sql('burdened_cost - raw_cost', 'burden_')},
       {_td_sql('burdened_cost', 'total_')}
FROM project_costs GROUP BY project_id""", "project_costs"))
def actual_cost_to_date(t: Tables) -> DataFrame:
    """R-CO5/R-PJ3/A15: raw, burden and total cost inception-, year- and
    period-to-date in one aggregation pass."""
    c = S.project_costs(t)
    return c.groupBy("project_id").agg(
        *A.to_date_sums("expenditure_date", "raw_cost", t.params.as_of, "raw_"),
        *A.to_date_sums("expenditure_date", F.col("burdened_cost") - F.col("raw_cost"), t.params.as_of, "burden_"),
        *A.to_date_sums("expenditure_date", "burdened_cost", t.params.as_of, "total_"))


@register("r_co2_cost_by_category", S.with_sql("""
SELECT project_id,
       CAST(SUM(CASE WHEN cost_category = 'Staff' THEN raw_cost ELSE 0 END) AS DECIMAL(38,2)) AS staff_cost,
       CAST(SUM(CASE WHEN cost_category = 'Burden' THEN raw_cost ELSE 0 END) AS DECIMAL(38,2)) AS burden_cost,
       CAST(SUM(CASE WHEN cost_category = 'Expenses' THEN raw_cost ELSE 0 END) AS DECIMAL(38,2)) AS expense_cost
FROM project_costs GROUP BY project_id""", "project_costs"))
def cost_by_category(t: Tables) -> DataFrame:
    """R-CO2: cost by category (staff, burden, expenses) per project (A2)."""
    return A.pivot_sum(S.project_costs(t), ["project_id"], "cost_category", "raw_cost", ["Staff", "Burden", "Expenses"],
                       {"Staff": "staff_cost", "Burden": "burden_cost", "Expenses": "expense_cost"})


@register("r_co3_contract_cost_overhead", S.with_sql("""
SELECT project_id, CAST(SUM(raw_cost) AS DECIMAL(38,2)) AS cost_without_overhead,
       CAST(SUM(burdened_cost) AS DECIMAL(38,2)) AS cost_with_overhead
FROM project_costs WHERE billable_flag = 'Y' GROUP BY project_id""", "project_costs"))
def contract_cost_overhead(t: Tables) -> DataFrame:
    """R-CO3: contract (billable) cost with and without overhead, each
    detail set aggregated once (no fan-out, §8 #14)."""
    c = S.project_costs(t).filter(F.col("billable_flag") == "Y")
    return c.groupBy("project_id").agg(F.sum("raw_cost").cast(TOTAL).alias("cost_without_overhead"),
                                       F.sum("burdened_cost").cast(TOTAL).alias("cost_with_overhead"))


@register("r_co4_wip", S.with_sql("""
SELECT project_id, recognised, invoiced, CAST(recognised - invoiced AS DECIMAL(38,2)) AS wip
FROM (SELECT project_id,
             CAST(SUM(CASE WHEN revenue_recognized_flag = 'F' THEN burdened_cost ELSE 0 END) AS DECIMAL(38,2)) AS recognised,
             CAST(SUM(CASE WHEN invoiced_flag = 'F' THEN burdened_cost ELSE 0 END) AS DECIMAL(38,2)) AS invoiced
      FROM project_costs WHERE billable_flag = 'Y' GROUP BY project_id) x
WHERE recognised - invoiced <> 0""", "project_costs"))
def wip(t: Tables) -> DataFrame:
    """R-CO4: WIP = recognised - invoiced per project, non-zero only."""
    c = S.project_costs(t).filter(F.col("billable_flag") == "Y")
    g = c.groupBy("project_id").agg(
        F.sum(F.when(F.col("revenue_recognized_flag") == "F", F.col("burdened_cost")).otherwise(0)).cast(TOTAL).alias("recognised"),
        F.sum(F.when(F.col("invoiced_flag") == "F", F.col("burdened_cost")).otherwise(0)).cast(TOTAL).alias("invoiced"))
    g = g.withColumn("wip", (F.col("recognised") - F.col("invoiced")).cast(TOTAL))
    return g.filter(F.col("wip") != 0)


@register("r_co6_quantity_hours", S.with_sql("""
SELECT project_id, CAST(SUM(quantity) AS DECIMAL(38,2)) AS hours
FROM project_costs c WHERE EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = c.expenditure_type_id
                                   AND split_part(p.p_type, ' ', 1) IN ('ECONOMY', 'STANDARD'))
GROUP BY project_id""", "project_costs"))
def quantity_hours(t: Tables) -> DataFrame:
    """R-CO6: quantity in hours -- items whose expenditure type is a labour
    type (semi join, J3)."""
    labour = t.part.filter(F.split("p_type", " ").getItem(0).isin("ECONOMY", "STANDARD")) \
        .select(F.col("p_partkey").alias("expenditure_type_id"))
    c = S.project_costs(t).join(labour, "expenditure_type_id", "left_semi")
    return c.groupBy("project_id").agg(F.sum("quantity").cast(TOTAL).alias("hours"))


@register("r_pj4_wip_billed_status", S.with_sql("""
SELECT project_id, task_id,
       CASE invoiced_flag WHEN 'F' THEN 'Fully Billed' WHEN 'P' THEN 'Partially Billed' ELSE 'Unbilled' END AS billed_status,
       COUNT(*) AS items, CAST(SUM(burdened_cost) AS DECIMAL(38,2)) AS amount
FROM project_costs GROUP BY 1, 2, 3""", "project_costs"))
def wip_billed_status(t: Tables) -> DataFrame:
    """R-PJ4: WIP detail with billed status (DECODE of the invoiced flag)."""
    c = S.project_costs(t)
    st = decode("invoiced_flag", [("F", "Fully Billed"), ("P", "Partially Billed")], "Unbilled")
    return c.groupBy("project_id", "task_id", st.alias("billed_status")).agg(
        F.count(F.lit(1)).alias("items"), F.sum("burdened_cost").cast(TOTAL).alias("amount"))


_PJ2_SQL = S.with_sql(f"""
SELECT p.project_id, b.budget_amount, f.forecast_amount, CAST(COALESCE(c.actual_cost, 0) AS DECIMAL(38,2)) AS actual_cost
FROM (SELECT DISTINCT project_id FROM plan_versions) p
LEFT JOIN (SELECT project_id, arg_max(plan_amount, (submitted_date, plan_version_id)) AS budget_amount
           FROM plan_versions WHERE plan_class = 'BUDGET' AND plan_status = 'BASELINED' AND submitted_date <= {D(AS_OF)}
           GROUP BY project_id) b ON b.project_id = p.project_id
LEFT JOIN (SELECT project_id, arg_max(plan_amount, (submitted_date, plan_version_id)) AS forecast_amount
           FROM plan_versions WHERE plan_class = 'FORECAST' AND submitted_date <= {D(AS_OF)}
           GROUP BY project_id) f ON f.project_id = p.project_id
LEFT JOIN (SELECT project_id, SUM(burdened_cost) AS actual_cost FROM project_costs
           WHERE expenditure_date <= {D(AS_OF)} GROUP BY project_id) c ON c.project_id = p.project_id""",
                      "plan_versions", "project_costs")


@register("r_pj2_project_summary", _PJ2_SQL)
def project_summary(t: Tables) -> DataFrame:
    """R-PJ2: latest baselined budget and latest forecast at the date (V1
    as a grouped max_by), actual cost to date, per project."""
    pv = S.plan_versions(t).filter(F.col("submitted_date") <= F.lit(t.params.as_of))
    bud = E.latest(pv.filter((F.col("plan_class") == "BUDGET") & (F.col("plan_status") == "BASELINED"))
                   .select("project_id", "submitted_date", "plan_version_id", "plan_amount"),
                   ["project_id"], ["submitted_date", "plan_version_id"]).select(
        "project_id", F.col("plan_amount").alias("budget_amount"))
    fc = E.latest(pv.filter(F.col("plan_class") == "FORECAST").select("project_id", "submitted_date", "plan_version_id", "plan_amount"),
                  ["project_id"], ["submitted_date", "plan_version_id"]).select(
        "project_id", F.col("plan_amount").alias("forecast_amount"))
    cost = (S.project_costs(t).filter(F.col("expenditure_date") <= F.lit(t.params.as_of)).groupBy("project_id")
            .agg(F.sum("burdened_cost").alias("actual_cost")))
    p = S.plan_versions(t).select("project_id").distinct()
    j = p.join(bud, "project_id", "left").join(fc, "project_id", "left").join(cost, "project_id", "left")
    return j.select("project_id", "budget_amount", "forecast_amount",
                    F.coalesce("actual_cost", F.lit(0)).cast(TOTAL).alias("actual_cost"))


# Stand-ins: an order is a plan version of its suppliers' projects (budget for
# priorities 1 and 2, baselined when finished), its lines are the plan lines;
# a plan line's revenue is its burdened cost and a fifth.
S._cte("plan_lines", (), """
SELECT l_suppkey AS project_id, CASE WHEN CAST(substr(o_orderpriority, 1, 1) AS INTEGER) <= 2 THEN 'BUDGET' ELSE 'FORECAST' END AS plan_class,
       CASE o_orderstatus WHEN 'F' THEN 'B' WHEN 'O' THEN 'S' ELSE 'W' END AS plan_status_code, CAST(o_orderdate AS DATE) AS submitted_date,
       CAST(l_extendedprice AS DECIMAL(18,2)) AS raw_cost,
       CAST(ROUND(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 + CAST(l_tax AS DECIMAL(4,2))), 2) AS DECIMAL(18,2)) AS burdened_cost
FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")


def plan_lines(t: Tables) -> DataFrame:
    """Plan lines of budget and forecast versions per project."""
    raw = money("l_extendedprice")
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select(F.col("l_suppkey").alias("project_id"),
                    F.when(F.substring("o_orderpriority", 1, 1).cast("int") <= 2, "BUDGET").otherwise("FORECAST").alias("plan_class"),
                    F.when(F.col("o_orderstatus") == "F", "B").when(F.col("o_orderstatus") == "O", "S").otherwise("W").alias("plan_status_code"),
                    F.to_date("o_orderdate").alias("submitted_date"), raw.alias("raw_cost"),
                    round_money(raw * (F.lit(1) + F.col("l_tax").cast("decimal(4,2)"))).alias("burdened_cost"))


def _plan_sql(plan: str) -> str:
    return f"""(SELECT project_id, SUM(raw_cost) AS raw_cost, SUM(burdened_cost) - SUM(raw_cost) AS burden_cost, SUM(burdened_cost) AS total_cost,
         SUM(burdened_cost) * 6 / 5 AS revenue
  FROM plan_lines p WHERE plan_class = '{plan}' AND plan_status_code = 'B'
   AND submitted_date = (SELECT MAX(submitted_date) FROM plan_lines q WHERE q.project_id = p.project_id AND q.plan_class = '{plan}'
                         AND q.plan_status_code = 'B' AND q.submitted_date < last_day({D(AS_OF)}))
  GROUP BY project_id)"""


def _tenth_sql(value: str, name: str) -> str:
    return f"CAST(ROUND(COALESCE({value}, 0), 1) AS DECIMAL(38,1)) AS {name}"


_PLAN_COLUMNS = ("raw_cost", "burden_cost", "total_cost", "revenue")

_PJ2F_SQL = S.with_sql(f"""
SELECT s.s_suppkey AS project_id, s.s_name AS project_name, c.start_date, c.completion_date,
       {", ".join(_tenth_sql(f"b.{x}" if x != "revenue" else "CAST(b.revenue AS DECIMAL(38,4))", f"budget_{x}") for x in _PLAN_COLUMNS)},
       {", ".join(_tenth_sql(f"f.{x}" if x != "revenue" else "CAST(f.revenue AS DECIMAL(38,4))", f"forecast_{x}") for x in _PLAN_COLUMNS)},
       {_tenth_sql("c.revenue", "billing_revenue_amt")}, {_tenth_sql("c.invoiced", "total_invoice_amt")},
       {_tenth_sql("COALESCE(c.revenue, 0) - COALESCE(c.invoiced, 0)", "wip_amount")}
FROM supplier s
LEFT JOIN {_plan_sql("BUDGET")} b ON b.project_id = s.s_suppkey
LEFT JOIN {_plan_sql("FORECAST")} f ON f.project_id = s.s_suppkey
LEFT JOIN (SELECT project_id, MIN(expenditure_date) AS start_date, MAX(expenditure_date) AS completion_date,
                  SUM(CASE WHEN revenue_recognized_flag = 'F' AND expenditure_date <= last_day({D(AS_OF)}) THEN burdened_cost END) AS revenue,
                  SUM(CASE WHEN invoiced_flag = 'F' AND expenditure_date <= last_day({D(AS_OF)}) THEN raw_cost END) AS invoiced
           FROM project_costs GROUP BY project_id) c ON c.project_id = s.s_suppkey""", "plan_lines", "project_costs")


@register("r_pj2_project_financials", _PJ2F_SQL)
def project_financials(t: Tables) -> DataFrame:
    """R-PJ2 in full: latest baselined budget and forecast before the month's
    last day (all lines of that day, V7) as raw, burden, total and revenue;
    revenue recognised, invoiced, and their difference as work in progress.

    Plan lines are summed per project, class and day first; the latest day is
    then one max_by over those sums, not a join back to the lines."""
    last = F.last_day(F.lit(t.params.as_of))
    p = plan_lines(t).filter((F.col("plan_status_code") == "B") & (F.col("submitted_date") < last))
    daily = p.groupBy("project_id", "plan_class", "submitted_date").agg(F.sum("raw_cost").alias("raw"), F.sum("burdened_cost").alias("total"))
    latest = daily.groupBy("project_id", "plan_class").agg(F.max_by(F.struct("raw", "total"), "submitted_date").alias("sums"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("decimal(38,2)"))
    tenth = lambda c, name: F.round(c, 1).cast("decimal(38,1)").alias(name)
    both = latest.groupBy("project_id").agg(*[F.max(F.when(F.col("plan_class") == k, F.col("sums"))).alias(k) for k in ("BUDGET", "FORECAST")])
    c = S.project_costs(t)
    upto = F.col("expenditure_date") <= last
    cost = c.groupBy("project_id").agg(
        F.min("expenditure_date").alias("start_date"), F.max("expenditure_date").alias("completion_date"),
        F.sum(F.when(upto & (F.col("revenue_recognized_flag") == "F"), F.col("burdened_cost"))).cast(TOTAL).alias("rev"),
        F.sum(F.when(upto & (F.col("invoiced_flag") == "F"), F.col("raw_cost"))).cast(TOTAL).alias("inv"))
    s = t.supplier.select(F.col("s_suppkey").alias("project_id"), F.col("s_name").alias("project_name"))
    j = s.join(both, "project_id", "left").join(cost, "project_id", "left")
    plan = []
    for k in ("BUDGET", "FORECAST"):
        raw, total = zero(F.col(f"{k}.raw").cast(TOTAL)), zero(F.col(f"{k}.total").cast(TOTAL))
        sixth = (total * F.lit("1.2").cast("decimal(2,1)"))
        plan += [tenth(v, f"{k.lower()}_{n}") for n, v in zip(_PLAN_COLUMNS, (raw, total - raw, total, sixth))]
    return j.select("project_id", "project_name", "start_date", "completion_date", *plan, tenth(zero("rev"), "billing_revenue_amt"),
                    tenth(zero("inv"), "total_invoice_amt"), tenth(zero("rev") - zero("inv"), "wip_amount"))


@register("r_pj3_project_revenue", S.with_sql(f"""
SELECT c.project_id, o.o_custkey AS contract_id,
       CAST(SUM(CASE WHEN c.expenditure_date <= {D(AS_OF)} THEN c.burdened_cost ELSE 0 END) AS DECIMAL(38,2)) AS cumulative_revenue,
       CAST(SUM(CASE WHEN c.expenditure_date BETWEEN {D(AS_OF.start("year"))} AND last_day({D(AS_OF)}) THEN c.burdened_cost ELSE 0 END) AS DECIMAL(38,2)) AS ytd_revenue,
       CAST(SUM(CASE WHEN c.expenditure_date BETWEEN {D(AS_OF.start("month"))} AND last_day({D(AS_OF)}) THEN c.burdened_cost ELSE 0 END) AS DECIMAL(38,2)) AS ptd_revenue,
       strftime({D(AS_OF)}, '%Y') AS accounting_year, strftime({D(AS_OF)}, '%Y-%m') AS ptd_month
FROM project_costs c JOIN orders o ON o.o_orderkey = c.expenditure_item_id
WHERE c.revenue_recognized_flag = 'F' AND c.expenditure_date <= last_day({D(AS_OF)})
GROUP BY c.project_id, o.o_custkey""", "project_costs"))
def project_revenue(t: Tables) -> DataFrame:
    """R-PJ3: revenue of each project and contract to the date, in its year
    and in its month, in one pass (the last two run to the month's end).
    Stand-in: the contract is the customer whose order the cost belongs to."""
    as_of = t.params.as_of
    last, day = F.last_day(F.lit(as_of)), F.col("expenditure_date")
    c = S.project_costs(t).filter((F.col("revenue_recognized_flag") == "F") & (day <= last))
    o = t.orders.select(F.col("o_orderkey").alias("expenditure_item_id"), F.col("o_custkey").alias("contract_id"))
    part = lambda cond, name: F.sum(F.when(cond, F.col("burdened_cost")).otherwise(0)).cast(TOTAL).alias(name)
    g = c.join(o, "expenditure_item_id").groupBy("project_id", "contract_id").agg(
        part(day <= F.lit(as_of), "cumulative_revenue"), part(day >= F.trunc(F.lit(as_of), "year"), "ytd_revenue"),
        part(day >= F.trunc(F.lit(as_of), "month"), "ptd_revenue"))
    return g.withColumn("accounting_year", F.lit(f"{as_of:%Y}")).withColumn("ptd_month", F.lit(f"{as_of:%Y-%m}"))


@register("r_pj10_plan_status_map", S.with_sql("""
SELECT plan_class, plan_status, current_plan_status_flag, original_flag,
       CASE plan_class
         WHEN 'BUDGET' THEN CASE code
           WHEN 'W' THEN CASE current_plan_status_flag WHEN 'Y' THEN 'CW' ELSE code END
           WHEN 'B' THEN CASE current_plan_status_flag || original_flag WHEN 'YY' THEN 'COB' WHEN 'YN' THEN 'CB'
                                                                        WHEN 'NY' THEN 'OB' ELSE code END END
         WHEN 'FORECAST' THEN CASE code
           WHEN 'W' THEN CASE current_plan_status_flag WHEN 'Y' THEN 'CW' ELSE code END
           WHEN 'B' THEN CASE current_plan_status_flag || original_flag WHEN 'YY' THEN 'COA' WHEN 'YN' THEN 'CA'
                WHEN 'NY' THEN 'OA' WHEN 'PY' THEN 'POA' WHEN 'PN' THEN 'PA' ELSE 'A' END
           WHEN 'S' THEN code END
       END AS status_code, COUNT(*) AS versions
FROM (SELECT *, substr(plan_status, 1, 1) AS code FROM plan_versions) v GROUP BY 1, 2, 3, 4, 5""", "plan_versions"))
def plan_status_map(t: Tables) -> DataFrame:
    """R-PJ10: nested status code map (DECODE within DECODE) by class, status
    code (W, B, S) and the current and original flags; no match is null."""
    pv = S.plan_versions(t)
    return (pv.groupBy("plan_class", "plan_status", "current_plan_status_flag", "original_flag",
                       plan_status_code(F.substring("plan_status", 1, 1)).alias("status_code"))
              .agg(F.count(F.lit(1)).alias("versions")))


def plan_status_code(code: F.Column) -> F.Column:
    """The plan status codes by class and flags."""
    flags = F.concat("current_plan_status_flag", "original_flag")
    working = F.when(F.col("current_plan_status_flag") == "Y", "CW").otherwise(code)
    budget = (F.when(code == "W", working)
               .when(code == "B", decode(flags, [("YY", "COB"), ("YN", "CB"), ("NY", "OB")], code)))
    forecast = (F.when(code == "W", working)
                 .when(code == "B", decode(flags, [("YY", "COA"), ("YN", "CA"), ("NY", "OA"), ("PY", "POA"), ("PN", "PA")], "A"))
                 .when(code == "S", code))
    return F.when(F.col("plan_class") == "BUDGET", budget).when(F.col("plan_class") == "FORECAST", forecast)


@register("r_co7_unpaid_supplier_invoices", S.with_sql("""
SELECT c.project_id, COUNT(*) AS unpaid_items, CAST(SUM(c.raw_cost) AS DECIMAL(38,2)) AS unpaid_amount
FROM project_costs c WHERE c.invoiced_flag <> 'F' GROUP BY c.project_id""", "project_costs"))
def unpaid_supplier_invoices(t: Tables) -> DataFrame:
    """R-CO7: unpaid supplier cost per project."""
    c = S.project_costs(t).filter(F.col("invoiced_flag") != "F")
    return c.groupBy("project_id").agg(F.count(F.lit(1)).alias("unpaid_items"),
                                       F.sum("raw_cost").cast(TOTAL).alias("unpaid_amount"))


@register("r_co1_cost_detail", S.with_sql("""
SELECT c.expenditure_item_id, c.project_id, c.task_id, c.expenditure_date, c.cost_category, c.raw_cost, c.burdened_cost,
       o.o_custkey AS employee_id, v.grade_id AS employee_grade
FROM project_costs c JOIN orders o ON o.o_orderkey = c.expenditure_item_id
LEFT JOIN person_versions v ON v.person_id = o.o_custkey AND c.expenditure_date BETWEEN v.eff_start AND v.eff_end""",
                                        "project_costs", "person_versions"))
def cost_detail(t: Tables) -> DataFrame:
    """R-CO1/R-CO8: cost items with the employee (the order's customer) and
    the employee's grade valid at the expenditure date (J2 + J8)."""
    c = S.project_costs(t).select("expenditure_item_id", "project_id", "task_id", "expenditure_date", "cost_category",
                                  "raw_cost", "burdened_cost")
    o = t.orders.select(F.col("o_orderkey").alias("expenditure_item_id"), F.col("o_custkey").alias("person_id"))
    j = c.join(o, "expenditure_item_id")
    j = E.join_effective(j, S.person_versions(t).select("person_id", "eff_start", "eff_end", "grade_id"),
                         ["person_id"], "expenditure_date",
                         within=tuple(t.lineitem.agg(f(F.to_date("l_shipdate"))).scalar() for f in (F.min, F.max)))
    return j.select("expenditure_item_id", "project_id", "task_id", "expenditure_date", "cost_category", "raw_cost",
                    "burdened_cost", F.col("person_id").alias("employee_id"), F.col("grade_id").alias("employee_grade"))


def _project_buyers(t: Tables) -> DataFrame:
    """Per project (supplier): first buyer, largest-order buyer, distinct customers."""
    li = t.lineitem.select("l_orderkey", "l_suppkey")
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy(F.col("l_suppkey").alias("project_id")).agg(
        F.min_by("o_custkey", F.struct("o_orderdate", "o_orderkey")).alias("manager_id"),
        F.max_by("o_custkey", F.struct("o_totalprice", "o_orderkey")).alias("director_id"),
        F.count_distinct("o_custkey").alias("customer_count"))


_BUYERS_SQL = """(SELECT l_suppkey AS project_id, arg_min(o_custkey, (o_orderdate, o_orderkey)) AS manager_id,
   arg_max(o_custkey, (o_totalprice, o_orderkey)) AS director_id, COUNT(DISTINCT o_custkey) AS customer_count
 FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_suppkey)"""


@register("r_pj1_project_master", f"""
SELECT b.project_id, s.s_name AS project_name, n.n_name AS country, r.r_name AS region,
       CASE WHEN s.s_acctbal > 5000 THEN 'STRATEGIC' WHEN s.s_acctbal >= 0 THEN 'STANDARD' ELSE 'AT RISK' END AS project_class,
       m.c_name AS manager_name, d.c_name AS director_name, b.customer_count
FROM {_BUYERS_SQL} b JOIN supplier s ON s.s_suppkey = b.project_id JOIN nation n ON n.n_nationkey = s.s_nationkey
JOIN region r ON r.r_regionkey = n.n_regionkey
LEFT JOIN customer m ON m.c_custkey = b.manager_id LEFT JOIN customer d ON d.c_custkey = b.director_id""")
def project_master(t: Tables) -> DataFrame:
    """R-PJ1: project master with country, region, class, manager, director
    and number of distinct customers (J21 + A7; buyers by min_by/max_by)."""
    b = _project_buyers(t)
    s = t.supplier.select(F.col("s_suppkey").alias("project_id"), F.col("s_name").alias("project_name"), "s_nationkey", "s_acctbal")
    n = F.broadcast(t.nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("country"), "n_regionkey"))
    r = F.broadcast(t.region.select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("region")))
    names = lambda k, n_: t.customer.select(F.col("c_custkey").alias(k), F.col("c_name").alias(n_))
    j = (b.join(s, "project_id").join(n, "s_nationkey").join(r, "n_regionkey")
          .join(names("manager_id", "manager_name"), "manager_id", "left")
          .join(names("director_id", "director_name"), "director_id", "left"))
    cls = (F.when(F.col("s_acctbal") > 5000, "STRATEGIC").when(F.col("s_acctbal") >= 0, "STANDARD").otherwise("AT RISK"))
    return j.select("project_id", "project_name", "country", "region", cls.alias("project_class"), "manager_name",
                    "director_name", "customer_count")


@register("r_pj5_project_purchase_orders", S.with_sql("""
SELECT c.project_id, c.po_id, CAST(o.o_orderdate AS DATE) AS po_date, CAST(o.o_totalprice AS DECIMAL(18,2)) AS po_amount
FROM (SELECT DISTINCT project_id, expenditure_item_id AS po_id FROM project_costs) c
JOIN orders o ON o.o_orderkey = c.po_id""", "project_costs"))
def project_purchase_orders(t: Tables) -> DataFrame:
    """R-PJ5: distinct purchase orders behind each project's cost (A7 + J21)."""
    c = S.project_costs(t).select("project_id", F.col("expenditure_item_id").alias("po_id")).distinct()
    o = t.orders.select(F.col("o_orderkey").alias("po_id"), F.to_date("o_orderdate").alias("po_date"),
                        F.col("o_totalprice").cast("decimal(18,2)").alias("po_amount"))
    return c.join(o, "po_id").select("project_id", "po_id", "po_date", "po_amount")


_PJ6_SQL = f"""
WITH direct AS (SELECT project_id, manager_id AS customer_id, 'DIRECT' AS route FROM {_BUYERS_SQL} b),
contract AS (SELECT l.l_suppkey AS project_id, MIN(o.o_custkey) AS customer_id, 'CONTRACT' AS route
             FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
             WHERE CAST(substr(o.o_orderpriority, 1, 1) AS INTEGER) <= 2 AND o.o_orderstatus = 'F'
             GROUP BY l.l_suppkey)
SELECT * FROM contract
UNION ALL
SELECT * FROM direct d WHERE NOT EXISTS (SELECT 1 FROM contract c WHERE c.project_id = d.project_id)"""


@register("r_pj6_project_customer", _PJ6_SQL)
def project_customer(t: Tables) -> DataFrame:
    """R-PJ6: project customer by two routes -- the contract route (the
    lowest customer of a baselined budget contract) wins, the direct route
    (first buyer) is used only where no contract exists.  Both routes come
    from ONE aggregation of the project's order lines; the override (J16,
    see ``j16_override_union``) becomes a coalesce over the two columns."""
    li = t.lineitem.select("l_orderkey", "l_suppkey")
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    contract_cond = (F.substring("o_orderpriority", 1, 1).cast("int") <= 2) & (F.col("o_orderstatus") == "F")
    g = j.groupBy(F.col("l_suppkey").alias("project_id")).agg(
        F.min(F.when(contract_cond, F.col("o_custkey"))).alias("contract_customer"),
        F.min_by("o_custkey", F.struct("o_orderdate", "o_orderkey")).alias("direct_customer"))
    return g.select("project_id", F.coalesce("contract_customer", "direct_customer").alias("customer_id"),
                    F.when(F.col("contract_customer").isNotNull(), "CONTRACT").otherwise("DIRECT").alias("route"))


# Contingency share of a budget, percent.
CONTINGENCY_PCT = 5


@register("r_pj7_contingency", S.with_sql(f"""
SELECT p.project_id, c.party_name, CAST(SUM(p.plan_amount) AS DECIMAL(38,2)) AS budget,
       CAST(SUM({sql_div_round(f'CAST(p.plan_amount * 100 AS BIGINT) * {CONTINGENCY_PCT}', '10000')}) AS DECIMAL(38,2)) AS contingency
FROM plan_versions p JOIN customers c ON c.customer_id = p.project_id
WHERE p.plan_class = 'BUDGET' GROUP BY p.project_id, c.party_name""", "plan_versions", "customers"))
def contingency(t: Tables) -> DataFrame:
    """R-PJ7: contingency (5 % of each budget line, exact cents) per project."""
    from tallyspark.functions.scalars import cents, div_round
    p = S.plan_versions(t).filter(F.col("plan_class") == "BUDGET")
    p = p.withColumn("cont", div_round(cents("plan_amount") * CONTINGENCY_PCT, F.lit(10000), 2))
    c = S.customers(t).select(F.col("customer_id").alias("project_id"), "party_name")
    g = p.groupBy("project_id").agg(F.sum("plan_amount").cast(TOTAL).alias("budget"),
                                    F.sum("cont").cast(TOTAL).alias("contingency"))
    return g.join(c, "project_id")


@register("r_pj8_project_contract_link", S.with_sql("""
SELECT project_id, plan_version_id AS contract_id, 'PROJECT_LEVEL' AS link_style, 1 AS branch_rank
FROM plan_versions WHERE plan_class = 'BUDGET'
UNION ALL
SELECT project_id, plan_version_id, 'TASK_LEVEL', 2 FROM plan_versions WHERE plan_class = 'FORECAST'""", "plan_versions"))
def project_contract_link(t: Tables) -> DataFrame:
    """R-PJ8: project-contract links of two project styles as one UNION ALL
    with a branch rank (O4)."""
    from tallyspark.operators.movements import union_branches
    p = S.plan_versions(t).select("project_id", F.col("plan_version_id").alias("contract_id"), "plan_class")
    u = union_branches([("PROJECT_LEVEL", 1, p.filter(F.col("plan_class") == "BUDGET").drop("plan_class")),
                        ("TASK_LEVEL", 2, p.filter(F.col("plan_class") == "FORECAST").drop("plan_class"))],
                       kind_col="link_style")
    return u


@register("r_pj9_contract_lines", S.with_sql("""
SELECT p.plan_version_id AS contract_line_id, p.project_id, c.party_name AS customer_name, c.unit_name AS customer_country,
       r.r_name AS customer_region, p.plan_class, p.plan_status, p.plan_amount
FROM plan_versions p JOIN customers c ON c.customer_id = p.project_id JOIN region r ON r.r_regionkey = c.ledger_id""",
                                        "plan_versions", "customers"))
def contract_lines(t: Tables) -> DataFrame:
    """R-PJ9: contract lines with customer, country and region."""
    p = S.plan_versions(t)
    c = S.customers(t).select(F.col("customer_id").alias("project_id"), F.col("party_name").alias("customer_name"),
                              F.col("unit_name").alias("customer_country"), F.col("ledger_id").alias("r_regionkey"))
    r = F.broadcast(t.region.select("r_regionkey", F.col("r_name").alias("customer_region")))
    j = p.join(c, "project_id").join(r, "r_regionkey")
    return j.select(F.col("plan_version_id").alias("contract_line_id"), "project_id", "customer_name", "customer_country",
                    "customer_region", "plan_class", "plan_status", "plan_amount")


@register("r_pj11_project_manager_director", S.with_sql(f"""
SELECT p.project_id, v.grade_id AS manager_grade, v.salary AS manager_salary, d.director_id
FROM (SELECT DISTINCT project_id FROM plan_versions) p
JOIN customers c ON c.customer_id = p.project_id
LEFT JOIN person_versions v ON v.person_id = p.project_id AND {D(AS_OF)} BETWEEN v.eff_start AND v.eff_end
LEFT JOIN (SELECT org_id, MIN(customer_id) AS director_id FROM customers GROUP BY org_id) d ON d.org_id = c.org_id""",
                                                    "plan_versions", "customers", "person_versions"))
def project_manager_director(t: Tables) -> DataFrame:
    """R-PJ11: the project manager's version valid at the date (J7) and a
    director picked as one deterministic row per country (V8)."""
    p = S.plan_versions(t).select("project_id").distinct()
    c = S.customers(t).select(F.col("customer_id").alias("project_id"), "org_id")
    v = E.as_of(S.person_versions(t), t.params.as_of).select(F.col("person_id").alias("project_id"),
                                                    F.col("grade_id").alias("manager_grade"),
                                                    F.col("salary").alias("manager_salary"))
    d = E.earliest(S.customers(t).select("org_id", F.col("customer_id").alias("director_id")), ["org_id"], ["director_id"])
    j = p.join(c, "project_id").join(v, "project_id", "left").join(d, "org_id", "left")
    return j.select("project_id", "manager_grade", "manager_salary", "director_id")
