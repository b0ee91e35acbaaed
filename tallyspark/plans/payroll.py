"""Payroll, compensation and benefits (R-PY*, R-CP*).

Run results hold their value as text (as in the source system); it is
converted with ``try_cast`` so a bad value becomes NULL instead of failing
the job under ANSI mode.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.params import AS_OF, END_OF_TIME, EVENTS_TO, PERIOD_FROM, PERIOD_TO
from tallyspark.functions.scalars import (
    TOTAL, cents, div_round, months_between_sql, percent, service_years, sql_div_round, sql_percent, sql_service_years,
)
from tallyspark.operators import effective as E
from tallyspark.operators import rollup as A
from tallyspark.operators import windows as W
from tallyspark.plans.registry import register
from tallyspark.sources import standins as S
from tallyspark.sources.tables import Tables

D = S._d


def _value() -> F.Column:
    return F.col("result_value").try_cast("decimal(18,2)")


_VAL = "TRY_CAST(result_value AS DECIMAL(18,2))"


@register("r_py1_payslip", S.with_sql(f"""
SELECT person_id, strftime(effective_date, '%Y-%m') AS pay_period,
       CAST(SUM(CASE WHEN classification = 'Earnings' THEN {_VAL} ELSE 0 END) AS DECIMAL(38,2)) AS earnings,
       CAST(SUM(CASE WHEN classification = 'Deductions' THEN {_VAL} ELSE 0 END) AS DECIMAL(38,2)) AS deductions,
       CAST(SUM(CASE WHEN classification = 'Earnings' THEN {_VAL} WHEN classification = 'Deductions' THEN -{_VAL} ELSE 0 END) AS DECIMAL(38,2)) AS net_pay
FROM run_results GROUP BY 1, 2""", "run_results"))
def payslip(t: Tables) -> DataFrame:
    """R-PY1: earnings, deductions and net per person and month; net is
    ELSE 0 so a person without deductions still gets a net (§8 #16)."""
    r = S.run_results(t)
    v = _value()
    return r.groupBy("person_id", F.date_format("effective_date", "yyyy-MM").alias("pay_period")).agg(
        F.sum(F.when(F.col("classification") == "Earnings", v).otherwise(0)).cast(TOTAL).alias("earnings"),
        F.sum(F.when(F.col("classification") == "Deductions", v).otherwise(0)).cast(TOTAL).alias("deductions"),
        F.sum(F.when(F.col("classification") == "Earnings", v).when(F.col("classification") == "Deductions", -v)
              .otherwise(0)).cast(TOTAL).alias("net_pay"))


@register("r_py2_element_register", S.with_sql(f"""
SELECT element, classification, COUNT(*) AS entries, COUNT(DISTINCT person_id) AS people,
       CAST(SUM({_VAL}) AS DECIMAL(38,2)) AS total
FROM run_results GROUP BY element, classification""", "run_results"))
def element_register(t: Tables) -> DataFrame:
    """R-PY2: element register -- entries, people and total per element."""
    r = S.run_results(t)
    return r.groupBy("element", "classification").agg(
        F.count(F.lit(1)).alias("entries"), F.count_distinct("person_id").alias("people"),
        F.sum(_value()).cast(TOTAL).alias("total"))


@register("r_py5_classification_net", S.with_sql(f"""
SELECT x.*, CAST(SUM(CASE WHEN classification = 'Deductions' THEN -amount WHEN classification = 'Earnings' THEN amount ELSE 0 END)
             OVER (PARTITION BY person_id) AS DECIMAL(38,2)) AS person_net
FROM (SELECT person_id, classification, CAST(SUM({_VAL}) AS DECIMAL(38,2)) AS amount
      FROM run_results GROUP BY person_id, classification) x""", "run_results"))
def classification_net(t: Tables) -> DataFrame:
    """R-PY5: element-agnostic totals by classification with the person's
    net beside each row (W3 as aggregate + join back)."""
    r = S.run_results(t)
    g = r.groupBy("person_id", "classification").agg(F.sum(_value()).cast(TOTAL).alias("amount"))
    signed = (F.when(F.col("classification") == "Deductions", -F.col("amount"))
              .when(F.col("classification") == "Earnings", F.col("amount")).otherwise(0))
    g = W.partition_total(g, ["person_id"], signed, "person_net")
    return g.withColumn("person_net", F.col("person_net").cast(TOTAL))


@register("r_py6_information_elements", S.with_sql("""
SELECT person_id, COUNT(*) AS info_entries, MAX(effective_date) AS last_entry
FROM run_results WHERE classification = 'Information' GROUP BY person_id""", "run_results"))
def information_elements(t: Tables) -> DataFrame:
    """R-PY6: information (non-money) elements per person."""
    r = S.run_results(t).filter(F.col("classification") == "Information")
    return r.groupBy("person_id").agg(F.count(F.lit(1)).alias("info_entries"), F.max("effective_date").alias("last_entry"))


_MONTH0 = D(EVENTS_TO.start("month") + _dt.timedelta(days=14))


@register("r_py8_balance_dimensions", S.with_sql(f"""
SELECT person_id, element,
       CAST(SUM(CASE WHEN effective_date <= {D(EVENTS_TO)} THEN {_VAL} ELSE 0 END) AS DECIMAL(38,2)) AS itd,
       CAST(SUM(CASE WHEN effective_date <= {D(EVENTS_TO)} AND effective_date >= {D(EVENTS_TO.start("year"))} THEN {_VAL} ELSE 0 END) AS DECIMAL(38,2)) AS ytd,
       CAST(SUM(CASE WHEN effective_date <= {D(EVENTS_TO)} AND effective_date >= {D(EVENTS_TO.start("month"))} THEN {_VAL} ELSE 0 END) AS DECIMAL(38,2)) AS ptd
FROM run_results WHERE classification <> 'Information' GROUP BY person_id, element""", "run_results"))
def balance_dimensions(t: Tables) -> DataFrame:
    """R-PY8: balance per dimension re-aimed as ITD/YTD/PTD sums of run
    results (A15, one pass)."""
    r = S.run_results(t).filter(F.col("classification") != "Information")
    return r.groupBy("person_id", "element").agg(*A.to_date_sums("effective_date", _value(), t.params.events_to))


@register("r_py9_component_breakdown", S.with_sql(f"""
SELECT person_id,
       CAST(SUM(CASE WHEN element = 'Basic' THEN {_VAL} ELSE 0 END) AS DECIMAL(38,2)) AS basic,
       CAST(SUM(CASE WHEN element = 'Housing' THEN {_VAL} ELSE 0 END) AS DECIMAL(38,2)) AS housing,
       CAST(SUM(CASE WHEN element = 'Transport' THEN {_VAL} ELSE 0 END) AS DECIMAL(38,2)) AS transport,
       CAST(SUM(CASE WHEN classification = 'Earnings' THEN {_VAL} ELSE 0 END) AS DECIMAL(38,2)) AS gross,
       CAST(SUM(CASE WHEN classification = 'Deductions' THEN {_VAL} ELSE 0 END) AS DECIMAL(38,2)) AS deductions,
       CAST(SUM(CASE WHEN classification = 'Earnings' THEN {_VAL} WHEN classification = 'Deductions' THEN -{_VAL} ELSE 0 END) AS DECIMAL(38,2)) AS net
FROM run_results GROUP BY person_id""", "run_results"))
def component_breakdown(t: Tables) -> DataFrame:
    """R-PY9: components, gross and net per person (A2)."""
    r = S.run_results(t)
    v = _value()
    el, cl = F.col("element"), F.col("classification")
    return r.groupBy("person_id").agg(
        F.sum(F.when(el == "Basic", v).otherwise(0)).cast(TOTAL).alias("basic"),
        F.sum(F.when(el == "Housing", v).otherwise(0)).cast(TOTAL).alias("housing"),
        F.sum(F.when(el == "Transport", v).otherwise(0)).cast(TOTAL).alias("transport"),
        F.sum(F.when(cl == "Earnings", v).otherwise(0)).cast(TOTAL).alias("gross"),
        F.sum(F.when(cl == "Deductions", v).otherwise(0)).cast(TOTAL).alias("deductions"),
        F.sum(F.when(cl == "Earnings", v).when(cl == "Deductions", -v).otherwise(0)).cast(TOTAL).alias("net"))


@register("r_cp4_salary_history", S.with_sql(f"""
SELECT person_id, eff_start, salary, previous_salary, CAST(salary - previous_salary AS DECIMAL(18,2)) AS change_amount,
       {sql_percent('CAST((salary - previous_salary) * 100 AS BIGINT)', 'CAST(previous_salary * 100 AS BIGINT)')} AS change_pct
FROM (SELECT person_id, eff_start, salary,
             LAG(salary) OVER (PARTITION BY person_id ORDER BY eff_start) AS previous_salary
      FROM person_versions) x""", "person_versions"))
def salary_history(t: Tables) -> DataFrame:
    """R-CP4/W8: salary history with previous value, change and percent
    change (exact, NULL when there is no previous value or it is 0)."""
    pv = S.person_versions(t).select("person_id", "eff_start", "salary")
    h = W.lag_change(pv, ["person_id"], ["eff_start"], "salary", "previous_salary", "change_amount")
    return h.select("person_id", "eff_start", "salary", "previous_salary",
                    F.col("change_amount").cast("decimal(18,2)").alias("change_amount"),
                    percent(cents("change_amount"), cents("previous_salary")).alias("change_pct"))


@register("r_cp5_salary_at_date", S.with_sql(f"""
SELECT s.person_id, s.department, v.salary, v.eff_start AS salary_since
FROM service_periods s JOIN person_versions v ON v.person_id = s.person_id
 AND {D(AS_OF)} >= v.eff_start AND {D(AS_OF)} <= COALESCE(v.eff_end, {D(END_OF_TIME)})""",
                                             "service_periods", "person_versions"))
def salary_at_date(t: Tables) -> DataFrame:
    """R-CP5/J7: salary valid at the date (dimension filtered first)."""
    sp = S.service_periods(t).select("person_id", "department")
    pv = E.as_of(S.person_versions(t), t.params.as_of).select("person_id", "salary", F.col("eff_start").alias("salary_since"))
    return sp.join(pv, "person_id")


def _current_salary(t: Tables) -> DataFrame:
    return S.person_versions(t).filter(F.col("eff_end") == F.lit(END_OF_TIME)).select("person_id", "salary")


_CUR_SAL_SQL = f"(SELECT person_id, salary FROM person_versions WHERE eff_end = {D(END_OF_TIME)})"

@register("r_cp6_salary_experience_bands", S.with_sql(f"""
SELECT s.person_id, c.salary,
       CASE WHEN c.salary < 5000 THEN 'Band 1 (< 5K)' WHEN c.salary <= 10000 THEN 'Band 2 (5K-10K)'
            WHEN c.salary <= 20000 THEN 'Band 3 (10K-20K)' ELSE 'Band 4 (> 20K)' END AS salary_band,
       s.service_years,
       CASE WHEN s.service_years < 2 THEN 'Entry Level' WHEN s.service_years <= 5 THEN 'Mid Level'
            WHEN s.service_years <= 10 THEN 'Senior Level' ELSE 'Expert Level' END AS experience_band,
       {sql_div_round('CAST(c.salary * 100 AS BIGINT)', 'greatest(CAST(s.service_years * 100 AS BIGINT), 100)')} AS pay_per_service_year
FROM (SELECT person_id, {sql_service_years("/*as_of*/DATE '2000-12-31'", "date_start")} AS service_years
      FROM service_periods WHERE date_start <= {D(AS_OF)}) s
JOIN {_CUR_SAL_SQL} c ON c.person_id = s.person_id""", "service_periods", "person_versions"))
def salary_experience_bands(t: Tables) -> DataFrame:
    """R-CP6/X14: salary band (edges 5, 10, 20 thousand), experience band (2,
    5, 10 years) and pay per service year, a year at least."""
    s = S.service_periods(t).filter(F.col("date_start") <= F.lit(t.params.as_of))
    s = s.select("person_id", service_years(F.lit(t.params.as_of), "date_start").alias("service_years"))
    j = s.join(_current_salary(t), "person_id")
    pay, y = F.col("salary"), F.col("service_years")
    return j.select("person_id", "salary",
                    F.when(pay < 5000, "Band 1 (< 5K)").when(pay <= 10000, "Band 2 (5K-10K)")
                     .when(pay <= 20000, "Band 3 (10K-20K)").otherwise("Band 4 (> 20K)").alias("salary_band"),
                    "service_years",
                    F.when(y < 2, "Entry Level").when(y <= 5, "Mid Level").when(y <= 10, "Senior Level")
                     .otherwise("Expert Level").alias("experience_band"),
                    div_round(cents("salary"), F.greatest((y * 100).cast("bigint"), F.lit(100)), 2).alias("pay_per_service_year"))


@register("r_cp3_compensation_by_department", S.with_sql(f"""
SELECT s.department, COUNT(*) AS cnt, CAST(SUM(c.salary) AS DECIMAL(38,2)) AS total,
       {sql_div_round('SUM(CAST(c.salary * 100 AS BIGINT))', 'COUNT(c.salary) * 100')} AS avg,
       MIN(c.salary) AS min, MAX(c.salary) AS max
FROM service_periods s JOIN {_CUR_SAL_SQL} c ON c.person_id = s.person_id GROUP BY s.department""",
                                                          "service_periods", "person_versions"))
def compensation_by_department(t: Tables) -> DataFrame:
    """R-CP3/A1: count, total, average, min and max current salary per department."""
    j = S.service_periods(t).select("person_id", "department").join(_current_salary(t), "person_id")
    return A.summarize(j, ["department"], "salary")


@register("r_cp2_new_joiners", S.with_sql(f"""
SELECT s.person_id, s.date_start, v.salary AS starting_salary
FROM service_periods s JOIN person_versions v ON v.person_id = s.person_id AND v.eff_start = s.date_start
WHERE s.date_start BETWEEN {D(PERIOD_FROM)} AND {D(PERIOD_TO)}""", "service_periods", "person_versions"))
def new_joiners(t: Tables) -> DataFrame:
    """R-CP2: people hired in the period with their starting salary."""
    s = S.service_periods(t).filter(F.col("date_start").between(F.lit(t.params.date_from), F.lit(t.params.date_to)))
    v = S.person_versions(t).select("person_id", F.col("eff_start").alias("date_start"), F.col("salary").alias("starting_salary"))
    return s.select("person_id", "date_start").join(v, ["person_id", "date_start"])


# Gratuity days per service year, leave-provision days per year.
GRATUITY_DAYS = 21
LEAVE_DAYS = 30


@register("r_py3_cost_to_company", S.with_sql(f"""
SELECT person_id, pay_period, net_pay, air_ticket_provision, gratuity_provision, leave_provision,
       CAST(net_pay + air_ticket_provision + gratuity_provision + leave_provision AS DECIMAL(38,2)) AS total_cost
FROM (SELECT x.person_id, x.pay_period, x.net_pay,
             COALESCE({sql_div_round("CAST((a.rate * CASE WHEN x.person_id % 2 = 0 THEN 2 ELSE 1 END + CASE WHEN x.person_id % 3 = 0 THEN k.rate ELSE 0 END) * 100 AS BIGINT)", '1200')}, 0) AS air_ticket_provision,
             {sql_div_round('CAST(basic * 100 AS BIGINT) * 21', '36500')} AS gratuity_provision,
             {sql_div_round('CAST(basic * 100 AS BIGINT) * 30', '36500')} AS leave_provision
      FROM (SELECT person_id, strftime(effective_date, '%Y-%m') AS pay_period, MAX(effective_date) AS paid_to,
                   CAST(SUM(CASE classification WHEN 'Earnings' THEN {_VAL} WHEN 'Deductions' THEN -{_VAL} ELSE 0 END) AS DECIMAL(38,2)) AS net_pay,
                   SUM(CASE WHEN element = 'Basic' THEN {_VAL} ELSE 0 END) AS basic
            FROM run_results GROUP BY 1, 2) x
      LEFT JOIN customers c ON c.customer_id = x.person_id
      LEFT JOIN rate_card a ON a.region_id = c.ledger_id AND a.segment = c.segment AND a.kind = 'ADULT'
       AND x.paid_to BETWEEN a.valid_from AND a.valid_to
      LEFT JOIN rate_card k ON k.region_id = c.ledger_id AND k.segment = c.segment AND k.kind = 'CHILD'
       AND x.paid_to BETWEEN k.valid_from AND k.valid_to) y""", "run_results", "customers", "rate_card"))
def cost_to_company(t: Tables) -> DataFrame:
    """R-PY3: net pay (earnings less deductions), the provisions of the month
    and their total per person and month.

    Provisions: air tickets, a twelfth of the year's fares of person, spouse
    and child; gratuity and leave, basic x days / 365, exact cents.
    Stand-ins: even persons have a spouse, every third a child; fares are the
    rate card's at the last pay date, none without a rate."""
    from tallyspark.sources import constants as K
    v = _value()
    signed = F.when(F.col("classification") == "Earnings", v).when(F.col("classification") == "Deductions", -v).otherwise(0)
    g = S.run_results(t).groupBy("person_id", F.date_format("effective_date", "yyyy-MM").alias("pay_period")).agg(
        F.max("effective_date").alias("paid_to"), F.sum(signed).cast(TOTAL).alias("net_pay"),
        F.sum(F.when(F.col("element") == "Basic", v).otherwise(0)).alias("basic"))
    c = S.customers(t).select(F.col("customer_id").alias("person_id"), F.col("ledger_id").alias("region_id"), "segment")
    fares = K.rate_card(t.spark).groupBy("region_id", "segment", "valid_from", "valid_to").agg(
        F.max(F.when(F.col("kind") == "ADULT", F.col("rate"))).alias("adult"),
        F.max(F.when(F.col("kind") == "CHILD", F.col("rate"))).alias("child"))
    j = g.join(c, "person_id", "left").alias("g").join(
        fares.alias("f"), (F.col("g.region_id") == F.col("f.region_id")) & (F.col("g.segment") == F.col("f.segment"))
        & F.col("paid_to").between(F.col("valid_from"), F.col("valid_to")), "left")
    fare = (F.col("adult") * F.when(F.col("person_id") % 2 == 0, 2).otherwise(1)
            + F.when(F.col("person_id") % 3 == 0, F.col("child")).otherwise(0))
    air = F.coalesce(div_round(cents(fare), F.lit(1200), 2), F.lit(0).cast("decimal(18,2)"))
    grat = div_round(cents("basic") * GRATUITY_DAYS, F.lit(36500), 2)
    leave = div_round(cents("basic") * LEAVE_DAYS, F.lit(36500), 2)
    return j.select("person_id", "pay_period", "net_pay", air.alias("air_ticket_provision"), grat.alias("gratuity_provision"),
                    leave.alias("leave_provision"), (F.col("net_pay") + air + grat + leave).cast(TOTAL).alias("total_cost"))


@register("r_cp7_end_of_service", S.with_sql(f"""
SELECT s.person_id, s.actual_termination_date, v.salary, y.years AS service_years,
       {sql_div_round(f'CAST(v.salary * 100 AS BIGINT) * y.years * {GRATUITY_DAYS}', '3000')} AS gratuity,
       {sql_div_round(f'CAST(v.salary * 100 AS BIGINT) * {LEAVE_DAYS}', '3000')} AS leave_encashment,
       r.rate AS fare,
       CAST({sql_div_round(f'CAST(v.salary * 100 AS BIGINT) * y.years * {GRATUITY_DAYS}', '3000')}
            + {sql_div_round(f'CAST(v.salary * 100 AS BIGINT) * {LEAVE_DAYS}', '3000')} + r.rate AS DECIMAL(38,2)) AS total_settlement
FROM service_periods s
JOIN person_versions v ON v.person_id = s.person_id AND s.actual_termination_date BETWEEN v.eff_start AND v.eff_end
JOIN (SELECT person_id, (CAST((year(actual_termination_date) - year(date_start)) * 12 + month(actual_termination_date) - month(date_start)
             - CASE WHEN day(actual_termination_date) < day(date_start) THEN 1 ELSE 0 END AS BIGINT) // 12) AS years
      FROM service_periods WHERE actual_termination_date IS NOT NULL) y ON y.person_id = s.person_id
JOIN customers c ON c.customer_id = s.person_id
JOIN rate_card r ON r.region_id = c.ledger_id AND r.segment = c.segment AND r.kind = 'ADULT'
 AND s.actual_termination_date BETWEEN r.valid_from AND r.valid_to""",
                                             "service_periods", "person_versions", "customers", "rate_card"))
def end_of_service(t: Tables) -> DataFrame:
    """R-CP7: end-of-service settlement = gratuity (salary x years x 21/30)
    + leave encashment (salary x 30/30) + the adult fare from the rate card
    valid at termination (J7 on both the salary and the rate card)."""
    from tallyspark.sources import constants as K
    s = S.service_periods(t).filter(F.col("actual_termination_date").isNotNull())
    months = ((F.year("actual_termination_date") - F.year("date_start")) * 12 + F.month("actual_termination_date")
              - F.month("date_start") - F.when(F.dayofmonth("actual_termination_date") < F.dayofmonth("date_start"), 1).otherwise(0))
    s = s.select("person_id", "actual_termination_date", F.floor(months / 12).cast("bigint").alias("service_years"))
    j = E.join_effective(s, S.person_versions(t), ["person_id"], "actual_termination_date", how="inner",
                         within=S.order_date_bounds(t))
    c = S.customers(t).select(F.col("customer_id").alias("person_id"), F.col("ledger_id").alias("region_id"), "segment")
    rc = K.rate_card(t.spark).filter(F.col("kind") == "ADULT")
    j = j.join(c, "person_id")
    j = j.join(rc, (j.region_id == rc.region_id) & (j.segment == rc.segment)
               & j.actual_termination_date.between(rc.valid_from, rc.valid_to))
    grat = div_round(cents("salary") * F.col("service_years") * GRATUITY_DAYS, F.lit(3000), 2)
    leave = div_round(cents("salary") * LEAVE_DAYS, F.lit(3000), 2)
    return j.select("person_id", "actual_termination_date", "salary", "service_years", grat.alias("gratuity"),
                    leave.alias("leave_encashment"), F.col("rate").alias("fare"),
                    (grat + leave + F.col("rate")).cast(TOTAL).alias("total_settlement"))


@register("r_py4_accrual_detail", S.with_sql("""
SELECT person_id, CAST(date_trunc('week', processed_date) AS DATE) AS week_start,
       CAST(SUM(CASE WHEN entry_type = 'ACRL' THEN entry_value ELSE 0 END) AS DECIMAL(38,2)) AS accrued,
       CAST(SUM(CASE WHEN entry_type = 'ABS' THEN entry_value ELSE 0 END) AS DECIMAL(38,2)) AS taken,
       CAST(SUM(CASE WHEN entry_type = 'CSH' THEN entry_value ELSE 0 END) AS DECIMAL(38,2)) AS encashed,
       CAST(SUM(CASE WHEN entry_type = 'COVR' THEN entry_value ELSE 0 END) AS DECIMAL(38,2)) AS carried_over,
       CAST(SUM(CASE WHEN entry_type = 'ADJOTH' THEN entry_value ELSE 0 END) AS DECIMAL(38,2)) AS adjusted
FROM accrual_entries GROUP BY 1, 2""", "accrual_entries"))
def accrual_detail(t: Tables) -> DataFrame:
    """R-PY4: accrual entries per person and week pivoted by entry type (A2)."""
    e = S.accrual_entries(t).withColumn("week_start", F.trunc("processed_date", "week"))
    return A.pivot_sum(e, ["person_id", "week_start"], "entry_type", "entry_value",
                       ["ACRL", "ABS", "CSH", "COVR", "ADJOTH"],
                       {"ACRL": "accrued", "ABS": "taken", "CSH": "encashed", "COVR": "carried_over", "ADJOTH": "adjusted"})


@register("r_py7_accruals_with_reversals", S.with_sql(f"""
SELECT person_id, pay_period,
       {sql_div_round(f'CAST(basic * 100 AS BIGINT) * {GRATUITY_DAYS}', '36500')} AS gratuity_accrued,
       {sql_div_round(f'CAST(reversed * 100 AS BIGINT) * {GRATUITY_DAYS}', '36500')} AS gratuity_reversed,
       {sql_div_round(f'CAST(basic * 100 AS BIGINT) * {LEAVE_DAYS}', '36500')} AS leave_accrued,
       {sql_div_round(f'CAST(reversed * 100 AS BIGINT) * {LEAVE_DAYS}', '36500')} AS leave_reversed
FROM (SELECT person_id, strftime(effective_date, '%Y-%m') AS pay_period,
             SUM(CASE WHEN element = 'Basic' THEN {_VAL} ELSE 0 END) AS basic,
             SUM(CASE WHEN element = 'Deduction' THEN {_VAL} ELSE 0 END) AS reversed
      FROM run_results GROUP BY 1, 2) x""", "run_results"))
def accruals_with_reversals(t: Tables) -> DataFrame:
    """R-PY7: gratuity and leave accruals on basic pay and their reversals
    (deduction runs), per person and month (A2, exact cents)."""
    r = S.run_results(t)
    v = _value()
    g = r.groupBy("person_id", F.date_format("effective_date", "yyyy-MM").alias("pay_period")).agg(
        F.sum(F.when(F.col("element") == "Basic", v).otherwise(0)).alias("basic"),
        F.sum(F.when(F.col("element") == "Deduction", v).otherwise(0)).alias("reversed"))
    acc = lambda c, days: div_round(cents(c) * days, F.lit(36500), 2)
    return g.select("person_id", "pay_period", acc("basic", GRATUITY_DAYS).alias("gratuity_accrued"),
                    acc("reversed", GRATUITY_DAYS).alias("gratuity_reversed"),
                    acc("basic", LEAVE_DAYS).alias("leave_accrued"), acc("reversed", LEAVE_DAYS).alias("leave_reversed"))


def bank_accounts(t: Tables) -> DataFrame:
    """Dated salary bank accounts: a purchase event opens a new account
    version for the person (end = next start - 1, open end 4712-12-31)."""
    from pyspark.sql import Window
    e = t.events.filter(F.col("event_type") == "purchase").groupBy(
        F.col("user_id").alias("person_id"), F.to_date("ts").alias("eff_start")).agg(
        F.max("event_id").alias("account_event"))
    w = Window.partitionBy("person_id").orderBy("eff_start")
    return e.select("person_id", "eff_start",
                    F.concat(F.lit("ACC-"), F.col("account_event").cast("string")).alias("account_number"),
                    F.coalesce(F.date_sub(F.lead("eff_start").over(w), 1), F.lit(END_OF_TIME)).alias("eff_end"))


S._cte("bank_accounts", (), f"""
SELECT person_id, eff_start, 'ACC-' || CAST(account_event AS VARCHAR) AS account_number,
       COALESCE(CAST(LEAD(eff_start) OVER (PARTITION BY person_id ORDER BY eff_start) - 1 AS DATE), {D(END_OF_TIME)}) AS eff_end
FROM (SELECT user_id AS person_id, CAST(ts AS DATE) AS eff_start, MAX(event_id) AS account_event
      FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) e""")

_BANK_DATE = _dt.date(2024, 1, 20)


@register("r_py10_bank_account_at_date", S.with_sql(f"""
SELECT p.person_id, b.account_number, b.eff_start AS account_since
FROM people p LEFT JOIN bank_accounts b ON b.person_id = p.person_id
 AND {D(_BANK_DATE)} BETWEEN b.eff_start AND b.eff_end""", "people", "bank_accounts"))
def bank_account_at_date(t: Tables) -> DataFrame:
    """R-PY10: the salary bank account valid at a date (J7), NULL when none."""
    acc = E.as_of(bank_accounts(t), _BANK_DATE).select("person_id", "account_number",
                                                       F.col("eff_start").alias("account_since"))
    return S.people(t).join(acc, "person_id", "left")


@register("r_py11_payroll_flows", S.with_sql(f"""
SELECT 'PAYROLL-' || strftime(effective_date, '%Y%m%d') AS flow_instance, classification AS consolidation_set,
       COUNT(*) AS results, CAST(SUM({_VAL}) AS DECIMAL(38,2)) AS total
FROM run_results WHERE result_value IS NOT NULL GROUP BY 1, 2""", "run_results"))
def payroll_flows(t: Tables) -> DataFrame:
    """R-PY11: run results per flow instance (pay date) and consolidation
    set; the flow filter is the NVL form (F4): with no parameter, rows with
    a NULL value are dropped, not kept."""
    from tallyspark.functions.params import filter_nvl
    r = filter_nvl(S.run_results(t), "result_value", None)
    return r.groupBy(F.concat(F.lit("PAYROLL-"), F.date_format("effective_date", "yyyyMMdd")).alias("flow_instance"),
                     F.col("classification").alias("consolidation_set")).agg(
        F.count(F.lit(1)).alias("results"), F.sum(_value()).cast(TOTAL).alias("total"))


# Allowance percentages of salary in the compensation listing.
HOUSING_PCT = 25
TRANSPORT_PCT = 10


@register("r_cp1_compensation_listing", S.with_sql(f"""
SELECT s.person_id, s.person_number, s.department, v.grade_id, v.salary,
       {sql_div_round(f'CAST(v.salary * 100 AS BIGINT) * {HOUSING_PCT}', '10000')} AS housing_allowance,
       {sql_div_round(f'CAST(v.salary * 100 AS BIGINT) * {TRANSPORT_PCT}', '10000')} AS transport_allowance,
       CAST(v.salary + {sql_div_round(f'CAST(v.salary * 100 AS BIGINT) * {HOUSING_PCT}', '10000')}
                     + {sql_div_round(f'CAST(v.salary * 100 AS BIGINT) * {TRANSPORT_PCT}', '10000')} AS DECIMAL(38,2)) AS gross
FROM service_periods s JOIN person_versions v ON v.person_id = s.person_id
 AND {D(AS_OF)} BETWEEN v.eff_start AND v.eff_end""", "service_periods", "person_versions"))
def compensation_listing(t: Tables) -> DataFrame:
    """R-CP1: salary at the date (J7) with percentage allowances and gross."""
    sp = S.service_periods(t).select("person_id", "person_number", "department")
    v = E.as_of(S.person_versions(t), t.params.as_of).select("person_id", "grade_id", "salary")
    j = sp.join(v, "person_id")
    h = div_round(cents("salary") * HOUSING_PCT, F.lit(10000), 2)
    tr = div_round(cents("salary") * TRANSPORT_PCT, F.lit(10000), 2)
    return j.select("person_id", "person_number", "department", "grade_id", "salary", h.alias("housing_allowance"),
                    tr.alias("transport_allowance"), (F.col("salary") + h + tr).cast(TOTAL).alias("gross"))


# Department -> cost centre.
COST_CENTRES = [("AUTOMOBILE", "CC-100"), ("BUILDING", "CC-200"), ("FURNITURE", "CC-300"),
                ("HOUSEHOLD", "CC-400"), ("MACHINERY", "CC-500")]


# Stand-ins: every fourth order of a person is a dependant, born as many years
# before it as its key's remainder by 30; one in eight is a spouse, two in
# three are eligible.  Nationals are the people of region 4.
CHILD_ALLOWANCE = 600

S._cte("dependants", (), """
SELECT o_custkey AS person_id, o_orderkey AS contact_id, CASE WHEN o_orderkey % 32 = 0 THEN 'S' ELSE 'C' END AS contact_type,
       CAST(CAST(o_orderdate AS DATE) - to_years(CAST(o_orderkey % 30 AS INTEGER)) AS DATE) AS birth_date,
       CASE WHEN o_orderkey % 3 = 0 THEN 'N' ELSE 'Y' END AS eligible
FROM orders WHERE o_orderkey % 4 = 0""")


def dependants(t: Tables) -> DataFrame:
    """Dependants of people: child or spouse, birth date, eligibility."""
    key = F.col("o_orderkey")
    return t.orders.filter(key % 4 == 0).select(
        F.col("o_custkey").alias("person_id"), key.alias("contact_id"), F.when(key % 32 == 0, "S").otherwise("C").alias("contact_type"),
        F.add_months(F.to_date("o_orderdate"), (-12 * (key % 30)).cast("int")).alias("birth_date"),
        F.when(key % 3 == 0, "N").otherwise("Y").alias("eligible"))


@register("r_cp8_dependants_by_age", S.with_sql(f"""
SELECT d.person_id,
       CAST(SUM(CASE WHEN d.eligible = 'Y' AND d.age < 2 THEN 1 ELSE 0 END) AS BIGINT) AS infants,
       CAST(SUM(CASE WHEN d.eligible = 'Y' AND d.age BETWEEN 2 AND 11 THEN 1 ELSE 0 END) AS BIGINT) AS children,
       CAST(SUM(CASE WHEN d.eligible = 'Y' AND d.age > 11 THEN 1 ELSE 0 END) AS BIGINT) AS adults,
       CAST(SUM(CASE WHEN d.eligible = 'Y' AND d.contact_type = 'S' THEN 1 ELSE 0 END) AS BIGINT) AS spouses,
       CAST(SUM(CASE WHEN d.eligible = 'Y' AND d.contact_type = 'C' AND c.ledger_id = 4 THEN 1 ELSE 0 END) AS BIGINT) AS allowance_children,
       CAST(SUM(CASE WHEN d.eligible = 'Y' AND d.contact_type = 'C' AND c.ledger_id = 4 THEN {CHILD_ALLOWANCE} ELSE 0 END) AS BIGINT) AS child_allowance
FROM (SELECT *, CAST(floor({months_between_sql(D(AS_OF), "birth_date")} / 12) AS BIGINT) AS age
      FROM dependants WHERE birth_date <= {D(AS_OF)}) d
JOIN customers c ON c.customer_id = d.person_id GROUP BY d.person_id""", "dependants", "customers"))
def dependants_by_age(t: Tables) -> DataFrame:
    """R-CP8: eligible dependants by age at the date (below 2, 2 to 11, above
    11 years, spouses of any age) and the fixed allowance for the eligible
    children of nationals."""
    as_of = t.params.as_of
    d = dependants(t).filter(F.col("birth_date") <= F.lit(as_of))
    d = d.join(S.customers(t).select(F.col("customer_id").alias("person_id"), "ledger_id"), "person_id")
    age = F.floor(F.months_between(F.lit(as_of), F.col("birth_date"), False) / 12)
    ok = F.col("eligible") == "Y"
    child = ok & (F.col("contact_type") == "C") & (F.col("ledger_id") == 4)
    many = lambda cond, name, each=1: F.sum(F.when(cond, each).otherwise(0)).alias(name)
    return d.groupBy("person_id").agg(many(ok & (age < 2), "infants"), many(ok & age.between(2, 11), "children"), many(ok & (age > 11), "adults"),
                                      many(ok & (F.col("contact_type") == "S"), "spouses"), many(child, "allowance_children"),
                                      many(child, "child_allowance", CHILD_ALLOWANCE))


@register("r_cp9_cost_centre_map", S.with_sql(f"""
SELECT s.person_id, s.department, COALESCE(m.cost_centre, 'CC-999') AS cost_centre
FROM service_periods s LEFT JOIN (VALUES {", ".join(f"('{a}', '{b}')" for a, b in COST_CENTRES)}) m(department, cost_centre)
  ON m.department = s.department""", "service_periods"))
def cost_centre_map(t: Tables) -> DataFrame:
    """R-CP9: department -> cost centre from a constant map (S4), default CC-999."""
    from tallyspark.sources import constants as K
    m = K.frame(t.spark, COST_CENTRES, "department string, cost_centre string")
    j = S.service_periods(t).select("person_id", "department").join(m, "department", "left")
    return j.select("person_id", "department", F.coalesce("cost_centre", F.lit("CC-999")).alias("cost_centre"))


def enrolments(t: Tables) -> DataFrame:
    """Medical plan enrolment per person: plan by department, coverage
    level by grade, valid over the period of service."""
    s = S.service_periods(t)
    return s.select("person_id", F.concat(F.lit("MEDICAL-"), F.col("department")).alias("plan_name"),
                    F.col("date_start").alias("eff_start"), F.col("actual_termination_date").alias("eff_end"))


S._cte("enrolments", ("service_periods",), """
SELECT person_id, 'MEDICAL-' || department AS plan_name, date_start AS eff_start, actual_termination_date AS eff_end
FROM service_periods""")


@register("r_bn1_medical_enrolments", S.with_sql(f"""
SELECT e.person_id, e.plan_name, e.eff_start, CASE WHEN v.grade_id <= 2 THEN 'FAMILY' ELSE 'EMPLOYEE' END AS coverage_level
FROM enrolments e JOIN person_versions v ON v.person_id = e.person_id AND {D(AS_OF)} BETWEEN v.eff_start AND v.eff_end
WHERE {D(AS_OF)} >= e.eff_start AND {D(AS_OF)} <= COALESCE(e.eff_end, {D(END_OF_TIME)})""", "enrolments", "person_versions"))
def medical_enrolments(t: Tables) -> DataFrame:
    """R-BN1: medical enrolments valid at the date with the coverage level
    from the grade valid at the same date (J7 on both)."""
    e = E.as_of(enrolments(t), t.params.as_of)
    v = E.as_of(S.person_versions(t), t.params.as_of).select("person_id", "grade_id")
    j = e.join(v, "person_id")
    return j.select("person_id", "plan_name", "eff_start",
                    F.when(F.col("grade_id") <= 2, "FAMILY").otherwise("EMPLOYEE").alias("coverage_level"))


@register("r_bn2_enrolment_coverage_check", S.with_sql(f"""
SELECT e.person_id, e.plan_name, CAST(r.rate * 10 AS DECIMAL(18,2)) AS coverage_amount,
       CASE WHEN r.rate IS NULL THEN 'NO COVERAGE' ELSE 'COVERED' END AS coverage_check
FROM enrolments e JOIN customers c ON c.customer_id = e.person_id
LEFT JOIN rate_card r ON r.region_id = c.ledger_id AND r.segment = c.segment AND r.kind = 'ADULT'
 AND {D(AS_OF)} BETWEEN r.valid_from AND r.valid_to
WHERE {D(AS_OF)} >= e.eff_start AND {D(AS_OF)} <= COALESCE(e.eff_end, {D(END_OF_TIME)})""",
                                                        "enrolments", "customers", "rate_card"))
def enrolment_coverage_check(t: Tables) -> DataFrame:
    """R-BN2: enrolments valid at the date (row validity) checked against a
    coverage rate valid at the same date (second J7)."""
    from tallyspark.sources import constants as K
    e = E.as_of(enrolments(t), t.params.as_of)
    c = S.customers(t).select(F.col("customer_id").alias("person_id"), F.col("ledger_id").alias("region_id"), "segment")
    rc = E.as_of(K.rate_card(t.spark).filter(F.col("kind") == "ADULT"), t.params.as_of, "valid_from", "valid_to") \
        .select("region_id", "segment", "rate")
    j = e.join(c, "person_id").join(rc, ["region_id", "segment"], "left")
    return j.select("person_id", "plan_name", (F.col("rate") * 10).cast("decimal(18,2)").alias("coverage_amount"),
                    F.when(F.col("rate").isNull(), "NO COVERAGE").otherwise("COVERED").alias("coverage_check"))


# Stand-ins: allowance elements as a percentage of the monthly salary, paid to
# grades up to the last number.  Fixed values: the element names.
ALLOWANCES = [("Housing Allowance", 25, 5), ("Transport Allowance", 10, 5), ("Food Allowance", 5, 3), ("Mobile Allowance", 2, 2), ("Other Allowance", 3, 4)]

S._cte("element_entries", ("person_versions",), " UNION ALL ".join(
    ["SELECT person_id, 'Basic' AS element, salary AS entry_value, eff_start, eff_end FROM person_versions"]
    + [f"SELECT person_id, '{name}', {sql_div_round(f'CAST(salary * 100 AS BIGINT) * {pct}', '120000')}, eff_start, eff_end FROM person_versions WHERE grade_id <= {last}"
       for name, pct, last in ALLOWANCES]))


def element_entries(versions: DataFrame) -> DataFrame:
    """Element entries of salary versions: the annual basic and the monthly
    allowances of the grade, a row each."""
    entry = lambda name, value: F.struct(F.lit(name).alias("element"), value.cast("decimal(18,2)").alias("entry_value"))
    paid = [F.when(F.col("grade_id") <= last, entry(name, div_round(cents("salary") * pct, F.lit(120000), 2))) for name, pct, last in ALLOWANCES]
    rest = [c for c in versions.columns if c not in ("salary", "grade_id")]
    return versions.select(*rest, F.explode(F.array(entry("Basic", F.col("salary")), *paid)).alias("e")).filter("e IS NOT NULL").select(*rest, "e.*")


def _allowance_column(name: str) -> str:
    return name.lower().replace(" ", "_")


def _entry_sum(name: str) -> F.Column:
    return F.sum(F.when(F.col("element") == name, F.col("entry_value")))


@register("r_cp1_compensation_elements", S.with_sql(f"""
SELECT s.person_number, s.full_name, s.date_start AS hire_date, s.department, g.grade_id, e.basic_salary,
       {", ".join(f"COALESCE(e.{_allowance_column(n)}, 0) AS {_allowance_column(n)}" for n, _, _ in ALLOWANCES)},
       COALESCE(e.gross_salary, 0) AS gross_salary
FROM service_periods s
LEFT JOIN (SELECT person_id, {sql_div_round("CAST(SUM(CASE WHEN element = 'Basic' THEN entry_value END) * 100 AS BIGINT)", "1200")} AS basic_salary,
                  {", ".join(f"CAST(SUM(CASE WHEN element = '{n}' THEN entry_value END) AS DECIMAL(38,2)) AS {_allowance_column(n)}" for n, _, _ in ALLOWANCES)},
                  CAST(SUM(entry_value) AS DECIMAL(38,2)) AS gross_salary
           FROM element_entries WHERE {D(AS_OF)} BETWEEN eff_start AND eff_end GROUP BY person_id) e ON e.person_id = s.person_id
LEFT JOIN person_versions g ON g.person_id = s.person_id AND {D(AS_OF)} BETWEEN g.eff_start AND g.eff_end
WHERE s.date_start <= {D(AS_OF)} AND COALESCE(s.actual_termination_date, {D(END_OF_TIME)}) >= {D(AS_OF)}""",
                                                    "service_periods", "element_entries", "person_versions"))
def compensation_elements(t: Tables) -> DataFrame:
    """R-CP1 by element: monthly basic, the five allowances and the gross of
    all earning entries valid at the date (J7), for people then in service;
    one pass over the entries (A2).  Gross adds entry values as they are
    stored, the annual basic among them, as the listing does."""
    v = E.as_of(S.person_versions(t), t.params.as_of).drop("eff_start", "eff_end")
    grades = v.select("person_id", "grade_id")
    e = element_entries(v).groupBy("person_id").agg(
        div_round(cents(_entry_sum("Basic")), F.lit(1200), 2).alias("basic_salary"),
        *[_entry_sum(n).cast(TOTAL).alias(_allowance_column(n)) for n, _, _ in ALLOWANCES], F.sum("entry_value").cast(TOTAL).alias("gross_salary"))
    s = S.service_periods(t).filter((F.col("date_start") <= F.lit(t.params.as_of))
                                    & (F.coalesce("actual_termination_date", F.lit(END_OF_TIME)) >= F.lit(t.params.as_of)))
    j = s.join(e, "person_id", "left").join(grades, "person_id", "left")
    none = F.lit(0).cast(TOTAL)
    return j.select("person_number", "full_name", F.col("date_start").alias("hire_date"), "department", "grade_id", "basic_salary",
                    *[F.coalesce(c, none).alias(c) for c in (*(_allowance_column(n) for n, _, _ in ALLOWANCES), "gross_salary")])


_AIR = ("air_fare_self", "air_fare_spouse", "air_fare_child", "air_fare_infant", "air_fare_adult_dependent")
_LEFT_AGE = f"CAST(floor({months_between_sql('s.actual_termination_date', 'd.birth_date')} / 12) AS BIGINT)"
_LEAVER_SQL = S.with_sql(f"""
SELECT person_id, actual_termination_date, basic_salary, housing_allowance, leave_balance_days, service_years, one_day_salary, leave_encashment,
       gratuity_balance, {", ".join(_AIR)},
       CAST(leave_encashment + gratuity_balance + {" + ".join(_AIR)} AS DECIMAL(38,2)) AS total_eos_payment
FROM (SELECT *, {sql_div_round("CAST((basic_salary + housing_allowance) * 100 AS BIGINT)", "3000")} AS one_day_salary,
             {sql_div_round("CAST((basic_salary + housing_allowance) * 100 AS BIGINT) * CAST(leave_balance_days * 100 AS BIGINT)", "300000")} AS leave_encashment,
             {sql_div_round(f"CAST(basic_salary * 100 AS BIGINT) * service_years * {GRATUITY_DAYS}", "3000")} AS gratuity_balance
      FROM (SELECT s.person_id, s.actual_termination_date, {sql_div_round("CAST(v.salary * 100 AS BIGINT)", "1200")} AS basic_salary,
                   CASE WHEN v.grade_id <= {ALLOWANCES[0][2]} THEN {sql_div_round(f"CAST(v.salary * 100 AS BIGINT) * {ALLOWANCES[0][1]}", "120000")} ELSE 0 END AS housing_allowance,
                   COALESCE(b.days, CAST(0 AS DECIMAL(38,2))) AS leave_balance_days,
                   CAST(floor({months_between_sql("s.actual_termination_date", "s.date_start")} / 12) AS BIGINT) AS service_years,
                   CAST(COALESCE(r.adult, 0) AS DECIMAL(38,2)) AS air_fare_self, CAST(COALESCE(r.adult * f.spouses, 0) AS DECIMAL(38,2)) AS air_fare_spouse,
                   CAST(COALESCE(r.child * f.children, 0) AS DECIMAL(38,2)) AS air_fare_child, CAST(COALESCE(r.infant * f.infants, 0) AS DECIMAL(38,2)) AS air_fare_infant,
                   CAST(COALESCE(r.adult * f.adults, 0) AS DECIMAL(38,2)) AS air_fare_adult_dependent
            FROM service_periods s
            JOIN person_versions v ON v.person_id = s.person_id AND s.actual_termination_date BETWEEN v.eff_start AND v.eff_end
            JOIN customers c ON c.customer_id = s.person_id
            LEFT JOIN (SELECT person_id, CAST(SUM(CASE WHEN entry_type IN ('COVR', 'ACRL', 'ADJOTH') THEN entry_value WHEN entry_type IN ('CSH', 'ABS') THEN -entry_value
                              ELSE 0 END) AS DECIMAL(38,2)) AS days FROM accrual_entries WHERE processed_date <= {D(EVENTS_TO)} GROUP BY person_id) b ON b.person_id = s.person_id
            LEFT JOIN (SELECT d.person_id, CAST(SUM(CASE WHEN d.contact_type = 'S' THEN 1 ELSE 0 END) AS BIGINT) AS spouses,
                              CAST(SUM(CASE WHEN d.contact_type = 'C' AND {_LEFT_AGE} < 2 THEN 1 ELSE 0 END) AS BIGINT) AS infants,
                              CAST(SUM(CASE WHEN d.contact_type = 'C' AND {_LEFT_AGE} BETWEEN 2 AND 11 THEN 1 ELSE 0 END) AS BIGINT) AS children,
                              CAST(SUM(CASE WHEN d.contact_type = 'C' AND {_LEFT_AGE} > 11 THEN 1 ELSE 0 END) AS BIGINT) AS adults
                       FROM dependants d JOIN service_periods s ON s.person_id = d.person_id AND d.birth_date <= s.actual_termination_date
                       WHERE d.eligible = 'Y' GROUP BY d.person_id) f ON f.person_id = s.person_id
            LEFT JOIN (SELECT region_id, segment, valid_from, valid_to, MAX(CASE WHEN kind = 'ADULT' THEN rate END) AS adult, MAX(CASE WHEN kind = 'CHILD' THEN rate END) AS child,
                              MAX(CASE WHEN kind = 'INFANT' THEN rate END) AS infant FROM rate_card GROUP BY ALL) r
              ON r.region_id = c.ledger_id AND r.segment = c.segment AND s.actual_termination_date BETWEEN r.valid_from AND r.valid_to) x) y""",
                           "service_periods", "person_versions", "customers", "accrual_entries", "dependants", "rate_card")


@register("r_cp7_end_of_service_components", _LEAVER_SQL)
def end_of_service_components(t: Tables) -> DataFrame:
    """R-CP7 after the reference, for people who have left: leave encashment
    (basic + housing) / 30 x leave balance, gratuity balance, and the fares of
    the person, the spouse and the eligible dependants by age at the leaving
    date (J7 on salary and rate card).  The gratuity balance is calculated
    (basic x years x 21 / 30); a fare without a valid rate counts as 0."""
    from tallyspark.sources import constants as K
    left = S.service_periods(t).filter(F.col("actual_termination_date").isNotNull()).select("person_id", "date_start", "actual_termination_date")
    years = F.floor(F.months_between("actual_termination_date", "date_start", False) / 12).cast("bigint")
    j = E.join_effective(left.withColumn("service_years", years), S.person_versions(t), ["person_id"], "actual_termination_date", how="inner",
                         within=S.order_date_bounds(t))
    j = j.join(S.customers(t).select(F.col("customer_id").alias("person_id"), F.col("ledger_id").alias("region_id"), "segment"), "person_id")
    value = F.col("entry_value")
    sign = F.when(F.col("entry_type").isin("COVR", "ACRL", "ADJOTH"), value).when(F.col("entry_type").isin("CSH", "ABS"), -value).otherwise(0)
    days = S.accrual_entries(t).filter(F.col("processed_date") <= F.lit(t.params.events_to)).groupBy("person_id").agg(F.sum(sign).cast(TOTAL).alias("days"))
    d = dependants(t).filter(F.col("eligible") == "Y").join(left.select("person_id", "actual_termination_date"), "person_id")
    d = d.filter(F.col("birth_date") <= F.col("actual_termination_date"))
    age = F.floor(F.months_between("actual_termination_date", "birth_date", False) / 12)
    child = F.col("contact_type") == "C"
    many = lambda cond, name: F.sum(F.when(cond, 1).otherwise(0)).alias(name)
    family = d.groupBy("person_id").agg(many(F.col("contact_type") == "S", "spouses"), many(child & (age < 2), "infants"),
                                        many(child & age.between(2, 11), "children"), many(child & (age > 11), "adults"))
    rate = lambda kind: F.max(F.when(F.col("kind") == kind.upper(), F.col("rate"))).alias(kind)
    fares = K.rate_card(t.spark).groupBy(F.col("region_id").alias("r_region"), F.col("segment").alias("r_segment"), "valid_from", "valid_to").agg(
        rate("adult"), rate("child"), rate("infant"))
    j = j.join(days, "person_id", "left").join(family, "person_id", "left")
    j = j.join(fares, (j.region_id == fares.r_region) & (j.segment == fares.r_segment) & j.actual_termination_date.between(fares.valid_from, fares.valid_to), "left")
    none = F.lit(0)
    fare = lambda kind, number: F.coalesce((F.col(kind) * number).cast(TOTAL), none.cast(TOTAL))
    _, pct, last = ALLOWANCES[0]
    j = j.select("person_id", "actual_termination_date", div_round(cents("salary"), F.lit(1200), 2).alias("basic_salary"),
                 F.when(F.col("grade_id") <= last, div_round(cents("salary") * pct, F.lit(120000), 2)).otherwise(none).cast("decimal(18,2)").alias("housing_allowance"),
                 F.coalesce("days", none).cast(TOTAL).alias("leave_balance_days"), "service_years",
                 fare("adult", F.lit(1)).alias("air_fare_self"), fare("adult", F.col("spouses")).alias("air_fare_spouse"),
                 fare("child", F.col("children")).alias("air_fare_child"), fare("infant", F.col("infants")).alias("air_fare_infant"),
                 fare("adult", F.col("adults")).alias("air_fare_adult_dependent"))
    paid = cents(F.col("basic_salary") + F.col("housing_allowance"))
    j = j.select("*", div_round(paid, F.lit(3000), 2).alias("one_day_salary"),
                 div_round(paid * cents("leave_balance_days"), F.lit(300000), 2).alias("leave_encashment"),
                 div_round(cents("basic_salary") * F.col("service_years") * GRATUITY_DAYS, F.lit(3000), 2).alias("gratuity_balance"))
    total = F.col("leave_encashment") + F.col("gratuity_balance")
    for c in _AIR:
        total = total + F.col(c)
    return j.withColumn("total_eos_payment", total.cast(TOTAL))
