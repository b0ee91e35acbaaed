"""HR, absence and recruiting (R-HR*, R-AB*, R-RC*)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.params import AS_OF, END_OF_TIME, EVENTS_FROM, EVENTS_TO
from tallyspark.functions.scalars import TOTAL, percent, sql_percent
from tallyspark.operators import effective as E
from tallyspark.operators import rollup as A
from tallyspark.plans.generic import ATTRIBUTE_MAP
from tallyspark.plans.registry import register
from tallyspark.sources import standins as S
from tallyspark.sources.tables import Tables

D = S._d


@register("r_hr1_headcount_at_date", S.with_sql(f"""
SELECT department, COUNT(*) AS headcount FROM service_periods
WHERE date_start <= {D(AS_OF)} AND COALESCE(actual_termination_date, {D(END_OF_TIME)}) >= {D(AS_OF)}
GROUP BY department""", "service_periods"))
def headcount(t: Tables) -> DataFrame:
    """R-HR1: headcount at a date by department (period of service valid at the date)."""
    s = E.as_of(S.service_periods(t), t.params.as_of, "date_start", "actual_termination_date")
    return s.groupBy("department").agg(F.count(F.lit(1)).alias("headcount"))


@register("r_hr2_worker_master", S.with_sql(f"""
SELECT s.person_id, s.person_number, s.full_name, s.department, s.date_start,
       LEAST(COALESCE(s.actual_termination_date, {D(AS_OF)}), {D(AS_OF)}) AS service_end,
       LEAST(COALESCE(s.actual_termination_date, {D(AS_OF)}), {D(AS_OF)}) - s.date_start AS service_days,
       CASE WHEN s.actual_termination_date IS NULL OR s.actual_termination_date >= {D(AS_OF)} THEN 'ACTIVE' ELSE 'TERMINATED' END AS assignment_status
FROM service_periods s WHERE s.date_start <= {D(AS_OF)}""", "service_periods"))
def worker_master(t: Tables) -> DataFrame:
    """R-HR2: worker master with service (as-of date capped by termination, J9)."""
    s = S.service_periods(t).filter(F.col("date_start") <= F.lit(t.params.as_of))
    end = E.capped_as_of("actual_termination_date", t.params.as_of)
    status = F.when(F.col("actual_termination_date").isNull() | (F.col("actual_termination_date") >= F.lit(t.params.as_of)),
                    "ACTIVE").otherwise("TERMINATED")
    return s.select("person_id", "person_number", "full_name", "department", "date_start", end.alias("service_end"),
                    F.datediff(end, F.col("date_start")).cast("bigint").alias("service_days"), status.alias("assignment_status"))


@register("r_hr4_leaving_state", S.with_sql("""
SELECT s.person_id, s.actual_termination_date, v.salary AS last_salary, v.grade_id AS last_grade,
       CASE WHEN v.grade_id <= 2 THEN 'RESIGNATION' ELSE 'END OF CONTRACT' END AS leaving_reason
FROM service_periods s LEFT JOIN person_versions v ON v.person_id = s.person_id
 AND CAST(s.actual_termination_date + 1 AS DATE) BETWEEN v.eff_start AND v.eff_end
WHERE s.actual_termination_date IS NOT NULL""", "service_periods", "person_versions"))
def leaving_state(t: Tables) -> DataFrame:
    """R-HR4: leaving action and reason from the state on termination + 1 day."""
    s = S.service_periods(t).filter(F.col("actual_termination_date").isNotNull()) \
        .select("person_id", "actual_termination_date", F.date_add("actual_termination_date", 1).alias("probe"))
    j = E.join_effective(s, S.person_versions(t), ["person_id"], "probe", within=S.order_date_bounds(t))
    reason = F.when(F.col("grade_id") <= 2, "RESIGNATION").otherwise("END OF CONTRACT")
    return j.select("person_id", "actual_termination_date", F.col("salary").alias("last_salary"),
                    F.col("grade_id").alias("last_grade"), reason.alias("leaving_reason"))


@register("r_ab5_leave_summary", S.with_sql("""
SELECT person_id, absence_type, COUNT(*) AS leaves, CAST(SUM(end_date - start_date + 1) AS BIGINT) AS leave_days
FROM leaves GROUP BY person_id, absence_type""", "leaves"))
def leave_summary(t: Tables) -> DataFrame:
    """R-AB5: leave count and days per person and type."""
    lv = S.leaves(t)
    return lv.groupBy("person_id", "absence_type").agg(
        F.count(F.lit(1)).alias("leaves"),
        F.sum(F.datediff("end_date", "start_date") + 1).alias("leave_days"))


@register("r_ab1_leave_history", S.with_sql("""
SELECT person_id, COUNT(*) AS prior_leaves,
       string_agg(strftime(start_date, '%Y-%m-%d'), ', ' ORDER BY start_date, absence_id) AS leave_dates
FROM leaves GROUP BY person_id""", "leaves"))
def leave_history(t: Tables) -> DataFrame:
    """R-AB1: prior leaves per person, listed in date order."""
    lv = S.leaves(t).withColumn("d", F.date_format("start_date", "yyyy-MM-dd"))
    lst = A.ordered_list(lv, ["person_id"], "d", ["start_date", "absence_id"], ", ", "leave_dates")
    cnt = lv.groupBy("person_id").agg(F.count(F.lit(1)).alias("prior_leaves"))
    return cnt.join(lst, "person_id")


# Accrual entry types and their sign in the leave balance.
BALANCE_COMPONENTS = [("COVR", "carry_over", 1), ("ACRL", "accrued", 1), ("ADJOTH", "adjustments", 1),
                      ("CSH", "encashed", -1), ("ABS", "taken", -1)]


def _component_sql() -> str:
    parts = [f"CAST(SUM(CASE WHEN entry_type = '{c}' THEN entry_value ELSE 0 END) AS DECIMAL(38,2)) AS {n}"
             for c, n, _ in BALANCE_COMPONENTS]
    bal = " + ".join(f"{'' if s > 0 else '-'}SUM(CASE WHEN entry_type = '{c}' THEN entry_value ELSE 0 END)"
                     for c, _, s in BALANCE_COMPONENTS)
    return ", ".join(parts) + f", CAST({bal} AS DECIMAL(38,2)) AS balance"


def _components() -> list:
    cols = [F.sum(F.when(F.col("entry_type") == c, F.col("entry_value")).otherwise(0)).cast(TOTAL).alias(n)
            for c, n, _ in BALANCE_COMPONENTS]
    bal = None
    for c, _, s in BALANCE_COMPONENTS:
        term = F.sum(F.when(F.col("entry_type") == c, F.col("entry_value")).otherwise(0)) * s
        bal = term if bal is None else bal + term
    return cols + [bal.cast(TOTAL).alias("balance")]


@register("r_ab6_annual_leave_balance", S.with_sql(f"""
SELECT person_id, plan_name, {_component_sql()}
FROM accrual_entries WHERE processed_date <= {D(EVENTS_TO)} GROUP BY person_id, plan_name""", "accrual_entries"))
def annual_leave_balance(t: Tables) -> DataFrame:
    """R-AB6/A14: carry + accrued + adjustments - encashed - taken, one pass."""
    e = S.accrual_entries(t).filter(F.col("processed_date") <= F.lit(t.params.events_to))
    return e.groupBy("person_id", "plan_name").agg(*_components())


@register("r_ab7_balance_by_plan_year", S.with_sql(f"""
SELECT person_id, CAST(date_trunc('year', processed_date) AS DATE) AS plan_year_start, {_component_sql()}
FROM accrual_entries GROUP BY 1, 2""", "accrual_entries"))
def balance_by_plan_year(t: Tables) -> DataFrame:
    """R-AB7: balance by movement type per calendar plan year."""
    from tallyspark.functions.scalars import plan_year_start
    e = S.accrual_entries(t)
    return e.groupBy("person_id", plan_year_start("processed_date").alias("plan_year_start")).agg(*_components())


# Carry-over of the year before may be taken up to this many days after it was
# granted; what leave taken by then has not used up expires.
CARRY_OVER_DAYS = 10

_EXPIRY_SQL = S.with_sql(f"""
SELECT g.person_id, g.plan_name, g.carry_over, g.accrued, g.adjustments, g.transferred, g.encashed, g.taken, COALESCE(x.expired, CAST(0 AS DECIMAL(38,2))) AS expired,
       CAST(g.carry_over + g.accrued + g.adjustments + g.transferred - g.encashed - g.taken - COALESCE(x.expired, 0) AS DECIMAL(38,2)) AS balance,
       x.last_expiry_date
FROM (SELECT person_id, plan_name,
             CAST(SUM(CASE WHEN entry_type = 'COVR' THEN entry_value ELSE 0 END) AS DECIMAL(38,2)) AS carry_over,
             CAST(SUM(CASE WHEN entry_type = 'ACRL' THEN entry_value ELSE 0 END) AS DECIMAL(38,2)) AS accrued,
             CAST(SUM(CASE WHEN entry_type = 'ADJOTH' AND entry_id % 2 = 0 THEN entry_value ELSE 0 END) AS DECIMAL(38,2)) AS adjustments,
             CAST(SUM(CASE WHEN entry_type = 'ADJOTH' AND entry_id % 2 = 1 THEN entry_value ELSE 0 END) AS DECIMAL(38,2)) AS transferred,
             CAST(SUM(CASE WHEN entry_type = 'CSH' THEN entry_value ELSE 0 END) AS DECIMAL(38,2)) AS encashed,
             CAST(SUM(CASE WHEN entry_type = 'ABS' THEN entry_value ELSE 0 END) AS DECIMAL(38,2)) AS taken
      FROM accrual_entries WHERE processed_date <= {D(EVENTS_TO)} GROUP BY person_id, plan_name) g
LEFT JOIN (
  SELECT person_id, plan_name, CAST(SUM(greatest(least(value, upto - used), 0)) AS DECIMAL(38,2)) AS expired, MAX(expiry) AS last_expiry_date
  FROM (SELECT c.person_id, c.plan_name, c.expiry, c.value, c.upto,
               COALESCE((SELECT SUM(entry_value) FROM accrual_entries a WHERE a.person_id = c.person_id AND a.plan_name = c.plan_name
                         AND a.entry_type = 'ABS' AND a.processed_date <= c.expiry), 0) AS used
        FROM (SELECT person_id, plan_name, CAST(processed_date + {CARRY_OVER_DAYS} AS DATE) AS expiry, SUM(entry_value) AS value,
                     SUM(SUM(entry_value)) OVER (PARTITION BY person_id, plan_name ORDER BY processed_date ROWS UNBOUNDED PRECEDING) AS upto
              FROM accrual_entries WHERE entry_type = 'COVR' AND processed_date <= {D(EVENTS_TO)} GROUP BY person_id, plan_name, processed_date) c
        WHERE c.expiry < {D(EVENTS_TO)}) e
  GROUP BY person_id, plan_name) x ON x.person_id = g.person_id AND x.plan_name = g.plan_name""", "accrual_entries")


def expired_carry_over(entries: DataFrame, as_of: _dt.date, days: int = CARRY_OVER_DAYS) -> DataFrame:
    """(person_id, plan_name, expired, last_expiry_date): carry-over that no
    leave has used up by its expiry.

    Grants are used up oldest first.  Laid end to end, a grant reaches up to
    the running total of grants; leave taken by its expiry has used the front
    of that line, so what is left of the grant is the part beyond it, at most
    the grant.  Running totals are over a person's days, not entries: grants
    and leave are summed per day first, and the leave taken up to each expiry
    comes from one window over the merged days."""
    key = ["person_id", "plan_name"]
    grants = entries.filter((F.col("entry_type") == "COVR") & (F.col("processed_date") <= F.lit(as_of)))
    grants = grants.groupBy(*key, "processed_date").agg(F.sum("entry_value").alias("value"))
    w = Window.partitionBy(*key).orderBy("processed_date").rowsBetween(Window.unboundedPreceding, 0)
    grants = grants.withColumn("upto", F.sum("value").over(w)).withColumn("day", F.date_add("processed_date", days))
    grants = grants.filter(F.col("day") < F.lit(as_of))
    leave = entries.filter(F.col("entry_type") == "ABS").groupBy(*key, F.col("processed_date").alias("day")).agg(F.sum("entry_value").alias("leave"))
    # leave of an expiry's own day still counts for it: days before grants
    merged = leave.select(*key, "day", "leave", F.lit(0).alias("last"), F.lit(None).cast(grants.schema["value"].dataType).alias("value"),
                          F.lit(None).cast(grants.schema["upto"].dataType).alias("upto")) \
        .unionByName(grants.select(*key, "day", F.lit(0).cast(leave.schema["leave"].dataType).alias("leave"), F.lit(1).alias("last"), "value", "upto"))
    seen = Window.partitionBy(*key).orderBy("day", "last").rowsBetween(Window.unboundedPreceding, 0)
    merged = merged.withColumn("used", F.sum("leave").over(seen)).filter("last = 1")
    left = F.greatest(F.least("value", F.col("upto") - F.col("used")), F.lit(0))
    return merged.groupBy(*key).agg(F.sum(left).cast(TOTAL).alias("expired"), F.max("day").alias("last_expiry_date"))


@register("r_ab6_balance_with_expiry", _EXPIRY_SQL)
def balance_with_expiry(t: Tables) -> DataFrame:
    """R-AB6/A14 with all seven movements: carried over, accrued, adjusted,
    transferred, encashed, taken and expired carry-over.

    Stand-ins: entries of type ADJOTH with an odd id are transfers; carry-over
    expires ``CARRY_OVER_DAYS`` after its day."""
    entries = S.accrual_entries(t)
    e = entries.filter(F.col("processed_date") <= F.lit(t.params.events_to))
    odd = F.col("entry_id") % 2 == 1
    kinds = {"carry_over": F.col("entry_type") == "COVR", "accrued": F.col("entry_type") == "ACRL", "adjustments": (F.col("entry_type") == "ADJOTH") & ~odd,
             "transferred": (F.col("entry_type") == "ADJOTH") & odd, "encashed": F.col("entry_type") == "CSH", "taken": F.col("entry_type") == "ABS"}
    g = e.groupBy("person_id", "plan_name").agg(*[F.sum(F.when(c, F.col("entry_value")).otherwise(0)).cast(TOTAL).alias(n) for n, c in kinds.items()])
    j = g.join(expired_carry_over(entries, t.params.events_to), ["person_id", "plan_name"], "left")
    j = j.withColumn("expired", F.coalesce("expired", F.lit(0)).cast(TOTAL))
    signs = {"carry_over": 1, "accrued": 1, "adjustments": 1, "transferred": 1, "encashed": -1, "taken": -1, "expired": -1}
    balance = sum((F.col(n) * s for n, s in signs.items()), F.lit(0))
    return j.select("person_id", "plan_name", *signs, balance.cast(TOTAL).alias("balance"), "last_expiry_date")


_ANNIVERSARY_SQL = S.with_sql(f"""
SELECT y.person_id, y.year_number, y.plan_year_start, y.plan_year_end, {_component_sql()}
FROM (SELECT person_id, n AS year_number, CAST(date_start + n * INTERVAL 1 YEAR AS DATE) AS plan_year_start,
             CAST(date_start + (n + 1) * INTERVAL 1 YEAR - INTERVAL 1 DAY AS DATE) AS plan_year_end
      FROM (SELECT person_id, date_start, unnest(range(0, 100)) AS n FROM service_periods)) y
JOIN accrual_entries e ON e.person_id = y.person_id AND e.processed_date BETWEEN y.plan_year_start AND y.plan_year_end
WHERE e.processed_date <= {D(EVENTS_TO)}
GROUP BY y.person_id, y.year_number, y.plan_year_start, y.plan_year_end""", "service_periods", "accrual_entries")


def plan_year_number(day, start):
    """Whole plan years from a start date to a day: the n with
    start + n years <= day < start + (n + 1) years.  A start on 29 February
    has its anniversary on the 28th in other years."""
    n = F.year(day) - F.year(start)
    return n - F.when(F.add_months(start, n * 12) > F.col(day), 1).otherwise(0)


@register("r_ab7_balance_by_anniversary_year", _ANNIVERSARY_SQL)
def balance_by_anniversary_year(t: Tables) -> DataFrame:
    """R-AB7: balance by movement type per plan year counted from the hire
    date (X9, anniversary mode); an entry's year is computed from its own date,
    so each entry meets one year."""
    e = S.accrual_entries(t).filter(F.col("processed_date") <= F.lit(t.params.events_to))
    p = S.service_periods(t).select("person_id", "date_start")
    n = plan_year_number("processed_date", "date_start")
    j = e.join(p, "person_id").withColumn("n", n.cast("bigint")).filter("n >= 0")
    start = F.add_months("date_start", (F.col("n") * 12).cast("int"))
    end = F.date_sub(F.add_months("date_start", ((F.col("n") + 1) * 12).cast("int")), 1)
    return j.groupBy("person_id", F.col("n").alias("year_number"), start.alias("plan_year_start"), end.alias("plan_year_end")).agg(*_components())


_REQUEST_SQL = S.with_sql(f"""
SELECT r.person_id, r.absence_id AS request_id, r.start_date, r.end_date, CAST(r.end_date - r.start_date + 1 AS BIGINT) AS days_requested,
       CASE WHEN h.previous_count > 0 THEN 'Full Leave History' ELSE 'New Leave Request' END AS history_class,
       COALESCE(h.previous_count, 0) AS previous_count, COALESCE(h.days_taken, 0) AS days_taken, h.last_leave_date,
       r.start_date - h.last_leave_date AS days_since_last,
       COALESCE(c.conflicts, 0) AS conflicts, COALESCE(c.conflict_days, 0) AS conflict_days
FROM (SELECT * FROM leaves WHERE start_date BETWEEN {D(EVENTS_FROM + _dt.timedelta(days=20))} AND {D(EVENTS_TO)}) r
LEFT JOIN (SELECT person_id, absence_type, COUNT(*) AS previous_count, CAST(SUM(end_date - start_date + 1) AS BIGINT) AS days_taken, MAX(end_date) AS last_leave_date
           FROM leaves WHERE start_date < {D(EVENTS_FROM + _dt.timedelta(days=20))} GROUP BY person_id, absence_type) h
  ON h.person_id = r.person_id AND h.absence_type = r.absence_type
LEFT JOIN (SELECT r.absence_id, COUNT(*) AS conflicts,
                  CAST(SUM(LEAST(r.end_date, o.end_date) - GREATEST(r.start_date, o.start_date) + 1) AS BIGINT) AS conflict_days
           FROM leaves r JOIN leaves o ON o.person_id = r.person_id AND o.absence_id <> r.absence_id
            AND o.start_date <= r.end_date AND r.start_date <= o.end_date GROUP BY r.absence_id) c ON c.absence_id = r.absence_id""", "leaves")

REQUESTS_AFTER_DAYS = 20


@register("r_ab1_request_against_history", _REQUEST_SQL)
def request_against_history(t: Tables) -> DataFrame:
    """R-AB1: each leave request of the period beside the person's earlier
    leave of its type: number, days, last day and days since, and the other
    leaves that it overlaps, with the days in common.

    Stand-in: requests are the leaves that start ``REQUESTS_AFTER_DAYS`` into
    the event window or later.  Overlaps meet by equality on (person, day):
    each leave is its few days, a pair counts once a shared day."""
    lv = S.leaves(t)
    since = F.lit(t.params.events_from + _dt.timedelta(days=REQUESTS_AFTER_DAYS))
    req = lv.filter((F.col("start_date") >= since) & (F.col("start_date") <= F.lit(t.params.events_to)))
    length = (F.datediff("end_date", "start_date") + 1).cast("bigint")
    hist = lv.filter(F.col("start_date") < since).groupBy("person_id", "absence_type").agg(
        F.count(F.lit(1)).alias("previous_count"), F.sum(length).alias("days_taken"), F.max("end_date").alias("last_leave_date"))
    day = lambda df, name: E.explode_interval(df.select("person_id", F.col("absence_id").alias(name), "start_date", "end_date"),
                                              "start_date", "end_date", "day").select("person_id", name, "day")
    shared = day(req, "absence_id").join(day(lv, "other_id"), ["person_id", "day"]).where("absence_id <> other_id")
    conf = shared.groupBy("absence_id").agg(F.count_distinct("other_id").alias("conflicts"), F.count(F.lit(1)).alias("conflict_days"))
    j = req.join(hist, ["person_id", "absence_type"], "left").join(conf, "absence_id", "left")
    none = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return j.select("person_id", F.col("absence_id").alias("request_id"), "start_date", "end_date", length.alias("days_requested"),
                    F.when(F.col("previous_count") > 0, "Full Leave History").otherwise("New Leave Request").alias("history_class"),
                    none("previous_count"), none("days_taken"), "last_leave_date",
                    F.datediff("start_date", "last_leave_date").cast("bigint").alias("days_since_last"), none("conflicts"), none("conflict_days"))


_PEND_FROM = _dt.date(2024, 1, 21)


@register("r_ab8_projected_balance", S.with_sql(f"""
SELECT b.person_id, b.balance, COALESCE(p.pending_days, 0) AS pending_days,
       CAST(b.balance - COALESCE(p.pending_days, 0) AS DECIMAL(38,2)) AS projected_balance
FROM (SELECT person_id,
             CAST({" + ".join(f"{'' if s > 0 else '-'}SUM(CASE WHEN entry_type = '{c}' THEN entry_value ELSE 0 END)" for c, _, s in BALANCE_COMPONENTS)} AS DECIMAL(38,2)) AS balance
      FROM accrual_entries WHERE processed_date < {D(_PEND_FROM)} GROUP BY person_id) b
LEFT JOIN (SELECT person_id, CAST(SUM(end_date - start_date + 1) AS BIGINT) AS pending_days FROM leaves
           WHERE start_date >= {D(_PEND_FROM)} GROUP BY person_id) p ON p.person_id = b.person_id""",
                                                  "accrual_entries", "leaves"))
def projected_balance(t: Tables) -> DataFrame:
    """R-AB8: balance before a date minus the days of leave pending after it."""
    e = S.accrual_entries(t).filter(F.col("processed_date") < F.lit(_PEND_FROM))
    b = e.groupBy("person_id").agg(_components()[-1])
    pend = (S.leaves(t).filter(F.col("start_date") >= F.lit(_PEND_FROM)).groupBy("person_id")
            .agg(F.sum(F.datediff("end_date", "start_date") + 1).alias("pending_days")))
    j = b.join(pend, "person_id", "left")
    pd_ = F.coalesce("pending_days", F.lit(0))
    return j.select("person_id", "balance", pd_.alias("pending_days"), (F.col("balance") - pd_).cast(TOTAL).alias("projected_balance"))


_FUNNEL = {"applied": "applied", "offered": "offered", "accepted": "accepted", "hired": "hired"}


@register("r_rc6_source_funnel", S.with_sql(f"""
SELECT source, COUNT(DISTINCT CASE WHEN applied = 1 THEN submission_id END) AS applied,
       COUNT(DISTINCT CASE WHEN offered = 1 THEN submission_id END) AS offered,
       COUNT(DISTINCT CASE WHEN accepted = 1 THEN submission_id END) AS accepted,
       COUNT(DISTINCT CASE WHEN hired = 1 THEN submission_id END) AS hired,
       {sql_percent('COUNT(DISTINCT CASE WHEN hired = 1 THEN submission_id END)', 'COUNT(DISTINCT CASE WHEN applied = 1 THEN submission_id END)')} AS hire_rate_pct
FROM submissions GROUP BY source""", "submissions"))
def source_funnel(t: Tables) -> DataFrame:
    """R-RC6/A5: recruiting funnel per source -- conditional distinct counts
    of submissions per stage and the hire rate (exact, zero-guarded)."""
    s = S.submissions(t)
    f = A.funnel(s, ["source"], "submission_id", {k: F.col(v) == 1 for k, v in _FUNNEL.items()})
    return f.withColumn("hire_rate_pct", percent("hired", "applied"))


@register("r_rc8_hiring_dashboard", S.with_sql("""
SELECT submission_date AS requisition_date, COUNT(*) AS submissions, CAST(SUM(applied) AS BIGINT) AS applied, CAST(SUM(offered) AS BIGINT) AS offered,
       CAST(SUM(accepted) AS BIGINT) AS accepted, CAST(SUM(hired) AS BIGINT) AS hired
FROM submissions GROUP BY submission_date""", "submissions"))
def hiring_dashboard(t: Tables) -> DataFrame:
    """R-RC8: five counts per requisition (day) in one aggregation, not five
    scalar subqueries."""
    s = S.submissions(t)
    return s.groupBy(F.col("submission_date").alias("requisition_date")).agg(
        F.count(F.lit(1)).alias("submissions"), F.sum("applied").alias("applied"), F.sum("offered").alias("offered"),
        F.sum("accepted").alias("accepted"), F.sum("hired").alias("hired"))


@register("r_rc15_multiple_applications", S.with_sql("""
SELECT person_id, COUNT(*) AS active_applications,
       string_agg(CAST(submission_id AS VARCHAR), ', ' ORDER BY submission_date, submission_id) AS application_ids
FROM submissions WHERE applied = 1 GROUP BY person_id HAVING COUNT(*) > 1""", "submissions"))
def multiple_applications(t: Tables) -> DataFrame:
    """R-RC15: candidates with many active applications (A4) and their list."""
    s = S.submissions(t).filter(F.col("applied") == 1).withColumn("sid", F.col("submission_id").cast("string"))
    cnt = A.having(s.groupBy("person_id").agg(F.count(F.lit(1)).alias("active_applications")),
                   F.col("active_applications") > 1)
    lst = A.ordered_list(s, ["person_id"], "sid", ["submission_date", "submission_id"], ", ", "application_ids")
    return cnt.join(lst, "person_id")


@register("r_rc12_time_to_hire", S.with_sql("""
SELECT a.person_id, a.first_applied, h.first_hired, h.first_hired - a.first_applied AS days_to_hire,
       CASE WHEN h.first_hired - a.first_applied <= 30 THEN 'Fast' WHEN h.first_hired - a.first_applied <= 60 THEN 'Normal'
            ELSE 'Slow' END AS rating
FROM (SELECT person_id, MIN(submission_date) AS first_applied FROM submissions WHERE applied = 1 GROUP BY person_id) a
JOIN (SELECT person_id, MIN(submission_date) AS first_hired FROM submissions WHERE hired = 1 GROUP BY person_id) h
  ON h.person_id = a.person_id""", "submissions"))
def time_to_hire(t: Tables) -> DataFrame:
    """R-RC12: days from first application to first hire, with a rating band."""
    s = S.submissions(t)
    a = s.filter(F.col("applied") == 1).groupBy("person_id").agg(F.min("submission_date").alias("first_applied"))
    h = s.filter(F.col("hired") == 1).groupBy("person_id").agg(F.min("submission_date").alias("first_hired"))
    j = a.join(h, "person_id")
    d = F.datediff("first_hired", "first_applied").cast("bigint")
    rating = F.when(d <= 30, "Fast").when(d <= 60, "Normal").otherwise("Slow")
    return j.select("person_id", "first_applied", "first_hired", d.alias("days_to_hire"), rating.alias("rating"))


@register("r_rc11_stage_alerts", S.with_sql("""
SELECT person_id, submission_id, current_status, days_since_submission, days_to_start, alert_message,
       CASE WHEN days_to_start < 7 AND current_status = 'Accepted' THEN 'HIGH'
            WHEN days_to_start < 14 AND current_status = 'Accepted' THEN 'MEDIUM'
            WHEN days_since_submission > 30 THEN 'HIGH'
            WHEN days_since_submission > 14 THEN 'MEDIUM' ELSE 'LOW' END AS alert_priority
FROM (SELECT *, CASE WHEN current_status IN ('To be Reviewed', 'Shared with Hiring Manager') AND days_since_submission > 7
                     THEN 'Alert: Pending review > 7 days'
                     WHEN current_status = 'Approved' AND days_since_submission > 3
                     THEN 'Alert: Approved offer not extended > 3 days'
                     WHEN current_status = 'Extended' AND days_since_submission > 14
                     THEN 'Alert: Offer extended > 14 days, not accepted'
                     WHEN current_status = 'Accepted' AND days_to_start < 14
                     THEN 'Alert: Pre-employment activities must complete in < 14 days'
                     ELSE 'No Alert' END AS alert_message
      FROM (SELECT person_id, submission_id, /*events_to*/DATE '2024-01-30' - submission_date AS days_since_submission,
                   CASE WHEN accepted = 1 OR offered = 1 THEN (submission_date + 30) - /*events_to*/DATE '2024-01-30' END AS days_to_start,
                   CASE WHEN accepted = 1 THEN 'Accepted' WHEN offered = 1 AND person_id % 2 = 0 THEN 'Extended'
                        WHEN offered = 1 THEN 'Approved' WHEN submission_id % 2 = 0 THEN 'To be Reviewed'
                        ELSE 'Shared with Hiring Manager' END AS current_status
            FROM submissions WHERE hired = 0 AND (applied = 1 OR offered = 1 OR accepted = 1)) s) a
WHERE alert_message <> 'No Alert'""", "submissions"))
def stage_alerts(t: Tables) -> DataFrame:
    """R-RC11: active submissions with an alert, by status, days since the
    submission and days to the projected start, and the alert's priority
    (X5; both are worked out before the bands, §8 #21).

    Stand-ins: a submission is active unless hired or withdrawn; an offer is
    extended for even persons, else approved only; its projected start is 30
    days after the submission."""
    s = S.submissions(t).filter("hired = 0 and (applied = 1 or offered = 1 or accepted = 1)")
    offer = (F.col("accepted") == 1) | (F.col("offered") == 1)
    status = (F.when(F.col("accepted") == 1, "Accepted")
               .when((F.col("offered") == 1) & (F.col("person_id") % 2 == 0), "Extended").when(F.col("offered") == 1, "Approved")
               .when(F.col("submission_id") % 2 == 0, "To be Reviewed").otherwise("Shared with Hiring Manager"))
    s = s.select("person_id", "submission_id", status.alias("current_status"),
                 F.datediff(F.lit(t.params.events_to), "submission_date").cast("bigint").alias("days_since_submission"),
                 F.when(offer, F.datediff(F.date_add("submission_date", 30), F.lit(t.params.events_to)).cast("bigint")).alias("days_to_start"))
    return stage_alert_columns(s).filter(F.col("alert_message") != "No Alert")


def stage_alert_columns(s: DataFrame) -> DataFrame:
    """``s`` with alert_message and alert_priority from current_status,
    days_since_submission and days_to_start (null without an offer)."""
    st, since, to = F.col("current_status"), F.col("days_since_submission"), F.col("days_to_start")
    message = (F.when(st.isin("To be Reviewed", "Shared with Hiring Manager") & (since > 7), "Alert: Pending review > 7 days")
                .when((st == "Approved") & (since > 3), "Alert: Approved offer not extended > 3 days")
                .when((st == "Extended") & (since > 14), "Alert: Offer extended > 14 days, not accepted")
                .when((st == "Accepted") & (to < 14), "Alert: Pre-employment activities must complete in < 14 days")
                .otherwise("No Alert"))
    accepted = st == "Accepted"
    priority = (F.when(accepted & (to < 7), "HIGH").when(accepted & (to < 14), "MEDIUM")
                 .when(since > 30, "HIGH").when(since > 14, "MEDIUM").otherwise("LOW"))
    return s.withColumn("alert_message", message).withColumn("alert_priority", priority)


@register("r_rc18_internal_candidate_flag", S.with_sql("""
SELECT s.person_id, COUNT(*) AS submissions,
       CASE WHEN EXISTS (SELECT 1 FROM time_records r WHERE r.resource_id = s.person_id) THEN 'INTERNAL' ELSE 'EXTERNAL' END AS candidate_type
FROM submissions s GROUP BY s.person_id""", "submissions", "time_records"))
def internal_candidate_flag(t: Tables) -> DataFrame:
    """R-RC18: internal/external flag -- EXISTS turned into a flag column
    (left join on the distinct keys)."""
    s = S.submissions(t).groupBy("person_id").agg(F.count(F.lit(1)).alias("submissions"))
    emp = S.time_records(t).select(F.col("resource_id").alias("person_id")).distinct().withColumn("emp", F.lit(1))
    j = s.join(emp, "person_id", "left")
    return j.select("person_id", "submissions",
                    F.when(F.col("emp").isNotNull(), "INTERNAL").otherwise("EXTERNAL").alias("candidate_type"))


# Weekly hours per schedule and the full-time threshold.
SCHEDULE_HOURS = [("STD", 40), ("SHIFT", 48)]
FULL_TIME_HOURS = 40


@register("r_hr3_fte_by_schedule", S.with_sql(f"""
SELECT ps.schedule_id, CASE WHEN h.hours >= {FULL_TIME_HOURS} THEN 'FULL_TIME' ELSE 'PART_TIME' END AS time_class,
       COUNT(*) AS headcount,
       CAST(SUM(CAST(h.hours AS DECIMAL(18,2))) / {FULL_TIME_HOURS} AS DECIMAL(18,2)) AS fte
FROM person_schedules ps JOIN (VALUES {", ".join(f"('{s}', {h})" for s, h in SCHEDULE_HOURS)}) h(schedule_id, hours)
  ON h.schedule_id = ps.schedule_id
GROUP BY 1, 2""", "person_schedules"))
def fte_by_schedule(t: Tables) -> DataFrame:
    """R-HR3: full/part-time class from scheduled hours and FTE per schedule."""
    from tallyspark.sources import constants as K
    h = K.frame(t.spark, SCHEDULE_HOURS, "schedule_id string, hours int")
    j = S.person_schedules(t).join(h, "schedule_id")
    cls = F.when(F.col("hours") >= FULL_TIME_HOURS, "FULL_TIME").otherwise("PART_TIME")
    return j.groupBy("schedule_id", cls.alias("time_class")).agg(
        F.count(F.lit(1)).alias("headcount"),
        (F.sum(F.col("hours").cast("decimal(18,2)")) / FULL_TIME_HOURS).cast("decimal(18,2)").alias("fte"))


_AB2_DATE = _dt.date(2024, 1, 15)


@register("r_ab2_current_absences", S.with_sql(f"""
SELECT l.absence_id, l.person_id, l.start_date, l.end_date,
       CAST(COALESCE(b.balance, 0) AS DECIMAL(38,2)) AS balance_at_date
FROM leaves l LEFT JOIN (SELECT person_id,
       SUM(CASE WHEN entry_type IN ('COVR', 'ACRL', 'ADJOTH') THEN entry_value WHEN entry_type IN ('CSH', 'ABS') THEN -entry_value ELSE 0 END) AS balance
       FROM accrual_entries WHERE processed_date <= {D(_AB2_DATE)} GROUP BY person_id) b ON b.person_id = l.person_id
WHERE {D(_AB2_DATE)} BETWEEN l.start_date AND l.end_date""", "leaves", "accrual_entries"))
def current_absences(t: Tables) -> DataFrame:
    """R-AB2: absences in progress at the date (J7 on the leave interval)
    with the person's leave balance at that date."""
    lv = E.as_of(S.leaves(t), _AB2_DATE, "start_date", "end_date").select("absence_id", "person_id", "start_date", "end_date")
    e = S.accrual_entries(t).filter(F.col("processed_date") <= F.lit(_AB2_DATE))
    sign = (F.when(F.col("entry_type").isin("COVR", "ACRL", "ADJOTH"), F.col("entry_value"))
            .when(F.col("entry_type").isin("CSH", "ABS"), -F.col("entry_value")).otherwise(0))
    b = e.groupBy("person_id").agg(F.sum(sign).alias("balance"))
    j = lv.join(b, "person_id", "left")
    return j.select("absence_id", "person_id", "start_date", "end_date",
                    F.coalesce("balance", F.lit(0)).cast(TOTAL).alias("balance_at_date"))


@register("r_rc9_offer_package", S.with_sql(f"""
SELECT c.customer_id AS person_id, v.salary,
       CAST(MAX(CASE WHEN r.kind = 'ADULT' THEN r.rate END) + 2 * MAX(CASE WHEN r.kind = 'CHILD' THEN r.rate END)
            + MAX(CASE WHEN r.kind = 'INFANT' THEN r.rate END) AS DECIMAL(18,2)) AS fares,
       CAST(v.salary + MAX(CASE WHEN r.kind = 'ADULT' THEN r.rate END) + 2 * MAX(CASE WHEN r.kind = 'CHILD' THEN r.rate END)
            + MAX(CASE WHEN r.kind = 'INFANT' THEN r.rate END) AS DECIMAL(18,2)) AS package_total
FROM customers c
JOIN person_versions v ON v.person_id = c.customer_id AND {D(AS_OF)} BETWEEN v.eff_start AND v.eff_end
JOIN rate_card r ON r.region_id = c.ledger_id AND r.segment = c.segment AND {D(AS_OF)} BETWEEN r.valid_from AND r.valid_to
GROUP BY c.customer_id, v.salary""", "customers", "person_versions", "rate_card"))
def offer_package(t: Tables) -> DataFrame:
    """R-RC9: salary at the date plus fares for one adult, two children and
    one infant from the rate card (S7 + J20 pivot + A2)."""
    from tallyspark.plans.generic import rate_card_lookup
    rates = rate_card_lookup(t).withColumnRenamed("customer_id", "person_id")
    sal = E.as_of(S.person_versions(t), t.params.as_of).select("person_id", "salary")
    j = sal.join(rates, "person_id")
    fares = F.col("adult_rate") + 2 * F.col("child_rate") + F.col("infant_rate")
    return j.select("person_id", "salary", fares.cast("decimal(18,2)").alias("fares"),
                    (F.col("salary") + fares).cast("decimal(18,2)").alias("package_total"))


@register("r_rc17_internal_move_class", S.with_sql("""
SELECT person_id, eff_start, previous_grade, grade_id,
       CASE WHEN grade_id < previous_grade THEN 'PROMOTION' WHEN grade_id > previous_grade THEN 'DEMOTION'
            ELSE 'LATERAL' END AS move_class
FROM (SELECT person_id, eff_start, grade_id, LAG(grade_id) OVER (PARTITION BY person_id ORDER BY eff_start) AS previous_grade
      FROM person_versions) x WHERE previous_grade IS NOT NULL""", "person_versions"))
def internal_move_class(t: Tables) -> DataFrame:
    """R-RC17: promotion / demotion / lateral move from the grade change
    between consecutive versions (grade 1 is the highest)."""
    from tallyspark.operators import windows as W
    pv = S.person_versions(t).select("person_id", "eff_start", "grade_id")
    h = W.lag_change(pv, ["person_id"], ["eff_start"], "grade_id", "previous_grade", "grade_change")
    h = h.filter(F.col("previous_grade").isNotNull())
    cls = (F.when(F.col("grade_id") < F.col("previous_grade"), "PROMOTION")
           .when(F.col("grade_id") > F.col("previous_grade"), "DEMOTION").otherwise("LATERAL"))
    return h.select("person_id", "eff_start", "previous_grade", "grade_id", cls.alias("move_class"))


@register("r_ab4_leave_detail", S.with_sql("""
SELECT l.absence_id, l.person_id, c.c_name AS person_name, l.absence_type, l.start_date, l.end_date,
       l.end_date - l.start_date + 1 AS leave_days, l.approval_status, ps.schedule_id,
       ll.line_mgr AS supervisor_id, sc.c_name AS supervisor_name
FROM leaves l JOIN customer c ON c.c_custkey = l.person_id
JOIN person_schedules ps ON ps.person_id = l.person_id
JOIN (SELECT schedule_id, MIN(person_id) AS line_mgr FROM person_schedules GROUP BY schedule_id) ll
  ON ll.schedule_id = ps.schedule_id AND ll.line_mgr <> l.person_id
LEFT JOIN customer sc ON sc.c_custkey = ll.line_mgr""", "leaves", "person_schedules"))
def leave_detail(t: Tables) -> DataFrame:
    """R-AB4: leave detail with workflow status, schedule and supervisor
    (line manager of the schedule group) stitched from masters (J21)."""
    ps = S.person_schedules(t).select("person_id", "schedule_id")
    lead = ps.groupBy("schedule_id").agg(F.min("person_id").alias("supervisor_id"))
    names = t.customer.select(F.col("c_custkey").alias("person_id"), F.col("c_name").alias("person_name"))
    sup = t.customer.select(F.col("c_custkey").alias("supervisor_id"), F.col("c_name").alias("supervisor_name"))
    j = S.leaves(t).join(names, "person_id").join(ps, "person_id").join(lead, "schedule_id")
    j = j.filter(F.col("supervisor_id") != F.col("person_id")).join(sup, "supervisor_id", "left")
    return j.select("absence_id", "person_id", "person_name", "absence_type", "start_date", "end_date",
                    (F.datediff("end_date", "start_date") + 1).cast("bigint").alias("leave_days"), "approval_status", "schedule_id",
                    "supervisor_id", "supervisor_name")


def approvals(t: Tables) -> DataFrame:
    """Approval actions keyed by a text transaction key (as in the source):
    one per leave whose event value is above 5; REJECTED above 250."""
    e = t.events.filter((F.col("event_type") == "signup") & (F.col("value") > 5))
    return e.select(F.col("event_id").cast("string").alias("transaction_key"),
                    F.when(F.col("value") > 250, "REJECTED").otherwise("APPROVED").alias("outcome"),
                    F.concat(F.lit("APPROVER-"), (F.col("user_id") % 7).cast("string")).alias("approver"))


S._cte("approvals", (), """
SELECT CAST(event_id AS VARCHAR) AS transaction_key, CASE WHEN value > 250 THEN 'REJECTED' ELSE 'APPROVED' END AS outcome,
       'APPROVER-' || CAST(user_id % 7 AS VARCHAR) AS approver
FROM events WHERE event_type = 'signup' AND value > 5""")


@register("r_ab9_approval_outcome", S.with_sql("""
SELECT l.absence_id, l.person_id, COALESCE(a.outcome, 'PENDING') AS outcome, a.approver
FROM leaves l LEFT JOIN approvals a ON a.transaction_key = CAST(l.absence_id AS VARCHAR)""", "leaves", "approvals"))
def approval_outcome(t: Tables) -> DataFrame:
    """R-AB9: approval outcome and approver per absence, joined on the text
    key (the numeric id cast to text once, on the smaller side's key)."""
    lv = S.leaves(t).select("absence_id", "person_id", F.col("absence_id").cast("string").alias("transaction_key"))
    j = lv.join(approvals(t), "transaction_key", "left")
    return j.select("absence_id", "person_id", F.coalesce("outcome", F.lit("PENDING")).alias("outcome"), "approver")


@register("r_ab10_advance_recovery", S.with_sql("""
SELECT l.absence_id, l.person_id, l.start_date, CAST(COALESCE(d.recovered, 0) AS DECIMAL(38,2)) AS advance_recovered
FROM leaves l LEFT JOIN (SELECT person_id, date_trunc('month', effective_date) AS m,
                                SUM(TRY_CAST(result_value AS DECIMAL(18,2))) AS recovered
                         FROM run_results WHERE element = 'Deduction' GROUP BY 1, 2) d
  ON d.person_id = l.person_id AND d.m = date_trunc('month', l.start_date)""", "leaves", "run_results"))
def advance_recovery(t: Tables) -> DataFrame:
    """R-AB10: salary advance recovered in the month of each absence
    (deductions pre-aggregated per person and month, J2)."""
    d = (S.run_results(t).filter(F.col("element") == "Deduction")
         .groupBy("person_id", F.trunc("effective_date", "month").alias("m"))
         .agg(F.sum(F.col("result_value").try_cast("decimal(18,2)")).alias("recovered")))
    lv = S.leaves(t).select("absence_id", "person_id", "start_date", F.trunc("start_date", "month").alias("m"))
    j = lv.join(d, ["person_id", "m"], "left")
    return j.select("absence_id", "person_id", "start_date",
                    F.coalesce("recovered", F.lit(0)).cast(TOTAL).alias("advance_recovered"))


@register("r_hr5_pending_approvers", S.with_sql("""
SELECT i.order_id, i.vendor_id, COUNT(DISTINCT a.part_id) AS approvers,
       string_agg(DISTINCT 'APPROVER-' || CAST(a.part_id AS VARCHAR), ', ' ORDER BY 'APPROVER-' || CAST(a.part_id AS VARCHAR)) AS approver_list
FROM ap_invoices i JOIN applications a ON a.applied_trx_id = i.order_id AND a.supplier_id = i.vendor_id
WHERE i.approval_status = 'PENDING' GROUP BY i.order_id, i.vendor_id""", "ap_invoices", "applications"))
def pending_approvers(t: Tables) -> DataFrame:
    """R-HR5: pending approvers of each unapproved invoice as an ordered list."""
    from tallyspark.plans.payables import ap_invoices
    inv = ap_invoices(t).filter(F.col("approval_status") == "PENDING").select("order_id", "vendor_id")
    a = S.applications(t).select(F.col("applied_trx_id").alias("order_id"), F.col("supplier_id").alias("vendor_id"),
                                 F.concat(F.lit("APPROVER-"), F.col("part_id").cast("string")).alias("approver"))
    j = inv.join(a, ["order_id", "vendor_id"]).select("order_id", "vendor_id", "approver").distinct()
    lst = A.ordered_list(j, ["order_id", "vendor_id"], "approver", ["approver"], ", ", "approver_list")
    cnt = j.groupBy("order_id", "vendor_id").agg(F.count(F.lit(1)).alias("approvers"))
    return cnt.join(lst, ["order_id", "vendor_id"])


@register("r_hr6_attribute_discovery", S.with_sql(" UNION ALL ".join(
    f"SELECT '{phys}' AS physical_column, '{biz}' AS business_name, COUNT({phys}) AS populated_rows, "
    f"COUNT(DISTINCT CAST({phys} AS VARCHAR)) AS distinct_values FROM customers"
    for phys, biz in ATTRIBUTE_MAP.items()),
    "customers"))
def attribute_discovery(t: Tables) -> DataFrame:
    """R-HR6 (feeds S11): which generic attribute columns hold data and
    under which business name -- the columns are unpivoted to rows and
    counted, then named from the metadata map."""
    from tallyspark.sources import constants as K
    c = S.customers(t).select("customer_id", *[F.col(p).cast("string").alias(p) for p in ATTRIBUTE_MAP])
    long = c.unpivot(["customer_id"], list(ATTRIBUTE_MAP), "physical_column", "value")
    g = long.groupBy("physical_column").agg(F.count("value").alias("populated_rows"),
                                            F.count_distinct("value").alias("distinct_values"))
    meta = K.frame(t.spark, list(ATTRIBUTE_MAP.items()), "physical_column string, business_name string")
    return g.join(meta, "physical_column")


@register("r_ab3_leave_record", S.with_sql("""
SELECT l.absence_id, l.person_id, c.c_name AS person_name, l.absence_type, l.start_date, l.end_date,
       l.end_date - l.start_date + 1 AS leave_days, COALESCE(a.outcome, 'PENDING') AS approval_outcome, a.approver,
       ps.schedule_id, CAST(COALESCE(b.balance, 0) AS DECIMAL(38,2)) AS balance_before_leave
FROM leaves l JOIN customer c ON c.c_custkey = l.person_id
JOIN person_schedules ps ON ps.person_id = l.person_id
LEFT JOIN approvals a ON a.transaction_key = CAST(l.absence_id AS VARCHAR)
LEFT JOIN (SELECT l2.absence_id,
                  SUM(CASE WHEN e.entry_type IN ('COVR', 'ACRL', 'ADJOTH') THEN e.entry_value
                           WHEN e.entry_type IN ('CSH', 'ABS') THEN -e.entry_value ELSE 0 END) AS balance
           FROM leaves l2 JOIN accrual_entries e ON e.person_id = l2.person_id AND e.processed_date < l2.start_date
           GROUP BY l2.absence_id) b ON b.absence_id = l.absence_id""",
                                           "leaves", "person_schedules", "approvals", "accrual_entries"))
def leave_record(t: Tables) -> DataFrame:
    """R-AB3: the single-leave record layout (person, dates, days, approval
    outcome and approver, schedule, balance before the leave) produced for
    every leave -- the print form picks one row of it.

    The balance before each leave is an as-of lookup done without pairing
    leaves with entries: leave markers (value 0, ordered before the entries
    of the same day) are merged into the entry stream and a skew-safe
    running total (chunk = day) is read at each marker -- the sum of the
    person's entries strictly before the leave starts."""
    from tallyspark.operators import windows as W
    lv = S.leaves(t)
    e = S.accrual_entries(t)
    sign = (F.when(F.col("entry_type").isin("COVR", "ACRL", "ADJOTH"), F.col("entry_value"))
            .when(F.col("entry_type").isin("CSH", "ABS"), -F.col("entry_value")).otherwise(0))
    entries = e.select("person_id", F.col("processed_date").alias("d"), F.lit(1).alias("ord"),
                       F.col("entry_id").alias("seq"), sign.alias("v"), F.lit(None).cast("bigint").alias("absence_id"))
    markers = lv.select("person_id", F.col("start_date").alias("d"), F.lit(0).alias("ord"),
                        F.col("absence_id").alias("seq"), F.lit(0).cast("decimal(18,2)").alias("v"), "absence_id")
    run = W.running_total(entries.unionByName(markers), ["person_id"], ["d", "ord", "seq"], "v", "balance", chunk="d")
    bal = run.filter(F.col("ord") == 0).select("absence_id", "balance")
    names = t.customer.select(F.col("c_custkey").alias("person_id"), F.col("c_name").alias("person_name"))
    ps = S.person_schedules(t).select("person_id", "schedule_id")
    ap = approvals(t)
    j = (lv.join(names, "person_id").join(ps, "person_id")
           .withColumn("transaction_key", F.col("absence_id").cast("string")).join(ap, "transaction_key", "left")
           .join(bal, "absence_id", "left"))
    return j.select("absence_id", "person_id", "person_name", "absence_type", "start_date", "end_date",
                    (F.datediff("end_date", "start_date") + 1).cast("bigint").alias("leave_days"),
                    F.coalesce("outcome", F.lit("PENDING")).alias("approval_outcome"), "approver", "schedule_id",
                    F.coalesce("balance", F.lit(0)).cast(TOTAL).alias("balance_before_leave"))
