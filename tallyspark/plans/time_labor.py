"""Time and attendance (R-TL*).

People x days is the one expansion step: it is generated per person from
the bounded parameter window (``schedule_days``), and every "minus" step
(reported days, holidays, leave) is an equi anti-join on (person, day), so
the three exclusions share the same hash partitioning.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.params import AS_OF, EVENTS_FROM, EVENTS_TO
from tallyspark.functions.scalars import (
    div_round, percent, service_years, sql_div_round, sql_percent, sql_service_years,
)
from tallyspark.operators import effective as E
from tallyspark.plans.registry import register
from tallyspark.sources import constants as K
from tallyspark.sources import standins as S
from tallyspark.sources.tables import Tables

D = S._d
FULL_DAY_MIN = 480


def punch_days(t: Tables) -> DataFrame:
    """Per person and day: punches, first and last punch, worked minutes."""
    tr = S.time_records(t)
    mod = F.hour("start_time") * 60 + F.minute("start_time")
    return tr.groupBy(F.col("resource_id").alias("person_id"), "work_date").agg(
        F.count(F.lit(1)).alias("punches"), F.min("start_time").alias("first_in"), F.max("start_time").alias("last_out"),
        (F.max(mod) - F.min(mod)).cast("bigint").alias("worked_minutes"), F.sum("measure").alias("measure"))


S._cte("punch_days", ("time_records",), """
SELECT resource_id AS person_id, work_date, COUNT(*) AS punches, MIN(start_time) AS first_in, MAX(start_time) AS last_out,
       MAX(hour(start_time) * 60 + minute(start_time)) - MIN(hour(start_time) * 60 + minute(start_time)) AS worked_minutes,
       SUM(measure) AS measure
FROM time_records GROUP BY resource_id, work_date""")


def missing_days(t: Tables, as_of: _dt.date | None = None) -> DataFrame:
    as_of = as_of or t.params.events_to
    days = S.schedule_days(t).filter(F.col("work_date") <= F.lit(as_of))
    reported = S.time_records(t).select(F.col("resource_id").alias("person_id"), "work_date").distinct()
    hol = S.person_holidays(t).select("person_id", F.col("holiday_date").alias("work_date"))
    out = days.join(reported, ["person_id", "work_date"], "left_anti").join(hol, ["person_id", "work_date"], "left_anti")
    return E.anti_interval(out, S.leaves(t), "person_id", "work_date", "start_date", "end_date")


_TL1_SQL = S.with_sql(f"""
SELECT d.person_id, d.schedule_id, d.work_date, d.weekday FROM schedule_days d
WHERE d.work_date <= {D(EVENTS_TO)}
  AND NOT EXISTS (SELECT 1 FROM time_records r WHERE r.resource_id = d.person_id AND r.work_date = d.work_date)
  AND NOT EXISTS (SELECT 1 FROM person_holidays h WHERE h.person_id = d.person_id AND h.holiday_date = d.work_date)
  AND NOT EXISTS (SELECT 1 FROM leaves l WHERE l.person_id = d.person_id AND d.work_date BETWEEN l.start_date AND l.end_date)""",
                      "schedule_days", "time_records", "person_holidays", "leaves")


@register("r_tl1_missing_timecard_days", _TL1_SQL)
def missing_timecard_days(t: Tables) -> DataFrame:
    """R-TL1: scheduled working days (override schedule, S6) without a time
    record, a holiday or a leave day, up to the date."""
    return missing_days(t).select("person_id", "schedule_id", "work_date", "weekday")


_TL3_SQL = S.with_sql(f"""
SELECT p.person_id FROM people p
WHERE NOT EXISTS (SELECT 1 FROM time_records r WHERE r.resource_id = p.person_id
                  AND r.work_date BETWEEN {D(EVENTS_FROM)} AND {D(EVENTS_TO)})""", "people", "time_records")


@register("r_tl3_no_timesheet_in_period", _TL3_SQL)
@register("r_tl3_no_timesheet", _TL3_SQL)
def no_timesheet(t: Tables, date_from: _dt.date | None = None, date_to: _dt.date | None = None) -> DataFrame:
    """R-TL3: employees without any time record in the period."""
    date_from = date_from or t.params.events_from
    date_to = date_to or t.params.events_to
    r = S.time_records(t).filter(F.col("work_date").between(F.lit(date_from), F.lit(date_to))) \
        .select(F.col("resource_id").alias("person_id"))
    return S.people(t).join(r, "person_id", "left_anti")


@register("r_tl4_hours_by_week", S.with_sql("""
SELECT resource_id AS person_id, CAST(date_trunc('week', work_date) AS DATE) AS week_start,
       CAST(SUM(measure) AS DECIMAL(38,2)) AS hours, COUNT(*) AS entries
FROM time_records GROUP BY 1, 2""", "time_records"))
def hours_by_week(t: Tables) -> DataFrame:
    """R-TL4: reported hours per person and week."""
    tr = S.time_records(t)
    return tr.groupBy(F.col("resource_id").alias("person_id"), F.trunc("work_date", "week").alias("week_start")).agg(
        F.sum("measure").cast("decimal(38,2)").alias("hours"), F.count(F.lit(1)).alias("entries"))


@register("r_tl4_hours_by_project", S.with_sql(f"""
SELECT resource_id AS person_id, 'PRJ-' || CAST(record_id % 40 AS VARCHAR) AS project_number, CAST(record_id % 7 + 1 AS BIGINT) AS task_number,
       CASE record_id % 3 WHEN 0 THEN 'Regular' WHEN 1 THEN 'Overtime' ELSE 'Travel' END AS expenditure_type,
       CAST(SUM(measure) AS DECIMAL(38,2)) AS total_hours, COUNT(*) AS entries
FROM time_records WHERE work_date BETWEEN {D(EVENTS_FROM)} AND {D(EVENTS_TO)} AND record_id % 4 <> 3 GROUP BY 1, 2, 3, 4""", "time_records"))
def hours_by_project(t: Tables) -> DataFrame:
    """R-TL4: hours of the period per person, project, task and expenditure
    type, of time cards approved or submitted.  Stand-ins: an entry's project,
    task, type and status go round by its id."""
    r = F.col("record_id")
    tr = S.time_records(t).filter(F.col("work_date").between(F.lit(t.params.events_from), F.lit(t.params.events_to)) & (r % 4 != 3))
    kind = F.when(r % 3 == 0, "Regular").when(r % 3 == 1, "Overtime").otherwise("Travel")
    return tr.groupBy(F.col("resource_id").alias("person_id"), F.concat(F.lit("PRJ-"), (r % 40).cast("string")).alias("project_number"),
                      (r % 7 + 1).alias("task_number"), kind.alias("expenditure_type")).agg(
        F.sum("measure").cast("decimal(38,2)").alias("total_hours"), F.count(F.lit(1)).alias("entries"))


_ATT_SQL = ("CASE WHEN p.punches IS NULL THEN 'ABSENT' WHEN p.punches = 1 THEN 'MISSING OUT' ELSE 'PRESENT' END")


@register("r_tl6_daily_attendance", S.with_sql(f"""
SELECT d.person_id, d.work_date, COALESCE(p.punches, 0) AS punches, p.first_in, p.last_out, {_ATT_SQL} AS attendance
FROM schedule_days d LEFT JOIN punch_days p ON p.person_id = d.person_id AND p.work_date = d.work_date""",
                                               "schedule_days", "punch_days"))
def daily_attendance(t: Tables) -> DataFrame:
    """R-TL6: daily attendance per scheduled day: present / missing out / absent."""
    d = S.schedule_days(t).select("person_id", "work_date")
    p = punch_days(t)
    j = d.join(p, ["person_id", "work_date"], "left")
    st = (F.when(F.col("punches").isNull(), "ABSENT").when(F.col("punches") == 1, "MISSING OUT").otherwise("PRESENT"))
    return j.select("person_id", "work_date", F.coalesce("punches", F.lit(0)).alias("punches"), "first_in", "last_out",
                    st.alias("attendance"))


_TL7_SQL = S.with_sql(f"""
SELECT d.person_id, COUNT(*) AS scheduled_days,
       CAST(SUM(CASE WHEN p.person_id IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS worked_days,
       {D(EVENTS_TO)} - {D(EVENTS_FROM)} + 1 - COUNT(*) AS week_off_days,
       CAST(SUM(CASE WHEN l.person_id IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS leave_days,
       CAST(SUM(CASE WHEN p.person_id IS NULL AND l.person_id IS NULL AND h.person_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS absent_days,
       {sql_percent('SUM(CASE WHEN p.person_id IS NOT NULL THEN 1 ELSE 0 END)', 'COUNT(*)')} AS attendance_pct
FROM schedule_days d
LEFT JOIN (SELECT DISTINCT person_id, work_date FROM punch_days) p ON p.person_id = d.person_id AND p.work_date = d.work_date
LEFT JOIN (SELECT DISTINCT person_id, CAST(unnest(generate_series(start_date::TIMESTAMP, end_date::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS work_date
           FROM leaves) l ON l.person_id = d.person_id AND l.work_date = d.work_date
LEFT JOIN person_holidays h ON h.person_id = d.person_id AND h.holiday_date = d.work_date
GROUP BY d.person_id""", "schedule_days", "punch_days", "leaves", "person_holidays")


@register("r_tl7_monthly_attendance", _TL7_SQL)
def monthly_attendance(t: Tables) -> DataFrame:
    """R-TL7: scheduled, worked, week-off, leave and absent days and the
    attendance percent (exact, zero-guarded); absent is 0, not NULL,
    without a schedule row (§8 #18)."""
    d = S.schedule_days(t).select("person_id", "work_date")
    worked = punch_days(t).select("person_id", "work_date").distinct().withColumn("w", F.lit(1))
    lv = E.explode_interval(S.leaves(t).select("person_id", "start_date", "end_date"), "start_date", "end_date", "work_date") \
        .select("person_id", "work_date").distinct().withColumn("l", F.lit(1))
    hol = S.person_holidays(t).select("person_id", F.col("holiday_date").alias("work_date")).withColumn("h", F.lit(1))
    j = d.join(worked, ["person_id", "work_date"], "left").join(lv, ["person_id", "work_date"], "left") \
        .join(hol, ["person_id", "work_date"], "left")
    g = j.groupBy("person_id").agg(
        F.count(F.lit(1)).alias("scheduled_days"),
        F.sum(F.when(F.col("w").isNotNull(), 1).otherwise(0)).alias("worked_days"),
        F.sum(F.when(F.col("l").isNotNull(), 1).otherwise(0)).alias("leave_days"),
        F.sum(F.when(F.col("w").isNull() & F.col("l").isNull() & F.col("h").isNull(), 1).otherwise(0)).alias("absent_days"))
    days_in_window = (t.params.events_to - t.params.events_from).days + 1
    return g.select("person_id", "scheduled_days", "worked_days",
                    (F.lit(days_in_window) - F.col("scheduled_days")).alias("week_off_days"), "leave_days", "absent_days",
                    percent("worked_days", "scheduled_days").alias("attendance_pct"))


_SHIFT_SQL = ("CASE WHEN hour(first_in) >= 20 OR hour(first_in) < 6 THEN 'NIGHT' "
              "WHEN hour(first_in) >= 14 THEN 'EVENING' ELSE 'DAY' END")


@register("r_tl8_shift_allowance", S.with_sql(f"""
SELECT person_id, work_date, {_SHIFT_SQL} AS shift_type, worked_minutes,
       CASE WHEN ({_SHIFT_SQL}) IN ('NIGHT', 'EVENING') AND worked_minutes >= {FULL_DAY_MIN} AND punches >= 2
            THEN 'Y' ELSE 'N' END AS allowance_eligible
FROM punch_days""", "punch_days"))
def shift_allowance(t: Tables) -> DataFrame:
    """R-TL8: shift type from the first punch and allowance eligibility
    (night/evening shift, full shift, both punches present)."""
    p = punch_days(t)
    h = F.hour("first_in")
    shift = F.when((h >= 20) | (h < 6), "NIGHT").when(h >= 14, "EVENING").otherwise("DAY")
    elig = F.when(shift.isin("NIGHT", "EVENING") & (F.col("worked_minutes") >= FULL_DAY_MIN) & (F.col("punches") >= 2),
                  "Y").otherwise("N")
    return p.select("person_id", "work_date", shift.alias("shift_type"), "worked_minutes", elig.alias("allowance_eligible"))


# Shifts by hours of their work date; hours from 24 on are the next day's.
ROSTER_SHIFTS = [(0, "DAY", 8.0, 8.0), (1, "AFTERNOON", 13.5, 8.0), (2, "NIGHT", 22.0, 8.0), (3, "SMALL HOURS", 25.0, 6.0)]
ROSTER_SCHEMA = "roster int, shift_name string, start_hour double, shift_hours double"
#: A punch so many hours outside a shift may still belong to it.
PUNCH_REACH = 4


def shift_windows(days: DataFrame) -> DataFrame:
    """(person_id, work_date, shift_name, shift_type, shift_hours, shift_start,
    shift_end) of rows with roster columns.  Fixed values: a shift that starts
    from 18 to 28 h or from 0 to 4 h is a night shift, from 13 to 17.5 h an
    evening shift."""
    h = F.col("start_hour")
    kind = F.when(h.between(18, 28) | h.between(0, 4), "night shift").when(h.between(13, 17.5), "Evening Shift").otherwise("Regular")
    at = lambda hours: (F.col("work_date").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), (hours * 60).cast("int")))
    return days.select("person_id", "work_date", "shift_name", kind.alias("shift_type"), "shift_hours",
                       at(h).alias("shift_start"), at(h + F.col("shift_hours")).alias("shift_end"))


def punches_by_shift(punches: DataFrame, windows: DataFrame) -> DataFrame:
    """(person_id, work_date, punch_in, punch_out, punches): each punch belongs
    to the nearest of its person's shifts, of those at most ``PUNCH_REACH``
    hours away the one that lies least far from it, the earlier on a tie.

    A shift ends on its own or the next day, so a punch meets by equality the
    shifts of three work dates: two, and the next for early arrivals."""
    day = F.to_date("punch")
    near = punches.withColumn("punch_id", F.struct("person_id", "punch", "record_id")).withColumn(
        "work_date", F.explode(F.array(F.date_sub(day, 1), day, F.date_add(day, 1))))
    seconds = lambda c: F.unix_timestamp(c)
    far = F.greatest(seconds("shift_start") - seconds("punch"), seconds("punch") - seconds("shift_end"), F.lit(0))
    met = near.join(windows.select("person_id", "work_date", "shift_start", "shift_end"), ["person_id", "work_date"])
    met = met.withColumn("far", far).where(F.col("far") <= PUNCH_REACH * 3600)
    own = met.groupBy("punch_id").agg(F.min(F.struct("far", "work_date")).alias("best"))
    own = own.select("punch_id.person_id", "best.work_date", "punch_id.punch")
    return own.groupBy("person_id", "work_date").agg(F.min("punch").alias("punch_in"), F.max("punch").alias("punch_out"), F.count(F.lit(1)).alias("punches"))


def _shift_windows_sql() -> str:
    rows = ", ".join(f"({r}, '{n}', {h}, {d})" for r, n, h, d in ROSTER_SHIFTS)
    return f"""
SELECT d.person_id, d.work_date, s.shift_name, s.shift_hours,
       CASE WHEN start_hour BETWEEN 18 AND 28 OR start_hour BETWEEN 0 AND 4 THEN 'night shift'
            WHEN start_hour BETWEEN 13 AND 17.5 THEN 'Evening Shift' ELSE 'Regular' END AS shift_type,
       CAST(d.work_date AS TIMESTAMP) + to_minutes(CAST(start_hour * 60 AS BIGINT)) AS shift_start,
       CAST(d.work_date AS TIMESTAMP) + to_minutes(CAST((start_hour + shift_hours) * 60 AS BIGINT)) AS shift_end
FROM schedule_days d JOIN (VALUES {rows}) s(roster, shift_name, start_hour, shift_hours)
  ON s.roster = (d.person_id + day(d.work_date)) % 4"""


@register("r_tl8_rostered_shift_allowance", S.with_sql(f"""
SELECT w.person_id, w.work_date, w.shift_name, w.shift_type, CAST(w.shift_hours AS DOUBLE) AS shift_hours, p.punches, p.punch_in, p.punch_out,
       CAST(epoch(p.punch_out) - epoch(p.punch_in) AS BIGINT) // 60 AS worked_minutes, CASE WHEN w.person_id % 3 = 0 THEN 'SUBMITTED' ELSE 'APPROVED' END AS status,
       CASE WHEN w.shift_hours * 60 <= CAST(epoch(p.punch_out) - epoch(p.punch_in) AS BIGINT) // 60 AND p.punch_in <= w.shift_start AND p.punch_out >= w.shift_end
             AND w.person_id % 3 <> 0 THEN 'Y' ELSE 'N' END AS allowance_eligible
FROM ({_shift_windows_sql()}) w
JOIN (SELECT person_id, work_date, MIN(punch) AS punch_in, MAX(punch) AS punch_out, COUNT(*) AS punches
      FROM (SELECT r.resource_id AS person_id, r.start_time AS punch, r.record_id, arg_min(w.work_date, (f.far, w.work_date)) AS work_date
            FROM time_records r JOIN ({_shift_windows_sql()}) w ON w.person_id = r.resource_id AND w.work_date BETWEEN r.work_date - 1 AND r.work_date + 1,
                 LATERAL (SELECT greatest(floor(epoch(w.shift_start)) - floor(epoch(r.start_time)), floor(epoch(r.start_time)) - floor(epoch(w.shift_end)), 0) AS far) f
            WHERE f.far <= {PUNCH_REACH} * 3600 GROUP BY r.resource_id, r.start_time, r.record_id) x
      GROUP BY person_id, work_date) p ON p.person_id = w.person_id AND p.work_date = w.work_date
WHERE w.shift_type IN ('night shift', 'Evening Shift')""", "schedule_days", "time_records"))
def rostered_shift_allowance(t: Tables) -> DataFrame:
    """R-TL8 on the roster's shifts: night and evening shifts with punches,
    eligible if worked in full, on time at both ends, and approved.

    Stand-ins: a person's shift of a day goes round ``ROSTER_SHIFTS``; a
    person's time sheets are approved unless the id is a multiple of 3."""
    days = S.schedule_days(t).select("person_id", "work_date", ((F.col("person_id") + F.dayofmonth("work_date")) % 4).cast("int").alias("roster"))
    w = shift_windows(days.join(K.frame(t.spark, ROSTER_SHIFTS, ROSTER_SCHEMA), "roster"))
    p = S.time_records(t).select(F.col("resource_id").alias("person_id"), F.col("start_time").cast("timestamp").alias("punch"), "record_id")
    j = w.filter(F.col("shift_type") != "Regular").join(punches_by_shift(p, w), ["person_id", "work_date"])
    worked = F.floor((F.unix_micros("punch_out") - F.unix_micros("punch_in")) / 60_000_000)
    approved = F.col("person_id") % 3 != 0
    good = (F.col("shift_hours") * 60 <= worked) & (F.col("punch_in") <= F.col("shift_start")) & (F.col("punch_out") >= F.col("shift_end")) & approved
    local = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return j.select("person_id", "work_date", "shift_name", "shift_type", "shift_hours", "punches", local("punch_in"), local("punch_out"),
                    worked.cast("bigint").alias("worked_minutes"), F.when(approved, "APPROVED").otherwise("SUBMITTED").alias("status"),
                    F.when(good, "Y").otherwise("N").alias("allowance_eligible"))


@register("r_tl9_missing_punches", S.with_sql("""
SELECT person_id, work_date, first_in AS only_punch FROM punch_days WHERE punches = 1""", "punch_days"))
def missing_punches(t: Tables) -> DataFrame:
    """R-TL9: days with a single punch (in without out)."""
    p = punch_days(t).filter(F.col("punches") == 1)
    return p.select("person_id", "work_date", F.col("first_in").alias("only_punch"))


@register("r_tl10_overtime", S.with_sql("""
SELECT person_id, week_start, worked_minutes, normal_ot_minutes, holiday_ot_minutes,
       CASE WHEN worked_minutes <= 2700 THEN 0
            WHEN worked_minutes - 2700 >= normal_ot_minutes THEN normal_ot_minutes
            ELSE worked_minutes - 2700 END AS weekly_normal_ot_minutes
FROM (SELECT person_id, CAST(date_trunc('week', work_date) AS DATE) AS week_start,
             CAST(SUM(worked_minutes) AS BIGINT) AS worked_minutes,
             CAST(SUM(CASE WHEN off_day THEN 0 WHEN worked_minutes - 480 > 120 THEN 120 ELSE worked_minutes - 480 END) AS BIGINT)
               AS normal_ot_minutes,
             CAST(SUM(CASE WHEN NOT off_day THEN 0 WHEN worked_minutes >= 480 THEN 480 ELSE worked_minutes END) AS BIGINT)
               AS holiday_ot_minutes
      FROM (SELECT p.person_id, p.work_date, p.worked_minutes,
                   h.person_id IS NOT NULL OR isodow(p.work_date) >= 6 AS off_day
            FROM punch_days p
            LEFT JOIN person_holidays h ON h.person_id = p.person_id AND h.holiday_date = p.work_date) d
      GROUP BY 1, 2) w""", "punch_days", "person_holidays"))
def overtime(t: Tables) -> DataFrame:
    """R-TL10: overtime per person and week.

    Fixed values: on a working day the time worked less the 8 h shift, 2 h at
    most (a short day counts against it, as in the reference's rule); on
    holidays and weekends all time worked, 8 h at most; normal overtime of a
    week counts as far as the week exceeds 45 h.  The 35 h of Ramadan weeks
    are left out: the test tables' calendar has none."""
    p = punch_days(t)
    hol = S.person_holidays(t).select("person_id", F.col("holiday_date").alias("work_date"), F.lit(True).alias("hol"))
    j = p.join(hol, ["person_id", "work_date"], "left")
    off = F.col("hol").isNotNull() | (F.weekday("work_date") >= 5)
    w = F.col("worked_minutes")
    g = j.groupBy("person_id", F.trunc("work_date", "week").alias("week_start")).agg(
        F.sum("worked_minutes").alias("worked_minutes"),
        F.sum(F.when(off, 0).otherwise(F.least(w - FULL_DAY_MIN, F.lit(120)))).alias("normal_ot_minutes"),
        F.sum(F.when(off, F.least(w, F.lit(480))).otherwise(0)).alias("holiday_ot_minutes"))
    return g.withColumn("weekly_normal_ot_minutes", weekly_overtime("worked_minutes", "normal_ot_minutes"))


def weekly_overtime(worked: str, normal: str, threshold: int = 45 * 60) -> F.Column:
    """Normal overtime of a week, at most what the week exceeds the threshold by."""
    over = F.col(worked) - threshold
    return F.when(over <= 0, F.lit(0)).when(over >= F.col(normal), F.col(normal)).otherwise(over).cast("bigint")


@register("r_tl11_monthly_deficit_alert", S.with_sql(f"""
SELECT d.person_id, COUNT(*) * {FULL_DAY_MIN} AS scheduled_minutes, CAST(COALESCE(SUM(p.worked_minutes), 0) AS BIGINT) AS worked_minutes,
       CAST(COUNT(*) * {FULL_DAY_MIN} - COALESCE(SUM(p.worked_minutes), 0) AS BIGINT) AS deficit_minutes
FROM schedule_days d LEFT JOIN punch_days p ON p.person_id = d.person_id AND p.work_date = d.work_date
GROUP BY d.person_id HAVING COUNT(*) * {FULL_DAY_MIN} - COALESCE(SUM(p.worked_minutes), 0) >= 360""",
                                                    "schedule_days", "punch_days"))
def monthly_deficit(t: Tables) -> DataFrame:
    """R-TL11: people whose worked time falls short of the schedule by 6 h
    or more in the month (A2 + A4)."""
    d = S.schedule_days(t).select("person_id", "work_date")
    j = d.join(punch_days(t).select("person_id", "work_date", "worked_minutes"), ["person_id", "work_date"], "left")
    g = j.groupBy("person_id").agg((F.count(F.lit(1)) * FULL_DAY_MIN).alias("scheduled_minutes"),
                                   F.coalesce(F.sum("worked_minutes"), F.lit(0)).alias("worked_minutes"))
    g = g.withColumn("deficit_minutes", F.col("scheduled_minutes") - F.col("worked_minutes"))
    return g.filter(F.col("deficit_minutes") >= 360)


@register("r_tl12_holidays_per_person", S.with_sql("""
SELECT person_id, COUNT(DISTINCT holiday_date) AS holiday_days FROM person_holidays GROUP BY person_id""",
                                                   "person_holidays"))
def holidays_per_person(t: Tables) -> DataFrame:
    """R-TL12: holiday days per person (distinct dates)."""
    return S.person_holidays(t).groupBy("person_id").agg(F.count_distinct("holiday_date").alias("holiday_days"))


@register("r_tl13_leave_entitlement", S.with_sql(f"""
SELECT person_id, service_years, entitlement_days, {sql_div_round('entitlement_days * 100', '1200')} AS monthly_accrual
FROM (SELECT person_id, service_years,
             CAST(CASE WHEN service_years < 1 THEN 10 WHEN service_years <= 5 THEN 15
                       WHEN service_years <= 10 THEN 20 ELSE 25 END AS INTEGER) AS entitlement_days
      FROM (SELECT person_id, {sql_service_years("/*as_of*/DATE '2000-12-31'", "date_start")} AS service_years
            FROM service_periods
            WHERE date_start <= /*as_of*/DATE '2000-12-31'
              AND (actual_termination_date IS NULL OR actual_termination_date >= /*as_of*/DATE '2000-12-31')) s) b""",
                                                 "service_periods"))
def leave_entitlement(t: Tables) -> DataFrame:
    """R-TL13: entitlement of the people in service at the date by years of
    service (2 decimals) and the monthly accrual (entitlement / 12, exact).
    Fixed values: 10 days below 1 year, 15 up to 5, 20 up to 10, then 25."""
    s = S.service_periods(t).filter((F.col("date_start") <= F.lit(t.params.as_of))
                                    & F.coalesce(F.col("actual_termination_date") >= F.lit(t.params.as_of), F.lit(True)))
    s = s.select("person_id", service_years(F.lit(t.params.as_of), "date_start").alias("service_years"))
    y = F.col("service_years")
    ent = F.when(y < 1, 10).when(y <= 5, 15).when(y <= 10, 20).otherwise(25).cast("int")
    return s.select("person_id", "service_years", ent.alias("entitlement_days"),
                    div_round(ent * 100, F.lit(1200), 2).alias("monthly_accrual"))


def _managers(t: Tables) -> DataFrame:
    """Task, project and line managers per person (J18 self joins through
    aggregated group leads; the lead of a group has no manager in it)."""
    p = S.people(t)
    ps = S.person_schedules(t).select("person_id", "schedule_id")
    proj_lead = p.groupBy((F.col("person_id") % 7).alias("project_id")).agg(F.max("person_id").alias("project_mgr"))
    line_lead = ps.groupBy("schedule_id").agg(F.min("person_id").alias("line_mgr"))
    task = p.select(F.col("person_id").alias("task_mgr"))
    x = (p.withColumn("project_id", F.col("person_id") % 7).join(proj_lead, "project_id")
          .join(ps, "person_id").join(line_lead, "schedule_id")
          .join(task, (F.col("person_id") % 2 == 0) & (F.col("task_mgr") == F.col("person_id") - 2), "left"))
    return x.select("person_id", "project_id", "task_mgr",
                    F.when(F.col("project_mgr") != F.col("person_id"), F.col("project_mgr")).alias("project_mgr"),
                    F.when(F.col("line_mgr") != F.col("person_id"), F.col("line_mgr")).alias("line_mgr"))


_TL2_SQL = S.with_sql("""
SELECT r.resource_id AS person_id, r.work_date, r.record_id, m.project_id,
       COALESCE(m.task_mgr, m.project_mgr, m.line_mgr) AS approver_id,
       CASE WHEN m.task_mgr IS NOT NULL THEN 'TASK' WHEN m.project_mgr IS NOT NULL THEN 'PROJECT'
            WHEN m.line_mgr IS NOT NULL THEN 'LINE' ELSE 'NONE' END AS approver_level
FROM (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY resource_id, work_date ORDER BY version DESC) AS rn
                     FROM time_records) v WHERE rn = 1) r
JOIN (SELECT p.person_id, p.person_id % 7 AS project_id, t.person_id AS task_mgr,
             CASE WHEN pl.project_mgr <> p.person_id THEN pl.project_mgr END AS project_mgr,
             CASE WHEN ll.line_mgr <> p.person_id THEN ll.line_mgr END AS line_mgr
      FROM people p
      JOIN (SELECT person_id % 7 AS project_id, MAX(person_id) AS project_mgr FROM people GROUP BY 1) pl
        ON pl.project_id = p.person_id % 7
      JOIN person_schedules ps ON ps.person_id = p.person_id
      JOIN (SELECT schedule_id, MIN(person_id) AS line_mgr FROM person_schedules GROUP BY 1) ll ON ll.schedule_id = ps.schedule_id
      LEFT JOIN people t ON p.person_id % 2 = 0 AND t.person_id = p.person_id - 2) m
  ON m.person_id = r.resource_id""", "time_records", "people", "person_schedules")


@register("r_tl2_timesheet_approver", _TL2_SQL)
def timesheet_approver(t: Tables) -> DataFrame:
    """R-TL2: latest timecard version per person and day (V3) with its
    project and approver: task manager, else project manager, else line
    manager (J17 fallback over J18 manager joins)."""
    from tallyspark.operators.joins import fallback_chain
    tr = S.time_records(t).select("resource_id", "work_date", "record_id", "version")
    latest = E.latest(tr, ["resource_id", "work_date"], ["version"])
    m = _managers(t).withColumnRenamed("person_id", "resource_id")
    j = latest.join(m, "resource_id")
    level = (F.when(F.col("task_mgr").isNotNull(), "TASK").when(F.col("project_mgr").isNotNull(), "PROJECT")
             .when(F.col("line_mgr").isNotNull(), "LINE").otherwise("NONE"))
    return j.select(F.col("resource_id").alias("person_id"), "work_date", "record_id", "project_id",
                    fallback_chain([F.col("task_mgr"), F.col("project_mgr"), F.col("line_mgr")]).alias("approver_id"),
                    level.alias("approver_level"))


@register("r_tl5_absence_hours", S.with_sql("""
SELECT l.person_id, l.absence_type, COUNT(DISTINCT d.work_date) AS absence_days, COUNT(DISTINCT d.work_date) * 8 AS absence_hours
FROM (SELECT DISTINCT person_id, absence_type,
             CAST(unnest(generate_series(start_date::TIMESTAMP, end_date::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS work_date
      FROM leaves) l
JOIN schedule_days d ON d.person_id = l.person_id AND d.work_date = l.work_date
GROUP BY l.person_id, l.absence_type""", "leaves", "schedule_days"))
def absence_hours(t: Tables) -> DataFrame:
    """R-TL5: absence days and hours (8 per scheduled day) by type."""
    lv = E.explode_interval(S.leaves(t).select("person_id", "absence_type", "start_date", "end_date"),
                            "start_date", "end_date", "work_date").select("person_id", "absence_type", "work_date").distinct()
    d = S.schedule_days(t).select("person_id", "work_date")
    j = lv.join(d, ["person_id", "work_date"])
    return j.groupBy("person_id", "absence_type").agg(F.count_distinct("work_date").alias("absence_days")) \
        .withColumn("absence_hours", F.col("absence_days") * 8)


@register("r_tl14_line_status", S.with_sql("""
SELECT d.person_id, d.work_date,
       CASE WHEN h.person_id IS NOT NULL THEN 'HOLIDAY' WHEN l.person_id IS NOT NULL THEN 'LEAVE'
            WHEN p.person_id IS NOT NULL THEN 'WORKED' ELSE 'MISSING' END AS line_status
FROM schedule_days d
LEFT JOIN person_holidays h ON h.person_id = d.person_id AND h.holiday_date = d.work_date
LEFT JOIN (SELECT DISTINCT person_id, CAST(unnest(generate_series(start_date::TIMESTAMP, end_date::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS work_date
           FROM leaves) l ON l.person_id = d.person_id AND l.work_date = d.work_date
LEFT JOIN (SELECT DISTINCT resource_id AS person_id, work_date FROM time_records) p
  ON p.person_id = d.person_id AND p.work_date = d.work_date""", "schedule_days", "person_holidays", "leaves", "time_records"))
def line_status(t: Tables) -> DataFrame:
    """R-TL14: status of each scheduled day from holiday, absence and time
    records (first match wins: holiday, leave, worked, missing)."""
    d = S.schedule_days(t).select("person_id", "work_date")
    hol = S.person_holidays(t).select("person_id", F.col("holiday_date").alias("work_date"), F.lit(1).alias("h"))
    lv = E.explode_interval(S.leaves(t).select("person_id", "start_date", "end_date"), "start_date", "end_date", "work_date") \
        .select("person_id", "work_date").distinct().withColumn("l", F.lit(1))
    wk = S.time_records(t).select(F.col("resource_id").alias("person_id"), "work_date").distinct().withColumn("w", F.lit(1))
    j = d.join(hol, ["person_id", "work_date"], "left").join(lv, ["person_id", "work_date"], "left") \
        .join(wk, ["person_id", "work_date"], "left")
    st = (F.when(F.col("h").isNotNull(), "HOLIDAY").when(F.col("l").isNotNull(), "LEAVE")
          .when(F.col("w").isNotNull(), "WORKED").otherwise("MISSING"))
    return j.select("person_id", "work_date", st.alias("line_status"))


@register("r_tl15_timecard_attributes", S.with_sql("""
SELECT v.resource_id AS person_id, v.work_date, v.record_id,
       MAX(CASE WHEN a.attribute = 'LEAVE_REF' THEN a.value END) AS leave_reference,
       MAX(CASE WHEN a.attribute = 'PAY_TIME_TYPE' THEN a.value END) AS payroll_time_type,
       MAX(CASE WHEN a.attribute = 'STAT_HOLIDAY' THEN a.value END) AS statutory_holiday
FROM (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY resource_id, work_date ORDER BY version DESC) AS rn
                     FROM time_records) x WHERE rn = 1) v
LEFT JOIN (SELECT r.record_id, 'LEAVE_REF' AS attribute, CAST(MIN(l.absence_id) AS VARCHAR) AS value
           FROM time_records r JOIN leaves l ON l.person_id = r.resource_id AND r.work_date BETWEEN l.start_date AND l.end_date
           GROUP BY r.record_id
           UNION ALL
           SELECT record_id, 'PAY_TIME_TYPE', CASE WHEN isodow(work_date) >= 6 THEN 'OVERTIME' ELSE 'REGULAR' END FROM time_records
           UNION ALL
           SELECT r.record_id, 'STAT_HOLIDAY', 'Y' FROM time_records r
           JOIN person_holidays h ON h.person_id = r.resource_id AND h.holiday_date = r.work_date) a
  ON a.record_id = v.record_id
GROUP BY v.resource_id, v.work_date, v.record_id""", "time_records", "leaves", "person_holidays"))
def timecard_attributes(t: Tables) -> DataFrame:
    """R-TL15: latest timecard line per day (V3) with its attribute rows
    (leave reference, payroll time type, statutory holiday) pivoted to
    columns with MAX(CASE ...) (A3)."""
    from tallyspark.operators import rollup as A
    tr = S.time_records(t).select("record_id", "resource_id", "work_date", "version")
    latest = E.latest(tr, ["resource_id", "work_date"], ["version"])
    days = tr.select("record_id", "resource_id", "work_date")
    lv = E.explode_interval(S.leaves(t).select("person_id", "absence_id", "start_date", "end_date"),
                            "start_date", "end_date", "work_date").withColumnRenamed("person_id", "resource_id")
    leave_ref = (days.join(lv.select("resource_id", "work_date", "absence_id"), ["resource_id", "work_date"])
                 .groupBy("record_id").agg(F.min("absence_id").cast("string").alias("value"))
                 .withColumn("attribute", F.lit("LEAVE_REF")))
    ptype = days.select("record_id", F.lit("PAY_TIME_TYPE").alias("attribute"),
                        F.when(F.weekday("work_date") >= 5, "OVERTIME").otherwise("REGULAR").alias("value"))
    hol = S.person_holidays(t).select(F.col("person_id").alias("resource_id"), F.col("holiday_date").alias("work_date"))
    stat = days.join(hol, ["resource_id", "work_date"]).select("record_id", F.lit("STAT_HOLIDAY").alias("attribute"),
                                                               F.lit("Y").alias("value"))
    attrs = leave_ref.unionByName(ptype).unionByName(stat)
    piv = A.attribute_pivot(attrs, ["record_id"], "attribute", "value", ["LEAVE_REF", "PAY_TIME_TYPE", "STAT_HOLIDAY"],
                            {"LEAVE_REF": "leave_reference", "PAY_TIME_TYPE": "payroll_time_type",
                             "STAT_HOLIDAY": "statutory_holiday"})
    j = latest.join(piv, "record_id", "left")
    return j.select(F.col("resource_id").alias("person_id"), "work_date", "record_id", "leave_reference",
                    "payroll_time_type", "statutory_holiday")
