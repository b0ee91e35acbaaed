"""Hand cases on both sides of the reports' limits and code maps."""

from pyspark.sql import functions as F

from tallyspark.plans.registry import load_all

load_all()

from tallyspark.plans.payroll import element_entries  # noqa: E402
from tallyspark.plans.people import stage_alert_columns  # noqa: E402
from tallyspark.plans.projects import plan_status_code  # noqa: E402
from tallyspark.plans.recruiting import transition_status  # noqa: E402
from tallyspark.plans.supply import grn_open  # noqa: E402
from tallyspark.plans.time_labor import weekly_overtime  # noqa: E402


def test_stage_alerts_at_their_limits(spark):
    cases = [("To be Reviewed", 7, None, "No Alert", "LOW"),
             ("Shared with Hiring Manager", 8, None, "Alert: Pending review > 7 days", "LOW"),
             ("To be Reviewed", 31, None, "Alert: Pending review > 7 days", "HIGH"),
             ("Approved", 3, 20, "No Alert", "LOW"),
             ("Approved", 4, 20, "Alert: Approved offer not extended > 3 days", "LOW"),
             ("Extended", 14, 5, "No Alert", "LOW"),
             ("Extended", 15, 5, "Alert: Offer extended > 14 days, not accepted", "MEDIUM"),
             ("Accepted", 2, 14, "No Alert", "LOW"),
             ("Accepted", 2, 13, "Alert: Pre-employment activities must complete in < 14 days", "MEDIUM"),
             ("Accepted", 2, 6, "Alert: Pre-employment activities must complete in < 14 days", "HIGH"),
             ("Accepted", 30, 14, "No Alert", "MEDIUM")]
    df = spark.createDataFrame([c[:3] for c in cases], "current_status string, days_since_submission long, days_to_start long")
    got = {tuple(r) for r in stage_alert_columns(df).collect()}
    assert got == set(cases)


def test_transition_states(spark):
    cases = [(True, True, True, True, "Hired - Active Employee"), (True, False, True, True, "Hired - Pending Worker (Not Yet Active)"),
             (False, False, True, True, "Offer Accepted - Awaiting Hire"),
             (False, True, False, True, "Offer Extended - Awaiting Acceptance"), (False, False, False, False, "Offer in Progress")]
    df = spark.createDataFrame([c[:4] for c in cases], "h boolean, a boolean, c boolean, e boolean")
    got = {tuple(r) for r in df.withColumn("s", transition_status(F.col("h"), F.col("a"), F.col("c"), F.col("e"))).collect()}
    assert got == set(cases)


def test_plan_status_codes(spark):
    cases = [("BUDGET", "W", "Y", "N", "CW"), ("BUDGET", "W", "N", "N", "W"), ("BUDGET", "B", "Y", "Y", "COB"), ("BUDGET", "B", "Y", "N", "CB"),
             ("BUDGET", "B", "N", "Y", "OB"), ("BUDGET", "B", "P", "Y", "B"), ("BUDGET", "S", "Y", "Y", None),
             ("FORECAST", "W", "Y", "Y", "CW"), ("FORECAST", "B", "Y", "Y", "COA"), ("FORECAST", "B", "Y", "N", "CA"),
             ("FORECAST", "B", "N", "Y", "OA"), ("FORECAST", "B", "P", "Y", "POA"), ("FORECAST", "B", "P", "N", "PA"),
             ("FORECAST", "B", "N", "N", "A"), ("FORECAST", "S", "N", "N", "S"), ("OTHER", "B", "Y", "Y", None)]
    df = spark.createDataFrame([c[:4] for c in cases], "plan_class string, code string, current_plan_status_flag string, original_flag string")
    got = {tuple(r) for r in df.withColumn("s", plan_status_code(F.col("code"))).collect()}
    assert got == set(cases)


def test_open_receipts(spark):
    cases = [(10, 4, "VALIDATED", "Approved", "Y"), (10, 4, "NEEDS REVALIDATION", "Approved", "N"), (10, 4, "VALIDATED", "Required", "N"),
             (10, 10, "VALIDATED", "Approved", "N"), (10, None, "VALIDATED", "Required", "Y"), (0, None, "VALIDATED", "Approved", "N"),
             (None, None, "VALIDATED", "Approved", "N"), (None, 4, "VALIDATED", "Approved", "N")]
    df = spark.createDataFrame([c[:4] for c in cases], "rcv_amount long, inv_amount long, validation_status string, approval_status string")
    got = {tuple(r) for r in df.withColumn("s", grn_open(df)).collect()}
    assert got == set(cases)


def test_weekly_overtime(spark):
    cases = [(2700, 60, 0), (2701, 60, 1), (2760, 60, 60), (3000, 60, 60), (2800, -30, -30)]
    df = spark.createDataFrame([c[:2] for c in cases], "worked long, normal long")
    got = {tuple(r) for r in df.withColumn("o", weekly_overtime("worked", "normal")).collect()}
    assert got == set(cases)


def test_no_timesheet_looks_at_the_whole_period(spark):
    from types import SimpleNamespace

    from tallyspark.functions.params import Params
    from tallyspark.plans.time_labor import no_timesheet

    rows = [(1, 1, "click", "2024-01-03 08:00:00"), (2, 2, "click", "2024-01-10 08:00:00"), (3, 3, "click", "2024-01-30 23:00:00"),
            (4, 4, "view", "2024-01-10 08:00:00"), (5, 5, "click", "2024-02-01 08:00:00")]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts string")
    t = SimpleNamespace(params=Params(), events=events.select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp"), F.lit(1.0).alias("value")))
    assert {r.person_id for r in no_timesheet(t).collect()} == {4, 5}


def test_allowances_by_grade(spark):
    df = spark.createDataFrame([(1, "12000.00", 1), (2, "12000.00", 3), (3, "100.07", 5), (4, "12000.00", 6)], "person_id int, s string, grade_id int")
    rows = element_entries(df.select("person_id", F.col("s").cast("decimal(18,2)").alias("salary"), "grade_id")).collect()
    got = {(r.person_id, r.element.split()[0]): str(r.entry_value) for r in rows}
    assert got == {(1, "Basic"): "12000.00", (1, "Housing"): "250.00", (1, "Transport"): "100.00", (1, "Food"): "50.00", (1, "Mobile"): "20.00", (1, "Other"): "30.00",
                   (2, "Basic"): "12000.00", (2, "Housing"): "250.00", (2, "Transport"): "100.00", (2, "Food"): "50.00", (2, "Other"): "30.00",
                   (3, "Basic"): "100.07", (3, "Housing"): "2.08", (3, "Transport"): "0.83", (4, "Basic"): "12000.00"}


def test_end_of_service_adds_up(spark):
    from tallyspark.plans.registry import QUERIES
    rows = QUERIES["r_cp7_end_of_service_components"](spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r.actual_termination_date is not None for r in rows)
    for r in rows:
        one = (r.basic_salary + r.housing_allowance) / 30
        assert abs(r.one_day_salary - one) < 0.01 and abs(r.leave_encashment - one * r.leave_balance_days) < 0.01
        assert r.total_eos_payment == r.leave_encashment + r.gratuity_balance + sum(r[c] for c in r.asDict() if c.startswith("air_fare"))
