"""Recruiting pipeline reports (R-RC1-5, 7, 10, 13, 14, 16, 19).

Stand-ins: one requisition per source group (``person_id % 7``) with its
recruiter (lowest id) and hiring manager (highest id); one offer per
candidate with extended/accepted/hire dates from the submission stages;
candidate names from the customer table (person id = customer id).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.params import AS_OF, EVENTS_FROM, EVENTS_TO
from tallyspark.functions.scalars import TOTAL, cents, decode, percent, sql_percent
from tallyspark.operators import effective as E
from tallyspark.operators import rollup as A
from tallyspark.operators import windows as W
from tallyspark.plans.registry import register
from tallyspark.sources import standins as S
from tallyspark.sources.tables import Tables

D = S._d


def requisitions(t: Tables) -> DataFrame:
    p = S.people(t)
    g = p.groupBy((F.col("person_id") % 7).alias("requisition_id")).agg(
        F.min("person_id").alias("recruiter_id"), F.max("person_id").alias("hiring_manager_id"))
    return g.select("requisition_id",
                    F.concat(F.lit("REQ-"), F.col("requisition_id").cast("string")).alias("requisition_number"),
                    F.concat(F.lit("Position "), F.col("requisition_id").cast("string")).alias("requisition_title"),
                    "recruiter_id", "hiring_manager_id")


S._cte("requisitions", ("people",), """
SELECT person_id % 7 AS requisition_id, 'REQ-' || CAST(person_id % 7 AS VARCHAR) AS requisition_number,
       'Position ' || CAST(person_id % 7 AS VARCHAR) AS requisition_title,
       MIN(person_id) AS recruiter_id, MAX(person_id) AS hiring_manager_id
FROM people GROUP BY person_id % 7""")


def offers(t: Tables) -> DataFrame:
    """One offer per candidate: first offered day (extended), first accepted
    day if not before it, first hired day if not before acceptance."""
    s = S.submissions(t)
    first = lambda flag: F.min(F.when(F.col(flag) == 1, F.col("submission_date")))
    g = s.groupBy("person_id").agg(first("offered").alias("extended_date"), first("accepted").alias("first_acc"),
                                   first("hired").alias("first_hire"))
    g = g.filter(F.col("extended_date").isNotNull())
    acc = F.when(F.col("first_acc") >= F.col("extended_date"), F.col("first_acc"))
    g = g.withColumn("accepted_date", acc)
    hire = F.when(F.col("first_hire") >= F.col("accepted_date"), F.col("first_hire"))
    return g.select(F.col("person_id").alias("offer_id"), "person_id", (F.col("person_id") % 7).alias("requisition_id"),
                    "extended_date", "accepted_date", hire.alias("hire_date"))


S._cte("offers", ("submissions",), """
SELECT person_id AS offer_id, person_id, person_id % 7 AS requisition_id, extended_date, accepted_date,
       CASE WHEN first_hire >= accepted_date THEN first_hire END AS hire_date
FROM (SELECT person_id, extended_date, first_hire, CASE WHEN first_acc >= extended_date THEN first_acc END AS accepted_date
      FROM (SELECT person_id, MIN(CASE WHEN offered = 1 THEN submission_date END) AS extended_date,
                   MIN(CASE WHEN accepted = 1 THEN submission_date END) AS first_acc,
                   MIN(CASE WHEN hired = 1 THEN submission_date END) AS first_hire
            FROM submissions GROUP BY person_id) g
      WHERE extended_date IS NOT NULL) x""")


def _names(t: Tables, id_col: str, name_col: str) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias(id_col), F.col("c_name").alias(name_col))


def _state() -> F.Column:
    even_person = (F.col("person_id") % 2) == 0
    return (F.when(F.col("hired") == 1, "Hired").when(F.col("accepted") == 1, "Offer Accepted")
             .when((F.col("offered") == 1) & even_person, "Selected for Offer - Experienced")
             .when(F.col("offered") == 1, "Selected for Offer - Fresher")
             .when((F.col("applied") == 1) & ((F.col("submission_id") % 2) == 0), "To be Reviewed")
             .when(F.col("applied") == 1, "Shared with Hiring Manager")
             .otherwise("Withdrawn by Candidate"))


_STATE_SQL = ("CASE WHEN hired = 1 THEN 'Hired' WHEN accepted = 1 THEN 'Offer Accepted' "
              "WHEN offered = 1 AND person_id % 2 = 0 THEN 'Selected for Offer - Experienced' "
              "WHEN offered = 1 THEN 'Selected for Offer - Fresher' "
              "WHEN applied = 1 AND submission_id % 2 = 0 THEN 'To be Reviewed' "
              "WHEN applied = 1 THEN 'Shared with Hiring Manager' ELSE 'Withdrawn by Candidate' END")

# Workflow state -> business-friendly status.
BUSINESS_STATUS = [
    ("To be Reviewed", "Candidate Reviewed for Interview"),
    ("Shared with Hiring Manager", "Candidate Reviewed for Interview"),
    ("Rejected by Employer", "Candidate Rejected"),
    ("Withdrawn by Candidate", "Candidate Withdrawn"),
    ("Selected for Offer - Experienced", "Candidate selected for offer"),
    ("Selected for Offer - Fresher", "Candidate selected for offer"),
]


def _business_sql(c: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} = '{a}' THEN '{b}'" for a, b in BUSINESS_STATUS) + f" ELSE {c} END"


_RC2_SQL = S.with_sql(f"""
SELECT r.requisition_number, s.submission_id, c.c_name AS candidate_name,
       strftime(s.submission_date, '%d/%m/%Y') AS submission_date_text, x.current_status,
       {_business_sql('x.current_status')} AS business_status, s.source,
       rc.c_name AS recruiter_name, hm.c_name AS hiring_manager
FROM submissions s
JOIN (SELECT submission_id, person_id, {_STATE_SQL} AS current_status FROM submissions) x
  ON x.submission_id = s.submission_id AND x.person_id = s.person_id
JOIN requisitions r ON r.requisition_id = s.person_id % 7
JOIN customer c ON c.c_custkey = s.person_id
LEFT JOIN customer rc ON rc.c_custkey = r.recruiter_id
LEFT JOIN customer hm ON hm.c_custkey = r.hiring_manager_id
WHERE s.submission_date >= {D(EVENTS_FROM)} AND s.applied = 1""", "submissions", "requisitions")


@register("r_rc2_candidate_pipeline", _RC2_SQL)
def candidate_pipeline(t: Tables) -> DataFrame:
    """R-RC2: active submissions with requisition, candidate, formatted
    date, workflow state, business-friendly status (X2 map), source,
    recruiter and hiring manager (J21)."""
    from tallyspark.functions.scalars import decode as dec
    s = S.submissions(t).filter((F.col("submission_date") >= F.lit(t.params.events_from)) & (F.col("applied") == 1))
    s = s.withColumn("current_status", _state())
    r = requisitions(t)
    j = (s.withColumn("requisition_id", F.col("person_id") % 7).join(r, "requisition_id")
          .join(_names(t, "person_id", "candidate_name"), "person_id")
          .join(_names(t, "recruiter_id", "recruiter_name"), "recruiter_id", "left")
          .join(_names(t, "hiring_manager_id", "hiring_manager"), "hiring_manager_id", "left"))
    biz = dec("current_status", BUSINESS_STATUS, F.col("current_status"))
    return j.select("requisition_number", "submission_id", "candidate_name",
                    F.date_format("submission_date", "dd/MM/yyyy").alias("submission_date_text"), "current_status",
                    biz.alias("business_status"), "source", "recruiter_name", "hiring_manager")


_RC1_SQL = S.with_sql("""
SELECT r.requisition_number, r.requisition_title, rc.c_name AS recruiter_name, hm.c_name AS hiring_manager,
       COALESCE(a.active_submissions, 0) AS active_submissions, COALESCE(o.offers_extended, 0) AS offers_extended,
       COALESCE(o.hires, 0) AS hires,
       CASE WHEN COALESCE(o.hires, 0) < COALESCE(a.active_submissions, 0) THEN 'OPEN' ELSE 'FILLED' END AS requisition_status
FROM requisitions r
LEFT JOIN customer rc ON rc.c_custkey = r.recruiter_id
LEFT JOIN customer hm ON hm.c_custkey = r.hiring_manager_id
LEFT JOIN (SELECT person_id % 7 AS requisition_id, COUNT(*) AS active_submissions FROM submissions WHERE applied = 1 GROUP BY 1) a
  ON a.requisition_id = r.requisition_id
LEFT JOIN (SELECT requisition_id, COUNT(*) AS offers_extended, COUNT(hire_date) AS hires FROM offers GROUP BY 1) o
  ON o.requisition_id = r.requisition_id""", "requisitions", "submissions", "offers")


@register("r_rc1_open_requisitions", _RC1_SQL)
def open_requisitions(t: Tables) -> DataFrame:
    """R-RC1: requisitions with recruiter, hiring manager, active
    submissions, offers and hires (each pre-aggregated), open or filled."""
    r = requisitions(t)
    a = (S.submissions(t).filter(F.col("applied") == 1).groupBy((F.col("person_id") % 7).alias("requisition_id"))
         .agg(F.count(F.lit(1)).alias("active_submissions")))
    o = offers(t).groupBy("requisition_id").agg(F.count(F.lit(1)).alias("offers_extended"),
                                                F.count("hire_date").alias("hires"))
    j = (r.join(_names(t, "recruiter_id", "recruiter_name"), "recruiter_id", "left")
          .join(_names(t, "hiring_manager_id", "hiring_manager"), "hiring_manager_id", "left")
          .join(a, "requisition_id", "left").join(o, "requisition_id", "left"))
    act, off, hires = (F.coalesce(c, F.lit(0)) for c in ("active_submissions", "offers_extended", "hires"))
    return j.select("requisition_number", "requisition_title", "recruiter_name", "hiring_manager",
                    act.alias("active_submissions"), off.alias("offers_extended"), hires.alias("hires"),
                    F.when(hires < act, "OPEN").otherwise("FILLED").alias("requisition_status"))


_RC3_SQL = S.with_sql("""
SELECT s.person_id, c.c_name AS candidate_name, r.requisition_number, s.submission_id, s.submission_date AS offer_date
FROM submissions s
JOIN (SELECT person_id, MAX(submission_date) AS d FROM submissions WHERE offered = 1 GROUP BY person_id) m
  ON m.person_id = s.person_id AND m.d = s.submission_date
JOIN requisitions r ON r.requisition_id = s.person_id % 7
JOIN customer c ON c.c_custkey = s.person_id
WHERE s.offered = 1""", "submissions", "requisitions")


@register("r_rc3_offer_letter", _RC3_SQL)
def offer_letter(t: Tables) -> DataFrame:
    """R-RC3: the candidate's latest offered submission (rows at the group
    maximum, W9) with candidate and requisition details."""
    s = S.submissions(t).filter(F.col("offered") == 1).select("person_id", "submission_id", "submission_date")
    top = W.rows_at_max(s, ["person_id"], "submission_date")
    j = (top.withColumn("requisition_id", F.col("person_id") % 7).join(requisitions(t), "requisition_id")
            .join(_names(t, "person_id", "candidate_name"), "person_id"))
    return j.select("person_id", "candidate_name", "requisition_number", "submission_id",
                    F.col("submission_date").alias("offer_date"))


def _offer_status() -> F.Column:
    return (F.when(F.col("hire_date").isNotNull(), "Hired").when(F.col("accepted_date").isNotNull(), "Accepted")
             .otherwise("Extended"))


_OFFER_STATUS_SQL = ("CASE WHEN hire_date IS NOT NULL THEN 'Hired' WHEN accepted_date IS NOT NULL THEN 'Accepted' "
                     "ELSE 'Extended' END")

_RC5_SQL = S.with_sql(f"""
SELECT o.offer_id, c.c_name AS candidate_name, r.requisition_number,
       strftime(o.extended_date, '%d/%m/%Y') AS extended_date, strftime(o.accepted_date, '%d/%m/%Y') AS accepted_date,
       strftime(o.hire_date, '%d/%m/%Y') AS hire_date, {_OFFER_STATUS_SQL} AS offer_status,
       rc.c_name AS recruiter_name, hm.c_name AS hiring_manager
FROM offers o JOIN requisitions r ON r.requisition_id = o.requisition_id
JOIN customer c ON c.c_custkey = o.person_id
LEFT JOIN customer rc ON rc.c_custkey = r.recruiter_id
LEFT JOIN customer hm ON hm.c_custkey = r.hiring_manager_id""", "offers", "requisitions")


@register("r_rc5_offer_status", _RC5_SQL)
def offer_status(t: Tables) -> DataFrame:
    """R-RC5: offer workflow dates (dd/MM/yyyy), status and the people on it."""
    o = offers(t)
    j = (o.join(requisitions(t), "requisition_id").join(_names(t, "person_id", "candidate_name"), "person_id")
          .join(_names(t, "recruiter_id", "recruiter_name"), "recruiter_id", "left")
          .join(_names(t, "hiring_manager_id", "hiring_manager"), "hiring_manager_id", "left"))
    fmt = lambda c: F.date_format(c, "dd/MM/yyyy")
    return j.select("offer_id", "candidate_name", "requisition_number", fmt("extended_date").alias("extended_date"),
                    fmt("accepted_date").alias("accepted_date"), fmt("hire_date").alias("hire_date"),
                    _offer_status().alias("offer_status"), "recruiter_name", "hiring_manager")


# Follow-up priority labels for pending offers.
FOLLOW_UP = [(14, "URGENT: >14 days"), (7, "HIGH: >7 days"), (3, "MEDIUM: >3 days")]
FOLLOW_UP_DEFAULT = "LOW: Recent"


@register("r_rc16_pending_offer_priority", S.with_sql(f"""
SELECT o.offer_id, c.c_name AS candidate_name, o.extended_date, {D(EVENTS_TO)} - o.extended_date AS days_since_extended,
       CASE {" ".join(f"WHEN {D(EVENTS_TO)} - o.extended_date > {d} THEN '{lab}'" for d, lab in FOLLOW_UP)}
            ELSE '{FOLLOW_UP_DEFAULT}' END AS follow_up_priority
FROM offers o JOIN customer c ON c.c_custkey = o.person_id
WHERE o.extended_date IS NOT NULL AND o.accepted_date IS NULL""", "offers"))
def pending_offer_priority(t: Tables) -> DataFrame:
    """R-RC16: extended, not accepted offers with days since extended and a
    follow-up priority band (X5 + X14)."""
    o = offers(t).filter(F.col("extended_date").isNotNull() & F.col("accepted_date").isNull())
    days = F.datediff(F.lit(t.params.events_to), F.col("extended_date")).cast("bigint")
    pr = None
    for d, lab in FOLLOW_UP:
        pr = F.when(days > d, lab) if pr is None else pr.when(days > d, lab)
    j = o.join(_names(t, "person_id", "candidate_name"), "person_id")
    return j.select("offer_id", "candidate_name", "extended_date", days.alias("days_since_extended"),
                    pr.otherwise(FOLLOW_UP_DEFAULT).alias("follow_up_priority"))


# Transition states of an offer.
RC14_ACTIVE = "Hired - Active Employee"
RC14_PENDING = "Hired - Pending Worker (Not Yet Active)"
RC14_AWAITING_HIRE = "Offer Accepted - Awaiting Hire"
RC14_AWAITING_ACCEPTANCE = "Offer Extended - Awaiting Acceptance"
RC14_IN_PROGRESS = "Offer in Progress"

_RC14_SQL = S.with_sql("""
SELECT offer_id, extended_date, accepted_date, projected_start_date, actual_start_date, transition_status,
       actual_start_date - projected_start_date AS start_date_variance_days,
       CAST(CASE transition_status WHEN 'Offer Accepted - Awaiting Hire' THEN 1
                                   WHEN 'Hired - Pending Worker (Not Yet Active)' THEN 2 ELSE 3 END AS INTEGER) AS sort_rank
FROM (SELECT o.offer_id, o.extended_date, o.accepted_date, o.extended_date + 14 AS projected_start_date,
             o.hire_date AS actual_start_date,
             CASE WHEN o.hire_date IS NOT NULL AND w.last_work_date >= o.hire_date THEN 'Hired - Active Employee'
                  WHEN o.hire_date IS NOT NULL THEN 'Hired - Pending Worker (Not Yet Active)'
                  WHEN o.accepted_date IS NOT NULL THEN 'Offer Accepted - Awaiting Hire'
                  WHEN o.extended_date IS NOT NULL THEN 'Offer Extended - Awaiting Acceptance'
                  ELSE 'Offer in Progress' END AS transition_status
      FROM offers o
      LEFT JOIN (SELECT resource_id, MAX(work_date) AS last_work_date FROM time_records GROUP BY resource_id) w
        ON w.resource_id = o.person_id
      WHERE o.extended_date >= /*events_from*/DATE '2024-01-01') x""", "offers", "time_records")


def transition_status(hired, active, accepted, extended) -> F.Column:
    """Transition state from four booleans, the first that holds."""
    return (F.when(hired & active, RC14_ACTIVE).when(hired, RC14_PENDING).when(accepted, RC14_AWAITING_HIRE)
             .when(extended, RC14_AWAITING_ACCEPTANCE).otherwise(RC14_IN_PROGRESS))


@register("r_rc14_offer_transition", _RC14_SQL)
def offer_transition(t: Tables) -> DataFrame:
    """R-RC14: every offer extended from the period's start, its transition
    state, the days from projected to actual start and a derived sort rank
    (O2: accepted and awaiting hire first, pending workers next).

    Stand-ins: a hired candidate has an employee assignment, active once a
    time record lies on or after the hire date; an offer's projected start is
    14 days after it was extended."""
    o = offers(t).filter(F.col("extended_date") >= F.lit(t.params.events_from))
    worked = S.time_records(t).groupBy(F.col("resource_id").alias("person_id")).agg(F.max("work_date").alias("last_work_date"))
    j = o.join(worked, "person_id", "left")
    active = F.coalesce(F.col("last_work_date") >= F.col("hire_date"), F.lit(False))
    st = transition_status(F.col("hire_date").isNotNull(), active, F.col("accepted_date").isNotNull(), F.col("extended_date").isNotNull())
    j = j.withColumn("projected_start_date", F.date_add("extended_date", 14)).withColumn("transition_status", st)
    rank = (F.when(F.col("transition_status") == RC14_AWAITING_HIRE, 1)
             .when(F.col("transition_status") == RC14_PENDING, 2).otherwise(3))
    return j.select("offer_id", "extended_date", "accepted_date", "projected_start_date", F.col("hire_date").alias("actual_start_date"),
                    "transition_status", F.datediff("hire_date", "projected_start_date").cast("bigint").alias("start_date_variance_days"),
                    rank.alias("sort_rank")).orderBy("sort_rank", "projected_start_date", "offer_id")


# Pre-employment checklist items keyed by the event type that completes them.
CHECKLIST = [("view", "medical"), ("click", "police_clearance"), ("purchase", "documents"),
             ("signup", "visa"), ("error", "contract")]


def _checklist(t: Tables) -> DataFrame:
    e = t.events.select(F.col("user_id").alias("person_id"), "event_type")
    return A.attribute_pivot(e.withColumn("done", F.lit("Completed")), ["person_id"], "event_type", "done",
                             [k for k, _ in CHECKLIST], dict(CHECKLIST))


_CHECK_SQL = ("(SELECT user_id AS person_id, " + ", ".join(
    f"MAX(CASE WHEN event_type = '{k}' THEN 'Completed' END) AS {n}" for k, n in CHECKLIST)
    + " FROM events GROUP BY user_id)")


@register("r_rc4_pre_employment_checklist", "SELECT person_id, " + ", ".join(
    f"COALESCE({n}, 'Pending') AS {n}" for _, n in CHECKLIST) + f" FROM {_CHECK_SQL} x")
def pre_employment_checklist(t: Tables) -> DataFrame:
    """R-RC4: checklist items per candidate as columns (A3 pivot of the
    activity rows), Completed / Pending (X2)."""
    c = _checklist(t)
    return c.select("person_id", *[F.coalesce(n, F.lit("Pending")).alias(n) for _, n in CHECKLIST])


@register("r_rc10_completion_percent", "SELECT person_id, " + " + ".join(
    f"CASE WHEN {n} IS NOT NULL THEN 1 ELSE 0 END" for _, n in CHECKLIST) + " AS items_done, "
    + sql_percent(" + ".join(f"CASE WHEN {n} IS NOT NULL THEN 1 ELSE 0 END" for _, n in CHECKLIST), str(len(CHECKLIST)))
    + f" AS completion_pct FROM {_CHECK_SQL} x")
def completion_percent(t: Tables) -> DataFrame:
    """R-RC10: completed checklist items and completion percent."""
    c = _checklist(t)
    done = None
    for _, n in CHECKLIST:
        term = F.when(F.col(n).isNotNull(), 1).otherwise(0)
        done = term if done is None else done + term
    return c.select("person_id", done.alias("items_done"), percent(done, F.lit(len(CHECKLIST))).alias("completion_pct"))


def _proposed(t: Tables) -> DataFrame:
    rr = S.run_results(t).filter(F.col("classification") == "Earnings")
    v = F.col("result_value").try_cast("decimal(18,2)")
    return rr.groupBy("person_id").agg(
        F.sum(F.when(F.col("element") == "Basic", v).otherwise(0)).cast(TOTAL).alias("proposed_basic"),
        F.sum(F.when(F.col("element") == "Housing", v).otherwise(0)).cast(TOTAL).alias("proposed_housing"),
        F.sum(F.when(F.col("element") == "Transport", v).otherwise(0)).cast(TOTAL).alias("proposed_transport"))


_PROPOSED_SQL = """(SELECT person_id,
   CAST(SUM(CASE WHEN element = 'Basic' THEN TRY_CAST(result_value AS DECIMAL(18,2)) ELSE 0 END) AS DECIMAL(38,2)) AS proposed_basic,
   CAST(SUM(CASE WHEN element = 'Housing' THEN TRY_CAST(result_value AS DECIMAL(18,2)) ELSE 0 END) AS DECIMAL(38,2)) AS proposed_housing,
   CAST(SUM(CASE WHEN element = 'Transport' THEN TRY_CAST(result_value AS DECIMAL(18,2)) ELSE 0 END) AS DECIMAL(38,2)) AS proposed_transport
 FROM run_results WHERE classification = 'Earnings' GROUP BY person_id)"""


@register("r_rc7_offer_vs_current", S.with_sql(f"""
SELECT p.person_id, v.salary AS current_salary, p.proposed_basic, p.proposed_housing, p.proposed_transport,
       CAST(p.proposed_basic + p.proposed_housing + p.proposed_transport AS DECIMAL(38,2)) AS proposed_total,
       CAST(p.proposed_basic + p.proposed_housing + p.proposed_transport - v.salary AS DECIMAL(38,2)) AS difference
FROM {_PROPOSED_SQL} p JOIN person_versions v ON v.person_id = p.person_id
 AND {D(AS_OF)} BETWEEN v.eff_start AND v.eff_end""", "run_results", "person_versions"))
def offer_vs_current(t: Tables) -> DataFrame:
    """R-RC7: proposed components (A2/A3 pivot of the offer's elements)
    against the current salary at the date (J7)."""
    p = _proposed(t)
    cur = E.as_of(S.person_versions(t), t.params.as_of).select("person_id", F.col("salary").alias("current_salary"))
    j = p.join(cur, "person_id")
    tot = F.col("proposed_basic") + F.col("proposed_housing") + F.col("proposed_transport")
    return j.select("person_id", "current_salary", "proposed_basic", "proposed_housing", "proposed_transport",
                    tot.cast(TOTAL).alias("proposed_total"), (tot - F.col("current_salary")).cast(TOTAL).alias("difference"))


@register("r_rc13_current_vs_proposed", S.with_sql(f"""
SELECT p.person_id, v.salary AS current_salary, p.proposed_basic,
       CAST(ROUND(p.proposed_basic - v.salary, 0) AS DECIMAL(38,0)) AS change_rounded,
       {sql_percent('CAST((p.proposed_basic - v.salary) * 100 AS BIGINT)', 'CAST(v.salary * 100 AS BIGINT)')} AS change_pct
FROM {_PROPOSED_SQL} p JOIN person_versions v ON v.person_id = p.person_id
 AND {D(AS_OF)} BETWEEN v.eff_start AND v.eff_end""", "run_results", "person_versions"))
def current_vs_proposed(t: Tables) -> DataFrame:
    """R-RC13: current vs proposed basic -- rounded change (X3) and percent."""
    p = _proposed(t).select("person_id", "proposed_basic")
    cur = E.as_of(S.person_versions(t), t.params.as_of).select("person_id", F.col("salary").alias("current_salary"))
    j = p.join(cur, "person_id")
    ch = F.col("proposed_basic") - F.col("current_salary")
    return j.select("person_id", "current_salary", "proposed_basic",
                    F.round(ch, 0).cast("decimal(38,0)").alias("change_rounded"),
                    percent(cents(ch), cents("current_salary")).alias("change_pct"))


_RC19_SQL = S.with_sql("""
SELECT f.person_id, c.c_name AS candidate_name, r.requisition_number, f.source, f.first_applied,
       o.extended_date, o.accepted_date, o.hire_date, o.hire_date - f.first_applied AS days_to_hire,
       CASE WHEN o.hire_date IS NOT NULL THEN 'HIRED' WHEN o.accepted_date IS NOT NULL THEN 'ACCEPTED'
            WHEN o.extended_date IS NOT NULL THEN 'OFFERED' ELSE 'APPLIED' END AS lifecycle_stage
FROM (SELECT person_id, MIN(source) AS source, MIN(CASE WHEN applied = 1 THEN submission_date END) AS first_applied
      FROM submissions GROUP BY person_id) f
JOIN requisitions r ON r.requisition_id = f.person_id % 7
JOIN customer c ON c.c_custkey = f.person_id
LEFT JOIN offers o ON o.person_id = f.person_id""", "submissions", "requisitions", "offers")


@register("r_rc19_recruiting_lifecycle", _RC19_SQL)
def recruiting_lifecycle(t: Tables) -> DataFrame:
    """R-RC19: one lifecycle row per candidate -- requisition, source, first
    application, offer dates, days to hire and the stage reached (J21)."""
    s = S.submissions(t).groupBy("person_id").agg(
        F.min("source").alias("source"),
        F.min(F.when(F.col("applied") == 1, F.col("submission_date"))).alias("first_applied"))
    j = (s.withColumn("requisition_id", F.col("person_id") % 7).join(requisitions(t), "requisition_id")
          .join(_names(t, "person_id", "candidate_name"), "person_id")
          .join(offers(t).drop("requisition_id", "offer_id"), "person_id", "left"))
    stage = (F.when(F.col("hire_date").isNotNull(), "HIRED").when(F.col("accepted_date").isNotNull(), "ACCEPTED")
             .when(F.col("extended_date").isNotNull(), "OFFERED").otherwise("APPLIED"))
    return j.select("person_id", "candidate_name", "requisition_number", "source", "first_applied", "extended_date",
                    "accepted_date", "hire_date", F.datediff("hire_date", "first_applied").cast("bigint").alias("days_to_hire"),
                    stage.alias("lifecycle_stage"))
