"""The semester table and its parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.operators import facts
from cohortline.plans import jobs
from cohortline.sources import reports
from cohortline.sources.schemas import SEMESTER_BASE, TERM_KEY
from cohortline.workload.campus import (
    SQL_BASE,
    SQL_FACTS,
    SQL_FITNESS_ROWS,
    SQL_ONLINE_ROWS,
    SQL_PROFILE,
    SQL_SNAPSHOT,
    SQL_USAGE_AGGREGATES,
    SQL_YEARLY,
    Campus,
    r,
    sql_base,
    sql_order,
    sql_score_aggregates,
)
from cohortline.workload.registry import query

KEY = ", ".join(TERM_KEY)
COLUMNS = ", ".join(SEMESTER_BASE.fieldNames())


@query(f"WITH {SQL_FACTS} SELECT {KEY}, count(*) AS selected_course_count FROM course GROUP BY {KEY}")
def course_counts(c: Campus) -> DataFrame:
    return facts.course_counts(c.course)


_OK = "score BETWEEN 0 AND 100"


@query(f"""WITH {SQL_FACTS}
SELECT {KEY}, count(*) FILTER (WHERE {_OK}) AS score_course_count, count(*) FILTER (WHERE {_OK}) AS score_numeric_count,
  {r(f"coalesce(sum(score) FILTER (WHERE {_OK}), 0)")} AS score_sum,
  {r(f"coalesce(sum(score * score) FILTER (WHERE {_OK}), 0)")} AS score_sq_sum,
  count(*) FILTER (WHERE {_OK} AND score < 60) AS fail_course_count, count(gpa) AS gpa_count,
  {r("coalesce(sum(gpa), 0)")} AS gpa_sum, {r("coalesce(sum(credit) FILTER (WHERE credit > 0), 0)")} AS credit_sum,
  count(*) FILTER (WHERE flagged AND {_OK}) AS resit_exam_count
FROM score GROUP BY {KEY}""")
def score_stats(c: Campus) -> DataFrame:
    return facts.score_stats(c.score)


@query(f"WITH {SQL_FACTS} SELECT {KEY}, {sql_score_aggregates('strict')} FROM score GROUP BY {KEY}")
def score_finalise(c: Campus) -> DataFrame:
    return facts.score_finalise(c.score)


@query(f"WITH {SQL_FACTS} SELECT event_type, school_year, semester, {SQL_USAGE_AGGREGATES} FROM usage GROUP BY ALL")
def internet_stats(c: Campus) -> DataFrame:
    """By kind of event: the key may be any column, and here a few keys hold all rows."""
    return facts.internet_stats(c.usage, ["event_type", "school_year", "semester"])


@query(f"WITH {SQL_FITNESS_ROWS}, {SQL_YEARLY} SELECT * FROM yearly")
def fitness_by_year(c: Campus) -> DataFrame:
    return c.yearly


@query(f"WITH {SQL_ONLINE_ROWS}, {SQL_SNAPSHOT} SELECT * FROM snapshot")
def first_snapshot(c: Campus) -> DataFrame:
    return c.snapshot


_RISK = """SELECT student_id, school_year, semester, 1 AS risk_event_current,
  string_agg(DISTINCT type_code, '|' ORDER BY type_code) AS risk_event_type_codes,
  string_agg(DISTINCT reason_code, '|' ORDER BY reason_code) AS risk_event_reason_codes
FROM status GROUP BY ALL"""


@query(f"WITH {SQL_FACTS} {_RISK}")
def risk_events(c: Campus) -> DataFrame:
    return facts.risk_events(c.status)


@query(f"""WITH {SQL_FACTS},
a AS (SELECT {KEY}, count(*) AS selected_course_count FROM course GROUP BY {KEY}),
b AS ({_RISK})
SELECT coalesce(a.student_id, b.student_id) AS student_id, coalesce(a.school_year, b.school_year) AS school_year,
  coalesce(a.semester, b.semester) AS semester, selected_course_count, risk_event_current, risk_event_type_codes,
  risk_event_reason_codes
FROM a FULL JOIN b ON a.student_id = b.student_id AND a.school_year = b.school_year AND a.semester = b.semester""")
def semester_skeleton(c: Campus) -> DataFrame:
    return facts.semester_skeleton(facts.course_counts(c.course), facts.risk_events(c.status))


@query(f"""WITH {SQL_PROFILE}, {SQL_SNAPSHOT}, {SQL_YEARLY}, {SQL_FACTS}
SELECT c.student_id, c.school_year, c.semester, {sql_order("c.school_year", "c.semester")} AS term_order, gender, grade,
  college, major, class_name, online_learning_bfb_snapshot,
  CASE WHEN fitness_count > 0 THEN physical_test_score END AS physical_test_score,
  CASE WHEN fitness_count > 0 THEN physical_test_bmi END AS physical_test_bmi
FROM course c JOIN profile p ON c.student_id = p.student_id LEFT JOIN snapshot s ON c.student_id = s.student_id
LEFT JOIN yearly y ON c.student_id = y.student_id AND c.school_year = y.school_year""")
def joined_terms(c: Campus) -> DataFrame:
    """The joins one by one: known students, profile, snapshot, yearly values."""
    rows = facts.known_students(c.course, c.profile)
    rows = facts.with_profile(rows, c.profile)
    rows = facts.with_yearly(facts.with_snapshot(rows, c.snapshot), c.yearly)
    return facts.with_term_order(rows)


@query(f"{SQL_BASE} SELECT {COLUMNS} FROM base")
def semester_base(c: Campus) -> DataFrame:
    return c.base


@query(f"{SQL_BASE} SELECT {COLUMNS} FROM base")
def semester_base_raw_text(c: Campus) -> DataFrame:
    """The same table, this time from dirty text tables."""
    return jobs.semester_base_of(c.raw)


@query(f"{sql_base('lenient')} SELECT {COLUMNS} FROM base")
def semester_base_lenient(c: Campus) -> DataFrame:
    return jobs.semester_base(c.course, c.score, c.usage, c.status, c.card, rules=facts.LENIENT)


@query(f"""{SQL_BASE}
SELECT {KEY}, CASE WHEN lead(term_order) OVER w - term_order = CASE WHEN semester = '1' THEN 1 ELSE 9 END
  THEN lead(risk_event_current) OVER w END AS risk_label_next_term
FROM base WINDOW w AS (PARTITION BY student_id ORDER BY term_order, school_year, semester)""")
def next_term_label_calendar(c: Campus) -> DataFrame:
    return facts.next_term_label(c.base, calendar=True).select(*TERM_KEY, "risk_label_next_term")


@query("""SELECT lower(trim(o_orderpriority)) AS value_norm, first(upper(o_orderpriority) ORDER BY o_orderkey) AS value_raw
FROM orders GROUP BY ALL""")
def distinct_values(c: Campus) -> DataFrame:
    rows = c.table("orders").select("o_orderkey", F.concat(F.lit(" "), F.upper("o_orderpriority")).alias("priority"))
    return reports.distinct_values(rows, "priority", "o_orderkey")


@query(f"""{SQL_BASE}
SELECT count(*) AS row_count, count(DISTINCT student_id) AS unique_students,
  count(*) FILTER (WHERE risk_event_current = 1) AS current_risk_rows, count(risk_label_next_term) AS labelled_rows
FROM base""")
def build_report(c: Campus) -> DataFrame:
    return reports.build_report(c.base)
