"""Column lists and schemas of the tables the jobs hand to each other."""

from __future__ import annotations

from pyspark.sql import types as T

TERM_KEY = ("student_id", "school_year", "semester")
ID_COLUMNS = ("student_id", "school_year", "semester", "term_order")
FLAG = "risk_event_current"
LABEL = "risk_label_next_term"

# Feature lists of the prepared tables.
NUMERIC_FEATURES = (
    "selected_course_count",
    "score_course_count",
    "avg_score",
    "score_std",
    "fail_course_count",
    "fail_ratio",
    "avg_gpa",
    "credit_sum",
    "resit_exam_count",
    "internet_month_count",
    "internet_hours_sum",
    "internet_hours_avg_per_month",
    "internet_diff_mean",
    "online_learning_bfb_snapshot",
    "physical_test_score",
    "bmi_height_cm",
    "bmi_weight_kg",
)
CATEGORICAL_FEATURES = ("gender", "grade", "college", "major", "semester")
LOG_FEATURES = ("internet_hours_sum", "internet_hours_avg_per_month")
SIGNED_LOG_FEATURES = ("internet_diff_mean",)

_TYPES = {"text": T.StringType(), "int": T.IntegerType(), "count": T.LongType(), "number": T.DoubleType()}


def _schema(**fields: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields.items()])


# The columns of the semester table, the predictions and the key bridge, in their order.
SEMESTER_BASE = _schema(
    student_id="text",
    school_year="text",
    semester="text",
    term_order="int",
    gender="text",
    grade="text",
    college="text",
    major="text",
    class_name="text",
    selected_course_count="count",
    score_course_count="count",
    avg_score="number",
    score_std="number",
    fail_course_count="count",
    fail_ratio="number",
    avg_gpa="number",
    credit_sum="number",
    resit_exam_count="count",
    internet_month_count="count",
    internet_hours_sum="number",
    internet_hours_avg_per_month="number",
    internet_diff_mean="number",
    online_learning_bfb_snapshot="number",
    physical_test_score="number",
    physical_test_bmi="text",
    risk_event_current="int",
    risk_event_type_codes="text",
    risk_event_reason_codes="text",
    risk_label_next_term="int",
)
PREDICTIONS = _schema(
    student_id="text",
    school_year="text",
    semester="text",
    term_order="int",
    label="int",
    pred_label="int",
    pred_proba="number",
)
KEY_BRIDGE_COLUMNS = (
    "source_table",
    "source_field",
    "source_value_raw",
    "source_value_norm",
    "student_id",
    "match_type",
    "match_confidence",
    "evidence_fields",
)
