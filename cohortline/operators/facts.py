"""Facts per student and term, and everything that is joined onto them.

A fact frame has the key columns of ``TERM_KEY`` plus measures. The adapters at the top turn raw text
tables into fact frames; the aggregations below accept any fact frame.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortline.functions import (
    coalesce_dates,
    in_code_set,
    is_blank,
    join_codes,
    non_blank,
    normalize_id,
    number_of,
    round4,
    school_year_of,
    strip,
    term_of_date,
    term_of_plan,
    term_order,
    to_date_flexible,
    valid_score,
)
from cohortline.functions.codes import HIGH_RISK_TYPES, NORMAL_EXAM, STUDENT_ROLE
from cohortline.functions.numbers import PASS_MARK
from cohortline.sources.schemas import FLAG, LABEL, TERM_KEY

STRICT, LENIENT = "strict", "lenient"


def drop_blank_key(df: DataFrame, *keys: str) -> DataFrame:
    for key in keys:
        df = df.where(~is_blank(F.col(key)))
    return df


def role_filter(df: DataFrame, role: str = "ROLEID", keep: str = STUDENT_ROLE) -> DataFrame:
    return df.where(strip(F.col(role)) == keep)


def known_students(df: DataFrame, master: DataFrame, key: str = "student_id") -> DataFrame:
    return df.join(master.select(key), key, "left_semi")


# ---------------------------------------------------------------- raw tables to fact frames


def course_facts(raw: DataFrame, student: str = "XH", year: str = "KKXN", semester: str = "KKXQ") -> DataFrame:
    rows = raw.select(
        normalize_id(F.col(student)).alias("student_id"),
        non_blank(F.col(year)).alias("school_year"),
        non_blank(F.col(semester)).alias("semester"),
    )
    return rows.dropna(subset=list(TERM_KEY))


def score_facts(
    raw: DataFrame,
    student: str = "XH",
    plan: str = "ZXJXJHH",
    score: str = "KCCJ",
    gpa: str = "JDCJ",
    credit: str = "XF",
    resit: str = "CXBKBZ",
) -> DataFrame:
    rows = raw.select(
        normalize_id(F.col(student)).alias("student_id"),
        F.col(plan).alias("plan"),
        number_of(raw, score).alias("score"),
        number_of(raw, gpa).alias("gpa"),
        number_of(raw, credit).alias("credit"),
        F.col(resit).alias("resit"),
    ).dropna(subset=["student_id"])
    termed = evaluate_once(rows, "term", term_of_plan(F.col("plan"))).select(
        "student_id", "term.school_year", "term.semester", "score", "gpa", "credit", "resit"
    )
    return termed.dropna(subset=["school_year", "semester"])


def usage_facts(
    raw: DataFrame,
    student: str = "XSBH",
    month: str = "TJNY",
    hours: str = "SWLJSC",
    average: str = "XXPJZ",
    strict_serial: bool = False,
) -> DataFrame:
    rows = raw.select(
        normalize_id(F.col(student)).alias("student_id"),
        F.col(month).alias("month_text"),
        number_of(raw, hours).alias("hours"),
        number_of(raw, average).alias("school_average"),
    ).dropna(subset=["student_id"])
    dated = evaluate_once(rows, "day", to_date_flexible(F.col("month_text"), strict_serial)).dropna(subset=["day"])
    return with_term(dated, "day").drop("day", "month_text")


def status_facts(
    raw: DataFrame,
    student: str = "XH",
    dates: Sequence[str] = ("YDRQ", "SPRQ", "BY1"),
    type_code: str = "YDLBDM",
    reason_code: str = "YDYYDM",
    enrolled: str = "SFZX",
    high_risk: Sequence[str] = HIGH_RISK_TYPES,
) -> DataFrame:
    """High-risk status changes only; the code test comes before the date parsing."""
    risky = raw.where(in_code_set(strip(F.col(type_code)), high_risk, strip(F.col(enrolled))))
    names = [f"day_{i}" for i in range(len(dates))]
    rows = risky.select(
        normalize_id(F.col(student)).alias("student_id"),
        non_blank(F.col(type_code)).alias("type_code"),
        non_blank(F.col(reason_code)).alias("reason_code"),
        *[F.col(d).alias(name) for d, name in zip(dates, names, strict=True)],
    ).dropna(subset=["student_id"])
    dated = evaluate_once(rows, "day", coalesce_dates(*[F.col(name) for name in names])).dropna(subset=["day"])
    return with_term(dated, "day").drop("day", *names)


def fitness_facts(
    raw: DataFrame,
    student: str = "XH",
    year: str = "TCNF",
    score: str = "ZF",
    bmi: str = "BMI",
    ordinal: str = "ordinal",
) -> DataFrame:
    rows = raw.select(
        normalize_id(F.col(student)).alias("student_id"),
        school_year_of(strip(F.col(year))).alias("school_year"),
        number_of(raw, score).alias("fitness_score"),
        non_blank(F.col(bmi)).alias("bmi"),
        F.col(ordinal).alias("ordinal"),
    )
    return rows.dropna(subset=["student_id", "school_year"])


def evaluate_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column so that filters on it, and on what is derived from it, do not parse again.

    Spark copies an expression into every filter it pushes below a projection; it does not push below
    an explode, and this one has a single element.
    """
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def with_term(df: DataFrame, day: str) -> DataFrame:
    """Add the term of a date column, which may be a timestamp without zone."""
    term = term_of_date(F.col(day).cast("date"))
    return df.withColumns({"school_year": term["school_year"], "semester": term["semester"]})


# ---------------------------------------------------------------- aggregations per term


def score_measures(facts: DataFrame, rules: str = STRICT) -> DataFrame:
    """Apply the validity rules once, so that one set of aggregates serves both rule sets."""
    flagged = F.coalesce(non_blank(F.col("resit")) != NORMAL_EXAM, F.lit(False))
    if rules == STRICT:
        valid = F.coalesce(valid_score(F.col("score")), F.lit(False))
        counted, score = F.when(valid, 1), F.when(valid, F.col("score"))
        credit, resit = F.when(F.col("credit") > 0, F.col("credit")), F.when(valid & flagged, 1)
    elif rules == LENIENT:
        counted, score = F.lit(1), F.col("score")
        credit, resit = F.col("credit"), F.when(flagged, 1)
    else:
        raise ValueError(f"unknown rules: {rules}")
    return facts.select(
        *TERM_KEY,
        counted.alias("counted"),
        score.alias("score"),
        F.col("gpa"),
        credit.alias("credit"),
        resit.alias("resit"),
    )


def usage_measures(facts: DataFrame) -> DataFrame:
    return facts.select(
        *TERM_KEY,
        F.lit(1).alias("month"),
        F.col("hours"),
        (F.col("hours") - F.col("school_average")).alias("hours_gap"),
    )


def _or_zero(c: Column, kind: str = "bigint") -> Column:
    return F.coalesce(c, F.lit(0)).cast(kind)


def _score_sums() -> list[Column]:
    return [
        F.count("counted").alias("score_course_count"),
        F.avg("score").alias("_score_mean"),
        F.stddev_pop("score").alias("_score_std"),
        F.count_if(F.col("score") < PASS_MARK).alias("fail_course_count"),
        F.avg("gpa").alias("_gpa_mean"),
        F.sum("credit").alias("_credit_sum"),
        F.count("resit").alias("resit_exam_count"),
    ]


def _score_results() -> list[Column]:
    return [
        F.col("score_course_count"),
        round4(F.col("_score_mean")).alias("avg_score"),
        round4(F.col("_score_std")).alias("score_std"),
        F.col("fail_course_count"),
        round4(F.try_divide("fail_course_count", "score_course_count")).alias("fail_ratio"),
        round4(F.col("_gpa_mean")).alias("avg_gpa"),
        round4(_or_zero(F.col("_credit_sum"), "double")).alias("credit_sum"),
        F.col("resit_exam_count"),
    ]


def _usage_sums() -> list[Column]:
    return [
        F.count("month").alias("internet_month_count"),
        F.sum("hours").alias("_hours_sum"),
        F.sum("hours_gap").alias("_gap_sum"),
    ]


def _usage_results() -> list[Column]:
    """Both means divide by the months seen, not by the months with a value."""
    months, hours, gap = (
        F.col("internet_month_count"),
        _or_zero(F.col("_hours_sum"), "double"),
        _or_zero(F.col("_gap_sum"), "double"),
    )
    return [
        months,
        round4(hours).alias("internet_hours_sum"),
        round4(F.try_divide(hours, months)).alias("internet_hours_avg_per_month"),
        round4(F.try_divide(gap, months)).alias("internet_diff_mean"),
    ]


def course_counts(facts: DataFrame) -> DataFrame:
    return facts.groupBy(*TERM_KEY).agg(F.count("*").alias("selected_course_count"))


def score_stats(facts: DataFrame, rules: str = STRICT) -> DataFrame:
    """The additive state of the score columns, in one pass: counts, sum, sum of squares."""
    squares = F.col("score") * F.col("score")
    return (
        score_measures(facts, rules)
        .groupBy(*TERM_KEY)
        .agg(
            F.count("counted").alias("score_course_count"),
            F.count("score").alias("score_numeric_count"),
            round4(_or_zero(F.sum("score"), "double")).alias("score_sum"),
            round4(_or_zero(F.sum(squares), "double")).alias("score_sq_sum"),
            F.count_if(F.col("score") < PASS_MARK).alias("fail_course_count"),
            F.count("gpa").alias("gpa_count"),
            round4(_or_zero(F.sum("gpa"), "double")).alias("gpa_sum"),
            round4(_or_zero(F.sum("credit"), "double")).alias("credit_sum"),
            F.count("resit").alias("resit_exam_count"),
        )
    )


def score_finalise(facts: DataFrame, rules: str = STRICT) -> DataFrame:
    """Mean, population deviation (0 for one score, NULL for none), fail ratio and mean grade point."""
    sums = score_measures(facts, rules).groupBy(*TERM_KEY).agg(*_score_sums())
    return sums.select(*TERM_KEY, *_score_results())


def internet_stats(facts: DataFrame, keys: Sequence[str] = TERM_KEY) -> DataFrame:
    measures = facts.select(
        *keys,
        F.lit(1).alias("month"),
        F.col("hours"),
        (F.col("hours") - F.col("school_average")).alias("hours_gap"),
    )
    return measures.groupBy(*keys).agg(*_usage_sums()).select(*keys, *_usage_results())


def fitness_by_year(facts: DataFrame) -> DataFrame:
    """Mean fitness score and first BMI text per student and school year."""
    seen = F.when(F.col("bmi").isNotNull(), F.col("ordinal"))
    return facts.groupBy("student_id", "school_year").agg(
        F.count("fitness_score").alias("fitness_count"),
        round4(F.avg("fitness_score")).alias("physical_test_score"),
        F.min_by("bmi", seen).alias("physical_test_bmi"),
    )


def first_snapshot(
    df: DataFrame, key: str, value: str, ordinal: str, alias: str = "online_learning_bfb_snapshot"
) -> DataFrame:
    """First readable number per student."""
    rows = df.select(
        normalize_id(F.col(key)).alias("student_id"), number_of(df, value).alias("value"), F.col(ordinal)
    ).dropna(subset=["student_id", "value"])
    return rows.groupBy("student_id").agg(round4(F.min_by("value", ordinal)).alias(alias))


def risk_events(facts: DataFrame) -> DataFrame:
    """Flag and code sets per term. The sets are bounded by the code lists, not by the rows."""
    return facts.groupBy(*TERM_KEY).agg(
        F.max(F.lit(1)).alias(FLAG),
        join_codes(F.collect_set(F.lower("type_code"))).alias("risk_event_type_codes"),
        join_codes(F.collect_set(F.lower("reason_code"))).alias("risk_event_reason_codes"),
    )


# ---------------------------------------------------------------- term rows


def union_partials(*partials: DataFrame) -> DataFrame:
    """Rows of all sources under one set of columns; a source's missing measures are NULL."""
    union = partials[0]
    for partial in partials[1:]:
        union = union.unionByName(partial, allowMissingColumns=True)
    return union


def semester_skeleton(*partials: DataFrame, keys: Sequence[str] = TERM_KEY) -> DataFrame:
    """Full outer join of any number of per-term aggregates: a row exists as soon as one source has it."""
    union = union_partials(*partials)
    measures = [c for c in union.columns if c not in keys]
    return union.groupBy(*keys).agg(*[F.max(c).alias(c) for c in measures])


def term_rows(
    course: DataFrame, score: DataFrame, usage: DataFrame, status: DataFrame, rules: str = STRICT
) -> DataFrame:
    """One row per student and term with all measures, from one aggregation over the four facts.

    The facts are united before aggregating, so each is combined map-side and all share one exchange.
    Code sets would push that aggregation out of generated code; they are rare and joined on after.
    """
    measures = union_partials(
        course.select(*TERM_KEY, F.lit(1).alias("selected")),
        score_measures(score, rules),
        usage_measures(usage),
        status.select(*TERM_KEY, F.lit(1).alias("risk")),
    )
    sums = measures.groupBy(*TERM_KEY).agg(
        F.count("selected").alias("selected_course_count"),
        *_score_sums(),
        *_usage_sums(),
        _or_zero(F.max("risk"), "int").alias(FLAG),
    )
    rows = sums.select(*TERM_KEY, "selected_course_count", *_score_results(), *_usage_results(), FLAG)
    return rows.join(risk_events(status).drop(FLAG), list(TERM_KEY), "left")


def with_term_order(df: DataFrame, rules: str = STRICT) -> DataFrame:
    order = term_order(F.col("school_year"), F.col("semester"), malformed_as_zero=rules == LENIENT)
    return df.withColumn("term_order", order)


def with_profile(rows: DataFrame, profile: DataFrame) -> DataFrame:
    """Left join on the student; Spark broadcasts the profile only when it is measured to be small."""
    return rows.join(profile, "student_id", "left")


def with_snapshot(rows: DataFrame, snapshot: DataFrame) -> DataFrame:
    return rows.join(snapshot, "student_id", "left")


def with_yearly(rows: DataFrame, yearly: DataFrame) -> DataFrame:
    """Fitness of the school year; both fields only when at least one score was numeric."""
    scored = yearly.where(F.col("fitness_count") > 0).drop("fitness_count")
    return rows.join(scored, ["student_id", "school_year"], "left")


def student_card(profile: DataFrame, snapshot: DataFrame, yearly: DataFrame) -> DataFrame:
    """Everything known per student in one row, the years as a map.

    The term rows then meet one table on one key: a single exchange by student serves the profile, the
    snapshot, the yearly values and the next-term window.
    """
    by_year = (
        yearly.where(F.col("fitness_count") > 0)
        .groupBy("student_id")
        .agg(
            F.map_from_entries(
                F.collect_list(
                    F.struct("school_year", F.struct("physical_test_score", "physical_test_bmi").alias("fitness"))
                )
            ).alias("fitness")
        )
    )
    return profile.join(snapshot, "student_id", "left").join(by_year, "student_id", "left")


def next_term_label(df: DataFrame, flag: str = FLAG, label: str = LABEL, calendar: bool = False) -> DataFrame:
    """Flag of the student's next existing row; NULL on the last one.

    ``calendar`` labels a row only when that next row is the very next term.
    """
    order = W.partitionBy("student_id").orderBy("term_order", "school_year", "semester")
    following = F.lead(flag).over(order)
    if calendar:
        step = F.when(F.col("semester") == "1", 1).otherwise(9)
        following = F.when(F.lead("term_order").over(order) - F.col("term_order") == step, following)
    return df.withColumn(label, following.cast("int"))
