"""How people move between clusters from term to term."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortline.functions import fill_unknown
from cohortline.sources.schemas import FLAG

# Support of a reported path and lengths of the reports.
MIN_SUPPORT = 20
TOP_PATHS = 10
HEAD_ROWS = 30

PATH = ("from_cluster", "from_cluster_name", "to_cluster", "to_cluster_name")


def transitions(assigned: DataFrame) -> DataFrame:
    """Each term paired with the student's next one; students with one term yield nothing.

    One window over the student's terms (bounded by the calendar), reading all next-term fields at once.
    """
    order = W.partitionBy("student_id").orderBy("term_order", "school_year", "semester")
    following = F.struct("school_year", "semester", "cluster", "cluster_name", "is_outlier", FLAG)
    paired = assigned.withColumn("_next", F.lead(following).over(order)).where(F.col("_next").isNotNull())
    return paired.select(
        "student_id",
        F.col("school_year").alias("from_school_year"),
        F.col("semester").alias("from_semester"),
        F.col("_next.school_year").alias("to_school_year"),
        F.col("_next.semester").alias("to_semester"),
        F.col("cluster").alias("from_cluster"),
        fill_unknown(F.col("cluster_name")).alias("from_cluster_name"),
        F.col("_next.cluster").alias("to_cluster"),
        fill_unknown(F.col("_next.cluster_name")).alias("to_cluster_name"),
        F.col("is_outlier").alias("from_is_outlier"),
        F.col("_next.is_outlier").alias("to_is_outlier"),
        F.col("avg_score").alias("from_avg_score"),
        F.col("fail_course_count").alias("from_fail_course_count"),
        F.col("internet_hours_sum").alias("from_internet_hours_sum"),
        "risk_label_next_term_numeric",
        F.col(f"_next.{FLAG}").alias("next_term_risk_event_current"),
    )


def transition_counts(paths: DataFrame) -> DataFrame:
    return paths.groupBy(*PATH).agg(F.count("*").alias("count"))


def transition_rates(counts: DataFrame) -> DataFrame:
    """Share of the from-cluster's transitions; the window runs over cells, not over transitions."""
    total = F.sum("count").over(W.partitionBy("from_cluster"))
    return counts.withColumn("row_total", total).withColumn("rate", F.col("count") / F.col("row_total"))


def transition_risk(paths: DataFrame) -> DataFrame:
    return paths.groupBy(*PATH).agg(
        F.count("student_id").alias("transition_count"),
        F.avg("risk_label_next_term_numeric").alias("next_term_risk_rate"),
        F.avg("next_term_risk_event_current").alias("next_term_risk_event_rate"),
        F.avg("from_avg_score").alias("from_avg_score_mean"),
        F.avg("from_fail_course_count").alias("from_fail_course_count_mean"),
        F.avg("from_internet_hours_sum").alias("from_internet_hours_sum_mean"),
    )


def term_cluster_counts(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy(
        "school_year", "semester", "cluster", fill_unknown(F.col("cluster_name")).alias("cluster_name")
    ).agg(F.count("*").alias("count"))


def stay_rate(paths: DataFrame) -> DataFrame:
    """Share of transitions that stay in their cluster; 0 without transitions."""
    stays = F.avg((F.col("from_cluster") == F.col("to_cluster")).cast("int"))
    return paths.agg(F.count("*").alias("transitions"), F.coalesce(stays, F.lit(0.0)).alias("same_cluster_rate"))


def min_support(risk: DataFrame, least: int = MIN_SUPPORT) -> DataFrame:
    return risk.where(F.col("transition_count") >= least)


def top_transitions(rates: DataFrame, limit: int = TOP_PATHS) -> DataFrame:
    return rates.orderBy(F.col("count").desc(), *PATH).limit(limit)


def top_risk_transitions(risk: DataFrame, least: int = MIN_SUPPORT, limit: int = TOP_PATHS) -> DataFrame:
    return min_support(risk, least).orderBy(F.col("next_term_risk_rate").desc_nulls_last(), *PATH).limit(limit)


def head_term_clusters(counts: DataFrame, limit: int = HEAD_ROWS) -> DataFrame:
    return counts.orderBy("school_year", "semester", "cluster", "cluster_name").limit(limit)
