"""Names for clusters, chosen from their profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortline.functions import list_position
from cohortline.operators.clusters import OUTLIER, cluster_profile

# Persona names in report order.
EXCELLENT = "卓越稳健型"
STEADY = "稳定中坚型"
ACTIVE_RISK = "行为活跃风险型"
WEAK_FITNESS = "体能薄弱波动型"
WARNING = "学业预警型"
EXTREME = "极端异常预警型"
PERSONA_ORDER = (EXCELLENT, STEADY, ACTIVE_RISK, WEAK_FITNESS, WARNING, EXTREME)


def _up(name: str) -> Column:
    return F.col(name).asc_nulls_last()


def _down(name: str) -> Column:
    return F.col(name).desc_nulls_last()


BY_STRENGTH = (_down, "avg_score_mean"), (_down, "physical_test_score_mean"), (_up, "fail_course_count_mean")
BY_WEAK_SCORE = (_up, "avg_score_mean"), (_down, "fail_course_count_mean")
BY_RISK = (_down, "next_term_risk_rate"), (_down, "internet_hours_sum_mean"), (_up, "physical_test_score_mean")
BY_WEAK_FITNESS = (_up, "physical_test_score_mean"), (_down, "next_term_risk_rate")


def choose_personas(profile: DataFrame) -> DataFrame:
    """One persona per inlier cluster, from at least one row per cluster (columns ``cluster``, ``mode_name``).

    Best and weakest scores are picked first, then the riskiest of the rest, then the steadiest and the
    least fit of what remains (the least fit wins if both fall on one cluster, unless it is the only
    one left); all others are steady. The windows span the whole input, which has one row per cluster.
    """

    def first(order: tuple, taken: Column | None) -> Column:
        keys = [direction(name) for direction, name in order]
        free_first = [] if taken is None else [taken.cast("int")]
        rank = F.row_number().over(W.orderBy(*free_first, *keys, F.col("cluster")))
        return (rank == 1) if taken is None else (rank == 1) & ~taken

    ends = profile.withColumns({"_best": first(BY_STRENGTH, None), "_worst": first(BY_WEAK_SCORE, None)})
    ends = ends.withColumn("_taken", F.col("_best") | F.col("_worst"))
    risky = ends.withColumn("_risky", first(BY_RISK, F.col("_taken")))
    risky = risky.withColumn("_taken", F.col("_taken") | F.col("_risky"))
    left = F.count_if(~F.col("_taken")).over(W.partitionBy())
    last = risky.withColumns(
        {"_weak": first(BY_WEAK_FITNESS, F.col("_taken")), "_left": left}
    )
    name = (
        F.when(F.col("_weak") & (F.col("_left") > 1), WEAK_FITNESS)
        .when(~F.col("_taken"), STEADY)
        .when(F.col("_worst"), WARNING)
        .when(F.col("_risky"), ACTIVE_RISK)
        .otherwise(EXCELLENT)
    )
    return last.select("cluster", name.alias("mode_name"))


def unfilled_roles(personas: DataFrame) -> DataFrame:
    """Persona names that no cluster took (possible with fewer than five clusters)."""
    every = personas.sparkSession.createDataFrame([(n,) for n in PERSONA_ORDER[:-1]], "mode_name string")
    return every.join(personas.select("mode_name"), "mode_name", "left_anti")


def persona_labels(personas: DataFrame) -> DataFrame:
    """Cluster dictionary with the row of the outliers appended."""
    extreme = personas.sparkSession.createDataFrame([(OUTLIER, EXTREME)], "cluster int, mode_name string")
    return personas.select(F.col("cluster").cast("int").alias("cluster"), "mode_name").union(extreme)


def unassigned_clusters(clusters: DataFrame, personas: DataFrame) -> DataFrame:
    return clusters.select("cluster").distinct().join(personas, "cluster", "left_anti")


def apply_personas(students: DataFrame, personas: DataFrame) -> DataFrame:
    """Persona per row: outliers are extreme, clusters without a persona are steady."""
    named = students.join(personas.select("cluster", "mode_name"), "cluster", "left")
    return named.withColumn(
        "mode_name",
        F.when(F.col("cluster") == OUTLIER, EXTREME).otherwise(F.coalesce("mode_name", F.lit(STEADY))),
    )


def persona_summary(named: DataFrame) -> DataFrame:
    return order_by_list(cluster_profile(named, by="mode_name", outliers=False))


def order_by_list(df: DataFrame, column: str = "mode_name", order: tuple[str, ...] = PERSONA_ORDER) -> DataFrame:
    return df.orderBy(list_position(F.col(column), order), column)
