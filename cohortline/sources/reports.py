"""Small reports over large tables; each is one aggregation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.functions import non_blank, normalize_id
from cohortline.sources.schemas import FLAG, LABEL


def distinct_values(df: DataFrame, column: str, ordinal: str) -> DataFrame:
    """Normalised value and the first raw value seen for it."""
    raw = non_blank(F.col(column))
    return (
        df.select(normalize_id(F.col(column)).alias("value_norm"), raw.alias("value_raw"), F.col(ordinal))
        .where(F.col("value_norm").isNotNull())
        .groupBy("value_norm")
        .agg(F.min_by("value_raw", ordinal).alias("value_raw"))
    )


def build_report(base: DataFrame) -> DataFrame:
    """Rows, students, rows at risk and labelled rows.

    Counting per student first keeps every step a partial aggregation, however many rows one student has.
    """
    per_student = base.groupBy("student_id").agg(
        F.count("*").alias("n"),
        F.count_if(F.col(FLAG) == 1).alias("at_risk"),
        F.count(LABEL).alias("labelled"),
    )
    return per_student.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.count("*").alias("unique_students"),
        F.coalesce(F.sum("at_risk"), F.lit(0)).alias("current_risk_rows"),
        F.coalesce(F.sum("labelled"), F.lit(0)).alias("labelled_rows"),
    )


def split_report(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Rows and positive labels per split."""
    return df.groupBy("split").agg(
        F.count("*").alias("row_count"), F.count_if(F.col(label) == 1).alias("positive_rows")
    )


def run_summary(reports: Mapping[str, DataFrame], settings: Mapping[str, str | int | float | Sequence[str]]) -> DataFrame:
    """One row: the settings, and each (small) report as a list of structs."""
    spark = next(iter(reports.values())).sparkSession
    values: list[Column] = [
        F.array(*[F.lit(v) for v in value]).alias(name)
        if isinstance(value, (list, tuple))
        else F.lit(value).alias(name)
        for name, value in settings.items()
    ]
    for name, report in reports.items():
        rows = report.agg(F.collect_list(F.struct(*report.columns)).alias(name))
        values.append(rows.scalar().alias(name))
    return spark.range(1).select(*values)
