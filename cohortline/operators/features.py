"""From semester rows to model input: typed columns, splits, fitted statistics, encodings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortline.functions import fill_unknown, log1p_clip, parse_ratio_pair, signed_log1p
from cohortline.operators.ordering import exact_quantiles, key_at, present, running_totals
from cohortline.sources.schemas import (
    CATEGORICAL_FEATURES,
    FLAG,
    ID_COLUMNS,
    LABEL,
    LOG_FEATURES,
    NUMERIC_FEATURES,
    SIGNED_LOG_FEATURES,
)

# School years of the splits.
POOL_YEARS = ("2020-2021", "2021-2022", "2022-2023", "2023-2024")
SPLIT_YEARS = {
    "train": ("2020-2021", "2021-2022"),
    "valid": ("2022-2023",),
    "test": ("2023-2024",),
}
BASELINE_YEARS = {"train": ("2020-2021", "2021-2022", "2022-2023"), "test": ("2023-2024",)}


def typed_features(base: DataFrame) -> DataFrame:
    """BMI text to height and weight, categories without gaps."""
    pair = parse_ratio_pair(F.col("physical_test_bmi"))
    return base.withColumns(
        {
            "bmi_height_cm": pair["height_cm"],
            "bmi_weight_kg": pair["weight_kg"],
            **{c: fill_unknown(F.col(c)) for c in CATEGORICAL_FEATURES},
        }
    )


def select_features(
    df: DataFrame,
    ids: Sequence[str] = ID_COLUMNS,
    numeric: Sequence[str] = NUMERIC_FEATURES,
    categorical: Sequence[str] = CATEGORICAL_FEATURES,
) -> DataFrame:
    """Ids, current flag, features and label, each column once."""
    return df.select(*dict.fromkeys([*ids, FLAG, *numeric, *categorical, LABEL]))


def labelled_only(df: DataFrame, label: str = LABEL) -> DataFrame:
    return df.where(F.col(label).isNotNull()).withColumn(label, F.col(label).cast("int"))


def pool(df: DataFrame, years: Sequence[str] = POOL_YEARS) -> DataFrame:
    return df.where(F.col("school_year").isin(*years))


def year_split(df: DataFrame, years: Mapping[str, Sequence[str]] = SPLIT_YEARS) -> DataFrame:
    """Name the split of each row by school year and drop the other years.

    The filter is a plain list of years, so it prunes a table partitioned by ``school_year``.
    """
    every = [year for group in years.values() for year in group]
    name = F.lit(None).cast("string")
    for split, group in years.items():
        name = F.when(F.col("school_year").isin(*group), split).otherwise(name)
    return df.where(F.col("school_year").isin(*every)).withColumn("split", name)


def require_splits(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Stop when a split is empty."""
    for name in names:
        if df.where(F.col("split") == name).isEmpty():
            raise ValueError(f"split is empty: {name}")
    return df


def last_term(df: DataFrame) -> DataFrame:
    """Last row per student. The window groups one student's terms, which a calendar bounds."""
    latest = W.partitionBy("student_id").orderBy(
        F.col("term_order").desc(), F.col("school_year").desc(), F.col("semester").desc()
    )
    return df.withColumn("_rank", F.row_number().over(latest)).where("_rank = 1").drop("_rank")


# ---------------------------------------------------------------- fitted statistics


def column_medians(df: DataFrame, columns: Sequence[str] = NUMERIC_FEATURES) -> DataFrame:
    return exact_quantiles(df, columns, [0.5]).select("feature", "n", F.col("q0").alias("median"))


def mean_std(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean and population deviation per column, from one pass over the wide rows."""
    sums = df.agg(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.count(present(c)).alias("n"),
                F.avg(present(c)).alias("mean"),
                F.stddev_pop(present(c)).alias("std"),
            ).alias(f"_{i}")
            for i, c in enumerate(columns)
        ]
    )
    return sums.select(F.inline(F.array(*[f"_{i}" for i in range(len(columns))])))


def _value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    texts = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    return (
        texts.unpivot([], list(columns), "feature", "value")
        .where(F.col("value").isNotNull())
        .groupBy("feature", "value")
        .agg(F.count("*").alias("n"))
    )


def category_codes(df: DataFrame, columns: Sequence[str] = CATEGORICAL_FEATURES) -> DataFrame:
    """Zero-based code of each category in text order, per column; fit once, then join.

    The rows are counted first, so the window ranks different categories, not rows.
    """
    code = F.row_number().over(W.partitionBy("feature").orderBy("value")) - 1
    return _value_counts(df, columns).select("feature", "value", code.cast("int").alias("code"), "n")


def category_cardinality(
    df: DataFrame, columns: Sequence[str] = CATEGORICAL_FEATURES, approximate: bool = False
) -> DataFrame:
    if approximate:
        counts = df.agg(
            *[
                F.struct(F.lit(c).alias("feature"), F.approx_count_distinct(c).alias("distinct_values")).alias(f"_{i}")
                for i, c in enumerate(columns)
            ]
        )
        return counts.select(F.inline(F.array(*[f"_{i}" for i in range(len(columns))])))
    return _value_counts(df, columns).groupBy("feature").agg(F.count("*").alias("distinct_values"))


def fitted_values(stats: DataFrame, value: str) -> dict[str, float | None]:
    """A fitted (feature, value) table as numbers of the plan: one per column, so always small.

    As literals they cost nothing per row; as subqueries Spark would plan the fit once per column.
    """
    return {row["feature"]: row[value] for row in stats.select("feature", value).collect()}


# ---------------------------------------------------------------- applying them


def fill_medians(df: DataFrame, medians: DataFrame, columns: Sequence[str]) -> DataFrame:
    fitted = fitted_values(medians, "median")
    return df.withColumns({c: F.coalesce(present(c), F.lit(fitted[c]).cast("double")) for c in columns})


def encode_features(
    df: DataFrame,
    medians: DataFrame,
    codes: DataFrame,
    ids: Sequence[str] = ID_COLUMNS,
    numeric: Sequence[str] = NUMERIC_FEATURES,
    categorical: Sequence[str] = CATEGORICAL_FEATURES,
) -> DataFrame:
    """Median fill, logarithms, category codes; ids first, then categories, then numbers.

    A category equal to an id column (semester) keeps the id's text in ``<name>`` and its code in
    ``<name>_code``, like every other category. A value not seen in fitting gets -1.
    """
    filled = fill_medians(df, medians, numeric)
    numbers: list[Column] = []
    for c in numeric:
        value = F.col(c)
        if c in LOG_FEATURES:
            value = log1p_clip(value)
        elif c in SIGNED_LOG_FEATURES:
            value = signed_log1p(value)
        numbers.append(value.alias(c))
    coded = filled
    for c in categorical:
        table = codes.where(F.col("feature") == c).select(
            F.col("value").alias(f"_{c}"), F.col("code").alias(f"{c}_code")
        )
        coded = coded.join(table, fill_unknown(F.col(c)) == F.col(f"_{c}"), "left")
    return coded.select(
        *ids, *[F.coalesce(f"{c}_code", F.lit(-1)).alias(f"{c}_code") for c in categorical], *numbers
    )


def standardize(df: DataFrame, stats: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / population deviation; a column that was constant in fitting is only centred (gives 0 there)."""
    fitted = {row["feature"]: (row["mean"], row["std"]) for row in stats.collect()}
    scaled = {}
    for c in columns:
        mean, std = fitted[c]
        scaled[c] = (F.col(c).cast("double") - F.lit(mean).cast("double")) / F.lit(std or 1.0)
    return df.withColumns(scaled)


# ---------------------------------------------------------------- row splits


def row_digest(keys: Sequence[str], seed: int) -> Column:
    """Hash of the row key and a seed: a random-looking order that survives repartitioning and retries."""
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))


def stratified_split(
    df: DataFrame, label: str, keys: Sequence[str], test_share: float = 0.2, seed: int = 42
) -> DataFrame:
    """In each class the first ``ceil(share * n)`` rows by hash are the test rows; rows without a label are a class, too.

    A class may be nearly all of the table, so it is never ranked in one task: the hashes are ordered in blocks.
    """
    names = {"_no_class": F.col(label).isNull(), "_class": F.coalesce(F.col(label).cast("string"), F.lit(""))}
    hashed = df.withColumns(names | {"_hash": row_digest(keys, seed), "_one": F.lit(1)})
    sizes = hashed.groupBy(*names).agg(F.ceil(F.count("*") * F.lit(float(test_share))).alias("_quota"))
    placed = running_totals(hashed, ["_hash"], ["_one"], by=list(names))
    return placed.join(sizes, list(names)).select(
        *df.columns, F.when(F.col("_one_before") < F.col("_quota"), "test").otherwise("train").alias("split")
    )


def ordered_split(df: DataFrame, order: Sequence[str], first_share: float = 0.9) -> DataFrame:
    """The first rows by position are for training, the rest for validation.

    Only the key columns are ordered, to find the row at the cut; the full rows are compared with it.
    """
    cut = key_at(df, order, first_share)
    before = F.coalesce(F.struct(*order) < cut, F.lit(True))
    return df.withColumn("split", F.when(before, "train").otherwise("valid"))
