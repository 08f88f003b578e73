"""Splits, fitted statistics and encodings of the semester table, and input noise."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.functions import half_even
from cohortline.operators import features, noise
from cohortline.sources import reports
from cohortline.sources.schemas import (
    CATEGORICAL_FEATURES,
    FLAG,
    ID_COLUMNS,
    LABEL,
    LOG_FEATURES,
    NUMERIC_FEATURES,
    SIGNED_LOG_FEATURES,
)
from cohortline.workload.campus import POOL_YEARS, SPLIT_YEARS, SQL_BASE, TIE_SHIFT, Campus, r6
from cohortline.workload.registry import query

IDS = ", ".join(ID_COLUMNS)
SELECTED = tuple(dict.fromkeys([*ID_COLUMNS, FLAG, *NUMERIC_FEATURES, *CATEGORICAL_FEATURES, LABEL]))


def _years(years: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{y}'" for y in years) + ")"


_SPLIT_CASE = " ".join(f"WHEN school_year IN {_years(group)} THEN '{name}'" for name, group in SPLIT_YEARS.items())
_FILLED = ", ".join(f"coalesce({c}, 'UNKNOWN') AS {c}" for c in CATEGORICAL_FEATURES if c != "semester")

SQL_FEATURES = f"""{SQL_BASE},
features AS (
  SELECT * REPLACE ({_FILLED}),
    TRY_CAST(split_part(physical_test_bmi, ' / ', 1) AS DOUBLE) AS bmi_height_cm,
    TRY_CAST(split_part(physical_test_bmi, ' / ', 2) AS DOUBLE) AS bmi_weight_kg
  FROM base),
pool AS (SELECT * FROM features WHERE school_year IN {_years(POOL_YEARS)}),
split AS (SELECT *, CASE {_SPLIT_CASE} END AS split FROM features WHERE CASE {_SPLIT_CASE} END IS NOT NULL)"""


def feature_rows(c: Campus) -> DataFrame:
    """Straight from the sources."""
    return features.select_features(features.typed_features(c.base))


def feature_table(c: Campus) -> DataFrame:
    """From the written semester table, for queries that read it more than once."""
    return features.select_features(features.typed_features(c.base_table))


def pool(c: Campus) -> DataFrame:
    return features.pool(feature_table(c), POOL_YEARS)


def rounded(df: DataFrame, *columns: str, shift: float = TIE_SHIFT) -> DataFrame:
    return df.withColumns({c: half_even(F.col(c) + F.lit(shift), 6) for c in columns})


@query(f"{SQL_FEATURES} SELECT {', '.join(SELECTED)} FROM features")
def select_features(c: Campus) -> DataFrame:
    return feature_rows(c)


@query(f"{SQL_FEATURES} SELECT {IDS}, {LABEL} FROM features WHERE {LABEL} IS NOT NULL")
def labelled_only(c: Campus) -> DataFrame:
    return features.labelled_only(feature_rows(c)).select(*ID_COLUMNS, LABEL)


@query(f"{SQL_FEATURES} SELECT {IDS}, split FROM split")
def year_split(c: Campus) -> DataFrame:
    return features.year_split(feature_rows(c), SPLIT_YEARS).select(*ID_COLUMNS, "split")


@query(f"""{SQL_FEATURES} SELECT split, count(*) AS row_count, count(*) FILTER (WHERE {LABEL} = 1) AS positive_rows
FROM split WHERE {LABEL} IS NOT NULL GROUP BY split""")
def split_report(c: Campus) -> DataFrame:
    return reports.split_report(features.year_split(features.labelled_only(feature_rows(c)), SPLIT_YEARS))


@query(f"""{SQL_FEATURES} SELECT {', '.join(SELECTED)} FROM features
QUALIFY row_number() OVER (PARTITION BY student_id ORDER BY term_order DESC, school_year DESC, semester DESC) = 1""")
def last_term(c: Campus) -> DataFrame:
    return features.last_term(feature_rows(c))


# ---------------------------------------------------------------- fitted statistics


def _per_column(template: str, columns: tuple[str, ...], table: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS feature, {template.format(c=c)} FROM {table}" for c in columns)


@query(f"{SQL_FEATURES} {_per_column(f'count({{c}}) AS n, {r6("median({c})")} AS median', NUMERIC_FEATURES, 'pool')}")
def column_medians(c: Campus) -> DataFrame:
    return rounded(features.column_medians(pool(c)), "median")


_STATS = f"count({{c}}) AS n, {r6('avg({c})')} AS mean, {r6('stddev_pop({c})')} AS std"


@query(f"{SQL_FEATURES} {_per_column(_STATS, NUMERIC_FEATURES, 'pool')}")
def mean_std(c: Campus) -> DataFrame:
    return rounded(features.mean_std(pool(c), NUMERIC_FEATURES), "mean", "std")


def _codes_sql(table: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {c} AS value, CAST(row_number() OVER (ORDER BY {c}) - 1 AS INTEGER) AS code, "
        f"count(*) AS n FROM {table} GROUP BY {c}"
        for c in CATEGORICAL_FEATURES
    )


@query(f"{SQL_FEATURES} {_codes_sql('pool')}")
def category_codes(c: Campus) -> DataFrame:
    return features.category_codes(pool(c))


@query(f"{SQL_FEATURES} {_per_column('count(DISTINCT {c}) AS distinct_values', CATEGORICAL_FEATURES, 'pool')}")
def category_cardinality(c: Campus) -> DataFrame:
    return features.category_cardinality(pool(c))


def _encoded_number(c: str) -> str:
    filled = f"coalesce({c}, (SELECT median({c}) FROM pool))"
    if c in LOG_FEATURES:
        filled = f"CASE WHEN {filled} IS NOT NULL THEN ln(1 + greatest({filled}, 0)) END"
    elif c in SIGNED_LOG_FEATURES:
        filled = f"sign({filled}) * ln(1 + abs({filled}))"
    return f"{r6(filled)} AS {c}"


_CODE_COLUMNS = ", ".join(
    f"coalesce((SELECT code FROM codes WHERE feature = '{c}' AND value = f.{c}), -1) AS {c}_code" for c in CATEGORICAL_FEATURES
)


@query(f"""{SQL_FEATURES}, codes AS ({_codes_sql("pool")})
SELECT {IDS}, {_CODE_COLUMNS}, {", ".join(_encoded_number(c) for c in NUMERIC_FEATURES)} FROM features f""")
def encode_features(c: Campus) -> DataFrame:
    """Fitted on the pool, applied to every row: later years may hold unseen categories."""
    fitted = pool(c)
    encoded = features.encode_features(feature_table(c), features.column_medians(fitted), features.category_codes(fitted))
    return rounded(encoded, *NUMERIC_FEATURES)


_SCALED = ", ".join(
    f"{r6(f'({c} - (SELECT avg({c}) FROM pool)) / coalesce(nullif((SELECT stddev_pop({c}) FROM pool), 0), 1)')} AS {c}"
    for c in NUMERIC_FEATURES
)


@query(f"{SQL_FEATURES} SELECT {IDS}, {_SCALED} FROM features")
def standardize(c: Campus) -> DataFrame:
    stats = features.mean_std(pool(c), NUMERIC_FEATURES)
    scaled = features.standardize(feature_table(c), stats, NUMERIC_FEATURES)
    return rounded(scaled, *NUMERIC_FEATURES).select(*ID_COLUMNS, *NUMERIC_FEATURES)


@query(f"""{SQL_FEATURES},
ranked AS (
  SELECT {IDS}, {LABEL}, row_number() OVER (PARTITION BY {LABEL} ORDER BY md5(concat_ws('|', student_id, school_year, semester, '42'))) AS rn,
    count(*) OVER (PARTITION BY {LABEL}) AS n
  FROM features WHERE {LABEL} IS NOT NULL)
SELECT {IDS}, {LABEL}, CASE WHEN rn <= ceil(n * CAST(0.2 AS DOUBLE)) THEN 'test' ELSE 'train' END AS split FROM ranked""")
def stratified_split(c: Campus) -> DataFrame:
    rows = features.labelled_only(feature_table(c)).select(*ID_COLUMNS, LABEL)
    return features.stratified_split(rows, LABEL, ["student_id", "school_year", "semester"])


@query(f"""{SQL_FEATURES},
ranked AS (
  SELECT {IDS}, row_number() OVER (ORDER BY student_id, term_order, school_year, semester) - 1 AS place, count(*) OVER () AS n FROM pool)
SELECT {IDS}, CASE WHEN place < floor(n * CAST(0.9 AS DOUBLE)) THEN 'train' ELSE 'valid' END AS split FROM ranked""")
def ordered_split(c: Campus) -> DataFrame:
    rows = pool(c).select(*ID_COLUMNS)
    return features.ordered_split(rows, ["student_id", "term_order", "school_year", "semester"])


# ---------------------------------------------------------------- noise

NOISY = ("avg_score", "score_std", "fail_ratio", "avg_gpa", "credit_sum", "internet_hours_sum", "physical_test_score", "bmi_height_cm", "bmi_weight_kg")
_ROW = "student_id, '|', school_year, '|', semester"


def _draw(name: str, i: int) -> str:
    digest = f"sha256(concat({_ROW}, '|42.{name}.{i // 8}'))"
    return f"((CAST(concat('0x', substr({digest}, {1 + 8 * (i % 8)}, 8)) AS BIGINT) + 0.5::DOUBLE) / {16**8}.0::DOUBLE)"


def _masked(i: int, c: str) -> str:
    normal = f"sqrt(-2.0::DOUBLE * ln({_draw('radius', i)})) * cos(2.0::DOUBLE * {math.pi!r}::DOUBLE * {_draw('angle', i)})"
    return f"{r6(f'CASE WHEN {_draw("mask", i)} < 0.25 THEN 0.0::DOUBLE ELSE {c} END + {normal} * 0.05::DOUBLE')} AS {c}"


@query(f"{SQL_FEATURES} SELECT {IDS}, {', '.join(_masked(i, c) for i, c in enumerate(NOISY))} FROM pool")
def mask_noise(c: Campus) -> DataFrame:
    noisy = noise.mask_noise(pool(c).select(*ID_COLUMNS, *NOISY), ["student_id", "school_year", "semester"], NOISY)
    return rounded(noisy, *NOISY)


def _swapped(i: int, c: str) -> str:
    donor = f"(SELECT d.{c} FROM ring d WHERE d.place = (r.place + 1 + {i} % (r.n - 1)) % r.n)"
    return f"CASE WHEN {_draw('swap', i)} < 0.3 THEN {donor} ELSE {c} END AS {c}"


@query(f"""{SQL_FEATURES},
ring AS (SELECT *, row_number() OVER (ORDER BY sha256(concat({_ROW}, '|42.order'))) - 1 AS place, count(*) OVER () AS n FROM pool)
SELECT {IDS}, {", ".join(_swapped(i, c) for i, c in enumerate(NOISY))} FROM ring r""")
def swap_noise(c: Campus) -> DataFrame:
    return noise.swap_noise(pool(c).select(*ID_COLUMNS, *NOISY), ["student_id", "school_year", "semester"], NOISY)
