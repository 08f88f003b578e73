"""Numbers, clean or held as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortline.functions.text import strip

# The text forms that count as numbers.
NUMBER_PATTERN = r"^[+-]?([0-9][0-9,]*(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
RATIO_PATTERN = r"^\s*(\d+(?:\.\d+)?)\s*/\s*(\d+(?:\.\d+)?)\s*$"
SCORE_MIN, SCORE_MAX, PASS_MARK = 0, 100, 60


def to_double(c: Column) -> Column:
    """Parse text as a number, else NULL. The guard keeps out ``1d`` and ``NaN``, which a bare cast takes."""
    number = F.regexp_extract(strip(c), NUMBER_PATTERN, 0)
    return F.replace(number, F.lit(","), F.lit("")).try_cast("double")


def number_of(df: DataFrame, name: str) -> Column:
    """A numeric column as it is (NaN is missing), a text column through ``to_double``: typed tables skip the parsing."""
    if isinstance(df.schema[name].dataType, T.NumericType):
        number = F.col(name).cast("double")
        return F.when(~F.isnan(number), number)
    return to_double(F.col(name))


def half_even(c: Column, digits: int) -> Column:
    """Scale, round half to even, scale back. ``bround`` goes through decimal text, is slower, and differs
    where the scaled double is not exactly a half. Adding zero turns -0.0 into 0.0."""
    power = float(10**digits)
    return F.rint(c.cast("double") * power) / power + F.lit(0.0)


def round4(c: Column) -> Column:
    return half_even(c, 4)


def valid_score(c: Column) -> Column:
    return c.between(SCORE_MIN, SCORE_MAX)


def log1p_clip(c: Column) -> Column:
    """log(1 + max(x, 0)); NULL stays NULL although ``greatest`` alone would skip it."""
    return F.when(c.isNotNull(), F.log1p(F.greatest(c.cast("double"), F.lit(0.0))))


def signed_log1p(c: Column) -> Column:
    return F.signum(c) * F.log1p(F.abs(c))


def parse_ratio_pair(c: Column, names: tuple[str, str] = ("height_cm", "weight_kg")) -> Column:
    """``"170 / 60"`` to a struct of two numbers; both NULL when the text has another form."""
    return F.struct(
        *[
            F.regexp_extract(c, RATIO_PATTERN, i).try_cast("double").alias(name)
            for i, name in enumerate(names, start=1)
        ]
    )
