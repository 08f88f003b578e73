"""Dates in mixed notations, and the school calendar built on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortline.functions.numbers import NUMBER_PATTERN, to_double
from cohortline.functions.text import strip

# Notations, serial-day origin and range, calendar months.
COMPACT_DATE = r"^\d{8}$"
COMPACT_MONTH = r"^(19|20)\d{2}(0[1-9]|1[0-2])$"
FREE_FORMS = (
    "yyyy-M-d[ H:m[:s]]",
    "yyyy-M-d'T'H:m[:s]",
    "yyyy/M/d[ H:m[:s]]",
    "M/d/yyyy[ H:m[:s]]",
    "yyyy-M",
    "yyyy/M",
)
SERIAL_ORIGIN = "1899-12-30"
SERIAL_MIN, SERIAL_MAX = -657434, 2958465
SCHOOL_YEAR_PATTERN = r"^\d{4}-\d{4}$"
PLAN_PATTERN = r"^(\d{4}-\d{4})-(\d)$"
MONTHS_BEFORE_YEAR = 7
AUTUMN_MONTHS = 6


def to_date_flexible(c: Column, strict_serial: bool = False) -> Column:
    """Eight digits as yyyyMMdd without fall-through, other numbers as spreadsheet days, else free form.

    Six digits that read as a month are taken as yyyyMM; ``strict_serial`` treats them as a day number.
    """
    text = strip(c)
    day = to_double(c).try_cast("int")
    serial = F.when(
        day.between(SERIAL_MIN, SERIAL_MAX), F.date_add(F.lit(SERIAL_ORIGIN).cast("date"), day)
    )
    parsed = F.when(text.rlike(COMPACT_DATE), F.try_to_date(text, "yyyyMMdd"))
    if not strict_serial:
        parsed = parsed.when(text.rlike(COMPACT_MONTH), F.try_to_date(text, "yyyyMM"))
    return parsed.when(text.rlike(NUMBER_PATTERN), serial).otherwise(
        F.coalesce(*[F.try_to_date(text, form) for form in FREE_FORMS])
    )


def coalesce_dates(*columns: Column, strict_serial: bool = False) -> Column:
    """First column that holds a readable date."""
    return F.coalesce(*[to_date_flexible(c, strict_serial) for c in columns])


def term_of_date(d: Column) -> Column:
    """School year and semester of a date. The year turns in August, and January closes semester 1.

    Moved back seven months, the school year is the calendar year and semester 1 is its first half.
    """
    moved = F.add_months(d, -MONTHS_BEFORE_YEAR)
    start = F.year(moved)
    return F.struct(
        F.concat(start.cast("string"), F.lit("-"), (start + 1).cast("string")).alias("school_year"),
        F.when(F.month(moved) <= AUTUMN_MONTHS, "1").when(d.isNotNull(), "2").alias("semester"),
    )


def term_of_plan(c: Column) -> Column:
    """``2020-2021-1`` to school year and semester; the text is not trimmed first."""
    return F.struct(
        F.nullif(F.regexp_extract(c, PLAN_PATTERN, 1), F.lit("")).alias("school_year"),
        F.nullif(F.regexp_extract(c, PLAN_PATTERN, 2), F.lit("")).alias("semester"),
    )


def term_order(year: Column, semester: Column, malformed_as_zero: bool = False) -> Column:
    """Start year times ten plus semester; a malformed year gives -1 (or counts as year 0)."""
    number = semester.try_cast("int")
    start = year.substr(1, 4).try_cast("int")
    fallback = number if malformed_as_zero else F.lit(-1)
    return F.when(year.rlike(SCHOOL_YEAR_PATTERN), start * 10 + number).otherwise(fallback)


def school_year_of(y: Column) -> Column:
    """Four-digit year text to ``y-(y+1)``, else NULL."""
    year = F.nullif(F.regexp_extract(y, r"^\d{4}$", 0), F.lit(""))
    return F.concat(year, F.lit("-"), (year.try_cast("int") + 1).cast("string"))
