"""Code lists, dictionaries and status words."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coded fields of the campus tables.
GENDER_CODES = {"男": 0, "女": 1}
SEMESTER_CODES = {"1": 0, "2": 1}
HIGH_RISK_TYPES = ("1", "3", "11", "13")
NOT_ENROLLED = "0"
NORMAL_EXAM = "01"
STUDENT_ROLE = "3"
AUC_TARGET = 0.80


def map_code(c: Column, codes: Mapping[str, int], default: int = 0) -> Column:
    """Dictionary look-up; values outside the dictionary, and NULL, give the default."""
    mapped = F.lit(default)
    for text, code in codes.items():
        mapped = F.when(c == text, code).otherwise(mapped)
    return mapped


def in_code_set(c: Column, codes: Iterable[str], flag: Column | None = None, flag_value: str = NOT_ENROLLED) -> Column:
    """Code is listed (case does not matter), or the flag has the given value; never NULL."""
    hit = F.coalesce(F.lower(c).isin([code.lower() for code in codes]), F.lit(False))
    if flag is not None:
        hit = hit | F.coalesce(flag == flag_value, F.lit(False))
    return hit


def threshold_status(value: Column, rank: Column, target: float = AUC_TARGET) -> Column:
    """OK or WARN against the target, marked BEST on rank 1."""
    status = F.when(value >= target, "OK").otherwise("WARN")
    return F.when(rank == 1, F.concat(status, F.lit(" BEST"))).otherwise(status)


def list_position(c: Column, ordered: Iterable[str], unknown: int = 999) -> Column:
    """Zero-based place in a fixed list, for sorting by that list."""
    place = F.array_position(F.array(*[F.lit(item) for item in ordered]), c) - 1
    return F.coalesce(F.when(place >= 0, place), F.lit(unknown)).cast("int")
