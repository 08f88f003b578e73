"""Identifiers and organisation names held as text. Missing is NULL, never an empty string."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: every Unicode white-space character (separators plus tab, line and page controls).
# Spark's one-argument trim removes plain spaces only, and full-width U+3000 occurs in the data.
WHITESPACE = "".join(
    map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)


def strip(c: Column) -> Column:
    """Trim all Unicode white space; a native trim, much cheaper than a regular expression."""
    return F.btrim(c.cast("string"), F.lit(WHITESPACE))


def non_blank(c: Column) -> Column:
    """The trimmed text, or NULL when nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def is_blank(c: Column) -> Column:
    return non_blank(c).isNull()


def normalize_id(c: Column) -> Column:
    return F.lower(non_blank(c))


def normalize_text(c: Column) -> Column:
    """Trim, turn inner runs of white space into one space, lower-case."""
    return F.lower(F.regexp_replace(non_blank(c), r"[\s\v\p{Z}]+", " "))


def fill_unknown(c: Column) -> Column:
    return F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit("UNKNOWN"))


def first_non_blank(*columns: Column) -> Column:
    return F.coalesce(*[non_blank(c) for c in columns])


def org_key(*parts: Column) -> Column:
    """Composite key; NULL as soon as one part is blank, because ``concat`` keeps NULL."""
    pieces: list[Column] = []
    for part in parts:
        if pieces:
            pieces.append(F.lit("|"))
        pieces.append(normalize_text(part))
    return F.concat(*pieces)


def join_codes(codes: Column) -> Column:
    """Code set as one text: sorted, joined by ``|``; NULL for an empty set."""
    return F.nullif(F.array_join(F.sort_array(codes), "|"), F.lit(""))
