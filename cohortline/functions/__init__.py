"""Column functions. All of them are built-in expressions, none is a UDF."""

from cohortline.functions.codes import in_code_set, list_position, map_code, threshold_status
from cohortline.functions.dates import (
    coalesce_dates,
    school_year_of,
    term_of_date,
    term_of_plan,
    term_order,
    to_date_flexible,
)
from cohortline.functions.numbers import (
    half_even,
    log1p_clip,
    number_of,
    parse_ratio_pair,
    round4,
    signed_log1p,
    to_double,
    valid_score,
)
from cohortline.functions.text import (
    fill_unknown,
    first_non_blank,
    is_blank,
    join_codes,
    non_blank,
    normalize_id,
    normalize_text,
    org_key,
    strip,
)
from cohortline.functions.vectors import cosine, l2_normalize, vec_distance

__all__ = [
    "coalesce_dates",
    "cosine",
    "fill_unknown",
    "half_even",
    "first_non_blank",
    "in_code_set",
    "is_blank",
    "join_codes",
    "l2_normalize",
    "list_position",
    "log1p_clip",
    "map_code",
    "non_blank",
    "normalize_id",
    "normalize_text",
    "number_of",
    "org_key",
    "parse_ratio_pair",
    "round4",
    "school_year_of",
    "signed_log1p",
    "strip",
    "term_of_date",
    "term_of_plan",
    "term_order",
    "threshold_status",
    "to_date_flexible",
    "to_double",
    "valid_score",
    "vec_distance",
]
