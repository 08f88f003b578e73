"""Who is who: merged master records, account resolution and the key bridge."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.functions import non_blank, normalize_id, normalize_text, org_key
from cohortline.operators.facts import role_filter
from cohortline.sources.reports import distinct_values
from cohortline.sources.schemas import KEY_BRIDGE_COLUMNS

# Fields of the two master tables and the words of the bridge.
PROFILE_FIELDS = ("XB", "NJ", "XSM", "ZYM", "YX", "ZY", "BJ")
MASTER_FIELDS = (
    "XM", "XB", "NJ", "YX", "ZY", "BJ", "BH", "XSM", "ZYM", "MZMC", "ZZMMMC", "CSRQ", "JG", "GRADE", "BYQXMC",
)
ACCOUNT_FIELDS = ("user_name", "department_name", "major_name", "class_name")
MATCH_RULES = {
    "exact_login_alias": ("high", "login_name = student_id"),
    "bridge_org_class_unique": ("medium", "department_name + major_name + class_name"),
    "bridge_org_major_unique": ("low", "department_name + major_name"),
    "unresolved_org_multi": ("low", "organization tuple not unique after anonymization"),
}
MISSING_ACCOUNT = ("unresolved_missing_account_master", "none", "login_name")
IDENTITY_TEMPLATES = (
    ("student_basic", "XH"),
    ("student_score", "XH"),
    ("course_select", "XH"),
    ("status_change", "XH"),
    ("daily_exercise", "XH"),
    ("pe_class", "XH"),
    ("physical_test", "XH"),
    ("student_fitness", "XH"),
    ("attendance_summary", "XH"),
    ("internet_stats", "XSBH"),
    ("scholarship", "XSBH"),
    ("club", "XSBH"),
    ("graduation", "SID"),
)


@dataclass(frozen=True)
class Source:
    """One table that knows something about students; ``fields`` maps target field to its column."""

    name: str
    df: DataFrame
    key: str
    ordinal: str
    fields: Mapping[str, str] = field(default_factory=dict)


def _nothing() -> Column:
    return F.lit(None).cast("string")


def _stacked(sources: Sequence[Source], fields: Sequence[str]) -> DataFrame:
    """All sources as rows of (id, source, place of the row, fields); the list order is the priority."""
    stacked: DataFrame | None = None
    for rank, source in enumerate(sources):
        rows = source.df.select(
            normalize_id(F.col(source.key)).alias("student_id"),
            F.lit(source.name).alias("source"),
            F.struct(F.lit(rank).alias("rank"), F.col(source.ordinal).alias("ordinal")).alias("place"),
            *[
                (non_blank(F.col(source.fields[f])) if f in source.fields else _nothing()).alias(f)
                for f in fields
            ],
        ).where(F.col("student_id").isNotNull())
        stacked = rows if stacked is None else stacked.unionByName(rows)
    assert stacked is not None, "at least one source"
    return stacked


def _first(name: str, place: str = "place") -> Column:
    return F.min_by(name, F.when(F.col(name).isNotNull(), F.col(place))).alias(name)


def merge_profiles(sources: Sequence[Source], fields: Sequence[str] = PROFILE_FIELDS) -> DataFrame:
    """Per student and field, the first non-blank value by source priority, then row order."""
    return _stacked(sources, fields).groupBy("student_id").agg(*[_first(f) for f in fields])


def profile_columns(merged: DataFrame) -> DataFrame:
    """Merged fields under the names of the semester table, organisation names with their fallback."""
    return merged.select(
        "student_id",
        F.col("XB").alias("gender"),
        F.col("NJ").alias("grade"),
        F.coalesce("YX", "XSM").alias("college"),
        F.coalesce("ZY", "ZYM").alias("major"),
        F.col("BJ").alias("class_name"),
    )


def student_master(sources: Sequence[Source], fields: Sequence[str] = MASTER_FIELDS) -> DataFrame:
    """Merged record with fallbacks, normal forms, organisation keys and the set of source tables."""
    merged = (
        _stacked(sources, fields)
        .groupBy("student_id")
        .agg(*[_first(f) for f in fields], F.sort_array(F.collect_set("source")).alias("source_tables"))
    )
    filled = merged.withColumns(
        {
            "YX": F.coalesce("YX", "XSM"),
            "ZY": F.coalesce("ZY", "ZYM"),
            "BJ": F.coalesce("BJ", "BH"),
        }
    )
    return filled.select(
        "student_id",
        *fields,
        normalize_text(F.col("YX")).alias("department_norm"),
        normalize_text(F.col("ZY")).alias("major_norm"),
        normalize_text(F.col("BJ")).alias("class_norm"),
        org_key(F.col("YX"), F.col("ZY"), F.col("BJ")).alias("org_class_key"),
        org_key(F.col("YX"), F.col("ZY")).alias("org_major_key"),
        "source_tables",
    )


def account_master(
    raw: DataFrame,
    source_table: str,
    ordinal: str = "ordinal",
    login: str = "LOGIN_NAME",
    user: str = "XM",
    department: str = "DEPARTMENT_NAME",
    major: str = "MAJOR_NAME",
    class_name: str = "CLASS_NAME",
    role: str = "ROLEID",
) -> DataFrame:
    """One row per student login: first raw spelling and first non-blank organisation fields."""
    rows = role_filter(raw, role).select(
        normalize_id(F.col(login)).alias("login_name_norm"),
        non_blank(F.col(login)).alias("login_name_raw"),
        F.col(ordinal).alias("place"),
        F.lit(source_table).alias("source"),
        *[
            non_blank(F.col(c)).alias(name)
            for name, c in zip(ACCOUNT_FIELDS, (user, department, major, class_name), strict=True)
        ],
    )
    return (
        rows.where(F.col("login_name_norm").isNotNull())
        .groupBy("login_name_norm")
        .agg(
            _first("login_name_raw"),
            *[_first(f) for f in ACCOUNT_FIELDS],
            F.sort_array(F.collect_set("source")).alias("source_tables"),
        )
    )


def unique_key_index(master: DataFrame, key: str) -> DataFrame:
    """Key to student, for keys held by exactly one student. Minimum = maximum says so without a set."""
    return (
        master.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.min("student_id").alias("student_id"), F.max("student_id").alias("_last"))
        .where(F.col("student_id") == F.col("_last"))
        .drop("_last")
    )


def resolve_accounts(accounts: DataFrame, master: DataFrame) -> DataFrame:
    """Exact id, else unique (department, major, class), else unique (department, major), else unresolved.

    A row needs a later key only when the earlier steps failed. Rows without a key get one of their own
    that matches nothing, so they do not gather in the partition of NULL.
    """
    own = F.concat(F.lit("\u0000"), F.col("login_name_norm"))
    exact = master.select(F.col("student_id").alias("login_name_norm"), F.col("student_id").alias("by_id"))
    by_class = unique_key_index(master, "org_class_key").withColumnRenamed("student_id", "by_class")
    by_major = unique_key_index(master, "org_major_key").withColumnRenamed("student_id", "by_major")

    class_key = org_key(F.col("department_name"), F.col("major_name"), F.col("class_name"))
    major_key = org_key(F.col("department_name"), F.col("major_name"))
    found = accounts.join(exact, "login_name_norm", "left")
    found = found.withColumn(
        "org_class_key", F.coalesce(F.when(F.col("by_id").isNull(), class_key), own)
    ).join(by_class, "org_class_key", "left")
    open_still = F.col("by_id").isNull() & F.col("by_class").isNull()
    found = found.withColumn("org_major_key", F.coalesce(F.when(open_still, major_key), own)).join(
        by_major, "org_major_key", "left"
    )

    steps = zip(("by_id", "by_class", "by_major"), MATCH_RULES, strict=False)
    match_type = F.lit("unresolved_org_multi")
    for column, name in reversed(list(steps)):
        match_type = F.when(F.col(column).isNotNull(), name).otherwise(match_type)
    rules = F.col("match_type")
    confidence, evidence = _nothing(), _nothing()
    for name, (level, reason) in MATCH_RULES.items():
        confidence = F.when(rules == name, level).otherwise(confidence)
        evidence = F.when(rules == name, reason).otherwise(evidence)
    return found.withColumn("match_type", match_type).select(
        "login_name_raw",
        "login_name_norm",
        *ACCOUNT_FIELDS,
        F.coalesce("by_id", "by_class", "by_major").alias("student_id"),
        "match_type",
        confidence.alias("match_confidence"),
        evidence.alias("evidence_fields"),
        "source_tables",
    )


def identity_bridge(master: DataFrame, templates: Sequence[tuple[str, str]] = IDENTITY_TEMPLATES) -> DataFrame:
    """Every student under every (table, field) template: the fixed list is exploded in each row."""
    pairs = F.array(*[F.struct(F.lit(t).alias("source_table"), F.lit(f).alias("source_field")) for t, f in templates])
    rows = master.select("student_id", F.explode(pairs).alias("template")).select("student_id", "template.*")
    return rows.select(
        "source_table",
        "source_field",
        F.col("student_id").alias("source_value_raw"),
        F.col("student_id").alias("source_value_norm"),
        "student_id",
        F.lit("exact").alias("match_type"),
        F.lit("high").alias("match_confidence"),
        F.concat(F.lit("identity:"), F.col("source_field"), F.lit(" -> student_id")).alias("evidence_fields"),
    )


def filtered_bridge(
    raw: DataFrame, master: DataFrame, source_table: str, source_field: str, ordinal: str = "ordinal"
) -> DataFrame:
    """Distinct values of a mixed person column; values that are no student are kept and say so."""
    values = distinct_values(raw, source_field, ordinal)
    known = master.select(F.col("student_id").alias("value_norm"), "student_id")
    hit = F.col("student_id").isNotNull()
    return values.join(known, "value_norm", "left").select(
        F.lit(source_table).alias("source_table"),
        F.lit(source_field).alias("source_field"),
        F.col("value_raw").alias("source_value_raw"),
        F.col("value_norm").alias("source_value_norm"),
        "student_id",
        F.when(hit, "filtered_exact").otherwise("filtered_out_nonstudent").alias("match_type"),
        F.when(hit, "high").otherwise("none").alias("match_confidence"),
        F.lit(f"{source_field} filtered by student_master").alias("evidence_fields"),
    )


def account_bridge(
    raw: DataFrame, accounts: DataFrame, source_table: str, source_field: str, ordinal: str = "ordinal"
) -> DataFrame:
    """Distinct logins of a source with their account's resolution; unknown logins are kept and say so."""
    resolved = accounts.select(
        F.col("login_name_norm").alias("value_norm"),
        F.lit(True).alias("known"),
        "student_id",
        "match_type",
        "match_confidence",
        "evidence_fields",
    )
    missing = dict(zip(("match_type", "match_confidence", "evidence_fields"), MISSING_ACCOUNT, strict=True))
    return (
        distinct_values(raw, source_field, ordinal)
        .join(resolved, "value_norm", "left")
        .select(
            F.lit(source_table).alias("source_table"),
            F.lit(source_field).alias("source_field"),
            F.col("value_raw").alias("source_value_raw"),
            F.col("value_norm").alias("source_value_norm"),
            "student_id",
            *[F.when(F.col("known"), F.col(c)).otherwise(F.lit(word)).alias(c) for c, word in missing.items()],
        )
    )


def key_bridge(*bridges: DataFrame) -> DataFrame:
    union = bridges[0].select(*KEY_BRIDGE_COLUMNS)
    for bridge in bridges[1:]:
        union = union.unionByName(bridge.select(*KEY_BRIDGE_COLUMNS))
    return union


def bridge_summary(bridge: DataFrame) -> DataFrame:
    return bridge.groupBy("source_table", "source_field", "match_type").agg(F.count("*").alias("row_count"))
