"""Master records, accounts and the key bridge."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.operators import identity
from cohortline.operators.identity import IDENTITY_TEMPLATES, MASTER_FIELDS, MATCH_RULES, Source
from cohortline.sources.schemas import KEY_BRIDGE_COLUMNS
from cohortline.workload.campus import (
    SQL_FITNESS_ROWS,
    SQL_PROFILE,
    SQL_STUDENTS,
    Campus,
)
from cohortline.workload.registry import query

# ---------------------------------------------------------------- sources


def master_sources(c: Campus) -> list[Source]:
    """Six sources; suppliers, parts and nations add ids that the earlier ones may not have."""
    basic = c.students.withColumn("birth", F.concat(F.lit("born "), "student_id"))
    supplier = c.table("supplier").select(
        F.col("s_suppkey").cast("string").alias("XH"), F.col("s_suppkey").alias("ordinal"), "s_name", F.lit("S1").alias("bh")
    )
    part = c.table("part").select(
        F.col("p_partkey").cast("string").alias("XH"), F.col("p_partkey").alias("ordinal"), "p_type", "p_brand", "p_name"
    )
    nation = c.table("nation").select(
        F.col("n_nationkey").cast("string").alias("SID"), F.col("n_nationkey").cast("bigint").alias("ordinal"), "n_name"
    )
    return [
        Source("student_basic", basic, "student_id", "ordinal", {"XB": "gender", "XSM": "college", "ZYM": "major", "CSRQ": "birth"}),
        Source("student_fitness", c.fitness_rows, "XH", "ordinal", {f: f for f in ("XB", "NJ", "YX", "ZY", "BH")}),
        Source("physical_test", c.online_rows, "LOGIN_NAME", "ordinal", {"YX": "DEPARTMENT_NAME", "BJ": "CLASS_NAME"}),
        Source("pe_class", supplier, "XH", "ordinal", {"XM": "s_name", "BH": "bh"}),
        Source("daily_exercise", part, "XH", "ordinal", {"XM": "p_name", "YX": "p_type", "ZY": "p_brand"}),
        Source("graduation", nation, "SID", "ordinal", {"GRADE": "n_name"}),
    ]


@cache
def _master_sql() -> str:
    def rows(rank: int, name: str, table: str, key: str, ordinal: str, **fields: str) -> str:
        columns = ", ".join(f"CAST({fields.get(f.lower(), 'NULL')} AS VARCHAR) AS {f.lower()}" for f in MASTER_FIELDS)
        return f"SELECT {key} AS student_id, {rank} AS rank, {ordinal} AS ordinal, '{name}' AS source, {columns} FROM {table}"

    stacked = " UNION ALL ".join(
        [
            rows(0, "student_basic", "students", "student_id", "ordinal", xb="gender", xsm="college", zym="major", csrq="concat('born ', student_id)"),
            rows(1, "student_fitness", "fitness_rows", "student_id", "ordinal", xb="xb", nj="nj", yx="yx", zy="zy", bh="bh"),
            rows(2, "physical_test", "all_online", "student_id", "ordinal", yx="yx", bj="bj"),
            rows(3, "pe_class", "supplier", "CAST(s_suppkey AS VARCHAR)", "s_suppkey", xm="s_name", bh="'S1'"),
            rows(4, "daily_exercise", "part", "CAST(p_partkey AS VARCHAR)", "p_partkey", xm="p_name", yx="p_type", zy="p_brand"),
            rows(5, "graduation", "nation", "CAST(n_nationkey AS VARCHAR)", "n_nationkey", grade="n_name"),
        ]
    )
    firsts = ", ".join(
        f"first({f.lower()} ORDER BY rank, ordinal) FILTER (WHERE {f.lower()} IS NOT NULL) AS {f.lower()}" for f in MASTER_FIELDS
    )

    def filled(f: str) -> str:
        other = {"YX": "xsm", "ZY": "zym", "BJ": "bh"}.get(f)
        return f"coalesce({f.lower()}, {other}) AS {f}" if other else f"{f.lower()} AS {f}"

    columns = ", ".join(filled(f) for f in MASTER_FIELDS)
    return f"""{SQL_STUDENTS}, {SQL_FITNESS_ROWS},
all_online AS (SELECT CAST(user_id AS VARCHAR) AS student_id, event_id AS ordinal, event_type AS yx, concat('C', event_id % 11) AS bj FROM events),
stacked AS ({stacked}),
merged_master AS (SELECT student_id, {firsts}, string_agg(DISTINCT source, '|' ORDER BY source) AS source_tables FROM stacked GROUP BY student_id),
filled AS (SELECT student_id, {columns}, source_tables FROM merged_master),
master AS (
  SELECT *, lower(YX) AS department_norm, lower(ZY) AS major_norm, lower(BJ) AS class_norm,
    lower(YX || '|' || ZY || '|' || BJ) AS org_class_key, lower(YX || '|' || ZY) AS org_major_key FROM filled)"""


@query(f"WITH {SQL_PROFILE} SELECT * FROM profile")
def merge_profiles(c: Campus) -> DataFrame:
    return c.profile


@query(f"WITH {_master_sql()} SELECT * FROM master")
def student_master(c: Campus) -> DataFrame:
    master = identity.student_master(master_sources(c))
    return master.withColumn("source_tables", F.array_join("source_tables", "|"))


# ---------------------------------------------------------------- accounts


def account_rows(c: Campus) -> DataFrame:
    """Orders as account rows: some logins are ids, the rest can only be found by their organisation."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    person = c.students.select(F.col("ordinal").alias("o_custkey"), "college", "major", "class_name")
    login = F.when(customer % 3 == 0, F.concat(F.lit(" "), customer.cast("string"))).otherwise(
        F.concat(F.lit("Acct-"), customer.cast("string"))
    )
    return c.table("orders").join(person, "o_custkey").select(
        login.alias("LOGIN_NAME"),
        key.alias("ordinal"),
        F.concat(F.lit("user "), key.cast("string")).alias("XM"),
        F.when(key % 3 == 0, "").otherwise(F.upper("college")).alias("DEPARTMENT_NAME"),
        F.col("major").alias("MAJOR_NAME"),
        F.when(customer % 4 != 1, F.col("class_name")).alias("CLASS_NAME"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "2").otherwise("3").alias("ROLEID"),
    )


def small_master(c: Campus) -> DataFrame:
    """Customers as the master the accounts are resolved against."""
    source = Source("student_basic", c.students, "student_id", "ordinal", {"XSM": "college", "ZYM": "major", "BJ": "class_name"})
    return identity.student_master([source])


def accounts(c: Campus) -> DataFrame:
    return identity.account_master(account_rows(c), "online_learning")


SQL_ACCOUNTS = f"""{SQL_STUDENTS},
account_rows AS (
  SELECT CASE WHEN o_custkey % 3 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE concat('Acct-', o_custkey) END AS login, o_orderkey AS ordinal,
    concat('user ', o_orderkey) AS user_name, CASE WHEN o_orderkey % 3 <> 0 THEN upper(college) END AS department_name,
    major AS major_name, CASE WHEN o_custkey % 4 <> 1 THEN class_name END AS class_name, o_orderpriority
  FROM orders JOIN students s ON s.ordinal = o_custkey),
account_agg AS (
  SELECT lower(login) AS login_name_norm, first(login ORDER BY ordinal) AS login_name_raw,
    first(user_name ORDER BY ordinal) AS user_name,
    first(department_name ORDER BY ordinal) FILTER (WHERE department_name IS NOT NULL) AS department_name,
    first(major_name ORDER BY ordinal) AS major_name, first(class_name ORDER BY ordinal) AS class_name
  FROM account_rows WHERE o_orderpriority <> '1-URGENT' GROUP BY ALL)"""

_RULE = {name: f"('{name}', '{level}', '{reason}')" for name, (level, reason) in MATCH_RULES.items()}

SQL_RESOLVED = f"""{SQL_ACCOUNTS},
master AS (
  SELECT student_id, lower(college || '|' || major || '|' || class_name) AS org_class_key, lower(college || '|' || major) AS org_major_key
  FROM students),
class_index AS (SELECT org_class_key, min(student_id) AS by_class FROM master GROUP BY ALL HAVING count(DISTINCT student_id) = 1),
major_index AS (SELECT org_major_key, min(student_id) AS by_major FROM master GROUP BY ALL HAVING count(DISTINCT student_id) = 1),
rules(match_type, match_confidence, evidence_fields) AS (VALUES {", ".join(_RULE.values())}),
found AS (
  SELECT a.*, m.student_id AS by_id, by_class, by_major,
    CASE WHEN m.student_id IS NOT NULL THEN 'exact_login_alias' WHEN by_class IS NOT NULL THEN 'bridge_org_class_unique'
         WHEN by_major IS NOT NULL THEN 'bridge_org_major_unique' ELSE 'unresolved_org_multi' END AS match_type
  FROM account_agg a LEFT JOIN master m ON a.login_name_norm = m.student_id
  LEFT JOIN class_index c ON c.org_class_key = lower(department_name || '|' || major_name || '|' || class_name)
  LEFT JOIN major_index j ON j.org_major_key = lower(department_name || '|' || major_name)),
resolved AS (
  SELECT login_name_raw, login_name_norm, user_name, department_name, major_name, class_name,
    coalesce(by_id, by_class, by_major) AS student_id, match_type, match_confidence, evidence_fields,
    'online_learning' AS source_tables
  FROM found JOIN rules USING (match_type))"""


@query(f"WITH {SQL_ACCOUNTS} SELECT *, 'online_learning' AS source_tables FROM account_agg")
def account_master(c: Campus) -> DataFrame:
    return accounts(c).withColumn("source_tables", F.array_join("source_tables", "|"))


@query(f"WITH {SQL_RESOLVED} SELECT org_major_key, by_major AS student_id FROM major_index")
def unique_key_index(c: Campus) -> DataFrame:
    return identity.unique_key_index(small_master(c), "org_major_key")


@query(f"WITH {SQL_RESOLVED} SELECT * FROM resolved")
def resolve_accounts(c: Campus) -> DataFrame:
    resolved = identity.resolve_accounts(accounts(c), small_master(c))
    return resolved.withColumn("source_tables", F.array_join("source_tables", "|"))


# ---------------------------------------------------------------- bridge

BRIDGE = ", ".join(KEY_BRIDGE_COLUMNS)
_TEMPLATES = ", ".join(f"('{t}', '{f}')" for t, f in IDENTITY_TEMPLATES)

SQL_BRIDGE = f"""{SQL_RESOLVED},
templates(source_table, source_field) AS (VALUES {_TEMPLATES}),
identity_rows AS (
  SELECT source_table, source_field, student_id AS source_value_raw, student_id AS source_value_norm, student_id,
    'exact' AS match_type, 'high' AS match_confidence, concat('identity:', source_field, ' -> student_id') AS evidence_fields
  FROM master CROSS JOIN templates),
people AS (SELECT concat('P', p_size * 40) AS raw FROM part UNION SELECT CAST(p_partkey AS VARCHAR) FROM part),
filtered_rows AS (
  SELECT 'competition' AS source_table, 'XHHGH' AS source_field, raw AS source_value_raw, lower(raw) AS source_value_norm, student_id,
    CASE WHEN student_id IS NULL THEN 'filtered_out_nonstudent' ELSE 'filtered_exact' END AS match_type,
    CASE WHEN student_id IS NULL THEN 'none' ELSE 'high' END AS match_confidence,
    'XHHGH filtered by student_master' AS evidence_fields
  FROM people LEFT JOIN master ON lower(raw) = student_id),
logins AS (SELECT lower(login) AS norm, first(login ORDER BY ordinal) AS raw FROM account_rows GROUP BY ALL),
account_bridge_rows AS (
  SELECT 'online_learning' AS source_table, 'LOGIN_NAME' AS source_field, raw AS source_value_raw, norm AS source_value_norm, student_id,
    coalesce(match_type, 'unresolved_missing_account_master') AS match_type, coalesce(match_confidence, 'none') AS match_confidence,
    coalesce(evidence_fields, 'login_name') AS evidence_fields
  FROM logins LEFT JOIN resolved ON norm = login_name_norm),
bridge AS (SELECT {BRIDGE} FROM identity_rows UNION ALL SELECT {BRIDGE} FROM filtered_rows UNION ALL SELECT {BRIDGE} FROM account_bridge_rows)"""


def competition(c: Campus) -> DataFrame:
    """A person column that mixes student ids with other codes."""
    part = c.table("part")
    other = F.concat(F.lit("P"), (F.col("p_size") * 40).cast("string"))
    values = F.explode(F.array(F.col("p_partkey").cast("string"), other))
    return part.select(F.col("p_partkey").alias("ordinal"), values.alias("XHHGH"))


@query(f"WITH {SQL_BRIDGE} SELECT {BRIDGE} FROM identity_rows")
def identity_bridge(c: Campus) -> DataFrame:
    return identity.identity_bridge(small_master(c))


@query(f"WITH {SQL_BRIDGE} SELECT {BRIDGE} FROM filtered_rows")
def filtered_bridge(c: Campus) -> DataFrame:
    return identity.filtered_bridge(competition(c), small_master(c), "competition", "XHHGH")


@query(f"WITH {SQL_BRIDGE} SELECT {BRIDGE} FROM account_bridge_rows")
def account_bridge(c: Campus) -> DataFrame:
    """All logins, the ones of other roles included: those have no account and are kept as unresolved."""
    resolved = identity.resolve_accounts(accounts(c), small_master(c))
    return identity.account_bridge(account_rows(c), resolved, "online_learning", "LOGIN_NAME")


@query(f"WITH {SQL_BRIDGE} SELECT {BRIDGE} FROM bridge")
def key_bridge(c: Campus) -> DataFrame:
    return identity.key_bridge(identity_bridge(c), filtered_bridge(c), account_bridge(c))


@query(f"""WITH {SQL_BRIDGE} SELECT source_table, source_field, match_type, count(*) AS row_count FROM bridge GROUP BY ALL""")
def bridge_summary(c: Campus) -> DataFrame:
    return identity.bridge_summary(key_bridge(c))
