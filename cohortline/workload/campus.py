"""The given tables seen as campus tables: customers are students, orders are enrolments, and so on.

``SQL_*`` texts state the same mapping for the SQL side. Measures are multiples of a quarter, so that
sums do not depend on the order of addition.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortline.functions import term_of_date
from cohortline.functions.text import WHITESPACE
from cohortline.operators import facts, identity
from cohortline.operators.identity import Source
from cohortline.plans import jobs
from cohortline.session import cut_lineage

POOL_YEARS = tuple(f"{y}-{y + 1}" for y in range(1995, 2000))
SPLIT_YEARS = {
    "train": tuple(f"{y}-{y + 1}" for y in range(1992, 1998)),
    "valid": ("1998-1999",),
    "test": ("1999-2000",),
}
DIMS = 64
TERMS = 10
SCHOOL_AVERAGE = {"click": 20.0, "view": 24.5, "purchase": 30.25}
OTHER_AVERAGE = 16.0
CLUSTER_NAMES = {i: f"group {i}" for i in range(9)}


def _text(c: Column) -> Column:
    return c.cast("string")


def _school_average() -> Column:
    average = F.lit(OTHER_AVERAGE)
    for kind, value in SCHOOL_AVERAGE.items():
        average = F.when(F.col("event_type") == kind, value).otherwise(average)
    return average


class Campus:
    """Lazy views over one folder of Parquet tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # ------------------------------------------------------------ people

    @cached_property
    def students(self) -> DataFrame:
        """One clean row per customer."""
        customer, nation = self.table("customer"), self.table("nation")
        return customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(
            _text(F.col("c_custkey")).alias("student_id"),
            F.col("c_custkey").alias("ordinal"),
            F.when(F.col("c_custkey") % 2 == 0, "男").otherwise("女").alias("gender"),
            F.col("n_name").alias("college"),
            F.concat("c_mktsegment", F.lit(" "), _text(F.floor(F.col("c_acctbal") / 1000))).alias("major"),
            _text(F.pmod(F.floor("c_acctbal"), F.lit(7))).alias("class_name"),
        )

    @cached_property
    def profile_sources(self) -> list[Source]:
        """Three sources with gaps and repeated rows per student."""
        basic = self.students.select(
            F.concat(F.lit("  "), "student_id", F.lit(" ")).alias("XH"),
            "ordinal",
            F.when(F.col("ordinal") % 5 == 0, " ").otherwise(F.col("gender")).alias("XB"),
            F.col("college").alias("XSM"),
            F.col("major").alias("ZYM"),
        )
        return [
            Source("student_basic", basic, "XH", "ordinal", {"XB": "XB", "XSM": "XSM", "ZYM": "ZYM"}),
            Source("physical_test", self.fitness_rows, "XH", "ordinal", {c: c for c in ("XB", "NJ", "YX", "ZY", "BJ")}),
            Source(
                "online_learning",
                facts.role_filter(self.online_rows),
                "LOGIN_NAME",
                "ordinal",
                {"YX": "DEPARTMENT_NAME", "ZY": "MAJOR_NAME", "BJ": "CLASS_NAME"},
            ),
        ]

    @cached_property
    def fitness_rows(self) -> DataFrame:
        """Orders as fitness tests."""
        key = F.col("o_orderkey")
        return self.table("orders").select(
            _text(F.col("o_custkey")).alias("XH"),
            key.alias("ordinal"),
            F.when(key % 2 == 0, "男").otherwise("女").alias("XB"),
            F.when(F.col("o_orderstatus") == "F", "").otherwise(_text(F.year("o_orderdate"))).alias("NJ"),
            F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(None))
            .otherwise(F.concat(F.lit("School "), "o_orderstatus"))
            .alias("YX"),
            F.when(key % 3 == 0, "\t").otherwise(F.col("o_orderpriority")).alias("ZY"),
            _text(key % 30).alias("BJ"),
            _text(key % 9).alias("BH"),
            _text(F.year("o_orderdate")).alias("TCNF"),
            F.when(key % 4 != 0, F.lit(40.0) + (key % 240) / 4).alias("ZF"),
            F.when(key % 5 == 0, " ")
            .otherwise(F.concat(_text(key % 40 + 150), F.lit(" / "), _text((key % 60) / 2 + 40)))
            .alias("BMI"),
        )

    @cached_property
    def online_rows(self) -> DataFrame:
        """Events as online-learning rows; errors are staff accounts."""
        key = F.col("event_id")
        return self.table("events").select(
            _text(F.col("user_id")).alias("LOGIN_NAME"),
            key.alias("ordinal"),
            F.when(F.col("event_type") == "error", "2").otherwise(" 3").alias("ROLEID"),
            F.col("event_type").alias("DEPARTMENT_NAME"),
            F.concat(F.lit("M"), _text(key % 7)).alias("MAJOR_NAME"),
            F.concat(F.lit("C"), _text(key % 11)).alias("CLASS_NAME"),
            F.when(key % 3 == 0, "n/a").otherwise(_text(F.col("value"))).alias("BFB"),
        )

    @cached_property
    def profile(self) -> DataFrame:
        return identity.profile_columns(identity.merge_profiles(self.profile_sources))

    @cached_property
    def snapshot(self) -> DataFrame:
        return facts.first_snapshot(facts.role_filter(self.online_rows), "LOGIN_NAME", "BFB", "ordinal")

    @cached_property
    def yearly(self) -> DataFrame:
        return facts.fitness_by_year(facts.fitness_facts(self.fitness_rows))

    # ------------------------------------------------------------ facts

    @cached_property
    def course(self) -> DataFrame:
        """Orders as course selections; some carry an id nobody has."""
        unknown = F.concat(F.lit("x"), _text(F.col("o_custkey")))
        rows = self.table("orders").select(
            F.when(F.col("o_orderkey") % 50 == 0, unknown).otherwise(_text(F.col("o_custkey"))).alias("student_id"),
            "o_orderdate",
        )
        return facts.with_term(rows, "o_orderdate").select("student_id", "school_year", "semester")

    @cached_property
    def score(self) -> DataFrame:
        """Line items as scores of the term in which they were ordered."""
        orders, lineitem = self.table("orders"), self.table("lineitem")
        rows = lineitem.join(orders, lineitem.l_orderkey == orders.o_orderkey).select(
            _text(F.col("o_custkey")).alias("student_id"),
            "o_orderdate",
            (F.col("l_quantity") * 2.25).alias("score"),
            (F.round(F.col("l_discount") * 100) / 2).alias("gpa"),
            F.round(F.col("l_tax") * 100).alias("credit"),
            F.when(F.col("l_returnflag") == "N", "01")
            .when(F.col("l_returnflag") == "A", " ")
            .otherwise("11")
            .alias("resit"),
        )
        return facts.with_term(rows, "o_orderdate").drop("o_orderdate")

    @cached_property
    def usage(self) -> DataFrame:
        """Events as months of internet use."""
        rows = self.table("events").select(
            _text(F.col("user_id")).alias("student_id"),
            "ts",
            F.when(F.col("event_id") % 6 != 0, F.floor(F.col("value") * 4) / 4).alias("hours"),
            F.when(F.col("event_id") % 4 != 0, _school_average()).alias("school_average"),
            "event_type",
        )
        return facts.with_term(rows, "ts").drop("ts")

    @cached_property
    def status(self) -> DataFrame:
        """Orders in status P as status changes with a type code; some students left (flag 0)."""
        code = F.substring("o_orderpriority", 1, 1)
        rows = self.table("orders").select(
            _text(F.col("o_custkey")).alias("XH"),
            "o_orderdate",
            F.when(F.col("o_orderstatus") == "P", code).otherwise("9").alias("type_code"),
            F.concat(F.lit("R"), "o_orderstatus").alias("reason_code"),
            F.when(F.col("o_orderkey") % 97 == 0, "0").otherwise("1").alias("enrolled"),
        )
        risky = rows.where(facts.in_code_set(F.col("type_code"), facts.HIGH_RISK_TYPES, F.col("enrolled")))
        return facts.with_term(risky.withColumnRenamed("XH", "student_id"), "o_orderdate").select(
            "student_id", "school_year", "semester", "type_code", "reason_code"
        )

    @cached_property
    def card(self) -> DataFrame:
        return facts.student_card(self.profile, self.snapshot, self.yearly)

    @cached_property
    def base(self) -> DataFrame:
        return jobs.semester_base(self.course, self.score, self.usage, self.status, self.card)

    @cached_property
    def base_table(self) -> DataFrame:
        """The semester table written once, as the jobs hand it on: for queries that fit and then apply."""
        return cut_lineage(self.base)

    @cached_property
    def raw(self) -> dict[str, DataFrame]:
        """Every semester source as a raw text table, dates in four notations."""
        orders = self.table("orders")
        key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
        term = term_of_date(day)
        serial = _text(F.datediff(day, F.lit("1899-12-30").cast("date")))
        notation = (
            F.when(key % 4 == 0, F.date_format(day, "yyyyMMdd"))
            .when(key % 4 == 1, serial)
            .when(key % 4 == 2, F.date_format(day, "yyyy-MM-dd"))
        )
        student = F.concat(F.lit(" "), _text(F.col("o_custkey")))
        lines = self.table("lineitem").join(orders, F.col("l_orderkey") == key)
        return {
            "student_basic": self.profile_sources[0].df,
            "physical_test": self.fitness_rows.withColumn("ZF", F.coalesce(_text(F.col("ZF")), F.lit("absent"))),
            "online_learning": self.online_rows,
            "course_select": orders.select(
                F.when(key % 50 == 0, F.concat(F.lit("x"), _text(F.col("o_custkey")))).otherwise(student).alias("XH"),
                term["school_year"].alias("KKXN"),
                F.concat(term["semester"], F.lit(" ")).alias("KKXQ"),
            ),
            "student_score": lines.select(
                student.alias("XH"),
                F.concat_ws("-", term["school_year"], term["semester"]).alias("ZXJXJHH"),
                _text(F.col("l_quantity") * 2.25).alias("KCCJ"),
                _text(F.round(F.col("l_discount") * 100) / 2).alias("JDCJ"),
                _text(F.round(F.col("l_tax") * 100)).alias("XF"),
                F.when(F.col("l_returnflag") == "N", "01")
                .when(F.col("l_returnflag") == "A", " ")
                .otherwise("11")
                .alias("CXBKBZ"),
            ),
            "internet_stats": self.table("events").select(
                _text(F.col("user_id")).alias("XSBH"),
                F.date_format("ts", "yyyyMM").alias("TJNY"),
                F.when(F.col("event_id") % 6 == 0, "-").otherwise(_text(F.floor(F.col("value") * 4) / 4)).alias("SWLJSC"),
                F.when(F.col("event_id") % 4 == 0, "").otherwise(_text(_school_average())).alias("XXPJZ"),
            ),
            "status_change": orders.select(
                student.alias("XH"),
                notation.alias("YDRQ"),
                F.date_format(day, "yyyy/M/d").alias("SPRQ"),
                F.lit(None).cast("string").alias("BY1"),
                F.when(F.col("o_orderstatus") == "P", F.substring("o_orderpriority", 1, 1)).otherwise("9").alias("YDLBDM"),
                F.concat(F.lit("R"), "o_orderstatus").alias("YDYYDM"),
                F.when(key % 97 == 0, "0").otherwise("1").alias("SFZX"),
            ),
        }

    # ------------------------------------------------------------ vectors

    @cached_property
    def embedded_terms(self) -> DataFrame:
        """Ten consecutive vectors are the ten terms of one student; the given label is the cluster."""
        key = F.col("vec_id")
        term = key % TERMS
        start = F.lit(2000) + F.floor(term / 2)
        rows = self.table("embeddings").select(
            "vec_id",
            _text(F.floor(key / TERMS)).alias("student_id"),
            F.concat(_text(start), F.lit("-"), _text(start + 1)).alias("school_year"),
            _text(term % 2 + 1).alias("semester"),
            (start * 10 + term % 2 + 1).cast("int").alias("term_order"),
            F.col("label").alias("cluster"),
            F.when(key % 41 == 0, 1).otherwise(0).alias("is_outlier"),
            F.concat(F.lit("College "), _text(key % 5)).alias("college"),
            F.when(key % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("Major "), _text(key % 6))).alias("major"),
            F.when(key % 11 != 0, (key * 7 % 240) / 4 + 40).alias("avg_score"),
            (key % 4).alias("fail_course_count"),
            (key * 13 % 400 / 4).alias("internet_hours_sum"),
            (key * 17 % 100).cast("double").alias("online_learning_bfb_snapshot"),
            (key * 19 % 160 / 4 + 50).alias("physical_test_score"),
            F.when(key % 9 == 0, 1).otherwise(0).alias("risk_event_current"),
            "embedding",
        )
        labelled = facts.next_term_label(rows)
        return labelled.withColumn("risk_label_next_term_numeric", F.col("risk_label_next_term"))

    @cached_property
    def cluster_names(self) -> DataFrame:
        return self.spark.createDataFrame(list(CLUSTER_NAMES.items()), "cluster int, cluster_name string")

    # ------------------------------------------------------------ scored rows

    @cached_property
    def scored(self) -> DataFrame:
        """Line items scored by two models with heavy ties; the label is a returned item."""
        pair = F.array(
            F.struct(F.lit("discount").alias("model"), (F.col("l_discount") * 10).alias("pred_proba")),
            F.struct(F.lit("tax").alias("model"), (F.col("l_tax") * 12.5).alias("pred_proba")),
        )
        rows = self.table("lineitem").select(
            F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"), F.explode(pair).alias("p")
        )
        return rows.select("p.model", "label", "p.pred_proba", (F.col("p.pred_proba") >= 0.5).cast("int").alias("pred_label"))

    @cached_property
    def scored_documents(self) -> DataFrame:
        """Document quality scored by length: hardly any ties."""
        rows = self.table("labels").join(self.table("documents").select("doc_id", "n_chars"), "doc_id")
        return rows.select(
            F.col("quality").alias("label"), (F.col("n_chars") / (F.col("n_chars") + 1000)).alias("pred_proba")
        )


# ---------------------------------------------------------------- the same in SQL

WS = "'" + WHITESPACE + "'"
NUMBER = r"[+-]?([0-9][0-9,]*(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?"


def r(x: str, digits: int = 4) -> str:
    """Half-even rounding; adding zero turns a negative zero into zero."""
    return f"(round_even(CAST({x} AS DOUBLE), {digits}) + 0.0)"


# Means of decimal numbers can lie exactly between two six-digit values, and then the order of addition
# decides. Comparisons of fitted numbers shift them off such ties first, on both sides.
TIE_SHIFT = 1e-9


def r6(x: str) -> str:
    return r(f"({x}) + CAST({TIE_SHIFT} AS DOUBLE)", 6)


def sql_text(x: str) -> str:
    return f"nullif(trim(CAST({x} AS VARCHAR), {WS}), '')"


def sql_double(x: str) -> str:
    t = f"trim({x}, {WS})"
    return f"CASE WHEN regexp_full_match({t}, '{NUMBER}') THEN TRY_CAST(replace({t}, ',', '') AS DOUBLE) END"


def sql_year(d: str) -> str:
    start = f"(year({d}) - CASE WHEN month({d}) >= 8 THEN 0 ELSE 1 END)"
    return f"concat({start}, '-', {start} + 1)"


def sql_semester(d: str) -> str:
    return f"CASE WHEN month({d}) >= 8 OR month({d}) = 1 THEN '1' ELSE '2' END"


def sql_order(year: str, semester: str) -> str:
    return f"CAST(CAST(substr({year}, 1, 4) AS INTEGER) * 10 + CAST({semester} AS INTEGER) AS INTEGER)"


_AVERAGE = " ".join(f"WHEN '{k}' THEN {v}" for k, v in SCHOOL_AVERAGE.items())

SQL_STUDENTS = """
students AS (
  SELECT CAST(c_custkey AS VARCHAR) AS student_id, c_custkey AS ordinal,
         CASE WHEN c_custkey % 2 = 0 THEN '男' ELSE '女' END AS gender, n_name AS college,
         concat(c_mktsegment, ' ', CAST(floor(c_acctbal / 1000) AS BIGINT)) AS major,
         CAST(((CAST(floor(c_acctbal) AS BIGINT) % 7) + 7) % 7 AS VARCHAR) AS class_name
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""

SQL_FITNESS_ROWS = """
fitness_rows AS (
  SELECT CAST(o_custkey AS VARCHAR) AS student_id, o_orderkey AS ordinal,
         CASE WHEN o_orderkey % 2 = 0 THEN '男' ELSE '女' END AS xb,
         CASE WHEN o_orderstatus <> 'F' THEN CAST(year(o_orderdate) AS VARCHAR) END AS nj,
         CASE WHEN o_orderpriority <> '1-URGENT' THEN concat('School ', o_orderstatus) END AS yx,
         CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS zy,
         CAST(o_orderkey % 30 AS VARCHAR) AS bj, CAST(o_orderkey % 9 AS VARCHAR) AS bh,
         concat(year(o_orderdate), '-', year(o_orderdate) + 1) AS school_year,
         CASE WHEN o_orderkey % 4 <> 0 THEN 40.0::DOUBLE + (o_orderkey % 240) / 4.0::DOUBLE END AS score,
         CASE WHEN o_orderkey % 5 <> 0 THEN
           concat(o_orderkey % 40 + 150, ' / ', CAST((o_orderkey % 60) / 2.0::DOUBLE + 40 AS VARCHAR)) END AS bmi
  FROM orders)"""

SQL_ONLINE_ROWS = """
online_rows AS (
  SELECT CAST(user_id AS VARCHAR) AS student_id, event_id AS ordinal, event_type AS yx,
         concat('M', event_id % 7) AS zy, concat('C', event_id % 11) AS bj,
         CASE WHEN event_id % 3 <> 0 THEN value END AS bfb
  FROM events WHERE event_type <> 'error')"""

SQL_PROFILE = f"""{SQL_STUDENTS}, {SQL_FITNESS_ROWS}, {SQL_ONLINE_ROWS},
profile_rows AS (
  SELECT student_id, 0 AS rank, ordinal, CASE WHEN ordinal % 5 <> 0 THEN gender END AS xb, NULL AS nj,
         college AS xsm, major AS zym, NULL AS yx, NULL AS zy, NULL AS bj FROM students
  UNION ALL SELECT student_id, 1, ordinal, xb, nj, NULL, NULL, yx, zy, bj FROM fitness_rows
  UNION ALL SELECT student_id, 2, ordinal, NULL, NULL, NULL, NULL, yx, zy, bj FROM online_rows),
merged AS (
  SELECT student_id, {", ".join(
      f"first({c} ORDER BY rank, ordinal) FILTER (WHERE {c} IS NOT NULL) AS {c}"
      for c in ("xb", "nj", "xsm", "zym", "yx", "zy", "bj"))}
  FROM profile_rows GROUP BY student_id),
profile AS (
  SELECT student_id, xb AS gender, nj AS grade, coalesce(yx, xsm) AS college, coalesce(zy, zym) AS major,
         bj AS class_name FROM merged)"""

SQL_SNAPSHOT = f"""
snapshot AS (
  SELECT student_id, {r("first(bfb ORDER BY ordinal)")} AS online_learning_bfb_snapshot
  FROM online_rows WHERE bfb IS NOT NULL GROUP BY student_id)"""

SQL_YEARLY = f"""
yearly AS (
  SELECT student_id, school_year, count(score) AS fitness_count, {r("avg(score)")} AS physical_test_score,
         first(bmi ORDER BY ordinal) FILTER (WHERE bmi IS NOT NULL) AS physical_test_bmi
  FROM fitness_rows GROUP BY ALL)"""

SQL_FACTS = f"""
course AS (
  SELECT CASE WHEN o_orderkey % 50 = 0 THEN concat('x', o_custkey) ELSE CAST(o_custkey AS VARCHAR) END AS student_id,
         {sql_year("o_orderdate")} AS school_year, {sql_semester("o_orderdate")} AS semester FROM orders),
score AS (
  SELECT CAST(o_custkey AS VARCHAR) AS student_id, {sql_year("o_orderdate")} AS school_year,
         {sql_semester("o_orderdate")} AS semester, l_quantity * 2.25::DOUBLE AS score,
         round(l_discount * 100) / 2.0::DOUBLE AS gpa, round(l_tax * 100) AS credit,
         l_returnflag NOT IN ('N', 'A') AS flagged
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
usage AS (
  SELECT CAST(user_id AS VARCHAR) AS student_id, {sql_year("ts")} AS school_year, {sql_semester("ts")} AS semester,
         CASE WHEN event_id % 6 <> 0 THEN floor(value * 4) / 4.0::DOUBLE END AS hours,
         CASE WHEN event_id % 4 <> 0 THEN CAST(CASE event_type {_AVERAGE} ELSE {OTHER_AVERAGE} END AS DOUBLE) END
           AS school_average,
         event_type
  FROM events),
status AS (
  SELECT CAST(o_custkey AS VARCHAR) AS student_id, {sql_year("o_orderdate")} AS school_year,
         {sql_semester("o_orderdate")} AS semester,
         CASE WHEN o_orderstatus = 'P' THEN substr(o_orderpriority, 1, 1) ELSE '9' END AS type_code,
         concat('r', lower(o_orderstatus)) AS reason_code
  FROM orders
  WHERE (o_orderstatus = 'P' AND substr(o_orderpriority, 1, 1) IN ('1', '3', '11', '13')) OR o_orderkey % 97 = 0)"""

_KEY = "student_id, school_year, semester"


def sql_score_aggregates(rules: str) -> str:
    """Score columns per term under either rule set."""
    if rules == "strict":
        ok = "score BETWEEN 0 AND 100"
        counted, credit, resit = f"count(*) FILTER (WHERE {ok})", "credit > 0", f"flagged AND {ok}"
    else:
        ok = "score IS NOT NULL"
        counted, credit, resit = "count(*)", "credit IS NOT NULL", "flagged"
    fails = f"count(*) FILTER (WHERE {ok} AND score < 60)"
    return f"""{counted} AS score_course_count, {r(f"avg(score) FILTER (WHERE {ok})")} AS avg_score,
      {r(f"stddev_pop(score) FILTER (WHERE {ok})")} AS score_std, {fails} AS fail_course_count,
      {r(f"{fails} / nullif(CAST({counted} AS DOUBLE), 0)")} AS fail_ratio, {r("avg(gpa)")} AS avg_gpa,
      {r(f"coalesce(sum(credit) FILTER (WHERE {credit}), 0)")} AS credit_sum,
      count(*) FILTER (WHERE {resit}) AS resit_exam_count"""


SQL_USAGE_AGGREGATES = f"""count(*) AS internet_month_count, {r("coalesce(sum(hours), 0)")} AS internet_hours_sum,
      {r("coalesce(sum(hours), 0) / count(*)")} AS internet_hours_avg_per_month,
      {r("coalesce(sum(hours - school_average), 0) / count(*)")} AS internet_diff_mean"""


def sql_base(rules: str = "strict", usage: str = "usage") -> str:
    """All CTEs up to ``base``, the semester table."""
    join = "JOIN" if rules == "strict" else "LEFT JOIN"
    return f"""WITH {SQL_PROFILE}, {SQL_SNAPSHOT}, {SQL_YEARLY}, {SQL_FACTS},
course_agg AS (SELECT {_KEY}, count(*) AS selected_course_count FROM course GROUP BY ALL),
score_agg AS (SELECT {_KEY}, {sql_score_aggregates(rules)} FROM score GROUP BY {_KEY}),
usage_agg AS (SELECT {_KEY}, {SQL_USAGE_AGGREGATES} FROM {usage} GROUP BY {_KEY}),
risk_agg AS (
  SELECT {_KEY}, 1 AS risk, string_agg(DISTINCT type_code, '|' ORDER BY type_code) AS type_codes,
         string_agg(DISTINCT reason_code, '|' ORDER BY reason_code) AS reason_codes FROM status GROUP BY {_KEY}),
terms AS (
  SELECT {_KEY} FROM course_agg UNION SELECT {_KEY} FROM score_agg UNION SELECT {_KEY} FROM usage_agg
  UNION SELECT {_KEY} FROM risk_agg),
base AS (
  SELECT t.student_id, t.school_year, t.semester, {sql_order("t.school_year", "t.semester")} AS term_order,
    gender, grade, college, major, class_name,
    coalesce(selected_course_count, 0) AS selected_course_count, coalesce(score_course_count, 0) AS score_course_count,
    avg_score, score_std, coalesce(fail_course_count, 0) AS fail_course_count, fail_ratio, avg_gpa,
    coalesce(credit_sum, 0.0) AS credit_sum, coalesce(resit_exam_count, 0) AS resit_exam_count,
    coalesce(internet_month_count, 0) AS internet_month_count, coalesce(internet_hours_sum, 0.0) AS internet_hours_sum,
    internet_hours_avg_per_month, internet_diff_mean, online_learning_bfb_snapshot,
    CASE WHEN fitness_count > 0 THEN physical_test_score END AS physical_test_score,
    CASE WHEN fitness_count > 0 THEN physical_test_bmi END AS physical_test_bmi,
    coalesce(risk, 0) AS risk_event_current, type_codes AS risk_event_type_codes,
    reason_codes AS risk_event_reason_codes,
    lead(coalesce(risk, 0)) OVER (PARTITION BY t.student_id
      ORDER BY {sql_order("t.school_year", "t.semester")}, t.school_year, t.semester) AS risk_label_next_term
  FROM terms t {join} profile p ON t.student_id = p.student_id
  LEFT JOIN course_agg c ON t.student_id = c.student_id AND t.school_year = c.school_year AND t.semester = c.semester
  LEFT JOIN score_agg s ON t.student_id = s.student_id AND t.school_year = s.school_year AND t.semester = s.semester
  LEFT JOIN usage_agg u ON t.student_id = u.student_id AND t.school_year = u.school_year AND t.semester = u.semester
  LEFT JOIN risk_agg k ON t.student_id = k.student_id AND t.school_year = k.school_year AND t.semester = k.semester
  LEFT JOIN snapshot n ON t.student_id = n.student_id
  LEFT JOIN yearly y ON t.student_id = y.student_id AND t.school_year = y.school_year)"""


SQL_BASE = sql_base()

SQL_EMBEDDED_TERMS = """WITH term_rows AS (
  SELECT vec_id, CAST(vec_id // 10 AS VARCHAR) AS student_id, 2000 + (vec_id % 10) // 2 AS start_year,
         vec_id % 10 % 2 + 1 AS sem, embedding, label FROM embeddings),
embedded_terms AS (
  SELECT vec_id, student_id, concat(start_year, '-', start_year + 1) AS school_year, CAST(sem AS VARCHAR) AS semester,
    CAST(start_year * 10 + sem AS INTEGER) AS term_order, CAST(label AS INTEGER) AS cluster,
    CASE WHEN vec_id % 41 = 0 THEN 1 ELSE 0 END AS is_outlier, concat('College ', vec_id % 5) AS college,
    CASE WHEN vec_id % 7 <> 0 THEN concat('Major ', vec_id % 6) END AS major,
    CASE WHEN vec_id % 11 <> 0 THEN (vec_id * 7 % 240) / 4.0::DOUBLE + 40 END AS avg_score,
    vec_id % 4 AS fail_course_count, (vec_id * 13 % 400) / 4.0::DOUBLE AS internet_hours_sum,
    CAST(vec_id * 17 % 100 AS DOUBLE) AS online_learning_bfb_snapshot,
    (vec_id * 19 % 160) / 4.0::DOUBLE + 50 AS physical_test_score,
    CASE WHEN vec_id % 9 = 0 THEN 1 ELSE 0 END AS risk_event_current, embedding,
    CASE WHEN label BETWEEN 0 AND 8 THEN concat('group ', label) ELSE 'UNKNOWN' END AS cluster_name,
    lead(CASE WHEN vec_id % 9 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY student_id ORDER BY start_year, sem)
      AS risk_label_next_term_numeric
  FROM term_rows)"""

SQL_SCORED = """WITH scored AS (
  SELECT 'discount' AS model, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, l_discount * 10 AS pred_proba
  FROM lineitem
  UNION ALL
  SELECT 'tax', CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END, l_tax * 12.5::DOUBLE FROM lineitem)"""
