"""Column functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline import functions as fn
from cohortline.functions.codes import GENDER_CODES, HIGH_RISK_TYPES
from cohortline.operators.personas import PERSONA_ORDER
from cohortline.workload.campus import NUMBER, Campus, r, sql_double, sql_semester, sql_text, sql_year
from cohortline.workload.registry import query


@query(f"""
WITH dirty AS (
  SELECT p_partkey, concat(' \t', upper(p_name), '　') AS raw, CASE WHEN p_partkey % 4 = 0 THEN '　 ' ELSE p_brand END AS brand,
         concat(p_type, '   ', p_name) AS label FROM part)
SELECT p_partkey, lower({sql_text("raw")}) AS id_norm, {sql_text("brand")} IS NULL AS blank,
       coalesce(nullif(brand, ''), 'UNKNOWN') AS filled, coalesce({sql_text("brand")}, {sql_text("raw")}) AS first_value,
       CASE WHEN {sql_text("brand")} IS NOT NULL THEN concat(lower({sql_text("brand")}), '|',
         lower(regexp_replace({sql_text("label")}, '\\s+', ' ', 'g'))) END AS org,
       lower(regexp_replace({sql_text("label")}, '\\s+', ' ', 'g')) AS label_norm
FROM dirty""")
def scalar_ids_text(c: Campus) -> DataFrame:
    dirty = c.table("part").select(
        "p_partkey",
        F.concat(F.lit(" \t"), F.upper("p_name"), F.lit("　")).alias("raw"),
        F.when(F.col("p_partkey") % 4 == 0, "　 ").otherwise(F.col("p_brand")).alias("brand"),
        F.concat("p_type", F.lit("   "), "p_name").alias("label"),
    )
    raw, brand, label = F.col("raw"), F.col("brand"), F.col("label")
    return dirty.select(
        "p_partkey",
        fn.normalize_id(raw).alias("id_norm"),
        fn.is_blank(brand).alias("blank"),
        fn.fill_unknown(brand).alias("filled"),
        fn.first_non_blank(brand, raw).alias("first_value"),
        fn.org_key(brand, label).alias("org"),
        fn.normalize_text(label).alias("label_norm"),
    )


_DIRTY_NUMBER = """CASE l_linenumber
    WHEN 1 THEN regexp_replace(CAST(l_extendedprice AS VARCHAR), '^(\\d+)(\\d{3})\\b', '\\1,\\2')
    WHEN 2 THEN '' WHEN 3 THEN '1d' WHEN 4 THEN 'abc' WHEN 5 THEN concat(' ', l_quantity, ' ') WHEN 6 THEN '1e3'
    ELSE CAST(l_extendedprice AS VARCHAR) END"""


@query(f"""
WITH dirty AS (SELECT l_orderkey, l_linenumber, l_extendedprice, l_quantity, {_DIRTY_NUMBER} AS raw FROM lineitem),
parsed AS (SELECT *, {sql_double("raw")} AS number FROM dirty)
SELECT l_orderkey, l_linenumber, l_extendedprice, l_quantity, raw, number, {r("l_extendedprice / 32")} AS rounded,
       coalesce(number BETWEEN 0 AND 100, false) AS is_valid_score,
       CASE WHEN number IS NOT NULL THEN {r("ln(1 + greatest(number - 1000, 0))", 6)} END AS log_clipped,
       {r("sign(number - 1000) * ln(1 + abs(number - 1000))", 6)} AS log_signed
FROM parsed""")
def scalar_numbers(c: Campus) -> DataFrame:
    price = F.col("l_extendedprice").cast("string")
    raw = (
        F.when(F.col("l_linenumber") == 1, F.regexp_replace(price, r"^(\d+)(\d{3})\b", "$1,$2"))
        .when(F.col("l_linenumber") == 2, "")
        .when(F.col("l_linenumber") == 3, "1d")
        .when(F.col("l_linenumber") == 4, "abc")
        .when(F.col("l_linenumber") == 5, F.concat(F.lit(" "), F.col("l_quantity").cast("string"), F.lit(" ")))
        .when(F.col("l_linenumber") == 6, "1e3")
        .otherwise(price)
    )
    parsed = c.table("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", raw.alias("raw"))
    parsed = parsed.withColumn("number", fn.to_double(F.col("raw")))
    shifted = F.col("number") - 1000
    return parsed.select(
        "*",
        fn.round4(F.col("l_extendedprice") / 32).alias("rounded"),
        F.coalesce(fn.valid_score(F.col("number")), F.lit(False)).alias("is_valid_score"),
        fn.half_even(fn.log1p_clip(shifted), 6).alias("log_clipped"),
        fn.half_even(fn.signed_log1p(shifted), 6).alias("log_signed"),
    )


_DAY = "CAST(o_orderdate AS DATE)"
_DIRTY_DATE = f"""CASE o_orderkey % 7
    WHEN 0 THEN strftime(o_orderdate, '%Y%m%d') WHEN 1 THEN CAST(date_diff('day', DATE '1899-12-30', {_DAY}) AS VARCHAR)
    WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 3 THEN strftime(o_orderdate, '%Y%m')
    WHEN 4 THEN strftime(o_orderdate, ' %Y/%-m/%-d') WHEN 5 THEN '20201332' ELSE ' ' END"""
_PARSED_DATE = f"""CASE
    WHEN regexp_full_match(t, '\\d{{8}}') THEN CAST(try_strptime(t, '%Y%m%d') AS DATE)
    WHEN regexp_full_match(t, '(19|20)\\d{{2}}(0[1-9]|1[0-2])') THEN CAST(try_strptime(concat(t, '01'), '%Y%m%d') AS DATE)
    WHEN regexp_full_match(t, '{NUMBER}') THEN DATE '1899-12-30' + CAST(trunc(TRY_CAST(t AS DOUBLE)) AS INTEGER)
    ELSE CAST(coalesce(try_strptime(t, '%Y-%m-%d'), try_strptime(t, '%Y/%m/%d')) AS DATE) END"""


@query(f"""
WITH dirty AS (SELECT o_orderkey, o_orderdate, {_DIRTY_DATE} AS raw FROM orders),
trimmed AS (SELECT *, {sql_text("raw")} AS t FROM dirty),
parsed AS (SELECT *, {_PARSED_DATE} AS parsed_date FROM trimmed),
dated AS (SELECT *, coalesce(parsed_date, {_DAY}) AS d FROM parsed),
termed AS (SELECT *, {sql_year("d")} AS school_year, {sql_semester("d")} AS semester FROM dated),
planned AS (SELECT *, concat(CASE WHEN o_orderkey % 10 = 0 THEN ' ' ELSE '' END, school_year, '-', semester) AS plan FROM termed)
SELECT o_orderkey, raw, parsed_date, d AS first_date, school_year, semester,
       CASE WHEN o_orderkey % 10 <> 0 THEN school_year END AS plan_year,
       CASE WHEN o_orderkey % 10 <> 0 THEN semester END AS plan_semester,
       CASE WHEN o_orderkey % 10 <> 0 THEN CAST(CAST(substr(school_year, 1, 4) AS INTEGER) * 10 + CAST(semester AS INTEGER) AS INTEGER)
            ELSE -1 END AS plan_order,
       CASE WHEN regexp_full_match(t, '\\d{{4}}') THEN concat(t, '-', CAST(t AS INTEGER) + 1) END AS year_of_raw,
       concat(year(o_orderdate), '-', year(o_orderdate) + 1) AS year_of_order
FROM planned""")
def scalar_dates_terms(c: Campus) -> DataFrame:
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    raw = (
        F.when(key % 7 == 0, F.date_format(day, "yyyyMMdd"))
        .when(key % 7 == 1, F.datediff(day, F.lit("1899-12-30").cast("date")).cast("string"))
        .when(key % 7 == 2, F.date_format(day, "yyyy-MM-dd"))
        .when(key % 7 == 3, F.date_format(day, "yyyyMM"))
        .when(key % 7 == 4, F.date_format(day, " yyyy/M/d"))
        .when(key % 7 == 5, "20201332")
        .otherwise(" ")
    )
    rows = c.table("orders").select("o_orderkey", "o_orderdate", raw.alias("raw"))
    parsed = fn.to_date_flexible(F.col("raw"))
    first = fn.coalesce_dates(F.col("raw"), F.date_format("o_orderdate", "yyyyMMdd"))
    rows = rows.withColumns({"parsed_date": parsed, "first_date": first})
    term = fn.term_of_date(F.col("first_date"))
    rows = rows.withColumns({"school_year": term["school_year"], "semester": term["semester"]})
    lead = F.when(key % 10 == 0, " ").otherwise("")
    plan = fn.term_of_plan(F.concat(lead, "school_year", F.lit("-"), "semester"))
    padded_year = F.concat(lead, "school_year")
    return rows.select(
        "o_orderkey",
        "raw",
        "parsed_date",
        "first_date",
        "school_year",
        "semester",
        plan["school_year"].alias("plan_year"),
        plan["semester"].alias("plan_semester"),
        fn.term_order(padded_year, F.col("semester")).alias("plan_order"),
        fn.school_year_of(fn.strip(F.col("raw"))).alias("year_of_raw"),
        fn.school_year_of(F.year("o_orderdate").cast("string")).alias("year_of_order"),
    )


_ORDER_CASE = " ".join(f"WHEN '{name}' THEN {i}" for i, name in enumerate(PERSONA_ORDER))
_NAME_CASE = " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(PERSONA_ORDER))


@query(f"""
WITH raw AS (
  SELECT p_partkey, p_size, p_retailprice, p_brand, p_type,
    CASE WHEN p_partkey % 5 = 0 THEN concat(p_size, '/') ELSE concat(' ', p_size, ' / ', CAST(p_retailprice AS VARCHAR)) END AS pair,
    CASE p_partkey % 3 WHEN 0 THEN '男' WHEN 1 THEN '女' END AS gender,
    CASE p_partkey % 7 {_NAME_CASE} ELSE 'other' END AS mode_name FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_size AS DOUBLE) END AS height_cm,
       CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice END AS weight_kg,
       CASE gender WHEN '男' THEN 0 WHEN '女' THEN 1 ELSE 0 END AS gender_code,
       concat(least(p_brand, p_type), '|', greatest(p_brand, p_type)) AS codes,
       CAST(p_size AS VARCHAR) IN ('1', '3', '11', '13') OR p_brand = 'Brand#7' AS is_risk,
       concat(CASE WHEN p_retailprice >= 1000 THEN 'OK' ELSE 'WARN' END, CASE WHEN p_size = 1 THEN ' BEST' ELSE '' END) AS status,
       CAST(CASE mode_name {_ORDER_CASE} ELSE 999 END AS INTEGER) AS place
FROM raw""")
def scalar_pairs_codes(c: Campus) -> DataFrame:
    key = F.col("p_partkey")
    size = F.col("p_size").cast("string")
    pair = F.when(key % 5 == 0, F.concat(size, F.lit("/"))).otherwise(
        F.concat(F.lit(" "), size, F.lit(" / "), F.col("p_retailprice").cast("string"))
    )
    ratio = fn.parse_ratio_pair(pair)
    gender = F.when(key % 3 == 0, "男").when(key % 3 == 1, "女")
    mode = F.lit("other")
    for i, name in enumerate(PERSONA_ORDER):
        mode = F.when(key % 7 == i, name).otherwise(mode)
    return c.table("part").select(
        "p_partkey",
        ratio["height_cm"].alias("height_cm"),
        ratio["weight_kg"].alias("weight_kg"),
        fn.map_code(gender, GENDER_CODES).alias("gender_code"),
        fn.join_codes(F.array("p_type", "p_brand")).alias("codes"),
        fn.in_code_set(size, HIGH_RISK_TYPES, F.col("p_brand"), "Brand#7").alias("is_risk"),
        fn.threshold_status(F.col("p_retailprice"), F.col("p_size"), 1000.0).alias("status"),
        fn.list_position(mode, PERSONA_ORDER).alias("place"),
    )


@query(f"""
WITH pairs AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a, list_reverse(CAST(embedding AS DOUBLE[])) AS b FROM embeddings)
SELECT vec_id, {r("list_distance(a, b)", 6)} AS distance, {r("list_cosine_similarity(a, b)", 6)} AS similarity,
       {r("a[1] / sqrt(list_inner_product(a, a))", 6)} AS unit_first
FROM pairs""")
def vector_functions(c: Campus) -> DataFrame:
    pairs = c.table("embeddings").select("vec_id", F.col("embedding").alias("a"), F.reverse("embedding").alias("b"))
    a, b = F.col("a"), F.col("b")
    return pairs.select(
        "vec_id",
        fn.half_even(fn.vec_distance(a, b), 6).alias("distance"),
        fn.half_even(fn.cosine(a, b), 6).alias("similarity"),
        fn.half_even(fn.l2_normalize(a)[0], 6).alias("unit_first"),
    )


