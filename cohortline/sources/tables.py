"""Table input and output. Formats, pruning and pushdown are Spark's own readers and writers."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A raw table is recognised by the columns it must have. Order matters: first hit wins.
SIGNATURES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("student_basic", ("XH", "XSM", "ZYM", "CSRQ", "JG", "MZMC")),
    ("student_fitness", ("XM", "XH", "CFBFS", "HSCJ", "XQ")),
    ("physical_test", ("XH", "TCNF", "BMI", "FHL", "WS", "LDTY")),
    ("pe_class", ("XH", "ZKC", "KC", "SKSJ")),
    ("daily_exercise", ("XH", "ZC", "DKCS")),
    ("graduation", ("SID", "GRADE", "BYQXMC")),
    ("online_learning", ("LOGIN_NAME", "ROLEID", "BFB", "DEPARTMENT_NAME", "MAJOR_NAME", "CLASS_NAME")),
    ("class_task", ("LOGIN_NAME", "USER_ID", "COURSE_ID", "JOB_NUM", "TASK_RATE")),
    ("sign_record", ("LOGIN_NAME", "ACTIVE_ID", "ROLE", "XYMC", "MAJORNAME", "CLASSNAME")),
    ("homework_submit", ("CREATER_LOGIN_NAME", "WORK_ID", "COMMENT", "SCORE", "TYPE")),
    ("exam_submit", ("CREATER_LOGIN_NAME", "WORK_ID", "FULLMARKS", "SCORE", "TYPE")),
    ("discussion", ("CREATER_LOGIN_NAME", "REPLY_LOGIN_NAME", "TOPIC_ID", "TOPIC_TITLE")),
    ("student_score", ("XH", "KCH", "KCCJ", "JDCJ")),
    ("course_select", ("XH", "JXBH", "KCH", "KKXN", "KKXQ")),
    ("status_change", ("XH", "YDRQ", "YDLBDM", "SFZX")),
    ("attendance_summary", ("XH", "RQ", "ZT", "DKSJ")),
    ("internet_stats", ("XSBH", "TJNY", "SWLJSC")),
    ("scholarship", ("XSBH", "JXJMC", "FFJE")),
    ("club", ("XSBH", "HDRQ")),
    ("running", ("USERNUM", "PUNCH_DAY", "TERM_ID")),
    ("access", ("IDSERTAL", "LOGINTIME", "LOGINADDRESS")),
    ("library", ("cardld", "visittime", "gateno")),
    ("cet", ("KS_XH", "KS_YYJB", "KS_CJ")),
    ("competition", ("XHHGH", "JSMC", "HJJB", "HJDJ")),
)

# The columns that the semester base asks of its tables. A fitness table need not hold the single exercises.
SEMESTER_SIGNATURES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("student_basic", ("XH", "XB", "MZMC", "ZZMMMC", "CSRQ", "JG", "XSM", "ZYM")),
    ("physical_test", ("XH", "XB", "NJ", "YX", "ZY", "BJ", "BH", "TCNF", "ZF")),
    ("online_learning", ("LOGIN_NAME", "XM", "DEPARTMENT_NAME", "MAJOR_NAME", "CLASS_NAME", "ROLEID", "BFB")),
    ("course_select", ("XH", "JXBH", "KCH", "KKXN", "KKXQ")),
    ("student_score", ("XH", "ZXJXJHH", "KCH", "KXH", "KCCJ", "JDCJ")),
    ("internet_stats", ("XSBH", "TJNY", "SWLJSC")),
    ("status_change", ("XH", "YDRQ", "YDLBDM", "YDYYDM", "SPRQ", "SFZX")),
)

ORDINAL = "ordinal"


def match_source(columns: Iterable[str], signatures: Sequence[tuple[str, tuple[str, ...]]] = SIGNATURES) -> str | None:
    """Alias of the first signature whose columns are all present, ignoring case."""
    present = {name.lower() for name in columns}
    return next((alias for alias, needed in signatures if present.issuperset(n.lower() for n in needed)), None)


def match_sources(
    tables: Iterable[DataFrame],
    required: Iterable[str],
    signatures: Sequence[tuple[str, tuple[str, ...]]] = SIGNATURES,
) -> dict[str, DataFrame]:
    """Recognise tables by their columns; a required alias that stays empty, or is found twice, is an error."""
    found: dict[str | None, DataFrame] = {}
    for df in tables:
        alias = match_source(df.columns, signatures)
        if alias is not None and alias in found:
            raise ValueError(f"two tables look like {alias}: union them first")
        found[alias] = df
    missing = [alias for alias in required if alias not in found]
    if missing:
        raise ValueError(f"no table found for: {', '.join(missing)}")
    return {alias: df for alias, df in found.items() if alias is not None}


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    present = {name.lower() for name in df.columns}
    missing = [name for name in columns if name.lower() not in present]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_raw(
    spark: SparkSession,
    path: str,
    columns: Sequence[str],
    fmt: str = "parquet",
    with_ordinal: bool = False,
) -> DataFrame:
    """Named columns of a raw table, every cell as text.

    ``with_ordinal`` adds the row's place (file, then row in file), which operators that keep the "first" value need.
    Parquet numbers its rows. A split of a text file is read in order by one task, so file, start of the split and a
    number that grows within the task order its rows, wherever the file is cut.
    """
    if fmt == "csv":
        df = spark.read.csv(path, header=True, inferSchema=False)
        place = ["_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row")]
    else:
        df = spark.read.format(fmt).load(path)
        place = ["_metadata.file_path", "_metadata.row_index"]
    picked: list[Column] = [F.col(c).cast("string").alias(c) for c in columns]
    if with_ordinal:
        picked.append(F.struct(*place).alias(ORDINAL))
    return df.select(*picked)


def read_table(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """Typed read of a derived table; blanks and NaN become NULL."""
    reader = spark.read.schema(schema)
    df = reader.csv(path, header=True, nullValue="", emptyValue="") if fmt == "csv" else reader.format(fmt).load(path)
    real = (T.DoubleType, T.FloatType)
    return df.select(
        *[F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if isinstance(f.dataType, real) else F.col(f.name) for f in schema.fields]
    )


def write_table(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] = (),
    sort_by: Sequence[str] = (),
    fmt: str = "parquet",
) -> None:
    """Overwrite a table. Rows are sorted inside each file, never gathered into one task.

    For a partitioned table the rows are rebalanced by partition first: without that every task writes a
    small file into every partition. Adaptive execution splits a partition that holds most of the rows.
    """
    if partition_by:
        df = df.hint("rebalance", *[F.col(c) for c in partition_by])
    if sort_by:
        df = df.sortWithinPartitions(*partition_by, *sort_by)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.csv(path, header=True)
    else:
        writer.format(fmt).save(path)


def write_summary(df: DataFrame, path: str) -> None:
    """Run summary (one row, nested) as JSON."""
    df.write.mode("overwrite").json(path)


def columns_with_prefix(df: DataFrame, prefix: str = "emb_", but_not: str = "emb_scaled_") -> list[str]:
    """Names of spread-out vector columns, for tables that do not hold one array column."""
    return [name for name in df.columns if name.startswith(prefix) and not name.startswith(but_not)]


def gather_vector(df: DataFrame, names: Sequence[str], alias: str = "embedding") -> DataFrame:
    """Spread-out vector columns as one array column."""
    return df.select(
        *[c for c in df.columns if c not in set(names)],
        F.array(*[F.col(n).cast("float") for n in names]).alias(alias),
    )
