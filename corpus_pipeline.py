"""A corpus from documents to shards: toxic documents go, one of each group of near-duplicates stays, contaminated documents
go, sources are mixed to their weights, and what is left is dealt into shards of equal size.

Every stage takes all that its predecessor kept, and returns the columns of documents; the last adds its own. Between the
stages the documents are written to the shared folder and read again, so a lost executor costs no more than a stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortline.llm import decontamination, jaccard_join, mixing, sharding, toxicity
from cohortline.llm.frames import shared_folder, table, without

SHARDS = 16


#: Columns that the stages read. Others get plain names while an operator runs, so that none can clash with its own.
READ = ("doc_id", "text", "source")


def apart(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that ``stage`` returns, with the columns of ``docs`` and nothing else."""
    plain = [c if c in READ else f"column_{i}" for i, c in enumerate(docs.columns)]
    return stage(docs.toDF(*plain)).select(*plain).toDF(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier chain does not call toxic; a NULL text is not. Trained on the labels of these rows."""
    labels = table(spark, sf_dir, "labels")
    return apart(docs, lambda rows: toxicity.classified(rows, labels).where("NOT toxic"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates, that of the smallest id; texts without words stay."""
    return apart(docs, jaccard_join.one_of_each_class)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which less than a twentieth of the words occur in benchmark windows."""
    items = table(spark, sf_dir, "benchmark")
    return apart(docs, lambda rows: decontamination.find_contamination(rows, items).where("NOT contaminated"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mixture takes them: 0, 1 or 2 times."""
    return apart(docs, mixing.mix)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their place; columns that are named like one of the results are replaced."""
    kept = without(docs, ["size", "text_crc32", "law", "shard", "slot", "virtual_slot"])
    plain = [c if c in READ else f"column_{i}" for i, c in enumerate(kept.columns)]
    placed = sharding.with_positions(sharding.shard_records(kept.toDF(*plain), SHARDS), order=["doc_id", "size", "text_crc32"])
    own = ["size", "text_crc32", "law", "shard", "slot", "virtual_slot"]
    return placed.withColumn("law", F.lit("bytes")).select(*plain, *own).toDF(*kept.columns, *own)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", deal_shards),
]

#: The classifier of the first stage is trained, so SQL cannot give the rows; tests check the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
