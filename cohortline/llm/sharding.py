"""Fixed virtual slots: records hash into slots, bytes are summed per slot, a versioned map names the shard of a slot.

Only slot totals and the map, both of ``slots`` rows, are ever brought together; records are never moved for planning.
A new version of the map moves only the slots that it must: every shard keeps its largest slots up to the mean load, and
the rest goes, largest first, to the least loaded shard.

Defined results: a NULL text has no bytes and size 1; a NULL key hashes like any value; repeated rows are rows of their
own, and those of a row that occurs more than ``COPIES`` times are numbered and spread over the slots by their number; an
empty table gives no rows; a column of the input with the name of a result column is replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortline.llm.frames import apart_if_hot, shared_folder, without

SLOTS = 4096


def text_bytes(text: str = "text") -> Column:
    return (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long")


def with_slots(docs: DataFrame, keys: Sequence[str] = ("doc_id",), text: str = "text", slots: int = SLOTS) -> DataFrame:
    """Add ``size``, ``text_crc32`` and ``virtual_slot``. The text's checksum is part of the hashed key, so that a key
    value shared by very many records does not fill one slot; nor does a record that is repeated very often, whose copies
    have their number in the key."""
    docs = without(docs, ["size", "text_crc32", "virtual_slot", "_row", "_lane", "_copy"])
    crc = F.crc32(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"))
    out = docs.withColumns({"size": text_bytes(text), "text_crc32": crc})
    rare, often = apart_if_hot(out.withColumn("_row", F.xxhash64(*keys, "text_crc32")), "_row", "_copy")
    slot = lambda rows, key: rows.withColumn("virtual_slot", F.pmod(key, F.lit(slots)).cast("int"))
    placed = slot(rare, F.col("_row"))
    if often is not None:
        placed = placed.unionByName(slot(often, F.xxhash64("_row", "_copy")).drop("_copy"))
    return placed.drop("_row")


def slot_bytes(slotted: DataFrame) -> DataFrame:
    return slotted.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("records"))


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1: slots dealt out in turn."""
    ids = spark.range(0, slots, 1, 1).select(F.col("id").cast("int").alias("virtual_slot"))
    return ids.select(
        F.lit(1).alias("version"), "virtual_slot", F.pmod(F.col("virtual_slot"), F.lit(shards)).cast("int").alias("shard")
    )


def latest(maps: DataFrame) -> DataFrame:
    """The current shard of every slot in a table of all versions."""
    last = maps.groupBy("virtual_slot").agg(F.max(F.struct("version", "shard")).alias("m"))
    return last.select(F.col("m.version").alias("version"), "virtual_slot", F.col("m.shard").alias("shard"))


def edited_map(current: DataFrame, totals: DataFrame, shards: int) -> DataFrame:
    """The next version of a map: equal bytes on ``shards`` shards (more or fewer than before) with few moves.

    All rows here are slots, so the windows and the fold hold ``slots`` rows at any data size.
    """
    sized = (
        current.join(totals, "virtual_slot", "left")
        .select("version", "virtual_slot", "shard", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"))
    )
    running = W.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot").rowsBetween(W.unboundedPreceding, 0)
    mean = F.lit(sized.agg(F.sum("bytes")).scalar()) / F.lit(shards)
    kept = (F.col("shard") < shards) & (F.sum("bytes").over(running) <= mean)
    marked = sized.withColumn("kept", kept)
    one = marked.groupBy().agg(
        F.max("version").alias("version"),
        F.sort_array(
            F.collect_list(F.when(~F.col("kept"), F.struct("bytes", F.negate("virtual_slot").alias("order")))), asc=False
        ).alias("free"),
        F.collect_list(F.when(F.col("kept"), F.struct("virtual_slot", "shard", "bytes"))).alias("stay"),
    )
    loads = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)),
        lambda i: F.aggregate(
            F.filter("stay", lambda s: s["shard"] == i), F.lit(0).cast("long"), lambda total, s: total + s["bytes"]
        ),
    )

    def place(state: Column, slot: Column) -> Column:
        goal = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int")
        return F.struct(
            F.transform(state["loads"], lambda x, i: F.when(i == goal - 1, x + slot["bytes"]).otherwise(x)).alias("loads"),
            F.array_append(state["goals"], goal - 1).alias("goals"),
        )

    start = F.struct(F.col("loads").alias("loads"), F.array().cast("array<int>").alias("goals"))
    folded = one.withColumn("loads", loads).withColumn("goals", F.aggregate("free", start, place)["goals"])
    moved = folded.select(
        "version",
        F.explode(
            F.concat(
                F.transform("stay", lambda s: F.struct(s["virtual_slot"].alias("virtual_slot"), s["shard"].alias("shard"))),
                F.zip_with("free", "goals", lambda s, g: F.struct(F.negate(s["order"]).alias("virtual_slot"), g.alias("shard"))),
            )
        ).alias("s"),
    )
    return moved.select((F.col("version") + 1).alias("version"), "s.virtual_slot", "s.shard")


def store_map(edited: DataFrame, path: str) -> None:
    """Append one version to the stored map; earlier versions stay readable."""
    edited.repartition(1).write.mode("append").partitionBy("version").parquet(path)


def stored_map(spark: SparkSession, path: str) -> DataFrame:
    """All stored versions."""
    return spark.read.schema("virtual_slot int, shard int, version int").parquet(path).select("version", "virtual_slot", "shard")


def assign(slotted: DataFrame, current: DataFrame) -> DataFrame:
    """The shard of every record. The map has ``slots`` rows, so it is broadcast."""
    return without(slotted, ["shard"]).join(F.broadcast(current.select("virtual_slot", "shard")), "virtual_slot")


def with_positions(assigned: DataFrame, order: Sequence[str]) -> DataFrame:
    """``slot``: the place of a record in its shard, from 0 without gaps. Records are ranked inside their virtual slot, a
    few thousandths of a percent of the data, and slots start where the slot before them in the shard ends."""
    assigned = without(assigned, ["slot"])
    counts = assigned.groupBy("shard", "virtual_slot").agg(F.count("*").alias("_n"))
    before = W.partitionBy("shard").orderBy("virtual_slot").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("shard", "virtual_slot", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = W.partitionBy("shard", "virtual_slot").orderBy(*order)
    ranked = assigned.withColumn("_rank", F.row_number().over(inside) - 1)
    placed = ranked.join(F.broadcast(offsets), ["shard", "virtual_slot"])
    return placed.withColumn("slot", (F.col("_offset") + F.col("_rank")).cast("long")).drop("_offset", "_rank")


def shard_records(
    docs: DataFrame, shards: int = 16, keys: Sequence[str] = ("doc_id",), text: str = "text", path: str | None = None
) -> DataFrame:
    """All records with ``size``, ``text_crc32``, ``virtual_slot``, ``shard``.

    Version 1 of the map deals the slots out in turn, version 2 is edited for the bytes that the slots really hold. Both are
    stored under ``path`` (a new shared folder by default), and records are assigned from the latest stored one.
    """
    spark = docs.sparkSession
    path = path or shared_folder(spark, "shard-map")
    slotted = with_slots(docs, keys, text)
    store_map(first_map(spark, shards), path)
    store_map(edited_map(latest(stored_map(spark, path)), slot_bytes(slotted), shards), path)
    return assign(slotted, latest(stored_map(spark, path)))
