"""Small helpers shared by the operators: tables, result columns, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortline.session import cut_lineage, ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the checkpoint folder, which all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drop columns that a result column of the same name (in any case) replaces."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def fields(ddl: str) -> list[T.StructField]:
    return list(T._parse_datatype_string(ddl).fields)


def append_columns(
    df: DataFrame, ddl: str, compute: Callable[[Iterator[pa.RecordBatch]], Iterator[list]], hidden: Sequence[str] = ()
) -> DataFrame:
    """Rows of ``df`` with further columns from Arrow batches.

    ``compute`` yields, for each batch, one array per new column. ``hidden`` columns are read but not returned.
    """
    added = fields(ddl)
    df = without(df, [f.name for f in added])
    kept = [f for f in df.schema.fields if f.name not in hidden]

    def run(batches):
        def seen():
            for batch in batches:
                last.append(batch)
                yield batch

        last: list[pa.RecordBatch] = []
        for columns in compute(seen()):
            batch = last.pop()
            own = [batch.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays([*own, *columns], names=[*(f.name for f in kept), *(f.name for f in added)])

    return df.mapInArrow(run, T.StructType([*kept, *added]))


#: Rows of one key that may be numbered in one task; more are numbered in ``LANES`` parts.
COPIES = 16
LANES = 1024


def apart_if_hot(df: DataFrame, key: str, name: str, many: int = COPIES) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose long ``key`` has at most ``many`` rows, and the others (or None) with ``name``: 0, 1, 2, ... within the key.

    A key may hold any share of the rows: its rows are dealt to lanes and written, numbered lane by lane, and a lane starts
    where the one before it ends. The frequent keys are written, so Spark knows their size before it joins them.
    """
    spark, path = df.sparkSession, shared_folder(df.sparkSession, "frequent-keys")
    df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > many).select(key).write.parquet(path)
    frequent = spark.read.schema(f"{key} long").parquet(path)
    if frequent.isEmpty():
        return df, None
    lane = F.pmod(F.monotonically_increasing_id(), F.lit(LANES)).alias("_lane")
    dealt = cut_lineage(df.join(frequent, key, "left_semi").select("*", lane))
    counts = dealt.groupBy(key, "_lane").agg(F.count("*").alias("_n"))
    before = W.partitionBy(key).orderBy("_lane").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(key, "_lane", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    number = (F.row_number().over(W.partitionBy(key, "_lane").orderBy("_lane")) - 1).cast("long")
    numbered = dealt.withColumn(name, number).join(offsets, [key, "_lane"]).withColumn(name, F.col(name) + F.col("_before"))
    columns = [f"`{c}`" for c in [*df.columns, name]]
    return df.join(frequent, key, "left_anti").select(*columns[:-1]), numbered.select(*columns)


def row_key(*columns: Column) -> Column:
    return F.xxhash64(*columns)


def _both_ends(pairs: DataFrame) -> DataFrame:
    """Every pair from both ends; one pass over the partitions of ``pairs``, which a union would read twice."""
    ends = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return pairs.select(F.explode(ends).alias("e")).select("e.a", "e.b")


def _is_star_forest(pairs: DataFrame) -> bool:
    """Whether every node of ``pairs(a, b)``, a above b, has at most one neighbour below it, and then none above it."""
    below = F.count(F.when(F.col("b") < F.col("a"), 1))
    nodes = _both_ends(pairs).groupBy("a").agg(below.alias("below"), F.count("*").alias("all"))
    return nodes.agg(F.count(F.when((F.col("below") > 0) & (F.col("all") > 1), 1))).first()[0] == 0


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``: the smallest node it can reach.

    Alternating large and small stars: every round hooks the neighbours of a node to the smallest of them, so the
    depth falls geometrically. Rounds end with a forest of stars, which may be what is given. Rows are edges; no node's
    neighbours are ever collected. A node with very many neighbours is only the key of a ``min``, which combines before the
    shuffle, and of a join.
    """
    pairs = cut_lineage(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    )
    while not _is_star_forest(pairs):
        lowest = _both_ends(pairs).groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        upwards = pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))
        large = upwards.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        floor = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(floor, "a")
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a <> b")
            .distinct()
        )
        pairs = cut_lineage(small)
    roots = pairs.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def dealt_by(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Rows of a key in one partition, sorted by key (and ``order``).

    The exchange is by a hash of the key: Spark drops one by the key itself if the rows come from a join on that key, and
    may then still split large partitions of the join, which would tear groups apart.
    """
    return df.repartition(F.xxhash64(F.col(key))).sortWithinPartitions(key, *order)


def map_sorted_groups(df: DataFrame, key: str, ddl: str, work: Callable[[pa.Table], list | None]) -> DataFrame:
    """Rows of a long ``key`` together, one call per key, many small groups per Arrow batch. The caller bounds the groups.

    Cheaper than a Python call with a frame of its own per group: partitions are sorted by key and cut where it changes.
    """
    import numpy as np

    names = [f.name for f in fields(ddl)]

    def run(batches):
        rest: list[pa.RecordBatch] = []
        out: list[list] = []

        def flush():
            whole = [pa.concat_arrays([pa.array(o[i]) if not isinstance(o[i], pa.Array) else o[i] for o in out]) for i in range(len(names))]
            out.clear()
            return pa.RecordBatch.from_arrays(whole, names=names)

        def take(part: pa.Table):
            done = work(part)
            if done is not None and len(done[0]):
                out.append(done)

        for batch in batches:
            keys = batch.column(key).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(keys)) + 1
            if rest and len(keys) and rest[-1].column(key)[-1].as_py() != keys[0]:
                take(pa.Table.from_batches(rest))
                rest = []
            begin = 0
            for end in cuts.tolist():
                piece = batch.slice(begin, end - begin)
                take(pa.Table.from_batches([*rest, piece]))
                rest = []
                begin = end
                if len(out) >= 2000:
                    yield flush()
            if len(keys):
                rest.append(batch.slice(begin))
        if rest:
            take(pa.Table.from_batches(rest))
        if out:
            yield flush()

    return dealt_by(df, key).mapInArrow(run, ddl)


def tiled(members: DataFrame, group: str, size: str, limit: int, node: str = "node") -> DataFrame:
    """Cut groups into tiles of about ``limit`` members so that every pair of members meets in exactly one pair of tiles.

    Adds ``tile_pair`` (a long key) and ``side``: 0 and 1 in a pair of two tiles, 2 if the tile meets itself. A group
    of n members sends each of them to n / limit pairs; no task ever holds more than two tiles.
    """
    count = F.ceil(F.col(size) / limit).cast("int")
    own = F.pmod(F.xxhash64(node), F.greatest(count, F.lit(1))).cast("int")
    dealt = members.withColumns({"_n": count, "_t": own}).withColumn("_u", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    side = F.when(F.col("_t") == F.col("_u"), 2).when(F.col("_t") < F.col("_u"), 0).otherwise(1)
    pair = F.xxhash64(group, F.least("_t", "_u"), F.greatest("_t", "_u"))
    return dealt.withColumns({"tile_pair": pair, "side": side}).drop("_n", "_t", "_u")


def marked_around(members: DataFrame, group: str, payload: str, near: Callable) -> DataFrame:
    """``(group, node, pivot, near)``: which members of a large group are near its smallest node.

    ``near`` gets the payloads of members and pivots (lists of bytes) and returns booleans. The pivot of a group is one
    row, so a group of any size is a join that Spark can split, and linear work.
    """
    lowest = members.groupBy(group).agg(F.min("node").alias("pivot"))
    pivots = members.select(group, F.col("node").alias("pivot"), F.col(payload).alias("_pivot")).join(lowest, [group, "pivot"])

    def run(batches):
        for batch in batches:
            flags = near(batch.column(payload).to_pylist(), batch.column("_pivot").to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (group, "node", "pivot")), pa.array(flags)], names=[group, "node", "pivot", "near"])

    both = members.select(group, "node", payload).join(pivots, group)
    return both.mapInArrow(run, f"{group} long, node long, pivot long, near boolean")


def tiled_around(marked: DataFrame, group: str, limit: int) -> DataFrame:
    """As ``tiled``, without the pairs of two members that are both near the pivot: what the caller knows of them
    already. Members near the pivot are sent to the tiles of the others only, which are few where a group is dense."""
    counts = marked.groupBy(group).agg(F.count(F.when(F.col("near"), 1)).alias("_a"), F.count(F.when(~F.col("near"), 1)).alias("_r"))
    tiles = counts.where("_r > 0").select(group, F.ceil(F.col("_a") / limit).cast("int").alias("_a"), F.ceil(F.col("_r") / limit).cast("int").alias("_r"))
    dealt = marked.join(tiles, group).withColumn("_t", F.pmod(F.xxhash64("node"), F.when(F.col("near"), F.col("_a")).otherwise(F.col("_r"))).cast("int"))

    def pair(kind: int, low: Column, high: Column, side: Column) -> Column:
        return F.struct(F.xxhash64(group, F.lit(kind), low, high).alias("tile_pair"), side.cast("int").alias("side"))

    t = F.col("_t")
    upto = lambda n: F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda u: u < n)
    rest = F.transform(
        upto(F.col("_r")), lambda u: pair(0, F.least(t, u), F.greatest(t, u), F.when(t == u, 2).when(t < u, 0).otherwise(1))
    )
    across = F.transform(upto(F.col("_a")), lambda u: pair(1, t, u, F.lit(0)))
    dense = F.transform(upto(F.col("_r")), lambda u: pair(1, u, t, F.lit(1)))
    goals = F.when(F.col("near"), dense).otherwise(F.concat(rest, across))
    return dealt.select(group, "node", F.explode(goals).alias("_g")).select(group, "node", "_g.tile_pair", "_g.side")


def star_roots(nodes, left, right):
    """Smallest node reachable from each position by the given links (arrays of positions)."""
    import numpy as np

    label = np.asarray(nodes).copy()
    while len(left):
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        if (before == label).all():
            break
    return label
