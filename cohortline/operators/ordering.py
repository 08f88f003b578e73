"""Running totals, exact quantiles and row positions over a global order.

A window without PARTITION BY sends every row to one task. Here the rows are range-partitioned by the
order instead; each block sums its own rows, and the few block totals give every block its offset.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortline.session import cut_lineage

BLOCK = "_block"
_GROUP = "_group"


def running_totals(
    df: DataFrame,
    order: Sequence[str],
    sums: Sequence[str],
    by: Sequence[str] = (),
    descending: bool = False,
    block: Column | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Add ``<sum>_before``: the total over the rows of the same ``by`` group that sort earlier.

    The input holds one row per (by, order), with no NULL in either: aggregate ties first, so a value
    shared by a third of all rows is a single row here. ``block`` may name a coarser key in the same
    order (for instance leading hash digits, ascending); without it the blocks are those of a range
    exchange.
    """
    keys = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    if block is None:
        return _totals_in_ranges(df, keys, sums, by, partitions)
    if descending:
        raise ValueError("a given block key follows the ascending order")
    blocked = df.withColumn(BLOCK, block)
    totals = blocked.groupBy(*by, BLOCK).agg(*[F.sum(s).alias(s) for s in sums])
    offsets = totals.select(*by, BLOCK, *[F.coalesce(F.sum(s).over(_earlier_blocks(by)), F.lit(0)).alias(f"_offset_{s}") for s in sums])
    earlier_rows = W.partitionBy(*by, BLOCK).orderBy(*keys).rowsBetween(W.unboundedPreceding, -1)
    return blocked.join(offsets, [*by, BLOCK]).select(
        *df.columns,
        *[
            (F.col(f"_offset_{s}") + F.coalesce(F.sum(s).over(earlier_rows), F.lit(0))).alias(f"{s}_before")
            for s in sums
        ],
    )


def _earlier_blocks(by: Sequence[str]):
    return W.partitionBy(*by).orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)


def _totals_in_ranges(df: DataFrame, keys: Sequence[Column], sums: Sequence[str], by: Sequence[str], partitions: int | None) -> DataFrame:
    """Running totals inside sorted range partitions, which are written once; whole rows are exchanged only to get there.

    A group that goes on from one partition to the next is the first group of the next, so every partition needs one
    offset per sum: as many numbers as partitions.
    """
    count = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    group = F.xxhash64(*by) if by else F.lit(0).cast("long")
    ranged = df.repartitionByRange(count, *[F.col(c) for c in by], *keys).sortWithinPartitions(*by, *keys)
    blocked = cut_lineage(ranged.withColumns({BLOCK: F.spark_partition_id(), _GROUP: group}))
    totals = blocked.groupBy(_GROUP, BLOCK).agg(*[F.sum(s).alias(s) for s in sums])
    running = totals.select(
        _GROUP, BLOCK, F.row_number().over(W.partitionBy(_GROUP).orderBy(BLOCK)).alias("_nth"),
        *[F.sum(s).over(_earlier_blocks([_GROUP])).alias(s) for s in sums],
    )
    found = {r[BLOCK]: tuple(r[s] for s in sums) for r in running.where("_nth > 1").collect()}  # at most one row per partition
    kinds = [T.DoubleType() if isinstance(df.schema[s].dataType, (T.DoubleType, T.FloatType)) else T.LongType() for s in sums]
    added = [T.StructField(f"{s}_before", k) for s, k in zip(sums, kinds)]
    kept = df.columns
    names = [*kept, *(f.name for f in added)]

    def run(batches):
        last = None  # the group at the end of the last batch, and its totals up to there
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = batch.column(_GROUP).to_numpy()
            if last is None:
                last = (groups[0], found.get(batch.column(BLOCK)[0].as_py(), (0,) * len(sums)))
            begin = np.flatnonzero(np.diff(groups, prepend=groups[:1] - 1))
            run_of = np.cumsum(np.diff(groups, prepend=groups[:1] - 1) != 0) - 1
            columns, ends = [], []
            for i, (s, field) in enumerate(zip(sums, added)):
                kind = np.float64 if isinstance(field.dataType, T.DoubleType) else np.int64
                own = pc.fill_null(batch.column(s).cast(pa.float64() if kind is np.float64 else pa.int64()), 0).to_numpy(zero_copy_only=False)
                upto = np.cumsum(own)
                before = upto - own - (upto - own)[begin][run_of]
                if groups[0] == last[0]:
                    before = before + np.where(run_of == 0, last[1][i], 0).astype(kind)
                columns.append(pa.array(before.astype(kind)))
                ends.append(before[-1] + own[-1])
            last = (groups[-1], tuple(ends))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns], names=names)

    return blocked.mapInArrow(run, T.StructType([*df.schema.fields, *added]))


#: Rank error of the first look at a quantile, as one part in so many.
ACCURACY = 10_000


def present(name: str) -> Column:
    """A number, with NaN as missing."""
    value = F.col(name).cast("double")
    return F.when(~F.isnan(value), value)


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Exact, linearly interpolated quantiles of several columns at once; NaN counts as missing.

    One row per column: ``feature``, ``n`` and ``q0``, ``q1``, ... in the order of ``probs``; a column without values has
    n = 0 and NULL quantiles. A first pass brackets every quantile with a sketch of known rank error. A second counts what
    lies below the bracket, and only the distinct values inside it, a few ten-thousandths of the rows, are ranked. Ties
    are counted before the shuffle. The columns, and nothing else, are written once, so the input is read and computed once.
    """
    doubles = cut_lineage(df.select(*[present(c).alias(c) for c in columns]))
    margin = 2.0 / ACCURACY
    ends = [min(1.0, max(0.0, p + side * margin)) for p in probs for side in (-1, 1)]
    looks = doubles.agg(
        *[F.struct(F.count(c).alias("n"), F.min(c).alias("low"), F.max(c).alias("high")).alias(f"s{i}") for i, c in enumerate(columns)],
        *[F.percentile_approx(c, ends, ACCURACY).alias(f"b{i}") for i, c in enumerate(columns)],
    ).first()
    session = df.sparkSession
    features = session.createDataFrame([(c, looks[f"s{i}"]["n"]) for i, c in enumerate(columns)], "feature string, n bigint")
    guesses = [
        (i, j, float(p) * (looks[f"s{i}"]["n"] - 1), looks[f"b{i}"][2 * j], looks[f"b{i}"][2 * j + 1])
        for i in range(len(columns)) if looks[f"s{i}"]["n"]
        for j, p in enumerate(probs)
    ]
    if not guesses:
        return features.select("feature", "n", *[F.lit(None).cast("double").alias(f"q{j}") for j in range(len(probs))])
    counts = doubles.agg(
        *[F.count_if(F.col(columns[i]) < low).alias(f"k{g}") for g, (i, _, _, low, _) in enumerate(guesses)],
        *[F.count_if(F.col(columns[i]) <= high).alias(f"u{g}") for g, (i, _, _, _, high) in enumerate(guesses)],
    ).first()
    rows = []
    for g, (i, j, place, low, high) in enumerate(guesses):
        # Only with fewer values than ACCURACY can a bracket miss its place; the ends of the column hold it then.
        below = counts[f"k{g}"]
        if below > math.floor(place):
            low, below = looks[f"s{i}"]["low"], 0
        if counts[f"u{g}"] <= math.ceil(place):
            high = looks[f"s{i}"]["high"]
        rows.append((columns[i], j, below, place, low, high))
    before = session.createDataFrame([r[:4] for r in rows], "feature string, prob int, below bigint, place double")
    inside = doubles.select(
        F.explode(
            F.filter(
                F.array(*[
                    F.when(F.col(c).between(low, high), F.struct(F.lit(c).alias("feature"), F.lit(j).alias("prob"), F.col(c).alias("value")))
                    for c, j, _, _, low, high in rows
                ]),
                lambda x: x.isNotNull(),
            )
        ).alias("x")
    ).select("x.*")
    counted = inside.groupBy("feature", "prob", "value").agg(F.count("*").alias("times"))
    upto = F.sum("times").over(W.partitionBy("feature", "prob").orderBy("value").rowsBetween(W.unboundedPreceding, 0))
    ranked = counted.withColumn("upto", upto).join(before, ["feature", "prob"])
    last = F.col("below") + F.col("upto")

    def value_at(place: Column) -> Column:
        here = (last - F.col("times") <= place) & (place < last)
        return F.max(F.when(here, F.col("value")))

    part = F.max(F.col("place") - F.floor("place"))
    low, high = value_at(F.floor("place")), value_at(F.ceil("place"))
    found = ranked.groupBy("feature", "prob").agg((low + (high - low) * part).alias("q"))
    wide = found.groupBy("feature").agg(*[F.max(F.when(F.col("prob") == j, F.col("q"))).alias(f"q{j}") for j in range(len(probs))])
    return features.join(wide, "feature", "left").select("feature", "n", *[f"q{j}" for j in range(len(probs))])


def one_quantile(df: DataFrame, column: str, prob: float) -> Column:
    """A single quantile as a scalar subquery."""
    return exact_quantiles(df, [column], [prob]).agg(F.max("q0")).scalar()


def key_at(df: DataFrame, order: Sequence[str], fraction: float) -> Column:
    """Key of the row at position ``floor(fraction * n)`` in the given (unique) order, as a scalar subquery."""
    keys = df.select(*order).withColumn("one", F.lit(1))
    ranked = running_totals(keys, order, ["one"])
    place = F.floor(F.lit(float(fraction)) * ranked.agg(F.count("*")).scalar())
    return ranked.where(F.col("one_before") == place).agg(F.min(F.struct(*order))).scalar()
