"""The most similar stored vector of every row by cosine, exact, through cells of a metric partition.

Up to ``MAX_PIVOTS`` stored vectors are pivots (the first by hash; they shape the cells, not the result). Every stored
vector belongs to the cell of its closest pivot, and a cell knows the largest angle to its pivot. A row first meets its own
cell; then only those cells that may hold something as good: angle to the pivot, less the cell's angle, within the best angle
found so far. Where vectors form groups few cells are left; where they do not, every cell is, and the work is quadratic.

Rows are not sent to cells but to packs of cells, once to each that holds a cell they need; the cells are ruled out again
inside. There are as many packs as keep all cores busy, more only where a pack would exceed ``PACK_BYTES``, so what is
exchanged grows with the rows times that number also where no cell is ruled out.

Equal vectors are compared once: a stored vector keeps its two lowest keys, a row gets its two best candidates, and the
row's own key is left out at the end. Inside a pack at most ``block_rows`` stored rows are compared at once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.accumulators import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.operators.vectors import BLOCK_ROWS, PACK_BYTES, blockwise, listed_matrix, matrix_of, packs_for_cores, unit_rows, usable
from cohortline.session import cut_lineage

MAX_PIVOTS = 4096
#: Pivots per square root of the rows: more angles to pivots, smaller cells.
PIVOT_SHARE = 4
#: Rows whose similarities are held at once, and similarities of a slab.
ROWS_AT_ONCE, SLAB = 512, 1 << 20
#: Angles closer than this count as equal when a cell is ruled out; far above the error of an arc cosine.
SLACK = 1e-6
DIGITS = 12


def _angles(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(rows @ pivots.T, -1.0, 1.0))


def _two_best(queries: np.ndarray, keys: np.ndarray, bank: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of queries, keys and cosines (``DIGITS`` digits) of the best and the second best key; lower keys win ties."""
    order = np.argsort(keys, kind="stable")
    keys, bank = keys[order], bank[order]
    same = np.concatenate([[0], np.cumsum(keys[1:] != keys[:-1])])
    out = []
    for start in range(0, len(queries), ROWS_AT_ONCE):
        similar = np.round(queries[start : start + ROWS_AT_ONCE] @ bank.T, DIGITS)
        at = np.arange(len(similar))
        for _ in range(2):
            best = similar.argmax(axis=1)
            top = similar[at, best]
            found = np.isfinite(top)
            out.append((start + at[found], keys[best[found]], top[found]))
            similar[same[best][:, None] == same[None, :]] = -np.inf
    return out


class _Best:
    """The two best different keys (by rank) of every query of a tile so far, and the cosine that another must reach."""

    def __init__(self, bound: np.ndarray):
        self.bound = bound
        self.cosine = np.full((len(bound), 2), -np.inf)
        self.rank = np.full((len(bound), 2), -1)

    def add(self, at: np.ndarray, rank: np.ndarray, cosine: np.ndarray) -> None:
        if not len(at):
            return
        touched = np.unique(at)
        old = np.isfinite(self.cosine[touched])
        at = np.concatenate([at, np.repeat(touched, old.sum(1))])
        rank = np.concatenate([rank, self.rank[touched][old]])
        cosine = np.concatenate([cosine, self.cosine[touched][old]])
        order = np.lexsort((-cosine, rank, at))
        at, rank, cosine = at[order], rank[order], cosine[order]
        once = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(rank, prepend=-1) != 0))
        at, rank, cosine = at[once], rank[once], cosine[once]
        order = np.lexsort((rank, -cosine, at))
        at, rank, cosine = at[order], rank[order], cosine[order]
        begin = np.flatnonzero(np.diff(at, prepend=-1))
        self.cosine[touched], self.rank[touched] = -np.inf, -1
        place = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
        for i in range(2):
            own = place == i
            self.cosine[at[own], i], self.rank[at[own], i] = cosine[own], rank[own]
        self.bound[touched] = np.maximum(self.bound[touched], self.cosine[touched, 1])

    def meet(self, at: np.ndarray, queries: np.ndarray, rank: np.ndarray, bank: np.ndarray, block_rows: int) -> None:
        """All of some queries against some stored rows."""
        for b in range(0, len(bank), block_rows):
            own, ranks = bank[b : b + block_rows], rank[b : b + block_rows]
            unbound = ~np.isfinite(self.bound[at])
            some = at[unbound]
            for place, best, top in _two_best(queries[some], ranks, own):
                self.add(some[place], best, top)
            some, step = at[~unbound], max(1, SLAB // len(own))
            for a in range(0, len(some), step):
                part = some[a : a + step]
                similar = queries[part] @ own.T
                hit = np.flatnonzero((similar >= (self.bound[part] - 10.0**-DIGITS)[:, None]).ravel())
                i, j = np.divmod(hit, len(own))
                top = np.round(similar.ravel()[hit], DIGITS)
                fine = top >= self.bound[part[i]]
                self.add(part[i[fine]], ranks[j[fine]], top[fine])


def _ranked(keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The rank of every key among the different ones, and where each rank is found first."""
    order = pc.sort_indices(keys)
    sorted_ = keys.take(order)
    new = pc.fill_null(pc.not_equal(sorted_[1:], sorted_[:-1]), True).to_numpy(zero_copy_only=False)
    order, number = order.to_numpy(), np.concatenate([[0], np.cumsum(new)])
    rank = np.empty(len(order), np.int64)
    rank[order] = number
    return rank, order[np.flatnonzero(np.diff(number, prepend=-1))]


def _merged(candidates: DataFrame) -> DataFrame:
    """The two best different neighbours of every vector: ``id, best`` (a list of ``far``, ``neighbour``)."""
    each = candidates.groupBy("id", "neighbour").agg(F.min(-F.col("cosine")).alias("far"))
    return each.groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct("far", "neighbour"))), 1, 2).alias("best"))


def _stored(bank: DataFrame) -> DataFrame:
    """Different vectors with their lowest and second lowest key, a row for each."""
    first = bank.groupBy("id").agg(F.min("key").alias("key"), F.first("vector").alias("vector"))
    low = first.select("id", F.col("key").alias("low"))
    second = bank.join(low, "id").where(F.col("key") > F.col("low")).groupBy("id").agg(F.min("key").alias("key"), F.first("vector").alias("vector"))
    return first.unionByName(second)


class _Packs:
    """Cells laid behind each other in packs of about ``pack_rows`` stored rows; a cell above that has packs of its own."""

    def __init__(self, held: np.ndarray, pack_rows: int):
        self.first, self.parts, number, room = np.zeros(len(held), np.int64), np.ones(len(held), np.int64), -1, 0
        for c, n in enumerate(held.tolist()):
            if n > pack_rows:
                self.first[c], self.parts[c] = number + 1, -(-n // pack_rows)
                number, room = number + int(self.parts[c]), 0
            else:
                if n > room:
                    number, room = number + 1, pack_rows
                self.first[c], room = max(number, 0), room - n
        self.count = max(number, 0) + 1
        self.cells: list[list[int]] = [[] for _ in range(self.count)]
        for c in np.flatnonzero(held > 0).tolist():
            for p in range(self.parts[c]):
                self.cells[self.first[c] + p].append(c)


def _tiles(asked: DataFrame, stored: DataFrame, parts: list[int], work, kind: str) -> DataFrame:
    """Queries (each with its ``pack``) in parts of a pack against the stored rows of the pack, sent to each of the parts."""
    count = F.get(F.lit(parts), F.col("pack"))
    left = asked.withColumn("part", F.pmod(F.xxhash64("id"), count).cast("int"))
    right = stored.withColumn("part", F.explode(F.sequence(F.lit(0), count - 1)))
    tile = ["pack", "part"]
    return left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInArrow(work, f"id string, neighbour {kind}, cosine double")


def _compared(block_rows: int, counter: Accumulator | None, needed):
    """Work on a tile; ``needed(table, queries, cells)`` says which queries meet which cells (queries by cells)."""

    def work(q: pa.Table, b: pa.Table) -> pa.Table:
        keys = b.column("key").combine_chunks()
        if not len(q) or not len(b):
            return pa.table({"id": pa.array([], pa.string()), "neighbour": keys.slice(0, 0), "cosine": pa.array([], pa.float64())})
        queries, bank, cell = unit_rows(listed_matrix(q.column("vector"))), unit_rows(listed_matrix(b.column("vector"))), b.column("cell").to_numpy()
        rank, where = _ranked(keys)
        cells = np.unique(cell)
        second = q.column("second").to_numpy() if "second" in q.column_names else np.full(len(q), np.nan)
        best = _Best(np.where(np.isfinite(second), second, -np.inf))
        meets = needed(q, queries, cells)
        for j, c in enumerate(cells):
            at, own = np.flatnonzero(meets[:, j]), np.flatnonzero(cell == c)
            if counter is not None:
                counter.add(len(at) * len(own))
            if len(at):
                best.meet(at, queries, rank[own], bank[own], block_rows)
        at, place = np.nonzero(np.isfinite(best.cosine))
        return pa.table({
            "id": q.column("id").take(pa.array(at)),
            "neighbour": keys.take(pa.array(where[best.rank[at, place]])),
            "cosine": pa.array(best.cosine[at, place]),
        })

    return work


def _by_cells(queries: DataFrame, bank: DataFrame, kind: str, rows: int, block_rows: int, counter: Accumulator | None) -> DataFrame:
    """``id, best`` for all different query vectors; both sides have ``key, id, vector`` and only usable vectors."""
    spark = queries.sparkSession
    stored = cut_lineage(_stored(bank))
    wanted = min(MAX_PIVOTS, int(np.ceil(PIVOT_SHARE * np.sqrt(rows))))
    chosen = stored.select("id", "vector").dropDuplicates(["id"]).orderBy(F.xxhash64("id"), "id").limit(wanted)
    shapes = [r["vector"] for r in chosen.collect()]  # at most MAX_PIVOTS
    if not shapes:
        return spark.createDataFrame([], f"id string, best array<struct<far:double,neighbour:{kind}>>")
    pivots = spark.sparkContext.broadcast(unit_rows(np.array(shapes, dtype=np.float64)))

    @F.pandas_udf("cell int, angle double")
    def home(vectors: pd.Series) -> pd.DataFrame:
        cell, angle = np.zeros(len(vectors), np.int32), np.zeros(len(vectors))
        for a in range(0, len(vectors), ROWS_AT_ONCE):
            angles = _angles(unit_rows(matrix_of(vectors[a : a + ROWS_AT_ONCE])), pivots.value)
            own = slice(a, a + len(angles))
            cell[own] = angles.argmin(axis=1)
            angle[own] = angles[np.arange(len(angles)), cell[own]]
        return pd.DataFrame({"cell": cell, "angle": angle})

    placed = cut_lineage(stored.withColumn("_home", home("vector")).select("key", "vector", "_home.cell", "_home.angle"))
    reach, held = np.full(len(shapes), -np.inf), np.zeros(len(shapes), np.int64)
    for r in placed.groupBy("cell").agg(F.max("angle").alias("reach"), F.count("*").alias("n")).collect():  # a row per pivot
        reach[r["cell"]], held[r["cell"]] = r["reach"], r["n"]
    radii = spark.sparkContext.broadcast(reach)
    different = queries.groupBy("id").agg(F.first("vector").alias("vector"))
    asked = cut_lineage(different.withColumn("cell", home("vector")["cell"]))
    wants = np.zeros(len(shapes), np.int64)
    for r in asked.groupBy("cell").count().collect():
        wants[r["cell"]] = r["count"]

    most = max(1, PACK_BYTES // (8 * max(1, len(shapes[0]))))
    pack_rows = min(most, max(block_rows, -(-rows // packs_for_cores(spark))))
    packs = _Packs(held, pack_rows)
    first, parts = packs.first.tolist(), packs.parts.tolist()
    pack = F.get(F.lit(first), F.col("cell")) + F.pmod(F.xxhash64("key"), F.get(F.lit(parts), F.col("cell")))
    dealt = placed.select("key", "vector", "cell", pack.cast("int").alias("pack"))

    def at_home(q: pa.Table, _: np.ndarray, cells: np.ndarray) -> np.ndarray:
        return q.column("cell").to_numpy()[:, None] == cells[None, :]

    def elsewhere(q: pa.Table, queries: np.ndarray, cells: np.ndarray) -> np.ndarray:
        return _within(queries, q.column("second").to_numpy(), pivots.value[cells], radii.value[cells]) & ~at_home(q, queries, cells)

    begin = F.get(F.lit(first), F.col("cell"))
    own = F.sequence(begin, begin + F.get(F.lit(parts), F.col("cell")) - 1)
    home_parts = [max(1, -(-int(sum(wants[c] for c in cells)) // pack_rows)) for cells in packs.cells]
    first_met = asked.withColumn("pack", F.explode(own))
    near = cut_lineage(_tiles(first_met, dealt, home_parts, _compared(block_rows, counter, at_home), kind))
    # The row's own key may be the best one, so only the second best bounds the search.
    bound = _merged(near).select("id", F.when(F.size("best") > 1, -F.col("best")[1]["far"]).alias("second"))
    lists = [np.array(cells, np.int64) for cells in packs.cells]

    @F.pandas_udf("array<int>")
    def others(vectors: pd.Series, cells: pd.Series, second: pd.Series) -> pd.Series:
        out = []
        for a in range(0, len(vectors), ROWS_AT_ONCE):
            some = slice(a, a + ROWS_AT_ONCE)
            within = _within(unit_rows(matrix_of(vectors[some])), second[some].to_numpy(np.float64), pivots.value, radii.value)
            within[np.arange(len(within)), cells[some].to_numpy()] = False
            some_cell = np.stack([within[:, own].any(axis=1) for own in lists], axis=1)
            out += [np.flatnonzero(w).astype(np.int32) for w in some_cell]
        return pd.Series(out)

    more = asked.join(bound, "id", "left").withColumn("pack", F.explode(others("vector", "cell", "second")))
    far_parts = [max(1, -(-int(wants.sum()) // pack_rows))] * packs.count
    far = _tiles(more, dealt, far_parts, _compared(block_rows, counter, elsewhere), kind)
    return _merged(near.unionByName(far))


def _within(queries: np.ndarray, second: np.ndarray, pivots: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """Which cells may hold something as good as the second best cosine found (NaN: none yet); queries by cells."""
    out = np.empty((len(queries), len(pivots)), bool)
    limit = np.arccos(np.clip(np.where(np.isfinite(second), second, -1.0) - 10.0**-DIGITS, -1.0, 1.0))
    for a in range(0, len(queries), ROWS_AT_ONCE):
        some = slice(a, a + ROWS_AT_ONCE)
        out[some] = _angles(queries[some], pivots) - radii <= limit[some, None] + SLACK
    return out & np.isfinite(radii)


def _directions(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a direction, and rows of zeros, which have the cosine 0 to everything."""
    zero = F.forall("vector", lambda x: x == 0)
    return df.where(~zero), df.where(zero)


def nearest_neighbour(
    queries: DataFrame,
    bank: DataFrame,
    key: str,
    vector: str = "embedding",
    block_rows: int = BLOCK_ROWS,
    counter: Accumulator | None = None,
) -> DataFrame:
    """Most similar stored vector per row by cosine: exact, columns ``key``, ``neighbour``, ``cosine``.

    Cosines are compared to 12 digits, the lowest key wins a tie, and a row's own key is no neighbour. Keys are of any type
    that sorts. A row without a usable vector, or with no other usable vector in the bank, has a NULL neighbour; a vector of
    zeros has the cosine 0 to all. ``counter`` adds up the pairs compared. Tables of one block each are compared at once.
    """
    kind = dict(queries.dtypes)[key]
    q = queries.select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    b = bank.select(F.col(key).cast(kind).alias("key"), F.col(vector).alias("vector")).where(usable("vector"))
    good, stored_rows = q.where(usable("vector")), b.count()
    if max(stored_rows, good.count()) <= block_rows:
        return _answered(q, _at_once(good, b, kind, block_rows, counter))
    named = F.md5(F.to_json("vector"))
    asked, zero_asked = _directions(good.withColumn("id", named))
    stored, zero_stored = _directions(b.withColumn("id", named))
    best = _by_cells(asked, stored, kind, stored_rows, block_rows, counter)
    # Zero vectors: any stored key ties at 0 for a query of zeros, and a stored one of zeros offers 0 to all; two keys suffice.
    offered = [F.struct(F.lit(-0.0).alias("far"), F.lit(r[0]).cast(kind).alias("neighbour")) for r in _two_lowest(zero_stored)]
    any_two = [F.struct(F.lit(-0.0).alias("far"), F.lit(r[0]).cast(kind).alias("neighbour")) for r in _two_lowest(b)]
    ranked = asked.select("key", "id").join(best, "id", "left")
    empty = F.array().cast(f"array<struct<far:double,neighbour:{kind}>>")
    listed = ranked.select("key", F.coalesce("best", empty).alias("best"))
    if offered:
        listed = listed.select("key", F.sort_array(F.concat("best", F.array(*offered))).alias("best"))
    found = listed.unionByName(zero_asked.select("key", (F.array(*any_two) if any_two else empty).alias("best")))
    own = F.filter("best", lambda x: x["neighbour"] != F.col("key"))
    first = found.select("key", F.get(own, F.lit(0)).alias("best")).groupBy("key").agg(F.min("best").alias("best"))
    return _answered(q, first)


def _two_lowest(df: DataFrame) -> list:
    return df.select("key").distinct().orderBy("key").limit(2).collect()


def _at_once(q: DataFrame, b: DataFrame, kind: str, block_rows: int, counter: Accumulator | None) -> DataFrame:
    def against(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"key": [], "neighbour": [], "cosine": []})
        if counter is not None:
            counter.add(len(left) * len(right))
        own = left["key"].to_numpy()
        found = _two_best(unit_rows(matrix_of(left["vector"])), right["key"].to_numpy(), unit_rows(matrix_of(right["vector"])))
        rows = pd.concat([pd.DataFrame({"key": own[at], "neighbour": key, "cosine": top}) for at, key, top in found])
        return rows[rows["key"] != rows["neighbour"]]

    partial = blockwise(q, b, "key", "key", against, f"key {kind}, neighbour {kind}, cosine double", block_rows)
    return partial.groupBy("key").agg(F.min(F.struct((-F.col("cosine")).alias("far"), "neighbour")).alias("best"))


def _answered(q: DataFrame, best: DataFrame) -> DataFrame:
    # Zero is added, so that no cosine is a negative zero.
    cosine = (F.lit(0.0) - F.col("best.far")).alias("cosine")
    return q.select("key").join(best, "key", "left").select("key", F.col("best.neighbour").alias("neighbour"), cosine)
