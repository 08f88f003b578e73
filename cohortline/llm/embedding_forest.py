"""Near-duplicate vectors by a forest of random-projection trees with spill overlap.

Every tree splits buckets recursively at the median of a random projection; vectors within ``spill`` of the median go to
both sides. Two unit vectors of cosine c differ by at most sqrt(2 - 2c), so their projections differ by a normal amount of
sigma = sqrt((2 - 2c) / dimension); with a spill of half a sigma on either side a split parts such a pair in about two of
a hundred cases, a tree of ten levels in a fifth, and six trees in less than one of ten thousand.

Medians come from a bounded hash sample of each bucket (``SAMPLE`` rows); every row is routed. A split is given up where
the spill would hold more than ``DENSE`` of the rows (an eighth is usual); such buckets, and those that do not shrink, are
dense and are compared as they are: members near the bucket's pivot are linked through it, only the others meet everyone, in
tiles, so no task holds more than two tiles. Comparing within leaves gives at most one verified link per member. All pairs
inside a component are then counted in double precision, so counts do not depend on how often the trees met a pair.

Defined results: vectors that are NULL, empty, zero, or hold NULL or non-finite components link with nothing; vectors of
different length do not link; equal vectors are one node with a weight; repeated ids are rows of their own, and a component
id is the smallest id in it; an empty table gives no rows; further columns of the input are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.llm.frames import components, map_sorted_groups, marked_around, star_roots, tiled, tiled_around
from cohortline.session import cut_lineage

TREES = 6
LEAF = 256
SAMPLE = 1024
LEVELS = 6
SPILL = 0.5
DENSE = 0.3


def _prepare(vectors: DataFrame) -> DataFrame:
    """``id``, ``node`` (NULL if it can't link), ``dim`` and ``vec`` (bytes of doubles or floats as given)."""
    single = vectors.schema["vec"].dataType.elementType.typeName() == "float"
    kind = np.float32 if single else np.float64

    def run(batches):
        for batch in batches:
            out = []
            for value in batch.column("vec"):
                v = np.array([], kind)
                if value.is_valid:
                    flat = value.values
                    if flat is not None and len(flat) and not flat.null_count:
                        v = flat.to_numpy(zero_copy_only=False).astype(kind) + kind(0)
                out.append(v.tobytes() if len(v) and np.isfinite(v).all() and v.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], names=["id", "vec"])

    vec = F.col("vec") if single else F.col("vec").cast("array<double>")
    raw = vectors.select("id", vec.alias("vec")).mapInArrow(run, f"id {vectors.schema['id'].dataType.simpleString()}, vec binary")
    return raw.select("id", F.when(F.col("vec").isNotNull(), F.xxhash64("vec")).alias("node"), "vec")


def _matrix(column: pa.ChunkedArray | pa.Array, kind) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _directions(path: int, dim: int) -> np.ndarray:
    r = np.random.default_rng(path & (2**63 - 1)).standard_normal((LEVELS, dim))
    return r / np.linalg.norm(r, axis=1, keepdims=True)


def _levels(size: int, leaf: int) -> int:
    return min(LEVELS, max(1, math.ceil(math.log2(size / leaf))))


def _margin(similarity: float, dim: int, spill: float) -> float:
    return spill * math.sqrt((2 - 2 * similarity) / dim)


def _fit(x: np.ndarray, path: int, size: int, leaf: int, margin: float) -> np.ndarray:
    """Thresholds of one subtree in heap order; NaN where a bucket is not split."""
    depth = _levels(size, leaf)
    cuts = np.full((1 << depth) - 1, np.nan)
    seen = x @ _directions(path, x.shape[1]).T
    members = {0: np.arange(len(x))}
    for level in range(depth):
        below = {}
        for place, rows in members.items():
            if len(rows) < 8:
                continue
            values = seen[rows, level]
            cut = float(np.median(values))
            if (np.abs(values - cut) <= margin).mean() > DENSE:
                continue
            cuts[(1 << level) - 1 + place] = cut
            below[2 * place] = rows[values <= cut + margin]
            below[2 * place + 1] = rows[values >= cut - margin]
        members = below
    return cuts


def _route(x: np.ndarray, path: int, cuts: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and leaf numbers (level and place) of every leaf a row reaches."""
    depth = (len(cuts) + 1).bit_length() - 1
    seen = x @ _directions(path, x.shape[1]).T
    rows, place = np.arange(len(x)), np.zeros(len(x), np.int64)
    done_rows, done_leaf = [], []
    for level in range(depth):
        cut = cuts[(1 << level) - 1 + place]
        stop = np.isnan(cut)
        done_rows.append(rows[stop])
        done_leaf.append((1 << level) - 1 + place[stop])
        rows, place, cut = rows[~stop], place[~stop], cut[~stop]
        values = seen[rows, level]
        low, high = values <= cut + margin, values >= cut - margin
        rows, place = np.concatenate([rows[low], rows[high]]), np.concatenate([2 * place[low], 2 * place[high] + 1])
    done_rows.append(rows)
    done_leaf.append((1 << depth) - 1 + place)
    return np.concatenate(done_rows), np.concatenate(done_leaf)


def forest_leaves(nodes: DataFrame, similarity: float, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL, kind=np.float32) -> DataFrame:
    """Leaves ``(path, node, size)`` of all trees over ``nodes(node, vec)``; equal leaves are kept once."""
    width = np.dtype(kind).itemsize
    tree = F.explode(F.sequence(F.lit(1), F.lit(trees))).alias("tree")
    level = nodes.select("node", "vec", tree).select("node", "vec", F.xxhash64("tree", F.octet_length("vec")).alias("path"))
    counts = level.groupBy("path").agg(F.count("*").alias("size"))
    level = level.join(counts, "path")
    leaves = []

    def fit(part: pa.Table):
        x = _unit(_matrix(part.column("vec"), kind))
        path, size = part.column("path")[0].as_py(), part.column("size")[0].as_py()
        cuts = _fit(x, path, size, leaf, _margin(similarity, x.shape[1], spill))
        return [np.array([path]), pa.array([cuts.tobytes()], pa.binary())]

    def route(batches):
        for batch in batches:
            path = batch.column("path").to_numpy()
            order = np.argsort(path, kind="stable")
            for some in np.split(order, np.flatnonzero(np.diff(path[order])) + 1) if len(order) else ():
                part = batch.take(pa.array(some))
                x = _unit(_matrix(part.column("vec"), kind))
                cuts = np.frombuffer(part.column("cuts")[0].as_py(), np.float64)
                rows, place = _route(x, int(path[some[0]]), cuts, _margin(similarity, x.shape[1], spill))
                yield pa.RecordBatch.from_arrays(
                    [part.column("node").take(pa.array(rows)), pa.array(np.full(len(rows), path[some[0]])), pa.array(place), part.column("size").take(pa.array(rows))],
                    names=["node", "parent", "place", "parent_size"],
                )

    while True:
        small = level.where(F.col("size") <= leaf)
        leaves.append(small.select("path", "node", "size"))
        big = level.where(F.col("size") > leaf)
        sample = big.where(F.pmod(F.xxhash64("node", "path"), F.col("size")) < SAMPLE)
        models = map_sorted_groups(sample.select("path", "size", "vec"), "path", "path long, cuts binary", fit)
        routed = big.join(models, "path").mapInArrow(route, "node long, parent long, place long, parent_size long")
        children = cut_lineage(routed.select(F.xxhash64("parent", "place").alias("path"), "node", "parent_size"))
        buckets = children.groupBy("path").agg(
            F.count("*").alias("size"), F.max("parent_size").alias("parent_size"), F.bit_xor(F.xxhash64("node")).alias("members")
        ).where("size > 1")
        once = buckets.groupBy("size", "members").agg(F.min("path").alias("path"), F.max("parent_size").alias("parent_size"))
        final = (F.col("size") <= leaf) | (F.col("size") * 2 > F.col("parent_size"))
        placed = cut_lineage(children.select("path", "node").join(once.select("path", "size", final.alias("final")), "path"))
        leaves.append(placed.where("final").select("path", "node", "size"))
        open_ = placed.where("NOT final").select("path", "node", "size")
        if open_.isEmpty():
            break
        level = open_.join(nodes.select("node", "vec"), "node")
    out = leaves[0]
    for more in leaves[1:]:
        out = out.unionByName(more)
    return out


def _compare(part: pa.Table, similarity: float, kind):
    side = part.column("side").to_numpy()
    nodes = part.column("node").to_numpy()
    own = np.flatnonzero(side == 2)
    left, right = (own, own) if len(own) else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    if not len(left) or not len(right):
        return None
    x = _unit(_matrix(part.column("vec"), kind))
    similar = x[left] @ x[right].T >= similarity
    if left is right:
        np.fill_diagonal(similar, False)
    return nodes, left, right, similar


def _near(floor: float, kind):
    def near(members: list[bytes], pivots: list[bytes]) -> np.ndarray:
        # All members of a bucket or component have the length of its pivot; those of a batch may differ.
        out = np.zeros(len(members), bool)
        sizes = np.array([len(m) for m in members])
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            x, y = (_unit(np.frombuffer(b"".join(side[i] for i in at), kind).reshape(len(at), -1).astype(np.float64)) for side in (members, pivots))
            out[at] = (x * y).sum(1) >= floor
        return out

    return near


def leaf_links(leaves: DataFrame, nodes: DataFrame, similarity: float, leaf: int = LEAF, kind=np.float32) -> DataFrame:
    """Verified links ``(a, b)``, at most one per member and tile pair."""

    def work(part: pa.Table):
        found = _compare(part, similarity, kind)
        if found is None:
            return None
        names, left, right, similar = found
        rows, cols = np.nonzero(similar)
        root = star_roots(names, left[rows], right[cols])
        linked = root != names
        return [names[linked], root[linked]]

    nodes = nodes.select("node", "vec")
    large = leaves.where(F.col("size") > 2 * leaf).select("path", "node").join(nodes, "node")
    marked = cut_lineage(marked_around(large, "path", "vec", _near(similarity, kind)))
    through = marked.where("near AND node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    small = tiled(leaves.where(F.col("size") <= 2 * leaf), "path", "size", 2 * leaf).select("tile_pair", "side", "node")
    dealt = small.union(tiled_around(marked, "path", 2 * leaf).select("tile_pair", "side", "node")).join(nodes, "node")
    return map_sorted_groups(dealt, "tile_pair", "a long, b long", work).union(through)


def counted_links(members: DataFrame, similarity: float, leaf: int = LEAF, kind=np.float32) -> DataFrame:
    """``node`` and ``links`` over ``members(component, size, node, weight, vec)``.

    Angles are a metric: two members of a large component that are both within half the allowed angle of its pivot are
    linked, and are counted without being compared.
    """

    def work(part: pa.Table):
        found = _compare(part, similarity, kind)
        if found is None:
            return None
        names, left, right, similar = found
        weight = part.column("weight").to_numpy()
        links = np.zeros(len(names), np.int64)
        links[left] += similar @ weight[right]
        if left is not right:
            links[right] += similar.T @ weight[left]
        return [names, links]

    members = cut_lineage(members)
    large = members.where(F.col("size") > 2 * leaf)
    half = math.cos(math.acos(similarity) / 2) + 1e-9
    marked = cut_lineage(marked_around(large, "component", "vec", _near(half, kind)))
    weighed = marked.where("near").join(members.select("node", "weight"), "node")
    dense = weighed.groupBy("component").agg(F.sum("weight").alias("total"))
    inside = weighed.join(dense, "component").select("node", (F.col("total") - F.col("weight")).alias("links"))
    small = tiled(members.where(F.col("size") <= 2 * leaf), "component", "size", 2 * leaf).select("tile_pair", "side", "node")
    dealt = small.union(tiled_around(marked, "component", 2 * leaf).select("tile_pair", "side", "node"))
    pairs = map_sorted_groups(dealt.join(members.select("node", "weight", "vec"), "node"), "tile_pair", "node long, links long", work)
    return pairs.union(inside).groupBy("node").agg(F.sum("links").alias("links"))


def near_duplicates(vectors: DataFrame, id: str = "vec_id", embedding: str = "embedding", similarity: float = 0.95, trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """``id``, ``n_links``, ``component_id``, ``kept`` of every row."""
    kind = np.float32 if vectors.schema[embedding].dataType.elementType.typeName() == "float" else np.float64
    prepared = cut_lineage(_prepare(vectors.select(F.col(id).alias("id"), F.col(embedding).alias("vec"))))
    valid = prepared.where(F.col("node").isNotNull())
    nodes = cut_lineage(valid.groupBy("node").agg(F.count("*").alias("weight"), F.min("id").alias("first"), F.any_value("vec").alias("vec")))
    links = leaf_links(forest_leaves(nodes.select("node", "vec"), similarity, trees, leaf, kind=kind), nodes, similarity, leaf, kind)
    found = components(links)
    sizes = found.groupBy("component").agg(F.count("*").alias("size"))
    members = found.join(sizes, "component").join(nodes.select("node", "weight", "vec"), "node")
    counts = counted_links(members, similarity, leaf, kind)
    placed = nodes.select("node", "weight", "first").join(found, "node", "left").join(counts, "node", "left")
    placed = placed.withColumn("component", F.coalesce("component", "node"))
    lowest = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    named = placed.join(lowest, "component").select("node", "component_id", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = prepared.select("id", "node").join(named, "node", "left")
    own = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("id") == own, F.lit(False)).alias("kept")
    )
