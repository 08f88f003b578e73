"""Outliers, number of clusters, profiles, coordinates and term-wise assignment."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.functions import fill_unknown
from cohortline.operators.ordering import exact_quantiles, one_quantile
from cohortline.operators.kmeans import best_fits
from cohortline.operators.vectors import (
    BLOCK_ROWS,
    PACK_BYTES,
    VectorScale,
    center_distance,
    centre_blocks,
    centroids,
    fit_scale,
    listed_matrix,
    nearest_in,
    packs_for_cores,
    scale_vectors,
    usable,
)
from cohortline.sources.schemas import FLAG

# Search range, smallest accepted cluster, outlier cut, sizes of the reports.
K_VALUES = (2, 3, 4, 5, 6)
MIN_CLUSTER_SHARE = 0.03
OUTLIER_PERCENTILE = 99.5
TOP_OUTLIERS = 50
RESTARTS, MAX_ITERATIONS = 20, 300
OUTLIER = -1
#: Distances held at once, sums that a block may have, and the share of the squares below which a squared distance counts as
#: cancelled and is taken from the differences.
SLAB_ROWS, SLAB_COLUMNS, GAPS_AT_ONCE, CELLS, CANCELLED = 256, 2048, 1 << 16, 1 << 22, 1e-6

PROFILE_MEANS = {
    "avg_score_mean": "avg_score",
    "fail_course_count_mean": "fail_course_count",
    "internet_hours_sum_mean": "internet_hours_sum",
    "online_learning_bfb_snapshot_mean": "online_learning_bfb_snapshot",
    "physical_test_score_mean": "physical_test_score",
    "current_risk_rate": FLAG,
    "next_term_risk_rate": "risk_label_next_term_numeric",
}


# ---------------------------------------------------------------- outliers


def percentile_threshold(df: DataFrame, column: str, percentile: float = OUTLIER_PERCENTILE) -> DataFrame:
    quantile = exact_quantiles(df, [column], [percentile / 100.0])
    return quantile.select(F.lit(percentile).alias("percentile"), "n", F.col("q0").alias("threshold"))


def outlier_flag(
    df: DataFrame,
    vector: str = "embedding",
    percentile: float = OUTLIER_PERCENTILE,
    scale: VectorScale | None = None,
) -> DataFrame:
    """Distance to the mean vector, the percentile of these distances, and who lies strictly beyond it."""
    fitted = scale or fit_scale(df, vector)
    centre = np.zeros_like(fitted.mean) if scale else fitted.mean
    measured = df.withColumn("embedding_distance_to_center", center_distance(centre, vector, scale))
    threshold = one_quantile(measured, "embedding_distance_to_center", percentile / 100.0)
    return measured.withColumn("outlier_distance_threshold", threshold).withColumn(
        "is_outlier", (F.col("embedding_distance_to_center") > F.col("outlier_distance_threshold")).cast("int")
    )


def inliers(df: DataFrame, flag: str = "is_outlier") -> DataFrame:
    return df.where(F.col(flag) == 0)


def top_outliers(df: DataFrame, columns: Sequence[str], key: Sequence[str], limit: int = TOP_OUTLIERS) -> DataFrame:
    return (
        df.orderBy(F.col("embedding_distance_to_center").desc_nulls_last(), *key).limit(limit).select(*columns)
    )


def zoom_bounds(df: DataFrame, columns: Sequence[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Rows whose coordinates all lie within their own percentile window."""
    bounds = {r["feature"]: (r["q0"], r["q1"]) for r in exact_quantiles(df, columns, [low, high]).collect()}
    for c in columns:
        df = df.where(F.col(c).between(*bounds[c]))
    return df


# ---------------------------------------------------------------- profiles


def cluster_profile(df: DataFrame, by: str = "cluster", outliers: bool = True) -> DataFrame:
    """Size, outliers, mean measures and risk rates per cluster."""
    counts = [F.count("student_id").alias("student_count")]
    if outliers:
        counts.append(F.coalesce(F.sum("is_outlier"), F.lit(0)).cast("bigint").alias("outlier_count"))
    return df.groupBy(by).agg(*counts, *[F.avg(source).alias(name) for name, source in PROFILE_MEANS.items()])


def inlier_profile(df: DataFrame) -> DataFrame:
    return cluster_profile(inliers(df), outliers=False)


def cluster_distribution(df: DataFrame, by: str) -> DataFrame:
    """Count per cluster and organisation; a missing organisation is counted as UNKNOWN, not lost."""
    counts = df.groupBy("cluster", fill_unknown(F.col(by)).alias(by)).agg(F.count("*").alias("count"))
    return counts.orderBy("cluster", F.col("count").desc(), by)


def cluster_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("cluster").agg(F.count("*").alias("student_count"))


def size_range(df: DataFrame) -> DataFrame:
    return cluster_sizes(df).agg(
        F.count("*").alias("clusters"),
        F.min("student_count").alias("min_cluster_size"),
        F.max("student_count").alias("max_cluster_size"),
    )


# ---------------------------------------------------------------- clustering


def _gaps(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Distances of all rows of two matrices. Squares and products cancel where rows are close: there they are taken from
    the differences, so equal rows have no distance."""
    squares = (left * left).sum(axis=1)[:, None] + (right * right).sum(axis=1)[None, :]
    with np.errstate(invalid="ignore", over="ignore"):
        far = squares - 2.0 * (left @ right.T)
        near = np.flatnonzero(~(far >= CANCELLED * squares).ravel())
    flat = far.ravel()
    for a in range(0, len(near), GAPS_AT_ONCE):
        i, j = np.divmod(near[a : a + GAPS_AT_ONCE], len(right))
        gap = left[i] - right[j]
        flat[near[a : a + GAPS_AT_ONCE]] = (gap * gap).sum(axis=1)
    return np.sqrt(far, out=far)


def _sums_by_cluster(left: np.ndarray, right: np.ndarray, left_begin: np.ndarray, right_begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Total distances of the left rows to every right cluster, and of the right rows to every left one. Rows are sorted by
    cluster; ``begin`` has the first row of each."""
    to_right = np.zeros((len(left), len(right_begin)))
    to_left = np.zeros((len(right), len(left_begin)))

    def runs(begin: np.ndarray, low: int, high: int) -> tuple[slice, np.ndarray]:
        first, last = np.searchsorted(begin, low, "right") - 1, np.searchsorted(begin, high, "left")
        return slice(first, last), np.maximum(begin[first:last] - low, 0)

    for a in range(0, len(left), SLAB_ROWS):
        own, starts = runs(left_begin, a, min(a + SLAB_ROWS, len(left)))
        for b in range(0, len(right), SLAB_COLUMNS):
            other, borders = runs(right_begin, b, min(b + SLAB_COLUMNS, len(right)))
            far = _gaps(left[a : a + SLAB_ROWS], right[b : b + SLAB_COLUMNS])
            to_right[a : a + SLAB_ROWS, other] += np.add.reduceat(far, borders, axis=1)
            to_left[b : b + SLAB_COLUMNS, own] += np.add.reduceat(far, starts, axis=0).T
    return to_right, to_left


def _distance_sums(rows: DataFrame, types: dict[str, str], block_rows: int | None = None) -> DataFrame:
    """``(key, cluster, other, n, total)``: distances of every row to the rows of every cluster, added up per pair of blocks.

    Rows are dealt to blocks by key, as many as keep all cores busy, more where a block would exceed ``PACK_BYTES`` or its
    sums ``CELLS``. A row goes to one tile with every block, its own included.
    """
    about = rows.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d"), F.count_distinct("cluster").alias("k")).first()
    most = min(PACK_BYTES // (8 * max(1, about["d"] or 1)), max(BLOCK_ROWS // 2, CELLS // max(1, about["k"])))
    most = block_rows or min(max(1, most), max(BLOCK_ROWS, -(-about["n"] // packs_for_cores(rows.sparkSession))))
    blocks = max(1, -(-about["n"] // most))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")).withColumn("facing", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    tiles = dealt.select("key", "cluster", "vector", "block", F.least("block", "facing").alias("low"), F.greatest("block", "facing").alias("high"))

    def sums(part: pa.Table) -> pa.Table:
        low, high = part.column("low")[0].as_py(), part.column("high")[0].as_py()
        sides = []
        for block in dict.fromkeys((low, high)):
            own = part.filter(pc.equal(part.column("block"), block)).sort_by("cluster")
            clusters = own.column("cluster").combine_chunks()
            begin = np.zeros(1, np.int64)
            if len(own) > 1:
                begin = np.concatenate([begin, 1 + np.flatnonzero(pc.not_equal(clusters[1:], clusters[:-1]).to_numpy(zero_copy_only=False))])
            sides.append((own, listed_matrix(own.column("vector")), begin))
        if any(not len(own) for own, _, _ in sides):
            sides = []
        else:
            # Distances are the same from any origin; a near one loses fewer digits.
            middle = np.concatenate([m for _, m, _ in sides]).mean(axis=0)
            sides = [(own, m - middle, begin) for own, m, begin in sides]
        out = []
        if sides:
            (own, m, begin), (other, w, border) = sides[0], sides[-1]
            to_other, to_own = _sums_by_cluster(m, w, begin, border)
            for rows_, total, far, starts in ((own, to_other, other, border), (other, to_own, own, begin))[: len(sides)]:
                at, c = (x.ravel() for x in np.indices(total.shape))
                sizes = np.diff(np.append(starts, len(far)))
                out.append([rows_.column("key").take(pa.array(at)), rows_.column("cluster").take(pa.array(at)), far.column("cluster").take(pa.array(starts[c])), pa.array(sizes[c]), pa.array(total.ravel())])
        names = ["key", "cluster", "other", "n", "total"]
        found = [pa.table(columns, names=names) for columns in out]
        if not found:
            one = part.slice(0, 0)
            found = [pa.table([one.column("key"), one.column("cluster"), one.column("cluster"), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)]
        return pa.concat_tables(found)

    schema = f"key {types['key']}, cluster {types['cluster']}, other {types['cluster']}, n bigint, total double"
    return tiles.groupBy("low", "high").applyInArrow(sums, schema)


def silhouette(
    df: DataFrame, key: str, vector: str = "embedding", cluster: str = "cluster", metric: str = "euclidean"
) -> DataFrame:
    """Mean silhouette over all rows, one row (``n``, ``silhouette``).

    ``euclidean`` is exact and needs every distance: the work is quadratic, spread over pairs of blocks that
    return only sums per row and cluster; each distance is taken once, for both rows. ``squaredEuclidean`` needs two linear passes and is the choice
    for very large tables; its value is a different one.
    """
    rows = df.select(F.col(key).alias("key"), F.col(cluster).alias("cluster"), F.col(vector).alias("vector"))
    if metric == "squaredEuclidean":
        rows = rows.where(usable("vector") & F.col("cluster").isNotNull())
        evaluator = ClusteringEvaluator(
            featuresCol="features", predictionCol="prediction", metricName="silhouette", distanceMeasure=metric
        )
        value = evaluator.evaluate(
            rows.select(array_to_vector("vector").alias("features"), F.col("cluster").cast("int").alias("prediction"))
        )
        return rows.agg(F.count("*").alias("n"), F.lit(float(value)).alias("silhouette"))

    rows = rows.where(usable("vector") & F.col("cluster").isNotNull())
    pairs = _distance_sums(rows, dict(rows.dtypes))
    totals = pairs.groupBy("key", "cluster", "other").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    mine = F.col("cluster") == F.col("other")
    sides = totals.groupBy("key", "cluster").agg(
        F.max(F.when(mine, F.col("n"))).alias("own_n"),
        F.max(F.when(mine, F.col("total") / F.greatest(F.col("n") - 1, F.lit(1)))).alias("own"),
        F.min(F.when(~mine, F.col("total") / F.col("n"))).alias("nearest"),
    )
    # A point with no distance to its own or to the nearest other cluster is on neither side.
    score = F.try_divide(F.col("nearest") - F.col("own"), F.greatest("nearest", "own"))
    value = F.when(F.col("nearest").isNotNull(), F.when(F.col("own_n") == 1, 0.0).otherwise(F.coalesce(score, F.lit(0.0))))
    return sides.agg(F.count("*").alias("n"), F.avg(value).alias("silhouette"))


@dataclass(frozen=True)
class KSearch:
    """Outcome of the search: chosen k, labelled rows, one table row per tried k."""

    k: int
    labelled: DataFrame
    table: DataFrame


def choose_k(
    df: DataFrame,
    key: str,
    vector: str = "embedding_scaled",
    ks: Sequence[int] = K_VALUES,
    min_share: float = MIN_CLUSTER_SHARE,
    restarts: int = RESTARTS,
    max_iter: int = MAX_ITERATIONS,
    seed: int = 42,
    metric: str = "squaredEuclidean",
    cluster: str = "cluster",
) -> KSearch:
    """K-means for each k, best of several starts; best silhouette among the k without a tiny cluster.

    All starts of all k advance together, one pass over the rows per iteration. The silhouette is the linear one unless the
    caller asks for ``euclidean``. If every k leaves a tiny cluster, the best silhouette decides alone.
    """
    points = df.select(key, vector).where(usable(vector)).persist()
    smallest_allowed = max(1, math.ceil(points.count() * min_share))
    fits = best_fits(points, key, vector, ks, restarts, max_iter, seed)
    tried = []
    for k, fit in fits.items():
        sizes = [int(n) for n in fit.sizes if n > 0]
        if len(sizes) < 2:
            continue
        near = nearest_in([(list(range(k)), fit.centres)], vector)
        labelled = points.withColumn(cluster, near["id"])
        score = silhouette(labelled, key, vector, cluster, metric).first()["silhouette"]
        tried.append((k, score, min(sizes), max(sizes), min(sizes) >= smallest_allowed, fit.centres))
    points.unpersist()
    if not tried:
        raise ValueError("no k gave two clusters")
    best = max(tried, key=lambda t: (t[4], t[1]))
    table = df.sparkSession.createDataFrame(
        [(t[0], round(float(t[1]), 6), t[2], t[3], t[4]) for t in tried],
        "k int, silhouette_score double, min_cluster_size bigint, max_cluster_size bigint, valid_clustering boolean",
    )
    near = nearest_in([(list(range(best[0])), best[5])], vector)
    return KSearch(best[0], df.withColumn(cluster, near["id"]), table)


def pca_2d(df: DataFrame, vector: str = "embedding_scaled") -> DataFrame:
    """Two principal coordinates of the centred vectors; the largest loading of each axis is positive."""
    scale = fit_scale(df, vector)
    centred = scale_vectors(df, VectorScale(scale.mean, np.ones_like(scale.std), scale.n), vector, "_centred")
    features = centred.withColumn("_features", array_to_vector("_centred"))
    model = PCA(k=2, inputCol="_features", outputCol="_pca").fit(features)
    axes = model.pc.toArray()
    signs = [float(np.sign(axis[np.abs(axis).argmax()]) or 1.0) for axis in axes.T]
    projected = model.transform(features).withColumn("_xy", vector_to_array("_pca"))
    return projected.select(
        *df.columns, *[(F.col("_xy")[i] * signs[i]).alias(f"pca_{i + 1}") for i in range(2)]
    )


# ---------------------------------------------------------------- every term


def label_names(df: DataFrame, names: DataFrame, cluster: str = "cluster", name: str = "cluster_name") -> DataFrame:
    """Cluster id to name through a small table; an id without a name is UNKNOWN."""
    return df.join(names.select(cluster, name), cluster, "left").withColumn(name, fill_unknown(F.col(name)))


def assign_semesters(
    semesters: DataFrame,
    last: DataFrame,
    threshold: float,
    vector: str = "embedding",
    cluster: str = "cluster",
) -> DataFrame:
    """Place every term by the last terms' scale, centre and inlier clusters.

    The fit costs one pass over the last terms for the scale and one for the cluster means; a scaled
    mean is the mean scaled, so no scaled copy is needed. The terms themselves are not shuffled.
    """
    scale = fit_scale(last, vector)
    means = centroids(last.where(usable(vector) & (F.col(cluster) >= 0)), cluster, vector)
    blocks = [(ids, scale.apply(raw)) for ids, raw in centre_blocks(means, cluster)]
    kept = [c for c in semesters.columns if c != cluster]
    scaled = scale_vectors(semesters.select(*kept), scale, vector)
    distance = F.col("embedding_distance_to_center")
    placed = scaled.withColumns(
        {
            "embedding_distance_to_center": center_distance(np.zeros_like(scale.mean), "embedding_scaled"),
            "_near": nearest_in(blocks, "embedding_scaled", dict(means.dtypes)[cluster]),
        }
    )
    return placed.select(
        *kept,
        F.when(distance > threshold, OUTLIER).otherwise(F.col("_near.id")).cast("int").alias(cluster),
        (distance > threshold).cast("int").alias("is_outlier"),
        "embedding_distance_to_center",
        "embedding_scaled",
    )
