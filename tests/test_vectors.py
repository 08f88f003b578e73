from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortline.operators import clusters, neighbours, vectors

DIMS = 6


@pytest.fixture
def cloud(table):
    """Three groups, one of them holding half of all rows, plus one far point; also an exact duplicate."""
    rng = np.random.default_rng(11)
    centres = np.array([[0.0] * DIMS, [8.0] * DIMS, [-8.0, 8.0] * (DIMS // 2)])
    labels = np.array([0] * 60 + [1] * 35 + [2] * 25)
    points = (centres[labels] + rng.normal(size=(len(labels), DIMS))).astype(np.float32)
    points[1] = points[0]
    points[-1] = 90.0
    df = table([(i, int(c), p.tolist()) for i, (c, p) in enumerate(zip(labels, points))], "id bigint, cluster int, embedding array<float>")
    return df, labels, points.astype(np.float64)


def distances(points):
    return np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))


def silhouette_by_definition(far, labels):
    scores = []
    for i, c in enumerate(labels):
        mine = labels == c
        if mine.sum() == 1:
            scores.append(0.0)
            continue
        a = far[i, mine].sum() / (mine.sum() - 1)
        b = min(far[i, labels == o].mean() for o in set(labels) - {c})
        scores.append((b - a) / max(a, b))
    return float(np.mean(scores))


def test_scale_and_centroids(cloud):
    df, labels, points = cloud
    scale = vectors.fit_scale(df)
    assert scale.mean == pytest.approx(points.mean(axis=0)) and scale.std == pytest.approx(points.std(axis=0))
    [(ids, matrix)] = vectors.centre_blocks(vectors.centroids(df))
    assert ids == [0, 1, 2]
    assert matrix == pytest.approx(np.array([points[labels == c].mean(axis=0) for c in range(3)]))


def test_nearest_centroid_prefers_the_lowest_id_on_a_tie(table):
    centres = table([(5, [1.0, 0.0]), (2, [-1.0, 0.0])], "cluster int, centre array<double>")
    rows = table([(1, [0.0, 3.0]), (2, [0.9, 0.0])], "id int, embedding array<float>")
    got = {r["id"]: r["nearest"] for r in vectors.nearest_centroid(rows, centres).collect()}
    assert got == {1: 2, 2: 5}


def test_no_centre_is_an_error(table):
    with pytest.raises(ValueError, match="centres"):
        vectors.centre_blocks(table([], "cluster int, centre array<double>"))


def test_many_centres_come_in_blocks(table):
    centres = table([(i, [float(i)]) for i in range(50)], "cluster int, centre array<double>")
    rows = table([(i, [i + 0.2]) for i in range(50)] + [(99, None), (98, [float("nan")])], "id int, embedding array<float>")
    got = {r["id"]: r["nearest"] for r in vectors.nearest_centroid(rows, centres, block_rows=7).collect()}
    assert got == {i: i for i in range(50)} | {98: None, 99: None}


def test_unusable_vectors_have_no_neighbour_and_no_distance(table):
    nan = float("nan")
    rows = [("a", [1.0, 0.0]), ("b", [1.0, 0.1]), ("c", [nan, 1.0]), ("d", None), ("e", [0.0, 1.0])]
    df = table(rows, "id string, embedding array<float>")
    got = {r["key"]: r["neighbour"] for r in neighbours.nearest_neighbour(df, df, "id").collect()}
    assert got == {"a": "b", "b": "a", "c": None, "d": None, "e": "b"}
    alone = df.where("id = 'a'")
    assert [tuple(r) for r in neighbours.nearest_neighbour(alone, alone, "id").collect()] == [("a", None, None)]
    flagged = {r["id"]: r["is_outlier"] for r in clusters.outlier_flag(df).collect()}
    assert flagged["c"] is None and flagged["d"] is None and flagged["a"] is not None


def test_silhouette_of_equal_points_is_zero(table):
    df = table([(i, i % 2, [1.0, 2.0]) for i in range(6)], "id int, cluster int, embedding array<float>")
    assert clusters.silhouette(df, "id").first()["silhouette"] == 0.0


@pytest.mark.parametrize("limit", [1000, 10])
def test_nearest_neighbour(cloud, limit):
    df, _, points = cloud
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    similar = np.round(unit @ unit.T, 12)
    np.fill_diagonal(similar, -np.inf)
    got = {r["key"]: (r["neighbour"], r["cosine"]) for r in neighbours.nearest_neighbour(df, df, "id", block_rows=limit).collect()}
    assert len(got) == len(points)
    for i, row in enumerate(similar):
        assert got[i] == (row.argmax(), pytest.approx(row.max()))


def neighbours_by_hand(queries, bank):
    """Best other key per row: cosine to 12 digits, then the lowest key."""
    out = {}
    for key, v in queries:
        found = []
        for other, w in bank:
            if v is not None and w is not None and other != key and np.isfinite(v).all() and np.isfinite(w).all():
                norm = np.linalg.norm(v) * np.linalg.norm(w)
                found.append((-np.round(np.dot(v, w) / norm, 12) if norm else 0.0, other))
        best = min(found, default=(None, None))
        out[key] = (best[1], None if best[0] is None else pytest.approx(-best[0], abs=1e-11))
    return out


def test_neighbours_by_cells_of_odd_rows(table):
    """Equal vectors, opposite ones, zeros, missing ones, text keys, a bank of other rows."""
    rng = np.random.default_rng(5)
    rows = [(f"k{i:03d}", [float(x) for x in rng.integers(-2, 3, 3)]) for i in range(150)]
    rows += [("z1", [0.0, 0.0, 0.0]), ("z2", [0.0, 0.0, 0.0]), ("n", None), ("x", [float("inf"), 0.0, 1.0])]
    df = table(rows, "id string, embedding array<double>")
    answers = lambda found: {r["key"]: (r["neighbour"], r["cosine"]) for r in found.collect()}
    assert answers(neighbours.nearest_neighbour(df, df, "id", block_rows=8)) == neighbours_by_hand(rows, rows)
    bank = rows[:40] + rows[-4:]
    other = table(bank, "id string, embedding array<double>")
    assert answers(neighbours.nearest_neighbour(df, other, "id", block_rows=8)) == neighbours_by_hand(rows, bank)
    same = table([(i, [1.0, 2.0]) for i in range(40)], "id long, embedding array<double>")
    assert {k: v[0] for k, v in answers(neighbours.nearest_neighbour(same, same, "id", block_rows=8)).items()} == {0: 1} | {i: 0 for i in range(1, 40)}
    none = table([], "id long, embedding array<double>")
    assert {v[0] for v in answers(neighbours.nearest_neighbour(same, none, "id", block_rows=8)).values()} == {None}


def test_fewer_pairs_than_quadratic_on_groups(spark):
    """Vectors in groups: ten times the rows, far less than a hundred times the pairs."""
    pairs = {}
    for n in (2000, 20_000):
        rng = np.random.default_rng(6)
        centres = rng.normal(size=(n // 50, 16))
        points = np.repeat(centres, 50, axis=0) + rng.normal(scale=0.05, size=(n, 16))
        df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, embedding array<double>")
        counter = spark.sparkContext.accumulator(0)
        found = neighbours.nearest_neighbour(df, df, "id", block_rows=500, counter=counter).collect()
        pairs[n] = counter.value
        unit = points / np.linalg.norm(points, axis=1, keepdims=True)
        for r in found[:300]:
            similar = np.round(unit @ unit[r["key"]], 12)
            similar[r["key"]] = -np.inf
            assert r["neighbour"] == similar.argmax()
    print("pairs compared", pairs)
    assert pairs[20_000] < 40 * pairs[2000] and pairs[20_000] < 20_000**2 / 10


def test_rows_are_sent_to_packs_of_cells(spark, monkeypatch):
    """Vectors without groups need nearly every cell: what is written and exchanged grows with the packs, not with the cells."""
    rng = np.random.default_rng(7)
    points = rng.normal(size=(1500, 12))
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, embedding array<double>")
    written, cut = [], neighbours.cut_lineage

    def counted(rows):
        out = cut(rows)
        written.append(out.count())
        return out

    monkeypatch.setattr(neighbours, "cut_lineage", counted)
    found = neighbours.nearest_neighbour(df, df, "id", block_rows=20)
    assert max(written) <= 16 * len(points)
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    similar = np.round(unit @ unit.T, 12)
    np.fill_diagonal(similar, -np.inf)
    assert {r["key"]: r["neighbour"] for r in found.collect()} == dict(enumerate(similar.argmax(axis=1)))


@pytest.mark.parametrize("sizes", [[], [0, 0], [3, 0, 4, 25, 2, 9], [40], [1] * 30])
def test_packs_hold_every_cell(sizes):
    packs = neighbours._Packs(np.array(sizes, np.int64), 10)
    where = [(c, p) for p, cells in enumerate(packs.cells) for c in cells]
    assert sorted(where) == [(c, packs.first[c] + i) for c, n in enumerate(sizes) if n for i in range(packs.parts[c])]
    assert all(packs.parts[c] == max(1, -(-n // 10)) for c, n in enumerate(sizes))
    assert all(len(cells) == 1 or sum(sizes[c] for c in cells) <= 10 for cells in packs.cells)


def test_blocks_cover_every_pair_once(cloud):
    df, _, points = cloud

    def count(left, right):
        return left[["id"]].assign(n=len(right))

    got = vectors.blockwise(df.select("id"), df.select("id"), "id", "id", count, "id long, n long", block_rows=17)
    assert {r["id"]: r["n"] for r in got.groupBy("id").agg(F.sum("n").alias("n")).collect()} == dict.fromkeys(range(120), 120)


@pytest.mark.parametrize("metric", ["euclidean", "squaredEuclidean"])
def test_silhouette(cloud, metric):
    df, labels, points = cloud
    far = distances(points)
    want = silhouette_by_definition(far if metric == "euclidean" else far**2, labels)
    got = clusters.silhouette(df, "id", metric=metric).first()
    assert (got["n"], got["silhouette"]) == (120, pytest.approx(want, abs=1e-6 if metric == "euclidean" else 2e-2))


def test_distance_sums_of_pairs_of_blocks(spark):
    """Every pair of blocks meets once and gives both sides; far from the origin, with equal and nearly equal rows."""
    rng = np.random.default_rng(8)
    points = np.round(rng.normal(size=(90, 5)), 3) + 1000.0
    points[50:60], points[60:63] = points[:10], points[:3] + 1e-9
    labels = rng.integers(0, 4, 90)
    df = spark.createDataFrame([(f"k{i}", f"c{c}", p.tolist()) for i, (c, p) in enumerate(zip(labels, points))], "key string, cluster string, vector array<double>")
    sums = clusters._distance_sums(df, dict(df.dtypes), block_rows=12)
    got = {(r["key"], r["other"]): (r["n"], r["total"]) for r in sums.groupBy("key", "other").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()}
    far = distances(points)
    want = {(f"k{i}", f"c{c}"): ((labels == c).sum(), pytest.approx(far[i, labels == c].sum(), rel=1e-9)) for i in range(90) for c in range(4)}
    assert got == want
    # 8 blocks: a row is sent to each once, and no pair of blocks meets twice.
    assert sums.count() <= 90 * 8 * 4


def test_silhouette_of_single_points(table):
    df = table([(1, 0, [0.0]), (2, 0, [1.0]), (3, 1, [5.0])], "id int, cluster int, embedding array<float>")
    got = clusters.silhouette(df, "id").first()["silhouette"]
    assert got == pytest.approx(np.mean([(5 - 1) / 5, (4 - 1) / 4, 0.0]))


def test_outliers_are_strictly_beyond_the_threshold(table):
    df = table([(i, [float(x)]) for i, x in enumerate([-1, 1, -1, 1, -1, 1])], "id int, embedding array<float>")
    flagged = clusters.outlier_flag(df, percentile=99.5)
    assert flagged.where("is_outlier = 1").isEmpty()
    assert flagged.where("embedding_distance_to_center = outlier_distance_threshold").count() == 6


def test_outlier_share(cloud):
    df, _, points = cloud
    distance = np.linalg.norm(points - points.mean(axis=0), axis=1)
    flagged = {r["id"]: r["is_outlier"] for r in clusters.outlier_flag(df).collect()}
    assert flagged == {i: int(d > np.percentile(distance, 99.5)) for i, d in enumerate(distance)}
    top = clusters.top_outliers(clusters.outlier_flag(df), ["id"], ["id"], limit=3)
    assert [r["id"] for r in top.collect()] == np.argsort(-distance, kind="stable")[:3].tolist()


def test_choose_k_finds_the_groups(cloud):
    df, labels, _ = cloud
    rows = df.where("id < 119").drop("cluster")
    search = clusters.choose_k(rows, "id", "embedding", ks=[2, 3, 4], restarts=2)
    assert search.k == 3 and {r["k"] for r in search.table.collect()} == {2, 3, 4}
    pairs = {(int(labels[r["id"]]), r["cluster"]) for r in search.labelled.collect()}
    assert len(pairs) == 3
    row = search.table.where("k = 3").first()
    assert (row["min_cluster_size"], row["max_cluster_size"], row["valid_clustering"]) == (24, 60, True)
    sizes = clusters.size_range(search.labelled).first()
    assert tuple(sizes) == (3, 24, 60)


def test_choose_k_falls_back_when_every_k_leaves_a_tiny_cluster(cloud):
    df, _, _ = cloud
    search = clusters.choose_k(df.drop("cluster"), "id", "embedding", ks=[2, 3], restarts=1, min_share=0.6)
    scores = {r["k"]: (r["silhouette_score"], r["valid_clustering"]) for r in search.table.collect()}
    assert search.k == max(scores, key=lambda k: scores[k][0]) and not any(v for _, v in scores.values())


def test_pca_coordinates(cloud):
    df, _, points = cloud
    got = np.array([(r["pca_1"], r["pca_2"]) for r in clusters.pca_2d(df, "embedding").orderBy("id").collect()])
    centred = points - points.mean(axis=0)
    axes = np.linalg.svd(centred, full_matrices=False)[2][:2]
    axes *= np.sign(axes[np.arange(2), np.abs(axes).argmax(axis=1)])[:, None]
    assert got == pytest.approx(centred @ axes.T, abs=1e-6)


def test_assign_semesters(cloud):
    df, labels, points = cloud
    last = df.withColumn("cluster", F.when(F.col("id") == 119, -1).otherwise(F.col("cluster")))
    z = (points - points.mean(axis=0)) / points.std(axis=0)
    centres = np.array([z[:119][labels[:119] == c].mean(axis=0) for c in range(3)])
    nearest = np.sqrt(((z[:, None] - centres[None]) ** 2).sum(axis=2)).argmin(axis=1)
    whole = np.linalg.norm(z, axis=1)
    got = clusters.assign_semesters(df.drop("cluster"), last, 5.0).orderBy("id").collect()
    assert [r["cluster"] for r in got] == np.where(whole > 5.0, -1, nearest).tolist()
    assert got[3]["embedding_scaled"] == pytest.approx(z[3].tolist())
    assert [r["embedding_distance_to_center"] for r in got] == pytest.approx(whole.tolist())


def test_encoder_layers(cloud):
    df, _, points = cloud
    rng = np.random.default_rng(2)
    layers = [(rng.normal(size=(DIMS, 5)), rng.normal(size=5)), (rng.normal(size=(5, 2)), rng.normal(size=2))]
    want = points
    for w, b in layers:
        want = np.maximum(want @ w + b, 0)
    got = np.array([r["encoded"] for r in vectors.encode_batch(df, layers).orderBy("id").collect()])
    assert got == pytest.approx(want)


def test_a_small_far_group_gets_a_start(table):
    """One row in five thousand, far from the rest."""
    from cohortline.operators import kmeans

    rng = np.random.default_rng(4)
    points = rng.normal(size=(5000, 3))
    points[77] = 400.0
    df = table([(i, p.tolist()) for i, p in enumerate(points)], "id bigint, embedding array<double>").repartition(4).persist()
    drawn, weights = kmeans.candidates(df, "id", "embedding", seed=1)
    assert weights.sum() == 5000 and len(drawn) > 500
    assert (drawn == 400.0).all(axis=1).any()
    fit = kmeans.best_fits(df, "id", "embedding", [2], restarts=3, max_iter=20, seed=1)[2]
    assert sorted(fit.sizes.tolist()) == [1, 4999]
    assert kmeans._spread(df, "embedding", points[0]) == pytest.approx(points.var(axis=0).mean())
    df.unpersist()
