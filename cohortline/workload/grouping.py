"""Vectors, clusters, movement between clusters and personas."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.operators import clusters, dynamics, neighbours, personas, vectors
from cohortline.operators.clusters import PROFILE_MEANS
from cohortline.operators.features import last_term
from cohortline.operators.personas import PERSONA_ORDER
from cohortline.workload.campus import DIMS, SQL_EMBEDDED_TERMS, Campus, r6
from cohortline.workload.preparation import rounded
from cohortline.workload.registry import query

# ---------------------------------------------------------------- vectors

SQL_LONG = "long AS (SELECT vec_id, label AS cluster, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)"
SQL_CENTRES = f"{SQL_LONG}, centres AS (SELECT cluster, dim, avg(x) AS centre, count(*) AS n FROM long GROUP BY ALL)"


def labelled_vectors(c: Campus) -> DataFrame:
    return c.table("embeddings").select("vec_id", F.col("label").alias("cluster"), "embedding")


@query(f"WITH {SQL_CENTRES} SELECT CAST(cluster AS INTEGER) AS cluster, CAST(dim AS INTEGER) AS dim, {r6('centre')} AS value, n FROM centres")
def centroids(c: Campus) -> DataFrame:
    found = vectors.centroids(labelled_vectors(c))
    return rounded(found.select("cluster", F.posexplode("centre").alias("dim", "value"), "n"), "value")


@query(f"""WITH {SQL_CENTRES},
far AS (SELECT vec_id, c.cluster, sqrt(sum((x - centre) * (x - centre))) AS d FROM long JOIN centres c USING (dim) GROUP BY ALL)
SELECT vec_id, CAST(arg_min(cluster, d) AS INTEGER) AS nearest, {r6("min(d)")} AS nearest_distance FROM far GROUP BY vec_id""")
def nearest_centroid(c: Campus) -> DataFrame:
    rows = labelled_vectors(c)
    found = vectors.nearest_centroid(rows.select("vec_id", "embedding"), vectors.centroids(rows))
    return rounded(found.drop("embedding"), "nearest_distance")


SQL_NEIGHBOURS = """WITH pairs AS (
  SELECT a.vec_id AS key, b.vec_id AS other,
         round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 12) AS s
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY s DESC, other) AS rn FROM pairs)
SELECT key, other AS neighbour, """ + r6("s") + """ AS cosine FROM ranked WHERE rn = 1"""


@query(SQL_NEIGHBOURS)
def nearest_neighbour(c: Campus) -> DataFrame:
    rows = c.table("embeddings")
    return rounded(neighbours.nearest_neighbour(rows, rows, "vec_id"), "cosine")


@query(SQL_NEIGHBOURS)
def nearest_neighbour_blocks(c: Campus) -> DataFrame:
    """The same with many small blocks."""
    rows = c.table("embeddings")
    return rounded(neighbours.nearest_neighbour(rows, rows, "vec_id", block_rows=200), "cosine")


ENCODED = 8


def encoder_layers() -> list[tuple[np.ndarray, np.ndarray]]:
    i, j = np.arange(1, DIMS + 1)[:, None], np.arange(1, ENCODED + 1)[None, :]
    return [(np.sin(i * j), np.cos(np.arange(1, ENCODED + 1)))]


@query(f"""WITH {SQL_LONG},
outputs AS (SELECT unnest(generate_series(1, {ENCODED})) AS j)
SELECT vec_id, CAST(j - 1 AS INTEGER) AS output, {r6("greatest(sum(x * sin((dim + 1) * j)) + cos(any_value(j)), 0)")} AS value
FROM long, outputs GROUP BY vec_id, j""")
def encode_batch(c: Campus) -> DataFrame:
    encoded = vectors.encode_batch(c.table("embeddings").select("vec_id", "embedding"), encoder_layers())
    return rounded(encoded.select("vec_id", F.posexplode("encoded").alias("output", "value")), "value")


# ---------------------------------------------------------------- outliers

SQL_DISTANCE = f"""{SQL_LONG},
middle AS (SELECT dim, avg(x) AS centre FROM long GROUP BY dim),
measured AS (SELECT vec_id, cluster, sqrt(sum((x - centre) * (x - centre))) AS d FROM long JOIN middle USING (dim) GROUP BY ALL),
cut AS (SELECT quantile_cont(d, 0.995) AS threshold, count(*) AS n FROM measured)"""


def measured(c: Campus) -> DataFrame:
    return clusters.outlier_flag(labelled_vectors(c))


@query(f"WITH {SQL_DISTANCE} SELECT CAST(99.5 AS DOUBLE) AS percentile, n, {r6('threshold')} AS threshold FROM cut")
def percentile_threshold(c: Campus) -> DataFrame:
    rows = labelled_vectors(c)
    centre = vectors.fit_scale(rows).mean
    distances = rows.select(vectors.center_distance(centre).alias("d"))
    return rounded(clusters.percentile_threshold(distances, "d"), "threshold")


@query(f"""WITH {SQL_DISTANCE}
SELECT vec_id, {r6("d")} AS embedding_distance_to_center, {r6("threshold")} AS outlier_distance_threshold,
  CASE WHEN d > threshold THEN 1 ELSE 0 END AS is_outlier FROM measured, cut""")
def outlier_flag(c: Campus) -> DataFrame:
    flagged = rounded(measured(c), "embedding_distance_to_center", "outlier_distance_threshold")
    return flagged.drop("embedding", "cluster")


@query(f"""WITH {SQL_DISTANCE}
SELECT vec_id, cluster, {r6("d")} AS embedding_distance_to_center, CASE WHEN d > threshold THEN 1 ELSE 0 END AS is_outlier
FROM measured, cut ORDER BY d DESC, vec_id LIMIT 50""")
def top_outliers(c: Campus) -> DataFrame:
    columns = ["vec_id", "cluster", "embedding_distance_to_center", "is_outlier"]
    return rounded(clusters.top_outliers(measured(c), columns, ["vec_id"]), "embedding_distance_to_center")


@query("""WITH points AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)
SELECT vec_id, x, y FROM points
WHERE x BETWEEN (SELECT quantile_cont(x, 0.01) FROM points) AND (SELECT quantile_cont(x, 0.99) FROM points)
  AND y BETWEEN (SELECT quantile_cont(y, 0.01) FROM points) AND (SELECT quantile_cont(y, 0.99) FROM points)""")
def zoom_bounds(c: Campus) -> DataFrame:
    e = F.col("embedding")
    points = c.table("embeddings").select("vec_id", e[0].cast("double").alias("x"), e[1].cast("double").alias("y"))
    return clusters.zoom_bounds(points, ["x", "y"])


# ---------------------------------------------------------------- profiles

MEANS = tuple(PROFILE_MEANS)
_MEANS_SQL = ", ".join(f"{r6(f'avg({source})')} AS {name}" for name, source in PROFILE_MEANS.items())


@query(f"""{SQL_EMBEDDED_TERMS} SELECT cluster, count(*) AS student_count, CAST(sum(is_outlier) AS BIGINT) AS outlier_count, {_MEANS_SQL}
FROM embedded_terms GROUP BY cluster""")
def cluster_profile(c: Campus) -> DataFrame:
    return rounded(clusters.cluster_profile(c.embedded_terms), *MEANS)


@query(f"""{SQL_EMBEDDED_TERMS} SELECT cluster, count(*) AS student_count, {_MEANS_SQL}
FROM embedded_terms WHERE is_outlier = 0 GROUP BY cluster""")
def inlier_profile(c: Campus) -> DataFrame:
    return rounded(clusters.inlier_profile(c.embedded_terms), *MEANS)


@query(f"{SQL_EMBEDDED_TERMS} SELECT cluster, coalesce(major, 'UNKNOWN') AS major, count(*) AS count FROM embedded_terms GROUP BY ALL")
def cluster_distribution(c: Campus) -> DataFrame:
    return clusters.cluster_distribution(c.embedded_terms, "major")


@query(f"{SQL_EMBEDDED_TERMS} SELECT cluster, count(*) AS student_count FROM embedded_terms GROUP BY ALL")
def cluster_sizes(c: Campus) -> DataFrame:
    return clusters.cluster_sizes(c.embedded_terms)


@query("""WITH pairs AS (
  SELECT a.vec_id, a.label AS own, b.label AS other,
         sum(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) AS total, count(*) AS n
  FROM embeddings a, embeddings b GROUP BY ALL),
parts AS (
  SELECT vec_id, max(CASE WHEN own = other THEN n END) AS own_n,
         max(CASE WHEN own = other THEN total / greatest(n - 1, 1) END) AS a, min(CASE WHEN own <> other THEN total / n END) AS b
  FROM pairs GROUP BY vec_id)
SELECT count(*) AS n, """ + r6("avg(CASE WHEN own_n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END)") + " AS silhouette FROM parts")
def silhouette(c: Campus) -> DataFrame:
    return rounded(clusters.silhouette(labelled_vectors(c), "vec_id"), "silhouette")


@query("""WITH pairs AS (
  SELECT a.vec_id, a.label AS own, b.label AS other,
         sum(power(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 2)) AS total, count(*) AS n
  FROM embeddings a, embeddings b GROUP BY ALL),
parts AS (
  SELECT vec_id, max(CASE WHEN own = other THEN n END) AS own_n,
         max(CASE WHEN own = other THEN total / greatest(n - 1, 1) END) AS a, min(CASE WHEN own <> other THEN total / n END) AS b
  FROM pairs GROUP BY vec_id)
SELECT count(*) AS n, """ + r6("avg(CASE WHEN own_n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END)") + " AS silhouette FROM parts")
def silhouette_squared(c: Campus) -> DataFrame:
    """Linear in the rows; checked against the pairwise definition in the tests."""
    return rounded(clusters.silhouette(labelled_vectors(c), "vec_id", metric="squaredEuclidean"), "silhouette")


# ---------------------------------------------------------------- clustering


def scaled_vectors(c: Campus) -> DataFrame:
    rows = c.table("embeddings").select("vec_id", "embedding")
    return vectors.scale_vectors(rows, vectors.fit_scale(rows))


@query()
def choose_k(c: Campus) -> DataFrame:
    return clusters.choose_k(scaled_vectors(c), "vec_id").labelled.select("vec_id", "cluster")


@query()
def k_search_table(c: Campus) -> DataFrame:
    return clusters.choose_k(scaled_vectors(c), "vec_id").table


@query()
def pca_2d(c: Campus) -> DataFrame:
    return rounded(clusters.pca_2d(scaled_vectors(c)).select("vec_id", "pca_1", "pca_2"), "pca_1", "pca_2")


THRESHOLD = 9.0


@query(f"""{SQL_EMBEDDED_TERMS},
last_rows AS (SELECT *, CASE WHEN cluster = 9 THEN -1 ELSE cluster END AS group_id FROM embedded_terms
  QUALIFY row_number() OVER (PARTITION BY student_id ORDER BY term_order DESC) = 1),
last_long AS (SELECT group_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS dim FROM last_rows),
scale AS (SELECT dim, avg(x) AS mean, coalesce(nullif(stddev_pop(x), 0), 1) AS std FROM last_long GROUP BY dim),
centres AS (SELECT group_id, dim, avg((x - mean) / std) AS centre FROM last_long JOIN scale USING (dim) WHERE group_id >= 0 GROUP BY ALL),
long AS (SELECT vec_id, (x - mean) / std AS z, dim FROM (
  SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS dim FROM embedded_terms) JOIN scale USING (dim)),
whole AS (SELECT vec_id, sqrt(sum(z * z)) AS d, max(CASE WHEN dim = 1 THEN z END) AS first_scaled FROM long GROUP BY vec_id),
far AS (SELECT vec_id, group_id, sqrt(sum((z - centre) * (z - centre))) AS d FROM long JOIN centres USING (dim) GROUP BY ALL),
near AS (SELECT vec_id, arg_min(group_id, d) AS nearest FROM far GROUP BY vec_id)
SELECT vec_id, CAST(CASE WHEN d > {THRESHOLD} THEN -1 ELSE nearest END AS INTEGER) AS cluster,
  CASE WHEN d > {THRESHOLD} THEN 1 ELSE 0 END AS is_outlier, {r6("d")} AS embedding_distance_to_center,
  {r6("first_scaled")} AS first_scaled FROM whole JOIN near USING (vec_id)""")
def assign_semesters(c: Campus) -> DataFrame:
    terms = c.embedded_terms.select("vec_id", "student_id", "school_year", "semester", "term_order", "cluster", "embedding")
    last = last_term(terms).withColumn("cluster", F.when(F.col("cluster") == 9, -1).otherwise(F.col("cluster")))
    placed = clusters.assign_semesters(terms.select("vec_id", "embedding"), last, THRESHOLD)
    first = F.col("embedding_scaled")[0].alias("first_scaled")
    columns = placed.select("vec_id", "cluster", "is_outlier", "embedding_distance_to_center", first)
    return rounded(columns, "embedding_distance_to_center", "first_scaled")


# ---------------------------------------------------------------- movement

SQL_PATHS = f"""{SQL_EMBEDDED_TERMS},
paired AS (
  SELECT *, lead(struct_pack(y := school_year, s := semester, c := cluster, n := cluster_name, o := is_outlier, f := risk_event_current))
    OVER (PARTITION BY student_id ORDER BY term_order, school_year, semester) AS nxt FROM embedded_terms),
paths AS (
  SELECT student_id, school_year AS from_school_year, semester AS from_semester, nxt.y AS to_school_year, nxt.s AS to_semester,
    cluster AS from_cluster, cluster_name AS from_cluster_name, nxt.c AS to_cluster, nxt.n AS to_cluster_name,
    is_outlier AS from_is_outlier, nxt.o AS to_is_outlier, avg_score AS from_avg_score,
    fail_course_count AS from_fail_course_count, internet_hours_sum AS from_internet_hours_sum,
    risk_label_next_term_numeric, nxt.f AS next_term_risk_event_current
  FROM paired WHERE nxt IS NOT NULL),
counts AS (SELECT from_cluster, from_cluster_name, to_cluster, to_cluster_name, count(*) AS count FROM paths GROUP BY ALL),
rates AS (SELECT *, CAST(sum(count) OVER (PARTITION BY from_cluster) AS BIGINT) AS row_total FROM counts),
risk AS (
  SELECT from_cluster, from_cluster_name, to_cluster, to_cluster_name, count(student_id) AS transition_count,
    {r6("avg(risk_label_next_term_numeric)")} AS next_term_risk_rate, {r6("avg(next_term_risk_event_current)")} AS next_term_risk_event_rate,
    {r6("avg(from_avg_score)")} AS from_avg_score_mean, {r6("avg(from_fail_course_count)")} AS from_fail_course_count_mean,
    {r6("avg(from_internet_hours_sum)")} AS from_internet_hours_sum_mean
  FROM paths GROUP BY ALL),
term_clusters AS (SELECT school_year, semester, cluster, cluster_name, count(*) AS count FROM embedded_terms GROUP BY ALL)"""
_RISK_MEANS = (
    "next_term_risk_rate", "next_term_risk_event_rate", "from_avg_score_mean", "from_fail_course_count_mean", "from_internet_hours_sum_mean",
)
_PATH = ", ".join(dynamics.PATH)


def named_terms(c: Campus) -> DataFrame:
    """Terms with their cluster's name; cluster 9 has none."""
    return clusters.label_names(c.embedded_terms, c.cluster_names)


def paths(c: Campus) -> DataFrame:
    return dynamics.transitions(named_terms(c))


@query(f"{SQL_PATHS} SELECT * FROM paths")
def transitions(c: Campus) -> DataFrame:
    return paths(c)


@query(f"{SQL_PATHS} SELECT * FROM counts")
def transition_counts(c: Campus) -> DataFrame:
    return dynamics.transition_counts(paths(c))


@query(f"{SQL_PATHS} SELECT *, {r6('count / row_total')} AS rate FROM rates")
def transition_rates(c: Campus) -> DataFrame:
    return rounded(dynamics.transition_rates(transition_counts(c)), "rate")


@query(f"{SQL_PATHS} SELECT * FROM risk")
def transition_risk(c: Campus) -> DataFrame:
    return rounded(dynamics.transition_risk(paths(c)), *_RISK_MEANS)


@query(f"{SQL_PATHS} SELECT * FROM term_clusters")
def term_cluster_counts(c: Campus) -> DataFrame:
    return dynamics.term_cluster_counts(named_terms(c))


@query(f"{SQL_PATHS} SELECT count(*) AS transitions, {r6('coalesce(avg(CASE WHEN from_cluster = to_cluster THEN 1 ELSE 0 END), 0)')} AS same_cluster_rate FROM paths")
def stay_rate(c: Campus) -> DataFrame:
    return rounded(dynamics.stay_rate(paths(c)), "same_cluster_rate")


@query(f"{SQL_PATHS} SELECT *, {r6('count / row_total')} AS rate FROM rates ORDER BY count DESC, {_PATH} LIMIT 10")
def top_transitions(c: Campus) -> DataFrame:
    return dynamics.top_transitions(transition_rates(c))


SUPPORT = 5


@query(f"{SQL_PATHS} SELECT * FROM risk WHERE transition_count >= {SUPPORT} ORDER BY next_term_risk_rate DESC NULLS LAST, {_PATH} LIMIT 10")
def top_risk_transitions(c: Campus) -> DataFrame:
    """The given vectors form about a hundred cells, so the support is lower than the default."""
    return dynamics.top_risk_transitions(transition_risk(c), least=SUPPORT)


@query(f"{SQL_PATHS} SELECT * FROM term_clusters ORDER BY school_year, semester, cluster, cluster_name LIMIT 30")
def head_term_clusters(c: Campus) -> DataFrame:
    return dynamics.head_term_clusters(term_cluster_counts(c))


# ---------------------------------------------------------------- personas

_EXCELLENT, _STEADY, _ACTIVE, _WEAK, _WARNING, _EXTREME = PERSONA_ORDER
_STRONG = "avg_score_mean DESC NULLS LAST, physical_test_score_mean DESC NULLS LAST, fail_course_count_mean NULLS LAST, cluster"
SQL_PERSONAS = f"""{SQL_EMBEDDED_TERMS},
profile AS (SELECT cluster, {_MEANS_SQL} FROM embedded_terms WHERE is_outlier = 0 GROUP BY cluster),
ends AS (SELECT *, row_number() OVER (ORDER BY {_STRONG}) = 1 AS best,
  row_number() OVER (ORDER BY avg_score_mean NULLS LAST, fail_course_count_mean DESC NULLS LAST, cluster) = 1 AS worst FROM profile),
rest AS (SELECT * FROM ends WHERE NOT best AND NOT worst),
active AS (SELECT cluster FROM rest ORDER BY next_term_risk_rate DESC NULLS LAST, internet_hours_sum_mean DESC NULLS LAST,
  physical_test_score_mean NULLS LAST, cluster LIMIT 1),
remaining AS (SELECT * FROM rest WHERE cluster NOT IN (SELECT cluster FROM active)),
weak AS (SELECT cluster FROM remaining ORDER BY physical_test_score_mean NULLS LAST, next_term_risk_rate DESC NULLS LAST, cluster LIMIT 1),
personas AS (SELECT cluster, CASE
    WHEN cluster IN (SELECT cluster FROM weak) AND (SELECT count(*) FROM remaining) > 1 THEN '{_WEAK}'
    WHEN cluster IN (SELECT cluster FROM remaining) THEN '{_STEADY}' WHEN worst THEN '{_WARNING}'
    WHEN cluster IN (SELECT cluster FROM active) THEN '{_ACTIVE}' ELSE '{_EXCELLENT}' END AS mode_name FROM ends),
named AS (SELECT e.*, CASE WHEN e.cluster = -1 THEN '{_EXTREME}' ELSE coalesce(p.mode_name, '{_STEADY}') END AS mode_name
  FROM (SELECT * REPLACE (CASE WHEN is_outlier = 1 THEN -1 ELSE cluster END AS cluster) FROM embedded_terms) e
  LEFT JOIN personas p ON e.cluster = p.cluster)"""


def persona_terms(c: Campus) -> DataFrame:
    outlier = F.when(F.col("is_outlier") == 1, clusters.OUTLIER).otherwise(F.col("cluster"))
    return c.embedded_terms.withColumn("cluster", outlier)


def chosen(c: Campus) -> DataFrame:
    return personas.choose_personas(inlier_profile(c))


@query(f"{SQL_PERSONAS} SELECT cluster, mode_name FROM personas")
def choose_personas(c: Campus) -> DataFrame:
    return chosen(c)


@query(f"{SQL_PERSONAS} SELECT cluster, mode_name FROM personas UNION ALL SELECT -1, '{_EXTREME}'")
def persona_labels(c: Campus) -> DataFrame:
    return personas.persona_labels(chosen(c))


@query(f"{SQL_PERSONAS} SELECT DISTINCT cluster FROM named WHERE cluster NOT IN (SELECT cluster FROM personas)")
def unassigned_clusters(c: Campus) -> DataFrame:
    return personas.unassigned_clusters(persona_terms(c), chosen(c))


@query(f"{SQL_PERSONAS} SELECT vec_id, cluster, mode_name FROM named")
def apply_personas(c: Campus) -> DataFrame:
    return personas.apply_personas(persona_terms(c), chosen(c)).select("vec_id", "cluster", "mode_name")


@query(f"{SQL_PERSONAS} SELECT mode_name, count(*) AS student_count, {_MEANS_SQL} FROM named GROUP BY mode_name")
def persona_summary(c: Campus) -> DataFrame:
    return rounded(personas.persona_summary(personas.apply_personas(persona_terms(c), chosen(c))), *MEANS)


#: Modes wanted first; others follow by name.
MODES = ("excellent", "click", "view")


@query("""WITH counts AS (SELECT event_type AS mode_name, count(*) AS student_count FROM events GROUP BY event_type)
SELECT mode_name, student_count FROM counts
ORDER BY CASE mode_name WHEN 'excellent' THEN 0 WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 999 END, mode_name LIMIT 3""")
def order_by_list(c: Campus) -> DataFrame:
    """The first three of a list order: the listed ones that occur, then others by name."""
    counts = c.table("events").groupBy(F.col("event_type").alias("mode_name")).agg(F.count("*").alias("student_count"))
    return personas.order_by_list(counts, "mode_name", MODES).limit(3)
