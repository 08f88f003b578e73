"""Feature sources, metrics of scored rows, and the models."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.operators import clusters, embedding, features, metrics, models, vectors
from cohortline.operators.models import FEATURE_SETS
from cohortline.plans import jobs
from cohortline.session import cut_lineage
from cohortline.sources.schemas import CATEGORICAL_FEATURES, ID_COLUMNS, LABEL, NUMERIC_FEATURES
from cohortline.workload.campus import DIMS, SPLIT_YEARS, SQL_BASE, SQL_EMBEDDED_TERMS, SQL_SCORED, Campus, r, r6
from cohortline.workload.preparation import SQL_FEATURES, feature_rows, rounded
from cohortline.workload.registry import query

TERM_KEYS = ["student_id", "school_year", "semester"]
SQL_BOTH = f"{SQL_BASE}, {SQL_EMBEDDED_TERMS.removeprefix('WITH ')}"
_ON = "b.student_id = e.student_id AND b.school_year = e.school_year AND b.semester = e.semester"


# ---------------------------------------------------------------- feature sources


@query(f"""{SQL_BOTH}
SELECT b.student_id, b.school_year, b.semester, coalesce(e.embedding[1], CAST(0 AS FLOAT)) AS first_value, e.embedding IS NULL AS filled
FROM base b LEFT JOIN embedded_terms e ON {_ON}""")
def with_embeddings(c: Campus) -> DataFrame:
    joined = models.with_embeddings(c.base.select(*TERM_KEYS), c.embedded_terms, TERM_KEYS, zero_dims=DIMS)
    first, last = F.col("embedding")[0], F.col("embedding")[DIMS - 1]
    return joined.select(*TERM_KEYS, first.alias("first_value"), ((first == 0) & (last == 0)).alias("filled"))


@query(f"""{SQL_BOTH}
SELECT b.student_id, b.school_year, b.semester, e.cluster,
  CASE WHEN e.cluster IS NULL THEN 'NO_CLUSTER' WHEN e.cluster = -1 THEN 'Outlier' ELSE concat('Cluster_', e.cluster) END AS cluster_name,
  coalesce(e.is_outlier, 0) AS is_outlier, {r("e.avg_score / 8", 6)} AS embedding_distance_to_center
FROM base b LEFT JOIN (SELECT * REPLACE (CASE WHEN cluster = 9 THEN -1 ELSE cluster END AS cluster) FROM embedded_terms) e ON {_ON}""")
def with_clusters(c: Campus) -> DataFrame:
    assigned = c.embedded_terms.select(
        *TERM_KEYS,
        F.when(F.col("cluster") == 9, -1).otherwise(F.col("cluster")).alias("cluster"),
        "is_outlier",
        (F.col("avg_score") / 8).alias("embedding_distance_to_center"),
    )
    joined = models.with_clusters(c.base.select(*TERM_KEYS), models.cluster_source(assigned, TERM_KEYS), TERM_KEYS)
    return rounded(joined, "embedding_distance_to_center", shift=0.0)


@query(f"""{SQL_BOTH}
SELECT b.student_id, b.school_year, b.semester, b.avg_score, b.avg_gpa, e.vec_id FROM base b JOIN embedded_terms e ON {_ON}""")
def concat_columns(c: Campus) -> DataFrame:
    left = c.base.select(*TERM_KEYS, "avg_score", "avg_gpa")
    return models.concat_columns(left, c.embedded_terms.select(*TERM_KEYS, "vec_id"), TERM_KEYS)


@query(f"""{SQL_BASE} SELECT student_id, school_year, semester, CASE gender WHEN '女' THEN 1 ELSE 0 END AS gender_encoded,
  CASE semester WHEN '2' THEN 1 ELSE 0 END AS semester_encoded FROM base""")
def coded_categories(c: Campus) -> DataFrame:
    return models.coded_categories(c.base).select(*TERM_KEYS, "gender_encoded", "semester_encoded")


# ---------------------------------------------------------------- metrics

SQL_DOCUMENTS = """WITH scored AS (
  SELECT CAST(quality AS INTEGER) AS label, n_chars / (n_chars + 1000)::DOUBLE AS pred_proba FROM labels JOIN documents USING (doc_id))"""


@query(f"{SQL_DOCUMENTS} SELECT count(label) AS n, CAST(sum(label) AS BIGINT) AS positives, {r('avg(label)', 6)} AS positive_rate FROM scored")
def label_balance(c: Campus) -> DataFrame:
    return rounded(metrics.label_balance(c.scored_documents), "positive_rate", shift=0.0)


_CELLS = """count(*) FILTER (WHERE label = 0 AND pred_proba < 0.5) AS tn, count(*) FILTER (WHERE label = 0 AND pred_proba >= 0.5) AS fp,
  count(*) FILTER (WHERE label = 1 AND pred_proba < 0.5) AS fn, count(*) FILTER (WHERE label = 1 AND pred_proba >= 0.5) AS tp"""
SQL_CELLS = f"cells AS (SELECT model, {_CELLS} FROM scored GROUP BY model)"


def _share(part: str, whole: str) -> str:
    return r(f"coalesce(({part}) / nullif(CAST({whole} AS DOUBLE), 0), 0)", 6)


_RATES = f"""{_share("tp + tn", "tn + fp + fn + tp")} AS accuracy, {_share("tp", "tp + fp")} AS precision,
  {_share("tp", "tp + fn")} AS recall, {_share("2 * tp", "2 * tp + fp + fn")} AS f1"""


@query(f"{SQL_SCORED}, {SQL_CELLS} SELECT * FROM cells")
def confusion_matrix(c: Campus) -> DataFrame:
    return metrics.confusion_matrix(c.scored, by=["model"])


@query(f"{SQL_SCORED}, {SQL_CELLS} SELECT *, {_RATES} FROM cells")
def class_metrics(c: Campus) -> DataFrame:
    return metrics.class_metrics(metrics.confusion_matrix(c.scored, by=["model"]))


def _sql_curve(by: str) -> str:
    """Step curve by score, and the two areas, per group."""
    part = f"PARTITION BY {by} " if by else ""
    comma = f"{by}, " if by else ""
    return f"""curve AS (
  SELECT {comma}pred_proba, count(*) AS n, count(*) FILTER (WHERE label = 1) AS p FROM scored GROUP BY {comma}pred_proba),
running AS (
  SELECT *, sum(n) OVER w AS n_upto, sum(p) OVER w AS p_upto FROM curve
  WINDOW w AS ({part}ORDER BY pred_proba DESC ROWS UNBOUNDED PRECEDING)),
areas AS (
  SELECT {comma}CAST(sum(n) AS BIGINT) AS test_rows, CAST(sum(p) AS BIGINT) AS positive_rows,
    CAST(0 AS BIGINT) AS unscored_rows,
    {r("sum((n - p) * (p_upto - p / 2.0::DOUBLE)) / (CAST(sum(p) AS DOUBLE) * sum(n - p))", 6)} AS roc_auc,
    {r("sum(p * CAST(p_upto AS DOUBLE) / n_upto) / sum(p)", 6)} AS pr_auc
  FROM running {f"GROUP BY {by}" if by else ""})"""


@query(f"{SQL_DOCUMENTS}, {_sql_curve('')} SELECT roc_auc FROM areas")
def roc_auc(c: Campus) -> DataFrame:
    return rounded(metrics.roc_auc(metrics.score_curve(c.scored_documents)), "roc_auc", shift=0.0)


@query(f"{SQL_DOCUMENTS}, {_sql_curve('')} SELECT pr_auc FROM areas")
def average_precision(c: Campus) -> DataFrame:
    return rounded(metrics.average_precision(metrics.score_curve(c.scored_documents)), "pr_auc", shift=0.0)


SQL_EVALUATED = f"""{SQL_SCORED}, {SQL_CELLS}, {_sql_curve("model")},
evaluated AS (SELECT model, test_rows, positive_rows, unscored_rows, {_RATES}, roc_auc, pr_auc, tn, fp, fn, tp FROM areas JOIN cells USING (model))"""


@query(f"{SQL_EVALUATED} SELECT * FROM evaluated")
def evaluate(c: Campus) -> DataFrame:
    return metrics.evaluate(c.scored, by=["model"])


@query(f"""{SQL_EVALUATED}, ranked AS (SELECT model, roc_auc, CAST(row_number() OVER (ORDER BY roc_auc DESC, model) AS INTEGER) AS rank FROM evaluated)
SELECT *, concat(CASE WHEN roc_auc >= 0.5 THEN 'OK' ELSE 'WARN' END, CASE WHEN rank = 1 THEN ' BEST' ELSE '' END) AS status FROM ranked""")
def rank_models(c: Campus) -> DataFrame:
    table = metrics.evaluate(c.scored, by=["model"]).select("model", "roc_auc")
    return metrics.rank_models(table, "roc_auc", ["model"], target=0.5)


# ---------------------------------------------------------------- models (rows only)


def labelled_split(c: Campus) -> tuple[DataFrame, DataFrame]:
    """Train and test years of the labelled rows, written once so that fits do not rebuild the table."""
    rows = features.labelled_only(feature_rows(c))
    split = cut_lineage(features.year_split(rows, SPLIT_YEARS))
    return split.where(F.col("split") == "train"), split.where(F.col("split") == "test")


def trained(c: Campus, fit) -> tuple:
    train, test = labelled_split(c)
    prepared = models.fit_preprocessor(train)
    ready = prepared.transform(train).select("features", LABEL).persist()
    return fit(ready, LABEL), prepared, train, test


def _sql_number(c: str) -> str:
    filled = f"coalesce(CAST({c} AS DOUBLE), (SELECT coalesce(median({c}), 0) FROM train))"
    fitted = f"SELECT {{}}(x) FROM (SELECT {filled} AS x FROM train)"
    scaled = f"({filled} - ({fitted.format('avg')})) / coalesce(nullif(({fitted.format('stddev_pop')}), 0), 1)"
    return f"SELECT {', '.join(ID_COLUMNS)}, 'num__{c}' AS feature, {r6(scaled)} AS value FROM test"


def _sql_category(c: str) -> str:
    known = f"coalesce(nullif(CAST({c} AS VARCHAR), ''), 'UNKNOWN')"
    return (
        f"SELECT {', '.join(ID_COLUMNS)}, 'cat__{c}_' || {known} AS feature, CAST(1 AS DOUBLE) AS value FROM test "
        f"WHERE {known} IN (SELECT {known} FROM train)"
    )


_SQL_PREPARED = " UNION ALL ".join([*map(_sql_number, NUMERIC_FEATURES), *map(_sql_category, CATEGORICAL_FEATURES)])


@query(f"""{SQL_FEATURES},
train AS (SELECT * FROM split WHERE split = 'train' AND {LABEL} IS NOT NULL), test AS (SELECT * FROM split WHERE split = 'test' AND {LABEL} IS NOT NULL)
{_SQL_PREPARED}""")
def preprocessor(c: Campus) -> DataFrame:
    """The feature vector of every test row by name: all numbers, and the categories that the row has."""
    train, test = labelled_split(c)
    prepared = models.fit_preprocessor(train)
    values = vector_to_array("features")
    named = F.arrays_zip(F.array(*map(F.lit, prepared.names)).alias("feature"), values.alias("value"))
    rows = prepared.transform(test).select(*ID_COLUMNS, F.explode(named).alias("f")).select(*ID_COLUMNS, "f.feature", "f.value")
    return rounded(rows.where((F.col("value") != 0) | F.startswith("feature", F.lit("num__"))), "value")


def _scored(c: Campus, fit) -> DataFrame:
    model, prepared, _, test = trained(c, fit)
    return models.score(model, prepared.transform(test))


SQL_TEST_ROWS = f"SELECT {', '.join(ID_COLUMNS)}, CAST(risk_label_next_term AS INTEGER) AS label FROM split WHERE split = 'test' AND risk_label_next_term IS NOT NULL"


@query(f"{SQL_FEATURES}, tested AS ({SQL_TEST_ROWS}) SELECT *, true AS decided_by_half, true AS probability FROM tested")
def score(c: Campus) -> DataFrame:
    """Every test row once, with its label, and whether decision and score fit together."""
    proba = F.col("pred_proba")
    return _scored(c, models.logistic_regression).select(
        *ID_COLUMNS,
        "label",
        (F.col("pred_label") == (proba > 0.5).cast("int")).alias("decided_by_half"),
        ((proba >= 0) & (proba <= 1)).alias("probability"),
    )


@query()
def baseline_run(c: Campus) -> DataFrame:
    return jobs.baseline_tables(c.base_table, SPLIT_YEARS)["metrics"]


@query()
def model_comparison(c: Campus) -> DataFrame:
    """The embedding is fitted without labels on all terms; then five models compete."""
    rows = features.select_features(features.typed_features(c.base_table))
    vectors = embedding.embed_rows(rows, models.fit_preprocessor(rows), dims=16).select(*ID_COLUMNS, "embedding")
    return jobs.compare_tables(c.base_table, vectors, 16)["ranking"]


@query()
def logistic_regression(c: Campus) -> DataFrame:
    return _scored(c, models.logistic_regression)


@query()
def random_forest(c: Campus) -> DataFrame:
    return _scored(c, models.random_forest)


@query()
def boosted_trees(c: Campus) -> DataFrame:
    return _scored(c, models.boosted_trees)


@query()
def top_features(c: Campus) -> DataFrame:
    model, prepared, train, _ = trained(c, models.logistic_regression)
    return rounded(models.top_features(model, prepared, train), "importance", shift=0.0)


@query()
def embed_rows(c: Campus) -> DataFrame:
    train, test = labelled_split(c)
    embedded = embedding.fit_embedding(train, models.fit_preprocessor(train), dims=16).transform(test)
    return embedded.select(*ID_COLUMNS, F.to_json("embedding").alias("embedding"))


@query()
def model_grid(c: Campus) -> DataFrame:
    """Embed all rows, group the last terms, place every term, then compare feature sets and models."""
    train, test = labelled_split(c)
    embedded = cut_lineage(embedding.embed_rows(train.unionByName(test), models.fit_preprocessor(train), dims=16))
    last = features.last_term(embedded)
    flagged = clusters.outlier_flag(vectors.scale_vectors(last, vectors.fit_scale(last)), "embedding_scaled")
    search = clusters.choose_k(clusters.inliers(flagged), "student_id")
    threshold = flagged.agg(F.max("outlier_distance_threshold")).first()[0]
    placed = clusters.assign_semesters(embedded, search.labelled, threshold)
    wide = models.with_clusters(embedded, models.cluster_source(placed))
    rows = cut_lineage(wide)
    return models.model_grid(
        rows.where(F.col("split") == "train"),
        rows.where(F.col("split") == "test"),
        feature_sets=FEATURE_SETS,
    )
