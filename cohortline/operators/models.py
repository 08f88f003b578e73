"""Risk models as Spark ML jobs: feature sets, preprocessing, training, scoring, comparison."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler, VectorSizeHint
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.functions import fill_unknown, map_code
from cohortline.functions.codes import GENDER_CODES, SEMESTER_CODES
from cohortline.operators.boosting import Boosting, fit_boosting
from cohortline.operators.clusters import OUTLIER
from cohortline.operators.features import column_medians, labelled_only, mean_std
from cohortline.operators.forests import Forest, fit_forest
from cohortline.operators.metrics import evaluate
from cohortline.operators.vectors import VectorScale, fit_scale, scale_vectors
from cohortline.session import cut_lineage
from cohortline.sources.schemas import CATEGORICAL_FEATURES, ID_COLUMNS, LABEL, NUMERIC_FEATURES

# Model settings of the compared runs.
LOGISTIC_ITERATIONS = 3000
FOREST_TREES, FOREST_LEAF, GRID_TREES = 400, 2, 500
BOOST_ROUNDS, BOOST_STEP, BOOST_COLUMNS = 500, 0.05, 0.8
TOP_FEATURES = 100
NO_CLUSTER = "NO_CLUSTER"


# ---------------------------------------------------------------- feature sources


def with_embeddings(
    df: DataFrame, embeddings: DataFrame, keys: Sequence[str] = ID_COLUMNS, vector: str = "embedding", zero_dims: int | None = None
) -> DataFrame:
    """Left join on the term keys; with ``zero_dims`` a missing vector becomes zeros, else it stays NULL."""
    joined = df.join(embeddings.select(*keys, vector), list(keys), "left")
    if zero_dims is None:
        return joined
    zeros = F.array_repeat(F.lit(0.0).cast("float"), zero_dims)
    return joined.withColumn(vector, F.coalesce(vector, zeros))


def cluster_source(assigned: DataFrame, keys: Sequence[str] = ID_COLUMNS) -> DataFrame:
    """Cluster columns of an assignment table; ids without a name table are named after their number."""
    if "cluster_name" in assigned.columns:
        name = fill_unknown(F.col("cluster_name"))
    else:
        numbered = F.concat(F.lit("Cluster_"), F.col("cluster").cast("string"))
        name = F.when(F.col("cluster") == OUTLIER, "Outlier").otherwise(numbered)
    return assigned.select(
        *keys,
        "cluster",
        name.alias("cluster_name"),
        F.coalesce("is_outlier", F.lit(0)).alias("is_outlier"),
        F.col("embedding_distance_to_center").cast("double").alias("embedding_distance_to_center"),
    )


def with_clusters(df: DataFrame, clusters: DataFrame, keys: Sequence[str] = ID_COLUMNS) -> DataFrame:
    return df.join(clusters, list(keys), "left").withColumns(
        {
            "cluster_name": F.coalesce("cluster_name", F.lit(NO_CLUSTER)),
            "is_outlier": F.coalesce("is_outlier", F.lit(0)),
        }
    )


def concat_columns(left: DataFrame, right: DataFrame, keys: Sequence[str] = ID_COLUMNS) -> DataFrame:
    """Columns of two tables side by side, matched by key."""
    added = [c for c in right.columns if c not in left.columns]
    return left.join(right.select(*keys, *added), list(keys))


def coded_categories(df: DataFrame) -> DataFrame:
    """Gender and semester as 0/1 numbers."""
    return df.withColumns(
        {
            "gender_encoded": map_code(F.col("gender"), GENDER_CODES),
            "semester_encoded": map_code(F.col("semester"), SEMESTER_CODES),
        }
    )


# ---------------------------------------------------------------- preprocessing


@dataclass(frozen=True)
class Preprocessor:
    """Fitted medians, scales and category lists; all of it is bounded by the number of columns and categories."""

    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    vector: str | None
    medians: Mapping[str, float]
    means: Mapping[str, float]
    stds: Mapping[str, float]
    scale: VectorScale | None
    encoder: PipelineModel
    names: tuple[str, ...]

    def transform(self, df: DataFrame, alias: str = "features") -> DataFrame:
        """Rows with one feature vector; values of a category not seen in fitting become all zeros."""
        rows = _filled(df, self.numeric, self.categorical, self.medians)
        scaled = {c: (F.col(f"_n_{c}") - self.means[c]) / (self.stds[c] or 1.0) for c in self.numeric}
        rows = rows.withColumns({f"_n_{c}": value for c, value in scaled.items()})
        if self.vector:
            rows = scale_vectors(rows, self.scale, self.vector, "_scaled").withColumn(
                "_vector", array_to_vector("_scaled")
            )
        return self.encoder.transform(rows).select(*df.columns, F.col("_features").alias(alias))


def _filled(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], medians: Mapping[str, float]) -> DataFrame:
    numbers = {f"_n_{c}": F.coalesce(F.col(c).cast("double"), F.lit(float(medians[c]))) for c in numeric}
    return df.withColumns(numbers | {f"_c_{c}": fill_unknown(F.col(c)) for c in categorical})


def fit_preprocessor(
    train: DataFrame,
    numeric: Sequence[str] = NUMERIC_FEATURES,
    categorical: Sequence[str] = CATEGORICAL_FEATURES,
    vector: str | None = None,
) -> Preprocessor:
    """Numbers: exact median, then standardised by population deviation. Categories: one-hot in text order.

    A column without any value has no median and is filled with 0.
    """
    medians = {c: 0.0 for c in numeric}
    means, stds = dict(medians), dict(medians)
    if numeric:
        medians |= {r["feature"]: r["median"] or 0.0 for r in column_medians(train, numeric).collect()}
    rows = _filled(train, numeric, categorical, medians)
    if numeric:
        for r in mean_std(rows, [f"_n_{c}" for c in numeric]).collect():
            name = r["feature"].removeprefix("_n_")
            means[name], stds[name] = r["mean"], r["std"]
    scale = fit_scale(train, vector) if vector else None
    parts = [f"_n_{c}" for c in numeric]
    stages = []
    if vector:
        stages.append(VectorSizeHint(inputCol="_vector", size=len(scale.mean)))
        parts.append("_vector")
        rows = scale_vectors(rows, scale, vector, "_scaled").withColumn("_vector", array_to_vector("_scaled"))
    if categorical:
        stages += [
            StringIndexer(
                inputCols=[f"_c_{c}" for c in categorical],
                outputCols=[f"_i_{c}" for c in categorical],
                handleInvalid="keep",
                stringOrderType="alphabetAsc",
            ),
            OneHotEncoder(
                inputCols=[f"_i_{c}" for c in categorical], outputCols=[f"_o_{c}" for c in categorical], dropLast=True
            ),
        ]
        parts += [f"_o_{c}" for c in categorical]
    stages.append(VectorAssembler(inputCols=parts, outputCol="_features"))
    encoder = Pipeline(stages=stages).fit(rows)

    names = [f"num__{c}" for c in numeric]
    if vector:
        names += [f"num__{vector}_{i:02d}" for i in range(len(scale.mean))]
    if categorical:
        indexer = next(s for s in encoder.stages if hasattr(s, "labelsArray"))
        for c, labels in zip(categorical, indexer.labelsArray, strict=True):
            names += [f"cat__{c}_{value}" for value in labels]
    return Preprocessor(
        tuple(numeric), tuple(categorical), vector, medians, means, stds, scale, encoder, tuple(names)
    )


# ---------------------------------------------------------------- training and scoring


def with_class_weight(train: DataFrame, label: str = LABEL, alias: str = "class_weight") -> DataFrame:
    """Balanced weights n / (2 * n_class), from one count of the two classes."""
    counts = {r[label]: r["count"] for r in train.groupBy(label).count().collect()}
    total = sum(counts.values())
    weight: Column = F.lit(None).cast("double")
    for value, count in counts.items():
        weight = F.when(F.col(label) == value, total / (len(counts) * count)).otherwise(weight)
    return train.withColumn(alias, weight)


def logistic_regression(train: DataFrame, label: str = LABEL, max_iter: int = LOGISTIC_ITERATIONS) -> Model:
    """L2 penalty of strength one on the summed loss: Spark averages the loss, hence 1 / sum of weights."""
    weighted = with_class_weight(train, label)
    return LogisticRegression(
        labelCol=label,
        weightCol="class_weight",
        regParam=1.0 / max(train.count(), 1),
        elasticNetParam=0.0,
        standardization=False,
        maxIter=max_iter,
    ).fit(weighted)


def random_forest(train: DataFrame, label: str = LABEL, trees: int = FOREST_TREES, min_leaf: int = FOREST_LEAF, seed: int = 42) -> Forest:
    """Trees grown to purity; classes balanced within every bootstrap."""
    return fit_forest(train, label, trees, min_leaf, seed=seed)


def boosted_trees(train: DataFrame, label: str = LABEL, rounds: int = BOOST_ROUNDS, step: float = BOOST_STEP, seed: int = 42) -> Boosting:
    """Trees of up to 31 leaves, the leaf of the largest gain split first."""
    return fit_boosting(train, label, rounds, step, column_share=BOOST_COLUMNS, seed=seed)


def score(model: Model, df: DataFrame, ids: Sequence[str] = ID_COLUMNS, label: str = LABEL) -> DataFrame:
    probability = vector_to_array("probability")[1]
    return model.transform(df).select(
        *ids,
        F.col(label).alias("label"),
        F.col("prediction").cast("int").alias("pred_label"),
        probability.alias("pred_proba"),
    )


def top_features(model: Model, preprocessor: Preprocessor, train: DataFrame, limit: int = TOP_FEATURES) -> DataFrame:
    """Largest importance, or absolute coefficient; one number per feature, so the list is small."""
    values = model.featureImportances if hasattr(model, "featureImportances") else model.coefficients
    rows = [(n, float(v)) for n, v in zip(preprocessor.names, np.abs(values.toArray()), strict=True)]
    table = train.sparkSession.createDataFrame(rows, "feature string, importance double")
    return table.orderBy(F.col("importance").desc(), "feature").limit(limit)


@dataclass(frozen=True)
class FeatureSet:
    numeric: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    vector: str | None = None


# The compared feature sets.
CLUSTER_NUMERIC, CLUSTER_CATEGORICAL = ("is_outlier", "embedding_distance_to_center"), ("cluster_name",)
FEATURE_SETS = {
    "baseline_only": FeatureSet(NUMERIC_FEATURES, CATEGORICAL_FEATURES),
    "embedding_only": FeatureSet(CLUSTER_NUMERIC, CLUSTER_CATEGORICAL, "embedding"),
    "baseline_plus_embedding": FeatureSet(
        NUMERIC_FEATURES + CLUSTER_NUMERIC, CATEGORICAL_FEATURES + CLUSTER_CATEGORICAL, "embedding"
    ),
}
MODELS: dict[str, Callable[[DataFrame, str], Model | Forest | Boosting]] = {
    "logistic_regression": logistic_regression,
    "random_forest": partial(random_forest, trees=GRID_TREES),
}


def grid_predictions(
    train: DataFrame,
    test: DataFrame,
    feature_sets: Mapping[str, FeatureSet] = FEATURE_SETS,
    models: Mapping[str, Callable[[DataFrame, str], Model | Forest | Boosting]] = MODELS,
    label: str = LABEL,
) -> DataFrame:
    """Scored test rows of every feature set with every model, as one table."""
    scored: DataFrame | None = None
    for set_name, features in feature_sets.items():
        prepared = fit_preprocessor(train, features.numeric, features.categorical, features.vector)
        ready = prepared.transform(train).select("features", label).persist()
        rows = prepared.transform(test)
        for model_name, fit in models.items():
            part = score(fit(ready, label), rows, label=label).select(
                F.lit(set_name).alias("feature_set"), F.lit(model_name).alias("model"), "*"
            )
            scored = part if scored is None else scored.unionByName(part)
        ready.unpersist()
    assert scored is not None, "at least one feature set and one model"
    return scored


# ---------------------------------------------------------------- the compared runs

# Settings and target of the baseline run and of the comparison.
BASELINE_ITERATIONS, COMPARED_ITERATIONS, COMPARED_TREES, COMPARED_LEAF, TARGET_AUC = 2000, 1000, 100, 1, 0.80
RAW_NUMERIC = tuple(c for c in NUMERIC_FEATURES if not c.startswith("bmi_"))
RAW_CODES = ("gender_encoded", "semester_encoded")

Fit = Callable[[DataFrame, str], Model | Forest | Boosting]


@dataclass(frozen=True)
class Run:
    """One model on one feature set."""

    features: FeatureSet
    fit: Fit


BASELINE_RUNS = {
    "logistic_regression": Run(FEATURE_SETS["baseline_only"], partial(logistic_regression, max_iter=BASELINE_ITERATIONS)),
    "random_forest": Run(FEATURE_SETS["baseline_only"], random_forest),
    "boosted_trees": Run(FEATURE_SETS["baseline_only"], boosted_trees),
}


def _compared_forest(train: DataFrame, label: str = LABEL, trees: int = COMPARED_TREES) -> Forest:
    return fit_forest(train, label, trees, COMPARED_LEAF, whole=True)


_RAW, _VECTOR, _BOTH = FeatureSet(RAW_NUMERIC + RAW_CODES), FeatureSet(vector="embedding"), FeatureSet(RAW_NUMERIC + RAW_CODES, vector="embedding")
_compared_regression = partial(logistic_regression, max_iter=COMPARED_ITERATIONS)
COMPARED_RUNS = {
    "raw_random_forest": Run(_RAW, _compared_forest),
    "raw_logistic_regression": Run(_RAW, _compared_regression),
    "embedding_random_forest": Run(_VECTOR, _compared_forest),
    "embedding_logistic_regression": Run(_VECTOR, _compared_regression),
    "combined_random_forest": Run(_BOTH, _compared_forest),
}


def run_models(
    train: DataFrame, test: DataFrame, runs: Mapping[str, Run], label: str = LABEL, top: int = TOP_FEATURES
) -> tuple[DataFrame, DataFrame]:
    """Scored test rows and the ``top`` features of every run, each with the column ``model``.

    Each feature set is prepared once, and its training rows are written once, however many runs share it.
    """
    scored, important = [], []
    for features in dict.fromkeys(run.features for run in runs.values()):
        prepared = fit_preprocessor(train, features.numeric, features.categorical, features.vector)
        ready = cut_lineage(prepared.transform(train).select("features", label))
        rows = prepared.transform(test)
        for name, run in runs.items():
            if run.features == features:
                model = run.fit(ready, label)
                scored.append(score(model, rows, label=label).select(F.lit(name).alias("model"), "*"))
                important.append(top_features(model, prepared, train, top).select(F.lit(name).alias("model"), "*"))
    return reduce(DataFrame.unionByName, scored), reduce(DataFrame.unionByName, important)


def comparison_rows(base: DataFrame, embeddings: DataFrame, dims: int, label: str = LABEL) -> DataFrame:
    """Labelled rows with coded categories and zeros for a missing vector; numbers filled with the median of all of them."""
    rows = cut_lineage(coded_categories(labelled_only(base, label)))
    medians = {r["feature"]: r["median"] or 0.0 for r in column_medians(rows, RAW_NUMERIC).collect()}
    filled = rows.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(float(medians[c]))) for c in RAW_NUMERIC})
    return with_embeddings(filled, embeddings, zero_dims=dims).select(*ID_COLUMNS, *RAW_NUMERIC, *RAW_CODES, "embedding", label)


def model_grid(train: DataFrame, test: DataFrame, **options) -> DataFrame:
    """Metrics of the whole grid, from one evaluation over all scored rows."""
    return evaluate(grid_predictions(train, test, **options), by=["feature_set", "model"])
