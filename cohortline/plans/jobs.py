"""The jobs. Each takes DataFrames and returns DataFrames; only ``run_*`` functions write tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortline.operators import clusters, dynamics, embedding, facts, features, identity, metrics, models, personas
from cohortline.operators.identity import Source
from cohortline.operators.vectors import fit_scale, scale_vectors
from cohortline.session import cut_lineage
from cohortline.sources.reports import build_report
from cohortline.sources.schemas import FLAG, ID_COLUMNS, LABEL, SEMESTER_BASE
from cohortline.sources.tables import ORDINAL, write_table


# ---------------------------------------------------------------- identity


def _own_names(columns: Sequence[str]) -> dict[str, str]:
    return {c: c for c in columns}


ORG = ("XB", "NJ", "YX", "ZY", "BJ", "BH")
# Which source offers which master field, in order of priority.
MASTER_SOURCES = (
    ("student_basic", "XH", _own_names(("XB", "MZMC", "ZZMMMC", "CSRQ", "JG", "XSM", "ZYM"))),
    ("student_fitness", "XH", _own_names(("XM", *ORG))),
    ("physical_test", "XH", _own_names(ORG)),
    ("pe_class", "XH", _own_names(ORG)),
    ("daily_exercise", "XH", _own_names(ORG)),
    ("graduation", "SID", {"GRADE": "GRADE", "BJ": "BJMC", "BYQXMC": "BYQXMC"}),
)
PROFILE_SOURCES = (
    ("student_basic", "XH", _own_names(("XB", "XSM", "ZYM"))),
    ("physical_test", "XH", _own_names(("XB", "NJ", "YX", "ZY", "BJ"))),
    ("online_learning", "LOGIN_NAME", {"YX": "DEPARTMENT_NAME", "ZY": "MAJOR_NAME", "BJ": "CLASS_NAME"}),
)


def sources_of(raw: Mapping[str, DataFrame], layout: Sequence[tuple[str, str, dict[str, str]]]) -> list[Source]:
    """Master sources from raw tables; online-learning rows count only for the student role."""
    out = []
    for name, key, fields in layout:
        df = facts.role_filter(raw[name]) if name == "online_learning" else raw[name]
        out.append(Source(name, df, key, ORDINAL, fields))
    return out


def identity_tables(raw: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Master, accounts and bridge from the raw tables (each with an ordinal column).

    The master is met five times and the accounts twice, so both are written once before the bridge.
    """
    master = cut_lineage(identity.student_master(sources_of(raw, MASTER_SOURCES)))
    found = identity.account_master(raw["online_learning"], "online_learning")
    accounts = cut_lineage(identity.resolve_accounts(found, master))
    bridge = identity.key_bridge(
        identity.identity_bridge(master),
        identity.filtered_bridge(raw["competition"], master, "competition", "XHHGH"),
        identity.account_bridge(facts.role_filter(raw["online_learning"]), accounts, "online_learning", "LOGIN_NAME"),
    )
    return {
        "student_master": master,
        "account_master": accounts,
        "key_bridge": bridge,
        "bridge_summary": identity.bridge_summary(bridge),
    }


# ---------------------------------------------------------------- semester base


def semester_base(
    course: DataFrame,
    score: DataFrame,
    usage: DataFrame,
    status: DataFrame,
    card: DataFrame,
    rules: str = facts.STRICT,
    calendar: bool = False,
) -> DataFrame:
    """One row per student and term, 29 columns, labelled with the next term's risk flag.

    Known students only is a condition on the group key, so it is applied after aggregating, by the
    same inner join that brings the student's card; the lenient rules keep unknown students.
    """
    rows = facts.term_rows(course, score, usage, status, rules)
    joined = rows.join(card, "student_id", "inner" if rules == facts.STRICT else "left")
    of_year = F.try_element_at(F.col("fitness"), F.col("school_year"))
    placed = facts.with_term_order(joined, rules).withColumns(
        {
            "physical_test_score": of_year["physical_test_score"],
            "physical_test_bmi": of_year["physical_test_bmi"],
        }
    )
    labelled = facts.next_term_label(placed, FLAG, LABEL, calendar)
    return labelled.select(*SEMESTER_BASE.fieldNames())


def semester_base_of(raw: Mapping[str, DataFrame], rules: str = facts.STRICT) -> DataFrame:
    """The same from raw text tables."""
    profile = identity.profile_columns(identity.merge_profiles(sources_of(raw, PROFILE_SOURCES)))
    snapshot = facts.first_snapshot(facts.role_filter(raw["online_learning"]), "LOGIN_NAME", "BFB", ORDINAL)
    yearly = facts.fitness_by_year(facts.fitness_facts(raw["physical_test"]))
    return semester_base(
        facts.course_facts(raw["course_select"]),
        facts.score_facts(raw["student_score"]),
        facts.usage_facts(raw["internet_stats"]),
        facts.status_facts(raw["status_change"]),
        facts.student_card(profile, snapshot, yearly),
        rules,
    )


def run_semester_base(raw: Mapping[str, DataFrame], path: str) -> DataFrame:
    """Build, write by school year (later splits read only their years) and report."""
    base = semester_base_of(raw)
    write_table(base, path, partition_by=["school_year"], sort_by=["student_id", "term_order"])
    return build_report(base.sparkSession.read.schema(SEMESTER_BASE).parquet(path))


# ---------------------------------------------------------------- features, clusters, dynamics, risk


def feature_tables(
    base: DataFrame,
    pool_years: Sequence[str] = features.POOL_YEARS,
    years: Mapping[str, Sequence[str]] = features.SPLIT_YEARS,
) -> dict[str, DataFrame]:
    """Pool, labelled splits, last terms, and the encoding fitted once on the pool."""
    rows = features.select_features(features.typed_features(base))
    pool = features.pool(rows, pool_years)
    medians = features.column_medians(pool)
    codes = features.category_codes(pool)
    last = features.last_term(rows)
    return {
        "pool": pool,
        "splits": features.year_split(features.labelled_only(rows), years),
        "last_semester": last,
        "medians": medians,
        "codes": codes,
        "encoded_pool": features.encode_features(pool, medians, codes),
        "encoded_last": features.encode_features(last, medians, codes),
    }


def cluster_tables(last: DataFrame, key: str = "student_id", vector: str = "embedding", **search) -> dict[str, DataFrame]:
    """Scale, cut outliers, search k on the rest, profile. ``last`` has one embedded row per student.

    The search reads its rows dozens of times and the result feeds six tables: both are written once.
    """
    scaled = scale_vectors(last, fit_scale(last, vector), vector)
    flagged = cut_lineage(clusters.outlier_flag(scaled, "embedding_scaled"))
    found = clusters.choose_k(clusters.inliers(flagged), key, **search)
    outliers = flagged.where(F.col("is_outlier") == 1).withColumn("cluster", F.lit(clusters.OUTLIER))
    labelled = found.labelled.unionByName(outliers).withColumn("risk_label_next_term_numeric", F.col(LABEL))
    assigned = cut_lineage(labelled)
    return {
        "assigned": assigned,
        "k_search": found.table,
        "profile": clusters.cluster_profile(assigned),
        "inlier_profile": clusters.inlier_profile(assigned),
        "sizes": clusters.cluster_sizes(assigned),
        "coordinates": clusters.pca_2d(assigned),
        "top_outliers": clusters.top_outliers(assigned, [key, "cluster", "embedding_distance_to_center", "is_outlier"], [key]),
        "by_college": clusters.cluster_distribution(assigned, "college"),
        "by_major": clusters.cluster_distribution(assigned, "major"),
    }


def dynamics_tables(assigned_terms: DataFrame) -> dict[str, DataFrame]:
    paths = dynamics.transitions(assigned_terms)
    counts = dynamics.transition_counts(paths)
    rates, risk = dynamics.transition_rates(counts), dynamics.transition_risk(paths)
    term_clusters = dynamics.term_cluster_counts(assigned_terms)
    return {
        "transitions": paths,
        "counts": counts,
        "rates": rates,
        "risk": risk,
        "term_clusters": term_clusters,
        "top_transitions": dynamics.top_transitions(rates),
        "top_risk_transitions": dynamics.top_risk_transitions(risk),
        "head_term_clusters": dynamics.head_term_clusters(term_clusters),
        "stay_rate": dynamics.stay_rate(paths),
    }


def persona_tables(assigned: DataFrame) -> dict[str, DataFrame]:
    chosen = personas.choose_personas(clusters.inlier_profile(assigned))
    named = personas.apply_personas(assigned, chosen)
    return {
        "assignment": named,
        "labels": personas.persona_labels(chosen),
        "unfilled": personas.unfilled_roles(chosen),
        "summary": personas.persona_summary(named),
    }


def risk_tables(
    base: DataFrame,
    embeddings: DataFrame,
    assigned_terms: DataFrame,
    dims: int,
    years: Mapping[str, Sequence[str]] = features.BASELINE_YEARS,
    **grid,
) -> dict[str, DataFrame]:
    """Feature sets side by side, split by year, trained and compared on one evaluation."""
    rows = features.labelled_only(features.typed_features(base))
    wide = models.with_clusters(
        models.with_embeddings(rows, embeddings, zero_dims=dims), models.cluster_source(assigned_terms)
    )
    split = features.require_splits(cut_lineage(features.year_split(wide, years)), list(years))
    train, test = (split.where(F.col("split") == name) for name in ("train", "test"))
    predictions = models.grid_predictions(train, test, **grid)
    return {"predictions": predictions, "metrics": models.evaluate(predictions, by=["feature_set", "model"])}


def baseline_tables(
    base: DataFrame,
    years: Mapping[str, Sequence[str]] = features.BASELINE_YEARS,
    runs: Mapping[str, models.Run] = models.BASELINE_RUNS,
) -> dict[str, DataFrame]:
    """The baseline run: predictions, the strongest features and the metrics by PR-AUC of every model, split by year."""
    rows = features.labelled_only(features.typed_features(base))
    split = features.require_splits(cut_lineage(features.year_split(rows, years)), list(years))
    train, test = (split.where(F.col("split") == name) for name in ("train", "test"))
    scored, important = models.run_models(train, test, runs)
    scored = cut_lineage(scored)
    return {
        "predictions": scored,
        "top_features": important,
        "metrics": metrics.rank_models(cut_lineage(models.evaluate(scored, by=["model"])), "pr_auc", ["model"]),
    }


def compare_tables(
    base: DataFrame, embeddings: DataFrame, dims: int, runs: Mapping[str, models.Run] = models.COMPARED_RUNS
) -> dict[str, DataFrame]:
    """Numbers, embeddings and both against each other on a stratified fifth of the rows; ranked, with a status."""
    rows = models.comparison_rows(base, embeddings, dims)
    split = cut_lineage(features.stratified_split(rows, LABEL, ID_COLUMNS))
    train, test = (split.where(F.col("split") == name) for name in ("train", "test"))
    scored, _ = models.run_models(train, test, runs)
    scored = cut_lineage(scored)
    table = cut_lineage(models.evaluate(scored, by=["model"]))
    return {"predictions": scored, "ranking": metrics.rank_models(table, "roc_auc", ["model"], target=models.TARGET_AUC)}


# ---------------------------------------------------------------- the whole chain


def hand_over(spark: SparkSession, made: Mapping[str, DataFrame], folder: str) -> dict[str, DataFrame]:
    """Write every table of a job under ``folder`` and give the next job what was written."""
    for name, df in made.items():
        write_table(df, f"{folder}/{name}")
    return {name: spark.read.schema(df.schema).parquet(f"{folder}/{name}") for name, df in made.items()}


def run_chain(
    raw: Mapping[str, DataFrame],
    root: str,
    dims: int = 16,
    baseline: Mapping[str, models.Run] = models.BASELINE_RUNS,
    compared: Mapping[str, models.Run] = models.COMPARED_RUNS,
    search: Mapping | None = None,
    grid: Mapping | None = None,
) -> dict[str, dict[str, DataFrame]]:
    """All jobs in order, from raw tables (with an ordinal column) to risk metrics.

    Every job reads what the jobs before it have written under ``root``, so a broken chain can go on from any of them.
    """
    spark = next(iter(raw.values())).sparkSession
    out: dict[str, dict[str, DataFrame]] = {"identity": hand_over(spark, identity_tables(raw), f"{root}/identity")}
    report = run_semester_base(raw, f"{root}/semester_base")
    base = spark.read.schema(SEMESTER_BASE).parquet(f"{root}/semester_base")
    out["base"] = hand_over(spark, {"report": report}, f"{root}/base")
    out["features"] = hand_over(spark, feature_tables(base), f"{root}/features")
    out["baseline"] = hand_over(spark, baseline_tables(base, runs=baseline), f"{root}/baseline")

    fitted = embedding.fit_embedding(out["features"]["pool"], models.fit_preprocessor(out["features"]["pool"]), dims)
    rows = features.select_features(features.typed_features(base))
    out["embedding"] = hand_over(spark, {"terms": fitted.transform(rows)}, f"{root}/embedding")
    terms = out["embedding"]["terms"]
    vectors = terms.select(*ID_COLUMNS, "embedding")
    out["comparison"] = hand_over(spark, compare_tables(base, vectors, dims, compared), f"{root}/comparison")

    grouped = cluster_tables(features.last_term(terms), **(search or {}))
    out["clusters"] = hand_over(spark, grouped, f"{root}/clusters")
    assigned = out["clusters"]["assigned"]
    threshold = assigned.agg(F.max("outlier_distance_threshold")).first()[0]
    placed = clusters.assign_semesters(terms, assigned, threshold)
    out["terms"] = hand_over(spark, {"assigned": placed}, f"{root}/terms")
    placed = out["terms"]["assigned"]
    named = placed.withColumns({"cluster_name": F.lit(None).cast("string"), "risk_label_next_term_numeric": F.col(LABEL)})
    out["dynamics"] = hand_over(spark, dynamics_tables(named), f"{root}/dynamics")
    out["personas"] = hand_over(spark, persona_tables(assigned), f"{root}/personas")
    out["risk"] = hand_over(spark, risk_tables(base, vectors, placed, dims, **(grid or {})), f"{root}/risk")
    return out
