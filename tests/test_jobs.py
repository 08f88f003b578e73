from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortline.operators import embedding, models
from cohortline.operators.features import last_term
from cohortline.plans import jobs
from cohortline.session import cut_lineage
from cohortline.sources import reports, tables
from cohortline.sources.schemas import LABEL, SEMESTER_BASE
from cohortline.sources.tables import ORDINAL

YEARS = ["2020-2021", "2021-2022", "2022-2023", "2023-2024"]


@pytest.fixture(scope="module")
def raw(spark):
    """Forty students with dirty text in every source; every cell is a string."""
    rng = random.Random(8)
    students = [f"S{i:03d}" for i in range(40)]

    def make(columns, rows):
        names = columns.split() + [ORDINAL]
        ddl = ", ".join(f"{n} string" for n in names[:-1]) + f", {ORDINAL} bigint"
        return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], ddl)

    terms = [(y, s) for y in YEARS for s in "12"]
    day = {"1": "10", "2": "04"}

    def date_in(y, s):
        start = int(y[:4])
        return f"{start if s == '1' else start + 1}{day[s]}15"

    basic = [(s.lower() + " ", rng.choice("男女"), "汉", "x", "2002", "a", f"Col {i % 3}", f"Maj {i % 5}") for i, s in enumerate(students)]
    org = [("n", s, "", "2020", f"Col {i % 3}", "", f"C{i % 4}", "B") for i, s in enumerate(students)]
    fitness = [(s, "男", "2020", "", "", "", "", y[:4], str(rng.randrange(40, 100)), "170 / 60") for s in students for y in YEARS]
    scores = [
        (f" {s}", f"{y}-{t}", str(rng.choice([1, 2, 3.5])), rng.choice(["01", "11", ""]), rng.choice(["55", "80", " 91.5", "abs", "120"]), "3.0", "K")
        for s in students for y, t in terms for _ in range(3)
    ]
    courses = [(s, "J", "K", y, t) for s in students for y, t in terms for _ in range(2)] + [("ghost", "J", "K", YEARS[0], "1")]
    usage = [(s, date_in(y, t)[:6], str(rng.randrange(100)), "50") for s in students for y, t in terms]
    status = [(s, date_in(y, t), rng.choice(["1", "2", "11"]), "r", "", "", "1") for s in students for y, t in terms if rng.random() < 0.25]
    online = [(s if i % 2 else f"login{i}", "3", f"Col {i % 3}", f"Maj {i % 5}", "", str(50 + i), "name") for i, s in enumerate(students)]
    return {
        "student_basic": make("XH XB MZMC ZZMMMC CSRQ JG XSM ZYM", basic),
        "student_fitness": make("XM XH XB NJ YX ZY BJ BH", org),
        "physical_test": make("XH XB NJ YX ZY BJ BH TCNF ZF BMI", fitness),
        "pe_class": make("XM XH XB NJ YX ZY BJ BH", org[:3]),
        "daily_exercise": make("XM XH XB NJ YX ZY BJ BH", org[:2]),
        "graduation": make("SID GRADE BJMC BYQXMC", [("s001", "2020", "G", "job")]),
        "online_learning": make("LOGIN_NAME ROLEID DEPARTMENT_NAME MAJOR_NAME CLASS_NAME BFB XM", online),
        "course_select": make("XH JXBH KCH KKXN KKXQ", courses),
        "student_score": make("XH ZXJXJHH XF CXBKBZ KCCJ JDCJ KCH", scores),
        "internet_stats": make("XSBH TJNY SWLJSC XXPJZ", usage),
        "status_change": make("XH YDRQ YDLBDM YDYYDM SPRQ BY1 SFZX", status),
        "competition": make("XHHGH", [("S001",), ("t9",), ("s001 ",)]),
    }


def test_identity_job(raw):
    out = jobs.identity_tables(raw)
    assert out["student_master"].count() == 40 and out["account_master"].count() == 40
    assert out["key_bridge"].count() == 13 * 40 + 2 + 40
    summary = {(r["source_table"], r["match_type"]): r["row_count"] for r in out["bridge_summary"].collect()}
    assert summary["student_basic", "exact"] == 40 and summary["competition", "filtered_out_nonstudent"] == 1
    assert summary["online_learning", "exact_login_alias"] == 20
    assert out["student_master"].where("student_id = 's001'").first()["GRADE"] == "2020"


def test_all_jobs_in_a_row(spark, raw, tmp_path):
    path = str(tmp_path / "base")
    report = jobs.run_semester_base(raw, path).first()
    assert (report["unique_students"], report["row_count"]) == (40, 320)
    base = tables.read_table(spark, path, SEMESTER_BASE)
    assert base.where("student_id = 'ghost'").isEmpty()
    assert report["labelled_rows"] == 320 - 40
    assert base.where(f"{LABEL} IS NULL").count() == 40
    pruned = base.where(F.col("school_year").isin("2020-2021"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in pruned and "school_year" in pruned.split("PartitionFilters: [")[1]

    made = jobs.feature_tables(base)
    assert made["last_semester"].count() == 40 and made["pool"].count() == 320
    split = {r["split"]: r["row_count"] for r in reports.split_report(made["splits"]).collect()}
    assert split == {"train": 160, "valid": 80, "test": 40}
    assert made["encoded_pool"].where("avg_score IS NULL").isEmpty() and made["encoded_last"].count() == 40

    prepared = models.fit_preprocessor(made["pool"])
    embedded = cut_lineage(embedding.embed_rows(made["pool"], prepared, dims=4))
    last = last_term(embedded)
    grouped = jobs.cluster_tables(last, ks=[2, 3], restarts=1)
    assert grouped["assigned"].count() == 40 and grouped["coordinates"].count() == 40
    assert grouped["sizes"].agg(F.sum("student_count")).first()[0] == 40
    outliers = grouped["assigned"].where("is_outlier = 1").count()
    assert outliers == grouped["assigned"].where("cluster = -1").count() <= 1

    threshold = grouped["assigned"].first()["outlier_distance_threshold"]
    terms = cut_lineage(jobs.clusters.assign_semesters(embedded, grouped["assigned"], threshold))
    named = terms.withColumn("cluster_name", F.lit(None).cast("string")).withColumn("risk_label_next_term_numeric", F.col(LABEL))
    moves = jobs.dynamics_tables(named)
    assert moves["transitions"].count() == 320 - 40
    per_origin = moves["rates"].groupBy("from_cluster").agg(F.sum("rate").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1) for r in per_origin)

    people = jobs.persona_tables(grouped["assigned"])
    assert people["assignment"].where("mode_name IS NULL").isEmpty()
    assert people["summary"].agg(F.sum("student_count")).first()[0] == 40

    result = jobs.risk_tables(
        base, embedded.select("student_id", "school_year", "semester", "term_order", "embedding"), terms, dims=4,
        feature_sets={"embedding_only": models.FEATURE_SETS["embedding_only"], "all": models.FEATURE_SETS["baseline_plus_embedding"]},
        models={"logistic_regression": models.logistic_regression},
    )
    rows = result["metrics"].collect()
    assert {r["feature_set"] for r in rows} == {"embedding_only", "all"} and all(r["test_rows"] == 40 for r in rows)

    summary = reports.run_summary({"splits": reports.split_report(made["splits"])}, {"seed": 42, "years": YEARS})
    tables.write_summary(summary, str(tmp_path / "summary"))
    back = spark.read.json(str(tmp_path / "summary")).first()
    assert back["seed"] == 42 and len(back["splits"]) == 3 and back["years"] == YEARS


def test_chain_from_csv_to_risk_metrics(spark, raw, tmp_path):
    """Text files in, every hand-over written, each job on what was written; results equal the jobs called by hand."""
    layout = {name: (str(tmp_path / "in" / name), [c for c in df.columns if c != ORDINAL]) for name, df in raw.items()}
    for name, (path, columns) in layout.items():
        tables.write_table(raw[name].orderBy(ORDINAL).select(*columns), path, fmt="csv")
    back = {name: tables.read_raw(spark, path, columns, fmt="csv", with_ordinal=True) for name, (path, columns) in layout.items()}
    few = {
        "raw_random_forest": models.Run(models.COMPARED_RUNS["raw_random_forest"].features, lambda t, label: models._compared_forest(t, label, trees=8)),
        "embedding_logistic_regression": models.COMPARED_RUNS["embedding_logistic_regression"],
    }
    out = jobs.run_chain(
        back, str(tmp_path / "out"), dims=3,
        baseline={"logistic_regression": models.BASELINE_RUNS["logistic_regression"]},
        compared=few,
        search={"ks": [2, 3], "restarts": 1},
        grid={"feature_sets": {"all": models.FEATURE_SETS["baseline_plus_embedding"]}, "models": {"logistic_regression": models.logistic_regression}},
    )
    assert out["base"]["report"].first()["row_count"] == 320
    by_hand = jobs.semester_base_of(raw)
    written = spark.read.schema(SEMESTER_BASE).parquet(str(tmp_path / "out" / "semester_base"))
    assert written.count() == 320 and written.select(*by_hand.columns).exceptAll(by_hand).isEmpty()
    assert out["identity"]["student_master"].exceptAll(jobs.identity_tables(raw)["student_master"]).isEmpty()
    ranking = out["comparison"]["ranking"].orderBy("rank").collect()
    assert {r["model"] for r in ranking} == set(few) and "BEST" in ranking[0]["status"] and ranking[0]["roc_auc"] >= ranking[1]["roc_auc"]
    labels = [r[0] for r in by_hand.where(f"{LABEL} IS NOT NULL").select(LABEL).collect()]
    tested = sum(-(-labels.count(v) // 5) for v in (0, 1))
    assert {r["test_rows"] for r in ranking} == {tested} and {r["positive_rows"] for r in ranking} == {-(-labels.count(1) // 5)}
    assert out["baseline"]["predictions"].count() == 40 and out["baseline"]["top_features"].count() > 3
    assert out["risk"]["metrics"].first()["test_rows"] == 40
    assert out["terms"]["assigned"].count() == 320 and out["personas"]["assignment"].count() == 40


def test_comparison_rows_fill_with_medians(spark, table):
    columns = [f"{c} double" for c in models.RAW_NUMERIC]
    key = f"student_id string, school_year string, semester string, term_order int, gender string, {', '.join(columns)}, {LABEL} int"
    row = lambda i, v, gender, label: (f"s{i}", "y", "2" if i else "1", i, gender, *([v] * len(columns)), label)
    base = table([row(0, 1.0, "女", 0), row(1, None, "男", 1), row(2, 4.0, None, 0), row(3, 9.0, "男", None)], key)
    vectors = table([("s0", "y", "1", 0, [0.5, 1.5])], "student_id string, school_year string, semester string, term_order int, embedding array<float>")
    got = {r["student_id"]: r for r in models.comparison_rows(base, vectors, 2).collect()}
    assert set(got) == {"s0", "s1", "s2"} and got["s1"]["avg_score"] == 2.5
    assert (got["s0"]["gender_encoded"], got["s0"]["semester_encoded"], got["s1"]["semester_encoded"]) == (1, 0, 1)
    assert got["s0"]["embedding"] == [0.5, 1.5] and got["s2"]["embedding"] == [0.0, 0.0]


# ---------------------------------------------------------------- sources


def test_tables_are_recognised_by_columns(table):
    assert tables.match_source(["xh", "kch", "kccj", "jdcj", "jxbh", "kkxn", "kkxq"]) == "student_score"
    assert tables.match_source(["XH", "JXBH", "KCH", "KKXN", "KKXQ"]) == "course_select"
    assert tables.match_source(["a"]) is None
    club = table([("1", "2")], "XSBH string, HDRQ string")
    assert set(tables.match_sources([club], ["club"])) == {"club"}
    with pytest.raises(ValueError, match="cet"):
        tables.match_sources([club], ["club", "cet"])
    with pytest.raises(ValueError, match="nope"):
        tables.require_columns(club, ["xsbh", "nope"])


def test_raw_round_trip(spark, table, tmp_path):
    df = table([(i, f" v{i}", "x" if i % 2 else None) for i in range(20)], "n int, a string, b string")
    tables.write_table(df, str(tmp_path / "p"), sort_by=["n"])
    back = tables.read_raw(spark, str(tmp_path / "p"), ["n", "a"], with_ordinal=True)
    assert back.dtypes[:2] == [("n", "string"), ("a", "string")]
    assert back.select(ORDINAL).distinct().count() == 20
    tables.write_table(df, str(tmp_path / "c"), fmt="csv")
    text = tables.read_raw(spark, str(tmp_path / "c"), ["a"], fmt="csv")
    assert text.count() == 20 and text.columns == ["a"]
    typed = tables.read_table(spark, str(tmp_path / "c"), df.schema, fmt="csv")
    assert typed.where("b IS NULL").count() == 10 and typed.where("n = 3").count() == 1


@pytest.mark.parametrize("split", ["2k", "64m"])
def test_csv_rows_keep_their_order(spark, tmp_path, split):
    """Rows of several files over many splits, as their ordinals sort them."""
    for name in "ab":
        (tmp_path / f"{name}.csv").write_text("n,v\n" + "".join(f"{name}{i},{i % 7}\n" for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        rows = tables.read_raw(spark, str(tmp_path), ["n", "v"], fmt="csv", with_ordinal=True)
        assert [r["n"] for r in rows.repartition(5).orderBy(ORDINAL).collect()] == [f"{name}{i}" for name in "ab" for i in range(5000)]
        first = rows.groupBy("v").agg(F.min_by("n", ORDINAL).alias("first"))
        assert {r["v"]: r["first"] for r in first.collect()} == {str(i): f"a{i}" for i in range(7)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_spread_vectors(table):
    df = table([(1, 0.5, 1.5, 9.0)], "id int, emb_00 double, emb_01 double, emb_scaled_00 double")
    names = tables.columns_with_prefix(df)
    assert names == ["emb_00", "emb_01"]
    assert tables.gather_vector(df, names).first()["embedding"] == [0.5, 1.5]


# ---------------------------------------------------------------- models


@pytest.fixture(scope="module")
def trainable(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(400):
        x, g = float(rng.normal()), str(rng.choice(["a", "b"]))
        y = int(rng.random() < 1 / (1 + np.exp(-(2 * x - 2.5 + (g == "b")))))
        rows.append((f"s{i}", "y", "1", i, x if i % 10 else None, g, y))
    return spark.createDataFrame(rows, f"student_id string, school_year string, semester string, term_order int, x double, g string, {LABEL} int")


def test_preprocessor(trainable, table):
    prepared = models.fit_preprocessor(trainable, ["x"], ["g"])
    assert prepared.names == ("num__x", "cat__g_a", "cat__g_b")
    got = np.array([r[0].toArray() for r in prepared.transform(trainable).select("features").collect()])
    assert got[:, 0].mean() == pytest.approx(0, abs=1e-9) and got[:, 0].std() == pytest.approx(1)
    unseen = trainable.limit(1).withColumn("g", F.lit("zzz")).withColumn("x", F.lit(None).cast("double"))
    row = prepared.transform(unseen).first()["features"].toArray()
    median = np.median([r["x"] for r in trainable.where("x IS NOT NULL").collect()])
    assert row[1:].tolist() == [0.0, 0.0]
    assert row[0] == pytest.approx((median - prepared.means["x"]) / prepared.stds["x"])


def test_logistic_regression_minimises_the_summed_loss(trainable):
    """At the optimum the gradient of |w|^2 / 2 + sum of weighted losses vanishes."""
    prepared = models.fit_preprocessor(trainable, ["x"], ["g"])
    ready = prepared.transform(trainable)
    model = models.logistic_regression(ready)
    rows = models.with_class_weight(ready).select("features", LABEL, "class_weight").collect()
    x = np.array([r[0].toArray() for r in rows])
    y, weight = (np.array([r[i] for r in rows], dtype=float) for i in (1, 2))
    assert weight.sum() == pytest.approx(len(rows))
    p = 1 / (1 + np.exp(-(x @ model.coefficients.toArray() + model.intercept)))
    gradient = model.coefficients.toArray() + x.T @ (weight * (p - y))
    assert gradient == pytest.approx(np.zeros(3), abs=1e-2)
    scored = models.score(model, ready)
    assert scored.columns == ["student_id", "school_year", "semester", "term_order", "label", "pred_label", "pred_proba"]
    top = models.top_features(model, prepared, trainable, limit=2).collect()
    assert top[0]["feature"] == "num__x" and len(top) == 2


@pytest.mark.parametrize("fit", [lambda t: models.random_forest(t, trees=20), lambda t: models.boosted_trees(t, rounds=10)])
def test_trees_beat_chance(trainable, fit):
    ready = models.fit_preprocessor(trainable, ["x"], ["g"]).transform(trainable)
    assert models.evaluate(models.score(fit(ready), ready)).first()["roc_auc"] > 0.75


def test_embedding_and_cluster_joins(table):
    key = "student_id string, school_year string, semester string, term_order int"
    rows = table([("a", "y", "1", 1), ("b", "y", "1", 1)], key)
    embeddings = table([("a", "y", "1", 1, [1.0, 2.0])], f"{key}, embedding array<float>")
    zero = {r[0]: r["embedding"] for r in models.with_embeddings(rows, embeddings, zero_dims=2).collect()}
    assert zero == {"a": [1.0, 2.0], "b": [0.0, 0.0]}
    kept = {r[0]: r["embedding"] for r in models.with_embeddings(rows, embeddings).collect()}
    assert kept == {"a": [1.0, 2.0], "b": None}
    assigned = table([("a", "y", "1", 1, -1, None, 2.5)], f"{key}, cluster int, is_outlier int, embedding_distance_to_center double")
    got = {r[0]: (r["cluster_name"], r["is_outlier"]) for r in models.with_clusters(rows, models.cluster_source(assigned)).collect()}
    assert got == {"a": ("Outlier", 0), "b": ("NO_CLUSTER", 0)}
