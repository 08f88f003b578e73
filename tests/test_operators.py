from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortline.operators import dynamics, facts, features, identity, metrics, noise, personas
from cohortline.operators.identity import Source
from cohortline.operators.ordering import exact_quantiles, key_at, running_totals
from cohortline.sources import reports

TERM = "student_id string, school_year string, semester string"


def by_key(df, key="student_id"):
    return {r[key]: r for r in df.collect()}


# ---------------------------------------------------------------- order


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_match_a_plain_loop(table, descending):
    rng = random.Random(5)
    rows = [(g, v, rng.randrange(5)) for g in "ab" for v in rng.sample(range(1000), 200)]
    df = table(rows, "g string, v int, n bigint")
    got = {(r["g"], r["v"]): r["n_before"] for r in running_totals(df, ["v"], ["n"], ["g"], descending, partitions=5).collect()}
    for g in "ab":
        total = 0
        for _, v, n in sorted((r for r in rows if r[0] == g), key=lambda r: r[1], reverse=descending):
            assert got[g, v] == total
            total += n
    assert len(got) == len(rows)


def test_running_totals_by_given_block(table):
    rows = [(f"{i:04x}", 1) for i in random.Random(1).sample(range(65536), 300)]
    got = running_totals(table(rows, "h string, n int"), ["h"], ["n"], block=F.substring("h", 1, 1)).collect()
    order = {h: i for i, (h, _) in enumerate(sorted(rows))}
    assert all(r["n_before"] == order[r["h"]] for r in got)


def test_exact_quantiles_with_a_hot_value(table):
    rng = np.random.default_rng(3)
    x = np.where(rng.random(999) < 0.4, 7.0, rng.normal(size=999))
    rows = [(float(v), float(i) if i % 2 else None, None) for i, v in enumerate(x)]
    got = by_key(exact_quantiles(table(rows, "x double, y double, z double"), ["x", "y", "z"], [0.0, 0.5, 0.995]), "feature")
    assert [got["x"][f"q{i}"] for i in range(3)] == pytest.approx(list(np.percentile(x, [0, 50, 99.5])))
    assert got["y"]["q1"] == np.median(np.arange(1, 999, 2)) and got["y"]["n"] == 499
    assert got["z"]["n"] == 0 and got["z"]["q1"] is None


def test_median_of_even_count_is_interpolated(table):
    df = table([(1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    assert features.column_medians(df, ["x"]).first()["median"] == 2.5


def test_key_at(table):
    df = table([(f"s{i:03d}", i % 3) for i in range(100)], "s string, t int")
    assert tuple(df.limit(1).select(key_at(df, ["s", "t"], 0.9)).first()[0]) == ("s090", 0)


# ---------------------------------------------------------------- facts

SCORES = [
    ("none", None, None, None, None),
    ("one", 60.0, 3.0, 2.0, "01"),
    ("same", 70.0, None, 0.0, "11"),
    ("same", 70.0, None, -1.0, None),
    ("bad", 100.5, 1.0, 1.0, "11"),
    ("bad", -1.0, 2.0, None, " "),
    ("fail", 59.75, None, None, " 02 "),
]


@pytest.fixture
def scores(table):
    rows = [(s, "2020-2021", "1", *rest) for s, *rest in SCORES]
    return table(rows, f"{TERM}, score double, gpa double, credit double, resit string")


def test_score_rules(scores):
    got = by_key(facts.score_finalise(scores))
    assert (got["none"]["avg_score"], got["none"]["score_std"], got["none"]["score_course_count"]) == (None, None, 0)
    assert (got["one"]["score_std"], got["one"]["fail_course_count"], got["one"]["resit_exam_count"]) == (0.0, 0, 0)
    assert (got["same"]["score_std"], got["same"]["credit_sum"], got["same"]["resit_exam_count"]) == (0.0, 0.0, 1)
    assert (got["bad"]["score_course_count"], got["bad"]["avg_gpa"], got["bad"]["resit_exam_count"]) == (0, 1.5, 0)
    assert (got["fail"]["fail_course_count"], got["fail"]["fail_ratio"], got["fail"]["resit_exam_count"]) == (1, 1.0, 1)
    lenient = by_key(facts.score_finalise(scores, facts.LENIENT))
    assert (lenient["bad"]["score_course_count"], lenient["bad"]["fail_course_count"]) == (2, 1)
    assert (lenient["same"]["credit_sum"], lenient["bad"]["resit_exam_count"]) == (-1.0, 1)
    assert lenient["none"]["score_course_count"] == 1 and lenient["none"]["fail_ratio"] == 0.0


def test_usage_means_divide_by_months(table):
    rows = [("a", "y", "1", 10.0, 4.0), ("a", "y", "1", 6.0, None), ("a", "y", "1", None, 3.0), ("a", "y", "1", None, None)]
    got = facts.internet_stats(table(rows, f"{TERM}, hours double, school_average double")).first()
    assert (got["internet_month_count"], got["internet_hours_sum"]) == (4, 16.0)
    assert (got["internet_hours_avg_per_month"], got["internet_diff_mean"]) == (4.0, 1.5)


def test_bmi_needs_a_numeric_score(table):
    raw = table(
        [("A", "2020", "x", " ", 1), ("A", "2020", "y", "170/60", 2), ("b", "2020", "80", "", 1), ("b", "2020", "70", "1/2", 3), ("b", "2020", "", "3/4", 2), ("b", "20", "9", "", 4)],
        "XH string, TCNF string, ZF string, BMI string, ordinal int",
    )
    yearly = facts.fitness_by_year(facts.fitness_facts(raw))
    rows = table([("a", "2020-2021"), ("b", "2020-2021"), ("b", "2021-2022")], "student_id string, school_year string")
    got = {(r[0], r[1]): (r["physical_test_score"], r["physical_test_bmi"]) for r in facts.with_yearly(rows, yearly).collect()}
    assert got == {("a", "2020-2021"): (None, None), ("b", "2020-2021"): (75.0, "3/4"), ("b", "2021-2022"): (None, None)}


def test_status_facts_take_the_first_readable_date(table):
    raw = table(
        [
            ("S1 ", "bad", "20210301", None, "1", "r1", "1"),
            ("s2", None, None, None, "3", "r", "1"),
            ("s3", "20200901", None, None, "2", "R2", "0"),
            ("s4", "20200901", None, None, "2", "r", "1"),
            ("s1", "44256", None, None, "11", "R1", None),
        ],
        "XH string, YDRQ string, SPRQ string, BY1 string, YDLBDM string, YDYYDM string, SFZX string",
    )
    got = by_key(facts.risk_events(facts.status_facts(raw)))
    assert set(got) == {"s1", "s3"}
    assert (got["s1"]["risk_event_type_codes"], got["s1"]["risk_event_reason_codes"]) == ("1|11", "r1")
    assert (got["s3"]["school_year"], got["s3"]["semester"]) == ("2020-2021", "1")


def test_next_label_skips_gaps_unless_calendar(table):
    rows = [("a", "2020-2021", "1", 20201, 0), ("a", "2020-2021", "2", 20202, 1), ("a", "2022-2023", "1", 20221, 1), ("b", "2020-2021", "2", 20202, 1), ("b", "2021-2022", "1", 20211, 0)]
    df = table(rows, f"{TERM}, term_order int, risk_event_current int")
    plain = {(r[0], r["term_order"]): r["risk_label_next_term"] for r in facts.next_term_label(df).collect()}
    assert plain == {("a", 20201): 1, ("a", 20202): 1, ("a", 20221): None, ("b", 20202): 0, ("b", 20211): None}
    strict = {(r[0], r["term_order"]): r["risk_label_next_term"] for r in facts.next_term_label(df, calendar=True).collect()}
    assert strict == {**plain, ("a", 20202): None}


def test_skeleton_and_build_report(table):
    a = table([("x", "y", "1", 2)], f"{TERM}, n bigint")
    b = table([("x", "y", "2", "c")], f"{TERM}, codes string")
    got = {r["semester"]: (r["n"], r["codes"]) for r in facts.semester_skeleton(a, b).collect()}
    assert got == {"1": (2, None), "2": (None, "c")}
    empty = table([], f"{TERM}, risk_event_current int, risk_label_next_term int")
    assert tuple(reports.build_report(empty).first()) == (0, 0, 0, 0)


# ---------------------------------------------------------------- identity


def test_first_non_blank_by_source_then_row(table):
    one = table([("S1", 2, "late"), ("s1", 1, " ")], "id string, ordinal int, f string")
    two = table([("s1 ", 9, "b"), ("s1", 3, "a"), ("s2", 1, "only"), (" ", 1, "nobody")], "id string, ordinal int, f string")
    sources = [Source("one", one, "id", "ordinal", {"XB": "f"}), Source("two", two, "id", "ordinal", {"XB": "f", "NJ": "f"})]
    got = by_key(identity.merge_profiles(sources))
    assert (got["s1"]["XB"], got["s1"]["NJ"], got["s2"]["XB"]) == ("late", "a", "only") and len(got) == 2
    master = by_key(identity.student_master(sources))
    assert (master["s1"]["source_tables"], master["s2"]["source_tables"]) == (["one", "two"], ["two"])


def test_account_cascade(table):
    people = table(
        [("s1", 1, "D", "M", "C1"), ("s2", 2, "D", "M", "C2"), ("s3", 3, "D", "M", "C2"), ("s4", 4, "D", "Lone", "C")],
        "id string, ordinal int, YX string, ZY string, BJ string",
    )
    master = identity.student_master([Source("t", people, "id", "ordinal", {c: c for c in ("YX", "ZY", "BJ")})])
    raw = table(
        [
            (" S2", 1, "u", "", "", "", "3"),
            ("c1", 2, "u", "d", "m", " c1", "3"),
            ("lone", 3, "u", "D", "LONE", "", "3"),
            ("multi", 4, "u", "D", "M", "C2", "3"),
            ("blank", 5, None, None, None, None, " 3 "),
            ("staff", 6, "u", "D", "M", "C1", "2"),
            ("", 7, "u", "D", "M", "C1", "3"),
        ],
        "LOGIN_NAME string, ordinal int, XM string, DEPARTMENT_NAME string, MAJOR_NAME string, CLASS_NAME string, ROLEID string",
    )
    accounts = identity.resolve_accounts(identity.account_master(raw, "online"), master)
    got = {k: (r["student_id"], r["match_type"], r["match_confidence"]) for k, r in by_key(accounts, "login_name_norm").items()}
    assert got == {
        "s2": ("s2", "exact_login_alias", "high"),
        "c1": ("s1", "bridge_org_class_unique", "medium"),
        "lone": ("s4", "bridge_org_major_unique", "low"),
        "multi": (None, "unresolved_org_multi", "low"),
        "blank": (None, "unresolved_org_multi", "low"),
    }
    bridge = by_key(identity.account_bridge(raw, accounts, "online", "LOGIN_NAME"), "source_value_norm")
    assert bridge["staff"]["match_type"] == "unresolved_missing_account_master" and len(bridge) == 6
    assert identity.identity_bridge(master).count() == 13 * 4


# ---------------------------------------------------------------- features


def test_codes_and_unseen_values(table):
    df = table([("b", None), ("a", "z"), ("b", "z")], "g string, h string")
    codes = features.category_codes(df, ["g", "h"])
    assert {(r["feature"], r["value"]): r["code"] for r in codes.collect()} == {("g", "a"): 0, ("g", "b"): 1, ("h", "z"): 0}
    medians = features.column_medians(table([(1.0,), (4.0,)], "x double"), ["x"])
    rows = table([(1, "b", "new", None)], "id int, g string, h string, x double")
    got = features.encode_features(rows, medians, codes, ids=["id"], numeric=["x"], categorical=["g", "h"]).first()
    assert tuple(got) == (1, 1, -1, 2.5)


def test_standardize_constant_column(table):
    df = table([(1.0, 5.0), (3.0, 5.0), (None, 5.0)], "x double, c double")
    got = [tuple(r) for r in features.standardize(df, features.mean_std(df, ["x", "c"]), ["x", "c"]).collect()]
    assert got == [(-1.0, 0.0), (1.0, 0.0), (None, 0.0)]


def test_population_deviation(table):
    stats = features.mean_std(table([(float(i),) for i in range(1, 11)], "x double"), ["x"]).first()
    assert stats["std"] == pytest.approx(np.arange(1, 11).std())


def test_splits(spark, table):
    df = spark.range(1000).select(F.col("id").cast("string").alias("k"), (F.col("id") % 50 == 0).cast("int").alias("y"))
    split = features.stratified_split(df, "y", ["k"])
    counts = Counter((r["y"], r["split"]) for r in split.collect())
    assert counts == {(0, "test"): 196, (0, "train"): 784, (1, "test"): 4, (1, "train"): 16}
    again = features.stratified_split(df.repartition(7), "y", ["k"])
    assert split.exceptAll(again).isEmpty()
    ordered = features.ordered_split(df, ["k"])
    names = [r["split"] for r in ordered.orderBy("k").collect()]
    assert names == ["train"] * 900 + ["valid"] * 100
    years = table([("2020-2021",), ("2022-2023",), ("2019-2020",)], "school_year string")
    assert {tuple(r) for r in features.year_split(years).collect()} == {("2020-2021", "train"), ("2022-2023", "valid")}
    with pytest.raises(ValueError, match="test"):
        features.require_splits(features.year_split(years), ["train", "test"])


# ---------------------------------------------------------------- dynamics and personas

ASSIGNED = f"{TERM}, term_order int, cluster int, cluster_name string, is_outlier int, avg_score double, fail_course_count bigint, internet_hours_sum double, risk_event_current int, risk_label_next_term_numeric int"


def test_transitions(table):
    rows = [
        ("a", "2020-2021", "1", 20201, 0, "x", 0, 1.0, 1, 1.0, 0, 1),
        ("a", "2020-2021", "2", 20202, 0, "x", 0, None, 0, 2.0, 1, 0),
        ("a", "2021-2022", "1", 20211, 7, None, 1, 3.0, 0, 3.0, 0, None),
        ("b", "2020-2021", "1", 20201, 0, "x", 0, 4.0, 0, 4.0, 0, None),
    ]
    assigned = table(rows, ASSIGNED)
    paths = dynamics.transitions(assigned)
    assert paths.count() == 4 - 2
    rates = {(r["from_cluster"], r["to_cluster_name"]): (r["count"], r["rate"]) for r in dynamics.transition_rates(dynamics.transition_counts(paths)).collect()}
    assert rates == {(0, "x"): (1, 0.5), (0, "UNKNOWN"): (1, 0.5)}
    assert tuple(dynamics.stay_rate(paths).first()) == (2, 0.5)
    assert tuple(dynamics.stay_rate(paths.where("1 = 0")).first()) == (0, 0.0)
    risk = dynamics.transition_risk(paths)
    assert dynamics.min_support(risk, 2).isEmpty() and risk.count() == 2
    assert dynamics.term_cluster_counts(assigned).where("cluster_name = 'UNKNOWN'").count() == 1


PROFILE = "cluster int, avg_score_mean double, fail_course_count_mean double, internet_hours_sum_mean double, physical_test_score_mean double, next_term_risk_rate double"


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([(0, 90, 0, 1, 80, 0.0), (1, 50, 3, 1, 60, 0.1), (2, 70, 1, 9, 70, 0.5)], {0: personas.EXCELLENT, 1: personas.WARNING, 2: personas.ACTIVE_RISK}),
        ([(0, 90, 0, 1, 80, 0.0), (1, 50, 3, 1, 60, 0.1), (2, 70, 1, 9, 70, 0.5), (3, 75, 1, 2, 65, 0.1)], {0: personas.EXCELLENT, 1: personas.WARNING, 2: personas.ACTIVE_RISK, 3: personas.STEADY}),
        (
            [(0, 90, 0, 1, 80, 0.0), (1, 50, 3, 1, 60, 0.1), (2, 70, 1, 9, 70, 0.5), (3, 75, 1, 2, 65, 0.1), (4, 72, 1, 2, 50, 0.1), (5, 71, 1, 2, 66, 0.0)],
            {0: personas.EXCELLENT, 1: personas.WARNING, 2: personas.ACTIVE_RISK, 3: personas.STEADY, 4: personas.WEAK_FITNESS, 5: personas.STEADY},
        ),
        ([(3, 75, 1, 2, 50, 0.1), (0, 90, 0, 1, 80, 0.0), (1, 50, 3, 1, 60, 0.1), (2, 70, 1, 9, 70, 0.5), (4, 72, 1, 2, 60, 0.1)], {0: personas.EXCELLENT, 1: personas.WARNING, 2: personas.ACTIVE_RISK, 3: personas.WEAK_FITNESS, 4: personas.STEADY}),
        ([(0, 60, 0, 1, None, None), (1, 60, 0, 1, 70, 0.5), (2, 60, 0, 1, 70, None)], {1: personas.EXCELLENT, 0: personas.WARNING, 2: personas.ACTIVE_RISK}),
    ],
)
def test_choose_personas(table, rows, want):
    floats = [tuple([r[0], *[None if v is None else float(v) for v in r[1:]]]) for r in rows]
    chosen = personas.choose_personas(table(floats, PROFILE))
    assert {r["cluster"]: r["mode_name"] for r in chosen.collect()} == want
    unfilled = {r[0] for r in personas.unfilled_roles(chosen).collect()}
    assert unfilled == set(personas.PERSONA_ORDER[:-1]) - set(want.values())


def test_personas_of_unknown_clusters(table):
    chosen = table([(0, personas.EXCELLENT)], "cluster int, mode_name string")
    rows = table([(-1,), (0,), (8,)], "cluster int")
    got = {r["cluster"]: r["mode_name"] for r in personas.apply_personas(rows, chosen).collect()}
    assert got == {-1: personas.EXTREME, 0: personas.EXCELLENT, 8: personas.STEADY}
    listed = personas.order_by_list(table([("zzz",), (personas.WARNING,), (personas.EXCELLENT,)], "mode_name string"))
    assert [r[0] for r in listed.collect()] == [personas.EXCELLENT, personas.WARNING, "zzz"]


# ---------------------------------------------------------------- metrics


def _curve_metrics(rows):
    """By definition: pairs for the ROC area, one step per distinct score for the precision."""
    pos = [s for s, y in rows if y]
    neg = [s for s, y in rows if not y]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    ap = sum(
        sum(p == s for p in pos) / len(pos) * sum(p >= s for p in pos) / sum(t >= s for t, _ in rows) for s in set(pos)
    )
    return auc, ap


@pytest.mark.parametrize(
    "rows",
    [
        [(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1)],
        [(0.5, 0), (0.5, 1), (0.5, 0)],
        [(0.9, 1), (0.1, 0)],
        [(0.9, 0), (0.1, 1)],
        [(random.Random(i).randrange(7) / 7, random.Random(i * 31).randrange(2)) for i in range(200)],
    ],
)
def test_areas(table, rows):
    df = table([(y, s, int(s >= 0.5)) for s, y in rows], "label int, pred_proba double, pred_label int")
    curve = metrics.score_curve(df)
    auc, ap = _curve_metrics(rows)
    assert metrics.roc_auc(curve).first()[0] == pytest.approx(auc)
    assert metrics.average_precision(curve).first()[0] == pytest.approx(ap)
    mirrored = metrics.score_curve(df.withColumn("pred_proba", -F.col("pred_proba")))
    assert metrics.roc_auc(mirrored).first()[0] == pytest.approx(1 - auc)
    row = metrics.evaluate(df).first()
    assert row["tn"] + row["fp"] + row["fn"] + row["tp"] == row["test_rows"] == len(rows)


def test_undefined_rates_are_zero(table):
    no_hit = table([(1, 0, 0.1), (0, 0, 0.2)], "label int, pred_label int, pred_proba double")
    row = metrics.class_metrics(metrics.confusion_matrix(no_hit)).first()
    assert (row["precision"], row["recall"], row["f1"], row["accuracy"]) == (0.0, 0.0, 0.0, 0.5)
    no_label = metrics.evaluate(no_hit.withColumn("label", F.lit(0))).first()
    assert no_label["recall"] == 0.0 and no_label["roc_auc"] is None and no_label["pr_auc"] is None


def test_rank_models(table):
    df = table([("a", 0.7), ("b", 0.9), ("c", 0.9), ("d", None)], "model string, auc double")
    got = {r["model"]: (r["rank"], r["status"]) for r in metrics.rank_models(df, "auc", ["model"], target=0.8).collect()}
    assert got["b"] == (1, "OK BEST") and got["c"] == (2, "OK") and got["a"] == (3, "WARN") and got["d"][0] == 4


# ---------------------------------------------------------------- noise


def test_noise_is_repeatable_and_has_the_asked_rate(spark):
    df = spark.range(4000).select("id", F.lit(5.0).alias("a"), F.col("id").cast("double").alias("b"))
    masked = noise.mask_noise(df, ["id"], ["a", "b"], noise_std=0.05)
    values = np.array([r["a"] for r in masked.collect()])
    low = np.abs(values) < 2
    assert low.mean() == pytest.approx(0.25, abs=0.03)
    assert values[~low].std() == pytest.approx(0.05, rel=0.1) and values[low].mean() == pytest.approx(0, abs=0.01)
    assert masked.exceptAll(noise.mask_noise(df.repartition(5), ["id"], ["a", "b"])).isEmpty()
    swapped = {r["id"]: r["b"] for r in noise.swap_noise(df, ["id"], ["a", "b"]).collect()}
    moved = [i for i, b in swapped.items() if i != b]
    assert len(moved) / 4000 == pytest.approx(0.3, abs=0.03)
    assert set(swapped.values()) <= set(float(i) for i in range(4000))


@pytest.mark.parametrize("n", [1000, 12_000])
def test_every_column_swaps_its_share(spark, n):
    names = [f"c{i}" for i in range(17)]
    df = spark.range(n).select("id", *[F.col("id").alias(c) for c in names])
    rows = noise.swap_noise(df, ["id"], names).collect()
    assert len(rows) == n
    for c in names:
        assert sum(r[c] != r["id"] for r in rows) / n == pytest.approx(0.3, abs=0.05)
        assert all(0 <= r[c] < n for r in rows)


@pytest.mark.parametrize("n", [1, 2, 5])
def test_swaps_in_tiny_tables(spark, n):
    names = [f"c{i}" for i in range(9)]
    df = spark.range(n).select("id", *[F.col("id").alias(c) for c in names])
    rows = noise.swap_noise(df, ["id"], names, swap_rate=1.1).collect()
    assert len(rows) == n and all((r[c] != r["id"]) == (n > 1) for r in rows for c in names)


def test_rows_without_a_class_or_a_score_stay(table):
    df = table([(str(i), i % 3 if i % 3 else None) for i in range(30)], "k string, y int")
    split = features.stratified_split(df, "y", ["k"])
    assert Counter((r["y"], r["split"]) for r in split.collect()) == {(y, s): n for y in (None, 1, 2) for s, n in (("test", 2), ("train", 8))}
    scored = table(
        [(1, 1, 0.9), (0, 0, 0.1), (1, 0, None), (None, 0, 0.5), (0, 1, float("nan"))], "label int, pred_label int, pred_proba double"
    )
    row = metrics.evaluate(scored).first()
    assert (row["test_rows"], row["positive_rows"], row["unscored_rows"], row["tn"], row["fp"], row["fn"], row["tp"]) == (5, 2, 2, 1, 1, 1, 1)
    assert row["roc_auc"] == 1.0


def test_nan_is_missing(table):
    df = table([(1.0,), (2.0,), (float("nan"),), (3.0,)], "x double")
    assert tuple(features.column_medians(df, ["x"]).first()) == ("x", 3, 2.0)
    stats = features.mean_std(df, ["x"]).first()
    assert (stats["n"], stats["mean"]) == (3, 2.0)


def test_running_totals_exchange_whole_rows_once(table):
    """The range exchange is written; what follows moves no row of the input, and groups may span many partitions."""
    rows = [(g, v, float(v), "x" * 5) for g in ("a", "b", "c") for v in range(400 if g == "b" else 7)]
    got = running_totals(table(rows, "g string, v int, w double, text string"), ["v"], ["v", "w"], ["g"], partitions=9)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    for r in got.collect():
        assert r["v_before"] == sum(range(r["v"])) and r["w_before"] == float(sum(range(r["v"])))


def test_quantiles_compute_their_input_once(spark):
    """An input that counts its rows as they are made."""
    seen = spark.sparkContext.accumulator(0)

    def made(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.range(5000).selectExpr("CAST(id AS DOUBLE) AS x", "CAST(id % 10 AS DOUBLE) AS y").mapInArrow(made, "x double, y double")
    found = {r["feature"]: r["q0"] for r in exact_quantiles(df, ["x", "y"], [0.5]).collect()}
    assert found == {"x": 2499.5, "y": 4.5} and seen.value == 5000
