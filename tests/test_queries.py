"""Every registered query with SQL gives the rows of its SQL; no plan holds a cross join."""

from __future__ import annotations

import oracle
import pytest
from conftest import SMALL

import __spark_entry__ as entry
from cohortline.operators import models
from cohortline.workload import ORACLES, QUERIES

# Without SQL: iterative fits. What they must satisfy is tested with their operators.
FITTED = {
    "choose_k", "k_search_table", "pca_2d", "logistic_regression", "random_forest",
    "boosted_trees", "top_features", "embed_rows", "model_grid", "baseline_run", "model_comparison",
}


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SMALL)


def test_entry_serves_every_query():
    assert set(QUERIES) <= set(entry.queries()) and ORACLES.items() <= entry.oracle_sql().items()


def test_only_fits_have_no_sql():
    assert set(QUERIES) - set(ORACLES) == FITTED and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    assert oracle.compare(df, con, ORACLES[name]) == []
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_entry_has_the_documented_schema(spark):
    from cohortline.sources.schemas import SEMESTER_BASE

    df = entry.entry(spark)
    assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in SEMESTER_BASE]
    assert df.count() > 0


def test_flagship_plan(spark):
    """Facts are combined before one exchange, and the student exchange also serves the window."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = entry.entry(spark)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    window = plan[: plan.index("SortMergeJoin")]
    assert window.count("Window [lead") == 1 and "Exchange" not in window
    union = plan[: plan.index("Union")]
    assert union.count("partial_stddev_pop") == 1


def test_dirty_dates_are_parsed_once_per_row(spark):
    from cohortline.operators import facts

    raw = spark.createDataFrame([("a", "20200901", "1", "2")], "XSBH string, TJNY string, SWLJSC string, XXPJZ string")
    rows = facts.internet_stats(facts.usage_facts(raw)).where("school_year = '2020-2021'")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Generate explode")]
    assert "gettimestamp" not in above.lower()
    assert rows.count() == 1


@pytest.mark.parametrize("name", ["random_forest", "boosted_trees", "model_grid"])
def test_fits_are_whole(spark, monkeypatch, name):
    """Queries really fit all trees and rounds of the compared runs, and score every test row with them."""
    seen = []

    def watched(fit):
        def run(*args, **named):
            seen.append(fit(*args, **named))
            return seen[-1]

        return run

    monkeypatch.setattr(models, "fit_forest", watched(models.fit_forest))
    monkeypatch.setattr(models, "fit_boosting", watched(models.fit_boosting))
    rows = QUERIES[name](spark, SMALL).collect()
    if name == "boosted_trees":
        assert [len(m.trees) for m in seen] == [500]
    else:
        assert [m.subtrees.count() for m in seen] == ([400] if name == "random_forest" else [500] * 3)
    assert rows and (name == "model_grid" or all(0 <= r["pred_proba"] <= 1 and r["pred_label"] == (r["pred_proba"] > 0.5) for r in rows))
