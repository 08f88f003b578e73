from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), *filter(None, [os.environ.get("PYTHONPATH")])])  # for Python workers

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from cohortline.session import local_session

    session = local_session(cores=8, shuffle_partitions=4, memory="6g")
    yield session
    session.stop()


@pytest.fixture
def table(spark):
    """Rows with a DDL schema."""
    return lambda rows, ddl: spark.createDataFrame(rows, ddl)


@pytest.fixture
def column(spark):
    """Values of one expression over a list of texts."""

    def run(values, expression, ddl="string"):
        from pyspark.sql import functions as F

        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {ddl}")
        return [r["out"] for r in rows.select("i", expression(F.col("v")).alias("out")).orderBy("i").collect()]

    return run
