import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from goldmeter.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("4", "tests")


@pytest.fixture(scope="session")
def column_values(spark):
    """Apply a builder to a list of Python strings and return the results."""

    def run(builder, values):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
        from pyspark.sql import functions as F

        out = rows.select("i", builder(F.col("v")).alias("r")).orderBy("i").collect()
        return [r["r"] for r in out]

    return run
