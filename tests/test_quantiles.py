"""Exact percentiles against a sort, with refinement forced; the sketch's stated error."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from goldmeter.operators import quantiles as Q

POINTS = {"p0": 0.0, "p5": 0.05, "p50": 0.5, "p95": 0.95, "p999": 0.999, "p100": 1.0}


@pytest.mark.parametrize("limit,k", [(10_000, 1000), (100, 64)])
def test_exact_equals_a_sort(spark, limit, k):
    rnd = random.Random(limit)
    rows = [("normal", rnd.gauss(0, 10)) for _ in range(3000)] + [("ties", float(rnd.randrange(3))) for _ in range(2000)] + [("one", 5.0)] + [(None, rnd.random()) for _ in range(100)]
    rows += [("skewed", 1e6 if rnd.random() < 0.01 else 7.0) for _ in range(2000)] + [("two", 1.0), ("two", 4.0)] + [("normal", None)] * 5 + [("nulls", None)] * 3
    rows += [("wide", rnd.choice((-1, 1)) * 10 ** rnd.uniform(-300, 300)) for _ in range(1500)]
    got = {r["g"]: r for r in Q.exact(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", POINTS, limit, k).collect()}
    by = defaultdict(list)
    for g, v in rows:
        by[g] += [v] if v is not None else []
    assert set(got) == set(by)
    for g, values in by.items():
        for name, p in POINTS.items():
            if not values:
                assert got[g][name] is None
                continue
            want = np.quantile(values, p)
            assert got[g][name] == pytest.approx(want, rel=1e-9, abs=1e-300), (g, name)


def test_no_groups(spark):
    df = spark.range(1001).select(F.col("id").cast("double").alias("v"))
    assert Q.exact(df, [], "v", {"m": 0.5}, 10, 16).collect()[0]["m"] == 500.0
    assert Q.exact(df.limit(0), [], "v", {"m": 0.5}).collect() == []


def test_sketch_error(spark):
    n = 200_000
    df = spark.range(n).select(F.lit("a").alias("g"), (F.xxhash64("id") % 1_000_003).cast("double").alias("v"))
    values = np.sort(np.array([r["v"] for r in df.collect()]))
    for k in (200, 2000):
        r = Q.sketched(df, ["g"], "v", POINTS, k).first()
        for name, p in POINTS.items():
            low, high = np.searchsorted(values, r[name], "left") / n, np.searchsorted(values, r[name], "right") / n
            assert low - 2 * Q.rank_error(k) <= p <= high + 2 * Q.rank_error(k)
