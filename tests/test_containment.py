"""Containment joins against all pairs, and their work on one hot key."""

import random

from pyspark.sql import functions as F

from goldmeter.operators.containment import contained_either_way, containment_pairs


def test_pairs_equal_brute_force(spark):
    rnd = random.Random(2)
    text = lambda: "".join(rnd.choice("ab c") for _ in range(rnd.choice((0, 1, 2, 3, 5, 8, 13, 21, 40))))
    needles = [(rnd.choice("xy"), text()) for _ in range(150)] + [("x", None), (None, "a")]
    haystacks = [(rnd.choice("xyz"), text()) for _ in range(150)] + [("x", None), (None, "a")]
    needles += [(k, h[3:15]) for k, h in haystacks if h and k and len(h) > 10]
    n = spark.createDataFrame(needles, "k string, needle string")
    h = spark.createDataFrame(haystacks, "k string, haystack string")
    rows = [tuple(r) for r in containment_pairs(n, h, ["k"]).collect()]
    want = {(k, a, b) for k, a in needles for q, b in haystacks if k and k == q and a and b and a in b}
    assert set(rows) == want and len(rows) == len(want)


def test_either_way(spark):
    texts = [("x", "abc def"), ("x", "b"), ("x", "zzz"), ("x", ""), ("y", "anything"), ("z", "q"), ("x", None)]
    others = [("x", "c d"), ("x", "abbb"), ("y", ""), ("z", None)]
    got = contained_either_way(spark.createDataFrame(texts, "k string, text string"), spark.createDataFrame(others, "k string, other string"), ["k"]).collect()
    assert sorted(map(tuple, got)) == [("x", "abc def"), ("x", "b"), ("y", "anything")]


def test_hot_key_is_linear(spark):
    """3,000 needles and 3,000 haystacks of one key: the rows that meet are as many as the matches, not nine million."""
    ids = spark.range(3000)
    word = F.concat(F.lit("value "), F.md5(F.col("id").cast("string")))
    needles = ids.select(F.lit("hot").alias("k"), F.substring(word, 7, 20).alias("needle"))
    haystacks = ids.select(F.lit("hot").alias("k"), F.concat(F.lit("the "), word, F.lit(" stands")).alias("haystack"))
    out = containment_pairs(needles, haystacks, ["k"])
    assert out.count() == 3000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    from goldmeter.operators import containment as C

    own = needles.select("k", F.explode(C._stretches(F.col("needle"), 8)).alias("part"))
    shared = own.groupBy("part").count().filter("count > 3").count()
    assert shared < 50
