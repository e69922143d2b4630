"""Covered segments against a look at every position; greedy matching in rounds against the plain rule."""

import random

import pytest

from goldmeter.operators import intervals as I
from goldmeter.operators.segments import covered_segments


def slow(texts, spans):
    out = {}
    for doc, n in texts:
        own = [s for s in spans if s[0] == doc and s[1] is not None and 0 <= s[1] < s[2] <= n]
        edges = sorted({0, n, *(x for s in own for x in s[1:3])})
        for a, b in zip(edges, edges[1:]):
            over = [s for s in own if s[1] <= a and s[2] >= b]
            side = lambda w: (sorted({s[3] or "" for s in over if s[5] == w}), sorted(s[4] or "" for s in over if s[5] == w))
            g, p = side("gold"), side("pred")
            out[doc, a, b] = (*g, *p, "both" if g[1] and p[1] else "gold" if g[1] else "pred" if p[1] else "plain")
    return out


def fast(spark, texts, spans, width):
    t = spark.createDataFrame(texts, "document_id string, length long")
    s = spark.createDataFrame(spans, "document_id string, start long, end long, label string, span_id string, side string")
    rows = covered_segments(t, s, width).collect()
    got = {(r.document_id, r.start, r.end): (r.gold_labels, r.gold_ids, r.pred_labels, r.pred_ids, r.kind) for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("width", [1, 7, 64, 4096])
def test_nested_touching_repeated(spark, width):
    rnd = random.Random(width)
    texts = [("a", 200), ("b", 130), ("c", 0), ("d", 7), ("e", 500)]
    spans = [("a", 10, 20, "X", "1", "gold"), ("a", 12, 15, "Y", "2", "gold"), ("a", 20, 30, "X", "3", "pred"), ("a", 10, 20, "X", "1", "gold"), ("a", 10, 20, "X", "4", "pred"), ("a", 0, 200, "Z", "5", "pred"),
             ("d", 0, 7, "X", "1", "gold"), ("d", 6, 8, "X", "2", "gold"), ("d", 3, 3, "X", "3", "gold"), ("d", None, 4, "X", "4", "gold"), ("d", 2, 5, None, None, "pred"), ("x", 0, 1, "X", "1", "gold")]
    for i in range(60):
        s = rnd.randrange(130)
        spans.append(("b", s, rnd.randrange(s, 135), rnd.choice("XYZ"), str(i), rnd.choice(["gold", "pred"])))
    assert fast(spark, texts, spans, width) == slow(texts, spans)


def test_hot_document_is_many_groups(spark):
    """20,000 spans of one document: more than one task sweeps them, and the pieces are right."""
    rnd = random.Random(1)
    n = 400_000
    spans = [("hot", s, min(n, s + rnd.randrange(1, 60)), rnd.choice("XY"), str(i), rnd.choice(["gold", "pred"])) for i, s in ((i, rnd.randrange(n)) for i in range(20_000))]
    t = spark.createDataFrame([("hot", n)], "document_id string, length long")
    s = spark.createDataFrame(spans, "document_id string, start long, end long, label string, span_id string, side string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = covered_segments(t, s)
        used = out.rdd.glom().map(len).collect()
        rows = sorted((r.start, r.end, len(r.gold_ids), len(r.pred_ids)) for r in out.collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(x > 0 for x in used) > 1
    assert [r[0] for r in rows] == sorted({0, *(x for s in spans for x in s[1:3])} - {n}) and all(a[1] == b[0] for a, b in zip(rows, rows[1:]))
    gold, pred = [0] * (n + 1), [0] * (n + 1)
    for _, a, b, _, _, side in spans:
        counts = gold if side == "gold" else pred
        counts[a] += 1
        counts[b] -= 1
    at = {r[0]: r for r in rows}
    g = p = 0
    for i in range(n):
        g, p = g + gold[i], p + pred[i]
        if i in at:
            assert at[i][2:] == (g, p)


def greedy(users, gold):
    """Each user span in order takes the best free gold span of its document and label."""
    taken, out = set(), set()
    for doc, label, uid, s, e, _ in users:
        best, who = 0.0, None
        for i, (gdoc, glabel, gid, gs, ge, _) in enumerate(gold):
            if (gdoc, glabel) == (doc, label) and i not in taken:
                inter = max(0, min(e, ge) - max(s, gs))
                score = inter / ((e - s) + (ge - gs) - inter)
                if score > best:
                    best, who = score, i
        if who is not None and best >= 0.5:
            taken.add(who)
            out.add((doc, label, uid, gold[who][2]))
    return out


SPAN = "document_id string, label string, ann_id string, start int, end int, ord int"


@pytest.mark.parametrize("rest,rounds", [(0, 30), (0, 2), (15, 30), (1000, 30)])
def test_rounds_equal_the_plain_rule(spark, rest, rounds):
    rnd = random.Random(rest + rounds)

    def side(p, n):
        return [(f"d{rnd.randrange(2)}", rnd.choice("XY"), f"{p}{i}", s, s + rnd.choice((4, 5, 5, 6, 9)), i) for i, s in ((i, rnd.randrange(60)) for i in range(n))]

    users, gold = side("u", 160) + [("d0", "X", f"v{i}", 5, 10, 500 + i) for i in range(30)], side("g", 160) + [("d0", "X", f"h{i}", 5, 10, 500 + i) for i in range(20)]
    got = I.greedy_span_match(spark.createDataFrame(users, SPAN), spark.createDataFrame(gold, SPAN), large=3, rest=rest, rounds=rounds).collect()
    assert {(r.document_id, r.label, r.user_id, r.gold_id) for r in got} == greedy(users, gold) and len(got) == len(greedy(users, gold))


def test_one_long_chain(spark):
    """50,000 gold spans that touch one another, each user span shifted by one: one overlap cluster of 100,000 spans."""
    n = 50_000
    ids = spark.range(n)
    from pyspark.sql import functions as F

    def spans(p, shift):
        return ids.select(F.lit("d").alias("document_id"), F.lit("X").alias("label"), F.concat(F.lit(p), F.col("id").cast("string")).alias("ann_id"),
                          (F.col("id") * 10 + shift).cast("int").alias("start"), (F.col("id") * 10 + 10 + shift).cast("int").alias("end"), F.col("id").cast("int").alias("ord"))

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = I.greedy_span_match(spans("u", 1), spans("g", 0))
        assert out.count() == n and out.filter(F.substring("user_id", 2, 9) != F.substring("gold_id", 2, 9)).count() == 0
        assert sum(x > 0 for x in out.select("user_id").rdd.glom().map(len).collect()) > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
