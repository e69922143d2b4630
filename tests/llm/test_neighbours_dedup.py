"""Neighbours and near-duplicates against brute force."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from goldmeter.llm import dedup, nearest


def brute_neighbours(rows, neighbours=20):
    """The contract on lists of (id, vector)."""
    out = {}
    for q, x in rows:
        if q % 20 == 0:
            near = sorted((-float((np.array(x) * np.array(y)).sum()), i) for i, y in rows if i != q)
            out[q] = [(i, -s) for s, i in near[:neighbours]]
    return out


def test_exact_on_a_small_table(spark):
    rnd = np.random.default_rng(1)
    rows = [(i, rnd.normal(size=5).tolist()) for i in range(120)]
    rows += [(i, rows[3][1]) for i in range(120, 190)]  # copies: ties by id
    odd = [(300, None), (320, [0.0] * 5), (340, [1.0, None, 0.0, 0.0, 0.0]), (360, [float("nan")] * 5), (380, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (400, [1.0, 2.0]), (420, []), (None, [1.0] * 5)]
    df = spark.createDataFrame(rows + odd + rows[:3], "vec_id long, embedding array<double>").withColumn("rank", F.lit(7)).withColumn("score", F.lit("x"))
    got = {}
    for r in nearest.search(df, F.col("id") % 20 == 0).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    want = brute_neighbours(rows)
    assert set(got) == set(want)
    for q, near in want.items():
        assert [got[q][k + 1][0] for k in range(20)] == [i for i, _ in near]
        assert np.allclose([got[q][k + 1][1] for k in range(20)], [s for _, s in near])


def test_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 3.0])], "vec_id long, embedding array<float>")
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in nearest.search(df, F.col("id") % 20 == 0).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]
    assert nearest.search(df.limit(0), F.col("id") % 20 == 0).count() == 0
    assert nearest.search(df.limit(1), F.col("id") % 20 == 0).count() == 0


def test_recall_with_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BUCKET", 16)
    monkeypatch.setattr(nearest, "BLOCK", 50)
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(2000, 16)) * rnd.uniform(0.2, 1.0, (2000, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in nearest.search(df, F.col("id") % 20 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = brute_neighbours(list(enumerate(x)))
    assert np.mean([len(got[q] & {i for i, _ in near}) / 20 for q, near in want.items()]) >= 0.9


@pytest.mark.parametrize("norms", ["one_long", "uneven"])
def test_recall_when_norms_differ(spark, norms):
    """Clustered vectors, one three times as long as the rest or all of uneven length."""
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(100, 64))[rnd.integers(0, 100, 10_000)] + 0.6 * rnd.normal(size=(10_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x *= rnd.uniform(0.3, 1.0, (10_000, 1)) if norms == "uneven" else np.where(np.arange(10_000) == 7, 3.0, 1.0)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    made = nearest.fit(df.select(F.col("vec_id").alias("rep"), F.col("embedding").alias("v")), 20, 0.96)
    assert made.offsets.shape[1] >= 2
    got = {}
    for r in nearest.search(df, F.col("id") % 20 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    asked = np.arange(0, 10_000, 20)
    near = x[asked] @ x.T
    near[np.arange(500), asked] = -np.inf
    want = np.argsort(-near, axis=1)[:, :20]
    assert np.mean([len(got[q] & set(w)) / 20 for q, w in zip(asked.tolist(), want.tolist())]) >= 0.95


def test_many_equal_scores_in_a_block(spark):
    """Binary vectors: far more of them than places share a score, the smallest ids count."""
    rnd = np.random.default_rng(6)
    rows = [(int(k), [float(b) for b in f"{i:010b}1"]) for i, k in enumerate(rnd.permutation(1024))]
    got = {}
    for r in nearest.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 20 == 0).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == brute_neighbours(rows)


def test_a_block_smaller_than_the_places():
    v = np.array([[1.0, 0.0], [0.0, 1.0], [1.0, 1.0]])
    score, ids = nearest.block_best(v[:1], v, np.array([9, 4, 2]), 21)
    assert ids.tolist() == [[2, 9, 4]] and score.tolist() == [[1.0, 1.0, 0.0]]


def test_probes_come_in_order_of_success():
    h = nearest.Hashes(np.eye(3)[None, :, :2], np.zeros((1, 2)), 1.0, 1.0, 0.8, 0.9)
    seen = []
    real, nearest.bucket_key = nearest.bucket_key, lambda slots: seen.append(slots) or real(slots)
    try:
        h._visit(np.array([0.3, -0.4]))
    finally:
        nearest.bucket_key = real
    edge = lambda s, c: (nearest._normal(np.array((s + 1) * nearest.WIDTH - c) / 0.8) - nearest._normal(np.array(s * nearest.WIDTH - c) / 0.8))
    chances = [float(edge(a, 0.3) * edge(b, -0.4)) for a, b in seen[0]]
    assert chances == sorted(chances, reverse=True) and sum(chances) >= 0.9 > sum(chances[:-1])


def slow_sets(plain):
    sets = []
    for _, t in plain:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset(map(tuple, [w])) if w else frozenset())
    return sets


def slow_components(plain):
    sets = slow_sets(plain)
    ids = [k for k, _ in plain]
    comp = list(range(len(plain)))

    def top(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(plain)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and ids[i] is not None and ids[j] is not None and 100 * len(a & b) >= 80 * len(a | b):
                comp[top(i)] = top(j)
    least = {}
    for i, k in enumerate(ids):
        if k is not None:
            least[top(i)] = min(k, least.get(top(i), k))
    return [(k, len(s), least[top(i)] if k is not None else None) for i, (k, s) in enumerate(zip(ids, sets))]


def as_rows(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


def test_near_duplicates_of_odd_rows(spark, odd_docs, plain, no_docs):
    got = dedup.near_duplicates(odd_docs)
    assert as_rows(got) == sorted(slow_components(plain), key=str)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.filter("doc_id IS NOT NULL").collect())
    assert dedup.near_duplicates(no_docs).count() == 0
    one = dedup.keep_one(odd_docs)
    assert one.columns == odd_docs.columns
    assert sorted(r["doc_id"] for r in one.filter("doc_id IS NOT NULL").collect()) == sorted({c for k, _, c in slow_components(plain) if k is not None})
    assert one.filter("doc_id IS NULL").count() == 2


def test_one_id_on_different_texts(spark):
    """Texts of one id are judged each by itself: unrelated ones all stay, a copy never takes a unique text's place."""
    one, two, three = (" ".join(f"{k}{i}" for i in range(30)) for k in "abc")
    rows = [(1, one), (5, one + " end"), (5, two), (5, three), (5, three.upper()), (6, two), (5, ""), (5, "")]
    got = dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"], r["text"].lower()) for r in got.collect()) == [(1, one), (5, ""), (5, two), (5, three)]


@pytest.mark.parametrize("small_blocks", [False, True])
def test_families_with_chains(spark, monkeypatch, small_blocks):
    """Copies edited step by step: many links just above and below the limit, chains, a large family."""
    if small_blocks:
        monkeypatch.setattr(dedup, "BLOCK", 8)
        monkeypatch.setattr(dedup, "BLOCK_SHINGLES", 400)
    rnd = np.random.default_rng(3)
    word = lambda: f"w{rnd.integers(0, 5000)}"
    rows = []
    for _ in range(6):
        text = [word() for _ in range(60)]
        for _ in range(25):
            edited = list(text)
            for at in rnd.choice(60, int(rnd.integers(0, 7)), replace=False):
                edited[at] = word()
            rows.append((int(rnd.permutation(10**6)[0]), " ".join(edited)))
            if rnd.random() < 0.3:
                text = edited
    assert as_rows(dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == sorted(slow_components(rows), key=str)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["cid"]: r["comp"] for r in dedup.connect(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert dedup.connect(edges.limit(0)).count() == 0
