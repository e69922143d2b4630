"""Runs against a brute force over all stretches, on random words of small alphabets and on odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from goldmeter.llm import queries, repeats


def slow_runs(words, least=12):
    """All maximal stretches with their smallest period, by definition."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        a = 0
        while a + q < n:
            b = a
            while b + q < n and words[b] == words[b + q]:
                b += 1
            if b + q - a >= max(least, 2 * q) and not any(all(words[i] == words[i + p] for i in range(a, b + q - p)) for p in range(1, q)):
                out.append((a, b + q - a, q))
            a = max(b, a + 1) if b > a else a + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def slow_collapse(words, runs):
    return [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]


def random_words(rnd):
    kind = rnd.randrange(6)
    letters = "abcd"[: rnd.choice((1, 2, 2, 3, 4))]
    if kind < 2:
        return [rnd.choice(letters) for _ in range(rnd.randrange(90))]
    if kind == 2:  # Fibonacci words: many overlapping runs
        x, y = ["a"], ["a", "b"]
        while len(y) < 80:
            x, y = y, y + x
        return y[: rnd.randrange(20, 90)]
    out = []
    while len(out) < 70:
        block = [rnd.choice(letters) for _ in range(rnd.randrange(1, 17))]
        out += (block * rnd.randrange(1, 8))[: rnd.randrange(1, 60)]
    return out


def test_runs_equal_brute_force():
    rnd = random.Random(5)
    texts = [random_words(rnd) for _ in range(1500)] + [["a"] * 300, ["a"] * 70 + ["b"] + ["a"] * 70 + ["b"] + ["a"] * 70, list("aaaabaa" * 4), [], ["x"]]
    for least in (2, 12):
        flat = np.array([ord(w) for t in texts for w in t], np.uint64)
        of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        first = np.cumsum([0, *map(len, texts)])
        start, length, period = repeats.word_runs(flat, of, least)
        got = [[] for _ in texts]
        for s, n, q in zip(start.tolist(), length.tolist(), period.tolist()):
            got[of[s]].append((s - int(first[of[s]]), n, q))
        for t, g in zip(texts, got):
            assert g == slow_runs(t, least), " ".join(t)


def test_few_steps_for_long_repeats():
    words = np.zeros(200_000, np.uint64)
    words[100_000] = 1
    start, length, period = repeats.word_runs(words, np.zeros(len(words), np.int64))
    assert list(zip(start.tolist(), length.tolist(), period.tolist())) == [(0, 100_000, 1), (100_001, 99_999, 1)]


def test_odd_rows(odd_docs, plain, no_docs):
    got = {(r["doc_id"], r["collapsed"], tuple(map(tuple, r["runs"]))) for r in repeats.find_runs(odd_docs).collect()}
    import re

    want = set()
    for doc_id, text in plain:
        words = re.findall("[^ \t-\r]+", text or "")
        if len(words) > 1000:
            continue
        runs = slow_runs(words)
        want.add((doc_id, " ".join(slow_collapse(words, runs)), tuple(runs)))
    assert want <= got and len(got) >= len(want)
    assert repeats.find_runs(no_docs).collect() == []


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_query_equals_brute_force(spark, folder):
    import re
    from pathlib import Path

    if not Path(folder).exists():
        pytest.skip("driver tables are not mounted")
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.QUERIES["op13_basic_factors"](spark, folder).collect()
    assert len(rows) == len(texts)
    checked = 0
    for r in rows:
        words = re.findall("[^ \t-\r]+", texts[r["doc_id"]] or "")
        if len(words) > 700:
            continue
        h = zlib.crc32(str(r["doc_id"]).encode())
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs = slow_runs(words)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(slow_collapse(words, runs)).encode()).hexdigest()
        checked += 1
    assert checked > 100
