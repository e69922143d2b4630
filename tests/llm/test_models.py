"""Language, quality and language-model scores against slow versions, and on odd rows."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd

from goldmeter.llm import language, lm, quality

fold = lambda s: bytes(language.folded(s))


def slow_bits(texts, text, order, least, width):
    """Code length of a text symbol by symbol, from counts of contexts of up to `order` bytes."""
    counts = {}
    for t in map(fold, texts):
        for i, s in enumerate(t):
            for k in range(min(order, i) + 1):
                counts.setdefault(t[i - k: i], Counter())[s] += 1
    symbols = set(counts[b""])
    total = 0.0
    data = fold(text)
    for i, s in enumerate(data):
        s = s if s in symbols else None
        for k in range(min(order, i), -1, -1):
            c = counts.get(data[i - k: i])
            if c is None or (k and sum(c.values()) < least):
                continue
            t, d = sum(c.values()), len(c)
            if s in c:
                total += math.log2((t + d) / c[s])
                break
            total += math.log2((t + d) / d)
        else:
            total += math.log2(width)
    return total


def model_of(samples, order=3):
    counts = {k: language.count_contexts(v, order) for k, v in samples.items()}
    symbols = np.sort(pd.concat(counts.values()).query("k == 0")["code"].unique()).astype(np.int64)
    return language.Model(sorted(samples), symbols, [language.compile_tree(counts[k], symbols) for k in sorted(samples)], order)


def test_code_lengths_are_exact():
    samples = {"a": ["abracadabra abra cadabra", "bandana banana", "abra"], "b": ["the cat sat on the mat", "été à la mer"]}
    model = model_of(samples)
    texts = ["abracadabra", "the banana été", "", "zzz!", "abra " * 300 + "mat"]
    bits = model.code_lengths(texts)
    # symbols of the other language have no count in this one's empty context and fall to the uniform code
    for j, lang in enumerate(model.languages):
        for i, t in enumerate(texts):
            want = slow_bits(samples[lang], t, 3, language.LEAST, len(model.symbols) + 1)
            assert abs(bits[i, j] - want) < 1e-2 + 1e-5 * want, (lang, t[:20])


def test_languages_of_odd_rows(spark, odd_docs, plain, no_docs):
    model = language.train(odd_docs)
    rows = language.identify(odd_docs, model).collect()
    assert len(rows) == len(plain) and all(0 <= r["score"] <= 1 for r in rows)
    by = {r["doc_id"]: r["lang_pred"] for r in rows if r["doc_id"] is not None}
    assert all((by[k] == "und") == (not re.search(r"[^\W\d_]", t or "")) for k, t in plain if k is not None)
    nothing = language.train(no_docs)
    assert nothing.languages == [] and {r["lang_pred"] for r in language.identify(odd_docs, nothing).collect()} == {"und"}
    assert language.identify(no_docs, model).count() == 0 and language.keep_named(odd_docs, model).columns == odd_docs.columns


def test_languages_held_out(spark):
    en, de = "the of and to in that was for with this ".split(), "der die und das nicht ein ist von mit auf ".split()
    rnd = np.random.default_rng(5)
    rows = [(i, " ".join(rnd.choice(en if i % 2 else de, 12)), "en" if i % 2 else "de") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(df, language.train(df, 40)).collect()}
    assert all(got[i] == lang for i, _, lang in rows)


def test_quality_held_out(spark, odd_docs, plain, no_docs):
    rnd = np.random.default_rng(6)
    words = ["river", "stone", "of", "the", "house", "walks", "slowly", "green"]
    good = lambda: (" ".join(rnd.choice(words, 40)) + ". ").capitalize()
    bad = lambda: " ".join(w.upper() + "!!$$" for w in rnd.choice(words, 40))
    rows = [(i, good() if i % 4 else bad()) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 if i % 4 else 0, 0) for i in range(0, 400, 3)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    assert 0.6 < model.prior < 0.9
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    wrong = sum((got[i] >= quality.THRESHOLD) != (i % 4 > 0) for i, _ in rows)
    assert wrong <= 4
    kept = quality.keep_good(docs, model)
    assert {r["doc_id"] for r in kept.collect()} == {i for i in got if got[i] >= quality.THRESHOLD}
    odd = quality.score(odd_docs, model).collect()
    assert len(odd) == len(plain) and all(0 <= r["score"] <= 1 for r in odd) and quality.score(no_docs, model).count() == 0
    blank = quality.train(no_docs, labels.limit(0))
    assert {r["score"] for r in quality.score(odd_docs, blank).collect()} == {0.5}


def test_risk_stays_non_negative():
    rnd = np.random.default_rng(7)
    p, u = rnd.normal(2, 1, (30, 40)), rnd.normal(0, 1, (60, 40))
    w, b = quality.descend(p, u, 0.5)
    z_p, z_u = p @ w + b, u @ w + b
    assert quality._loss(-z_u).mean() - 0.5 * quality._loss(-z_p).mean() > -0.05
    assert abs(quality.estimate_prior(np.r_[rnd.normal(3, 1, 4000)], np.r_[rnd.normal(3, 1, 2800), rnd.normal(-3, 1, 1200)]) - 0.7) < 0.05


def slow_counts(plain):
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None] for _, t in plain]
    rest = [zlib.crc32(str(k).encode()) % 10 if k is not None else 1 for k, _ in plain]
    return tokens, rest


def test_language_model(spark, odd_docs, plain, no_docs, monkeypatch):
    whole = lm.score(odd_docs).collect()
    tokens, rest = slow_counts(plain)
    train = [t for t, r in zip(tokens, rest) if r != 0]
    uni = Counter(w for t in train for w in t)
    n, v = sum(uni.values()), len(uni)
    base = lambda t: sum(math.log10((uni[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
    want = sorted(((k is None, k or 0), r == 0, len(t), sum(uni[w] > 0 for w in t), n, round(base(t), 6)) for (k, _), t, r in zip(plain, tokens, rest))
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in whole) == want
    assert all(r["score"] < 0 for r in whole)
    monkeypatch.setattr(lm, "BLOCK_BYTES", 500)
    monkeypatch.setattr(lm, "SLICE_TOKENS", 200)
    parts = lm.score(odd_docs).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"])
    assert np.allclose([r["score"] for r in sorted(whole, key=key)], [r["score"] for r in sorted(parts, key=key)])
    assert lm.score(no_docs).count() == 0


def test_model_is_a_distribution_and_beats_words_alone():
    """The mixed probabilities of all words after a context sum to 1, and EM raises the held-out likelihood."""
    rnd = np.random.default_rng(8)
    bucket, r1, r2, n = rnd.integers(0, 3, 500), rnd.exponential(5, 500), rnd.exponential(50, 500) * (rnd.random(500) < 0.6), rnd.integers(1, 9, 500).astype(float)
    value = lambda w: (n * np.log((w[bucket] * np.stack([np.ones(500), r1, r2], 1)).sum(1))).sum()
    assert value(lm.em(bucket, r1, r2, n)) > value(lm.em(bucket, r1, r2, n, 1)) > value(lm.em(bucket, r1, r2, n, 0))
    assert np.allclose(lm.em(bucket, r1, r2, n)[:3].sum(axis=1), 1)
