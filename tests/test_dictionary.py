"""Dictionary hits against a plain scan, with a dictionary of 100,000 surfaces."""

import random
import re

import pytest

from goldmeter.operators.dictionary import dictionary_hits, dictionary_names, longest_hits

WORD = re.compile(r"[^\W]+")


def slow(texts, known):
    """All hits and those that remain reading from the left; known: words -> (surface, concept)."""
    most = max((len(k.split(" ")) for k in known), default=0)
    every, kept = set(), set()
    for doc, text in texts:
        words = list(WORD.finditer(text or ""))
        low = [w.group().lower() for w in words]
        free = 0
        for i in range(len(words)):
            own = [(n, known[g]) for n in range(1, most + 1) if i + n <= len(words) and (g := " ".join(low[i: i + n])) in known]
            rows = [(doc, i, n, words[i].start(), words[i + n - 1].end(), *what) for n, what in own]
            every.update(rows)
            if rows and i >= free:
                kept.add(rows[-1])
                free = i + rows[-1][2]
    return every, kept


def frames(spark, texts, surfaces):
    return spark.createDataFrame(texts, "document_id int, text string"), spark.createDataFrame(surfaces, "surface string, concept string")


def check(spark, texts, surfaces):
    t, d = frames(spark, texts, surfaces)
    known = {}
    for s, c in sorted(surfaces, key=lambda x: (x[1], x[0])):
        words = " ".join(w.lower() for w in WORD.findall(s))
        if words:
            known.setdefault(words, (s, c))
    every, kept = slow(texts, known)
    hits = dictionary_hits(t, d)
    cols = ("document_id", "word_no", "n", "char_start", "char_end", "surface", "concept")
    assert {tuple(r[c] for c in cols) for r in hits.collect()} == every
    assert sorted(tuple(r[c] for c in cols) for r in longest_hits(hits).collect()) == sorted(kept)
    return len(every)


def test_small_and_odd(spark):
    surfaces = [("tonic clonic", "gtc"), ("Tonic-Clonic seizure", "gtc2"), ("clonic seizure disorder now", "x"), ("seizure", "s"), ("sodium valproate", "v"), ("valproate", "w"), ("!!", "none"), ("", "none"), ("tonic clonic", "zzz"), ("été", "fr")]
    texts = [(1, "A tonic-clonic seizure disorder now, seizures; seizure."), (2, None), (3, ""), (4, "...!"), (5, "Sodium  valproate\nsodium valproateX Été"), (6, "tonic clonic tonic clonic seizure disorder now seizure")]
    assert check(spark, texts, surfaces) > 5
    assert dictionary_hits(*frames(spark, texts, [("", "none")])).collect() == []


def test_large_dictionary(spark):
    rnd = random.Random(3)
    vocabulary = [f"{rnd.choice('abcdefgh')}{i}" for i in range(3000)]
    grams = {" ".join(rnd.choice(vocabulary) for _ in range(rnd.choice((1, 2, 2, 3, 3, 4)))) for _ in range(125_000)}
    texts = []
    pool = sorted(grams)
    for i in range(60):
        words = []
        for _ in range(rnd.randrange(150)):
            words += pool[rnd.randrange(len(pool))].split(" ") if rnd.random() < 0.3 else [rnd.choice(vocabulary)]
        texts.append((i, rnd.choice([" ", ", ", "\n"]).join(words)))
    assert len(pool) > 100_000 and check(spark, texts, [(g, f"c{n}") for n, g in enumerate(pool)]) > 3000


def test_names(spark):
    surfaces = spark.createDataFrame([("valproate", "v", 2), ("sodium valproate", "sv", 1), ("aa bb", "first", 0), ("bb cc", "second", 1)], "surface string, concept string, rank int")
    values = spark.createDataFrame([(1, "sodium valproate cr"), (2, "valproate"), (3, "other"), (4, None), (5, "aa bb cc"), (6, "valproate")], "i int, v string")
    got = {r["i"]: r["name"] for r in dictionary_names(values, "v", surfaces).collect()}
    assert got == {1: "sv", 2: "v", 3: "other", 4: None, 5: "first", 6: "v"}


@pytest.mark.parametrize("n", [400])
def test_chain_of_overlapping_hits(spark, n):
    surfaces = [("a b", "1"), ("b a", "2"), ("b a b", "3")]
    check(spark, [(1, " ".join("ab"[i % 2] for i in range(n)))], surfaces)
