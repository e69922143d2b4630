import random

import pytest

WORDS = ["the", "of", "and", "Stone", "river,", "house.", "été", "über", "niño", "x|y", "42", "a", "It's", "zz\x1cq"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows, equal texts, odd characters, and columns whose names operators use."""
    rnd = random.Random(3)
    text = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n))
    base = text(60)
    texts = [None, "", "   ", "\n", "one", "One", "!!! ### 123", "日本語 テキスト 🙂", "<|endoftext|> a <|endoftext|>", "a  b\n\n c\t d \n", "x" * 3000, text(20000), base, base, base + " tail", base.replace("the", "THE"), text(80), text(80), "é ́a", "ΟΔΟΣ İx"]
    rows = [(i, t, "en" if i % 3 else None, "s", 1, i, 0, "k", 2.0) for i, t in enumerate(texts)]
    rows += [rows[12], (None, "no id here", "en", "s", 1, 0, 0, "k", 2.0), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key long, node long, digest string, score double")


@pytest.fixture(scope="session")
def plain(odd_docs):
    return [(r["doc_id"], r["text"]) for r in odd_docs.collect()]


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
