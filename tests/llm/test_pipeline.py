"""The pipeline's stages take effect one after another; queries and oracles are registered."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402
from goldmeter.llm import packing  # noqa: E402
from verify.check import TABLES, rows_of  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_registered():
    names = entry.queries()
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11)) and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "language_id", "near_duplicates", "packing"]


@pytest.mark.skipif(not Path(SF).exists(), reason="driver tables are not mounted")
@pytest.mark.parametrize("name", ["op7_minhash_components", "op9_licence_digests"])
def test_query_equals_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = entry.queries()[name](spark, SF)
    rel = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in rel.description]
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, rel.fetchall())


def test_near_duplicate_stage_takes_five_words(spark):
    """Against brute force: texts edited step by step, some alike on two words only, some shorter than a shingle."""
    rnd = __import__("random").Random(7)
    word = lambda: f"w{rnd.randrange(5000)}"
    rows = []
    for _ in range(8):
        text = [word() for _ in range(60)]
        for _ in range(12):
            edited = list(text)
            for at in rnd.sample(range(60), rnd.randrange(5)):
                edited[at] = word()
            rows.append((len(rows), " ".join(edited)))
    rows += [(200 + i, t) for i, t in enumerate(["a b c", "a b c", "a b", "a b c d", "b c d a", "a", "A", "", None, "a b c d e"])]

    def sets(width):
        words = [(t or "").lower().split() for _, t in rows]
        return [{tuple(w[i: i + width]) for i in range(max(1, len(w) - width + 1))} if w else set() for w in words]

    def winners(width):
        own, comp = sets(width), list(range(len(rows)))
        for i in range(len(rows)):
            for j in range(i):
                if own[i] and own[j] and 100 * len(own[i] & own[j]) >= 80 * len(own[i] | own[j]) and comp[i] != comp[j]:
                    comp = [comp[j] if c == comp[i] else c for c in comp]
        least = {}
        for (k, _), c in zip(rows, comp):
            least[c] = min(k, least.get(c, k))
        return sorted(least.values())

    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(r["doc_id"] for r in corpus_pipeline.one_of_each(spark, docs, "").collect())
    assert got == winners(5) != winners(2)


def test_stages(spark, tmp_path):
    rnd = __import__("random").Random(4)
    words = "the river of stone and a house with green doors near that old mill".split()
    rows = []
    for i in range(120):
        text = " ".join(rnd.choice(words) for _ in range(60)) + "."
        rows.append((i, text.upper().replace(" ", "!!$$ ") if i % 5 == 0 else text, "en", "s", 1))
    rows += [(200, rows[1][1], "en", "s", 1), (201, rows[1][1] + " end", None, "s", 1), (202, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(0, 120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept
        kept = stage(spark, before, str(tmp_path))
        assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} <= {r["doc_id"] for r in before.collect()}
    ids = {r["doc_id"] for r in kept.collect()}
    assert not ids & {0, 5, 10, 200, 201, 202} and {1, 2, 3, 4} <= ids
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == ids and max(r["offset"] + r["length"] for r in packed) <= packing.Limits().tokens
