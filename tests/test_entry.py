"""The driver contract: every oracle belongs to a query, and a sample of queries agrees with SQL."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from verify.check import TABLES, rows_of  # noqa: E402

SF = "/root/testdata/sf0.001"
SAMPLE = ["label_precision_recall", "class_report", "annotation_conflict_counts", "table_offset_issues", "quality_cost_frontier", "exact_bootstrap",
          "sign_flip_test", "ranked_event_selection", "event_decision_log", "fixed_splits", "streamed_parse_health", "sentence_spans", "verifier_decisions"]


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 150


@pytest.mark.skipif(not Path(SF).exists(), reason="driver tables are not mounted")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = entry.queries()[name](spark, SF)
    rel = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in rel.description]
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, rel.fetchall())


def test_frontier_equals_brute_force(spark):
    import random

    from goldmeter.operators.statistics import cost_frontier

    rnd = random.Random(5)
    rows = [(i, rnd.randrange(40), float(rnd.randrange(40))) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, q int, c double")
    want = {a[0] for a in rows if not any(b[1] >= a[1] and b[2] <= a[2] and (b[1] > a[1] or b[2] < a[2]) for b in rows)}
    assert {r.i for r in cost_frontier(df, "q", "c", cuts=7).collect()} == want
