"""Overlap flags: small groups inside the group, large ones by joins, both against brute force; rows are shuffled once."""

import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from goldmeter.operators import intervals as I
from verify import match_queries as MQ
from verify.base import ORACLES

EVIDENCE = "id int, k string, t int, char_start int, char_end int, quote_norm string, placed boolean"
GOLD = "k string, t int, start int, end int, value_norm string"


def odd_sides():
    rnd = random.Random(5)
    word = lambda: rnd.choice((None, "", "a", "ab", "abc", "b c", "cab", "zz"))
    key = lambda: (rnd.choice((None, "hot", "hot", "hot", "w", "x", "y")), rnd.choice((None, 1, 1, 1)))

    def span(gap):
        start = rnd.randrange(0, 4000, 7)
        return [None if rnd.random() < gap else at for at in (start, start + rnd.choice((-2, 0, 1, 3, 300)))]

    evidence = [(i, *key(), *span(0.2), word(), i % 3 != 0) for i in range(400)] + [(400, "hot", 1, 3, 9, "a", None)]
    gold = [(*key(), *span(0.02), word()) for _ in range(60)] + [("y", 1, None, None, "q"), ("z", 1, 0, 9, "a")]
    gold += [("w", 1, 3000, None, None), ("x", 1, None, 700, "x")]
    return evidence, gold


def mixed(spark, evidence, gold):
    gold = spark.createDataFrame(gold, GOLD).select("k", "t", F.struct("start", "end", "value_norm").alias("gold"))
    return spark.createDataFrame(evidence, EVIDENCE).unionByName(gold, allowMissingColumns=True)


def brute(evidence, gold):
    def meets(e, g):
        _, k, t, start, end, quote, placed = e
        if k is None or t is None or (k, t) != g[:2]:
            return False
        if placed:
            starts, ends = ([x for x in two if x is not None] for two in ((start, g[2]), (end, g[3])))
            return bool(starts and ends) and max(starts) < min(ends)
        return bool(quote) and g[4] is not None and (quote in g[4] or g[4] in quote)

    return {e[0]: any(meets(e, g) for g in gold) for e in evidence}


@pytest.mark.parametrize("most_rows, most_chars", [(256, 65_536), (40, 65_536), (256, 20), (0, 0)])
def test_flags_equal_brute_force_in_groups_and_by_joins(spark, most_rows, most_chars):
    evidence, gold = odd_sides()
    want = brute(evidence, gold)
    assert 20 < sum(want.values()) < 380
    out = I.mark_overlaps(mixed(spark, evidence, gold), ["k", "t"], most_rows, most_chars)
    assert out.columns == ["id", "k", "t", "char_start", "char_end", "quote_norm", "placed", "overlaps_gold"]
    got = [(r.id, r.overlaps_gold) for r in out.select("id", "overlaps_gold").collect()]
    assert len(got) == len(evidence) and dict(got) == want


def test_many_large_keys_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(I, "BROADCAST_KEYS", 0)
    evidence, gold = odd_sides()
    out = I.mark_overlaps(mixed(spark, evidence, gold), ["k", "t"], 40)
    assert {r.id: r.overlaps_gold for r in out.collect()} == brute(evidence, gold)


def test_two_sides_are_placed_by_their_offsets(spark):
    evidence = [(*e[:6], e[3] is not None and e[4] is not None) for e in odd_sides()[0]]
    gold = odd_sides()[1]
    ev = spark.createDataFrame(evidence, EVIDENCE).drop("placed")
    out = I.overlap_flags(ev, spark.createDataFrame(gold, GOLD), ["k", "t"])
    assert out.columns == [*ev.columns, "overlaps_gold"] and out.schema[:-1] == ev.schema
    assert {r.id: r.overlaps_gold for r in out.collect()} == brute(evidence, gold)


def test_missing_columns_of_order_lines_count_as_in_sql(spark, tmp_path):
    """Nulls stand last in the numbering of lines, and a span without a bound is tested by the bounds there are."""
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    some = F.abs(F.xxhash64("l_extendedprice"))
    lines.withColumns({"l_partkey": F.when(some % 5 != 0, F.col("l_partkey")), "l_quantity": F.when(some % 5 != 1, F.col("l_quantity")),
                       "l_returnflag": F.when(some % 7 != 2, F.col("l_returnflag")), "l_orderkey": F.when(some % 11 != 3, F.col("l_orderkey"))}
                      ).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = [tuple(r) for r in MQ.evidence_gold_overlap(spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert Counter(got) == Counter(con.execute(ORACLES["evidence_gold_overlap"]).fetchall())


def test_order_lines_are_shuffled_once(spark):
    """Numbering deals the lines by order; evidence, gold, intervals and quotes need no further exchange and nothing derived is sent."""
    plan = MQ.evidence_gold_overlap(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    below = plan[plan.index("Exchange hashpartitioning"):]
    assert "label" not in below and "char_start" not in below
