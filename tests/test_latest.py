"""Keyed stream state: late rows, ties, replays, folding, and work in proportion to the batch."""

from goldmeter.streaming.latest import _versions, fold, latest_of, read_latest, run_latest

SCHEMA = "k string, o long, v string"


def test_stream(spark, tmp_path):
    log, table, state = (f"{tmp_path}/{x}" for x in ("log", "table", "state"))
    assert read_latest(spark, table, ["k"]) is None and fold(spark, table, ["k"]) == 0
    every = []

    def drop(rows):
        every.extend(rows)
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(log)
        query = run_latest(spark.readStream.schema(SCHEMA).json(log), table, state, ["k"], "o")
        got = {(r["k"], r["o"], r["v"]) for r in read_latest(spark, table, ["k"]).collect()}
        best = latest_of(spark.createDataFrame(every, SCHEMA), ["k"], "o")
        assert got == {(r["k"], r["o"], r["v"]) for r in best.collect()}
        return query

    drop([(f"k{i}", 10, "first") for i in range(300)])
    drop([("k1", 11, "newer"), ("k2", 9, "late"), ("k3", 10, "tie"), ("new", 1, "x"), (None, 5, "null key"), ("k4", None, "no order")])
    last = max(_versions(spark, table, "changes"))
    changes = spark.read.parquet(_versions(spark, table, "changes")[last])
    assert changes.count() <= 5 and not {"k9", "k4"} & {r["k"] for r in changes.collect()}
    before = sorted(map(str, read_latest(spark, table, ["k"]).collect()))
    rows = changes.collect()
    spark.createDataFrame(rows, changes.schema).write.mode("overwrite").parquet(f"{table}/changes/{last}")  # a replayed batch
    assert sorted(map(str, read_latest(spark, table, ["k"]).collect())) == before
    assert fold(spark, table, ["k"]) >= 2 and fold(spark, table, ["k"]) == 0
    assert sorted(map(str, read_latest(spark, table, ["k"]).collect())) == before
    drop([("k1", 12, "newest"), ("k2", 8, "late again"), ("k5", 10, "tie after folding")])
    assert len(_versions(spark, table, "base")) == 1
