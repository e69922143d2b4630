"""Response parsing, ragged tables, price lists, offsets and the run log on small hand-made input."""

from pyspark.sql import functions as F

from goldmeter.operators import costs, passages, payloads
from goldmeter.sources import markup
from goldmeter.streaming import run_log


def parse(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [(r["payload"], r["parse_success"], r["repair_attempted"], r["repair_succeeded"]) for r in payloads.parse_responses(df).orderBy("i").collect()]


def test_responses(spark):
    good = ['{"a":1}', '```json\n{"a":1}\n```', 'see {"a":1} there', '{"a":1,"a":2}', '{"a":"x\ny"}', '{"a":NaN}', "[1,2]", "7"]
    assert all(ok and not tried for _, ok, tried, _ in parse(spark, good))
    repaired = ['{"a":[1,2,],}', '{\\"a\\": 1}']
    assert [x[1:] for x in parse(spark, repaired)] == [(True, True, True)] * 2
    bad = ['{"a":1} and {"b":2}', '{"a":1},{"b":2}', '{"a":1}] or [{"b":2}', "{a", "plain words"]
    assert [x for x in parse(spark, bad)] == [(None, False, True, False)] * 5
    assert [x for x in parse(spark, ["", "  ", "null", None])] == [(None, False, False, False)] * 4


def test_event_lists(spark):
    texts = ['[{"a":1},{"b":2}]', 'x [1, 2] y', '{"items": [3]}', "[1] and [2]", "", '{"a": 1}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = [(r["events"], r["error"]) for r in payloads.parse_event_lists(df).orderBy("i").collect()]
    assert got == [('[{"a":1},{"b":2}]', None), ("[1, 2]", None), ("[3]", None), (None, "not parseable"), (None, "empty response"), (None, "not parseable")]


def test_ragged_rows(spark):
    text = 'a, b ,"c, ""d""\ne",\n' + ",".join(str(i) for i in range(200)) + '\n5" nail,x\n\nlast'
    rows = spark.createDataFrame([(text,)], "t string").select(F.posexplode(markup.split_rows(F.col("t"))).alias("row_no", "line"))
    got = [r["cells"] for r in markup.parse_markup_lines(rows).orderBy("row_no").collect()]
    assert got == [["a", "b", 'c, "d"\ne', ""], [str(i) for i in range(200)], ['5" nail', "x"], ["last"]]


def test_repeated_price(spark):
    calls = spark.createDataFrame([(1, "m", 1_000_000, 0)], "id int, model_label string, input_tokens long, output_tokens long")
    prices = spark.createDataFrame([("m", 1.0, 1.0), ("m", 2.0, 1.0)], "model_label string, input_per_million double, output_per_million double")
    assert [r["cost"] for r in costs.call_costs(calls, prices).collect()] == [2.0]


def test_offsets_of_a_long_line(spark):
    for n in (1, 63, 64, 65, 130, 16000):
        text = ". ".join(f"Seizure {i}" for i in range(n))
        df = spark.createDataFrame([("d", text)], "document_id string, text string")
        row = df.select(passages.sentence_spans(F.col("text")).alias("s"), passages.pattern_spans(F.col("text"), r"Seizure \d+").alias("p")).first()
        assert len(row["s"]) == len(row["p"]) == n
        assert all(text[x["char_start"]: x["char_end"]] == x["text"] for x in (row["s"][-1], row["p"][-1], row["p"][0]))


def test_compaction(spark, tmp_path):
    path = f"{tmp_path}/log"
    assert run_log.read_table(spark, path) is None and run_log.compact(spark, path) == 0
    merge = run_log.merge_batch(path, ["k"], "o", 4)
    for batch in range(3):
        merge(spark.createDataFrame([(k, batch * 10 + k, "x") for k in range(batch, batch + 5)], "k int, o int, v string"), batch)
    before = sorted((r["k"], r["o"]) for r in run_log.read_table(spark, path).collect())
    assert run_log.compact(spark, path) > 0 and run_log.compact(spark, path) == 0
    assert sorted((r["k"], r["o"]) for r in run_log.read_table(spark, path).collect()) == before
    assert before == [(0, 0), (1, 11), (2, 22), (3, 23), (4, 24), (5, 25), (6, 26)]


def test_nothing_may_follow_a_value(spark):
    bad = ['{"a":1}, 5] x {"b":2}', '{"a":1}} x {', '{"a":1}, "b":2, {"c":3}', '{"a":1} // {"b":2}']
    assert [x for x in parse(spark, bad)] == [(None, False, True, False)] * 4
    text = '{"t":"a: NaN, b \\" [NaN]","x":NaN,"y":[-Infinity,1]}'
    assert parse(spark, [text]) == [('{"t":"a: NaN, b \\" [NaN]","x":null,"y":[null,1]}', True, False, False)]
