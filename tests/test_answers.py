import hashlib
import os
import uuid

import pytest

from goldmeter.operators import answers as AN
from goldmeter.operators import grounding as G


def _stub(folder, fail_first=False, poison=None):
    """Answers with the letter's last word; leaves one file per call, named by what was asked."""
    def ask(batch):
        name = hashlib.sha256("".join(r["digest"] for r in batch).encode()).hexdigest()
        calls = [f for f in os.listdir(folder) if f.startswith(name + ".")]
        with open(f"{folder}/{name}.{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(r["digest"] for r in batch))
        if fail_first and not calls:
            raise RuntimeError("busy")
        if poison is not None and any(r["value"] == poison for r in batch):
            raise RuntimeError("poison")
        return [(r["text"] or "").split(" ")[-1] or None for r in batch]

    return ask


def _asked(folder):
    return [d for f in os.listdir(folder) for d in open(f"{folder}/{f}").read().split("\n")]


@pytest.fixture
def claims(spark):
    rows = [("A", f"d{i}", "p", "frequency", f"v{i % 10}") for i in range(40)] + [("B", f"d{i}", "p", "frequency", f"v{i % 10}") for i in range(40)]
    rows += [("A", "d0", "p2", None, None), ("A", "lost", "p", "eeg", "x"), ("A", "d0", "p3", "", "")]
    letters = [(f"d{i}", f"letter of number{i}") for i in range(40)]
    frame = spark.createDataFrame(rows, "system string, document_id string, path string, category string, value string")
    return AN.claim_requests(frame, spark.createDataFrame(letters, "document_id string, text string"))


def test_each_request_is_asked_once(spark, claims, tmp_path):
    calls, store = tmp_path / "calls", str(tmp_path / "store")
    calls.mkdir()
    got = AN.answer_requests(claims, _stub(str(calls)), store, most=7, partitions=3).collect()
    asked = _asked(str(calls))
    # 40 letters, one claim of null parts that equals one of empty parts, one claim without a letter
    assert len(asked) == len(set(asked)) == 42 == len(got) and {r.status for r in got} == {"answered"}
    assert all(len(open(calls / f).read().split("\n")) <= 7 for f in os.listdir(calls))
    back = AN.answered_claims(claims, spark.createDataFrame(got, AN.ANSWER), ["system", "document_id"])
    rows = {(r.system, r.document_id, r.path): r.answer for r in back.collect()}
    assert len(rows) == 83 and rows["B", "d7", "p"] == "number7" and rows["A", "lost", "p"] is None
    again = AN.answer_requests(claims, _stub(str(calls)), store, most=5, partitions=2)
    assert again.count() == 42 and len(_asked(str(calls))) == 42
    AN.fold_journal(spark, store)
    assert os.listdir(f"{store}/journal") == [] and AN.stored_answers(spark, store).count() == 42
    AN.answer_requests(claims, _stub(str(calls)), store)
    AN.fold_journal(spark, store)
    assert len(_asked(str(calls))) == 42 and AN.stored_answers(spark, store).count() == 42


def test_failures_are_tried_again_and_narrowed_down(spark, claims, tmp_path):
    calls, store = tmp_path / "calls", str(tmp_path / "store")
    calls.mkdir()
    got = AN.answer_requests(claims, _stub(str(calls), fail_first=True), store, most=50, pause=0.0, partitions=1).collect()
    assert {r.status for r in got} == {"answered"} and len(os.listdir(calls)) == 2
    other = str(tmp_path / "other")
    bad = AN.answer_requests(claims, _stub(str(calls), poison="v3"), other, most=50, attempts=1, pause=0.0, partitions=1).collect()
    assert sorted(r.status for r in bad) == ["answered"] * 38 + ["failed"] * 4
    before = len(_asked(str(calls)))
    mended = AN.answer_requests(claims, _stub(str(calls)), other, most=50, partitions=1).collect()
    assert {r.status for r in mended} == {"answered"} and len(_asked(str(calls))) == before + 4


def test_a_repeated_task_finds_its_batches(spark, claims, tmp_path):
    calls, store = tmp_path / "calls", str(tmp_path / "store")
    calls.mkdir()
    broken, inner = tmp_path / "broken", _stub(str(calls))

    def ask(batch):
        answers = inner(batch)
        if len(os.listdir(calls)) == 3 and not broken.exists():
            broken.write_text("")
            raise SystemExit("the worker is lost")
        return answers

    with pytest.raises(Exception):  # noqa: B017 - local mode doesn't repeat tasks, so the job is run again
        AN.answer_requests(claims, ask, store, most=7, partitions=1).count()
    assert AN.answer_requests(claims, ask, store, most=7, partitions=1).count() == 42
    asked = _asked(str(calls))
    # only the batch that was lost before it was stored is asked a second time
    assert len(set(asked)) == 42 and len(asked) == 49


def test_batches_are_bounded_and_empty_input_asks_nothing(spark, claims, tmp_path):
    rows = [{"text": "x" * n} for n in (3, 3, 9, 1, None or 0, 2)]
    assert [len(b) for b in AN.batches_of(iter(rows), 2, 6)] == [2, 1, 2, 1]
    out = AN.answer_requests(claims.limit(0), _stub(str(tmp_path)), str(tmp_path / "store"))
    assert out.count() == 0 and out.columns == ["digest", "answer", "status"]


def test_answers_reach_the_claims(spark, claims, tmp_path):
    (tmp_path / "calls").mkdir()
    answers = AN.answered_claims(claims, AN.answer_requests(claims, _stub(str(tmp_path / "calls")), str(tmp_path / "store")), ["system", "document_id"])
    grounded = claims.select("system", "document_id", "path").selectExpr("*", "CAST(NULL AS STRING) AS quote", "'ungrounded' AS grounded_by")
    letters = claims.select("document_id", "text").distinct()
    by = {r.grounded_by: r["count"] for r in G.apply_answers(grounded, answers, letters, ["system", "document_id"]).groupBy("grounded_by").count().collect()}
    assert by == {"fallback": 82, "ungrounded": 1}
