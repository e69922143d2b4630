"""External answers for ungrounded claims: bounded batches, retries, and answers that are asked for once.

A request is named by the digest of its letter, category and value, so claims that ask the same of equal letters share
one answer, in this run and in later ones. Every answered batch is written to a journal in shared storage before its task
goes on; a task that runs again after a lost executor finds its batches there. A second copy of a task that runs beside
the first (speculation) may ask a batch twice; both write the same file and one answer counts.

Defined results: null categories and values count as empty text; a claim whose document has no letter asks with an
empty one. A batch that fails `attempts` times is halved until the requests that fail stand alone; those have status
`failed`, no answer, and are asked again in the next run. An answer of None is kept as an answer without text.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from goldmeter.functions.text import text_of
from goldmeter.session import ensure_checkpoint_dir

REQUEST = ["digest", "category", "value", "text"]
ANSWER = "digest string, answer string, status string"


def request_digest(text: Column, category: Column, value: Column) -> Column:
    """Name of a request; each part is hashed by itself, so parts can't run into one another."""
    parts = [F.sha2(text_of(c).cast("binary"), 256) for c in (text, category, value)]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def claim_requests(ungrounded: DataFrame, letters: DataFrame) -> DataFrame:
    """Claims (document_id, category, value, ...) with the digest of their request and their letter."""
    rows = ungrounded.join(letters.select("document_id", "text"), "document_id", "left")
    return rows.withColumn("digest", request_digest(F.col("text"), F.col("category"), F.col("value")))


def _filesystem(uri: str):
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _read(system, path: str) -> list | None:
    try:
        with system.open_input_stream(path) as f:
            return [json.loads(line) for line in f.read().decode().splitlines()]
    except FileNotFoundError:
        return None


def _write(system, path: str, rows: list[dict]) -> None:
    """A file appears whole: written under a name of its own beside the place, then moved there."""
    started = f"{path}.{uuid.uuid4().hex}.started"
    with system.open_output_stream(started) as f:
        f.write("".join(json.dumps(r) + "\n" for r in rows).encode())
    system.move(started, path)


def _asked(ask: Callable, batch: list[dict], attempts: int, pause: float) -> list[dict]:
    """Answers of a batch; what goes wrong is narrowed down to single requests."""
    for attempt in range(attempts):
        try:
            answers = list(ask(batch))
            if len(answers) != len(batch):
                raise ValueError(f"{len(answers)} answers to {len(batch)} requests")
            return [{"digest": r["digest"], "answer": a, "status": "answered"} for r, a in zip(batch, answers)]
        except Exception:  # noqa: BLE001 - the answerer is foreign code; a failure is a result here
            if attempt + 1 < attempts:
                time.sleep(pause * 2**attempt)
    if len(batch) == 1:
        return [{"digest": batch[0]["digest"], "answer": None, "status": "failed"}]
    middle = len(batch) // 2
    return _asked(ask, batch[:middle], attempts, pause) + _asked(ask, batch[middle:], attempts, pause)


def batches_of(rows: Iterator[dict], most: int, characters: int) -> Iterator[list[dict]]:
    """Consecutive rows, at most `most` of them and `characters` of letters; a longer letter is a batch by itself."""
    batch, size = [], 0
    for row in rows:
        length = len(row["text"] or "")
        if batch and (len(batch) >= most or size + length > characters):
            yield batch
            batch, size = [], 0
        batch.append(row)
        size += length
    if batch:
        yield batch


def answer_requests(requests: DataFrame, ask: Callable[[list[dict]], list], store: str, most: int = 64, characters: int = 1_000_000,
                    attempts: int = 3, pause: float = 0.5, partitions: int | None = None) -> DataFrame:
    """Ask for every request (digest, category, value, text) that `store` has no answer to; return (digest, answer, status).

    `ask` takes a list of dicts and returns one answer (text or None) for each. `store` is a folder that driver and
    executors share (a plain path or a URI that pyarrow knows); one writer at a time. The requests are fixed in a
    checkpoint first and sorted by digest in their partitions, so a repeated task forms the same batches.
    A task holds one batch; letters are never gathered beyond `characters`, except one longer letter by itself.
    """
    spark = requests.sparkSession
    ensure_checkpoint_dir(spark)
    known = stored_answers(spark, store)
    one = requests.select(*REQUEST).dropDuplicates(["digest"])
    open_ = one.join(known.filter("status = 'answered'").select("digest"), "digest", "left_anti")
    dealt = open_.repartition(partitions or int(spark.conf.get("spark.sql.shuffle.partitions")), "digest").sortWithinPartitions("digest")
    fixed = dealt.checkpoint()
    system, root = _filesystem(store)
    system.create_dir(f"{root}/journal", recursive=True)

    def work(frames):
        files, folder = _filesystem(store)
        rows = (row for frame in frames for row in frame.to_dict("records"))
        for batch in batches_of(rows, most, characters):
            name = hashlib.sha256("".join(r["digest"] for r in batch).encode()).hexdigest()
            path = f"{folder}/journal/{name}.json"
            done = _read(files, path)
            if done is None or any(r["status"] == "failed" for r in done):
                left = {r["digest"]: r for r in done or [] if r["status"] == "answered"}
                wanted = [r for r in batch if r["digest"] not in left]
                done = list(left.values()) + _asked(ask, wanted, attempts, pause)
                _write(files, path, done)
            yield pd.DataFrame([{"batch": name, "asked": len(batch)}])

    # the journal is the result; this small frame makes the tasks run and is counted, not gathered
    fixed.mapInPandas(work, "batch string, asked long").agg(F.sum("asked")).collect()
    return one.select("digest").join(stored_answers(spark, store), "digest")


def stored_answers(spark: SparkSession, store: str) -> DataFrame:
    """All answers of a store, one row per digest: folded ones and those of the journal; an answer goes before a failure."""
    system, root = _filesystem(store)
    kinds = {i.base_name: i for i in system.get_file_info(fs.FileSelector(root, allow_not_found=True))}
    found = []
    if "journal" in kinds:
        found.append(spark.read.schema(ANSWER).option("pathGlobFilter", "*.json").json(f"{store}/journal"))
    version = max((n for n in kinds if n.startswith("answers-")), default=None)
    if version is not None:
        found.append(spark.read.schema(ANSWER).parquet(f"{store}/{version}"))
    if not found:
        return spark.createDataFrame([], ANSWER)
    rows = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    best = F.max_by(F.struct("answer", "status"), F.struct((F.col("status") == "answered").alias("a"), F.coalesce("answer", F.lit("")).alias("b")))
    return rows.filter(F.col("digest").isNotNull()).groupBy("digest").agg(best.alias("_r")).select("digest", "_r.*")


def fold_journal(spark: SparkSession, store: str) -> None:
    """Put the answered rows of the journal into one new Parquet version, then drop the journal files that it holds.

    Only files that stood there at the start are dropped, and only after the version is whole; a fold that stops half-way
    loses nothing. Run it between rounds of questions, not during one. Earlier versions stay.
    """
    system, root = _filesystem(store)
    names = [i.path for i in system.get_file_info(fs.FileSelector(f"{root}/journal", allow_not_found=True)) if i.base_name.endswith(".json")]
    if not names:
        return
    versions = [i.base_name for i in system.get_file_info(fs.FileSelector(root)) if i.base_name.startswith("answers-")]
    number = max((int(v.split("-")[1]) for v in versions), default=0) + 1
    rows = stored_answers(spark, store).filter("status = 'answered'")
    started = f"{store}/started-{number:08d}"
    rows.write.mode("overwrite").parquet(started)
    system.move(f"{root}/started-{number:08d}", f"{root}/answers-{number:08d}")
    for path in names:
        system.delete_file(path)


def answered_claims(claims: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """Answers (digest, answer, status) back at their claims: (keys..., path, answer), as `grounding.apply_answers` takes them."""
    return claims.join(answers.filter("status = 'answered'"), "digest").select(*keys, "path", "answer")
