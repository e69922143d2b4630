"""Language-model scores by deleted interpolation of bigram, unigram and uniform estimates.

P(w | h) = l2(b) c(h,w)/c(h) + l1(b) c(w)/N + l0(b)/(V+1), where b is the power of two below the context's count. The weights
of each b are learned by expectation-maximisation on documents kept apart from the counts they are mixed over (the deleted
part); the model then counts all training documents.

Counts of words and word pairs outgrow any one machine, so texts are cut into blocks of 4 MB. A block's distinct keys
(64-bit hashes) with its own counts go out in chunks to slices of the hash space; a slice adds the chunks up and answers the
blocks with the sums of keys that other blocks hold too. A block then knows all counts its tokens need. Blocks lie in shared
storage as files and are read by name, so texts are never shuffled; the number of slices follows the number of tokens.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from goldmeter.llm.common import remainder, shared_folder, stored
from goldmeter.llm.words import SECOND, mix, runs, word_hashes

BLOCK_BYTES = 4 << 20
SLICE_TOKENS = 1 << 20
EVALUATED, DELETED = 0, 1  # remainders: scored only; training, but held out from the counts when weights are learned
STEPS = 8  # histogram bins of component probabilities per factor of two
END = np.uint64(1)
WORDS, PAIRS = 0, 1


def _planes(x: np.ndarray) -> bytes:
    """Bytes of integers, most alike ones together."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def _small(x: np.ndarray) -> bytes:
    """Compressed planes, for integers that are mostly small: rows stay a few KB, and so do Arrow batches of many rows."""
    return zlib.compress(_planes(x), 1)


def _unsmall(data: bytes, kind: str) -> np.ndarray:
    return _unplanes(zlib.decompress(data), kind)


def _unplanes(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


@dataclass
class Block:
    """vocabulary: sorted word hashes; tokens: places in it, each document's closed by END; sizes: tokens per document."""

    vocabulary: np.ndarray
    tokens: np.ndarray
    sizes: np.ndarray
    rests: np.ndarray

    @staticmethod
    def of(texts: list[bytes], rests: list[int]) -> Block:
        tokens, sizes = [], []
        for part in runs(texts):
            words, first = word_hashes(part)
            tokens.append(np.insert(words, first[1:], END))
            sizes.append(np.diff(first) + 1)
        vocabulary, places = np.unique(np.concatenate(tokens), return_inverse=True)
        return Block(vocabulary, places.astype(np.uint32), np.concatenate(sizes).astype(np.uint32), np.array(rests, np.uint8))

    def pack(self) -> bytes:
        parts = [zlib.compress(_planes(x), 1) for x in (np.diff(self.vocabulary, prepend=np.uint64(0)), self.tokens, self.sizes, self.rests)]
        return np.array([len(p) for p in parts], "<u8").tobytes() + b"".join(parts)

    @staticmethod
    def unpack(data: bytes) -> Block:
        ends = 32 + np.cumsum(np.frombuffer(data[:32], "<u8")).astype(np.int64)
        parts = [zlib.decompress(data[a:b]) for a, b in zip([32, *ends], ends)]
        gaps, tokens, sizes, rests = (_unplanes(p, k) for p, k in zip(parts, ("u8", "u4", "u4", "u1")))
        return Block(np.cumsum(gaps, dtype=np.uint64), tokens, sizes, rests)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct pair hashes, each token's place among them, each token's context (END before the first)."""
        end = np.searchsorted(self.vocabulary, END)
        context = np.r_[end, self.tokens[:-1]].astype(np.int64)  # the token before a document's first is the last one's END
        keys, places = np.unique(mix(self.vocabulary[context] * SECOND + self.vocabulary[self.tokens]), return_inverse=True)
        return keys, places, context


def write_blocks(docs: DataFrame, folder: str, key: str, text: str, modulus: int) -> DataFrame:
    """block, tokens, ids (the documents' keys in order) for files written to `folder`."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        ids: list = []
        held: list[bytes] = []
        rests: list[int] = []
        size = 0

        def close() -> pa.RecordBatch:
            block, name = Block.of(held, rests), uuid.uuid4().hex
            store.create_dir(base, recursive=True)
            with store.open_output_stream(f"{base}/{name}") as out:
                out.write(block.pack())
            row = [pa.array([name]), pa.array([len(block.tokens)]), pa.array([ids], pa.list_(key_type))]
            for x in (ids, held, rests):
                x.clear()
            return pa.RecordBatch.from_arrays(row, names=["block", "tokens", "ids"])

        for b in batches:
            key_type = b.schema.field(0).type
            for k, t, r in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
                if held and size + len(raw) > BLOCK_BYTES:
                    yield close()
                    size = 0
                ids.append(k)
                held.append(raw)
                rests.append(r)
                size += len(raw)
        if held:
            yield close()

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), remainder(F.col(key), modulus).cast("int").alias("rest"))
    return stored(rows.mapInArrow(run, f"block string, tokens bigint, ids array<{kind}>"), "lm-blocks")


def _load(folder: str):
    store, base = fs.FileSystem.from_uri(folder)

    def load(name: str) -> Block:
        with store.open_input_stream(f"{base}/{name}") as f:
            return Block.unpack(f.read())

    return load


def _cuts(keys: np.ndarray, slices: int) -> np.ndarray:
    """Where each slice of the hash space begins in sorted keys, and their end."""
    edges = np.arange(1, slices, dtype=np.uint64) * np.uint64(2**64 // slices)
    return np.r_[0, np.searchsorted(keys, edges), len(keys)]


def count(index: DataFrame, folder: str, slices: int) -> DataFrame:
    """Chunks of each block's keys: kind, slice, block, keys, kept, deleted (counts of training tokens), as packed integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load = _load(folder)
        for name in (x for b in batches for x in b.column(0).to_pylist()):
            block = load(name)
            rest = np.repeat(block.rests, block.sizes)
            keys, places, _ = block.pairs()
            for kind, key, place in ((WORDS, block.vocabulary, block.tokens), (PAIRS, keys, places)):
                kept = np.bincount(place[rest > DELETED], minlength=len(key)).astype(np.uint32)
                deleted = np.bincount(place[rest == DELETED], minlength=len(key)).astype(np.uint32)
                cuts = _cuts(key, slices)
                spans = [(i, a, b) for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if b > a]
                yield pa.RecordBatch.from_arrays([
                    pa.array([kind] * len(spans), pa.int32()), pa.array([i for i, _, _ in spans], pa.int32()), pa.array([name] * len(spans)),
                    pa.array([_planes(np.diff(key[a:b], prepend=np.uint64(0))) for _, a, b in spans], pa.binary()),
                    *(pa.array([_small(x[a:b]) for _, a, b in spans], pa.binary()) for x in (kept, deleted))],
                    names=["kind", "slice", "block", "keys", "kept", "deleted"])

    return index.select("block").mapInArrow(run, "kind int, slice int, block string, keys binary, kept binary, deleted binary")


def answer(chunks: DataFrame, slices: int) -> DataFrame:
    """Sums of a slice's chunks. For every block: kind, slice, block, at (gaps between places in the block's chunk), kept, deleted of keys other
    blocks hold too; and one row without block per slice and kind whose arrays are the sums (tokens kept, tokens deleted) and `at`
    the numbers of distinct keys that are kept and that are counted at all."""

    def add(kind: int, part: int, rows: list[tuple]) -> pa.RecordBatch:
        keys = [np.cumsum(_unplanes(k, "u8"), dtype=np.uint64) for _, k, _, _ in rows]
        every, place = np.unique(np.concatenate(keys), return_inverse=True)
        holders = np.bincount(place, minlength=len(every))
        kept, deleted = (np.bincount(place, np.concatenate([_unsmall(r[i], "u4") for r in rows]), len(every)).astype(np.uint64) for i in (2, 3))
        out, start = [(None, np.array([(kept > 0).sum(), (kept + deleted > 0).sum()], np.uint32), kept.sum(keepdims=True), deleted.sum(keepdims=True))], 0
        for (name, *_), k in zip(rows, keys):
            own = place[start: start + len(k)]
            at = np.flatnonzero(holders[own] > 1)
            if len(at):
                out.append((name, np.diff(at, prepend=0).astype(np.uint32), kept[own[at]], deleted[own[at]]))
            start += len(k)
        return pa.RecordBatch.from_arrays([
            pa.array([kind] * len(out), pa.int32()), pa.array([part] * len(out), pa.int32()), pa.array([r[0] for r in out], pa.string()),
            *(pa.array([_small(r[i]) for r in out], pa.binary()) for i in (1, 2, 3))], names=["kind", "slice", "block", "at", "kept", "deleted"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: tuple[int, int] | None = None
        rows: list[tuple] = []
        for b in batches:
            for kind, part, *row in zip(*(c.to_pylist() for c in b.columns)):
                if group not in (None, (kind, part)):
                    yield add(*group, rows)
                    rows = []
                group = (kind, part)
                rows.append(tuple(row))
        if group:
            yield add(*group, rows)

    dealt = chunks.repartition(slices, "kind", "slice").sortWithinPartitions("kind", "slice")
    return dealt.mapInArrow(run, "kind int, slice int, block string, at binary, kept binary, deleted binary")


def _per_block(index: DataFrame, answers: DataFrame, folder: str, slices: int, tasks: int, schema: str, work) -> DataFrame:
    """`work(block, ids, counts)` for every block; counts: per kind the kept and deleted totals of its keys, beside pairs()."""
    asked = answers.filter("block IS NOT NULL").select("block", F.lit(1).alias("is_answer"), "kind", "slice", "at", "kept", "deleted", F.lit(None).cast(index.schema["ids"].dataType).alias("ids"))
    heads = index.select("block", F.lit(0).alias("is_answer"), F.lit(0).alias("kind"), F.lit(0).alias("slice"), *(F.lit(None).cast("binary").alias(c) for c in ("at", "kept", "deleted")), "ids")
    rows = heads.unionByName(asked).repartition(tasks, "block").sortWithinPartitions("block", "is_answer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load = _load(folder)
        state: list = []

        def begin(name: str, ids: list) -> None:
            block = load(name)
            rest = np.repeat(block.rests, block.sizes)
            keys, places, context = block.pairs()
            sums, cuts = [], []
            for key, place in ((block.vocabulary, block.tokens), (keys, places)):
                sums.append([np.bincount(place[which], minlength=len(key)).astype(float) for which in (rest > DELETED, rest == DELETED)])
                cuts.append(_cuts(key, slices))
            state[:] = [block, ids, places, context, sums, cuts]

        def end() -> pa.RecordBatch:
            block, ids, places, context, sums, _ = state
            return work(block, ids, places, context, sums)

        for b in batches:
            for row in range(b.num_rows):
                name, is_answer, kind, part, at, kept, deleted, ids = (c[row].as_py() for c in b.columns)
                if not is_answer:
                    if state:
                        yield end()
                    begin(name, ids)
                    continue
                where = state[5][kind][part] + np.cumsum(_unsmall(at, "u4"), dtype=np.int64)
                state[4][kind][0][where] = _unsmall(kept, "u8")
                state[4][kind][1][where] = _unsmall(deleted, "u8")
        if state:
            yield end()

    return rows.mapInArrow(run, schema)


def frequency_bucket(c: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + the power of two below its count."""
    return np.where(c > 0, np.floor(np.log2(np.maximum(c, 1))) + 1, 0).astype(np.int64)


def em(bucket: np.ndarray, r1: np.ndarray, r2: np.ndarray, n: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Weights [bucket, (uniform, unigram, bigram)] from n held-out events with component probabilities 1 : r1 : r2."""
    weights = np.tile([0.1, 0.4, 0.5], (64, 1))
    weights[0] = [0.1, 0.9, 0.0]
    p = np.stack([np.ones(len(n)), r1, r2], axis=1)
    for _ in range(rounds):
        share = weights[bucket] * p
        share *= (n / share.sum(axis=1))[:, None]
        got = np.stack([np.bincount(bucket, share[:, i], 64) for i in range(3)], axis=1) + np.array([1e-3, 0, 0])
        weights = np.where(got.sum(axis=1, keepdims=True) > 1, got / got.sum(axis=1, keepdims=True), weights)
    return weights


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", modulus: int = 10) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score, weight_buckets for every row.

    Rows whose crc32(key as text) mod `modulus` is 0 are only scored. Null text counts as empty: one END token. Repeated rows
    count and are scored each; other columns are not read. Without training tokens every token has the uniform probability.
    """
    kind, key_type = docs.schema[key].dataType.simpleString(), to_arrow_type(docs.schema[key].dataType)
    folder = shared_folder(docs.sparkSession, "lm-files")
    index = write_blocks(docs, folder, key, text, modulus)
    tokens, tasks = index.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.greatest(F.count(F.lit(1)), F.lit(1))).first()
    slices = 1 << max(4, (tokens // SLICE_TOKENS).bit_length())
    dealt = index.select("block").repartition(tasks, "block")
    answers = stored(answer(count(dealt, folder, slices), slices), "lm-answers")

    totals = {c: 0 for c in ("kept", "deleted", "v_kept", "v_all")}

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, kept, deleted = (c.to_pylist() for c in b.columns)
            yield pa.RecordBatch.from_arrays([
                pa.array([int(_unsmall(x, "u4")[0]) for x in at], pa.int64()), pa.array([int(_unsmall(x, "u4")[1]) for x in at], pa.int64()),
                pa.array([int(_unsmall(x, "u8")[0]) for x in kept], pa.int64()), pa.array([int(_unsmall(x, "u8")[0]) for x in deleted], pa.int64())], names=["v_kept", "v_all", "kept", "deleted"])

    got = answers.filter(f"block IS NULL AND kind = {WORDS}").select("at", "kept", "deleted").mapInArrow(numbers, "v_kept bigint, v_all bigint, kept bigint, deleted bigint")
    totals = {k: v or 0 for k, v in got.agg(*(F.sum(c).alias(c) for c in totals)).first().asDict().items()}
    n_kept, v_kept = max(1, totals["kept"]), totals["v_kept"]
    n, v = totals["kept"] + totals["deleted"], totals["v_all"]

    def histogram(block: Block, ids: list, places: np.ndarray, context: np.ndarray, sums: list) -> pa.RecordBatch:
        mine = np.repeat(block.rests, block.sizes) == DELETED
        word, before, pair = block.tokens[mine], context[mine], places[mine]
        c_word, c_before, c_pair = sums[WORDS][0][word], sums[WORDS][0][before], sums[PAIRS][0][pair]
        bins = [np.where(x > 0, np.round(np.log2(np.maximum(x, 1e-30)) * STEPS), -9999).astype(np.int64) for x in (c_word / n_kept * (v_kept + 1), c_pair / np.maximum(c_before, 1) * (v_kept + 1))]
        rows, times = np.unique(np.stack([frequency_bucket(c_before), *bins], axis=1), axis=0, return_counts=True)
        return pa.RecordBatch.from_arrays([*(pa.array(rows[:, i]) for i in range(3)), pa.array(times)], names=["bucket", "q1", "q2", "n"])

    events = _per_block(index, answers, folder, slices, tasks, "bucket bigint, q1 bigint, q2 bigint, n bigint", histogram)
    events = events.groupBy("bucket", "q1", "q2").agg(F.sum("n").alias("n")).toPandas()  # bounded by the number of bins
    value = lambda q: np.where(q == -9999, 0.0, np.exp2(q / STEPS))
    weights = em(events["bucket"].to_numpy(np.int64), value(events["q1"].to_numpy(float)), value(events["q2"].to_numpy(float)), events["n"].to_numpy(float))

    def judge(block: Block, ids: list, places: np.ndarray, context: np.ndarray, sums: list) -> pa.RecordBatch:
        words, pairs = sums[WORDS][0] + sums[WORDS][1], sums[PAIRS][0] + sums[PAIRS][1]
        c_word, c_before, c_pair = words[block.tokens], words[context], pairs[places]
        w = weights[frequency_bucket(words)][context]
        p = w[:, 0] / (v + 1) + w[:, 1] * c_word / max(1, n) + w[:, 2] * c_pair / np.maximum(c_before, 1)
        if not n:
            p = np.full(len(p), 1 / (v + 1))
        base = np.log10((c_word + 0.1) / (n + 0.1 * (v + 1)))
        first = np.r_[0, np.cumsum(block.sizes)[:-1]].astype(np.int64)
        add = lambda x: np.add.reduceat(x, first)  # noqa: E731  no document is without tokens
        return pa.RecordBatch.from_arrays([
            pa.array(ids, key_type), pa.array(block.rests == EVALUATED), pa.array(block.sizes.astype(np.int64)), pa.array(add((c_word > 0).astype(np.int64))),
            pa.array(np.full(len(first), n, np.int64)), pa.array(add(base)), pa.array(add(np.log10(p)))], names=["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = f"key {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return _per_block(index, answers, folder, slices, tasks, schema, judge).withColumnRenamed("key", key)
