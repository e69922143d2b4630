"""Token ids in binary shards with a minimal perfect hash index from document keys to places.

A shard is one file: 16 bytes of head, the raw ids of its documents one after another (16-bit if the vocabulary fits, else
32-bit, little-endian), the index, and a footer of fixed size. The index hashes keys level by level into bit fields; a key that
has a bit of a level to itself stays there, the others go on to the next. A key's number is the rank of its bit, so n keys have
the numbers below n; each number has the key's 64-bit fingerprint, its first record and how many records have that key. A look-up
costs one hash for each level (about two on average), one fingerprint and one record, however large the shard is.

Documents are dealt to tasks by key ranges and sorted there, so shards follow one another in ascending key order and each id's
place among all ids is its shard's base plus its place in the shard. Shards are named anew by every attempt of a task and known
only through rows of attempts that ended well; a lost executor leaves at most files that no row names.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from goldmeter.llm import tokens
from goldmeter.llm.words import mix

MAGIC = b"IDSHARD1"
HEAD, FOOTER = 16, 64
STEP = 0x9E3779B97F4A7C15


class PerfectHash:
    """Minimal perfect hash of distinct pairs of 64-bit hashes."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        """sizes: bits of each level, multiples of 64; bits: all levels' fields as 64-bit words."""
        self.sizes, self.bits = sizes.astype(np.int64), bits.astype(np.uint64)
        self.before = np.cumsum(self.sizes) - self.sizes
        counts = np.bitwise_count(self.bits).astype(np.int64)
        self.rank = np.cumsum(counts) - counts

    @staticmethod
    def _place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(a ^ mix(b + np.uint64(level * STEP % 2**64))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray, spare: float = 1.5) -> PerfectHash:
        sizes, fields = [], []
        while len(a):
            size = -(-max(64, int(spare * len(a))) // 64) * 64
            at = cls._place(a, b, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            fields.append(np.packbits(alone, bitorder="little").view("<u8"))
            rest = ~alone[at]
            if len(sizes) > 200:
                raise ValueError("two keys have one hash")
            a, b = a[rest], b[rest]
        return cls(np.array(sizes, np.int64), np.concatenate(fields) if fields else np.zeros(0, np.uint64))

    def numbers(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Each key's number; of a key it was not built for, any number or -1."""
        out = np.full(len(a), -1, np.int64)
        rows = np.arange(len(a))
        for level, size in enumerate(self.sizes.tolist()):
            at = self.before[level] + self._place(a[rows], b[rows], level, size)
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[rows[hit]] = (self.rank[at >> 6] + below)[hit]
            rows = rows[~hit]
            if not len(rows):
                break
        return out


def index_of(a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> tuple[bytes, bytes]:
    """Index and footer (less its place) of records in file order: hashes of their keys, equal keys side by side, and id counts."""
    fresh = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)]
    first = np.flatnonzero(fresh)
    own_a, own_b = a[first], b[first]
    table = PerfectHash.build(own_a, own_b)
    at = table.numbers(own_a, own_b)
    prints, start, copies = np.empty(len(first), "<u8"), np.empty(len(first), "<u4"), np.empty(len(first), "<u4")
    prints[at], start[at], copies[at] = own_b, first, np.diff(np.r_[first, len(a)])
    body = b"".join(x.tobytes() for x in (table.sizes.astype("<i8"), table.bits.astype("<u8"), prints, start, copies, np.cumsum(sizes).astype("<i8")))
    facts = np.array([len(a), len(first), int(sizes.sum()), len(table.sizes), len(table.bits), zlib.crc32(body)], "<i8").tobytes()
    return body, facts


class Shard:
    """An opened shard: its index in memory, its ids on storage."""

    def __init__(self, store: fs.FileSystem, path: str):
        self.file = store.open_input_file(path)
        end = self.file.size()
        foot = self._at(end - FOOTER, FOOTER)
        if foot[-8:] != MAGIC or self._at(0, 8) != MAGIC:
            raise ValueError(f"{path} is no id shard")
        self.records, self.keys, self.ids, levels, words, crc, place = np.frombuffer(foot[:56], "<i8").tolist()
        self.width = int.from_bytes(self._at(8, 4), "little")
        body = self._at(place, end - FOOTER - place)
        if zlib.crc32(body) != crc:
            raise ValueError(f"the index of {path} is damaged")
        at = 0

        def take(n: int, kind: str) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(body, kind, n, at)
            at += out.nbytes
            return out

        self.table = PerfectHash(take(levels, "<i8"), take(words, "<u8"))
        self.prints, self.first, self.copies = take(self.keys, "<u8"), take(self.keys, "<u4"), take(self.keys, "<u4")
        self.ends = np.r_[0, take(self.records, "<i8")]

    def _at(self, place: int, size: int) -> bytes:
        self.file.seek(place)
        return self.file.read(size)

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First record of each key and how many it has; -1 and 0 for keys that the shard lacks."""
        number = self.table.numbers(a, b)
        known = number >= 0
        known[known] = self.prints[number[known]] == b[known]
        first, copies = np.full(len(a), -1, np.int64), np.zeros(len(a), np.int64)
        first[known], copies[known] = self.first[number[known]], self.copies[number[known]]
        return first, copies

    def read(self, records: np.ndarray, most: int = 8 << 20) -> Iterator[tuple[int, np.ndarray]]:
        """Row and ids (32-bit) of the wanted records in file order; neighbours share a range read."""
        order = np.argsort(records, kind="stable").tolist()
        starts, ends = (HEAD + self.width * self.ends[records]).tolist(), (HEAD + self.width * self.ends[records + 1]).tolist()
        a = 0
        while a < len(order):
            b, lo, hi = a, starts[order[a]], ends[order[a]]
            while b < len(order) and starts[order[b]] <= hi and ends[order[b]] - lo <= max(most, hi - lo):
                hi = max(hi, ends[order[b]])
                b += 1
            ids = np.frombuffer(self._at(lo, hi - lo), f"<u{self.width}").astype("<u4")
            for i in order[a:b]:
                yield i, ids[(starts[i] - lo) // self.width: (ends[i] - lo) // self.width]
            a = b

    def close(self) -> None:
        self.file.close()


PLACE = "key {kind}, a bigint, b bigint, shard string, number bigint, copy bigint"


def write_shards(docs: DataFrame, folder: str, path: str, key: str = "doc_id", text: str = "text", end: int = 2, shard_ids: int = 1 << 24) -> DataFrame:
    """key, a, b (its hashes), shard, number (shards' order), copy: where each document lies.

    A document is its text's ids by the byte-level vocabulary and id `end`; a null text counts as empty. Documents stand in
    ascending key order (null first, equal keys by text hash); documents of one key are copies 0, 1, ... of it in their shard. An
    empty table writes nothing. `folder` is a URI on storage that all executors see; store the result at once, since another
    run would write new shards. Texts are shuffled once. Memory per task: the encoder, about 4 MB of texts or one, 48 bytes for
    each document of a shard (`shard_ids` ids and one document at most).
    """
    kind = docs.schema[key].dataType.simpleString()
    own = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(key).alias("a"), F.xxhash64(F.lit(7), key).alias("b"), F.xxhash64(text).alias("t"))
    own = own.repartitionByRange("key", "t").sortWithinPartitions("key", "t").select("key", "text", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens.byte_encoder(path)
        width = 2 if max(coder.machine.size, end + 1, *(i + 1 for i in coder.added.values())) <= 1 << 16 else 4
        store, base = fs.FileSystem.from_uri(folder)
        out, name, number, total = None, "", TaskContext.get().partitionId() << 32, 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]] = []

        def close() -> pa.RecordBatch:
            nonlocal out, number, total
            keys = pa.concat_arrays([h[0] for h in held])
            a, b, sizes = (np.concatenate([h[i] for h in held]) for i in (1, 2, 3))
            body, facts = index_of(a, b, sizes)
            out.write(body + facts + (HEAD + width * total).to_bytes(8, "little") + MAGIC)
            out.close()
            fresh = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
            copy = np.arange(len(a)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
            n = len(a)
            batch = pa.RecordBatch.from_arrays([keys, pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array([name] * n), pa.array(np.full(n, number)), pa.array(copy)], names=["key", "a", "b", "shard", "number", "copy"])
            held.clear()
            out, number, total = None, number + 1, 0
            return batch

        for batch in batches:
            for part in tokens.portions(batch, 1):
                ids, counts = coder.encode_flat(["" if t is None else t for t in part.column(1).to_pylist()])
                ids = np.insert(ids, np.cumsum(counts), end)
                counts = counts + 1
                a, b = (part.column(i).to_numpy().view(np.uint64) for i in (2, 3))
                ends = np.cumsum(counts)
                i = 0
                while i < len(counts):
                    before = int(ends[i - 1]) if i else 0
                    j = max(i + 1, int(np.searchsorted(ends, before + shard_ids - total, "right")))
                    if out is not None and total + int(ends[j - 1]) - before > shard_ids:  # not even one document more
                        yield close()
                        continue
                    if out is None:
                        store.create_dir(base, recursive=True)
                        name = f"{uuid.uuid4().hex}.ids"
                        out = store.open_output_stream(f"{base}/{name}")
                        out.write(MAGIC + width.to_bytes(8, "little"))
                    out.write(ids[before: int(ends[j - 1])].astype(f"<u{width}").tobytes())
                    held.append((part.column(0).slice(i, j - i), a[i:j], b[i:j], counts[i:j]))
                    total += int(ends[j - 1]) - before
                    i = j
        if out is not None:
            yield close()

    return own.mapInArrow(run, PLACE.format(kind=kind)).withColumnRenamed("key", key)


def catalogue(places: DataFrame, folder: str) -> DataFrame:
    """shard, number, documents, ids, base: what each shard's footer says, and how many ids stand before it. One row per shard: the
    running sum over all of them is small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        for b in batches:
            found = []
            for name in b.column(0).to_pylist():
                shard = Shard(store, f"{base}/{name}")
                found.append((shard.records, shard.ids))
                shard.close()
            if found:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x, pa.int64()) for x in zip(*found))], names=["shard", "number", "documents", "ids"])

    shards = places.groupBy("shard", "number").agg(F.count(F.lit(1)).alias("n")).select("shard", "number")
    facts = shards.mapInArrow(run, "shard string, number bigint, documents bigint, ids bigint")
    before = F.sum("ids").over(Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1))
    return facts.withColumn("base", F.coalesce(before, F.lit(0)))


def read_documents(places: DataFrame, folder: str, key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """key, number, at (ids before it in its shard), n_tokens, ids_crc32 and, if asked for, ids of the documents that `places` names:
    each is looked up by its key in its shard's index, then read. Rows of one shard side by side share its opening."""
    kind = places.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        opened: tuple[str, Shard] | None = None
        for batch in batches:
            names = batch.column(3).dictionary_encode()
            which = names.indices.to_numpy(zero_copy_only=False)
            for n, name in enumerate(names.dictionary.to_pylist()):
                if opened is None or opened[0] != name:
                    if opened is not None:
                        opened[1].close()
                    opened = name, Shard(store, f"{base}/{name}")
                shard = opened[1]
                part = batch.take(pa.array(np.flatnonzero(which == n)))
                first, copies = shard.find(*(part.column(i).to_numpy().view(np.uint64) for i in (1, 2)))
                copy = part.column(5).to_numpy()
                if (copy >= copies).any():
                    raise ValueError(f"{name} lacks a document that was written to it")
                record = first + copy
                crc = np.zeros(len(record), np.int64)
                lists: list[bytes] = [b""] * (len(record) if with_ids else 0)
                for i, ids in shard.read(record):
                    crc[i] = zlib.crc32(ids)
                    if with_ids:
                        lists[i] = ids.tobytes()
                arrays = [part.column(0), part.column(4), pa.array(shard.ends[record]), pa.array(shard.ends[record + 1] - shard.ends[record]), pa.array(crc)]
                if with_ids:
                    arrays.append(tokens.id_lists(lists))
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "number", "at", "n_tokens", "ids_crc32", "ids"][: len(arrays)])

    rows = places.select(F.col(key).alias("key"), "a", "b", "shard", "number", "copy")
    return rows.mapInArrow(run, f"key {kind}, number bigint, at bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")).withColumnRenamed("key", key)
