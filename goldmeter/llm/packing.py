"""Packing as vector bin packing: pieces of documents go into sequences under limits on tokens, segments and loss-bearing tokens.

Sequences are filled one at a time by the dot-product heuristic: of all pieces that fit, take the one whose demand vector has the
largest inner product with what the sequence has left, each limit counted as 1. A sequence left open takes the head of a piece
too long for it. Each task packs the rows it scans, a window of pieces at a time, so nothing is shuffled; what remains at a
task's end goes into sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldmeter.llm import tokens

END = (2).to_bytes(4, "little")


@dataclass(frozen=True)
class Limits:
    """tokens: a power of two, the padded length. least_cut: a shorter head or rest is not cut off just to fill a sequence."""

    tokens: int = 4096
    segments: int = 256
    loss: int = 4096
    least_cut: int = 16


@dataclass
class Piece:
    """`size` ids of row `row` from `start` on; the first `unlearned` of them bear no loss."""

    row: int
    start: int
    size: int
    unlearned: int

    def cut(self, n: int) -> tuple[Piece, Piece]:
        head = min(n, self.unlearned)
        return Piece(self.row, self.start, n, head), Piece(self.row, self.start + n, self.size - n, self.unlearned - head)


def fill(pieces: list[Piece], limits: Limits, last: bool) -> tuple[list[list[Piece]], list[Piece]]:
    """Full sequences and the pieces left over. Unless `last`, the final sequence that has room is left over too."""
    full: list[list[Piece]] = []
    todo: list[Piece] = []
    for p in pieces:
        while p.size >= limits.tokens and min(p.size, limits.tokens) - p.unlearned <= limits.loss:
            head, p = p.cut(limits.tokens)
            full.append([head])
        while p.size > limits.tokens or p.size - p.unlearned > limits.loss:
            head, p = p.cut(min(limits.tokens, p.unlearned + limits.loss))
            todo.append(head)
        if p.size:
            todo.append(p)
    scale = np.array([1 / limits.tokens, 1 / limits.segments, 1 / limits.loss])
    demand = np.array([(p.size, 1, p.size - p.unlearned) for p in todo], float).reshape(-1, 3) * scale
    alive = np.ones(len(todo), bool)
    while alive.any():
        room, bin_ = np.ones(3), []
        while alive.any():
            fits = alive & (demand <= room + 1e-9).all(axis=1)
            if fits.any():
                i = int(np.argmax(np.where(fits, demand @ room, -1.0)))
                bin_.append(todo[i])
                room, alive[i] = room - demand[i], False
                continue
            tokens_left, loss_left = round(room[0] * limits.tokens), round(room[2] * limits.loss)
            i = int(np.argmax(np.where(alive, demand[:, 0], -1.0)))
            n = min(tokens_left, todo[i].unlearned + loss_left, todo[i].size - limits.least_cut)
            if n >= limits.least_cut and round(room[1] * limits.segments) >= 1:
                head, todo[i] = todo[i].cut(n)
                bin_.append(head)
                room = room - np.array([n, 1, n - head.unlearned]) * scale
                demand[i] = np.array([todo[i].size, 1, todo[i].size - todo[i].unlearned]) * scale
            break
        if alive.any() or last or room[0] * limits.tokens < limits.least_cut:
            full.append(bin_)
        else:
            return full, bin_
    return full, []


def powers_of_two(pieces: list[Piece]) -> list[list[Piece]]:
    """Sequences of falling power-of-two lengths that hold the pieces in order without padding."""
    out: list[list[Piece]] = []
    queue = pieces[::-1]
    total = sum(p.size for p in pieces)
    while total:
        room = 1 << (total.bit_length() - 1)
        total -= room
        row: list[Piece] = []
        while room:
            p = queue.pop()
            if p.size > room:
                p, rest = p.cut(room)
                queue.append(rest)
            row.append(p)
            room -= p.size
        out.append(row)
    return out


PIECE = "key {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, loss_tokens bigint"


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", prompt: str | None = None, limits: Limits = Limits(), with_ids: bool = False, window: int = 2048) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens, and `ids` if asked for.

    A document is its text's ids by the word vocabulary and id 2; `prompt`, the name of a column of instruction text, puts ids
    that bear no loss before it (the document's own ids bear it, and so does id 2). Every id is in exactly one piece. Null text
    counts as empty: one piece with id 2. Repeated rows are packed apart, other columns are not read, an empty table gives no
    rows. Memory per task: the encoder and a window of documents (`window` rows or 4M ids, and at least one document).
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens.word_encoder(path)
        sequence = TaskContext.get().partitionId() << 32
        keys: list = []
        held: list[bytes] = []
        open_: list[Piece] = []
        fresh, size = 0, 0
        key_type: pa.DataType | None = None

        def emit(sequences: list[list[Piece]]) -> pa.RecordBatch:
            nonlocal sequence
            rows = []
            for pieces in sequences:
                at = 0
                for p in pieces:
                    ids = memoryview(held[p.row])[4 * p.start: 4 * (p.start + p.size)]
                    rows.append((keys[p.row], p.start, p.size, zlib.crc32(ids), len(held[p.row]) // 4, sequence, at, p.size - p.unlearned, *([bytes(ids)] if with_ids else [])))
                    at += p.size
                sequence += 1
            cols = list(zip(*rows)) or [()] * (8 + with_ids)
            arrays = [pa.array(cols[0], key_type), *(pa.array(c, pa.int64()) for c in cols[1:8])]
            if with_ids:
                arrays.append(tokens.id_lists(list(cols[8])))
            return pa.RecordBatch.from_arrays(arrays, names=["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens", "ids"][: len(arrays)])

        def keep(left: list[Piece]) -> list[Piece]:
            """Drop documents that are packed."""
            rows = sorted({p.row for p in left})
            new = {r: i for i, r in enumerate(rows)}
            keys[:], held[:] = [keys[r] for r in rows], [held[r] for r in rows]
            return [Piece(new[p.row], p.start, p.size, p.unlearned) for p in left]

        for b in batches:
            key_type = b.schema.field(0).type
            for part in tokens.portions(b, 1):
                own = coder.encode(["" if t is None else t for t in part.column(1).to_pylist()])
                asked = coder.encode(["" if t is None else t for t in part.column(2).to_pylist()]) if prompt else [b""] * len(own)
                for k, before, ids in zip(part.column(0).to_pylist(), asked, own):
                    keys.append(k)
                    held.append(before + ids + END)
                    open_.append(Piece(len(held) - 1, 0, len(held[-1]) // 4, len(before) // 4))
                    fresh, size = fresh + 1, size + len(held[-1]) // 4
                    if fresh >= window or size >= 1 << 22:
                        done, left = fill(open_, limits, False)
                        yield emit(done)
                        open_ = keep(left)
                        fresh = size = 0
        if open_:
            done, left = fill(open_, limits, False)
            yield emit(done)
            yield emit(powers_of_two(left))

    columns = [F.col(key).alias("key"), F.col(text).alias("text"), *([F.col(prompt).alias("prompt")] if prompt else [])]
    return docs.select(*columns).mapInArrow(run, PIECE.format(kind=kind) + (", ids array<int>" if with_ids else "")).withColumnRenamed("key", key)
