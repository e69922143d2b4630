"""Language identification by prediction by partial matching.

Every language has a variable-order context tree over bytes with symbol counts. A symbol's code length in a context it was seen
in is log2((T + D) / c): T symbols in all, D different ones, c times this one. Otherwise an escape, log2((T + D) / D), is paid and
the next shorter context asked, down to a uniform code. Statistics are frozen, so state and symbol fix the code length: a tree
compiles into a table of next states and costs, and a text is scored exactly by walking it. The language with the shortest code
is predicted.

Bytes are read as: ASCII letters in lower case, other ASCII bytes as blank, bytes from 128 on as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from goldmeter.llm.common import remainder

ORDER = 4
LEAST = 4
SAMPLE = 256
LANE = 512
LETTER = re.compile(r"[^\W\d_]")

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def folded(text: str) -> np.ndarray:
    return _FOLD[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]


def sample(docs: DataFrame, size: int = SAMPLE) -> DataFrame:
    """lang, text: per language the `size` training texts with the smallest hashes (distinct texts; a bounded, repeatable sample).

    The hashes alone are ranked; texts are fetched by each language's largest hash kept, a table with a row per language.
    """
    known = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & (remainder(F.col("doc_id"), 5) != 0))
    known = known.select("lang", "text", F.xxhash64("text").alias("h"))
    order = Window.partitionBy("lang").orderBy("h")
    top = known.select("lang", "h").distinct().withColumn("k", F.row_number().over(order)).filter(F.col("k") <= size)
    last = top.groupBy("lang").agg(F.max("h").alias("last"))
    return known.join(F.broadcast(last), "lang").filter("h <= last").dropDuplicates(["lang", "h"]).select("lang", "text")


def count_contexts(texts: list[str], order: int = ORDER) -> pd.DataFrame:
    """order, code, n of all strings of 1 to order + 1 symbols; a code holds a string's bytes, the first one highest."""
    parts = [folded(t).astype(np.int64) for t in texts if t]
    out = []
    for k in range(order + 1):
        codes = []
        for x in parts:
            if len(x) > k:
                c = x[: len(x) - k].copy()
                for j in range(1, k + 1):
                    c = (c << 8) | x[j: len(x) - k + j]
                codes.append(c)
        code, n = np.unique(np.concatenate(codes) if codes else np.zeros(0, np.int64), return_counts=True)
        out.append(pd.DataFrame({"k": np.full(len(code), k, np.int32), "code": code, "n": n}))
    return pd.concat(out)


@dataclass
class Tree:
    """Compiled context tree: row-major tables state x symbol; state 0 is the empty context."""

    step: np.ndarray
    bits: np.ndarray
    width: int


def compile_tree(counts: pd.DataFrame, symbols: np.ndarray, least: int = LEAST) -> Tree:
    """symbols: the bytes any language was seen with; column 0 stands for all others. Contexts followed fewer than `least` times
    are left out, whatever their length."""
    width = len(symbols) + 1
    column = np.zeros(256, np.int64)
    column[symbols] = np.arange(1, width)
    steps, bits = [np.zeros((1, width), np.int32)], [np.full((1, width), np.log2(width))]
    state_of: dict[tuple[int, int], int] = {}
    for k in sorted(map(int, counts["k"].unique())):
        level = counts[counts["k"] == k]
        context, symbol, n = level["code"].to_numpy() >> 8, column[level["code"].to_numpy() & 255], level["n"].to_numpy()
        found, where = np.unique(context, return_inverse=True)
        total, kinds = np.bincount(where, n), np.bincount(where)
        keep = (total >= least) if k else np.ones(len(found), bool)
        rank = np.cumsum(keep) - 1
        found, total, kinds, row = found[keep], total[keep], kinds[keep], rank[where][keep[where]]
        symbol, n = symbol[keep[where]], n[keep[where]]
        if k:
            shorter = np.array([state_of[k - 1, int(c) & ((1 << 8 * (k - 1)) - 1)] for c in found], np.int64)
            base = sum(len(s) for s in steps)
            go, cost = np.concatenate(steps)[shorter], np.concatenate(bits)[shorter] + np.log2((total + kinds) / kinds)[:, None]
            prefix = [state_of.get((k - 1, int(c) >> 8)) for c in found]
        else:
            base, go, cost, prefix = 0, steps.pop(), bits.pop() + np.log2((total + kinds) / kinds)[:, None], []
        cost[row, symbol] = np.log2((total + kinds)[row] / n)
        steps.append(go)
        bits.append(cost)
        for i, c in enumerate(found):
            state_of[k, int(c)] = base + i
        table = np.concatenate(steps)
        for i, p in enumerate(prefix):  # reading its last byte after the bytes before it leads to a context
            if p is not None:
                table[p, column[int(found[i]) & 255]] = base + i
        if k:  # contexts of this length have the arcs of their suffixes, which now know this level
            table[base:] = table[shorter]
        steps, bits = [table], [np.concatenate(bits)]
    return Tree(steps[0].astype(np.int32), bits[0].astype(np.float32), width)


@dataclass
class Model:
    languages: list[str]
    symbols: np.ndarray
    trees: list[Tree]
    order: int

    def code_lengths(self, texts: list[str]) -> np.ndarray:
        """Bits of each text (rows) by each language (columns). Texts are cut into lanes of LANE symbols that advance in step;
        a lane first reads, unpaid, the symbols before it that can matter."""
        column = np.zeros(256, np.uint8)
        column[self.symbols] = np.arange(1, len(self.symbols) + 1)
        flat = [column[folded(t)] for t in texts]
        lanes = [(i, a, min(a + LANE, len(x))) for i, x in enumerate(flat) for a in range(0, len(x), LANE)]
        out = np.zeros((len(texts), len(self.languages)))
        if not lanes:
            return out
        lanes.sort(key=lambda x: x[1] - x[2])
        doc = np.array([i for i, _, _ in lanes])
        paid = np.array([b - a for _, a, b in lanes])
        before = self.order
        grid = np.zeros((before + LANE, len(lanes)), np.uint8)
        lead = np.array([min(before, a) for _, a, _ in lanes])
        for j, (i, a, b) in enumerate(lanes):
            grid[before - lead[j]: before + b - a, j] = flat[i][a - lead[j]: b]
        for k, tree in enumerate(self.trees):
            step, bits, width = tree.step.ravel(), tree.bits.ravel(), tree.width
            state, cost = np.zeros(len(lanes), np.int64), np.zeros(len(lanes))
            for t in range(before + int(paid.max())):
                if t < before:
                    reads = lead >= before - t
                    state[reads] = step[state[reads] * width + grid[t, reads]]
                    continue
                n = int(np.searchsorted(-paid, -(t - before), "left"))  # lanes longer than t - before
                at = state[:n] * width + grid[t, :n]
                cost[:n] += bits[at]
                state[:n] = step[at]
            out[:, k] = np.bincount(doc, cost, len(texts))
        return out


def train(docs: DataFrame, size: int = SAMPLE, order: int = ORDER) -> Model:
    """Fit on the bounded sample; each language is counted in a task of its own and the counts (bounded by the sample) collected."""

    def count(group: pd.DataFrame) -> pd.DataFrame:
        out = count_contexts(group["text"].tolist(), order)
        out["lang"] = group["lang"].iloc[0]
        return out[["lang", "k", "code", "n"]]

    counts = sample(docs, size).groupBy("lang").applyInPandas(count, "lang string, k int, code bigint, n bigint").toPandas()
    symbols = np.sort(counts.loc[counts["k"] == 0, "code"].unique()).astype(np.int64)
    languages = sorted(counts["lang"].unique())
    return Model(languages, symbols, [compile_tree(counts[counts["lang"] == x], symbols) for x in languages], order)


def judge(model: Model, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Predicted language, score and bits per byte of each text. Score: the language's share when every language weighs
    2 to the minus code length; 0 where nothing is predicted."""
    bits = model.code_lengths(texts)
    named = np.array([bool(LETTER.search(t)) for t in texts]) & bool(model.languages)
    sizes = np.maximum(1, [len(t.encode("utf-8", "surrogatepass")) for t in texts])
    if not model.languages:
        return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    best = bits.argmin(axis=1)
    least = bits.min(axis=1)
    score = 1 / np.exp2(np.maximum(-1000, least[:, None] - bits)).sum(axis=1)
    return [model.languages[b] if n else "und" for b, n in zip(best, named)], np.where(named, score, 0.0), least / sizes


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score, bits_per_byte for every row, by its whole text alone.

    `und` with score 0: text null, empty or without a letter, or nothing was learned. Ties go to the first language by name.
    Repeated rows stay; other columns are not read. The model is bounded by its sample and is broadcast.
    """
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 1024):
                part = b.slice(a, 1024)
                lang, score, bits = judge(shared.value, ["" if t is None else t for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(bits)], names=["key", "lang_pred", "score", "bits_per_byte"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, lang_pred string, score double, bits_per_byte double").withColumnRenamed("key", key)


def keep_named(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of `docs`, all columns, whose text is in a learned language: predicted, and coded in fewer bits than by the uniform
    code the trees fall back to."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")
    limit = float(np.log2(len(model.symbols) + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 1024):
                part = b.slice(a, 1024)
                lang, _, bits = judge(shared.value, ["" if t is None else t for t in part.column(at).to_pylist()])
                yield part.filter(pa.array([x != "und" and y < limit for x, y in zip(lang, bits)]))

    return docs.mapInArrow(run, docs.schema)
