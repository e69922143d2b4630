"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are rows labelled 1; the unlabelled set is drawn from all texts as they are. For a linear score with logistic
loss the risk is pi * E_p[l(+)] + max(0, E_u[l(-)] - pi * E_p[l(-)]); where the second part turns negative, a step against it is
taken instead. The class prior pi is estimated by the best bin: a first classifier of positives against unlabelled texts ranks
both, and pi is the smallest ratio, with a margin for its error, of the two shares above a cut.

Features come from a whole text alone: shares of bytes and of pairs of byte classes (square roots), and counts of words and lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldmeter.llm.common import remainder

POSITIVES = 4000
UNLABELLED = 8000
THRESHOLD = 0.3

_CLASS = np.full(256, 5, np.uint8)  # other marks
for _i, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b"", b".,", b"!?", b":;", b"'\"", b"()[]{}<>", b"|", b"-_/\\", b"@#$%&*+=~^`")):
    _CLASS[list(_chars)] = _i
_CLASS[128:192], _CLASS[192:] = 14, 15
WIDTH = 256 + 256 + 9


def features(text: str) -> np.ndarray:
    """Feature vector of a text; all zero parts are fine, so the empty text has one too."""
    x = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    out = np.zeros(WIDTH, np.float32)
    if len(x):
        out[:256] = np.sqrt(np.bincount(x, minlength=256) / len(x))
        c = _CLASS[x]
        if len(x) > 1:
            out[256:512] = np.sqrt(np.bincount(c[:-1] * np.uint8(16) + c[1:], minlength=256) / (len(x) - 1))
    words, lines = text.split(), [y for y in text.split("\n") if y.strip()]
    n = max(1, len(words))
    out[512:] = (
        np.log1p(len(words)), len(x) / n / 16, len(set(words)) / n, len(set(lines)) / max(1, len(lines)),
        np.log1p(len(lines)), np.log1p(n / max(1, len(lines))), len(set(words)) / np.sqrt(n) / 8,
        float(not words), sum(map(eq, words, words[1:])) / n)
    return out


def matrix(texts: list[str]) -> np.ndarray:
    return np.array([features(t) for t in texts], np.float32).reshape(len(texts), WIDTH)


def _collect(rows: DataFrame) -> np.ndarray:
    """Feature rows of a bounded frame; features are computed by the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([f.tobytes() for f in matrix(["" if t is None else t for t in b.column(0).to_pylist()])], pa.binary())], names=["f"])

    got = rows.mapInArrow(run, "f binary").collect()
    return np.array([np.frombuffer(r["f"], np.float32) for r in got], np.float64).reshape(len(got), WIDTH)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _loss(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, -z)


def _slope(z: np.ndarray) -> np.ndarray:
    """Derivative of the logistic loss."""
    return -1 / (1 + np.exp(np.clip(z, -500, 500)))


def descend(p: np.ndarray, u: np.ndarray, prior: float | None, rounds: int = 600, rate: float = 0.03, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on whole batches. With a prior: the non-negative risk; without: positives against unlabelled."""
    w, m, v = np.zeros(p.shape[1] + 1), np.zeros(p.shape[1] + 1), np.zeros(p.shape[1] + 1)
    p, u = np.c_[p, np.ones(len(p))], np.c_[u, np.ones(len(u))]
    for t in range(1, rounds + 1):
        zp, zu = p @ w, u @ w
        if prior is None:
            g = p.T @ _slope(zp) / len(p) - u.T @ _slope(-zu) / len(u)
        else:
            rest = _loss(-zu).mean() - prior * _loss(-zp).mean()
            g_rest = -(u.T @ _slope(-zu)) / len(u) + prior * (p.T @ _slope(-zp)) / len(p)
            g = prior * (p.T @ _slope(zp)) / len(p) + g_rest if rest >= 0 else -g_rest
        g = g + decay * np.r_[w[:-1], 0]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def estimate_prior(p: np.ndarray, u: np.ndarray, confidence: float = 0.1) -> float:
    """Best-bin estimate from scores of positives and unlabelled rows that took no part in the fit of the scorer."""
    cuts = np.sort(p)[: max(1, int(0.95 * len(p)))]
    above_p = 1 - np.searchsorted(np.sort(p), cuts, "left") / len(p)
    above_u = 1 - np.searchsorted(np.sort(u), cuts, "left") / len(u)
    margin = np.sqrt(np.log(4 / confidence) / 2) * (1 / np.sqrt(len(p)) + 1 / np.sqrt(len(u)))
    best = np.argmin((above_u + margin) / np.maximum(above_p, 1e-9))
    return float(np.clip(above_u[best] / max(above_p[best], 1e-9), 0.01, 0.99))


def fit(p: np.ndarray, u: np.ndarray) -> Model:
    """Without positives or unlabelled rows every score is 0.5."""
    if not len(p) or not len(u):
        return Model(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), 0.0, 0.5)
    mean, scale = u.mean(axis=0), u.std(axis=0)
    scale = np.where(scale > 1e-6, scale, 1.0) * 4
    p, u = (p - mean) / scale, (u - mean) / scale
    w, b = descend(p[::2], u[::2], None)
    prior = estimate_prior(p[1::2] @ w + b, u[1::2] @ w + b) if len(p) > 1 and len(u) > 1 else 0.5
    w, b = descend(p, u, prior)
    return Model(mean, scale, w, b, prior)


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Fit on bounded samples: the texts with the smallest hashes of the ids among rows labelled 1 and among all rows, held-out
    rows left out. Bounds are parameters; a top-k keeps at most so many rows per task and on the driver."""
    seen = docs.filter(remainder(F.col("doc_id"), 5) != 0).select("doc_id", "text")
    good = labels.filter("quality = 1").select("doc_id").distinct()
    order = F.xxhash64("doc_id", F.lit("quality"))
    u_ids = seen.select("doc_id").distinct().orderBy(order, "doc_id").limit(unlabelled)
    p_ids = seen.select("doc_id").join(good, "doc_id").distinct().orderBy(order, "doc_id").limit(positives)
    take = lambda ids: _collect(seen.join(F.broadcast(ids), "doc_id").select("text"))  # noqa: E731  at most the bound's ids
    return fit(take(p_ids), take(u_ids))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score of every row by its whole text; null counts as empty, repeated rows stay, other columns are not read."""
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 1024):
                part = b.slice(a, 1024)
                s = shared.value.scores(matrix(["" if t is None else t for t in part.column(1).to_pylist()]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.float64())], names=["key", "score"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, score double").withColumnRenamed("key", key)


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of `docs`, all columns, whose text scores at least `threshold`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 1024):
                part = b.slice(a, 1024)
                yield part.filter(pa.array(shared.value.scores(matrix(["" if t is None else t for t in part.column(at).to_pylist()])) >= threshold))

    return docs.mapInArrow(run, docs.schema)
