"""Approximate nearest neighbours by multiprobe p-stable hashing, for the largest inner product.

A vector x becomes (x / R, sqrt(1 - |x|^2 / R^2)) with R the largest norm, a query q becomes (q / |q|, 0); nearness is then
Euclidean. A table hashes by M functions floor((a.x + b) / w) with Gaussian a. A query visits buckets in order of estimated
success, and at least as many as hold MET candidates: its neighbours' projections are normal around slope * (a.q) + extra * (last coordinate of a) with a spread, all three
fitted on a bounded sample; extra is the neighbours' mean last coordinate, which no query has. So each bucket has a probability,
and probing stops when the visited ones add up to the coverage that two tables need for the wanted recall. M, at least 1, grows
with the logarithm of the table, so buckets keep their size. Queries whose buckets hold too few candidates meet all of them.

Equal vectors are one candidate that stands for its smallest ids. A bucket is compared in blocks of bounded size; a task keeps
the best of each query over all its blocks before anything is shuffled. Scores are inner products of the original vectors in
double precision; equal ones are cut by id, however many they are.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from goldmeter.llm.common import partitions, stored

TABLES = 2
WIDTH = 1.5
BUCKET = 1024
MET = 2048
BLOCK = 4096
HELD = 200_000


@dataclass
class Hashes:
    """directions [table, d + 1, M], offsets [table, M]; slope, spread and extra (mean last coordinate) of neighbours, given the
    query; number of candidates, and centre and width [table, M] of their projections."""

    directions: np.ndarray
    offsets: np.ndarray
    radius: float
    slope: float
    spread: float
    coverage: float
    extra: float = 0.0
    number: int = 0
    centre: np.ndarray | None = None
    width: np.ndarray | None = None

    def rows(self, x: np.ndarray) -> np.ndarray:
        x = x / self.radius
        return np.c_[x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))]

    def queries(self, x: np.ndarray) -> np.ndarray:
        return np.c_[x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros(len(x))]

    def keys(self, x: np.ndarray, table: int) -> np.ndarray:
        slots = np.floor((self.rows(x) @ self.directions[table] + self.offsets[table]) / WIDTH).astype(np.int64)
        return bucket_key(slots)

    def probes(self, q: np.ndarray, table: int) -> list[np.ndarray]:
        """Bucket keys of each query, likeliest first, until their probabilities reach the coverage and they hold MET candidates (or
        all there are) by the candidates' distribution."""
        at = self.queries(q) @ self.directions[table]
        shift = self.extra * self.directions[table][-1] + self.offsets[table]
        return [self._visit(self.slope * p + shift, table) for p in at]

    def _visit(self, centre: np.ndarray, table: int = 0) -> np.ndarray:
        m = len(centre)
        reach = int(np.ceil(5 * self.spread / WIDTH)) + 1
        home = np.floor(centre / WIDTH).astype(np.int64)
        slots = home[:, None] + np.arange(-reach, reach + 1)
        edge = (slots * WIDTH - centre[:, None]) / self.spread
        p = _normal(edge + WIDTH / self.spread) - _normal(edge)
        order = np.argsort(-p, axis=1)
        p, slots = np.take_along_axis(p, order, 1), np.take_along_axis(slots, order, 1)
        if self.number:
            low = (slots * WIDTH - self.centre[table][:, None]) / self.width[table][:, None]
            share = _normal(low + WIDTH / self.width[table][:, None]) - _normal(low)
        out, got, met, seen = [], 0.0, 0.0 if self.number else MET, {(0,) * m}
        heap = [(-float(p[:, 0].prod()), (0,) * m)]
        while heap and (got < self.coverage or met < MET):
            chance, ranks = heapq.heappop(heap)
            if chance > -1e-300:
                break
            out.append(slots[np.arange(m), list(ranks)])
            got -= chance
            if self.number:
                met += self.number * float(share[np.arange(m), list(ranks)].prod())
            for i in range(m):
                if ranks[i] + 1 < slots.shape[1]:
                    step = (*ranks[:i], ranks[i] + 1, *ranks[i + 1:])
                    if step not in seen:
                        seen.add(step)
                        heapq.heappush(heap, (-float(p[np.arange(m), list(step)].prod()), step))
        return bucket_key(np.array(out, np.int64).reshape(len(out), m))


def _normal(z: np.ndarray) -> np.ndarray:
    """Distribution function of the standard normal, to 1e-7 (Abramowitz and Stegun 7.1.26)."""
    x = np.abs(z) / np.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-x * x)
    return np.where(z >= 0, 1 - tail / 2, tail / 2)


def bucket_key(slots: np.ndarray) -> np.ndarray:
    key = np.full(len(slots), 1, np.uint64)
    for i in range(slots.shape[1]):
        key = key * np.uint64(0x9E3779B97F4A7C15) + slots[:, i].astype(np.uint64)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """id, v (doubles): one row per id. Null, empty or zero vectors, vectors with null or non-finite components and null ids are
    left out, as are vectors not of the commonest dimension; of rows that repeat an id the smallest vector counts."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).filter(fine).select(F.col(key).cast("long").alias("id"), v.alias("v"))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    return rows.filter(F.size("v") == (sizes["d"] if sizes else 0)).groupBy("id").agg(F.min("v").alias("v"))


def groups(rows: DataFrame, most: int) -> DataFrame:
    """rep (smallest id), v, ids (the `most` smallest ids) of each distinct vector; ranks are cut in every task first."""
    rank = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    ids = F.sort_array(F.collect_list("id"))
    return rows.withColumn("r", rank).filter(F.col("r") <= most).groupBy("v").agg(ids.alias("ids")).select(F.col("ids")[0].alias("rep"), "v", "ids")


def _array(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def fit(candidates: DataFrame, neighbours: int, recall: float, sample: int = 4000, asked: int = 200) -> Hashes:
    """Hash functions for `candidates` (rep, v), with slope, extra and spread from a sample of at most `sample` vectors."""
    n, radius = candidates.agg(F.count(F.lit(1)), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))).first()
    rows = candidates.orderBy(F.xxhash64("rep"), "rep").limit(sample).select("v").collect()
    x = np.array([r["v"] for r in rows], np.float64)
    d = x.shape[1] if len(x) else 1
    m = max(1, round(np.log2(max(1, n) / BUCKET) / 2))
    random = np.random.default_rng(3)
    made = Hashes(random.normal(size=(TABLES, d + 1, m)), random.uniform(0, WIDTH, (TABLES, m)), float(radius or 1.0), 0.5, 0.9, 1 - (1 - recall) ** (1 / TABLES))
    if len(x) > 2:
        a, b = made.queries(x[:asked]), made.rows(x)
        near = a @ b.T
        near[np.arange(len(a)), np.arange(len(a))] = -np.inf
        k = max(1, min(neighbours * len(x) // n, len(x) - 1))
        best = np.argsort(-near, axis=1)[:, :k]
        made.slope = float(np.mean(np.take_along_axis(near, best, 1)))
        made.extra = float(np.mean(b[best, -1]))
        rest = b[best] - made.slope * a[:, None, :]
        rest[:, :, -1] -= made.extra
        length = np.linalg.norm(rest, axis=2)
        made.spread = float(max(0.05, np.sqrt(np.mean(length**2))))
        at = [b @ made.directions[t] + made.offsets[t] for t in range(TABLES)]
        made.number, made.centre, made.width = n, np.array([y.mean(axis=0) for y in at]), np.array([np.maximum(0.05, y.std(axis=0)) for y in at])
    return made


def _hashed(frame: DataFrame, hashes: Hashes, asking: bool) -> DataFrame:
    """table, key, rep, v: a row per table (candidates) or per bucket to visit (queries)."""
    shared = frame.sparkSession.sparkContext.broadcast(hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            x = _array(b.column(1))
            for t in range(TABLES):
                keys = h.probes(x, t) if asking else [np.array([k]) for k in h.keys(x, t)]
                at = np.repeat(np.arange(b.num_rows), [len(k) for k in keys])
                out = b.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t, np.int32)), pa.array(np.concatenate(keys)), *out.columns], names=["table", "key", "rep", "v"])

    return frame.select("rep", "v").mapInArrow(run, "table int, key bigint, rep bigint, v array<double>")


def block_best(q: np.ndarray, v: np.ndarray, own: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """score, id [query, min(most, len(own))]: the best of a block by (score falling, id), scores exact.

    All that reach the k-th score of the matrix product, less its rounding, are scored anew before the cut.
    """
    k = min(most, len(own))
    score, ids = np.empty((len(q), k)), np.empty((len(q), k), np.int64)
    lengths = np.linalg.norm(q, axis=1) * np.linalg.norm(v, axis=1).max()
    margin = 4 * v.shape[1] * np.finfo(np.float64).eps * lengths
    for a in range(0, len(q), 64):
        part = q[a: a + 64]
        near = part @ v.T
        least = np.partition(near, near.shape[1] - k, axis=1)[:, -k] - margin[a: a + 64]
        row, at = np.nonzero(near >= least[:, None])
        exact = np.concatenate([(v[at[z: z + 16384]] * part[row[z: z + 16384]]).sum(axis=1) for z in range(0, len(at), 16384)])
        order = np.lexsort((own[at], -exact, row))
        first = np.searchsorted(row, np.arange(len(part)))
        kept = order[first[:, None] + np.arange(k)]
        score[a: a + 64], ids[a: a + 64] = exact[kept], own[at][kept]
    return score, ids


class Best:
    """The best candidates of many queries: scores falling, ties to the smaller id."""

    def __init__(self, most: int):
        self.most, self.row, self.score, self.id = most, {}, np.zeros((0, most)), np.zeros((0, most), np.int64)

    def add(self, queries: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        new = [q for q in queries.tolist() if q not in self.row]
        self.row.update(zip(new, range(len(self.row), len(self.row) + len(new))))
        if len(self.row) > len(self.score):
            grow = max(len(self.row), 2 * len(self.score)) - len(self.score)
            self.score = np.r_[self.score, np.full((grow, self.most), -np.inf)]
            self.id = np.r_[self.id, np.full((grow, self.most), np.iinfo(np.int64).max)]
        at = np.fromiter((self.row[q] for q in queries.tolist()), np.int64, len(queries))
        s, i = np.c_[self.score[at], score], np.c_[self.id[at], ids]
        order = np.lexsort((i, -s), axis=1)
        s, i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
        s[:, 1:][i[:, 1:] == i[:, :-1]] = -np.inf  # met in another table too
        order = np.argsort(-s, axis=1, kind="stable")[:, : self.most]
        self.score[at], self.id[at] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)

    def batch(self) -> pa.RecordBatch:
        queries = np.fromiter(self.row, np.int64, len(self.row))
        score, ids = self.score[: len(queries)], self.id[: len(queries)]
        real = np.isfinite(score)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(queries, real.sum(axis=1))), pa.array(ids[real]), pa.array(score[real])], names=["q", "rep", "score"])


def compare(candidates: DataFrame, asked: DataFrame, most: int) -> DataFrame:
    """q, rep, score: for every query the best it meets in a task's buckets, by exact inner products."""
    sizes = candidates.groupBy("table", "key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    rows = candidates.join(sizes, ["table", "key"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("asks", F.lit(False))
    asks = asked.join(sizes, ["table", "key"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("asks", F.lit(True))
    both = rows.unionByName(asks).select("table", "key", "block", "asks", "rep", "v")
    both = both.repartition(partitions(candidates.sparkSession), "table", "key", "block").sortWithinPartitions("table", "key", "block", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(most)
        group, ids, vectors = None, [], []

        def meet(queries: np.ndarray, q: np.ndarray) -> None:
            best.add(queries, *block_best(q, np.concatenate(vectors), np.concatenate(ids), most))

        for whole in batches:
            for z in range(0, whole.num_rows, 1024):
                b = whole.slice(z, 1024)
                if not b.num_rows:
                    continue
                table, key, block, asks, rep = (np.asarray(b.column(i).to_numpy(zero_copy_only=False)) for i in range(5))
                v = _array(b.column(5))
                change = np.flatnonzero((np.diff(table) != 0) | (np.diff(key) != 0) | (np.diff(block) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
                for a, e in zip([0, *change.tolist()], [*change.tolist(), b.num_rows]):
                    if group != (table[a], key[a], block[a]):
                        group, ids, vectors = (table[a], key[a], block[a]), [], []
                    if not asks[a]:
                        ids.append(rep[a:e])
                        vectors.append(v[a:e])
                    elif ids:
                        meet(rep[a:e], v[a:e])
                if len(best.row) > HELD:
                    yield best.batch()
                    best = Best(most)
        yield best.batch()

    return both.mapInArrow(run, "q bigint, rep bigint, score double")


def search(vectors: DataFrame, is_query, key: str = "vec_id", vector: str = "embedding", neighbours: int = 20, recall: float = 0.96) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found for every query row, itself left out; ties to the smaller id.

    `is_query`: condition on the column `id`. See `usable` for rows that take no part. Copies of one vector are searched once;
    each of them gets its own rows. An empty table gives no rows.
    """
    rows = stored(usable(vectors, key, vector), "vectors")
    most = neighbours + 1
    own = stored(groups(rows, most), "vector-groups")
    n = own.count()
    hashes = fit(own, neighbours, recall)
    asks = stored(rows.filter(is_query).join(own.select("v", "rep"), "v").select(F.col("id").alias("query_id"), F.col("rep").alias("q")), "vector-queries")
    asked = own.join(asks.select(F.col("q").alias("rep")).distinct(), "rep", "left_semi")
    found = stored(compare(_hashed(own, hashes, False), _hashed(asked, hashes, True), most), "vector-best")
    enough = found.groupBy("q").agg(F.count_distinct("rep").alias("n")).filter(F.col("n") >= min(most, n)).select(F.col("q").alias("rep"))
    few = stored(asked.join(enough, "rep", "left_anti").select("rep", "v"), "vector-few")
    if not few.isEmpty():
        whole = [F.lit(-1).alias("table"), F.lit(0).cast("long").alias("key"), "rep", "v"]
        found = found.unionByName(compare(own.select(*whole), few.select(*whole), most))
    by_score = Window.partitionBy("q").orderBy(F.desc("score"), "rep")
    found = found.groupBy("q", "rep").agg(F.max("score").alias("score")).withColumn("r", F.row_number().over(by_score)).filter(F.col("r") <= most)
    ids = found.join(own.select("rep", "ids"), "rep").select("q", "score", F.explode("ids").alias("vec_id"))
    by_id = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    ids = ids.withColumn("r", F.row_number().over(by_id)).filter(F.col("r") <= most).groupBy("q").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("list"))
    mine = asks.join(ids, "q").select("query_id", F.slice(F.filter("list", lambda x: x["vec_id"] != F.col("query_id")), 1, neighbours).alias("list"))
    return mine.select("query_id", F.posexplode("list").alias("place", "x")).select("query_id", (F.col("place") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
