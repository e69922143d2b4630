"""MinHash near-duplicates: universal hash minima, bands, signature verification, exact confirmation, connected components.

1. One scan turns each text into its shingle set (64-bit hashes), 288 minima of universal hash functions, 48 band keys of 6
   minima each and an 8-bit signature. A pair at similarity 0.8 misses all bands with probability below 5e-7.
2. Equal sets are one node (64-bit digest), so exact copies cost nothing from here on.
3. Members of a bucket are compared by signature, in blocks of bounded size, and joined into groups where the signatures allow
   the similarity. Only a forest of each group is given out, never all its pairs; buckets with the same members count once.
4. The groups' components are closed under possible links. Each is confirmed on full sets, again block by block: a forest of the
   exact links of every pair of blocks is given out, so no link between different components is lost.
5. Components by alternating large-star and small-star until the edges are stars.

Only ids, band keys and 288-byte signatures of all documents are shuffled, and texts once, of which those in groups stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldmeter.llm.common import partitions, stored
from goldmeter.llm.words import BASE, SECOND, mix, runs, word_hashes

BANDS, ROWS = 48, 6
#: Agreeing 8-bit minima of 288 that a pair must have: six deviations below the mean at similarity 0.8.
LEAST_AGREEING = 188
BLOCK = 1024
#: Shingles of the texts in a block, about.
BLOCK_SHINGLES = 500_000

_random = np.random.default_rng(21)
_FACTORS = _random.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_SHIFTS = _random.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)


def _shingles(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of every `width` words in a row."""
    n = max(0, len(words) - width + 1)
    h = words[:n]
    for i in range(1, width):
        h = mix(h * SECOND + words[i: i + n])
    return h


def shingle_sets(texts: list[str], width: int = 2) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles of `width` words, two at least; a text of fewer words is one shingle, no
    word gives the empty set."""
    out = []
    for run in runs([t.encode("utf-8", "surrogatepass") for t in texts]):
        words, first = word_hashes(run)
        every = _shingles(words, width)
        for a, b in zip(first.tolist(), first[1:].tolist()):
            if b - a >= width:
                out.append(np.unique(every[a: b - width + 1]))
            else:
                out.append(_shingles(words[a:b], b - a) if b - a > 1 else mix(words[a:b] + SECOND))
    return out


def minima(shingles: np.ndarray) -> np.ndarray:
    """Smallest upper half of factor * x + shift, for every hash function."""
    least = np.full(BANDS * ROWS, np.uint64(2**64 - 1))
    for a in range(0, len(shingles), 512):
        h = _FACTORS[:, None] * shingles[None, a: a + 512]
        h += _SHIFTS[:, None]
        np.minimum(least, h.min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * BASE
    for r in range(ROWS):
        key = mix(key * SECOND + rows[:, r])
    return key.view(np.int64)


def digest(shingles: np.ndarray) -> int | None:
    """64 bits that stand for a whole set; none for the empty set."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True) if len(shingles) else None


def sketch(docs: DataFrame, width: int = 2) -> DataFrame:
    """doc_id, n_shingles, node (digest of the set), body (hash of the text), bands, sig."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 512):
                part = b.slice(a, 512)
                sets = shingle_sets(["" if t is None else t for t in part.column(1).to_pylist()], width)
                sigs = [minima(s) for s in sets]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) for s in sets], pa.int64()), part.column(2),
                    pa.array([band_keys(g) for g in sigs], pa.list_(pa.int64())), pa.array([(g & 255).astype(np.uint8).tobytes() for g in sigs], pa.binary())],
                    names=["doc_id", "n_shingles", "node", "body", "bands", "sig"])

    return docs.select("doc_id", "text", F.xxhash64("text")).mapInArrow(run, f"doc_id {kind}, n_shingles bigint, node bigint, body bigint, bands array<bigint>, sig binary")


def shared_buckets(nodes: DataFrame) -> DataFrame:
    """bucket, node, m for buckets of several nodes; of buckets with the same members one stays."""
    rows = nodes.select(F.explode("bands").alias("bucket"), "node")
    several = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.bit_xor("node").alias("x"), F.min("node").alias("least")).filter("m > 1")
    one = several.groupBy("m", "x", "least").agg(F.min("bucket").alias("bucket")).select("bucket", "m")
    return rows.join(one, "bucket")


def in_block_pairs(rows: DataFrame, group: str, blocks: Column) -> DataFrame:
    """Rows dealt into `blocks` blocks of their group by the node's hash, and repeated for each pair of blocks (p, q) their own
    is in; `second` marks rows of block q where p < q."""
    rows = rows.withColumn("blocks", blocks.cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(F.col(group).alias("grp"), F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), (F.col("own") > F.col("other")).alias("second"), *(c for c in rows.columns if c not in (group, "own", "other", "blocks", "m")))
    n = partitions(rows.sparkSession)
    return rows.repartition(n, "grp", "p", "q").sortWithinPartitions("grp", "p", "q")


def forest(n: int, left: int, links) -> list[tuple[int, int]]:
    """Edges (i, j) of a spanning forest of 0..n-1 where links(i, rest) gives those of `rest` linked with i. With left < n only
    links between 0..left-1 and the others count. Every node is asked about once, about nodes not reached yet."""
    open_ = np.ones(n, bool)
    edges = []
    for start in range(left if left < n else n):
        if not open_[start]:
            continue
        open_[start] = False
        queue = [start]
        while queue:
            i = queue.pop()
            rest = np.flatnonzero(open_[left:]) + left if i < left < n else np.flatnonzero(open_[:left])
            if len(rest):
                near = links(i, rest)
                open_[near] = False
                edges += [(i, int(j)) for j in near]
                queue += near.tolist()
    return edges


def _by_group(rows: DataFrame, join) -> DataFrame:
    """Edges a, b of `join(left, right)` for every (grp, p, q); left and right are lists of the remaining columns, right is None
    inside a block. A group is one pair of blocks, so its size is bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        left: list[tuple] = []
        right: list[tuple] = []

        def edges() -> pa.RecordBatch:
            found = join(left, right if at[1] != at[2] else None) if at and left and (right or at[1] == at[2]) else []
            a, b = list(zip(*found)) or ((), ())
            left.clear()
            right.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for whole in batches:
            for z in range(0, whole.num_rows, 1024):
                for *key, second, in_ in ((*r[:3], r[3], r[4:]) for r in zip(*(c.to_pylist() for c in whole.slice(z, 1024).columns))):
                    if tuple(key) != at:
                        yield edges()
                        at = tuple(key)
                    (right if second else left).append(in_)
        yield edges()

    return rows.mapInArrow(run, "a bigint, b bigint")


def _similar_sizes(n: np.ndarray, m: int) -> np.ndarray:
    return (n * 100 >= m * 80) & (m * 100 >= n * 80)


def possible_links(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) of forests over nodes that share a bucket and whose sizes and signatures allow the similarity."""

    def join(left: list[tuple], right: list[tuple] | None) -> list[tuple[int, int]]:
        both = left + (right or [])
        node, n = [r[0] for r in both], np.array([r[1] for r in both])
        sig = np.frombuffer(b"".join(r[2] for r in both), np.uint8).reshape(len(both), -1)

        def links(i: int, rest: np.ndarray) -> np.ndarray:
            rest = rest[_similar_sizes(n[rest], n[i])]
            return rest[(sig[rest] == sig[i]).sum(axis=1) >= LEAST_AGREEING]

        return [(node[i], node[j]) for i, j in forest(len(both), len(left), links)]

    rows = shared_buckets(nodes).join(nodes.select("node", F.col("n_shingles").alias("n"), "sig"), "node")
    dealt = in_block_pairs(rows.select("bucket", "m", "node", "n", "sig"), "bucket", F.ceil(F.col("m") / BLOCK))
    return _by_group(dealt, join).distinct()


def confirmed_links(docs: DataFrame, nodes: DataFrame, groups: DataFrame, width: int = 2) -> DataFrame:
    """Edges (a, b) of forests of the links 100 * intersection >= 80 * union on full sets, between nodes of one group.

    A group's texts, one per node, are dealt into blocks of about BLOCK_SHINGLES shingles. groups: cid (node), comp.
    """
    wanted = groups.select(F.col("cid").alias("node"), "comp").join(nodes.select("node", "n_shingles", "doc_id"), "node")
    sizes = wanted.groupBy("comp").agg(F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES).alias("m"))
    rows = docs.select("doc_id", "text").join(wanted.join(sizes, "comp").select("doc_id", "node", "comp", "m"), "doc_id")
    dealt = in_block_pairs(rows.select("comp", "m", "node", "text"), "comp", F.col("m"))

    def join(left: list[tuple], right: list[tuple] | None) -> list[tuple[int, int]]:
        sets = [[(r[0], s) for r, s in zip(side, shingle_sets([r[1] or "" for r in side], width)) if digest(s) == r[0]] for side in (left, right or [])]
        both = sets[0] + sets[1]  # a row whose doc_id repeats with another text is no node of this group
        if not both:
            return []
        node, n = [k for k, _ in both], np.array([len(s) for _, s in both])
        every, flat = np.unique(np.concatenate([s for _, s in both]), return_inverse=True)
        starts = np.r_[0, np.cumsum(n)[:-1]]
        mark = np.zeros(len(every), np.int64)

        def links(i: int, rest: np.ndarray) -> np.ndarray:
            rest = rest[_similar_sizes(n[rest], n[i])]
            if not len(rest):
                return rest
            own = flat[starts[i]: starts[i] + n[i]]
            mark[own] = 1
            if len(rest) * 4 > len(n):
                shared = np.add.reduceat(mark[flat], starts)[rest]
            else:
                shared = np.array([mark[flat[starts[j]: starts[j] + n[j]]].sum() for j in rest])
            mark[own] = 0
            return rest[100 * shared >= 80 * (n[rest] + n[i] - shared)]

        return [(node[i], node[j]) for i, j in forest(len(both), len(sets[0]), links)]

    return _by_group(dealt, join).distinct()


def connect(edges: DataFrame, most: int = 60) -> DataFrame:
    """cid, comp (smallest id of the component) for every id in `edges` (a, b), by alternating large-star and small-star.

    Each step finds a node's smallest neighbour by a partial minimum and joins it to the node's edges; no neighbour list is
    gathered. Every round is stored, so lineage stays short. Without edges the result is empty.
    """
    edges = edges.filter("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
    edges = stored(edges, "links")
    before = None
    for _ in range(most):
        both = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).filter("lo < hi").distinct()
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(down, "hi")
        small = joined.select(F.col("m").alias("lo"), F.col("lo").alias("hi")).unionByName(down.select(F.col("m").alias("lo"), "hi")).filter("lo < hi").distinct()
        edges = stored(small, "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("hi").alias("cid"), F.col("lo").alias("comp")).unionByName(edges.select(F.col("lo").alias("cid"), F.col("lo").alias("comp")).distinct())
        before = now
    raise RuntimeError(f"components not settled after {most} rounds")


def components(docs: DataFrame, width: int = 2) -> DataFrame:
    """doc_id, n_shingles, node, body, comp (smallest node of the component), least (smallest doc_id of it) for every row; comp
    and least are null for empty sets and, where no row of the set has an id, for null ids."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = stored(sketch(docs, width), "sketches")
    owners = sketches.filter("node IS NOT NULL AND doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    nodes = stored(sketches.join(owners, ["node", "doc_id"]).dropDuplicates(["node"]), "nodes")
    groups = connect(possible_links(nodes))
    final = connect(confirmed_links(docs, nodes, groups, width))
    placed = owners.join(final.select(F.col("cid").alias("node"), "comp"), "node", "left").select("node", F.coalesce("comp", "node").alias("comp"), "doc_id")
    least = placed.groupBy("comp").agg(F.min("doc_id").alias("least"))
    component = placed.join(least, "comp").select("node", "comp", "least")
    return sketches.select("doc_id", "n_shingles", "node", "body").join(component, "node", "left")


def near_duplicates(docs: DataFrame, width: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row, by shingles of `width` words.

    Null or wordless texts have the empty set and a component of their own. Each row is judged by its own text, repeated rows
    included. A null doc_id takes part in nothing and has no component. Ties have one outcome, the smallest id. An empty table
    gives no rows; only doc_id and text are read. Two different sets share a digest with a probability of one in 2**64 a pair.
    """
    rows = components(docs, width)
    component_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return rows.select("doc_id", "n_shingles", component_id.alias("component_id"), (F.col("doc_id") == component_id).alias("kept"))


def keep_one(docs: DataFrame, width: int = 2) -> DataFrame:
    """Rows of `docs`, all columns, one per component: the one with the smallest doc_id, of several texts of that id the one with
    the smallest digest. Texts that share an id but no component all stay; an id's wordless texts are one. Rows without an id
    stay. A row is met again by its id and a 64-bit hash of its text."""
    rows = components(docs, width).filter("doc_id IS NOT NULL")
    alone = F.when(F.col("comp").isNull(), F.col("doc_id"))
    kept = rows.groupBy("comp", alone.alias("alone")).agg(F.min(F.struct("doc_id", "node", "body")).alias("x")).select("x.doc_id", F.col("x.body").alias("_body"))
    own = docs.withColumn("_body", F.xxhash64("text")).join(kept, ["doc_id", "_body"], "left_semi").dropDuplicates(["doc_id", "_body"])
    return own.select(*docs.columns).unionByName(docs.filter("doc_id IS NULL"))
