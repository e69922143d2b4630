"""The index is minimal and perfect, files hold what the public tokenizer gives, keys find their documents."""

import zlib

import numpy as np
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from goldmeter.llm import idstore, queries
from goldmeter.llm.common import shared_folder, stored, vocabulary

tokenizers = pytest.importorskip("tokenizers")
BYTES = vocabulary("byte_bpe_50k.json")


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 1000, 50_000])
def test_hash_is_minimal_and_perfect(n):
    rng = np.random.default_rng(n)
    a, b = rng.integers(0, 2**64, (2, n), dtype=np.uint64)
    table = idstore.PerfectHash.build(a, b)
    assert sorted(table.numbers(a, b).tolist()) == list(range(n))
    assert int(table.sizes.sum()) <= 4 * n + 64 * (len(table.sizes) + 1)


def test_equal_first_hashes_are_told_apart():
    a, b = np.zeros(500, np.uint64), np.arange(500, dtype=np.uint64)
    assert sorted(idstore.PerfectHash.build(a, b).numbers(a, b).tolist()) == list(range(500))
    with pytest.raises(ValueError):
        idstore.PerfectHash.build(np.zeros(2, np.uint64), np.zeros(2, np.uint64))


def ids_of(text):
    return [*tokenizers.Tokenizer.from_file(BYTES).encode(text or "", add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("shard_ids", [50, 1 << 24])
def test_round_trip_of_odd_rows(spark, odd_docs, plain, no_docs, shard_ids):
    folder = shared_folder(spark, "ids")
    places = stored(idstore.write_shards(odd_docs, folder, BYTES, shard_ids=shard_ids), "places")
    shards = {r["number"]: r for r in idstore.catalogue(places, folder).collect()}
    rows = [(shards[r["number"]]["base"] + r["at"], r["doc_id"], r["ids"], r["n_tokens"], r["ids_crc32"]) for r in idstore.read_documents(places, folder, with_ids=True).collect()]
    assert sorted(((r[1] is not None, r[1] or 0, r[2]) for r in rows)) == sorted((i is not None, i or 0, ids_of(t)) for i, t in plain)
    at, before = 0, None
    for start, key, ids, n, crc in sorted(rows):
        assert start == at and n == len(ids) and crc == zlib.crc32(np.array(ids, "<u4").tobytes())
        assert before is None or key is not None and key >= before
        at, before = at + n, key
    assert sum(r["documents"] for r in shards.values()) == len(plain) and sum(r["ids"] for r in shards.values()) == at
    assert (len(shards) > 5) == (shard_ids == 50)
    nothing = stored(idstore.write_shards(no_docs, shared_folder(spark, "ids"), BYTES), "places")
    assert nothing.collect() == [] and idstore.catalogue(nothing, folder).collect() == []


def test_absent_keys_are_not_found_and_damage_is_seen(spark, odd_docs):
    folder = shared_folder(spark, "ids")
    places = stored(idstore.write_shards(odd_docs, folder, BYTES), "places")
    store, base = fs.FileSystem.from_uri(folder)
    name = places.first()["shard"]
    shard = idstore.Shard(store, f"{base}/{name}")
    absent = spark.range(1000, 4000).select(F.xxhash64("id").alias("a"), F.xxhash64(F.lit(7), "id").alias("b")).toPandas()
    first, copies = shard.find(absent["a"].to_numpy().view(np.uint64), absent["b"].to_numpy().view(np.uint64))
    assert (first == -1).all() and (copies == 0).all()
    data = bytearray(store.open_input_file(f"{base}/{name}").read())
    data[-idstore.FOOTER - 1] ^= 1
    with store.open_output_stream(f"{base}/bad.ids") as f:
        f.write(bytes(data))
    with pytest.raises(ValueError):
        idstore.Shard(store, f"{base}/bad.ids")


def test_query_on_given_table(spark):
    from pathlib import Path

    folder = "/root/testdata/sf0.001"
    if not Path(folder).exists():
        pytest.skip("driver tables are not mounted")
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())
    got = {r["doc_id"]: r for r in queries.QUERIES["op12_perfect_hash_ids"](spark, folder).collect()}
    assert len(got) == len(docs)
    at = 0
    for key, text in docs:
        ids = ids_of(text)
        assert (got[key]["start"], got[key]["n_tokens"], got[key]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
