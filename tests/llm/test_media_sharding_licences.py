"""Round trip of media columns, laws of sharding, canonical digests."""

import hashlib
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from goldmeter.llm import licences, media, sharding
from goldmeter.llm.common import shared_folder


def test_png_round_trip():
    for samples in (b"\0" * 64, bytes(range(256)), b"ab" * 5000):
        image = media.to_png(samples)
        assert media.from_png(image) == samples and media.png_header(image[:33])[:3] == (len(samples), 1, 8)
    assert [len(media.payload(t)) for t in ("", "a", "a" * 64, "a" * 65)] == [64, 64, 64, 128]


def test_media_columns(spark, odd_docs, plain):
    folder = shared_folder(spark, "media-test")
    index = media.write_shards(odd_docs, folder, shard_bytes=20_000)
    facts = {r["digest"]: r for r in media.read_features(media.fill_metadata(media.spread(media.objects(index)), folder), folder).collect()}
    rows = index.collect()
    assert len(rows) == len(plain)
    texts = defaultdict(set)
    for k, t in plain:
        texts[k].add(t or "")
    for r in rows:
        f = facts[r["digest"]]
        body = next(t.encode() for t in texts[r["doc_id"]] if len(t.encode()) == r["n_bytes"])
        padded = body + b"\0" * (f["payload_bytes"] - len(body))
        assert f["payload_bytes"] % 64 == 0 and f["payload_bytes"] - len(body) <= 64 and f["width"] == f["payload_bytes"]
        assert f["payload_sha256"] == r["digest"] == hashlib.sha256(padded).hexdigest()
        assert f["tail_crc32"] == zlib.crc32(padded[-64:]) and f["media_bytes"] == f["length"]
    assert len({r["digest"] for r in rows}) < len(rows)


def test_shards_are_tar_files(spark, odd_docs):
    import tarfile

    from pyarrow import fs

    folder = shared_folder(spark, "media-tar")
    index = media.write_shards(odd_docs, folder).collect()
    store, base = fs.FileSystem.from_uri(folder)
    names = set()
    for shard in {r["shard"] for r in index}:
        with store.open_input_file(f"{base}/{shard}") as f, tarfile.open(fileobj=f) as tar:
            names |= set(tar.getnames())
    assert names == {f"{r['digest']}.png" for r in index}


def test_media_of_no_rows(spark, no_docs):
    folder = shared_folder(spark, "media-none")
    index = media.write_shards(no_docs, folder)
    assert media.read_features(media.fill_metadata(media.spread(media.objects(index)), folder), folder).count() == 0


def test_slots(spark, odd_docs, plain, no_docs):
    first = sharding.first_map(spark, 16)
    grown = sharding.grow(first, 16)
    rows = sharding.assign(odd_docs, first, grown).collect()
    assert len(rows) == len(plain)
    assert sorted((r["size"], r["text_crc32"]) for r in rows) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in plain)
    by_shard = defaultdict(list)
    for r in rows:
        assert r["grown_shard"] in (r["shard"], 16)
        by_shard[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in by_shard.values())
    where = defaultdict(set)
    for r in rows:
        where[r["doc_id"]].add((r["shard"], r["grown_shard"]))
    assert all(len(x) == 1 for x in where.values())
    moved = grown.filter("shard = 16").count()
    assert moved == 16 * (256 // 17) and grown.filter("version = 2").count() == sharding.SLOTS
    assert sharding.assign(no_docs, first).count() == 0 and sharding.assign(odd_docs, first).filter("grown_shard IS NOT NULL").count() == 0


def test_rebalance_moves_little_and_levels(spark):
    first = sharding.first_map(spark, 4, 64)
    loads = spark.range(64).select(F.col("id").cast("int").alias("virtual_slot"), F.when(F.col("id") % 4 == 0, 300).otherwise(100).alias("bytes"))
    after = sharding.rebalance(first, loads)
    sums = {r["shard"]: r["b"] for r in after.join(loads, "virtual_slot").groupBy("shard").agg(F.sum("bytes").alias("b")).collect()}
    assert after.count() == 64 and set(sums) == {0, 1, 2, 3} and max(sums.values()) <= 2400 * 1.25
    moved = after.join(first.withColumnRenamed("shard", "was"), "virtual_slot").filter("shard <> was")
    assert moved.filter("was <> 0").count() == 0 and 0 < moved.count() < 16


def test_stored_map_and_query(spark, tmp_path):
    folder = str(tmp_path)
    first = sharding.save_map(sharding.first_map(spark, 4, 64), folder)
    second = sharding.save_map(sharding.grow(first, 4), folder)
    assert {r["version"] for r in sharding.read_map(spark, folder).collect()} == {2} and {r["version"] for r in sharding.read_map(spark, folder, 1).collect()} == {1}
    assert sorted(map(tuple, sharding.read_map(spark, folder).collect())) == sorted(map(tuple, second.collect()))
    from goldmeter.llm import queries

    docs = [(i, "x" * (i * i % 97)) for i in range(3000)] + [(3000 + i, None) for i in range(5)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    rows = queries.QUERIES["op10_virtual_slots"](spark, folder).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(i for i, _ in docs)
    by = {}
    for r in rows:
        by.setdefault(r["virtual_slot"], []).append(r)
    assert all({r["slot_bytes"] for r in own} == {sum(r["size"] for r in own)} for own in by.values())

    def loads(column):
        sums = {}
        for r in rows:
            sums[r[column]] = sums.get(r[column], 0) + r["size"]
        return max(sums.values()) / (sum(sums.values()) / 16)

    assert loads("rebalanced_shard") <= max(1.1, loads("shard")) and len({(r["virtual_slot"], r["rebalanced_shard"]) for r in rows}) == len(by)
    assert any(r["rebalanced_shard"] != r["shard"] for r in rows)


def test_canonical_texts(spark):
    variants = [
        "Released under the MIT License.", "released UNDER the  MIT licence", "Copyright 2020 A. Body\nReleased under the MIT License.", "(c) me\n* Released under the MIT License *",
        "Released under the MIT License. And more.", "", None]
    docs = spark.createDataFrame([(i, v, "x") for i, v in enumerate(variants)], "doc_id long, text string, digest string")
    known = licences.known_licences(spark)
    got = {r["doc_id"]: r["licence"] for r in licences.scan(docs, known).collect()}
    assert got == {0: "MIT", 1: "MIT", 2: "MIT", 3: "MIT", 4: None, 5: None, 6: None}
    lines = licences.scan_lines(spark.createDataFrame([(1, "a\nReleased under the MIT license.\nb\nLicensed under CC BY-NC 4.0"), (2, "no"), (3, None)], "doc_id long, text string"), known).collect()
    assert sorted((r["doc_id"], r["licence"], r["lines"]) for r in lines) == [(1, "CC-BY-NC-4.0", 1), (1, "MIT", 1)]


def test_wrapped_licences_and_other_scripts(spark):
    """Files wrapped at every width are the licence; a notice within a text of another script is not all of it."""
    import textwrap

    known = licences.known_licences(spark)
    bodies = [(n, b) for n, b in licences.KNOWN if n in ("MIT", "ISC") and len(b) > 200]
    rows, want = [], {}
    for n, b in bodies:
        for width in range(30, 100):
            text = "\n\n".join(textwrap.fill(p, width) for p in b.replace("<year>", "2020").replace("<owner>", "José").replace("<copyright holders>", "Ann").split("\n\n"))
            want[len(rows)] = n
            rows.append((len(rows), text))
    for text in ("Это не лицензия.\nReleased under the MIT License.", "日本語 Released under the MIT License. テキスト", "Released under the MIT License. ２", "Это не лицензия."):
        want[len(rows)] = None
        rows.append((len(rows), text))
    want[len(rows)] = "MIT"
    rows.append((len(rows), "Copyright Jane Doe\n© 2020 Хозяин\n“Released under the MIT License.”"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["licence"] for r in licences.scan(docs, known).collect()} == want
    lines = spark.createDataFrame([(1, "Это Released under the MIT License.\nx"), (2, "x\nReleased under the MIT License.")], "doc_id long, text string")
    assert [r["doc_id"] for r in licences.scan_lines(lines, known).collect()] == [2]


def test_licences_of_odd_rows(spark, odd_docs, no_docs, plain):
    known = licences.known_licences(spark)
    assert licences.scan(odd_docs, known).count() == len(plain) and licences.scan(no_docs, known).count() == 0
    assert licences.scan_lines(no_docs, known).count() == 0
