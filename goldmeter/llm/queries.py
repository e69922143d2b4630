"""The registered queries of this subpackage and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldmeter.llm import dedup, idstore, language, licences, lm, media, nearest, packing, quality, repeats, sharding, tokens, turns
from goldmeter.llm.common import remainder, shared_folder, stored, table, vocabulary

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_KNOWN_SQL = " UNION ALL ".join(f"SELECT {_quoted(n)} AS licence, {_quoted(t)} AS body" for n, t in licences.KNOWN)


@query("op1_media_columns")
def op1(spark, d):
    """Every text stored as an image in tar shards and read back; rows of one digest share the image."""
    folder = shared_folder(spark, "media")
    index = media.write_shards(table(spark, d, "documents"), folder)
    facts = media.read_features(media.fill_metadata(media.spread(media.objects(index)), folder), folder)
    return index.select("doc_id", "n_bytes", "digest").join(facts, "digest").select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature",
        "width", "height", "bits", "digest", "shard", "offset", "length")


def _held_out(df: DataFrame, modulus: int) -> DataFrame:
    return df.withColumn("held_out", remainder(F.col("doc_id"), modulus) == 0)


@query("op2_language_ppm")
def op2(spark, d):
    """Language of every text, learned from the rows not held out."""
    docs = table(spark, d, "documents")
    return _held_out(language.identify(docs, language.train(docs)), 5)


@query("op3_multiprobe_neighbours")
def op3(spark, d):
    """The 20 nearest of every twentieth vector."""
    return nearest.search(table(spark, d, "embeddings"), F.col("id") % 20 == 0)


@query("op4_quality_pu")
def op4(spark, d):
    """Quality score of every text, learned from labels of the rows not held out."""
    docs = table(spark, d, "documents")
    scored = quality.score(docs, quality.train(docs, table(spark, d, "labels")))
    return _held_out(scored, 5).withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


@query("op5_deleted_interpolation")
def op5(spark, d):
    """Scores of every text by the model learned from nine tenths of the documents."""
    return lm.score(table(spark, d, "documents"))


@query("op6_vector_packing")
def op6(spark, d):
    """All documents packed into sequences of at most 4096 tokens."""
    return packing.pack(table(spark, d, "documents"), vocabulary("word_bpe_49k.json"))


_TOKENS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"


@query("op7_minhash_components", f"""WITH RECURSIVE w AS (SELECT doc_id, {_TOKENS} AS t FROM documents),
 s AS (SELECT DISTINCT doc_id, CASE WHEN len(t) = 1 THEN t[1] ELSE t[i] || ' ' || t[i + 1] END AS g FROM (SELECT doc_id, t, unnest(range(1, greatest(len(t), 2))) AS i FROM w WHERE len(t) > 0)),
 sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 sets AS (SELECT doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS h FROM s GROUP BY 1),
 reps AS (SELECT h, min(doc_id) AS cid FROM sets GROUP BY 1),
 rs AS (SELECT s.doc_id, s.g, z.n FROM s JOIN reps ON reps.cid = s.doc_id JOIN sizes z ON z.doc_id = s.doc_id),
 shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c, any_value(a.n) AS nx, any_value(b.n) AS ny FROM rs a JOIN rs b ON a.g = b.g AND a.doc_id < b.doc_id AND a.n * 100 >= b.n * 80 AND b.n * 100 >= a.n * 80 GROUP BY 1, 2),
 e AS (SELECT x, y FROM shared WHERE 100 * c >= 80 * (nx + ny - c)),
 reach(x, y) AS (SELECT cid, cid FROM reps UNION SELECT r.x, CASE WHEN e.x = r.y THEN e.y ELSE e.x END FROM reach r JOIN e ON r.y = e.x OR r.y = e.y),
 comp AS (SELECT x AS cid, min(y) AS comp FROM reach GROUP BY 1)
 SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, coalesce(c.comp, d.doc_id) AS component_id, d.doc_id = coalesce(c.comp, d.doc_id) AS kept
 FROM documents d LEFT JOIN sizes z ON z.doc_id = d.doc_id LEFT JOIN sets t ON t.doc_id = d.doc_id LEFT JOIN reps USING (h) LEFT JOIN comp c USING (cid)""")
def op7(spark, d):
    """Component of every document under links of similarity 0.8 or more."""
    return dedup.near_duplicates(table(spark, d, "documents"))


@query("op8_token_automaton")
def op8(spark, d):
    """Digests of every text's token ids and of the text decoded from them."""
    path = vocabulary("byte_bpe_50k.json")
    coded = tokens.decode(tokens.encode(table(spark, d, "documents"), path), path)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


@query("op9_licence_digests", f"""WITH known AS (SELECT sha256({licences.canonical_sql('body')}) AS digest, min(licence) AS licence FROM ({_KNOWN_SQL}) GROUP BY 1),
 whole AS (SELECT doc_id, sha256({licences.canonical_sql('text')}) AS digest FROM documents),
 lines AS (SELECT doc_id, sha256({licences.canonical_sql('line')}) AS digest FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents) WHERE regexp_matches(line, '(?i)licen|permission|redistribut')),
 notices AS (SELECT doc_id, count(*) AS notice_lines, min(licence) AS notice FROM lines JOIN known USING (digest) GROUP BY 1)
 SELECT w.doc_id, w.digest, k.licence, n.notice, coalesce(n.notice_lines, 0) AS notice_lines FROM whole w LEFT JOIN known k USING (digest) LEFT JOIN notices n USING (doc_id)""")
def op9(spark, d):
    """Every document's canonical digest, the licence its whole text is, and the licence notices standing as lines in it."""
    docs, known = table(spark, d, "documents"), licences.known_licences(spark)
    notices = licences.scan_lines(docs, known).groupBy("doc_id").agg(F.sum("lines").alias("notice_lines"), F.min("licence").alias("notice"))
    return licences.scan(docs, known).join(notices, "doc_id", "left").select("doc_id", "digest", "licence", "notice", F.coalesce("notice_lines", F.lit(0)).alias("notice_lines"))


@query("op10_virtual_slots")
def op10(spark, d):
    """All documents in 16 shards by `key`, where each goes when a 17th is added, the bytes of its virtual slot, and its shard once
    the stored map has been edited for those bytes."""
    folder = shared_folder(spark, "slot-map")
    first = sharding.save_map(sharding.first_map(spark, 16), folder)
    grown = sharding.grow(first, 16)
    placed = sharding.assign(table(spark, d, "documents"), first, grown).withColumn("law", F.lit("key"))
    loads = stored(sharding.slot_bytes(placed), "slot-loads")  # one row per slot at most
    sharding.save_map(sharding.rebalance(first, loads), folder)
    edited = sharding.read_map(spark, folder).select("virtual_slot", F.col("shard").alias("rebalanced_shard"))
    facts = edited.join(loads.select("virtual_slot", F.col("bytes").alias("slot_bytes")), "virtual_slot")
    return placed.join(F.broadcast(facts), "virtual_slot")


_WORDS = "regexp_extract_all({}, '[^\\\\x20\\\\x09-\\\\x0D]+', 0)"


def with_repeats(docs: DataFrame) -> DataFrame:
    """Texts of ids whose crc32 is divisible by 10 get a repeated end: from word a on, the p words from a again and again."""
    h = F.crc32(F.col("doc_id").cast("string"))
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), h.alias("h"), F.floor(h / 10).alias("g"))
    words = docs.withColumn("w", F.when(F.col("h") % 10 == 0, F.expr(_WORDS.format("text"))))
    n = F.size("w")
    words = words.withColumn("n", n).withColumn("a", F.when(n > 0, F.col("g") % n)).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    repeated = F.expr("array_join(transform(w, (x, i) -> if(i < a, x, w[int(a + (i - a) % p)])), ' ')")
    return words.select("doc_id", F.when(F.col("n") > 0, repeated).otherwise(F.col("text")).alias("text"))


@query("op13_basic_factors")
def op13(spark, d):
    """Runs of every text's words, the longest run, and the text without what runs repeat."""
    found = repeats.find_runs(with_repeats(table(spark, d, "documents")))
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    best = F.expr("array_min(transform(runs, r -> struct(-r.length AS n, r.start AS start, r.period AS period)))")
    length = -F.col("best.n")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"),
        F.floor(1000 * length / F.col("best.period")).alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))


def damaged(turns: DataFrame) -> DataFrame:
    """Every twentieth row is dropped (`present` is false), emptied, bereft of sentence ends, doubled or given the role user."""
    space = F.lit(" ")
    own = turns.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    place = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    own = own.withColumn("k", F.crc32(place) % 20)
    k = F.col("k")
    text = F.when(k == 1, "").when(k == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(k == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return own.select("conv_id", "turn", F.when(k == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (k != 0).alias("present"), copies)


@query("op11_branch_and_bound")
def op11(spark, d):
    """Faults of every conversation, its cheapest edits, and the digest of the conversation they give."""
    rows = damaged(table(spark, d, "conversations"))
    plans = stored(turns.plan_repairs(rows, present=F.col("present")), "plans")
    digests = turns.text_digests(turns.repaired_turns(rows, plans, present=F.col("present")))
    digests = digests.withColumnRenamed("conv_id", "of")
    empty = F.sha2(F.lit(""), 256)
    return plans.join(digests, F.col("conv_id").eqNullSafe(F.col("of")), "left").drop("of").withColumn("repaired_sha256", F.coalesce("repaired_sha256", empty))


@query("op12_perfect_hash_ids")
def op12(spark, d):
    """Every document's ids written to indexed shards and looked up there by its key."""
    folder = shared_folder(spark, "ids")
    places = stored(idstore.write_shards(table(spark, d, "documents"), folder, vocabulary("byte_bpe_50k.json")), "places")
    shards = stored(idstore.catalogue(places, folder), "shards").select("number", "base")
    found = idstore.read_documents(places, folder)
    return found.join(shards, "number").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
