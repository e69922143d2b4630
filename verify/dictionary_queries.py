"""Dictionaries as tables: stretches of benchmark passages looked up in all documents, and names of the part table."""

from __future__ import annotations

from pyspark.sql import functions as F

from goldmeter.functions import normalize as N
from goldmeter.functions import vocabulary as V
from goldmeter.functions.text import let, slice_text
from goldmeter.operators import dictionary as D
from verify.base import query, table
from verify.function_queries import MED_NAME_SQL, med_text


def passage_surfaces(spark, d):
    """Two to four words at every third place of every benchmark passage; concept: the passage."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(D.WORD), 0)
    rows = table(spark, d, "benchmark").select(F.concat(F.lit("c"), F.col("item_id").cast("string")).alias("concept"), words.alias("w"))
    cut = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 1, F.lit(3)), lambda i: F.slice(w, i + 1, F.lit(2) + (i / 3).cast("int") % 3))
    grams = rows.filter(F.size("w") > 0).select("concept", F.explode(let(F.col("w"), cut)).alias("g"))
    return grams.filter(F.size("g") > 1).select(F.array_join("g", " ").alias("surface"), "concept")


_WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')"
_HITS = f"""bw AS (SELECT 'c' || item_id AS concept, {_WORDS} AS w FROM benchmark), bp AS (SELECT concept, w, unnest(range(0, len(w), 3)) AS i FROM bw),
bg AS (SELECT concept, array_to_string(w[i + 1 : i + 2 + (i // 3) % 3], ' ') AS gram FROM bp WHERE i + 2 <= len(w)),
dict AS (SELECT gram, min(concept) AS concept FROM bg GROUP BY 1), dw AS (SELECT doc_id, {_WORDS} AS w FROM documents),
dg AS (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM dw),
dn AS (SELECT doc_id, i AS word_no, n, array_to_string(w[i + 1 : i + n], ' ') AS gram FROM dg, (VALUES (2), (3), (4)) v(n) WHERE i + n <= len(w)),
hit AS (SELECT doc_id, CAST(word_no AS INT) AS word_no, n, gram AS surface, concept FROM dn JOIN dict USING (gram))"""


def passage_hits(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return docs, D.dictionary_hits(docs, passage_surfaces(spark, d), "doc_id")


@query("dictionary_hits", f"WITH {_HITS} SELECT doc_id, word_no, n, surface, concept, true AS stands_there FROM hit")
def dictionary_hits(spark, d):
    docs, hits = passage_hits(spark, d)
    there = D.surface_words(slice_text(F.col("text"), F.col("char_start"), F.col("char_end"))) == F.col("surface")
    return hits.join(docs, "doc_id").select("doc_id", "word_no", "n", "surface", "concept", there.alias("stands_there"))


@query("dictionary_longest_hits", f"""WITH RECURSIVE {_HITS}, best AS (SELECT doc_id, word_no, max(n) AS n, arg_max(surface, n) AS surface, arg_max(concept, n) AS concept FROM hit GROUP BY 1, 2),
nx AS (SELECT a.*, b.word_no AS follows FROM best a ASOF LEFT JOIN best b ON a.doc_id = b.doc_id AND a.word_no + a.n <= b.word_no),
kept AS (SELECT * FROM nx WHERE (doc_id, word_no) IN (SELECT (doc_id, min(word_no)) FROM best GROUP BY doc_id) UNION ALL SELECT n.* FROM kept k JOIN nx n ON n.doc_id = k.doc_id AND n.word_no = k.follows)
SELECT doc_id, word_no, n, surface, concept FROM kept""")
def dictionary_longest_hits(spark, d):
    return D.longest_hits(passage_hits(spark, d)[1], "doc_id").select("doc_id", "word_no", "n", "surface", "concept")


@query("dictionary_table_names", MED_NAME_SQL + "SELECT p_partkey, coalesce(concept, bare) AS medication FROM b LEFT JOIN (SELECT * FROM hit WHERE rn = 1) h USING (bare)")
def dictionary_table_names(spark, d):
    rows = [(s, c, i) for i, (s, c) in enumerate(V.MEDICATION_SYNONYMS.items())]
    known = spark.createDataFrame(rows, "surface string, concept string, rank int")
    bare = table(spark, d, "part").select("p_partkey", N.medication_surface(med_text()).alias("bare"))
    return D.dictionary_names(bare, "bare", known, "medication").select("p_partkey", "medication")
