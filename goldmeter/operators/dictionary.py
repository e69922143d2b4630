"""Dictionaries as tables: all places where a surface of a user's dictionary stands in a text, and names by dictionary.

A text and a surface are sequences of words (letters, numbers and underscores, lower case; whatever stands between them only
parts words). Every stretch of as many words as some surface has is looked up by an equi-join on its words, so a dictionary may
have any size: Spark broadcasts a small one and shuffles by words otherwise. One pass over a text serves all surfaces, and a
stretch never begins or ends inside a word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from goldmeter.functions.spans import with_offsets
from goldmeter.functions.text import computed_once, let, text_of

_SIGN = r"\p{L}\p{N}_"
WORD = f"[{_SIGN}]+"


def placed_words(text: Column) -> Column:
    """Array of (start, end, word) of a text's words, in order; word in lower case."""
    pieces = F.regexp_extract_all(text_of(text), F.lit(f"{WORD}|[^{_SIGN}]+"), 0)
    words = F.filter(with_offsets(pieces), lambda p: p["text"].rlike(f"^{WORD}"))
    return F.transform(words, lambda p: F.struct(p["start"].alias("start"), (p["start"] + F.length(p["text"])).alias("end"), F.lower(p["text"]).alias("word")))


def surface_words(surface: Column) -> Column:
    """A surface as its words, parted by one blank."""
    return F.array_join(F.regexp_extract_all(F.lower(text_of(surface)), F.lit(WORD), 0), " ")


def surfaces(dictionary: DataFrame) -> DataFrame:
    """gram, n (its words), surface, concept, rank: one row per sequence of words, that of the smallest rank, then concept.

    `dictionary` has surface, concept and perhaps rank. Surfaces without words are left out.
    """
    rank = F.col("rank") if "rank" in dictionary.columns else F.lit(0)
    rows = dictionary.select(surface_words(F.col("surface")).alias("gram"), F.struct(rank.cast("long").alias("rank"), F.col("concept").alias("concept"), F.col("surface").alias("surface")).alias("own"))
    best = rows.filter("gram <> ''").groupBy("gram").agg(F.min("own").alias("own"))
    return best.select("gram", F.size(F.split("gram", " ")).alias("n"), "own.surface", "own.concept", "own.rank")


def dictionary_hits(texts: DataFrame, dictionary: DataFrame, key: str = "document_id", text: str = "text") -> DataFrame:
    """key, word_no, n, char_start, char_end, surface, concept, rank: every place of every surface, overlapping ones too.

    Null texts have no hits. Repeated keys are texts of their own only if they differ from each other in their key.
    """
    known = surfaces(dictionary)
    lengths = sorted(r["n"] for r in known.select("n").distinct().collect())  # as many as surfaces have different word counts
    if not lengths:
        return texts.select(F.col(key), F.lit(0).alias("word_no"), F.lit(0).alias("n"), F.lit(0).alias("char_start"), F.lit(0).alias("char_end")).limit(0).join(
            known.select("surface", "concept", "rank").limit(0), F.lit(True), "inner")
    # one scanning task may hold all texts, so they are dealt out first; a text's words are told once, then a row for each place and
    # length is made outside of lambdas, in generated code
    dealt = texts.select(F.col(key), F.col(text).alias("_text")).repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.col(key))
    words = computed_once(dealt, [key], _words=placed_words(F.col("_text")))
    parts = computed_once(words, [key], _w=F.struct(*[F.col("_words")[c].alias(c) for c in ("start", "end", "word")]))
    places = parts.select(key, F.col("_w.start").alias("_s"), F.col("_w.end").alias("_e"), F.col("_w.word").alias("_g"))
    places = places.select(key, "_s", "_e", "_g", F.posexplode("_g").alias("word_no", "_first"))
    each = places.select(key, "_s", "_e", "_g", "word_no", F.explode(F.array(*[F.lit(n) for n in lengths])).alias("n")).filter(F.col("word_no") + F.col("n") <= F.size("_g"))
    gram = F.array_join(F.slice("_g", F.col("word_no") + 1, F.col("n")), " ")
    rows = each.select(key, "word_no", "n", F.get("_s", F.col("word_no")).alias("char_start"), F.get("_e", F.col("word_no") + F.col("n") - 1).alias("char_end"), gram.alias("gram"))
    return rows.join(known.drop("n"), "gram").select(key, "word_no", "n", "char_start", "char_end", "surface", "concept", "rank")


def longest_hits(hits: DataFrame, key: str = "document_id") -> DataFrame:
    """The hits that remain reading from the left: at each place the longest surface, then on behind it.

    Hits that touch no other are kept at once; the fold runs over stretches of overlapping hits only.
    """
    order = W.partitionBy(key).orderBy("word_no")
    first = hits.groupBy(key, "word_no").agg(F.max_by(F.struct("n", "char_start", "char_end", "surface", "concept"), "n").alias("h")).select(key, "word_no", "h.*")
    reach = F.max(F.col("word_no") + F.col("n")).over(order.rowsBetween(W.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col("word_no") >= reach), 1).otherwise(0)
    marked = first.withColumn("_opens", opens).withColumn("_cluster", F.sum("_opens").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    cluster = marked.groupBy(key, "_cluster").agg(F.sort_array(F.collect_list(F.struct("word_no", "n", "char_start", "char_end", "surface", "concept"))).alias("all"))

    def step(state, hit):
        taken = hit["word_no"] >= state["next"]
        return F.struct(F.when(taken, hit["word_no"] + hit["n"]).otherwise(state["next"]).alias("next"), F.when(taken, F.array_append(state["kept"], hit)).otherwise(state["kept"]).alias("kept"))

    start = F.struct(F.lit(0).alias("next"), F.slice("all", 1, 0).alias("kept"))
    return cluster.select(key, F.inline(F.aggregate("all", start, step, lambda s: s["kept"])))


def dictionary_names(values: DataFrame, column: str, dictionary: DataFrame, name: str = "name") -> DataFrame:
    """All columns and `name`: the concept of the longest surface in the value (most characters, then smallest rank), else the value.

    Each distinct value is looked up once. A null value has a null name.
    """
    own = values.select(F.col(column).alias("_value")).filter(F.col("_value").isNotNull()).distinct()
    hits = dictionary_hits(own, dictionary, "_value", "_value")
    best = hits.groupBy("_value").agg(F.max_by("concept", F.struct(F.length("surface"), -F.col("rank"))).alias("_concept"))
    return values.join(best, values[column] == best["_value"], "left").withColumn(name, F.coalesce("_concept", F.col(column))).drop("_value", "_concept")
