"""Set matching, reports, joins and interval joins over orders/lineitem, documents/labels and events."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from goldmeter.operators import intervals as I
from goldmeter.operators import matching as M
from goldmeter.operators import segments as SG
from goldmeter.operators import selection as SEL
from goldmeter.operators import statistics as ST
from goldmeter.sources.runs import union_runs
from verify.base import pick, query, table

# predicted medications of an order = parts with a discount of at least 5 %, gold = returned parts
PRED = "pred AS (SELECT DISTINCT l_orderkey AS d, l_partkey % 400 AS k FROM lineitem WHERE l_discount >= 0.05)"
GOLD = "gold AS (SELECT DISTINCT l_orderkey AS d, l_partkey % 400 AS k FROM lineitem WHERE l_returnflag = 'R')"
FLAGS = f"{PRED}, {GOLD}, f AS (SELECT coalesce(p.d, g.d) AS d, coalesce(p.k, g.k) AS k, p.d IS NOT NULL AS ip, g.d IS NOT NULL AS ig FROM pred p FULL JOIN gold g ON p.d = g.d AND p.k = g.k)"
RATES = """CASE WHEN tp + fp > 0 THEN tp / (tp + fp) WHEN fn = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1.0::DOUBLE END AS recall"""
F1 = "CASE WHEN precision + recall > 0 THEN 2.0::DOUBLE * precision * recall / (precision + recall) ELSE 0.0::DOUBLE END AS f1"


def set_sides(spark, d):
    li = table(spark, d, "lineitem").withColumn("document_id", F.col("l_orderkey")).withColumn("key", F.col("l_partkey") % 400)
    return li.filter("l_discount >= 0.05").select("document_id", "key"), li.filter("l_returnflag = 'R'").select("document_id", "key")


def flags_of(spark, d):
    return M.set_flags(*set_sides(spark, d), ["document_id", "key"])


@query("document_set_match", f"""WITH {FLAGS}, c AS (SELECT d AS document_id, count(*) FILTER (ip AND ig) AS tp, count(*) FILTER (ip AND NOT ig) AS fp, count(*) FILTER (ig AND NOT ip) AS fn FROM f GROUP BY 1),
r AS (SELECT *, {RATES} FROM c) SELECT *, {F1} FROM r""")
def document_set_match(spark, d):
    return M.with_rates(M.count_flags(flags_of(spark, d), ["document_id"]))


@query("micro_precision_recall", f"""WITH {FLAGS}, c AS (SELECT d % 5 AS shard, count(*) FILTER (ip AND ig) AS tp, count(*) FILTER (ip AND NOT ig) AS fp, count(*) FILTER (ig AND NOT ip) AS fn FROM f GROUP BY 1),
r AS (SELECT *, {RATES} FROM c) SELECT *, {F1} FROM r""")
def micro_precision_recall(spark, d):
    return M.micro_table(flags_of(spark, d).withColumn("shard", F.col("document_id") % 5), ["shard"])


@query("label_precision_recall", f"""WITH {FLAGS}, c AS (SELECT 'S' || (d % 3) AS system, CASE WHEN grouping(k) = 1 THEN '__micro__' ELSE CAST(k AS VARCHAR) END AS label,
 count(*) FILTER (ip AND ig) AS tp, count(*) FILTER (ip AND NOT ig) AS fp, count(*) FILTER (ig AND NOT ip) AS fn FROM f GROUP BY GROUPING SETS ((d % 3, k), (d % 3))),
r AS (SELECT *, {RATES} FROM c) SELECT *, {F1} FROM r""")
def label_precision_recall(spark, d):
    f = flags_of(spark, d).withColumn("system", F.concat(F.lit("S"), (F.col("document_id") % 3).cast("string"))).withColumn("key", F.col("key").cast("string"))
    return M.label_table(f, ["system"])


@query("set_intersection_difference", f"""WITH {PRED}, {GOLD}
SELECT 'both' AS side, count(*) AS n FROM (SELECT * FROM pred INTERSECT SELECT * FROM gold) UNION ALL SELECT 'pred_only', count(*) FROM (SELECT * FROM pred EXCEPT SELECT * FROM gold)
UNION ALL SELECT 'gold_only', count(*) FROM (SELECT * FROM gold EXCEPT SELECT * FROM pred)""")
def set_intersection_difference(spark, d):
    side = F.when(F.col("in_pred") & F.col("in_gold"), "both").when(F.col("in_pred"), "pred_only").otherwise("gold_only")
    return flags_of(spark, d).groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("n"))


@query("label_universe", f"WITH {PRED}, {GOLD} SELECT DISTINCT k AS key FROM (SELECT k FROM pred UNION ALL SELECT k FROM gold)")
def label_universe(spark, d):
    p, g = set_sides(spark, d)
    return p.select("key").union(g.select("key")).distinct()


# class report: gold = label quality, predicted = a length and language rule
CLS = """cls AS (SELECT d.doc_id, d.lang, CAST(quality AS VARCHAR) AS gold, CASE WHEN n_chars > 1500 THEN '1' WHEN n_chars < 300 THEN 'short' ELSE '0' END AS predicted FROM documents d JOIN labels USING (doc_id))"""


def class_pairs(spark, d):
    doc, lab = table(spark, d, "documents").select("doc_id", "lang", "n_chars"), table(spark, d, "labels")
    j = doc.join(lab, "doc_id")
    pred = F.when(F.col("n_chars") > 1500, "1").when(F.col("n_chars") < 300, "short").otherwise("0")
    return j.select("doc_id", "lang", F.col("quality").cast("string").alias("gold"), pred.alias("predicted"))


CLASS_ROWS = f"""{CLS}, lab AS (SELECT DISTINCT lang, gold AS class FROM cls UNION SELECT DISTINCT lang, predicted FROM cls),
c AS (SELECT lab.lang, lab.class, count(*) FILTER (gold = class AND predicted = class) AS tp, count(*) FILTER (gold <> class AND predicted = class) AS fp,
 count(*) FILTER (gold = class AND predicted <> class) AS fn, count(*) FILTER (gold = class) AS support FROM lab JOIN cls USING (lang) GROUP BY 1, 2),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0::DOUBLE END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0::DOUBLE END AS recall FROM c),
rows_ AS (SELECT *, {F1} FROM r)"""


@query("class_rows", f"WITH {CLASS_ROWS} SELECT * FROM rows_")
def class_rows(spark, d):
    return M.class_rows(M.pair_counts(class_pairs(spark, d), "gold", "predicted", ["lang"]), ["lang"])


@query("class_report", f"WITH {CLASS_ROWS} SELECT lang, sum(tp) / sum(support) AS micro_f1, avg(f1) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1, CAST(sum(support) AS BIGINT) AS support FROM rows_ GROUP BY 1")
def class_report(spark, d):
    return M.class_report(M.pair_counts(class_pairs(spark, d), "gold", "predicted", ["lang"]), ["lang"])


@query("document_accuracy", f"WITH {CLS} SELECT lang, count(*) AS documents, count(*) FILTER (gold = predicted) AS correct, avg(CAST(gold = predicted AS INT)) AS accuracy FROM cls GROUP BY 1")
def document_accuracy(spark, d):
    return M.accuracy_table(class_pairs(spark, d).withColumn("correct", F.col("gold") == F.col("predicted")), ["lang"])


@query("expected_available", """SELECT s.system, count(*) AS expected, count(l.doc_id) FILTER (s.system = 'A' OR quality = 1) AS available FROM documents d, (VALUES ('A'), ('B')) s(system) LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1""")
def expected_available(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"))
    lab = table(spark, d, "labels").withColumnRenamed("doc_id", "document_id")
    found = M.expected_pairs(lab, ["A"]).unionByName(M.expected_pairs(lab.filter("quality = 1"), ["B"]))
    out = M.expected_available(M.expected_pairs(docs, ["A", "B"]), found, ["system", "document_id"])
    return out.groupBy("system").agg(F.count(F.lit(1)).alias("expected"), F.count_if("available").alias("available"))


@query("containment_match", """WITH p AS (SELECT o_orderkey AS k, (['focal', 'focal epilepsy', 'epi', 'migraine', ''])[o_custkey % 5 + 1] AS value FROM orders),
g AS (SELECT l_orderkey AS k, (['epilepsy', 'focal', 'generalized epilepsy', 'focal epilepsy with aura'])[l_partkey % 4 + 1] AS label FROM lineitem)
SELECT k AS document_id, value, coalesce(bool_or(value <> '' AND (contains(value, label) OR contains(label, value))), false) AS correct FROM p LEFT JOIN g USING (k) GROUP BY 1, 2""")
def containment_match(spark, d):
    p = table(spark, d, "orders").select(F.col("o_orderkey").alias("document_id"), pick(["focal", "focal epilepsy", "epi", "migraine", ""], F.col("o_custkey")).alias("value"))
    g = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), pick(["epilepsy", "focal", "generalized epilepsy", "focal epilepsy with aura"], F.col("l_partkey")).alias("label"))
    return M.containment_match(p, g, ["document_id"])


@query("present_among", """SELECT l_returnflag AS flag, count(*) AS n, count(*) FILTER ((l_orderkey, l_partkey % 7) IN (SELECT l_orderkey, l_suppkey % 7 FROM lineitem)) AS found FROM lineitem GROUP BY 1""")
def present_among(spark, d):
    li = table(spark, d, "lineitem")
    left = li.select("l_orderkey", (F.col("l_partkey") % 7).alias("key"), F.col("l_returnflag").alias("flag"))
    right = li.select("l_orderkey", (F.col("l_suppkey") % 7).alias("key"))
    return M.present_among(left, right, ["l_orderkey", "key"]).groupBy("flag").agg(F.count(F.lit(1)).alias("n"), F.count_if("found").alias("found"))


# ---- spans derived from lineitem ------------------------------------------------------

LABELS = ["Diagnosis", "Prescription", "SeizureFrequency", "PatientHistory"]
_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate"
ANN = f"""ann AS (SELECT l_orderkey AS d, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS n, (['Diagnosis', 'Prescription', 'SeizureFrequency', 'PatientHistory'])[l_linenumber % 4 + 1] AS label,
 CAST((l_partkey % 12) * 10 AS INT) AS s, CAST((l_partkey % 12) * 10 + 3 + CAST(floor(l_quantity) AS INT) % 25 AS INT) AS e, l_suppkey % 4 AS dose, CASE WHEN l_suppkey % 3 = 0 THEN '' ELSE (['p', 'q', 'r'])[l_partkey % 3 + 1] END AS concept, l_returnflag AS rf FROM lineitem)"""


def annotations(spark, d):
    """Annotation table of the driver: one annotation per order line."""
    w = W.partitionBy("l_orderkey").orderBy(*[F.asc_nulls_last(c.strip()) for c in _ORDER.split(",")])
    # numbered before anything is derived, so that only the table's own columns are shuffled
    li = table(spark, d, "lineitem").withColumn("line_no", F.row_number().over(w))
    s = (F.col("l_partkey") % 12) * 10
    concept = F.when(F.col("l_suppkey") % 3 != 0, pick(["p", "q", "r"], F.col("l_partkey")))
    attrs = F.map_filter(F.create_map(F.lit("DrugDose"), (F.col("l_suppkey") % 4).cast("string"), F.lit("CUIPhrase"), concept), lambda k, v: v.isNotNull())
    return li.select(
        F.col("l_orderkey").alias("document_id"), "line_no", pick(LABELS, F.col("l_linenumber")).alias("label"),
        s.cast("int").alias("char_start"), (s + 3 + F.floor("l_quantity") % 25).cast("int").alias("char_end"), attrs.alias("attributes"), "l_returnflag"
    ).withColumn("ann_id", F.concat(F.lit("T"), F.col("line_no").cast("string"))).withColumn("annotation_text", F.concat(F.lit("x"), F.col("ann_id")))


CONFLICT = f"""{ANN}, pr AS (SELECT a.d, a.label, a.n AS an, b.n AS bn, greatest(0, least(a.e, b.e) - greatest(a.s, b.s)) / least(a.e - a.s, b.e - b.s) AS frac, a.dose <> b.dose AS clash,
 (a.concept <> '' AND b.concept <> '' AND a.concept <> b.concept) AS named FROM ann a JOIN ann b ON a.d = b.d AND a.label = b.label AND a.n < b.n),
ct AS (SELECT *, CASE WHEN clash THEN 'tier1_numeric_conflict' WHEN named THEN 'tier2_cuiphrase_mismatch' WHEN frac >= 0.99 THEN 'tier3_exact_duplicate' ELSE 'tier3_overlap_no_conflict' END AS tier FROM pr WHERE frac >= 0.3)"""


@query("annotation_conflict_pairs", f"WITH {CONFLICT} SELECT d AS document_id, label, 'T' || an AS l_id, 'T' || bn AS r_id, frac AS overlap_fraction, tier FROM ct")
def annotation_conflict_pairs(spark, d):
    return I.conflict_pairs(annotations(spark, d)).select("document_id", "label", "l_id", "r_id", "overlap_fraction", "tier")


@query("annotation_conflict_counts", f"WITH {CONFLICT} SELECT d AS document_id, label, tier, count(*) AS pairs FROM ct GROUP BY 1, 2, 3")
def annotation_conflict_counts(spark, d):
    return I.conflict_counts(annotations(spark, d))


@query("same_span_types", f"""WITH {ANN} SELECT d AS document_id, s AS char_start, e AS char_end, count(*) AS annotations, string_agg(DISTINCT label, '|' ORDER BY label) AS labels,
 'xT' || min(n) AS annotation_text FROM ann GROUP BY 1, 2, 3 HAVING count(*) > 1""")
def same_span_types(spark, d):
    return I.same_span_types(annotations(spark, d))


@query("evidence_gold_overlap", f"""WITH {ANN}, ev AS (SELECT * FROM ann WHERE rf <> 'R'), gs AS (SELECT * FROM ann WHERE rf = 'R')
SELECT ev.d AS document_id, ev.label, ev.n AS line_no, CASE WHEN ev.n % 3 <> 0 THEN EXISTS (SELECT 1 FROM gs WHERE gs.d = ev.d AND gs.label = ev.label AND least(ev.e, gs.e) > greatest(ev.s, gs.s))
 ELSE EXISTS (SELECT 1 FROM gs WHERE gs.d = ev.d AND gs.label = ev.label AND (contains('s' || gs.s || 'e' || gs.e, 's' || ev.s) OR contains('s' || ev.s, 's' || gs.s || 'e' || gs.e))) END AS overlaps_gold FROM ev""")
def evidence_gold_overlap(spark, d):
    start, end = F.col("char_start"), F.col("char_end")
    quote = F.concat(F.lit("s"), start.cast("string"))
    value = F.concat(quote, F.lit("e"), end.cast("string"))
    rows = annotations(spark, d).filter("l_returnflag IS NOT NULL").select(
        "document_id", "label", "line_no", start, end, (F.col("line_no") % 3 != 0).alias("placed"), quote.alias("quote_norm"),
        F.when(F.col("l_returnflag") == "R", F.struct(start.alias("start"), end.alias("end"), value.alias("value_norm"))).alias("gold"))
    return I.mark_overlaps(rows, ["document_id", "label"]).select("document_id", "label", "line_no", "overlaps_gold")


@query("table_offset_issues", f"""WITH {ANN}, t AS (SELECT o_orderkey AS d, (['Diagnosis', 'Prescription', 'Onset'])[o_custkey % 3 + 1] AS label, CAST((o_custkey % 12) * 10 + o_orderkey % 3 AS INT) AS s0, CAST((o_custkey % 12) * 10 + 14 AS INT) AS e0 FROM orders)
SELECT d AS document_id, label, s0 AS start, e0 AS "end", CASE WHEN NOT EXISTS (SELECT 1 FROM ann WHERE ann.d = t.d) THEN 'doc_not_in_ann' WHEN NOT EXISTS (SELECT 1 FROM ann WHERE ann.d = t.d AND ann.label = t.label) THEN 'entity_type_not_in_doc'
 WHEN EXISTS (SELECT 1 FROM ann WHERE ann.d = t.d AND ann.label = t.label AND s = s0 AND e = e0) THEN 'ok'
 WHEN EXISTS (SELECT 1 FROM ann WHERE ann.d = t.d AND ann.label = t.label AND abs(s - s0) <= 2 AND abs(e - e0) <= 2) THEN 'offset_near_match' ELSE 'offset_mismatch' END AS issue FROM t""")
def table_offset_issues(spark, d):
    s = (F.col("o_custkey") % 12) * 10
    rows = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("document_id"), pick(["Diagnosis", "Prescription", "Onset"], F.col("o_custkey")).alias("label"),
        (s + F.col("o_orderkey") % 3).cast("int").alias("start"), (s + 14).cast("int").alias("end"))
    return I.table_offset_issues(rows, annotations(spark, d))


STATE = """st AS (SELECT user_id AS d, CASE WHEN event_type = 'error' AND value < 20 THEN 'free' WHEN event_type = 'purchase' AND value < 40 THEN 'active' ELSE 'other' END AS state, (['', 'During', 'Since'])[CAST(json_extract_string(props, '$.k') AS INT) % 3 + 1] AS scope FROM events)"""


@query("contradiction_counts", f"""WITH {STATE}, pr AS (SELECT f.d, f.scope AS fs, a.scope AS asx FROM st f JOIN st a ON f.d = a.d AND f.state = 'free' AND a.state = 'active')
SELECT d AS document_id, (SELECT count(*) FROM st WHERE st.d = pr.d AND state = 'free') AS free, (SELECT count(*) FROM st WHERE st.d = pr.d AND state = 'active') AS active, count(*) AS pairs,
 count(*) FILTER (fs <> '' AND asx <> '' AND fs <> asx) AS resolvable_pairs FROM pr GROUP BY 1""")
def contradiction_counts(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    state = F.when((F.col("event_type") == "error") & (F.col("value") < 20), "free").when((F.col("event_type") == "purchase") & (F.col("value") < 40), "active").otherwise("other")
    st = table(spark, d, "events").select(F.col("user_id").alias("document_id"), state.alias("state"), pick(["", "During", "Since"], k).alias("scope"))
    return I.contradiction_counts(st)


SEG = f"""{ANN}, tx AS (SELECT o_orderkey AS d, 160 AS len FROM orders), sp AS (SELECT ann.d, s, e, CASE WHEN rf = 'R' THEN 1 ELSE 0 END AS g FROM ann JOIN tx USING (d) WHERE e <= len),
edge AS (SELECT d, s AS p FROM sp UNION SELECT d, e FROM sp UNION SELECT d, 0 FROM tx UNION SELECT d, len FROM tx), sg AS (SELECT d, p AS a, lead(p) OVER (PARTITION BY d ORDER BY p) AS b FROM edge)"""


@query("text_segments", f"""WITH {SEG}, c AS (SELECT sg.d, a, b, count(sp.d) FILTER (g = 1) AS gs, count(sp.d) FILTER (g = 0) AS ps FROM sg LEFT JOIN sp ON sp.d = sg.d AND sp.s <= a AND sp.e >= b WHERE b IS NOT NULL GROUP BY 1, 2, 3)
SELECT d AS document_id, a AS start, b AS "end", gs AS gold_spans, ps AS pred_spans, CASE WHEN gs > 0 AND ps > 0 THEN 'both' WHEN gs > 0 THEN 'gold' WHEN ps > 0 THEN 'pred' ELSE 'plain' END AS kind FROM c""")
def text_segments(spark, d):
    texts = table(spark, d, "orders").select(F.col("o_orderkey").alias("document_id"), F.lit(160).alias("length"))
    side = F.when(F.col("l_returnflag") == "R", "gold").otherwise("pred")
    spans = annotations(spark, d).select("document_id", F.col("char_start").alias("start"), F.col("char_end").alias("end"), "label", side.alias("side"))
    return I.segments(texts, spans)


@query("segment_labels", f"""WITH {SEG}, sl AS (SELECT ann.d, s, e, label, 'T' || n AS id, rf = 'R' AS gold FROM ann JOIN tx USING (d) WHERE e <= len),
c AS (SELECT sg.d, a, b, list(label) FILTER (gold) AS gl, list(id) FILTER (gold) AS gi, list(label) FILTER (NOT gold) AS pl, list(id) FILTER (NOT gold) AS pi FROM sg LEFT JOIN sl ON sl.d = sg.d AND sl.s <= a AND sl.e >= b WHERE b IS NOT NULL GROUP BY 1, 2, 3)
SELECT d AS document_id, a AS start, b AS "end", {', '.join(f"coalesce(array_to_string(list_sort({x}), '|'), '') AS {n}" for x, n in (("list_distinct(gl)", "gold_labels"), ("gi", "gold_ids"), ("list_distinct(pl)", "pred_labels"), ("pi", "pred_ids")))},
 CASE WHEN gi IS NOT NULL AND pi IS NOT NULL THEN 'both' WHEN gi IS NOT NULL THEN 'gold' WHEN pi IS NOT NULL THEN 'pred' ELSE 'plain' END AS kind FROM c""")
def segment_labels(spark, d):
    texts = table(spark, d, "orders").select(F.col("o_orderkey").alias("document_id"), F.lit(160).alias("length"))
    side = F.when(F.col("l_returnflag") == "R", "gold").otherwise("pred")
    spans = annotations(spark, d).select("document_id", F.col("char_start").alias("start"), F.col("char_end").alias("end"), "label", F.col("ann_id").alias("span_id"), side.alias("side"))
    out = SG.covered_segments(texts, spans, 64)
    joined = [F.array_join(c, "|").alias(c) for c in ("gold_labels", "gold_ids", "pred_labels", "pred_ids")]
    return out.select("document_id", "start", "end", *joined, "kind")


def span_sides(spark, d):
    a = annotations(spark, d).withColumnRenamed("char_start", "start").withColumnRenamed("char_end", "end").withColumn("ord", F.col("line_no"))
    return a.filter("l_returnflag <> 'R'"), a.filter("l_returnflag = 'R'")


# user spans in order, each with the gold ids its predecessors have taken
GREEDY = f"""RECURSIVE {ANN}, us AS (SELECT *, row_number() OVER (PARTITION BY d, label ORDER BY n) AS i FROM ann WHERE rf <> 'R'), gs AS (SELECT * FROM ann WHERE rf = 'R'),
iv AS (SELECT u.d, u.label, u.i, u.n AS un, g.n AS gn, u.dose = g.dose AS same, greatest(0, least(u.e, g.e) - greatest(u.s, g.s)) AS common, (u.e - u.s) + (g.e - g.s) AS both_ FROM us u JOIN gs g ON u.d = g.d AND u.label = g.label),
cd AS (SELECT *, common / (both_ - common) AS iou FROM iv WHERE common / (both_ - common) >= 0.5), total AS (SELECT d, label, max(i) AS n FROM us GROUP BY 1, 2),
st(d, label, i, used, un, gn, same, iou) AS (SELECT d, label, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), false, CAST(NULL AS DOUBLE) FROM total
 UNION ALL SELECT s.d, s.label, s.i + 1, CASE WHEN p.gn IS NULL THEN s.used ELSE list_append(s.used, p.gn) END, p.un, p.gn, p.same, p.iou FROM st s JOIN total t ON t.d = s.d AND t.label = s.label AND s.i < t.n
 LEFT JOIN LATERAL (SELECT un, gn, same, iou FROM cd c WHERE c.d = s.d AND c.label = s.label AND c.i = s.i + 1 AND NOT list_contains(s.used, c.gn) ORDER BY iou DESC, gn LIMIT 1) p ON true),
gm AS (SELECT * FROM st WHERE gn IS NOT NULL)"""


@query("greedy_span_match", f"WITH {GREEDY} SELECT d AS document_id, label, 'T' || un AS user_id, 'T' || gn AS gold_id, iou FROM gm")
def greedy_span_match(spark, d):
    return I.greedy_span_match(*span_sides(spark, d))


@query("greedy_match_in_rounds", f"WITH {GREEDY} SELECT d AS document_id, label, 'T' || un AS user_id, 'T' || gn AS gold_id, iou FROM gm")
def greedy_match_in_rounds(spark, d):
    """The same pairs with every cluster matched in parallel rounds until no user span is open."""
    return I.greedy_span_match(*span_sides(spark, d), large=1, rest=0)


_F1 = "CASE WHEN {0} + {1} > 0 THEN 2 * {0} * {1} / ({0} + {1}) ELSE 0.0 END"


@query("span_scores", f"""WITH {GREEDY}, al AS (SELECT label, 1 AS u, 0 AS g, 0 AS m, 0 AS f FROM us UNION ALL SELECT label, 0, 1, 0, 0 FROM gs UNION ALL SELECT label, 0, 0, 1, CAST(same AS INT) FROM gm),
sm AS (SELECT coalesce(label, '__all__') AS label, sum(u) AS u, sum(g) AS g, sum(m) AS m, sum(f) AS f FROM al GROUP BY ROLLUP (label)),
sh AS (SELECT *, CASE WHEN u > 0 THEN m / u ELSE 0.0 END AS sp, CASE WHEN g > 0 THEN m / g ELSE 0.0 END AS sr, CASE WHEN u > 0 THEN f / u ELSE 0.0 END AS fp, CASE WHEN g > 0 THEN f / g ELSE 0.0 END AS fr FROM sm)
SELECT label, CAST(m AS BIGINT) AS span_tp, CAST(u - m AS BIGINT) AS span_fp, CAST(g - m AS BIGINT) AS span_fn, CAST(f AS BIGINT) AS full_tp, CAST(u - f AS BIGINT) AS full_fp, CAST(g - f AS BIGINT) AS full_fn,
 sp AS span_precision, sr AS span_recall, fp AS full_precision, fr AS full_recall, {_F1.format('sp', 'sr')} AS span_f1, {_F1.format('fp', 'fr')} AS full_f1 FROM sh""")
def span_scores(spark, d):
    user, gold = span_sides(spark, d)
    return I.span_scores(user, gold, I.greedy_span_match(user, gold))


# ---- first seen, latest, top-k, sampling ----------------------------------------------


@query("first_seen_dedupe", """SELECT user_id, event_type, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY 1, 2""")
def first_seen_dedupe(spark, d):
    return SEL.first_seen(table(spark, d, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("latest_log_row", """SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2""")
def latest_log_row(spark, d):
    return SEL.latest_rows(table(spark, d, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("top_k_per_category", """SELECT event_type, user_id, event_id, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 7""")
def top_k_per_category(spark, d):
    e = table(spark, d, "events").select("event_type", "user_id", "event_id", "value")
    return SEL.top_k(e, ["event_type"], [F.desc("value"), F.asc("event_id")], 7)


@query("sequential_ids", """SELECT event_id, 's' || lpad(CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS VARCHAR), 4, '0') AS seq_id FROM events""")
def sequential_ids(spark, d):
    return SEL.sequential_ids(table(spark, d, "events").select("user_id", "event_id"), ["user_id"], [F.asc("event_id")]).select("event_id", "seq_id")


H42 = "CAST('0x' || substr(md5('42:' || {0}), 1, 8) AS BIGINT)"
DRAW = f"""dr AS (SELECT * FROM (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {H42.format('o_orderkey')}, o_orderkey) AS rn FROM orders)
 WHERE rn <= CASE o_orderstatus WHEN 'O' THEN 65 WHEN 'F' THEN 175 ELSE 0 END)"""


@query("stratified_draw", f"WITH {DRAW} SELECT o_orderkey, o_orderstatus FROM dr")
def stratified_draw(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return SEL.stratified_draw(o, "o_orderstatus", {"O": 65, "F": 175}, "o_orderkey")


@query("sample_top_up", f"""WITH {DRAW}, rest AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM dr) ORDER BY CAST('0x' || substr(md5('43:' || o_orderkey), 1, 8) AS BIGINT), o_orderkey LIMIT 60)
SELECT o_orderkey, o_orderstatus FROM dr UNION ALL SELECT * FROM rest""")
def sample_top_up(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return SEL.top_up(o, SEL.stratified_draw(o, "o_orderstatus", {"O": 65, "F": 175}, "o_orderkey"), "o_orderkey", 300)


SPLITS = """sp AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('exectv2-fixed-splits-v1:' || doc_id), doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents),
spl AS (SELECT doc_id, pos, CASE WHEN pos < round(n * 0.6) THEN 'development' WHEN pos < round(n * 0.8) THEN 'validation' ELSE 'test' END AS split FROM sp)"""


def doc_splits(spark, d):
    return SEL.fixed_splits(table(spark, d, "documents").select("doc_id"), id_column="doc_id")


@query("fixed_splits", f"WITH {SPLITS} SELECT * FROM spl")
def fixed_splits(spark, d):
    return doc_splits(spark, d)


@query("split_documents", f"WITH {SPLITS} SELECT lang, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM spl WHERE split = 'validation') GROUP BY 1")
def split_documents(spark, d):
    doc = table(spark, d, "documents").select("doc_id", "lang")
    return SEL.documents_of(doc, doc_splits(spark, d), "validation", "doc_id").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("unknown_request_ids", "SELECT l_partkey * 2 AS p_partkey FROM lineitem WHERE l_partkey * 2 NOT IN (SELECT p_partkey FROM part)")
def unknown_request_ids(spark, d):
    return SEL.unknown_ids(table(spark, d, "lineitem").select((F.col("l_partkey") * 2).alias("p_partkey")), table(spark, d, "part"), "p_partkey")


@query("union_of_runs", """SELECT run, run_ord, count(*) AS n, count(note) AS notes FROM (SELECT 'a' AS run, 0 AS run_ord, event_id, NULL AS note FROM events WHERE event_type = 'view' UNION ALL SELECT 'b', 1, event_id, props FROM events WHERE event_type <> 'click') GROUP BY 1, 2""")
def union_of_runs(spark, d):
    e = table(spark, d, "events")
    runs = {"a": e.filter("event_type = 'view'").select("event_id"), "b": e.filter("event_type <> 'click'").select("event_id", F.col("props").alias("note"))}
    return union_runs(runs).groupBy("run", "run_ord").agg(F.count(F.lit(1)).alias("n"), F.count("note").alias("notes"))


@query("top_counts", "SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10")
def top_counts(spark, d):
    return ST.top_counts(table(spark, d, "events"), "user_id", 10)


@query("value_distribution", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def value_distribution(spark, d):
    return ST.value_counts(table(spark, d, "events"), ["event_type"])
