"""Text to spans and perturbations over the documents table and the letters derived from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from goldmeter.functions import text as T
from goldmeter.functions.vocabulary import MEDICATION_SYNONYMS, SEIZURE_TYPE_PHRASINGS
from goldmeter.operators import corpus_audit as CA
from goldmeter.operators import grounding as G
from goldmeter.operators import label_audit as LA
from goldmeter.operators import passages as P
from goldmeter.operators import perturb as X
from goldmeter.sources import corpora as CP
from verify import clinic as C
from verify.base import WS, lit_sql, norm_label_sql, norm_text_sql, query, table
from verify.corpus_queries import scratch


def docs(spark, d):
    return table(spark, d, "documents").select(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("document_id"), "text")


DOC = "dc AS (SELECT 'D' || doc_id AS document_id, text FROM documents)"
MARK = "regexp_replace({0}, '([.!?])(\\s)', '\\1' || chr(1) || '\\2', 'g')"
SENT = f"""{DOC}, ln AS (SELECT document_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM dc),
lo AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY document_id ORDER BY ln) - length(line) - 1 AS base FROM ln),
mk AS (SELECT *, string_split(CASE WHEN regexp_matches(line, '^[.!?]') THEN substr(line, 1, 1) || {MARK.format('substr(line, 2)')} ELSE {MARK.format('line')} END, chr(1)) AS parts FROM lo),
pc AS (SELECT document_id, ln, base, unnest(parts) AS piece, generate_subscripts(parts, 1) AS pn FROM mk),
po AS (SELECT *, base + sum(length(piece)) OVER (PARTITION BY document_id, ln ORDER BY pn) - length(piece) AS st FROM pc),
sn AS (SELECT document_id, ln, pn, CAST(st + length(piece) - length(ltrim(piece, {WS})) AS INT) AS char_start, trim(piece, {WS}) AS text FROM po WHERE trim(piece, {WS}) <> '')"""


@query("sentence_spans", f"""WITH {SENT} SELECT document_id, 's' || lpad(CAST(row_number() OVER (PARTITION BY document_id ORDER BY ln, pn) AS VARCHAR), 4, '0') AS sentence_id, char_start, CAST(char_start + length(text) AS INT) AS char_end, text FROM sn""")
def sentence_spans(spark, d):
    return P.sentence_table(docs(spark, d))


CUT = "regexp_replace({0}, '([.!?;])\\s+', '\\1' || chr(1), 'g')"


@query("retrieval_chunks", f"""WITH {DOC}, ln AS (SELECT document_id, trim(unnest(string_split(text, chr(10))), {WS}) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM dc),
ch AS (SELECT document_id, ln, trim(unnest(string_split({CUT.format('line')}, chr(1))), {WS}) AS chunk, generate_subscripts(string_split({CUT.format('line')}, chr(1)), 1) AS pn FROM ln)
SELECT document_id, count(*) AS chunks, CAST(sum(length(chunk)) AS BIGINT) AS chars, count(*) FILTER (regexp_matches(chunk, '[0-9]+|[A-Z][a-z]+ing')) AS hits FROM ch WHERE chunk <> '' GROUP BY 1""")
def retrieval_chunks(spark, d):
    t = docs(spark, d).select("document_id", P.retrieval_chunks(F.col("text")).alias("c"))
    hits = F.filter("c", lambda x: x.rlike("[0-9]+|[A-Z][a-z]+ing"))
    n = t.select("document_id", F.size("c").cast("long").alias("chunks"), F.aggregate(F.transform("c", F.length), F.lit(0).cast("long"), lambda a, x: a + x).alias("chars"), F.size(hits).cast("long").alias("hits"))
    return n.filter("chunks > 0")


@query("frequency_chunk_retrieval", f"""WITH {C.BASE}, ln AS (SELECT document_id, trim(unnest(string_split(text, chr(10))), {WS}) AS line FROM bl), ch AS (SELECT document_id, trim(unnest(string_split({CUT.format('line')}, chr(1))), {WS}) AS chunk FROM ln)
SELECT document_id, chunk FROM ch WHERE chunk <> '' AND regexp_matches(lower(chunk), '\\bper\\s+(day|week|month|year|fortnight)\\b|\\bseizure[\\s-]free\\b|\\bcluster\\b|\\b(daily|weekly|monthly)\\s+(seizures?|attacks?|episodes?|fits?|events?)\\b')""")
def frequency_chunk_retrieval(spark, d):
    return P.retrieve_chunks(C.letters(spark, d)).select("document_id", "chunk")


@query("pattern_mining_offsets", f"""WITH {DOC}, m AS (SELECT document_id, text, regexp_extract_all(text, '[0-9]+|[A-Z][a-z]+ing') AS ms, regexp_split_to_array(text, '[0-9]+|[A-Z][a-z]+ing') AS gs FROM dc),
u AS (SELECT document_id, unnest(ms) AS match, generate_subscripts(ms, 1) AS i, gs, ms FROM m WHERE len(ms) > 0),
o AS (SELECT document_id, match, CAST(list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS INT) AS char_start FROM u)
SELECT document_id, 'mixed' AS category, char_start, CAST(char_start + length(match) AS INT) AS char_end, match AS matched_text FROM o""")
def pattern_mining_offsets(spark, d):
    out = docs(spark, d).select("document_id", F.inline(P.pattern_spans(F.col("text"), "[0-9]+|[A-Z][a-z]+ing")))
    return out.select("document_id", F.lit("mixed").alias("category"), "char_start", "char_end", F.col("text").alias("matched_text"))


TEMP_SQL = f"""{C.BASE}, tm AS (SELECT document_id, 'previous_medication' AS category, CAST(instr(text, 'previously was on lamotrigine') - 1 AS INT) AS char_start, 'previously was on lamotrigine' AS matched_text FROM bl WHERE contains(text, 'previously was on lamotrigine'))"""


@query("temporality_mining", f"WITH {TEMP_SQL} SELECT document_id, category, char_start, CAST(char_start + length(matched_text) AS INT) AS char_end, matched_text FROM tm")
def temporality_mining(spark, d):
    return P.temporality_matches(C.letters(spark, d)).select("document_id", "category", "char_start", "char_end", "matched_text")


@query("temporality_summary", f"WITH {TEMP_SQL} SELECT category, count(*) AS matches, count(DISTINCT document_id) AS documents FROM tm GROUP BY 1 UNION ALL SELECT '__all__', count(*), count(DISTINCT document_id) FROM tm")
def temporality_summary(spark, d):
    return P.temporality_summary(P.temporality_matches(C.letters(spark, d)))


# every benchmark passage is looked for in the documents of its residue
QUOTES = "bq AS (SELECT d.doc_id, d.text, d.lang, b.text AS q FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT max(item_id) + 1 FROM benchmark))"


def quote_pairs(spark, d):
    b = table(spark, d, "benchmark").select("item_id", F.col("text").alias("q"))
    docs = table(spark, d, "documents").crossJoin(F.broadcast(b.agg((F.max("item_id") + 1).alias("items"))))
    return docs.select("doc_id", "text", "lang", (F.col("doc_id") % F.col("items")).alias("item_id")).join(b, "item_id").select("doc_id", "text", "lang", "q")


@query("exact_quote_location", f"""WITH {QUOTES}, w AS (SELECT doc_id, text, upper(split_part(q, ' ', 2)) AS v FROM bq), f AS (SELECT *, instr(lower(text), lower(v)) AS pos_ FROM w)
SELECT doc_id, CASE WHEN pos_ > 0 THEN substr(text, pos_, length(v)) END AS quote, CASE WHEN pos_ > 0 THEN CAST(pos_ - 1 AS INT) END AS start FROM f""")
def exact_quote_location(spark, d):
    # the SQL's upper() maps one character to one; Spark's makes two of some (sharp s, ligatures)
    def upper(c):
        return F.when(c == "\u00df", "\u1e9e").when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(c)

    v = F.array_join(F.transform(F.split(F.split_part(F.col("q"), F.lit(" "), F.lit(2)), ""), upper), "")
    return quote_pairs(spark, d).select("doc_id", P.exact_quote(F.col("text"), v).alias("quote"), T.find_text(F.col("text"), v).cast("int").alias("start"))


@query("quote_context_snippet", f"""WITH {QUOTES}, w AS (SELECT doc_id, text, split_part(q, ' ', 2) AS v FROM bq), f AS (SELECT *, instr(text, v) - 1 AS s FROM w WHERE contains(text, v))
SELECT doc_id, trim(regexp_replace(substr(text, greatest(s - 40, 0) + 1, s + length(v) + 40 - greatest(s - 40, 0)), '\\s+', ' ', 'g'), {WS}) AS snippet FROM f""")
def quote_context_snippet(spark, d):
    v = F.split_part(F.col("q"), F.lit(" "), F.lit(2))
    t = quote_pairs(spark, d).withColumn("v", v).filter(F.contains("text", "v")).withColumn("s", F.instr("text", F.col("v")) - 1)
    return t.select("doc_id", T.window_snippet(F.col("text"), F.col("s"), F.col("s") + F.length("v"), 40).alias("snippet"))


@query("tolerant_quote_location", f"""WITH {C.BASE}, v AS (SELECT document_id, text, CASE k % 3 WHEN 0 THEN 'seizures:   ' || fq WHEN 1 THEN 'Vitamin' || chr(10) || 'b' ELSE 'dear  dr smith' END AS q FROM bl)
SELECT document_id, CASE WHEN instr(lower(text), trim(regexp_replace(lower(q), '\\s+', ' ', 'g'))) > 0 THEN substr(text, instr(lower(text), trim(regexp_replace(lower(q), '\\s+', ' ', 'g'))), length(trim(regexp_replace(lower(q), '\\s+', ' ', 'g')))) END AS quote FROM v""")
def tolerant_quote_location(spark, d):
    b = C.base(spark, d)
    q = F.when(F.col("k") % 3 == 0, F.concat(F.lit("seizures:   "), F.col("fq"))).when(F.col("k") % 3 == 1, "Vitamin\nb").otherwise("dear  dr smith")
    return b.select("document_id", P.tolerant_quote(F.col("text"), q).alias("quote"))


@query("quote_validity", f"""WITH {QUOTES}, v AS (SELECT doc_id, {norm_text_sql('text')} AS tn, {norm_text_sql("CASE WHEN doc_id % 2 = 0 THEN q ELSE split_part(text, chr(10), -1) END")} AS qn FROM bq)
SELECT doc_id, contains(tn, qn) AS valid FROM v""")
def quote_validity(spark, d):
    q = F.when(F.col("doc_id") % 2 == 0, F.col("q")).otherwise(F.split_part("text", F.lit("\n"), F.lit(-1)))
    return quote_pairs(spark, d).select("doc_id", P.quote_is_valid(T.norm_text(F.col("text")), q).alias("valid"))


GRAM = f"""{QUOTES}, g AS (SELECT doc_id, {norm_label_sql('text')} AS tn, {norm_label_sql("CASE WHEN doc_id % 5 = 0 THEN lang ELSE q END")} AS qn, q FROM bq),
tk AS (SELECT doc_id, tn, qn, list_filter(string_split(tn, ' '), lambda x: x <> '') AS tt, list_filter(string_split(qn, ' '), lambda x: x <> '') AS qt FROM g),
gr AS (SELECT doc_id, tn, qn, len(qt) AS nq, list_transform(range(1, len(tt) - 2), lambda i: array_to_string(tt[i:i + 3], ' ')) AS tg, list_transform(range(1, len(qt) - 2), lambda i: array_to_string(qt[i:i + 3], ' ')) AS qg FROM tk)"""


def gram_pairs(spark, d):
    return quote_pairs(spark, d).withColumn("quote", F.when(F.col("doc_id") % 5 == 0, F.col("lang")).otherwise(F.col("q"))).withColumnRenamed("doc_id", "document_id")


@query("gram_overlap", f"WITH {GRAM} SELECT doc_id AS document_id, CASE WHEN nq < 4 THEN contains(tn, qn) ELSE list_has_any(tg, qg) END AS overlap FROM gr")
def gram_overlap(spark, d):
    return gram_pairs(spark, d).select("document_id", T.gram_overlap(F.col("quote"), F.col("text")).alias("overlap"))


@query("quote_metric_rates", f"""WITH {GRAM}, f AS (SELECT contains(tn, qn) AS exact, contains(tn, qn) OR (nq >= 4 AND list_has_any(tg, qg)) AS ov FROM gr)
SELECT count(*) AS documents, 1.0::DOUBLE AS present_rate, round(avg(CAST(exact AS INT)), 4) AS exact_rate, round(avg(CAST(ov AS INT)), 4) AS overlap_rate FROM f""")
def quote_metric_rates(spark, d):
    return LA.quote_rates(LA.quote_metrics(gram_pairs(spark, d)))


@query("sentence_expansion", f"""WITH {C.BASE}, s AS (SELECT document_id, text, m1, instr(text, m1) AS pos_ FROM bl)
SELECT document_id, trim(regexp_extract(substr(text, 1, pos_ - 1), '[^.!?\\n]*$') || m1 || regexp_extract(substr(text, pos_ + length(m1)), '^[^.!?\\n]*'), ' ' || chr(9)) AS sentence FROM s""")
def sentence_expansion(spark, d):
    return C.base(spark, d).select("document_id", P.sentence_around(F.col("text"), F.col("m1")).alias("sentence"))


@query("context_validity", f"""WITH {DOC}, s AS (SELECT document_id, lower(text) AS low FROM dc)
SELECT document_id, NOT ((contains(low, 'family') AND contains(low, 'history')) OR (contains(low, 'brother') AND (contains(low, 'had') OR contains(low, 'has'))) OR (contains(low, 'mother') AND (contains(low, 'had') OR contains(low, 'has')))
 OR (contains(low, 'father') AND (contains(low, 'had') OR contains(low, 'has'))) OR (contains(low, 'sister') AND (contains(low, 'had') OR contains(low, 'has'))) OR (contains(low, 'no') AND contains(low, 'report') AND contains(low, 'of')) OR (contains(low, 'not') AND contains(low, 'available'))) AS valid FROM s""")
def context_validity(spark, d):
    return docs(spark, d).select("document_id", G.context_is_valid(F.col("text")).alias("valid"))



@query("synonym_quote_location", f"""WITH {C.BASE} SELECT document_id, CASE WHEN c % 10 = 7 THEN 'levitiracetam' WHEN c % 10 = 0 THEN 'Keppra' END AS quote FROM bl""")
def synonym_quote_location(spark, d):
    return C.base(spark, d).select("document_id", G.synonym_quote(F.col("text"), F.lit("levetiracetam"), MEDICATION_SYNONYMS).alias("quote"))


@query("phrasing_quote_location", f"""WITH {C.BASE} SELECT document_id, CASE WHEN lower(dx) = 'focal epilepsy' THEN dx WHEN t % 5 = 0 THEN 'focal seizures' END AS quote FROM bl""")
def phrasing_quote_location(spark, d):
    return C.base(spark, d).select("document_id", G.phrasing_quote(F.col("text"), F.lit("focal seizure"), SEIZURE_TYPE_PHRASINGS).alias("quote"))


@query("prompt_inputs", f"""WITH {C.BASE} SELECT document_id, length(text) AS letter_chars FROM bl""")
def prompt_inputs(spark, d):
    b = C.letters(spark, d)
    p = P.prompt_inputs(b, "Read the letter.", 50)
    return p.join(b, "document_id").select("document_id", F.when((F.length("prompt") == F.least(F.lit(200), F.col("full_chars"))) & (F.col("truncated") == (F.col("full_chars") > 200)), F.length("text")).alias("letter_chars"))


@query("rendered_sentences", f"""WITH {SENT}, z AS (SELECT document_id, 's' || lpad(CAST(row_number() OVER (PARTITION BY document_id ORDER BY ln, pn) AS VARCHAR), 4, '0') || ' [' || char_start || ', ' || CAST(char_start + length(text) AS INT) || ']: ' || text AS r, ln, pn FROM sn)
SELECT document_id, length(string_agg(r, chr(10) ORDER BY ln, pn)) AS chars FROM z GROUP BY 1""")
def rendered_sentences(spark, d):
    t = docs(spark, d).select("document_id", F.length(P.rendered_sentences(P.sentence_spans(F.col("text")))).alias("chars"))
    return t.filter("chars > 0")


@query("evidence_from_quote", f"""WITH {C.BASE}, q AS (SELECT document_id, text, CASE k % 3 WHEN 0 THEN m1 WHEN 1 THEN 'Seizures:  ' || fq ELSE 'absent words' END AS q FROM bl), v AS (SELECT *, contains({norm_text_sql('text')}, {norm_text_sql('q')}) AS ok, instr(text, q) AS pos_ FROM q)
SELECT document_id, ok AS valid, CASE WHEN ok AND pos_ > 0 THEN CAST(pos_ - 1 AS INT) END AS char_start, CASE WHEN ok AND pos_ > 0 THEN CAST(pos_ - 1 + length(q) AS INT) END AS char_end FROM v""")
def evidence_from_quote(spark, d):
    b = C.base(spark, d)
    q = F.when(F.col("k") % 3 == 0, F.col("m1")).when(F.col("k") % 3 == 1, F.concat(F.lit("Seizures:  "), F.col("fq"))).otherwise("absent words")
    t = b.withColumn("q", q).withColumn("s", P.sentence_spans(F.col("text"))).withColumn("e", P.evidence_from_quote(F.col("text"), F.col("s"), F.col("q")))
    first = F.get("e", F.lit(0))
    return t.select("document_id", (F.size("e") > 0).alias("valid"), first["char_start"].alias("char_start"), first["char_end"].alias("char_end"))


# ---- letter quality and perturbations -------------------------------------------------


@query("letter_quality", f"""WITH {DOC}, z AS (SELECT document_id, text, CASE WHEN length(text) % 11 = 0 THEN text || ' Ã he said â€' ELSE text END AS tx FROM dc),
w AS (SELECT document_id, tx, list_filter(regexp_split_to_array(lower(tx), '[^\\p{{L}}\\p{{N}}_\\p{{M}}]+'), lambda x: x IN ('he', 'his', 'him', 'himself')) AS mw, list_filter(regexp_split_to_array(lower(tx), '[^\\p{{L}}\\p{{N}}_\\p{{M}}]+'), lambda x: x IN ('she', 'her', 'hers', 'herself')) AS fw FROM z)
SELECT document_id, length(tx) AS char_count, trim((CASE WHEN contains(tx, 'Ã') THEN 'utf8_double_encode_a; ' ELSE '' END) || (CASE WHEN contains(tx, 'ï¿½') THEN 'utf8_double_encode_i; ' ELSE '' END) || (CASE WHEN contains(tx, 'â€') THEN 'utf8_double_encode_e; ' ELSE '' END)
 || (CASE WHEN contains(tx, 'Â') THEN 'utf8_nbsp; ' ELSE '' END) || (CASE WHEN contains(tx, '�') THEN 'replacement_char; ' ELSE '' END), '; ') AS encoding_artefacts, len(mw) AS male_pronoun_count, len(fw) AS female_pronoun_count, length(tx) < 200 AS too_short FROM w""")
def letter_quality(spark, d):
    t = docs(spark, d).withColumn("text", F.when(F.length("text") % 11 == 0, F.concat("text", F.lit(" Ã he said â€"))).otherwise(F.col("text")))
    return CA.letter_quality(t).select("document_id", "char_count", "encoding_artefacts", "male_pronoun_count", "female_pronoun_count", "too_short")


@query("label_text_artefacts", f"""WITH {DOC} SELECT document_id, length(text) AS text_length, contains(text, 'Ã') OR contains(text, 'ï¿½') OR contains(text, 'â€') OR contains(text, 'Â') OR regexp_matches(text, '[^\\x00-\\x7F\\x{{a0}}-\\x{{24f}}]') AS has_artefacts FROM dc""")
def label_text_artefacts(spark, d):
    return LA.text_artefacts(docs(spark, d)).select("document_id", "text_length", (F.col("encoding_artefacts") != "").alias("has_artefacts"))


PERT = f"""{C.BASE}, sec AS (SELECT document_id, text, list_filter(list_transform(regexp_split_to_array(trim(text, {WS}), '\\n\\s*\\n+'), lambda x: trim(x, {WS})), lambda x: x <> '') AS ss FROM bl)"""


@query("reorder_sections", f"""WITH {PERT} SELECT document_id, CASE WHEN len(ss) < 4 THEN text ELSE array_to_string(list_concat([ss[1]], list_reverse(ss[2:])), chr(10) || chr(10)) END AS text FROM sec""")
def reorder_sections(spark, d):
    return X.perturb(C.letters(spark, d), X.chosen(["reordered_sections"], X.LETTER_PERTURBATIONS)).select(F.col("source_document_id").alias("document_id"), "text")


LINES = "string_split(regexp_replace(text, '\\n$', ''), chr(10))"


@query("remove_headings", f"""WITH {C.BASE} SELECT document_id, array_to_string(list_filter({LINES}, lambda x: NOT (ends_with(trim(x), ':') AND len(list_filter(regexp_split_to_array(trim(x), '\\s+'), lambda w: w <> '')) <= 5)), chr(10)) AS text FROM bl""")
def remove_headings(spark, d):
    return X.perturb(C.letters(spark, d), X.chosen(["removed_headings"], X.LETTER_PERTURBATIONS)).select(F.col("source_document_id").alias("document_id"), "text")


@query("bullets_to_prose", f"""WITH {C.BASE} SELECT document_id, array_to_string(['Dear Dr Smith,', '', 'Medication:', rtrim(trim(m1 || ' ' || d1 || ' ' || s1), '.') || '. Vitamin B.'], chr(10)) || substr(text, instr(text, chr(10) || chr(10) || 'Seizures'), length(text) - instr(text, chr(10) || chr(10) || 'Seizures')) AS text FROM bl""")
def bullets_to_prose(spark, d):
    return X.perturb(C.letters(spark, d), X.chosen(["bullets_to_prose"], X.LETTER_PERTURBATIONS)).select(F.col("source_document_id").alias("document_id"), "text")


NOTE_VALUES = ", ".join(f"({lit_sql(k)}, {lit_sql('label_changing' if k in ('current_seizure_free_contrast', 'requested_mri_contrast') else 'label_preserving')}, {lit_sql(v)})" for k, v in X.NOTES.items() if not k.startswith("gan"))


@query("appended_traps", f"""WITH {DOC}, n(perturbation_id, label_effect, note) AS (VALUES {NOTE_VALUES})
SELECT document_id || '__' || perturbation_id AS document_id, label_effect, length(rtrim(text, {WS}) || chr(10) || chr(10) || note || chr(10)) AS chars, md5(rtrim(text, {WS}) || chr(10) || chr(10) || note || chr(10)) AS text_md5 FROM dc, n""")
def appended_traps(spark, d):
    kept = [p for p in X.LETTER_PERTURBATIONS if p.id in X.NOTES]
    out = X.perturb(docs(spark, d), kept)
    return out.select("document_id", "label_effect", F.length("text").alias("chars"), F.md5("text").alias("text_md5"))


@query("replaced_markers", f"""WITH {C.BASE} SELECT document_id, replace(replace(text || 'Plan: none', 'Current Medication:', 'Current Medication:' || chr(10) || '-'), 'Plan:', 'Plan:' || chr(10) || '-') AS text FROM bl""")
def replaced_markers(spark, d):
    t = C.letters(spark, d).withColumn("text", F.concat("text", F.lit("Plan: none")))
    return X.perturb(t, X.chosen(["gan_frequency_bullets"], X.LABEL_PERTURBATIONS)).select(F.col("source_document_id").alias("document_id"), "text")


@query("perturbed_corpus", """SELECT p AS perturbation_id, count(*) AS n FROM documents, (SELECT unnest(['reordered_sections', 'removed_headings', 'bullets_to_prose', 'historical_medication_trap', 'planned_medication_trap', 'family_history_trap', 'negated_investigation_trap',
 'historical_seizure_free_trap', 'vague_frequency_trap', 'mixed_semiology_type_trap', 'current_seizure_free_contrast', 'requested_mri_contrast']) AS p) GROUP BY 1""")
def perturbed_corpus(spark, d):
    return X.perturb(docs(spark, d), X.LETTER_PERTURBATIONS).filter(F.length("text") >= 0).groupBy("perturbation_id").agg(F.count(F.lit(1)).alias("n"))


SINK = ["planned_medication_trap", "family_history_trap", "requested_mri_contrast"]
# fixed values: the notes that the sink's perturbations append, the second one as rewritten
SINK_NOTES = ["Planned change: If seizures worsen in future, we may consider adding levetiracetam 250 mg twice daily. No change is being made today.", "Family history: none.",
              "Updated investigation plan: MRI brain has been requested and is pending; there is no completed MRI result available today."]
SINK_VALUES = ", ".join(f"({lit_sql(i)}, {lit_sql('label_changing' if n == 2 else 'label_preserving')}, {lit_sql(t)}, {int(n == 1)})" for n, (i, t) in enumerate(zip(SINK, SINK_NOTES)))


@query("perturbed_corpus_sink", f"""WITH {DOC}, pt(id, effect, note, version) AS (VALUES {SINK_VALUES})
SELECT document_id || '__' || id AS document_id, document_id AS source_document_id, 'exectv2' AS source_dataset, id AS perturbation_id, effect AS label_effect,
 md5(rtrim(text, {WS}) || chr(10) || chr(10) || note || chr(10)) AS text_md5, version, 3 AS splits FROM dc, pt""")
def perturbed_corpus_sink(spark, d):
    """Three perturbations written as one version, one of them written anew, and the corpus read back by its manifest."""
    path = scratch(spark)
    kinds = {p.id: p for p in X.LETTER_PERTURBATIONS}
    letters = docs(spark, d)
    CP.write_corpus(X.perturb(letters, [kinds[i] for i in SINK]), path)
    anew = X.Perturbation(SINK[1], X.PRESERVING, "exectv2", "written anew", X.append_note(SINK_NOTES[1]))
    CP.write_corpus(X.perturb(letters, [anew]), path)
    corpus = CP.read_corpus(spark, path)
    splits = CP.corpus_splits(corpus).groupBy("document_id").agg(F.count_distinct("split").cast("int").alias("splits"))
    versions = CP.manifest(spark, path).select("perturbation_id", F.col("version").cast("int").alias("version"))
    return corpus.join(versions, "perturbation_id").join(splits, "document_id").select(
        "document_id", "source_document_id", "source_dataset", "perturbation_id", "label_effect", F.md5("text").alias("text_md5"), "version", "splits")


@query("user_perturbation", f"WITH {DOC} SELECT document_id || '__doubled' AS document_id, text || '|' || text AS text FROM dc")
def user_perturbation(spark, d):
    mine = X.Perturbation("doubled", "label_preserving", "mine", "text twice", lambda text: F.concat(text, F.lit("|"), text))
    return X.perturb(docs(spark, d), [mine]).select("document_id", "text")
