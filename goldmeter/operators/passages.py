"""Text to spans: sentences, retrieval chunks, pattern hits, quote location, prompt inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldmeter.functions.spans import running_ends, trim_span, with_offsets
from goldmeter.functions.text import (
    fold_typography, folded_case, let, norm_text, regex_escape, slice_text, squeeze, strip, text_of, window_snippet,
)
from goldmeter.functions.vocabulary import FREQUENCY_SENTENCE_PATTERNS, TEMPORALITY_PATTERNS

# fixed values: a line is cut after . ! ? before whitespace; a line's very first character never ends a sentence
SENTENCE_CUT = r"(?Us)(?<=.[.!?])(?=\s)"


def sentence_spans(text: Column) -> Column:
    """Array of (sentence_id, char_start, char_end, text): lines first, then sentences.

    Everything happens inside the row: lines are numbered with their offsets, then the
    sentences of each line, so the fold is short in both directions and nothing shuffles.
    """
    lines = with_offsets(F.split(text, "(?<=\n)", -1))

    def of_line(line):
        body = F.regexp_replace(line["text"], "\n$", "")
        return F.transform(with_offsets(F.split(body, SENTENCE_CUT, -1)), lambda s: trim_span(s, line["start"]))

    spans = F.filter(F.flatten(F.transform(lines, of_line)), lambda s: s["text"] != "")
    return F.transform(spans, lambda s, i: F.struct(
        F.format_string("s%04d", i + 1).alias("sentence_id"), s["char_start"].alias("char_start"),
        s["char_end"].alias("char_end"), s["text"].alias("text"),
    ))


def with_sentences(letters: DataFrame) -> DataFrame:
    return letters.withColumn("sentences", sentence_spans(F.col("text")))


def sentence_table(letters: DataFrame) -> DataFrame:
    """Exploded sentences(document_id, sentence_id, char_start, char_end, text)."""
    return letters.select("document_id", F.inline(sentence_spans(F.col("text"))))


def retrieval_chunks(text: Column) -> Column:
    """Stripped chunks of stripped lines, cut after . ! ? ; and whitespace."""
    lines = F.filter(F.transform(F.split(text, "\n", -1), strip), lambda x: x != "")
    cut = F.flatten(F.transform(lines, lambda x: F.split(x, r"(?U)(?<=[.!?;])\s+", -1)))
    return F.filter(F.transform(cut, strip), lambda x: x != "")


def frequency_chunks(text: Column, patterns: list[str] | None = None) -> Column:
    """Chunks in which any pattern occurs, in text order."""
    pattern = "(?iUd)" + "|".join(f"(?:{p})" for p in (patterns or FREQUENCY_SENTENCE_PATTERNS))
    return F.filter(retrieval_chunks(text), lambda x: x.rlike(pattern))


def retrieve_chunks(letters: DataFrame, patterns: list[str] | None = None) -> DataFrame:
    return letters.select(
        "document_id", F.posexplode(frequency_chunks(F.col("text"), patterns)).alias("pos", "chunk")
    )


def pattern_spans(text: Column, pattern: str) -> Column:
    """All matches with offsets: lengths of the pieces between matches place the matches."""
    hits = F.regexp_extract_all(text, F.lit(pattern), 0)
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    tiles = F.flatten(F.zip_with(gaps, F.concat(hits, F.array(F.lit(""))), lambda g, h: F.array(
        F.struct(g.alias("n"), F.lit("").alias("m")), F.struct(F.length(h).alias("n"), h.alias("m")))))

    def placed(ts):
        ends = running_ends(F.transform(ts, lambda t: t["n"]))
        spans = F.zip_with(ts, ends, lambda t, end: F.struct((end - t["n"]).cast("int").alias("char_start"), end.cast("int").alias("char_end"), t["m"].alias("text")))
        return F.filter(spans, lambda s: s["text"] != "")

    return F.when(F.size(hits) == 0, F.array().cast("array<struct<char_start:int,char_end:int,text:string>>")).otherwise(let(tiles, placed))


def mine_patterns(letters: DataFrame, patterns: list[tuple[str, str]], window: int = 140) -> DataFrame:
    """All matches of a fixed list of (category, regex) with offsets and context."""
    found = F.array(*[
        F.struct(F.lit(name).alias("category"), pattern_spans(F.col("text"), "(?iUd)" + p).alias("spans"))
        for name, p in patterns
    ])
    rows = letters.select("document_id", "text", F.inline(found)).select(
        "document_id", "text", "category", F.inline("spans").alias("char_start", "char_end", "match"))
    return rows.select(
        "document_id", "category", "char_start", "char_end", squeeze(F.col("match")).alias("matched_text"),
        window_snippet(F.col("text"), F.col("char_start"), F.col("char_end"), window).alias("snippet"),
    )


def temporality_matches(letters: DataFrame) -> DataFrame:
    return mine_patterns(letters, TEMPORALITY_PATTERNS)


def temporality_summary(matches: DataFrame) -> DataFrame:
    """Matches and distinct documents per category, and over all under __all__."""
    per_doc = matches.groupBy("category", "document_id").agg(F.count(F.lit(1)).alias("n"))
    by_category = per_doc.groupBy("category").agg(F.sum("n").alias("matches"), F.count(F.lit(1)).alias("documents"))
    overall = per_doc.groupBy("document_id").agg(F.sum("n").alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("matches"), F.count(F.lit(1)).alias("documents")
    ).select(F.lit("__all__").alias("category"), "matches", "documents")
    return by_category.unionByName(overall)


def exact_quote(text: Column, value: Column) -> Column:
    """First case-insensitive occurrence in the source's own case, NULL when absent."""
    low = folded_case(value)
    return let(F.instr(folded_case(text), low), lambda at: F.when((at > 0) & (value != ""), F.substring(text, at, F.length(low))))


def tolerant_pattern(value: Column) -> Column:
    """Regex of a value that accepts any whitespace between tokens and any dash for a hyphen.

    Quote characters stand for themselves: the scored behaviour folds them in the value only.
    """
    escaped = regex_escape(F.lower(norm_text(value)))
    loose = F.replace(escaped, F.lit(" "), F.lit(r"\s*"))
    return F.concat(F.lit("(?iU)"), F.replace(loose, F.lit(r"\-"), F.lit("[\\-\u2013\u2014]")))


def tolerant_quote(text: Column, value: Column) -> Column:
    return F.when(norm_text(value) != "", F.regexp_substr(text, tolerant_pattern(value)))


def sentence_around(text: Column, quote: Column) -> Column:
    """Sentence-like stretch (up to . ! ? or a line break) around the first occurrence of a quote."""
    def of(at):
        before = F.regexp_replace(F.substring(text, F.lit(1), at - 1), r"(?s)\A.*[.!?\n]", "")
        after = F.regexp_extract(F.substring(text, at + F.length(quote), F.length(text)), r"\A[^.!?\n]*", 0)
        return F.when((at == 0) | (quote == ""), quote).otherwise(
            F.btrim(F.concat(before, quote, after), F.lit(" \t"))
        )

    return let(F.instr(text, quote), of)


def quote_is_valid(text_norm: Column, quote: Column) -> Column:
    """Whitespace- and typography-normalised containment; pass the normalised text."""
    return F.contains(text_norm, norm_text(quote))


def evidence_from_quote(text: Column, sentences: Column, quote: Column) -> Column:
    """Evidence array of one quote: empty unless valid; offsets only for an exact find."""
    def made(at):
        start = F.when(at > 0, at - 1)
        end = start + F.length(quote)
        home = F.filter(sentences, lambda s: (s["char_start"] <= start) & (end <= s["char_end"]))
        return F.array(F.struct(
            quote.alias("quote"), F.get(home, F.lit(0))["sentence_id"].alias("sentence_id"),
            start.cast("int").alias("char_start"), end.cast("int").alias("char_end"),
        ))

    empty = F.array().cast("array<struct<quote:string,sentence_id:string,char_start:int,char_end:int>>")
    usable = (text_of(quote) != "") & F.coalesce(quote_is_valid(norm_text(text), quote), F.lit(False))
    return F.when(usable, let(F.instr(text, quote), made)).otherwise(empty)


def quote_place(text: Column, quote: Column) -> Column:
    """(char_start, char_end) by exact, then case-insensitive find; NULL members when absent."""
    exact, loose = F.instr(text, quote), F.instr(F.lower(text), F.lower(quote))
    at = F.when(exact > 0, exact - 1).when(loose > 0, loose - 1)
    start = F.when(text_of(quote) != "", at)
    return F.struct(start.cast("int").alias("char_start"), (start + F.length(quote)).cast("int").alias("char_end"))


def rendered_sentences(sentences: Column) -> Column:
    return F.array_join(F.transform(sentences, lambda s: F.concat(
        s["sentence_id"], F.lit(" ["), s["char_start"].cast("string"), F.lit(", "), s["char_end"].cast("string"),
        F.lit("]: "), s["text"])), "\n")


def prompt_inputs(letters: DataFrame, instructions: str, token_budget: int, chars_per_token: int = 4) -> DataFrame:
    """Batch-inference inputs: instructions, sentence list and letter, cut to a context budget."""
    sentences = sentence_spans(F.col("text"))
    body = F.concat_ws("\n\n", F.lit(instructions), F.lit("## Sentence List"), rendered_sentences(sentences),
                       F.lit("## Source Letter"), F.col("text"))
    limit = token_budget * chars_per_token
    return letters.select(
        "document_id", F.substring(body, 1, limit).alias("prompt"), (F.length(body) > limit).alias("truncated"),
        F.length(body).alias("full_chars"),
    )


def text_location(quotes: DataFrame, letters: DataFrame) -> DataFrame:
    """(document_id, quote) rows with validity, place and snippet in the letter."""
    joined = quotes.join(letters.select("document_id", "text"), "document_id", "left")
    place = quote_place(F.col("text"), F.col("quote"))
    return joined.select(
        *quotes.columns, F.coalesce(quote_is_valid(norm_text(F.col("text")), F.col("quote")), F.lit(False)).alias("valid"),
        place["char_start"].alias("char_start"), place["char_end"].alias("char_end"),
    )


def source_slice(text: Column, start: Column, end: Column) -> Column:
    return fold_typography(slice_text(text, start, end))
