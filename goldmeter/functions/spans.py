"""Span arithmetic and in-row offset recipes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from goldmeter.functions.text import WHITESPACE, let, strip, text_of


def overlap_chars(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))


def overlap_fraction(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Overlap divided by the shorter span (0 when that span is empty)."""
    short = F.least(a1 - a0, b1 - b0)
    return F.when(short == 0, 0.0).otherwise(overlap_chars(a0, a1, b0, b1) / short)


def iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    inter = overlap_chars(a0, a1, b0, b1)
    union = (a1 - a0) + (b1 - b0) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def attribute_agreement(a: Column, b: Column, skipped=("CUI", "CUIPhrase")) -> Column:
    """Share of equal attributes over the union of keys; 1 when nothing can be compared."""
    empty = F.create_map().cast("map<string,string>")
    a, b = F.coalesce(a, empty), F.coalesce(b, empty)
    keys = F.filter(F.array_union(F.map_keys(a), F.map_keys(b)), lambda k: ~k.isin(*skipped))
    same = F.filter(
        keys,
        lambda k: F.lower(strip(text_of(F.try_element_at(a, k)))) == F.lower(strip(text_of(F.try_element_at(b, k)))),
    )
    return F.when(F.size(keys) == 0, 1.0).otherwise(F.size(same) / F.size(keys))


#: Elements summed in one fold; a fold copies its array at each step, so blocks keep the work near linear.
RUN = 64


def running_ends(lengths: Column) -> Column:
    """Running sums of an array of lengths."""
    none = F.array().cast("array<int>")

    def add(acc, n):
        return F.concat(acc, F.array((F.element_at(acc, -1) + n).cast("int")))

    def sums(x):
        blocks = F.transform(F.sequence(F.lit(0), ((F.size(x) - 1) / RUN).cast("int")), lambda i: F.slice(x, i * RUN + 1, F.lit(RUN)))

        def placed(bs):
            totals = F.transform(bs, lambda y: F.aggregate(y, F.lit(0), lambda acc, n: acc + n))
            starts = F.aggregate(totals, F.array(F.lit(0)), add)
            return F.flatten(F.zip_with(bs, F.slice(starts, F.lit(1), F.size(bs)), lambda y, at: F.slice(F.aggregate(y, F.array(at), add), F.lit(2), F.size(y))))

        return F.when(F.size(x) > 0, let(blocks, placed)).otherwise(none)

    return let(lengths, sums)


def with_offsets(pieces: Column) -> Column:
    """Array of (start, end, text) for pieces that tile a text from its beginning; done inside the row, so no text is shuffled."""
    def tile(ps):
        return F.zip_with(ps, running_ends(F.transform(ps, F.length)), lambda p, end: F.struct(
            (end - F.length(p)).cast("int").alias("start"), end.cast("int").alias("end"), p.alias("text")))

    return let(pieces, tile)


def trim_span(span: Column, base: Column) -> Column:
    """Shrink a span to its stripped text and shift it by a base offset."""
    raw = span["text"]
    lead = F.length(raw) - F.length(F.ltrim(raw, F.lit(WHITESPACE)))
    clean = strip(raw)
    start = base + span["start"] + lead
    return F.struct(
        start.cast("int").alias("char_start"), (start + F.length(clean)).cast("int").alias("char_end"),
        clean.alias("text"),
    )
