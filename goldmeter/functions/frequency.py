"""Frequency grammar: expressions to parts, labels to monthly rates, rates to classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from goldmeter.functions import vocabulary as V
from goldmeter.functions.text import any_of, let, lookup, norm_label, norm_value, recode, to_number


def parts(count, period_count, unit, cls) -> Column:
    def col(x):
        return x if isinstance(x, Column) else F.lit(x)

    return F.struct(
        col(count).alias("count"), col(period_count).alias("period_count"),
        col(unit).alias("period_unit"), col(cls).alias("class"),
    )


def _range(first: Column, second: Column) -> Column:
    lo, hi = recode(first, V.NUMBER_WORDS), recode(second, V.NUMBER_WORDS)
    return F.when(second == "", lo).otherwise(F.concat_ws("-", lo, hi))


def frequency_parts(c: Column) -> Column:
    """Struct(count, period_count, period_unit, class) of a free-text frequency."""
    phrase_count = {k: v[0] for k, v in V.PHRASE_RATES.items()}
    phrase_unit = {k: v[1] for k, v in V.PHRASE_RATES.items()}

    def one_if_blank(x: Column) -> Column:
        return F.when(x == "", "1").otherwise(x)

    def groups(text: Column, pattern: str, n: int) -> Column:
        """Groups of the first match as one array; empty when there is no match."""
        hit = F.regexp_substr(text, F.lit(pattern))
        return F.when(hit.isNotNull(), F.array(*[F.regexp_extract(text, pattern, i) for i in range(1, n + 1)])).otherwise(
            F.array().cast("array<string>"))

    def every_rule(t: Column, otherwise) -> Column:
        def made(g):
            n = F.when(g[0] == "few", "3").when(g[0] == "couple", "2").otherwise(recode(g[0], V.NUMBER_WORDS))
            cls = F.when(g[0].isin("few", "couple"), "approximate_rate").otherwise("rate")
            return F.when(F.size(g) > 0, parts("1", n, g[1], cls)).otherwise(otherwise)

        return let(groups(t, V.EVERY_PATTERN, 2), made)

    def rate_rule(t: Column, pattern: str, otherwise) -> Column:
        return let(groups(t, pattern, 4), lambda g: F.when(
            F.size(g) > 0, parts(_range(g[0], g[1]), one_if_blank(g[2]), g[3], "rate")).otherwise(otherwise))

    def grammar(t: Column) -> Column:
        rest = F.when(t.rlike(r"^\d+(?:\.\d+)?$"), parts(t, "", "", "count_only")).otherwise(parts("", "", "", "unparsed"))
        ruled = every_rule(t, rate_rule(t, V.PER_PATTERN, rate_rule(t, V.IN_PERIOD_PATTERN, rest)))
        return (
            F.when(t == "", parts("", "", "", ""))
            .when(any_of(t, V.SEIZURE_FREE_PHRASES), parts("0", "", "", "seizure_free"))
            .when(any_of(t, V.FEW_MONTHS_PHRASES), parts("1", "3", "month", "approximate_rate"))
            .when(t.isin(list(V.PHRASE_RATES)), parts("1", recode(t, phrase_count), recode(t, phrase_unit), "rate"))
            .otherwise(ruled)
        )

    return let(norm_value(c), grammar)


def structured_parts(count: Column, period_count: Column, unit: Column) -> Column:
    """Parts held in table columns instead of text."""
    n, p, u = (F.coalesce(x, F.lit("")) for x in (count, period_count, unit))
    return parts(n, p, u, F.when(u != "", "rate").when(n != "", "count_only").otherwise(""))


def is_blank_parts(p: Column) -> Column:
    return (p["count"] == "") & (p["period_count"] == "") & (p["period_unit"] == "") & (p["class"] == "")


def _both_free(a: Column, b: Column):
    free_a, free_b = a["class"] == "seizure_free", b["class"] == "seizure_free"
    return free_a & free_b, free_a | free_b


def parts_match(pred: Column, gold: Column) -> Column:
    """Strict: count, period count and unit all agree (or both seizure free)."""
    def rule(pair):
        p, g = pair["p"], pair["g"]
        both, either = _both_free(p, g)
        same = (
            (p["count"] != "") & (p["count"] == g["count"])
            & (p["period_count"] == g["period_count"]) & (p["period_unit"] == g["period_unit"])
        )
        return F.when(both, True).when(either, False).otherwise(same)

    return let(F.struct(pred.alias("p"), gold.alias("g")), rule)


def count_in_range(count: Column, gold: Column) -> Column:
    bounds = F.split(gold, "-", 2)
    lo, hi, x = to_number(F.get(bounds, F.lit(0))), to_number(F.get(bounds, F.lit(1))), to_number(count)
    inside = gold.contains("-") & F.coalesce(x.between(lo, hi), F.lit(False))
    return (count == gold) | inside


def parts_loose_match(pred: Column, gold: Column) -> Column:
    """Loose: count may lie inside a gold range and units are equated."""
    def rule(pair):
        p, g = pair["p"], pair["g"]
        both, either = _both_free(p, g)
        close = (
            (p["count"] != "") & (g["count"] != "") & (p["period_count"] == g["period_count"])
            & (recode(p["period_unit"], V.PERIOD_UNITS) == recode(g["period_unit"], V.PERIOD_UNITS))
            & count_in_range(p["count"], g["count"])
        )
        return F.when(both, True).when(either, False).otherwise(close)

    return let(F.struct(pred.alias("p"), gold.alias("g")), rule)


# fixed values: counts written as words in labels
_QUANTITY_WORDS = {
    "a": 1.0, "an": 1.0, "one": 1.0, "multiple": V.MULTIPLE_COUNT, "two": 2.0, "three": 3.0, "four": 4.0, "five": 5.0,
    "six": 6.0, "seven": 7.0, "eight": 8.0, "nine": 9.0, "ten": 10.0,
}


def _word_or_number(t: Column) -> Column:
    return F.coalesce(lookup(t, _QUANTITY_WORDS).cast("double"), to_number(t))


def _token_quantity(t: Column) -> Column:
    def rule(tokens):
        values = F.transform(tokens, _word_or_number)
        return F.when(F.size(tokens) == 2, (F.get(values, F.lit(0)) + F.get(values, F.lit(1))) / 2)

    return F.coalesce(_word_or_number(t), let(F.filter(F.split(t, " "), lambda x: x != ""), rule))


def quantity(c: Column) -> Column:
    """Number of a count phrase: words, "multiple", "n to m" and "n m" ranges averaged.

    "a to b to c" is a to (b to c): the parts fold from the right.
    """
    def rule(t):
        parts_ = F.transform(F.split(t, " to "), _token_quantity)
        tail = F.aggregate(
            F.reverse(F.slice(parts_, F.lit(1), F.size(parts_) - 1)), F.element_at(parts_, -1), lambda acc, x: (x + acc) / 2)
        return F.when(t.contains(" to "), tail).otherwise(_token_quantity(t))

    return let(norm_label(c), rule)


def monthly_factor(unit: Column) -> Column:
    u = F.rtrim(unit, F.lit("s"))
    return (
        F.when(u == "day", 30.0).when(u == "week", 4.0).when(u == "month", 1.0).when(u == "year", F.lit(1.0) / F.lit(12.0))
    )


def monthly_rate(count: Column, period_count: Column, unit: Column) -> Column:
    """Events per month, NULL when a part does not parse or the period is zero."""
    den = let(F.coalesce(period_count, F.lit("")), lambda n: F.when(n == "", F.lit(1.0)).otherwise(quantity(n)))
    return quantity(count) * monthly_factor(unit) / F.nullif(den, F.lit(0.0))


_CLUSTER = r"^(.+?) cluster per (?:(.+?) )?(day|week|month|year), (.+?) per cluster$"
_RATE = r"^(.+?) per (?:(.+?) )?(day|week|month|year)$"


def label_rate(c: Column) -> Column:
    """Monthly rate of a normalised label; 1000 stands for unknown."""
    def groups(t, pattern, n):
        return F.array(*[F.regexp_extract(t, pattern, i) for i in range(1, n + 1)])

    def rule(t):
        cluster = let(groups(t, _CLUSTER, 4), lambda g: F.when(
            g[2] != "", monthly_rate(g[0], g[1], g[2]) * quantity(g[3])))
        rate = let(groups(t, _RATE, 3), lambda g: F.when(g[2] != "", monthly_rate(g[0], g[1], g[2])))
        return (
            F.when(t.isin("", "unknown", V.NO_REFERENCE_LABEL), V.UNKNOWN_RATE)
            .when(t.startswith("seizure free") | t.isin("no seizure", "no seizures"), 0.0)
            .otherwise(F.coalesce(cluster, rate, F.lit(V.UNKNOWN_RATE)))
        )

    return let(norm_label(c), rule)


def parts_rate(p: Column) -> Column:
    """Monthly rate of parsed parts; 1000 stands for unknown."""
    return let(p, lambda p: F.when(p["class"] == "seizure_free", 0.0).otherwise(
        F.coalesce(
            F.when((p["count"] != "") & (p["period_unit"] != ""),
                   monthly_rate(p["count"], p["period_count"], p["period_unit"])),
            F.lit(V.UNKNOWN_RATE),
        )
    ))


def gold_rate(structured: Column, surface_parts: Column) -> Column:
    """Rate of a gold annotation; the parsed span text speaks when the columns are empty."""
    def rule(pair):
        g, s = pair["g"], pair["s"]
        use_text = (g["count"] == "") & (g["period_unit"] == "") & ~s["class"].isin("", "unparsed")
        return parts_rate(F.when(use_text, s).otherwise(g))

    return let(F.struct(structured.alias("g"), surface_parts.alias("s")), rule)


# fixed values: upper bounds (inclusive) of the ten-class ladder
FINE_LADDER = [
    (0.16, "<1/6M"), (0.18, "1/6M"), (0.99, "(1/6M,1/M)"), (1.1, "1/M"), (3.9, "(1/M,1/W)"), (4.1, "1/W"),
    (29.0, "(1/W,1/D)"), (999.0, ">=1/D"),
]
# fixed values: upper bounds (inclusive) of the four-class ladder
COARSE_LADDER = [(1.1, "infrequent"), (999.0, "frequent")]


def _ladder(x: Column, steps) -> Column:
    def rule(x):
        out = F.when(x == V.UNKNOWN_RATE, "UNK").when(x == 0, "NS").when(~(x > 0), "UNK")
        for bound, name in steps:
            out = out.when(x <= bound, name)
        return out.otherwise("UNK")

    return let(x, rule)


def fine_class(x: Column) -> Column:
    return _ladder(x, FINE_LADDER)


def coarse_class(x: Column) -> Column:
    return _ladder(x, COARSE_LADDER)


def annotation_class(count: Column, period_count: Column, unit: Column, surface: Column, scope: Column) -> Column:
    """rate / seizure_free / change / temporal / count_only / surface class of a gold annotation."""
    changes = ["increase", "increased", "decrease", "decreased", "reduced", "unchanged"]
    p = structured_parts(count, period_count, unit)

    def rule(said):
        return (
            F.when(p["period_unit"] != "", "rate")
            .when(said["class"] == "seizure_free", "seizure_free")
            .when(any_of(norm_value(surface), changes), "change")
            .when(norm_value(scope) != "", "temporal")
            .when(p["count"] != "", "count_only")
            .otherwise(F.when(said["class"] == "", "unparsed").otherwise(said["class"]))
        )

    return let(frequency_parts(surface), rule)
