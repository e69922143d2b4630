"""Text normalisers as Column -> Column builders (no Python runs per row)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldmeter.functions.vocabulary import NULL_WORDS

# Unicode whitespace, as trimmed by text tools; Spark's plain trim removes only the ASCII blank.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# fixed values: typographic characters folded to their ASCII twins
CURLY = "\u2018\u2019\u201c\u201d\u2013\u2014"
PLAIN = "''\"\"--"
BOM = "\ufeff"


def let(value: Column, body) -> Column:
    """Bind a value once inside an expression: body(bound value).

    Without it every mention of a composed builder repeats the whole tree below it, and a
    few nested rules grow to plans no optimizer finishes.
    """
    return F.transform(F.array(value), body)[0]


def computed_once(rows: DataFrame, keep: list[str], **made: Column) -> DataFrame:
    """The kept columns and the made ones, each made column computed once a row however often it is used later.

    Later filters and projections repeat the tree of a projected column at every mention, and again in each filter pushed
    below it; a generator's output they can only refer to.
    """
    # made in a projection, which is generated code but for its lambdas; a generator that holds a lambda is interpreted as a whole
    staged = rows.select(*keep, F.struct(*[c.alias(n) for n, c in made.items()]).alias("_made"))
    return staged.select(*keep, F.inline(F.array("_made")))


def text_of(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(WHITESPACE))


def folded_case(c: Column) -> Column:
    """Lower case with every character in its place: a dotted capital I, whose lower case has two characters, becomes i."""
    return F.lower(F.replace(c, F.lit("\u0130"), F.lit("i")))


def squeeze(c: Column) -> Column:
    """Whitespace runs to one blank, ends trimmed."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def any_of(c: Column, terms: list[str]) -> Column:
    """True when the text contains one of a short, fixed list of terms."""
    return reduce(lambda a, b: a | b, [c.contains(F.lit(t)) for t in terms])


def literal_map(mapping: dict) -> Column:
    """map<string,string> literal written as one expression that Catalyst folds to a constant."""
    pairs = "\x02".join(f"{k}\x01{v}" for k, v in mapping.items())
    return F.str_to_map(F.lit(pairs), F.lit("\x02"), F.lit("\x01"))


def lookup(c: Column, mapping: dict) -> Column:
    """Dictionary value as text, NULL when the key is unknown."""
    return F.try_element_at(literal_map(mapping), c)


def recode(c: Column, mapping: dict[str, str], default: Column | None = None) -> Column:
    """Dictionary lookup with a fallback."""
    return F.coalesce(lookup(c, mapping), c if default is None else default)


_ABSENT = r"\A(?:" + "|".join(w for w in NULL_WORDS if w) + r")\z"


def norm_value(c: Column) -> Column:
    """Canonical comparison form of a value; every way of saying "absent" becomes ""."""
    folded = F.btrim(F.regexp_replace(F.lower(text_of(c)), "[^a-z0-9./]+", " "))
    # one mention of the folded value: an interpreted lambda computes it again at every mention
    return F.regexp_replace(folded, _ABSENT, "")


def fold_typography(c: Column) -> Column:
    return F.translate(c, CURLY, PLAIN)


def norm_text(c: Column) -> Column:
    """Source-text form for quote checks: quotes and dashes folded, whitespace squeezed."""
    return squeeze(fold_typography(text_of(c)))


def norm_quote(c: Column) -> Column:
    """Conservative span form: as norm_text, hyphens to blanks, lower case, BOM dropped."""
    folded = F.translate(text_of(c), CURLY + "-" + BOM, PLAIN.replace("-", " ") + " ")
    return F.lower(squeeze(folded))


def norm_source(c: Column) -> Column:
    """Model-input form of a letter: BOM dropped, line ends unified, blank runs squeezed."""
    unix = unix_lines(F.translate(text_of(c), BOM, ""))
    return strip(F.regexp_replace(unix, "[ \t]+", " "))


def norm_label(c: Column) -> Column:
    """Frequency-label form: lower case, hyphen to blank, whitespace squeezed."""
    return F.regexp_replace(F.translate(F.lower(strip(text_of(c))), "-", " "), r"(?U)\s+", " ")


def norm_rate_text(c: Column) -> Column:
    """Loose frequency comparison form used on perturbed records."""
    return F.btrim(F.regexp_replace(F.lower(text_of(c)), "[^a-z0-9.]+", " "))


def regex_escape(c: Column) -> Column:
    """Quote a string so it matches itself inside a Java regular expression."""
    return F.regexp_replace(c, r"([^\p{L}\p{N}\s])", r"\\$1")


def unix_lines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


# every character that ends a line
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def line_array(c: Column) -> Column:
    """Lines of a text; one trailing line break adds no empty line."""
    return F.split(F.regexp_replace(c, f"(?:{LINE_BREAK})\\z", ""), LINE_BREAK, -1)


def to_number(c: Column) -> Column:
    """Number or NULL; blank and malformed text are NULL (suffix letters are not numbers)."""
    t = strip(c.cast("string"))
    return F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double"))


def is_true_word(c: Column) -> Column:
    return F.lower(strip(text_of(c))).isin("1", "true", "yes", "y")


def display_number(c: Column, digits: int = 3) -> Column:
    return F.when(c.isNull(), F.lit("n/a")).otherwise(F.format_string(f"%.{digits}f", c.cast("double")))


def find_text(haystack: Column, needle: Column) -> Column:
    """0-based offset of the first case-insensitive occurrence, NULL when absent."""
    at = F.instr(folded_case(haystack), folded_case(needle))
    return F.when((at > 0) & (F.length(needle) > 0), at - 1)


def slice_text(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))


def window_snippet(text: Column, start: Column, end: Column, window: int = 140) -> Column:
    """Whitespace-squeezed context around a span."""
    left = F.greatest(start - window, F.lit(0))
    return squeeze(slice_text(text, left, end + window))


def token_grams(c: Column, n: int = 4) -> Column:
    """Distinct token n-grams of the normalised text (empty when fewer than n tokens)."""
    def grams(tokens):
        count = F.size(tokens) - (n - 1)
        starts = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " ")))

    return let(F.filter(F.split(norm_label(c), " "), lambda t: t != ""), grams)


def gram_overlap(quote: Column, source: Column, n: int = 4) -> Column:
    """Quote shares a token n-gram with the source; short quotes must be contained."""
    few = F.size(F.filter(F.split(norm_label(quote), " "), lambda t: t != "")) < n
    return F.when(few, F.contains(norm_label(source), norm_label(quote))).otherwise(
        F.arrays_overlap(token_grams(quote, n), token_grams(source, n))
    )
