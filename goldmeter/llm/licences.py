"""Licence scans by canonical digest: a whole text, normalised, is looked up by SHA-256 among known licence texts.

DataFrame functions only. Canonical form: lower case, copyright lines removed, equivalent spellings replaced, every run of
characters that are neither ASCII letters nor digits becomes one blank, ends trimmed. A sentence of a licence that wraps before
`copyright` is no copyright line. All known texts are ASCII, so a text with other letters or digits is none of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Equivalent spellings, each whole word on the left replaced by the word on the right.
SPELLINGS = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("licencing", "licensing"), ("sublicence", "sublicense"),
    ("acknowledgement", "acknowledgment"), ("acknowledgements", "acknowledgments"), ("analogue", "analog"), ("authorisation", "authorization"),
    ("authorised", "authorized"), ("centre", "center"), ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"), ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"), ("labour", "labor"),
    ("merchantability", "merchantability"), ("noncommercial", "non commercial"), ("organisation", "organization"), ("organise", "organize"),
    ("practise", "practice"), ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"),
    ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"), ("copyright holder", "copyright owner"), ("per cent", "percent"),
]

# Short licence notices and complete short licences, by identifier.
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("MIT", "Released under the MIT License."),
    ("MIT", """MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """ISC License

Copyright (c) <year> <owner>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Zlib", """Copyright (c) <year> <owner>

This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""),
    ("0BSD", """Copyright (C) <year> by <owner>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
]

# A line that opens with `copyright` and one of these words, or with nothing behind it, is the rest of a wrapped sentence.
SENTENCE = r"[ \t\r]*(?:\n|$)|[ \t-]+(?:notices?|holders?|owners?|laws?|interests?|licen[cs]es?|statements?|and|or|in|is)\b"
COPYRIGHT_LINE = rf"(^|\n)[ \t]*(copyright\b(?!{SENTENCE})|\(c\)|©)[^\n]*"
FOREIGN = r"[\p{L}\p{N}&&[^\x00-\x7F]]"
PUNCTUATION = "[^a-z0-9]+"


def without_notices(text: Column) -> Column:
    """ASCII letters lowered, copyright lines removed."""
    t = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(t, COPYRIGHT_LINE, "\n")


def canonical(text: Column) -> Column:
    """Canonical form of a whole text; null counts as empty. ASCII letters are lowered; others become blanks like punctuation."""
    t = F.concat(F.lit(" "), F.trim(F.regexp_replace(without_notices(text), PUNCTUATION, " ")), F.lit(" "))
    for left, right in SPELLINGS:
        t = F.replace(t, F.lit(f" {left} "), F.lit(f" {right} "))
    return F.trim(t)


def known_licences(spark: SparkSession, texts: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """licence, digest of every known text; two spellings of one text give one row."""
    rows = spark.createDataFrame(texts, "licence string, body string")
    return rows.select("licence", F.sha2(canonical(F.col("body")), 256).alias("digest")).groupBy("digest").agg(F.min("licence").alias("licence"))


def scan(docs: DataFrame, known: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """One row per input row: keys, digest, licence (null when the text is no known licence).

    Only the digest leaves the scan, so texts are not shuffled; the table of known digests joins by equality and Spark broadcasts
    it by its size. Repeated rows stay; null or empty texts have the digest of the empty form and match nothing known.
    """
    digests = docs.select(*keys, F.sha2(canonical(F.col(text)), 256).alias("digest"), without_notices(F.col(text)).rlike(FOREIGN).alias("_foreign"))
    return digests.join(known.select("digest", "licence"), "digest", "left").select(*keys, "digest", F.when(~F.col("_foreign"), F.col("licence")).alias("licence"))


def scan_lines(docs: DataFrame, known: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Licence notices standing as whole lines in a text: keys, licence, lines (how many). Lines without the stem are skipped
    before they are hashed: every known text holds `licen`, `permission` or `redistribut`."""
    line = F.explode(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: x.rlike("(?i)licen|permission|redistribut"))).alias("line")
    digests = docs.select(*keys, line).filter(~without_notices(F.col("line")).rlike(FOREIGN)).select(*keys, F.sha2(canonical(F.col("line")), 256).alias("digest"))
    return digests.join(known.select("digest", "licence"), "digest").groupBy(*keys, "licence").agg(F.count(F.lit(1)).alias("lines"))


def canonical_sql(x: str) -> str:
    t = f"translate(coalesce({x}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    t = f"' ' || trim(regexp_replace(regexp_replace({t}, '(^|\\n)[ \\t]*(copyright|\\(c\\)|©)[^\\n]*', chr(10), 'g'), '[^a-z0-9]+', ' ', 'g')) || ' '"
    for left, right in SPELLINGS:
        t = f"replace({t}, ' {left} ', ' {right} ')"
    return f"trim({t})"
