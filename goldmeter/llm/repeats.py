"""Runs of words: maximal periodic stretches of texts, found by the dictionary of basic factors.

The factors of one power-of-two length L get names, equal factors equal names; the names of length 2L are those of two neighbours.
A run of smallest period q, L <= q < 2L, repeats a factor of length L at distance q. So from every place of a factor its later
places within 2L are visited: those at equal distances of at most L are one arithmetic progression, of which only the next place
and, further on, the first and the last can be at distance q (places between them would give the run a smaller period). Each
distance is extended to both sides as far as words agree, and of equal stretches the smallest period is kept.

All texts of a batch are named together, and places whose factor occurs once are dropped from the next length. Names are words'
64-bit hashes at first (two different words of a text agree with a probability below 2^-60) and exact from there on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldmeter.llm.tokens import gather, portions
from goldmeter.llm.words import mix, span_hashes, word_spans

FAR = np.int64(1) << 62


def _named(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the distinct keys in their order, and which keys occur more than once."""
    _, names, sizes = np.unique(keys, return_inverse=True, return_counts=True)
    return names, sizes[names] > 1


def _distances(place: np.ndarray, name: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances from `size` to below twice that at which a factor of that size may begin a period."""
    order = np.argsort(name, kind="stable")
    at, own = place[order], name[order]
    gap = np.full(len(at), FAR)
    gap[:-1] = np.where(own[1:] == own[:-1], at[1:] - at[:-1], FAR)
    breaks = np.flatnonzero(np.r_[gap[1:] != gap[:-1], True])
    last = breaks[np.searchsorted(breaks, np.arange(len(at)))] + 1  # where the progression from here ends
    cur = np.flatnonzero(gap < 2 * size)
    base, first = at[cur], True
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def propose(d: np.ndarray) -> None:
        good = (d >= size) & (d < 2 * size)
        found.append((base[good], d[good]))

    while len(cur):
        propose(at[cur + 1] - base)
        end = np.where(gap[cur] <= size, last[cur], cur + 1)
        far = at[end] - base
        if not first:
            propose(np.where(end > cur + 1, far, FAR))
        first = False
        go_on = (far < 2 * size) & (gap[end] < 2 * size)
        cur, base = end[go_on], base[go_on]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([d for _, d in found])


def _agree(words: np.ndarray, a: np.ndarray, d: np.ndarray, step: int) -> np.ndarray:
    """How many words from `a` on, forwards or backwards, are the same as those `d` later."""
    n, out = len(words), np.zeros(len(a), np.int64)
    rows = np.arange(len(a))
    while len(rows):
        x = a[rows] + step * out[rows]
        inside = (x >= 0) & (x + d[rows] < n)
        rows, x = rows[inside], x[inside]
        rows = rows[words[x] == words[x + d[rows]]]
        out[rows] += 1
    return out


def word_runs(words: np.ndarray, text: np.ndarray, least: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all runs of at least `least` words and two periods, by start, then period.

    `words` are the words' hashes, one text after another; `text` numbers each word's text, in rising order. A run lies in one
    text; starts count from the first word of the first text.
    """
    none = np.zeros(0, np.int64)
    if not len(words):
        return none, none, none
    longest = int(np.bincount(text).max())
    names, alive = _named(mix(words + mix(text.astype(np.uint64) + np.uint64(1))))
    same = names  # equal for equal words of a text
    place, name, size = np.flatnonzero(alive), names[alive], 1
    stretches = []
    while len(place) and 2 * size <= longest:
        at, d = _distances(place, name, size)
        if len(at):
            order = np.lexsort((at, d))
            at, d = at[order], d[order]
            fresh = np.r_[True, (d[1:] != d[:-1]) | (at[1:] > at[:-1] + 1)]
            i0, i1, period = at[fresh], at[np.r_[fresh[1:], True]], d[fresh]
            start = i0 - _agree(same, i0 - 1, period, -1)
            end = i1 + size + period + _agree(same, i1 + size, period, 1)
            long = end - start >= np.maximum(least, 2 * period)
            stretches.append(np.stack([start[long], end[long], period[long]]))
        # the next length: two neighbours that both occur again
        number = np.full(len(words) + size, -1, np.int64)
        number[place] = name
        right = number[place + size]
        both = right >= 0
        place, left, right = place[both], name[both], right[both]
        name, again = _named(left * (int(right.max()) + 1 if len(right) else 1) + right)
        place, name, size = place[again], name[again], 2 * size
    if not stretches:
        return none, none, none
    start, end, period = np.concatenate(stretches, axis=1)
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    smallest = np.r_[True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])][: len(start)]
    start, end, period = start[smallest], end[smallest], period[smallest]
    order = np.lexsort((period, start))
    return start[order], (end - start)[order], period[order]


RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 12) -> DataFrame:
    """key, runs (by start, then period), collapsed: the words that no run repeats, joined by one blank.

    Words are what stands between blanks and 0x09-0x0D, numbered from 0; a run is a stretch of at least `least` words and two of
    its smallest periods that no neighbouring word extends. A word is dropped from `collapsed` if a run holds it after its first
    period. Null, empty and blank texts have no words: no runs, empty `collapsed`. Repeated rows stay apart, other columns are
    not read, an empty table gives no rows. Nothing is shuffled; memory per task: about 4 MB of texts or one text, some 20 bytes
    for each of their bytes.
    """
    kind = docs.schema[key].dataType.simpleString()
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in portions(b, 1, 1 << 20):
                block = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in part.column(1)]
                flat, begins, ends, bounds = word_spans(block)
                counts = np.diff(bounds)
                of = np.repeat(np.arange(len(block)), counts)
                start, length, period = word_runs(span_hashes(flat, begins, ends), of, least)
                owner = of[start]
                change = np.zeros(len(begins) + 1, np.int64)
                np.add.at(change, start + period, 1)
                np.add.at(change, start + length, -1)
                kept = np.cumsum(change)[:-1] == 0
                wide = (ends - begins + 1)[kept]  # with the byte after the word, which becomes the blank
                out = gather(flat, begins[kept], wide)
                stops = np.cumsum(wide)
                out[stops - 1] = 32
                last = np.r_[0, stops][np.cumsum(np.bincount(of[kept], minlength=len(block)))].tolist()
                data = out.tobytes()
                texts = [data[x: max(x, y - 1)].decode("utf-8", "surrogatepass") for x, y in zip([0, *last], last)]
                items = pa.StructArray.from_arrays([pa.array(start - bounds[owner]), pa.array(length), pa.array(period)], names=["start", "length", "period"])
                offsets = np.r_[0, np.cumsum(np.bincount(owner, minlength=len(block)))].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), items).cast(run_type)
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(texts, pa.string())], names=["key", "runs", "collapsed"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, runs {RUNS}, collapsed string").withColumnRenamed("key", key)
