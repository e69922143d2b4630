"""Texts cut at all span edges, with the labels and ids that cover each piece.

An ordered sweep keeps the open spans as its state. A text is cut into cells of positions, and each cell is swept by itself: a
span stands in every cell it reaches, carried in as open where it began before, so a hot document is many groups. A piece
belongs to the cell in which it begins; where its end lies in a later cell, that cell's first edge is handed to the sweep.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CELL = 4096
SIDES = ("gold", "pred")
_OUT = ["document_id", "start", "end", "gold_labels", "gold_ids", "pred_labels", "pred_ids"]


class _Open:
    """Spans open at one place: ids and labels of each side, in order."""

    def __init__(self):
        self.ids: dict[str, list[str]] = {s: [] for s in SIDES}
        self.labels: dict[str, list[str]] = {s: [] for s in SIDES}

    def add(self, side: str, label: str, ident: str) -> None:
        insort(self.ids[side], ident)
        insort(self.labels[side], label)

    def drop(self, side: str, label: str, ident: str) -> None:
        for values, x in ((self.ids[side], ident), (self.labels[side], label)):
            del values[bisect_left(values, x)]

    def lists(self) -> list[list[str]]:
        return [x for s in SIDES for x in (list(dict.fromkeys(self.labels[s])), list(self.ids[s]))]


def _sweep(rows: Iterator[tuple], after: int | None, end_of_cell: int) -> Iterator[tuple]:
    """(start, end, lists) of the pieces that begin in one cell; rows (at, until, side, label, id, is_edge) by place, `after` the
    next edge beyond the cell."""
    state, closing = _Open(), []
    last = None
    held = next(rows, None)
    while held is not None or closing and closing[0][0] < end_of_cell:
        place = min([held[0]] if held is not None else [], default=end_of_cell)
        closes = bool(closing) and closing[0][0] <= place
        place = closing[0][0] if closes else place
        edge = closes
        pending = []
        while held is not None and held[0] == place:
            edge |= held[5] or held[1] == place  # it begins here, or was carried in and ends here
            pending.append(held)
            held = next(rows, None)
        if edge and last is not None and place > last:
            yield last, place, state.lists()
        while closing and closing[0][0] == place:
            state.drop(*heappop(closing)[1:])
        for _, until, side, label, ident, _ in pending:
            if side is not None and until > place:
                state.add(side, label, ident)
                heappush(closing, (until, side, label, ident))
        if edge:
            last = place
    if last is not None and after is not None:
        yield last, after, state.lists()


def covered_segments(texts: DataFrame, spans: DataFrame, width: int = CELL) -> DataFrame:
    """document_id, start, end, gold_labels, gold_ids, pred_labels, pred_ids (sorted; labels once each), kind.

    `texts` has document_id, length; `spans` has document_id, start, end, label, span_id, side ('gold' | 'pred'). Spans that are
    empty or don't lie in their text are left out, null labels and ids count as empty. A text of length 0 has no pieces.
    """
    text_of = texts.select("document_id", F.col("length").cast("long").alias("_n"))
    ok = spans.join(text_of, "document_id").filter((F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.col("_n")))
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    ok = ok.select("document_id", F.col("start").cast("long").alias("s"), F.col("end").cast("long").alias("e"), "side", name("label").alias("label"), name("span_id").alias("id"))
    cell = F.explode(F.sequence(F.floor(F.col("s") / width), F.floor(F.col("e") / width)))
    placed = ok.withColumn("cell", cell).withColumn("at", F.greatest("s", F.col("cell") * width)).withColumn("edge", F.col("s") >= F.col("cell") * width)
    bounds = text_of.select("document_id", F.explode(F.array(F.lit(0).cast("long"), F.col("_n"))).alias("at"))
    nothing = F.lit(None).cast("string")
    bounds = bounds.select("document_id", F.floor(F.col("at") / width).alias("cell"), "at", F.col("at").alias("e"), nothing.alias("side"), nothing.alias("label"), nothing.alias("id"), F.lit(True).alias("edge"))
    rows = placed.select("document_id", "cell", "at", "e", "side", "label", "id", "edge").unionByName(bounds)
    # the first edge of every cell, and from it the next one beyond each cell
    first = F.when(F.col("edge"), F.col("at")).when(F.col("e") < (F.col("cell") + 1) * width, F.col("e"))
    firsts = rows.groupBy("document_id", "cell").agg(F.min(first).alias("first")).filter(F.col("first").isNotNull())
    nexts = firsts.withColumn("after", F.lead("first").over(W.partitionBy("document_id").orderBy("cell")))
    heads = nexts.select("document_id", "cell", F.lit(-1).cast("long").alias("at"), F.col("after").alias("e"), nothing.alias("side"), nothing.alias("label"), nothing.alias("id"), F.lit(False).alias("edge"))
    swept = rows.unionByName(heads).repartition("document_id", "cell").sortWithinPartitions("document_id", "cell", "at")
    kind = texts.schema["document_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: list[pa.DataType] = []
        out: list[tuple] = []
        weight = 0

        def stream() -> Iterator[tuple]:
            for b in batches:
                if not types:
                    types.extend([b.schema.field(0).type, pa.int64(), pa.int64(), *[pa.list_(pa.string())] * 4])
                yield from zip(*(c.to_pylist() for c in b.columns))

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=_OUT)

        every = stream()
        held = next(every, None)
        while held is not None:
            doc, cell = held[:2]
            after = None

            def own() -> Iterator[tuple]:
                nonlocal held, after
                while held is not None and held[:2] == (doc, cell):
                    row, held = held, next(every, None)
                    if row[2] < 0:
                        after = row[3]
                    else:
                        yield row[2], row[3], row[4], row[5], row[6], row[7]

            mine = own()
            ahead = next(mine, None)  # reads the head, which comes first
            rows_of_cell = (x for part in ([ahead] if ahead is not None else [], mine) for x in part)
            for start, end, lists in _sweep(rows_of_cell, after, (cell + 1) * width):
                out.append((doc, start, end, *lists))
                weight += sum(map(len, lists)) + 4
                if weight > 100_000:
                    yield flush()
                    weight = 0
            for _ in mine:
                pass
        if out:
            yield flush()

    schema = f"document_id {kind}, start bigint, end bigint, gold_labels array<string>, gold_ids array<string>, pred_labels array<string>, pred_ids array<string>"
    g, p = F.size("gold_ids") > 0, F.size("pred_ids") > 0
    return swept.mapInArrow(run, schema).withColumn("kind", F.when(g & p, "both").when(g, "gold").when(p, "pred").otherwise("plain"))
