"""Conversation repair: the cheapest edits that make a conversation's roles `(s?(ua)+)?`, by depth-first branch and bound.

A node is a number of rows dealt with and a role state (nothing yet, after s, after u, after a); its moves keep, rename, delete
or insert. The search keeps an explicit stack, an incumbent (cost, audit) for each wanted end state and, for each node, the best
prefix that reached it: a prefix that is not better is dominated. Two prefixes of one node and one cost are never beginnings of
one another (an insertion costs), so comparing their audits decides for every continuation. A prefix is cut if its cost and a
lower bound of the rest exceed the incumbents: forced deletions, one for each truncated row, two for each row of a role that
can't stay and two for each second of a stretch of equal roles. The stack's end proves the optimum.

Conversations longer than a block are searched block by block, from every state to every state, and the blocks' tables are
joined pairwise, so the work is linear in the rows.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cost of each edit; a truncated row that stays costs LATE more.
KEEP, RENAME, DELETE, INSERT, LATE = 0, 2, 3, 2, 1
#: Role state after a wanted role: 0 nothing yet, 1 after s, 2 after u, 3 after a; DONE are those a conversation may end in.
AFTER = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
WANTED = ("u", "u", "a", "u")
DONE = (0, 3)
NAMES = {"u": "user", "a": "assistant"}
BLOCK = 32

#: A row is coded as D (must go), or its role's initial (s, u, a, or x for all others), in capitals if it is truncated.
Best = tuple[int, str]


def bounds(rows: str) -> tuple[list[int], list[bool]]:
    """For each suffix: the least cost of its edits if a leading s can't stay, and whether it holds an s."""
    least, has_s = [0] * (len(rows) + 1), [False] * (len(rows) + 1)
    before, run = "", 0
    for i in range(len(rows) - 1, -1, -1):
        code = rows[i]
        cost = least[i + 1]
        if code == "D":
            cost += DELETE
        else:
            cost += LATE if code.isupper() else 0
            kind = code.lower()
            if kind in "sx":
                cost += min(RENAME, DELETE)
                before = ""
            else:
                run = run + 1 if kind == before else 1
                before = kind
                if run % 2 == 0:
                    cost += min(RENAME, DELETE - LATE, INSERT)
        least[i], has_s[i] = cost, has_s[i + 1] or code in "sS"
    return least, has_s


@functools.lru_cache(maxsize=1 << 14)
def search(rows: str, entry: int, ends: tuple[int, ...]) -> dict[int, Best]:
    """The best (cost, audit) from state `entry` over all rows to each reachable state of `ends`."""
    n = len(rows)
    least, has_s = bounds(rows)
    table: dict[tuple[int, int], Best] = {(0, entry): (0, "")}
    stack = [(0, entry, 0, "")]

    def hopeless(i: int, state: int, cost: int, audit: str) -> bool:
        total = cost + least[i] - (RENAME if state == 0 and has_s[i] else 0)
        for end in ends:
            known = table.get((n, end))
            if known is None or total < known[0] or total == known[0] and audit <= known[1][: len(audit)]:
                return False
        return True

    while stack:
        i, state, cost, audit = stack.pop()
        if table[i, state] != (cost, audit) or hopeless(i, state, cost, audit):
            continue
        moves = [(cost + INSERT, audit + "I", i, AFTER[state, WANTED[state]])]
        if i < n:
            code = rows[i]
            moves.append((cost + DELETE, audit + "D", i + 1, state))
            if code != "D":
                late = LATE if code.isupper() else 0
                moves.append((cost + RENAME + late, audit + "R", i + 1, AFTER[state, WANTED[state]]))
                if (kept := AFTER.get((state, code.lower()))) is not None:
                    moves.append((cost + KEEP + late, audit + "K", i + 1, kept))
        for total, text, at, then in sorted(moves, reverse=True):  # the best is taken first
            if (total, text) < table.get((at, then), (1 << 62, "")) and not hopeless(at, then, total, text):
                table[at, then] = (total, text)
                stack.append((at, then, total, text))
    return {end: table[n, end] for end in ends if (n, end) in table}


def best_edits(rows: str, block: int = BLOCK) -> Best:
    """The least cost and the ASCII-least audit of that cost."""
    if len(rows) <= block:
        return min(search(rows, 0, DONE).values())
    every = (0, 1, 2, 3)
    tables = [{(e, x): b for e in ((0,) if a == 0 else every) for x, b in search(rows[a: a + block], e, every).items()} for a in range(0, len(rows), block)]
    while len(tables) > 1:
        joined = []
        for left, right in zip(tables[::2], tables[1::2]):
            both: dict[tuple[int, int], Best] = {}
            for (e, m), (c, t) in left.items():
                for x in every:
                    if (m, x) in right:
                        way = (c + right[m, x][0], t + right[m, x][1])
                        both[e, x] = min(both.get((e, x), way), way)
            joined.append(both)
        tables = joined + tables[len(tables) - len(tables) % 2:]
    return min(b for (_, x), b in tables[0].items() if x in DONE)


def _rows(turns: DataFrame, conv: str, turn: str, role: str, text: str, present: Column | None) -> DataFrame:
    """Columns conv, turn, role, text (null: one space), present, digest."""
    there = F.lit(True) if present is None else present
    own = turns.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"), there.alias("present"))
    return own.withColumn("digest", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))))


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """Consecutive rows of one conversation, as an iterator that is read before the next is asked for."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
    held = next(rows, None)
    while held is not None:
        conv = held[0]

        def own():
            nonlocal held
            while held is not None and held[0] == conv:
                row = held
                held = next(rows, None)
                yield row

        mine = own()
        yield conv, mine
        for _ in mine:
            pass


PLAN = "conv {kind}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def _kind(turns: DataFrame, conv: str) -> str:
    return turns.schema[conv].dataType.simpleString()


def plan_repairs(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None) -> DataFrame:
    """conv, gaps, blank, duplicate, truncated, illegal, cost, audit: one row per conversation.

    Rows stand by turn (nulls first), then role and text digest. A null role or text is one space. A row's first fault counts:
    blank, duplicate (role and text stood before), truncated. A row for which `present` is false holds no turn; a conversation
    of such rows only has zeros and an empty audit. Null is a conversation of its own. Other columns are not read, an empty table
    gives no rows. Texts stay behind: a task holds a digest and a letter for each turn of one conversation (its audit has as
    many letters), whatever the texts' length.
    """
    kind = _kind(turns, conv)
    body = F.expr(r"trim(TRAILING ' \t\n\u000b\f\r' FROM text)")
    slim = _rows(turns, conv, turn, role, text, present).withColumn("body", body).select(
        "conv", "turn", F.left("role", F.lit(1)).alias("role1"), "digest", "present", "role",
        F.when(F.col("body") == "", "b").when(F.right("body", F.lit(1)).isin(".", "!", "?"), "").otherwise("t").alias("flag"))
    slim = slim.repartition("conv").sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "digest").select("conv", "turn", "role1", "digest", "flag", "present")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        types = None

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])

        def watched() -> Iterator[pa.RecordBatch]:
            nonlocal types
            for b in batches:
                types = types or [b.schema.field(0).type, *[pa.int64()] * 6, pa.string()]
                yield b

        for conv_id, rows in _conversations(watched()):
            seen: set[bytes] = set()
            codes: list[str] = []
            first = last = None
            distinct = blank = duplicate = truncated = illegal = 0
            before = None
            for _, t, initial, digest, flag, there in rows:
                if not there:
                    continue
                if t is not None and t != last:
                    first, last, distinct = t if first is None else first, t, distinct + 1
                if before is not None and before + initial not in ("su", "ua", "au"):
                    illegal += 1
                before = initial
                code = initial if initial in ("s", "u", "a") else "x"
                if flag == "b":
                    blank, code = blank + 1, "D"
                elif digest in seen:
                    duplicate, code = duplicate + 1, "D"
                elif flag == "t":
                    truncated, code = truncated + 1, code.upper()
                seen.add(digest)
                codes.append(code)
            cost, audit = best_edits("".join(codes))
            out.append((conv_id, last - first + 1 - distinct if distinct else 0, blank, duplicate, truncated, illegal, cost, audit))
            if len(out) >= 1000:
                yield flush()
        if out:
            yield flush()

    return slim.mapInArrow(run, PLAN.format(kind=kind)).withColumnRenamed("conv", conv)


def _edited(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """Role and text of the repaired rows, one after another."""
    state = 0
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit == "K":
            wanted = role[:1]
        else:
            wanted = WANTED[state]
            role = NAMES[wanted]
        state = AFTER[state, wanted]
        yield role, text


def _with_plans(turns: DataFrame, plans: DataFrame, conv: str, turn: str, role: str, text: str, present: Column | None) -> DataFrame:
    """conv, audit, role, text: of each conversation first its plan, then its rows in order."""
    rows = _rows(turns, conv, turn, role, text, present).where("present")
    none = F.lit(None).cast("string")
    rows = rows.select("conv", F.lit(1).alias("part"), "turn", "role", "digest", "text", none.alias("audit"))
    first = plans.select(F.col(conv).alias("conv"), F.lit(0).alias("part"), F.lit(None).cast("long").alias("turn"), none.alias("role"), F.lit(None).cast("binary").alias("digest"), none.alias("text"), "audit")
    both = rows.unionByName(first).repartition("conv")
    return both.sortWithinPartitions("conv", "part", F.col("turn").asc_nulls_first(), "role", "digest").select("conv", "audit", "role", "text")


def repaired_turns(turns: DataFrame, plans: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None) -> DataFrame:
    """conv, position, role, text: the rows of the repaired conversations, in order within each partition, a conversation's rows in
    one partition. Texts pass through one at a time."""
    kind = _kind(turns, conv)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size, types = 0, None

        def watched() -> Iterator[pa.RecordBatch]:
            nonlocal types
            for b in batches:
                types = types or [b.schema.field(0).type, pa.int64(), pa.string(), pa.string()]
                yield b

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["conv", "position", "role", "text"])

        for conv_id, rows in _conversations(watched()):
            audit = next(rows)[1]
            for i, (r, t) in enumerate(_edited(audit, ((x[2], x[3]) for x in rows))):
                out.append((conv_id, i, r, t))
                size += len(t)
                if len(out) >= 4096 or size >= 1 << 22:
                    yield flush()
                    size = 0
        if out:
            yield flush()

    rows = _with_plans(turns, plans, conv, turn, role, text, present)
    return rows.mapInArrow(run, f"conv {kind}, position bigint, role string, text string").withColumnRenamed("conv", conv)


def text_digests(repaired: DataFrame, conv: str = "conv_id") -> DataFrame:
    """conv, repaired_sha256 of `role:text` lines joined by line breaks, from the rows that `repaired_turns` gives, in their order:
    a digest can't be merged from parts, so a conversation's rows are read in one task, one at a time."""
    kind = _kind(repaired, conv)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = None
        done: list[tuple] = []

        def watched() -> Iterator[pa.RecordBatch]:
            nonlocal key
            for b in batches:
                key = key or b.schema.field(0).type
                yield b

        def flush() -> pa.RecordBatch:
            ids, digests = zip(*done)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(ids, key), pa.array(digests, pa.string())], names=["conv", "repaired_sha256"])

        for conv_id, rows in _conversations(watched()):
            digest = hashlib.sha256()
            for _, position, r, t in rows:
                digest.update(("\n" * (position > 0) + f"{r}:{t}").encode("utf-8", "surrogatepass"))
            done.append((conv_id, digest.hexdigest()))
            if len(done) >= 4096:
                yield flush()
        if done:
            yield flush()

    own = repaired.select(F.col(conv).alias("conv"), "position", "role", "text")
    return own.mapInArrow(run, f"conv {kind}, repaired_sha256 string").withColumnRenamed("conv", conv)
