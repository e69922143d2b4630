"""Repairs against an exhaustive search over edits, and the whole query against a plain Python version."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict
from pathlib import Path

import pytest

from goldmeter.llm import queries, turns

SPACE = " \t\n\x0b\f\r"


def slow_edits(rows):
    """Uniform-cost search over (cost, audit) with whole audits; rows: (initial, must go, truncated)."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, roles = heapq.heappop(heap)
        state = roles[-1:] if roles else "0"
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, roles
        if (i, state) in done:
            continue
        done.add((i, state))
        nexts = {"0": "su", "s": "u", "u": "a", "a": "u"}[state]
        for r in nexts:
            if r != "s":
                heapq.heappush(heap, (cost + 2, audit + "I", i, (roles + r)))
        if i < len(rows):
            initial, gone, late = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, roles))
            if not gone:
                for r in nexts:
                    if r == initial:
                        heapq.heappush(heap, (cost + late, audit + "K", i + 1, roles + r))
                    if r != "s":
                        heapq.heappush(heap, (cost + 2 + late, audit + "R", i + 1, roles + r))


def coded(rows):
    return "".join("D" if gone else (i if i in "sua" and i else "x").upper() if late else (i if i in "sua" and i else "x") for i, gone, late in rows)


def test_search_is_optimal_and_audit_least():
    rnd = random.Random(9)
    for n in range(0, 60):
        for _ in range(40 if n < 14 else 8):
            rows = [(rnd.choice("suuuaaax"), rnd.random() < 0.15, rnd.random() < 0.3) for _ in range(n)]
            if rnd.random() < 0.3:
                rows = [("su"[i > 0] if i % 2 == 0 else "a", g, t) for i, (_, g, t) in enumerate(rows)]
            want = slow_edits(rows)[:2]
            assert turns.search(coded(rows), 0, turns.DONE) and min(turns.search(coded(rows), 0, turns.DONE).values()) == want
            for block in (1, 3, 7, 32):
                assert turns.best_edits(coded(rows), block) == want


def test_bounds_never_exceed_the_cost():
    rnd = random.Random(2)
    for _ in range(400):
        rows = [(rnd.choice("suax"), rnd.random() < 0.2, rnd.random() < 0.3) for _ in range(rnd.randrange(1, 9))]
        least, has_s = turns.bounds(coded(rows))
        assert least[0] - 2 * has_s[0] <= slow_edits(rows)[0]


def slow(conversations):
    """The contract row by row; rows: (conv, turn, role, text)."""
    by, out = defaultdict(list), {}
    for conv, turn, role, text in conversations:
        by[conv]
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        by[conv] += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    for conv, rows in by.items():
        digest = lambda r: hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], digest(r)))
        seen, flags, count = set(), [], defaultdict(int)
        for _, role, text in rows:
            body = text.rstrip(SPACE)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            count[fault] += 1
            flags.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        ts = [r[0] for r in rows if r[0] is not None]
        cost, audit, roles = slow_edits(flags)
        left, lines, at = iter(rows), [], 0
        for e in audit:
            row = None if e == "I" else next(left)
            if e != "D":
                lines.append((row[1] if e == "K" else {"u": "user", "a": "assistant"}[roles[at]]) + ":" + (row[2] if row else ""))
                at += 1
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
        out[conv] = (max(ts) - min(ts) + 1 - len(set(ts)) if ts else 0, count["blank"], count["duplicate"], count["truncated"], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def check(spark, folder, rows):
    got = queries.QUERIES["op11_branch_and_bound"](spark, folder).collect()
    want = slow(rows)
    assert len(got) == len(want)
    for r in got:
        assert tuple(r[c] for c in COLUMNS) == want[r["conv_id"]], r["conv_id"]


def test_query_on_odd_rows(spark, tmp_path):
    rnd = random.Random(4)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "User"]
    texts = ["Yes.", "No!\n", "open", "", " \t\n", None, "Why?  ", "ünï.", "x" * 5000 + ".", "a\x0b", "Yes."]
    rows = [(rnd.choice([None, *range(40)]), rnd.choice([None, *range(12)]), rnd.choice(roles), rnd.choice(texts)) for _ in range(900)]
    rows += [rows[3]] * 4 + [(77, 5, "user", "alone."), (1000, None, None, None)]
    rows += [(500, i, ("user", "assistant")[i % 2], f"turn {i}.") for i in range(400)] + [(600, i, "user", "same.") for i in range(300)]
    spark.createDataFrame([(*r, "s", 1) for r in rows], "conv_id long, turn long, role string, text string, conv string, part int").write.parquet(f"{tmp_path}/conversations.parquet")
    check(spark, str(tmp_path), rows)


def test_conversation_without_rows_after_damage(spark, tmp_path):
    gone = [c for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    rows = [(c, 0, "user", "x.") for c in gone]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    check(spark, str(tmp_path), rows)
    assert gone and all(v == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for v in slow(rows).values())


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    check(spark, str(tmp_path), [])


def test_query_on_given_table(spark):
    folder = "/root/testdata/sf0.01"
    if not Path(folder).exists():
        pytest.skip("driver tables are not mounted")
    check(spark, folder, [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()])
