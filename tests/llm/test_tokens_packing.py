"""Encoders against the public tokenizers; packing covers every id once."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from goldmeter.llm import packing, tokens
from goldmeter.llm.common import vocabulary

tokenizers = pytest.importorskip("tokenizers")
BYTES, WORDS = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")


def test_byte_encoding_and_decoding(spark, odd_docs, plain):
    public = tokenizers.Tokenizer.from_file(BYTES)
    got = tokens.decode(tokens.encode(odd_docs, BYTES), BYTES).collect()
    assert len(got) == len(plain)
    for row, (doc_id, text) in zip(sorted(got, key=lambda r: (r["doc_id"] is None, r["doc_id"], r["decoded"])), sorted(plain, key=lambda r: (r[0] is None, r[0], r[1] or ""))):
        want = public.encode(text or "", add_special_tokens=False).ids
        assert (row["doc_id"], row["ids"]) == (doc_id, want)
        assert row["decoded"] == public.decode(want, skip_special_tokens=False)


def test_word_encoding(plain):
    public = tokenizers.Tokenizer.from_file(WORDS)
    texts = [t or "" for _, t in plain]
    for text, ids in zip(texts, tokens.word_encoder(WORDS).encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == public.encode(text, add_special_tokens=False).ids


def test_word_memory_forgets():
    memory = tokens.Memory(lambda words: (np.array([ord(c) for w in words for c in w], "<u4"), np.array([len(w) for w in words])), 5)
    for i in range(20):
        ids, counts = memory.look_up([str(i), "a", str(i + 1), "a"])
        assert bytes(ids.tolist()) == f"{i}a{i + 1}a".encode() and counts.tolist() == [len(str(i)), 1, len(str(i + 1)), 1]
        assert len(memory.known) <= 5 + 3
    assert memory.look_up([])[0].tolist() == []


def test_flat_encoders_equal_the_public_tokenizers():
    """Line breaks, double blanks, control characters, apostrophes, numbers, signs, scripts, added tokens and long words."""
    rnd = random.Random(11)
    parts = ["it's", "'re", "x'll've", "42", "Über", "Ⱥbc", "été,", "日本", "🙂!", "--", "a.b", "<|endoftext|>", "x" * 40, "Σας", "12½", "ª", "ͅ", "n\u0303"]
    gaps = [" ", " ", " ", "\n", "  ", "\n ", " \n", "\t", "\u00a0", "", "\x1c", "\0", "\1", "\r\n", "\n\n"]
    texts = ["".join(rnd.choice(parts) + rnd.choice(gaps[: rnd.choice((4, len(gaps)))]) for _ in range(rnd.randrange(30))) for _ in range(400)]
    for path, coder in ((BYTES, tokens.byte_encoder(BYTES)), (WORDS, tokens.word_encoder(WORDS))):
        public = tokenizers.Tokenizer.from_file(path)
        for text, ids in zip(texts, coder.encode(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == public.encode(text, add_special_tokens=False).ids, repr(text)


def test_damaged_pairs_never_form():
    """The automaton equals repeated merging of the smallest rank, on a vocabulary with self-overlapping merges."""
    merges = [("a", "a"), ("a", "b"), ("aa", "aa"), ("b", "a"), ("aa", "b"), ("ab", "ab"), ("ba", "ab")]
    ids = {t: i for i, t in enumerate(["a", "b", *(x + y for x, y in merges)])}
    machine = tokens.Automaton(ids, merges)

    def slow(word):
        parts = list(word)
        while True:
            ranks = [(merges.index(p), i) for i, p in enumerate(zip(parts, parts[1:])) if p in merges]
            if not ranks:
                return [ids[p] for p in parts]
            rank, _ = min(ranks)
            out, i = [], 0
            while i < len(parts):
                if tuple(parts[i: i + 2]) == merges[rank]:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out

    words = [format(i, f"0{n}b").replace("0", "a").replace("1", "b") for n in range(1, 10) for i in range(2**n)]
    for word, got in zip(words, machine.encode_words([w.encode() for w in words])):
        assert np.frombuffer(got, "<u4").tolist() == slow(word), word


def check_sequences(rows, limits):
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append(r)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= limits.tokens and len(pieces) <= limits.segments and sum(r["loss_tokens"] for r in pieces) <= limits.loss
    return sequences


def test_packing_covers_every_id(spark, odd_docs, plain):
    rows = packing.pack(odd_docs, WORDS, with_ids=True).collect()
    check_sequences(rows, packing.Limits())
    encoder = tokens.word_encoder(WORDS)
    want = sorted(((k is None, k), ids + packing.END) for (k, _), ids in zip(plain, encoder.encode([t or "" for _, t in plain])))
    got = defaultdict(list)
    for r in rows:
        ids = np.array(r["ids"], "<u4").tobytes()
        assert zlib.crc32(ids) == r["ids_crc32"] and len(ids) == 4 * r["length"]
        got[r["doc_id"], r["doc_tokens"]].append((r["start"], ids))
    copies = 2  # row 12 stands twice
    for (_, k), ids in want:
        pieces = sorted(got[k, len(ids) // 4])
        joined = b"".join(x for _, x in pieces) if len({s for s, _ in pieces}) == len(pieces) else None
        assert joined == ids if joined is not None else sum(len(x) for _, x in pieces) == copies * len(ids)


def test_limits_hold_together():
    limits = packing.Limits(tokens=64, segments=3, loss=40, least_cut=4)
    rnd = np.random.default_rng(1)
    pieces = [packing.Piece(i, 0, int(n), int(rnd.integers(0, n + 1))) for i, n in enumerate(rnd.integers(1, 150, 200))]
    full, left = packing.fill(pieces, limits, True)
    seen = defaultdict(int)
    for row in full:
        assert sum(p.size for p in row) <= 64 and len(row) <= 3 and sum(p.size - p.unlearned for p in row) <= 40
        for p in row:
            seen[p.row] += p.size
    assert not left and all(seen[p.row] == p.size for p in pieces)
    assert [sum(p.size for p in r) for r in packing.powers_of_two([packing.Piece(0, 0, 37, 0), packing.Piece(1, 0, 6, 2)])] == [32, 8, 2, 1]


def test_prompt_bears_no_loss(spark):
    df = spark.createDataFrame([(1, "say hello", "hello"), (2, None, "x"), (3, "p", None)], "doc_id long, ask string, text string")
    rows = {r["doc_id"]: r for r in packing.pack(df, WORDS, prompt="ask").collect()}
    assert [(rows[i]["length"], rows[i]["loss_tokens"]) for i in (1, 2, 3)] == [(4, 2), (2, 2), (2, 1)]


def test_empty_table(no_docs):
    assert packing.pack(no_docs, WORDS).count() == 0
    assert tokens.decode(tokens.encode(no_docs, BYTES), BYTES).count() == 0
