"""Words of texts as 64-bit hashes, whole batches at a time.

A word is a run of bytes other than blank and 0x09-0x0D, with A-Z lowered. Its hash is a polynomial over random byte values,
taken from running sums and mixed; equal words have equal hashes, and two of 10**8 different words collide with probability
below 0.001.
"""

from __future__ import annotations

import numpy as np

_random = np.random.default_rng(20)
_TABLE = _random.integers(0, 2**64, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
SECOND = np.uint64(0xC2B2AE3D27D4EB4F)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(n, base, np.uint64)], dtype=np.uint64)


_powers_of: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, n.bit_length())
    if size not in _powers_of:
        _powers_of.clear()
        _powers_of[size] = _powers(BASE, size), _powers(_BASE_INVERSE, size)
    return _powers_of[size]


def word_hashes(block: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a block of texts, and where each text's words begin (one entry more than texts)."""
    flat = _FOLD[np.frombuffer(b"\n" + b"\n".join(block) + b"\n", np.uint8)]
    up, down = _tables(len(flat))
    space = _SPACE[flat]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    sums = np.r_[np.uint64(0), np.cumsum(_TABLE[flat] * up[: len(flat)], dtype=np.uint64)]
    words = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return words, np.r_[0, np.searchsorted(starts, np.cumsum([len(x) + 1 for x in block]))]


def runs(texts: list[bytes], most: int = 1 << 20):
    """Neighbouring texts of about `most` bytes together; a longer text is a run of its own."""
    run: list[bytes] = []
    size = 0
    for t in texts:
        if run and size + len(t) > most:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def word_spans(block: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of a block of texts, where words begin and end in them, and where each text's words begin (one entry more than
    texts). A byte of white space follows every word."""
    flat = np.frombuffer(b"\n" + b"\n".join(block) + b"\n", np.uint8)
    space = _SPACE[flat]
    begins = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    return flat, begins, ends, np.r_[0, np.searchsorted(begins, np.cumsum([len(x) + 1 for x in block]))]


def span_hashes(flat: np.ndarray, begins: np.ndarray, ends: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """Hashes of words as they stand (letters not lowered), about `most` bytes at a time."""
    out = np.empty(len(begins), np.uint64)
    a = 0
    while a < len(begins):
        lo = int(begins[a])
        b = max(a + 1, int(np.searchsorted(ends, lo + most, "right")))
        part = flat[lo: int(ends[b - 1])]
        up, down = _tables(len(part))
        sums = np.r_[np.uint64(0), np.cumsum(_TABLE[part] * up[: len(part)], dtype=np.uint64)]
        first, last = begins[a:b] - lo, ends[a:b] - lo
        out[a:b] = mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64))
        a = b
    return out
