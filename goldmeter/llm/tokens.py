"""Byte-pair encoding by a tokenization automaton, and decoding by its arc labels.

A merge list is compiled into a deterministic automaton over tokens that accepts exactly the sequences the merges produce. It
starts as one state with a loop on every base symbol. Each merge (u, v) is a gadget: the state that u leads to is copied
without its v arc, u's arcs are led to the copy, and arcs labelled uv lead where v led. A token's arcs all lead to one state, so
a state is named by the token read last and is kept as the arcs its gadgets removed, on top of the state it was copied from.
Tokens are numbered in preorder of the tree "uv hangs below u", later children first: the arcs that one gadget removes (v and
every later token that begins with v) are one interval, and all tables have as many rows as there are merges.

Every prefix of a word has exactly one accepted path, so encoding reads a word left to right and keeps for each position the
last token of that path: the longest token ending here whose arc leaves the state at its start. Candidate tokens come from a
transition table over symbols with failure links. Words of a batch advance in step, each as one lane of numpy arrays.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LATER = np.int64(1) << 40


def _byte_chars() -> dict[str, int]:
    """The printable stand-in character of each byte in byte-level vocabularies: printable Latin-1 bytes stand for themselves,
    the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def token_labels(ids: dict[str, int]) -> dict[int, bytes]:
    """The bytes each token stands for, a word's end mark included; tokens outside the byte alphabet have none."""
    chars = _byte_chars()
    return {i: bytes(chars[c] for c in token) for token, i in ids.items() if token and all(c in chars for c in token)}


def gather(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of `values` that begin at `start` and are `size` long, one after another."""
    ends = np.cumsum(size)
    at = np.repeat(start - (ends - size), size)
    at += np.arange(len(at))
    return values[at]


def cut(ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Ids as little-endian 32-bit integers, `counts` of them at a time."""
    data, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
    return [data[x:y] for x, y in zip([0, *ends], ends)]


class Automaton:
    """Compiled form of a vocabulary: `ids` by token string, `merges` in order; `suffix` marks a word's last symbol."""

    def __init__(self, ids: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        n = max(ids.values()) + 1
        self.size, self.suffix = n, suffix
        self.born, self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        symbols: list[tuple[int, ...]] = [()] * n
        for i, label in token_labels(ids).items():
            last = 256 if suffix and len(label) > len(suffix) and label.endswith(suffix.encode()) else 0
            body = label[: -len(suffix)] if last else label
            symbols[i] = (*body[:-1], body[-1] + last)
        pairs = [(ids[a], ids[b], ids[a + b]) for a, b in merges]
        if len({w for _, _, w in pairs}) != len(pairs):
            raise ValueError("a token is made by two merges")
        for t, (u, v, w) in enumerate(pairs):
            self.born[w], self.left[w], self.right[w] = t, u, v
        self._number(pairs)
        self.alive = np.array([bool(s) for s in symbols])
        self._gadgets(pairs)
        self._transitions(symbols)

    def _number(self, pairs: list[tuple[int, int, int]]) -> None:
        """Preorder places of the tokens, later children first, and the end of each subtree."""
        below: list[list[int]] = [[] for _ in range(self.size)]
        for u, _, w in pairs:
            below[u].append(w)
        self.place, self.end = np.zeros(self.size, np.int64), np.zeros(self.size, np.int64)
        at = 0
        stack = [(i, False) for i in range(self.size) if self.left[i] < 0]
        while stack:
            i, done = stack.pop()
            if done:
                self.end[i] = at
                continue
            self.place[i] = at
            at += 1
            stack.append((i, True))
            stack.extend((w, False) for w in below[i])  # the last pushed, the latest child, is numbered first

    def _gadgets(self, pairs: list[tuple[int, int, int]]) -> None:
        place, end, born, right = self.place.tolist(), self.end.tolist(), self.born.tolist(), self.right.tolist()
        removed: list[list[tuple[int, int, int]]] = [[] for _ in range(self.size)]
        newest = [-1] * self.size

        def barred(u: int, at: int) -> bool:
            limit = LATER
            while u >= 0:
                own = removed[u]
                k = bisect_right(own, (at, LATER, 0)) - 1
                if k >= 0 and at < own[k][1] and own[k][2] < limit:
                    return True
                limit, u = born[u], right[u]
            return False

        for t, (u, v, w) in enumerate(pairs):
            if self.alive[u] and self.alive[v] and not barred(u, place[v]):
                insort(removed[u], (place[v], place[newest[v]] if newest[v] >= 0 else end[v], t))
            else:
                self.alive[w] = False
            newest[u] = w
        flat = [(u * self.size + s, e, t) for u, own in enumerate(removed) for s, e, t in own]
        self.key, self.until, self.when = (np.array(x, np.int64) for x in zip(*flat)) if flat else (np.zeros(0, np.int64),) * 3
        self.key = np.concatenate([[-1], self.key])
        self.until, self.when = np.concatenate([[-1], self.until]), np.concatenate([[LATER], self.when])
        self.first_key = np.array([len(x) for x in removed]) > 0

    def _transitions(self, symbols: list[tuple[int, ...]]) -> None:
        """Table node x symbol -> node, with failure links folded in; per node the longest token that ends there."""
        tokens = [i for i in range(self.size) if self.alive[i]]
        used = sorted({s for i in tokens if len(symbols[i]) > 1 for s in symbols[i]})
        self.column = np.zeros(512, np.int64)  # column 0: symbols that only stand alone
        self.column[used] = np.arange(1, len(used) + 1)
        self.alone = np.full(512, -1, np.int64)
        column = self.column.tolist()
        step: dict[tuple[int, int], int] = {}
        at_node: dict[int, int] = {}
        depth = [0]
        parent, by = [0], [0]
        for i in tokens:
            if len(symbols[i]) == 1:
                self.alone[symbols[i][0]] = i
                if not column[symbols[i][0]]:
                    continue
            node = 0
            for s in symbols[i]:
                k = (node, column[s])
                if k not in step:
                    step[k] = len(depth)
                    depth.append(depth[node] + 1)
                    parent.append(node)
                    by.append(column[s])
                node = step[k]
            at_node[node] = i
        n, wide = len(depth), len(used) + 1
        go = np.zeros((n, wide), np.int32)
        fail = np.zeros(n, np.int64)
        longest = np.full(n, -1, np.int64)
        depth, parent, by = np.array(depth), np.array(parent), np.array(by)
        own = np.full(n, -1, np.int64)
        own[list(at_node)] = list(at_node.values())
        order = np.argsort(depth, kind="stable")
        starts = np.searchsorted(depth[order], np.arange(depth.max() + 2))
        self.shorter = np.full(self.size, -1, np.int64)
        for d in range(depth.max() + 1):
            nodes = order[starts[d]: starts[d + 1]]
            if d > 1:
                fail[nodes] = go[fail[parent[nodes]], by[nodes]]
            if d:
                longest[nodes] = np.where(own[nodes] >= 0, own[nodes], longest[fail[nodes]])
                mine = nodes[own[nodes] >= 0]
                self.shorter[own[mine]] = longest[fail[mine]]
                go[nodes] = go[fail[nodes]]
            kids = order[starts[d + 1]: starts[d + 2]] if d + 2 < len(starts) else order[:0]
            go[parent[kids], by[kids]] = kids
        self.go, self.longest = go, longest
        self.length = np.array([len(s) for s in symbols], np.int64)

    def barred(self, last: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether the state reached by `last` has no arc `token`."""
        out = np.zeros(len(last), bool)
        rows, u, limit, at = np.arange(len(last)), last, np.full(len(last), LATER), self.place[token]
        while len(rows):
            k = np.searchsorted(self.key, u * self.size + at, "right") - 1
            hit = (self.key[k] >= u * self.size) & (at < self.until[k]) & (self.when[k] < limit)
            out[rows[hit]] = True
            go_on = ~hit & (self.right[u] >= 0)
            rows, at, u = rows[go_on], at[go_on], u[go_on]
            limit, u = self.born[u], self.right[u]
        return out

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Token ids of each word as little-endian 32-bit integers (words: non-empty byte strings; the last symbol carries the
        suffix mark if the vocabulary has one)."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ids, counts = self.encode_flat(np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes) - sizes, sizes)
        return cut(ids, counts)

    def encode_flat(self, text: np.ndarray, first: np.ndarray, sizes: np.ndarray, cells: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the words that begin at `first` in the bytes `text`, one word after another, and how many each has."""
        symbols = text.astype(np.int64)
        if self.suffix:
            symbols[first + sizes - 1] += 256
        order = np.argsort(-sizes, kind="stable")
        parts, counts = [np.zeros(0, "<u4")], np.zeros(len(sizes), np.int64)
        a = 0
        while a < len(order):
            lanes = order[a: a + max(1, cells // int(sizes[order[a]]))]
            ids, counts[lanes] = self._lanes(symbols, first[lanes], sizes[lanes])
            parts.append(ids)
            a += len(lanes)
        starts = np.empty(len(order), np.int64)
        starts[order] = np.cumsum(counts[order]) - counts[order]
        return gather(np.concatenate(parts), starts, counts), counts

    def _lanes(self, text: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words given by falling size, one after another, and how many each has."""
        n, wide = len(sizes), int(sizes[0])
        last = np.full((wide + 1, n), -1, np.int32)
        node = np.zeros(n, np.int64)
        for i in range(1, wide + 1):
            k = int(np.searchsorted(-sizes, -i, "right"))  # lanes with that many symbols
            symbol = text[first[:k] + i - 1]
            node = self.go[node[:k], self.column[symbol]].astype(np.int64)
            token = self.longest[node]
            lone = token < 0
            if lone.any():
                token = np.where(lone, self.alone[symbol], token)
            rows = np.arange(k)
            while len(rows):
                start = i - self.length[token]
                at = np.flatnonzero(start > 0)
                bad = at[self.barred(last[start[at], rows[at]].astype(np.int64), token[at])]
                good = np.ones(len(rows), bool)
                good[bad] = False
                last[i, rows[good]] = token[good]
                rows, token = rows[bad], self.shorter[token[bad]]
                if (token < 0).any():
                    raise ValueError("a word has no path: the vocabulary lacks a base symbol")
        at, rows, parts, lanes = sizes.copy(), np.arange(n), [], []
        while len(rows):
            token = last[at, rows]
            parts.append(token)
            lanes.append(rows)
            at = at - self.length[token]
            keep = at > 0
            at, rows = at[keep], rows[keep]
        token, lane = np.concatenate(parts), np.concatenate(lanes)
        back = np.arange(len(token))[::-1]
        sort = back[np.argsort(lane[back], kind="stable")]  # within a lane, the first token was found last
        return token[sort].astype("<u4"), np.bincount(lane, minlength=n)


def _model(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)["model"]


@functools.lru_cache(maxsize=4)
def automaton(path: str) -> Automaton:
    """Compiled once per Python worker from the vocabulary file, which every worker must be able to read."""
    model = _model(path)
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return Automaton(model["vocab"], merges, model.get("end_of_word_suffix") or "")


@functools.lru_cache(maxsize=4)
def added_tokens(path: str) -> dict[str, int]:
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


def _split_pattern():
    import regex

    # fixed value: the pattern by which byte-level vocabularies of this family split a text
    return regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


class _Numbers(dict):
    """Numbers words as they come; `new` are those numbered since it was last emptied."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        n = self[word] = len(self)
        return n


class Memory:
    """Ids of words seen lately: a number for each word, and the ids of all numbered words in one array. `learn` gives the ids of
    new words, one after another, and how many each has. Beyond `limit` words all are forgotten."""

    def __init__(self, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = 450_000):
        self.learn, self.limit = learn, limit
        self._forget()

    def _forget(self) -> None:
        self.known = _Numbers()
        self.ids, self.used = np.zeros(1 << 16, "<u4"), 0
        self.start, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def look_up(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one after another, and how many each has."""
        if len(self.known) > self.limit:
            self._forget()
        before = len(self.known)
        numbers = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        if self.known.new:
            ids, counts = self.learn(self.known.new)
            self.known.new = []
            n = len(self.known)
            self.ids, self.start, self.size = _room(self.ids, self.used + len(ids)), _room(self.start, n), _room(self.size, n)
            self.ids[self.used: self.used + len(ids)] = ids
            self.start[before:n], self.size[before:n] = self.used + np.cumsum(counts) - counts, counts
            self.used += len(ids)
        counts = self.size[numbers]
        return gather(self.ids, self.start[numbers], counts), counts


def _room(x: np.ndarray, n: int) -> np.ndarray:
    if n <= len(x):
        return x
    out = np.zeros(max(n, 2 * len(x)), x.dtype)
    out[: len(x)] = x
    return out


def _blocks(texts: list[str], most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Neighbouring texts of about `most` characters together."""
    a = size = 0
    for i, t in enumerate(texts):
        if i > a and size + len(t) > most:
            yield a, i
            a, size = i, 0
        size += len(t)
    if texts:
        yield a, len(texts)


# Classes of characters in the tables below: the rest are left to the tokenizers' own patterns.
ODD, LETTER, NUMBER, OTHER = range(4)


class _Points:
    """Words as one array of code points: the class of each, where words and pieces begin, and which words need a pattern."""

    def __init__(self, words: list[str], kinds: np.ndarray, lower: np.ndarray | None, numbers_alone: bool):
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        kind = kinds[np.minimum(points, len(kinds) - 1)]
        word = np.repeat(np.arange(len(words)), sizes)
        self.odd = np.bincount(word[kind == ODD], minlength=len(words)) > 0
        self.odd |= sizes == 0
        keep = ~self.odd[word]
        points, kind, word = points[keep], kind[keep], word[keep]
        if lower is not None:
            points = lower[points]
        begins = np.r_[True, (word[1:] != word[:-1]) | (kind[1:] != kind[:-1])][: len(word)]
        if numbers_alone:
            begins |= kind == NUMBER
        self.first_of_word = np.r_[True, word[1:] != word[:-1]][: len(word)]
        self.points, self.word, self.begins = points, word, begins

    def utf8(self) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all characters (below U+0800) and how many each has."""
        wide = self.points >= 0x80
        n = 1 + wide.astype(np.int64)
        end = np.cumsum(n)
        out = np.empty(int(end[-1]) if len(end) else 0, np.uint8)
        out[end - 1] = np.where(wide, 0x80 | (self.points & 0x3F), self.points)
        out[end[wide] - 2] = 0xC0 | (self.points[wide] >> 6)
        return out, n


def _kinds(letter, number, space, top: int, odd: Callable[[str], bool]) -> np.ndarray:
    """Class of each character below `top`; the last entry stands for all above."""
    out = np.full(top + 1, ODD, np.uint8)
    for i in range(top):
        c = chr(i)
        if not (space(c) or odd(c)):
            out[i] = LETTER if letter(c) else NUMBER if number(c) else OTHER
    return out


def _merge(words: int, odd: np.ndarray, plain: tuple[np.ndarray, np.ndarray], rest: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words in order from those of the plain ones and of the odd ones."""
    ids, counts = plain
    all_counts = np.empty(words, np.int64)
    all_counts[~odd], all_counts[odd] = counts, [len(x) // 4 for x in rest]
    starts = np.empty(words, np.int64)
    starts[~odd] = np.cumsum(counts) - counts
    starts[odd] = len(ids) + np.cumsum(all_counts[odd]) - all_counts[odd]
    return gather(np.concatenate([ids, np.frombuffer(b"".join(rest), "<u4")]), starts, all_counts), all_counts


# A lone blank between two characters that are not white space always starts a new piece, so the text may be cut there.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_RARE = ("  ", "\n\n", " \n", "\n ", "\0", "\1")


def _plain_gaps(text: str) -> bool:
    """Whether all white space is lone blanks and line breaks between other characters."""
    if text[0].isspace() or text[-1].isspace() or any(x in text for x in _RARE):
        return False
    return sum(map(len, text.split())) + text.count(" ") + text.count("\n") == len(text)


class ByteEncoder:
    """Encoder for byte-level vocabularies that split by the pattern above; equal to the public tokenizer of the same file.

    A text is looked up by the words between lone blanks and line breaks. A word of the memory is named as it stands if a blank
    is before it, with its line break if that is before it, after a zero byte if nothing is, and after a one byte if it is an
    added token. Words of letters, numbers and signs are cut into pieces by their characters' classes, all others by the pattern.
    """

    def __init__(self, path: str, words: int = 450_000):
        self.path, self.machine, self.pattern = path, automaton(path), _split_pattern()
        self.added = added_tokens(path)
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        import regex

        test = lambda p: lambda c: regex.fullmatch(p, c) is not None
        self.kinds = _kinds(test(r"\p{L}"), test(r"\p{N}"), test(r"\s"), 0x800, lambda c: c == "'" or c.isspace() or not c.isprintable())
        self.memory = Memory(self._learn, words)

    def _learn(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = _Points(names, self.kinds, None, False)
        # the piece at a word's start takes the blank before it
        text, n = plain.utf8()
        lead = plain.first_of_word
        width = n + lead
        end = np.cumsum(width)
        out = np.full(int(end[-1]) if len(end) else 0, 32, np.uint8)
        at = end - n
        out[at] = text[np.cumsum(n) - n]
        out[at[n > 1] + 1] = text[np.cumsum(n)[n > 1] - 1]
        begins = np.flatnonzero(plain.begins)
        first = (end - width)[begins]
        sizes = np.diff(np.r_[first, len(out)])
        ids, counts = self.machine.encode_flat(out, first, sizes)
        per_word = np.bincount(plain.word[begins], counts, len(names)).astype(np.int64)[~plain.odd]
        rest = [names[i] for i in np.flatnonzero(plain.odd)]
        chunks = ["" if x[:1] == "\1" else x[1:] if x[:1] == "\0" else x if x[:1] == "\n" else " " + x for x in rest]
        found = [np.uint32(self.added[x[1:]]).tobytes() if x[:1] == "\1" else y for x, y in zip(rest, self._by_pattern(chunks))]
        return _merge(len(names), plain.odd, (ids, per_word), found)

    def _by_pattern(self, chunks: list[str]) -> list[bytes]:
        pieces = list(map(self.pattern.findall, chunks))
        new = list(set().union(*pieces))
        ids = dict(zip(new, self.machine.encode_words([p.encode("utf-8", "surrogatepass") for p in new])))
        return [b"".join(map(ids.__getitem__, x)) for x in pieces]

    def _names(self, text: str) -> list[str]:
        """The text's words as the memory names them."""
        if not text:
            return []
        if not _plain_gaps(text):
            head, *rest = _CUT.split(text)
            return ["\0" + head, *["\0 " + c for c in rest]]
        words = text.replace("\n", " \n").split(" ")
        words[0] = "\0" + words[0]
        return words

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, one after another, and how many each has."""
        parts, counts = [np.zeros(0, "<u4")], np.zeros(len(texts), np.int64)
        for a, b in _blocks(texts):
            names: list[str] = []
            of: list[int] = []
            for i in range(a, b):
                if self.special is not None and any(t in texts[i] for t in self.added):
                    own = [n for p in self.special.split(texts[i]) for n in (["\1" + p] if p in self.added else self._names(p))]
                else:
                    own = self._names(texts[i])
                names += own
                of.append(len(own))
            ids, sizes = self.memory.look_up(names)
            ends = np.r_[0, np.cumsum(sizes)][np.cumsum(of)]
            counts[a:b] = np.diff(np.r_[0, ends])
            parts.append(ids)
        return np.concatenate(parts), counts

    def encode(self, texts: list[str]) -> list[bytes]:
        return cut(*self.encode_flat(texts))


@functools.lru_cache(maxsize=4)
def byte_encoder(path: str, words: int = 450_000) -> ByteEncoder:
    """Made once per Python worker; `words` is how many words it keeps the ids of."""
    return ByteEncoder(path, words)


def id_lists(ids: list[bytes]) -> pa.Array:
    return flat_lists(np.frombuffer(b"".join(ids), "<i4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4)


def flat_lists(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(ids.view("<i4")))


def portions(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch in which the lists or texts of a column take about `most` bytes; one row at least."""
    values = batch.column(column)
    width = 4 if pa.types.is_list(values.type) else 1
    sizes = pc.fill_null(pc.list_value_length(values) if width == 4 else pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes * width)
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield batch.slice(a, b - a)
        a = b


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids array<int> of every whole text; a null or empty text has no ids. Rows stay apart, repeated ones included; other
    columns are not read. Memory per task: the automaton, the word memory and one Arrow batch."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_encoder(path, 200_000)
        for b in batches:
            for part in portions(b, 1):
                ids = coder.encode_flat(["" if t is None else t for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), flat_lists(*ids)], names=["key", "ids"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


@functools.lru_cache(maxsize=4)
def arc_labels(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Label bytes of all arcs in one buffer, with the start and size of each."""
    by_id = token_labels(_model(path)["vocab"]) | {i: token.encode() for token, i in added_tokens(path).items()}
    labels = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
    sizes = np.array([len(x) for x in labels], np.int64)
    return np.frombuffer(b"".join(labels), np.uint8), np.cumsum(sizes) - sizes, sizes


def emit_labels(path: str, ids: np.ndarray) -> np.ndarray:
    """The labels of a path's arcs, one after another."""
    buffer, start, size = arc_labels(path)
    return gather(buffer, start[ids], size[ids])


def decode(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """All columns of `encoded` and `decoded` string: the emitted labels as UTF-8, bytes that form no character replaced by
    U+FFFD. Null or empty ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in portions(b, b.schema.get_field_index(ids), 2 << 20):
                lists = part.column(part.schema.get_field_index(ids))
                counts = np.asarray(lists.value_lengths().fill_null(0))
                flat = np.asarray(lists.flatten()).astype(np.int64)
                sizes = arc_labels(path)[2][flat]
                ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(counts)]
                data = emit_labels(path, flat).tobytes()
                texts = [data[x:y].decode("utf-8", "replace") for x, y in zip([0, *ends.tolist()], ends.tolist())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{schema}, decoded string")


# Characters whose composed form, lower case and class do not depend on a tokenizer's tables: printable ASCII and Latin letters.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ĮıĲ-ɏ]").fullmatch
_SEPARATORS = "\x1c\x1d\x1e\x1f"


class WordEncoder:
    """Encoder for the lower-case word vocabulary with word ends; equal to the public tokenizer of the same file.

    White space is dropped by that tokenizer and no piece spans it, so a text is the sum of its words. Words of plain characters
    go through the automaton; any other word, and texts with control separators, go to the tokenizer itself.
    """

    def __init__(self, path: str):
        import os

        import regex

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.machine, self.library = automaton(path), Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        # pieces of this vocabulary: short forms after an apostrophe, letters, single numbers, other signs
        test = lambda p: lambda c: regex.fullmatch(p, c) is not None
        self.kinds = _kinds(test(r"\p{L}"), test(r"\p{N}"), test(r"\s"), 0x250, lambda c: c in "'<" or not _PLAIN(c) or ord(c.lower()) >= 0x800)
        self.lower = np.array([ord(chr(i).lower()) if self.kinds[i] else i for i in range(0x250)], np.uint32)
        self.memory = Memory(self._learn)

    def _public(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = _Points(words, self.kinds, self.lower, True)
        text, n = plain.utf8()
        begins = np.flatnonzero(plain.begins)
        first = (np.cumsum(n) - n)[begins]
        ids, counts = self.machine.encode_flat(text, first, np.diff(np.r_[first, len(text)]))
        per_word = np.bincount(plain.word[begins], counts, len(words)).astype(np.int64)[~plain.odd]
        return _merge(len(words), plain.odd, (ids, per_word), self._public([words[i] for i in np.flatnonzero(plain.odd)]))

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for a, b in _blocks(texts):
            odd = [any(c in t for c in _SEPARATORS) for t in texts[a:b]]
            words = [[] if x else t.split() for x, t in zip(odd, texts[a:b])]
            ids, sizes = self.memory.look_up(list(itertools.chain.from_iterable(words)))
            ends = np.r_[0, np.cumsum(sizes)][np.cumsum([len(own) for own in words])]
            found = cut(ids, np.diff(np.r_[0, ends]))
            out += [self._public([t])[0] if x else ids for x, t, ids in zip(odd, texts[a:b], found)]
        return out


@functools.lru_cache(maxsize=4)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)
