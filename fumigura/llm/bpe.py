"""Problem 8: exact byte-pair encoding of a corpus in linear time.

Backtracking encoder: from each place the longest token that matches is tried,
then its prefixes that are tokens; a token is kept if the pair it forms with
the token before is compatible, that is if the merges of the vocabulary would
leave the boundary between the two. A sequence of compatible pairs is the
encoding. Longest matches come from the vocabulary's automaton, kept as a
double array; a match must begin where the token before ended, so that no failure
link is ever followed. All stretches of a batch advance side by side in numpy.

Decoding copies the bytes of the tokens from one block by an offset table.

Empty and null texts have no ids: an empty list.
"""

from __future__ import annotations

import base64
import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fumigura.llm.common import codes, column, expand, mix64, spread

#: Folder of the public vocabularies, on the driver; the file of one (about 1 MB) is broadcast.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
#: Characters encoded at once.
SLICE = 400_000

_OTHER, _LETTER, _NUMBER, _SPACE = 0, 1, 2, 3
# Characters of the property White_Space.
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def _classes() -> np.ndarray:
    kinds = {"L": _LETTER, "N": _NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], _OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    out[_WHITE] = _SPACE
    return out


def stretches(a: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Where the stretches start that merges never cross: words, numbers and other signs with one space before, white space, and English endings."""
    n = len(a)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes()[a]
    first = np.zeros(n + 1, bool)
    first[np.concatenate([[0], np.cumsum(lengths)])] = True  # of a text; holds n too
    start = first[:-1].copy()
    start[1:] |= kind[1:] != kind[:-1]
    ends_text = first[1:]
    white = kind == _SPACE
    # the last of several white spaces before something else stands alone or goes with it
    last_white = white & ~ends_text
    last_white[:-1] &= ~white[1:]
    start |= last_white
    lead = last_white & (a == 0x20)
    start[1:][lead[:-1]] = False
    # 's 't 're 've 'm 'll 'd where a stretch begins with the apostrophe
    at = np.flatnonzero(start[: n - 1] & (a[: n - 1] == 0x27) & ~ends_text[: n - 1])
    if len(at):
        one = a[at + 1]
        far = np.minimum(at + 2, n - 1)
        two = np.where((at + 2 < n) & ~first[far], a[far], 0)
        short = np.isin(one, [ord(x) for x in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        start[at[short | long] + 1] = False
        nxt = np.concatenate([at[short] + 2, at[long] + 3])
        nxt = nxt[nxt < n]
        # what follows the ending begins anew, unless it is a space's own stretch already
        start[nxt] |= True
    return np.flatnonzero(start)


class Vocabulary:
    """Tables of one vocabulary: token bytes, automaton, prefixes, and the merges behind each token."""

    def __init__(self, lines: bytes) -> None:
        ranks = {base64.b64decode(x): int(y) for x, y in (line.split() for line in lines.splitlines() if line.strip())}
        tokens = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            tokens[r] = t
        self.ranks, self.length = ranks, np.array([len(t) for t in tokens], np.int32)
        self.offset = np.concatenate([[0], np.cumsum(self.length)]).astype(np.int64)
        self.block = np.frombuffer(b"".join(tokens), np.uint8)
        self._split(tokens)
        self._automaton(tokens)
        self.known = np.full(1 << 20, -1, np.int64)
        self.fits = np.zeros(1 << 20, bool)

    def _split(self, tokens: list[bytes]) -> None:
        """The two tokens whose merge made each token; itself twice for a byte."""
        n = len(tokens)
        self.left, self.right = np.arange(n, dtype=np.int32), np.arange(n, dtype=np.int32)
        pairs = []
        for r, t in enumerate(tokens):
            if len(t) > 1:
                parts = [t[i : i + 1] for i in range(len(t))]
                while len(parts) > 2:  # the merges of earlier rank, in order
                    best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], n) if self.ranks.get(parts[i] + parts[i + 1], n) < r else n)
                    parts[best : best + 2] = [parts[best] + parts[best + 1]]
                self.left[r], self.right[r] = self.ranks[parts[0]], self.ranks[parts[1]]
                pairs.append((int(self.left[r]) * n + int(self.right[r]), r))
        pairs.sort()
        self.pair_key, self.pair_id = (np.array(x, np.int64) for x in zip(*pairs, strict=True))

    def _automaton(self, tokens: list[bytes]) -> None:
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        self.prefix = np.full(len(tokens), -1, np.int32)
        for r in sorted(range(len(tokens)), key=lambda r: len(tokens[r])):
            node, longest = 0, -1
            for b in tokens[r]:
                longest = ends[node] if ends[node] >= 0 else longest
                nxt = children[node].get(b)
                if nxt is None:
                    nxt = children[node][b] = len(children)
                    children.append({})
                    ends.append(-1)
                node = nxt
            if tokens[r]:
                ends[node], self.prefix[r] = r, longest
        size = len(children) + 4096
        base, check, place, row = np.zeros(size * 2, np.int32), np.full(size * 2, -1, np.int32), [0] * len(children), [0] * len(children)
        free = np.ones(size * 2, bool)
        free[:257] = False  # the root stands at 0, its children from 1
        scan = 257
        for node in sorted(range(len(children)), key=lambda k: (k != 0, -len(children[k]))):
            kids = sorted(children[node])
            if not kids:
                continue
            if node == 0:
                at = 1
            elif len(kids) == 1:
                while not free[scan]:
                    scan += 1
                at = scan - kids[0]
            else:
                k = np.array(kids)
                lo = max(scan, 257)
                while True:
                    slots = np.flatnonzero(free[lo : lo + 4096]) + lo - kids[0]
                    ok = slots[free[slots[:, None] + k[None, :]].all(1)] if len(slots) else slots
                    if len(ok):
                        at = int(ok[0])
                        break
                    lo += 4096
            row[node] = at
            free[[at + b for b in kids]] = False
        for node, kids in enumerate(children):  # parents come before their children
            for b, child in kids.items():
                place[child] = row[node] + b
                check[row[node] + b] = place[node]
            base[place[node]] = row[node]
        self.base, self.check = base, check
        self.ends = np.full(len(base), -1, np.int32)
        for node, r in enumerate(ends):
            if node and r >= 0:
                self.ends[place[node]] = r

    def longest(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The longest token at each place; data ends in zeros that no stretch reaches."""
        out = np.full(len(at), -1, np.int32)
        live, node, pos = np.arange(len(at)), np.zeros(len(at), np.int32), at
        while len(live):
            nxt = self.base[node] + data[pos]
            ok = self.check[nxt] == node
            ok &= self.base[node] != 0
            live, node, pos = live[ok], nxt[ok], pos[ok] + 1
            r = self.ends[node]
            hit = r >= 0
            out[live[hit]] = r[hit]
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the merges leave the boundary between the tokens of each pair; remembered by pair."""
        n = len(self.length)
        key = a.astype(np.int64) * n + b
        slot = (mix64(key.astype(np.uint64)) >> np.uint64(44)).astype(np.int64)
        out = self.fits[slot]
        new = np.flatnonzero(self.known[slot] != key)
        if len(new):
            keys, back = np.unique(key[new], return_inverse=True)
            ok = self._leaves(keys // n, keys % n)
            out[new] = ok[back]
            s = (mix64(keys.astype(np.uint64)) >> np.uint64(44)).astype(np.int64)
            self.fits[s] = ok
            self.known[s] = keys
            clash = self.known[s] != keys  # two keys of one slot: the last has it, with its own answer
            s, ok, keys = s[~clash], ok[~clash], keys[~clash]
            self.fits[s] = ok
        return out

    def _leaves(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = len(self.length)
        out = np.ones(len(a), bool)
        live, limit = np.arange(len(a)), np.full(len(a), np.iinfo(np.int64).max)
        a, b = a.astype(np.int64), b.astype(np.int64)
        while len(live):
            key = a * n + b
            at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
            merged = (self.pair_key[at] == key) & (self.pair_id[at] < limit)
            out[live[merged]] = False
            keep = ~merged
            live, limit, a, b = live[keep], limit[keep], a[keep], b[keep]
            # undo the later of the two merges; a byte can't be undone, then the other's turn
            right, left = self.right[a].astype(np.int64), self.left[b].astype(np.int64)
            byte_a, byte_b = right == a, left == b
            undo_a = ((a > b) & ~byte_a) | ((a <= b) & byte_b & ~byte_a)
            undo_b = ~undo_a & ~byte_b
            limit = np.where(undo_a, a, np.where(undo_b, b + 1, limit))
            a, b = np.where(undo_a, right, a), np.where(undo_b, left, b)
            more = undo_a | undo_b
            live, limit, a, b = live[more], limit[more], a[more], b[more]
        return out

    def encode_stretches(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of all tokens in ``data`` (padded), and the tokens."""
        after = np.full(len(data) + 1, -1, np.int32)  # the token that ends before each place
        fresh = np.ones(len(data) + 1, bool)  # places not yet found to lead nowhere
        start, pos, stop = begin.astype(np.int64), begin.astype(np.int64), end.astype(np.int64)
        cur = self.longest(data, pos)
        while len(pos):
            to = pos + self.length[cur]
            ok = (to <= stop) & fresh[np.minimum(to, len(data))]
            inner = np.flatnonzero(ok & (pos > start))
            ok[inner] = self.compatible(after[pos[inner]], cur[inner])
            good = np.flatnonzero(ok)
            after[to[good]] = cur[good]
            pos[good] = to[good]
            bad = np.flatnonzero(~ok)
            if len(bad):
                shorter = self.prefix[cur[bad]]
                back = bad[shorter < 0]
                cur[bad] = shorter
                if len(back):  # no token leads on from here
                    fresh[pos[back]] = False
                    last = after[pos[back]]
                    pos[back] -= self.length[last]
                    cur[back] = last
            going = pos < stop
            step = good[going[good]]
            cur[step] = self.longest(data, pos[step])
            if not going.all():
                start, pos, stop, cur = start[going], pos[going], stop[going], cur[going]
        return self._walk_back(after, begin, end)

    def _walk_back(self, after: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Follow the tokens of each stretch from its end: places that were tried and left are not met."""
        keep = np.zeros(len(after), bool)
        pos, floor = end.astype(np.int64), begin.astype(np.int64)
        while len(pos):
            keep[pos] = True
            pos = pos - self.length[after[pos]]
            on = pos > floor
            pos, floor = pos[on], floor[on]
        at = np.flatnonzero(keep)
        return at, after[at]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and how many each text has."""
        a, n = codes(texts)
        width = np.where(a < 0x80, 1, np.where(a < 0x800, 2, np.where(a < 0x10000, 3, 4)))
        data = np.concatenate([np.frombuffer("".join(texts).encode("utf-8"), np.uint8), np.zeros(64, np.uint8)])
        byte = np.concatenate([[0], np.cumsum(width)])
        begin = byte[stretches(a, n)]
        end = np.concatenate([begin[1:], byte[-1:]]) if len(begin) else begin
        at, ids = self.encode_stretches(data, begin, end) if len(begin) else (np.zeros(0, np.int64), np.zeros(0, np.int32))
        limits = byte[np.cumsum(n)]
        counts = np.diff(np.concatenate([[0], np.searchsorted(at, limits, "right")]))
        return ids, counts

    def decode(self, ids: np.ndarray) -> bytes:
        ids = np.asarray(ids, np.int64)
        return self.block[expand(self.offset[ids], self.length[ids].astype(np.int64))].tobytes()


def _file(name: str, folder: str) -> bytes:
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        return f.read()


@lru_cache(4)
def _loaded(lines: bytes) -> Vocabulary:
    return Vocabulary(lines)


def vocabulary(name: str = VOCABULARY, folder: str = TOKENIZERS) -> Vocabulary:
    return _loaded(_file(name, folder))


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    s, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > SLICE:
            yield s, i
            s, size = i, 0
        size += len(t)
    yield s, len(texts)


def _encode(lines: Broadcast, key: str, only_counts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _loaded(lines.value)
        for batch in batches:
            texts = [t or "" for t in column(batch, "text").to_pylist()]
            for s, e in _slices(texts):
                ids, counts = v.encode(texts[s:e])
                keys = column(batch, key).slice(s, e - s)
                if only_counts:
                    value = pa.array(counts.astype(np.int32))
                else:
                    value = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([keys, value], names=[key, "tokens" if only_counts else "ids"])

    return run


def encode_corpus(df: DataFrame, key: str = "doc_id", name: str = VOCABULARY, folder: str = TOKENIZERS) -> DataFrame:
    """(key, ids array<int>) of (key, text), without special tokens, whose strings count as plain text."""
    kind = df.schema[key].dataType.simpleString()
    return spread(df.select(key, "text")).mapInArrow(_encode(df.sparkSession.sparkContext.broadcast(_file(name, folder)), key, False), f"{key} {kind}, ids array<int>")


def token_counts(df: DataFrame, key: str = "doc_id", name: str = VOCABULARY, folder: str = TOKENIZERS) -> DataFrame:
    """(key, tokens int) of (key, text)."""
    kind = df.schema[key].dataType.simpleString()
    return spread(df.select(key, "text")).mapInArrow(_encode(df.sparkSession.sparkContext.broadcast(_file(name, folder)), key, True), f"{key} {kind}, tokens int")


def decode_corpus(df: DataFrame, key: str = "doc_id", name: str = VOCABULARY, folder: str = TOKENIZERS) -> DataFrame:
    """(key, text) of (key, ids); sequences that are no whole UTF-8 give replacement characters, null gives null."""

    lines = df.sparkSession.sparkContext.broadcast(_file(name, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _loaded(lines.value)
        for batch in batches:
            texts = [None if x is None else v.decode(x).decode("utf-8", "replace") for x in column(batch, "ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, key), pa.array(texts, pa.string())], names=[key, "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col("ids")).mapInArrow(run, f"{key} {kind}, text string")
