"""Problem 10: text garbled by a wrong decoding, found and restored.

A record's latent state is the chain of wrong decodings it went through, or
none. A language model of the corpus (in how many distinct texts each pair of
neighbouring characters occurs, in a sketch of fixed size, without the passages
that show by their form alone that they are garbled) tells how much likelier a
passage becomes when a chain is undone. Steps that don't show by form and are
common in the corpus are tried on every text, rare pairs or not. Expectation-maximisation
pools this evidence: each source has its own shares of the chains, drawn to the
shares of the whole corpus, and each record's posterior follows from the shares
of its source and its own evidence; records whose posterior is for a chain come
out, repaired by the likeliest one.

A chain is one or several steps "right>wrong": bytes written in the first
encoding and read in the second. ``lost`` stands for bytes that a decoder
replaced and nothing restores; a record may have it besides a chain.

Null and empty texts are sound. Very long texts are worked on whole.
"""

from __future__ import annotations

import codecs as encodings
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fumigura.llm.common import codes, column, distinct_spread, expand, materialize, spread

SLOT_BITS = 20
#: Characters counted at once.
SLICE = 500_000
#: Pairs of a long window and their mean log share under which it is looked at closely; the same for the pairs around a single run.
LONG, LONG_RARE, SHORT_RARE = 6, -6.3, -4.6
#: Records of a pair up to which it is rare in any corpus.
FEW = 5
#: Least gain of a passage in log units.
LEAST_GAIN = 6.0
#: Records' worth of the whole corpus's shares that each source starts from, and the change of a share from which on rounds go on.
PRIOR, SETTLED = 20.0, 1e-3
#: Share of the distinct texts from which a step is tried on every text: well under the share at which its pairs are no longer rare.
COMMON = 0.003
#: Characters of a passage that shows by its form, and sequences of UTF-8 in a text whose other letters are ASCII.
FORMAL, SEQUENCES = 12, 3
#: Evidence of one replacement character.
LOST_EVIDENCE = 6.0


# --- language model ---------------------------------------------------------


_PAIR, _SPREAD, _TOP = np.uint64(21), np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - SLOT_BITS)


def _slots(a: np.ndarray) -> np.ndarray:
    """Slot of the pair that begins at each character but the last."""
    c = a.astype(np.uint64)
    h = c[:-1] << _PAIR
    h += c[1:]
    h *= _SPREAD
    h >>= _TOP
    return h.view(np.int64)


def _framed(texts: list[str]) -> list[str]:
    return ["\n" + t + "\n" for t in texts]


def _groups(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Of about ``SLICE`` characters each."""
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t or "")
        if size > SLICE:
            yield group
            group, size = [], 0
    if group:
        yield group


def _count(batches: Iterator[pa.RecordBatch], clean=lambda t: t) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(1 << SLOT_BITS, np.int64), 0

    def add(texts: list[str]) -> None:
        a, lengths = codes(_framed(texts))
        owner = np.repeat(np.arange(len(texts)), lengths)
        s = _slots(a)
        inside = owner[1:] == owner[:-1]
        key = np.sort(owner[:-1][inside] << SLOT_BITS | s[inside])
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
        np.add(total, np.bincount(key & ((1 << SLOT_BITS) - 1), minlength=len(total)), out=total)

    for batch in batches:
        for group in _groups(column(batch, "text").to_pylist()):
            kept = [t for t in map(clean, without_formal(group)) if t]
            n += len(kept)
            if kept:
                add(kept)
    at = np.flatnonzero(total)
    for s in range(0, len(at), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(at[s : s + 100_000].astype(np.int32)), pa.array(total[at[s : s + 100_000]])], names=["slot", "n"])
    yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([n], pa.int64())], names=["slot", "n"])


def _count_undone(shared, common: frozenset[str]):
    """As _count, of the texts after the common steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(np.frombuffer(shared.value, np.float32), common)

        def clean(t: str | None) -> str | None:
            for step in sorted(common) if t else ():
                t = undo(Text(t, score), step)[0]
            return t

        yield from _count(batches, clean)

    return run


def pair_model(df: DataFrame, count=_count) -> np.ndarray:
    """Natural logarithm of the share of the texts, each given once, with each pair of characters."""
    got = spread(df).mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # at most 2^20 + 1 rows
    counts = np.zeros(1 << SLOT_BITS)
    slot, n = got["slot"].to_numpy(), got["n"].to_numpy()
    counts[slot[slot >= 0]] = n[slot >= 0]
    records = max(1, int(n[slot < 0].sum()))
    return np.log((counts + 0.1) / (records + 1)).astype(np.float32)


class Scorer:
    def __init__(self, model: np.ndarray, common: frozenset[str] = frozenset()) -> None:
        self.model = model
        self.common = common  # steps tried whether pairs are rare or not
        self.memo: dict[str, float] = {}
        self.western: dict[str, list[str]] = {}  # what may help a stretch
        # a pair of a few records is rare however few records there are
        few = float(model.min()) + np.log(FEW / 0.1)
        self.long_rare, self.short_rare = max(LONG_RARE, few), max(SHORT_RARE, few)

    def logs(self, text: str) -> np.ndarray:
        a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return self.model[_slots(a)]

    def total(self, text: str) -> float:
        """Log share of all pairs; short texts, which come again and again, are remembered."""
        if len(text) > 8:
            return float(self.logs(text).sum())
        got = self.memo.get(text)
        if got is None:
            if len(self.memo) > 200_000:
                self.memo.clear()
            got = self.memo[text] = float(self.logs(text).sum())
        return got


class Text:
    """A text with the stretches that steps look at, each found once."""

    def __init__(self, text: str, score: Scorer, only: dict[str, set[int]] | None = None) -> None:
        self.text, self.score, self._high, self._raw, self._upper = text, score, {}, {}, {}
        self.only = only or {}  # by step where the passages begin that it may help, where that is known
        self.run = np.concatenate([[0.0], np.cumsum(score.logs("\n" + text + "\n"), dtype=np.float64)])
        self._wide: list[tuple[int, int]] | None = None
        self._mid: list[tuple[int, int]] | None = None

    def pairs(self, start: int, end: int) -> float:
        """Log share of the pairs that touch [start, end)."""
        return self.run[end + 1] - self.run[start]

    def gain(self, start: int, end: int, new: str, on_average: bool) -> float:
        """How much likelier the passage becomes; ``on_average``: only if its pairs are likelier on average too."""
        before, after = self.text[start - 1 : start] or "\n", self.text[end : end + 1] or "\n"
        total, was = self.score.total(before + new + after), self.pairs(start, end)
        return total - was if not on_average or total / (len(new) + 1) > was / (end - start + 1) + 0.5 else 0.0

    def high(self, codec: str) -> list[tuple[int, int]]:
        if codec not in self._high:
            self._high[codec] = [m.span() for m in _high_run(codec).finditer(self.text)]
        return self._high[codec]

    def wide(self) -> list[tuple[int, int]]:
        """Runs beyond ASCII that hold a long window of rare pairs, or begin within a Latin word."""
        if self._wide is None:
            rare = (self.run[LONG:] - self.run[:-LONG]) / LONG < self.score.long_rare
            self._wide = []
            for m in _WIDE_RUN.finditer(self.text):
                s, e = m.span()
                if rare[max(0, s - 1) : max(s, e + 2 - LONG)].any() or _HALF_IN_WORD.search(self.text, max(0, s - 1), e):
                    self._wide.append((s, e))
        return self._wide

    def encoded(self, codec: str, common: bool = False) -> list[tuple[int, int, bytes]]:
        """What the encoding has of the wide runs (``common``: of all runs): start, end, bytes."""
        if (codec, common) not in self._raw:
            runs = [m.span() for m in _WIDE_RUN.finditer(self.text)] if common else self.wide()
            self._raw[codec, common] = [(s + x, s + y, raw) for s, e in runs for x, y, raw in _encodable(self.text[s:e], codec)]
        return self._raw[codec, common]

    def upper(self, step: str) -> list[tuple[int, int, bytes]]:
        """The middle runs (of a common step not only those of rare pairs) that a single-byte encoding has, where the step may help: start, end, bytes."""
        codec, only, known = step.split(">")[1], self.only.get(step), self._upper
        to, out = _to_byte(codec), []
        for s, e in [m.span() for m in _MIDDLE.finditer(self.text)] if step in self.score.common else self.mid():
            if only is None or s in only:
                if (codec, s) not in known:
                    raw = [to.get(ord(c)) for c in self.text[s:e]]
                    known[codec, s] = None if None in raw else bytes(raw)
                if known[codec, s] is not None:
                    out.append((s, e, known[codec, s]))
        return out

    def mid(self) -> list[tuple[int, int]]:
        """Runs of signs and letters beyond ASCII, but not of East Asia, whose pairs are rare."""
        if self._mid is None:
            self._mid = [m.span() for m in _MIDDLE.finditer(self.text) if self.pairs(*m.span()) < self.score.short_rare * (m.end() - m.start() + 1)]
        return self._mid


_WIDE_RUN = re.compile("[^\x00-\x7f\ufffd]+")
_MIDDLE_ONE = re.compile("[\x80-\u2dff\uf8ff\ufb01\ufb02]")
_MIDDLE = re.compile("[\x80-\u2dff\uf8ff\ufb01\ufb02]+")
_HALF_IN_WORD = re.compile("[A-Za-zÀ-ÿ][\uff61-\uff9f]")


def suspicious(texts: list[str], score: Scorer) -> np.ndarray:
    """Texts with a long window of rare pairs, a short one around a letter or sign that is neither ASCII nor East Asian, a control, or a replacement character."""
    a, n = codes(_framed(texts))
    owner = np.repeat(np.arange(len(texts)), n)
    run = np.concatenate([[0.0], np.cumsum(score.model[_slots(a)], dtype=np.float64)])
    out = np.zeros(len(texts), bool)

    def mark(at: np.ndarray, span: int) -> None:
        at = at[(at >= 0) & (at + span < len(a))]
        out[owner[at[owner[at] == owner[at + span]]]] = True

    mark(np.flatnonzero((run[LONG:] - run[:-LONG]) / LONG < score.long_rare), LONG)
    dash = (a == 0x2026) | (a == 0x2015) | (a == 0x2014)
    odd = ((a >= 0x80) & (a < 0x2E00)) | ((a >= 0xFF61) & (a < 0xFFA0)) | (a == 0xF8FF) | (a == 0xFB01) | (a == 0xFB02)
    odd &= ~dash
    at = np.flatnonzero(odd)
    at = at[(at > 0) & (at + 1 < len(a))]
    mark(at[(run[at + 1] - run[at - 1]) / 2 < score.short_rare] - 1, 2)
    out[owner[((a >= 0x80) & (a < 0xA0)) | (a == 0xFFFD) | (a == 0x1B)]] = True
    shifts = np.flatnonzero((a[:-1] == 0x24) & ((a[1:] == 0x42) | (a[1:] == 0x40)))
    out[owner[shifts]] = True
    return out


# --- chains -----------------------------------------------------------------

# Single-byte encodings that texts are wrongly read in, and multi-byte ones.
SINGLE = ("cp1252", "cp1251", "cp866", "cp437", "cp850", "mac_roman", "koi8_r", "cp874")
MULTI = ("cp932", "gb18030", "cp949", "big5", "euc_jp")
LEGACY = ("cp932", "euc_jp", "cp949", "gb18030", "big5", "cp874")
WESTERN = ("cp1252", "mac_roman", "cp437")

Passage = tuple[int, int, str]


@lru_cache(None)
def _to_byte(codec: str) -> dict[int, int]:
    """Code point -> byte of the upper half; what the codec leaves open stands for itself."""
    out: dict[int, int] = {}
    for b in range(0x80, 0x100):
        try:
            out[ord(bytes([b]).decode(codec))] = b
        except UnicodeDecodeError:
            out[b] = b
    if codec == "cp1252":
        for b in range(0x80, 0xA0):
            out.setdefault(b, b)
    return out


def _class(codec: str, lo: int, hi: int) -> str:
    return "".join(re.escape(chr(c)) for c, b in _to_byte(codec).items() if lo <= b < hi)


@lru_cache(None)
def _utf8_pattern(codec: str) -> re.Pattern:
    cont = f"[{_class(codec, 0x80, 0xC0)} ]" if codec == "cp1252" else f"[{_class(codec, 0x80, 0xC0)}]"
    two, three, four = (f"[{_class(codec, *r)}]" for r in ((0xC2, 0xE0), (0xE0, 0xF0), (0xF0, 0xF5)))
    return re.compile(f"(?:{two}{cont}|{three}{cont}{{2}}|{four}{cont}{{3}})+")


@lru_cache(None)
def _high_run(codec: str) -> re.Pattern:
    high = _class(codec, 0x80, 0x100)
    return re.compile(f"[{high}](?:[{high}]|[@-~](?=[{high}@-~])){{2,}}")


@lru_cache(None)
def _any_high(codec: str) -> re.Pattern:
    return re.compile(f"[{_class(codec, 0x80, 0x100)}]")


@lru_cache(None)
def _byte_table(codec: str) -> dict[int, int]:
    return _to_byte(codec) | {0x20: 0xA0}


def _bytes(text: str, codec: str) -> bytes:
    """Bytes of a stretch of the codec's own characters and ASCII; a space stands for the unbreakable one it was made of."""
    return text.translate(_byte_table(codec)).encode("latin-1", "replace")


def utf8_read_as(t: Text, codec: str) -> Iterator[Passage]:
    """UTF-8 read in a single-byte encoding."""
    for m in _utf8_pattern(codec).finditer(t.text):
        try:
            yield m.start(), m.end(), _bytes(m.group(), codec).decode("utf-8")
        except UnicodeDecodeError:
            continue


_NEARLY_UTF8 = re.compile(rb"(?:(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})[\x80-\xbf\xef]{0,2})+")


encodings.register_error("fumigura-gap", lambda e: (b"\0" * (e.end - e.start), e.end))
_STRETCH = re.compile(rb"\0+|[^\0]+")


@lru_cache(None)
def _written(codec: str) -> list[bytes]:
    """By code point up to 0x10000, which stands for all above: what the multi-byte encoding writes, nothing for what it lacks."""
    planes = "\n".join("" if 0xD800 <= c < 0xE000 or c == 10 else chr(c) for c in range(1 << 16))
    out = [*planes.encode(codec, "ignore").split(b"\n"), "𠮷".encode(codec, "ignore")]
    out[10] = b"\n"
    return out


@lru_cache(None)
def _widths(codec: str) -> np.ndarray:
    """By code point as in ``_written``: bytes of it."""
    return np.fromiter(map(len, _written(codec)), np.int64, (1 << 16) + 1)


def _encodable(run: str, codec: str) -> Iterator[tuple[int, int, bytes]]:
    at = 0
    try:
        yield 0, len(run), run.encode(codec)
        return
    except UnicodeEncodeError:
        pass
    for m in _STRETCH.finditer(run.encode(codec, "fumigura-gap")):
        raw = m.group()
        n = len(raw.decode(codec, "replace")) if raw[0] else len(raw)
        if raw[0]:
            yield at, at + n, raw
        at += n


def utf8_read_as_wide(t: Text, codec: str) -> Iterator[Passage]:
    """UTF-8 read in a multi-byte encoding: stretches that are whole UTF-8 again but for single lost bytes."""
    only = t.only.get(f"utf8>{codec}")
    order = sorted(only) if only is not None else []
    for start, end, raw in t.encoded(codec):
        if only is not None and bisect_left(order, start) == bisect_left(order, end):
            continue
        at: list[int] = []  # first byte of each character
        for m in _NEARLY_UTF8.finditer(raw):
            at = at or np.cumsum(np.concatenate([[0], _widths(codec)[np.minimum(codes([t.text[start:end]])[0], 1 << 16)]])).tolist()
            x, y = bisect_left(at, m.start()), bisect_right(at, m.end()) - 1  # a character cut in two belongs to neither side
            if y > x and (only is None or start + x in only):
                yield start + x, start + y, raw[at[x] : at[y]].decode("utf-8", "ignore")


def legacy_read_as_single(t: Text, right: str, codec: str) -> Iterator[Passage]:
    """A multi-byte encoding read in a single-byte one."""
    only = t.only.get(f"{right}>{codec}")
    for s, e in t.high(codec):
        if only is not None and s not in only:
            continue
        new = _bytes(t.text[s:e], codec).decode(right, "replace")
        if new.endswith("�") and "@" <= t.text[e : e + 1] <= "~":  # the second byte of the last character looks like a letter
            longer = _bytes(t.text[s : e + 1], codec).decode(right, "replace")
            if not longer.endswith("�"):
                new, e = longer, e + 1
        if "�" not in new[:-1] and len(new) > 1:
            yield s, e, new.rstrip("�")


def legacy_read_as_wide(t: Text, right: str, codec: str) -> Iterator[Passage]:
    """One multi-byte encoding read in another."""
    only = t.only.get(f"{right}>{codec}")
    for s, e, raw in t.encoded(codec, f"{right}>{codec}" in t.score.common):
        if len(raw) >= 6 and (only is None or s in only):
            new = raw.decode(right, "replace")
            if new.count("�") <= len(new) // 20:
                yield s, e, new.replace("�", "")


def western_read_as(t: Text, right: str, codec: str) -> Iterator[Passage]:
    """One single-byte encoding read in another: each run of upper characters by itself."""
    for s, e, raw in t.upper(f"{right}>{codec}"):
        new = raw.decode(right, "replace")
        if new != t.text[s:e] and "�" not in new:
            yield s, e, new


_SHIFTED = re.compile(r"(?:\x1b)?\$[@B]((?:[!-~]{2})+?)(?:\x1b)?\([BJ]|(?:\x1b)?\$[@B]((?:[!-~]{2}){4,})")


def shifts_shown(t: Text) -> Iterator[Passage]:
    """ISO-2022-JP whose shifts were not obeyed."""
    for m in _SHIFTED.finditer(t.text):
        try:
            yield m.start(), m.end(), (b"\x1b$B" + (m.group(1) or m.group(2)).encode() + b"\x1b(B").decode("iso2022_jp")
        except UnicodeDecodeError:
            continue


def steps() -> dict[str, object]:
    """All single steps by name."""
    out: dict[str, object] = {}
    for c in SINGLE:
        out[f"utf8>{c}"] = lambda t, c=c: utf8_read_as(t, c)
    for c in MULTI:
        out[f"utf8>{c}"] = lambda t, c=c: utf8_read_as_wide(t, c)
    for r in LEGACY:
        for c in ("cp1252", "mac_roman", "cp437"):
            out[f"{r}>{c}"] = lambda t, r=r, c=c: legacy_read_as_single(t, r, c)
        for c in MULTI:
            if c != r:
                out[f"{r}>{c}"] = lambda t, r=r, c=c: legacy_read_as_wide(t, r, c)
    for r in WESTERN:
        for c in (*WESTERN, "cp850", "cp1251", "koi8_r"):
            if c != r:
                out[f"{r}>{c}"] = lambda t, r=r, c=c: western_read_as(t, r, c)
    out["iso2022_jp>ascii"] = shifts_shown
    return out


_STEPS = steps()
#: Steps that don't show by form: of two multi-byte or two single-byte encodings.
FORMLESS = frozenset(s for s in _STEPS if (r := s.split(">"))[0] != "utf8" and (r[1] in MULTI or r[0] in WESTERN))


# --- passages that show by form ---------------------------------------------


@lru_cache(None)
def _form_tables() -> tuple[np.ndarray, ...]:
    """By code point up to 0x10000 in which of ``SINGLE`` (a bit each) it leads two bytes of UTF-8, leads more, follows."""
    two, more, follows = out = tuple(np.zeros((1 << 16) + 1, np.uint8) for _ in range(3))
    for k, codec in enumerate(SINGLE):
        for c, b in (_byte_table if codec == "cp1252" else _to_byte)(codec).items():
            for table, lo, hi in ((two, 0xC2, 0xE0), (more, 0xE0, 0xF5), (follows, 0x80, 0xC0)):
                table[c] |= (lo <= b < hi) << k
    return out


def _read_utf8(low: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """By framed text the ``SINGLE`` that may have read UTF-8 in it: a bit each."""
    two, more, follows = _form_tables()
    then = follows[low]
    pairs = np.zeros(len(low), np.uint8)
    pairs[:-1] = two[low[:-1]] & then[1:]
    pairs[:-2] |= more[low[:-2]] & then[1:-1] & then[2:]
    return np.bitwise_or.reduceat(pairs, np.concatenate([[0], ends[:-1]]))


@lru_cache(None)
def _utf8_bytes(codec: str) -> np.ndarray:
    """By code point up to 0xFFFF: whether the multi-byte encoding writes it in bytes usual in UTF-8 beyond ASCII."""
    usual = {*range(0x80, 0xC0), *range(0xC3, 0xC6), *range(0xCE, 0xD2), *range(0xD7, 0xDA), *range(0xE0, 0xF0)}
    out = np.array([bool(raw) and usual.issuperset(raw) for raw in _written(codec)[: 1 << 16]])
    out[:0x80] = out[0xFFFD:] = False
    return out


@lru_cache(None)
def _upper_half() -> np.ndarray:
    """By code point up to 0x10000: whether it is of the upper half of one of ``WESTERN``."""
    out = np.zeros((1 << 16) + 1, bool)
    for codec in WESTERN:
        out[list(_to_byte(codec))] = True
    return out


_UTF8_ROW = re.compile(rb"(?:[\xe0-\xef][\x80-\xbf]{2}){4,}|(?:[\xc3-\xc5\xce-\xd1\xd7-\xd9][\x80-\xbf]){7,}")
#: Its two kinds, for a search that skips to where one may begin.
_UTF8_ROW_3 = re.compile(rb"[\xe0-\xef][\x80-\xbf]{2}(?:[\xe0-\xef][\x80-\xbf]{2}){3}")
_UTF8_ROW_2 = re.compile(rb"[\xc3-\xc5\xce-\xd1\xd7-\xd9][\x80-\xbf](?:[\xc3-\xc5\xce-\xd1\xd7-\xd9][\x80-\xbf]){6}")


class _Bare:
    """A text whose runs are all looked at."""

    def __init__(self, text: str) -> None:
        self.text, self._high, self.only = text, {}, {}

    def encoded(self, codec: str) -> list[tuple[int, int, bytes]]:
        """The runs that hold several characters of UTF-8 in a row."""
        return [(s + x, s + y, raw) for m in _WIDE_RUN.finditer(self.text) for s, e in [m.span()] for x, y, raw in _encodable(self.text[s:e], codec) if _UTF8_ROW.search(raw)]

    def high(self, codec: str) -> list[tuple[int, int]]:
        """The long runs of which at least half is beyond ASCII."""
        if codec not in self._high:
            runs = (m.span() for m in _high_run(codec).finditer(self.text))
            self._high[codec] = [(s, e) for s, e in runs if e - s >= FORMAL and 2 * len(_any_high(codec).findall(self.text, s, e)) >= e - s]
        return self._high[codec]


def _formal(text: str, wide: list[str], middle: bool, utf8: int, upper_rows: bool) -> list[tuple[int, int]]:
    """``utf8``: the ``SINGLE`` that may have read it, a bit each; ``upper_rows``: whether characters of an upper half may stand close.

    Spans that are UTF-8 or a legacy encoding once more when written in the bytes they were read from."""
    t, out = _Bare(text), []
    for codec in wide:
        raw = text.encode(codec, "ignore")
        if not (_UTF8_ROW_3.search(raw) or _UTF8_ROW_2.search(raw)):
            continue
        for start, _, raw in t.encoded(codec):
            for m in _UTF8_ROW.finditer(raw):
                x, y = (len(raw[:k].decode(codec, "ignore")) for k in m.span())
                out.append((start + x, start + y))
    if middle:
        upper = len(_MIDDLE_ONE.findall(text))
        for k, codec in enumerate(SINGLE):
            spans = [(s, e) for s, e, _ in utf8_read_as(t, codec)] if utf8 >> k & 1 else []
            # ASCII among them: no-break spaces read as spaces
            if len(spans) >= SEQUENCES and sum(e - s for s, e in spans) >= 0.9 * upper or spans and max(e - s for s, e in spans) >= FORMAL:
                out += spans
        for codec in WESTERN if upper_rows else ():
            for right in LEGACY[:-1]:
                for s, e, new in legacy_read_as_single(t, right, codec):
                    if all(c >= "\u2e80" or c < "\x80" for c in new):
                        out.append((s, e))
    if "$B" in text or "$@" in text:
        out += [(s, e) for s, e, _ in shifts_shown(t) if e - s >= FORMAL]
    return sorted(out)


def without_formal(texts: list[str | None]) -> list[str | None]:
    """The texts with a line break for each passage that shows by its form that it is garbled."""
    a, n = codes([t or "" for t in texts])
    owner = np.repeat(np.arange(len(texts)), n)
    wide: dict[int, list[str]] = {}
    if len(a) > FORMAL:
        low = np.minimum(a, 0xFFFF).astype(np.uint16)
        for codec in MULTI:
            outside = np.concatenate([[0], np.cumsum(~_utf8_bytes(codec)[low], dtype=np.int32)])
            at = np.flatnonzero(outside[FORMAL:] == outside[:-FORMAL])
            for i in np.unique(owner[at[owner[at] == owner[at + FORMAL - 1]]]):
                wide.setdefault(int(i), []).append(codec)
    odd = (a >= 0x80) & (a < 0x2E00) | (a == 0xF8FF) | (a == 0xFB01) | (a == 0xFB02)
    odd &= (a != 0x2026) & (a != 0x2015) & (a != 0x2014)
    pairs = np.flatnonzero(odd[:-1] & (odd[1:] | (a[1:] < 0x80) & (a[1:] >= 0x20) & (a[:-1] == 0xC3)))
    middle = np.bincount(owner[pairs], minlength=len(texts)) >= SEQUENCES
    full = np.cumsum(n)
    utf8, rows = np.zeros(len(texts), np.uint8), np.zeros(len(texts), bool)
    if middle.any():
        low = np.minimum(a, 1 << 16)
        # of FORMAL characters and more half are beyond ASCII only if FORMAL in a row have more than a quarter
        upper = np.concatenate([[0], np.cumsum(_upper_half()[low])])
        at = np.flatnonzero(upper[FORMAL:] - upper[:-FORMAL] > FORMAL // 4)
        rows[np.searchsorted(full, at, "right")] = True
        rows[np.searchsorted(full, at + FORMAL - 1, "right")] = True
        some = np.flatnonzero(n)
        utf8[some] = _read_utf8(low, full[some])
    out = list(texts)
    for i, t in enumerate(texts):
        if t and (i in wide or middle[i] or "$B" in t or "$@" in t):
            at, parts = 0, []
            for s, e in _formal(t, wide.get(i, []), bool(middle[i]), int(utf8[i]), bool(rows[i])):
                if e > at:
                    parts += [t[at : max(s, at)], "\n"]
                    at = e
            out[i] = "".join([*parts, t[at:]])
    return out


# --- what may help ----------------------------------------------------------


@lru_cache(None)
def _held(codec: str) -> np.ndarray:
    """By code point up to 0x10000, which stands for all above: whether the encoding has it beyond ASCII."""
    out = _widths(codec) > 0
    out[:0x80] = out[0xFFFD] = False
    return out


@lru_cache(None)
def _single_codes(codec: str) -> np.ndarray:
    """By byte: the code point that the single-byte encoding reads."""
    return codes([bytes(range(256)).decode(codec, "replace")])[0]


def _read(raw: bytes, codec: str) -> np.ndarray:
    if codec not in (*MULTI, "utf-8"):
        return _single_codes(codec)[np.frombuffer(raw, np.uint8)]
    return np.frombuffer(raw.decode(codec, "replace").encode("utf-32-le"), np.uint32)


#: Line breaks after all, as what a decoder waits for at the end would take the last one.
_REST = b"\n\n\n"
#: Encodings in which an unfinished character counts up to twice where something follows, and may leave ASCII.
_LONGER = ("euc_jp", "gb18030")


class Stretches:
    """Stretches of framed texts that an encoding has, for many at once."""

    def __init__(self, a: np.ndarray, was: np.ndarray, score: Scorer) -> None:
        self.a, self.was, self.score = a, was, score  # was: sums of the pairs' log shares

    def before(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Log share of the pairs that touch each stretch."""
        return self.was[stop] - self.was[start - 1]

    def joined(self, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the stretches' characters, a line break after each, and the characters."""
        place = expand(start, size + 1)
        some = self.a[place]
        some[np.cumsum(size + 1) - 1] = 10
        return place, some

    def wide(self) -> np.ndarray:
        """By character whether it is of a run as ``Text.wide`` has it; some more may be."""
        a, out = self.a, np.zeros(len(self.a), bool)
        beyond = (a >= 0x80) & (a != 0xFFFD)
        start, stop = (np.flatnonzero(beyond[1:] != beyond[:-1]) + 1).reshape(-1, 2).T
        rare = np.concatenate([[0], np.cumsum((self.was[LONG:] - self.was[:-LONG]) / LONG < self.score.long_rare + 1e-6)])
        half = np.concatenate([[0], np.cumsum((a >= 0xFF61) & (a < 0xFFA0))])
        first, last = np.maximum(start - 2, 0), np.maximum(start - 1, stop + 1 - LONG)
        some = (rare[np.minimum(last, len(rare) - 1)] > rare[np.minimum(first, len(rare) - 1)]) | (half[stop] > half[start])
        start, stop = start[some], stop[some]
        out[expand(start, stop - start)] = True
        return out

    def around(self, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.a[start - 1], self.a[stop]


def _write(some: np.ndarray, codec: str) -> bytes:
    return some.tobytes().decode("utf-32-le").encode(codec)


def _least_loss(raw: bytes, right: str, score: Scorer) -> tuple[np.ndarray, np.ndarray | int]:
    """By beginning of a stretch in ``raw``, each ended by a line break, as ``right`` reads it: bound from above of its pairs' log shares, lost characters (none, where few are)."""
    b = _read(raw + _REST, right)
    ends = np.flatnonzero(b == 10)[: -len(_REST)]
    starts = np.concatenate([[0], ends[:-1] + 1])
    pairs = score.model[_slots(b)]
    lost = np.flatnonzero(b == 0xFFFD)
    pairs[np.maximum(ends - 1, 0)] = pairs[ends] = 0.0
    if right in _LONGER:  # what may be of a character cut in two
        cut = (b[ends - 1] == 0xFFFD) | (b[ends - 2] == 0xFFFD) | (b[ends - 3] == 0xFFFD)
        for k in (2, 3, 4):
            pairs[np.maximum(ends[cut] - k, starts[cut])] = 0.0
    pairs[lost] = pairs[np.maximum(lost - 1, 0)] = 0.0
    return np.add.reduceat(pairs, starts), np.searchsorted(lost, ends) - np.searchsorted(lost, starts) if 50 * len(lost) > len(b) else 0


def _bounds(raw: bytes, right: str, score: Scorer, around: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
    """By stretch of ``raw``, each ended by a line break, as ``right`` reads it: characters, lost ones, bound from above of its pairs' log shares, lost ones before the end.

    ``around``: the characters before and after each stretch.
    """
    b = _read(raw + _REST, right)
    ends = np.flatnonzero(b == 10)[: -len(_REST)]
    starts = np.concatenate([[0], ends[:-1] + 1])
    lost = np.flatnonzero(b == 0xFFFD)
    pairs = score.model[_slots(b)]
    pairs[lost] = pairs[np.maximum(lost - 1, 0)] = 0.0
    run = np.concatenate([[0.0], np.cumsum(pairs, dtype=np.float64)])
    bad = np.searchsorted(lost, ends) - np.searchsorted(lost, starts)
    tail = np.where(bad > 0, 4, 1) if right in _LONGER else 1
    after = run[np.maximum(ends - tail, starts)] - run[starts]
    whole, none = np.flatnonzero((bad == 0) & (ends > starts)), np.flatnonzero(ends == starts)
    for at, x, y in ((whole, around[0][whole], b[starts[whole]]), (whole, b[ends[whole] - 1], around[1][whole]), (none, around[0][none], around[1][none])):
        if len(at):
            after[at] += score.model[_slots(np.stack([x, y], 1).ravel())[::2]]
    early = np.searchsorted(lost, np.maximum(ends - (3 if right in _LONGER else 1), starts)) - np.searchsorted(lost, starts)
    return ends - starts, bad, after, early


def _likelier(after: np.ndarray, length: np.ndarray, before: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether a bound of the log share leaves room for ``LEAST_GAIN``, as a whole and on average."""
    return (after - before >= LEAST_GAIN - 0.01) & (after / (length + 1) > before / (size + 1) + 0.49)


def _wide_steps(of: Stretches, start: np.ndarray, stop: np.ndarray, codec: str, rights: list[str]) -> Iterator[tuple[str, np.ndarray]]:
    """The steps by which ``rights`` may make stretches likelier, with the beginnings of these.

    A log share is never above zero, so the pairs within the restored stretch
    bound its gain from above, and those within its first part do: only
    stretches that they leave are read whole.
    """
    widest = int(_widths(codec).max())
    long = stop - start >= 6 // widest  # of fewer characters no stretch has the six bytes asked for
    start, stop = start[long], stop[long]
    if not len(start):
        return
    size, before = stop - start, of.before(start, stop)
    # as many characters as outweigh the stretch if their pairs are nearly all unknown; a single-byte encoding reads two of each
    most = (before / (0.75 * float(of.score.model.min()))).astype(np.int64)
    part = {k: _write(of.joined(start, np.minimum(size, most // k + 4))[1], codec) for k in {1 if r in MULTI else 2 for r in rights}}
    for right in rights:
        after, bad = _least_loss(part[1 if right in MULTI else 2], right, of.score)
        # of a byte comes one character at most, and three lost ones of one cut in two
        at = np.flatnonzero((after - before >= LEAST_GAIN - 0.1) & (bad <= size * widest // 20 + 3))
        if len(at):
            length, bad, after, _ = _bounds(_write(of.joined(start[at], size[at])[1], codec), right, of.score, of.around(start[at], stop[at]))
            at = at[(np.where(bad > 1, bad - (right in _LONGER), bad) <= length // 20) & _likelier(after, length, before[at], size[at])]
        if len(at):
            yield f"{right}>{codec}", start[at]


def _utf8_wide(of: Stretches, start: np.ndarray, stop: np.ndarray, codec: str) -> np.ndarray:
    """Where UTF-8 read in a multi-byte encoding may become likelier."""
    if not len(start):
        return start
    place, some = of.joined(start, stop - start)
    raw = _write(some, codec)
    at = np.concatenate([[0], np.cumsum(_widths(codec)[np.minimum(some, 1 << 16)])])  # first byte of each character
    spans = np.array([m.span() for m in _NEARLY_UTF8.finditer(raw)], np.int64).reshape(-1, 2)
    x, y = np.searchsorted(at, spans[:, 0]), np.searchsorted(at, spans[:, 1], "right") - 1
    x, y = x[y > x], y[y > x]
    if not len(x):
        return x
    take = expand(at[x], at[y] - at[x] + 1)
    new = np.frombuffer(raw, np.uint8)[take]
    new[np.cumsum(at[y] - at[x] + 1) - 1] = 10
    start, stop = place[x], place[y - 1] + 1
    length, _, after, _ = _bounds(new.tobytes().decode("utf-8", "ignore").encode(), "utf-8", of.score, of.around(start, stop))
    return start[_likelier(after, length, of.before(start, stop), stop - start)]


def _legacy_single(of: Stretches, framed: str, codec: str) -> Iterator[tuple[str, np.ndarray]]:
    """The steps by which a multi-byte encoding read in a single-byte one may become likelier, with the places."""
    spans = np.array([m.span() for m in _high_run(codec).finditer(framed)], np.int64).reshape(-1, 2)
    start, stop = spans.T
    if not len(start):
        return
    raw = _bytes(_joined_text(of.joined(start, stop - start)[1]), codec)
    then = of.a[stop]
    second = (then >= 0x40) & (then <= 0x7E)
    size = stop - start
    for right in LEGACY:
        length, bad, after, early = _bounds(raw, right, of.score, of.around(start, stop))
        before = of.before(start, stop + (second & (bad > 0)))  # the second byte of the last character may look like a letter
        at = np.flatnonzero((early == 0) & (length > 1) & (after - before >= LEAST_GAIN - 0.01) & ((bad > 0) | _likelier(after, length, before, size)))
        if len(at):
            yield f"{right}>{codec}", start[at]


def _joined_text(some: np.ndarray) -> str:
    return some.tobytes().decode("utf-32-le")


def _stretches(texts: list[str], score: Scorer) -> tuple[Stretches, np.ndarray]:
    """Of the framed texts, with where each ends."""
    a, n = codes(_framed(texts))
    return Stretches(a, np.concatenate([[0.0], np.cumsum(score.model[_slots(a)], dtype=np.float64)]), score), np.cumsum(n)


def _held_runs(low: np.ndarray, codec: str) -> tuple[np.ndarray, np.ndarray]:
    held = _held(codec)[low]  # nowhere at the line breaks around each text
    return (np.flatnonzero(held[1:] != held[:-1]) + 1).reshape(-1, 2).T


def _promising(texts: list[str], score: Scorer, tried: Iterable[str] = FORMLESS) -> dict[int, list[str]]:
    """By text the steps of two multi-byte encodings among ``tried`` that may make a stretch of it likelier by ``LEAST_GAIN``.

    All texts are written and read at once.
    """
    out: dict[int, list[str]] = {}
    if not texts:
        return out
    of, ends = _stretches(texts, score)
    low = np.minimum(of.a, 1 << 16)
    for codec in MULTI:
        rights = [r for r in LEGACY if f"{r}>{codec}" in tried]
        if rights:
            for step, at in _wide_steps(of, *_held_runs(low, codec), codec, rights):
                for i in np.unique(np.searchsorted(ends, at, "right")).tolist():
                    out.setdefault(i, []).append(step)
    return out


#: Steps of two single-byte encodings, and characters of a stretch with its neighbours up to which what may help it is remembered.
_WESTERN_STEPS, REMEMBERED = tuple(s for s in _STEPS if s in FORMLESS and s.split(">")[1] not in MULTI), 32
_WESTERN_RIGHTS = {c: [r for r in WESTERN if f"{r}>{c}" in _WESTERN_STEPS] for c in (*WESTERN, "cp850", "cp1251", "koi8_r")}


def _western_helping(stretch: str, score: Scorer) -> list[str]:
    """The steps of two single-byte encodings that may help a middle run, given with the characters before and after."""
    got = score.western.get(stretch)
    if got is None:
        if len(stretch) > REMEMBERED:
            return list(_WESTERN_STEPS)
        if len(score.western) > 200_000:
            score.western.clear()
        got, run, was = [], stretch[1:-1], float(score.logs(stretch).sum())
        least, points = was + LEAST_GAIN - 0.01, [ord(c) for c in run]
        for codec, rights in _WESTERN_RIGHTS.items():
            to = _to_byte(codec)
            raw = [to.get(c) for c in points]
            if None not in raw:
                for right in rights:
                    new = bytes(raw).decode(right, "replace")
                    if new != run and "�" not in new and score.total(stretch[0] + new + stretch[-1]) >= least:
                        got.append(f"{right}>{codec}")
        score.western[stretch] = got
    return got


def _western(texts: list[str], score: Scorer) -> dict[int, dict[str, set[int]]]:
    """By text the steps of two single-byte encodings that may help runs of it, with where these begin; a run between the same characters is weighed once."""
    out: dict[int, dict[str, set[int]]] = {}
    joined, ends, known = "".join(_framed(texts)), None, score.western
    for m in _MIDDLE.finditer(joined):
        stretch = joined[m.start() - 1 : m.end() + 1]
        helping = known[stretch] if stretch in known else _western_helping(stretch, score)
        if helping:
            ends = ends or np.cumsum([len(t) + 2 for t in texts]).tolist()
            i = bisect_right(ends, m.start())
            for step in helping:
                out.setdefault(i, {}).setdefault(step, set()).add(m.start() - 1 - (ends[i - 1] if i else 0))
    return out


def first_candidates(texts: list[str]) -> list[dict[str, set[int] | None]]:
    """By text the first ones of all steps, those of UTF-8 read byte by byte, that may help it."""
    if not texts:
        return []
    a, n = codes(_framed(texts))
    return [{f"utf8>{c}": None for k, c in enumerate(SINGLE) if bits >> k & 1} for bits in _read_utf8(np.minimum(a, 1 << 16), np.cumsum(n)).tolist()]


def candidates(texts: list[str], score: Scorer) -> list[dict[str, set[int] | None]]:
    """By text the further steps, in their order, that may help it, with where the passages begin, if that is known; none that helps is missing."""
    if not texts:
        return []
    of, ends = _stretches(texts, score)
    low = np.minimum(of.a, 1 << 16)
    begins = np.concatenate([[0], ends[:-1]]) + 1
    some: list[dict[str, set[int] | None]] = [{} for _ in texts]

    def add(step: str, at: np.ndarray) -> None:
        owner = np.searchsorted(ends, at, "right")
        for i, x in zip(owner.tolist(), (at - begins[owner]).tolist(), strict=True):
            some[i].setdefault(step, set()).add(x)

    wide = of.wide()
    for codec in MULTI:
        start, stop = _held_runs(low, codec)
        seen = wide[start]
        add(f"utf8>{codec}", _utf8_wide(of, start[seen], stop[seen], codec))
        rights = [r for r in LEGACY if r != codec]
        for common in (False, True):
            tried = [r for r in rights if (f"{r}>{codec}" in score.common) == common]
            if tried:
                for step, at in _wide_steps(of, *((start, stop) if common else (start[seen], stop[seen])), codec, tried):
                    add(step, at)
    framed = "".join(_framed(texts))
    for codec in WESTERN:
        for step, at in _legacy_single(of, framed, codec):
            add(step, at)
    for i, places in _western(texts, score).items():
        some[i].update(places)
    for i, text in enumerate(texts):
        if "$B" in text or "$@" in text:
            some[i]["iso2022_jp>ascii"] = None
    return [{s: x[s] for s in _STEPS if s in x} if x else x for x in some]


# --- search -----------------------------------------------------------------


def undo(t: Text, step: str) -> tuple[str, float]:
    """The text with all passages restored that become likelier by this step, and the gain."""
    text, parts, at, total = t.text, [], 0, 0.0
    # UTF-8 read byte by byte shows by its form alone, and may be only the first of two layers
    on_average = not (step.startswith("utf8>") and step[5:] in SINGLE)
    for start, end, new in _STEPS[step](t):
        if start < at:
            continue
        g = t.gain(start, end, new, on_average)
        if g >= LEAST_GAIN:
            parts += [text[at:start], new]
            at, total = end, total + g
    return ("".join([*parts, text[at:]]), total) if parts else (text, 0.0)


def sound(text: str, score: Scorer) -> bool:
    return not suspicious([text.replace("�", "")], score)[0]


def helping(texts: list[str], score: Scorer) -> list[list[tuple[str, float, str]]]:
    """By text (step, gain, restored text) of the steps that help; a step that leaves nothing suspicious ends the search."""
    out: list[list[tuple[str, float, str]]] = [[] for _ in texts]

    def ends(i: int, tried: dict[str, set[int] | None]) -> bool:
        t = Text(texts[i], score, {s: x for s, x in tried.items() if x is not None})
        for step in tried:
            new, gain = undo(t, step)
            if gain > 0:
                out[i].append((step, gain, new))
                if gain >= 3 * LEAST_GAIN and sound(new, score):
                    return True
        return False

    rest = [i for i, tried in enumerate(first_candidates(texts)) if not (tried and ends(i, tried))]
    for i, tried in zip(rest, candidates([texts[i] for i in rest], score), strict=True):
        if tried:
            ends(i, tried)
    return out


def chains(texts: list[str], score: Scorer) -> list[list[tuple[str, float, str]]]:
    """By text (chain, evidence, restored text) of every first step that helps, the best one carried on greedily."""
    out = helping(texts, score)
    best = {}
    for i, found in enumerate(out):
        if found:
            best[i] = max(found, key=lambda x: x[1])
            found.remove(best[i])
    more = list(best)
    while more:  # each step makes the text likelier, so none comes again
        more = [more[k] for k in np.flatnonzero(suspicious([best[i][2].replace("�", "") for i in more], score))]
        carried = []
        for i, then in zip(more, helping([best[i][2] for i in more], score), strict=True):
            name, gain, new = best[i]
            if then:
                step, further, new = max(then, key=lambda x: x[1])
                best[i] = f"{step}|{name}", gain + further, new
                carried.append(i)
        more = carried
    for i, text in enumerate(texts):
        if i in best:
            out[i].append(best[i])
        lost = text.count("�")
        if lost:
            out[i].append(("lost", lost * LOST_EVIDENCE, text))
    return out


# --- operator ---------------------------------------------------------------


def _formless(shared):
    """mapInArrow: texts -> the best step without form of each that it helps although its pairs are not rare."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(np.frombuffer(shared.value, np.float32), FORMLESS)

        def best(texts: list[str]) -> Iterator[str]:
            texts = [texts[i] for i in np.flatnonzero(~suspicious(texts, score))]
            wide, western = _promising(texts, score), _western(texts, score)
            for i in sorted({*wide, *western}):
                t = Text(texts[i], score)
                gain, step = max((undo(t, step)[1], step) for step in (*wide.get(i, []), *western.get(i, [])))
                if gain > 0:
                    yield step

        for batch in batches:
            found = [step for group in _groups(column(batch, "text").to_pylist()) for step in best(group)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["step"])

    return run


def common_steps(texts: DataFrame, shared) -> frozenset[str]:
    """Steps without form that help a share of at least ``COMMON`` of all distinct texts (a table on storage), pairs not being rare."""
    least = max(2, COMMON * texts.count())
    rows = spread(texts).mapInArrow(_formless(shared), "step string").groupBy("step").count().collect()  # a row by step at most
    return frozenset(r["step"] for r in rows if r["count"] >= least)


def _evidence(shared, common: frozenset[str] = frozenset()):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(np.frombuffer(shared.value, np.float32), common)
        for batch in batches:
            ids, sources, texts = (column(batch, c).to_pylist() for c in ("doc_id", "source", "text"))
            rows: list[tuple] = []
            s = 0
            while s < len(texts):
                e, size = s, 0
                while e < len(texts) and (e == s or size < SLICE):
                    size += len(texts[e] or "")
                    e += 1
                odd = suspicious([t or "" for t in texts[s:e]], score)
                if common:
                    rest = np.flatnonzero(~odd)
                    some = [texts[s + i] or "" for i in rest]
                    wide, western = _promising(some, score, common), _western(some, score)
                    for i in {*wide, *western}:
                        t = Text(some[i], score)
                        odd[rest[i]] = any(undo(t, step)[1] > 0 for step in common.intersection([*wide.get(i, []), *western.get(i, [])]))
                at = np.flatnonzero(odd) + s
                for i, found in zip(at, chains([texts[i] for i in at], score), strict=True):
                    rows += [(ids[i], sources[i], c, g, new) for c, g, new in found]
                s = e
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string()), strict=True)], names=["doc_id", "source", "chain", "evidence", "restored"])

    return run


def garbled(documents: DataFrame) -> DataFrame:
    """Affected records of (doc_id, source, text): doc_id, chain, posterior (of being garbled at all), restored and lost.

    ``lost``: whether bytes are lost, besides the chain or alone; ``restored`` is null where nothing is restorable.
    """
    docs = spread(documents.select("doc_id", "source", "text").where(F.col("text").isNotNull()))
    spark = documents.sparkSession
    texts = materialize(distinct_spread(docs.select("text")), "garbled-texts")
    shared = spark.sparkContext.broadcast(pair_model(texts).tobytes())
    common: frozenset[str] = frozenset()
    while True:  # the fewer garbled pairs the model holds, the more steps show
        more = common_steps(texts, shared) - common
        if not more:
            break
        common |= more
        shared = spark.sparkContext.broadcast(pair_model(texts, _count_undone(shared, common)).tobytes())
    found = materialize(docs.mapInArrow(_evidence(shared, common), "doc_id long, source string, chain string, evidence double, restored string"), "garbled-evidence")
    ev = found.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "chain", "evidence")
    sizes = materialize(documents.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count("*").alias("records")), "garbled-sizes")
    # the chains of a record exclude each other and being sound; lost bytes go with any of them
    apart = Window.partitionBy("doc_id", F.col("chain") == "lost")
    of_source = Window.partitionBy("source", F.col("chain") == "lost")

    def whole(share: DataFrame) -> DataFrame:
        """With the share of sound records, so that all add up to one."""
        return share.withColumn("sound", F.greatest(1 - F.sum("share").over(of_source), F.lit(1e-6)))

    share = materialize(whole(ev.select("source", "chain").distinct().withColumn("share", F.lit(0.001))), "garbled-share")

    def posteriors(share: DataFrame) -> DataFrame:
        """Posterior ``p`` of each chain in logarithms; a share too small for a double counts as 1e-300."""
        logs = ev.join(share, ["source", "chain"]).withColumn("l", F.log(F.greatest("share", F.lit(1e-300))) + F.col("evidence"))
        top = logs.withColumn("top", F.greatest(F.max("l").over(apart), F.lit(0.0))).withColumn("w", F.exp(F.col("l") - F.col("top")))
        return top.withColumn("p", F.col("w") / (F.col("sound") * F.exp(-F.col("top")) + F.sum("w").over(apart)))

    n = sizes.agg(F.sum("records")).first()[0] or 0
    while True:
        mass = posteriors(share).groupBy("source", "chain").agg(F.sum("p").alias("mass"))
        by_chain = mass.groupBy("chain").agg(F.sum("mass").alias("whole"))
        new = mass.join(by_chain, "chain").join(sizes, "source").select("source", "chain", ((F.col("mass") + PRIOR * F.col("whole") / F.lit(max(n, 1))) / (F.col("records") + PRIOR)).alias("share"))
        new = materialize(whole(new), "garbled-share")
        moved = new.join(share.select("source", "chain", F.col("share").alias("before")), ["source", "chain"]).agg(F.max(F.abs(F.col("share") - F.col("before")))).first()[0]
        share = new
        if moved is None or moved < SETTLED:
            break
    gone = F.col("chain") == "lost"
    best = posteriors(share).groupBy("doc_id").agg(
        F.coalesce(F.sum(F.when(~gone, F.col("p"))), F.lit(0.0)).alias("by_chain"), F.coalesce(F.max(F.when(gone, F.col("p"))), F.lit(0.0)).alias("by_loss"),
        F.max_by("chain", F.when(~gone, F.struct("l", "chain"))).alias("chain"),
    )
    best = best.withColumn("posterior", 1 - (1 - F.col("by_chain")) * (1 - F.col("by_loss"))).where("posterior > 0.5")
    best = best.withColumn("chain", F.when((F.col("by_chain") > 0.5) | (F.col("by_chain") >= F.col("by_loss")), F.col("chain")).otherwise("lost"))
    texts = found.select("doc_id", "chain", F.when(~gone, F.col("restored")).alias("restored"))
    return best.join(texts, ["doc_id", "chain"]).select("doc_id", "chain", "posterior", "restored", (F.col("by_loss") > 0.5).alias("lost")).dropDuplicates(["doc_id"])
