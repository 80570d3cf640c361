"""Problem 2: oversized texts cut into pieces at natural boundaries.

Agglomerative merging: a text starts as atomic segments; the boundaries between
neighbours wait in a heap, weakest first, and a boundary is merged away as long
as the two segments and the overlap with the piece before fit the limit. What
is left are the strongest boundaries the limit allows: paragraph, line,
sentence, clause, word, and a cut between characters only where a single
segment is over the limit. Inside quotes and brackets boundaries count less.

A null or blank text is one piece as it is, and so is a text whose profile has
no limit. Repeated rows count once.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fumigura.llm.common import column, distinct_spread
from fumigura.llm.sentences import protected_spans, sentence_ends

PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD, CHARACTER = 6, 5, 4, 3, 2, 0
_CLAUSE = re.compile(r"[、，,;；:：―—]+\s*|[」』）】〉》”]\s*")
_WORD = re.compile(r"\s+")
_NEWLINE = re.compile(r"\r?\n(\s*\n)?\s*|[  \v\f]")


def _joins(text: str, i: int) -> bool:
    """Whether a cut before ``i`` would split one written character."""
    ch = text[i]
    return bool(unicodedata.combining(ch)) or unicodedata.category(ch) in ("Mn", "Mc", "Me") or ch in "‍︎️" or text[i - 1] == "‍" or "\U0001f3fb" <= ch <= "\U0001f3ff" or text[i - 1 : i + 1] == "\r\n"


def boundaries(text: str, lang: str | None = None) -> dict[int, int]:
    """Strength of each natural boundary, by position."""
    out: dict[int, int] = {}
    for pattern, strength in ((_WORD, WORD), (_CLAUSE, CLAUSE)):
        for m in pattern.finditer(text):
            out[m.end()] = max(strength, out.get(m.end(), 0))
    for e in sentence_ends(text, lang):
        at = _WORD.match(text, e)
        at = at.end() if at else e
        out[at] = SENTENCE
    for start, end in protected_spans(text):
        for i in [i for i in range(start + 1, end) if out.get(i, 0) > WORD]:
            out[i] = WORD
    for m in _NEWLINE.finditer(text):
        out[m.end()] = PARAGRAPH if m.group(1) is not None else LINE
    out.pop(0, None)
    out.pop(len(text), None)
    return out


def _hard_cuts(text: str, start: int, end: int, room: int) -> Iterator[int]:
    """Cuts of a segment over the limit, at whole characters where they are shorter than the room."""
    while end - start > room:
        cut = start + room
        while cut > start + 1 and _joins(text, cut):
            cut -= 1
        if cut == start + 1:
            cut = start + room
        yield cut
        start = cut


def pieces(text: str, most: int, overlap: int, lang: str | None = None) -> list[tuple[int, int, int]]:
    """(start, end, strength of the boundary at the end) of the pieces, without the overlap that stands before each but the first."""
    if len(text) <= most:
        return [(0, len(text), PARAGRAPH)]
    overlap = max(0, min(overlap, most - 1))
    room = most - overlap
    strength = boundaries(text, lang)
    cuts, start = [], 0
    for b in [*sorted(strength), len(text)]:
        for c in _hard_cuts(text, start, b, room):
            strength[c] = CHARACTER
            cuts.append(c)
        if b < len(text):
            cuts.append(b)
        start = b
    starts = [0, *cuts]
    ends = [*cuts, len(text)]
    n = len(starts)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    fits = lambda i, j: ends[j] - starts[i] <= (room if starts[i] else most)
    heap = [(strength[ends[i]], ends[i + 1] - starts[i], i, i + 1) for i in range(n - 1) if fits(i, i + 1)]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, size, i, j = heapq.heappop(heap)
        if not (alive[i] and alive[j]) or after[i] != j or size != ends[j] - starts[i]:
            continue
        ends[i], alive[j], after[i] = ends[j], False, after[j]
        if after[i] >= 0:
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b >= 0 and fits(a, b):
                heapq.heappush(heap, (strength[ends[a]], ends[b] - starts[a], a, b))
    return [(starts[i], ends[i], strength.get(ends[i], PARAGRAPH)) for i in range(n) if alive[i]]


_NAMES = {PARAGRAPH: "paragraph", LINE: "line", SENTENCE: "sentence", CLAUSE: "clause", WORD: "word", CHARACTER: "character"}
_OUT = pa.list_(pa.struct([("begin_pos", pa.int32()), ("end_pos", pa.int32()), ("overlap", pa.int32()), ("boundary", pa.string())]))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = []
        for text, most, overlap in zip(*(column(batch, c).to_pylist() for c in ("text", "max_chars", "overlap_chars")), strict=True):
            if text is None or most is None or most < 1:
                made.append([(0, len(text or ""), 0, "end")])
                continue
            lap = max(0, min(overlap or 0, most - 1))
            made.append([(s - (lap if s else 0), e, lap if s else 0, "end" if e == len(text) else _NAMES[b]) for s, e, b in pieces(text, most, lap)])
        rows = [[dict(zip(("begin_pos", "end_pos", "overlap", "boundary"), p, strict=True)) for p in m] for m in made]
        yield pa.RecordBatch.from_arrays([column(batch, "window_id"), column(batch, "profile"), column(batch, "text"), pa.array(rows, _OUT)], names=["window_id", "profile", "text", "pieces"])


def cut_windows(windows: DataFrame, limits: DataFrame) -> DataFrame:
    """Pieces of (window_id, profile, text) under the limit of their profile.

    window_id, profile, piece_no, begin_pos, end_pos (code points; begin_pos
    with the overlap), overlap, boundary (what stands at the end), piece.
    """
    rows = distinct_spread(windows.select("window_id", "profile", "text")).join(limits.select("profile", "max_chars", "overlap_chars").dropDuplicates(["profile"]), "profile", "left")
    done = rows.mapInArrow(_cut, "window_id long, profile string, text string, pieces array<struct<begin_pos:int, end_pos:int, overlap:int, boundary:string>>")
    out = done.select("window_id", "profile", "text", F.posexplode("pieces").alias("piece_no", "p"))
    return out.select("window_id", "profile", "piece_no", "p.begin_pos", "p.end_pos", "p.overlap", "p.boundary", F.expr("substring(text, p.begin_pos + 1, p.end_pos - p.begin_pos)").alias("piece"))


def oversized_windows(windows: DataFrame, limits: DataFrame) -> DataFrame:
    """window_id of the texts that had to be cut."""
    return cut_windows(windows, limits).where("piece_no = 1").select("window_id").distinct()
