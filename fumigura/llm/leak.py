"""Problem 1: passages of evaluation items inside a corpus.

Pigeonhole edit matching. Of a passage of ``passage`` characters with at most
``errors`` edits, one of ``errors + 1`` stretches must occur unchanged. The
pieces of all items are shorter than a stretch by less than the step of their
grid, so that every stretch contains a whole piece wherever the passage begins;
the corpus is searched for exact piece hits (a bitmap sized from the pieces
first, then an equi-join). Around a hit both sides show one byte a character, by
which it is seen whether a passage with the edits allowed can contain the piece.
The pairs of texts that are left are verified whole by Myers' bit-parallel
distance: of each piece in common the passage that an edit can reach against the
text around it.

Copies of one text, in the corpus or among the items, are one class until the
result is written; pieces of very many items are spread over several tasks, those
of very many records by the adaptive split of skewed joins. Nulls, empty and
short texts (form under one passage) leak nothing and are no items. Repeated rows
of one id count once. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fumigura.llm.common import KeyFilter, codes, column, comparison_form, expand, materialize, mix64, salted_join, semi_by_key, spread, window_hashes

#: Fills the context of an item, and that of a record; the bytes of characters are others.
_PAD, _GAP = 1, 0
_HIT = "h long, class long, ctx binary"
#: Characters of pairs of texts compared at once.
SLICE = 200_000


def _contexts(a: np.ndarray, lengths: np.ndarray, owner: np.ndarray, pos: np.ndarray, width: int, side: int, pad: int) -> np.ndarray:
    """Text from ``side`` before to ``side`` after each window of ``width``, a row for each."""
    start = np.cumsum(lengths) - lengths
    rel = pos[:, None] - side + np.arange(width + 2 * side)
    inside = (rel >= 0) & (rel < lengths[owner][:, None])
    return np.where(inside, a[np.where(inside, start[owner][:, None] + rel, 0)], np.asarray(pad, a.dtype))


def _bytes_of(a: np.ndarray) -> np.ndarray:
    return (2 + (mix64(a.astype(np.uint64)) >> np.uint64(32)) % np.uint64(254)).astype(np.uint8)


def _unlike(h: np.ndarray, owner: np.ndarray, ctx: np.ndarray) -> np.ndarray:
    """The first of the windows of one text that agree in piece and context: a text that repeats itself has few."""
    pad = -(ctx.shape[1] * ctx.itemsize) % 8
    raw = np.ascontiguousarray(ctx).view(np.uint8).reshape(len(ctx), -1)
    words = np.concatenate([raw, np.zeros((len(ctx), pad), np.uint8)], 1).view(np.uint64) if len(ctx) else np.zeros((0, 1), np.uint64)
    key = h ^ mix64(owner.astype(np.uint64) + np.uint64(1))
    for k in range(words.shape[1]):
        key = mix64(key + words[:, k])
    return np.sort(np.unique(key, return_index=True)[1])


def _hits(piece: int, side: int, grid: int, pad: int, wanted: KeyFilter | None = None):
    """mapInArrow: (class, text) -> windows of ``piece`` on a grid, of the wanted pieces if some are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = dict(zip(column(batch, "class").to_pylist(), column(batch, "text").to_pylist(), strict=True))
            classes = np.array(list(texts), np.int64)
            a, n = codes([comparison_form(t) for t in texts.values()])
            h, owner, pos = window_hashes(a, n, piece)
            keep = (pos % grid == 0) & (n[owner] >= piece + side) if wanted is None else wanted.may_hold(h)
            h, owner, pos, shown = h[keep], owner[keep], pos[keep], _bytes_of(a)
            for s in range(0, len(h), 50_000):
                e = slice(s, s + 50_000)
                ctx = _contexts(shown, n, owner[e], pos[e], piece, side, pad)
                one = _unlike(h[e], owner[e], ctx)
                ctx = ctx[one]
                fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(ctx.shape[1]), len(ctx), [None, pa.py_buffer(np.ascontiguousarray(ctx))])
                yield pa.RecordBatch.from_arrays([pa.array(h[e][one].view(np.int64)), pa.array(classes[owner[e][one]]), fixed.cast(pa.binary())], names=["h", "class", "ctx"])

    return run


def myers_distances(p: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Least edit distance of each pattern row to any stretch of its text row, 64 rows of pattern at most.

    Bit-parallel over the pattern, vectorised over the pairs.
    """
    n, m = p.shape
    weight = (np.uint64(1) << np.arange(m, dtype=np.uint64))[None, :]
    mask = np.uint64((1 << m) - 1)
    top = np.uint64(m - 1)
    pv, mv = np.full(n, mask), np.zeros(n, np.uint64)
    score = np.full(n, m, np.int64)
    best = score.copy()
    for j in range(t.shape[1]):
        eq = np.where(p == t[:, j : j + 1], weight, np.uint64(0)).sum(1, dtype=np.uint64)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = (mv | ~(xh | pv)) & mask
        mh = pv & xh & mask
        score += (ph >> top & np.uint64(1)).astype(np.int64) - (mh >> top & np.uint64(1)).astype(np.int64)
        ph, mh = ph << np.uint64(1) & mask, mh << np.uint64(1) & mask
        pv = (mh | ~(xv | ph)) & mask
        mv = ph & xv & mask
        np.minimum(best, score, out=best)
    return best


def _reach(i: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Item characters from a piece outward that agree with the corpus: without an edit, and with one at most."""
    n, span = i.shape
    real, same = i != _PAD, i == c[:, :span]
    none = np.cumprod(same, 1).sum(1)
    k = np.arange(span)
    before, upto = k < none[:, None], k <= none[:, None]
    left_out = np.concatenate([np.zeros((n, 1), bool), i[:, 1:] == c[:, : span - 1]], 1)
    ways = (same | upto, left_out | upto, (i == c[:, 1 : span + 1]) | before)  # replaced, left out, put in
    return none, np.maximum.reduce([np.cumprod(w & real, 1).sum(1) for w in ways])


def _held(c: np.ndarray, i: np.ndarray, piece: int, side: int, passage: int, errors: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each hit: the run in common around the piece, and where in the item's context a passage begins that one edit can reach (or -1)."""
    at = side + errors  # the corpus shows as many characters more on each side as may be put in
    exact = (c[:, at : at + piece] == i[:, side : side + piece]).all(1)  # else two pieces of one hash
    pad = np.full((len(c), 1), _GAP, c.dtype)
    right, right_one = _reach(i[:, side + piece :], np.concatenate([c[:, at + piece :], pad], 1))
    left, left_one = _reach(i[:, :side][:, ::-1], np.concatenate([c[:, :at][:, ::-1], pad], 1))
    ahead, behind = left + piece + right_one >= passage, left_one + piece + right >= passage
    return np.where(exact, left + piece + right, 0), np.where(exact & ahead, side - left, np.where(exact & behind, side + piece + right - passage, -1))


def _compared(corpus: list[str], items: list[str], piece: int, side: int, passage: int, errors: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each pair of forms: the longest run in common (up to ``side`` around a piece), and the least edits of a passage."""
    run_len, best = np.zeros(len(corpus), np.int64), np.full(len(corpus), errors + 1, np.int64)
    (ac, nc), (ai, ni) = codes(corpus), codes(items)
    (hc, oc, pc), (hi, oi, pi) = window_hashes(ac, nc, piece), window_hashes(ai, ni, piece)
    kc, ki = (h ^ mix64(o.astype(np.uint64) + np.uint64(1)) for h, o in ((hc, oc), (hi, oi)))  # a piece of this pair
    at_c, at_i = np.flatnonzero(np.isin(kc, ki)), np.flatnonzero(np.isin(ki, kc))
    ctx_c, ctx_i = _contexts(ac, nc, oc[at_c], pc[at_c], piece, side + errors, _GAP), _contexts(ai, ni, oi[at_i], pi[at_i], piece, side, _PAD)
    one_c, one_i = _unlike(hc[at_c], oc[at_c], ctx_c), _unlike(hi[at_i], oi[at_i], ctx_i)
    at_c, at_i, ctx_c, ctx_i = at_c[one_c], at_i[one_i], ctx_c[one_c], ctx_i[one_i]
    order = np.argsort(ki[at_i], kind="stable")
    lo, upto = (np.searchsorted(ki[at_i][order], kc[at_c], x) for x in ("left", "right"))
    bounds = np.concatenate([[0], np.cumsum(upto - lo)])
    s = 0
    while s < len(at_c):
        e = max(s + 1, int(np.searchsorted(bounds, bounds[s] + 50_000, "right")) - 1)
        mine, theirs = np.repeat(np.arange(s, e), (upto - lo)[s:e]), order[expand(lo[s:e], (upto - lo)[s:e])]
        s = e
        same = oc[at_c[mine]] == oi[at_i[theirs]]
        c, i, pair = ctx_c[mine[same]], ctx_i[theirs[same]], oc[at_c[mine[same]]]
        runs, first = _held(c, i, piece, side, passage, errors)
        np.maximum.at(run_len, pair, runs)
        for x in [first] if errors <= 1 else [np.where((i[:, k : k + passage] != _PAD).all(1), k, -1) for k in range(side + 1)]:
            some = np.flatnonzero(x >= 0)
            if len(some):
                np.minimum.at(best, pair[some], myers_distances(i[some[:, None], x[some, None] + np.arange(passage)], c[some]))
    return run_len, best


def _near(piece: int, side: int, passage: int, errors: int):
    """mapInArrow: joined hits -> (corpus_class, item_class) of those a passage may contain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            c, i = (np.frombuffer(b"".join(column(batch, k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in ("corpus_ctx", "item_ctx"))
            run_len, first = _held(c, i, piece, side, passage, errors)
            keep = run_len >= passage if not errors else first >= 0 if errors == 1 else run_len >= piece
            at = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([column(batch, k).take(at) for k in ("corpus_class", "item_class")], names=["corpus_class", "item_class"])

    return run


def _verify(piece: int, side: int, passage: int, errors: int):
    """mapInArrow: pairs of texts -> verified (corpus_class, item_class, run_len, errors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [[comparison_form(t) for t in column(batch, k).to_pylist()] for k in ("corpus_text", "item_text")]
            sizes = np.cumsum([len(x) + len(y) for x, y in zip(*texts, strict=True)])
            run_len, best = np.zeros(len(sizes), np.int64), np.full(len(sizes), errors + 1, np.int64)
            s = 0
            while s < len(sizes):
                e = max(s + 1, int(np.searchsorted(sizes, sizes[s] + SLICE, "right")))
                run_len[s:e], best[s:e] = _compared(texts[0][s:e], texts[1][s:e], piece, side, passage, errors)
                s = e
            best[run_len >= passage] = 0
            where = np.flatnonzero(best <= errors)
            at = pa.array(where)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "corpus_class").take(at), column(batch, "item_class").take(at), pa.array(run_len[where].astype(np.int32)), pa.array(best[where].astype(np.int32))],
                names=["corpus_class", "item_class", "run_len", "errors"],
            )

    return run


def leaked_passages(corpus: DataFrame, items: DataFrame, passage: int = 24, errors: int = 1) -> DataFrame:
    """Pairs of corpus record and item that share a passage with at most ``errors`` edits.

    ``corpus`` and ``items``: id string, text string. Result, one row per pair:
    corpus_id, item_id, run_len (longest run in common that a piece hit showed,
    counted up to one passage on each side) and errors (fewest edits of a passage).
    """
    stretch = passage // (errors + 1)
    grid = max(1, stretch // 6)
    piece = stretch - grid + 1
    side = passage - piece
    corpus, items = (df.where(F.col("text").isNotNull() & F.col("id").isNotNull()).select("id", F.xxhash64("text").alias("class"), "text") for df in (spread(corpus.select("id", "text")), items))
    hit = lambda df, x: df.select("h", F.col("class").alias(f"{x}_class"), F.col("ctx").alias(f"{x}_ctx"))
    pieces = materialize(hit(items.select("class", "text").mapInArrow(_hits(piece, side, grid, _PAD), _HIT), "item"), "leak-pieces")
    hits = hit(corpus.select("class", "text").mapInArrow(_hits(piece, side + errors, 1, _GAP, KeyFilter(pieces, "h")), _HIT), "corpus")
    met = salted_join(pieces, hits, "h", "item_class").select("corpus_class", "corpus_ctx", "item_class", "item_ctx")
    near = materialize(met.mapInArrow(_near(piece, side, passage, errors), "corpus_class long, item_class long").distinct(), "leak-near")
    full = near
    for df, x in ((corpus, "corpus"), (items, "item")):
        keys = materialize(near.select(F.col(f"{x}_class").alias("class")).distinct(), f"leak-{x}-classes")
        rows = materialize(semi_by_key(df, keys, "class"), f"leak-{x}-texts")
        texts = rows.groupBy("class").agg(F.first("text").alias("text"))
        full = full.join(texts.select(F.col("class").alias(f"{x}_class"), F.col("text").alias(f"{x}_text")), f"{x}_class")
        corpus, items = (rows, items) if x == "corpus" else (corpus, rows)
    found = full.mapInArrow(_verify(piece, side, passage, errors), "corpus_class long, item_class long, run_len int, errors int")
    named = lambda df, x: df.select(F.col("class").alias(f"{x}_class"), F.col("id").alias(f"{x}_id")).distinct()
    pairs = found.join(named(items, "item"), "item_class").join(named(corpus, "corpus"), "corpus_class")
    return pairs.groupBy("corpus_id", "item_id").agg(F.max("run_len").alias("run_len"), F.min("errors").alias("errors"))


def leaked_runs(corpus: DataFrame, items: DataFrame, passage: int = 24) -> DataFrame:
    """The pairs that share a run of at least ``passage`` characters: of those the edit matching finds, the unchanged ones."""
    return leaked_passages(corpus, items, passage).where((F.col("errors") == 0) & (F.col("run_len") >= passage)).select("corpus_id", "item_id")
