"""Predicate-argument scores of a sentence by biaffine forms, and what follows from them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The cases scored, in order.
CASES = ["ガ", "ガ２", "ヲ", "ニ", "ト", "デ", "カラ", "ヨリ", "ヘ", "マデ"]


_SENTENCE = re.compile("[^。\n!！?？]*[。\n!！?？]|[^。\n!！?？]+$")


def weights(dim: int, cases: int = len(CASES), seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random weights within the usual bound: predicate and argument projections, and one form by case."""
    rng = np.random.default_rng(seed)
    bound = np.sqrt(3 / dim)
    return tuple(rng.uniform(-bound, bound, s) for s in ((dim, dim), (dim, dim), (cases, dim, dim)))


def forward(h: np.ndarray, w: tuple[np.ndarray, np.ndarray, np.ndarray], polyphony: float = 0.0, jumps: list[dict] | None = None, gain: float = 0.8, loss: float = 0.6) -> np.ndarray:
    """scores[case, predicate, argument] of hidden states; far pairs lose under high polyphony, spans of a semantic jump gain or lose."""
    p, a = h @ w[0], h @ w[1]
    scores = np.einsum("ik,ckl,jl->cij", p, w[2], a, optimize=True)
    n = len(h)
    far = np.abs(np.subtract.outer(np.arange(n), np.arange(n))) > 15
    cost = 0.35 * min(1.0, (polyphony - 65) / 35) if jumps is not None and polyphony >= 65 else 0.0
    scores -= cost * far
    aligned = {1: (0, 1), 2: (1, 2), 3: (2, 3)}
    for j in jumps or []:
        v, s = j["verbtokenidx"], j["nountokenidx"]
        if 0 <= v < n and 0 <= s < n:
            for c in aligned.get(j["casemarker"], ()):
                if j["jumpdegree"] < 40:
                    scores[c, v, s] += gain + cost * far[v, s]
                elif j["jumpdegree"] >= 80:
                    scores[c, v, s] -= loss * j["jumpdegree"] / 100
    return scores


def normalized(scores: np.ndarray, temperature: float = 1.0, distortion: float = 0.1, softmax: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Shares over the arguments, and the score of an omitted argument; subject cases lose with distances over 32."""
    n = scores.shape[1]
    s = scores / max(temperature, 1e-5)
    far = np.maximum(0, np.abs(np.subtract.outer(np.arange(n), np.arange(n))) - 32)
    s[:2] -= distortion * far
    if softmax:
        e = np.exp(s - s.max(-1, keepdims=True))
        out = e / np.maximum(e.sum(-1, keepdims=True), 1e-9)
    else:
        out = 1 / (1 + np.exp(-s))
    return out, np.maximum(0, 1 - out.max(-1))


def relations(scores: np.ndarray, predicates: list[int], threshold: float = 0.15, zero_threshold: float = 0.3) -> list[tuple[int, str, int | None, float, bool]]:
    """(predicate, case, argument or None, score, is_zero): the best argument over the threshold, else an omitted subject."""
    share, zero = normalized(scores.copy())
    out = []
    for i in predicates:
        for c, name in enumerate(CASES):
            j = int(share[c, i].argmax())  # the first of equals
            if share[c, i, j] >= threshold:
                out.append((i, name, j, float(share[c, i, j]), False))
            elif c < 2 and zero[c, i] >= zero_threshold:
                out.append((i, name, None, float(zero[c, i]), True))
    return out


def row_relations(h: np.ndarray, w: tuple[np.ndarray, np.ndarray, np.ndarray], i: int, threshold: float = 0.15, zero_threshold: float = 0.3) -> list[tuple[int, str, int | None, float, bool]]:
    """The relations of one predicate, as ``relations(forward(h, w), [i])`` has them; linear in the length."""
    s = (h[i] @ w[0] @ w[2]) @ (h @ w[1]).T
    s[:2] -= 0.1 * np.maximum(0, np.abs(np.arange(len(h)) - i) - 32)
    e = np.exp(s - s.max(-1, keepdims=True))
    share = e / np.maximum(e.sum(-1, keepdims=True), 1e-9)
    out = []
    for c, name in enumerate(CASES):
        j = int(share[c].argmax())  # the first of equals
        top = float(share[c, j])
        if top >= threshold:
            out.append((i, name, j, top, False))
        elif c < 2 and max(0.0, 1 - top) >= zero_threshold:
            out.append((i, name, None, max(0.0, 1 - top), True))
    return out


def scored(df: DataFrame, dim: int = 16, seed: int = 0) -> DataFrame:
    """(id, text) -> one row per relation of the last predicate of each sentence, over character states made by hashing; positions in the text."""
    w = weights(dim, seed=seed)
    table = np.random.default_rng(seed + 1).normal(size=(1024, dim)) / np.sqrt(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if t:
                    for m in _SENTENCE.finditer(t):
                        if m.group().isspace():
                            continue
                        start, h = m.start(), table[[ord(ch) % 1024 for ch in m.group()]]
                        last = max(0, len(h) - 2)
                        rows += [(key, start + i, c, None if j is None else start + j, round(s, 6), z) for i, c, j, s, z in row_relations(h, w, last)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = (b.schema.field(0).type, pa.int32(), pa.string(), pa.int32(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["id", "predicate", "case_name", "argument", "score", "is_zero"])

    kind = df.schema["id"].dataType.simpleString()
    return df.select("id", "text").mapInArrow(run, f"id {kind}, predicate int, case_name string, argument int, score double, is_zero boolean")


def reshaped(df: DataFrame, key: str, flat: str, cases: int, length: int) -> DataFrame:
    """(key, case_idx, i, j, value) of a flat tensor [case][i][j]; what it lacks is 0."""
    cells = df.select(key, F.col(flat).alias("v"), F.explode(F.sequence(F.lit(0), F.lit(cases * length * length - 1))).alias("at"))
    return cells.select(key, F.floor(F.col("at") / (length * length)).cast("int").alias("case_idx"), F.floor(F.pmod("at", F.lit(length * length)) / length).cast("int").alias("i"), F.pmod("at", F.lit(length)).alias("j"), F.coalesce(F.get("v", F.col("at")), F.lit(0.0)).alias("value"))


def subtrees(df: DataFrame, key: str, heads: str) -> DataFrame:
    """(key, node, first, last, size) of the subtree under each node of an array of heads; a node is in its own, a head outside the array or of itself is none, cycles are walked once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple[int, int, int, int, int]] = []
            for r, hs in enumerate(b.column(1).to_pylist()):
                under: list[list[int]] = [[] for _ in hs or []]
                for i, h in enumerate(hs or []):
                    if h is not None and 0 <= h < len(under) and h != i:
                        under[h].append(i)
                for node, kids in enumerate(under):
                    seen, todo = {node}, list(kids)
                    while todo:
                        x = todo.pop()
                        if x not in seen:
                            seen.add(x)
                            todo += under[x]
                    rows.append((r, node, min(seen), max(seen), len(seen)))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(c, pa.int32()) for c in cols[1:])], names=["key", "node", "first", "last", "size"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), heads).mapInArrow(run, f"key {kind}, node int, first int, last int, size int").withColumnRenamed("key", key)
