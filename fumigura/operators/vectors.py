"""Kernels on vectors, as expressions, and statistics over their columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quantized(v: Column, scale: float, zero: int = 0) -> Column:
    """array<int> of eight bits; halves are rounded up."""
    return F.transform(v, lambda x: F.greatest(F.lit(-128), F.least(F.lit(127), (F.floor(x.cast("double") / scale + 0.5) + zero).cast("int"))))


def dequantized(v: Column, scale: float, zero: int = 0) -> Column:
    return F.transform(v, lambda x: (x - zero) * scale)


def dot(a: Column, b: Column) -> Column:
    """Sum of products; vectors of different length give null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def correlations(df: DataFrame, v: str, dims: int) -> DataFrame:
    """(i, j, corr) of the first ``dims`` columns, in one pass without shuffling the vectors."""
    pairs = [(i, j) for i in range(dims) for j in range(i, dims)]
    one = df.agg(*[F.corr(F.element_at(v, i + 1).cast("double"), F.element_at(v, j + 1).cast("double")).alias(f"c{i}_{j}") for i, j in pairs])
    return one.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"c{i}_{j}").alias("corr")) for i, j in pairs])).alias("x")).select("x.*")


def spectrum(df: DataFrame, v: str, dims: int) -> DataFrame:
    """Effective rank, condition number and shares of variance of the standardised columns, from their correlation matrix (dims by dims)."""
    c = np.eye(dims)
    for r in correlations(df, v, dims).collect():
        if r["i"] != r["j"]:  # columns without variance correlate with nothing
            c[r["i"], r["j"]] = c[r["j"], r["i"]] = 0.0 if r["corr"] is None or np.isnan(r["corr"]) else r["corr"]
    s = np.sqrt(np.maximum(np.linalg.eigvalsh(c), 0))[::-1]
    p = s / s.sum()
    rank = float(np.exp(-(p[p > 0] * np.log(p[p > 0])).sum()))
    return df.sparkSession.createDataFrame([(dims, round(rank, 6), round(float(s[0] / max(s[-1], 1e-12)), 6), [round(float(x), 6) for x in s**2 / (s**2).sum()])], "dims int, effective_rank double, condition_number double, variance_explained array<double>")


def recurrent_core(df: DataFrame, ids: str, vocab: int = 256, dim: int = 64, seed: int = 0, weights: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """(id, ids) -> (id, best): the likeliest next token of a small recurrent core after each sequence; ids outside the vocabulary are cut to it.

    ``weights``: embedding (vocab, dim), recurrence (dim, dim) and output (vocab, dim); random by ``seed`` if none are given.
    """
    rng = np.random.default_rng(seed)
    e, w, out = weights or tuple(rng.normal(size=size) * 0.1 for size in ((vocab, dim), (dim, dim), (vocab, dim)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [np.clip(np.array(seq or [], np.int64), 0, vocab - 1) for seq in b.column(1).to_pylist()]
            order = np.argsort([-len(r) for r in rows], kind="stable")  # longest first: those still running stay in front
            long = np.array([len(rows[k]) for k in order])
            h = np.zeros((len(rows), dim))
            for t in range(long[0] if len(long) else 0):
                n = int(np.searchsorted(-long, -t, "left"))
                h[:n] = 0.5 * h[:n] + 0.5 * np.maximum(0, (h[:n] + e[[rows[k][t] for k in order[:n]]]) @ w.T)
            best = np.empty(len(rows), np.int32)
            best[order] = (h @ out.T).argmax(1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(best, pa.int32())], names=["id", "best"])

    kind = df.schema["id"].dataType.simpleString()
    return df.select("id", ids).mapInArrow(run, f"id {kind}, best int")
