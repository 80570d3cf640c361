"""Problem 3: records of evaluation splits that stand in the training split.

Equal records meet by the hash of their canonical form. Records that are almost
equal can't: for them each training form is cut into one piece more than the
edits it may have, a piece must occur unchanged in the evaluation form, shifted
by no more than the edits before it; the hashes of the pieces are joined, a
sketch of the characters bounds the edits, and a bit-vector edit distance decides.

Null and empty forms overlap with nothing. Rows delivered twice count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fumigura.llm.common import KeyFilter, class_representatives, codes, column, comparison_form, edit_distance_at_most, materialize, mix64, salted_join, semi_by_key, spread, window_hashes

_FORM = "rec_id long, source string, h long, hc long, form string"
_PIECE = "k long, h long, sketch long, len int, pos int, nth int"


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        forms = [comparison_form(t) for t in column(batch, "text").to_pylist()]
        h, hc = (pa.array(np.array([xxhash.xxh3_64_intdigest(f) for f in x], np.uint64).view(np.int64)) for x in (forms, [f.casefold() for f in forms]))
        yield pa.RecordBatch.from_arrays([column(batch, "rec_id"), column(batch, "source"), h, hc, pa.array(forms, pa.string())], names=["rec_id", "source", "h", "hc", "form"]).filter(pa.array([bool(f) for f in forms]))


def forms(records: DataFrame, name: str) -> DataFrame:
    """(rec_id, source, h, hc, form) of the records with a form; hc is the hash without letter case."""
    return materialize(spread(records.where(F.col("text").isNotNull() & F.col("rec_id").isNotNull()).select("rec_id", "source", "text")).mapInArrow(_forms, _FORM), name)


def budget(length, tenths: int):
    """Edits allowed for a longer form of ``length``."""
    return length * tenths // 10_000


def piece_plan(length: int, tenths: int) -> tuple[int, int]:
    """Number and length of the pieces of a form: one more than the edits it may have with any partner."""
    pieces = budget(length * 10_000 // (10_000 - tenths), tenths) + 1
    return pieces, length // pieces


def _sketches(a: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Parity of the characters in 64 buckets; an edit flips two bits at most."""
    bits = np.uint64(1) << (mix64(a.astype(np.uint64)) & np.uint64(63))
    out = np.zeros(len(n), np.uint64)
    np.bitwise_xor.at(out, np.repeat(np.arange(len(n)), n), bits)
    return out.view(np.int64)


def _pieces(tenths: int, of_training: bool, wanted: KeyFilter | None = None):
    """mapInArrow: (h, form) -> pieces of training forms, or all windows of evaluation forms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, h = column(batch, "form").to_pylist(), column(batch, "h").to_numpy()
            a, n = codes(texts)
            sketch = _sketches(a, n)
            longest = int(n.max(initial=0))
            plan = np.array([piece_plan(i, tenths) if i else (1, 1) for i in range(longest * 10_000 // (10_000 - tenths) + 1)], np.int64)
            for q in np.unique(plan[1:, 1]):
                if of_training:
                    rows = np.flatnonzero((plan[n, 1] == q) & (n > 0))
                else:  # of partners whose pieces have this length
                    lengths = np.flatnonzero(plan[:, 1] == q)
                    lengths = lengths[lengths > 0]
                    lo, hi = n - budget(n, tenths), n * 10_000 // (10_000 - tenths)
                    rows = np.flatnonzero(np.searchsorted(lengths, hi, "right") > np.searchsorted(lengths, lo, "left"))
                if not len(rows):
                    continue
                b, m = codes([texts[i] for i in rows])
                k, owner, pos = window_hashes(b, m, int(q))
                k = mix64(k + np.uint64(q))
                who = rows[owner]
                nth = pos // q
                if of_training:
                    keep = (pos % q == 0) & (nth < plan[n[who], 0]) & wanted.may_hold(k)
                    k, who, pos, nth = k[keep], who[keep], pos[keep], nth[keep]
                for s in range(0, len(k), 200_000):
                    e = slice(s, s + 200_000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(k[e].view(np.int64)), pa.array(h[who[e]]), pa.array(sketch[who[e]]), *(pa.array(x.astype(np.int32)) for x in (n[who[e]], pos[e], nth[e]))],
                        names=["k", "h", "sketch", "len", "pos", "nth"],
                    )

    return run


def _near(tenths: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [edit_distance_at_most(x, y, budget(max(len(x), len(y)), tenths)) for x, y in zip(column(batch, "form_a").to_pylist(), column(batch, "form_b").to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def near_classes(train: DataFrame, val: DataFrame, share: float = 0.10) -> DataFrame:
    """(a, b): hashes of different forms of training and evaluation within ``share`` of the longer one's length in edits."""
    spark, tenths = train.sparkSession, round(share * 10_000)
    one_t, one_v = class_representatives(train, "rec_id", "h").select("h", "form"), class_representatives(val, "rec_id", "h").select("h", "form")
    windows = materialize(one_v.mapInArrow(_pieces(tenths, False), _PIECE).drop("nth"), "overlap-windows")
    pieces = one_t.mapInArrow(_pieces(tenths, True, KeyFilter(windows, "k")), _PIECE)
    v = windows.select("k", *(F.col(c).alias(f"v_{c}") for c in ("h", "sketch", "len", "pos")))
    edits = F.floor(F.greatest("len", "v_len") * tenths / 10_000)
    shift, longer = F.col("v_pos") - F.col("pos"), F.col("v_len") - F.col("len")
    meets = (F.abs(shift) <= F.col("nth")) & (F.abs(longer - shift) <= edits - F.col("nth")) & (F.bit_count(F.col("sketch").bitwiseXOR(F.col("v_sketch"))) <= edits * 2) & (F.col("h") != F.col("v_h"))
    pairs = materialize(salted_join(v, pieces, "k", "v_h").where(meets).select(F.col("h").alias("a"), F.col("v_h").alias("b")).distinct(), "overlap-candidates")
    for split, key in ((train, "a"), (val, "b")):
        keys = materialize(pairs.select(F.col(key).alias("h")).distinct(), "overlap-keys")
        texts = semi_by_key(split.select("h", "form"), keys, "h").groupBy("h").agg(F.min("form").alias("form"))
        pairs = pairs.join(texts.select(F.col("h").alias(key), F.col("form").alias(f"form_{key}")), key)
    return materialize(pairs.mapInArrow(_near(tenths), "a long, b long"), "overlap-near")


def overlaps(train: DataFrame, val: DataFrame, share: float = 0.10) -> DataFrame:
    """(rec_id_a, rec_id_b, kind): records of ``val`` that stand in ``train``; kind is equal or near.

    Inputs: rec_id long, source string, text string.
    """
    t, v = forms(train, "overlap-train"), forms(val, "overlap-val")
    both = lambda df: df.select("rec_id", "h", F.xxhash64("form").alias("h2"))
    equal = both(t).withColumnRenamed("rec_id", "rec_id_a").join(both(v).withColumnRenamed("rec_id", "rec_id_b"), ["h", "h2"]).select("rec_id_a", "rec_id_b", F.lit("equal").alias("kind"))
    pairs = near_classes(t, v, share)
    near = pairs.join(t.select(F.col("h").alias("a"), F.col("rec_id").alias("rec_id_a")), "a").join(v.select(F.col("h").alias("b"), F.col("rec_id").alias("rec_id_b")), "b").select("rec_id_a", "rec_id_b", F.lit("near").alias("kind"))
    return equal.union(near).distinct()


def overlap_report(train: DataFrame, val: DataFrame, share: float = 0.10) -> DataFrame:
    """By split and source: records, those equal without letter case to one of the other split, and those equal or near one.

    Counted by class of equal forms; no pairs of records are made.
    """
    t, v = forms(train, "overlap-train"), forms(val, "overlap-val")
    pairs = near_classes(t, v, share)
    out = None
    for split, df, f, other, key in (("train", train, t, v, "a"), ("val", val, v, t, "b")):
        equal = other.select("hc").distinct().withColumn("equal", F.lit(1))
        near = pairs.select(F.col(key).alias("h")).distinct().withColumn("near", F.lit(1))
        same = other.select("h").distinct().withColumn("same", F.lit(1))
        marks = f.select("rec_id", "h", "hc").distinct().join(equal, "hc", "left").join(near, "h", "left").join(same, "h", "left")
        marks = marks.groupBy("rec_id").agg(F.max("equal").alias("equal"), F.max(F.coalesce("near", "same", "equal")).alias("near"))
        rows = df.select("rec_id", "source").where("rec_id is not null").dropDuplicates(["rec_id"]).join(marks, "rec_id", "left")
        part = rows.groupBy("source").agg(F.count("*").alias("records"), F.count("equal").alias("equal_records"), F.count("near").alias("overlapping_records")).select(F.lit(split).alias("split"), "source", "records", "equal_records", "overlapping_records")
        out = part if out is None else out.union(part)
    return out
