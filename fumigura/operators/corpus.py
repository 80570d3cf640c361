"""Corpus building: segments, evaluation guard, first-wins dedup, caps, splits, unions, ids and statistics."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType
from pyspark.sql.window import Window

from fumigura.functions import text as T
from fumigura.sources.io import kept

#: Bytes of guard texts up to which they are sent to every task; larger guards are joined.
GUARD_BYTES = 4 << 20


def segments(df: DataFrame, key: str, text: str) -> DataFrame:
    """Quoted parts whole, the rest by sentence: key, line_no, part_no, sent_no, segment, is_dialogue. Blank lines and parts are left out."""
    lines = df.select(key, F.posexplode(F.split(text, r"\r?\n")).alias("line_no", "line")).where(~T.is_blank(F.col("line")))
    parts = lines.select(key, "line_no", F.posexplode(F.filter(T.quoted_parts(T.strip(F.col("line"))), lambda p: p.rlike(r"(?U)\S"))).alias("part_no", "part"))
    part = T.strip(F.col("part"))
    quoted = part.rlike("^(?:「.*」|『.*』)$")
    pieces = F.when(quoted, F.array(part)).otherwise(T.sentences(part))
    out = parts.select(key, "line_no", "part_no", quoted.alias("is_dialogue"), F.posexplode(pieces).alias("sent_no", "segment"))
    return out.select(key, "line_no", "part_no", "sent_no", T.strip(F.col("segment")).alias("segment"), "is_dialogue")


def core_phrases(items: DataFrame) -> DataFrame:
    """Phrases of guard texts: bracket contents of five characters or more, and what stands before the first quotative if six or more."""
    inner = items.select(F.explode(F.regexp_extract_all("text", F.lit("[「『（]([^」』）]+)[」』）]"), F.lit(1))).alias("p")).select(T.strip(F.col("p")).alias("phrase")).where(F.length("phrase") >= 5)
    head = F.split("text", "、と", 2)
    clause = items.where(F.col("text").contains("、と")).select(head[0].alias("h")).where(F.length("h") >= 6).select(T.strip(F.col("h")).alias("phrase"))
    return inner.union(clause).distinct()


def exact_leaks(df: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of ``df`` whose trimmed text is a guard text, or blank."""
    guard = items.where(F.col("text").isNotNull()).select(T.strip(F.col("text")).alias("_g")).distinct()
    return df.join(guard, T.strip(F.col("text")) == F.col("_g"), "left_semi")


def _matcher(guard: list[str], both_ways: bool):
    """mapInArrow: rows whose text holds a guard text; both ways: or lies within one. Two automata, each linear in what it reads."""
    import ahocorasick

    def automaton(words: list[str]):
        out = ahocorasick.Automaton()
        for w in words:
            out.add_word(w, w)
        out.make_automaton()
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, block = automaton(guard), "\0".join(guard)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            keep = [t is not None and next(search.iter(t), None) is not None for t in texts]
            left = {t.strip() for t, k in zip(texts, keep, strict=True) if both_ways and t is not None and not k} - {""}
            if left:
                within = {w for _, w in automaton(sorted(left)).iter(block)}
                keep = [k or (t is not None and t.strip() in within) for t, k in zip(texts, keep, strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def _sizes(least: int, most: int, short: bool) -> list[int]:
    """Sizes of stretches that have keys: ``least`` and its doubles, and if ``short`` each size below."""
    return [*(range(1, least) if short else ()), *(least << i for i in range(64) if least << i <= most)]


def _stretches(texts: list[str], least: int, short: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each of ``_sizes``: the size, and of each stretch of so many characters its text, its place in it and its key."""
    a = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts)), lengths)
    place = np.arange(len(a)) - (np.cumsum(lengths) - lengths)[owner]
    left, h, done = lengths[owner] - place, np.zeros(len(a), np.uint64), 0
    base = 0x9E3779B97F4A7C15
    for n in _sizes(least, int(lengths.max(initial=0)), short):
        m = len(a) - n + 1
        if n == 2 * done and n > least:
            h = h[:m] * np.uint64(pow(base, done, 1 << 64)) + h[done : done + m]
        else:
            for size in range(done + 1, n + 1):
                h = h[: len(a) - size + 1] * np.uint64(base) + a[size - 1 :] + np.uint64(1)
        done, ok = n, left[:m] >= n
        k = h[ok] + np.uint64(n)
        k = (k ^ (k >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        k = (k ^ (k >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        yield n, owner[:m][ok], place[:m][ok], k ^ (k >> np.uint64(31))


def _slices(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """The texts in slices of some 500,000 characters, each with the place of its first."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and size < 500_000:
            size += len(texts[end])
            end += 1
        yield at, texts[at:end]
        at = end


def _heads(texts: list[str], least: int) -> np.ndarray:
    """Key of the longest head of each text that has one; of an empty text 0."""
    out = np.zeros(len(texts), np.uint64)
    for at, part in _slices(texts):
        sizes = _sizes(least, max(map(len, part)), True)
        longest = [sizes[bisect_right(sizes, len(t)) - 1] if t else 0 for t in part]
        part, whole = [t[:n] for t, n in zip(part, longest, strict=True)], np.array(longest)
        for n, owner, place, key in _stretches(part, least, True):
            own = (place == 0) & (whole[owner] == n)
            out[at + owner[own]] = key[own]
    return out


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


class _Sieve:
    """A Bloom filter of keys, 32 bits or more for each (128 MB at most): it lets all of the keys through, and hardly any others while it is not full."""

    probes = (0, 17, 34)  # bits of a key from which on it is read

    def __init__(self, keys: DataFrame) -> None:
        self.bits = min(30, max(20, (32 * keys.count()).bit_length()))
        slots = F.array(*[F.shiftrightunsigned(F.shiftleft("k", p), 64 - self.bits) for p in self.probes])
        one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("s").bitwiseAND(63).cast("int"))
        words = keys.select(F.explode(slots).alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(one).alias("b")).toArrow()  # 2^24 rows at most
        bitmap = np.zeros(1 << (self.bits - 6), np.int64)
        bitmap[words["w"].to_numpy()] = words["b"].to_numpy()
        self._shared = keys.sparkSession.sparkContext.broadcast(bitmap.tobytes())

    def holding(self, keys: np.ndarray) -> np.ndarray:
        """Places of the keys that are let through."""
        words, at = np.frombuffer(self._shared.value, np.uint64), np.arange(len(keys))
        for p in self.probes:
            slot = (keys[at] << np.uint64(p)) >> np.uint64(64 - self.bits)
            at = at[(words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)]
        return at


def _headed(least: int, once: bool = False):
    """mapInArrow: a column of texts -> key of the head and text, empty ones left out; ``once``: the keys alone, each once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t for t in batch.column(0).to_pylist() if t]
            keys = _heads(texts, least)
            if once:
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(keys).view(np.int64))], names=["k"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(texts, pa.string())], names=["k", "other"])

    return run


def _opened(heads: _Sieve, least: int):
    """mapInArrow: phrases -> their stretches that may be heads of texts: key and, of the shorter ones, the stretch, else the phrase from there on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in _slices(batch.column(0).to_pylist()):
                for n, owner, place, key in _stretches(part, least, True):
                    at = heads.holding(key)
                    if n < least:
                        at = at[np.unique(key[at], return_index=True)[1]]
                    found = [part[o][p : p + n if n < least else None] for o, p in zip(owner[at].tolist(), place[at].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(key[at].view(np.int64)), pa.array(found, pa.string())], names=["k", "other"])

    return run


def _candidates(guard: _Sieve, within: _Sieve | None, least: int, names: list[str]):
    """mapInArrow: rows with ``text`` and the trimmed ``_t`` -> columns ``names`` with a key that a phrase begins with, or that opens a stretch of one (``inner``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in _column(batch, "text").to_pylist()]
            rows, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for start, part in _slices(texts):
                for _, owner, _, key in _stretches(part, least, False):
                    at = guard.holding(key)
                    pairs = np.unique(np.rec.fromarrays([owner[at] + start, key[at]]))
                    rows.append(pairs["f0"])
                    keys.append(pairs["f1"])
            n = sum(map(len, rows))
            if within:
                trimmed = [t or "" for t in _column(batch, "_t").to_pylist()]
                heads = _heads(trimmed, least)
                at = within.holding(heads)
                at = at[np.fromiter(map(len, trimmed), np.int64, len(trimmed))[at] > 0]
                rows.append(at)
                keys.append(heads[at])
            chosen = batch.select(names).take(pa.array(np.concatenate(rows)))
            inner = np.arange(len(chosen)) >= n
            yield pa.RecordBatch.from_arrays([*chosen.columns, pa.array(np.concatenate(keys).view(np.int64)), pa.array(inner)], names=[*names, "k", "inner"])

    return run


def _anchored(df: DataFrame, phrases: DataFrame, least: int, both_ways: bool) -> DataFrame:
    """The same by an equi-join on keys of heads, for guards of any size.

    A head has ``least`` characters or the longest double of that, so that a
    stock opening alone meets nothing. Bitmaps of the keys of each side keep
    all other stretches from being written out; the texts themselves decide.
    """
    rows = df.withColumn("_t", T.strip(F.col("text"))) if both_ways else df.withColumn("_t", F.lit(None).cast("string"))
    begun = phrases.mapInArrow(_headed(least), "k long, other string")
    guard, within, others = _Sieve(begun.select("k").distinct()), None, begun.withColumn("inner", F.lit(False))
    if both_ways:
        heads = _Sieve(kept(rows.select("_t").mapInArrow(_headed(least, True), "k long").distinct(), "guard-heads"))
        inner = kept(phrases.mapInArrow(_opened(heads, least), "k long, other string").distinct(), "guard-stretches")
        within, others = _Sieve(inner.select("k").distinct()), others.union(inner.withColumn("inner", F.lit(True)))
    schema = StructType([*df.schema.fields, StructField("k", LongType()), StructField("inner", BooleanType())])
    met = rows.mapInArrow(_candidates(guard, within, least, df.columns), schema).alias("a")
    holds = F.when(F.col("a.inner"), F.col("b.other").startswith(T.strip(F.col("a.text")))).otherwise(F.col("a.text").contains(F.col("b.other")))
    on = (F.col("a.k") == F.col("b.k")) & (F.col("a.inner") == F.col("b.inner")) & holds
    return met.join(others.alias("b"), on, "left_semi").select(*df.columns).distinct()


def substring_leaks(df: DataFrame, guard: DataFrame, least: int, both_ways: bool) -> DataFrame:
    """Rows of ``df`` (id, text) that hold a guard phrase of ``least`` characters or more, or lie within one.

    A guard of up to GUARD_BYTES is sought at once by an automaton in one pass;
    a larger one is joined on keys of heads of ``least`` characters or more.
    """
    phrases = guard.where(F.length("phrase") >= least).select("phrase").distinct()
    size = phrases.agg(F.coalesce(F.sum(F.octet_length("phrase")), F.lit(0))).first()[0]
    if size > GUARD_BYTES:
        return _anchored(df, phrases, least, both_ways)
    words = [r["phrase"] for r in phrases.collect()]  # GUARD_BYTES at most
    return df.mapInArrow(_matcher(words, both_ways), df.schema) if words else df.limit(0)


def first_wins(df: DataFrame, key: Column, *order: str) -> DataFrame:
    """The first row, in ``order``, of each value of ``key``."""
    cols = df.columns
    best = df.withColumn("_k", key).groupBy("_k").agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("r"))
    return best.select(*[F.col("r")[c].alias(c) for c in cols])


def keep_parts(df: DataFrame, group: str, part: str, n: int) -> DataFrame:
    """Whole parts of each group as long as the parts before hold fewer than ``n`` rows: the last one may overshoot."""
    sizes = df.groupBy(group, part).agg(F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = sizes.withColumn("_before", before).where(F.col("_before") < n).select(group, part)
    return df.join(kept, [group, part], "left_semi")


def first_n(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows of a total order: partial top-k by task, then one merge."""
    return df.orderBy(*order).limit(n)


def numbered(df: DataFrame, group: str, key: str, name: str, parts: int = 64) -> DataFrame:
    """Rows numbered from 0 by group in the order of ``key``, as ``name``; no group is sorted in one task.

    Keys are cut into ranges by sampled quantiles (which only balance the work);
    rows are numbered within a range, after the rows of the ranges before.
    """
    cuts = df.select(key).distinct().stat.approxQuantile(key, [i / parts for i in range(1, parts)], 0.001) if df.schema[key].dataType.typeName() != "string" else []
    cuts = sorted(set(cuts))
    place = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col(key))) if cuts else F.lit(0)
    rows = df.withColumn("_part", place)
    before = F.coalesce(F.sum("_rows").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = rows.groupBy(group, "_part").agg(F.count("*").alias("_rows")).withColumn("_start", before).select(group, "_part", "_start")
    inner = F.row_number().over(Window.partitionBy(group, "_part").orderBy(key))
    return rows.withColumn("_n", inner).join(starts, [group, "_part"]).withColumn(name, F.col("_start") + F.col("_n") - 1).drop("_part", "_n", "_start")


def kinds_of_brackets(line: Column) -> Column:
    """array<string>: a line cut before and after each 「…」, 『…』 and （…）."""
    q = "「[^」]*」|『[^』]*』|（[^）]*）"
    return F.regexp_extract_all(line, F.lit(f"(?s){q}|(?:(?!{q}).)+"), F.lit(0))


def bracketed_segments(df: DataFrame, key: str, text: str) -> DataFrame:
    """Like ``segments`` with round brackets as a third kind: key, line_no, part_no, sent_no, segment, kind (dialogue, monologue, narrative)."""
    lines = df.select(key, F.posexplode(F.split(text, r"\r?\n")).alias("line_no", "line")).where(~T.is_blank(F.col("line")))
    parts = lines.select(key, "line_no", F.posexplode(F.filter(kinds_of_brackets(T.strip(F.col("line"))), lambda p: p.rlike(r"(?U)\S"))).alias("part_no", "part"))
    part = T.strip(F.col("part"))
    kind = F.when(part.rlike("^(?:「.*」|『.*』)$"), "dialogue").when(part.rlike("^（.*）$"), "monologue").otherwise("narrative")
    pieces = F.when(kind != "narrative", F.array(part)).otherwise(T.sentences(part))
    out = parts.select(key, "line_no", "part_no", kind.alias("kind"), F.posexplode(pieces).alias("sent_no", "segment"))
    return out.select(key, "line_no", "part_no", "sent_no", T.strip(F.col("segment")).alias("segment"), "kind")


def dialogue_lines(df: DataFrame, key: str, text: str, least: int = 5, most: int = 120, end: str = "") -> DataFrame:
    """Lines cut at 。: key, line_no, sent_no, sentence, is_dialogue.

    A line from 「 to 」 is dialogue: its sentences get the 」 back, others ``end``.
    Pieces of fewer than ``least`` characters and sentences of more than ``most`` are left out.
    """
    lines = df.select(key, F.posexplode(F.split(text, r"\r?\n")).alias("line_no", "line")).select(key, "line_no", T.strip(F.col("line")).alias("line")).where("line <> ''")
    spoken = F.col("line").startswith("「") & F.col("line").endswith("」")
    parts = F.filter(F.transform(F.split("line", "。"), T.strip), lambda s: F.length(s) >= least)
    ended = lambda s: F.when(spoken & ~s.endswith("」"), F.concat(s, F.lit("」"))).when(spoken, s).otherwise(F.concat(s, F.lit(end)))
    out = lines.select(key, "line_no", spoken.alias("is_dialogue"), F.posexplode(F.filter(F.transform(parts, ended), lambda s: F.length(s) <= most)).alias("sent_no", "sentence"))
    return out.select(key, "line_no", "sent_no", "sentence", "is_dialogue")


def first_seen_counts(df: DataFrame, category: str, order: str) -> DataFrame:
    """Counts by category with the place of each in the order of first occurrence."""
    counts = df.groupBy(category).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy("_first", category))).drop("_first")


def ranked_union(parts: list[DataFrame]) -> DataFrame:
    """All parts under each other, with the place of each as ``src_rank``."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("src_rank", F.lit(i))
        out = p if out is None else out.unionByName(p)
    return out


def capped(df: DataFrame, group: str, n: int, *order: str) -> DataFrame:
    """At most ``n`` rows of each group, the first in ``order``; Spark ranks within the map tasks before the shuffle."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def hash_order(df: DataFrame, seed: int, *cols: str) -> DataFrame:
    """All rows in a reproducible random order."""
    return df.orderBy(F.xxhash64(F.lit(seed), *cols), *cols)


def split_by_hash(df: DataFrame, text: str, share: float = 0.9, seed: int = 42) -> DataFrame:
    """Rows with ``split``: train or val by a hash of the text, so that equal texts are never in both."""
    u = F.pmod(F.xxhash64(F.lit(seed), text), F.lit(1_000_000)) / 1_000_000
    return df.withColumn("split", F.when(u < share, "train").otherwise("val"))


def modality_labels(text: Column, is_dialogue: Column) -> Column:
    """array<int> by character: 0 narrative, 1 quoted, 2 in round brackets; dialogue is 1 throughout, or 2 if bracketed as a whole."""
    n = F.length(text)
    whole = F.when(text.rlike("^（.*）$"), 2).otherwise(1)
    quotes, rounds = T.find_spans(text, "「[^」]*」|『[^』]*』"), T.find_spans(text, "（[^）]*）")
    within = lambda spans, i: F.exists(spans, lambda s: (i >= s["start"]) & (i < s["end"]))
    by_char = T.let(F.struct(quotes.alias("q"), rounds.alias("r")), lambda s: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(within(s["r"], i), 2).when(within(s["q"], i), 1).otherwise(0)))
    return F.when(n == 0, F.array().cast("array<int>")).when(is_dialogue, F.array_repeat(whole, n)).otherwise(by_char)


def histogram(df: DataFrame, labels: str) -> DataFrame:
    """Counts and percentages of the values in an array column."""
    counts = df.select(F.explode(labels).alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return counts.select("label", "n", F.round(F.col("n") * 100.0 / total, 4).alias("percent"))
