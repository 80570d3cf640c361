"""Problem 6: near-duplicate records by the share of common character runs.

Token-group matrix. The tokens of a record are its distinct runs of three
characters. Records are partitioned into groups of similar ones: those with the
same two least token hashes, a few at a time. A group stores the union of the
tokens of its members as a bitmap. The matrix of tokens and groups is kept in
sparse form: by token, the groups with a member that has it among its rarest.
A record queries the groups under its own rarest tokens; how many of its tokens
the group's union lacks, and how many follow the shared one, bound the overlap
with every member at once, and only groups whose bound reaches the threshold are
opened. Their members are held against the query by bitmaps of their own, and
exact sets decide.

No grouping loses a pair: two sets of similarity t share a token among the first
n - ceil(t n) + 1 of either in any one order, and a union that lacks a token has
no member with it. Rare is relative to a sketch of the token counts of all
records, which grows with their variety. Copies of one text are one class until
the result is written. Tokens of very many records are split into blocks that
meet in pairs; the matrix is cut into as many parts as its bytes need.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fumigura.llm.common import codes, column, comparison_form, expand, materialize, mix64, semi_by_key, spread

RUN = 3
#: log2 of the slots of the count sketch: the first, and the last of those tried while more than half are in use.
SLOT_BITS = (20, 24)
#: Records under one token beyond which they are split into blocks (or four times the mean of the slots in use).
HOT = 20_000
#: Members of a group.
GROUP = 16
#: Bytes of the matrix in one part.
PART_BYTES = 32 << 20
#: Words of 64 bits of a member's bitmap.
WORDS = 3
#: Texts worked on at once, and pairs compared at once.
SLICE, PAIRS = 8192, 1 << 21
_HASH = np.uint64((1 << 42) - 1)


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        forms = [comparison_form(t) for t in column(batch, "text").to_pylist()]
        h = np.array([xxhash.xxh3_64_intdigest(f) for f in forms], np.uint64)
        lead = np.zeros(len(h), bool)
        lead[np.unique(h, return_index=True)[1]] = True  # the first of its text in this batch
        alike = np.zeros(len(h), np.uint64)
        for s in range(0, len(forms), SLICE):
            _, tok, n = _tokens(forms[s : s + SLICE], None)
            some = np.flatnonzero(n)
            if len(some):
                start = (np.cumsum(n) - n)[some]
                least = np.minimum.reduceat(mix64(tok + np.uint64(1)), start)
                alike[s + some] = mix64(tok[start] ^ least)  # tokens are in order of their hash here
        keep = pa.array([bool(f) for f in forms])
        yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(h.view(np.int64)), pa.array(alike.view(np.int64)), pa.array(lead), pa.array(forms, pa.string())], names=["id", "h", "alike", "lead", "form"]).filter(keep)


def forms(corpus: DataFrame) -> DataFrame:
    """(id, h, alike, lead, form) of the records with a form, in a shared table: ``alike`` is equal for most similar forms."""
    return materialize(spread(corpus.where(F.col("text").isNotNull() & F.col("id").isNotNull()).select("id", "text")).mapInArrow(_forms, "id string, h long, alike long, lead boolean, form string"), "forms")


def _slots(h: np.ndarray, slots: int) -> np.ndarray:
    return (h >> np.uint64(43 - int(slots).bit_length())).astype(np.int64)


def _tokens(texts: list[str], counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens by text, rare ones first: owner, hash of 42 bits, and number by text."""
    a, n = codes(texts)
    m = max(0, len(a) - RUN + 1)
    c = a.astype(np.uint64)
    owner = np.repeat(np.arange(len(n), dtype=np.uint64), n)[:m]
    key = np.zeros(m, np.uint64)
    for j in range(RUN):
        key = key << np.uint64(21) | c[j : j + m]
    ends = np.cumsum(n).astype(np.int64)[owner.astype(np.int64)]
    inside = np.arange(m) + RUN <= ends
    owner, h = owner[inside], mix64(key[inside] + np.uint64(0x9E3779B97F4A7C15)) & _HASH
    level = np.uint64(0) if counts is None else counts[_slots(h, len(counts))].astype(np.uint64)
    s = np.sort(owner << np.uint64(50) | level << np.uint64(42) | h)
    s = s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s
    owner = (s >> np.uint64(50)).astype(np.int64)
    return owner, s & _HASH, np.bincount(owner, minlength=len(n))


def _count(slots: int):
    """mapInArrow: forms -> tokens by slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots, np.int64)
        for batch in batches:
            texts = column(batch, "form").to_pylist()
            for s in range(0, len(texts), SLICE):
                at, n = np.unique(_slots(_tokens(texts[s : s + SLICE], None)[1], slots), return_counts=True)
                total[at] += n
        at = np.flatnonzero(total)
        for s in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[s : s + 100_000].astype(np.int32)), pa.array(total[at[s : s + 100_000]])], names=["slot", "n"])

    return run


def token_counts(table: DataFrame) -> np.ndarray:
    """Records by token, in hashed slots: more of them while more than half are in use."""
    first, last = SLOT_BITS
    for bits in range(first, last + 1, 2):
        got = table.select("form").mapInArrow(_count(1 << bits), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # at most 2^24 rows
        if 2 * len(got) <= 1 << bits:
            break
    counts = np.zeros(1 << bits, np.int64)
    counts[got["slot"].to_numpy()] = got["n"].to_numpy()
    return counts


def _levels(counts: np.ndarray) -> np.ndarray:
    """Counts in 256 logarithmic steps."""
    return np.minimum(255, np.log2(np.maximum(counts, 1)) * 8).astype(np.uint8)


def _postings(t: float, parts: int, levels, blocks):
    """mapInArrow: forms in the order of ``alike`` -> the matrix's entries, packed by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lv = np.frombuffer(levels.value, np.uint8)
        hot_slots = blocks.value  # {slot: number of blocks}; empty but for hot tokens
        hot_at = np.array(sorted(hot_slots), np.int64)
        hot_n = np.array([hot_slots[x] for x in sorted(hot_slots)], np.int64)
        for batch in batches:
            all_forms, all_h, all_alike = column(batch, "form").to_pylist(), column(batch, "h").to_numpy().view(np.uint64), column(batch, "alike").to_numpy()
            for s in range(0, len(all_forms), SLICE):
                h, first = np.unique(all_h[s : s + SLICE], return_index=True)  # copies meet here or in the part
                alike = all_alike[s + first]
                order = np.lexsort(([len(all_forms[s + i]) for i in first], alike))
                h, first, alike = h[order], first[order], alike[order]
                owner, tok, n = _tokens([all_forms[s + i] for i in first], lv)
                bits = np.zeros((len(h), WORDS * 64), bool)
                bits[owner, (tok % np.uint64(WORDS * 64)).astype(np.int64)] = True
                sketch = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
                # groups: up to GROUP records in a row that are alike
                run_start = np.concatenate([[True], alike[1:] != alike[:-1]])
                in_run = np.arange(len(h)) - np.maximum.accumulate(np.where(run_start, np.arange(len(h)), 0))
                starts = np.flatnonzero(in_run % GROUP == 0)
                group = np.repeat(np.arange(len(starts)), np.diff([*starts, len(h)]))
                several = np.bincount(group, minlength=len(starts)) > 1
                start = np.cumsum(n) - n
                prefix = np.where(n > 0, n - np.ceil(t * n - 1e-9).astype(np.int64) + 1, 0)
                at = expand(start, prefix)
                doc, place = owner[at], at - start[owner[at]]
                slot = _slots(tok[at], len(lv))
                tok = tok[at]
                key = (tok & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                if len(hot_at):
                    p = np.searchsorted(hot_at, slot)
                    p[p == len(hot_at)] = 0
                    hot = np.flatnonzero(hot_at[p] == slot)
                    nb = hot_n[p[hot]]
                    mine = (h[doc[hot]] % nb.astype(np.uint64)).astype(np.int64)
                    src, other = np.repeat(hot, nb - 1), expand(np.zeros(len(hot), np.int64), nb - 1)
                    mine = np.repeat(mine, nb - 1)
                    other = other + (other >= mine)
                    cell = (np.minimum(mine, other) << 20 | np.maximum(mine, other)).astype(np.uint64)
                    cold = np.setdiff1d(np.arange(len(doc)), hot, assume_unique=True)
                    new = mix64(tok[src] ^ cell << np.uint64(22)).astype(np.uint32)
                    key = np.concatenate([key[cold], new])
                    doc, place = np.concatenate([doc[cold], doc[src]]), np.concatenate([place[cold], place[src]])
                part = ((key.astype(np.uint64) * np.uint64(2654435761) & np.uint64(0xFFFFFFFF)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                in_part, edges = np.unique(part[order], return_index=True)
                edges = np.append(edges, len(order))
                out_blob = []
                for k in range(len(in_part)):
                    o = order[edges[k] : edges[k + 1]]
                    docs, which = np.unique(doc[o], return_inverse=True)
                    groups, mine = np.unique(group[docs], return_inverse=True)
                    shared = several[groups]
                    local = np.where(shared, np.cumsum(shared) - 1, 65535)[mine]
                    head = np.array([len(docs), len(o), shared.sum()], np.int64)
                    out_blob.append(b"".join(x.tobytes() for x in (head, h[docs], sketch[docs], n[docs].astype(np.uint32), key[o], local.astype(np.uint16), which.astype(np.uint16), np.minimum(place[o], 65535).astype(np.uint16))))
                yield pa.RecordBatch.from_arrays([pa.array(in_part.astype(np.int32)), pa.array(out_blob, pa.binary())], names=["part", "blob"])

    return run


def _unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    """Number of groups, then h, sketch, n, key, group, doc and place of the entries of one block."""
    d, p, g = np.frombuffer(blob, np.int64, 3)
    out, at = [g], 24
    for kind, width, count in ((np.uint64, 1, d), (np.uint64, WORDS, d), (np.uint32, 1, d), (np.uint32, 1, p), (np.uint16, 1, d), (np.uint16, 1, p), (np.uint16, 1, p)):
        x = np.frombuffer(blob, kind, count * width, at)
        out.append(x.reshape(-1, WORDS) if width > 1 else x)
        at += x.nbytes
    return tuple(out)


def _chunks(count: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """Ranges (from, to, offset, counts) of rows with about ``PAIRS`` of ``count`` in all; one row alone may be cut."""
    sums = np.concatenate([[0], np.cumsum(count)])
    i = 0
    while i < len(count):
        e = max(i + 1, int(np.searchsorted(sums, sums[i] + PAIRS, "right")) - 1)
        if e > i + 1:
            yield i, e, 0, count[i:e]
        else:
            for lo in range(0, int(count[i]), PAIRS):
                yield i, e, lo, np.minimum(count[i:e] - lo, PAIRS)
        i = e


def _open_groups(t: float):
    """mapInArrow: entries of one part -> candidate pairs of classes, from the groups whose bound reaches ``t``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: list[tuple[np.ndarray, ...]] = [_unpack(x) for batch in batches for x in column(batch, "blob").to_pylist()]
        if not blocks:
            return
        h, sketch, n, key, local, which, place = (np.concatenate([b[k] for b in blocks]) for k in range(1, 8))
        docs, groups = np.array([len(b[1]) for b in blocks]), np.array([b[0] for b in blocks])
        doc = which.astype(np.int64) + np.repeat(np.cumsum(docs) - docs, [len(b[4]) for b in blocks])
        group = np.where(local == 65535, groups.sum() + np.arange(len(h)), local + np.repeat(np.cumsum(groups) - groups, docs))
        del blocks
        # copies of one text, from several batches, become one member
        h, first, same = np.unique(h, return_index=True, return_inverse=True)
        sketch, n, group = sketch[first], n[first].astype(np.int64), group[first]
        _, first = np.unique(key.astype(np.uint64) << np.uint64(32) | same[doc].astype(np.uint64), return_index=True)
        key, doc, place = key[first].astype(np.uint64) << np.uint64(32), same[doc[first]], place[first].astype(np.int64)
        # under a token: by the least member of the group, then by group, then by size
        _, group = np.unique(group, return_inverse=True)
        least = np.full(group.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, group, n)
        rank = np.empty(len(h), np.uint64)
        rank[np.lexsort((n, group, least[group]))] = np.arange(len(h), dtype=np.uint64)
        order = np.argsort(key | rank[doc])
        key, doc, place = key[order], doc[order], place[order]
        size, mine = n[doc], group[doc]
        # the largest partner whose overlap can still reach the threshold from this place on
        most = np.floor((size - place) * ((1 + t) / t) + 1e-6).astype(np.int64) - size
        most = np.clip(np.minimum(most, np.floor(size / t + 1e-6).astype(np.int64)), 0, 0xFFFFFFFF)
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (mine[1:] != mine[:-1])])
        begin = np.flatnonzero(new)  # of the groups under each token
        end = np.append(begin[1:], len(key))
        lone = end - begin == 1
        seg = np.cumsum(new) - 1
        small, large = size[begin], size[end - 1]
        reach = np.searchsorted(key[begin] | least[mine[begin]].astype(np.uint64), key | most.astype(np.uint64), "right")
        words = [np.ascontiguousarray(sketch[:, w])[doc] for w in range(WORDS)]
        # token unions: a group of one has its member's; members without the token count under another
        unions = [np.bitwise_or.reduceat(w, begin) for w in words]
        everything = np.where(lone, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
        slack, share = (1 - t) / (1 + t), t / (1 + t)

        def pairs(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            ok = np.flatnonzero((most[right] >= size[left]) & (most[left] >= size[right]) & (doc[left] != doc[right]))
            left, right = left[ok], right[ok]
            far = np.bitwise_count(words[0][left] ^ words[0][right]).astype(np.int64)
            for w in words[1:]:
                far += np.bitwise_count(w[left] ^ w[right])
            ok = far <= (size[left] + size[right]) * slack + 1e-6
            return left[ok], right[ok]

        def batch(left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
            x, y = h[doc[left]].view(np.int64), h[doc[right]].view(np.int64)
            u = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(u[:, 0]), pa.array(u[:, 1])], names=["a", "b"])

        # members of one group
        for i, e, lo, c in _chunks(end[seg] - np.arange(len(key)) - 1):
            left, right = pairs(np.repeat(np.arange(i, e), c), expand(np.arange(i, e) + 1 + lo, c))
            if len(left):
                yield batch(left, right)
        # a query against the groups behind its own
        for i, e, lo, c in _chunks(np.maximum(0, reach - seg - 1)):
            query, other = np.repeat(np.arange(i, e), c), expand(seg[i:e] + 1 + lo, c)
            n_q = size[query]
            # a group of one: all that differs; else the query's tokens that the union lacks
            most_far = np.where(lone[other], (n_q + small[other]) * slack, n_q - share * (n_q + np.maximum(small[other], t * n_q))) + 1e-6
            far = np.zeros(len(query), np.uint8)
            for w, u in zip(words, unions, strict=True):
                q = w[query]
                far = far + np.bitwise_count((q ^ u[other]) & (q | everything[other]))
                ok = np.flatnonzero(far <= most_far)
                query, other, far, most_far = query[ok], other[ok], far[ok], most_far[ok]
            ok = large[other] >= t * size[query] - 1e-6
            query, other = query[ok], other[ok]
            count = end[other] - begin[other]
            for j, f, low, d in _chunks(count):
                left, right = pairs(np.repeat(query[j:f], d), expand(begin[other[j:f]] + low, d))
                if len(left):
                    yield batch(left, right)

    return run


def _exact(t: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(column(batch, "form_a").to_pylist(), column(batch, "form_b").to_pylist(), strict=True):
                p, q = ({f[i : i + RUN] for i in range(len(f) - RUN + 1)} for f in (x, y))
                c = len(p & q)
                keep.append(bool(c) and c >= t * (len(p) + len(q) - c) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def class_pairs(table: DataFrame, t: float = 0.70) -> DataFrame:
    """Pairs (a < b) of classes of equal forms whose similarity is at least ``t``."""
    spark = table.sparkSession
    counts = token_counts(table)
    used = np.flatnonzero(counts)
    limit = max(HOT, 4 * int(counts[used].mean()) if len(used) else 0)
    hot = {int(s): int(math.ceil(counts[s] / limit)) for s in np.flatnonzero(counts > limit)}
    levels, blocks = spark.sparkContext.broadcast(_levels(counts).tobytes()), spark.sparkContext.broadcast(hot)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    entries = int(counts.sum() * (1 - t))
    parts = max(least, -(-entries * (14 + 8 * WORDS) // PART_BYTES))
    # similar records side by side; a family of very many is spread by the hash of its texts
    leads = table.where("lead").select("alike", "h", "form")
    many = max(50_000, table.count() // 10_000)
    families = leads.groupBy("alike").count().where(F.col("count") > many).select("alike", (F.col("count") / many + 1).cast("int").alias("spread"))
    near = leads.join(F.broadcast(families), "alike", "left")  # at most 10,000 rows
    near = near.repartition(least, "alike", F.pmod("h", F.coalesce("spread", F.lit(1)))).sortWithinPartitions("alike")
    packed = near.select("h", "alike", "form").mapInArrow(_postings(t, parts, levels, blocks), "part int, blob binary")
    candidates = materialize(packed.repartitionById(parts, F.col("part")).mapInArrow(_open_groups(t), "a long, b long").distinct(), "neardup-candidates")
    keys = materialize(candidates.select(F.explode(F.array("a", "b")).alias("h")).distinct(), "neardup-keys")
    reps = materialize(semi_by_key(table.select("h", "form"), keys, "h").groupBy("h").agg(F.min("form").alias("form")), "neardup-forms")
    full = candidates.join(reps.select(F.col("h").alias("a"), F.col("form").alias("form_a")), "a").join(reps.select(F.col("h").alias("b"), F.col("form").alias("form_b")), "b")
    return materialize(full.mapInArrow(_exact(t), "a long, b long"), "neardup-pairs")


def _members(table: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, h) of the classes in ``pairs``, and of the classes of several ids."""
    ids = table.select("id", "h").distinct()
    copies = ids.groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("h")
    keys = materialize(pairs.select(F.explode(F.array("a", "b")).alias("h")).union(copies).distinct(), "neardup-members")
    members = materialize(semi_by_key(table.select("id", "h", "form"), keys, "h").select("id", "h", F.xxhash64("form").alias("h2")).distinct(), "neardup-ids")
    return members, members.groupBy("h", "h2").count().where("count > 1").drop("count")


def near_duplicate_pairs(corpus: DataFrame, t: float = 0.70) -> DataFrame:
    """All pairs id_a < id_b of different ids with similarity at least ``t``, copies included.

    Null ids and texts, and texts with an empty form, are in no pair; forms
    shorter than a run pair only with their equals. Repeated rows count once.
    """
    table = forms(corpus)
    pairs = class_pairs(table, t)
    members, copied = _members(table, pairs)
    a, b = members.select(F.col("h").alias("a"), F.col("id").alias("x")), members.select(F.col("h").alias("b"), F.col("id").alias("y"))
    linked = pairs.join(a, "a").join(b, "b").select("x", "y")
    many = members.join(copied, ["h", "h2"])
    same = many.select("h", "h2", F.col("id").alias("x")).join(many.select("h", "h2", F.col("id").alias("y")), ["h", "h2"]).where("x < y").select("x", "y")
    out = linked.union(same).where("x <> y")
    return out.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def components(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of the graph of ``pairs``: the least node of each connected component.

    Alternating large-star and small-star steps, each cut by a shared table.
    """
    edges = materialize(pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "cc-0")
    nodes = edges
    before = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        edges = materialize(small.select("v", "m").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).distinct(), "cc")
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if now == before:
            break
        before = now
    roots = edges.groupBy("u").agg(F.min("v").alias("root"))
    every = nodes.select("u").union(nodes.select(F.col("v").alias("u"))).distinct()
    return every.join(roots, "u", "left").select(F.col("u").alias("node"), F.coalesce("root", "u").alias("root"))


def near_duplicate_groups(corpus: DataFrame, t: float = 0.70) -> DataFrame:
    """One row per record with a form: id, group_id (least id of its group) and links.

    ``links`` counts the other texts it is similar to, copies of a text counted
    as one; records alone have themselves as group.
    """
    table = forms(corpus)
    pairs = class_pairs(table, t)
    roots = components(pairs)
    degree = pairs.select(F.explode(F.array("a", "b")).alias("h")).groupBy("h").agg(F.count("*").alias("links"))
    ids = table.select("id", "h").distinct().join(roots.select(F.col("node").alias("h"), "root"), "h", "left").join(degree, "h", "left")
    ids = ids.select("id", F.coalesce("root", "h").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    least = ids.groupBy("root").agg(F.min("id").alias("group_id"))
    return ids.join(least, "root").select("id", "group_id", "links")
