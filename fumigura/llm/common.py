"""Helpers shared by the training-data operators: shared-storage tables, text
forms, and numpy kernels over batches of texts."""

from __future__ import annotations

import atexit
import re
import tempfile
import unicodedata
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Keys of a filter set up to this count are broadcast; larger ones are joined by shuffle.
BROADCAST_KEYS = 200_000

_MARKUP = re.compile("《[^》]*》|｜|［＃[^］]*］")
_NOT_ALNUM = re.compile(r"[\W_]+")


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of the input directory, pruned to ``columns`` if any are named."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where none is set a local one is, but only in local mode: on a cluster each
    executor would write to its own disk.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="fumigura-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone; the folder belongs to the cluster
        pass


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a table in the shared folder and return it read back.

    Cuts lineage and survives the loss of executors. Removed at exit.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/fumigura/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Repartition a scan of fewer splits than cores, so that Python stages use all of them.

    A plan that shuffles is left alone: to ask for its partitions would run it.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def distinct_spread(df: DataFrame) -> DataFrame:
    """Distinct rows in as many partitions as shuffles have, not fewer: what follows is costlier than its size tells."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *df.columns).distinct()


#: Bits of a key filter: eight for each key, but no fewer and no more than 2 to the power of these.
FILTER_BITS = (20, 30)


class KeyFilter:
    """A bitmap of the keys of one side of a join, sized from their number, for the other side to skip rows by.

    It never drops a row that has a partner. Beyond 2^30 bits (128 MB) it lets
    more and more pass; the join that follows is exact either way.
    """

    def __init__(self, keys: DataFrame, key: str) -> None:
        self.bits = min(FILTER_BITS[1], max(FILTER_BITS[0], (8 * keys.count()).bit_length()))
        slot = F.shiftrightunsigned(key, 64 - self.bits)
        one = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int"))
        words = keys.groupBy(F.shiftright(slot, 6).alias("w")).agg(F.bit_or(one).alias("b")).toArrow()  # at most 2^24 rows
        bitmap = np.zeros(1 << (self.bits - 6), np.int64)
        bitmap[words["w"].to_numpy()] = words["b"].to_numpy()
        self._shared = keys.sparkSession.sparkContext.broadcast(bitmap.tobytes())

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        words = np.frombuffer(self._shared.value, np.uint64)
        slot = keys >> np.uint64(64 - self.bits)
        return (words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


#: Bits of a dice, and bits by which one level of ``first_by_dice`` narrows its range.
DICE_BITS, LEVEL_BITS = 60, 12
#: Rows of a range beyond which it is narrowed once more.
EDGE_ROWS = 20_000


def dice(*columns) -> Column:
    """A hash of ``columns`` read as a number of ``DICE_BITS`` bits."""
    return F.xxhash64(*columns).bitwiseAND((1 << DICE_BITS) - 1)


def first_by_dice(rows: DataFrame, group: str, key: list[str], weight, need: dict) -> DataFrame:
    """``rows`` with the column ``first``: whether the weights in the order of the dice, by group, add up to ``need`` at most.

    ``rows`` is a table on storage with the columns ``group``, ``dice`` and
    ``key``; ``weight`` is an expression on it. No group is sorted: sums over
    4,096 ranges of the dice show in which range the sum is reached, that one
    is narrowed until it holds few rows, and only they are put in order.
    ``need`` has an entry for each group asked for.
    """
    spark = rows.sparkSession
    kind = rows.schema[group].dataType.simpleString()
    weight = weight if weight is not None else F.lit(1)
    edges = {g: (0, DICE_BITS, 0.0) for g in need}  # start of the range, log2 of its width, weights before it
    open_ = set(need)
    while open_:
        at = spark.createDataFrame([(g, edges[g][0], edges[g][1], float(edges[g][2]), float(need[g])) for g in sorted(open_)], f"{group} {kind}, _lo long, _width int, _before double, _need double")
        inside = rows.join(F.broadcast(at), group).where((F.col("dice") >= F.col("_lo")) & (F.col("dice") - F.col("_lo") < F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_width"))))
        slot = F.call_function("shiftrightunsigned", F.col("dice") - F.col("_lo"), F.greatest(F.col("_width") - LEVEL_BITS, F.lit(0)))
        sums = inside.groupBy(group, "_need", "_before", slot.alias("_slot")).agg(F.sum(weight).cast("double").alias("_part"), F.count("*").alias("_rows"))
        upto = F.col("_before") + F.sum("_part").over(Window.partitionBy(group).orderBy("_slot"))
        over = sums.withColumn("_upto", upto).where("_upto > _need").groupBy(group).agg(F.min_by(F.struct("_slot", F.expr("cast(_upto - _part as double)").alias("_start"), "_rows"), "_slot").alias("x"))
        found = {r[group]: r["x"] for r in over.collect()}  # a row for each group asked for
        for g in sorted(open_):
            lo, width, _ = edges[g]
            if g not in found:  # all of the range fits
                edges[g] = (lo + (1 << width), 0, float(need[g]))
                open_.discard(g)
                continue
            less = max(width - LEVEL_BITS, 0)
            edges[g] = (lo + (found[g]["_slot"] << less), less, found[g]["_start"])
            if less == 0 or found[g]["_rows"] <= EDGE_ROWS:
                open_.discard(g)
    at = spark.createDataFrame([(g, edges[g][0], edges[g][1], float(edges[g][2]), float(need[g])) for g in sorted(need)], f"{group} {kind}, _lo long, _width int, _before double, _need double")
    placed = rows.join(F.broadcast(at), group)
    end = F.col("_lo") + F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_width"))
    run = F.col("_before") + F.sum(weight).over(Window.partitionBy(group).orderBy("dice", *key))
    edge = placed.where((F.col("dice") >= F.col("_lo")) & (F.col("dice") < end)).withColumn("first", run <= F.col("_need"))
    other = placed.where((F.col("dice") < F.col("_lo")) | (F.col("dice") >= end)).withColumn("first", F.col("dice") < F.col("_lo"))
    return other.union(edge).drop("_lo", "_width", "_before", "_need")


def semi_by_key(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in ``keys`` (one column of that name, materialised, distinct).

    The keys are broadcast only if counted below ``BROADCAST_KEYS``.
    """
    small = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return df.join(F.broadcast(keys) if small else keys, key, "left_semi")


#: A key is hot from this number of rows and this share of all rows on; hot ones are spread over so many salts.
HOT_ROWS, HOT_SHARE, SALTS = 10_000, 1000, 32


def salted_join(left: DataFrame, right: DataFrame, key: str, by: str) -> DataFrame:
    """Inner join on ``key``; rows of ``left`` under a hot key are spread by the hash of ``by``.

    ``left`` is a table on storage, whose keys are counted; the rows of ``right``
    under its hot keys are repeated for each salt.
    """
    limit = max(HOT_ROWS, left.count() // HOT_SHARE)
    hot = left.groupBy(key).count().where(F.col("count") > limit).select(key).toArrow()  # fewer than HOT_SHARE rows
    if not hot.num_rows:
        return left.join(right, key)
    marks = F.broadcast(left.sparkSession.createDataFrame(hot).withColumn("_hot", F.lit(True)))
    many, none = F.array(*[F.lit(i) for i in range(SALTS)]), F.array(F.lit(0))
    a = left.join(marks, key, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).otherwise(0))
    b = right.join(marks, key, "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), many).otherwise(none)))
    return a.drop("_hot").join(b.drop("_hot"), [key, "_salt"]).drop("_salt")


def class_representatives(df: DataFrame, row_id: str, key: str) -> DataFrame:
    """One row by value of ``key``: that of the least ``row_id``. Only the surplus rows are moved."""
    ids = df.select(row_id, key)
    many = ids.groupBy(key).agg(F.min(row_id).alias("_least"), F.max(row_id).alias("_most")).where("_least < _most").drop("_most")
    surplus = materialize(ids.join(many, key).where(F.col(row_id) > F.col("_least")).select(row_id).distinct(), "surplus")
    small = surplus.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return df.join(F.broadcast(surplus) if small else surplus, row_id, "left_anti")


def comparison_form(text: str | None) -> str:
    """Ruby readings, ruby bars and annotations out, NFKC, letters and digits only. Null gives ''."""
    if not text:
        return ""
    if "《" in text or "｜" in text or "［" in text:
        text = _MARKUP.sub("", text)
    return _NOT_ALNUM.sub("", unicodedata.normalize("NFKC", text))


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of ``texts`` in one array, and each text's length."""
    # surrogatepass: lone surrogates can't come from Arrow, but may from a caller's own strings
    a = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return a, np.fromiter(map(len, texts), np.int64, len(texts))


def mix64(h: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def window_hashes(a: np.ndarray, lengths: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all windows of ``q`` code points, with the text and the position of each."""
    m = len(a) - q + 1
    if m <= 0:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z
    h, c = np.zeros(m, np.uint64), a.astype(np.uint64)
    for j in range(q):
        h = h * np.uint64(0x9E3779B97F4A7C15) + c[j : j + m] + np.uint64(1)
    owner = np.repeat(np.arange(len(lengths)), lengths)[:m]
    start = np.cumsum(lengths) - lengths
    pos = np.arange(m) - start[owner]
    ok = pos + q <= lengths[owner]
    return mix64(h[ok]), owner[ok], pos[ok]


def expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated ranges [starts[i], starts[i] + counts[i])."""
    total = int(counts.sum())
    first = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(first - starts, counts)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def edit_distance_at_most(a: str, b: str, k: int) -> bool:
    """Whether Levenshtein(a, b) <= k: Myers' bit vectors in one Python integer."""
    if abs(len(a) - len(b)) > k:
        return False
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    m = len(a)
    if not m:
        return len(b) <= k
    peq: dict[str, int] = {}
    for i, ch in enumerate(a):
        peq[ch] = peq.get(ch, 0) | 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, left = mask, 0, m, len(b)
    for ch in b:
        eq = peq.get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        left -= 1
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        if score - left > k:
            return False
        ph = (ph << 1 | 1) & mask
        mh = mh << 1 & mask
        pv = mh | ~(xv | ph) & mask
        mv = ph & xv
    return score <= k
