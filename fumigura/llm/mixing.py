"""Problem 9: sources mixed to target shares of the total size.

Poisson replication: each source has a mean repetition rate that gives it its
share; a hash of the document, read as a uniform number, is put through the
inverse of the Poisson distribution, cut off at the source's cap, and the
document is repeated that often. As the rate grows a document gains its uses one
by one, each at a rate that its uniform number fixes; uses are taken in the order
of these rates until the source has its share. So the counts are one Poisson draw
at the rate at which the tokens drawn, not only those expected, are within one
document of the share. The copies come out in the order of another hash: shuffled
globally.

Sizes are tokens of a public tokenizer. Documents with a null source, of a
source without target, or of no tokens are not used. A source without tokens
gets none; the others keep their shares of the same total.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fumigura.llm import bpe
from fumigura.llm.common import DICE_BITS, column, first_by_dice, materialize


def entry_rates(u: np.ndarray, k: int) -> np.ndarray:
    """The Poisson means from which on the quantile at ``u`` is at least ``k``."""

    def below(rate: np.ndarray) -> np.ndarray:  # P(X < k)
        p, total = np.exp(-rate), np.zeros_like(rate)
        for j in range(k):
            total = total + p
            p = p * rate / (j + 1)
        return total

    lo, hi = np.zeros_like(u), np.full_like(u, k + 1.0)
    while (far := below(hi) > u).any():
        hi = np.where(far, hi * 2, hi)
    for _ in range(60):
        mid = (lo + hi) / 2
        more = below(mid) > u
        lo, hi = np.where(more, mid, lo), np.where(more, hi, mid)
    return hi


def _uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents -> their uses up to the cap, with the rate of each as a dice."""
    for batch in batches:
        u, cap = column(batch, "u").to_numpy(), column(batch, "cap").to_numpy()
        for k in range(1, int(cap.max(initial=0)) + 1):
            at = np.flatnonzero(cap >= k)
            rate = entry_rates(u[at], k)
            value = np.minimum(rate / (1 + rate) * (1 << DICE_BITS), float((1 << DICE_BITS) - 256)).astype(np.int64)
            rows = batch.select(["doc_id", "source", "tokens"]).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.full(len(at), k, np.int32)), pa.array(value)], names=["doc_id", "source", "tokens", "copy_no", "dice"])


def _uniform(*cols):
    return (F.xxhash64(*cols).bitwiseAND((1 << 52) - 1) + F.lit(0.5)) / float(1 << 52)


def _plan(documents: DataFrame, targets: DataFrame, seed: int) -> tuple[DataFrame, list[dict], float]:
    """The uses drawn, the sources' targets, and the total."""
    wanted = [r.asDict() for r in targets.where("source is not null").select("source", "target_share", "max_repeat").distinct().orderBy("source").collect()]  # a row for each source that is asked for
    spark = documents.sparkSession
    names = spark.createDataFrame([(r["source"],) for r in wanted], "source string")
    used = documents.join(F.broadcast(names), "source", "left_semi").where(F.col("text").isNotNull()).select("doc_id", "source", "text")
    # encoding is costlier than its bytes tell: as many partitions as shuffles have
    used = used.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id").dropDuplicates(["doc_id"])
    sized = materialize(bpe.token_counts(used.select(F.struct("doc_id", "source").alias("key"), "text"), "key").where("tokens > 0").select("key.doc_id", "key.source", "tokens"), "mix-sizes")
    have = {r["source"]: (r["t"], r["n"]) for r in sized.groupBy("source").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).collect()}
    for r in wanted:
        r["tokens"], r["documents"] = have.get(r["source"], (0, 0))
    total = min((r["max_repeat"] * r["tokens"] / r["target_share"] for r in wanted if r["tokens"] and r["target_share"] > 0), default=0.0)
    for r in wanted:
        r["aim"] = r["target_share"] * total if r["tokens"] else 0.0
    caps = spark.createDataFrame([(r["source"], r["max_repeat"]) for r in wanted], "source string, cap int")
    drawn = sized.join(F.broadcast(caps), "source").select("doc_id", "source", "tokens", "cap", _uniform(F.lit(seed), "doc_id").alias("u"))
    kinds = {f.name: f.dataType.simpleString() for f in sized.schema.fields}
    uses = materialize(drawn.mapInArrow(_uses, f"doc_id {kinds['doc_id']}, source string, tokens {kinds['tokens']}, copy_no int, dice long"), "mix-uses")
    need = {r["source"]: r["aim"] * (1 + 1e-12) for r in wanted}
    return first_by_dice(uses, "source", ["doc_id", "copy_no"], F.col("tokens"), need).where("first").select("doc_id", "source", "tokens", "copy_no"), wanted, total


def mixed_documents(documents: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """One row per use of a document in global random order: doc_id, source, copy_no, tokens, shuffle_key.

    documents: doc_id, source, text; targets: source, target_share, max_repeat.
    The total is the largest at which every source can reach its share.
    """
    copies, _, _ = _plan(documents, targets, seed)
    return copies.select("doc_id", "source", "copy_no", "tokens", F.xxhash64(F.lit(seed + 2), "doc_id", "copy_no").alias("shuffle_key")).orderBy("shuffle_key", "doc_id", "copy_no")


def mix_report(documents: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """By source: target and reached share of all tokens, tokens there and used, documents, and the most uses of one."""
    copies, wanted, _ = _plan(documents, targets, seed)
    spark = documents.sparkSession
    asked = spark.createDataFrame([(r["source"], r["target_share"], r["max_repeat"], r["documents"], r["tokens"]) for r in wanted], "source string, target_share double, max_repeat int, documents long, tokens_there long")
    used = copies.groupBy("source").agg(F.sum("tokens").alias("tokens_used"), F.max("copy_no").alias("most_uses"))
    out = asked.join(used, "source", "left").withColumn("_all", F.sum("tokens_used").over(Window.partitionBy()))
    return out.select("source", "target_share", (F.coalesce("tokens_used", F.lit(0)) / F.col("_all")).alias("reached_share"), "max_repeat", F.coalesce("most_uses", F.lit(0)).alias("most_uses"), "documents", "tokens_there", F.coalesce("tokens_used", F.lit(0)).alias("tokens_used"))
