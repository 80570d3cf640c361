"""Event evaluation and sequence checks on streams."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fumigura.functions import text as T
from fumigura.operators import events as E
from fumigura.sources.io import shared_dir


def from_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A file stream of a parquet table (one file or a folder), a file at a time."""
    static = spark.read.parquet(path)
    folder, name = path.rstrip("/").rsplit("/", 1)
    reader = spark.readStream.schema(static.schema).option("maxFilesPerTrigger", 1)
    if any(f.endswith("/" + name) for f in static.inputFiles()):  # the table is that file
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def evaluated(stream: DataFrame) -> DataFrame:
    """Events with their operation and whether they are accepted: a stateless projection."""
    op = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "purchase", "create").otherwise("update")
    return stream.select("event_id", "user_id", "event_type", op.alias("operation"), E.accepted(op).alias("accepted"))


def windowed_counts(stream: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def spikes(stream: DataFrame, key: str, order: str, value: str, width: int = 4, rise: float = 25.0, least: float = 60.0) -> DataFrame:
    """Values that stand ``rise`` over the least of the ``width`` before them and reach ``least``; state holds only those."""
    kind = stream.schema[key].dataType.simpleString()

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(order)
        out = []
        for o, v in zip(rows[order], rows[value], strict=True):
            known = [x for x in before if x == x]
            if known and v == v and v - min(known) >= rise and v >= least:
                out.append((k[0], int(o), float(v)))
            before = (before + [float(v) if v == v else float("nan")])[-width:]
        state.update((before,))
        yield pd.DataFrame(out, columns=[key, "at", "value"])

    return stream.select(key, F.col(order).cast("long"), F.col(value).cast("double")).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, at long, value double", "before array<double>", "append", GroupStateTimeout.NoTimeout)


def bounded(stream: DataFrame, key: str, order: str, capacity: int) -> DataFrame:
    """A bounded queue by key: what arrives in one trigger beyond ``capacity`` is dropped and counted.

    One row per key and trigger: accepted and, in all so far, dropped.
    """
    slots = 1 << max(1, (capacity - 1).bit_length())
    kind = stream.schema[key].dataType.simpleString()

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        dropped = state.get[0] if state.exists else 0
        n = sum(len(f) for f in frames)
        dropped += max(0, n - slots)
        state.update((dropped,))
        yield pd.DataFrame([(k[0], min(n, slots), dropped)], columns=[key, "accepted", "dropped"])

    return stream.select(key, order).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, accepted long, dropped long", "dropped long", "append", GroupStateTimeout.NoTimeout)


def analysed(stream: DataFrame, key: str, text: str) -> DataFrame:
    """Requests to analyse a text: its characters, sentences and dialogue, a stateless projection."""
    c = F.col(text)
    return stream.where(c.isNotNull()).select(key, F.length(c).alias("chars"), F.size(T.sentences(c)).alias("sentences"), c.rlike("「[^」]*」").alias("has_dialogue"))


def correlated(requests: DataFrame, responses: DataFrame, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Requests (key, asked) with each response (key, answered) of the same key that comes within the time; state is bounded by the watermarks."""
    a = requests.withWatermark("asked", late).alias("a")
    b = responses.withWatermark("answered", late).alias("b")
    on = (F.col("a.key") == F.col("b.key")) & (F.col("answered") >= F.col("asked")) & (F.col("answered") <= F.col("asked") + F.expr(f"interval {within}"))
    return a.join(b, on).select(F.col("a.key").alias("key"), "asked", "answered")


def latest(stream: DataFrame, key: str, version: str, value: str) -> DataFrame:
    """(key, version, value) for each trigger in which a key gets a later version: edits that come late are passed over."""
    kind, what = (stream.schema[c].dataType.simpleString() for c in (key, value))

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = state.get[0] if state.exists else None
        best = None
        for rows in frames:  # a key's rows may come in several, each with an index of its own
            at = int(rows[version].to_numpy().argmax())
            found = int(rows[version].iloc[at])
            if (known is None or found > known) and (best is None or found > best[0]):
                best = (found, rows[value].iloc[at])
        if best is not None:
            state.update((best[0],))
            yield pd.DataFrame([(k[0], *best)], columns=[key, "version", value])

    return stream.where(F.col(version).isNotNull()).select(key, F.col(version).cast("long").alias(version), value).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, version long, {value} {what}", "version long", "append", GroupStateTimeout.NoTimeout)


def waits(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests (key, asked) with the first response (key, answered) from then on, or null: one pass over both in order."""
    both = requests.select("key", F.col("asked").alias("at"), F.lit(None).cast("timestamp").alias("answered"), F.lit(True).alias("asks")).union(responses.select("key", "answered", "answered", F.lit(False)))
    ahead = Window.partitionBy("key").orderBy("at").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    return both.withColumn("answered", F.min("answered").over(ahead)).where("asks").select("key", F.col("at").alias("asked"), "answered")


def watchdog(waited: DataFrame, limit: float) -> DataFrame:
    """By key: requests, those without a response within ``limit`` seconds, and the longest wait of the others."""
    took = (F.unix_micros("answered") - F.unix_micros("asked")) / 1e6
    late = took.isNull() | (took > limit)
    return waited.groupBy("key").agg(F.count("*").alias("requests"), F.count_if(late).alias("timeouts"), F.round(F.max(F.when(~late, took)), 3).alias("longest"))


def drained(stream: DataFrame, out: str | None = None) -> DataFrame:
    """All that the stream has now, written in micro-batches and read back as a table."""
    spark = stream.sparkSession
    path = out or f"{shared_dir(spark)}/fumigura-stream/{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", path + "-log").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
