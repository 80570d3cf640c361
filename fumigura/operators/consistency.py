"""Consistency of a story's facts over time: intervals, presence, cycles, references and histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fumigura.sources.io import kept


def lifetime_violations(events: DataFrame, lives: DataFrame) -> DataFrame:
    """Events of (entity, at) outside the entity's [born, died]; open ends are null."""
    met = events.join(lives, "entity")
    kind = F.when(F.col("at") < F.col("born"), "before_birth").when(F.col("at") > F.col("died"), "after_death")
    return met.withColumn("violation", kind).where("violation is not null").select(*events.columns, "violation")


def simultaneous_presence(stays: DataFrame, width: int = 3600) -> DataFrame:
    """Stays (entity, place, start, end; whole numbers) that begin while another one elsewhere lasts.

    The overlap is an equi-join on (entity, time bucket): a stay is in every
    bucket it lasts through, and is held against the starts of that bucket.
    """
    spans = stays.select("entity", F.col("place").alias("other_place"), F.col("start").alias("s"), F.col("end").alias("e"), F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))).alias("bucket"))
    starts = stays.withColumn("bucket", F.floor(F.col("start") / width))
    met = starts.join(spans, ["entity", "bucket"]).where((F.col("place") != F.col("other_place")) & (F.col("s") <= F.col("start")) & (F.col("start") < F.col("e")))
    return met.select("entity", "place", "start", "other_place").distinct()


def speed_violations(visits: DataFrame, most: float) -> DataFrame:
    """Moves of (entity, at, x) faster than ``most``."""
    w = Window.partitionBy("entity").orderBy("at")
    moved = visits.withColumn("speed", F.abs(F.col("x") - F.lag("x").over(w)) / F.nullif(F.col("at") - F.lag("at").over(w), F.lit(0)))
    return moved.where(F.col("speed") > most)


def cycles(edges: DataFrame) -> DataFrame:
    """(node, steps): nodes of (src, dst) that reach themselves, and in how many steps at least.

    A frontier of pairs not reached before is carried on until none is left, so
    cycles of any length are found and no path is walked twice. Nodes that
    nothing leads to, or that lead nowhere, are taken out first.
    """
    edges = kept(edges.where("src is not null and dst is not null").select("src", "dst").distinct(), "edges")
    size = edges.count()
    while True:
        ends = edges.select("src").intersect(edges.select("dst")).withColumnRenamed("src", "node")
        edges = kept(edges.join(ends, F.col("src") == F.col("node"), "left_semi").join(ends, F.col("dst") == F.col("node"), "left_semi"), "edges")
        before, size = size, edges.count()
        if size == before:
            break
    frontier = kept(edges.select(F.col("src").alias("node"), F.col("dst").alias("at"), F.lit(1).alias("steps")), "frontier")
    seen, n = [frontier], 1
    while not frontier.isEmpty():
        n += 1
        old = seen[0]
        for f in seen[1:]:
            old = old.union(f)
        ahead = frontier.where("at <> node").join(edges, F.col("at") == F.col("src")).select("node", F.col("dst").alias("at")).distinct()
        frontier = kept(ahead.join(old, ["node", "at"], "left_anti").withColumn("steps", F.lit(n)), "frontier")
        seen.append(frontier)
        if len(seen) > 8:
            seen = [kept(old.union(frontier), "reached")]
    every = seen[0]
    for f in seen[1:]:
        every = every.union(f)
    return every.where("at = node").groupBy("node").agg(F.min("steps").alias("steps"))


def deadlocks(needs: DataFrame) -> DataFrame:
    """(node) of (node, needed): what can't happen, as it needs itself or something that does: a fixed point backwards from the cycles."""
    edges = kept(needs.select("node", "needed").distinct(), "needs")
    stuck = kept(cycles(edges.select(F.col("node").alias("src"), F.col("needed").alias("dst"))).select("node"), "stuck")
    new = stuck
    while not new.isEmpty():
        new = kept(edges.join(new.withColumnRenamed("node", "needed"), "needed", "left_semi").select("node").distinct().join(stuck, "node", "left_anti"), "stuck")
        stuck = kept(stuck.union(new), "stuck")
    return stuck


def undefined_references(texts: DataFrame, known: DataFrame) -> DataFrame:
    """(id, name) of [[name]] in texts that no entity has."""
    found = texts.select("id", F.explode(F.regexp_extract_all("text", F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1))).alias("name")).distinct()
    return found.join(known.select("name").distinct(), "name", "left_anti").select("id", "name")


def history(changes: DataFrame, entity: str, at: str, state: str) -> DataFrame:
    """Validity of each state: (entity, state, valid_from, valid_to), null while it lasts."""
    w = Window.partitionBy(entity).orderBy(at)
    return changes.select(entity, state, F.col(at).alias("valid_from"), F.lead(at).over(w).alias("valid_to"))


def anomaly(raw: Column) -> Column:
    """struct<is_anomaly, severity> of a packed word."""
    return F.struct((raw.bitwiseAND(0xFFFF) > 32768).alias("is_anomaly"), F.shiftright(raw, 16).bitwiseAND(0xFF).alias("severity"))
