"""Omitted subjects: candidates from the sentences before, scored and ranked.

entities: doc, idx, ent, pos (order in the sentence), role, kind, salience, is_speaker.
queries: doc, idx, omitted (case), staccato.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fumigura import profiles as P

LOOKBACK, DECAY, RESOLVED = 3, 0.75, 0.25


def candidates(queries: DataFrame, entities: DataFrame, lookback: int = LOOKBACK) -> DataFrame:
    """Entities of the sentence itself and of the ``lookback`` before it, each by its nearest mention.

    The range is spread over equal keys (one per distance), so that Spark can
    hash-join on (doc, idx) whatever the length of a document.
    """
    near = entities.withColumn("distance", F.explode(F.sequence(F.lit(0), F.lit(lookback)))).withColumn("at", F.col("idx") + F.col("distance")).withColumnRenamed("idx", "from_idx")
    met = queries.join(near.withColumnRenamed("at", "q_idx").withColumnRenamed("doc", "q_doc"), (F.col("doc") == F.col("q_doc")) & (F.col("idx") == F.col("q_idx"))).drop("q_doc", "q_idx")
    keys = [c for c in queries.columns]
    first = met.groupBy(*keys, "ent").agg(F.min_by(F.struct("distance", "pos", "role", "kind", "salience", "is_speaker"), F.struct("distance", "pos")).alias("c"))
    return first.select(*keys, "ent", "c.*")


def score(pas: Column | float = 0.5) -> Column:
    """Weighted sum of argument score, distance, role and salience; a speaker just before a clipped style is held on to."""
    weights = F.create_map(*[F.lit(x) for kv in P.ROLE_WEIGHTS.items() for x in kv])
    role = F.coalesce(F.try_element_at(weights, F.col("role")), F.lit(0.3))
    salience = F.coalesce("salience", F.lit(1.0)) * F.when(F.col("kind") == "character", 1.2).otherwise(1.0)
    held = (F.coalesce("staccato", F.lit(0.0)) >= 60) & (F.col("distance") == 1) & F.coalesce("is_speaker", F.lit(False)) & F.col("omitted").isin("ガ", "ガ２")
    near = F.when(held, 1.0).otherwise(F.pow(F.lit(DECAY), F.col("distance")))
    pas = F.lit(pas) if isinstance(pas, float) else pas
    return pas * 0.35 + near * 0.30 + F.when(held, F.greatest(role, F.lit(1.0))).otherwise(role) * 0.20 + F.least(salience, F.lit(2.0)) * 0.15 + F.when(held, 0.25).otherwise(0.0)


def ranked(found: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates with score, likelihood (softmax of temperature one half) and rank."""
    g = Window.partitionBy(*keys)
    s = found.withColumn("score", score())
    s = s.withColumn("e", F.exp((F.col("score") - F.max("score").over(g)) * 2))
    order = g.orderBy(F.desc("score"), "distance", "pos", "ent")
    return s.withColumn("likelihood", F.col("e") / F.sum("e").over(g)).withColumn("rank", F.row_number().over(order)).drop("e")


def resolved(queries: DataFrame, entities: DataFrame) -> DataFrame:
    """The best candidate of each query, null where it isn't likely enough."""
    best = ranked(candidates(queries, entities), queries.columns).where("rank = 1")
    return best.select(*queries.columns, F.when(F.col("likelihood") >= RESOLVED, F.col("ent")).alias("antecedent"), "likelihood")


def missing_slots(filled: Column, mandatory: list[str]) -> Column:
    return F.array_except(F.array(*[F.lit(m) for m in mandatory]), filled)


def incomplete_score(raw: Column, missing: Column, zero: Column) -> Column:
    """A sentence's score lowered by empty mandatory slots."""
    return F.when(missing == 0, raw).otherwise(raw * F.greatest(F.lit(0.1), 1 - (0.2 * missing + 0.3 * zero)))


def incomplete(asked: DataFrame, entities: DataFrame, missing: Column) -> DataFrame:
    """Queries with the likelihood of an omission (the best antecedent's; .8 without one where a slot is empty), whether they are incomplete, and a score of 1 lowered accordingly."""
    best = ranked(candidates(asked, entities), asked.columns).where("rank = 1").select(*asked.columns, "likelihood")
    rows = asked.join(best, asked.columns, "left").withColumn("missing", missing)
    zero = F.coalesce("likelihood", F.when(F.col("missing") > 0, 0.8).otherwise(0.0))
    return rows.select(*asked.columns, "missing", zero.alias("zero"), ((F.col("missing") > 0) | F.col("likelihood").isNotNull()).alias("is_incomplete"), incomplete_score(F.lit(1.0), F.col("missing"), zero).alias("score"))
