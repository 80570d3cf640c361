"""State changes from predicates and their arguments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fumigura import profiles as P


def action(predicate: Column, custom: dict[str, str] | None = None, default: str = "ChangeState") -> Column:
    """Standard action of a predicate: own dictionary, dictionary, first stem that occurs, default. Null and '' give the default."""
    word = F.trim(predicate)
    table = {w: a for a, words in P.PREDICATES.items() for w in words} | (custom or {})
    known = F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), word)
    stem = F.lit(default)
    for a, stems in reversed(P.STEMS):
        stem = F.when(word.rlike("|".join(stems)), a).otherwise(stem)
    return F.when(F.coalesce(predicate, F.lit("")) == "", default).otherwise(F.coalesce(known, stem, F.lit(default)))


def operation(act: Column) -> Column:
    return F.when(act == "Drop", "delete").when(act == "Acquire", "create").otherwise("update")


def argument(args: Column, *cases: str) -> Column:
    """Text of the last explicit argument of one of the cases."""
    fits = F.filter(args, lambda a: a["case_name"].isin(*cases) & ~F.coalesce(a["is_zero"], F.lit(False)) & (F.coalesce(a["text"], F.lit("")) != ""))
    return F.when(F.size(fits) > 0, F.element_at(fits, -1)["text"])


def events(relations: DataFrame, antecedents: DataFrame | None = None, default_entity: str = "unknown_entity") -> DataFrame:
    """(rel_id, predicate, args array<struct<case_name, text, is_zero>>) -> one event each.

    antecedents: rel_id, antecedent (text) of omitted subjects, used where no explicit subject is there.
    """
    r = relations.join(antecedents, "rel_id", "left") if antecedents is not None else relations.withColumn("antecedent", F.lit(None).cast("string"))
    told = argument(F.col("args"), "ガ", "ガ２")
    empty = F.exists("args", lambda a: a["case_name"].isin("ガ", "ガ２") & F.coalesce(a["is_zero"], F.lit(False)))
    act = action(F.col("predicate"))
    who = F.coalesce(told, F.col("antecedent"))
    return r.select(
        "rel_id", F.coalesce(who, F.lit(default_entity)).alias("entity_id"), act.alias("action"), operation(act).alias("operation"), who.alias("subject"),
        argument(F.col("args"), "ヲ").alias("object"), argument(F.col("args"), "ニ").alias("target"), F.coalesce("predicate", F.lit("")).alias("predicate"),
        (empty | (told.isNull() & F.col("antecedent").isNotNull())).alias("is_subject_zero"),
    )


def accepted(op: Column) -> Column:
    """Everything but a deletion; a null operation is accepted too."""
    return F.coalesce(op != "delete", F.lit(True))
