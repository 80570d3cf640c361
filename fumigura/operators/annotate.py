"""Token-aligned labels of a sentence: one expression per head, or rows of (position, label)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fumigura import profiles as P
from fumigura.functions import text as T

#: Characters of a sentence that are labelled.
MAX_LENGTH = 256
NONE = -100


def case_particles(text: Column) -> Column:
    """array<struct> of the case particles with number, names, span and the noun before."""
    names = {k: F.struct(F.lit(v[0]).alias("case_id"), F.lit(v[1]).alias("case_name"), F.lit(v[2]).alias("case_katakana")) for k, v in P.CASES.items()}
    table = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), v)])
    return F.transform(
        T.particles(text),
        lambda s: F.struct(
            s["text"].alias("particle"), table[s["text"]]["case_id"].alias("case_id"), table[s["text"]]["case_name"].alias("case_name"),
            table[s["text"]]["case_katakana"].alias("case_katakana"), F.array(s["start"], s["end"]).alias("span"), T.particle_target(text, s["start"]).alias("target_noun"),
        ),
    )


def case_positions(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, case_id): every particle sought by itself, so that a longer one also counts for a shorter inside it; the last in order labels a shared place."""

    def marked(p: str, rank: int) -> Column:
        return F.transform(T.occurrences(F.col(text), p), lambda at: F.struct(at.alias("pos"), F.lit(rank).alias("rank"), F.lit(P.CASES[p][0]).alias("case_id")))

    spans = F.concat(*[marked(p, i) for i, p in enumerate(P.CASES)])
    rows = df.select(key, F.explode(spans).alias("s")).where(F.col("s.pos") < MAX_LENGTH)
    return rows.groupBy(key, F.col("s.pos").alias("pos")).agg(F.max_by("s.case_id", "s.rank").alias("case_id"))


def action_spans(text: Column) -> Column:
    """array<struct<start, end, action>>: first occurrence of each stem; where spans meet the later stem in order holds."""
    found = []
    for number, words in P.ACTIONS:
        for w in words:
            at = F.instr(text, w) - 1
            found.append(F.when(at >= 0, F.struct(at.alias("start"), (at + len(w)).alias("end"), F.lit(number).alias("action"))))
    return F.filter(F.array(*found), lambda s: s.isNotNull())


def action_labels(text: Column) -> Column:
    """array<int> of actions by character."""
    n = F.least(F.length(text), F.lit(MAX_LENGTH))
    last = lambda spans, i: F.coalesce(F.try_element_at(F.filter(spans, lambda s: (i >= s["start"]) & (i < s["end"])), F.lit(-1))["action"], F.lit(0))
    return F.when(n == 0, F.array().cast("array<int>")).otherwise(T.let(action_spans(text), lambda spans: F.transform(F.sequence(F.lit(0), n - 1), lambda i: last(spans, i))))


def entity_spans(text: Column) -> Column:
    return T.find_spans(text, P.ENTITY.strip("()"))


def entity_labels(text: Column) -> Column:
    """array<int>: 1 begins an entity, 2 is inside, 3 ends it, 0 else."""
    n = F.least(F.length(text), F.lit(MAX_LENGTH))

    def label(spans: Column, i: Column) -> Column:
        s = F.try_element_at(F.filter(spans, lambda s: (i >= s["start"]) & (i < s["end"])), F.lit(-1))
        return F.when(s.isNull(), 0).when(i == s["start"], 1).when(i == F.least(s["end"], n) - 1, 3).otherwise(2)

    return F.when(n == 0, F.array().cast("array<int>")).otherwise(T.let(entity_spans(text), lambda spans: F.transform(F.sequence(F.lit(0), n - 1), lambda i: label(spans, i))))


def dependency_labels(text: Column) -> Column:
    """array<int>: 2 modifier, 1 the root before the last character, 4 subject and 5 other particle."""
    n = F.least(F.length(text), F.lit(MAX_LENGTH))
    root = F.greatest(F.lit(0), n - 2)

    def marked(p: str, rank: int) -> Column:
        return F.transform(T.occurrences(text, p), lambda at: F.struct(at.alias("at"), F.lit(rank).alias("rank"), F.lit(4 if p == "が" else 5).alias("label")))

    marks = F.filter(F.concat(*[marked(p, i) for i, p in enumerate(P.CASES)]), lambda s: s["at"] < n)
    last = lambda marks, i: F.array_max(F.transform(F.filter(marks, lambda s: s["at"] == i), lambda s: F.struct(s["rank"], s["label"])))["label"]
    return F.when(n == 0, F.array().cast("array<int>")).otherwise(T.let(marks, lambda marks: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(last(marks, i), F.when(i == root, 1).otherwise(2)))))


def offset_labels(labels: Column, root: Column, reach: int = 32) -> Column:
    """Distance to the root by character, cut to +-reach and moved to be positive."""
    return F.transform(labels, lambda _, i: F.greatest(F.lit(-reach), F.least(F.lit(reach), root - i)) + reach)


# Words of inner states of the batch labels, and their scores (dialogue, with such a word, else).
BATCH_INNER = ["思っ", "感じ", "悲し", "悔し", "怒り", "悟っ", "知っ"]
BATCH_SCORES = (0.1, 0.85, 0.25)


def batch_heads(text: Column, is_dialogue: Column) -> dict[str, Column]:
    """Labels (1 root, 7 particle, 2 else), offsets (of particles to the root, else 32 for none) and the epistemic score of training batches."""
    n = F.least(F.length(text), F.lit(MAX_LENGTH))
    root = F.greatest(F.lit(0), n - 2)
    at = lambda i: F.exists(F.array(*[F.lit(p) for p in P.CASES]), lambda p: F.substring(text, i + 1, F.length(p)) == p)
    every = lambda f: F.when(n == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), f))
    dialogue, inner, other = BATCH_SCORES
    return {
        "labels": every(lambda i: F.when(at(i), 7).when(i == root, 1).otherwise(2)),
        "offsets": every(lambda i: F.when(at(i), F.greatest(F.lit(-32), F.least(F.lit(32), root - i)) + 32).otherwise(32)),
        "epistemic": F.when(is_dialogue, dialogue).when(T.any_of(text, BATCH_INNER), inner).otherwise(other),
    }


def padded(values: Column, n: int, fill: int) -> Column:
    """The first ``n`` values, filled up with ``fill``."""
    return F.slice(F.concat(values, F.array_repeat(F.lit(fill), n)), 1, n)


def head_columns(df: DataFrame, text: str, is_dialogue: str) -> DataFrame:
    """``df`` with all heads: modality, offset, label, epistemic, action, entity and connective."""
    t = F.col(text)
    n = F.least(F.length(t), F.lit(MAX_LENGTH))
    known = T.any_of(t, P.EPISTEMIC)
    return df.withColumns({
        "modality": F.array_repeat(F.col(is_dialogue).cast("int"), n), "offset": F.array_repeat(F.lit(32), n), "label": dependency_labels(t),
        "epistemic": F.array_repeat(known.cast("double"), n), "action": action_labels(t), "entity": entity_labels(t), "connective": F.array_repeat(T.connective(t), n),
    })


def word_pattern(words: list[str]) -> str:
    return "|".join(re.escape(w) for w in words)
