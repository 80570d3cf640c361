"""Point of view over a sequence of sentences, in window expressions.

Input: doc, idx, text, is_dialogue, subject (candidate or null), telemetry.
Dialogue is skipped, but its telemetry counts in the windows before a sentence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fumigura import profiles as P
from fumigura.functions import text as T


def scaled(tension: Column) -> Column:
    """Tension as a share, from a share or a percentage."""
    return F.when(tension > 1, F.least(F.lit(1.0), tension / 100)).otherwise(tension)


def inner_state(text: Column) -> Column:
    """The phrase that shows an inner state, by the first pattern that matches, or null."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 0), F.lit("")) for p in P.INNER_STATES])


def subject(candidate: Column, text: Column) -> Column:
    """The candidate, or the word before the first は or が that follows a beginning or a comma; '' if none."""
    return F.coalesce(F.nullif(candidate, F.lit("")), F.regexp_extract(text, P.SUBJECT, 1))


def features(df: DataFrame) -> DataFrame:
    """All that a sentence's verdict depends on, but the last inner state before it."""
    w = Window.partitionBy("doc").orderBy("idx")
    x = F.col("telemetry")["texture"]
    clean = T.strip(F.col("text"))
    out = df.select(
        "doc", "idx", "is_dialogue", clean.alias("clean"), subject(F.col("subject"), clean).alias("who"),
        F.coalesce(x["showing"], F.lit(50.0)).alias("showing"), F.coalesce(x["speculation"], F.lit(0.0)).alias("speculation"), F.coalesce(x["staccato"], F.lit(50.0)).alias("staccato"),
        F.coalesce(x["confession"], F.lit(0.0)).alias("confession"), F.coalesce(scaled(x["tension"]), F.lit(0.0)).alias("tension"),
        scaled(F.lag(x["tension"]).over(w)).alias("tension_before"), F.min(x["speculation"]).over(w.rowsBetween(-4, -1)).alias("least_before"), inner_state(clean).alias("phrase"),
    )
    return out.withColumns({
        "modulated": (F.coalesce(F.abs(F.col("tension") - F.col("tension_before")), F.lit(0.0)) > 0.3) | (F.col("tension") >= 0.3),
        "spike": F.coalesce((F.col("speculation") - F.col("least_before") >= 25) & (F.col("speculation") >= 60), F.lit(False)),
        "recalled": clean_like("clean", P.RECOLLECTION), "indirect": clean_like("clean", P.FREE_INDIRECT), "softened": clean_like("clean", P.MITIGATION),
    })


def clean_like(c: str, pattern: str) -> Column:
    return F.coalesce(F.col(c).rlike(pattern), F.lit(False))


def verdicts(df: DataFrame, mode: str = "third_person_limited", character: str = "", strict: bool = False) -> DataFrame:
    """One row per narrative sentence that breaks or bends the point of view: doc, idx, kind, who, phrase, severity, confidence."""
    focus = character or (P.NARRATORS[0] if mode == "first_person" else "")
    f = features(df).where(~F.coalesce("is_dialogue", F.lit(False)) & (F.col("clean") != ""))
    who, named = F.col("who"), F.col("who") != ""
    allowed = ~named
    if mode == "first_person":
        allowed = allowed | who.isin([*P.NARRATORS, focus])
    elif mode == "third_person_limited":
        allowed = allowed | (F.lit(True) if not focus else who == focus)
    elif mode == "third_person_omniscient":
        allowed = F.lit(True)
    other = named & (who != focus) if focus else F.lit(False)
    soft = (F.lit(mode == "third_person_limited") & (F.col("confession") >= F.when(F.col("recalled"), 80).otherwise(65)) & F.col("modulated") & F.col("indirect") & ~other)
    inner = F.col("phrase").isNotNull()
    excess = ((F.col("showing") <= 20) & (F.col("speculation") >= 60) & (F.col("staccato") <= 25)) | F.col("spike")
    objective = F.lit(mode == "third_person_objective")
    kind = (
        F.when(soft, "free_indirect_discourse").when(~inner, None).when(F.col("softened") & ~excess, None)
        .when(F.col("softened") & (~allowed | objective), "epistemic_leak_excessive_speculation").when(objective, "objective_mode_leak").when(~allowed, "unauthorized_internal_state").otherwise("inner")
    )
    rows = f.withColumn("kind", kind).where("kind is not null")
    holder = F.lit(focus) if focus else who
    holds = F.when(F.col("kind") == "free_indirect_discourse", F.struct(holder.alias("who"), F.col("idx"))).when(F.col("kind") == "inner", F.struct(who.alias("who"), F.col("idx")))
    before = Window.partitionBy("doc").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("last", F.last(holds, ignorenulls=True).over(before))
    hop = (F.col("kind") == "inner") & (F.coalesce(F.col("last.who"), F.lit("")) != "") & (F.col("last.who") != who) & (F.col("idx") - F.col("last.idx") <= 2)
    kind = F.when(hop, "head_hopping").otherwise(F.col("kind"))
    leak = F.round(F.least(F.lit(1.0), 0.85 * (1 + 0.5 * (F.col("speculation") / (F.col("showing") + 1)))), 3)
    confidence = F.when(kind == "free_indirect_discourse", 0.85).when(kind == "epistemic_leak_excessive_speculation", leak).when(kind == "objective_mode_leak", 0.95).when(kind == "unauthorized_internal_state", 0.9).otherwise(0.8)
    severity = F.when(kind == "free_indirect_discourse", "info").when((kind == "objective_mode_leak") | ((kind == "unauthorized_internal_state") & F.lit(strict)), "error").otherwise("warning")
    out = rows.select("doc", "idx", kind.alias("kind"), "who", "phrase", severity.alias("severity"), confidence.alias("confidence")).where("kind <> 'inner'")
    return out.where("kind <> 'head_hopping'") if mode == "third_person_omniscient" and not strict else out


def report(df: DataFrame, found: DataFrame) -> DataFrame:
    """By document: sentences, dialogue, violations, head hops and the score of consistency."""
    size = df.groupBy("doc").agg(F.count("*").alias("sentences"), F.count_if(F.coalesce("is_dialogue", F.lit(False))).alias("dialogue"))
    cost = F.sum(F.when(F.col("severity") == "error", 0.25).when(F.col("severity") == "warning", 0.1).otherwise(0.0))
    sums = found.groupBy("doc").agg(F.count("*").alias("violations"), F.count_if(F.col("kind") == "head_hopping").alias("head_hops"), cost.alias("penalty"))
    told = F.col("sentences") - F.col("dialogue")
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.when(told > 0, F.coalesce("penalty", F.lit(0.0)) / F.greatest(F.lit(1.0), told / 5)).otherwise(0.0)))
    return size.join(sums, "doc", "left").select("doc", "sentences", "dialogue", F.coalesce("violations", F.lit(0)).alias("violations"), F.coalesce("head_hops", F.lit(0)).alias("head_hops"), F.round(score, 3).alias("score"))


def suggestion(phrase: Column, who: Column) -> Column:
    """How the sentence could be put instead."""
    name = F.when(F.coalesce(who, F.lit("")) != "", F.concat(who, F.lit("は"))).otherwise("")
    return (
        F.when(phrase.rlike("思った|考えた"), F.concat(name, F.lit("〜と思っているように見えた / 〜といった様子を見せた")))
        .when(phrase.rlike("感じた|恐怖した|恐れた"), F.concat(name, F.lit("恐怖に顔を強張らせた / 〜そうに身を震わせた")))
        .when(phrase.rlike("心の中で|胸の内で"), "直接の内的独白を避け、外見の仕草や表情描写に置き換えることを推奨します。")
        .otherwise(F.concat(name, F.lit("〜そうに見えた（外見・推量表現への言い換え）")))
    )
