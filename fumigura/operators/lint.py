"""Syntactic checks of sentences: diagnostics with offsets, and a score.

Checks with plain patterns are expressions; particle repetition needs context
around each occurrence and runs on Arrow batches. Blank and null sentences have
no diagnostics; a null sentence has a null score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fumigura import profiles as P
from fumigura.functions import text as T

MIN_REPEATED, CADENCE = 3, 30.0
DIAGNOSTIC = "array<struct<from_pos:int, to_pos:int, severity:string, rule:string, detail:string>>"


def double_negations(c: Column) -> Column:
    """array<struct<start, end, text>>, earlier phrases of the list first where two begin together."""
    return T.find_spans(c, "|".join(P.DOUBLE_NEGATIONS))


def mismatch(c: Column) -> Column:
    """Whether a topic is followed by a predicate that gives a reason; sentences with a dash apposition never."""
    s = T.strip(c)
    hit = F.lit(False)
    for p in P.MISMATCHES:
        hit = hit | s.rlike(p)
    reason = s.rlike("(?:から|ため)(?:です|である)")  # what all the patterns end in, found by a plain search
    return F.when(reason, hit & ~s.rlike("――|──")).otherwise(F.when(c.isNotNull(), False))


def passives(c: Column) -> Column:
    """Passive forms without look-alikes and hearsay."""
    found = T.find_spans(c, P.PASSIVE)
    around = lambda s: F.substring(c, F.greatest(F.lit(0), s["start"] - 5) + 1, s["end"] + 5 - F.greatest(F.lit(0), s["start"] - 5))
    return F.filter(found, lambda s: ~s["text"].isin(P.NOT_PASSIVE) & ~around(s).rlike(P.HEARSAY))


def intentional(telemetry: Column) -> Column:
    """Whether the style asks for the irregularity: polyphony with cadence, tension with confession, or a high crest."""
    x, d = telemetry["texture"], telemetry["dynamics"]
    zero = F.lit(0.0)
    tension = F.coalesce(x["tension"], zero)
    tension = F.when(tension > 1, tension / 100).otherwise(tension)
    cadence = F.coalesce(x["cadence"], d["cadence"], zero)
    return ((F.coalesce(x["polyphony"], zero) >= 70) & (cadence >= 45)) | ((tension >= 0.7) & (F.coalesce(x["confession"], zero) >= 70)) | (F.coalesce(d["crestfactor"], F.lit(1.0)) >= 2.5)


def long_dependency(c: Column, telemetry: Column, most: int = 12) -> Column:
    """struct<start, end, distance, severity> of a topic too far from the end of the sentence, or null."""
    topic = F.regexp_extract(c, "(?:^|[、。])([一-龠々ぁ-んァ-ヶa-zA-Z0-9]+[はが])", 1)
    whole = F.regexp_extract(c, "(?:^|[、。])([一-龠々ぁ-んァ-ヶa-zA-Z0-9]+[はが])", 0)
    start = F.instr(c, whole) - 1 + F.when(whole.rlike("^[、。]"), 1).otherwise(0)
    distance = F.length(c) - 1 - start
    limit = F.coalesce(telemetry["dynamics"]["maxdependencydistance"], F.lit(most)) + 8
    return F.when((topic != "") & (distance > limit), F.struct(start.alias("start"), (F.length(c) - 1).alias("end"), distance.alias("distance"), F.when(intentional(telemetry), "info").otherwise("warning").alias("severity")))


# What a particle の or と is part of, so that it doesn't count.
_NO_AFTER = re.compile("の(?:み|で|に|は|が|を|も|だ|か|よ|ね|どけ|どか)")
_NO_WORDS = re.compile("手のひら|目の前|女の子|男の子")
_NO_BEFORE = ("この", "その", "あの", "どの", "もの", "かの", "ほんの")
_TO_AFTER = re.compile("と(?:き|ころ|おり|なり|ちゅう|して|ともに|いう|いった|のこと|する|した|みる|みられる|は思|思|は考|考|は言|言|は聞|聞|は感|感|か)")
_TO_BEFORE = re.compile("(?:ひょっとする?|きっ|ふ|ふっ|そっ|じっ|やっ|もっ|ずっ|堂々|凛|忽然|パッ|スッ|ハッ|バッ|サッ|じっくり|はっきり|くっきり|ゆったり|しっかりと?|ちゃん|なんと|まったく)と$")
_TO_OPEN, _TO_CLOSE = "「『“\"‘`", "」』”\"’`"
_BETWEEN = re.compile(r"[一-鿿゠-ヿ぀-ゟ]+?(?:が|を|は|に|で|へ|と|から|より|も)|[\s()「」]")
_CLAUSE = re.compile(T.CLAUSE)


def counts(sentence: str, at: int, particle: str) -> bool:
    """Whether the particle at ``at`` stands for itself."""
    if particle == "の":
        return not (_NO_AFTER.match(sentence, at) or (at and _NO_WORDS.match(sentence, at - 1)) or sentence[: at + 1].endswith(_NO_BEFORE))
    if particle == "と":
        quoted = (at and sentence[at - 1] in _TO_OPEN) or sentence[at + 1 : at + 2] in tuple(_TO_CLOSE)
        return not (quoted or _TO_AFTER.match(sentence, at) or _TO_BEFORE.search(sentence[max(0, at - 10) : at + 1]))
    return True


def places(clause: str, particle: str) -> list[int]:
    return [m.start() for m in re.finditer(particle, clause) if counts(clause, m.start(), particle)]


def clauses(sentence: str) -> list[tuple[int, str]]:
    found = [(m.start(), m.group()) for m in _CLAUSE.finditer(sentence) if m.group().strip()]
    return found or ([(0, sentence)] if sentence.strip() else [])


def repeated_particles(sentence: str, cadence: float = 0.0, least: int = MIN_REPEATED) -> list[tuple[int, int, str, str, str]]:
    """Particles too often in one clause; for の only chains without another particle between them."""
    out = []
    raised = cadence >= CADENCE
    need, need_no = (math.ceil(least * 1.5), 5) if raised else (least, 3)
    parts = clauses(sentence)
    for p in P.REPEATED:
        if sentence.count(p) < min(need, need_no):
            continue
        for start, clause in parts:
            at = places(clause, p)
            runs = [at]
            if p == "の":
                runs = [at[:1]]
                for before, here in zip(at, at[1:]):
                    if _BETWEEN.search(clause[before + 1 : here]):
                        runs.append([])
                    runs[-1].append(here)
            for run in runs:
                if len(run) >= (need_no if p == "の" else need):
                    severity = "info" if p == "の" and len(run) < 4 else "warning"
                    out += [(start + i, start + i + len(p), severity, "particle-repetition", p) for i in run]
    return out


def repetition_penalty(sentence: str, least: int = MIN_REPEATED) -> float:
    total, parts = 0.0, clauses(sentence)
    for p in P.REPEATED:
        need = max(least, 4) if p == "の" else least
        if sentence.count(p) < need:
            continue
        most = max((len(places(c, p)) for _, c in parts), default=0)
        total += 0.15 * max(0, most - need + 1)
    return total


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("from_pos", pa.int32()), ("to_pos", pa.int32()), ("severity", pa.string()), ("rule", pa.string()), ("detail", pa.string())]))
    names = ("from_pos", "to_pos", "severity", "rule", "detail")
    for batch in batches:
        texts, cadences = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        found = [[dict(zip(names, d, strict=True)) for d in repeated_particles(t, c or 0.0)] if t else [] for t, c in zip(texts, cadences, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, kind), pa.array([None if t is None else repetition_penalty(t) for t in texts], pa.float64())], names=["id", "sentence", "repeated", "penalty"])


def lint(df: DataFrame, telemetry: Column | None = None) -> DataFrame:
    """(id, sentence) -> id, score and diagnostics (array) of each sentence, rules in fixed order."""
    cadence = F.lit(0.0) if telemetry is None else F.coalesce(telemetry["texture"]["cadence"], telemetry["dynamics"]["cadence"])
    kind = df.schema["id"].dataType.simpleString()
    base = df.select("id", "sentence", cadence.cast("double").alias("cadence")).mapInArrow(_run, f"id {kind}, sentence string, repeated {DIAGNOSTIC}, penalty double")
    s = F.col("sentence")
    made = lambda spans, rule: F.transform(spans, lambda x: F.struct(x["start"].alias("from_pos"), x["end"].alias("to_pos"), F.lit("warning").alias("severity"), F.lit(rule).alias("rule"), x["text"].alias("detail")))
    # an apposition between dashes is taken out before the topic is compared with the predicate
    plain = F.when(s.rlike("(?:――|──)[^―─]+(?:である|だ|だった|でした)[。！？\n]?$"), "").otherwise(F.regexp_replace(s, "(?:――|──)[^―─]+(?:――|──)", "、"))
    topic = F.regexp_extract(s, r"(?:[^\s。、]{1,20})(?:は|が|のは|としては)", 0)
    twist = F.when(mismatch(plain), F.array(F.struct(F.greatest(F.lit(0), F.instr(s, topic) - 1).alias("start"), F.length(s).alias("end"), topic.alias("text")))).otherwise(F.array().cast("array<struct<start:int,end:int,text:string>>"))
    passive = passives(s)
    passive = F.transform(F.array(passive), lambda p: F.when(F.size(p) >= 2, p).otherwise(F.slice(p, 1, 0)))[0]  # a name for what is costly to find
    commas = F.length(F.regexp_replace(s, "[^,、]", ""))
    score = 1.0 - F.col("penalty") - F.when(mismatch(s), 0.45).otherwise(0.0) - 0.25 * F.size("negations") - 0.2 * F.size("passives") - F.when((F.length(s) > 150) & (commas >= 6), 0.1 * (commas - 5)).otherwise(0.0)
    wide = base.withColumns({"negations": double_negations(s), "passives": passive, "twist": twist})
    return wide.select(
        "id", F.when(s.isNotNull(), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6)).alias("score"),
        F.coalesce(F.concat("repeated", made(F.col("twist"), "subject-predicate-mismatch"), made(F.col("negations"), "double-negation"), made(F.col("passives"), "consecutive-passive")), F.array().cast(DIAGNOSTIC)).alias("diagnostics"),
    )


def document_diagnostics(df: DataFrame, key: str, text: str) -> DataFrame:
    """Diagnostics of all sentences of a text, with offsets in the text: key, from_pos, to_pos, severity, rule, detail."""
    spans = df.select(key, F.posexplode(T.sentence_spans(F.col(text))).alias("no", "s"))
    found = lint(spans.select(F.struct(key, "no", F.col("s.start").alias("start")).alias("id"), F.col("s.text").alias("sentence")))
    rows = found.select(F.col(f"id.{key}").alias(key), F.col("id.start").alias("start"), F.explode("diagnostics").alias("d"))
    return rows.select(key, (F.col("start") + F.col("d.from_pos")).alias("from_pos"), (F.col("start") + F.col("d.to_pos")).alias("to_pos"), "d.severity", "d.rule", "d.detail")
