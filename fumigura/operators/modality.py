"""Guards that refine modality labels of a sentence: citations, speech without quotes, free indirect discourse."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fumigura import profiles as P

NARRATIVE, DIALOGUE, MONOLOGUE, CITATION = 0, 1, 2, 3
_QUOTED = re.compile("「([^」]+)」|『([^』]+)』")
_FREE = re.compile(P.FREE_INDIRECT.rsplit("|", 1)[0] + "|悔しくてたまらない")
_SPAN = re.compile("[^。！？!?\n]+[。！？!?\n]?")
_UNQUOTED = [re.compile(p) for p in P.UNQUOTED]
_SPEECH = re.compile(P.SPEECH)
_RECALLED = re.compile(P.RECOLLECTION)


def is_cited(text: str, start: int, end: int) -> bool:
    """Whether the bracketed span is named or shown rather than said."""
    after, before, inside = text[end : end + 25], text[max(0, start - 20) : start], text[start + 1 : end - 1]
    return any(w in after for w in P.CITED_AFTER) or any(w in before for w in P.CITED_BEFORE) or any(w in inside for w in P.CITED_TERMS)


def unquoted_speech(text: str) -> int:
    """Characters of speech that a sentence without brackets begins with."""
    if not re.search("[「」『』（）]", text):
        m = next((m for p in _UNQUOTED if (m := p.search(text))), None)
        if m and _SPEECH.search(m.group(1)):
            return len(m.group(1))
    return 0


def refine(text: str, labels: list[int], confession: float | None = None, tension: float = 0.0, tension_before: float | None = None) -> list[int]:
    """The labels after the three guards, in this order."""
    out = list(labels)
    inside = set()
    for m in _QUOTED.finditer(text):
        span = range(*m.span())
        inside.update(span)
        if is_cited(text, *m.span()):
            out = [CITATION if i in span else NARRATIVE if x == DIALOGUE else x for i, x in enumerate(out)]
    n = unquoted_speech(text)
    if n:
        out = [DIALOGUE if i < n else NARRATIVE if x == DIALOGUE else x for i, x in enumerate(out)]
    if confession is not None:
        share = lambda t: min(1.0, t / 100) if t > 1 else t
        change = 0.0 if tension_before is None else abs(share(tension) - share(tension_before))
        if confession >= (80 if _RECALLED.search(text) else 65) and (change > 0.3 or share(tension) >= 0.3):
            for m in _SPAN.finditer(text):
                if _FREE.search(m.group()):
                    out = [MONOLOGUE if m.start() <= i < m.end() and i not in inside and x in (NARRATIVE, DIALOGUE) else x for i, x in enumerate(out)]
    return out


def refined(df: DataFrame) -> DataFrame:
    """(id, text, labels, confession, tension) -> (id, labels); null texts give null labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(i).to_pylist() for i in range(1, 5)), strict=True)
            got = [None if t is None or x is None else refine(t, x, c, k or 0.0) for t, x, c, k in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.list_(pa.int32()))], names=["id", "labels"])

    kind = df.schema["id"].dataType.simpleString()
    return df.select("id", "text", "labels", F.col("confession").cast("double"), F.col("tension").cast("double")).mapInArrow(run, f"id {kind}, labels array<int>")


def modulated(narrative: Column, monologue: Column, confession: Column, alpha: float = 0.5) -> Column:
    """struct<narrative, monologue>: the share of monologue raised by confession; unchanged without telemetry."""
    up = F.least(F.lit(1.0), F.greatest(F.lit(0.0), monologue * (1 + alpha * confession / 100)))
    return F.when(confession.isNull(), F.struct(narrative.alias("narrative"), monologue.alias("monologue"))).otherwise(F.struct(F.greatest(F.lit(0.0), 1 - up).alias("narrative"), up.alias("monologue")))
