"""Problem 5: sentence units across languages and scripts.

Cascading rule tables: a line's places after end marks, after closing quotes
and at spaces of scripts without end marks are candidates; for each, the table
of the language and then the common table are tried in order, and the first
pair of expressions (before, after) that matches decides: break or none.
Balanced quotes and brackets are never divided, line breaks always end a unit.

Null and blank texts have no unit. Unbalanced brackets protect nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fumigura.llm.common import column, distinct_spread

#: Opening marks and what closes them.
PAIRS = {"「": "」", "『": "』", "（": "）", "(": ")", "【": "】", "〈": "〉", "《": "》", "〔": "〕", "［": "］", "[": "]", "“": "”", "„": "“”", "«": "»", "‹": "›", "｢": "｣"}
_CLOSING = "".join(PAIRS.values())
_MARKS = "。．｡！？!?।॥.…‥"
_CANDIDATE = regex.compile(rf"[{regex.escape(_MARKS)}]+[{regex.escape(_CLOSING)}’\"]*")
_NO_MARKS_SCRIPT = "฀-໿ក-៿"
_BARE_SPACE = regex.compile(rf"(?<=[{_NO_MARKS_SCRIPT}])\s+(?=[{_NO_MARKS_SCRIPT}“«(])")
_LINE = regex.compile(r"[^\r\n  \u0085\v\f]+")

BREAK, GO_ON = True, False
#: What carries on a Japanese sentence after quoted matter or an exclamation: particles, but not words that begin like them.
_CARRY = r"(?:と(?!ころ|きに|きどき|にかく|もかく|うとう|たん|なり|びら|も)|って|という|を|に(?!わか|こ|や|も)|が(?!、)|は(?!じ|る|や|た|な|い)|の(?!ち|ん|ど)|で(?!も|は|、|き)|など|から(?!す)|まで|へ(?!や)|や(?!が|は|っ)|も(?!っと|う|し|ち|は|の)|だ(?!が|け|か))"

Rule = tuple[bool, str, str]
#: Rules of all languages, tried last.
COMMON: list[Rule] = [
    (GO_ON, r"》", r"\s*\S"),
    (GO_ON, r"\d[.．]", r"\d"),
    (BREAK, r"[\p{Hiragana}\p{Katakana}\p{Han}]\.", r"[^\d.]|$"),
    (GO_ON, r"[A-Za-z]．", r"[\p{L}\d]"),
    (GO_ON, r"\.", r"\S"),
    (GO_ON, r"(?:^|[^\p{L}\p{M}])\p{Lu}\.", r"\s"),
    (GO_ON, r"(?:^|[^\p{L}\p{M}])\p{Ll}\.", r"\s?\p{L}\."),
    (GO_ON, r".", r"\s*[,;:，、；：]"),
    (GO_ON, r".", r"\s+[–—]\s"),
    (GO_ON, r".", r"\s*\p{Ll}"),
    (GO_ON, r"[…‥]", r"[^\s]"),
]
_TITLES = r"(?:^|[^\p{L}\p{M}.])(?:Mr|Mrs|Ms|Dr|Prof|St|Ste|Capt|Col|Gen|Lt|Sgt|Rev|Hon|Mt|Messrs|Mme|Mlle|MM|Hr|Fr)\."
_CITED = r"(?:^|[^\p{L}\p{M}.])(?:[Nn]os?|[Nn]r|[Vv]ol|[Pp]p?|[Cc]h|[Cc]f|[Ff]igs?|[Ss]ec|[Aa]rt|[Bb]d|[Vv]gl|[Bb]zw|[Cc]a|[Ee]d|[Ee]ds|[Mm]s|[Mm]ss|[Vv]s|chap|éd|env|fol|hrsg|Jh|Abb|Kap|Anm|e\.\s?g|i\.\s?e|z\.\s?B|d\.\s?h|u\.\s?a|s\.\s?o|p\.\s?ex)\."
_LATIN: list[Rule] = [(GO_ON, _TITLES, r"\s"), (GO_ON, _CITED, r"\s")]
_MONTHS = "Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember"
#: Rules by language, tried before the common ones.
RULES: dict[str, list[Rule]] = {
    "en": _LATIN,
    "fr": _LATIN,
    "de": [(GO_ON, r"(?:^|\D)\d{1,2}\.", rf"\s+(?:{_MONTHS})\b"), (GO_ON, r"\b(?:[Aa]m|[Vv]om|[Zz]um|[Bb]is|[Dd]e[rmsn])\s\d{1,2}\.", r"\s"), *_LATIN],
    "ja": [(GO_ON, rf"[{regex.escape(_CLOSING)}]", _CARRY), (GO_ON, r"[！？!?]", r"(?:と(?!ころ|きに|きどき|にかく|もかく|うとう|たん|も)|って)"), (GO_ON, r"[…‥]", r"[^\s」』）】]"), *_LATIN],
    "zh": [(GO_ON, r"[”’」』》]", r"(?:的|地|之|了|着)"), *_LATIN],
    "ko": [(GO_ON, r"[”’」』»)]", r"(?:\p{Hangul}|\s*(?:하고|라고|라는|라며|고)\s)"), *_LATIN],
    "hi": _LATIN,
    "th": _LATIN,
}
_ANY: list[Rule] = [RULES["de"][0], *_LATIN]


def _compiled(rules: list[Rule]) -> list[tuple[bool, regex.Pattern, regex.Pattern]]:
    return [(b, regex.compile(rf"(?:{x})$"), regex.compile(y)) for b, x, y in rules]


_TABLES = {k: _compiled(v + COMMON) for k, v in RULES.items()}
_DEFAULT = _compiled(_ANY + COMMON)
_SCRIPTS = [("ja", regex.compile(r"[\p{Hiragana}\p{Katakana}]")), ("ko", regex.compile(r"\p{Hangul}")), ("th", regex.compile(r"\p{Thai}")), ("hi", regex.compile(r"\p{Devanagari}")), ("zh", regex.compile(r"\p{Han}"))]


def rule_table(text: str, lang: str | None):
    if lang not in _TABLES:
        lang = next((k for k, p in _SCRIPTS if p.search(text)), None)
    return _TABLES.get(lang, _DEFAULT)


def protected_spans(line: str) -> list[tuple[int, int]]:
    """Outermost balanced quotes and brackets, [start, end)."""
    stack: list[tuple[str, int]] = []
    spans: list[tuple[int, int]] = []
    for i, ch in enumerate(line):
        at = next((k for k in range(len(stack) - 1, -1, -1) if ch in PAIRS[stack[k][0]]), None) if ch in _CLOSING else None
        if at is not None:
            start = stack[at][1]
            del stack[at:]
            while spans and spans[-1][0] >= start:
                spans.pop()
            spans.append((start, i + 1))
        elif ch in PAIRS:
            stack.append((ch, i))
    return spans


def _line_ends(line: str, table) -> Iterator[int]:
    spans = protected_spans(line)
    found = set()
    k = 0
    for m in _CANDIDATE.finditer(line):
        s, e = m.span()
        while k < len(spans) and spans[k][1] <= s:
            k += 1
        if k < len(spans) and spans[k][0] <= s < spans[k][1]:  # inside quoted matter: the place is after it, if the marks stand at its end
            close = spans[k][1]
            inner = line[s:close].rstrip(_CLOSING + " 　’\"")
            if all(c in _MARKS for c in inner):
                tail = _CANDIDATE.match(line, close)
                if not tail:
                    found.add(close)
        else:
            found.add(e)
    found.update(m.end() for m in _BARE_SPACE.finditer(line) if not any(s < m.start() < e for s, e in spans))
    for e in sorted(found):
        before, after = line[max(0, e - 40) : e], line[e : e + 40]
        if line[e - 1].isspace():
            yield e
            continue
        verdict = next((b for b, x, y in table if x.search(before) and y.match(after)), BREAK)
        if verdict:
            yield e


def sentence_ends(text: str | None, lang: str | None = None) -> list[int]:
    """Code points up to and including the last non-blank character of each sentence unit."""
    if not text or text.isspace():
        return []
    table, out = rule_table(text, lang), []
    for m in _LINE.finditer(text):
        line, base, start = m.group(), m.start(), 0
        for e in [*_line_ends(line, table), len(line)]:
            unit = line[start:e].rstrip()
            if unit.strip():
                out.append(base + start + len(unit))
            start = e
    return out


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends = [sentence_ends(t, g) for t, g in zip(column(batch, "text").to_pylist(), column(batch, "lang").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([column(batch, "row_id"), column(batch, "text"), pa.array(ends, pa.list_(pa.int32()))], names=["row_id", "text", "ends"])


def sentence_units(df: DataFrame) -> DataFrame:
    """(row_id, idx, end_pos, sentence) of (row_id long, text, lang); repeated rows count once."""
    rows = df.where(F.col("text").isNotNull()).select("row_id", "text", "lang")
    done = distinct_spread(rows).mapInArrow(_units, "row_id long, text string, ends array<int>")
    units = done.select("row_id", "text", "ends", F.posexplode("ends").alias("idx", "end_pos"))
    begin = F.when(F.col("idx") == 0, 0).otherwise(F.get("ends", F.col("idx") - 1))
    sentence = F.regexp_replace(F.substring("text", F.col("begin") + 1, F.col("end_pos") - F.col("begin")), r"(?U)^\s+", "")
    return units.withColumn("begin", begin).select("row_id", "idx", "end_pos", sentence.alias("sentence"))
