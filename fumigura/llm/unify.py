"""Problem 4: one consistent form of text that looks the same.

Default-ignorable characters go, compatibility normalisation in composed form
follows, every kind of space becomes a space, and on demand letters are folded
(full case folding) or replaced by the letter whose shape they share. The work
is done once per distinct value of a batch.

Null stays null, an empty text stays empty. Where only letter case differs two
texts look different, so the searches here leave case alone; ``fold_case`` is
for comparisons that ignore it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fumigura.llm.common import column, materialize, salted_join, spread

# Letters of one shape, the first of each group stands for all.
SAME_SHAPE = """
A Α А|B Β В|C С Ϲ|E Ε Е|H Η Н|I Ι І Ӏ|J Ј Ϳ|K Κ К|M Μ М|N Ν|O Ο О|P Ρ Р|S Ѕ|T Τ Т|X Χ Х|Y Υ Ү|Z Ζ
W Ԝ|Q Ԛ|G Ԍ|V Ѵ|F Ϝ|a а|c с ϲ|d ԁ|e е|h һ|i і|j ј ϳ|l ӏ|o ο о|p р ρ|q ԛ|s ѕ|v ν ѵ|w ԝ|x х|y у
ニ 二|ハ 八|ロ 口|カ 力|エ 工|タ 夕|ト 卜|ー 一|ノ 丿|ヘ へ|ベ べ|ペ ぺ|Ï Ї|ï ї|Ë Ё|ë ё
"""
_SHAPES = {ord(x): g[0] for g in (part.split() for part in SAME_SHAPE.replace("\n", "|").split("|")) if g for x in g[1:]}

# The property Default_Ignorable_Code_Point.
_IGNORABLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ￰-￸\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0000-\U000e0fff]")
_SPACE = re.compile(r"\s")


def canonical(text: str, fold_case: bool = False) -> str:
    """The consistent form of one text."""
    out = unicodedata.normalize("NFKC", _IGNORABLE.sub("", text))
    out = _SPACE.sub(" ", _IGNORABLE.sub("", out))
    return unicodedata.normalize("NFKC", out.casefold()) if fold_case else out


def looks(text: str) -> str:
    """The form in which texts that look the same are equal."""
    out = canonical(text)
    return out if out.isascii() else unicodedata.normalize("NFC", out.translate(_SHAPES))


def per_distinct(f: Callable[[str], str], columns: dict[str, str]):
    """mapInArrow body: adds the columns ``columns[source]`` = f(source), each distinct value once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, names = list(batch.columns), list(batch.schema.names)
            for source, name in columns.items():
                d = column(batch, source).cast(pa.string()).dictionary_encode()
                made = pa.array([f(x) for x in d.dictionary.to_pylist()], pa.string())
                out.append(pa.DictionaryArray.from_arrays(d.indices, made).cast(pa.string()))
                names.append(name)
            yield pa.RecordBatch.from_arrays(out, names=names)

    return run


def unify(df: DataFrame, source: str, name: str, fold_case: bool = True) -> DataFrame:
    """``df`` with the consistent form of ``source`` as the column ``name``, which must be new."""
    if name in df.columns:
        raise ValueError(f"column {name} exists")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(per_distinct(lambda t: canonical(t, fold_case), {source: name}), f"{schema}, `{name}` string")


def _by_form(df: DataFrame) -> DataFrame:
    """(id, text, form) of the records with a text, in a shared table."""
    rows = df.where(F.col("text").isNotNull() & F.col("id").isNotNull()).select("id", "text").distinct()
    return materialize(rows.mapInArrow(per_distinct(looks, {"text": "form"}), "id string, text string, form string"), "alike-forms")


def alike_records(df: DataFrame) -> DataFrame:
    """(key_a, key_b): ids key_a < key_b of (id, text) whose texts differ but look the same; frequent forms are spread over several tasks."""
    keyed = _by_form(df)
    a, b = (keyed.select("form", F.col("id").alias(f"key_{x}"), F.col("text").alias(f"text_{x}")) for x in "ab")
    return salted_join(a, b, "form", "key_a").where((F.col("key_a") < F.col("key_b")) & (F.col("text_a") != F.col("text_b"))).select("key_a", "key_b").distinct()


def alike_classes(df: DataFrame) -> DataFrame:
    """One row for each id and text of (id, text): id, class_id (the least id that looks the same) and links (other texts that do)."""
    keyed = _by_form(df)
    texts = keyed.groupBy("form", F.xxhash64("text").alias("t")).agg(F.min("id").alias("least"))  # copies of a text become one row before forms meet
    classes = texts.groupBy("form").agg(F.min("least").alias("class_id"), (F.count("*") - 1).alias("links"))
    return keyed.join(classes, "form").select("id", "class_id", "links").distinct()


def alike_columns(df: DataFrame, a: str, b: str) -> DataFrame:
    """The rows of ``df`` whose strings ``a`` and ``b`` differ but look the same; nulls look like nothing."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    keyed = spread(df.where(F.col(a) != F.col(b))).mapInArrow(per_distinct(looks, {a: "_look_a", b: "_look_b"}), f"{schema}, _look_a string, _look_b string")
    return keyed.where("_look_a = _look_b").drop("_look_a", "_look_b")
