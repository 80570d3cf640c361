"""Character tokens with exact offsets, over a vocabulary table.

The ways a character can be found in the vocabulary (itself, a variant, its
compatibility form, a character of that form) are worked out once per distinct
character of the corpus; the corpus itself is then encoded in a projection that
puts a stand-in for each character and reads the ids off those.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fumigura.functions import text as T

# Special tokens, first in the vocabulary.
SPECIAL = ["[PAD]", "[UNK]", "[BOS]", "[EOS]", "[MASK]", "[SEP]", "[CLS]", "[RSV]"]
PAD, UNK, BOS, EOS = 0, 1, 2, 3
#: Code point of the stand-in for id 0; ids have 16 bits, so that stand-ins are code points of the last plane.
STAND_IN, MAP_LIMIT = 0x100000, 65_000


def vocabulary(df: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(ch, token_id, n): the ``size`` most frequent characters after the special tokens; ties by first occurrence in the order of ``key``."""
    seen = df.select(key, F.posexplode(T.chars(F.col(text))).alias("pos", "ch"))
    counts = seen.groupBy("ch").agg(F.count("*").alias("n"), F.min(F.struct(key, "pos")).alias("first"))
    top = counts.orderBy(F.desc("n"), "first").limit(size)
    return top.select("ch", "n", (F.row_number().over(Window.orderBy(F.desc("n"), "first")) - 1 + len(SPECIAL)).cast("int").alias("token_id"))


def lookup(vocab: dict[str, int], variants: dict[str, str]):
    """The way of a character into the vocabulary: (id, whether it isn't there itself)."""

    def find(ch: str) -> tuple[int, bool]:
        if ch in vocab:
            return vocab[ch], False
        form = unicodedata.normalize("NFKC", ch)
        for x in (variants.get(ch), form, variants.get(form), *form):
            if x in vocab:
                return vocab[x], True
        return UNK, True

    return find


def char_table(chars: DataFrame, vocab: dict[str, int], variants: dict[str, str] | None = None) -> DataFrame:
    """(ch) -> (ch, token_id, is_oov), distinct."""
    if len(vocab) > MAP_LIMIT:
        raise ValueError("a character vocabulary of this size isn't one")
    find = lookup(vocab, variants or {})

    def run(batches):
        for b in batches:
            got = [find(c) for c in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.bool_())], names=["ch", "token_id", "is_oov"])

    return chars.select("ch").where("ch is not null").distinct().mapInArrow(run, "ch string, token_id int, is_oov boolean")


def encode(df: DataFrame, key: str, text: str, table: DataFrame) -> DataFrame:
    """(key, ids): one id per code point; empty and null texts have no ids.

    ``table`` has a row for each distinct character at most (there are fewer than
    200,000), which go into the plan; nothing is shuffled.
    """
    ids = {r["ch"]: r["token_id"] for r in table.collect() if r["ch"]}
    stands = F.translate(text, "".join(ids), "".join(chr(STAND_IN + i) for i in ids.values())) if ids else F.col(text)
    known = lambda c: F.when(F.ascii(c) >= STAND_IN, F.ascii(c) - STAND_IN).otherwise(UNK)
    return df.select(key, F.coalesce(F.transform(T.chars(stands), known), F.array().cast("array<int>")).alias("ids"))


def offsets(text: Column) -> Column:
    """array<struct<ch, codepoint_start, utf16_start>> of the characters."""
    kind = "struct<ch:string,utf16_start:int>"
    at = T.placed(T.chars(text), T.utf16_width, lambda ch: F.lit(True), lambda ch, n: F.struct(ch.alias("ch"), n.alias("utf16_start")), kind)
    return F.transform(at, lambda x, i: F.struct(x["ch"].alias("ch"), i.alias("codepoint_start"), x["utf16_start"].alias("utf16_start")))


def to_code_point(starts: Column, utf16: Column) -> Column:
    """The character that holds the UTF-16 unit, by the array ``offsets`` gives; clamped to the text, 0 if it is empty."""
    return F.greatest(F.size(F.filter(starts, lambda x: x["utf16_start"] <= utf16)) - 1, F.lit(0))


def to_utf16(starts: Column, code_point: Column) -> Column:
    """The first UTF-16 unit of the character at ``code_point``, clamped to the text; 0 if it is empty."""
    at = F.least(F.greatest(code_point, F.lit(0)), F.size(starts) - 1)
    return F.coalesce(F.get(starts, at)["utf16_start"], F.lit(0))


def decode(ids: Column, vocab: Column) -> Column:
    """Text of ids by a map<id, character>; special tokens and unknown ids are left out."""
    return F.array_join(F.transform(F.filter(ids, lambda i: i >= len(SPECIAL)), lambda i: F.coalesce(F.try_element_at(vocab, i), F.lit(""))), "")
