"""Column functions on text: all of them plain expressions that stay in the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from fumigura import profiles as P

ENDS = "。！？!"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once: a name in a lambda would be worked out anew for each element."""
    return F.transform(F.array(value), use)[0]


def strip(c: Column) -> Column:
    """Outer white space of any kind removed, the ideographic space too."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    return ~c.rlike(r"(?U)\S")


def any_of(c: Column, words: list[str]) -> Column:
    """Whether any of ``words`` occurs."""
    return c.rlike("|".join(re.escape(w) for w in words))


def strip_markup(c: Column) -> Column:
    """Annotations, then ruby readings (their base stays), then bars removed."""
    for pattern, new in ((r"［＃[^］]*］", ""), (r"｜([^《\n]+)《([^》\n]+)》", "$1"), (r"([一-龠々〆ヵヶ]+)《([^》\n]+)》", "$1"), (r"《[^》\n]*》", ""), ("｜", "")):
        c = F.regexp_replace(c, pattern, new)
    return c


def quick_clean(c: Column) -> Column:
    """Readings, bars, annotations and everything between two rules of dashes removed."""
    for pattern in ("《.*?》", "｜", "［＃.*?］", "(?s)-{5,}.*?-{5,}"):
        c = F.regexp_replace(c, pattern, "")
    return c


def rubies(c: Column) -> Column:
    """array<struct<base, reading>> of the simple rubies."""
    pattern = F.lit(r"([一-龠々〆ヵヶ]+)《([^》\n]+)》")
    return F.arrays_zip(F.regexp_extract_all(c, pattern, 1).alias("base"), F.regexp_extract_all(c, pattern, 2).alias("reading"))


def escaped_rubies(c: Column) -> Column:
    """array<struct<base, reading>> of the rubies whose base a bar marks."""
    pattern = F.lit(r"｜([^《\n]+)《([^》\n]+)》")
    return F.arrays_zip(F.regexp_extract_all(c, pattern, 1).alias("base"), F.regexp_extract_all(c, pattern, 2).alias("reading"))


def body(c: Column) -> Column:
    """Text between the second rule of dashes and the colophon; the whole text where there is none. Null stays null."""
    lines = F.transform(F.split(c, r"\r?\n"), lambda x, i: F.struct(x.alias("line"), strip(x).alias("s"), i.alias("i")))

    def inside(lines: Column) -> Column:
        second = F.try_element_at(F.filter(lines, lambda x: x["s"].startswith("-------")), F.lit(2))["i"]
        return let(F.slice(lines, second + 2, F.greatest(F.size(lines), F.lit(1))), until)

    def until(after: Column) -> Column:
        stop = F.try_element_at(F.filter(after, lambda x: x["s"].startswith("底本：") | x["s"].startswith("［＃本文終わり］")), F.lit(1))["i"]
        kept = F.filter(F.slice(after, 1, F.coalesce(stop - F.get(after, F.lit(0))["i"], F.size(after), F.lit(0))), lambda x: ~x["s"].startswith("-------"))
        return F.transform(kept, lambda x: x["line"])

    whole = lambda kept: F.when(F.size(kept) > 0, F.array_join(kept, "\n")).otherwise(c)
    return F.when(c.contains("-------"), let(let(lines, inside), whole)).otherwise(c)


#: Elements folded at once: appending to an array copies it.
BLOCK = 256


def placed(parts: Column, width: Callable[[Column], Column], keep: Callable[[Column], Column], make: Callable[[Column, Column], Column], kind: str) -> Column:
    """``make(part, start)`` of the parts to ``keep``, where ``start`` is the sum of the widths before.

    Folded block by block: the arrays that grow stay short, and the work in proportion to the parts.
    """

    def within(block: Column, at: Column) -> Column:
        step = lambda acc, x: F.struct((acc["at"] + width(x)).alias("at"), F.when(keep(x), F.concat(acc["out"], F.array(make(x, acc["at"])))).otherwise(acc["out"]).alias("out"))
        return F.aggregate(block, F.struct(at.alias("at"), F.array().cast(f"array<{kind}>").alias("out")), step, lambda acc: acc["out"])

    def all_of(parts: Column) -> Column:
        few = within(parts, F.lit(0))
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / BLOCK)), lambda b: F.slice(parts, (b * BLOCK + 1).cast("int"), F.lit(BLOCK)))
        sized = F.transform(blocks, lambda b: F.struct(b.alias("b"), F.aggregate(b, F.lit(0), lambda n, x: n + width(x)).alias("n")))
        nested = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        many = F.aggregate(sized, nested, lambda acc, b: F.struct((acc["at"] + b["n"]).alias("at"), F.concat(acc["out"], F.array(within(b["b"], acc["at"]))).alias("out")), lambda acc: F.flatten(acc["out"]))
        return F.when(F.size(parts) <= BLOCK, few).otherwise(many)

    return let(parts, all_of)


def expand_repetition(c: Column) -> Column:
    """The mark of repetition after a kanji replaced by that kanji."""
    return F.regexp_replace(c, "([一-鿿])々", "$1$1")


def expand_kana_repetition(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "([一-龠])々", "$1$1"), "([ぁ-ん])[ゝゞ]", "$1$1")


def sentences(c: Column, ends: str = ENDS, keep_tail: bool = True) -> Column:
    """Sentences with their end mark, blank ones dropped; linear, as every match starts where the last ended."""
    out = F.filter(F.split(c, f"(?<=[{ends}])"), lambda s: s.rlike(r"(?U)\S"))
    return out if keep_tail else F.filter(out, lambda s: s.rlike(f"[{ends}]$"))


def find_spans(c: Column, pattern: str) -> Column:
    """array<struct<start, end, text>> of all matches, in code points; ``pattern`` has no groups of its own.

    One pass cuts the text into matches and what lies between them; a piece
    between can't match as a whole, as no match begins at its first character.
    Texts without a match are passed over by a plain search.
    """
    kind = "struct<start:int,end:int,text:string>"
    parts = F.regexp_extract_all(c, F.lit(f"(?s)(?:{pattern})|(?:(?!{pattern}).)+"), F.lit(0))
    hit = lambda x, at: F.struct(at.alias("start"), (at + F.length(x)).alias("end"), x.alias("text"))
    found = placed(parts, F.length, lambda x: x.rlike(rf"(?s)\A(?:{pattern})\z"), hit, kind)
    return F.when(c.isNull(), F.lit(None).cast(f"array<{kind}>")).when(c.rlike(f"(?s){pattern}"), found).otherwise(F.array().cast(f"array<{kind}>"))


def sentence_spans(c: Column) -> Column:
    """Sentences with offsets; a line break ends one too, blank ones are left out."""
    return F.filter(find_spans(c, "[^。\n!！?？]*[。\n!！?？]|[^。\n!！?？]+$"), lambda s: s["text"].rlike(r"(?U)\S"))


CLAUSE = "[^、―─「」『』（）…：；\n]+(?:[、―─「」『』（）…：；\n]|$)"


def clause_spans(c: Column) -> Column:
    """Clauses with offsets; the whole sentence if there is none."""
    found = F.filter(find_spans(c, CLAUSE), lambda s: s["text"].rlike(r"(?U)\S"))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length(c).alias("end"), c.alias("text")))
    return F.when((F.size(found) == 0) & ~is_blank(c), whole).otherwise(found)


def quoted_parts(c: Column) -> Column:
    """The text cut before and after each closed 「…」 or 『…』."""
    q = "「[^」]*」|『[^』]*』"
    return F.regexp_extract_all(c, F.lit(f"(?s){q}|(?:(?!{q}).)+"), F.lit(0))


def bracket_balance(c: Column, pairs: list[str] = P.BRACKETS) -> Column:
    """struct<unclosed, unopened>: brackets left open, and closing ones without an opening one on top."""
    opens = "".join(p[0] for p in pairs)
    closes = "".join(p[1] for p in pairs)
    marks = F.regexp_extract_all(c, F.lit(f"[{re.escape(opens + closes)}]"), F.lit(0))
    start = F.struct(F.lit("").alias("stack"), F.lit(0).alias("bad"))

    def step(acc: Column, m: Column) -> Column:
        top = F.right(acc["stack"], F.lit(1))
        opening = F.lit(opens).contains(m)
        fits = (acc["stack"] != "") & (top == F.translate(m, closes, opens)) & ~opening
        rest = F.left(acc["stack"], F.length(acc["stack"]) - 1)
        return F.struct(F.when(opening, F.concat(acc["stack"], m)).when(fits, rest).otherwise(acc["stack"]).alias("stack"), (acc["bad"] + (~opening & ~fits).cast("int")).alias("bad"))

    return F.aggregate(marks, start, step, lambda acc: F.struct(F.length(acc["stack"]).alias("unclosed"), acc["bad"].alias("unopened")))


def chars(c: Column) -> Column:
    """The text's code points."""
    return F.filter(F.split(c, ""), lambda x: x != "")


def utf16_width(ch: Column) -> Column:
    return F.when(F.ascii(ch) > 0xFFFF, 2).otherwise(1)


def epistemic_score(c: Column, is_dialogue: Column) -> Column:
    """How far a sentence shows an inner state, 0 to 1."""
    inner = F.when(any_of(c, P.INTERNAL), 0.8).otherwise(0.0)
    soft = F.when(any_of(c, P.CONJECTURE), F.greatest(F.lit(0.2), inner * 0.5)).otherwise(inner)
    own = F.when(any_of(c, ["私", "僕", "俺"]), F.greatest(soft, F.lit(0.5))).otherwise(soft)
    return F.when(is_dialogue, 0.1).otherwise(F.least(F.lit(1.0), own))


def connective(c: Column) -> Column:
    """Relation of the connective the text begins with, 0 if none."""
    out = F.lit(0)
    for number, words in reversed(P.CONNECTIVES):
        out = F.when(c.rlike("^(?:" + "|".join(words) + ")"), number).otherwise(out)
    return out


def particles(c: Column) -> Column:
    """Case particles from left to right, longest first: array<struct<start, end, text>>."""
    return find_spans(c, "|".join(P.PARTICLES))


def particle_target(c: Column, start: Column) -> Column:
    """The noun before a particle: the last word of the fifteen characters before it, else the four characters."""
    begin = F.greatest(F.lit(0), start - 15)
    before = F.substring(c, begin + 1, start - begin)
    words = F.filter(F.split(before, r"[、。！？「」『』\s　]|(?:より|から|まで|が|を|に|で|と|へ|の)"), lambda w: w != "")
    four = F.greatest(F.lit(0), start - 4)
    return F.when(F.size(words) > 0, F.element_at(words, -1)).otherwise(F.substring(c, four + 1, start - four))


def code_units(c: Column) -> Column:
    """The text's UTF-16 code units as numbers."""
    n = F.ascii
    pair = lambda ch: F.array(F.shiftright(n(ch) - 0x10000, 10) + 0xD800, (n(ch) - 0x10000).bitwiseAND(0x3FF) + 0xDC00)
    return F.flatten(F.transform(chars(c), lambda ch: F.when(n(ch) > 0xFFFF, pair(ch)).otherwise(F.array(n(ch)))))


def occurrences(c: Column, word: str) -> Column:
    """Start of every occurrence of ``word``, not overlapping itself."""
    return F.transform(find_spans(c, re.escape(word)), lambda s: s["start"])
