"""Leak search, split overlap and near-duplicates against brute force, and on odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fumigura.llm import common, leak, neardup, overlap, unify
from fumigura.llm.common import comparison_form, edit_distance_at_most

PARTS = ["森の奥で", "古い鍵を", "静かに拾って", "町へ向かった", "誰も知らない", "雨の夜に", "彼女は笑い", "塔の上から", "手紙を読んで", "『そうか』と", "言った。", "羽根のように軽い", "ＡＢＣ", "x", "々", "Wien"]


def texts(n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        t = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12)))
        out.append(t)
        if rng.random() < 0.4 and len(t) > 5:  # a variant
            i = rng.randrange(len(t))
            out.append(t[:i] + rng.choice(["", "ー", "、", "二三"]) + t[i + rng.randint(0, 2) :])
        if rng.random() < 0.1:
            out.append(rng.choice(out))
    return out + ["", "　", "。", "短", None, "長" * 5000]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_comparison_form():
    assert comparison_form("｜硝子戸《ガラスど》の［＃注］Ａ１ ﾎﾞ、_x") == "硝子戸のA1ボx"
    assert comparison_form(None) == comparison_form("") == comparison_form("《》") == ""


def test_edit_distance():
    rng = random.Random(3)
    for _ in range(500):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 15))) for _ in range(2))
        for k in range(6):
            assert edit_distance_at_most(a, b, k) == (distance(a, b) <= k)


def test_leaks(frame):
    corpus, items = texts(120, 1), texts(30, 2)
    items += [t[3:60] for t in corpus if t and len(t) > 40][:10]
    c = frame([(f"c{i}", t, 1) for i, t in enumerate(corpus)] * 2, "id string, text string, h int")
    g = frame([(f"i{i}", t) for i, t in enumerate(items)], "id string, text string")
    got = {tuple(r) for r in leak.leaked_runs(c, g).collect()}
    runs = lambda t: {t[k : k + 24] for k in range(len(t) - 23)}
    in_items = [runs(comparison_form(u)) for u in items]
    assert got == {(f"c{i}", f"i{j}") for i, t in enumerate(corpus) for r in [runs(comparison_form(t))] for j, u in enumerate(in_items) if r & u} and got


def test_leaks_of_nothing(frame):
    empty = frame([], "id string, text string")
    some = frame([("a", "あ" * 40), ("b", None)], "id string, text string")
    assert leak.leaked_runs(empty, some).count() == leak.leaked_runs(some, empty).count() == 0


def test_leak_with_one_edit(frame):
    item = "むかしむかしあるところにお爺さんとお婆さんが住んでいました"
    c = frame([("near", "前置き" + item[:17] + "X" + item[18:] + "後")], "id string, text string")
    got = leak.leaked_passages(c, frame([("i", item)], "id string, text string")).collect()
    assert [(r["corpus_id"], r["errors"]) for r in got] == [("near", 1)] and got[0]["run_len"] < 24


def test_leaks_of_any_alignment(frame):
    rng = random.Random(11)
    letter = lambda: chr(0x4E00 + rng.randrange(3000))
    corpus, items = [], []
    for k in range(100):
        item = [letter() for _ in range(rng.randint(24, 60))]
        p = rng.randint(0, len(item) - 24)
        part, e = item[p : p + 24], rng.randrange(24)
        part[e : e + rng.choice([0, 1, 1])] = [letter()] * rng.randint(0, 1)
        if k % 4 == 0:  # a second edit
            part[(e + 5) % 20] = letter()
        items.append("".join(item))
        corpus.append("".join([letter() for _ in range(rng.randint(0, 9))] + part + [letter() for _ in range(rng.randint(0, 9))]))

    def near(u, t):  # least edits of a passage of u in t
        best = 2
        for p in range(len(u) - 23):
            row = [0] * (len(t) + 1)
            for a in u[p : p + 24]:
                new = [row[0] + 1]
                for j, b in enumerate(t):
                    new.append(min(row[j] + (a != b), row[j + 1] + 1, new[-1] + 1))
                row = new
            best = min(best, *row)
        return best

    c = frame([(str(k), t) for k, t in enumerate(corpus)], "id string, text string")
    g = frame([(str(k), t) for k, t in enumerate(items)], "id string, text string")
    got = {(r["corpus_id"], r["item_id"]): r["errors"] for r in leak.leaked_passages(c, g).collect()}
    want = {(str(k), str(k)): n for k, (u, t) in enumerate(zip(items, corpus, strict=True)) if (n := near(u, t)) < 2}
    assert got == want and 60 < len(want) < 100


def jaccard(a, b):
    x, y = ({f[k : k + 3] for k in range(len(f) - 2)} for f in map(comparison_form, (a, b)))
    return len(x & y) / len(x | y) if x | y else float(comparison_form(a) == comparison_form(b))


@pytest.mark.parametrize("hot", [20_000, 2])
def test_near_duplicates(frame, monkeypatch, hot):
    monkeypatch.setattr(neardup, "HOT", hot)  # hot groups are split, with the same result
    rows = [(f"r{i:04d}", t, i) for i, t in enumerate(texts(150, 5))]
    df = frame(rows + rows[:20], "id string, text string, form int")
    got = {tuple(r) for r in neardup.near_duplicate_pairs(df).collect()}
    want = {(a, b) for a, t, _ in rows for b, u, _ in rows if a < b and t and u and comparison_form(t) and comparison_form(u) and jaccard(t, u) >= 0.7 - 1e-9}
    assert got == want and len(want) > 20


def test_copies_of_a_third(frame):
    rows = [(f"c{i:03d}", "同じ文がここに何度も出てくる。") for i in range(40)] + [(f"d{i:03d}", f"ほかの文その{i}は{i * 7}ばかり違う。") for i in range(80)]
    got = neardup.near_duplicate_pairs(frame(rows, "id string, text string"))
    assert got.where("id_a like 'c%' and id_b like 'c%'").count() == 40 * 39 // 2


def test_groups(frame):
    rows = [("a", "森の奥で古い鍵を静かに拾って町へ向かった"), ("b", "森の奥で古い鍵を静かに拾って町へ向かった。"), ("c", "森の奥で古い鍵を静かに拾って町へ向かったよ"), ("d", "まったく別の話をここに書いておく"), ("e", None), ("f", "")]
    got = {r["id"]: (r["group_id"], r["links"]) for r in neardup.near_duplicate_groups(frame(rows, "id string, text string")).collect()}
    assert got == {"a": ("a", 1), "b": ("a", 1), "c": ("a", 1), "d": ("d", 0)}


def test_components(frame):
    rng = random.Random(4)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    root = {x: x for p in pairs for x in p}
    for _ in range(400):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["root"] for r in neardup.components(frame(pairs, "a long, b long")).collect()}
    assert got == {x: root[x] for a, b in pairs if a != b for x in (a, b)}


def test_overlap(frame):
    train, val = texts(120, 7), texts(60, 8)
    val += [t[:9] + "Z" + t[10:] for t in train if t and len(t) > 20][:20] + [t for t in train if t][:10]
    t = frame([(i, "s", x) for i, x in enumerate(train)] * 2, "rec_id long, source string, text string")
    v = frame([(10_000 + i, None, x) for i, x in enumerate(val)], "rec_id long, source string, text string")
    got = {(r["rec_id_a"], r["rec_id_b"]) for r in overlap.overlaps(t, v).collect()}
    f = comparison_form
    want = {(i, 10_000 + j) for i, x in enumerate(train) for j, y in enumerate(val) if f(x) and f(y) and abs(len(f(x)) - len(f(y))) < 30 and len(f(x)) < 300 and distance(f(x), f(y)) <= max(len(f(x)), len(f(y))) // 10}
    want |= {(i, 10_000 + j) for i, x in enumerate(train) for j, y in enumerate(val) if x and x == y and f(x)}
    assert got == want and len(want) > 25
    report = overlap.overlap_report(t, v).collect()
    assert sum(r["records"] for r in report) == len(train) + len(val)


def test_looks(frame):
    same = [("ﾎﾞ", "ボ"), ("Ａ", "A"), ("é", "é"), ("a​b", "ab"), ("a b", "a b"), ("А", "A"), ("ニ", "二"), ("ヘ", "へ"), ("①", "1"), ("見", "見")]
    other = [("a", "A"), ("シ", "ツ"), ("国", "國"), ("ば", "は"), ("ッ", "ツ"), ("B", "8"), ("é", "e")]
    df = frame([(i, a, b, 1) for i, (a, b) in enumerate(same + other + [(None, "a"), ("a", None), ("a", "a"), ("", "")])], "k int, a string, b string, form int")
    assert sorted(r["k"] for r in unify.alike_columns(df, "a", "b").collect()) == list(range(len(same)))
    rows = frame([("1", "Ｎｏｖａ"), ("2", "Nova"), ("3", "nova"), ("4", None), ("5", "Nova"), ("2", "Nova")], "id string, text string")
    assert sorted(map(tuple, unify.alike_records(rows).collect())) == [("1", "2"), ("1", "5")]
    assert [r["f"] for r in unify.unify(rows, "text", "f").where(F.col("id") < "4").orderBy("id").collect()][:3] == ["nova"] * 3


def test_filter_grows_with_its_keys(frame, monkeypatch):
    monkeypatch.setattr(common, "FILTER_BITS", (8, 30))
    rng = np.random.default_rng(3)
    keys = rng.integers(-(2**63), 2**63 - 1, 5000)
    f = common.KeyFilter(frame([(int(k),) for k in keys], "k long"), "k")  # far more keys than the least number of slots
    assert f.may_hold(keys.view(np.uint64)).all() and f.may_hold(rng.integers(0, 2**63 - 1, 20_000).view(np.uint64)).mean() < 0.2


def test_salted_join(frame, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    left = frame([(1 if i % 3 == 0 else i, i) for i in range(200)], "k long, x int")
    right = frame([(1, "a"), (1, "b"), (4, "c"), (None, "d")], "k long, y string")
    got = sorted(map(tuple, common.salted_join(left, right, "k", "x").select("k", "x", "y").collect()))
    assert got == sorted(map(tuple, left.join(right, "k").select("k", "x", "y").collect())) and len(got) > 100


@pytest.mark.parametrize("hot", [10_000, 5])
def test_leaks_of_copies(frame, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    stock = "むかしむかしあるところにお爺さんとお婆さんが住んでいました"
    c = frame([(f"c{i}", f"{i}番目の話。" + stock) for i in range(30)] + [(f"d{i}", stock) for i in range(30)] + [(None, stock), ("e", "短い")], "id string, text string")
    g = frame([("i1", stock), ("i2", stock), ("i3", None), (None, stock)], "id string, text string")
    got = leak.leaked_runs(c, g).collect()
    assert len(got) == 120 and {r["item_id"] for r in got} == {"i1", "i2"}
