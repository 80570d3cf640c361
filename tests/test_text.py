"""Text functions against examples and against plain Python."""

import re

from pyspark.sql import functions as F

from fumigura.functions import text as T
from fumigura.operators import annotate, corpus, normalizer

ODD = ["", "　", "𠮷野家が。", "「開いたまま", "閉じた」だけ", "時々々、山々", "a\n\nb。", "！？", "が" * 300, "彼は｜硝子戸《ガラスど》の［＃傍点］中", "（心）の「声」と『本』。"]


def one(spark, f, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.select("i", f(F.col("t")).alias("x")).orderBy("i").select("x").collect()]


def test_sentences(spark):
    assert len(one(spark, T.sentences, "主人公は立ち上がった。闇の中で不気味な音が響く！誰だ？")[0]) == 3
    assert one(spark, lambda c: T.sentences(c, keep_tail=False), "終わり。途中")[0] == ["終わり。"]
    for t, got in zip(ODD, one(spark, T.sentences, *ODD), strict=True):
        assert got == [s for s in re.findall("[^。！？!]*[。！？!]|[^。！？!]+", t) if s.strip()]
    assert one(spark, T.sentences, None) == [None]


def test_spans_cover_positions(spark):
    for t, got in zip(ODD, one(spark, T.particles, *ODD), strict=True):
        assert [(x["start"], x["text"]) for x in got] == [(m.start(), m.group()) for m in re.finditer("より|から|まで|[がをにでとへの]", t)]
    assert [x["start"] for x in one(spark, T.particles, "𠮷が城まで")[0]] == [1, 3]


def test_segments(spark):
    df = spark.createDataFrame([("a", "月明かりが回廊を照らしていた。「そこを動くな！」少年は剣を構えた。『伝説の聖剣』が輝く。"), ("b", None), ("c", "　\n")], "id string, t string")
    rows = corpus.segments(df, "id", "t").orderBy("part_no", "sent_no").collect()
    assert [r["segment"] for r in rows if r["is_dialogue"]] == ["「そこを動くな！」", "『伝説の聖剣』"]
    assert {r["id"] for r in rows} == {"a"}


def test_case_particles(spark):
    got = one(spark, annotate.case_particles, "彼が街へ走った。")[0]
    assert [(p["particle"], p["span"], p["target_noun"]) for p in got] == [("が", [1, 2], "彼"), ("へ", [3, 4], "街")]


def test_labels_have_the_texts_length(spark):
    texts = [t for t in ODD if t]
    for f in (annotate.action_labels, annotate.entity_labels, annotate.dependency_labels):
        assert [len(x) for x in one(spark, f, *texts)] == [min(256, len(t)) for t in texts]
    for t, x in zip(texts, one(spark, lambda c: corpus.modality_labels(c, F.lit(False)), *texts), strict=True):
        assert len(x) == len(t)
    assert one(spark, lambda c: corpus.modality_labels(c, F.lit(False)), "（心）の「声」")[0] == [2, 2, 2, 0, 1, 1, 1]


def test_repetition_and_markup(spark):
    assert one(spark, T.expand_repetition, "時々々、山々") == ["時時々、山山"]
    assert one(spark, T.expand_kana_repetition, "時々、山々の木々が揺れる。") == ["時時、山山の木木が揺れる。"]
    assert one(spark, T.strip_markup, "彼は｜硝子戸《ガラスど》の［＃「硝子戸」に傍点］中から") == ["彼は硝子戸の中から"]


def test_body(spark):
    raw = "題\n-------\n記号\n-------\n本文一\n本文二\n底本：某\n後"
    assert one(spark, T.body, raw, "見出しなし", None) == ["本文一\n本文二", "見出しなし", None]


def test_brackets(spark):
    got = one(spark, T.bracket_balance, "「『あ』」", "「あ", "あ」", "「あ』」")
    assert [(x["unclosed"], x["unopened"]) for x in got] == [(0, 0), (1, 0), (0, 1), (0, 1)]
    for t, x in zip(ODD, one(spark, T.bracket_balance, *ODD), strict=True):
        stack, bad = normalizer.unmatched(t, 0, len(t))
        assert (x["unclosed"], x["unopened"]) == (len(stack), len(bad))


def test_normalizer():
    clean, source, back, ruby = normalizer.normalize("彼は｜硝子戸《ガラスど》の［＃「硝子戸」に傍点］中から外を見た。")
    assert clean == "彼は硝子戸の中から外を見た。" and len(ruby) == 1 and ruby[0][4:] == (2, 5)
    clean, source, *_ = normalizer.normalize("彼女は《《真実》》を知っていた。")
    assert clean == "彼女は真実を知っていた。" and source[3] == 5
    for raw in ODD + ["《", "｜《》", "《《》", "𠮷《よし》"]:
        clean, source, back, _ = normalizer.normalize(raw)
        assert [raw[i] for i in source] == list(clean) and all(back[s] == i for i, s in enumerate(source))


def test_snap():
    assert normalizer.snap("短文です。", 2)["text"] == "短文です。" and not normalizer.snap("短文です。", 2)["snapped_start"]
    text = "あいうえお。「かきくけこ」" * 60
    for caret in range(0, len(text), 37):
        w = normalizer.snap(text, caret)
        assert w["start_index"] <= caret <= w["end_index"] and w["end_index"] - w["start_index"] <= 256
        assert text[w["start_index"] : w["end_index"]] == w["text"]


def test_epistemic_and_connective(spark):
    df = spark.createDataFrame([("嬉しいと思った。", False), ("私は行く", False), ("と思った", True), ("嬉しいらしい", False)], "t string, d boolean")
    assert [r[0] for r in df.select(T.epistemic_score(F.col("t"), F.col("d"))).collect()] == [0.8, 0.5, 0.1, 0.4]
    assert one(spark, T.connective, "しかし雨", "だからだ", "雨", "そして") == [2, 1, 0, 3]
