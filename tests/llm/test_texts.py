"""Chunks, sentences, encoding, mixing, sampling and repair of garbled text."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fumigura.llm import bpe, chunk, common, mixing, mojibake, sentences, stratify


def units(text, lang=None):
    out, start = [], 0
    for e in sentences.sentence_ends(text, lang):
        out.append(text[start:e].strip())
        start = e
    return out


@pytest.mark.parametrize(
    ("lang", "parts", "joint"),
    [
        ("ja", ["「来たか。もう遅い！」と彼は言った。", "２．８キロ歩いた｡", "そして……扉が開いた．", "『おい。来い！？』", "もっとも、St.グレタは芝居『鍵！』を観た。"], ""),
        ("en", ["“Stop!” said Mr. Penhale.", "See No. 2, vol. 1, p. 41 for it.", "He waited... and then ran.", "“I ran. Nobody saw me.”", "A. M. Orvane paid $1.50 at 5.21 p.m. there?!"], " "),
        ("de", ["Am 24. Oktober kam er.", "Er zahlte 4.300,50 Kronen für Nr. 70.", "„Halt! Wo ist es?“, rief sie.", "Das gilt z. B. hier!"], " "),
        ("fr", ["« Arrêtez ! Où est-il ? » demanda M. Varenn.", "Il hésita… puis partit…", "Page 3, cf. p. 15, pour 9,70 écus."], " "),
        ("zh", ["邮差说：“不见了！你看见了吗？”", "他读完《回来！》以后走了6.7公里。"], ""),
        ("ko", ["그는 “그만! 어디로 가니?”라고 물었다.", "20.2미터를 걸었다!"], " "),
        ("hi", ["उसने 72.9 रुपये दिए।", "कौन आया?"], " "),
        ("th", ["นักแปลคืนร่ม", "เด็กหญิงพบกุญแจ"], " "),
    ],
)
def test_sentences(lang, parts, joint):
    assert units(joint.join(parts), lang) == parts
    assert units(joint.join(parts)) == parts  # the language may be unknown
    assert units("\n\n".join(parts) + "\n") == parts


def test_sentences_of_nothing(spark):
    assert sentences.sentence_ends(None) == sentences.sentence_ends("") == sentences.sentence_ends(" \n　") == []
    df = spark.createDataFrame([(1, "一。二。", None), (1, "一。二。", None), (2, None, "ja"), (3, "", "xx")], "row_id long, text string, lang string")
    got = sentences.sentence_units(df).orderBy("idx").collect()
    assert [(r["row_id"], r["end_pos"], r["sentence"]) for r in got] == [(1, 2, "一。"), (1, 4, "二。")]


def test_pieces():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice(["文。", "句、", "「引用。続き」", "\n", "\n\n", "word ", "é", "語" * 30, "👩‍🚀"]) for _ in range(rng.randint(0, 60)))
        most, lap = rng.choice([(20, 4), (64, 16), (10, 0), (8, 7)])
        got = chunk.pieces(text, most, lap)
        assert got[0][0] == 0 and got[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(got, got[1:]))
        assert all(e - s + (lap if s else 0) <= most for s, e, _ in got)
        assert (len(got) > 1) == (len(text) > most)


def test_pieces_end_at_sentences():
    text = "これは一つ目の文です。" * 20
    assert all(text[e - 1] == "。" for _, e, _ in chunk.pieces(text, 64, 16))
    assert {b for *_, b in chunk.pieces("一行目。\n\n" * 30, 40, 0)} <= {chunk.PARAGRAPH}


def test_windows(spark):
    w = spark.createDataFrame([(1, "p", "あ" * 100), (1, "p", "あ" * 100), (2, "p", "短い"), (3, None, "x" * 500), (4, "p", None), (5, "p", "")], "window_id long, profile string, text string")
    lim = spark.createDataFrame([("p", 10, 64, 16)], "profile string, min_chars int, max_chars int, overlap_chars int")
    assert [r[0] for r in chunk.oversized_windows(w, lim).collect()] == [1]
    rows = chunk.cut_windows(w, lim).where("window_id = 1").orderBy("piece_no").collect()
    assert [(r["begin_pos"], r["end_pos"], r["overlap"]) for r in rows][0] == (0, rows[0]["end_pos"], 0) and all(len(r["piece"]) <= 64 for r in rows) and rows[1]["overlap"] == 16


TOKENIZERS = pytest.importorskip("public_tokenizers")


def test_encoding_is_the_public_one():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(TOKENIZERS.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rng = random.Random(2)
    bits = ["a", "'", "s", " ", "  ", "\n", "　", "é", "日", "本語", "1", "²", "'re", "'ll", "\x1c", "\x85", "<|endoftext|>", "é", "🎉", "thing", "…", "ไทย", "한국", "हिं"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["", "a" * 5000, "日" * 3000, "-" * 3000, "ab" * 1500]
    v = bpe.vocabulary()
    ids, counts = v.encode(texts)
    ends = np.cumsum(counts)
    got = [ids[e - n : e].tolist() for n, e in zip(counts, ends, strict=True)]
    assert got == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
    assert [v.decode(g).decode() for g in got] == texts


def test_encoding_other_vocabulary():
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    with open(TOKENIZERS.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    e = tiktoken.Encoding("own", pat_str=TOKENIZERS.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["吾輩は猫である。名前はまだ無い。", "Grüße aus Köln, 1.234,5 %", "नमस्ते दुनिया", "it's  we'll\n\n"]
    ids, counts = bpe.vocabulary("byte_bpe_multi_50k").encode(texts)
    assert ids.tolist() == [i for t in texts for i in e.encode_ordinary(t)]


def test_encode_corpus(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, None), (3, "")], "doc_id long, text string")
    enc = bpe.encode_corpus(df)
    assert {r["doc_id"]: r["ids"] for r in enc.collect()} == {1: [15496, 995], 2: [], 3: []}
    assert {r["doc_id"]: r["text"] for r in bpe.decode_corpus(enc).collect()} == {1: "Hello world", 2: "", 3: ""}


def test_poisson():
    u = (np.arange(20_000) + 0.5) / 20_000
    rates = np.stack([mixing.entry_rates(u, k) for k in range(1, 40)])
    assert (np.diff(rates, axis=0) > 0).all()  # a document gains its uses one by one
    for rate in (0.05, 0.3, 2.5, 8.0):
        counts = (rates <= rate).sum(0)
        p = np.exp(-rate)
        for k in range(12):
            assert abs((counts == k).mean() - p) < 2e-4
            p *= rate / (k + 1)


def test_mix(spark):
    rng = random.Random(5)
    docs = [(i, s, "word " * rng.randint(1, 60)) for i, s in enumerate(["a"] * 300 + ["b"] * 150 + ["c"] * 40)] + [(1000, None, "x"), (1001, "z", "x"), (1002, "a", None), (1003, "b", "")]
    d = spark.createDataFrame(docs, "doc_id long, source string, text string")
    t = spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 3), ("c", 0.15, 6), ("none", 0.05, 2)], "source string, target_share double, max_repeat int")
    got = {r["source"]: r for r in mixing.mix_report(d, t).collect()}
    assert got["none"]["tokens_used"] == 0 and all(r["most_uses"] <= r["max_repeat"] for r in got.values())
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.15)):
        assert abs(got[s]["reached_share"] - share / 0.95) < 0.01
    rows = mixing.mixed_documents(d, t).collect()
    assert {r["source"] for r in rows} == {"a", "b", "c"} and sum(r["tokens"] for r in rows) == sum(r["tokens_used"] for r in got.values())
    assert [r["shuffle_key"] for r in rows] == sorted(r["shuffle_key"] for r in rows) and len({(r["doc_id"], r["copy_no"]) for r in rows}) == len(rows)
    assert rows == mixing.mixed_documents(d, t).collect()


def test_repair_reaches_the_best():
    rng = random.Random(6)
    for _ in range(200):
        n = rng.randint(2, 6)
        have, floors = [rng.randint(0, 30) for _ in range(n)], [rng.randint(0, 3) for _ in range(n)]
        size = rng.randint(0, 60)
        shares = [rng.random() for _ in range(n)]
        aims = [size * s / sum(shares) for s in shares]
        take = stratify.repair(have, aims, floors, size, rng.randint(0, 9))
        assert all(min(h, f) <= t <= h for t, h, f in zip(take, have, floors, strict=True))
        assert sum(take) == max(min(size, sum(have)), sum(min(h, f) for h, f in zip(have, floors, strict=True)))
        cost = sum((t - a) ** 2 for t, a in zip(take, aims, strict=True))
        for i in range(n):
            for j in range(n):
                if i != j and take[i] > min(have[i], floors[i]) and take[j] < have[j]:
                    other = list(take)
                    other[i], other[j] = other[i] - 1, other[j] + 1
                    assert sum((t - a) ** 2 for t, a in zip(other, aims, strict=True)) >= cost - 1e-9


def test_stratified(spark):
    items = [(f"i{k}", "Ｄialogue" if k % 2 else " dialogue ", "q", "dialogue") for k in range(20)] + [("n1", "narrative", "s", "narrative")] * 2 + [("x", None, "s", "narrative"), ("i0", "dialogue", "q", "dialogue")]
    df = spark.createDataFrame(items, "id string, gold_category string, subcategory string, expected_modality string")
    t = spark.createDataFrame([("dialogue", "q", "dialogue", 0.8, 1, 10), ("narrative", "s", "narrative", 0.2, 1, 10)], "gold_category string, subcategory string, expected_modality string, target_share double, min_rows int, sample_size int")
    got = {r["subcategory"]: r for r in stratify.sample_report(df, t).collect()}
    assert (got["q"]["available"], got["q"]["drawn"], got["q"]["short"]) == (20, 9, False) and (got["s"]["available"], got["s"]["drawn"], got["s"]["short"]) == (1, 1, True)
    assert len({r["id"] for r in stratify.stratified_sample(df, t).collect()}) == 10
    assert stratify.sample_report(df.limit(0), t).where("short").count() == 2


def test_garbled(spark):
    rng = random.Random(7)
    words = ["森の奥で古い鍵を拾った。", "彼女は静かに笑い、町へ向かった。", "雨の夜、塔の上から手紙が届いた。", "誰も知らない話だった。", "「もう戻れない」と言った。"]
    latin = ["Der Fährmann öffnete die Tür.", "L’élève trouva la clé à la gare.", "Später hörte er die Glocken läuten."]
    clean = [(i, "s", "".join(rng.choice(words) for _ in range(6)) if i % 3 else " ".join(rng.choice(latin) for _ in range(4))) for i in range(400)]
    ways = {"utf8>cp1252": lambda t: t.encode().decode("latin-1"), "utf8>cp932": lambda t: t.encode().decode("cp932", "replace"), "cp932>cp1252": lambda t: t.encode("cp932", "replace").decode("latin-1"), "euc_jp>gb18030": lambda t: t.encode("euc_jp").decode("gb18030", "replace"), "lost": lambda t: t.encode("cp932", "replace").decode("utf-8", "replace")}
    japanese = [t for i, _, t in clean if i % 3]
    bad = [(1000 + k, "s", f(japanese[k])) for k, f in enumerate(list(ways.values()) * 4)]
    bad += [(2000, "t", "Der FÃ¤hrmann öffnete die TÃ¼r.")]
    sound = [(3000, None, "√2 ≠ ¼、±5℃。"), (3001, "s", "SÃO PAULO、ÂGE。"), (3002, "s", None), (3003, "s", "")]
    got = mojibake.garbled(spark.createDataFrame(clean + bad + sound, "doc_id long, source string, text string")).collect()
    assert {r["doc_id"] for r in got} == {d for d, *_ in bad}
    restored = {r["doc_id"]: r["restored"] for r in got}
    assert restored[1000] == japanese[0] and restored[1002] == japanese[2] and restored[1003] == japanese[3]
    assert restored[2000] == "Der Fährmann öffnete die Tür." and all(r["posterior"] > 0.5 for r in got)
    assert mojibake.garbled(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0


def test_two_garblings_and_lost_bytes(spark):
    rng = random.Random(9)
    words = ["森の奥で古い鍵を拾った。", "彼女は静かに笑い、町へ向かった。", "雨の夜、塔の上から手紙が届いた。", "誰も知らない話だった。", "「もう戻れない」と言った。"]
    texts = ["".join(rng.choice(words) for _ in range(6)) for _ in range(400)]
    utf8, euc = (lambda t: t.encode().decode("latin-1")), (lambda t: t.encode("euc_jp").decode("gb18030", "replace"))
    rows = [(i, "s", euc(t) if i < 3 else t + "�" * 12 if i < 30 else t) for i, t in enumerate(texts)]
    rows += [(1000, "s", euc(texts[50]) + "\n" + utf8(texts[51])), (1001, "s", utf8(texts[52]) + "�" * 12)]
    got = {r["doc_id"]: r for r in mojibake.garbled(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert got[1000]["restored"] == texts[50] + "\n" + texts[51] and not got[1000]["lost"]
    assert got[1001]["restored"] == texts[52] + "�" * 12 and got[1001]["lost"]
    assert all(got[i]["chain"] == "lost" and got[i]["restored"] is None and got[i]["lost"] for i in range(3, 30))


@pytest.mark.parametrize(("right", "wrong"), [("utf-8", "cp932"), ("utf-8", "latin-1"), ("euc_jp", "gb18030")])
def test_garbling_that_is_common(spark, right, wrong):
    rng = random.Random(8)
    words = ["森の奥で古い鍵を拾った。", "彼女は静かに笑い、町へ向かった。", "雨の夜、塔の上から手紙が届いた。", "誰も知らない話だった。", "朝の市場で魚を売る声がした。", "兄は黙って火を見ていた。"]
    texts = ["".join(rng.choice(words) for _ in range(8)) for _ in range(300)]
    rows = [(i, "s", t.encode(right).decode(wrong, "replace") if i < 90 else t) for i, t in enumerate(texts)]
    rows += [(1000 + k, "s", rows[0][2]) for k in range(300)]  # copies of one
    got = {r["doc_id"]: r["restored"] for r in mojibake.garbled(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert set(got) == {*range(90), *range(1000, 1300)}
    if wrong != "cp932":  # that one loses bytes
        assert all(got[i] == texts[i] for i in range(90))


def test_sample_is_what_the_report_counts(spark):
    rng = random.Random(12)
    names = [("dialogue", "q", "dialogue"), ("narrative", "s", "narrative"), ("monologue", "m", "inner"), ("other", "o", "x")]
    have, shares, floors, size = [400, 300, 12, 2], [0.3, 0.4, 0.25, 0.05], [5, 5, 5, 5], 200
    items = [(f"{k}-{i}", *n) for k, n in enumerate(names) for i in range(have[k])]
    rng.shuffle(items)
    df = spark.createDataFrame(items + items[:50], "id string, gold_category string, subcategory string, expected_modality string")
    t = spark.createDataFrame([(*n, s, f, size) for n, s, f in zip(names, shares, floors, strict=True)], "gold_category string, subcategory string, expected_modality string, target_share double, min_rows int, sample_size int")
    sample = stratify.stratified_sample(df, t).collect()
    drawn = {n[0]: sum(r["gold_category"] == n[0] for r in sample) for n in names}
    report = {r["gold_category"]: r for r in stratify.sample_report(df, t).collect()}
    assert len({r["id"] for r in sample}) == len(sample) == size and {k: r["drawn"] for k, r in report.items()} == drawn
    assert drawn["monologue"] == 12 and drawn["other"] == 2 and {k for k, r in report.items() if r["short"]} == {"monologue", "other"}
    # no exchange between two strata comes nearer to the targets
    surplus = {n[0]: drawn[n[0]] - size * s for n, s in zip(names, shares, strict=True)}
    assert all(surplus[a[0]] - surplus[b[0]] <= 1 + 1e-9 for a, x in zip(names, have, strict=True) for b, y in zip(names, have, strict=True) if drawn[b[0]] < y)


def test_first_by_dice(spark, monkeypatch):
    monkeypatch.setattr(common, "EDGE_ROWS", 3)
    rows = [(g, k, rng_w) for g in "abc" for k, rng_w in enumerate(random.Random(ord(g)).choices(range(1, 9), k=300))]
    df = common.materialize(spark.createDataFrame(rows, "g string, k int, w int").withColumn("dice", common.dice("g", "k")), "dice")
    need = {"a": 0, "b": 500, "c": 10_000}
    got = common.first_by_dice(df, "g", ["k"], F.col("w"), need).collect()
    assert len(got) == len(rows)
    for g, most in need.items():
        left, mine = most, sorted((r for r in got if r["g"] == g), key=lambda r: r["dice"])
        for r in mine:
            left -= r["w"]
            assert r["first"] == (left >= 0)


def test_common_steps_count_all_texts(spark):
    """A garbling that no text of a sample by hash has, but enough of all texts."""
    rng = random.Random(14)
    words = ["森の奥で古い鍵を拾った。", "彼女は静かに笑い、町へ向かった。", "雨の夜、塔の上から手紙が届いた。", "誰も知らない話だった。", "朝の市場で魚を売る声がした。", "兄は黙って火を見ていた。"]
    texts = sorted({"".join(rng.choice(words) for _ in range(8)) for _ in range(2500)})
    garble = lambda t: t.encode("euc_jp").decode("gb18030", "replace")
    hashed = spark.createDataFrame([(i, garble(t)) for i, t in enumerate(texts[:900])], "i int, t string").selectExpr("i", "pmod(xxhash64(t), 1000000) > 600000 AS last").collect()
    last = {r["i"] for r in hashed if r["last"]}
    rows = [garble(t) if i in last else t for i, t in enumerate(texts[:900]) if i in last or i >= 300] + texts[900:]
    df = spark.createDataFrame([(t,) for t in rows], "text string").distinct()
    shared = spark.sparkContext.broadcast(mojibake.pair_model(df).tobytes())
    assert len(rows) > 2000 and "euc_jp>gb18030" in mojibake.common_steps(df, shared)


def test_bound_of_gains_leaves_out_no_step(spark):
    rng = random.Random(15)
    words = ["森の奥で古い鍵を拾った。", "彼女は静かに笑い、", "雨の夜、\n", "〜①㈱", "한국어 글", "𠮷野家で", "ABC def ", "«Où?» "]
    texts = ["".join(rng.choice(words) for _ in range(12)) for _ in range(60)]
    texts += [t.encode(r, "ignore").decode(c, "ignore") for t in texts[:20] for r, c in (("euc_jp", "cp932"), ("cp932", "gb18030"), ("gb18030", "euc_jp"), ("big5", "cp949"))] + ["", "a"]
    score = mojibake.Scorer(mojibake.pair_model(spark.createDataFrame([(t,) for t in texts[:60]], "text string")), mojibake.FORMLESS)
    tried, helped = mojibake._promising(texts, score), 0
    for i, t in enumerate(texts):
        x = mojibake.Text(t, score)
        for step in mojibake.FORMLESS:
            if step.split(">")[1] in mojibake.MULTI and mojibake.undo(x, step)[1] > 0:
                helped += 1
                assert step in tried.get(i, [])
    assert helped > 20


def test_sound_texts_try_no_step(spark, monkeypatch):
    rng = random.Random(16)
    words = ["L’élève trouva la clé à la gare. ", "Où était-elle ? ", "Der Fährmann öffnete die Tür. ", "森の奥で古い鍵を拾った。", "彼女は静かに笑い、町へ向かった。", "『もう戻れない』と彼は言った。"]
    texts = sorted({"".join(rng.choice(words) for _ in range(8)) for _ in range(400)})
    shared = spark.sparkContext.broadcast(mojibake.pair_model(spark.createDataFrame([(t,) for t in texts], "text string")).tobytes())
    tried, undo = [], mojibake.undo
    monkeypatch.setattr(mojibake, "undo", lambda t, step: tried.append(step) or undo(t, step))
    got = list(mojibake._formless(shared)(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])])))
    assert not sum(b.num_rows for b in got) and not tried


def test_candidates_leave_out_no_step(spark):
    rng = random.Random(17)
    words = ["森の奥で古い鍵を拾った。", "彼女は静かに笑い、", "雨の夜、\n", "〜①㈱", "한국어 글", "𠮷野家で", "ABC def ", "«Où?» ", "Später hörte er ", "ｶﾅ"]
    texts = ["".join(rng.choice(words) for _ in range(12)) for _ in range(60)]
    model = mojibake.pair_model(spark.createDataFrame([(t,) for t in texts], "text string"))
    for k, step in enumerate(mojibake._STEPS):
        right, wrong = step.split(">")
        if right != "iso2022_jp":
            for t in texts[k % 20 : k % 20 + 4]:
                bad = t.encode({"utf8": "utf-8"}.get(right, right), "ignore").decode(wrong, "replace")
                texts += [bad, t + bad[: len(bad) // 2] + t]
    texts += ["", "a", "é", "\n", "𠮷野", "\x81", "$B", "é\n\né", "�"]
    for common in (frozenset(), mojibake.FORMLESS):
        score, helped = mojibake.Scorer(model, common), set()
        for t, first, further in zip(texts, mojibake.first_candidates(texts), mojibake.candidates(texts, score), strict=True):
            tried = first | further
            for step in mojibake._STEPS:
                all_ = mojibake.undo(mojibake.Text(t, score), step)
                if all_[1] > 0:
                    helped.add(step)
                    assert step in tried
                    assert mojibake.undo(mojibake.Text(t, score, {step: tried[step]} if tried[step] is not None else None), step) == all_
        assert len(helped) > 40
