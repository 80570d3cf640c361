"""Operators for works of any length, guards of any size and the further queries, on small and odd rows."""

import random
import re

from pyspark.sql import functions as F

from fumigura.functions import text as T
from fumigura.operators import annotate, consistency, corpus, evaluate, generate, normalizer, pas, tokenizer, vectors
from fumigura.plans import registry
from fumigura.sources import io
from fumigura.streaming import events as stream


def test_spans_of_long_texts(spark):
    rng = random.Random(1)
    for n in (0, 1, 255, 256, 257, 900):
        parts = ["".join(rng.choice("あいう") for _ in range(rng.randint(1, 4))) + "。" for _ in range(n)]
        got = spark.createDataFrame([("".join(parts),)], "t string").select(T.sentence_spans(F.col("t"))).first()[0]
        at = 0
        assert len(got) == n
        for g, p in zip(got, parts, strict=True):
            assert (g["start"], g["end"], g["text"]) == (at, at + len(p), p)
            at += len(p)
    assert spark.createDataFrame([(None,)], "t string").select(T.sentence_spans(F.col("t"))).first()[0] is None


def test_body(spark):
    text = "題\n-------\n記号\n-------\n本文\r\n\n-------x\n続き\n底本：本\n後"
    rows = [(0, text), (1, "規則なし"), (2, None), (3, ""), (4, "a\n-------\n-------")]
    got = {r["k"]: r["b"] for r in spark.createDataFrame(rows, "k int, t string").select("k", T.body(F.col("t")).alias("b")).collect()}
    assert got == {0: "本文\n\n続き", 1: "規則なし", 2: None, 3: "", 4: "a\n-------\n-------"}


def test_guard_by_one_pass_and_by_join(spark, monkeypatch):
    rng = random.Random(2)
    letters = "あいうえおかき"
    guard = ["".join(rng.choice(letters) for _ in range(rng.randint(3, 20))) for _ in range(40)]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(60)]
    texts += [g[2:7] for g in guard[:10]] + ["前" + g + "後" for g in guard[:10]] + [guard[0], "", "　", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    phrases = spark.createDataFrame([(g,) for g in guard], "phrase string")
    for both in (False, True):
        long = [g for g in guard if len(g) >= 8]
        want = {i for i, t in enumerate(texts) if t is not None and (any(g in t for g in long) or (both and t.strip() and any(t.strip() in g for g in long)))}
        for size in (corpus.GUARD_BYTES, 0):
            monkeypatch.setattr(corpus, "GUARD_BYTES", size)
            assert {r["id"] for r in corpus.substring_leaks(df, phrases, 8, both).collect()} == want and want
        monkeypatch.undo()
    assert corpus.substring_leaks(df, phrases.limit(0), 8, True).count() == 0


def test_encode_is_a_projection(spark):
    df = spark.createDataFrame([("a", "あＡ𠮷い?"), ("b", ""), ("c", None)], "id string, t string")
    table = spark.createDataFrame([("あ", 8), ("Ａ", 9), ("𠮷", 10), ("い", 70)], "ch string, token_id int")
    out = tokenizer.encode(df, "id", "t", table)
    assert {r["id"]: r["ids"] for r in out.collect()} == {"a": [8, 9, 10, 70, tokenizer.UNK], "b": [], "c": []}
    assert "Exchange" not in out._jdf.queryExecution().toString()
    o = df.where("id = 'a'").select(tokenizer.offsets(F.col("t")).alias("o")).select("o", *[tokenizer.to_code_point(F.col("o"), F.lit(k)).alias(f"c{k}") for k in (0, 2, 3, 4, 99)], *[tokenizer.to_utf16(F.col("o"), F.lit(k)).alias(f"u{k}") for k in (0, 3, 99)]).first()
    assert [o[f"c{k}"] for k in (0, 2, 3, 4, 99)] == [0, 2, 2, 3, 4] and [o[f"u{k}"] for k in (0, 3, 99)] == [0, 4, 5]


def test_numbers_and_parts(spark):
    rows = [("h", i * 7 % 1000) for i in range(1000)] + [("t", 2**60 + i) for i in range(5)]
    got = corpus.numbered(spark.createDataFrame(rows, "g string, k long"), "g", "k", "n").collect()
    for g in "ht":
        assert [r["n"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["k"])] == list(range(sum(x == g for x, _ in rows)))
    df = spark.createDataFrame([("a", p, i) for p in range(4) for i in range(3)], "g string, p int, i int")
    assert {r["p"] for r in corpus.keep_parts(df, "g", "p", 4).collect()} == {0, 1}
    assert [r["i"] for r in corpus.first_n(df, 2, "p", "i").collect()] == [0, 1] and corpus.first_n(df.limit(0), 2, "p").count() == 0


def test_segments_of_three_kinds(spark):
    df = spark.createDataFrame([(1, "彼は「来たか。」と言った。（まさか。）夜だ。\n\n『よし』（開いた"), (2, None), (3, " ")], "id int, t string")
    got = [(r["segment"], r["kind"]) for r in corpus.bracketed_segments(df, "id", "t").orderBy("line_no", "part_no", "sent_no").collect()]
    assert got == [("彼は", "narrative"), ("「来たか。」", "dialogue"), ("と言った。", "narrative"), ("（まさか。）", "monologue"), ("夜だ。", "narrative"), ("『よし』", "dialogue"), ("（開いた", "narrative")]
    told = spark.createDataFrame([(1, "「おい来たか。もう遅いぞ。」\n短い。しかし長い文だった。\n「開いたまま言った。")], "id int, t string")
    lines = [(r["sentence"], r["is_dialogue"]) for r in corpus.dialogue_lines(told, "id", "t").orderBy("line_no", "sent_no").collect()]
    assert lines == [("「おい来たか」", True), ("もう遅いぞ」", True), ("しかし長い文だった", False), ("「開いたまま言った", False)]


def test_cycles_of_any_length(spark):
    ring = [(i, (i + 1) % 40) for i in range(40)] + [(100, 101), (101, 102), (7, 100), (200, 200), (None, 1)]
    got = {r["node"]: r["steps"] for r in consistency.cycles(spark.createDataFrame(ring, "src int, dst int")).collect()}
    assert got == {**dict.fromkeys(range(40), 40), 200: 1}
    stuck = {r["node"] for r in consistency.deadlocks(spark.createDataFrame([(1, 2), (2, 1), (3, 1), (4, 3), (5, 6)], "node int, needed int")).collect()}
    assert stuck == {1, 2, 3, 4}
    assert consistency.cycles(spark.createDataFrame([], "src int, dst int")).count() == 0


def test_trees_tensors_and_cores(spark):
    df = spark.createDataFrame([("a", [1, 1, 1, 2, 9, None]), ("b", [1, 0]), ("c", []), ("d", None)], "k string, heads array<int>")
    got = {(r["k"], r["node"]): (r["first"], r["last"], r["size"]) for r in pas.subtrees(df, "k", "heads").collect()}
    assert got[("a", 1)] == (0, 3, 4) and got[("a", 2)] == (2, 3, 2) and got[("a", 4)] == (4, 4, 1) and got[("b", 0)] == (0, 1, 2) and len(got) == 8
    cells = pas.reshaped(spark.createDataFrame([("a", [1.0, 2.0, 3.0])], "k string, v array<double>"), "k", "v", 2, 2).collect()
    assert {(r["case_idx"], r["i"], r["j"]): r["value"] for r in cells if r["value"]} == {(0, 0, 0): 1.0, (0, 0, 1): 2.0, (0, 1, 0): 3.0} and len(cells) == 8
    rows = [("a", [1, 2, 3]), ("b", [1, 2, 3, 4]), ("c", None), ("d", []), ("e", [3])]
    together = {r["id"]: r["best"] for r in vectors.recurrent_core(spark.createDataFrame(rows, "id string, x array<int>").coalesce(1), "x").collect()}
    for k, x in rows:
        assert together[k] == vectors.recurrent_core(spark.createDataFrame([(k, x)], "id string, x array<int>"), "x").first()["best"]


def test_rates_and_trials(spark):
    rows = [(70.0, 0.5, True, False), (85.0, 0.5, True, False), (70.0, 0.5, False, True), (10.0, 0.5, False, True), (None, 0.1, None, False)]
    df = spark.createDataFrame(rows, "c double, d double, past boolean, t boolean")
    assert tuple(evaluate.guard_rates(df, F.col("c"), F.col("d"), F.col("past"), F.col("t")).first()) == (0.666667, 0.5, 0.333333, 0.5)
    r = evaluate.perturbation_trials(spark, 20_000).first()
    assert 0.15 < r["fp"] < 0.35 and r["fp_guarded"] < 0.1 and r["fn"] == r["fn_guarded"] < 0.2


def test_labels_units_and_forms(spark):
    df = spark.createDataFrame([(1, "𠮷が本を読んだ。"), (2, ""), (3, None)], "id int, t string")
    heads = annotate.batch_heads(F.col("t"), F.lit(False))
    r = df.select("id", *[c.alias(k) for k, c in heads.items()]).collect()
    assert r[0]["labels"] == [2, 7, 2, 7, 2, 2, 1, 2] and r[0]["offsets"][1] == 37 and r[1]["labels"] == []
    assert df.select(T.code_units(F.col("t"))).first()[0][:3] == [0xD842, 0xDFB7, ord("が")]
    assert [x["clean"] for x in normalizer.compatible(spark.createDataFrame([(1, "ﾎﾞ《x》Ａ"), (2, None)], "k int, t string"), "k", "t", "clean").orderBy("k").collect()] == ["ボA", None]
    assert generate.constituent_sentences(spark, 50).where("text like '%{%'").count() == 0 and generate.modern_sentences(spark, 50).count() == 200


def test_packed_lines_and_stats(spark):
    df = spark.createDataFrame([(1, "一\n\n二"), (2, None), (3, "")], "k int, t string")
    assert [(r["k"], r["line_no"], r["line"]) for r in io.embedded_lines(io.packed(df, "k", "t"), "k", "packed").orderBy("line_no").collect()] == [(1, 0, "一"), (1, 2, "二")]
    assert io.embedded_lines(spark.createDataFrame([(1, "no base64!"), (2, "AAAA")], "k int, p string"), "k", "p").count() == 0
    rows = spark.createDataFrame([("x", True), ("y", False), (None, None)], "c string, f boolean")
    assert io.stats_json(rows, "c", "f").first()[0].startswith('{"total":3,"flagged":1,"ratio":0.3333')
    assert io.run_history(spark.createDataFrame([("r", 2, 0.5), ("r", 1, 0.9)], "run string, step int, loss double"), "run", "step", "loss").first()["history"] == '[{"step":1,"loss":0.9},{"step":2,"loss":0.5}]'


def test_waits(spark):
    asked = spark.createDataFrame([(1, 10), (1, 50), (2, 5)], "key int, s int").select("key", F.timestamp_seconds("s").alias("asked"))
    done = spark.createDataFrame([(1, 12), (1, 40)], "key int, s int").select("key", F.timestamp_seconds("s").alias("answered"))
    got = {r["key"]: (r["requests"], r["timeouts"], r["longest"]) for r in stream.watchdog(stream.waits(asked, done), 5.0).collect()}
    assert got == {1: (2, 1, 2.0), 2: (1, 1, None)}


def test_latest_of_a_key_in_several_batches(spark, tmp_path):
    rng = random.Random(5)
    rows = [(v % 3, v, f"e{v}") for v in range(300)] + [(7, None, "none")]
    rng.shuffle(rows)
    path = str(tmp_path / "edits.parquet")
    spark.createDataFrame(rows, "k int, version long, what string").coalesce(1).write.parquet(path)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        got = stream.drained(stream.latest(stream.from_parquet(spark, path), "k", "version", "what")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {tuple(r) for r in got} == {(0, 297, "e297"), (1, 298, "e298"), (2, 299, "e299")}


def test_join_of_a_guard_holds_no_stock_stretches(spark, monkeypatch):
    rng = random.Random(6)
    stock = "それはある静かな夜の"
    word = lambda n: "".join(rng.choice("あいうえおかきくけこ") for _ in range(n))
    guard = [stock + word(n) for n in (2, 14, 15, 38, 39, 90, 200)] + [word(300)]
    texts = [stock + word(60) for _ in range(200)] + [word(5) + g + word(9) for g in guard] + [g[k : k + n] for g in guard for k, n in ((0, 3), (3, 11), (1, 12), (0, 23), (2, 24), (2, 60))] + [guard[-1][40:250], "ん", " ", "𠮷" + guard[0]]
    texts += [" " + t + "　\n" for t in texts[-20:]]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    phrases = spark.createDataFrame([(g,) for g in guard], "phrase string")
    want = {i for i, t in enumerate(texts) if any(g in t for g in guard) or (t.strip() and any(t.strip() in g for g in guard))}
    candidates = corpus._candidates
    total = spark.sparkContext.accumulator(0)

    def counted(*args):
        run = candidates(*args)

        def count(batches):
            for b in run(batches):
                total.add(b.num_rows)
                yield b

        return count

    monkeypatch.setattr(corpus, "GUARD_BYTES", 0)
    monkeypatch.setattr(corpus, "_candidates", counted)
    assert {r["id"] for r in corpus.substring_leaks(df, phrases, 12, True).collect()} == want and want
    assert total.value <= len(want) + 20


def test_flagship_by_join_moves_its_rows_once(spark, monkeypatch, tmp_path):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("あいうえおかきくけこ") for _ in range(n))
    guard = [word(30) for _ in range(20)]
    texts = [word(12) + "。" + word(20) for _ in range(60)] + [word(4) + g + "。" for g in guard[:9]] + [g[3:20] for g in guard[9:]] + [None, ""]
    corpus_rows = [(f"r{i}", t, "ab"[i % 2]) for i, t in enumerate(texts)]
    spark.createDataFrame(corpus_rows + corpus_rows[:30], "id string, text string, source string").write.parquet(str(tmp_path / "token_corpus_v18_leakfree.parquet"))
    spark.createDataFrame([(str(i), g) for i, g in enumerate(guard)], "id string, text string").write.parquet(str(tmp_path / "benchmark_sample.parquet"))
    spark.createDataFrame([("f", None)], "id string, text string").write.parquet(str(tmp_path / "fused_sample.parquet"))
    one_pass = {tuple(r) for r in registry.flagship(spark, str(tmp_path)).collect()}
    monkeypatch.setattr(corpus, "GUARD_BYTES", 0)
    joined = registry.flagship(spark, str(tmp_path))
    assert {tuple(r) for r in joined.collect()} == one_pass and sum(r[1] for r in one_pass) == 120
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = registry.flagship(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not re.search(r"hashpartitioning\(id#\d+, text#\d+, source", plan)
