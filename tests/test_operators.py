"""Rules, sequences, numbers and streams on small examples."""

import math

import numpy as np
from pyspark.sql import functions as F

from fumigura.operators import anaphora, consistency, corpus, evaluate, events, generate, lint, modality, pas, pov, tokenizer, vectors
from fumigura.sources import io
from fumigura.streaming import events as stream


def test_particle_lint():
    assert len(lint.repeated_particles("彼が猫が魚が好きだと言った。")) == 3
    chain = lint.repeated_particles("私の友達の犬の家の庭。")
    assert len(chain) == 4 and {d[2] for d in chain} == {"warning"}
    assert lint.repeated_particles("彼が猫が魚が好きだ。", cadence=40.0) == []
    assert lint.repeated_particles("") == []


def test_lint_scores(spark):
    rows = [("ok", "私の夢は、世界大会で優勝することです。"), ("twist", "私の夢は、世界大会で優勝したからです。"), ("neg", "その真実を知らないわけではないと言わざるを得ない。"), ("passive", "敵に城を奪われて、味方が皆殺害された。"), ("null", None), ("blank", "")]
    got = {r["id"]: r for r in lint.lint(spark.createDataFrame(rows, "id string, sentence string")).collect()}
    assert got["ok"]["diagnostics"] == [] and got["ok"]["score"] == 1.0
    assert [d["rule"] for d in got["twist"]["diagnostics"]] == ["subject-predicate-mismatch"]
    assert [d["rule"] for d in got["neg"]["diagnostics"]] == ["double-negation"] * 2 and got["neg"]["score"] == 0.5
    assert {d["rule"] for d in got["passive"]["diagnostics"]} == {"consecutive-passive"}
    assert got["null"]["score"] is None and got["null"]["diagnostics"] == [] and got["blank"]["score"] == 1.0


def test_error_benchmark(spark):
    n = {r["error_type"]: r["count"] for r in generate.error_benchmark(spark).groupBy("error_type").count().collect()}
    assert n == {"particle-repetition": 180, "subject-predicate-mismatch": 100, "double-negation": 50, "consecutive-passive": 50, "pov-shift": 30, "style-shift": 30, "clean": 160}


def test_validation_cases(spark):
    rows = generate.validation_cases(spark).collect()
    assert len(rows) == 5000 and rows[0]["id"] == "val_int8_000001" and sum(r["has_twist"] for r in rows) == 500
    assert rows[1]["text"] == "主人公は港町で剣を抜いて構えた。"


TELEMETRY = "struct<texture:struct<showing:double,staccato:double,polyphony:double,confession:double,tension:double,speculation:double,cadence:double>,dynamics:struct<crestfactor:double,cadence:double,maxdependencydistance:int>>"


def scene(spark, rows):
    made = [("d", i, t, dialogue, who, None if x is None else ((50.0, 50.0, 0.0, 0.0, 0.0, x, 0.0), None)) for i, (t, dialogue, who, x) in enumerate(rows)]
    return spark.createDataFrame(made, f"doc string, idx int, text string, is_dialogue boolean, subject string, telemetry {TELEMETRY}")


def test_pov_other_mind(spark):
    rows = [("女は歩いた。", False, "女", None), ("「はい」", True, None, None), ("男は内心で後悔した。", False, "男", None), ("女は疑った。", False, "女", None)]
    got = pov.verdicts(scene(spark, rows), character="女").collect()
    assert [(r["idx"], r["kind"], r["who"]) for r in got] == [(2, "unauthorized_internal_state", "男")]
    assert pov.report(scene(spark, rows), pov.verdicts(scene(spark, rows), character="女")).first()["score"] == 0.9


def test_pov_spike(spark):
    rows = [("男は立った。", False, "男", 10.0)] * 4 + [("男は怯えたようだった。", False, "男", 80.0)]
    got = pov.verdicts(scene(spark, rows), character="女").collect()
    assert [r["kind"] for r in got] == ["epistemic_leak_excessive_speculation"]


def test_head_hop(spark):
    rows = [("女は疑った。", False, "女", None), ("男は恐れた。", False, "男", None)]
    assert [r["kind"] for r in pov.verdicts(scene(spark, rows)).collect()] == ["head_hopping"]


def test_lookback(spark):
    ents = spark.createDataFrame([("d", i, f"e{i}", 0, "ガ", "character", 1.0, i == 3) for i in range(5)], "doc string, idx int, ent string, pos int, role string, kind string, salience double, is_speaker boolean")
    asked = spark.createDataFrame([("d", 4, "ガ", 75.0)], "doc string, idx int, omitted string, staccato double")
    found = anaphora.ranked(anaphora.candidates(asked, ents), ["doc", "idx"]).collect()
    assert {r["ent"] for r in found} == {"e4", "e3", "e2", "e1"}
    assert abs(sum(r["likelihood"] for r in found) - 1) < 1e-9 and min(found, key=lambda r: r["rank"])["ent"] == "e3"
    assert spark.range(1).select(F.round(anaphora.incomplete_score(F.lit(1.0), F.lit(1), F.lit(0.8)), 6)).first()[0] == 0.56


def test_actions(spark):
    words = ["拾った", "手渡した", "向かっている", "倒された", "", None, "拾う"]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string")
    assert [r[0] for r in df.orderBy("i").select(events.action(F.col("w"))).collect()] == ["Acquire", "Drop", "Move", "ChangeState", "ChangeState", "ChangeState", "Acquire"]


def test_event_binds_omitted_subject(spark):
    rel = spark.createDataFrame([("r", "走る", [("ガ", None, True), ("ニ", "町", False)])], "rel_id string, predicate string, args array<struct<case_name:string,text:string,is_zero:boolean>>")
    e = events.events(rel, spark.createDataFrame([("r", "メロス")], "rel_id string, antecedent string")).first()
    assert (e["entity_id"], e["action"], e["target"], e["is_subject_zero"]) == ("メロス", "Move", "町", True)


def test_modality_guards():
    t = "夏目漱石の「坊っちゃん」を読んだ。"
    assert modality.refine(t, [1 if "「" in t[: i + 1] else 0 for i in range(len(t))]) == [3 if 5 <= i < 12 else 0 for i in range(len(t))]
    assert modality.unquoted_speech("おい、待ってくれ、と彼は言った。") == 8
    assert set(modality.refine("なぜ来たのか。", [0] * 7, confession=70, tension=0.5)) == {2}
    assert set(modality.refine("なぜ来たのか。", [0] * 7, confession=60, tension=0.5)) == {0}


def test_guard_and_dedup(spark):
    c = spark.createDataFrame([("1", "　短い。"), ("2", "とても長い評価の文がここにあります。余り"), ("3", "別の文"), ("4", "評価の文がここにあります"), ("5", None), ("6", "別の文 ")], "id string, text string")
    g = spark.createDataFrame([("短い。",), ("とても長い評価の文がここにあります。",), (None,)], "text string")
    assert [r["id"] for r in corpus.exact_leaks(c, g).collect()] == ["1"]
    found = corpus.substring_leaks(c, g.selectExpr("text AS phrase"), 12, True).collect()
    assert sorted(r["id"] for r in found) == ["2", "4"]
    assert sorted(r["id"] for r in corpus.first_wins(c.where("text is not null"), F.trim("text"), "id").collect()) == ["1", "2", "3", "4"]
    assert corpus.substring_leaks(c, g.limit(0).selectExpr("text AS phrase"), 12, True).count() == 0


def test_vectors(spark):
    df = spark.createDataFrame([([0.5, -2.5, 300.0],), ([1.0, 2.0, 3.0],)], "v array<double>")
    assert df.select(vectors.quantized(F.col("v"), 1.0)).first()[0] == [1, -2, 127]
    assert df.select(vectors.dot(F.col("v"), F.col("v"))).collect()[1][0] == 14.0


def test_pas():
    h = np.random.default_rng(1).normal(size=(20, 8))
    w = pas.weights(8)
    s = pas.forward(h, w)
    i, j, c = 3, 7, 2
    assert abs(s[c, i, j] - (h[i] @ w[0]) @ w[2][c] @ (h[j] @ w[1])) < 1e-9
    near = pas.forward(h, w, jumps=[{"verbtokenidx": 3, "nountokenidx": 7, "casemarker": 1, "jumpdegree": 10}])
    assert abs(near[0, 3, 7] - s[0, 3, 7] - 0.8) < 1e-9 and abs(near[2, 3, 7] - s[2, 3, 7]) < 1e-9
    share, zero = pas.normalized(s.copy())
    assert np.allclose(share.sum(-1), 1) and np.allclose(zero, 1 - share.max(-1))


def test_pas_of_whole_sentences(spark):
    h, w = np.random.default_rng(2).normal(size=(90, 16)), pas.weights(16)
    for i in (0, 40, 88):
        got, want = pas.row_relations(h, w, i), pas.relations(pas.forward(h, w), [i])
        assert [(*g[:3], g[4]) for g in got] == [(*x[:3], x[4]) for x in want] and np.allclose([g[3] for g in got], [x[3] for x in want])
    text = "森" * 70 + "た。" + "町" * 10 + "だ。"
    rows = pas.scored(spark.createDataFrame([("a", text), ("b", None)], "id string, text string")).collect()
    assert {r["predicate"] for r in rows} == {70, 82}


def test_measures(spark):
    df = spark.createDataFrame([(True, True)] * 3 + [(False, True), (True, False), (None, None)], "t boolean, g boolean")
    r = evaluate.confusion(df, F.col("t"), F.col("g")).first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"], r["f1"]) == (3, 1, 1, 1, 75.0)
    values = [float(x % 17) for x in range(1000)]
    got = evaluate.nearest_rank(spark.createDataFrame([(v,) for v in values] + [(None,)], "v double"), "v", [0.0, 0.5, 0.99], buckets=8, small=50).collect()
    assert [(r["p"], r["value"]) for r in got] == [(p, sorted(values)[math.floor(1000 * p)]) for p in (0.0, 0.5, 0.99)]
    assert evaluate.nearest_rank(spark.createDataFrame([], "v double"), "v", [0.5]).count() == 0


def test_tokenizer(spark):
    df = spark.createDataFrame([("a", "ああい"), ("b", "ｱい𠮷"), ("c", "")], "id string, t string")
    vocab = {r["ch"]: r["token_id"] for r in tokenizer.vocabulary(df.where("id = 'a'"), "id", "t", 10).collect()}
    assert vocab == {"あ": 8, "い": 9}
    table = tokenizer.char_table(df.select(F.explode(F.split("t", "")).alias("ch")), vocab | {"ア": 10})
    got = {r["id"]: r["ids"] for r in tokenizer.encode(df, "id", "t", table).collect()}
    assert got == {"a": [8, 8, 9], "b": [10, 9, 1], "c": []}
    o = df.where("id = 'b'").select(tokenizer.offsets(F.col("t")).alias("o")).first()["o"]
    assert [(x["codepoint_start"], x["utf16_start"]) for x in o] == [(0, 0), (1, 1), (2, 2)]
    names = F.create_map(*[F.lit(x) for k, v in vocab.items() for x in (v, k)])
    assert spark.range(1).select(tokenizer.decode(F.array(F.lit(2), F.lit(8), F.lit(9), F.lit(77)), names)).first()[0] == "あい"


def test_consistency(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "src int, dst int")
    assert sorted((r["node"], r["steps"]) for r in consistency.cycles(edges).collect()) == [(1, 3), (2, 3), (3, 3)]
    stays = spark.createDataFrame([("a", "x", 0, 100), ("a", "y", 50, 80), ("a", "x", 90, 95), ("b", "y", 0, 9)], "entity string, place string, start long, end long")
    assert [(r["entity"], r["place"], r["start"]) for r in consistency.simultaneous_presence(stays, 30).collect()] == [("a", "y", 50)]
    refs = consistency.undefined_references(spark.createDataFrame([("t", "[[塔]]と[[城]]")], "id string, text string"), spark.createDataFrame([("城",)], "name string"))
    assert [r["name"] for r in refs.collect()] == ["塔"]


def test_io(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("吾輩は猫".encode("shift_jis"))
    (tmp_path / "b.txt").write_bytes("吾輩あ".encode())
    got = {r["encoding"]: r["text"] for r in io.decoded(spark, str(tmp_path / "a.txt"), str(tmp_path / "b.txt")).collect()}
    assert got["shift_jis"] == "吾輩は猫" and got["utf-8"] == "吾輩あ"
    df = spark.createDataFrame([("1", "猫"), ("2", None)], "id string, text string")
    io.write_json_lines(df, str(tmp_path / "j"), gzip=True)
    back = io.json_lines(spark, "id string, text string", str(tmp_path / "j"))
    assert sorted(map(tuple, back.collect()), key=str) == [("1", "猫"), ("2", None)]
    assert io.digest(df).first() == io.digest(back.repartition(3)).first()


def test_streams(spark, tmp_path):
    rows = [(i, 1, float(v), None, "error" if i % 2 else "view") for i, v in enumerate([10, 12, 11, 90, 95, 20, 70])]
    spark.createDataFrame(rows, "event_id long, user_id long, value double, ts timestamp, event_type string").coalesce(1).write.parquet(str(tmp_path / "e.parquet"))
    source = lambda: stream.from_parquet(spark, str(tmp_path / "e.parquet"))
    assert sorted(r["at"] for r in stream.drained(stream.spikes(source(), "user_id", "event_id", "value"), str(tmp_path / "s")).collect()) == [3, 4, 6]
    q = stream.drained(stream.bounded(source(), "user_id", "event_id", 3), str(tmp_path / "q")).first()
    assert (q["accepted"], q["dropped"]) == (4, 3)
    assert stream.drained(stream.evaluated(source()), str(tmp_path / "v")).where("accepted").count() == 4
