"""Deterministic generators of test sentences: ranges of numbers with lookups by remainders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words of the validation sentences.
PLACES = ["古城", "港町", "雪山", "図書室", "王都", "地下牢", "霧の森", "教会", "廃墟", "時計塔"]
PEOPLE = ["主人公", "老騎士", "探偵", "少女", "学者", "旅人", "剣士", "修道士", "暗殺者", "精霊"]
DEEDS = ["剣を抜いて構えた。", "扉を静かに開けた。", "目的地に無事到達した。", "部屋で手紙を発見した。", "仲間と深く頷き合った。", "旧市街より抜け出してきた。", "広場から小道へと走った。", "夜明けまで待機した。", "北の塔へ向かった。", "王の言葉を刻み込んだ。"]

# Words of the fallback sentences.
SUBJECTS = ["主人公", "少年", "老騎士", "探偵", "少女", "旅人", "館の主", "若き学者"]
SCENES = ["古城の回廊", "雨の港町", "静かな書斎", "吹雪の峠", "霧の深い森", "月明かりの広場"]
LINES = [
    ("剣を手に取り、暗闇の中へと進んだ。", "narrative"), ("「あの山の向こうへ行ってはならぬと、長老から固く口止めされていたのだ。」", "dialogue"), ("机の上の古い手紙を手にとり、静かに目を通した。", "narrative"),
    ("「この手懸かりから犯人の部屋まで辿り着くことができるはずだ。」", "dialogue"), ("暖炉の炎を見つめながら、静かに過去を語り始めた。", "narrative"), ("「私と共にあの街へ向かった日のことを、覚えているかね？」", "dialogue"),
]

# Topics with a fitting and a twisted predicate; nominal ones at even numbers, clauses at odd ones.
NOMINAL = [
    ("彼が旅に出た理由", "幼少期の記憶を忘れたかったからだ。", "幼少期の記憶を忘れたかった。"), ("私がこの小説を書き始めた目的", "失われた名誉を取り戻すことだ。", "失われた名誉を取り戻したい。"),
    ("主人公の最大の願い", "世界平和を守り抜くことだ。", "世界平和を守り抜く。"), ("探偵が事件の真相を確信した背景", "現場に残された足跡の角度に違和感を抱いたからだ。", "現場に残された足跡の角度に違和感を抱いた。"),
]
TOPICAL = [
    ("古びた洋館の扉", "静かに開くと、冷たい風が吹き込んできた。", "静かに開けると、冷たい風が吹き込んできた。"), ("風に揺れる桜の花びら", "舞い散り、地面を桃色に染めていった。", "舞い散る様子を眺めながら溜息をついた。"),
    ("テーブルの上の手紙", "静かに風に吹かれて床へ落ちた。", "そっと手に取って中身を読み進めた。"),
]

# Sentences of the error benchmark with their kind and how often each comes.
ERRORS = [
    (20, "particle-repetition", ["彼が猫が魚が好きだと言った。", "勇者が仲間が敵が倒れたと叫んだ。", "彼を部屋を荷物を見せに連れて行った。", "剣を盾を鎧を落として逃げ出した。", "私の友達の犬の家の庭。", "学校の図書室の奥の机の上の本。", "ギルドのマスターの部屋の鍵の束。", "彼に私に先生に報告しに行った。", "東京で大阪で名古屋で開催された。"]),
    (25, "subject-predicate-mismatch", ["私の将来の夢は、世界大会で優勝したからです。", "彼は、明日晴れると良いなと思ったからです。", "僕の希望としては、全員が無事に帰還できるからです。", "彼女の提案は、一旦退却して体制を立て直すからです。"]),
    (25, "double-negation", ["その真実を知らないわけではないと言わざるを得ない。", "彼の主張に賛同できなくもないわけではない。"]),
    (25, "consecutive-passive", ["敵に城を奪われて、味方が皆殺害された。", "魔王に追われて、仲間に見捨てられて、孤立させられた。"]),
    (30, "pov-shift", ["エリスは恐怖に震えていた。しかし俺は冷たく見下ろした。"]),
    (30, "style-shift", ["彼は冷徹な暗殺者だった。でも本当はちょっぴり寂しがり屋なのだ。"]),
    (25, "clean", ["私が最も驚いた理由は、彼が突然走り出したからです。", "この計画の目的は、敵の拠点を偵察することです。", "静かに扉を開けて、誰もいない部屋に入った。", "主人公は剣を抜き、敵の攻撃を冷静にかわした。"]),
    (30, "clean", ["ギルドの受付嬢は微笑んだ。私は書類を受け取って酒場へ向かった。", "夕暮れの街を一人歩きながら、過ぎ去った日々に思いを馳せる。"]),
]


def pick(values: list, i: Column) -> Column:
    """The value at ``i`` modulo their number."""
    return F.element_at(F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]), (F.pmod(i, F.lit(len(values))) + 1).cast("int"))


def _triples(rows: list[tuple[str, str, str]]) -> list[Column]:
    return [F.struct(F.lit(a).alias("topic"), F.lit(b).alias("right"), F.lit(c).alias("twisted")) for a, b, c in rows]


def twist(i: Column) -> Column:
    """struct<text, corrected, kind> of the twisted sentence number ``i``."""
    half = F.floor(i / 2)
    even = F.pmod(i, F.lit(2)) == 0
    t = F.when(even, pick(_triples(NOMINAL), half)).otherwise(pick(_triples(TOPICAL), half))
    kind = F.when(even, "NOMINAL_PREDICATE_MISMATCH").otherwise("TOPIC_CLAUSE_MISMATCH")
    return F.struct(F.concat(t["topic"], F.lit("は、"), t["twisted"]).alias("text"), F.concat(t["topic"], F.lit("は、"), t["right"]).alias("corrected"), kind.alias("kind"))


def validation_cases(spark: SparkSession, n: int = 5000) -> DataFrame:
    """id, text, context, has_twist, twist_type, corrected_text; every tenth sentence is twisted."""
    i = F.col("id")
    place, person, deed = pick(PLACES, i), pick(PEOPLE, F.floor(i / 10)), pick(DEEDS, F.floor(i / 100))
    twisted = F.pmod(i, F.lit(10)) == 0
    t = twist(i)
    return spark.range(n).select(
        F.format_string("val_int8_%06d", i + 1).alias("id"), F.when(twisted, t["text"]).otherwise(F.concat(person, F.lit("は"), place, F.lit("で"), deed)).alias("text"),
        F.concat(F.lit("第"), (F.floor(i / 500) + 1).cast("string"), F.lit("章: "), place, F.lit("における"), person, F.lit("の行動記録#"), (i + 1).cast("string")).alias("context"),
        twisted.alias("has_twist"), F.when(twisted, t["kind"]).alias("twist_type"), F.when(twisted, t["corrected"]).alias("corrected_text"),
    )


def fallback_cases(spark: SparkSession, n: int = 100) -> DataFrame:
    """context, text, text_type, has_twist by number; every fifth sentence is twisted."""
    i = F.col("id")
    who, where = pick(SUBJECTS, i), pick(SCENES, i * 3)
    line = pick([F.struct(F.lit(a).alias("text"), F.lit(b).alias("kind")) for a, b in LINES], i * 5)
    twisted = F.pmod(i, F.lit(5)) == 0
    told = F.when(line["text"].startswith("「"), line["text"]).otherwise(F.concat(who, F.lit("は"), line["text"]))
    return spark.range(n).select("id", F.concat(where, F.lit("で"), who, F.lit("はたたずんでいた。")).alias("context"), F.when(twisted, twist(i)["text"]).otherwise(told).alias("text"), line["kind"].alias("text_type"), twisted.alias("has_twist"))


def error_benchmark(spark: SparkSession) -> DataFrame:
    """text, error_type, has_error, copy: the benchmark's sentences, each as often as it comes."""
    rows = spark.createDataFrame([(t, kind, n) for n, kind, texts in ERRORS for t in texts], "text string, error_type string, times int")
    return rows.select("text", "error_type", (F.col("error_type") != "clean").alias("has_error"), F.explode(F.sequence(F.lit(1), "times")).alias("copy"))


def oversampled(df: DataFrame, times: int) -> DataFrame:
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times))))


def choice(values: list[str], i: Column, nth: int) -> Column:
    """A value by a hash of the number and of the place it is chosen for: any row can be made by itself."""
    mixed = F.pmod(i * 2654435761 + nth * 40503 + F.shiftright(i * 40503 + nth * 9176, 3), F.lit(1 << 32))
    return pick(values, F.shiftright(mixed, 12))


# Words of the constituent sentences.
WHO = ["俺", "私", "僕", "彼女", "彼", "勇者", "主人公", "ギルドマスター", "探偵", "騎士", "賢者", "少女", "少年", "老人", "警官", "旅人", "王女"]
WHAT = ["ステータス画面", "古代の魔導書", "真実の鍵", "スマートフォン", "冷めたコーヒー", "依頼書", "聖剣", "壊れた時計", "水晶玉", "手紙", "記憶の欠片", "古びた地図", "暗号メモ"]
WHERE = ["ギルドの酒場", "暗いダンジョンの深層", "オフィスの静寂の中", "放課後の教室", "壊れかけた神殿", "静かな図書室", "霧深い森の奥", "城のバルコニー", "街角の路地裏"]
HOW = ["確かめるように", "震える手で", "素早く", "慎重に", "息を潜めて", "迷いなく", "不敵な笑みを浮かべて", "祈りを込めながら", "無言で"]
THEN = ["そして", "しかし", "だが", "その時", "まもなく", "だから", "また"]
# The four forms of the constituent sentences (c: connective, l: place, s: subject, o: object, h: manner).
FORMS = ["{c}、{l}で{s}は{o}を{h}開いた。", "{o}を{h}見つめながら、{s}は{l}へと急いだ。", "{l}の片隅で、{s}は「これこそが{o}に違いない」と強く確信した。", "{s}の手から{o}が零れ落ち、{l}の床に鈍い音を立てて砕け散った。"]

# Words and forms of the modern sentences; speech and thought have five forms each.
MODERN_WHO = ["俺", "私", "僕", "彼女", "彼", "勇者", "主人公", "ギルドマスター", "先輩", "後輩", "エリス", "アリア", "魔王", "少女"]
MODERN_WHAT = ["ステータス画面", "スキル一覧", "古代の魔導書", "真実の鍵", "スマートフォン", "冷めたコーヒー", "依頼書", "聖剣", "黒い短剣"]
MODERN_WHERE = ["ギルドの酒場", "暗いダンジョンの中層", "オフィスの静寂", "放課後の教室", "地下闘技場", "壊れかけた神殿", "薄暗い自室"]
MODERN_DEED = ["静かに睨みつけた", "ため息をつきながら開いた", "素早くポケットに隠した", "信じられない思いで見つめた", "迷わず手に取った", "呟いて立ち上がった"]
MODERN_TOLD = ["{s}は{l}で{o}を{d}。", "{s}が{l}から{o}を持ち去った。"]
MODERN_SPEECH = ["「おい{s}、本当に{l}へ行くつもりなのか？」", "「{o}なら、もう俺の手の中にあるよ」", "「まさか……{s}がそんなことをするなんて信じられない！」", "「安心しろって。この{o}さえあれば何とかなるからさ」", "「{l}の様子はどうだった？　何か手がかりはあったのか？」"]
MODERN_THOUGHT = ["{l}に立ち尽くし、{o}を握りしめていた。", "まさか、こんなところで{s}に出会うとは思わなかった。", "息を殺して、闇の奥から響く足音に耳を澄ませた。", "どれほど悔やんでも、失われた時間だけは戻らないのだと知っていた。", "{o}を前にして、胸の奥で燻っていた疑念が確信へと変わった。"]


def filled(form: Column, words: dict[str, Column]) -> Column:
    for name, word in words.items():
        form = F.replace(form, F.lit("{" + name + "}"), word)
    return form


def constituent_sentences(spark: SparkSession, n: int = 8000) -> DataFrame:
    """(id, form, text): four sentences of chosen constituents for each of ``n`` numbers; none is dialogue."""
    i = F.col("id")
    words = {k: choice(v, i, nth) for nth, (k, v) in enumerate((("c", THEN), ("l", WHERE), ("s", WHO), ("o", WHAT), ("h", HOW)))}
    rows = spark.range(n).withColumn("form", F.explode(F.sequence(F.lit(0), F.lit(len(FORMS) - 1))))
    return rows.select("id", "form", filled(pick(FORMS, F.col("form")), words).alias("text"))


def modern_sentences(spark: SparkSession, n: int = 800) -> DataFrame:
    """(id, form, text, is_dialogue): two told sentences, one spoken and one thought for each of ``n`` numbers."""
    i = F.col("id")
    words = {k: choice(v, i, nth) for nth, (k, v) in enumerate((("s", MODERN_WHO), ("l", MODERN_WHERE), ("o", MODERN_WHAT), ("d", MODERN_DEED)))}
    forms = F.array(*[F.lit(f) for f in MODERN_TOLD], choice(MODERN_SPEECH, i, 4), choice(MODERN_THOUGHT, i, 5))
    return spark.range(n).select("id", F.posexplode(forms).alias("form", "t")).select("id", "form", filled(F.col("t"), words).alias("text"), (F.col("form") == 2).alias("is_dialogue"))
