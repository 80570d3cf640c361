"""Language profile: the tables that operators take as parameters, with Japanese defaults.

The word lists, label numbers and patterns below are fixed values: results
depend on each of them.
"""

from __future__ import annotations

# Case particles, longest first, with case number and names (ten cases).
PARTICLES = ["より", "から", "まで", "が", "を", "に", "で", "と", "へ", "の"]
CASES = {
    "が": (0, "主格", "ガ"), "を": (1, "対格", "ヲ"), "に": (2, "与格", "ニ"), "で": (3, "具格", "デ"), "と": (4, "共格", "ト"),
    "より": (5, "奪格", "ヨリ"), "から": (6, "起点格", "カラ"), "まで": (7, "終点格", "マデ"), "へ": (8, "方向格", "ヘ"), "の": (9, "連体修飾格", "ノ"),
}

# Case numbers of the twelve-case scheme.
CASES_12 = {"が": 0, "は": 1, "を": 2, "に": 3, "で": 4, "と": 5, "から": 6, "まで": 7, "へ": 8, "より": 9, "の": 10, "も": 11}

# Words that show inner states, and conjecture.
INTERNAL = ["思っ", "思わ", "思い", "感じ", "考え", "悔し", "悲し", "嬉し", "驚い", "怖", "怒り", "望ん", "疑っ", "悩み", "迷っ", "信じ", "焦っ", "悟っ", "知っ", "気絶"]
CONJECTURE = ["ようだ", "ようだった", "らしい", "かもしれ", "に違いない", "のだろ", "気がした", "ようにも見え"]
EPISTEMIC = [
    "思った", "思い", "感じた", "考えた", "悔し", "悲し", "嬉し", "驚い", "怖", "怒り", "望ん", "疑っ", "悩み", "迷っ", "信じ", "焦っ", "悟っ", "知っ",
    "ようだ", "ようだった", "らしい", "かもしれ", "に違いない", "のだろ", "気がした", "はずだ",
]

# Connectives by relation (cause, contrast, time, addition), as prefixes.
CONNECTIVES = [
    (1, ["だから", "そのため", "したがって", "ゆえに", "ので", "から"]),
    (2, ["しかし", "だが", "けれども", "ところが", "にもかかわらず", "ものの"]),
    (3, ["そして", "それから", "ついで", "まもなく", "やがて", "その時"]),
    (4, ["また", "さらに", "くわえて", "ならびに", "および"]),
]

# Stems by action (acquire, drop, move, speak, change of state).
ACTIONS = [
    (1, ["拾っ", "取っ", "受け取っ", "手に入れ", "奪っ", "買っ", "掴ん"]),
    (2, ["落とし", "捨て", "手放し", "置い", "失っ", "零し"]),
    (3, ["走っ", "歩い", "向かっ", "飛び出し", "去っ", "訪れ", "逃げ", "登っ"]),
    (4, ["言っ", "語っ", "叫ん", "尋ね", "答え", "呟い", "告げ", "話しかけ"]),
    (5, ["倒れ", "壊れ", "変身", "眠り", "目覚め", "死ん", "生き返", "凍り"]),
]

# What counts as an entity.
ENTITY = "([A-Z][a-z]+|[ァ-ヴー]{2,}|先生|メロス|カンパネルラ|ジョバンニ|セリヌンティウス|漱石|太宰|阿部|山川)"

# Double negations.
DOUBLE_NEGATIONS = [
    "ないわけではない", "ないわけじゃない", "なくもない", "なくはない", "ないとは言えない", "ないとは限らない", "ざるを得ない", "ないことはない",
    "ないこともない", "否定できない", "否定はできない", "ずにはいられない", "ないではいられない", "思わないでもない",
]

# Passive forms, words that only look passive, and hearsay around one.
PASSIVE = "(?:[ぁ-んァ-ヶー一-龠]{1,8}?(?:(?:[あかさたなはまやらわがざだばぱ])(?:れる|れた|れて|れば)|(?:される|された|されて|せられる|せられた)|(?:られる|られた|られて|られれば)))"
NOT_PASSIVE = ["これ", "それ", "あれ", "だれ", "あふれる", "あふれた"]
HEARSAY = "と(?:伝えられ|言われ|考えられ|思われ|見られ)"

# Particles that are checked for repetition.
REPEATED = ["が", "を", "に", "で", "の", "と", "から", "より", "へ", "まで", "は"]

# Patterns of a topic whose predicate gives a reason instead.
MISMATCHES = [
    "^(?:(?![^。、]*[の理由原因目的]は).)*?[はが]\\s*[,、].*?(?:と思ったからです|と考えたからです|と感じたからです|からです|ためです|だからです|からである|ためである)[。!！?？]?$",
    "[はが][,、].*?(?:と思った|と考え|と感じ).*?(?:からです|ためです)",
    "(?:[彼我君彼女私自分][はが]|夢[はが]|目標[はが]|計画[はが]|行動[はが]|思い[はが]).*?(?:からです|ためです)[。!！?？]?$",
]

# Patterns of inner states, in order of precedence.
INNER_STATES = [
    "(思った|思って|思い至った|考えた|考えて|企んだ|企んで|目論んだ|目論んで|思案した|思案して|確信した|確信して|疑った|疑って)",
    "(感じた|感じて|実感した|実感して|直感した|直感して|胸を締め付けられた|戦慄した|戦慄して)",
    "(悔やんだ|悔やんで|後悔した|後悔して|恥じた|恥じて|羨んだ|羨んで|妬んだ|妬んで|憎んだ|憎んで|憤った|憤って|歓喜した|歓喜して|嘲笑った|嘲笑って|蔑んだ|蔑んで|軽蔑し|軽蔑して|恨んだ|恨んで|嫌悪した|嫌悪して)",
    "(心の中で|胸の内で|胸中で|内心)",
    "(恐れた|恐れて|怯えた|怯えて|恐怖した|恐怖して|怖気づいた|安堵した|安堵して|ほっとした)",
    "(思い描いた|夢見た|思いを巡らせた|決意した|覚悟を決めた)",
]

# What softens a statement about another mind, and marks of free indirect discourse.
MITIGATION = "ように見えた|ような気がした|ような表情|そうに見えた|そうだった|ようだった|に違いない|のだろう|かもしれない|かのように|様子だった|かの如く"
FREE_INDIRECT = "なぜ.*(?:か|のか|だろう|ねばならない)|どうして.*(?:か|のか|だろう)|だろうか|ねばならないのか|なんと.*(?:だろう|ことだ|ことか|のだろう)|まさか|に違いない|はずがない|ではないか|てたまるか|ものか|どうすれば.*(?:か|のか|だろう|のだろう)|[？?]"
RECOLLECTION = "(?:十年前|あの日|当時は|あの頃|その頃|かつて)[^。]*?(?:だった|であった|いた|た。)"
SUBJECT = "(?:^|[、。])([一-龠々ぁ-んァ-ヶa-zA-Z0-9]+)[はが]"
NARRATORS = ["私", "僕", "俺", "わたし", "あたし", "自分", "我"]

# What shows that a bracketed span is cited, after, before and inside it.
CITED_AFTER = [
    "読んだ", "読む", "書かれて", "書いた", "記された", "掲げ", "という題", "という本", "という名", "という言葉", "の項", "という警告", "という文字", "を机の上",
    "の解説書", "とだけ走り書き", "と書かれた", "と表示", "と点滅", "の文字が", "の項に", "という見出し", "の額が", "という特集",
]
CITED_BEFORE = [
    "夏目漱石の", "芥川龍之介の", "太宰治の", "梶井基次郎の", "川端康成の", "看板には", "見出しには", "壁には", "辞書を引くと", "画面に", "案内板には", "いわゆる",
    "黒板に", "雑誌の表紙に",
]
CITED_TERMS = ["本日休業", "各駅停車", "緊急連絡先", "初志貫徹", "草々", "接続エラー", "神話の法則", "アンビバレンス", "歴史的暴落", "相対性理論", "誠実"]
# Speech without quotes.
UNQUOTED = [
    "^([^。！？!?]+?)(?:、と)(?:[^。！？!?]+[。！？!?]?)$",
    "^((?:おい|ねえ|やあ|もし|ほら|さあ|どうしたんだい|ごめんください|助けて|冗談じゃない|駄目だよ|まさかそんな|ちょっと待って|よかった)[^、。]*、[^、。]+?)(?:、(?:誰かが|見知らぬ|後ろから|彼女が|子供が|微かな声が|席を|格子戸を|号令が|抱きしめ|気遣われ|指さし|勝ち誇))",
]
SPEECH = "おい|ねえ|やあ|もし|ほら|さあ|かい|だい|よ|ぞ|な|ね|くれ|しろ|見ろ|行こう|待って|聞いて|駄目|馬鹿|冗談|助けて|ごめん|よかった|おられませんか|やってられるか|ちゃ"

# Weight of a case role for an antecedent.
ROLE_WEIGHTS = {"ガ": 1.0, "ガ２": 0.95, "ハ": 0.9, "ヲ": 0.65, "ニ": 0.55, "ト": 0.45, "デ": 0.4, "カラ": 0.35, "ヘ": 0.35, "ヨリ": 0.3, "マデ": 0.3}

# Predicates by standard action, then stems in order.
PREDICATES = {
    "Acquire": ["拾う", "拾いあげる", "拾い上げる", "手に入れる", "獲得する", "獲得", "買い取る", "奪う", "得る", "受け取る", "つかむ", "掴む", "捕まえる", "入手"],
    "Drop": ["手放す", "捨てる", "落とす", "渡す", "手渡す", "譲る", "失う", "置く", "放す", "奪われる", "喪失"],
    "Move": ["向かう", "移動する", "移動", "行く", "走る", "逃げる", "赴く", "歩く", "訪れる", "着く", "辿り着く", "立ち去る", "登る", "降りる", "去る", "進む"],
    "ChangeState": ["倒す", "倒れる", "壊す", "壊れる", "傷つける", "変身する", "死ぬ", "眠る", "覚める", "変化する", "破滅させる", "殺す", "撃つ", "斬る"],
}
STEMS = [
    ("Acquire", ["拾", "手に入", "獲得", "買", "奪", "得", "受取", "入手"]),
    ("Drop", ["捨", "落と", "手渡", "渡", "譲", "失", "置", "放", "喪失"]),
    ("Move", ["向か", "移動", "行", "走", "逃", "赴", "歩", "訪", "着", "辿り着", "登", "降", "進"]),
    ("ChangeState", ["倒", "壊", "傷", "変身", "死", "眠", "覚", "変化", "破滅", "殺", "撃", "斬"]),
]

# Bracket pairs of the balance test.
BRACKETS = ["「」", "『』", "（）", "()", "【】", "〈〉", "《》", "〔〕", "［］", "｛｝", "＜＞", "{}", "[]", "<>"]
