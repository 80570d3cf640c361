"""ANSI SQL of the queries, for DuckDB, written from what each query means rather than from its plan."""

from __future__ import annotations

from fumigura import profiles as P
from fumigura.operators import generate as G
from fumigura.operators import tokenizer

_WHITE = r"\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_SOLID = f"[^{_WHITE}]"


def _trim(c: str) -> str:
    return f"regexp_replace({c}, '^[{_WHITE}]+|[{_WHITE}]+$', '', 'g')"


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _any(c: str, words: list[str]) -> str:
    return f"regexp_matches({c}, '{'|'.join(words)}')"


def _spans(source: str, key: str, text: str, pattern: str) -> str:
    """CTE ``spans``: key, off (offset), tok of every piece of an exhaustive pattern."""
    return f"""pieces AS (SELECT {key}, regexp_extract_all({text}, '{pattern}') AS l FROM {source}),
      toks AS (SELECT {key}, i, l[i] AS tok FROM pieces, unnest(range(1, len(l) + 1)) AS u(i)),
      spans AS (SELECT {key}, i, tok, (coalesce(sum(length(tok)) OVER (PARTITION BY {key} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS off FROM toks)"""


_CORPUS = "corpus AS (SELECT DISTINCT id, text FROM token_corpus_v18_leakfree WHERE text IS NOT NULL)"
_TRAIN = "train AS (SELECT DISTINCT rec_id, text FROM train_v15_1m WHERE text IS NOT NULL)"
_ITEMS = "items AS (SELECT DISTINCT id, text FROM benchmark_sample WHERE text IS NOT NULL)"
_EVALUATION = "(SELECT text FROM benchmark_sample UNION ALL SELECT text FROM fused_sample)"
_GUARD = f"guard AS (SELECT DISTINCT {_trim('text')} AS phrase FROM {_EVALUATION} WHERE text IS NOT NULL)"
_D = "、―─「」『』（）…：；\\n"
_SCENES = """sc AS (SELECT DISTINCT ON (pov_id) scene_id AS doc, (idx::BIGINT * 1000000 + pov_id) AS idx, text, isdialogue AS is_dialogue, subjectcandidate AS subject, kasanetelemetry.texture AS x
      FROM pov_sentence_input WHERE text IS NOT NULL)"""
_SHARE = "CASE WHEN {0} > 1 THEN least(1.0, {0} / 100) ELSE {0} END"
_FEATURES = f"""{_SCENES}, f AS (SELECT doc, idx, coalesce(is_dialogue, false) AS is_dialogue, {_trim('text')} AS clean, subject, coalesce(x.showing, 50.0) AS showing, coalesce(x.speculation, 0.0) AS speculation,
      coalesce(x.staccato, 50.0) AS staccato, coalesce(x.confession, 0.0) AS confession, coalesce({_SHARE.format('x.tension')}, 0.0) AS tension,
      lag(x.tension) OVER w AS raw_before, min(x.speculation) OVER (PARTITION BY doc ORDER BY idx ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS least_before
      FROM sc WINDOW w AS (PARTITION BY doc ORDER BY idx)),
    g AS (SELECT *, {_SHARE.format('raw_before')} AS tension_before, coalesce(speculation - least_before >= 25 AND speculation >= 60, false) AS spike FROM f),
    h AS (SELECT *, coalesce(abs(tension - tension_before), 0) > 0.3 OR tension >= 0.3 AS modulated,
      coalesce({', '.join(f"nullif(regexp_extract(clean, '{p}'), '')" for p in P.INNER_STATES)}) AS phrase,
      coalesce(nullif(subject, ''), regexp_extract(clean, '{P.SUBJECT}', 1)) AS who FROM g)"""


def _verdicts(mode: str, strict: bool) -> str:
    if mode == "third_person_limited":
        allowed = "true"
        soft = f"confession >= CASE WHEN regexp_matches(clean, '{P.RECOLLECTION}') THEN 80 ELSE 65 END AND modulated AND regexp_matches(clean, '{P.FREE_INDIRECT}')"
    else:
        allowed = f"who = '' OR list_contains({_list(P.NARRATORS)}, who)"
        soft = "false"
    objective = "true" if mode == "third_person_objective" else "false"
    if mode == "third_person_objective":
        allowed = "who = ''"
    holder = "who" if mode != "first_person" else "'私'"
    level = "error" if strict else "warning"
    return f"""{_FEATURES}, k AS (SELECT *, regexp_matches(clean, '{P.MITIGATION}') AS softened, ((showing <= 20 AND speculation >= 60 AND staccato <= 25) OR spike) AS excess, ({allowed}) AS allowed, ({soft}) AS soft
        FROM h WHERE NOT is_dialogue AND clean <> ''),
      v AS (SELECT *, CASE WHEN soft THEN 'free_indirect_discourse' WHEN phrase IS NULL THEN NULL WHEN softened AND NOT excess THEN NULL
        WHEN softened AND (NOT allowed OR {objective}) THEN 'epistemic_leak_excessive_speculation' WHEN {objective} THEN 'objective_mode_leak' WHEN NOT allowed THEN 'unauthorized_internal_state' ELSE 'inner' END AS kind FROM k),
      n AS (SELECT *, CASE kind WHEN 'free_indirect_discourse' THEN {holder} WHEN 'inner' THEN who END AS holds FROM v WHERE kind IS NOT NULL),
      o AS (SELECT *, last_value(holds IGNORE NULLS) OVER w AS last_who, last_value(CASE WHEN holds IS NOT NULL THEN idx END IGNORE NULLS) OVER w AS last_idx
        FROM n WINDOW w AS (PARTITION BY doc ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
      r AS (SELECT *, CASE WHEN kind = 'inner' AND coalesce(last_who, '') <> '' AND last_who <> who AND idx - last_idx <= 2 THEN 'head_hopping' ELSE kind END AS verdict FROM o),
      verdicts AS (SELECT doc, idx, verdict AS kind, who, phrase, CASE WHEN verdict = 'free_indirect_discourse' THEN 'info' WHEN verdict = 'objective_mode_leak' THEN 'error' WHEN verdict = 'unauthorized_internal_state' THEN '{level}' ELSE 'warning' END AS severity,
        CASE verdict WHEN 'free_indirect_discourse' THEN 0.85 WHEN 'epistemic_leak_excessive_speculation' THEN round(least(1.0, 0.85 * (1 + 0.5 * (speculation / (showing + 1)))), 3) WHEN 'objective_mode_leak' THEN 0.95 WHEN 'unauthorized_internal_state' THEN 0.9 ELSE 0.8 END::DOUBLE AS confidence
        FROM r WHERE verdict <> 'inner')"""


_LEAKED = {
    "exact": f"SELECT id FROM corpus WHERE {_trim('text')} IN (SELECT phrase FROM guard)",
    "substring": f"SELECT id FROM corpus c WHERE EXISTS (SELECT 1 FROM guard g WHERE length(phrase) >= 12 AND (contains(c.text, phrase) OR ({_trim('c.text')} <> '' AND contains(phrase, {_trim('c.text')}))))",
}
_ROLE = "1.0 * 0.20"


def _twist(i: str) -> tuple[str, str, str]:
    n, t = G.NOMINAL, G.TOPICAL
    at = lambda rows, k, m: f"{_list([r[k] for r in rows])}[({i} // 2) % {m} + 1]"
    side = lambda k: f"CASE WHEN {i} % 2 = 0 THEN {at(n, k, len(n))} ELSE {at(t, k, len(t))} END"
    return f"{side(0)} || 'は、' || {side(2)}", f"{side(0)} || 'は、' || {side(1)}", f"CASE WHEN {i} % 2 = 0 THEN 'NOMINAL_PREDICATE_MISMATCH' ELSE 'TOPIC_CLAUSE_MISMATCH' END"


def oracle_sql() -> dict[str, str]:
    actions = [(w, n) for n, words in P.ACTIONS for w in words]
    connective = "CASE " + " ".join(f"WHEN regexp_matches(text, '^(?:{'|'.join(w)})') THEN {n}" for n, w in P.CONNECTIVES) + " ELSE 0 END"
    known = {w: a for a, words in P.PREDICATES.items() for w in words}
    stems = " ".join(f"WHEN regexp_matches(predicate, '{'|'.join(s)}') THEN '{a}'" for a, s in P.STEMS)
    action = "CASE WHEN predicate = '' THEN 'ChangeState' " + " ".join(f"WHEN predicate = '{w}' THEN '{a}'" for w, a in known.items()) + f" {stems} ELSE 'ChangeState' END"
    cases = f"""rel AS (SELECT DISTINCT ON (id) id AS rel_id, regexp_extract(text, '([一-龠ぁ-ん]+)[。」』）]*$', 1) AS predicate, case_particles AS args FROM token_corpus_v18_leakfree WHERE text IS NOT NULL AND case_particles IS NOT NULL)"""
    arg = lambda c: f"list_filter(args, lambda a: a.case_katakana = '{c}' AND coalesce(a.target_noun, '') <> '')[-1].target_noun"
    markup = "text"
    for pattern, new in ((r"［＃[^］]*］", ""), (r"｜([^《\n]+)《([^》\n]+)》", r"\1"), (r"([一-龠々〆ヵヶ]+)《([^》\n]+)》", r"\1"), (r"《[^》\n]*》", ""), ("｜", "")):
        markup = f"regexp_replace({markup}, '{pattern}', '{new}', 'g')"
    quick = "text"
    for pattern in ("《.*?》", "｜", "［＃.*?］", "(?s)-{5,}.*?-{5,}"):
        quick = f"regexp_replace({quick}, '{pattern}', '', 'g')"
    tw = _twist("i")
    lines = "[" + ", ".join(f"{{'text': '{a}', 'kind': '{b}'}}" for a, b in G.LINES) + "]"
    errors = ", ".join(f"('{kind}', {n * len(texts)}, {n * len(texts) if kind != 'clean' else 0})" for n, kind, texts in G.ERRORS)
    texts = ", ".join(f"('{t}')" for _, _, ts in G.ERRORS for t in ts)
    negations = "|".join(P.DOUBLE_NEGATIONS)
    decided = """SELECT event_type, operation, operation <> 'delete' AS accepted, count(*) AS n FROM (SELECT event_type, CASE event_type WHEN 'error' THEN 'delete' WHEN 'purchase' THEN 'create' ELSE 'update' END AS operation FROM events) GROUP BY ALL"""
    dims = 7
    corr = " UNION ALL ".join(f"SELECT {i}::INT AS i, {j}::INT AS j, round(corr(embedding[{i + 1}]::DOUBLE, embedding[{j + 1}]::DOUBLE), 6) AS corr FROM embeddings" for i in range(dims) for j in range(i, dims))
    mentions = """named AS (SELECT scene_id AS doc, idx, subjectcandidate AS ent, bool_or(coalesce(isdialogue, false)) AS is_speaker FROM pov_sentence_input WHERE subjectcandidate IS NOT NULL AND subjectcandidate <> '' GROUP BY ALL),
      asked AS (SELECT DISTINCT scene_id AS doc, idx FROM pov_sentence_input WHERE subjectcandidate IS NULL),
      met AS (SELECT a.doc, a.idx, n.ent, a.idx - n.idx AS distance, n.is_speaker, row_number() OVER (PARTITION BY a.doc, a.idx, n.ent ORDER BY a.idx - n.idx) AS r FROM asked a JOIN named n ON a.doc = n.doc AND a.idx - n.idx BETWEEN 0 AND 3),
      scored AS (SELECT *, 0.5 * 0.35 + CASE WHEN distance = 1 AND is_speaker THEN 1.0 ELSE power(0.75, distance) END * 0.30 + 1.0 * 0.20 + 1.2 * 0.15 + CASE WHEN distance = 1 AND is_speaker THEN 0.25 ELSE 0.0 END AS score FROM met WHERE r = 1),
      expo AS (SELECT *, exp((score - max(score) OVER (PARTITION BY doc, idx)) * 2) AS e FROM scored),
      ranked AS (SELECT doc, idx, ent, distance, score, e / sum(e) OVER (PARTITION BY doc, idx) AS likelihood, row_number() OVER (PARTITION BY doc, idx ORDER BY score DESC, distance, ent) AS rank FROM expo)"""
    return {
        "corpus_build": f"""WITH {_CORPUS}, {_GUARD}, rows_ AS (SELECT DISTINCT id, source, text FROM token_corpus_v18_leakfree WHERE text IS NOT NULL),
          s AS (SELECT id, source, list_filter(regexp_extract_all(text, '[^。！？!]*[。！？!]|[^。！？!]+'), lambda x: regexp_matches(x, '{_SOLID}')) AS l FROM rows_ WHERE id NOT IN ({_LEAKED['substring']})),
          t AS (SELECT id, source, i - 1 AS no, l[i] AS sentence FROM s, unnest(range(1, len(l) + 1)) AS u(i)),
          k AS (SELECT *, row_number() OVER (PARTITION BY {_trim('sentence')} ORDER BY id, no) AS r FROM t WHERE length(sentence) BETWEEN 6 AND 120)
          SELECT source, count(*) AS sentences, sum(length(sentence))::BIGINT AS chars, max(length(sentence))::INT AS longest FROM k WHERE r = 1 GROUP BY source""",
        "sentence_segments": f"""WITH s AS (SELECT doc_id, list_filter(regexp_extract_all(text, '[^。！？!]*[。！？!]|[^。！？!]+'), lambda x: regexp_matches(x, '{_SOLID}')) AS l FROM documents WHERE text IS NOT NULL)
          SELECT doc_id, (i - 1)::INT AS sent_no, l[i] AS sentence FROM s, unnest(range(1, len(l) + 1)) AS u(i)""",
        "sentence_offsets": f"""WITH src AS (SELECT DISTINCT sar_id, sentence FROM sentence_analysis_result WHERE sentence IS NOT NULL), {_spans('src', 'sar_id', 'sentence', '[^。\\n!！?？]*[。\\n!！?？]|[^。\\n!！?？]+')}
          SELECT sar_id, off AS from_off, (off + length(tok))::INT AS to_off FROM spans WHERE regexp_matches(tok, '{_SOLID}')""",
        "clause_split": f"""WITH {_CORPUS}, {_spans('corpus', 'id', 'text', f'[^{_D}]+[{_D}]?|[{_D}]')}
          SELECT id, off AS start_pos, tok AS clause FROM spans WHERE regexp_matches(tok, '^[^{_D}]') AND regexp_matches(tok, '{_SOLID}')""",
        "markup_clean": f"SELECT doc_id, {markup} AS clean FROM documents WHERE text IS NOT NULL",
        "quick_clean": f"SELECT doc_id, {quick} AS clean FROM documents WHERE text IS NOT NULL",
        "header_strip": f"""WITH l AS (SELECT doc_id, text, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS a FROM documents WHERE text IS NOT NULL),
          m AS (SELECT doc_id, text, i, a[i] AS line, {_trim('a[i]')} AS s FROM l, unnest(range(1, len(a) + 1)) AS u(i)),
          n AS (SELECT *, starts_with(s, '-------') AS dash, sum(starts_with(s, '-------')::INT) OVER (PARTITION BY doc_id ORDER BY i) AS seen FROM m),
          o AS (SELECT *, seen >= 2 AND NOT dash AS inside, bool_or(seen >= 2 AND NOT dash AND (starts_with(s, '底本：') OR starts_with(s, '［＃本文終わり］'))) OVER (PARTITION BY doc_id ORDER BY i) AS ended FROM n)
          SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE inside AND NOT ended), any_value(text)) AS body FROM o GROUP BY doc_id""",
        "repetition_marks": r"SELECT doc_id, regexp_replace(text, '([一-鿿])々', '\1\1', 'g') AS expanded FROM documents WHERE contains(text, '々')",
        "length_bands": "SELECT source, " + ", ".join(f"count(*) FILTER (WHERE length(text) BETWEEN {a} AND {b}) AS l{n}" for a, b, n in ((4, 128, "4_128"), (6, 120, "6_120"), (8, 120, "8_120"), (5, 120, "5_120"), (6, 90, "6_90"), (10, 240, "10_240"))) + " FROM (SELECT DISTINCT id, source, text FROM token_corpus_v18_leakfree WHERE text IS NOT NULL) GROUP BY source",
        "ruby_count": f"SELECT doc_id, len(list_filter(regexp_extract_all(text, '([一-龠々〆ヵヶ]+)《([^》\\n]+)》', 1), lambda b: contains({markup}, b)))::INT AS rubies FROM documents WHERE text IS NOT NULL",
        "leak_exact": f"WITH {_CORPUS}, {_GUARD} {_LEAKED['exact']}",
        "leak_substring": f"WITH {_CORPUS}, {_GUARD} {_LEAKED['substring']}",
        "leak_phrase": f"""WITH {_CORPUS}, ph AS (SELECT {_trim('p')} AS phrase FROM (SELECT unnest(regexp_extract_all(text, '[「『（]([^」』）]+)[」』）]', 1)) AS p FROM {_EVALUATION} WHERE text IS NOT NULL)
            UNION SELECT {_trim('h')} FROM (SELECT string_split(text, '、と')[1] AS h FROM {_EVALUATION} WHERE contains(text, '、と')) WHERE length(h) >= 6)
          SELECT id FROM corpus c WHERE EXISTS (SELECT 1 FROM ph WHERE length(phrase) >= 8 AND contains(c.text, phrase))""",
        "leak_audit": f"WITH {_CORPUS}, {_GUARD} SELECT count(*) AS checked, count(*) FILTER (WHERE {_trim('text')} IN (SELECT phrase FROM guard)) AS overlaps FROM corpus WHERE id NOT IN ({_LEAKED['exact']})",
        "dedup_first": f"WITH {_CORPUS} SELECT id, text FROM (SELECT *, row_number() OVER (PARTITION BY {_trim('text')} ORDER BY id) AS r FROM corpus) WHERE r = 1",
        "corpus_union": f"""WITH u AS (SELECT 0 AS src_rank, id::VARCHAR AS id, {_trim('text')} AS text FROM benchmark_sample WHERE text IS NOT NULL UNION ALL SELECT 1, rec_id::VARCHAR, {_trim('text')} FROM val_v15_1m WHERE text IS NOT NULL UNION ALL SELECT 2, rec_id::VARCHAR, {_trim('text')} FROM train_v15_1m WHERE text IS NOT NULL),
          k AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY src_rank, id) AS r FROM u) SELECT src_rank, count(*) AS kept, sum(length(text))::BIGINT AS chars FROM k WHERE r = 1 GROUP BY src_rank""",
        "source_cap": "SELECT id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY id) AS r FROM (SELECT DISTINCT id, source FROM token_corpus_v18_leakfree WHERE source IS NOT NULL)) WHERE r <= 5",
        "numbered_ids": "SELECT rec_id, source, source || '_' || lpad((row_number() OVER (PARTITION BY source ORDER BY rec_id) - 1)::VARCHAR, 7, '0') AS new_id FROM (SELECT DISTINCT rec_id, source FROM train_v15_1m WHERE source IS NOT NULL)",
        "split_90_10": "WITH i AS (SELECT DISTINCT rec_id FROM train_v15_1m), r AS (SELECT rec_id, row_number() OVER (ORDER BY rec_id) - 1 AS k, count(*) OVER () AS n FROM i) SELECT rec_id, CASE WHEN k < floor(n * 0.9) THEN 'train' ELSE 'val' END AS split FROM r",
        "oversampled": f"WITH {_ITEMS} SELECT copy::INT AS copy, count(*) AS n FROM items, unnest(range(1, 51)) AS u(copy) GROUP BY copy",
        "char_vocab_topn": f"""WITH {_CORPUS}, ch AS (SELECT id, i, substr(text, i::INT, 1) AS ch FROM corpus, unnest(range(1, length(text) + 1)) AS u(i)),
          c AS (SELECT ch, count(*) AS n, min(id || '#' || lpad(i::VARCHAR, 8, '0')) AS first FROM ch GROUP BY ch)
          SELECT ch, n, (row_number() OVER (ORDER BY n DESC, first) - 1 + {len(tokenizer.SPECIAL)})::INT AS token_id FROM c ORDER BY n DESC, first LIMIT 2040""",
        "distinct_chars": f"WITH {_CORPUS} SELECT DISTINCT substr(text, i::INT, 1) AS ch FROM corpus, unnest(range(1, length(text) + 1)) AS u(i)",
        "utf16_offsets": r"SELECT window_id, length(text)::INT AS code_points, (length(text) + len(regexp_extract_all(text, '[\x{10000}-\x{10FFFF}]')))::INT AS utf16_units FROM (SELECT DISTINCT window_id, text FROM snapped_context_window WHERE text IS NOT NULL)",
        "padded_labels": "SELECT rec_id, array_to_string(list_resize(modality_ids[1:128], 128, 0), ',') AS padded FROM (SELECT DISTINCT rec_id, modality_ids FROM val_v15_1m WHERE modality_ids IS NOT NULL)",
        "modality_histogram": "WITH l AS (SELECT unnest(token_modality) AS label FROM token_corpus_v18_leakfree) SELECT label, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 4)::DOUBLE AS percent FROM l GROUP BY label",
        "particle_topk": "WITH p AS (SELECT unnest(case_particles) AS p FROM token_corpus_v18_leakfree) SELECT p.particle AS particle, count(*) AS n FROM p GROUP BY 1 ORDER BY n DESC, particle LIMIT 10",
        "case_particles": f"WITH {_CORPUS}, {_spans('corpus', 'id', 'text', '(?s)' + '|'.join(P.PARTICLES) + '|.')} SELECT id, off AS start_pos, tok AS particle FROM spans WHERE list_contains({_list(P.PARTICLES)}, tok)",
        "case_labels_find": f"""WITH {_TRAIN}, p AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{k}', {v[0]})" for i, (k, v) in enumerate(P.CASES.items()))}) AS v(rank, w, case_id)),
          hits AS (SELECT rec_id, (i - 1)::INT AS pos, rank, case_id FROM train, p, unnest(range(1, length(text) + 1)) AS u(i) WHERE substr(text, i::INT, length(w)::INT) = w AND i <= 256)
          SELECT rec_id, pos, arg_max(case_id, rank) AS case_id FROM hits GROUP BY rec_id, pos""",
        "epistemic_score": f"""SELECT rec_id, CASE WHEN coalesce(is_dialogue, false) THEN 0.1 ELSE least(1.0, CASE WHEN regexp_matches(text, '私|僕|俺') THEN greatest(b, 0.5) ELSE b END) END::DOUBLE AS score
          FROM (SELECT *, CASE WHEN {_any('text', P.CONJECTURE)} THEN greatest(0.2, a * 0.5) ELSE a END AS b FROM (SELECT *, CASE WHEN {_any('text', P.INTERNAL)} THEN 0.8 ELSE 0.0 END AS a FROM (SELECT DISTINCT rec_id, text, is_dialogue FROM train_v15_1m WHERE text IS NOT NULL)))""",
        "connective_label": f"WITH {_TRAIN} SELECT rec_id, {connective} AS connective FROM train",
        "action_spans": f"WITH {_TRAIN}, w AS (SELECT * FROM (VALUES {', '.join(f"('{w}', {n})" for w, n in actions)}) AS v(w, action)) SELECT rec_id, (strpos(text, w) - 1)::INT AS start_pos, (strpos(text, w) - 1 + length(w))::INT AS end_pos, action FROM train, w WHERE contains(text, w)",
        "entity_spans": f"WITH {_TRAIN}, {_spans('train', 'rec_id', 'text', '(?s)' + P.ENTITY.strip('()') + '|.')} SELECT rec_id, off AS start_pos, tok AS entity FROM spans WHERE regexp_full_match(tok, '{P.ENTITY}')",
        "validation_cases": f"""SELECT 'val_int8_' || lpad((i + 1)::VARCHAR, 6, '0') AS id, CASE WHEN i % 10 = 0 THEN {tw[0]} ELSE who || 'は' || place || 'で' || deed END AS text, '第' || (i // 500 + 1) || '章: ' || place || 'における' || who || 'の行動記録#' || (i + 1) AS context,
          i % 10 = 0 AS has_twist, CASE WHEN i % 10 = 0 THEN {tw[2]} END AS twist_type, CASE WHEN i % 10 = 0 THEN {tw[1]} END AS corrected_text
          FROM (SELECT i, {_list(G.PLACES)}[i % 10 + 1] AS place, {_list(G.PEOPLE)}[(i // 10) % 10 + 1] AS who, {_list(G.DEEDS)}[(i // 100) % 10 + 1] AS deed FROM range(5000) AS r(i))""",
        "fallback_cases": f"""SELECT i AS id, place || 'で' || who || 'はたたずんでいた。' AS context, CASE WHEN i % 5 = 0 THEN {tw[0]} WHEN starts_with(line.text, '「') THEN line.text ELSE who || 'は' || line.text END AS text, line.kind AS text_type, i % 5 = 0 AS has_twist
          FROM (SELECT i, {_list(G.SUBJECTS)}[i % 8 + 1] AS who, {_list(G.SCENES)}[(i * 3) % 6 + 1] AS place, {lines}[(i * 5) % 6 + 1] AS line FROM range(1000) AS r(i))""",
        "error_benchmark_stats": f"SELECT error_type, sum(n)::BIGINT AS n, sum(e)::BIGINT AS errors FROM (VALUES {errors}) AS v(error_type, n, e) GROUP BY error_type",
        "template_product": f"SELECT a::INT AS a, b::INT AS b, {_list(G.PEOPLE)}[a + 1] || 'は' || {_list(G.PLACES)}[b + 1] AS text FROM range(10) AS x(a), range(10) AS y(b) ORDER BY a, b LIMIT 50",
        "double_negation": f"WITH {_CORPUS}, t AS (SELECT id, text FROM corpus UNION ALL SELECT DISTINCT text, text FROM (VALUES {texts}) AS v(text)), {_spans('t', 'id', 'text', f'(?s){negations}|.')} SELECT id, off AS start_pos, tok AS phrase FROM spans WHERE list_contains({_list(P.DOUBLE_NEGATIONS)}, tok)",
        "long_dependency": """WITH f AS (SELECT DISTINCT ON (id) id, text, telemetry.texture AS x, telemetry.dynamics AS d FROM fused_sample WHERE text IS NOT NULL),
          g AS (SELECT *, regexp_extract(text, '(?:^|[、。])([一-龠々ぁ-んァ-ヶa-zA-Z0-9]+[はが])') AS whole FROM f),
          h AS (SELECT *, (strpos(text, whole) - 1 + CASE WHEN regexp_matches(whole, '^[、。]') THEN 1 ELSE 0 END)::INT AS start_pos FROM g WHERE whole <> '')
          SELECT id, start_pos, (length(text) - 1 - start_pos)::INT AS distance, CASE WHEN (coalesce(x.polyphony, 0) >= 70 AND coalesce(x.cadence, d.cadence, 0) >= 45) OR (CASE WHEN coalesce(x.tension, 0) > 1 THEN x.tension / 100 ELSE coalesce(x.tension, 0) END >= 0.7 AND coalesce(x.confession, 0) >= 70) OR coalesce(d.crestfactor, 1) >= 2.5 THEN 'info' ELSE 'warning' END AS severity
          FROM h WHERE length(text) - 1 - start_pos > coalesce(d.maxdependencydistance, 12) + 8""",
        "modulated_modality": """SELECT pov_id, CASE WHEN c IS NULL THEN 0.6 ELSE round(greatest(0.0, 1 - least(1.0, greatest(0.0, 0.4 * (1 + 0.5 * c / 100)))), 6) END::DOUBLE AS narrative, CASE WHEN c IS NULL THEN 0.4 ELSE round(least(1.0, greatest(0.0, 0.4 * (1 + 0.5 * c / 100))), 6) END::DOUBLE AS monologue
          FROM (SELECT DISTINCT ON (pov_id) pov_id, kasanetelemetry.texture.confession AS c FROM pov_sentence_input)""",
        "pov_spike": f"WITH {_FEATURES} SELECT doc, idx, round(speculation, 4) AS speculation, round(least_before, 4) AS least_before FROM h WHERE spike",
        "tension_modulation": f"WITH {_FEATURES} SELECT doc, idx, round(tension, 6)::DOUBLE AS tension, round(tension_before, 6)::DOUBLE AS tension_before, modulated FROM h",
        "pov_violations": f"WITH {_verdicts('third_person_limited', False)} SELECT * FROM verdicts",
        "pov_first_person": f"WITH {_verdicts('first_person', True)} SELECT * FROM verdicts",
        "pov_report": f"""WITH {_verdicts('third_person_objective', False)}, n2 AS (SELECT doc, count(*) AS sentences, count(*) FILTER (WHERE coalesce(is_dialogue, false)) AS dialogue FROM sc GROUP BY doc),
          m2 AS (SELECT doc, count(*) AS violations, count(*) FILTER (WHERE kind = 'head_hopping') AS head_hops, sum(CASE severity WHEN 'error' THEN 0.25 WHEN 'warning' THEN 0.1 ELSE 0 END)::DOUBLE AS penalty FROM verdicts GROUP BY doc)
          SELECT doc, sentences, dialogue, coalesce(violations, 0) AS violations, coalesce(head_hops, 0) AS head_hops, round(greatest(0.0, least(1.0, 1 - CASE WHEN sentences > dialogue THEN coalesce(penalty, 0) / greatest(1.0, (sentences - dialogue) / 5) ELSE 0 END)), 3)::DOUBLE AS score FROM n2 LEFT JOIN m2 USING (doc)""",
        "antecedent_rank": f"WITH {mentions} SELECT doc, idx, ent, distance, round(score, 6)::DOUBLE AS score, round(likelihood, 6)::DOUBLE AS likelihood, rank::INT AS rank FROM ranked",
        "antecedent_best": f"WITH {mentions} SELECT doc, idx, CASE WHEN likelihood >= 0.25 THEN ent END AS antecedent FROM ranked WHERE rank = 1",
        "mandatory_slots": f"WITH {cases}, m AS (SELECT rel_id, len(list_filter(['ガ', 'ヲ'], lambda c: NOT list_contains(list_transform(args, lambda a: a.case_katakana), c)))::INT AS missing FROM rel) SELECT rel_id, missing, round(CASE WHEN missing = 0 THEN 1.0 ELSE greatest(0.1, 1 - (0.2 * missing + 0.3 * 0.8)) END, 6)::DOUBLE AS score FROM m",
        "action_normalize": f"WITH {cases}, w AS (SELECT DISTINCT predicate FROM rel) SELECT predicate, {action} AS action FROM w",
        "pas_events": f"""WITH {cases}, a AS (SELECT rel_id, predicate, args, {action} AS action, {arg('ガ')} AS subject, {arg('ヲ')} AS object, {arg('ニ')} AS target FROM rel)
          SELECT rel_id, coalesce(subject, 'unknown_entity') AS entity_id, action, CASE action WHEN 'Drop' THEN 'delete' WHEN 'Acquire' THEN 'create' ELSE 'update' END AS operation, subject, object, target, predicate, false AS is_subject_zero FROM a""",
        "semantic_jump_bias": """WITH f AS (SELECT DISTINCT ON (id) id, telemetry FROM fused_sample WHERE telemetry IS NOT NULL), j AS (SELECT id, unnest(telemetry.semanticjumps) AS j FROM f),
          c AS (SELECT id, unnest(CASE j.casemarker WHEN 1 THEN [0, 1] WHEN 2 THEN [1, 2] WHEN 3 THEN [2, 3] END) AS case_idx, j.verbtokenidx AS pred, j.nountokenidx AS arg, CASE WHEN j.jumpdegree < 40 THEN 0.8 WHEN j.jumpdegree >= 80 THEN -0.6 * j.jumpdegree / 100 ELSE 0.0 END::DOUBLE AS delta FROM j)
          SELECT id, case_idx, pred, arg, round(sum(delta), 6) AS bias FROM c GROUP BY ALL""",
        "event_accept": decided,
        "stream_event_accept": decided,
        "int8_quantize": "SELECT vec_id, array_to_string(list_transform(embedding, lambda x: greatest(-128, least(127, floor(x::DOUBLE / 0.01 + 0.5)::INT))), ',') AS q FROM embeddings",
        "dot_product": "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 6) AS dot FROM embeddings",
        "correlation_matrix": corr,
        "embedding_argmax": """SELECT vec_id, (list_position(e, list_max(e)) - 1)::INT AS best, round(1 / list_sum(list_transform(e, lambda x: exp(x - list_max(e)))), 6) AS share FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)""",
        "confusion_f1": """WITH c AS (SELECT count(*) FILTER (WHERE t AND g) AS tp, count(*) FILTER (WHERE NOT t AND g) AS fp, count(*) FILTER (WHERE t AND NOT g) AS fn, count(*) FILTER (WHERE NOT t AND NOT g) AS tn FROM (SELECT coalesce(is_dialogue, false) AS t, coalesce(starts_with(text, '「'), false) AS g FROM (SELECT DISTINCT rec_id, text, is_dialogue FROM train_v15_1m))),
          p AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp * 100.0::DOUBLE / (tp + fp) ELSE 0 END AS pr, CASE WHEN tp + fn > 0 THEN tp * 100.0::DOUBLE / (tp + fn) ELSE 0 END AS re FROM c)
          SELECT tp, fp, fn, tn, round(pr, 4) AS precision, round(re, 4) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 4) AS f1 FROM p""",
        "category_accuracy": """WITH b AS (SELECT DISTINCT ON (id) * FROM benchmark_sample), r AS (SELECT gold_category, coalesce(starts_with(lower(gold_category), lower(expected_modality)), false)::INT AS ok FROM b WHERE gold_category IS NOT NULL)
          SELECT gold_category, count(*) AS total, sum(ok)::BIGINT AS passed, round(sum(ok) / count(*), 6)::DOUBLE AS accuracy FROM r GROUP BY ROLLUP (gold_category)""",
        "percentile_nearest": "WITH l AS (SELECT list(value ORDER BY value) AS a FROM events WHERE value IS NOT NULL) SELECT p::DOUBLE AS p, round(a[floor(len(a) * p)::INT + 1], 6) AS value FROM l, (VALUES (0.5), (0.95), (0.99)) AS v(p)",
        "percentile_linear": "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(value), 6) AS mean FROM events GROUP BY event_type",
        "latency_summary": "SELECT user_id, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY user_id",
        "running_mean": "SELECT user_id, event_id, floor(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) * 1000 + 0.5 + 1e-6) / 1000 AS running_mean FROM events",
        "masked_accuracy": """WITH r AS (SELECT DISTINCT rec_id, case_ids, label_ids FROM train_v15_1m WHERE case_ids IS NOT NULL AND label_ids IS NOT NULL), z AS (SELECT rec_id, list_filter(list_zip(case_ids, label_ids), lambda x: x[1] <> -100) AS l FROM r)
          SELECT rec_id, CASE WHEN len(l) > 0 THEN round(len(list_filter(l, lambda x: x[1] = x[2])) / len(l), 6) END::DOUBLE AS accuracy FROM z""",
        "threshold_rates": """WITH f AS (SELECT DISTINCT ON (id) category, telemetry.texture AS x FROM fused_sample WHERE telemetry IS NOT NULL)
          SELECT category, round(avg((x.confession >= 65)::INT), 6) AS fid, round(avg((x.showing <= 20 AND x.speculation >= 60)::INT), 6) AS leak, round(avg((x.cadence >= 30)::INT), 6) AS cadence FROM f GROUP BY category""",
        "json_props": "SELECT event_type, sum((props::JSON->>'$.k')::INT)::BIGINT AS total, count((props::JSON->>'$.k')::INT) AS n FROM events GROUP BY event_type",
        "row_digest": f"WITH {_ITEMS} SELECT id, sha256(text) AS sha FROM items",
        "anomaly_bits": "SELECT (raw & 65535) > 32768 AS is_anomaly, (raw >> 16) & 255 AS severity, count(*) AS n FROM (SELECT l_orderkey * 7919 + l_partkey * 104729 AS raw FROM lineitem) GROUP BY ALL",
        "state_history": "SELECT user_id, event_type, event_id AS valid_from, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS valid_to FROM events",
        "lifetime_violations": """SELECT l_orderkey AS entity, l_linenumber AS line, CASE WHEN l_shipdate::DATE < o_orderdate::DATE THEN 'before_birth' ELSE 'after_death' END AS violation FROM lineitem JOIN orders ON l_orderkey = o_orderkey
          WHERE l_shipdate::DATE < o_orderdate::DATE OR l_shipdate::DATE > o_orderdate::DATE + 60""",
        "simultaneous_presence": """WITH e AS (SELECT DISTINCT user_id AS entity, event_type AS place, floor(epoch(ts))::BIGINT AS s FROM events)
          SELECT DISTINCT a.entity, a.place, a.s AS start, b.place AS other_place FROM e a JOIN e b ON a.entity = b.entity AND a.place <> b.place AND b.s <= a.s AND a.s < b.s + 5400""",
        "speed_violations": """WITH m AS (SELECT user_id AS entity, event_id AS event_at, abs(value - lag(value) OVER w) / nullif(event_id - lag(event_id) OVER w, 0) AS speed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT entity, event_at, round(speed, 6) AS speed FROM m WHERE speed > 2.0""",
        "causal_cycles": """WITH RECURSIVE e AS (SELECT n_nationkey AS src, (n_nationkey * 7 + 3) % 25 AS dst FROM nation), reach AS (SELECT src AS node, dst AS there, 1 AS n FROM e UNION ALL SELECT r.node, e.dst, r.n + 1 FROM reach r JOIN e ON r.there = e.src WHERE r.there <> r.node  AND r.n <= 25)
          SELECT node, min(n)::INT AS steps FROM reach WHERE there = node GROUP BY node""",
    }
