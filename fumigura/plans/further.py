"""Further named queries, each with its SQL beside it where it has one."""

from __future__ import annotations

from pyspark.sql import functions as F

from fumigura import profiles as P
from fumigura.functions import text as T
from fumigura.operators import anaphora, annotate, consistency, corpus, evaluate, events, generate, normalizer, pas
from fumigura.plans import registry as R
from fumigura.plans.oracle import _CORPUS, _TRAIN, _trim
from fumigura.sources import io
from fumigura.sources.io import table
from fumigura.streaming import events as stream

QUERIES: dict[str, R.Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: R.Query) -> R.Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- cleaning and segmentation ---


@query(r"""WITH r AS (SELECT doc_id, regexp_extract_all(text, '｜([^《\n]+)《([^》\n]+)》', 1) AS b, regexp_extract_all(text, '｜([^《\n]+)《([^》\n]+)》', 2) AS y FROM documents WHERE text IS NOT NULL)
  SELECT doc_id, (i - 1)::INT AS no, b[i] AS base, y[i] AS reading FROM r, unnest(range(1, len(b) + 1)) AS u(i)""")
def escaped_ruby(s, d):
    return R._documents(s, d).select("doc_id", F.posexplode(T.escaped_rubies(F.col("text"))).alias("no", "r")).select("doc_id", "no", "r.base", "r.reading")


@query()
def nfkc_clean(s, d):
    return normalizer.compatible(R._documents(s, d), "doc_id", "text", "clean")


@query(r"SELECT doc_id, regexp_replace(regexp_replace(text, '([一-龠])々', '\1\1', 'g'), '([ぁ-ん])[ゝゞ]', '\1\1', 'g') AS expanded FROM documents WHERE text IS NOT NULL")
def kana_repetition(s, d):
    return R._documents(s, d).select("doc_id", T.expand_kana_repetition(F.col("text")).alias("expanded"))


_Q = "「[^」]*」|『[^』]*』|（[^）]*）"


@query()
def bracket_segments(s, d):
    return corpus.bracketed_segments(R._corpus(s, d), "id", "text")


def _segments_sql(quoted: str, opening: str, label: str) -> str:
    """Lines cut before and after what is quoted, the rest by sentence; ``label`` names each part."""
    return rf"""WITH {_CORPUS}, l AS (SELECT id, i - 1 AS line_no, {_trim('a[i]')} AS line FROM (SELECT id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS a FROM corpus), unnest(range(1, len(a) + 1)) AS u(i)),
      t AS (SELECT id, line_no, k, x[k] AS tok, regexp_full_match(x[k], '(?s){quoted}') AS whole FROM (SELECT id, line_no, regexp_extract_all(line, '(?s){quoted}|[^{opening}]+|[{opening}]') AS x FROM l WHERE line <> ''), unnest(range(1, len(x) + 1)) AS u(k)),
      b AS (SELECT *, coalesce(lag(whole) OVER (PARTITION BY id, line_no ORDER BY k), true) AS before FROM t),
      g AS (SELECT *, sum(CASE WHEN NOT whole AND NOT before THEN 0 ELSE 1 END) OVER (PARTITION BY id, line_no ORDER BY k) AS grp FROM b),
      p AS (SELECT id, line_no, grp, {_trim("string_agg(tok, '' ORDER BY k)")} AS part FROM g GROUP BY id, line_no, grp),
      n AS (SELECT *, row_number() OVER (PARTITION BY id, line_no ORDER BY grp) - 1 AS part_no, regexp_full_match(part, '「.*」|『.*』') AS spoken, regexp_full_match(part, '（.*）') AS rounded FROM p WHERE part <> ''),
      c AS (SELECT *, {label}, CASE WHEN spoken OR (rounded AND contains('{opening}', '（')) THEN [part] ELSE list_filter(regexp_extract_all(part, '[^。！？!]*[。！？!]|[^。！？!]+'), lambda x: {_trim('x')} <> '') END AS cut FROM n)
      SELECT id, line_no::INT AS line_no, part_no::INT AS part_no, (j - 1)::INT AS sent_no, {_trim('cut[j]')} AS segment, {label.rsplit(' ', 1)[1]} FROM c, unnest(range(1, len(cut) + 1)) AS u(j)"""


SQL["bracket_segments"] = _segments_sql(_Q, "「『（", "CASE WHEN spoken THEN 'dialogue' WHEN rounded THEN 'monologue' ELSE 'narrative' END AS kind")
SQL["quoted_segments"] = _segments_sql("「[^」]*」|『[^』]*』", "「『", "spoken AS is_dialogue")


@query(rf"""WITH {_CORPUS}, l AS (SELECT id, i - 1 AS line_no, {_trim('a[i]')} AS line FROM (SELECT id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS a FROM corpus), unnest(range(1, len(a) + 1)) AS u(i)),
  p AS (SELECT id, line_no, starts_with(line, '「') AND ends_with(line, '」') AS is_dialogue, list_filter(list_transform(string_split(line, '。'), lambda x: {_trim('x')}), lambda x: length(x) >= 5) AS y FROM l WHERE line <> ''),
  e AS (SELECT id, line_no, is_dialogue, list_filter(list_transform(y, lambda s: CASE WHEN is_dialogue AND NOT ends_with(s, '」') THEN s || '」' ELSE s END), lambda s: length(s) <= 120) AS x FROM p)
  SELECT id, line_no::INT AS line_no, (k - 1)::INT AS sent_no, x[k] AS sentence, is_dialogue FROM e, unnest(range(1, len(x) + 1)) AS u(k)""")
def dialogue_lines(s, d):
    return corpus.dialogue_lines(R._corpus(s, d), "id", "text")


# --- caps, order and statistics ---


@query(f"WITH {_CORPUS} SELECT id, text FROM corpus ORDER BY id, text LIMIT 1000")
def corpus_truncate(s, d):
    return corpus.first_n(R._corpus(s, d), 1000, "id", "text")


@query("""WITH r AS (SELECT DISTINCT rec_id, source, rec_id // 50 AS part FROM train_v15_1m WHERE source IS NOT NULL), n AS (SELECT source, part, count(*) AS n FROM r GROUP BY ALL),
  b AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY part) - n AS before FROM n) SELECT rec_id, source, part FROM r JOIN b USING (source, part) WHERE before < 20""")
def part_cap(s, d):
    rows = table(s, d, "train_v15_1m", "rec_id", "source").where("source is not null").distinct().withColumn("part", F.floor(F.col("rec_id") / 50))
    return corpus.keep_parts(rows, "source", "part", 20).select("rec_id", "source", "part")


@query("SELECT category, n, row_number() OVER (ORDER BY f, category)::INT AS place FROM (SELECT category, count(*) AS n, min(id) AS f FROM fused_sample GROUP BY category)")
def category_first_seen(s, d):
    return corpus.first_seen_counts(table(s, d, "fused_sample", "id", "category"), "category", "id")


@query("SELECT {'total': count(*), 'flagged': count(*) FILTER (WHERE has_bracket), 'ratio': round(count(*) FILTER (WHERE has_bracket) / count(*), 4)}.ratio AS ratio, count(*) AS total, count(*) FILTER (WHERE has_bracket) AS flagged FROM benchmark_sample")
def bracket_ratio(s, d):
    stats = io.stats_json(table(s, d, "benchmark_sample", "gold_category", "has_bracket"), "gold_category", "has_bracket")
    return stats.select(F.from_json("stats", "total long, flagged long, ratio double").alias("x")).select("x.ratio", "x.total", "x.flagged")


@query("SELECT user_id, count(*) AS n, round(min(value), 6) AS least, round(max(value), 6) AS most, round(count(*) / nullif((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 0), 6) AS per_second FROM events GROUP BY user_id")
def throughput(s, d):
    took = (F.unix_micros(F.max(F.col("ts").cast("timestamp"))) - F.unix_micros(F.min(F.col("ts").cast("timestamp")))) / 1e6
    return table(s, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.min("value"), 6).alias("least"), F.round(F.max("value"), 6).alias("most"), F.round(F.count("*") / F.nullif(took, F.lit(0.0)), 6).alias("per_second"))


@query("""WITH f AS (SELECT DISTINCT ON (id) category = 'fid_monologue' AS t, telemetry.texture AS x, coalesce(is_past_recollection, false) AS past FROM fused_sample WHERE telemetry IS NOT NULL AND category IS NOT NULL),
  p AS (SELECT t, coalesce(x.confession >= 65 AND x.cadence / 100 >= 0.3, false) AS a, coalesce(x.confession >= CASE WHEN past THEN 80 ELSE 65 END AND x.cadence / 100 >= 0.3, false) AS b FROM f)
  SELECT round(sum((a AND NOT t)::INT) / nullif(sum((NOT t)::INT), 0), 6)::DOUBLE AS fp, round(sum((NOT a AND t)::INT) / nullif(sum(t::INT), 0), 6)::DOUBLE AS fn, round(sum((b AND NOT t)::INT) / nullif(sum((NOT t)::INT), 0), 6)::DOUBLE AS fp_guarded, round(sum((NOT b AND t)::INT) / nullif(sum(t::INT), 0), 6)::DOUBLE AS fn_guarded FROM p""")
def guard_rates(s, d):
    rows = table(s, d, "fused_sample", "id", "category", "telemetry", "is_past_recollection").where("telemetry is not null and category is not null").dropDuplicates(["id"])
    x = F.col("telemetry.texture")
    return evaluate.guard_rates(rows, x["confession"], x["cadence"] / 100, F.col("is_past_recollection"), F.col("category") == "fid_monologue")


@query()
def perturbation_trials(s, d):
    return evaluate.perturbation_trials(s)


@query("""WITH t AS (SELECT DISTINCT rec_id, epistemic FROM train_v15_1m WHERE epistemic IS NOT NULL AND len(epistemic) > 0)
  SELECT rec_id, round(list_sum(list_transform(epistemic, lambda x: exp(x) / (1 + exp(x)))) / len(epistemic), 6) AS share FROM t""")
def token_probability(s, d):
    rows = table(s, d, "train_v15_1m", "rec_id", "epistemic").where("size(epistemic) > 0").distinct()
    second = lambda x: F.exp(x) / (F.exp(F.lit(0.0)) + F.exp(x))
    return rows.select("rec_id", F.round(F.aggregate("epistemic", F.lit(0.0), lambda n, x: n + second(x)) / F.size("epistemic"), 6).alias("share"))


@query("""SELECT rec_id, len(list_intersect(list_distinct(label_ids), list_distinct(case_ids)))::INT AS shared, list_contains(label_ids, 1) AS has_root, len(list_filter(list_distinct(case_ids), lambda x: NOT list_contains(label_ids, x))) = 0 AS within
  FROM (SELECT DISTINCT rec_id, label_ids, case_ids FROM train_v15_1m WHERE label_ids IS NOT NULL AND case_ids IS NOT NULL)""")
def label_sets(s, d):
    rows = table(s, d, "train_v15_1m", "rec_id", "label_ids", "case_ids").where("label_ids is not null and case_ids is not null").distinct()
    return rows.select("rec_id", F.size(F.array_intersect("label_ids", "case_ids")).alias("shared"), F.array_contains("label_ids", 1).alias("has_root"), (F.size(F.array_except("case_ids", "label_ids")) == 0).alias("within"))


# --- labels and tokens ---

_AT = " OR ".join(f"substr(text, i + 1, {len(p)}) = '{p}'" for p in P.CASES)
_INNER = "|".join(annotate.BATCH_INNER)


@query(f"""WITH t AS (SELECT DISTINCT rec_id, text, coalesce(is_dialogue, false) AS dia FROM train_v15_1m WHERE text IS NOT NULL), n AS (SELECT *, least(length(text), 256) AS n, greatest(0, least(length(text), 256) - 2) AS root FROM t),
  c AS (SELECT rec_id, i, root, ({_AT}) AS hit FROM n, unnest(range(0, n)) AS u(i)),
  a AS (SELECT rec_id, string_agg(CASE WHEN hit THEN 7 WHEN i = root THEN 1 ELSE 2 END, ',' ORDER BY i) AS labels, string_agg(CASE WHEN hit THEN greatest(-32, least(32, root - i)) + 32 ELSE 32 END, ',' ORDER BY i) AS offsets FROM c GROUP BY rec_id, root)
  SELECT n.rec_id, coalesce(labels, '') AS labels, coalesce(offsets, '') AS offsets, CASE WHEN dia THEN 0.1 WHEN regexp_matches(text, '{_INNER}') THEN 0.85 ELSE 0.25 END::DOUBLE AS epistemic FROM n LEFT JOIN a USING (rec_id)""")
def batch_labels(s, d):
    heads = annotate.batch_heads(F.col("text"), F.coalesce("is_dialogue", F.lit(False)))
    text = lambda k: F.array_join(heads[k].cast("array<string>"), ",").alias(k)
    return R._train(s, d, "is_dialogue").groupBy("rec_id", "text", F.coalesce("is_dialogue", F.lit(False)).alias("is_dialogue")).agg(F.lit(0)).select("rec_id", text("labels"), text("offsets"), heads["epistemic"].cast("double").alias("epistemic"))


@query()
def dependency_subtrees(s, d):
    offsets = annotate.batch_heads(F.col("text"), F.lit(False))["offsets"]
    return pas.subtrees(R._train(s, d).select("rec_id", F.transform(offsets, lambda o, i: i + o - 32).alias("heads")), "rec_id", "heads").where("size > 1")


@query("""WITH t AS (SELECT DISTINCT rec_id, text FROM val_v15_1m WHERE text IS NOT NULL), c AS (SELECT rec_id, i, unicode(substr(text, i::INT, 1)) AS c FROM t, unnest(range(1, length(text) + 1)) AS u(i)),
  w AS (SELECT rec_id, list(x ORDER BY i, k) AS l FROM (SELECT rec_id, i, k, z[k] AS x FROM (SELECT rec_id, i, CASE WHEN c > 65535 THEN [55296 + ((c - 65536) >> 10), 56320 + ((c - 65536) & 1023)] ELSE [c] END AS z FROM c), unnest(range(1, len(z) + 1)) AS u(k)) GROUP BY rec_id)
  SELECT rec_id, array_to_string(list_resize(list_transform(coalesce(l, []), lambda x: x % 16384)[1:128], 128, 0), ',') AS tokens FROM t LEFT JOIN w USING (rec_id)""")
def charcode_tokens(s, d):
    rows = table(s, d, "val_v15_1m", "rec_id", "text").where("text is not null").distinct()
    units = F.transform(T.code_units(F.col("text")), lambda x: F.pmod(x, F.lit(16384)).cast("int"))
    return rows.select("rec_id", F.array_join(annotate.padded(units, 128, 0).cast("array<string>"), ",").alias("tokens"))


@query("SELECT vec_id, (k // 16)::INT AS case_idx, ((k % 16) // 4)::INT AS i, (k % 4)::INT AS j, coalesce(embedding[k + 1], 0)::DOUBLE AS value FROM embeddings, unnest(range(0, 64)) AS u(k)")
def tensor_reshape(s, d):
    rows = table(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return pas.reshaped(rows, "vec_id", "v", 4, 4)


@query("""WITH t AS (SELECT DISTINCT rec_id, modality_ids, label_ids, case_ids, action_ids FROM val_v15_1m WHERE label_ids IS NOT NULL)
  SELECT rec_id, i::INT AS pos, modality_ids[i + 1] AS modality, label_ids[i + 1] AS label, case_ids[i + 1] AS case_id, action_ids[i + 1] AS action FROM t, unnest(range(0, len(label_ids))) AS u(i)""")
def multi_task_decode(s, d):
    rows = table(s, d, "val_v15_1m", "rec_id", "modality_ids", "label_ids", "case_ids", "action_ids").where("label_ids is not null").distinct()
    at = lambda c: F.get(c, F.col("pos"))
    return rows.select("*", F.posexplode("label_ids").alias("pos", "label")).select("rec_id", "pos", at("modality_ids").alias("modality"), "label", at("case_ids").alias("case_id"), at("action_ids").alias("action"))


@query("""SELECT event_id, event_type AS kind, (props::JSON->>'$.k')::INT AS k, true AS broken_is_null FROM events""")
def slot_json(s, d):
    slot = F.to_json(F.struct("event_type", F.from_json("props", "k int")["k"].alias("k")))
    back = F.from_json(slot, "event_type string, k int")
    return table(s, d, "events").select("event_id", back["event_type"].alias("kind"), back["k"].alias("k"), F.from_json(F.substring(slot, 1, 9), "k int")["k"].isNull().alias("broken_is_null"))


@query("SELECT event_id, (epoch_us(ts) // 1000)::BIGINT AS ms, strftime(ts, '%Y-%m-%d %H:%M:%S') AS shown FROM events")
def event_times(s, d):
    ts = F.col("ts").cast("timestamp")
    return table(s, d, "events").select("event_id", F.floor(F.unix_micros(ts) / 1000).alias("ms"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("shown"))


@query(r"""SELECT doc_id, (i - 1)::INT AS line_no, a[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL), unnest(range(1, len(a) + 1)) AS u(i) WHERE a[i] <> ''""")
def embedded_lines(s, d):
    return io.embedded_lines(io.packed(R._documents(s, d), "doc_id", "text"), "doc_id", "packed")


# --- omitted subjects and events ---


@query("""WITH rel AS (SELECT DISTINCT ON (id) id AS rel_id, source, case_particles AS args FROM token_corpus_v18_leakfree WHERE text IS NOT NULL AND case_particles IS NOT NULL),
  a AS (SELECT rel_id, source, list_filter(args, lambda a: a.case_katakana = 'ガ' AND coalesce(a.target_noun, '') <> '')[-1].target_noun AS told FROM rel)
  SELECT rel_id, coalesce(told, source, 'unknown_entity') AS entity_id, coalesce(told, source) AS subject, told IS NULL AND source IS NOT NULL AS is_subject_zero FROM a""")
def pas_events_bound(s, d):
    names = table(s, d, "token_corpus_v18_leakfree", "id", "source", "text", "case_particles").where("text is not null and case_particles is not null").dropDuplicates(["id"]).where("source is not null")
    return events.events(R._cases(s, d), names.select(F.col("id").alias("rel_id"), F.col("source").alias("antecedent"))).select("rel_id", "entity_id", "subject", "is_subject_zero")


# --- generators ---


def _chosen(values: list[str], nth: int) -> str:
    words = ", ".join(f"'{v}'" for v in values)
    return f"[{words}][(((((i * 2654435761 + {nth} * 40503 + ((i * 40503 + {nth} * 9176) >> 3)) % 4294967296) >> 12)) % {len(values)}) + 1]"


def _filled(form: str, words: dict[str, str]) -> str:
    for name, word in words.items():
        form = f"replace({form}, '{{{name}}}', {word})"
    return form


_WORDS = {k: _chosen(v, n) for n, (k, v) in enumerate((("c", generate.THEN), ("l", generate.WHERE), ("s", generate.WHO), ("o", generate.WHAT), ("h", generate.HOW)))}
_MODERN = {k: _chosen(v, n) for n, (k, v) in enumerate((("s", generate.MODERN_WHO), ("l", generate.MODERN_WHERE), ("o", generate.MODERN_WHAT), ("d", generate.MODERN_DEED)))}
_FORM_LIST = "[" + ", ".join(f"'{f}'" for f in generate.FORMS) + "]"
_TOLD = ", ".join(f"'{f}'" for f in generate.MODERN_TOLD)


@query(f"SELECT i AS id, f::INT AS form, {_filled(f'{_FORM_LIST}[f + 1]', _WORDS)} AS text FROM range(8000) AS r(i), range(4) AS q(f)")
def constituent_sentences(s, d):
    return generate.constituent_sentences(s)


@query(f"SELECT i AS id, f::INT AS form, {_filled(f'[{_TOLD}, {_chosen(generate.MODERN_SPEECH, 4)}, {_chosen(generate.MODERN_THOUGHT, 5)}][f + 1]', _MODERN)} AS text, f = 2 AS is_dialogue FROM range(800) AS r(i), range(4) AS q(f)")
def modern_sentences(s, d):
    return generate.modern_sentences(s)


# --- streams ---


@query("SELECT doc_id, length(text)::INT AS chars, len(list_filter(regexp_extract_all(text, '[^。！？!]*[。！？!]|[^。！？!]+'), lambda x: " + _trim("x") + " <> ''))::INT AS sentences, regexp_matches(text, '「[^」]*」') AS has_dialogue FROM documents WHERE text IS NOT NULL")
def stream_text_analysis(s, d):
    return stream.drained(stream.analysed(stream.from_parquet(s, f"{d}/documents.parquet"), "doc_id", "text"))


@query("SELECT a.user_id AS key, epoch_us(a.ts) AS asked, epoch_us(b.ts) AS answered FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 1 HOUR")
def stream_correlation(s, d):
    ev = stream.from_parquet(s, f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    asked = ev.where("event_type = 'click'").select(F.col("user_id").alias("key"), F.col("ts").alias("asked"))
    done = ev.where("event_type = 'purchase'").select(F.col("user_id").alias("key"), F.col("ts").alias("answered"))
    return stream.drained(stream.correlated(asked, done)).select("key", F.unix_micros("asked").alias("asked"), F.unix_micros("answered").alias("answered"))


@query("SELECT user_id, max(event_id) AS version, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def stream_latest(s, d):
    seen = stream.drained(stream.latest(stream.from_parquet(s, f"{d}/events.parquet").withColumnRenamed("event_id", "version"), "user_id", "version", "event_type"))
    return seen.groupBy("user_id").agg(F.max("version").alias("version"), F.max_by("event_type", "version").alias("event_type"))


_WAITS = "w AS (SELECT a.user_id AS key, a.ts AS asked, (SELECT min(b.ts) FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'purchase' AND b.ts >= a.ts) AS answered FROM events a WHERE a.event_type = 'click'), k AS (SELECT key, (epoch_us(answered) - epoch_us(asked)) / 1e6 AS took FROM w)"


@query(f"WITH {_WAITS} SELECT key, count(*) AS requests, count(*) FILTER (WHERE took IS NULL OR took > 36000) AS timeouts, round(max(CASE WHEN took <= 36000 THEN took END), 3) AS longest FROM k GROUP BY key")
def watchdog_metrics(s, d):
    ev = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    asked = ev.where("event_type = 'click'").select(F.col("user_id").alias("key"), F.col("ts").alias("asked"))
    done = ev.where("event_type = 'purchase'").select(F.col("user_id").alias("key"), F.col("ts").alias("answered"))
    return stream.watchdog(stream.waits(asked, done), 36_000.0)


@query("SELECT user_id, 'Ready (accepted ' || least(count(*), 16) || ', dropped ' || greatest(0, count(*) - 16) || ')' AS status FROM events GROUP BY user_id")
def queue_status(s, d):
    seen = stream.drained(stream.bounded(stream.from_parquet(s, f"{d}/events.parquet"), "user_id", "event_id", 16))
    totals = seen.groupBy("user_id").agg(F.sum("accepted").alias("accepted"), F.max("dropped").alias("dropped"))
    return totals.select("user_id", F.format_string("Ready (accepted %d, dropped %d)", "accepted", "dropped").alias("status"))


SQL["stream_bounded"] = "SELECT user_id, least(count(*), 16) AS accepted, greatest(0, count(*) - 16) AS dropped FROM events GROUP BY user_id"
SQL["stream_spikes"] = """WITH w AS (SELECT user_id, event_id, value, min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS least FROM events)
  SELECT user_id, event_id AS at, value FROM w WHERE value - least >= 25 AND value >= 60"""


# --- consistency ---

_NEEDS = "n AS (SELECT n_nationkey AS node, CASE WHEN n_nationkey < 12 THEN (n_nationkey * 3 + 1) % 12 WHEN n_nationkey < 20 THEN n_nationkey - 5 ELSE n_nationkey - 1 END AS needed FROM nation WHERE n_nationkey <> 20)"


@query(f"WITH RECURSIVE {_NEEDS}, r AS (SELECT node, needed FROM n UNION SELECT r.node, n.needed FROM r JOIN n ON r.needed = n.node), c AS (SELECT DISTINCT node FROM r WHERE node = needed) SELECT DISTINCT node FROM r WHERE node IN (SELECT node FROM c) OR needed IN (SELECT node FROM c)")
def foreshadow_deadlocks(s, d):
    node = F.col("n_nationkey")
    needed = F.when(node < 12, F.pmod(node * 3 + 1, F.lit(12))).when(node < 20, node - 5).otherwise(node - 1)
    return consistency.deadlocks(table(s, d, "nation").where("n_nationkey <> 20").select(node.alias("node"), needed.alias("needed")))


@query(r"""WITH t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '『([^』\n]{2,12})』', 1)) AS name FROM documents WHERE text IS NOT NULL)
  SELECT doc_id AS id, name FROM t WHERE name NOT IN (SELECT text FROM benchmark_sample WHERE text IS NOT NULL)""")
def undefined_references(s, d):
    texts = R._documents(s, d).select(F.col("doc_id").alias("id"), F.regexp_replace("text", r"『([^』\n]{2,12})』", "[[$1]]").alias("text"))
    known = R._items(s, d).select(F.col("text").alias("name"))
    return consistency.undefined_references(texts, known)


@query("""WITH m AS (SELECT scene_id AS doc, idx, subjectcandidate AS ent, bool_or(coalesce(isdialogue, false)) AS is_speaker FROM pov_sentence_input WHERE subjectcandidate IS NOT NULL AND subjectcandidate <> '' GROUP BY ALL),
  q AS (SELECT DISTINCT scene_id AS doc, idx FROM pov_sentence_input WHERE subjectcandidate IS NULL),
  k AS (SELECT q.doc, q.idx, m.ent, q.idx - m.idx AS distance, m.idx AS seen, is_speaker, row_number() OVER (PARTITION BY q.doc, q.idx, m.ent ORDER BY q.idx - m.idx) AS r FROM q JOIN m ON q.doc = m.doc AND q.idx - m.idx BETWEEN 0 AND 3),
  v AS (SELECT *, distance = 1 AND is_speaker AND idx % 2 = 0 AS held, CASE seen % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.65 ELSE 0.55 END AS role, (seen % 4) * 0.7 * CASE WHEN length(ent) % 2 = 0 THEN 1.2 ELSE 1.0 END AS sal FROM k WHERE r = 1),
  z AS (SELECT *, 0.5 * 0.35 + CASE WHEN held THEN 1.0 ELSE power(0.75, distance) END * 0.3 + CASE WHEN held THEN greatest(role, 1.0) ELSE role END * 0.2 + least(sal, 2.0) * 0.15 + CASE WHEN held THEN 0.25 ELSE 0 END AS score FROM v)
  SELECT doc, idx, ent, distance, round(score + 1e-9, 6)::DOUBLE AS score FROM z""")
def antecedent_scores(s, d):
    asked, named = R._mentions(s, d)
    asked = asked.withColumn("staccato", F.when(F.pmod("idx", F.lit(2)) == 0, 70.0).otherwise(20.0))
    at = F.pmod("idx", F.lit(3))
    named = named.withColumns({"role": F.when(at == 0, "ガ").when(at == 1, "ヲ").otherwise("ニ"), "kind": F.when(F.length("ent") % 2 == 0, "character").otherwise("object"), "salience": F.pmod("idx", F.lit(4)) * 0.7})
    found = anaphora.ranked(anaphora.candidates(asked, named), ["doc", "idx"])
    return found.select("doc", "idx", "ent", "distance", F.round(F.col("score") + 1e-9, 6).alias("score"))


@query("""WITH m AS (SELECT scene_id AS doc, idx, subjectcandidate AS ent, bool_or(coalesce(isdialogue, false)) AS is_speaker FROM pov_sentence_input WHERE subjectcandidate IS NOT NULL AND subjectcandidate <> '' GROUP BY ALL),
  q AS (SELECT DISTINCT scene_id AS doc, idx FROM pov_sentence_input WHERE subjectcandidate IS NULL),
  k AS (SELECT q.doc, q.idx, q.idx - m.idx AS distance, is_speaker, row_number() OVER (PARTITION BY q.doc, q.idx, m.ent ORDER BY q.idx - m.idx) AS r FROM q JOIN m ON q.doc = m.doc AND q.idx - m.idx BETWEEN 0 AND 3),
  z AS (SELECT doc, idx, CASE WHEN distance = 1 AND is_speaker THEN 0.3 + 0.25 ELSE 0.3 * power(0.75, distance) END AS score FROM k WHERE r = 1),
  e AS (SELECT doc, idx, 1 / sum(exp((score - top) * 2)) AS likelihood FROM (SELECT *, max(score) OVER (PARTITION BY doc, idx) AS top FROM z) GROUP BY doc, idx)
  SELECT doc, idx, 1 AS missing, round(coalesce(likelihood, 0.8) + 1e-9, 6)::DOUBLE AS zero, true AS is_incomplete, round(greatest(0.1, 1 - (0.2 + 0.3 * coalesce(likelihood, 0.8))) + 1e-9, 6)::DOUBLE AS score FROM q LEFT JOIN e USING (doc, idx)""")
def incomplete_sentences(s, d):
    found = anaphora.incomplete(*R._mentions(s, d), F.lit(1))
    return found.select("doc", "idx", "missing", F.round(F.col("zero") + 1e-9, 6).alias("zero"), "is_incomplete", F.round(F.col("score") + 1e-9, 6).alias("score"))
