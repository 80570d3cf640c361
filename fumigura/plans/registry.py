"""Named queries of the engine, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fumigura.functions import text as T
from fumigura.operators import anaphora, annotate, consistency, corpus, evaluate, events, generate, lint, modality, normalizer, pas, pov, tokenizer, vectors
from fumigura.sources.io import digest, distinct_rows, table
from fumigura.streaming import events as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _corpus(s: SparkSession, d: str) -> DataFrame:
    return distinct_rows(table(s, d, "token_corpus_v18_leakfree", "id", "text").where("text is not null"))


def _train(s: SparkSession, d: str, *more: str) -> DataFrame:
    return distinct_rows(table(s, d, "train_v15_1m", "rec_id", "text", *more).where("text is not null"))


def _items(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "benchmark_sample", "id", "text").where("text is not null").distinct()


def _documents(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents", "doc_id", "text").where("text is not null")


def _evaluation(s: SparkSession, d: str) -> DataFrame:
    return _items(s, d).union(table(s, d, "fused_sample", "id", "text").where("text is not null")).distinct()


def _guard(s: SparkSession, d: str) -> DataFrame:
    return _evaluation(s, d).select(T.strip(F.col("text")).alias("phrase")).distinct()


def _errors(s: SparkSession) -> DataFrame:
    return generate.error_benchmark(s).select("text").distinct()


def flagship(s: SparkSession, d: str) -> DataFrame:
    """Sentences of the corpus that leak no benchmark text, first wins, by source."""
    rows = distinct_rows(table(s, d, "token_corpus_v18_leakfree", "id", "text", "source").where("text is not null"), "id")
    leaked = corpus.substring_leaks(rows.select("id", "text"), _guard(s, d), 12, True).select("id").distinct()
    clean = rows.join(leaked, "id", "left_anti").select("id", "source", F.posexplode(T.sentences(F.col("text"))).alias("no", "sentence"))
    kept = corpus.first_wins(clean.where(F.length("sentence").between(6, 120)), T.strip(F.col("sentence")), "id", "no")
    return kept.groupBy("source").agg(F.count("*").alias("sentences"), F.sum(F.length("sentence")).alias("chars"), F.max(F.length("sentence")).alias("longest"))


@query
def corpus_build(s, d):
    return flagship(s, d)


# --- cleaning and segmentation ---


@query
def sentence_segments(s, d):
    return _documents(s, d).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("sent_no", "sentence"))


@query
def sentence_offsets(s, d):
    rows = table(s, d, "sentence_analysis_result", "sar_id", "sentence").where("sentence is not null").distinct()
    return rows.select("sar_id", F.explode(T.sentence_spans(F.col("sentence"))).alias("x")).select("sar_id", F.col("x.start").alias("from_off"), F.col("x.end").alias("to_off"))


@query
def clause_split(s, d):
    return _corpus(s, d).select("id", F.explode(T.clause_spans(F.col("text"))).alias("x")).select("id", F.col("x.start").alias("start_pos"), F.col("x.text").alias("clause"))


@query
def markup_clean(s, d):
    return _documents(s, d).select("doc_id", T.strip_markup(F.col("text")).alias("clean"))


@query
def quick_clean(s, d):
    return _documents(s, d).select("doc_id", T.quick_clean(F.col("text")).alias("clean"))


@query
def header_strip(s, d):
    return _documents(s, d).select("doc_id", T.body(F.col("text")).alias("body"))


@query
def repetition_marks(s, d):
    return _documents(s, d).where(F.col("text").contains("々")).select("doc_id", T.expand_repetition(F.col("text")).alias("expanded"))


@query
def quoted_segments(s, d):
    return corpus.segments(_corpus(s, d), "id", "text")


@query
def length_bands(s, d):
    n = F.length("text")
    bands = {"l4_128": (4, 128), "l6_120": (6, 120), "l8_120": (8, 120), "l5_120": (5, 120), "l6_90": (6, 90), "l10_240": (10, 240)}
    return table(s, d, "token_corpus_v18_leakfree", "id", "source", "text").where("text is not null").distinct().groupBy("source").agg(*[F.count_if(n.between(a, b)).alias(k) for k, (a, b) in bands.items()])


@query
def bracket_balance(s, d):
    rows = table(s, d, "snapped_context_window", "window_id", "text").where("text is not null").distinct()
    return rows.select("window_id", T.bracket_balance(F.col("text")).alias("b")).select("window_id", "b.unclosed", "b.unopened")


@query
def context_windows(s, d):
    rows = table(s, d, "snapped_context_window", "window_id", "text", "caretoffset").where("text is not null").distinct()
    return normalizer.snapped(rows, "window_id", "text", "caretoffset")


@query
def offset_normalize(s, d):
    return normalizer.normalized(_documents(s, d), "doc_id", "text")


@query
def ruby_count(s, d):
    rows = _documents(s, d).select("doc_id", T.strip_markup(F.col("text")).alias("clean"), T.rubies(F.col("text")).alias("r"))
    return rows.select("doc_id", F.size(F.filter("r", lambda r: F.col("clean").contains(r["base"]))).alias("rubies"))


# --- guard, dedup, caps, splits ---


@query
def leak_exact(s, d):
    return corpus.exact_leaks(_corpus(s, d), _evaluation(s, d)).select("id")


@query
def leak_substring(s, d):
    return corpus.substring_leaks(_corpus(s, d), _guard(s, d), 12, True).select("id")


@query
def leak_phrase(s, d):
    return corpus.substring_leaks(_corpus(s, d), corpus.core_phrases(_evaluation(s, d)), 8, False).select("id")


@query
def leak_audit(s, d):
    c, g = _corpus(s, d), _guard(s, d)
    left = c.join(corpus.exact_leaks(c, _evaluation(s, d)).select("id").distinct(), "id", "left_anti")
    return left.join(g, T.strip(F.col("text")) == F.col("phrase"), "left").agg(F.count("*").alias("checked"), F.count("phrase").alias("overlaps"))


@query
def dedup_first(s, d):
    return corpus.first_wins(_corpus(s, d), T.strip(F.col("text")), "id")


@query
def corpus_union(s, d):
    part = lambda t, k: table(s, d, t, k, "text").where("text is not null").select(F.col(k).cast("string").alias("id"), T.strip(F.col("text")).alias("text"))
    rows = corpus.ranked_union([part("benchmark_sample", "id"), part("val_v15_1m", "rec_id"), part("train_v15_1m", "rec_id")])
    return corpus.first_wins(rows, F.col("text"), "src_rank", "id").groupBy("src_rank").agg(F.count("*").alias("kept"), F.sum(F.length("text")).alias("chars"))


@query
def source_cap(s, d):
    rows = table(s, d, "token_corpus_v18_leakfree", "id", "source").where("source is not null").distinct()
    return corpus.capped(rows, "source", 5, "id")


@query
def numbered_ids(s, d):
    rows = table(s, d, "train_v15_1m", "rec_id", "source").where("source is not null").distinct()
    return corpus.numbered(rows, "source", "rec_id", "n").select("rec_id", "source", F.format_string("%s_%07d", "source", "n").alias("new_id"))


@query
def split_90_10(s, d):
    ids = table(s, d, "train_v15_1m", "rec_id").distinct()
    n = ids.count()
    return corpus.numbered(ids.withColumn("all", F.lit(0)), "all", "rec_id", "k").select("rec_id", F.when(F.col("k") < n * 9 // 10, "train").otherwise("val").alias("split"))


@query
def split_by_text(s, d):
    return corpus.split_by_hash(_train(s, d), "text")


@query
def shuffled(s, d):
    return corpus.hash_order(_corpus(s, d), 42, "text", "id")


@query
def oversampled(s, d):
    return generate.oversampled(_items(s, d).select("id"), 50).groupBy("copy").agg(F.count("*").alias("n"))


# --- vocabulary and tokens ---


@query
def char_vocab_topn(s, d):
    return tokenizer.vocabulary(_corpus(s, d), "id", "text", 2040).select("ch", "n", "token_id")


@query
def distinct_chars(s, d):
    return _corpus(s, d).select(F.explode(T.chars(F.col("text"))).alias("ch")).distinct()


@query
def tokenize_encode(s, d):
    c = _corpus(s, d)
    vocab = {r["ch"]: r["token_id"] for r in tokenizer.vocabulary(c, "id", "text", 2040).collect()}  # 2,040 rows
    chars = c.select(F.explode(T.chars(F.col("text"))).alias("ch"))
    return tokenizer.encode(c, "id", "text", tokenizer.char_table(chars, vocab))


@query
def utf16_offsets(s, d):
    rows = table(s, d, "snapped_context_window", "window_id", "text").where("text is not null").distinct()
    return rows.select("window_id", F.length("text").alias("code_points"), F.aggregate(T.chars(F.col("text")), F.lit(0), lambda n, ch: n + T.utf16_width(ch)).alias("utf16_units"))


@query
def padded_labels(s, d):
    rows = table(s, d, "val_v15_1m", "rec_id", "modality_ids").where("modality_ids is not null").distinct()
    return rows.select("rec_id", F.array_join(annotate.padded(F.col("modality_ids"), 128, 0).cast("array<string>"), ",").alias("padded"))


# --- annotation ---


@query
def modality_histogram(s, d):
    return corpus.histogram(table(s, d, "token_corpus_v18_leakfree", "token_modality"), "token_modality")


@query
def modality_labels(s, d):
    t = F.col("text")
    return _corpus(s, d).select("id", corpus.modality_labels(t, t.rlike("(?s)^(?:「.*」|『.*』|（.*）)$")).alias("labels"))


@query
def particle_topk(s, d):
    p = table(s, d, "token_corpus_v18_leakfree", "case_particles").select(F.explode("case_particles").alias("p"))
    return p.groupBy(F.col("p.particle").alias("particle")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "particle").limit(10)


@query
def case_particles(s, d):
    return _corpus(s, d).select("id", F.explode(T.particles(F.col("text"))).alias("x")).select("id", F.col("x.start").alias("start_pos"), F.col("x.text").alias("particle"))


@query
def case_targets(s, d):
    return _corpus(s, d).select("id", annotate.case_particles(F.col("text")).alias("particles"))


@query
def case_labels_find(s, d):
    return annotate.case_positions(_train(s, d), "rec_id", "text")


@query
def epistemic_score(s, d):
    return _train(s, d, "is_dialogue").select("rec_id", F.round(T.epistemic_score(F.col("text"), F.coalesce("is_dialogue", F.lit(False))), 4).alias("score"))


@query
def connective_label(s, d):
    return _train(s, d).select("rec_id", T.connective(F.col("text")).alias("connective"))


@query
def action_spans(s, d):
    return _train(s, d).select("rec_id", F.explode(annotate.action_spans(F.col("text"))).alias("x")).select("rec_id", F.col("x.start").alias("start_pos"), F.col("x.end").alias("end_pos"), F.col("x.action").alias("action"))


@query
def entity_spans(s, d):
    return _train(s, d).select("rec_id", F.explode(annotate.entity_spans(F.col("text"))).alias("x")).select("rec_id", F.col("x.start").alias("start_pos"), F.col("x.text").alias("entity"))


@query
def token_heads(s, d):
    return annotate.head_columns(_train(s, d, "is_dialogue").withColumn("is_dialogue", F.coalesce("is_dialogue", F.lit(False))), "text", "is_dialogue")


# --- generators ---


@query
def validation_cases(s, d):
    return generate.validation_cases(s)


@query
def fallback_cases(s, d):
    return generate.fallback_cases(s, 1000)


@query
def error_benchmark_stats(s, d):
    rows = generate.error_benchmark(s)
    return rows.groupBy("error_type").agg(F.count("*").alias("n"), F.count_if("has_error").alias("errors"))


@query
def template_product(s, d):
    pair = s.createDataFrame([(i, p) for i, p in enumerate(generate.PEOPLE)], "a int, person string").crossJoin(s.createDataFrame([(i, p) for i, p in enumerate(generate.PLACES)], "b int, place string"))
    return pair.orderBy("a", "b").limit(50).select("a", "b", F.concat("person", F.lit("は"), "place").alias("text"))


# --- linter ---


@query
def double_negation(s, d):
    return _corpus(s, d).union(_errors(s).select(F.col("text").alias("id"), "text")).select("id", F.explode(lint.double_negations(F.col("text"))).alias("x")).select("id", F.col("x.start").alias("start_pos"), F.col("x.text").alias("phrase"))


@query
def lint_diagnostics(s, d):
    return lint.lint(_corpus(s, d).select("id", F.col("text").alias("sentence"))).select("id", F.explode("diagnostics").alias("x")).select("id", "x.*")


@query
def lint_errors(s, d):
    rows = lint.lint(_errors(s).select(F.col("text").alias("id"), F.col("text").alias("sentence")))
    return rows.select("id", "score", F.size("diagnostics").alias("diagnostics"))


@query
def syntactic_score(s, d):
    return lint.lint(table(s, d, "sentence_analysis_result", "sar_id", "sentence").select(F.col("sar_id").alias("id"), "sentence").distinct()).select("id", "score")


@query
def lint_documents(s, d):
    return lint.document_diagnostics(_documents(s, d), "doc_id", "text")


@query
def long_dependency(s, d):
    rows = table(s, d, "fused_sample", "id", "text", "telemetry").where("text is not null").dropDuplicates(["id"])
    return rows.select("id", lint.long_dependency(F.col("text"), F.col("telemetry")).alias("x")).where("x is not null").select("id", F.col("x.start").alias("start_pos"), "x.distance", "x.severity")


# --- modality and point of view ---


@query
def refined_modality(s, d):
    rows = table(s, d, "fused_sample", "id", "text", "telemetry").where("text is not null").dropDuplicates(["id"])
    t = F.col("text")
    return modality.refined(rows.select("id", "text", corpus.modality_labels(t, F.lit(False)).alias("labels"), F.col("telemetry.texture.confession").alias("confession"), F.col("telemetry.texture.tension").alias("tension")))


@query
def modulated_modality(s, d):
    rows = table(s, d, "pov_sentence_input", "pov_id", "kasanetelemetry").dropDuplicates(["pov_id"])
    m = modality.modulated(F.lit(0.6), F.lit(0.4), F.col("kasanetelemetry.texture.confession"))
    return rows.select("pov_id", F.round(m["narrative"], 6).alias("narrative"), F.round(m["monologue"], 6).alias("monologue"))


def _scenes(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "pov_sentence_input", "pov_id", "scene_id", "idx", "text", "isdialogue", "subjectcandidate", "kasanetelemetry").where("text is not null").dropDuplicates(["pov_id"])
    return rows.select(F.col("scene_id").alias("doc"), (F.col("idx") * 1_000_000 + F.col("pov_id")).cast("long").alias("idx"), "text", F.col("isdialogue").alias("is_dialogue"), F.col("subjectcandidate").alias("subject"), F.col("kasanetelemetry").alias("telemetry"))


@query
def pov_spike(s, d):
    return pov.features(_scenes(s, d)).where("spike").select("doc", "idx", F.round("speculation", 4).alias("speculation"), F.round("least_before", 4).alias("least_before"))


@query
def tension_modulation(s, d):
    return pov.features(_scenes(s, d)).select("doc", "idx", F.round("tension", 6).alias("tension"), F.round("tension_before", 6).alias("tension_before"), "modulated")


@query
def pov_violations(s, d):
    return pov.verdicts(_scenes(s, d))


@query
def pov_first_person(s, d):
    return pov.verdicts(_scenes(s, d), mode="first_person", strict=True)


@query
def pov_report(s, d):
    rows = _scenes(s, d)
    return pov.report(rows, pov.verdicts(rows, mode="third_person_objective"))


# --- omitted subjects and events ---


def _mentions(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(s, d, "pov_sentence_input", "scene_id", "idx", "subjectcandidate", "isdialogue")
    named = rows.where("subjectcandidate is not null and subjectcandidate <> ''").groupBy(F.col("scene_id").alias("doc"), "idx", F.col("subjectcandidate").alias("ent")).agg(F.max(F.coalesce("isdialogue", F.lit(False))).alias("is_speaker"))
    named = named.withColumns({"pos": F.lit(0), "role": F.lit("ガ"), "kind": F.lit("character"), "salience": F.lit(1.0)})
    asked = rows.where("subjectcandidate is null").select(F.col("scene_id").alias("doc"), "idx").distinct().withColumns({"omitted": F.lit("ガ"), "staccato": F.lit(70.0)})
    return asked, named


@query
def antecedent_rank(s, d):
    found = anaphora.ranked(anaphora.candidates(*_mentions(s, d)), ["doc", "idx"])
    return found.select("doc", "idx", "ent", "distance", F.round("score", 6).alias("score"), F.round("likelihood", 6).alias("likelihood"), "rank")


@query
def antecedent_best(s, d):
    return anaphora.resolved(*_mentions(s, d)).select("doc", "idx", "antecedent")


def _cases(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "token_corpus_v18_leakfree", "id", "text", "case_particles").where("text is not null and case_particles is not null").dropDuplicates(["id"])
    args = F.transform("case_particles", lambda p: F.struct(p["case_katakana"].alias("case_name"), p["target_noun"].alias("text"), F.lit(False).alias("is_zero")))
    return rows.select(F.col("id").alias("rel_id"), F.regexp_extract("text", "([一-龠ぁ-ん]+)[。」』）]*$", 1).alias("predicate"), args.alias("args"))


@query
def mandatory_slots(s, d):
    rows = _cases(s, d).select("rel_id", F.size(anaphora.missing_slots(F.transform("args", lambda a: a["case_name"]), ["ガ", "ヲ"])).alias("missing"))
    return rows.select("rel_id", "missing", F.round(anaphora.incomplete_score(F.lit(1.0), F.col("missing"), F.lit(0.8)), 6).alias("score"))


@query
def action_normalize(s, d):
    words = _cases(s, d).select("predicate").distinct()
    return words.select("predicate", events.action(F.col("predicate")).alias("action"))


@query
def pas_events(s, d):
    return events.events(_cases(s, d))


@query
def pas_relations(s, d):
    return pas.scored(_corpus(s, d))


@query
def semantic_jump_bias(s, d):
    rows = table(s, d, "fused_sample", "id", "telemetry").where("telemetry is not null").dropDuplicates(["id"]).select("id", F.explode("telemetry.semanticjumps").alias("j"))
    kinds = F.when(F.col("j.casemarker") == 1, F.array(F.lit(0), F.lit(1))).when(F.col("j.casemarker") == 2, F.array(F.lit(1), F.lit(2))).when(F.col("j.casemarker") == 3, F.array(F.lit(2), F.lit(3)))
    delta = F.when(F.col("j.jumpdegree") < 40, 0.8).when(F.col("j.jumpdegree") >= 80, -0.6 * F.col("j.jumpdegree") / 100).otherwise(0.0)
    cells = rows.select("id", F.explode(kinds).alias("case_idx"), F.col("j.verbtokenidx").alias("pred"), F.col("j.nountokenidx").alias("arg"), delta.alias("delta"))
    return cells.groupBy("id", "case_idx", "pred", "arg").agg(F.round(F.sum("delta"), 6).alias("bias"))


def _evaluated(df: DataFrame) -> DataFrame:
    return stream.evaluated(df).groupBy("event_type", "operation", "accepted").agg(F.count("*").alias("n"))


@query
def event_accept(s, d):
    return _evaluated(table(s, d, "events"))


@query
def stream_event_accept(s, d):
    done = stream.drained(stream.evaluated(stream.from_parquet(s, f"{d}/events.parquet")))
    return done.groupBy("event_type", "operation", "accepted").agg(F.count("*").alias("n"))


@query
def stream_spikes(s, d):
    return stream.drained(stream.spikes(stream.from_parquet(s, f"{d}/events.parquet"), "user_id", "event_id", "value"))


@query
def stream_bounded(s, d):
    return stream.drained(stream.bounded(stream.from_parquet(s, f"{d}/events.parquet"), "user_id", "event_id", 16))


# --- numbers ---


@query
def int8_quantize(s, d):
    return table(s, d, "embeddings").select("vec_id", F.array_join(vectors.quantized(F.col("embedding"), 0.01).cast("array<string>"), ",").alias("q"))


@query
def dot_product(s, d):
    return table(s, d, "embeddings").select("vec_id", F.round(vectors.dot(F.col("embedding"), F.col("embedding")), 6).alias("dot"))


@query
def correlation_matrix(s, d):
    return vectors.correlations(table(s, d, "embeddings"), "embedding", 7).select("i", "j", F.round("corr", 6).alias("corr"))


@query
def spectrum(s, d):
    return vectors.spectrum(table(s, d, "embeddings"), "embedding", 7)


@query
def recurrent_core(s, d):
    rows = table(s, d, "train_v15_1m", "rec_id", "label_ids").where("label_ids is not null").distinct()
    return vectors.recurrent_core(rows.select(F.col("rec_id").alias("id"), "label_ids"), "label_ids")


@query
def embedding_argmax(s, d):
    e = F.col("embedding").cast("array<double>")
    return table(s, d, "embeddings").select("vec_id", evaluate.argmax(e).alias("best"), F.round(F.array_max(evaluate.softmax(e)), 6).alias("share"))


@query
def confusion_f1(s, d):
    rows = table(s, d, "train_v15_1m", "rec_id", "text", "is_dialogue").distinct()
    return evaluate.confusion(rows, F.col("is_dialogue"), F.col("text").startswith("「"))


@query
def category_accuracy(s, d):
    rows = table(s, d, "benchmark_sample", "id", "gold_category", "expected_modality").dropDuplicates(["id"]).where("gold_category is not null")
    return evaluate.by_category(rows, "gold_category", F.coalesce(F.lower("gold_category").startswith(F.lower("expected_modality")), F.lit(False)))


@query
def percentile_nearest(s, d):
    return evaluate.nearest_rank(table(s, d, "events"), "value", [0.5, 0.95, 0.99]).select("p", F.round("value", 6).alias("value"))


@query
def percentile_linear(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.round(F.percentile("value", F.lit(0.5)), 6).alias("p50"), F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95"), F.round(F.avg("value"), 6).alias("mean"))


@query
def latency_summary(s, d):
    return table(s, d, "events").groupBy("user_id").agg(F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("n"))


@query
def running_mean(s, d):
    return evaluate.running_mean(table(s, d, "events"), "user_id", "event_id", "value").select("user_id", "event_id", (F.floor(F.col("running_mean") * 1000 + 0.5 + 1e-6) / 1000).alias("running_mean"))


@query
def masked_accuracy(s, d):
    rows = table(s, d, "train_v15_1m", "rec_id", "case_ids", "label_ids").where("case_ids is not null and label_ids is not null").distinct()
    return rows.select("rec_id", F.round(evaluate.masked_accuracy(F.col("case_ids"), F.col("label_ids")), 6).alias("accuracy"))


@query
def threshold_rates(s, d):
    x = F.col("telemetry.texture")
    rows = table(s, d, "fused_sample", "id", "category", "telemetry").dropDuplicates(["id"]).where("telemetry is not null")
    rate = lambda c: F.round(F.avg(c.cast("double")), 6)
    return rows.groupBy("category").agg(rate(x["confession"] >= 65).alias("fid"), rate((x["showing"] <= 20) & (x["speculation"] >= 60)).alias("leak"), rate(x["cadence"] >= 30).alias("cadence"))


@query
def json_props(s, d):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(s, d, "events").groupBy("event_type").agg(F.sum(k).alias("total"), F.count(k).alias("n"))


@query
def row_digest(s, d):
    return _items(s, d).select("id", F.sha2("text", 256).alias("sha"))


@query
def table_digest(s, d):
    return digest(_items(s, d))


# --- consistency of facts ---


@query
def anomaly_bits(s, d):
    raw = (F.col("l_orderkey") * 7919 + F.col("l_partkey") * 104729).cast("long")
    return table(s, d, "lineitem", "l_orderkey", "l_partkey").select(consistency.anomaly(raw).alias("a")).groupBy("a.is_anomaly", "a.severity").agg(F.count("*").alias("n"))


@query
def state_history(s, d):
    return consistency.history(table(s, d, "events", "user_id", "event_id", "event_type"), "user_id", "event_id", "event_type")


@query
def lifetime_violations(s, d):
    ev = table(s, d, "lineitem", "l_orderkey", "l_linenumber", "l_shipdate").select(F.col("l_orderkey").alias("entity"), F.col("l_linenumber").alias("line"), F.datediff("l_shipdate", F.lit("1992-01-01")).alias("at"))
    born = F.datediff("o_orderdate", F.lit("1992-01-01"))
    return consistency.lifetime_violations(ev, table(s, d, "orders", "o_orderkey", "o_orderdate").select(F.col("o_orderkey").alias("entity"), born.alias("born"), (born + 60).alias("died"))).select("entity", "line", "violation")


@query
def simultaneous_presence(s, d):
    t = F.unix_timestamp("ts")
    return consistency.simultaneous_presence(table(s, d, "events", "user_id", "event_type", "ts").select(F.col("user_id").alias("entity"), F.col("event_type").alias("place"), t.alias("start"), (t + 5400).alias("end")).distinct())


@query
def speed_violations(s, d):
    return consistency.speed_violations(table(s, d, "events", "user_id", "event_id", "value").select(F.col("user_id").alias("entity"), F.col("event_id").alias("at"), F.col("value").alias("x")), 2.0).select("entity", F.col("at").alias("event_at"), F.round("speed", 6).alias("speed"))


@query
def causal_cycles(s, d):
    return consistency.cycles(table(s, d, "nation", "n_nationkey").select(F.col("n_nationkey").alias("src"), F.pmod(F.col("n_nationkey") * 7 + 3, F.lit(25)).alias("dst")))


def queries() -> dict[str, Query]:
    return dict(QUERIES)

