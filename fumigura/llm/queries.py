"""Queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fumigura.llm import bpe, chunk, leak, mixing, mojibake, neardup, overlap, sentences, stratify, unify
from fumigura.llm.common import table


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "token_corpus_v18_leakfree", "id", "text")


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark_sample", "id", "text").union(table(spark, d, "fused_sample", "id", "text"))


def _splits(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return tuple(table(spark, d, t, "rec_id", "source", "text") for t in ("train_v15_1m", "val_v15_1m"))


def _windows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "snapped_context_window", "window_id", "profile", "text"), table(spark, d, "window_limit")


def _p4(spark: SparkSession, d: str) -> DataFrame:
    samples = unify.alike_records(table(spark, d, "fused_sample", "id", "text"))
    offsets = unify.alike_columns(table(spark, d, "token_offset", "offset_id", "originalchar", "tokenchar"), "originalchar", "tokenchar")
    return samples.select(F.lit("sample").alias("kind"), "key_a", "key_b").union(offsets.select(F.lit("offset"), F.col("offset_id").cast("string"), F.lit("")).distinct())


def _p4_forms(spark: SparkSession, d: str) -> DataFrame:
    samples = unify.unify(table(spark, d, "fused_sample", "id", "text").where("text is not null").distinct(), "text", "form")
    offsets = unify.unify(unify.unify(table(spark, d, "token_offset", "offset_id", "originalchar", "tokenchar"), "originalchar", "original_form"), "tokenchar", "token_form")
    rows = samples.select(F.lit("sample").alias("kind"), F.col("id").alias("key"), F.col("form").alias("form_a"), F.lit(None).cast("string").alias("form_b"))
    return rows.union(offsets.select(F.lit("offset"), F.col("offset_id").cast("string"), "original_form", "token_form"))


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    pov = sentences.sentence_units(table(spark, d, "pov_sentence_input").select(F.col("pov_id").alias("row_id"), "text", "lang"))
    sar = sentences.sentence_units(table(spark, d, "sentence_analysis_result").select(F.col("sar_id").alias("row_id"), F.col("sentence").alias("text"), F.lit(None).cast("string").alias("lang")))
    return pov.select(F.lit("pov").alias("src"), "*").union(sar.select(F.lit("sar"), "*"))


def _bench(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "benchmark_sample"), table(spark, d, "sample_target")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "source", "text")


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return _documents(spark, d), table(spark, d, "mix_target")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": lambda s, d: leak.leaked_runs(_corpus(s, d), _items(s, d)),
        "p1_passages": lambda s, d: leak.leaked_passages(_corpus(s, d), _items(s, d)),
        "p2_found": lambda s, d: chunk.oversized_windows(*_windows(s, d)),
        "p2_pieces": lambda s, d: chunk.cut_windows(*_windows(s, d)),
        "p3_found": lambda s, d: overlap.overlaps(*_splits(s, d)).select("rec_id_a", "rec_id_b").distinct(),
        "p3_report": lambda s, d: overlap.overlap_report(*_splits(s, d)),
        "p4_found": _p4,
        "p4_classes": lambda s, d: unify.alike_classes(table(s, d, "fused_sample", "id", "text")),
        "p4_forms": _p4_forms,
        "p5_found": lambda s, d: _sentences(s, d).select("src", "row_id", "end_pos").distinct(),
        "p5_units": _sentences,
        "p6_found": lambda s, d: neardup.near_duplicate_pairs(_corpus(s, d)),
        "p6_groups": lambda s, d: neardup.near_duplicate_groups(_corpus(s, d)),
        "p7_found": lambda s, d: stratify.sample_report(*_bench(s, d)).where("short").select(*stratify.LABELS),
        "p7_report": lambda s, d: stratify.sample_report(*_bench(s, d)),
        "p7_sample": lambda s, d: stratify.stratified_sample(*_bench(s, d)),
        "p8_ids": lambda s, d: bpe.encode_corpus(_documents(s, d)),
        "p8_roundtrip": lambda s, d: bpe.decode_corpus(bpe.encode_corpus(_documents(s, d))),
        "p9_mix": lambda s, d: mixing.mixed_documents(*_mix(s, d)),
        "p9_shares": lambda s, d: mixing.mix_report(*_mix(s, d)),
        "p10_found": lambda s, d: mojibake.garbled(_documents(s, d)).select("doc_id"),
        "p10_restored": lambda s, d: mojibake.garbled(_documents(s, d)),
    }


def oracle_sql() -> dict[str, str]:
    """SQL of the two problems that it can express; the others need NFKC, edit distances or rule tables."""
    wide = "".join(chr(0xFEE0 + i) for i in range(0x21, 0x7F)).replace("'", "''")
    narrow = "".join(chr(i) for i in range(0x21, 0x7F)).replace("'", "''")
    label = lambda c: f"trim(lower(translate({c}, '{wide}　 ', '{narrow}  ')))"
    same = " AND ".join(f"{label('b.' + c)} = {label('t.' + c)}" for c in stratify.LABELS)
    named = ", ".join(f"t.{c}" for c in stratify.LABELS)
    return {
        "p2_found": "SELECT DISTINCT window_id FROM snapped_context_window JOIN window_limit USING (profile) WHERE length(text) > max_chars",
        "p7_found": f"SELECT {named} FROM sample_target t LEFT JOIN benchmark_sample b ON {same} GROUP BY {named}, t.sample_size, t.target_share, t.min_rows HAVING count(DISTINCT b.id) < round(t.sample_size * t.target_share, 9) OR count(DISTINCT b.id) < t.min_rows",
    }
