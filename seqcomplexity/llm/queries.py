"""Registered queries of the training-data operators, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, jaccard, linededup, media, mixing, quality, tokencount, urlfilter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents"), mixing.word_tokens())


def op2_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents")).select("doc_id", "n_tokens")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), words=4, num=85, den=100).drop("set_id")


def op4_temporal_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = urlfilter.dated_captures(table(spark, sf_dir, "pages"))
    return urlfilter.filter_captures(captures, urlfilter.dated_entries(captures))


def op5_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate_perspectives(table(spark, sf_dir, "conversations"))


def op6_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = media.read_audio(media.store_audio(table(spark, sf_dir, "documents")))
    return rows.select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), media.feature().alias("feature"), "duration_samples", "sample_rate", "n_frames",
    )


def op7_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_bpe_segment_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), keep_ids=False).drop("ids")


def op9_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op10_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_temperature_mixing, op2_separator_scan, op3_ngram_jaccard_join, op4_temporal_url_lists, op5_perspective_rotation, op6_mpeg_audio, op7_fuzzy_line_dedup, op8_bpe_segment_tree, op9_weak_label_quality, op10_additive_quantisation)}


def oracle_sql() -> dict[str, str]:
    return {"op1_temperature_mixing": mixing.ORACLE, "op3_ngram_jaccard_join": jaccard.ORACLE, "op4_temporal_url_lists": urlfilter.ORACLE, "op5_perspective_rotation": chat.ORACLE}
