"""The registered query of each text operator, over whole tables, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import crosspoly, decontam, jaccard, license, mixing, packing, quality, seedextend, sufdedup, warc
from .common import table


def op1_warc_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_bfd_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_seed_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seedextend.dedup(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sufdedup.dedup(table(spark, sf_dir, "documents"))


def op6_license_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op8_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosspoly.near(table(spark, sf_dir, "embeddings"))


def op10_cgk_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc_convert, op2_bfd_pack, op3_knn_quality, op4_seed_extend, op5_suffix_dedup, op6_license_dice, op7_jaccard_join, op8_pareto_mix, op9_cross_polytope, op10_cgk_decontaminate)}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_convert": warc.ORACLE, "op4_seed_extend": seedextend.ORACLE, "op7_jaccard_join": jaccard.ORACLE, "op8_pareto_mix": mixing.ORACLE, "op9_cross_polytope": crosspoly.ORACLE}
