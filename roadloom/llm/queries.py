"""The corpus queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fingerprints, html_wrappers, line_rules, lm_score, mixing, near_dedup, packing, quality_gbt, secret_scan, toxicity
from .shared import read_table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gbt.op1_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.op2_fingerprints(read_table(spark, sf_dir, "documents"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.op3_lm_score(read_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op4_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op5_mix_sources(read_table(spark, sf_dir, "documents"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrappers.op6_main_text(read_table(spark, sf_dir, "pages"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.op7_secret_scan(read_table(spark, sf_dir, "documents"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.op8_near_dedup(read_table(spark, sf_dir, "documents"))


def op9_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.op9_line_rules(read_table(spark, sf_dir, "documents"))


def op10_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op10_pack_sequences(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_fingerprints": op2_fingerprints,
        "op3_lm_score": op3_lm_score,
        "op4_toxicity": op4_toxicity,
        "op5_mix_sources": op5_mix_sources,
        "op6_main_text": op6_main_text,
        "op7_secret_scan": op7_secret_scan,
        "op8_near_dedup": op8_near_dedup,
        "op9_line_rules": op9_line_rules,
        "op10_pack_sequences": op10_pack_sequences,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_mix_sources": mixing.ORACLE, "op7_secret_scan": secret_scan.oracle(), "op9_line_rules": line_rules.ORACLE}
