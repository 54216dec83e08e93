"""Registered queries of the corpus operators, and SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import html, jaccard, language, leaks, mixing, multiindex, packing, phrases, privacy, quality, tokens, variants, whitening
from .common import table


def vocabulary() -> str:
    """The public vocabulary file of the token query."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.digest(table(spark, sf_dir, "documents"), vocabulary())


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.digest(table(spark, sf_dir, "pages"))


def op3_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(table(spark, sf_dir, "documents"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiindex.digest(table(spark, sf_dir, "embeddings"))


def op6_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.detect(table(spark, sf_dir, "documents"))


def op7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.remove_repeats(table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.digest(table(spark, sf_dir, "documents"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(table(spark, sf_dir, "documents"), vocabulary())


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.digest(table(spark, sf_dir, "embeddings"))


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.digest(table(spark, sf_dir, "documents"))


QUERIES = {"op1_tokens": op1_tokens, "op2_main_text": op2_main_text, "op3_near_copies": op3_near_copies, "op4_mixing": op4_mixing, "op5_nearest": op5_nearest, "op6_privacy": op6_privacy, "op7_leaks": op7_leaks, "op8_quality": op8_quality, "op9_repeats": op9_repeats, "op10_language": op10_language,
           "op11_packing": op11_packing, "op12_whitening": op12_whitening, "op13_variants": op13_variants}
ORACLE: dict[str, str] = {}
