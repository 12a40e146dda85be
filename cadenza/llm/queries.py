"""The registered queries of this subpackage: each applies its operator, with its defaults, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, context_tree, decontaminate, media, mixing, periodicity, quality, secrets, simhash, substring_dedup, templates, tokens, window_dedup
from .common import read, stored

TOKENIZER = "word_bpe_49k.json"
#: The two of op13.
ALIGNED = ("byte_bpe_50k.json", "piece_bpe_32k.model")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_png_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(stored(media.encode(read(spark, sf_dir, "documents")), "media"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(read(spark, sf_dir, "documents"))


def op4_prefix_free_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_report(read(spark, sf_dir, "documents"))


def op5_randomness_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(read(spark, sf_dir, "documents"))


def op6_count_min_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_dedup.window_report(read(spark, sf_dir, "documents"))


def op7_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.score(read(spark, sf_dir, "documents"))


def op8_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op9_token_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_index(tokens.write_archives(read(spark, sf_dir, "documents"), tokens.public_tokenizer(TOKENIZER)))


def op10_benchmark_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op11_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.main_texts(read(spark, sf_dir, "pages"))


def op12_block_convolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodicity.run_report(periodicity.planted(read(spark, sf_dir, "documents")))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_report(read(spark, sf_dir, "documents"), *map(tokens.public_tokenizer, ALIGNED))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_png_media,
        op3_source_mix,
        op4_prefix_free_parse,
        op5_randomness_battery,
        op6_count_min_windows,
        op7_context_tree,
        op8_simhash_components,
        op9_token_archives,
        op10_benchmark_tiles,
        op11_site_templates,
        op12_block_convolution,
        op13_token_alignment,
    )
}
ORACLES: dict[str, str] = {"op3_source_mix": mixing.ORACLE, "op6_count_min_windows": window_dedup.ORACLE}
