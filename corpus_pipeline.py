"""A corpus pipeline in five stages; each stage's rows are written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cadenza.llm import decontaminate, mixing, quality, simhash, tokens
from cadenza.llm.common import read, stored
from cadenza.llm.queries import TOKENIZER

#: Words that a worker's encoder remembers: workers and their memory stay with the session, whatever it runs next.
REMEMBERED = 150_000


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, fitted on the labels, doesn't reject."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, on shingles of five words; no pair of an overlap of 0.8 is missed."""
    return simhash.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask for."""
    return mixing.mix(docs)


def token_archives(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the token archives, read back: doc_id, start, n_tokens, ids_crc32."""
    return tokens.token_index(tokens.write_archives(docs, tokens.public_tokenizer(TOKENIZER), remembered=REMEMBERED))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("near_duplicates", one_of_near_duplicates),
    ("decontamination", without_benchmark),
    ("mixing", mixed_sources),
    ("tokens", token_archives),
]

#: Rule ensembles and fingerprints have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
