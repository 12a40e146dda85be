"""All registered queries of the library, and the flagship."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.plans import cleaning_queries, feature_queries, io_queries, model_queries, statistics_queries
from cadenza.plans.feature_queries import FEAT, SEG, features
from cadenza.plans.spec import Query, q


def mean_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean alpha balance and peak of each subject over its trials."""
    return features(spark, sf_dir).groupBy("subject").agg(F.avg("sf_balance").alias("sf_balance"), F.avg("paf_cog_hz").alias("paf_cog_hz"), F.count("*").alias("n_trials"))


FLAGSHIP = q(mean_balance, "subject n_trials", "sf_balance paf_cog_hz", f"WITH {SEG}, {FEAT} SELECT subject, count(*) AS n_trials, avg(sf_balance) AS sf_balance, avg(cog) AS paf_cog_hz FROM feat GROUP BY subject", "psd")
QUERIES: dict[str, Query] = {"mean_balance": FLAGSHIP} | cleaning_queries.QUERIES | feature_queries.QUERIES | statistics_queries.QUERIES | io_queries.QUERIES | model_queries.QUERIES
