"""Queries of the additive models over the listed formulas and combinations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.operators import additive as A
from cadenza.operators import windows as W
from cadenza.operators.models import MODELS, results_report
from cadenza.plans import views as V
from cadenza.plans.spec import q
from cadenza.plans.statistics_queries import covariates

BASE = A.Model("base", (), ("laser_power", "trial_index"), ("age",), ("sex",), (), ("experiment_id",))
REGION = A.listed(MODELS["region"], BASE)
CHANNEL = A.listed(MODELS["channel"], BASE)
APERIODIC = A.listed(MODELS["aperiodic"], BASE)
#: (concept, channel model and curve, region model and curve); baselines have no curve.
CONCEPTS = [
    ("baseline", "m00_baseline", None, "m00_baseline", None),
    ("balance", "m12_bi_pre", "bi_pre", "m01_bi_pre", "BI_pre"),
    ("log ratio", "m13_lr_pre", "lr_pre", "m02_lr_pre", "LR_pre"),
    ("centre of gravity", "m14_cog_pre", "cog_pre", "m03_cog_pre", "CoG_pre"),
    ("change of centre", "m15_psi_cog", "psi_cog", "m04_psi_cog", "psi_cog"),
    ("desynchronisation", "m16_delta_erd", "delta_erd", "m07_delta_erd", "delta_ERD"),
]


def features(s: SparkSession, d: str) -> tuple[DataFrame, dict[str, str]]:
    """A row for each line of an order as a trial: the subject is the customer, the unit its flags, the metrics made of the
    line's numbers, two of them missing here and there; and by which name metrics of regions are made."""
    line = V.table(s, d, "lineitem").join(V.table(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), F.col("l_orderkey") == F.col("o_orderkey"))
    slow, fast = F.col("l_discount") * 10 + 1, F.col("l_tax") * 10 + 1
    bi = ((F.col("l_suppkey") * 7 + F.col("l_orderkey")) % 101) / 50.0 - 1
    erd = F.when(F.col("l_orderkey") % 11 != 0, F.col("l_quantity") / 25.0 + (F.col("l_partkey") % 13) / 10.0)
    phase = 2 * F.pi() * F.dayofyear("l_shipdate") / 366.0
    made = {
        "laser_power": F.col("l_quantity") / 10.0, "trial_index": (F.col("l_orderkey") % 50) / 10.0, "pain_rating": F.col("l_extendedprice") / 10000.0,
        "paf_cog_hz": 8 + (F.col("l_partkey") % 40) / 10.0, "pow_slow_alpha": slow, "pow_fast_alpha": fast, "sf_ratio": slow / fast, "sf_logratio": F.log(slow / fast), "sf_balance": (slow - fast) / (slow + fast),
        "slow_alpha_frac": slow / (slow + fast), "bi_pre": bi, "lr_pre": F.log(bi + 1.5), "cog_pre": 8 + (F.col("l_orderkey") % 37) / 9.0, "psi_cog": (F.col("l_partkey") % 23) / 10.0, "delta_erd": erd,
        "n2p2_amp": (F.col("l_partkey") % 31) / 10.0 * fast, "sin_phase": F.sin(phase), "cos_phase": F.cos(phase), "fooof_offset": F.log(F.col("o_totalprice") + 1), "fooof_exponent": F.when(F.col("l_partkey") % 29 != 0, (F.col("l_partkey") % 17) / 10.0),
    }
    same = {"BI_pre": "bi_pre", "LR_pre": "lr_pre", "CoG_pre": "cog_pre", "pow_slow": "pow_slow_alpha", "pow_fast": "pow_fast_alpha", "delta_ERD": "delta_erd"}
    people = V.subjects(s, d).select("subject", (F.col("age") / 50.0).alias("age"), "sex", "cap_size", "experiment_id")
    # Lines meet the people as they are: made columns are wider.
    rows = line.withColumn("subject", F.col("o_custkey")).join(people, "subject")
    return rows.select("subject", F.concat("l_returnflag", "l_linestatus").alias("unit"), *[c.cast("double").alias(n) for n, c in made.items()], "age", "sex", "cap_size", "experiment_id"), same


def wanted(s: SparkSession, d: str, models: list[A.Model], keys: list[str]) -> DataFrame:
    """The rows with the columns that the models use, under their names."""
    rows, same = features(s, d)
    columns = list(dict.fromkeys(c for m in models for c in m.columns()))
    return rows.select("subject", "pain_rating", *keys, *[F.col(same.get(c, c)).alias(c) for c in columns])


def fits(s: SparkSession, d: str, models: list[A.Model], keys: list[str]) -> DataFrame:
    return A.additive_mixed_fits(wanted(s, d, models, keys), keys, models, "subject", "pain_rating")


def concepts(s: SparkSession) -> DataFrame:
    return s.createDataFrame(CONCEPTS, "concept string, channel_model string, channel_term string, source_model string, source_term string")


def both_levels(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Fits of the models of CONCEPTS over all units together, and of each unit."""
    channel = [m for m in CHANNEL if m.name in {c[1] for c in CONCEPTS}]
    region = [m for m in REGION if m.name in {c[3] for c in CONCEPTS}]
    rows, same = features(s, d)
    used = lambda models: dict.fromkeys(c for m in models for c in m.columns())
    kept = list(dict.fromkeys(same.get(c, c) for c in used([*channel, *region])))
    rows = A.arranged(rows.select("subject", "unit", "pain_rating", *kept), ["unit"], kept, "subject", "pain_rating")
    named = rows.select("unit", "_subject", "_y", *[F.col(same.get(c, c)).alias(c) for c in used(region)])
    return A.arranged_fits(rows, [], channel), A.arranged_fits(named, ["unit"], region)


COMBINED = ["bi_pre", "psi_cog", "delta_erd", "n2p2_amp"]
#: Straight models of one metric, which SQL can fit too.
PLAIN = [A.Model(m, (m,), (), (m,)) for m in ("sf_logratio", "bi_pre", "psi_cog", "delta_erd", "fooof_exponent")]
FEATURES = """lines AS (SELECT l_returnflag || l_linestatus AS unit, l_extendedprice / 10000.0::DOUBLE AS y, ln((l_discount * 10 + 1) / (l_tax * 10 + 1)) AS sf_logratio, ((l_suppkey * 7 + l_orderkey) % 101) / 50.0::DOUBLE - 1 AS bi_pre, (l_partkey % 23) / 10.0::DOUBLE AS psi_cog,
 CASE WHEN l_orderkey % 11 <> 0 THEN l_quantity / 25.0::DOUBLE + (l_partkey % 13) / 10.0::DOUBLE END AS delta_erd, CASE WHEN l_partkey % 29 <> 0 THEN (l_partkey % 17) / 10.0::DOUBLE END AS fooof_exponent, o_custkey
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""
PLAIN_SQL = f"""WITH {FEATURES}, x AS (SELECT * FROM lines UNPIVOT (v FOR model IN (sf_logratio, bi_pre, psi_cog, delta_erd, fooof_exponent))),
 f AS (SELECT unit, model, count(*) AS n, count(DISTINCT o_custkey) AS n_subjects, regr_slope(y, v) AS slope, regr_r2(y, v) AS r2, regr_syy(y, v) AS syy FROM x GROUP BY unit, model)
 SELECT unit, model, n, n_subjects, slope, r2 AS dev_expl, 1 - (1 - r2) * (n - 1) / (n - 2) AS r_sq, (6 + n * (ln(2 * pi() * syy * (1 - r2) / n) + 1)) / n AS aic_n, (3 * ln(n) + n * (ln(2 * pi() * syy * (1 - r2) / n) + 1)) / n AS bic_n FROM f"""


def plain(s: SparkSession, d: str) -> DataFrame:
    made = A.additive_mixed_fits(wanted(s, d, PLAIN, ["unit"]), ["unit"], PLAIN, "subject", "pain_rating", intercepts=False)
    return made.select("*", F.col("coef")[1].alias("slope"), (F.col("aic") / F.col("n")).alias("aic_n"), (F.col("bic") / F.col("n")).alias("bic_n"))


def report(s: SparkSession, d: str) -> DataFrame:
    """Fits, their terms, and the concordance of their effects as the flat rows of a report."""
    channel, region = both_levels(s, d)
    concordance = A.effect_concordance(channel, region, concepts(s), ["unit"])
    return results_report(
        {
            "model fits": (region, "concat(unit, ' ', model)", "aic", "p"),
            "terms": (A.term_rows(region, ["unit"]), "concat(unit, ' ', model, ' ', term)", "f", "p"),
            "effects": (concordance, "concat(unit, ' ', concept)", "r", None),
        }
    )


#: The base formula with a surface of both curves, on the trials.
SURFACE = A.Model("surface", (), ("laser_power", "trial_z"), ("age",), ("sex", "cap_size"), (("laser_power", "trial_z"),), ("experiment_id",))


def surface_terms(s: SparkSession, d: str) -> DataFrame:
    """Each term of the surface model of each unit, with the model's own numbers."""
    made = A.additive_mixed_fits(covariates(s, d), ["unit"], [SURFACE], "subject", "pain_rating")
    own = F.inline(F.transform("terms", lambda t: F.struct(t["term"].alias("name"), t["penalty"].alias("penalty"), t["edf"].alias("own_edf"), t["f"].alias("own_f"), t["p"].alias("own_p"))))
    return made.select("unit", "n", "n_subjects", "edf", "r_sq", "aic", "bic", "f", "p", own)


STATS = "edf deviance dev_expl r_sq aic bic f p"
QUERIES = {
    "l9_additive_mixed": q(surface_terms, "unit n n_subjects name", "penalty edf r_sq aic bic f p own_edf own_f own_p"),
    "l9_listed_region": q(lambda s, d: fits(s, d, REGION, ["unit"]), "unit model n_metrics n n_subjects", STATS),
    "l9_listed_channel": q(lambda s, d: fits(s, d, CHANNEL, []), "model n_metrics n n_subjects", STATS),
    "l9_listed_aperiodic": q(lambda s, d: A.term_rows(fits(s, d, APERIODIC, []), []), "model term", "edf f p penalty"),
    "l9_combinations": q(lambda s, d: W.delta_aic(fits(s, d, A.combinations_of(COMBINED, [1, 2], BASE, [("bi_pre", "psi_cog")]), ["unit"]), "unit"), "unit model n_metrics n", "edf dev_expl aic delta_aic"),
    "l9_plain_models": q(plain, "unit model n n_subjects", "slope dev_expl r_sq aic_n bic_n", PLAIN_SQL),
    "l18_partial_effects": q(lambda s, d: A.smooth_effects(both_levels(s, d)[1], ["unit"]), "unit model term", "x effect se low high"),
    "l19_effect_concordance": q(lambda s, d: A.effect_concordance(*both_levels(s, d), concepts(s), ["unit"]), "concept unit same_direction", "r"),
    "l20_quality_by_concept": q(lambda s, d: A.quality_by_concept(*both_levels(s, d), concepts(s), "unit"), "concept channel_model source_model best", "channel_aic source_aic delta_aic delta_dev_expl"),
    "l23_models_report": q(report, "what name statistic significant", "value p"),
}
