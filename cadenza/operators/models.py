"""Statistical jobs. A model's rows are reduced to sums of products, so folds, subjects, regions and models
are keys of one aggregation, and each system of equations is solved in a task of its own."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.distributions import f_upper, t_quantile, t_two_sided
from cadenza.operators.filters import guarded_corr
from cadenza.operators.joins import dimension, unit_pairs
from cadenza.operators.summaries import eval_metrics
from cadenza.operators.windows import bucket_of, fdr_bh, same_keys, value_cuts
from cadenza.sources.scratch import scratch_path


def paired_ttest(df: DataFrame, keys: list[str], x: str, y: str, least: int = 3) -> DataFrame:
    """(keys, n, mean_diff, t, df, p, d_z, se): paired t-test of x - y; se is the 95 % interval's width over 3.92."""
    d = F.col(x) - F.col(y)
    rows = (df.groupBy(*keys) if keys else df).agg(F.count(d).alias("n"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("_s")).where(F.col("n") >= least)
    error = F.nullif(F.col("_s"), F.lit(0.0)) / F.sqrt("n")
    rows = rows.withColumns({"t": F.col("mean_diff") / error, "df": (F.col("n") - 1).cast("double"), "d_z": F.col("mean_diff") / F.nullif("_s", F.lit(0.0)), "_e": error})
    return rows.withColumns({"p": t_two_sided("t", "df"), "se": F.col("_e") * t_quantile(F.lit(0.975), F.col("df")) / 1.96}).drop("_s", "_e")


def ttest_statistics(df: DataFrame, keys: list[str], x: str, y: str, least: int = 3) -> DataFrame:
    """The part of ``paired_ttest`` that needs no distribution: (keys, n, mean_diff, t, d_z)."""
    d = F.col(x) - F.col(y)
    rows = df.groupBy(*keys).agg(F.count(d).alias("n"), F.avg(d).alias("mean_diff"), F.nullif(F.stddev_samp(d), F.lit(0.0)).alias("_s")).where(F.col("n") >= least)
    return rows.select(*keys, "n", "mean_diff", (F.col("mean_diff") / (F.col("_s") / F.sqrt("n"))).alias("t"), (F.col("mean_diff") / F.col("_s")).alias("d_z"))


def pairwise_paired_fdr(df: DataFrame, subject: str, unit: str, value: str) -> DataFrame:
    """Paired tests of all pairs of units, with p_adj over them."""
    tests = paired_ttest(unit_pairs(df, subject, unit, value), ["unit_a", "unit_b"], "a", "b")
    return fdr_bh(tests.withColumn("_f", F.lit(1)), ["_f"], "p", "unit_a").drop("_f")


def rm_anova_sums(df: DataFrame, subject: str, within: str, value: str) -> DataFrame:
    """One row: n subjects, k levels, F and its degrees of freedom over subjects that have every level."""
    cells = df.where(F.col(value).isNotNull()).groupBy(subject, within).agg(F.avg(value).alias("v"))
    levels = cells.agg(F.count_distinct(within).alias("k"))
    full = cells.groupBy(subject).agg(F.count("*").alias("_n")).join(F.broadcast(levels), F.col("_n") == F.col("k")).select(subject)
    rows = cells.join(full, subject, "left_semi")
    by_subject, by_level = (rows.groupBy(c).agg(F.avg("v").alias("m")) for c in (subject, within))
    total = rows.agg(F.count("*").alias("cells"), F.avg("v").alias("grand"), F.sum(F.col("v") * F.col("v")).alias("sq"))
    a = by_subject.agg(F.count("*").alias("n"), F.sum(F.col("m") * F.col("m")).alias("ssq"))
    b = by_level.agg(F.count("*").alias("k"), F.sum(F.col("m") * F.col("m")).alias("lsq"))
    one = total.join(F.broadcast(a)).join(F.broadcast(b))
    n, k, g = F.col("n"), F.col("k"), F.col("grand")
    within_ss = F.col("lsq") * n - n * k * g * g
    subject_ss = F.col("ssq") * k - n * k * g * g
    error_ss = F.col("sq") - n * k * g * g - within_ss - subject_ss
    df1, df2 = (k - 1).cast("double"), ((k - 1) * (n - 1)).cast("double")
    return one.select("n", "k", ((within_ss / df1) / F.nullif(error_ss / df2, F.lit(0.0))).alias("f"), df1.alias("df1"), df2.alias("df2"))


def greenhouse_geisser(df: DataFrame, subject: str, within: str, value: str) -> DataFrame:
    """(epsilon) from the levels' covariance matrix, a row for each pair of levels."""
    pairs = df.select(subject, F.col(within).alias("a"), F.col(value).alias("x")).join(df.select(subject, F.col(within).alias("b"), F.col(value).alias("y")), subject)
    cov = pairs.groupBy("a", "b").agg(F.covar_samp("x", "y").alias("c"))
    rows = cov.groupBy("a").agg(F.avg("c").alias("r"))
    whole = cov.agg(F.count("*").alias("kk"), F.avg("c").alias("g"), F.sum(F.when(F.col("a") == F.col("b"), F.col("c"))).alias("tr"), F.sum(F.col("c") * F.col("c")).alias("cc"))
    k = F.sqrt("kk")
    both = whole.join(F.broadcast(rows.agg(F.sum(F.col("r") * F.col("r")).alias("rr"))))
    above = k * k * (F.col("tr") / k - F.col("g")) * (F.col("tr") / k - F.col("g"))
    below = (k - 1) * (F.col("cc") - 2 * k * F.col("rr") + k * k * F.col("g") * F.col("g"))
    return both.select(F.least(F.lit(1.0), F.greatest(1 / (k - 1), above / F.nullif(below, F.lit(0.0)))).alias("epsilon"))


def rm_anova(df: DataFrame, subject: str, within: str, value: str) -> DataFrame:
    """F test with and without the Greenhouse-Geisser correction."""
    one = rm_anova_sums(df, subject, within, value).join(F.broadcast(greenhouse_geisser(df, subject, within, value)))
    return one.withColumns({"p": f_upper("f", "df1", "df2"), "p_gg": f_upper(F.col("f"), F.col("df1") * F.col("epsilon"), F.col("df2") * F.col("epsilon"))})


def linear_screen(long: DataFrame, outcome: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, n, slope, r2) of every (unit, metric) at once, on values z-scored within it; constants have null fits."""
    keys = keys or ["unit", "metric_name"]
    rows = long.where(F.col("metric_value").isNotNull() & F.col(outcome).isNotNull())
    r = guarded_corr("metric_value", outcome)
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), r.alias("slope"), (r * r).alias("r2"))


def safe_k(df: DataFrame, keys: list[str], column: str, most: int = 10) -> DataFrame:
    return df.groupBy(*keys).agg(F.greatest(F.lit(3), F.least(F.lit(most), F.count_distinct(column) - 1)).alias("k"))


def model_matrix_guards(df: DataFrame, keys: list[str], factors: list[str]) -> DataFrame:
    """(keys, use_<factor>): factors with more than one level."""
    return df.groupBy(*keys).agg(*[(F.count_distinct(f) > 1).alias(f"use_{f}") for f in factors])


# Names, metrics and covariates of the listed models: channels, channels with aperiodic terms, regions.
# (name, metrics, aperiodic covariates, cap as a factor, metrics as a tensor product)
MODELS = {
    "channel": [
        ("m00_baseline", [], False, False, False),
        ("m01_baseline_cap", [], False, True, False),
        ("m02_paf_cog", ["paf_cog_hz"], False, False, False),
        ("m03_pow_slow", ["pow_slow_alpha"], False, False, False),
        ("m04_pow_fast", ["pow_fast_alpha"], False, False, False),
        ("m05_sf_ratio", ["sf_ratio"], False, False, False),
        ("m06_sf_logratio", ["sf_logratio"], False, False, False),
        ("m07_sf_balance", ["sf_balance"], False, False, False),
        ("m08_slow_frac", ["slow_alpha_frac"], False, False, False),
        ("m09_sf_logratio_cap", ["sf_logratio"], False, True, False),
        ("m10_sf_balance_cap", ["sf_balance"], False, True, False),
        ("m11_slow_frac_cap", ["slow_alpha_frac"], False, True, False),
        ("m12_bi_pre", ["bi_pre"], False, False, False),
        ("m13_lr_pre", ["lr_pre"], False, False, False),
        ("m14_cog_pre", ["cog_pre"], False, False, False),
        ("m15_psi_cog", ["psi_cog"], False, False, False),
        ("m16_delta_erd", ["delta_erd"], False, False, False),
        ("m17_bi_pre_cap", ["bi_pre"], False, True, False),
        ("m18_psi_cog_cap", ["psi_cog"], False, True, False),
    ],
    "aperiodic": [
        ("m00_baseline", [], False, False, False),
        ("m01_baseline_aperiodic", [], True, False, False),
        ("m02_sf_logratio", ["sf_logratio"], False, False, False),
        ("m03_sf_balance", ["sf_balance"], False, False, False),
        ("m04_slow_frac", ["slow_alpha_frac"], False, False, False),
        ("m05_sf_logratio_aperiodic", ["sf_logratio"], True, False, False),
        ("m06_sf_balance_aperiodic", ["sf_balance"], True, False, False),
        ("m07_slow_frac_aperiodic", ["slow_alpha_frac"], True, False, False),
        ("m08_bi_pre", ["bi_pre"], False, False, False),
        ("m09_cog_pre", ["cog_pre"], False, False, False),
        ("m10_psi_cog", ["psi_cog"], False, False, False),
        ("m11_delta_erd", ["delta_erd"], False, False, False),
        ("m12_bi_pre_aperiodic", ["bi_pre"], True, False, False),
        ("m13_psi_cog_aperiodic", ["psi_cog"], True, False, False),
        ("m14_delta_erd_aperiodic", ["delta_erd"], True, False, False),
    ],
    "region": [
        ("m00_baseline", [], False, False, False),
        ("m01_bi_pre", ["BI_pre"], False, False, False),
        ("m02_lr_pre", ["LR_pre"], False, False, False),
        ("m03_cog_pre", ["CoG_pre"], False, False, False),
        ("m04_psi_cog", ["psi_cog"], False, False, False),
        ("m05_tensor_slow_fast", ["pow_slow", "pow_fast"], False, False, True),
        ("m06_phase", ["sin_phase", "cos_phase"], False, False, False),
        ("m07_delta_erd", ["delta_ERD"], False, False, False),
        ("m08_n2p2_amp", ["n2p2_amp"], False, False, False),
        ("m09_bi_delta_erd", ["BI_pre", "delta_ERD"], False, False, False),
        ("m10_bi_n2p2", ["BI_pre", "n2p2_amp"], False, False, False),
        ("m11_full_combined", ["BI_pre", "delta_ERD", "n2p2_amp"], False, False, False),
        ("m12_fooof_baseline", [], True, False, False),
        ("m13_fooof_bi_pre", ["BI_pre"], True, False, False),
        ("m14_fooof_lr_pre", ["LR_pre"], True, False, False),
    ],
}


def model_registry(spark, models: list[tuple[str, list[str], bool, bool, bool]]) -> DataFrame:
    """(name, terms, aperiodic, cap, tensor), to be joined with units."""
    return spark.createDataFrame(models, "name string, terms array<string>, aperiodic boolean, cap boolean, tensor boolean")


def products(df: DataFrame, keys: list[str], terms: list[str], outcome: str) -> DataFrame:
    """(keys, n, yy, xy array, xx array of rows): sums of products of the terms and an intercept.

    A row of sums for each key, made by partial sums on each node; downdates and replicates use nothing else."""
    names = [F.lit(1.0), *[F.col(t).cast("double") for t in terms]]
    rows = df.where(F.lit(True) if not terms else F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in [*terms, outcome])))
    y = F.col(outcome).cast("double")
    xx = F.array(*[F.sum(a * b) for a in names for b in names])
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(y * y).alias("yy"), F.sum(y).alias("sy"), F.array(*[F.sum(a * y) for a in names]).alias("xy"), xx.alias("xx"))


def _solved(n: float, yy: float, sy: float, xy: np.ndarray, xx: np.ndarray, ridge: float = 0.0) -> dict:
    k = len(xy)
    a = xx.reshape(k, k) + ridge * np.diag([0.0] + [1.0] * (k - 1))
    b = np.linalg.lstsq(a, xy, rcond=1e-12)[0]
    rss = max(float(yy - 2 * b @ xy + b @ xx.reshape(k, k) @ b), 0.0)
    tss = yy - sy * sy / n
    edf = float(np.trace(np.linalg.lstsq(a, xx.reshape(k, k), rcond=1e-12)[0]))
    loglik = -0.5 * n * (math.log(2 * math.pi * max(rss, 1e-300) / n) + 1)
    fit = {"coef": b.tolist(), "rss": rss, "r_sq": 1 - rss / tss if tss > 0 else None, "edf": edf, "aic": 2 * (edf + 1) - 2 * loglik, "bic": math.log(n) * (edf + 1) - 2 * loglik}
    return fit | {"means": (xx[:k] / n).tolist(), "inverse": np.linalg.pinv(a).ravel().tolist()}


FIT = "coef array<double>, rss double, r_sq double, edf double, aic double, bic double, means array<double>, inverse array<double>"


def solve(sums: DataFrame, ridge: float = 0.0) -> DataFrame:
    """Adds the least-squares (or ridge) fit to rows of ``products``."""

    @F.pandas_udf(f"struct<{', '.join(x.replace(' ', ':', 1) for x in FIT.split(', '))}>")
    def run(n: pd.Series, yy: pd.Series, sy: pd.Series, xy: pd.Series, xx: pd.Series) -> pd.DataFrame:
        made = [_solved(float(a), b, c, np.asarray(d, float), np.asarray(e, float), ridge) for a, b, c, d, e in zip(n, yy, sy, xy, xx)]
        return pd.DataFrame(made, columns=[x.split()[0] for x in FIT.split(", ")])

    keep = [c for c in sums.columns if c not in ("yy", "sy", "xy", "xx")]
    return sums.withColumn("_f", run("n", "yy", "sy", "xy", "xx")).select(*keep, "_f.*")


def _minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def predict(df: DataFrame, fits: DataFrame, keys: list[str], terms: list[str]) -> DataFrame:
    """Adds predicted: intercept and fixed terms only, so that subjects that the model hasn't seen can be scored."""
    rows = df.join(fits.select(*keys, "coef"), keys)
    value = F.col("coef")[0]
    for i, t in enumerate(terms, 1):
        value = value + F.col("coef")[i] * F.col(t)
    return rows.withColumn("predicted", value).drop("coef")


def loso_cv(df: DataFrame, keys: list[str], fold: str, terms: list[str], outcome: str, least: int = 5) -> tuple[DataFrame, DataFrame]:
    """(per fold, over folds): each fold is predicted by the model of all others, whose sums are the whole's minus
    its own. Folds under ``least`` rows are skipped."""
    own = products(df, [*keys, fold], terms, outcome)
    whole = products(df, keys, terms, outcome)
    rest = own.where(F.col("n") >= least).alias("o").join(whole.alias("w"), keys)
    left = rest.select(*keys, fold, *[(F.col(f"w.{c}") - F.col(f"o.{c}")).alias(c) for c in ("n", "yy", "sy")], *[_minus(F.col(f"w.{c}"), F.col(f"o.{c}")).alias(c) for c in ("xy", "xx")])
    scored = predict(df, solve(left.where("n > 0")), [*keys, fold], terms)
    folds = eval_metrics(scored, [*keys, fold], outcome, "predicted", split=False)
    metrics = ["pearson_r", "rmse", "mae", "r_sq"]
    over = folds.groupBy(*keys).agg(*[f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("sd", F.stddev_samp))], F.count("pearson_r").alias("n_complete"))
    return folds, over


def external_cv(df: DataFrame, fits: DataFrame, keys: list[str], terms: list[str], outcome: str, groups: list[str]) -> DataFrame:
    """Scores of held-out rows overall, and by each of ``groups``."""
    scored = predict(df, fits, keys, terms)
    metrics = ["n_obs", "pearson_r", "rmse", "mae", "r_sq", "spearman_rho"]
    out = eval_metrics(scored, keys, outcome, "predicted").select(*keys, F.lit("overall").alias("cv_type"), F.lit("all").alias("fold_id"), *metrics)
    for g in groups:
        part = eval_metrics(scored, [*keys, g], outcome, "predicted", split=False)
        out = out.unionAll(part.select(*keys, F.lit(g).alias("cv_type"), F.col(g).cast("string").alias("fold_id"), *metrics))
    return out


def seeded(seed: int, *columns: str) -> Column:
    """A number in [0, 1) that depends on nothing but the seed and the columns."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 52)) / float(1 << 52)


#: Rows that are permuted together, and rows of a key up to which a task makes the ranks of its replicates.
BLOCK_ROWS, HELD_ROWS = 1 << 17, 2_000_000


def permutation_p(df: DataFrame, keys: list[str], row: str, x: str, y: str, n_perm: int = 1000, seed: int = 42, plus_one: bool = True) -> DataFrame:
    """(keys, r, n_ge, p): |r| against shuffles of y within keys; (c + 1) / (n + 1), or c / n but 1 / n at least.

    A key's rows are shuffled between tasks once, whatever ``n_perm`` is: permutations are made where they lie, and a replicate is one
    sum of products. Beyond BLOCK_ROWS a key's rows are dealt by a hash into blocks of about so many, and y is permuted within each:
    under the hypothesis rows can be exchanged, so also within parts that don't depend on them. Rows are taken in the
    order of ``row`` and the values, and seeds follow from the keys, so the same seed gives the same p."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    stats = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.avg(x).alias("_mx"), F.avg(y).alias("_my"), guarded_corr(x, y).alias("r"))
    placed = rows.join(dimension(stats), keys)
    block = F.pmod(F.xxhash64(F.lit(seed), F.lit("block"), row), F.ceil(F.col("_n") / BLOCK_ROWS))
    placed = placed.select(*keys, block.alias("_block"), F.col(row).alias("_row"), (F.col(x) - F.col("_mx")).alias("_x"), (F.col(y) - F.col("_my")).alias("_y"))
    placed = placed.withColumn("_seed", F.xxhash64(F.lit(seed), *[F.col(k).cast("string") for k in keys], "_block"))
    kinds = ", ".join(f"`{c}` {t}" for c, t in placed.dtypes[: len(keys)]) + ", xx double, yy double, xy array<double>"

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["_row", "_x", "_y"])
        a, b = own["_x"].to_numpy(float), own["_y"].to_numpy(float)
        rng = np.random.default_rng(int(own["_seed"].iloc[0]) % (1 << 64))
        return pd.DataFrame([[*(own[k].iloc[0] for k in keys), a @ a, b @ b, [float(a @ rng.permutation(b)) for _ in range(n_perm)]]], columns=[*keys, "xx", "yy", "xy"])

    sums = placed.groupBy(*keys, "_block").applyInPandas(run, kinds)
    draws = sums.select(*keys, "xx", "yy", F.posexplode("xy").alias("rep", "xy")).groupBy(*keys, "rep").agg(*[F.sum(c).alias(c) for c in ("xx", "yy", "xy")])
    draws = draws.select(*keys, (F.col("xy") / F.sqrt(F.nullif(F.col("xx") * F.col("yy"), F.lit(0.0)))).alias("_r"))
    count = draws.join(dimension(stats.select(*keys, "r")), keys).groupBy(*keys).agg(F.first("r").alias("r"), F.count_if(F.col("r").isNotNull() & (F.abs("_r") >= F.abs("r") - 1e-12)).alias("n_ge"), F.count(F.when(F.col("r").isNotNull(), F.col("_r"))).alias("_n"))
    p = (F.col("n_ge") + 1) / (F.col("_n") + 1) if plus_one else F.greatest(F.col("n_ge"), F.lit(1)) / F.nullif("_n", F.lit(0))
    return count.withColumn("p", F.when(F.col("r").isNotNull(), p)).drop("_n")


def weighted_spearman(x: np.ndarray, y: np.ndarray, weights: Iterable[np.ndarray]) -> list[float | None]:
    """For each of ``weights`` the correlation of the ranks that the points have when each is repeated so often."""
    codes = [np.unique(v, return_inverse=True)[1] for v in (x, y)]
    out: list[float | None] = []
    for w in weights:
        n, ranks, spreads = float(w.sum()), [], []
        for c in codes:
            at = np.bincount(c, w)
            rank = np.cumsum(at) - (at - 1) / 2 - (n + 1) / 2  # the middle of its copies, from the mean
            ranks.append(rank[c])
            spreads.append(float(at @ (rank * rank)))
        norm = math.sqrt(spreads[0] * spreads[1])
        out.append(float((w * ranks[0]) @ ranks[1]) / norm if norm > 0 else None)
    return out


def _hashed(value: np.ndarray | int, state: np.ndarray | int) -> np.ndarray:
    """XXH64 of 32-bit integers on top of a state, as ``seeded`` has it of each of its columns."""
    p = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
    h = (np.atleast_1d(state).astype(np.uint64) + p[3] + np.uint64(4)) ^ (np.atleast_1d(value).astype(np.uint64) * p[0])
    h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * p[1] + p[2]
    h = (h ^ (h >> np.uint64(33))) * p[1]
    h = (h ^ (h >> np.uint64(29))) * p[2]
    return h ^ (h >> np.uint64(32))


def times_drawn(seed: int, reps: Iterable[int], m: int) -> Iterable[np.ndarray]:
    """For each of ``reps`` how often each of m subjects is drawn: draw k is subject floor(seeded(seed, rep, k) * m)."""
    start, k = _hashed(seed, 42), np.arange(m)
    for rep in reps:
        u = (_hashed(k, _hashed(rep, start)) & np.uint64((1 << 52) - 1)) / float(1 << 52)
        yield np.bincount((u * m).astype(np.int64), minlength=m)


#: Values of the side with fewer, up to which a large key's ranks are made in buckets of the other side, and the least rows of a bucket.
SIDE_VALUES, BUCKET_ROWS = 1000, 250_000


def _bucket_ranks(rows: DataFrame, keys: list[str], n_boot: int, seed: int, parts: int) -> DataFrame:
    """(keys, rep, spearman_rho) of rows (keys, _k, _m, a, b), b of few values, without a row for a replicate: weights of the
    values of b and of buckets of a are sums of the subjects' counts in them, and a bucket's rows then have both ranks of each replicate."""
    cuts = value_cuts(rows, keys, ["a"], parts)
    dealt = rows.alias("d").join(dimension(cuts).alias("c"), same_keys("d", "c", keys)).select("d.*", bucket_of("d.a", "_cuts0").cast("double").alias("_b"))
    path = scratch_path(rows.sparkSession, "bootstrap-rows")
    dealt.write.parquet(path)
    dealt = rows.sparkSession.read.parquet(path)
    reps = range(1, n_boot + 1)
    kinds = ", ".join(f"`{c}` {t}" for c, t in dealt.dtypes if c in keys)
    each = dealt.select(*keys, "_k", "_m", F.inline(F.array(F.struct(F.lit(0).alias("kind"), F.col("_b").alias("at")), F.struct(F.lit(1).alias("kind"), F.col("b").alias("at")))))
    counts = each.groupBy(*keys, "_k", "_m", "kind", "at").agg(F.count("*").alias("_n")).withColumn("_part", F.pmod(F.xxhash64("kind", "at"), F.lit(max(1, parts // 4))))

    def weigh(own: pd.DataFrame) -> pd.DataFrame:
        group = own.groupby(["kind", "at"], sort=False).ngroup().to_numpy()
        k, n = own["_k"].to_numpy(), own["_n"].to_numpy(float)
        w = np.stack([np.bincount(group, c[k] * n) for c in times_drawn(seed, reps, int(own["_m"].iloc[0]))], 1)
        return own.drop_duplicates(["kind", "at"])[[*keys, "kind", "at"]].assign(w=list(w))

    weights = counts.groupBy(*keys, "_part").applyInPandas(weigh, f"{kinds}, kind int, at double, w array<double>")

    def table(own: pd.DataFrame) -> pd.DataFrame:
        (_, buckets), (_, values) = sorted(own.sort_values("at").groupby("kind"), key=lambda x: x[0])
        w, v = np.stack(list(buckets["w"])), np.stack(list(values["w"]))
        total = w.sum(0)
        ranks = np.cumsum(v, 0) - (v - 1) / 2 - (total + 1) / 2
        out = buckets[[*keys]].assign(_b=buckets["at"], base=list(np.cumsum(w, 0) - w))
        for c, x in (("total", total), ("spread", (v * ranks * ranks).sum(0)), ("known", values["at"].to_numpy()), ("ranks", ranks.T.ravel())):
            out[c] = [x] * len(out)
        return out

    tables = weights.groupBy(*keys).applyInPandas(table, f"{kinds}, _b double, " + ", ".join(f"{c} array<double>" for c in ("base", "total", "spread", "known", "ranks")))

    def score(own: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
        own, t = own.sort_values("a"), sums.iloc[0]
        k, a, known = own["_k"].to_numpy(), own["a"].to_numpy(), np.asarray(t["known"])
        starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        code, ranks = np.searchsorted(known, own["b"].to_numpy()), np.asarray(t["ranks"]).reshape(n_boot, len(known))
        made = []
        for i, c in enumerate(times_drawn(seed, reps, int(own["_m"].iloc[0]))):
            w = c[k].astype(float)
            at = np.add.reduceat(w, starts)
            rank = t["base"][i] + np.cumsum(at) - (at - 1) / 2 - (t["total"][i] + 1) / 2
            made.append((i + 1, float(np.add.reduceat(w * ranks[i][code], starts) @ rank), float(at @ (rank * rank)), float(t["spread"][i])))
        out = pd.DataFrame(made, columns=["rep", "xy", "xx", "yy"])
        return out.assign(**{c: t[c] for c in keys})[[*keys, "rep", "xy", "xx", "yy"]]

    scored = dealt.groupBy(*keys, "_b").cogroup(tables.groupBy(*keys, "_b")).applyInPandas(score, f"{kinds}, rep int, xy double, xx double, yy double")
    rho = F.sum("xy") / F.sqrt(F.nullif(F.sum("xx") * F.max("yy"), F.lit(0.0)))
    return scored.groupBy(*keys, "rep").agg(rho.alias("spearman_rho"))


def _replicate_ranks(rows: DataFrame, placed: DataFrame, keys: list[str], x: str, y: str, n_boot: int, seed: int, parts: int = 4) -> DataFrame:
    """(keys, rep, spearman_rho) of rows (keys, _k: subject, _m: subjects of the key); ``placed`` has a row for each subject.

    Keys of up to HELD_ROWS rows: each of ``parts`` tasks holds a key's rows and makes the ranks of its share of the replicates.
    Larger ones with few values on a side: in buckets of the other side. Else rows meet their weights in a join, and
    windows, which spill, make the ranks."""
    rows = rows.select(*keys, "_k", "_m", F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_size"), F.approx_count_distinct("_x").alias("_dx"), F.approx_count_distinct("_y").alias("_dy"))
    path = scratch_path(rows.sparkSession, "bootstrap-sizes")
    sizes.write.parquet(path)
    sizes = rows.sparkSession.read.parquet(path)
    sized = rows.join(dimension(sizes), keys)
    kinds = ", ".join(f"`{c}` {t}" for c, t in sized.dtypes[: len(keys)]) + ", rep int, spearman_rho double"

    def run(own: pd.DataFrame) -> pd.DataFrame:
        of = own["_k"].to_numpy()
        reps = [r for r in range(1, n_boot + 1) if r % parts == own["_part"].iloc[0]]
        rho = weighted_spearman(own["_x"].to_numpy(), own["_y"].to_numpy(), (c[of] for c in times_drawn(seed, reps, int(own["_m"].iloc[0]))))
        return pd.DataFrame({k: [own[k].iloc[0]] * len(reps) for k in keys} | {"rep": reps, "spearman_rho": pd.Series(rho, dtype="float64")})

    large, few = F.col("_size") > HELD_ROWS, F.least("_dx", "_dy") <= SIDE_VALUES
    small = sized.where(~large).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    out = small.groupBy(*keys, "_part").applyInPandas(run, kinds)
    most = sizes.where(large & few).agg(F.max("_size")).first()[0]
    if most:
        swap = F.col("_dx") < F.col("_dy")
        some = sized.where(large & few).select(*keys, "_k", "_m", F.when(swap, F.col("_y")).otherwise(F.col("_x")).alias("a"), F.when(swap, F.col("_x")).otherwise(F.col("_y")).alias("b"))
        # Each bucket draws all subjects anew, so it has some rows for each.
        people = placed.agg(F.max("_m")).first()[0]
        out = out.unionAll(_bucket_ranks(some, keys, n_boot, seed, max(2, math.ceil(most / max(BUCKET_ROWS, 4 * people)))))
    if sizes.where(large & ~few).isEmpty():
        return out
    draws = placed.join(dimension(sizes.where(large & ~few).select(*keys)), keys).select(*keys, "_m", "_k", F.explode(F.sequence(F.lit(1), F.lit(n_boot))).alias("rep"))
    drawn = draws.withColumn("_d", F.floor(seeded(seed, "rep", "_k") * F.col("_m"))).groupBy(*keys, "rep", F.col("_d").alias("_k")).agg(F.count("*").alias("c"))
    # Draws are many times the rows that Spark expects of them.
    weighed = sized.where(large & ~few).join(drawn.hint("merge"), [*keys, "_k"])
    whole = Window.partitionBy(*keys, "rep")

    def rank(v: str) -> Column:
        upto = F.sum("c").over(whole.orderBy(v).rangeBetween(Window.unboundedPreceding, Window.currentRow))
        return upto - (F.sum("c").over(Window.partitionBy(*keys, "rep", v)) - 1) / 2 - (F.sum("c").over(whole) + 1) / 2

    ranked = weighed.withColumns({"_p": rank("_x"), "_q": rank("_y")})
    total = lambda a, b: F.sum(F.col("c") * F.col(a) * F.col(b))
    rho = total("_p", "_q") / F.sqrt(F.nullif(total("_p", "_p") * total("_q", "_q"), F.lit(0.0)))
    return out.unionAll(ranked.groupBy(*keys, "rep").agg(rho.alias("spearman_rho")))


def bootstrap_ci(df: DataFrame, keys: list[str], subject: str, x: str, y: str, n_boot: int = 500, seed: int = 42, parts: int = 8) -> DataFrame:
    """(keys, metric, ci_low, median, ci_high): subjects drawn with replacement. A replicate is a weight of each subject:
    pearson_r, r_sq, rmse and mae follow from subjects' sums, of which each of ``parts`` tasks takes a share of the replicates;
    spearman_rho from the ranks that the rows have in the replicate, made of sums of weights over sorted values, so rows
    aren't repeated. Draws are made where they are used; a null key has no row."""
    e = F.col(x) - F.col(y)
    a, b = F.col(x), F.col(y)
    rows = df.where(a.isNotNull() & b.isNotNull() & F.col(subject).isNotNull()).dropna(subset=keys)
    summed = {"sx": a, "sy": b, "sxx": a * a, "syy": b * b, "sxy": a * b, "se": e * e, "sa": F.abs(e)}
    sums = rows.groupBy(*keys, subject).agg(F.count("*").alias("n"), *[F.sum(v).alias(c) for c, v in summed.items()])
    w = Window.partitionBy(*keys)
    placed = sums.withColumns({"_k": F.row_number().over(w.orderBy(subject)) - 1, "_m": F.count("*").over(w)})
    path = scratch_path(df.sparkSession, "subject-sums")
    placed.write.parquet(path)
    placed = df.sparkSession.read.parquet(path)
    columns = ["n", *summed]
    kinds = ", ".join(f"`{c}` {t}" for c, t in placed.dtypes if c in keys)

    def totals(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("_k")
        reps = [r for r in range(1, n_boot + 1) if r % parts == own["_part"].iloc[0]]
        v = own[columns].to_numpy(float)
        made = pd.DataFrame(np.array([c @ v for c in times_drawn(seed, reps, len(own))]).reshape(-1, len(columns)), columns=columns)
        return made.assign(rep=reps, **{k: own[k].iloc[0] for k in keys})[[*keys, "rep", *columns]]

    total = placed.select(*keys, "_k", *columns, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part")).groupBy(*keys, "_part").applyInPandas(totals, f"{kinds}, rep int, " + ", ".join(f"{c} double" for c in columns))
    n = F.col("n")
    cov, vx, vy = (F.col(u) - F.col(v) * F.col(z) / n for u, v, z in (("sxy", "sx", "sy"), ("sxx", "sx", "sx"), ("syy", "sy", "sy")))
    pearson = F.when((vx > 1e-12) & (vy > 1e-12), cov / F.sqrt(F.nullif(vx * vy, F.lit(0.0))))
    metrics = total.select(*keys, "rep", pearson.alias("pearson_r"), (pearson * pearson).alias("r_sq"), F.sqrt(F.col("se") / n).alias("rmse"), (F.col("sa") / n).alias("mae"))
    own = rows.join(dimension(placed.select(*keys, subject, "_k", "_m")), [*keys, subject])
    ranks = _replicate_ranks(own, placed, keys, x, y, n_boot, seed).unpivot([*keys, "rep"], ["spearman_rho"], "metric", "value")
    long = metrics.unpivot([*keys, "rep"], ["pearson_r", "r_sq", "rmse", "mae"], "metric", "value").unionByName(ranks)
    q = F.percentile("value", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    return long.groupBy(*keys, "metric").agg(q.alias("_q")).select(*keys, "metric", *[F.col("_q")[i].alias(c) for i, c in enumerate(("ci_low", "median", "ci_high"))])


def sensitivity_drop(df: DataFrame, keys: list[str], group: str, terms: list[str], outcome: str) -> DataFrame:
    """(keys, group, r_full, r_without, delta_r): the fit without each group's rows, from sums."""
    own, whole = products(df, [*keys, group], terms, outcome), products(df, keys, terms, outcome)
    rest = own.alias("o").join(whole.alias("w"), keys)
    left = rest.select(*keys, group, *[(F.col(f"w.{c}") - F.col(f"o.{c}")).alias(c) for c in ("n", "yy", "sy")], *[_minus(F.col(f"w.{c}"), F.col(f"o.{c}")).alias(c) for c in ("xy", "xx")])
    r = lambda: F.sqrt(F.greatest(F.lit(0.0), F.col("r_sq")))
    full = solve(whole).select(*keys, r().alias("r_full"))
    return solve(left.where("n > 0")).select(*keys, group, r().alias("r_without")).join(full, keys).withColumn("delta_r", F.col("r_without") - F.col("r_full"))


def sensitivity_qc(df: DataFrame, keys: list[str], quality: str, limits: list[float], terms: list[str], outcome: str, subject: str, least: int = 5) -> DataFrame:
    """(keys, limit, n, n_subjects, r): the fit on rows at or over each quality limit, with ``least`` subjects or more."""
    rows = df.withColumn("limit", F.explode(F.array(*map(F.lit, limits)))).where(F.col(quality) >= F.col("limit"))
    people = rows.groupBy(*keys, "limit").agg(F.count_distinct(subject).alias("n_subjects")).where(F.col("n_subjects") >= least)
    return solve(products(rows, [*keys, "limit"], terms, outcome)).join(people, [*keys, "limit"]).select(*keys, "limit", "n", "n_subjects", F.sqrt(F.greatest(F.lit(0.0), F.col("r_sq"))).alias("r"))


def split_half_stability(df: DataFrame, keys: list[str], subject: str, strata: str, terms: list[str], outcome: str, n_reps: int = 50, seed: int = 42) -> DataFrame:
    """(keys, rep, r): correlation over all rows of the predictions of models of two stratified halves of subjects."""
    sums = products(df, [*keys, strata, subject], terms, outcome)
    people = sums.select(*keys, strata, subject, F.explode(F.sequence(F.lit(1), F.lit(n_reps))).alias("rep"))
    w = Window.partitionBy(*keys, strata, "rep")
    half = F.when(F.row_number().over(w.orderBy(seeded(seed, "rep", subject), subject)) <= F.ceil(F.count("*").over(w) / 2), "a").otherwise("b")
    k = len(terms) + 1
    total = people.withColumn("half", half).join(sums, [*keys, strata, subject]).groupBy(*keys, "rep", "half").agg(
        *[F.sum(c).alias(c) for c in ("n", "yy", "sy")], F.array(*[F.sum(F.col("xy")[i]) for i in range(k)]).alias("xy"), F.array(*[F.sum(F.col("xx")[i]) for i in range(k * k)]).alias("xx")
    )
    fits = solve(total).groupBy(*keys, "rep").agg(F.max(F.when(F.col("half") == "a", F.col("coef"))).alias("a"), F.max(F.when(F.col("half") == "b", F.col("coef"))).alias("b"))
    # The correlation of two linear predictors needs the rows' covariance only.
    whole = products(df, keys, terms, outcome).select(*keys, "n", "xx")

    @F.pandas_udf("double")
    def corr(n: pd.Series, xx: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for m, s, p, q in zip(n, xx, a, b):
            if p is None or q is None:
                out.append(None)
                continue
            s = np.asarray(s, float).reshape(k, k) / m
            cov = s[1:, 1:] - np.outer(s[0, 1:], s[0, 1:])
            p, q = np.asarray(p, float)[1:], np.asarray(q, float)[1:]
            norm = math.sqrt(max(p @ cov @ p, 0) * max(q @ cov @ q, 0))
            out.append(float(p @ cov @ q / norm) if norm > 0 else None)
        return pd.Series(out, dtype="float64")

    return fits.join(whole, keys).select(*keys, "rep", corr("n", "xx", "a", "b").alias("r"))


def smooth_effect(fits: DataFrame, term: int, low: float, high: float, points: int = 200, basis: list[Callable[[Column], Column]] | None = None) -> DataFrame:
    """(keys, x, effect, se, low, high): on a grid the partial effect of the term whose columns begin at ``term`` of fits of
    ``solve``, from its mean, with its own standard error at each x and 1.96 of it on either side.

    ``basis`` gives the columns' values at x (one, x itself, for a linear term)."""
    basis = basis or [lambda x: x]
    step = (high - low) / (points - 1)
    grid = fits.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", low + F.col("_i") * step).drop("_i")
    k = F.size("coef")
    apart = [g(F.col("x")) - F.col("means")[term + i] for i, g in enumerate(basis)]
    effect = functools.reduce(lambda a, b: a + b, [F.col("coef")[term + i] * v for i, v in enumerate(apart)])
    form = functools.reduce(lambda a, b: a + b, [v * w * F.col("inverse")[k * (term + i) + term + j] for i, v in enumerate(apart) for j, w in enumerate(apart)])
    se = F.sqrt(F.greatest(F.lit(0.0), form) * F.col("rss") / F.greatest(F.lit(1.0), F.col("n") - F.col("edf")))
    out = grid.withColumns({"effect": effect, "se": se, "low": effect - 1.96 * se, "high": effect + 1.96 * se})
    return out.drop(*[x.split()[0] for x in FIT.split(", ")])


def smooth_concordance(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, r, same_sign) of two effects (keys, x, y) on one grid."""
    both = a.withColumnRenamed("y", "ya").join(b.withColumnRenamed("y", "yb"), [*keys, "x"])
    return both.groupBy(*keys).agg(guarded_corr("ya", "yb").alias("r")).withColumn("same_sign", F.col("r") > 0)


def fit_quality_comparison(concepts: DataFrame) -> DataFrame:
    """delta_aic = channel - source for each concept."""
    return concepts.withColumn("delta_aic", F.col("channel_aic") - F.col("source_aic"))


def variance_components(df: DataFrame, keys: list[str], subject: str, value: str) -> DataFrame:
    """(keys, n_subjects, var_residual, var_subject, icc) by the moments of a one-way layout."""
    own = df.where(F.col(value).isNotNull()).groupBy(*keys, subject).agg(F.count("*").alias("_m"), F.sum(value).alias("_s"), F.sum(F.col(value) * F.col(value)).alias("_q"))
    out = own.groupBy(*keys).agg(F.count("*").alias("k"), F.sum("_m").alias("n"), F.sum("_s").alias("_s"), F.sum("_q").alias("_q"), F.sum(F.col("_s") * F.col("_s") / F.col("_m")).alias("b"), F.sum(F.col("_m") * F.col("_m")).alias("mm")).where("k > 1 AND n > k")
    between = (F.col("b") - F.col("_s") * F.col("_s") / F.col("n")) / (F.col("k") - 1)
    inner = (F.col("_q") - F.col("b")) / (F.col("n") - F.col("k"))
    n0 = (F.col("n") - F.col("mm") / F.col("n")) / (F.col("k") - 1)
    rows = out.select(*keys, F.col("k").alias("n_subjects"), inner.alias("var_residual"), F.greatest(F.lit(0.0), (between - inner) / n0).alias("var_subject"))
    return rows.withColumn("icc", F.col("var_subject") / F.nullif(F.col("var_subject") + F.col("var_residual"), F.lit(0.0)))


def results_report(tests: dict[str, tuple[DataFrame, str, str, str | None]], level: float = 0.05) -> DataFrame:
    """(what, name, statistic, value, p, significant): the flat rows of a report, of tables by their title with the columns
    that name a row, its statistic and its p-value (or none)."""
    parts = []
    for title, (rows, name, value, p) in tests.items():
        own = F.col(p) if p else F.lit(None).cast("double")
        parts.append(rows.select(F.lit(title).alias("what"), F.expr(name).cast("string").alias("name"), F.lit(value).alias("statistic"), F.col(value).cast("double").alias("value"), own.alias("p"), (own < level).alias("significant")))
    return functools.reduce(lambda a, b: a.unionAll(b), parts)


def required_sample(curve: DataFrame, keys: list[str], target: float, have: int) -> DataFrame:
    """n_required of each key and whether ``have`` subjects suffice."""
    from cadenza.operators.windows import first_crossing

    rows = first_crossing(curve, keys, "n", "power", target)
    return rows.withColumn("verdict", F.when(~F.col("achieved"), "not reached").when(F.col("n_required") <= have, "sufficient").otherwise("recruit more"))
