"""Counts, evaluation metrics, rankings, grouping sets and report tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.cleaning import hemisphere, region
from cadenza.operators.filters import guarded_corr
from cadenza.operators.windows import avg_rank, avg_ranks, exact_percentiles


def subject_unit_means(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in columns], F.count("*").alias("n_trials"))


def group_shares(df: DataFrame, outer: str, inner: str) -> DataFrame:
    counts = df.groupBy(outer, inner).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(outer)))


def distinct_units(long: DataFrame, split: DataFrame, unit: str = "unit") -> DataFrame:
    """Units with at least one training subject, in order."""
    train = split.where(F.col("split_group") == "train").select("subject")
    return long.join(train, "subject", "left_semi").select(unit).distinct().orderBy(unit)


def pivot_metrics(long: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Long to wide for the named metrics; of several values of a key the greatest stays."""
    return long.groupBy(*keys).pivot("metric_name", names).agg(F.max("metric_value"))


def eval_metrics(df: DataFrame, keys: list[str], actual: str, predicted: str, ranks: bool = True, split: bool = True) -> DataFrame:
    """(keys, n_obs, pearson_r, rmse, r_sq, mae, spearman_rho) of complete pairs; null correlations under 3.

    Ranks are made in buckets of values; without ``split``, for keys of bounded size such as a subject, in one task a key."""
    rows = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    if ranks:
        # A join and a window carry only what the metrics need.
        rows = rows.select(*keys, actual, predicted)
        names = {actual: "_ra", predicted: "_rp"}
        rows = avg_ranks(rows, keys, names) if split else reduce(lambda r, v: avg_rank(r, keys, v, names[v], False), names, rows)
    e = F.col(actual) - F.col(predicted)
    out = [F.count("*").alias("n_obs"), guarded_corr(actual, predicted).alias("pearson_r"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae")]
    out += [guarded_corr("_ra", "_rp").alias("spearman_rho")] if ranks else []
    return (rows.groupBy(*keys) if keys else rows).agg(*out).withColumn("r_sq", F.col("pearson_r") * F.col("pearson_r"))


def per_subject_r2(df: DataFrame, keys: list[str], actual: str, predicted: str) -> DataFrame:
    r = guarded_corr(actual, predicted)
    return df.groupBy(*keys).agg((r * r).alias("r2"), F.count("*").alias("n"))


def fold_summary(folds: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    out = [f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("sd", F.stddev_samp))]
    return folds.groupBy(*keys).agg(*out, F.count(metrics[0]).alias("n_complete"))


def ci_quantiles(df: DataFrame, keys: list[str], value: str, wide_over: float = 0.2) -> DataFrame:
    rows = exact_percentiles(df, keys, value, [0.025, 0.5, 0.975])
    width = F.col("_q")[2] - F.col("_q")[0]
    return rows.select(*keys, F.col("_q")[0].alias("ci_low"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("ci_high"), width.alias("width"), (width >= wide_over).alias("wide"))


def mean_se(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("se"), F.count(value).alias("n"))


def concordance_summary(df: DataFrame, keys: list[str], r: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(r).alias("mean_r"), F.count_if(F.col(r) > 0).alias("n_same_sign"), F.count(r).alias("n"))


def domain_vote(df: DataFrame, delta: str, margin: float = 2.0) -> DataFrame:
    return df.agg(F.count_if(F.col(delta) > margin).alias("source_better"), F.count_if(F.col(delta) < -margin).alias("channel_better"), F.count("*").alias("n"))


def grouping_sets(df: DataFrame, sets: list[list[str]], aggregates: list[Column]) -> DataFrame:
    """One pass over all sets of keys; ``level`` names the keys of a row."""
    names = list(dict.fromkeys(k for s in sets for k in s))
    rows = df.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in names])
    level = F.concat_ws("+", *[F.when(F.grouping(k) == 0, F.lit(k)) for k in names])
    return rows.agg(level.alias("level"), *aggregates)


def by_hemisphere(df: DataFrame, unit: str, aggregates: list[Column]) -> DataFrame:
    """Of each region the combined row, and one for each hemisphere that it has."""
    rows = df.withColumns({"region": region(F.col(unit)), "hemi": hemisphere(F.col(unit))})
    sets = rows.groupingSets([[F.col("region")], [F.col("region"), F.col("hemi")]], F.col("region"), F.col("hemi"))
    out = sets.agg(F.grouping("hemi").alias("_g"), *aggregates).where("_g = 1 OR hemi IS NOT NULL")
    return out.withColumn("hemi", F.when(F.col("_g") == 1, "combined").otherwise(F.col("hemi"))).drop("_g")


def heatmap(long: DataFrame, metric: str) -> DataFrame:
    """(subject, trial, metric_value) in order: the cells of a subject x trial matrix."""
    return long.where(F.col("metric_name") == metric).groupBy("subject", "trial").agg(F.avg("metric_value").alias("metric_value"))


def color_limits(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """2nd and 98th percentiles; minimum and maximum if these are equal; symmetric if they span 0."""
    q = F.percentile(value, F.array(F.lit(0.02), F.lit(0.98)))
    rows = df.groupBy(*keys).agg(q.alias("_q"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    flat = F.col("_q")[0] >= F.col("_q")[1]
    low, high = F.when(flat, F.col("_lo")).otherwise(F.col("_q")[0]), F.when(flat, F.col("_hi")).otherwise(F.col("_q")[1])
    most = F.greatest(F.abs(low), F.abs(high))
    spans = (low < 0) & (high > 0)
    return rows.select(*keys, F.when(spans, -most).otherwise(low).alias("vmin"), F.when(spans, most).otherwise(high).alias("vmax"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, keys: list[str] | None = None) -> DataFrame:
    """(keys, bin, n, share) of values in [low, high]; the last bin is closed."""
    keys = keys or []
    place = F.least(F.lit(bins - 1), F.floor((F.col(value) - low) / ((high - low) / bins))).cast("int")
    counts = df.where(F.col(value).between(low, high)).groupBy(*keys, place.alias("bin")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))))


def coverage_report(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.count_distinct(key).alias("n_subjects"), *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in columns])


def extreme_trials(df: DataFrame, keys: list[str], balance: str, paf: str, most: int = 6) -> DataFrame:
    """(keys, trial): two lowest balances, two highest peaks, one lowest peak, one highest balance; ``most`` at most."""
    w = lambda *o: F.row_number().over(Window.partitionBy(*keys).orderBy(*o, "trial"))
    ranked = df.withColumns({"_a": w(F.asc(balance)), "_b": w(F.desc(paf)), "_c": w(F.asc(paf)), "_d": w(F.desc(balance))})
    picked = ranked.where("_a <= 2 OR _b <= 2 OR _c <= 1 OR _d <= 1").select(*keys, "trial").distinct()
    return picked.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("trial"))).where(F.col("_r") <= most).drop("_r")


def strongest_peak(peaks: str, low: float, high: float) -> Column:
    """Of an array of structs (cf, pw, bw) the one with the most power in the band; the lowest frequency of equals."""
    inside = F.filter(peaks, lambda p: p["cf"].between(low, high))
    return F.array_max(F.transform(inside, lambda p: F.struct(p["pw"].alias("pw"), (-p["cf"]).alias("neg_cf"), p["bw"].alias("bw"))))


def best_per_group(df: DataFrame, group: str, score: str, name: str) -> DataFrame:
    """The row with the least score of each group, first by name of equals."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(score, name))).where("_r = 1").drop("_r")


def binding_constraint(required: DataFrame, target: str, name: str, n: str = "n_required") -> DataFrame:
    return required.groupBy(target).agg(F.max_by(name, F.struct(n, name)).alias(name), F.max(n).alias(n))


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """An ordered report of aggregates."""
    return df.orderBy(*order)


def first_trials(df: DataFrame, n: int) -> DataFrame:
    return df.where(F.col("trial") <= n)
