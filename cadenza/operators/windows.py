"""Order-based operators; every window is bounded by a key of the data or runs over aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators.joins import dimension
from cadenza.sources.scratch import scratch_path


def trial_index(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return df.withColumn("trial_index", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))


def global_ordinal(dimension: DataFrame, order: list[str]) -> DataFrame:
    """1..N over a dimension table of subjects; facts keep their stable identifier."""
    return dimension.withColumn("ordinal", F.row_number().over(Window.orderBy(*order)))


def zscore(df: DataFrame, columns: list[str], by: list[str], population: bool = False) -> DataFrame:
    """Adds c_z: (x - mean) / sd of its group; null for a constant, or the centred value as it is with ``population``."""
    spread = F.stddev_pop if population else F.stddev_samp
    made = {}
    sums = [a for c in columns for a in (F.avg(c).alias(f"_m_{c}"), spread(c).alias(f"_s_{c}"))]
    stats = df.groupBy(*by).agg(*sums) if by else df.agg(*sums)
    rows = df.join(stats, by, "left") if by else df.join(F.broadcast(stats))
    for c in columns:
        z = (F.col(c) - F.col(f"_m_{c}")) / F.nullif(F.col(f"_s_{c}"), F.lit(0.0))
        made[f"{c}_z"] = F.coalesce(z, F.col(c)) if population else z
    return rows.withColumns(made).drop(*[f"_{k}_{c}" for c in columns for k in "ms"])


def successive_diff(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    rows = df.where(F.col(value).isNotNull())
    return rows.withColumn("diff", F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(order)))


def fdr_bh(df: DataFrame, family: list[str], p: str = "p", tie: str | None = None) -> DataFrame:
    """Adds p_adj (Benjamini-Hochberg) within each family of tests; null p-values aren't counted."""
    own = Window.partitionBy(*family, F.col(p).isNull())
    up = own.orderBy(F.col(p), *([tie] if tie else []))
    after = up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ranked = df.withColumns({"_r": F.row_number().over(up), "_n": F.count(p).over(own)})
    adjusted = F.least(F.lit(1.0), F.min(F.col(p) * F.col("_n") / F.col("_r")).over(after))
    return ranked.withColumn("p_adj", F.when(F.col(p).isNotNull(), adjusted)).drop("_r", "_n")


def same_keys(a: str, b: str, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys], F.lit(True))


def _kept(df: DataFrame, name: str) -> DataFrame:
    """A small table, written and read back, so that it is made once."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def value_cuts(df: DataFrame, keys: list[str], values: list[str], parts: int = 64) -> DataFrame:
    """(keys, _cuts0, _cuts1, ...): approximate quantiles of the values, written; a row for each of the keys."""
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    return _kept(df.groupBy(*keys).agg(*[F.percentile_approx(v, shares, F.lit(20 * parts)).alias(f"_cuts{i}") for i, v in enumerate(values)]), "cuts")


def bucket_of(value: str, cuts: str) -> Column:
    """How many cuts lie below the value; -1 for null."""
    return F.when(F.col(value).isNull(), F.lit(-1)).otherwise(F.coalesce(F.size(F.filter(cuts, lambda c: c < F.col(value))), F.lit(0)))


def value_buckets(df: DataFrame, keys: list[str], values: list[str], parts: int = 64) -> tuple[DataFrame, list[DataFrame]]:
    """``df`` with _b0, _b1, ... of ``values``: buckets of a value that rise with it (nulls first); and for each of them (keys, _b, _before:
    rows in lower buckets, _n: rows in it, _all: rows of the keys). About ``parts`` buckets for each of the keys, cut by approximate
    quantile sketches: whatever the cuts, ranks from the counts are exact, and no task holds all rows of a key but
    those of equal values. The tables of cuts and counts are a few rows for each of the keys, counted before they are broadcast."""
    cuts = value_cuts(df, keys, values, parts)
    rows = df.alias("d").join(dimension(cuts).alias("c"), same_keys("d", "c", keys), "left")
    rows = rows.select("d.*", *[bucket_of(f"d.{v}", f"_cuts{i}").alias(f"_b{i}") for i, v in enumerate(values)])
    each = rows.select(*keys, F.posexplode(F.array(*[F.col(f"_b{i}") for i in range(len(values))])).alias("_which", "_b"))
    own = Window.partitionBy(*keys, "_which")
    counts = each.groupBy(*keys, "_which", "_b").agg(F.count("*").alias("_n"))
    counts = _kept(counts.withColumns({"_before": F.sum("_n").over(own.orderBy("_b")) - F.col("_n"), "_all": F.sum("_n").over(own)}), "bucket-counts")
    return rows, [counts.where(F.col("_which") == i).drop("_which") for i in range(len(values))]


def avg_ranks(df: DataFrame, keys: list[str], names: dict[str, str]) -> DataFrame:
    """Adds for each value its rank within keys under a name: ties share their mean, nulls are lowest. One shuffle for each value."""
    out, counts = value_buckets(df, keys, list(names))
    for i, (value, name) in enumerate(names.items()):
        known = dimension(counts[i].select(*keys, F.col("_b").alias(f"_b{i}"), "_before"))
        placed = out.alias("d").join(known.alias("c"), same_keys("d", "c", [*keys, f"_b{i}"])).select("d.*", "_before")
        own = [*keys, f"_b{i}"]
        ties = F.count("*").over(Window.partitionBy(*own, value))
        out = placed.withColumn(name, F.col("_before") + F.rank().over(Window.partitionBy(*own).orderBy(value)) + (ties - 1) / 2).drop(f"_b{i}", "_before")
    return out


def avg_rank(df: DataFrame, keys: list[str], value: str, name: str = "rank", split: bool = True) -> DataFrame:
    """Ranks, ties sharing their mean; nulls are lowest. With ``split`` a key's rows are ranked in buckets of values."""
    if split:
        return avg_ranks(df, keys, {value: name})
    ties = F.count("*").over(Window.partitionBy(*keys, value))
    return df.withColumn(name, F.rank().over(Window.partitionBy(*keys).orderBy(value)) + (ties - 1) / 2)


def exact_percentiles(df: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """(keys, _q: the interpolated percentiles): only the buckets that hold one are sorted."""
    rows, (counts,) = value_buckets(df.where(F.col(value).isNotNull()).select(*keys, value), keys, [value])
    rows = rows.withColumnRenamed("_b0", "_b")
    wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(p) * (F.col("_all") - 1)).alias("at")) for i, p in enumerate(shares)]))
    wanted = counts.select(*keys, "_b", "_before", "_n", wanted.alias("_w")).select(*keys, "_b", "_before", "_n", "_w.i", "_w.at")
    # The two neighbours of a place may lie in two buckets.
    wanted = wanted.select("*", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))).alias("_row")).where((F.col("_row") >= F.col("_before")) & (F.col("_row") < F.col("_before") + F.col("_n")))
    wanted = dimension(_kept(wanted, "wanted-ranks"))
    buckets = dimension(wanted.select(*keys, "_b", "_before").distinct())
    inside = rows.alias("d").join(buckets.alias("c"), same_keys("d", "c", [*keys, "_b"])).select("d.*", "_before")
    numbered = inside.withColumn("_row", F.col("_before") + F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(value)) - 1)
    found = numbered.alias("r").join(wanted.alias("w"), same_keys("w", "r", [*keys, "_row"])).select(*[f"w.{k}" for k in keys], "i", "at", "w._row", f"r.{value}")
    weight = F.when(F.floor("at") == F.ceil("at"), 1.0).otherwise(1 - F.abs(F.col("at") - F.col("_row")))
    each = found.groupBy(*keys, "i").agg(F.sum(F.col(value) * weight).alias("v"))
    return each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("_q"))


def delta_aic(fits: DataFrame, group: str) -> DataFrame:
    return fits.withColumn("delta_aic", F.col("aic") - F.min("aic").over(Window.partitionBy(group)))


def moving_mean(df: DataFrame, keys: list[str], order: str, value: str, width: int) -> DataFrame:
    """Centred mean over ``width`` rows, fewer at the ends."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(width // 2), (width + 1) // 2 - 1)
    return df.withColumn("smooth", F.avg(value).over(w))


def mask_to_intervals(df: DataFrame, keys: list[str], flag: str, order: str = "i") -> DataFrame:
    """(keys, start, end) of each run of set flags at consecutive numbers."""
    hit = df.where(flag)
    island = F.col(order) - F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return hit.withColumn("_g", island).groupBy(*keys, "_g").agg(F.min(order).alias("start"), F.max(order).alias("end")).drop("_g")


def autocorrelation(df: DataFrame, keys: list[str], order: str, value: str, lags: int = 10, least: int = 6) -> DataFrame:
    """(keys, lag, acf, bound, n): normalised by lag 0; lags to min(``lags``, n / 3); groups of ``least`` rows or more.

    Rows are matched by an equal join on their number plus the lag."""
    w = Window.partitionBy(*keys)
    rows = df.where(F.col(value).isNotNull()).withColumns(
        {"_k": F.row_number().over(w.orderBy(order)), "_n": F.count("*").over(w), "_x": F.col(value) - F.avg(value).over(w)}
    ).where(F.col("_n") >= least)
    most = F.least(F.lit(lags), F.floor(F.col("_n") / 3)).cast("int")
    left = rows.select(*keys, "_n", F.col("_x").alias("a"), "_k", F.explode(F.sequence(F.lit(0), most)).alias("lag")).withColumn("_at", F.col("_k") + F.col("lag"))
    right = rows.select(*keys, F.col("_x").alias("b"), F.col("_k").alias("_at"))
    sums = left.join(right, [*keys, "_at"]).groupBy(*keys, "lag").agg(F.sum(F.col("a") * F.col("b")).alias("s"), F.max("_n").alias("n"))
    zero = F.max(F.when(F.col("lag") == 0, F.col("s"))).over(Window.partitionBy(*keys))
    return sums.select(*keys, "lag", (F.col("s") / F.nullif(zero, F.lit(0.0))).alias("acf"), (1.96 / F.sqrt("n")).alias("bound"), "n")


def quota_split(subjects: DataFrame, strata: str, key: str, existing: DataFrame | None = None, share: float = 0.75, seed: int = 42) -> DataFrame:
    """(key, strata, split_group): new subjects, in a seeded order, join train while its share is under ``share``.

    After j of a stratum's new subjects, on top of T0 train of n0, train holds
    min(T0 + j, max(T0, or 1 if n0 = 0, ceil(share * (n0 + j - 1)))): a subject joins train where that
    grows. Nobody is assigned anew."""
    schema = f"{key} {dict(subjects.dtypes)[key]}, {strata} {dict(subjects.dtypes)[strata]}, split_group string"
    old = existing if existing is not None else subjects.sparkSession.createDataFrame([], schema)
    base = old.groupBy(strata).agg(F.count("*").alias("n0"), F.count_if(F.col("split_group") == "train").alias("t0"))
    new = subjects.select(key, strata).distinct().join(old, key, "left_anti")
    place = F.row_number().over(Window.partitionBy(strata).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key))
    rows = new.join(base, strata, "left").fillna(0, ["n0", "t0"]).withColumn("j", place)

    def held(j: Column) -> Column:
        floor = F.when(F.col("n0") == 0, F.lit(1)).otherwise(F.col("t0"))
        grown = F.ceil(F.round(share * (F.col("n0") + j - 1), 9))
        return F.when(j == 0, F.col("t0")).otherwise(F.least(F.col("t0") + j, F.greatest(floor, grown)))

    joins = held(F.col("j")) > held(F.col("j") - 1)
    return rows.select(key, strata, F.when(joins, "train").otherwise("holdout").alias("split_group"))


def latest_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def cumulative_offset(df: DataFrame, keys: list[str], order: str, size: str) -> DataFrame:
    return df.withColumn("offset", F.sum(size).over(Window.partitionBy(*keys).orderBy(order)) - F.col(size))


def trapz_segments(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Adds the area from each point to the next of its group."""
    w = Window.partitionBy(*keys).orderBy(x)
    return df.withColumn("area", (F.lead(x).over(w) - F.col(x)) * (F.col(y) + F.lead(y).over(w)) / 2)


def first_crossing(curve: DataFrame, keys: list[str], n: str, power: str, target: float) -> DataFrame:
    """(keys, n_required, achieved, max_power): the smallest n whose power reaches the target."""
    return curve.groupBy(*keys).agg(F.min(F.when(F.col(power) >= target, F.col(n))).alias("n_required"), (F.max(power) >= target).alias("achieved"), F.max(power).alias("max_power"))


def percentile_flag(df: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    limits = exact_percentiles(df, keys, value, [share]).withColumn("_p", F.col("_q")[0]).drop("_q")
    return df.join(dimension(limits), keys).withColumn("flag", (F.col(value) < F.col("_p")).cast("int")).drop("_p")
