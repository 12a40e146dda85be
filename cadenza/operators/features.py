"""Per-trial features: spectra, balance indices, evoked peaks, phase statistics, channel quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators.filters import guarded, guarded_corr, in_band

EPS = 1e-12
SLOW, FAST, ALPHA = (8.0, 10.0), (10.0, 12.0), (8.0, 12.0)


def ga_psd(psd: DataFrame, keys: list[str]) -> DataFrame:
    """Mean density over units, bin by bin."""
    return psd.groupBy(*keys, "f").agg(F.avg("p").alias("p"))


def with_next(psd: DataFrame, keys: list[str]) -> DataFrame:
    """Adds f2 and p2, the following bin of the spectrum."""
    w = Window.partitionBy(*keys).orderBy("f")
    return psd.withColumns({"f2": F.lead("f").over(w), "p2": F.lead("p").over(w)})


def trapz(low: float, high: float, value: Column | None = None, value2: Column | None = None, half_open: bool = False) -> Column:
    """Area over the segments whose both ends lie in the band; null without a bin."""
    a, b = value if value is not None else F.col("p"), value2 if value2 is not None else F.col("p2")
    inside = in_band("f", low, high, half_open)
    segment = inside & in_band("f2", low, high, half_open)
    area = F.sum(F.when(segment, (F.col("f2") - F.col("f")) * (a + b) / 2))
    return F.when(F.count(F.when(inside, 1)) > 0, F.coalesce(area, F.lit(0.0)))


def bandpower(psd: DataFrame, keys: list[str], bands: dict[str, tuple[float, float]], half_open: bool = False) -> DataFrame:
    return with_next(psd, keys).groupBy(*keys).agg(*[trapz(lo, hi, half_open=half_open).alias(n) for n, (lo, hi) in bands.items()])


def bandpower_array(f: str, p: str, low: float, high: float, by_frequency: bool = False) -> Column:
    """The same area over array columns, without a shuffle; of f * p with ``by_frequency``."""
    value = (lambda z: z["f"] * z["p"]) if by_frequency else (lambda z: z["p"])
    inside = F.filter(F.arrays_zip(F.col(f).alias("f"), F.col(p).alias("p")), lambda z: z["f"].between(low, high))
    pairs = F.zip_with(F.slice(inside, 1, F.greatest(F.size(inside) - 1, F.lit(0))), F.slice(inside, 2, F.size(inside)), lambda a, b: (b["f"] - a["f"]) * (value(a) + value(b)) / 2)
    return F.when(F.size(inside) > 0, F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x))


def bandpower_of(spectra: DataFrame, bands: dict[str, tuple[float, float]]) -> DataFrame:
    """Adds each band's power to spectra whose f and p are arrays."""
    return spectra.withColumns({n: bandpower_array("f", "p", lo, hi) for n, (lo, hi) in bands.items()})


def alpha_features_of(spectra: DataFrame) -> DataFrame:
    """Adds what ``alpha_features`` gives to spectra whose f and p are arrays."""
    sums = bandpower_of(spectra, {"pow_slow_alpha": SLOW, "pow_fast_alpha": FAST, "pow_alpha_total": ALPHA})
    return _alpha_shares(sums.withColumn("paf_cog_hz", bandpower_array("f", "p", *ALPHA, True) / (F.col("pow_alpha_total") + EPS)))


def paf_cog(psd: DataFrame, keys: list[str], band: tuple[float, float] = ALPHA, method: str = "trapz") -> DataFrame:
    """Centre of gravity of the band, by areas or by sums over bins."""
    if method == "sum":
        inside = in_band("f", *band)
        return psd.where(inside).groupBy(*keys).agg((F.sum(F.col("f") * F.col("p")) / F.nullif(F.sum("p"), F.lit(0.0))).alias("paf_cog_hz"))
    fp, fp2 = F.col("f") * F.col("p"), F.col("f2") * F.col("p2")
    return with_next(psd, keys).groupBy(*keys).agg((trapz(*band, fp, fp2) / (trapz(*band) + EPS)).alias("paf_cog_hz"))


def alpha_features(psd: DataFrame, keys: list[str]) -> DataFrame:
    """Centre of gravity, slow, fast and total alpha power, their shares, ratio, log ratio, balance and slow fraction."""
    fp, fp2 = F.col("f") * F.col("p"), F.col("f2") * F.col("p2")
    sums = with_next(psd, keys).groupBy(*keys).agg(
        (trapz(*ALPHA, fp, fp2) / (trapz(*ALPHA) + EPS)).alias("paf_cog_hz"),
        trapz(*SLOW).alias("pow_slow_alpha"), trapz(*FAST).alias("pow_fast_alpha"), trapz(*ALPHA).alias("pow_alpha_total"),
    )
    return _alpha_shares(sums)


def _alpha_shares(sums: DataFrame) -> DataFrame:
    slow, fast, total = F.col("pow_slow_alpha"), F.col("pow_fast_alpha"), F.col("pow_alpha_total")
    return sums.withColumns(
        {
            "rel_slow_alpha": slow / (total + EPS), "rel_fast_alpha": fast / (total + EPS),
            "sf_ratio": slow / (fast + EPS), "sf_logratio": F.ln((slow + EPS) / (fast + EPS)),
            "sf_balance": (slow - fast) / (slow + fast + EPS), "slow_alpha_frac": slow / (slow + fast + EPS),
        }
    )


def psi_cog(features: DataFrame) -> DataFrame:
    return features.withColumn("psi_cog", F.col("sf_balance") * (F.col("paf_cog_hz") - 10.0))


def ga_features(long: DataFrame, keys: list[str]) -> DataFrame:
    return long.groupBy(*keys, "metric_name").agg(F.avg("metric_value").alias("metric_value"))


def deltas(long: DataFrame, keys: list[str], window: str = "window") -> DataFrame:
    """post - pre of each metric that a key has in both windows, as delta_<name>."""
    at = lambda w: F.max(F.when(F.col(window) == w, F.col("metric_value")))
    return long.groupBy(*keys, "metric_name").agg((at("post") - at("pre")).alias("metric_value")).where(F.col("metric_value").isNotNull()).withColumn("metric_name", F.concat(F.lit("delta_"), "metric_name"))


def noise_floor(psd: DataFrame, keys: list[str], band: tuple[float, float] = (45.0, 55.0)) -> DataFrame:
    """Of each key the median density of the band with 2 bins or more and a positive one, else a thousandth of the
    overall median; EPS at least."""
    inside = F.when(in_band("f", *band), F.col("p"))
    own = F.when(F.count_distinct(F.when(inside.isNotNull(), F.col("f"))) >= 2, F.median(inside))
    return psd.groupBy(*keys).agg(F.greatest(F.lit(EPS), F.when(own > 0, own).otherwise(1e-3 * F.median("p"))).alias("eps0"))


def erd_family(powers: DataFrame, floors: DataFrame, keys: list[str]) -> DataFrame:
    """(post - pre) / (pre + eps0) of slow, fast and total alpha, and delta_erd = slow - fast.

    powers: pre_slow, pre_fast, pre_alpha and post_*; floors: eps0 by ``keys``."""
    rows = powers.join(F.broadcast(floors) if floors.count() <= 100_000 else floors, keys)
    change = lambda b: (F.col(f"post_{b}") - F.col(f"pre_{b}")) / (F.col(f"pre_{b}") + F.col("eps0"))
    rows = rows.withColumns({"erd_slow": change("slow"), "erd_fast": change("fast"), "erd_pow_alpha_total": change("alpha")})
    return rows.withColumn("delta_erd", F.col("erd_slow") - F.col("erd_fast"))


def hazen(values: str, share: float) -> Column:
    """The percentile with midpoints (k - 1/2) / n, of an aggregate's sorted values."""
    v = F.array_sort(F.collect_list(values))
    at = F.lit(share) * F.size(v) + 0.5
    low = F.greatest(F.lit(1), F.least(F.floor(at).cast("int"), F.size(v)))
    high = F.least(low + 1, F.size(v))
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), at - low))
    return F.when(F.size(v) > 0, F.get(v, low - 1) * (1 - part) + F.get(v, high - 1) * part)


def p5_flag(powers: DataFrame, session: list[str], trial: list[str], value: str, share: float = 0.05, method: str = "linear") -> DataFrame:
    """Adds p5_flag (below the session's percentile, all units pooled) and ga_p5_flag (any unit of the trial)."""
    limit = hazen(value, share) if method == "hazen" else F.percentile(value, F.lit(share))
    rows = powers.join(powers.groupBy(*session).agg(limit.alias("_l")), session).withColumn("p5_flag", (F.col(value) < F.col("_l")).cast("int"))
    return rows.withColumn("ga_p5_flag", F.max("p5_flag").over(Window.partitionBy(*trial))).drop("_l")


def erd_guarded(powers: DataFrame, keys: list[str], pre: str, post: str, share: float = 0.05) -> DataFrame:
    """(post - pre) / pre, null at or under the percentile of its key or EPS."""
    limits = powers.groupBy(*keys).agg(F.percentile(pre, F.lit(share)).alias("_l"))
    ok = (F.col(pre) > F.col("_l")) & (F.col(pre) > EPS)
    return powers.join(limits, keys).withColumn("erd", F.when(ok, (F.col(post) - F.col(pre)) / F.col(pre))).drop("_l")


def tvi(values: DataFrame, keys: list[str], order: str, value: str, ddof: int = 1) -> DataFrame:
    """Mean squared successive difference over the variance, of three values or more; null for a constant."""
    rows = values.where(F.col(value).isNotNull())
    d = F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    var = F.var_samp if ddof else F.var_pop
    rows = rows.withColumn("_d", d * d).groupBy(*keys).agg(F.count("*").alias("n"), F.avg("_d").alias("mssd"), var(value).alias("variance"))
    return rows.withColumn("tvi", guarded(F.col("mssd") / F.nullif("variance", F.lit(0.0)), F.col("n"), 3, F.col("variance")))


def circ_mean(phase: str) -> Column:
    return F.atan2(F.avg(F.sin(phase)), F.avg(F.cos(phase)))


def resultant(phase: str) -> Column:
    c, s = F.avg(F.cos(phase)), F.avg(F.sin(phase))
    return F.sqrt(c * c + s * s)


def itc(phases: DataFrame, keys: list[str], time: str = "t_ms") -> DataFrame:
    """(keys, itc_mean, itc_peak, itc_peak_latency_ms): modulus of the mean phasor over trials, at each time."""
    at = phases.groupBy(*keys, time).agg(resultant("phase").alias("r"))
    return at.groupBy(*keys).agg(F.avg("r").alias("itc_mean"), F.max("r").alias("itc_peak"), F.max_by(time, F.struct(F.round("r", 9), -F.col(time))).alias("itc_peak_latency_ms"))


def rayleigh(phases: DataFrame, keys: list[str], least: int = 5) -> DataFrame:
    """(keys, n, r, z, p, mean_phase) with Mardia's approximation of p, clamped to [0, 1]."""
    rows = phases.where(F.col("phase").isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), resultant("phase").alias("r"), circ_mean("phase").alias("mean_phase")).where(F.col("n") >= least)
    z, n = F.col("n") * F.col("r") * F.col("r"), F.col("n")
    p = F.exp(-z) * (1 + (2 * z - z * z) / (4 * n) - (24 * z - 132 * z * z + 76 * z * z * z - 9 * z * z * z * z) / (288 * n * n))
    return rows.withColumns({"z": z, "p": F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))})


def rayleigh_summary(tests: DataFrame, keys: list[str], alpha: float = 0.05, p: str = "p") -> DataFrame:
    hit = F.count_if(F.col(p) < alpha)
    return tests.groupBy(*keys).agg(F.count("*").alias("n"), hit.alias("n_sig"), (100.0 * hit / F.count("*")).alias("pct_sig"), F.avg("r").alias("mean_r"), F.median("r").alias("median_r"))


def circ_lin_corr(phases: DataFrame, keys: list[str], phase: str = "phase", value: str = "rating", least: int = 10) -> DataFrame:
    """(keys, n, r_cl): circular-linear correlation; 0 where sine and cosine are collinear, null for few pairs or
    a constant."""
    rows = phases.where(F.col(phase).isNotNull() & F.col(value).isNotNull()).withColumns({"_s": F.sin(phase), "_c": F.cos(phase)})
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), guarded_corr(value, "_s").alias("xs"), guarded_corr(value, "_c").alias("xc"), guarded_corr("_s", "_c").alias("sc"))
    below = 1 - F.col("sc") * F.col("sc")
    above = F.col("xs") * F.col("xs") + F.col("xc") * F.col("xc") - 2 * F.col("xs") * F.col("xc") * F.col("sc")
    r = F.when(below < 1e-12, 0.0).otherwise(F.sqrt(F.greatest(F.lit(0.0), above / F.nullif(below, F.lit(0.0)))))
    complete = F.col("xs").isNotNull() & F.col("xc").isNotNull() & F.col("sc").isNotNull()
    return sums.select(*keys, "n", F.when((F.col("n") >= least) & complete, r).alias("r_cl"))


def ga_rcl(rcl: DataFrame, keys: list[str]) -> DataFrame:
    return rcl.groupBy(*keys).agg(F.avg("r_cl").alias("ga_phase_r_cl"), F.count("r_cl").alias("n_chans_r_cl"))


def evoked_peaks(samples: DataFrame, keys: list[str], n2: tuple[float, float], p2: tuple[float, float], time: str = "t_ms") -> DataFrame:
    """N2 is the least, P2 the greatest value of its window, at its first time; and their difference."""
    inside = lambda w: F.col(time).between(*w) & F.col("x").isNotNull()
    low, high = F.when(inside(n2), F.struct("x", time)), F.when(inside(p2), F.struct("x", -F.col(time)))
    rows = samples.groupBy(*keys).agg(F.min(F.when(inside(n2), F.col("x"))).alias("n2_amp"), F.min_by(time, low).alias("n2_lat_ms"), F.max(F.when(inside(p2), F.col("x"))).alias("p2_amp"), F.max_by(time, high).alias("p2_lat_ms"))
    return rows.withColumn("n2p2_amp", F.col("p2_amp") - F.col("n2_amp"))


def window_means(samples: DataFrame, keys: list[str], windows: dict[str, tuple[float, float]], time: str = "t_ms") -> DataFrame:
    return samples.groupBy(*keys).agg(*[F.avg(F.when(F.col(time).between(*w), F.col("x"))).alias(n) for n, w in windows.items()])


def evoked_ga(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Mean waveform over trials (partial sums in one pass), with the number of trials."""
    return samples.groupBy(*keys, "i").agg(F.avg("x").alias("x"), F.count("x").alias("n_trials"))


def grand_average(waves: DataFrame, subject: str, keys: list[str]) -> DataFrame:
    """Mean over subjects and their number; subjects whose number of samples isn't the commonest are left out."""
    sizes = waves.groupBy(subject, *keys).agg(F.count("*").alias("n"))
    common = sizes.groupBy(*keys, "n").agg(F.count("*").alias("k")).groupBy(*keys).agg(F.max_by("n", F.struct("k", "n")).alias("n"))
    fit = sizes.join(common, [*keys, "n"]).drop("n")
    return waves.join(fit, [subject, *keys], "left_semi").groupBy(*keys, "i").agg(F.avg("x").alias("x"), F.count_distinct(subject).alias("n_subjects"))


def channel_rms(samples: DataFrame, keys: list[str]) -> DataFrame:
    return samples.groupBy(*keys).agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"), F.stddev_samp("x").alias("sd"))


def suggest_bad_channels(samples: DataFrame, recording: list[str], unit: str = "unit", limit: float = 5.0, bins: int = 100) -> DataFrame:
    """(recording, unit, z_kurtosis, z_probability, reasons): kurtosis and mean log-probability against the other
    channels'; probabilities come from an equal-width histogram over the channel."""
    keys = [*recording, unit]
    own = samples.groupBy(*keys).agg(F.kurtosis("x").alias("kurt"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("x").alias("n"))
    place = F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins))
    counts = samples.join(own, keys).groupBy(*keys, place.alias("b")).agg(F.count("*").alias("c"), F.first("n").alias("n"))
    logp = counts.groupBy(*keys).agg((F.sum(F.col("c") * F.ln(F.col("c") / F.col("n"))) / F.max("n")).alias("logp"))
    w = Window.partitionBy(*recording)
    z = lambda c: (F.col(c) - F.avg(c).over(w)) / F.nullif(F.stddev_samp(c).over(w), F.lit(0.0))
    rows = own.join(logp, keys).select(*keys, z("kurt").alias("z_kurtosis"), z("logp").alias("z_probability"))
    why = F.concat_ws(" + ", F.when(F.abs("z_kurtosis") > limit, "kurtosis"), F.when(F.abs("z_probability") > limit, "probability"))
    return rows.withColumn("reasons", F.nullif(why, F.lit("")))


def kurtosis_z(samples: DataFrame, recording: list[str], unit: str = "unit") -> DataFrame:
    own = samples.groupBy(*recording, unit).agg(F.kurtosis("x").alias("kurt"))
    w = Window.partitionBy(*recording)
    return own.withColumn("z", (F.col("kurt") - F.avg("kurt").over(w)) / F.nullif(F.stddev_samp("kurt").over(w), F.lit(0.0)))


def channel_psd_ratios(psd: DataFrame, keys: list[str], line: tuple[float, float], high: tuple[float, float], drift: tuple[float, float], alpha: tuple[float, float] = (8.0, 13.0), base: tuple[float, float] = (1.0, 30.0)) -> DataFrame:
    """Areas of half-open bands over that of ``base``."""
    rows = with_next(psd, keys).groupBy(*keys)
    area = lambda b: F.coalesce(trapz(*b, half_open=True), F.lit(0.0))
    return rows.agg(*[(area(b) / F.greatest(area(base), F.lit(EPS))).alias(n) for n, b in (("line_ratio", line), ("hf_ratio", high), ("drift_ratio", drift), ("alpha_ratio", alpha))])


COMPONENT_BANDS = {"delta": (1.0, 4.0), "theta": (4.0, 8.0), "alpha": (8.0, 13.0), "beta": (13.0, 30.0), "gamma": (30.0, 33.0)}


def component_psd_metrics(psd: DataFrame, keys: list[str], peak: tuple[float, float] = (0.5, 40.0)) -> DataFrame:
    top = F.max_by("f", F.when(F.col("f").between(*peak), F.struct("p", -F.col("f"))))
    bands = [F.coalesce(trapz(*b, half_open=True), F.lit(0.0)).alias(n) for n, b in COMPONENT_BANDS.items()]
    return with_next(psd, keys).groupBy(*keys).agg(top.alias("peak_hz"), *bands)


def bandwidth_proxy(psd: DataFrame, keys: list[str], band: tuple[float, float] = ALPHA) -> DataFrame:
    """Power-weighted spread about the centre of gravity of the bins."""
    rows = psd.where(in_band("f", *band))
    s0, s1, s2 = F.sum("p"), F.sum(F.col("f") * F.col("p")), F.sum(F.col("f") * F.col("f") * F.col("p"))
    mean = s1 / (s0 + EPS)
    return rows.groupBy(*keys).agg(F.sqrt(F.greatest(F.lit(0.0), (s2 - 2 * mean * s1 + mean * mean * s0) / (s0 + EPS))).alias("bandwidth"))


def alpha_peak_fill(psd: DataFrame, fits: DataFrame, keys: list[str], band: tuple[float, float] = ALPHA) -> DataFrame:
    """Adds filled cf, pw, bw and their source: the fit's, else the highest bin's (bw: between the nearest bins under half
    of it), else the centre of gravity."""
    rows = psd.where(in_band("f", *band))
    top = rows.groupBy(*keys).agg(F.max_by("f", F.struct("p", -F.col("f"))).alias("pf"), F.max("p").alias("pp"), (F.sum(F.col("f") * F.col("p")) / F.nullif(F.sum("p"), F.lit(0.0))).alias("cog"))
    under = F.col("p") <= F.col("pp") / 2
    near = rows.join(top, keys).groupBy(*keys).agg(F.max(F.when(under & (F.col("f") < F.col("pf")), F.col("f"))).alias("left"), F.min(F.when(under & (F.col("f") > F.col("pf")), F.col("f"))).alias("right"))
    out = fits.join(top, keys, "left").join(near, keys, "left")
    return out.select(
        *keys,
        F.coalesce("alpha_cf", "pf", "cog").alias("cf_filled"), F.coalesce("alpha_pw", "pp").alias("pw_filled"), F.coalesce("alpha_bw", F.col("right") - F.col("left")).alias("bw_filled"),
        F.when(F.col("alpha_cf").isNotNull(), "fit").when(F.col("pf").isNotNull(), "argmax").when(F.col("cog").isNotNull(), "cog").otherwise("missing").alias("source"),
    )


def erd_ga(samples: DataFrame, fs: float, windows: dict[str, tuple[int, int]], keys: list[str]) -> DataFrame:
    """ERD of slow and fast alpha on the trial-mean waveform, with EPS as the only guard."""
    from cadenza.operators.signals import collect_samples, psd_long, windowed_psd

    mean = collect_samples(samples.groupBy(*keys, "i").agg(F.avg("x").alias("x")), keys)
    powers = bandpower(psd_long(windowed_psd(mean, fs, windows, 1.0)), [*keys, "window"], {"slow": SLOW, "fast": FAST})
    at = lambda b, w: F.max(F.when(F.col("window") == w, F.col(b)))
    change = lambda b: F.when(at(b, "pre") > EPS, (at(b, "post") - at(b, "pre")) / F.nullif(at(b, "pre"), F.lit(0.0)))
    return powers.groupBy(*keys).agg(change("slow").alias("erd_slow"), change("fast").alias("erd_fast"))


def baseline_covariance(samples: DataFrame, keys: list[str], last: int) -> DataFrame:
    """(keys, unit_a, unit_b, cov) over samples up to ``last``; a pair of units is one row of an aggregate."""
    rows = samples.where(F.col("i") <= last)
    both = rows.select(*keys, "i", F.col("unit").alias("unit_a"), F.col("x").alias("a")).join(rows.select(*keys, "i", F.col("unit").alias("unit_b"), F.col("x").alias("b")), [*keys, "i"]).where("unit_a <= unit_b")
    return both.groupBy(*[k for k in keys if k != "trial"], "unit_a", "unit_b").agg(F.covar_samp("a", "b").alias("cov"))


def spectrum_and_residual(psd: DataFrame, lines: DataFrame, keys: list[str], trial: list[str]) -> tuple[DataFrame, DataFrame]:
    """(mean spectrum, aperiodic line and flattened spectrum in dB by bin; RMSE in dB by trial). lines: offset and
    exponent by ``trial``."""
    rows = psd.where((F.col("f") > 0) & (F.col("p") > 0)).join(lines, trial)
    rows = rows.withColumns({"db": 10 * F.log10("p"), "line_db": 10 * (F.col("offset") - F.col("exponent") * F.log10("f"))})
    mean = rows.groupBy(*keys, "f").agg(F.avg("db").alias("mean_db"), F.avg("line_db").alias("line_db"), F.avg(F.col("db") - F.col("line_db")).alias("flat_db"))
    error = F.sqrt(F.avg((F.col("db") - F.col("line_db")) * (F.col("db") - F.col("line_db"))))
    return mean, rows.groupBy(*trial).agg(error.alias("rmse_db"))


def flag_rate(df: DataFrame, keys: list[str], flag: str) -> DataFrame:
    return df.groupBy(*keys).agg((100.0 * F.avg(F.col(flag).cast("double"))).alias("pct"))


def merge_feature_sets(sets: list[DataFrame], keys: list[str]) -> DataFrame:
    """Long sets of metrics; of a metric that several have, the last set's value stays."""
    tagged = [s.select(*keys, "metric_name", "metric_value", F.lit(i).alias("_p")) for i, s in enumerate(sets)]
    return reduce(DataFrame.unionAll, tagged).groupBy(*keys, "metric_name").agg(F.max_by("metric_value", "_p").alias("metric_value"))
