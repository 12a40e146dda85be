"""Queries of spectra, features, phase, evoked responses and signal jobs."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from cadenza.operators import features as E
from cadenza.operators import signals as J
from cadenza.operators import windows as W
from cadenza.plans import views as V
from cadenza.plans.spec import q

IDS = ["subject", "trial", "unit"]
HALVES = {"pre": (0, 32), "post": (32, 64)}
N2, P2 = (100.0, 300.0), (250.0, 450.0)


def tz(lo, hi, a="p", b="p2", half=False, table=""):
    """The SQL of an area over a band."""
    inside = lambda f: f"({f} >= {lo} AND {f} < {hi})" if half else f"{f} BETWEEN {lo} AND {hi}"
    return f"CASE WHEN count(CASE WHEN {inside('f')} THEN 1 END) > 0 THEN coalesce(sum(CASE WHEN {inside('f')} AND {inside('f2')} THEN (f2 - f) * ({a} + {b}) / 2 END), 0) END"


def seg(source, keys):
    return f"seg AS (SELECT *, lead(f) OVER w AS f2, lead(p) OVER w AS p2 FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY f))"


SEG = seg("psd", "subject, trial, unit")
WSEG = seg("win_psd", 'subject, trial, unit, "window"')
POWERS = f'pw AS (SELECT subject, trial, unit, "window", {tz(8, 10)} AS slow, {tz(10, 12)} AS fast, {tz(8, 12)} AS alpha FROM seg GROUP BY ALL)'
WIDE = """wide AS (SELECT subject, trial, unit, """ + ", ".join(f"""max({b}) FILTER ("window" = '{w}') AS {w}_{b}""" for w in ("pre", "post") for b in ("slow", "fast", "alpha")) + " FROM pw GROUP BY ALL)"
COG = f"({tz(8, 12, 'f * p', 'f2 * p2')}) / (({tz(8, 12)}) + 1e-12)"
FEAT = f"""feat AS (SELECT *, (slow - fast) / (slow + fast + 1e-12) AS sf_balance FROM (SELECT subject, trial, unit, {COG} AS cog, {tz(8, 10)} AS slow, {tz(10, 12)} AS fast, {tz(8, 12)} AS total FROM seg GROUP BY ALL))"""


def win_psd(s, d):
    return J.psd_long(J.windowed_psd(V.signals(s, d), V.FS, HALVES, 1.0))


def powers(s, d):
    rows = E.bandpower_of(J.windowed_psd(V.signals(s, d), V.FS, HALVES, 1.0), {"slow": E.SLOW, "fast": E.FAST, "alpha": E.ALPHA})
    at = lambda w, b: F.max(F.when(F.col("window") == w, F.col(b))).alias(f"{w}_{b}")
    return rows.groupBy(*IDS).agg(*[at(w, b) for w in ("pre", "post") for b in ("slow", "fast", "alpha")])


def features(s, d):
    return E.psi_cog(E.alpha_features_of(spectra(s, d)).drop("f", "p", "samples"))


def spectra(s, d):
    """The spectra of ``views.psd``, arrays still."""
    return J.welch_psd(V.signals(s, d), V.FS, 1.0, 0.5)


def phases_at(s, d):
    """A phase at every sample that needs no filter: the sample's value as an angle."""
    return V.samples(s, d).withColumn("phase", F.col("x") * 2 * math.pi)


def rotation(s):
    return s.createDataFrame([("ch0", "a", 0.5), ("ch1", "a", 0.5), ("ch2", "b", 1.0), ("ch3", "b", -1.0)], "unit_in string, unit_out string, w double")


def by_channel(s, d):
    """One wave a channel and subject: the mean over its trials."""
    return V.samples(s, d).groupBy("subject", "unit", "i").agg(F.avg("x").alias("x"))


def waves(s, d):
    """The same as arrays."""
    return J.collect_samples(by_channel(s, d), ["subject", "unit"])


def channels_long(signals):
    return signals.select("subject", "unit", F.posexplode("samples").alias("i", "x")).withColumn("i", F.col("i").cast("long"))


CHAN = "chan AS (SELECT subject, unit, i, avg(x) AS x FROM samples GROUP BY ALL)"
LINES = """line AS (SELECT subject, trial, unit, regr_intercept(log10(p), log10(f)) AS o, -regr_slope(log10(p), log10(f)) AS e, regr_r2(log10(p), log10(f)) AS r2 FROM psd WHERE f BETWEEN 2 AND 30 AND p > 0 GROUP BY ALL)"""


def lines(s, d):
    return J.aperiodic_line(V.psd(s, d), IDS, 2.0, 30.0)


QUERIES = {
    "j1_welch_psd": q(lambda s, d: V.psd(s, d), "subject trial unit", "f p", "SELECT * FROM psd", "psd"),
    "j2_windowed_psd": q(win_psd, "subject trial unit window", "f p", "SELECT * FROM win_psd", "win_psd"),
    "e1_ga_psd": q(lambda s, d: E.ga_psd(V.psd(s, d), ["subject", "unit"]), "subject unit", "f p", "SELECT subject, unit, f, avg(p) AS p FROM psd GROUP BY ALL", "psd"),
    "e2_bandpower": q(lambda s, d: E.bandpower_of(spectra(s, d), {"theta": (4.0, 8.0), "alpha": (8.0, 12.0), "none": (40.0, 50.0)}), "subject trial unit", "theta alpha none", f"WITH {SEG} SELECT subject, trial, unit, {tz(4, 8)} AS theta, {tz(8, 12)} AS alpha, {tz(40, 50)} AS none FROM seg GROUP BY ALL", "psd"),
    "e3_paf_cog": q(lambda s, d: spectra(s, d).withColumn("paf_cog_hz", E.bandpower_array("f", "p", *E.ALPHA, True) / (E.bandpower_array("f", "p", *E.ALPHA) + E.EPS)), "subject trial unit", "paf_cog_hz", f"WITH {SEG} SELECT subject, trial, unit, {COG} AS paf_cog_hz FROM seg GROUP BY ALL", "psd"),
    "e3_paf_cog_sum": q(lambda s, d: E.paf_cog(V.psd(s, d), IDS, method="sum"), "subject trial unit", "paf_cog_hz", "SELECT subject, trial, unit, sum(f * p) / sum(p) AS paf_cog_hz FROM psd WHERE f BETWEEN 8 AND 12 GROUP BY ALL", "psd"),
    "e4_alpha_features": q(features, "subject trial unit", "paf_cog_hz pow_slow_alpha pow_fast_alpha pow_alpha_total rel_slow_alpha rel_fast_alpha sf_ratio sf_logratio sf_balance slow_alpha_frac", f"WITH {SEG}, {FEAT} SELECT subject, trial, unit, cog AS paf_cog_hz, slow AS pow_slow_alpha, fast AS pow_fast_alpha, total AS pow_alpha_total, slow / (total + 1e-12) AS rel_slow_alpha, fast / (total + 1e-12) AS rel_fast_alpha, slow / (fast + 1e-12) AS sf_ratio, ln((slow + 1e-12) / (fast + 1e-12)) AS sf_logratio, sf_balance, slow / (slow + fast + 1e-12) AS slow_alpha_frac FROM feat", "psd"),
    "e5_psi_cog": q(features, "subject trial unit", "psi_cog", f"WITH {SEG}, {FEAT} SELECT subject, trial, unit, sf_balance * (cog - 10) AS psi_cog FROM feat", "psd"),
    "e6_ga_features": q(lambda s, d: E.ga_features(V.metrics_long(s, d), ["subject", "trial"]), "subject trial metric_name", "metric_value", "SELECT subject, trial, metric_name, avg(metric_value) AS metric_value FROM metrics_long GROUP BY ALL", "metrics_long"),
    "e7_erd_family": q(lambda s, d: E.erd_family(powers(s, d), E.noise_floor(win_psd(s, d), ["subject"], (24.0, 32.0)), ["subject"]), "subject trial unit", "erd_slow erd_fast erd_pow_alpha_total delta_erd", f"WITH {WSEG}, {POWERS}, {WIDE}, fl AS (SELECT subject, greatest(1e-12, CASE WHEN count(DISTINCT f) FILTER (f BETWEEN 24 AND 32) >= 2 AND median(p) FILTER (f BETWEEN 24 AND 32) > 0 THEN median(p) FILTER (f BETWEEN 24 AND 32) ELSE 1e-3 * median(p) END) AS e FROM win_psd GROUP BY subject), x AS (SELECT subject, trial, unit, (post_slow - pre_slow) / (pre_slow + e) AS a, (post_fast - pre_fast) / (pre_fast + e) AS b, (post_alpha - pre_alpha) / (pre_alpha + e) AS c FROM wide JOIN fl USING (subject)) SELECT subject, trial, unit, a AS erd_slow, b AS erd_fast, c AS erd_pow_alpha_total, a - b AS delta_erd FROM x", "win_psd"),
    "e8_noise_floor": q(lambda s, d: E.noise_floor(V.psd(s, d), ["subject"], (28.0, 32.0)), "subject", "eps0", "SELECT subject, greatest(1e-12, coalesce(median(p) FILTER (f BETWEEN 28 AND 32), 1e-3 * median(p))) AS eps0 FROM psd GROUP BY subject", "psd"),
    "e9_p5_flag": q(lambda s, d: E.p5_flag(powers(s, d), ["subject"], ["subject", "trial"], "pre_alpha", 0.25), "subject trial unit p5_flag ga_p5_flag", "", f"WITH {WSEG}, {POWERS}, {WIDE}, l AS (SELECT subject, quantile_cont(pre_alpha, 0.25) AS l FROM wide GROUP BY subject), x AS (SELECT *, (pre_alpha < l)::INT AS p5_flag FROM wide JOIN l USING (subject)) SELECT subject, trial, unit, p5_flag, max(p5_flag) OVER (PARTITION BY subject, trial) AS ga_p5_flag FROM x", "win_psd"),
    "e10_erd_guarded": q(lambda s, d: E.erd_guarded(powers(s, d), ["subject", "unit"], "pre_slow", "post_slow", 0.1), "subject trial unit", "erd", f"WITH {WSEG}, {POWERS}, {WIDE}, l AS (SELECT subject, unit, quantile_cont(pre_slow, 0.1) AS l FROM wide GROUP BY ALL) SELECT subject, trial, unit, CASE WHEN pre_slow > l AND pre_slow > 1e-12 THEN (post_slow - pre_slow) / pre_slow END AS erd FROM wide JOIN l USING (subject, unit)", "win_psd"),
    "e11_erd_ga": q(lambda s, d: E.erd_ga(V.samples(s, d), V.FS, HALVES, ["subject", "unit"]), "subject unit", "erd_slow erd_fast"),
    "e12_tvi": q(lambda s, d: E.tvi(V.trials(s, d), ["subject", "unit"], "trial", "pain_rating"), "subject unit n", "tvi", "WITH x AS (SELECT subject, unit, pain_rating, pow(pain_rating - lag(pain_rating) OVER (PARTITION BY subject, unit ORDER BY trial), 2) AS d FROM trials WHERE pain_rating IS NOT NULL) SELECT subject, unit, count(*) AS n, avg(d) AS mssd, CASE WHEN count(*) >= 3 AND var_samp(pain_rating) > 0 THEN avg(d) / var_samp(pain_rating) END AS tvi FROM x GROUP BY ALL", "trials"),
    "e13_circ_mean": q(lambda s, d: V.phase(s, d).groupBy("subject", "unit").agg(E.circ_mean("phase").alias("mean_phase")), "subject unit", "mean_phase", "SELECT subject, unit, atan2(avg(sin(phase)), avg(cos(phase))) AS mean_phase FROM phase GROUP BY ALL", "phase"),
    "e14_itc": q(lambda s, d: E.itc(phases_at(s, d), ["subject", "unit"]), "subject unit", "itc_mean itc_peak itc_peak_latency_ms", "WITH r AS (SELECT subject, unit, t_ms, sqrt(pow(avg(cos(x * 2 * pi())), 2) + pow(avg(sin(x * 2 * pi())), 2)) AS r FROM samples GROUP BY ALL) SELECT subject, unit, avg(r) AS itc_mean, max(r) AS itc_peak, arg_max(t_ms, (round(r, 9), -t_ms)) AS itc_peak_latency_ms FROM r GROUP BY ALL", "samples"),
    "e15_rayleigh": q(lambda s, d: E.rayleigh(V.phase(s, d), ["subject", "unit"]), "subject unit n", "r z p mean_phase", "WITH x AS (SELECT subject, unit, count(*) AS n, sqrt(pow(avg(cos(phase)), 2) + pow(avg(sin(phase)), 2)) AS r, atan2(avg(sin(phase)), avg(cos(phase))) AS mean_phase FROM phase GROUP BY ALL HAVING count(*) >= 5), y AS (SELECT *, n * r * r AS z FROM x) SELECT subject, unit, n, r, z, mean_phase, greatest(0, least(1, exp(-z) * (1 + (2*z - z*z) / (4*n) - (24*z - 132*z*z + 76*z*z*z - 9*z*z*z*z) / (288*n*n)))) AS p FROM y", "phase"),
    "e16_rayleigh_summary": q(lambda s, d: E.rayleigh_summary(E.rayleigh(V.phase(s, d), ["subject", "unit"]), ["unit"], 0.3), "unit n n_sig", "pct_sig mean_r median_r", "WITH x AS (SELECT subject, unit, count(*) AS n, sqrt(pow(avg(cos(phase)), 2) + pow(avg(sin(phase)), 2)) AS r FROM phase GROUP BY ALL HAVING count(*) >= 5), y AS (SELECT *, n * r * r AS z FROM x), w AS (SELECT *, greatest(0, least(1, exp(-z) * (1 + (2*z - z*z) / (4*n) - (24*z - 132*z*z + 76*z*z*z - 9*z*z*z*z) / (288*n*n)))) AS p FROM y) SELECT unit, count(*) AS n, count(*) FILTER (p < 0.3) AS n_sig, 100.0 * count(*) FILTER (p < 0.3) / count(*) AS pct_sig, avg(r) AS mean_r, median(r) AS median_r FROM w GROUP BY unit", "phase"),
    "e17_circ_lin_corr": q(lambda s, d: E.circ_lin_corr(V.phase(s, d), ["subject", "unit"]), "subject unit n", "r_cl", "WITH c AS (SELECT subject, unit, count(*) AS n, corr(rating, sin(phase)) AS xs, corr(rating, cos(phase)) AS xc, corr(sin(phase), cos(phase)) AS sc FROM phase GROUP BY ALL) SELECT subject, unit, n, CASE WHEN n >= 10 THEN sqrt(greatest(0, (xs*xs + xc*xc - 2*xs*xc*sc) / (1 - sc*sc))) END AS r_cl FROM c", "phase"),
    "e18_ga_rcl": q(lambda s, d: E.ga_rcl(E.circ_lin_corr(V.phase(s, d), ["subject", "unit"]), ["subject"]), "subject n_chans_r_cl", "ga_phase_r_cl", "WITH c AS (SELECT subject, unit, count(*) AS n, corr(rating, sin(phase)) AS xs, corr(rating, cos(phase)) AS xc, corr(sin(phase), cos(phase)) AS sc FROM phase GROUP BY ALL), r AS (SELECT subject, CASE WHEN n >= 10 THEN sqrt(greatest(0, (xs*xs + xc*xc - 2*xs*xc*sc) / (1 - sc*sc))) END AS r FROM c) SELECT subject, avg(r) AS ga_phase_r_cl, count(r) AS n_chans_r_cl FROM r GROUP BY subject", "phase"),
    "e19_evoked_peaks": q(lambda s, d: E.evoked_peaks(V.samples(s, d), IDS, N2, P2), "subject trial unit", "n2_amp n2_lat_ms p2_amp p2_lat_ms n2p2_amp", "SELECT subject, trial, unit, min(x) FILTER (t_ms BETWEEN 100 AND 300) AS n2_amp, arg_min(t_ms, (x, t_ms)) FILTER (t_ms BETWEEN 100 AND 300) AS n2_lat_ms, max(x) FILTER (t_ms BETWEEN 250 AND 450) AS p2_amp, arg_max(t_ms, (x, -t_ms)) FILTER (t_ms BETWEEN 250 AND 450) AS p2_lat_ms, max(x) FILTER (t_ms BETWEEN 250 AND 450) - min(x) FILTER (t_ms BETWEEN 100 AND 300) AS n2p2_amp FROM samples GROUP BY ALL", "samples"),
    "e20_window_means": q(lambda s, d: E.window_means(V.samples(s, d), IDS, {"n2_mean": N2, "p2_mean": P2}), "subject trial unit", "n2_mean p2_mean", "SELECT subject, trial, unit, avg(x) FILTER (t_ms BETWEEN 100 AND 300) AS n2_mean, avg(x) FILTER (t_ms BETWEEN 250 AND 450) AS p2_mean FROM samples GROUP BY ALL", "samples"),
    "e21_evoked_ga": q(lambda s, d: E.evoked_ga(V.samples(s, d), ["subject", "unit"]), "subject unit i n_trials", "x", "SELECT subject, unit, i, avg(x) AS x, count(*) AS n_trials FROM samples GROUP BY ALL", "samples"),
    "e22_grand_average": q(lambda s, d: E.grand_average(by_channel(s, d).where("i < 60 OR subject <> 3"), "subject", ["unit"]), "unit i n_subjects", "x", f"WITH {CHAN} SELECT unit, i, avg(x) AS x, count(DISTINCT subject) AS n_subjects FROM chan WHERE subject <> 3 GROUP BY ALL", "samples"),
    "e23_running_mean": q(lambda s, d: E.evoked_ga(V.samples(s, d), ["unit"]), "unit i n_trials", "x", "SELECT unit, i, avg(x) AS x, count(*) AS n_trials FROM samples GROUP BY ALL", "samples"),
    "e24_channel_rms": q(lambda s, d: E.channel_rms(V.samples(s, d), ["subject", "unit"]), "subject unit", "rms sd", "SELECT subject, unit, sqrt(avg(x * x)) AS rms, stddev_samp(x) AS sd FROM samples GROUP BY ALL", "samples"),
    "e25_kurtosis_z": q(lambda s, d: E.kurtosis_z(V.samples(s, d), ["subject"]), "subject unit", "kurt z", "WITH k AS (SELECT subject, unit, kurtosis_pop(x) AS kurt FROM samples GROUP BY ALL) SELECT subject, unit, kurt, (kurt - avg(kurt) OVER w) / stddev_samp(kurt) OVER w AS z FROM k WINDOW w AS (PARTITION BY subject)", "samples"),
    "e25_bad_channels": q(lambda s, d: E.suggest_bad_channels(V.samples(s, d), ["subject"], limit=1.0), "subject unit reasons", "z_kurtosis z_probability"),
    "e26_channel_ratios": q(lambda s, d: E.channel_psd_ratios(V.psd(s, d), IDS, (24.0, 27.0), (20.0, 32.0), (0.0, 2.0)), "subject trial unit", "line_ratio hf_ratio drift_ratio alpha_ratio", f"WITH {SEG} SELECT subject, trial, unit, " + ", ".join(f"coalesce({tz(a, b, half=True)}, 0) / greatest(coalesce({tz(1, 30, half=True)}, 0), 1e-12) AS {n}" for n, a, b in (("line_ratio", 24, 27), ("hf_ratio", 20, 32), ("drift_ratio", 0, 2), ("alpha_ratio", 8, 13))) + " FROM seg GROUP BY ALL", "psd"),
    "e27_component_metrics": q(lambda s, d: E.component_psd_metrics(V.psd(s, d), IDS), "subject trial unit", "peak_hz delta theta alpha beta gamma", f"WITH {SEG} SELECT subject, trial, unit, arg_max(f, (p, -f)) FILTER (f BETWEEN 0.5 AND 40) AS peak_hz, " + ", ".join(f"coalesce({tz(*b, half=True)}, 0) AS {n}" for n, b in E.COMPONENT_BANDS.items()) + " FROM seg GROUP BY ALL", "psd"),
    "e28_bandwidth": q(lambda s, d: E.bandwidth_proxy(V.psd(s, d), IDS), "subject trial unit", "bandwidth", "WITH m AS (SELECT subject, trial, unit, sum(f * p) / (sum(p) + 1e-12) AS mu FROM psd WHERE f BETWEEN 8 AND 12 GROUP BY ALL) SELECT subject, trial, unit, sqrt(sum(p * (f - mu) * (f - mu)) / (sum(p) + 1e-12)) AS bandwidth FROM psd JOIN m USING (subject, trial, unit) WHERE f BETWEEN 8 AND 12 GROUP BY ALL", "psd"),
    "e29_alpha_peak_fill": q(
        lambda s, d: E.alpha_peak_fill(V.psd(s, d), V.signals(s, d).selectExpr("subject", "trial", "unit", "if(trial % 3 = 0, 9.5D, null) AS alpha_cf", "if(trial % 3 = 0, 1D, null) AS alpha_pw", "if(trial % 3 = 0, 2D, null) AS alpha_bw"), IDS),
        "subject trial unit source", "cf_filled pw_filled bw_filled",
        "WITH t AS (SELECT subject, trial, unit, arg_max(f, (p, -f)) AS pf, max(p) AS pp FROM psd WHERE f BETWEEN 8 AND 12 GROUP BY ALL), n AS (SELECT subject, trial, unit, pf, pp, max(f) FILTER (p <= pp / 2 AND f < pf) AS l, min(f) FILTER (p <= pp / 2 AND f > pf) AS r FROM psd JOIN t USING (subject, trial, unit) WHERE f BETWEEN 8 AND 12 GROUP BY ALL) SELECT subject, trial, unit, CASE WHEN trial % 3 = 0 THEN 'fit' ELSE 'argmax' END AS source, CASE WHEN trial % 3 = 0 THEN 9.5 ELSE pf END AS cf_filled, CASE WHEN trial % 3 = 0 THEN 1 ELSE pp END AS pw_filled, CASE WHEN trial % 3 = 0 THEN 2 ELSE r - l END AS bw_filled FROM n", "psd",
    ),
    "e45_baseline_covariance": q(lambda s, d: E.baseline_covariance(by_channel(s, d), ["subject"], 31), "subject unit_a unit_b", "cov", f"WITH {CHAN} SELECT a.subject, a.unit AS unit_a, b.unit AS unit_b, covar_samp(a.x, b.x) AS cov FROM chan a JOIN chan b ON a.subject = b.subject AND a.i = b.i AND a.unit <= b.unit WHERE a.i <= 31 GROUP BY ALL", "samples"),
    "e46_mean_spectrum": q(lambda s, d: E.spectrum_and_residual(V.psd(s, d), lines(s, d), ["subject"], IDS)[0], "subject", "f mean_db line_db flat_db", f"WITH {LINES} SELECT subject, f, avg(10 * log10(p)) AS mean_db, avg(10 * (o - e * log10(f))) AS line_db, avg(10 * log10(p) - 10 * (o - e * log10(f))) AS flat_db FROM psd JOIN line USING (subject, trial, unit) WHERE f > 0 AND p > 0 GROUP BY ALL", "psd"),
    "e46_residual": q(lambda s, d: E.spectrum_and_residual(V.psd(s, d), lines(s, d), ["subject"], IDS)[1], "subject trial unit", "rmse_db", f"WITH {LINES} SELECT subject, trial, unit, sqrt(avg(pow(10 * log10(p) - 10 * (o - e * log10(f)), 2))) AS rmse_db FROM psd JOIN line USING (subject, trial, unit) WHERE f > 0 AND p > 0 GROUP BY ALL", "psd"),
    "b19_deltas": q(lambda s, d: E.deltas(E.bandpower(win_psd(s, d), [*IDS, "window"], {"slow": E.SLOW, "alpha": E.ALPHA}).unpivot([*IDS, "window"], ["slow", "alpha"], "metric_name", "metric_value"), IDS), "subject trial unit metric_name", "metric_value", f"WITH {WSEG}, {POWERS}, {WIDE} SELECT subject, trial, unit, 'delta_slow' AS metric_name, post_slow - pre_slow AS metric_value FROM wide UNION ALL SELECT subject, trial, unit, 'delta_alpha', post_alpha - pre_alpha FROM wide", "win_psd"),
    "f14_trapz_segments": q(lambda s, d: W.trapz_segments(V.psd(s, d), IDS, "f", "p"), "subject trial unit", "f area", f"WITH {SEG} SELECT subject, trial, unit, f, (f2 - f) * (p + p2) / 2 AS area FROM seg", "psd"),
    "j3_spectrogram": q(lambda s, d: J.spectrogram_ga(V.signals(s, d), V.FS, 32, 16, V.T0_MS), "subject trial", "f t_ms p db", 'SELECT subject, trial, 2.0 * k AS f, CASE g WHEN 0 THEN -250.0 WHEN 1 THEN 0.0 ELSE 250.0 END AS t_ms, avg(re * re + im * im) AS p, 10 * log10(avg(re * re + im * im) + 1e-12) AS db FROM (SELECT subject, trial, unit, g, k, sum(x * (0.54 - 0.46 * cos(2 * pi() * (i - 16 * g) / 31)) * cos(2 * pi() * k * (i - 16 * g) / 32)) AS re, sum(x * (0.54 - 0.46 * cos(2 * pi() * (i - 16 * g) / 31)) * sin(2 * pi() * k * (i - 16 * g) / 32)) AS im FROM samples, range(3) AS a(g), range(17) AS b(k) WHERE i BETWEEN 16 * g AND 16 * g + 31 GROUP BY ALL) GROUP BY ALL', "samples"),
    "j4_bandpass": q(lambda s, d: J.explode_samples(J.notch(J.bandpass(V.signals(s, d), V.FS, 1.0, 20.0, 33), V.FS, 25.0, 1.0, 33), V.FS), "subject trial unit i", "x"),
    "j5_resample": q(lambda s, d: J.explode_samples(J.resample(V.signals(s, d), V.FS, 32.0), 32.0), "subject trial unit i", "x"),
    "j6_rereference": q(lambda s, d: J.rereference(by_channel(s, d), ["subject"]), "subject unit i", "x", f"WITH {CHAN} SELECT subject, unit, i, x - avg(x) OVER (PARTITION BY subject, i) AS x FROM chan", "samples"),
    "j7_baseline": q(lambda s, d: J.explode_samples(J.baseline_correct(V.signals(s, d), 0, 31), V.FS), "subject trial unit i", "x", "SELECT subject, trial, unit, i, x - avg(x) FILTER (i <= 31) OVER (PARTITION BY subject, trial, unit) AS x FROM samples", "samples"),
    "j8_hilbert_phase": q(lambda s, d: J.hilbert_phase(V.signals(s, d), V.FS, 8.0, 10.0, V.STIMULUS, 33), "subject trial unit", "phase"),
    "j9_apply_linear": q(lambda s, d: channels_long(J.apply_matrix(waves(s, d), rotation(s), ["subject"])), "subject unit i", "x", f"WITH {CHAN}, k(unit, o, w) AS (VALUES ('ch0','a',0.5),('ch1','a',0.5),('ch2','b',1.0),('ch3','b',-1.0)) SELECT subject, o AS unit, i, sum(w * x) AS x FROM chan JOIN k USING (unit) GROUP BY ALL", "samples"),
    "j10_remove_components": q(
        lambda s, d: channels_long(J.remove_parts(waves(s, d), rotation(s), s.createDataFrame([("a", "ch0", 0.9), ("a", "ch1", 0.3), ("b", "ch2", 0.2)], "unit_in string, unit_out string, w double"), ["a"], ["subject"])),
        "subject unit i", "x", f"WITH {CHAN}, c AS (SELECT subject, i, 0.5 * sum(x) AS a FROM chan WHERE unit IN ('ch0', 'ch1') GROUP BY ALL) SELECT subject, unit, i, x - CASE unit WHEN 'ch0' THEN 0.9 * a WHEN 'ch1' THEN 0.3 * a ELSE 0 END AS x FROM chan JOIN c USING (subject, i)", "samples",
    ),
    "j11_roi_time_course": q(lambda s, d: J.roi_time_course(by_channel(s, d), s.createDataFrame([("ch0", "left", 1), ("ch1", "left", -1), ("ch2", "right", 1), ("ch0", "whole", 1)], "unit string, roi string, sign int"), ["subject"]), "subject unit i", "x", f"WITH {CHAN}, m(unit, roi, s) AS (VALUES ('ch0','left',1),('ch1','left',-1),('ch2','right',1),('ch0','whole',1)) SELECT subject, roi AS unit, i, avg(s * x) AS x FROM chan JOIN m USING (unit) GROUP BY ALL", "samples"),
    "j12_suggest_components": q(
        lambda s, d: J.suggest_components(V.metrics_long(s, d).where("metric_name IN ('discount', 'tax')").selectExpr("subject", "trial", "unit", "metric_name AS class", "metric_value AS p"), s.createDataFrame([("discount", 0.09), ("tax", 0.08)], "class string, limit double"), IDS),
        "subject trial unit reasons", "", "SELECT subject, trial, unit, array_to_string(list_sort(list(metric_name || '=' || printf('%.3f', metric_value))), ' + ') AS reasons FROM metrics_long WHERE (metric_name = 'discount' AND metric_value >= 0.09) OR (metric_name = 'tax' AND metric_value >= 0.08) GROUP BY ALL", "metrics_long",
    ),
    "j13_aperiodic_line": q(lines, "subject trial unit", "offset exponent r2", f'WITH {LINES} SELECT subject, trial, unit, o AS "offset", e AS exponent, r2 FROM line', "psd"),
    "j13_fit_aperiodic": q(lambda s, d: J.fit_aperiodic(J.welch_psd(V.signals(s, d), V.FS, 1.0, 0.5), 2.0, 30.0).select(*IDS, "fit.*"), "subject trial unit fail_reason", "offset exponent r2 error alpha_cf alpha_pw alpha_bw"),
    "j13_spectral_peaks": q(lambda s, d: J.spectral_peaks(J.welch_psd(V.signals(s, d), V.FS, 1.0, 0.5), 2.0, 30.0), "subject trial unit", "cf pw bw"),
    "j14_epoch_builder": q(
        lambda s, d: J.explode_samples(J.build_epochs(V.signals(s, d).withColumn("subject", F.concat_ws("_", "subject", "trial")).drop("trial"), V.signals(s, d).select(F.concat_ws("_", "subject", "trial").alias("subject"), F.explode(F.array(*map(F.lit, (10, 32, 50)))).alias("at")).selectExpr("subject", "at", "if(at = 32, 'S1', if(at = 50, 'S9', 'S2')) AS code"), s.createDataFrame([("S1", "stim", "high", 1), ("S1", "other", "low", 2), ("S2", "rest", "none", 3)], "code string, condition string, intensity string, position int"), V.FS, 0.125, 0.25, (-0.125, 0.0)), V.FS),
        "subject unit epoch_index code condition intensity i", "x",
        "WITH e(pos, n, code, condition, intensity) AS (VALUES (10, 1, 'S2', 'rest', 'none'), (32, 2, 'S1', 'stim', 'high')), c AS (SELECT subject || '_' || trial AS subject, unit, n, code, condition, intensity, i - pos + 8 AS i, x FROM samples, e WHERE i BETWEEN pos - 8 AND pos + 16) SELECT subject, unit, n AS epoch_index, code, condition, intensity, i, x - avg(x) FILTER (i <= 8) OVER (PARTITION BY subject, unit, n) AS x FROM c", "samples",
    ),
}
