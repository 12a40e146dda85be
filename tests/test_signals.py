"""Kernels and features on signals with known answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions import kernels
from cadenza.operators import features as E
from cadenza.operators import signals as J

FS = 64.0
TIME = np.arange(128) / FS


@pytest.fixture(scope="module")
def waves(spark):
    made = [(1, 1, "slow", 9.0), (1, 1, "fast", 11.0)]
    return spark.createDataFrame([(s, t, u, np.cos(2 * np.pi * f * TIME).tolist()) for s, t, u, f in made], "subject int, trial int, unit string, samples array<double>")


def test_known_peaks(waves):
    psd = J.psd_long(J.welch_psd(waves, FS, 2.0, 0.5))
    found = {r.unit: r for r in E.psi_cog(E.alpha_features(psd, J.IDS)).collect()}
    assert found["slow"].sf_balance > 0.9 and found["fast"].sf_balance < -0.9
    assert found["slow"].paf_cog_hz == pytest.approx(9, abs=0.2) and found["fast"].paf_cog_hz == pytest.approx(11, abs=0.2)
    for r in found.values():
        assert -1 <= r.sf_balance <= 1 and 0 <= r.slow_alpha_frac <= 1 and r.psi_cog == pytest.approx(r.sf_balance * (r.paf_cog_hz - 10))
    arrays = J.welch_psd(waves, FS, 2.0, 0.5).select("unit", E.bandpower_array("f", "p", 8.0, 10.0).alias("a"), E.bandpower_array("f", "p", 50.0, 60.0).alias("none"))
    for r in arrays.collect():
        assert r.a == pytest.approx(found[r.unit].pow_slow_alpha) and r.none is None


def test_welch_is_the_dft_mean():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2, 100))
    f, p = kernels.welch(x, FS, 0.5, 0.5)
    w = kernels.hamming(32)
    parts = [np.abs(np.fft.rfft(x[:, s : s + 32] * w)) ** 2 for s in range(0, 69, 16)]
    expected = np.mean(parts, axis=0) / (FS * (w**2).sum())
    expected[:, 1:-1] *= 2
    assert np.allclose(p, expected) and f[1] == 2.0


def test_short_and_missing_signals(spark):
    df = spark.createDataFrame([(1, [1.0] * 4), (2, None), (3, [0.0] * 16)], "k int, samples array<double>")
    found = {r.k: r.p for r in J.welch_psd(df, FS, 1.0, 0.5).collect()}
    assert found[1] is None and found[2] is None and max(found[3]) == 0
    with pytest.raises(ValueError):
        J.windowed_psd(df, FS, {"pre": (0, 4), "post": (4, 20)}, 1.0)
    assert E.tvi(spark.createDataFrame([(1, i, v) for i, v in enumerate([1.0, 1.0, 1.0])], "k int, t int, v double"), ["k"], "t", "v").first().tvi is None


def test_filters_keep_time(spark):
    x = np.sin(2 * np.pi * 5 * TIME)[None] + np.sin(2 * np.pi * 25 * TIME)[None]
    low = kernels.zero_phase(x, kernels.sinc_taps(FS, None, 12.0, 65))
    assert np.abs(low - np.sin(2 * np.pi * 5 * TIME))[0, 30:-30].max() < 0.05
    stop = kernels.zero_phase(x, kernels.sinc_taps(FS, 23.0, 27.0, 65, stop=True))
    assert np.abs(stop - np.sin(2 * np.pi * 5 * TIME))[0, 40:-40].max() < 0.25
    half = kernels.resample(np.sin(2 * np.pi * 5 * TIME)[None], FS, 32.0)
    assert half.shape == (1, 64) and np.abs(half[0] - np.sin(2 * np.pi * 5 * np.arange(64) / 32))[15:-15].max() < 0.05


def test_resampling_is_upsampling_filtering_and_decimating():
    rng = np.random.default_rng(0)
    for fs, target, n in ((64.0, 48.0, 90), (64.0, 32.0, 91), (64.0, 160.0, 40), (100.0, 64.0, 75)):
        up, down = kernels.rational_rate(fs, target)
        x = rng.normal(size=(2, n))
        h = kernels.polyphase_taps(up, down)
        pad = min(-(-len(h) // up), n - 1)
        wide = np.concatenate((2 * x[:, :1] - x[:, pad:0:-1], x, 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]), axis=1)
        zeros = np.zeros((2, wide.shape[1] * up))
        zeros[:, ::up] = wide
        full = np.array([np.convolve(z, h) for z in zeros])[:, len(h) // 2 + pad * up :][:, ::down]
        assert np.allclose(kernels.resample(x, fs, target), full[:, : -(-n * up // down)])
    assert kernels.resample(x, 64.0, 64.0) is x
    t = np.arange(256) / 64
    wave = kernels.resample(np.sin(2 * np.pi * 5 * t)[None], 64.0, 48.0)[0]
    assert np.abs(wave - np.sin(2 * np.pi * 5 * np.arange(192) / 48))[20:-20].max() < 0.02


def test_all_peaks_of_a_spectrum(spark):
    f = np.arange(1, 46, 0.5)
    planted = [(6.0, 0.9, 0.8), (11.0, 1.2, 1.0), (24.0, 0.6, 1.5)]
    p = 10 ** (2 - 1.1 * np.log10(f) + sum(h * np.exp(-((f - c) ** 2) / (2 * w * w)) for c, h, w in planted))
    df = spark.createDataFrame([("a", f.tolist(), p.tolist()), ("flat", f.tolist(), (f**-1.0).tolist()), ("none", None, None)], "unit string, f array<double>, p array<double>")
    found = J.spectral_peaks(df, 1.0, 45.0).collect()
    assert {r.unit for r in found} == {"a"}
    for c, h, w in planted:
        assert any(abs(r.cf - c) <= 0.5 and abs(r.pw - h) < 0.2 and abs(r.bw - 2 * w) < 1 for r in found)


def test_packed_matrices(spark, monkeypatch):
    rng = np.random.default_rng(3)
    data = [(s, u, rng.normal(size=5 if u != "d" else 3).tolist()) for s in (1, 2) for u in "abcd" if (s, u) != (2, "a")]
    df = spark.createDataFrame(data, "subject int, unit string, samples array<double>")
    k = spark.createDataFrame([("a", "x", 1.0), ("b", "x", -2.0), ("d", "y", 0.5), ("b", "y", 0.25), ("z", "w", 1.0)], "unit_in string, unit_out string, w double")
    back = spark.createDataFrame([("x", "a", 0.5), ("x", "c", 2.0), ("y", "b", 1.0)], "unit_in string, unit_out string, w double")
    run = lambda: [{(r.subject, r.unit): r.samples for r in made.collect()} for made in (J.apply_matrix(df, k, ["subject"]), J.remove_parts(df, k, back, ["x", "y"], ["subject"]))]
    packed = run()
    monkeypatch.setattr(J, "MATRIX_CELLS", 0)
    joined = run()
    for one, two in zip(packed, joined):
        assert one.keys() == two.keys() and all(one[c] == pytest.approx(two[c]) for c in one)


def test_phase(waves):
    found = {r.unit: r.phase for r in J.hilbert_phase(waves, FS, 7.0, 13.0, 64, 33).collect()}
    assert found["slow"] == pytest.approx(0, abs=0.15) and abs(found["fast"]) == pytest.approx(0, abs=0.15)
    long = J.hilbert_phases(waves, FS, 7.0, 13.0, 33)
    assert long.select(F.size("phases")).first()[0] == 128


def test_aperiodic_fit():
    f = np.arange(1, 41.0)
    p = 10 ** (1.5 - 1.2 * np.log10(f)) * 10 ** (0.8 * np.exp(-((f - 10) ** 2) / (2 * 1.2**2)))
    fit = kernels.fit_aperiodic(f, p)
    assert fit["exponent"] == pytest.approx(1.2, abs=0.1) and fit["offset"] == pytest.approx(1.5, abs=0.15)
    assert fit["alpha_cf"] == pytest.approx(10, abs=1) and fit["r2"] > 0.95 and fit["fail_reason"] is None
    assert kernels.fit_aperiodic(f, np.zeros(40))["fail_reason"]
    assert kernels.fit_aperiodic(f[:3], p[:3])["fail_reason"]


def test_tvi_of_alternation(spark):
    n = 10
    df = spark.createDataFrame([(1, i, float((-1) ** i)) for i in range(n)] + [(2, i, float(i)) for i in range(2)] + [(3, 0, None)], "k int, t int, v double")
    found = {r.k: r.tvi for r in E.tvi(df, ["k"], "t", "v").collect()}
    assert found[1] == pytest.approx(4 * (n - 1) / n) and found[2] is None and 3 not in found


def test_circular_statistics(spark):
    same = spark.createDataFrame([(1, 0.3, 1.0)] * 12, "k int, phase double, rating double")
    r = E.rayleigh(same, ["k"]).first()
    assert r.r == pytest.approx(1) and r.p < 0.001 and r.mean_phase == pytest.approx(0.3)
    assert E.circ_lin_corr(same, ["k"]).first().r_cl is None
    rng = np.random.default_rng(1)
    phi = rng.uniform(-np.pi, np.pi, 400)
    linked = spark.createDataFrame([(1, float(p), float(np.cos(p) + 0.1 * rng.normal())) for p in phi], "k int, phase double, rating double")
    assert E.circ_lin_corr(linked, ["k"]).first().r_cl > 0.95
    flat = E.itc(spark.createDataFrame([(1, 0.0, float(p)) for p in phi], "k int, t_ms double, phase double"), ["k"]).first()
    assert 0 <= flat.itc_mean <= 0.15


def test_linear_operators(spark):
    s = spark.createDataFrame([(1, u, i, float(v + i)) for u, v in (("a", 0), ("b", 10)) for i in range(3)], "subject int, unit string, i int, x double")
    k = spark.createDataFrame([("a", "c1", 1.0), ("b", "c1", 1.0), ("b", "c2", 2.0)], "unit_in string, unit_out string, w double")
    made = {(r.unit, r.i): r.x for r in J.apply_linear(s, k, ["subject"]).collect()}
    assert made["c1", 1] == 12 and made["c2", 0] == 20
    back = spark.createDataFrame([("c2", "b", 0.5)], "unit_in string, unit_out string, w double")
    clean = {(r.unit, r.i): r.x for r in J.remove_components(s, k, back, ["c2"], ["subject"]).collect()}
    assert clean["b", 2] == 0 and clean["a", 2] == 2
    ref = {(r.unit, r.i): r.x for r in J.rereference(s, ["subject"], ["a"]).collect()}
    assert ref["a", 1] == 0 and ref["b", 1] == 10


def test_hazen_percentile(spark):
    df = spark.createDataFrame([(1, float(v)) for v in (1, 2, 3, 4)], "k int, v double")
    get = lambda p: df.groupBy("k").agg(E.hazen("v", p).alias("h")).first().h
    assert get(0.5) == 2.5 and get(0.05) == 1.0 and get(0.375) == 2.0
