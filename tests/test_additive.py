"""Additive models fitted together against direct computations."""

import math

import numpy as np
import pytest

from cadenza.operators import additive as A
from cadenza.operators import models as L

BASE = A.Model("m0", (), ("x",), ("age",), ("sex",), (), ("experiment",))
MODELS = [BASE, A.Model("m1", ("z",), ("x", "z"), ("age",), ("sex",), (), ("experiment",)), A.Model("m2", ("z", "w"), ("x",), ("age",), ("sex",), (("z", "w"),), ("experiment",)), A.Model("m3", (), (), ("x", "age"))]


def rows(n_subjects=30, seed=0, missing=True):
    rng = np.random.default_rng(seed)
    out = []
    for s in range(n_subjects):
        for unit in ("u", "v"):
            u = rng.normal()
            for t in range(int(rng.integers(8, 20))):
                x, z, w = rng.uniform(0, 3, 3)
                y = np.sin(2 * x) + 0.5 * z * z + u + 0.3 * (s % 3) + 0.02 * s + rng.normal(scale=0.3)
                out.append((unit, s, f"e{s % 3}", "fm"[s % 2], 20.0 + s % 7, float(x), None if missing and rng.random() < 0.2 else float(z), None if missing and rng.random() < 0.1 else float(w), float(y)))
    return out


SCHEMA = "unit string, subject int, experiment string, sex string, age double, x double, z double, w double, y double"


def comparable(r):
    return {k: v for k, v in r.asDict(True).items() if k not in ("columns", "metrics")}


def close(a, b):
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(close(a[k], b[k]) for k in a)
    if isinstance(a, (list, tuple)):
        return len(a) == len(b) and all(map(close, a, b))
    return a == pytest.approx(b, rel=1e-5, abs=1e-7) if isinstance(a, float) else a == b


def test_together_is_as_alone(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    both = {(r.unit, r.model): r for r in A.additive_mixed_fits(df, ["unit"], MODELS, "subject", "y").collect()}
    assert set(both) == {(u, m.name) for u in "uv" for m in MODELS}
    assert both["u", "m1"].n < both["u", "m0"].n
    for m in (MODELS[0], MODELS[2]):
        for r in A.additive_mixed_fits(df, ["unit"], [m], "subject", "y").collect():
            assert close(comparable(r), comparable(both[r.unit, r.model]))


def test_fit_against_numpy(spark):
    data = rows(seed=3)
    df = spark.createDataFrame(data, SCHEMA)
    fits = {(r.unit, r.model): r for r in A.additive_mixed_fits(df, ["unit"], MODELS, "subject", "y", knots=5).collect()}
    fit = fits["u", "m1"]
    design = A._design(df, MODELS, 5)
    own = [r for r in data if r[0] == "u" and r[6] is not None]
    knots = {c: design.curves[c] for c in ("x", "z")}
    cols = [np.ones((len(own), 1)), *(A.spline(np.array([r[i] for r in own]), knots[c]) for c, i in (("x", 5), ("z", 6))), np.array([[r[4]] for r in own]), np.array([[r[3] == "m"] for r in own], float)]
    cols.append(np.array([[r[2] == f"e{i}" for i in range(3)] for r in own], float))
    x, y, s = np.hstack(cols), np.array([r[8] for r in own]), np.array([r[1] for r in own])
    theta = np.array([1 - 1 / math.sqrt(1 + (s == i).sum() * fit.theta_ratio) for i in s])
    mean = lambda v: np.array([v[s == i].mean(0) for i in s])
    xt, yt = x - theta[:, None] * mean(x), y - theta * mean(y)
    sd = x.std(0)
    sd[0] = 1
    penalty, at = np.zeros((x.shape[1],) * 2), 1
    wanted = {t["term"]: t["penalty"] for t in fit.terms}
    for term, k, own_penalty in (("s(x)", 4, A.curvature(knots["x"])), ("s(z)", 4, A.curvature(knots["z"])), ("age", 1, None), ("sex", 1, None), ("experiment", 3, np.eye(3))):
        if own_penalty is not None:
            p = own_penalty / np.outer(sd[at : at + k], sd[at : at + k])
            penalty[at : at + k, at : at + k] = wanted[term] * p / np.trace(p) * np.count_nonzero(np.diag(p) > 0)
        at += k
    xs = xt / sd
    inverse = np.linalg.inv(xs.T @ xs + len(y) * penalty)
    b = inverse @ xs.T @ yt
    rss = ((yt - xs @ b) ** 2).sum()
    edf = np.trace(inverse @ xs.T @ xs)
    assert fit.coef == pytest.approx((b / sd).tolist(), rel=1e-5, abs=1e-7)
    assert (fit.n, fit.n_subjects, fit.deviance, fit.edf) == (len(own), len(set(s)), pytest.approx(rss, rel=1e-7), pytest.approx(edf, rel=1e-6))
    assert fit.aic == pytest.approx(2 * (edf + 1) + len(y) * (math.log(2 * math.pi * rss / len(y)) + 1))
    effect = next(e for e in fit.effects if e["term"] == "z")
    grid = np.linspace(x[:, 5].min(), x[:, 5].max(), A.POINTS)
    apart = (A.spline(grid, knots["z"]) - x[:, 5:9].mean(0)) / sd[5:9]
    assert effect["x"] == pytest.approx(grid.tolist()) and effect["fit"] == pytest.approx((apart @ b[5:9]).tolist(), rel=1e-5, abs=1e-6)
    sigma = rss / (len(y) - edf)
    assert effect["se"] == pytest.approx(np.sqrt(sigma * np.einsum("ij,jk,ik->i", apart, inverse[5:9, 5:9], apart)).tolist(), rel=1e-5)
    # The score can't be lowered by any one penalty.
    assert fits["u", "m1"].aic < fits["u", "m0"].aic + 1e6 and fit.terms[1]["p"] < 1e-9


def test_variance_ratio_and_plain_least_squares(spark):
    data = [r for r in rows(seed=5, missing=False) if r[0] == "u"]
    df = spark.createDataFrame(data, SCHEMA)
    r = A.additive_mixed_fits(df, ["unit"], MODELS[:1], "subject", "y").first()
    parts = L.variance_components(df, ["unit"], "subject", "y").first()
    assert r.theta_ratio == pytest.approx(parts.var_subject / parts.var_residual)
    plain = A.additive_mixed_fits(df, [], [MODELS[3]], "subject", "y", intercepts=False).first()
    x, y = np.array([[1, q[5], q[4]] for q in data]), np.array([q[8] for q in data])
    b, rss = np.linalg.lstsq(x, y, rcond=None)[:2]
    assert plain.coef == pytest.approx(b.tolist(), rel=1e-6) and plain.deviance == pytest.approx(rss[0]) and plain.edf == pytest.approx(3)
    assert plain.dev_expl == pytest.approx(1 - rss[0] / ((y - y.mean()) ** 2).sum())


def test_a_surface_is_found(spark):
    rng = np.random.default_rng(4)
    data = [("u", s, f"e{s % 3}", "fm"[s % 2], 1.0, float(x), float(z), 0.0, float(np.sin(x) * z + s % 3 + 0.5 * (s % 2) + 0.1 * rng.normal())) for s in range(24) for x, z in rng.uniform(0, 3, (40, 2))]
    df = spark.createDataFrame(data, SCHEMA)
    both = A.Model("surface", (), ("x", "z"), (), ("sex",), (("x", "z"),), ("experiment",)), A.Model("apart", (), ("x", "z"), (), ("sex",), (), ("experiment",)), A.Model("line", (), (), ("x",))
    found = {r.model: r for r in A.additive_mixed_fits(df, ["unit"], list(both), "subject", "y").collect()}
    surface = found["surface"]
    assert [t["term"] for t in surface.terms] == ["s(x)", "s(z)", "te(x,z)", "sex", "experiment"]
    assert surface.dev_expl > 0.98 > found["apart"].dev_expl > found["line"].dev_expl and surface.bic < found["apart"].bic < found["line"].bic
    assert surface.terms[2]["p"] < 1e-9


def test_generalised_least_squares(spark):
    """Without penalties the fit is that under equal covariances within subjects, of the same variance ratio."""
    rng = np.random.default_rng(3)
    data = [("u", s, "e", "f", float(s % 7), float(x), None, None, float(0.4 * x + 0.3 * (s % 7) + u + rng.normal())) for s, u in enumerate(rng.normal(scale=1.5, size=30)) for x in rng.uniform(0, 3, rng.integers(4, 15))]
    fit = A.additive_mixed_fits(spark.createDataFrame(data, SCHEMA), ["unit"], [MODELS[3]], "subject", "y").first()
    a = np.array([[r[1], r[5], r[4], r[8]] for r in data])
    v = np.eye(len(a)) + fit.theta_ratio * (a[:, :1] == a[:, 0])
    design, w = np.c_[np.ones(len(a)), a[:, 1], a[:, 2]], np.linalg.inv(v)
    wanted = np.linalg.solve(design.T @ w @ design, design.T @ w @ a[:, 3])
    assert fit.coef == pytest.approx(wanted.tolist(), rel=1e-5) and fit.theta_ratio > 0.5
    assert [t["edf"] for t in fit.terms] == pytest.approx([1, 1], abs=1e-6) and fit.terms[0]["p"] < 1e-3


def test_curvature_is_the_integral():
    knots = [0.0, 0.4, 1.1, 2.0, 3.0]
    at = np.linspace(0, 3, 200_001)
    second = np.gradient(np.gradient(A.spline(at, knots), at, axis=0), at, axis=0)[2:-2]
    assert np.allclose(A.curvature(knots), second.T @ second * (at[1] - at[0]), rtol=2e-3, atol=1e-2)


def test_effects_and_their_concordance(spark):
    df = spark.createDataFrame(rows(seed=8), SCHEMA)
    fits = A.additive_mixed_fits(df, ["unit"], MODELS, "subject", "y")
    pooled = A.additive_mixed_fits(df, [], MODELS, "subject", "y")
    effects = A.smooth_effects(fits, ["unit"])
    assert effects.where("model = 'm1' AND term = 'x' AND unit = 'u'").count() == A.POINTS
    at = {round(r.x, 1): r.effect for r in effects.where("model = 'm1' AND term = 'x' AND unit = 'u'").collect()}
    assert at[0.8] > 0.5 > -0.5 > at[2.3]  # a sine
    concepts = spark.createDataFrame([("bend", "m1", "z", "m1", "z"), ("none", "m0", None, "m0", None), ("other", "m1", "z", "m0", "x")], "concept string, channel_model string, channel_term string, source_model string, source_term string")
    found = {(r.concept, r.unit): r for r in A.effect_concordance(pooled, fits, concepts, ["unit"]).collect()}
    assert set(found) == {(c, u) for c in ("bend", "other") for u in "uv"} and found["bend", "u"].r > 0.9 and found["bend", "u"].same_direction
    e = {(r.model, e["term"], r.unit): e for r in fits.collect() for e in r.effects}
    p = {(r.model, e["term"]): e for r in pooled.collect() for e in r.effects}
    wanted = np.corrcoef(p["m1", "z"]["fit"], np.interp(p["m1", "z"]["x"], e["m0", "x", "v"]["x"], e["m0", "x", "v"]["fit"]))[0, 1]
    assert found["other", "v"].r == pytest.approx(wanted)
    quality = {r.concept: r for r in A.quality_by_concept(pooled, fits, concepts, "unit").collect()}
    own = {(r.model, r.unit): r for r in fits.collect()}
    best = min("uv", key=lambda u: own["m1", u].aic)
    assert quality["bend"].best == best and quality["bend"].delta_dev_expl == pytest.approx(own["m1", best].dev_expl - pooled.where("model = 'm1'").first().dev_expl)


def test_combinations():
    made = A.combinations_of(["a_z", "b_z", "c"], [1, 2], BASE, [("b_z", "a_z")])
    assert [m.name for m in made] == ["m00_baseline", "m_1metric_a", "m_1metric_b", "m_1metric_c", "m_2metric_a_x_b", "m_2metric_a_x_c", "m_2metric_b_x_c"]
    assert made[4].tensors == (("a_z", "b_z"),) and made[5].smooths == ("x", "a_z", "c")
    registry = A.listed(L.MODELS["region"], BASE)
    assert registry[5].tensors == (("pow_slow", "pow_fast"),) and registry[6].linear == ("age", "sin_phase", "cos_phase") and "fooof_offset" in registry[12].smooths


def test_edges(spark):
    df = spark.createDataFrame([("few", 1, "e", "f", 1.0, 1.0, 1.0, 1.0, 1.0), ("flat", 1, "e", "f", 1.0, 1.0, None, 1.0, 2.0)] + [("flat", i % 4, "e", "f", 1.0, 2.0, None, 1.0, float(i % 3)) for i in range(40)], SCHEMA)
    found = {(r.unit, r.model): r for r in A.additive_mixed_fits(df, ["unit"], MODELS, "subject", "y").collect()}
    assert ("few", "m0") not in found and ("flat", "m1") not in found and found["flat", "m0"].n == 41
    assert A.additive_mixed_fits(df.limit(0), ["unit"], MODELS, "subject", "y").count() == 0


def test_no_row_is_stored_for_a_subject(spark, monkeypatch):
    """Sums of products are stored for each task, key and pattern of missing columns; subjects' sums stay in their tasks."""
    paths = []
    real = A.scratch_path
    monkeypatch.setattr(A, "scratch_path", lambda s, name: paths.append((name, real(s, name))) or paths[-1][1])
    df = spark.createDataFrame(rows(n_subjects=300, seed=4), SCHEMA)
    A.additive_mixed_fits(df, ["unit"], MODELS, "subject", "y").collect()
    counts = {name: spark.read.parquet(path).count() for name, path in paths if "sums" in name}
    assert counts and max(counts.values()) <= 4 * 2 * (4 + 4)


def test_subjects_cut_by_batches(spark):
    df = spark.createDataFrame(rows(n_subjects=12, seed=5), SCHEMA)
    found = []
    for size in (None, "7"):
        if size:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            found.append({(r.unit, r.model): comparable(r) for r in A.additive_mixed_fits(df, ["unit"], MODELS, "subject", "y").collect()})
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found[0].keys() == found[1].keys() and all(close(found[0][k], found[1][k]) for k in found[0])
