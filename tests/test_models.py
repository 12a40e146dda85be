"""Statistical jobs against direct computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions.distributions import beta_share, f_upper, t_two_sided
from cadenza.operators import models as L


def test_distributions(spark):
    # Reference values of t and F tables.
    df = spark.createDataFrame([(2.228, 10.0, 4.965, 1.0, 10.0), (0.0, 5.0, 0.0, 2.0, 5.0), (None, 5.0, None, 1.0, 1.0)], "t double, v double, f double, a double, b double")
    found = df.select(t_two_sided("t", "v").alias("p"), f_upper("f", "a", "b").alias("q")).collect()
    assert found[0].p == pytest.approx(0.05, abs=2e-4) and found[0].q == pytest.approx(0.05, abs=2e-4)
    assert found[1].p == pytest.approx(1) and found[1].q == pytest.approx(1) and found[2].p is None and found[2].q is None
    assert beta_share(2.0, 3.0, 0.4) == pytest.approx(0.5248)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    data = []
    for s in range(24):
        for t in range(12):
            x, z = rng.normal(size=2)
            data.append((s, f"c{s % 3}", t, "u", float(x), float(z), float(2 + 1.5 * x - 0.5 * z + 0.2 * rng.normal() + (s % 5) * 0.01)))
    return spark.createDataFrame(data, "subject int, cap string, trial int, unit string, x double, z double, y double").cache()


def test_least_squares_and_folds(table):
    rows = table.collect()
    a, y, s = np.array([[1, r.x, r.z] for r in rows]), np.array([r.y for r in rows]), np.array([r.subject for r in rows])
    fit = L.solve(L.products(table, ["unit"], ["x", "z"], "y")).first()
    assert np.allclose(fit.coef, np.linalg.lstsq(a, y, rcond=None)[0]) and 0.98 < fit.r_sq < 1
    folds, over = L.loso_cv(table, ["unit"], "subject", ["x", "z"], "y")
    b = np.linalg.lstsq(a[s != 3], y[s != 3], rcond=None)[0]
    expected = np.sqrt(np.mean((y[s == 3] - a[s == 3] @ b) ** 2))
    assert folds.where("subject = 3").first().rmse == pytest.approx(expected)
    assert over.first().n_complete == 24


def test_anova_and_ttests(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(8, 4)) + np.arange(4)
    df = spark.createDataFrame([(i, f"l{j}", float(v[i, j])) for i in range(8) for j in range(4)] + [(99, "l0", 1.0)], "subject int, level string, v double")
    g, n, k = v.mean(), 8, 4
    between = n * ((v.mean(0) - g) ** 2).sum() / (k - 1)
    error = ((v - v.mean(0) - v.mean(1)[:, None] + g) ** 2).sum() / ((k - 1) * (n - 1))
    r = L.rm_anova(df.where("subject < 99"), "subject", "level", "v").first()
    assert r.f == pytest.approx(between / error) and 1 / 3 <= r.epsilon <= 1 and r.p <= r.p_gg < 0.05
    assert L.rm_anova_sums(df, "subject", "level", "v").first().n == 8
    d = v[:, 3] - v[:, 0]
    t = L.pairwise_paired_fdr(df.where("subject < 99"), "subject", "level", "v").where("unit_a = 'l0' AND unit_b = 'l3'").first()
    assert -t.t == pytest.approx(d.mean() / (d.std(ddof=1) / np.sqrt(8))) and t.p <= t.p_adj
    flat = spark.createDataFrame([(1, 2.0, 1.0)] * 4, "g int, x double, y double")
    assert L.paired_ttest(flat, ["g"], "x", "y").first().t is None


def test_resampling_is_seeded(table, spark):
    first = L.permutation_p(table, ["unit"], "trial", "x", "y", 30).first()
    assert first.p == pytest.approx(1 / 31)
    boot = lambda: {r.metric: (r.ci_low, r.ci_high) for r in L.bootstrap_ci(table, ["unit"], "subject", "x", "y", 60).collect()}
    a = boot()
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        b = boot()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert all(a[m] == pytest.approx(b[m]) for m in a) and 0.5 < a["pearson_r"][0] < a["pearson_r"][1] < 1.01
    halves = L.split_half_stability(table, ["unit"], "subject", "cap", ["x", "z"], "y", 10).collect()
    assert len(halves) == 10 and all(h.r > 0.99 for h in halves)


def ranks(v):
    order = np.sort(v)
    return (np.searchsorted(order, v) + np.searchsorted(order, v, "right") + 1) / 2


def test_replicate_ranks_are_those_of_repeated_rows():
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 9, 60).astype(float), rng.normal(size=60)
    weights = rng.integers(0, 4, (5, 60)).astype(float)
    for w, rho in zip(weights, L.weighted_spearman(x, y, weights)):
        a, b = (np.repeat(v, w.astype(int)) for v in (x, y))
        assert rho == pytest.approx(np.corrcoef(ranks(a), ranks(b))[0, 1])
    assert L.weighted_spearman(np.ones(4), np.arange(4.0), np.ones((1, 4))) == [None]


def test_bootstrap_of_ranks(spark, monkeypatch):
    """Held and windowed replicates agree with ranking the drawn rows one by one."""
    rng = np.random.default_rng(6)
    data = [(u, s, float(rng.integers(0, 6) + s % 3), float(rng.normal() + s % 3)) for u in "ab" for s in range(9) for _ in range(int(rng.integers(1, 7)))]
    df = spark.createDataFrame(data, "unit string, subject int, x double, y double")
    found = {}
    for most in (L.HELD_ROWS, 0):
        monkeypatch.setattr(L, "HELD_ROWS", most)
        found[most] = {(r.unit, r.metric): (r.ci_low, r["median"], r.ci_high) for r in L.bootstrap_ci(df, ["unit"], "subject", "x", "y", 40).collect()}
    assert all(found[0][k] == pytest.approx(v) for k, v in found[2_000_000].items()) and len(found[0]) == 10
    picks = spark.range(9).withColumnRenamed("id", "_k").selectExpr("cast(_k as int) AS _k", "explode(sequence(1, 40)) AS rep").withColumn("d", F.floor(L.seeded(42, "rep", "_k") * 9)).collect()
    rhos = []
    for rep in range(1, 41):
        drawn = [r for p in picks if p.rep == rep for r in data if r[0] == "a" and r[1] == p.d]
        a, b = (np.array([r[i] for r in drawn]) for i in (2, 3))
        rhos.append(np.corrcoef(ranks(a), ranks(b))[0, 1])
    assert found[0]["a", "spearman_rho"] == pytest.approx(tuple(np.percentile(rhos, [2.5, 50, 97.5])))


def test_draws_are_those_of_seeded(spark):
    rows = spark.range(50).selectExpr("cast(id as int) AS _k", "explode(array(1, 2, 500)) AS rep").withColumn("d", F.floor(L.seeded(42, "rep", "_k") * 50)).collect()
    for rep, drawn in zip((1, 2, 500), L.times_drawn(42, (1, 2, 500), 50)):
        assert drawn.tolist() == np.bincount([r.d for r in rows if r.rep == rep], minlength=50).tolist()


def test_large_keys_have_no_row_for_a_replicate(spark, monkeypatch):
    """In buckets, on either side, as held, by windows; in buckets no join makes more rows than there are."""
    rng = np.random.default_rng(8)
    data = [(u, s, float(rng.normal() + s % 3), float(rng.integers(0, 4) + s % 3)) for u in "ab" for s in range(9) for _ in range(int(rng.integers(1, 9)))]
    data = [(u, s, y, x) if u == "b" else (u, s, x, y) for u, s, x, y in data]
    df = spark.createDataFrame(data, "unit string, subject int, x double, y double")
    boot = lambda: L.bootstrap_ci(df, ["unit"], "subject", "x", "y", 40)
    found = [{(r.unit, r.metric): (r.ci_low, r["median"], r.ci_high) for r in boot().collect()}]
    monkeypatch.setattr(L, "HELD_ROWS", 0)
    monkeypatch.setattr(L, "BUCKET_ROWS", 10)
    asked = boot()
    found.append({(r.unit, r.metric): (r.ci_low, r["median"], r.ci_high) for r in asked.collect()})
    assert "Window" not in asked._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(L, "SIDE_VALUES", 0)
    found.append({(r.unit, r.metric): (r.ci_low, r["median"], r.ci_high) for r in boot().collect()})
    for other in found[1:]:
        assert len(other) == 10 and all(other[k] == pytest.approx(v) for k, v in found[0].items())


def test_permutations_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=400)
    df = spark.createDataFrame([(u, i, float(a), float(0.12 * a * (u == "a") + b)) for u in "ab" for i, (a, b) in enumerate(zip(x, rng.normal(size=400)))] + [("c", i, 1.0, float(i)) for i in range(9)], "unit string, row int, x double, y double")
    run = lambda: {r.unit: r for r in L.permutation_p(df, ["unit"], "row", "x", "y", 200).collect()}
    whole = run()
    again = L.permutation_p(df.repartition(3), ["unit"], "row", "x", "y", 200).collect()
    assert {r.unit: (r.n_ge, r.p) for r in again} == {u: (r.n_ge, r.p) for u, r in whole.items()}
    monkeypatch.setattr(L, "BLOCK_ROWS", 50)
    parts = run()
    assert whole["c"].p is None and whole["c"].n_ge == 0
    for u in "ab":
        assert parts[u].r == whole[u].r and abs(parts[u].p - whole[u].p) < 0.15


def test_variance_components(spark):
    rng = np.random.default_rng(9)
    data = [(s, float(m + rng.normal())) for s, m in enumerate(rng.normal(scale=3, size=300)) for _ in range(10)]
    r = L.variance_components(spark.createDataFrame(data, "s int, v double").withColumn("g", F.lit(1)), ["g"], "s", "v").first()
    assert r.var_residual == pytest.approx(1, rel=0.1) and r.var_subject == pytest.approx(9, rel=0.25)


def test_effect_has_its_own_error(spark):
    rng = np.random.default_rng(5)
    x, z = rng.normal(size=(2, 200))
    y = 2 * x - z + rng.normal(size=200)
    df = spark.createDataFrame([("u", float(a), float(b), float(c)) for a, b, c in zip(x, z, y)], "unit string, x double, z double, y double")
    rows = L.smooth_effect(L.solve(L.products(df, ["unit"], ["x", "z"], "y")), 1, -2.0, 2.0, 5).orderBy("x").collect()
    design = np.c_[np.ones(200), x, z]
    b, rss = np.linalg.lstsq(design, y, rcond=None)[:2]
    error = np.sqrt(rss[0] / 197 * np.linalg.inv(design.T @ design)[1, 1])
    for r in rows:
        assert r.effect == pytest.approx(b[1] * (r.x - x.mean())) and r.se == pytest.approx(error * abs(r.x - x.mean()), rel=1e-6)
