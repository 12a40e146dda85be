"""Names, identifiers, labels, filters and joins on small tables."""

import pytest
from pyspark.sql import functions as F

from cadenza.functions import cleaning as C
from cadenza.operators import filters, joins, sets, windows


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


def test_column_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "` a b ` int, `r^2` int, `x.y` int")
    assert C.clean_names(df).columns == ["a_b", "rr2", "x_y"]
    assert C.normalize_colnames(spark.createDataFrame([(1, 2)], "` Pain-Rating ` int, `__` int")).columns == ["pain_rating", "col2"]
    named = C.rename_first_match(spark.createDataFrame([(1, 2, 3)], "Age int, AGE2 int, sex int"), {"age": ["years", "Age", "AGE2"], "sex": ["Sex"]})
    assert named.columns == ["age", "AGE2", "sex"]
    with pytest.raises(ValueError):
        C.require_columns(named, ["trial"])


def test_scalars(spark):
    df = spark.createDataFrame([("M",), (" female",), ("x",), (None,)], "s string")
    assert [r[0] for r in df.select(C.harmonize_sex(F.col("s"))).collect()] == ["M", "F", None, None]
    p = spark.createDataFrame([(p,) for p in (None, 0.0001, 0.005, 0.03, 0.5)], "p double")
    assert [r[0] for r in p.select(C.sig_label(F.col("p"))).collect()] == ["n/a", "***", "**", "*", "ns"]
    v = spark.createDataFrame([(123456.0,), (0.00123456,), (0.0,), (-9.876,)], "v double")
    assert [r[0] for r in v.select(C.signif(F.col("v"), 3)).collect()] == pytest.approx([123000, 0.00123, 0, -9.88])
    nan = spark.createDataFrame([(float("nan"),), (1.0,)], "v double")
    assert C.all_no_nan(nan).agg(F.avg("v")).first()[0] == 1.0
    assert [r[0] for r in spark.createDataFrame([("NaN",), ("1.5 ",), ("n/a",)], "v string").select(C.coerce_numeric(F.col("v"))).collect()] == [None, 1.5, None]


def test_subject_ids(spark):
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "id string")
    assert rows(C.parse_subject_ids(ids("sub-007", "7", "12", "sub-000"), "id")) == [(7,), (12,)]
    with pytest.raises(Exception, match="not a subject id"):
        C.parse_subject_ids(ids("abc"), "id").collect()


def test_experiment_from_path(spark):
    paths = spark.createDataFrame([("/d/exp1/exp2_x.csv",), ("/d/exp1/x.csv",), ("/d/exp1/exp2/x.csv",), ("/d/x.csv",)], "p string")
    assert [r[0] for r in paths.select(C.experiment_from_path(F.col("p"), ["exp1", "exp2"])).collect()] == ["exp2", "exp1", None, None]


def test_guards(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (1, 2.0, 5.0), (1, 3.0, 5.0), (2, 1.0, 2.0), (3, None, None), (4, 1.0, 1.0), (4, 2.0, 2.0), (4, 3.0, 3.0), (4, None, 9.0)], "g int, x double, y double")
    found = {r.g: r.r for r in df.groupBy("g").agg(filters.guarded_corr("x", "y").alias("r")).collect()}
    assert found[1] is None and found[2] is None and found[3] is None and found[4] == pytest.approx(1)
    assert filters.min_rows_per_group(df, ["g"], 3).count() == 7
    assert filters.complete_blocks(spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "s int, u string"), "s", "u").count() == 2


def test_epoch_forms_agree(spark):
    signal = [float(i * i % 17) for i in range(40)]
    rec = spark.createDataFrame([("s", "c", signal)], "subject string, unit string, samples array<double>")
    ev = spark.createDataFrame([("s", 1, 5), ("s", 2, 20), ("s", 3, 39), ("s", 4, 1)], "subject string, event_id int, at long")
    cut = joins.epochs(rec, ev, 2, 3)
    assert rows(cut, "event_id") == [(1,), (2,)] and cut.where("event_id = 2").first().samples == signal[18:24]
    long = rec.select("subject", F.posexplode("samples").alias("i", "x")).withColumn("i", F.col("i").cast("long"))
    found = joins.epochs_long(long, ev, 2, 3)
    assert [r.x for r in found.where("event_id = 2").orderBy("offset").collect()] == signal[18:24]
    assert found.groupBy("event_id", "offset").count().where("count > 1").count() == 0


def test_interpolate_in_buckets(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = {k: np.unique(rng.normal(size=n).round(3)) for k, n in (("a", 700), ("b", 2), ("c", 1))}
    y = {k: rng.normal(size=len(v)) for k, v in x.items()}
    g = {k: rng.uniform(-4, 4, 300) for k in "abcd"}
    p = spark.createDataFrame([(k, float(a), float(b)) for k in x for a, b in zip(x[k], y[k])], "k string, x double, y double")
    found = {(r.k, r.x): r.y for r in joins.interpolate(p, spark.createDataFrame([(k, float(v)) for k in g for v in g[k]], "k string, x double"), ["k"]).collect()}
    assert len(found) == 1200 and all(found["d", float(v)] is None for v in g["d"])
    for k in x:
        assert np.allclose([found[k, float(v)] for v in g[k]], np.interp(g[k], x[k], y[k]))


def test_interpolate(spark):
    p = spark.createDataFrame([("a", 0.0, 0.0), ("a", 2.0, 4.0), ("b", 1.0, 7.0)], "k string, x double, y double")
    g = spark.createDataFrame([("a", -1.0), ("a", 0.5), ("a", 2.0), ("a", 3.0), ("b", 5.0)], "k string, x double")
    assert rows(joins.interpolate(p, g, ["k"])) == [("a", -1.0, 0.0), ("a", 0.5, 1.0), ("a", 2.0, 4.0), ("a", 3.0, 4.0), ("b", 5.0, 7.0)]


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "a", 3)], "subject int, u string, v int")
    new = spark.createDataFrame([(1, "a", 9)], "subject int, u string, v int")
    assert rows(sets.upsert_by_subject(old, new)) == [(1, "a", 9), (2, "a", 3)]
    assert rows(sets.upsert_by_key(old, new, ["subject", "u"])) == [(1, "a", 9), (1, "b", 2), (2, "a", 3)]
    once = sets.upsert_by_subject(old, new)
    assert rows(sets.upsert_by_subject(once, new)) == rows(once)


def greedy(t0, n0, new, share):
    """Who joins train, one after the other."""
    out, t, n = [], t0, n0
    for _ in range(new):
        hit = n == 0 or round(t / n, 9) < share
        out.append(hit)
        t, n = t + hit, n + 1
    return out


@pytest.mark.parametrize(("t0", "n0"), [(0, 0), (0, 3), (3, 3), (5, 6), (1, 9)])
def test_quota_split_is_the_greedy_one(spark, t0, n0):
    people = spark.createDataFrame([(i, "x") for i in range(100, 123)], "subject int, cap string")
    old = spark.createDataFrame([(i, "x", "train" if i < t0 else "holdout") for i in range(n0)], "subject int, cap string, split_group string")
    found = windows.quota_split(people, "cap", "subject", old)
    assert found.where("split_group = 'train'").count() == sum(greedy(t0, n0, 23, 0.75))
    whole = old.unionByName(found)
    assert windows.quota_split(people, "cap", "subject", whole).count() == 0


def test_intervals_ranks_fdr(spark):
    flags = spark.createDataFrame([(1, i, i in (2, 3, 4, 7, 9, 10)) for i in range(12)], "k int, i int, bad boolean")
    assert rows(windows.mask_to_intervals(flags, ["k"], "bad"), "start", "end") == [(2, 4), (7, 7), (9, 10)]
    tied = spark.createDataFrame([(1, 5.0), (1, 5.0), (1, 7.0), (1, 1.0)], "k int, v double")
    assert rows(windows.avg_rank(tied, ["k"], "v"), "v", "rank") == [(1.0, 1.0), (5.0, 2.5), (5.0, 2.5), (7.0, 4.0)]
    ps = spark.createDataFrame([(1, 0.01), (1, 0.04), (1, 0.03), (1, None), (1, 0.2)], "f int, p double")
    found = {r.p: r.p_adj for r in windows.fdr_bh(ps, ["f"]).collect()}
    assert found[None] is None and found[0.01] == pytest.approx(0.04) and found[0.03] == pytest.approx(0.16 / 3) and found[0.04] == pytest.approx(0.16 / 3) and found[0.2] == pytest.approx(0.2)


def test_combinations(spark):
    names = spark.createDataFrame([("u", "a"), ("u", "b"), ("u", "c"), ("w", "a")], "unit string, metric_name string")
    found = rows(joins.combinations(names), "unit", "model_name")
    assert found == [("u", "a"), ("u", "a+b"), ("u", "a+c"), ("u", "b"), ("u", "b+c"), ("u", "baseline"), ("u", "c"), ("w", "a"), ("w", "baseline")]


def test_percentile_guard_with_null_keys_equals_sql(spark, tmp_path):
    import duckdb

    from cadenza.plans.registry import QUERIES

    rows = "timestamp '2024-01-01' + id * interval 1 minute AS ts, if(id % 7 = 0, null, id % 3) AS user_id, if(id % 5 = 0, null, concat('t', id % 2)) AS event_type, id % 4 + 0.25 AS value, '{\"k\": 3}' AS props"
    spark.sql(f"SELECT id AS event_id, {rows} FROM range(200)").write.parquet(str(tmp_path / "events.parquet"))
    query = QUERIES["c11_percentile_guard"]
    found = [tuple(map(str, r)) for r in query.run(spark, str(tmp_path)).select("subject", "trial", "p_low", "guard_ok").collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS FROM '{tmp_path}/events.parquet/*.parquet'")
    wanted = [tuple(map(str, r)) for r in con.execute(f"SELECT subject, trial, p_low, guard_ok FROM ({query.oracle()})").fetchall()]
    assert sorted(found) == sorted(wanted)
