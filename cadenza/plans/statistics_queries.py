"""Queries of summaries, order-based operators, rankings, statistical jobs and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.operators import features as E
from cadenza.operators import joins as D
from cadenza.operators import models as L
from cadenza.operators import summaries as S
from cadenza.operators import windows as W
from cadenza.plans import views as V
from cadenza.plans.cleaning_queries import SPLIT, _split
from cadenza.plans.spec import q

TERMS = ["laser_power", "trial_z"]


def wide(s, d):
    return V.metrics_wide(s, d)


def split_trials(s, d):
    """Trials with a standardised trial number, the cap and the split of their subject."""
    rows = V.trials(s, d).join(V.subjects(s, d).select("subject", "cap_size", "experiment_id"), "subject")
    return rows.withColumn("trial_z", (F.col("trial") - 30) / 20.0).withColumn("laser_power", F.col("laser_power") / 50.0)


TRIALS = "m AS (SELECT t.subject, t.trial, t.unit, cap_size, experiment_id, (t.trial - 30) / 20.0::DOUBLE AS trial_z, laser_power / 50.0::DOUBLE AS laser_power, pain_rating FROM trials t JOIN subjects s USING (subject))"


def unit_means(s, d):
    return V.trials(s, d).groupBy("subject", "unit").agg(F.avg("pain_rating").alias("v"))


def two_metrics(s, d):
    """A subject's mean of two units."""
    return V.trials(s, d).groupBy("subject").agg(F.avg(F.when(F.col("unit") == "click", F.col("pain_rating"))).alias("x"), F.avg(F.when(F.col("unit") == "view", F.col("pain_rating"))).alias("y"), (F.max("subject") % 4).alias("g"))


TWO = "two AS (SELECT subject, avg(pain_rating) FILTER (unit = 'click') AS x, avg(pain_rating) FILTER (unit = 'view') AS y, subject % 4 AS g FROM trials GROUP BY subject)"


def curve(s, d):
    rows = V.table(s, d, "orders").select((F.col("o_custkey") % 40).alias("metric"), (F.col("o_orderkey") % 12 * 10 + 10).alias("n"), "o_totalprice")
    return rows.groupBy("metric", "n").agg((F.avg("o_totalprice") / 200000.0 * F.col("n") / 60.0).alias("power"))


CURVE = "curve AS (SELECT o_custkey % 40 AS metric, o_orderkey % 12 * 10 + 10 AS n, avg(o_totalprice) / 200000.0::DOUBLE * (o_orderkey % 12 * 10 + 10) / 60.0::DOUBLE AS power FROM orders GROUP BY 1, o_orderkey % 12 * 10 + 10)"


def fits(s, d):
    """A table of model fits: part brands as regions, types as models."""
    return V.table(s, d, "part").groupBy(F.col("p_brand").alias("roi"), F.col("p_type").alias("model_name")).agg(F.avg("p_retailprice").alias("aic"), F.count("*").alias("n"), (F.min("p_size") / 100.0).alias("p"), (F.max("p_size") % 3 + 0).alias("n_metrics"), (F.avg("p_size") / 50.0).alias("r_sq"))


FITS = "fits AS (SELECT p_brand AS roi, p_type AS model_name, avg(p_retailprice) AS aic, count(*) AS n, min(p_size) / 100.0::DOUBLE AS p, max(p_size) % 3 AS n_metrics, avg(p_size) / 50.0::DOUBLE AS r_sq FROM part GROUP BY 1, 2)"


def fit_view(s, d):
    fits(s, d).createOrReplaceTempView("cadenza_fits")
    return s


RANK_HITS = "SELECT roi, model_name, rank() OVER (PARTITION BY roi ORDER BY aic) AS place, aic FROM {t} WHERE p < 0.1"
VS_BASELINE = "SELECT a.roi, a.model_name, a.aic - b.aic AS delta_aic FROM {t} a JOIN (SELECT roi, max(aic) AS aic FROM {t} WHERE n_metrics = 0 GROUP BY roi) b ON a.roi = b.roi WHERE a.n_metrics > 0"
BETTER_PAIRS = "SELECT roi, model_name, aic FROM {t} f WHERE n_metrics = 2 AND aic < (SELECT min(aic) FROM {t} g WHERE g.roi = f.roi AND g.n_metrics = 1)"


def evals(s, d):
    return V.predictions(s, d)


EVAL = """e AS (SELECT *, rank() OVER (PARTITION BY {k} ORDER BY actual) + (count(*) OVER (PARTITION BY {k}, actual) - 1) / 2.0 AS ra,
 rank() OVER (PARTITION BY {k} ORDER BY predicted) + (count(*) OVER (PARTITION BY {k}, predicted) - 1) / 2.0 AS rp FROM predictions)"""
EVAL_COLUMNS = "count(*) AS n_obs, corr(actual, predicted) AS pearson_r, sqrt(avg(pow(actual - predicted, 2))) / 1000 AS rmse_k, avg(abs(actual - predicted)) / 1000 AS mae_k"


def in_thousands(df):
    return df.withColumns({"rmse_k": F.col("rmse") / 1000, "mae_k": F.col("mae") / 1000})


def ordinary(terms, by):
    """SQL of the two-term least-squares fit by normal equations: coefficients b0, b1, b2."""
    x, y = terms
    return f"""s AS (SELECT {by}, count(*) AS n, avg({x}) AS mx, avg({y}) AS mz, avg(pain_rating) AS my, covar_pop({x}, {x}) AS xx, covar_pop({y}, {y}) AS zz, covar_pop({x}, {y}) AS xz, covar_pop({x}, pain_rating) AS xy, covar_pop({y}, pain_rating) AS zy FROM tr GROUP BY {by}),
    c AS (SELECT {by}, n, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS b1, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS b2, mx, mz, my FROM s), f AS (SELECT {by}, n, my - b1 * mx - b2 * mz AS b0, b1, b2 FROM c)"""


def train(s, d, group):
    return split_trials(s, d).join(_split(s, d).where(F.col("split_group") == group).select("subject"), "subject", "left_semi").where("laser_power IS NOT NULL")


def channel_vs_source(s, d):
    """Subjects' mean R2 over all units against that of the best unit of their group."""
    r2 = S.per_subject_r2(wide(s, d).withColumn("concept", F.col("subject") % 5), ["concept", "subject", "unit"], "quantity", "extendedprice")
    best = r2.join(D.best_unit(r2, "concept", "unit", "r2"), ["concept", "unit"]).select("subject", F.col("r2").alias("source"))
    both = r2.groupBy("subject").agg(F.avg("r2").alias("channel")).join(best, "subject").withColumn("g", F.lit(1))
    return L.ttest_statistics(both, ["g"], "channel", "source")


def screened(s, d):
    """The long metrics, each with the price of its row."""
    return wide(s, d).withColumn("y", F.col("extendedprice")).unpivot(["subject", "trial", "unit", "y"], ["quantity", "extendedprice", "discount", "tax"], "metric_name", "metric_value")


def covariates(s, d):
    """Trials with their subject's age, sex, cap and experiment."""
    people = V.subjects(s, d).select("subject", (F.col("age") / 50.0).alias("age"), "sex")
    return split_trials(s, d).join(people, "subject")


def r_squared(terms, by, name, rows):
    """SQL of the share of variance that the two-term least-squares fit explains, of each group."""
    x, y = terms
    return f"""{name}_s AS (SELECT {by}, count(*) AS n, count(DISTINCT subject) AS people, covar_pop({x}, {x}) AS xx, covar_pop({y}, {y}) AS zz, covar_pop({x}, {y}) AS xz, covar_pop({x}, pain_rating) AS xy, covar_pop({y}, pain_rating) AS zy, var_pop(pain_rating) AS yy FROM {rows} GROUP BY {by}),
    {name} AS (SELECT {by}, n, people, sqrt(greatest(0, ((xy * zz - zy * xz) * xy + (zy * xx - xy * xz) * zy) / (xx * zz - xz * xz) / yy)) AS r FROM {name}_s)"""


def report(s, d):
    """Paired tests, model fits and effects of one data set as flat rows."""
    return L.results_report(
        {
            "paired tests": (L.ttest_statistics(two_metrics(s, d), ["g"], "x", "y"), "g", "t", None),
            "model fits": (fits(s, d), "concat(roi, ' ', model_name)", "aic", "p"),
            "screens": (L.linear_screen(screened(s, d), "y"), "concat(unit, ' ', metric_name)", "r2", None),
        },
        0.1,
    )


def replicate_rows(s, d):
    return V.trials(s, d).where("laser_power IS NOT NULL")


QUERIES = {
    "e30_unit_means": q(lambda s, d: S.subject_unit_means(wide(s, d), ["subject", "unit"], ["quantity", "discount"]), "subject unit n_trials", "quantity discount", "SELECT subject, unit, avg(quantity) AS quantity, avg(discount) AS discount, count(*) AS n_trials FROM metrics_wide GROUP BY ALL", "metrics_wide"),
    "e31_group_shares": q(lambda s, d: S.group_shares(_split(s, d), "cap_size", "split_group"), "cap_size split_group n", "share", SPLIT + " SELECT cap_size, split_group, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY cap_size) AS share FROM split GROUP BY cap_size, split_group", "subjects"),
    "e32_distinct_units": q(lambda s, d: S.distinct_units(wide(s, d), _split(s, d)), "unit", "", SPLIT + " SELECT DISTINCT unit FROM metrics_wide WHERE subject IN (SELECT subject FROM split WHERE split_group = 'train')", "subjects metrics_wide"),
    "e33_pivot_metrics": q(lambda s, d: S.pivot_metrics(V.metrics_long(s, d), ["subject", "trial", "unit"], ["discount", "tax"]), "subject trial unit", "discount tax", "SELECT subject, trial, unit, discount, tax FROM metrics_wide", "metrics_wide"),
    "e34_eval_metrics": q(lambda s, d: in_thousands(S.eval_metrics(evals(s, d), ["model"], "actual", "predicted")), "model n_obs", "pearson_r spearman_rho rmse_k mae_k r_sq", f"WITH {EVAL.format(k='model')} SELECT model, {EVAL_COLUMNS}, corr(ra, rp) AS spearman_rho, pow(corr(actual, predicted), 2) AS r_sq FROM e GROUP BY model", "predictions"),
    "e35_per_subject_r2": q(lambda s, d: S.per_subject_r2(evals(s, d), ["fold"], "actual", "predicted"), "fold n", "r2", "SELECT fold, count(*) AS n, pow(corr(actual, predicted), 2) AS r2 FROM predictions GROUP BY fold", "predictions"),
    "e36_fold_summary": q(lambda s, d: S.fold_summary(S.eval_metrics(evals(s, d), ["model", "fold"], "actual", "predicted", False), ["model"], ["pearson_r", "r_sq"]), "model n_complete", "pearson_r_mean pearson_r_sd r_sq_mean r_sq_sd", "WITH f AS (SELECT model, fold, CASE WHEN count(*) >= 3 AND var_pop(actual) > 0 AND var_pop(predicted) > 0 THEN corr(actual, predicted) END AS r FROM predictions GROUP BY ALL) SELECT model, count(r) AS n_complete, avg(r) AS pearson_r_mean, stddev_samp(r) AS pearson_r_sd, avg(r * r) AS r_sq_mean, stddev_samp(r * r) AS r_sq_sd FROM f GROUP BY model", "predictions"),
    "e37_ci_quantiles": q(lambda s, d: S.ci_quantiles(wide(s, d), ["unit"], "discount", 0.09), "unit wide", "ci_low median ci_high width", "WITH x AS (SELECT unit, quantile_cont(discount, 0.025) AS a, median(discount) AS b, quantile_cont(discount, 0.975) AS c FROM metrics_wide GROUP BY unit) SELECT unit, a AS ci_low, b AS median, c AS ci_high, c - a AS width, c - a >= 0.09 AS wide FROM x", "metrics_wide"),
    "e38_mean_se": q(lambda s, d: S.mean_se(wide(s, d), ["unit"], "quantity"), "unit n", "mean se", "SELECT unit, avg(quantity) AS mean, stddev_samp(quantity) / sqrt(count(quantity)) AS se, count(quantity) AS n FROM metrics_wide GROUP BY unit", "metrics_wide"),
    "e39_concordance": q(lambda s, d: S.concordance_summary(two_metrics(s, d).withColumn("r", (F.col("x") - F.col("y")) / (F.col("x") + F.col("y"))), ["g"], "r"), "g n_same_sign n", "mean_r", f"WITH {TWO}, r AS (SELECT g, (x - y) / (x + y) AS r FROM two) SELECT g, avg(r) AS mean_r, count(*) FILTER (r > 0) AS n_same_sign, count(r) AS n FROM r GROUP BY g", "trials"),
    "e39_domain_vote": q(lambda s, d: S.domain_vote(two_metrics(s, d).withColumn("delta", F.col("x") - F.col("y")), "delta"), "source_better channel_better n", "", f"WITH {TWO} SELECT count(*) FILTER (x - y > 2) AS source_better, count(*) FILTER (x - y < -2) AS channel_better, count(*) AS n FROM two", "trials"),
    "e40_flag_rate": q(lambda s, d: E.flag_rate(wide(s, d).withColumn("flag", F.col("quantity") < 5), ["unit"], "flag"), "unit", "pct", "SELECT unit, 100.0 * avg((quantity < 5)::INT) AS pct FROM metrics_wide GROUP BY unit", "metrics_wide"),
    "e41_grouping_sets": q(lambda s, d: S.grouping_sets(split_trials(s, d), [["unit"], ["unit", "cap_size"], ["unit", "cap_size", "subject"]], [F.avg("pain_rating").alias("mean"), F.count("*").alias("n")]), "level unit cap_size subject n", "mean", f"WITH {TRIALS} SELECT CASE WHEN grouping(cap_size) = 1 THEN 'unit' WHEN grouping(subject) = 1 THEN 'unit+cap_size' ELSE 'unit+cap_size+subject' END AS level, unit, cap_size, subject, count(*) AS n, avg(pain_rating) AS mean FROM m GROUP BY GROUPING SETS ((unit), (unit, cap_size), (unit, cap_size, subject))", "trials subjects"),
    "e41_hemispheres": q(lambda s, d: S.by_hemisphere(wide(s, d).withColumn("roi", F.concat("unit", F.element_at(F.array(F.lit("-lh"), F.lit("-rh"), F.lit("")), (F.col("trial") % 3 + 1).cast("int")))), "roi", [F.avg("tax").alias("tax"), F.count("*").alias("n")]), "region hemi n", "tax", "SELECT unit AS region, 'combined' AS hemi, count(*) AS n, avg(tax) AS tax FROM metrics_wide GROUP BY unit UNION ALL SELECT unit, CASE trial % 3 WHEN 0 THEN 'lh' ELSE 'rh' END, count(*), avg(tax) FROM metrics_wide WHERE trial % 3 < 2 GROUP BY 1, 2", "metrics_wide"),
    "e42_heatmap": q(lambda s, d: S.heatmap(V.metrics_long(s, d), "discount"), "subject trial", "metric_value", "SELECT subject, trial, avg(discount) AS metric_value FROM metrics_wide GROUP BY ALL", "metrics_wide"),
    "e43_color_limits": q(lambda s, d: S.color_limits(V.samples(s, d), ["subject"], "x"), "subject", "vmin vmax", "WITH x AS (SELECT subject, quantile_cont(x, 0.02) AS a, quantile_cont(x, 0.98) AS b FROM samples GROUP BY subject) SELECT subject, CASE WHEN a < 0 AND b > 0 THEN -greatest(abs(a), abs(b)) ELSE a END AS vmin, CASE WHEN a < 0 AND b > 0 THEN greatest(abs(a), abs(b)) ELSE b END AS vmax FROM x", "samples"),
    "e44_histogram": q(lambda s, d: S.histogram(V.phase(s, d), "phase", 0.0, 6.283185307179586, 24, ["unit"]), "unit bin n", "share", "WITH b AS (SELECT unit, least(23, floor(phase / (6.283185307179586 / 24)))::INT AS bin FROM phase) SELECT unit, bin, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY unit) AS share FROM b GROUP BY unit, bin", "phase"),
    "e47_coverage": q(lambda s, d: S.coverage_report(V.trials(s, d).join(V.subjects(s, d), "subject", "left"), "subject", ["age", "sex", "cap_size"]), "n_rows n_subjects missing_age missing_sex missing_cap_size", "", "SELECT count(*) AS n_rows, count(DISTINCT subject) AS n_subjects, count(*) FILTER (age IS NULL) AS missing_age, count(*) FILTER (sex IS NULL) AS missing_sex, count(*) FILTER (cap_size IS NULL) AS missing_cap_size FROM trials LEFT JOIN subjects USING (subject)", "trials subjects"),
    "f1_trial_index": q(lambda s, d: W.trial_index(V.trials(s, d).where("unit <> 'view'"), ["subject"], "trial"), "subject trial trial_index", "", "SELECT subject, trial, row_number() OVER (PARTITION BY subject ORDER BY trial) AS trial_index FROM trials WHERE unit <> 'view'", "trials"),
    "f2_global_ordinal": q(lambda s, d: W.global_ordinal(V.subjects(s, d), ["experiment_id", "subject"]), "subject uid ordinal", "", "SELECT subject, uid, row_number() OVER (ORDER BY experiment_id, subject) AS ordinal FROM subjects", "subjects"),
    "f3_zscore": q(lambda s, d: W.zscore(wide(s, d), ["discount", "tax"], ["unit"]), "subject trial unit", "discount_z tax_z", "SELECT subject, trial, unit, (discount - avg(discount) OVER w) / stddev_samp(discount) OVER w AS discount_z, (tax - avg(tax) OVER w) / stddev_samp(tax) OVER w AS tax_z FROM metrics_wide WINDOW w AS (PARTITION BY unit)", "metrics_wide"),
    "f4_successive_diff": q(lambda s, d: W.successive_diff(V.trials(s, d), ["subject", "unit"], "trial", "pain_rating"), "subject trial", "diff", "SELECT subject, trial, pain_rating - lag(pain_rating) OVER (PARTITION BY subject, unit ORDER BY trial) AS diff FROM trials", "trials"),
    "f5_fdr_bh": q(lambda s, d: W.fdr_bh(fits(s, d).withColumn("p", F.when(F.col("p") < 0.45, F.col("p"))), ["roi"], "p", "model_name"), "roi model_name", "p p_adj", f"WITH {FITS}, r AS (SELECT roi, model_name, p, row_number() OVER (PARTITION BY roi ORDER BY p, model_name) AS r, count(*) OVER (PARTITION BY roi) AS n FROM fits WHERE p < 0.45) SELECT roi, model_name, p, least(1, min(p * n / r) OVER (PARTITION BY roi ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS p_adj FROM r UNION ALL SELECT roi, model_name, NULL, NULL FROM fits WHERE p >= 0.45"),
    "f6_avg_rank": q(lambda s, d: W.avg_rank(V.trials(s, d), ["unit"], "laser_power"), "subject trial", "rank", "SELECT subject, trial, rank() OVER (PARTITION BY unit ORDER BY laser_power NULLS FIRST) + (count(*) OVER (PARTITION BY unit, laser_power) - 1) / 2.0 AS rank FROM trials", "trials"),
    "f7_delta_aic": q(lambda s, d: W.delta_aic(fits(s, d), "roi"), "roi model_name", "delta_aic", f"WITH {FITS} SELECT roi, model_name, aic - min(aic) OVER (PARTITION BY roi) AS delta_aic FROM fits"),
    "f8_moving_mean": q(lambda s, d: W.moving_mean(V.samples(s, d), ["subject", "trial"], "i", "x", 6), "subject trial i", "smooth", "SELECT subject, trial, i, avg(x) OVER (PARTITION BY subject, trial ORDER BY i ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS smooth FROM samples", "samples"),
    "f9_mask_intervals": q(lambda s, d: W.mask_to_intervals(V.samples(s, d).withColumn("bad", F.abs("x") > 0.15), ["subject", "trial"], "bad"), "subject trial start end", "", 'WITH b AS (SELECT subject, trial, i, i - row_number() OVER (PARTITION BY subject, trial ORDER BY i) AS g FROM samples WHERE abs(x) > 0.15) SELECT subject, trial, min(i) AS start, max(i) AS "end" FROM b GROUP BY subject, trial, g', "samples"),
    "f10_autocorrelation": q(lambda s, d: W.autocorrelation(V.trials(s, d), ["subject"], "trial", "pain_rating"), "subject lag n", "acf bound", "WITH x AS (SELECT subject, row_number() OVER (PARTITION BY subject ORDER BY trial) AS k, count(*) OVER (PARTITION BY subject) AS n, pain_rating - avg(pain_rating) OVER (PARTITION BY subject) AS v FROM trials), c AS (SELECT a.subject, l AS lag, max(a.n) AS n, sum(a.v * b.v) AS s FROM x a JOIN range(11) AS r(l) ON l <= least(10, floor(a.n / 3)) JOIN x b ON a.subject = b.subject AND b.k = a.k + l WHERE a.n >= 6 GROUP BY a.subject, l) SELECT subject, lag, n, s / max(s) FILTER (lag = 0) OVER (PARTITION BY subject) AS acf, 1.96 / sqrt(n) AS bound FROM c", "trials"),
    "f12_latest": q(lambda s, d: W.latest_per_key(V.table(s, d, "orders"), ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")), "o_custkey o_orderkey", "", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1"),
    "f13_cumulative_offset": q(lambda s, d: W.cumulative_offset(V.signals(s, d).withColumn("n", F.size("samples") + F.col("trial") % 3), ["subject"], "trial", "n"), "subject trial offset", "", 'SELECT subject, trial, (sum(n) OVER (PARTITION BY subject ORDER BY trial) - n)::BIGINT AS "offset" FROM (SELECT subject, trial, len(samples) + trial % 3 AS n FROM signals)', "signals"),
    "f15_first_crossing": q(lambda s, d: W.first_crossing(curve(s, d), ["metric"], "n", "power", 0.8), "metric n_required achieved", "max_power", f"WITH {CURVE} SELECT metric, min(n) FILTER (power >= 0.8) AS n_required, max(power) >= 0.8 AS achieved, max(power) AS max_power FROM curve GROUP BY metric"),
    "f16_percentile_flag": q(lambda s, d: W.percentile_flag(wide(s, d), ["unit"], "extendedprice", 0.05), "subject trial unit flag", "", "SELECT subject, trial, unit, (extendedprice < p)::INT AS flag FROM metrics_wide JOIN (SELECT unit, quantile_cont(extendedprice, 0.05) AS p FROM metrics_wide GROUP BY unit) USING (unit)", "metrics_wide"),
    "g1_extreme_trials": q(lambda s, d: S.extreme_trials(V.trials(s, d), ["subject"], "pain_rating", "laser_power"), "subject trial", "", "WITH r AS (SELECT subject, trial, row_number() OVER (PARTITION BY subject ORDER BY pain_rating, trial) AS a, row_number() OVER (PARTITION BY subject ORDER BY laser_power DESC NULLS LAST, trial) AS b, row_number() OVER (PARTITION BY subject ORDER BY laser_power NULLS FIRST, trial) AS c, row_number() OVER (PARTITION BY subject ORDER BY pain_rating DESC, trial) AS e FROM trials) SELECT subject, trial FROM r WHERE a <= 2 OR b <= 2 OR c <= 1 OR e <= 1", "trials"),
    "g2_strongest_peak": q(lambda s, d: V.table(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct((F.col("l_quantity") / 2).alias("cf"), F.col("l_extendedprice").alias("pw"), F.col("l_discount").alias("bw"))).alias("peaks")).withColumn("top", S.strongest_peak("peaks", 8.0, 13.0)).selectExpr("l_orderkey", "-top.neg_cf AS cf", "top.pw AS pw"), "l_orderkey", "cf pw", "SELECT l_orderkey, arg_max(l_quantity / 2, (l_extendedprice, -l_quantity)) FILTER (l_quantity / 2 BETWEEN 8 AND 13) AS cf, max(l_extendedprice) FILTER (l_quantity / 2 BETWEEN 8 AND 13) AS pw FROM lineitem GROUP BY l_orderkey"),
    "g3_best_per_group": q(lambda s, d: S.best_per_group(fits(s, d), "roi", "aic", "model_name"), "roi model_name", "aic", f"WITH {FITS} SELECT roi, model_name, aic FROM (SELECT *, row_number() OVER (PARTITION BY roi ORDER BY aic, model_name) AS r FROM fits) WHERE r = 1"),
    "g4_binding_constraint": q(lambda s, d: S.binding_constraint(W.first_crossing(curve(s, d), ["metric"], "n", "power", 0.8).withColumn("target", F.col("metric") % 3), "target", "metric"), "target metric n_required", "", f"WITH {CURVE}, r AS (SELECT metric, metric % 3 AS target, min(n) FILTER (power >= 0.8) AS n_required FROM curve GROUP BY metric) SELECT target, arg_max(metric, (n_required, metric)) FILTER (n_required IS NOT NULL) AS metric, max(n_required) AS n_required FROM r GROUP BY target"),
    "g5_order_subjects": q(lambda s, d: S.ranked(unit_means(s, d).groupBy("subject").agg(F.avg("v").alias("mean_r")), F.desc("mean_r")), "subject", "mean_r", "SELECT subject, avg(v) AS mean_r FROM (SELECT subject, unit, avg(pain_rating) AS v FROM trials GROUP BY ALL) GROUP BY subject ORDER BY 2 DESC", "trials"),
    "g7_first_trials": q(lambda s, d: S.first_trials(V.trials(s, d), 5), "subject trial unit", "", "SELECT subject, trial, unit FROM trials WHERE trial <= 5", "trials"),
    "g8_model_ranking": q(lambda s, d: S.ranked(fits(s, d), F.asc("aic"), F.asc("roi"), F.asc("model_name")), "roi model_name", "aic", f"WITH {FITS} SELECT roi, model_name, aic FROM fits ORDER BY aic"),
    "l1_paired_ttest": q(lambda s, d: L.ttest_statistics(two_metrics(s, d), ["g"], "x", "y"), "g n", "mean_diff t d_z", f"WITH {TWO} SELECT g, count(x - y) AS n, avg(x - y) AS mean_diff, avg(x - y) / (stddev_samp(x - y) / sqrt(count(x - y))) AS t, avg(x - y) / stddev_samp(x - y) AS d_z FROM two GROUP BY g HAVING count(x - y) >= 3", "trials"),
    "l1_paired_ttest_p": q(lambda s, d: L.paired_ttest(two_metrics(s, d), ["g"], "x", "y"), "g n", "mean_diff t df p d_z se"),
    "l2_pairwise_fdr": q(lambda s, d: L.pairwise_paired_fdr(unit_means(s, d), "subject", "unit", "v"), "unit_a unit_b n", "t p p_adj"),
    "l2_pairwise_t": q(lambda s, d: L.pairwise_paired_fdr(unit_means(s, d), "subject", "unit", "v"), "unit_a unit_b n", "mean_diff t df d_z", "WITH m AS (SELECT subject, unit, avg(pain_rating) AS v FROM trials GROUP BY ALL), x AS (SELECT a.unit AS unit_a, b.unit AS unit_b, a.v - b.v AS e FROM m a JOIN m b ON a.subject = b.subject AND a.unit < b.unit) SELECT unit_a, unit_b, count(e) AS n, avg(e) AS mean_diff, avg(e) / (stddev_samp(e) / sqrt(count(e))) AS t, count(e) - 1 AS df, avg(e) / stddev_samp(e) AS d_z FROM x GROUP BY ALL HAVING count(e) >= 3", "trials"),
    "l3_rm_anova_f": q(lambda s, d: L.rm_anova_sums(unit_means(s, d), "subject", "unit", "v"), "n k", "f df1 df2", "WITH c AS (SELECT subject, unit, avg(pain_rating) AS v FROM trials GROUP BY ALL), f AS (SELECT * FROM c WHERE subject IN (SELECT subject FROM c GROUP BY subject HAVING count(*) = (SELECT count(DISTINCT unit) FROM c))), g AS (SELECT avg(v) AS g FROM f), a AS (SELECT subject, avg(v) AS m FROM f GROUP BY subject), b AS (SELECT unit, avg(v) AS m FROM f GROUP BY unit), x AS (SELECT count(*) AS n, sum(pow(m - g, 2)) AS ss FROM a, g), y AS (SELECT count(*) AS k, sum(pow(m - g, 2)) AS ss FROM b, g), z AS (SELECT sum(pow(f.v - a.m - b.m + g, 2)) AS ss FROM f JOIN a USING (subject) JOIN b USING (unit), g) SELECT n, k, (n * y.ss / (k - 1)) / (z.ss / ((k - 1) * (n - 1))) AS f, k - 1 AS df1, (k - 1) * (n - 1) AS df2 FROM x, y, z", "trials"),
    "l3_rm_anova": q(lambda s, d: L.rm_anova(unit_means(s, d), "subject", "unit", "v"), "n k", "f df1 df2 epsilon p p_gg"),
    "l4_channel_vs_source": q(channel_vs_source, "n", "mean_diff t d_z", "WITH r AS (SELECT subject % 5 AS concept, subject, unit, pow(CASE WHEN count(*) >= 3 AND var_pop(quantity) > 0 AND var_pop(extendedprice) > 0 THEN corr(quantity, extendedprice) END, 2) AS r2 FROM metrics_wide GROUP BY ALL), b AS (SELECT concept, unit, row_number() OVER (PARTITION BY concept ORDER BY avg(r2) DESC, unit) AS k FROM r GROUP BY concept, unit), best AS (SELECT r.subject, r.r2 FROM r JOIN b USING (concept, unit) WHERE k = 1), ch AS (SELECT subject, avg(r2) AS r2 FROM r GROUP BY subject), x AS (SELECT ch.r2 - best.r2 AS d FROM ch JOIN best USING (subject)) SELECT count(d) AS n, avg(d) AS mean_diff, avg(d) / (stddev_samp(d) / sqrt(count(d))) AS t, avg(d) / stddev_samp(d) AS d_z FROM x", "metrics_wide"),
    "l5_rayleigh_fdr": q(lambda s, d: W.fdr_bh(E.rayleigh(V.phase(s, d), ["subject", "unit"]), ["unit"], "p", "subject"), "subject unit n", "r p p_adj", "WITH x AS (SELECT subject, unit, count(*) AS n, sqrt(pow(avg(cos(phase)), 2) + pow(avg(sin(phase)), 2)) AS r FROM phase GROUP BY ALL HAVING count(*) >= 5), y AS (SELECT *, n * r * r AS z FROM x), w AS (SELECT *, greatest(0, least(1, exp(-z) * (1 + (2*z - z*z) / (4*n) - (24*z - 132*z*z + 76*z*z*z - 9*z*z*z*z) / (288*n*n)))) AS p FROM y), k AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY p, subject) AS i, count(*) OVER (PARTITION BY unit) AS m FROM w) SELECT subject, unit, n, r, p, least(1, min(p * m / i) OVER (PARTITION BY unit ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS p_adj FROM k", "phase"),
    "l6_permutation_p": q(lambda s, d: L.permutation_p(replicate_rows(s, d), ["unit"], "event_id", "laser_power", "pain_rating", 1000), "unit n_ge", "r p"),
    "l7_bootstrap_ci": q(lambda s, d: L.bootstrap_ci(V.predictions(s, d), ["model"], "fold", "actual", "predicted", 500), "model metric", "ci_low median ci_high"),
    "l8_linear_screen": q(lambda s, d: L.linear_screen(screened(s, d), "y"), "unit metric_name n", "slope r2", "SELECT unit, metric_name, count(*) AS n, corr(metric_value, y) AS slope, pow(corr(metric_value, y), 2) AS r2 FROM metrics_long JOIN (SELECT subject, trial, unit, extendedprice AS y FROM metrics_wide) USING (subject, trial, unit) GROUP BY ALL", "metrics_long metrics_wide"),
    "l10_safe_k": q(lambda s, d: L.safe_k(V.trials(s, d), ["subject", "unit"], "laser_power", 8), "subject unit k", "", "SELECT subject, unit, greatest(3, least(8, count(DISTINCT laser_power) - 1)) AS k FROM trials GROUP BY ALL", "trials"),
    "l11_guards": q(lambda s, d: L.model_matrix_guards(wide(s, d), ["subject"], ["unit", "discount"]), "subject use_unit use_discount", "", "SELECT subject, count(DISTINCT unit) > 1 AS use_unit, count(DISTINCT discount) > 1 AS use_discount FROM metrics_wide GROUP BY subject", "metrics_wide"),
    "l13_predict": q(lambda s, d: L.predict(train(s, d, "holdout"), L.solve(L.products(train(s, d, "train"), ["unit"], TERMS, "pain_rating")), ["unit"], TERMS), "subject trial unit", "predicted", SPLIT + f", {TRIALS}, tr AS (SELECT * FROM m JOIN split USING (subject) WHERE split_group = 'train' AND laser_power IS NOT NULL), {ordinary(TERMS, 'unit')} SELECT m.subject, m.trial, m.unit, b0 + b1 * laser_power + b2 * trial_z AS predicted FROM m JOIN f USING (unit) WHERE laser_power IS NOT NULL AND m.subject IN (SELECT subject FROM split WHERE split_group = 'holdout')", "subjects trials"),
    "l14_loso_cv": q(lambda s, d: L.loso_cv(split_trials(s, d), ["unit"], "cap_size", TERMS, "pain_rating")[0], "unit cap_size n_obs", "pearson_r rmse mae", f"WITH {TRIALS}, g AS (SELECT DISTINCT cap_size AS fold FROM m), tr AS (SELECT m.*, fold FROM m, g WHERE cap_size <> fold AND laser_power IS NOT NULL), {ordinary(TERMS, 'unit, fold')}, p AS (SELECT m.unit, cap_size, pain_rating, b0 + b1 * laser_power + b2 * trial_z AS y FROM m JOIN f ON f.unit = m.unit AND f.fold = m.cap_size WHERE laser_power IS NOT NULL) SELECT unit, cap_size, count(*) AS n_obs, corr(pain_rating, y) AS pearson_r, sqrt(avg(pow(pain_rating - y, 2))) AS rmse, avg(abs(pain_rating - y)) AS mae FROM p GROUP BY unit, cap_size", "trials subjects"),
    "l14_loso_subjects": q(lambda s, d: L.loso_cv(split_trials(s, d), ["unit"], "subject", TERMS, "pain_rating")[1], "unit n_complete", "pearson_r_mean rmse_mean mae_mean"),
    "l15_external_cv": q(lambda s, d: L.external_cv(train(s, d, "holdout"), L.solve(L.products(train(s, d, "train"), ["unit"], TERMS, "pain_rating")), ["unit"], TERMS, "pain_rating", ["cap_size", "subject"]), "unit cv_type fold_id n_obs", "pearson_r rmse mae", SPLIT + f", {TRIALS}, tr AS (SELECT * FROM m JOIN split USING (subject) WHERE split_group = 'train' AND laser_power IS NOT NULL), {ordinary(TERMS, 'unit')}, p AS (SELECT m.unit, cap_size, m.subject, pain_rating AS o, b0 + b1 * laser_power + b2 * trial_z AS y FROM m JOIN f USING (unit) WHERE laser_power IS NOT NULL AND m.subject IN (SELECT subject FROM split WHERE split_group = 'holdout')) SELECT unit, CASE WHEN grouping(cap_size) = 0 THEN 'cap_size' WHEN grouping(subject) = 0 THEN 'subject' ELSE 'overall' END AS cv_type, CASE WHEN grouping(cap_size) = 0 THEN cap_size WHEN grouping(subject) = 0 THEN subject::VARCHAR ELSE 'all' END AS fold_id, count(*) AS n_obs, CASE WHEN count(*) >= 3 AND var_pop(o) > 0 AND var_pop(y) > 0 THEN corr(o, y) END AS pearson_r, sqrt(avg(pow(o - y, 2))) AS rmse, avg(abs(o - y)) AS mae FROM p GROUP BY GROUPING SETS ((unit), (unit, cap_size), (unit, subject))", "subjects trials"),
    "l16_sensitivity_drop": q(lambda s, d: L.sensitivity_drop(split_trials(s, d), ["unit"], "experiment_id", TERMS, "pain_rating"), "unit experiment_id", "r_full r_without delta_r", f"WITH {TRIALS}, ok AS (SELECT * FROM m WHERE laser_power IS NOT NULL AND pain_rating IS NOT NULL), g AS (SELECT DISTINCT experiment_id AS fold FROM ok), tr AS (SELECT ok.*, fold FROM ok, g WHERE experiment_id <> fold), {r_squared(TERMS, 'unit', 'w', 'ok')}, {r_squared(TERMS, 'unit, fold', 'o', 'tr')} SELECT unit, fold AS experiment_id, w.r AS r_full, o.r AS r_without, o.r - w.r AS delta_r FROM o JOIN w USING (unit) WHERE (unit, fold) IN (SELECT (unit, experiment_id) FROM ok)", "subjects trials"),
    "l16_sensitivity_qc": q(lambda s, d: L.sensitivity_qc(split_trials(s, d).withColumn("fit_r2", F.col("subject") % 10 / 10.0), ["unit"], "fit_r2", [0.3, 0.5, 0.6], TERMS, "pain_rating", "subject"), "unit n n_subjects", "limit r", f"WITH {TRIALS}, ok AS (SELECT m.*, lim FROM m, (VALUES (3), (5), (6)) AS v(lim) WHERE subject % 10 >= lim), pe AS (SELECT unit, lim, count(DISTINCT subject) AS n_subjects FROM ok GROUP BY ALL), tr AS (SELECT * FROM ok WHERE laser_power IS NOT NULL AND pain_rating IS NOT NULL), {r_squared(TERMS, 'unit, lim', 'w', 'tr')} SELECT unit, lim / 10.0 AS \"limit\", n, n_subjects, r FROM w JOIN pe USING (unit, lim) WHERE n_subjects >= 5", "subjects trials"),
    "l17_split_half": q(lambda s, d: L.split_half_stability(split_trials(s, d), ["unit"], "subject", "cap_size", TERMS, "pain_rating", 50), "unit rep", "r"),
    "l18_smooth_effect": q(lambda s, d: L.smooth_effect(L.solve(L.products(split_trials(s, d), ["unit"], TERMS, "pain_rating")), 1, 0.0, 2.0), "unit", "x effect se low high", f"WITH {TRIALS}, tr AS (SELECT * FROM m WHERE laser_power IS NOT NULL), s AS (SELECT unit, count(*) AS n, avg(laser_power) AS mx, covar_pop(laser_power, laser_power) AS xx, covar_pop(trial_z, trial_z) AS zz, covar_pop(laser_power, trial_z) AS xz, covar_pop(laser_power, pain_rating) AS xy, covar_pop(trial_z, pain_rating) AS zy, var_pop(pain_rating) AS yy FROM tr GROUP BY unit), b AS (SELECT *, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS b1, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS b2 FROM s), v AS (SELECT *, sqrt(n * (yy - b1 * xy - b2 * zy) / (n - 3) * zz / (n * (xx * zz - xz * xz))) AS sb FROM b), x AS (SELECT unit, k * 2.0 / 199 AS x, b1 * (k * 2.0 / 199 - mx) AS effect, abs(k * 2.0 / 199 - mx) * sb AS se FROM v, range(200) AS r(k)) SELECT unit, x, effect, se, effect - 1.96 * se AS low, effect + 1.96 * se AS high FROM x", "subjects trials"),
    "l19_concordance": q(lambda s, d: L.smooth_concordance(*[V.trials(s, d).where(f"subject % 2 = {k}").groupBy("unit", F.col("laser_power").alias("x")).agg(F.avg("pain_rating").alias("y")) for k in (0, 1)], ["unit"]), "unit same_sign", "r", "WITH a AS (SELECT unit, laser_power AS x, avg(pain_rating) FILTER (subject % 2 = 0) AS ya, avg(pain_rating) FILTER (subject % 2 = 1) AS yb FROM trials WHERE laser_power IS NOT NULL GROUP BY ALL) SELECT unit, corr(ya, yb) AS r, corr(ya, yb) > 0 AS same_sign FROM a WHERE ya IS NOT NULL AND yb IS NOT NULL GROUP BY unit", "trials"),
    "l20_fit_quality": q(lambda s, d: L.fit_quality_comparison(fits(s, d).groupBy("roi").agg(F.min("aic").alias("channel_aic"), F.max("aic").alias("source_aic"))), "roi", "delta_aic", f"WITH {FITS} SELECT roi, min(aic) - max(aic) AS delta_aic FROM fits GROUP BY roi"),
    "l21_variance_components": q(lambda s, d: L.variance_components(wide(s, d), ["unit"], "subject", "discount"), "unit n_subjects", "var_residual var_subject icc", "WITH o AS (SELECT unit, subject, count(*) AS m, avg(discount) AS a FROM metrics_wide GROUP BY ALL), g AS (SELECT unit, avg(discount) AS g FROM metrics_wide GROUP BY unit), w AS (SELECT unit, sum(pow(discount - a, 2)) AS sw, count(*) AS n FROM metrics_wide JOIN o USING (unit, subject) GROUP BY unit), b AS (SELECT unit, count(*) AS k, sum(m * pow(a - g, 2)) AS sb, sum(m * m) AS mm FROM o JOIN g USING (unit) GROUP BY unit), v AS (SELECT unit, k, sw / (n - k) AS vr, greatest(0, (sb / (k - 1) - sw / (n - k)) / ((n - mm / n) / (k - 1))) AS vs FROM b JOIN w USING (unit)) SELECT unit, k AS n_subjects, vr AS var_residual, vs AS var_subject, vs / (vs + vr) AS icc FROM v", "metrics_wide"),
    "l22_required_sample": q(lambda s, d: L.required_sample(curve(s, d), ["metric"], 0.8, 80), "metric n_required verdict", "", f"WITH {CURVE}, r AS (SELECT metric, min(n) FILTER (power >= 0.8) AS n_required FROM curve GROUP BY metric) SELECT metric, n_required, CASE WHEN n_required IS NULL THEN 'not reached' WHEN n_required <= 80 THEN 'sufficient' ELSE 'recruit more' END AS verdict FROM r"),
    "l23_results_report": q(report, "what name statistic significant", "value p", f"WITH {TWO}, {FITS}, t AS (SELECT g, avg(x - y) / (stddev_samp(x - y) / sqrt(count(x - y))) AS t FROM two GROUP BY g HAVING count(x - y) >= 3), r AS (SELECT unit, metric_name, pow(corr(metric_value, y), 2) AS r2 FROM metrics_long JOIN (SELECT subject, trial, unit, extendedprice AS y FROM metrics_wide) USING (subject, trial, unit) GROUP BY ALL) SELECT 'paired tests' AS what, g::VARCHAR AS name, 't' AS statistic, t AS value, NULL::DOUBLE AS p, NULL::BOOLEAN AS significant FROM t UNION ALL SELECT 'model fits', roi || ' ' || model_name, 'aic', aic, p, p < 0.1 FROM fits UNION ALL SELECT 'screens', unit || ' ' || metric_name, 'r2', r2, NULL, NULL FROM r", "trials metrics_long metrics_wide"),
    "l24_rank_hits": q(lambda s, d: fit_view(s, d).sql(RANK_HITS.format(t="cadenza_fits")), "roi model_name place", "aic", f"WITH {FITS} " + RANK_HITS.format(t="fits")),
    "l24_vs_baseline": q(lambda s, d: fit_view(s, d).sql(VS_BASELINE.format(t="cadenza_fits")), "roi model_name", "delta_aic", f"WITH {FITS} " + VS_BASELINE.format(t="fits")),
    "l24_better_pairs": q(lambda s, d: fit_view(s, d).sql(BETTER_PAIRS.format(t="cadenza_fits")), "roi model_name", "aic", f"WITH {FITS} " + BETTER_PAIRS.format(t="fits")),
}
