"""Queries of scans' reshaping, cleaning, filters, joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import cleaning as C
from cadenza.operators import features, filters, joins, sets, windows
from cadenza.plans import views as V
from cadenza.plans.spec import q
from cadenza.sources import sinks

METRICS = ["quantity", "extendedprice", "discount", "tax"]
EVENT_MAP = [("click", "stim", "high", 1), ("click", "late", "low", 2), ("view", "rest", "none", 3), ("purchase", "stim", "low", 4)]
MAP_SQL = "(VALUES ('click','stim','high',1),('click','late','low',2),('view','rest','none',3),('purchase','stim','low',4)) AS m(unit, condition, intensity, position)"


def _map(s):
    return s.createDataFrame(EVENT_MAP, "unit string, condition string, intensity string, position int")


def _split(s, d):
    return windows.quota_split(V.subjects(s, d), "cap_size", "subject")


SPLIT = """WITH ranked AS (SELECT subject, cap_size, row_number() OVER (PARTITION BY cap_size ORDER BY md5('42:' || subject::VARCHAR), subject) AS j FROM subjects),
split AS (SELECT subject, cap_size, CASE WHEN least(j, greatest(1, ceil(round(0.75 * (j - 1), 9)))) > CASE WHEN j = 1 THEN 0 ELSE least(j - 1, greatest(1, ceil(round(0.75 * (j - 2), 9)))) END
  THEN 'train' ELSE 'holdout' END AS split_group FROM ranked)"""

QUERIES = {
    "b4_harmonize_sex": q(
        lambda s, d: V.table(s, d, "customer").select("c_custkey", C.harmonize_sex(F.element_at(F.array(*map(F.lit, ("M", "female", " F ", "male", "?"))), (F.col("c_custkey") % 5 + 1).cast("int"))).alias("sex")),
        "c_custkey sex", "", "SELECT c_custkey, CASE lower(trim(CASE c_custkey % 5 WHEN 0 THEN 'M' WHEN 1 THEN 'female' WHEN 2 THEN ' F ' WHEN 3 THEN 'male' ELSE '?' END)) WHEN 'm' THEN 'M' WHEN 'male' THEN 'M' WHEN 'f' THEN 'F' WHEN 'female' THEN 'F' END AS sex FROM customer",
    ),
    "b5_experiment_from_path": q(
        lambda s, d: V.table(s, d, "pages").select("page_id", C.experiment_from_path(F.col("url"), ["html", "example", "com/"]).alias("experiment")), "page_id experiment", "",
        """SELECT page_id, CASE WHEN len(f) = 1 THEN f[1] WHEN len(f) = 0 AND len(p) = 1 THEN p[1] END AS experiment FROM (SELECT page_id,
        list_filter(['html','example','com/'], lambda n: contains(string_split(url, '/')[-1], n)) AS f, list_filter(['html','example','com/'], lambda n: contains(url, n)) AS p FROM pages)""",
    ),
    "b6_subject_uid": q(lambda s, d: V.subjects(s, d), "subject uid", "", "SELECT subject, uid FROM subjects", "subjects"),
    "b7_parse_subject_ids": q(lambda s, d: C.parse_subject_ids(V.table(s, d, "customer"), "c_name"), "subject", "", r"SELECT DISTINCT regexp_extract(c_name, '([0-9]+)$', 1)::INT AS subject FROM customer WHERE regexp_extract(c_name, '([0-9]+)$', 1)::INT > 0"),
    "b8_coerce_numeric": q(lambda s, d: V.table(s, d, "events").select("event_id", C.coerce_numeric(F.when(F.col("event_id") % 7 == 0, "n/a").otherwise(F.col("value").cast("string"))).alias("x")), "event_id", "x", "SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS x FROM events"),
    "b9_factor_cast": q(lambda s, d: V.subjects(s, d).select("subject", C.factor_cast(F.col("experiment_id")).alias("experiment_f")), "subject experiment_f", "", "SELECT subject, experiment_id::VARCHAR AS experiment_f FROM subjects", "subjects"),
    "b10_prefix_columns": q(lambda s, d: C.prefix_columns(V.metrics_wide(s, d).select("subject", "trial", "unit", "discount", "tax"), "pre_", ["subject", "trial", "unit"]), "subject trial unit", "pre_discount pre_tax", "SELECT subject, trial, unit, discount AS pre_discount, tax AS pre_tax FROM metrics_wide", "metrics_wide"),
    "b11_merge_feature_sets": q(
        lambda s, d: features.merge_feature_sets([V.metrics_long(s, d), V.metrics_long(s, d).where("metric_name IN ('tax', 'discount')").withColumn("metric_value", F.col("metric_value") * 100)], ["subject", "trial", "unit"]),
        "subject trial unit metric_name", "metric_value", "SELECT subject, trial, unit, metric_name, metric_value * CASE WHEN metric_name IN ('tax','discount') THEN 100 ELSE 1 END AS metric_value FROM metrics_long", "metrics_long",
    ),
    "b12_label_normalise": q(lambda s, d: V.table(s, d, "part").select("p_partkey", C.label_normalise(F.when(F.col("p_partkey") % 3 == 0, " - ").otherwise(F.col("p_type")), F.col("p_partkey")).alias("label")), "p_partkey label", "", r"SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'Ch' || p_partkey ELSE regexp_replace(trim(p_type), '[\s-]', '', 'g') END AS label FROM part"),
    "b13_roi_label": q(lambda s, d: V.table(s, d, "part").select("p_partkey", C.roi_label_normalise(F.concat(F.when(F.col("p_partkey") % 2 == 0, "lh-").otherwise("mid-"), "p_brand")).alias("roi")), "p_partkey roi", "", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand || '-lh' ELSE 'mid-' || p_brand END AS roi FROM part"),
    "b14_hemisphere": q(
        lambda s, d: V.table(s, d, "part").select("p_partkey", F.concat("p_brand", F.element_at(F.array(F.lit("-lh"), F.lit("-rh"), F.lit("")), (F.col("p_partkey") % 3 + 1).cast("int"))).alias("u")).select("p_partkey", C.region(F.col("u")).alias("region"), C.hemisphere(F.col("u")).alias("hemi")),
        "p_partkey region hemi", "", "SELECT p_partkey, p_brand AS region, CASE p_partkey % 3 WHEN 0 THEN 'lh' WHEN 1 THEN 'rh' END AS hemi FROM part",
    ),
    "b15_sig_label": q(lambda s, d: V.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", C.sig_label(F.when(F.col("l_quantity") > 5, F.col("l_tax") * F.col("l_discount"))).alias("sig")), "l_orderkey l_linenumber sig", "", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 5 IS NOT TRUE THEN 'n/a' WHEN l_tax*l_discount < 0.001 THEN '***' WHEN l_tax*l_discount < 0.01 THEN '**' WHEN l_tax*l_discount < 0.05 THEN '*' ELSE 'ns' END AS sig FROM lineitem"),
    "b16_ab_channels": q(lambda s, d: V.table(s, d, "part").select("p_partkey", F.concat(F.element_at(F.array(*map(F.lit, "ABC")), (F.col("p_partkey") % 3 + 1).cast("int")), F.lpad(F.col("p_size").cast("string"), 3, "0")).alias("label")).where(C.is_ab_channel(F.col("label"))), "p_partkey label", "", "SELECT p_partkey, label FROM (SELECT p_partkey, substr('ABC', (p_partkey % 3 + 1)::INT, 1) || lpad(p_size::VARCHAR, 3, '0') AS label FROM part) WHERE regexp_full_match(label, '(A|B)0*[0-9]+')"),
    "b17_output_name": q(lambda s, d: V.table(s, d, "part").select("p_partkey", C.output_name(F.lit("sub-"), F.col("p_size"), F.array(F.lit("clean"), F.when(F.col("p_size") % 2 == 0, "epoched"))).alias("name")), "p_partkey name", "", "SELECT p_partkey, printf('sub-%03d', p_size) || '_clean' || CASE WHEN p_size % 2 = 0 THEN '_epoched' ELSE '' END AS name FROM part"),
    "b18_default_fill": q(lambda s, d: V.subjects(s, d).select("subject", C.default_fill(F.col("sex")).alias("sex")), "subject sex", "", "SELECT subject, coalesce(sex, 'unknown') AS sex FROM subjects", "subjects"),
    "b20_phase_components": q(lambda s, d: V.phase(s, d).withColumns(C.phase_components("phase")), "subject trial", "sin_phase cos_phase", "SELECT subject, trial, sin(phase) AS sin_phase, cos(phase) AS cos_phase FROM phase", "phase"),
    "c1_qc_complete": q(lambda s, d: filters.qc_complete(V.subjects(s, d), ["sex", "age"]), "subject sex", "age", "SELECT * FROM subjects WHERE sex IS NOT NULL AND age IS NOT NULL", "subjects"),
    "c2_qc_threshold": q(lambda s, d: filters.qc_threshold_or_null(V.metrics_wide(s, d).withColumn("fit", F.when(F.col("quantity") > 10, F.col("quantity") / 50)), "fit", 0.8), "subject trial unit", "fit", "SELECT * FROM (SELECT *, CASE WHEN quantity > 10 THEN quantity / 50 END AS fit FROM metrics_wide) WHERE fit IS NULL OR fit >= 0.8", "metrics_wide"),
    "c3_min_rows": q(lambda s, d: filters.min_rows_per_group(V.trials(s, d), ["subject", "unit"], 14), "subject trial unit", "", "SELECT * FROM trials WHERE (subject, unit) IN (SELECT (subject, unit) FROM trials GROUP BY subject, unit HAVING count(*) >= 14)", "trials"),
    "c4_split_filter": q(lambda s, d: filters.split_filter(V.metrics_long(s, d), _split(s, d), "holdout"), "subject trial unit metric_name", "metric_value", SPLIT + " SELECT m.* FROM metrics_long m WHERE subject IN (SELECT subject FROM split WHERE split_group = 'holdout')", "subjects metrics_long"),
    "c5_time_crop": q(lambda s, d: filters.time_crop(V.samples(s, d), -100.0, 250.0), "subject trial i", "x", "SELECT * FROM samples WHERE t_ms BETWEEN -100 AND 250", "samples"),
    "c6_band_mask": q(lambda s, d: V.psd(s, d).select("subject", "trial", "f", F.when(filters.in_band("f", 8, 12), 1).otherwise(0).alias("closed"), F.when(filters.in_band("f", 8, 12, True), 1).otherwise(0).alias("half_open")), "subject trial closed half_open", "f", "SELECT subject, trial, f, (f BETWEEN 8 AND 12)::INT AS closed, (f >= 8 AND f < 12)::INT AS half_open FROM psd", "psd"),
    "c7_complete_blocks": q(lambda s, d: filters.complete_blocks(V.metrics_wide(s, d), "subject", "unit"), "subject trial unit", "quantity", "SELECT * FROM metrics_wide WHERE subject IN (SELECT subject FROM metrics_wide GROUP BY subject HAVING count(DISTINCT unit) = (SELECT count(DISTINCT unit) FROM metrics_wide))", "metrics_wide"),
    "c8_usable_metrics": q(lambda s, d: filters.usable_metrics(V.metrics_long(s, d).withColumn("metric_value", F.when(F.col("metric_value") > 0.079, F.col("metric_value")))), "unit metric_name n", "", "SELECT unit, metric_name, count(CASE WHEN metric_value > 0.079 THEN 1 END) AS n FROM metrics_long GROUP BY ALL HAVING n > 1", "metrics_long"),
    "c9_significant_models": q(lambda s, d: filters.significant_models(V.table(s, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_linenumber AS n_metrics", "if(l_quantity > 45, 'NA', cast(l_tax AS string)) AS p", "if(l_discount > 0.08, null, l_discount) AS r_sq")), "l_orderkey l_linenumber", "r_sq", "SELECT l_orderkey, l_linenumber, l_discount AS r_sq FROM lineitem WHERE l_linenumber = 1 AND l_quantity <= 45 AND l_tax < 0.05 AND l_discount <= 0.08"),
    "c10_guarded_corr": q(lambda s, d: V.metrics_wide(s, d).groupBy("subject", "unit").agg(filters.guarded_corr("quantity", "discount").alias("r")), "subject unit", "r", "SELECT subject, unit, CASE WHEN count(*) >= 3 AND var_pop(quantity) > 0 AND var_pop(discount) > 0 THEN covar_pop(quantity, discount) / (stddev_pop(quantity) * stddev_pop(discount)) END AS r FROM metrics_wide GROUP BY ALL", "metrics_wide"),
    "c11_percentile_guard": q(lambda s, d: filters.percentile_guard(V.trials(s, d), ["subject", "unit"], "pain_rating"), "subject trial guard_ok", "p_low", "SELECT subject, trial, p_low, pain_rating > p_low AND pain_rating > 1e-12 AS guard_ok FROM trials JOIN (SELECT subject, unit, quantile_cont(pain_rating, 0.05) AS p_low FROM trials GROUP BY ALL) USING (subject, unit)", "trials"),
    "c12_roi_missing": q(lambda s, d: filters.roi_allow_list(V.trials(s, d), ["click", "view", "nowhere"])[1], "unit", "", "SELECT unit FROM (VALUES ('click'), ('view'), ('nowhere')) AS a(unit) WHERE unit NOT IN (SELECT unit FROM trials)", "trials"),
    "c13_validate_events": q(lambda s, d: filters.validate_events(V.trials(s, d), ["click", "view", "nowhere"], "unit"), "unit n", "", "SELECT unit, count(*) AS n FROM trials WHERE unit IN ('click', 'view', 'nowhere') GROUP BY unit", "trials"),
    "c14_validate_mapping": q(lambda s, d: filters.validate_mapping(_map(s).selectExpr("unit", "condition"), V.trials(s, d), "unit", "condition"), "problem label", "", f"WITH m AS (SELECT * FROM {MAP_SQL}) SELECT 'duplicate source' AS problem, unit AS label FROM m GROUP BY unit HAVING count(*) > 1 UNION ALL SELECT 'duplicate target', condition FROM m GROUP BY condition HAVING count(*) > 1 UNION ALL SELECT 'unmapped', unit FROM (SELECT DISTINCT unit FROM trials) WHERE unit NOT IN (SELECT unit FROM m)", "trials"),
    "c15_bad_samples": q(lambda s, d: filters.bad_samples(V.samples(s, d), ["subject", "trial"], 0.2), "subject trial i bad", "", "SELECT subject, trial, i, max(abs(x)) > 0.2 AS bad FROM samples GROUP BY ALL", "samples"),
    "c16_drop_unknown": q(lambda s, d: filters.drop_unknown_units(V.metrics_wide(s, d).withColumn("unit", F.when(F.col("unit") == "NO", "Unknown-1").otherwise(F.col("unit")))), "subject trial unit", "", "SELECT subject, trial, unit FROM metrics_wide WHERE unit <> 'NO'", "metrics_wide"),
    "d1_dimensions": q(lambda s, d: joins.left_dimensions(V.trials(s, d), (V.subjects(s, d), ["subject"])), "subject trial uid cap_size sex", "age", "SELECT t.subject, trial, uid, cap_size, sex, age FROM trials t LEFT JOIN subjects s USING (subject)", "trials subjects"),
    "d2_features_behaviour": q(lambda s, d: joins.features_with_behaviour(V.metrics_wide(s, d).select("subject", (F.col("trial") % 100).alias("trial"), "unit", "tax"), V.trials(s, d).select("subject", "trial", "pain_rating"), ["subject", "trial"], ["subject"]), "subject trial unit", "tax pain_rating", "SELECT m.subject, m.trial % 100 AS trial, m.unit, tax, pain_rating FROM metrics_wide m LEFT JOIN trials t ON m.subject = t.subject AND m.trial % 100 = t.trial WHERE m.subject IN (SELECT subject FROM trials)", "metrics_wide trials"),
    "d3_roi_behaviour": q(lambda s, d: joins.features_with_behaviour(V.metrics_wide(s, d).withColumn("trial", F.col("trial") % 50), V.trials(s, d).select("subject", "trial", "laser_power"), ["subject", "trial"], ["subject"]), "subject trial unit", "discount laser_power", "SELECT m.subject, m.trial % 50 AS trial, m.unit, discount, laser_power FROM metrics_wide m LEFT JOIN trials t ON m.subject = t.subject AND m.trial % 50 = t.trial WHERE m.subject IN (SELECT subject FROM trials)", "metrics_wide trials"),
    "d4_subject_fits": q(lambda s, d: joins.left_dimensions(V.trials(s, d), (V.metrics_wide(s, d).groupBy("subject").agg(F.avg("discount").alias("exponent")), ["subject"])), "subject trial", "exponent", "SELECT t.subject, trial, exponent FROM trials t LEFT JOIN (SELECT subject, avg(discount) AS exponent FROM metrics_wide GROUP BY subject) USING (subject)", "trials metrics_wide"),
    "d5_star": q(lambda s, d: joins.star(V.metrics_wide(s, d).withColumn("trial", F.col("trial") % 60 + 1), V.subjects(s, d).select("subject", "cap_size"), V.trials(s, d).select("subject", "trial", "pain_rating")), "subject trial unit cap_size", "quantity pain_rating", "SELECT subject, trial, m.unit, cap_size, quantity, pain_rating FROM (SELECT * REPLACE (trial % 60 + 1 AS trial) FROM metrics_wide) m JOIN subjects USING (subject) JOIN (SELECT subject, trial, pain_rating FROM trials) USING (subject, trial)", "metrics_wide subjects trials"),
    "d6_semi": q(lambda s, d: V.metrics_wide(s, d).join(V.trials(s, d).select("subject"), "subject", "left_semi"), "subject trial unit", "", "SELECT subject, trial, unit FROM metrics_wide WHERE subject IN (SELECT subject FROM trials)", "metrics_wide trials"),
    "d7_anti": q(lambda s, d: V.subjects(s, d).join(V.trials(s, d), "subject", "left_anti"), "subject uid", "", "SELECT subject, uid FROM subjects WHERE subject NOT IN (SELECT subject FROM trials)", "subjects trials"),
    "d8_full_merge": q(lambda s, d: joins.full_merge([V.metrics_wide(s, d).where("quantity < 20").select("subject", "trial", "unit", "tax"), V.metrics_wide(s, d).where("quantity > 15").select("subject", "trial", "unit", "tax", "discount")], ["subject", "trial", "unit"]), "subject trial unit", "tax discount", "SELECT coalesce(a.subject, b.subject) AS subject, coalesce(a.trial, b.trial) AS trial, coalesce(a.unit, b.unit) AS unit, a.tax, b.discount FROM (FROM metrics_wide WHERE quantity < 20) a FULL JOIN (FROM metrics_wide WHERE quantity > 15) b ON a.subject = b.subject AND a.trial = b.trial AND a.unit = b.unit", "metrics_wide"),
    "d9_unit_pairs": q(lambda s, d: joins.unit_pairs(V.trials(s, d).groupBy("subject", "unit").agg(F.avg("pain_rating").alias("v")), "subject", "unit", "v"), "subject unit_a unit_b", "a b", "WITH m AS (SELECT subject, unit, avg(pain_rating) AS v FROM trials GROUP BY ALL) SELECT x.subject, x.unit AS unit_a, y.unit AS unit_b, x.v AS a, y.v AS b FROM m x JOIN m y ON x.subject = y.subject AND x.unit < y.unit", "trials"),
    "d10_concept_map": q(
        lambda s, d: joins.concept_pairs(*[V.table(s, d, "part").where(w).groupBy(F.col("p_brand").alias("model_name")).agg(F.avg("p_retailprice").alias("aic")) for w in ("p_size <= 25", "p_size > 45")], V.table(s, d, "part").selectExpr("p_type AS concept", "p_brand AS channel_model", "p_brand AS source_model").distinct()),
        "concept channel_model source_model", "channel_aic source_aic",
        "WITH c AS (SELECT p_brand AS m, avg(p_retailprice) AS aic FROM part WHERE p_size <= 25 GROUP BY 1), e AS (SELECT p_brand AS m, avg(p_retailprice) AS aic FROM part WHERE p_size > 45 GROUP BY 1), k AS (SELECT DISTINCT p_type AS concept, p_brand AS m FROM part) SELECT concept, k.m AS channel_model, k.m AS source_model, c.aic AS channel_aic, e.aic AS source_aic FROM k JOIN c USING (m) LEFT JOIN e ON e.m = k.m",
    ),
    "d11_epochs_long": q(
        lambda s, d: joins.epochs_long(V.samples(s, d).groupBy("subject", "i").agg(F.sum("x").alias("x")), V.trials(s, d).selectExpr("subject % 10 AS subject", "event_id", "(event_id % 70) AS at"), 2, 5),
        "subject event_id offset", "x",
        "WITH r AS (SELECT subject, i, sum(x) AS x FROM samples GROUP BY ALL), e AS (SELECT subject % 10 AS subject, event_id, event_id % 70 AS pos FROM trials) SELECT r.subject, event_id, i - pos AS \"offset\", x FROM r JOIN e ON r.subject = e.subject AND i BETWEEN pos - 2 AND pos + 5", "samples trials",
    ),
    "d12_nearest_sample": q(lambda s, d: joins.nearest_sample(V.samples(s, d), ["subject", "trial"], 200.0), "subject trial", "x t_ms", "SELECT subject, trial, arg_min(x, (abs(t_ms - 200), t_ms)) AS x, arg_min(t_ms, (abs(t_ms - 200), t_ms)) AS t_ms FROM samples GROUP BY ALL", "samples"),
    "d13_align_ordinal": q(lambda s, d: joins.align_by_ordinal(V.signals(s, d).select("subject", "trial"), V.trials(s, d).selectExpr("subject", "event_id", "pain_rating"), ["subject"], "trial", "event_id", "pain_rating"), "subject trial ordinal", "pain_rating", "WITH a AS (SELECT subject, trial, row_number() OVER (PARTITION BY subject ORDER BY trial) AS ordinal FROM signals), b AS (SELECT subject, pain_rating, row_number() OVER (PARTITION BY subject ORDER BY event_id) AS ordinal FROM trials) SELECT a.subject, a.trial, a.ordinal, pain_rating FROM a LEFT JOIN b ON a.subject = b.subject AND a.ordinal = b.ordinal", "signals trials"),
    "d14_relabel": q(lambda s, d: joins.relabel(V.trials(s, d), s.createDataFrame([("CLICK", "Cz"), ("View", "Pz")], "raw string, std string"), "unit", "raw", "std"), "subject trial unit", "", "SELECT subject, trial, CASE upper(unit) WHEN 'CLICK' THEN 'Cz' WHEN 'VIEW' THEN 'Pz' ELSE unit END AS unit FROM trials", "trials"),
    "d15_label_events": q(lambda s, d: joins.label_events(V.trials(s, d), _map(s), "unit"), "subject trial condition intensity", "", "SELECT subject, trial, CASE unit WHEN 'click' THEN 'stim' WHEN 'view' THEN 'rest' WHEN 'purchase' THEN 'stim' ELSE 'unknown' END AS condition, CASE unit WHEN 'click' THEN 'high' WHEN 'view' THEN 'none' WHEN 'purchase' THEN 'low' ELSE 'unknown' END AS intensity FROM trials", "trials"),
    "d16_interpolate": q(
        lambda s, d: joins.interpolate(V.trials(s, d).groupBy("unit", F.col("laser_power").alias("x")).agg(F.avg("pain_rating").alias("y")), V.trials(s, d).select("unit").distinct().select("unit", F.explode(F.sequence(F.lit(-4), F.lit(240))).alias("k")).select("unit", (F.col("k") * 0.5).alias("x")), ["unit"]),
        "unit", "x y",
        """WITH p AS (SELECT unit, laser_power AS x, avg(pain_rating) AS y FROM trials WHERE laser_power IS NOT NULL GROUP BY ALL), g AS (SELECT unit, k * 0.5 AS x FROM (SELECT DISTINCT unit FROM trials), range(-4, 241) AS r(k)),
        j AS (SELECT g.unit, g.x, (SELECT max(x) FROM p WHERE p.unit = g.unit AND p.x <= g.x) AS x0, (SELECT min(x) FROM p WHERE p.unit = g.unit AND p.x >= g.x) AS x1 FROM g)
        SELECT j.unit, j.x, coalesce(a.y + (b.y - a.y) / nullif(b.x - a.x, 0) * (j.x - a.x), a.y, b.y) AS y FROM j LEFT JOIN p a ON a.unit = j.unit AND a.x = j.x0 LEFT JOIN p b ON b.unit = j.unit AND b.x = j.x1""", "trials",
    ),
    "d17_attach_fitted": q(lambda s, d: joins.attach_fitted(V.table(s, d, "orders").selectExpr("o_orderkey AS row_id", "o_totalprice AS actual"), V.table(s, d, "orders").where("o_totalprice > 100000").selectExpr("o_orderkey AS row_id", "o_totalprice * 0.9 AS fitted")), "row_id", "actual fitted", "SELECT o_orderkey AS row_id, o_totalprice AS actual, CASE WHEN o_totalprice > 100000 THEN o_totalprice * 0.9 END AS fitted FROM orders"),
    "d18_combinations": q(lambda s, d: joins.combinations(V.metrics_long(s, d)), "unit n_metrics model_name", "", "WITH m AS (SELECT DISTINCT unit, metric_name AS a FROM metrics_long) SELECT DISTINCT unit, 0 AS n_metrics, 'baseline' AS model_name FROM m UNION ALL SELECT unit, 1, a FROM m UNION ALL SELECT x.unit, 2, x.a || '+' || y.a FROM m x JOIN m y ON x.unit = y.unit AND x.a < y.a", "metrics_long"),
    "d19_leave_one_out": q(lambda s, d: joins.leave_one_out(V.table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("subject"), "o_orderstatus").agg(F.count("*").alias("n"))), "subject o_orderstatus fold train n", "", "WITH g AS (SELECT o_orderpriority AS subject, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) SELECT g.*, f.subject AS fold, g.subject <> f.subject AS train FROM g, (SELECT DISTINCT subject FROM g) f"),
    "d20_best_unit": q(lambda s, d: joins.best_unit(V.metrics_wide(s, d).withColumn("concept", F.col("subject") % 7), "concept", "unit", "discount"), "concept unit", "", "SELECT concept, unit FROM (SELECT subject % 7 AS concept, unit, row_number() OVER (PARTITION BY subject % 7 ORDER BY avg(discount) DESC, unit) AS r FROM metrics_wide GROUP BY 1, 2) WHERE r = 1", "metrics_wide"),
    "d21_registry": q(lambda s, d: joins.registry(V.subjects(s, d), V.table(s, d, "nation").selectExpr("cast(n_nationkey AS bigint) AS experiment_id", "n_name AS experiment"), "experiment_id"), "subject experiment", "", "SELECT subject, n_name AS experiment FROM subjects JOIN nation ON experiment_id = n_nationkey", "subjects"),
    "d22_concat_sessions": q(
        lambda s, d: joins.concat_sessions(V.signals(s, d).select("subject", F.col("trial").alias("session"), F.size("samples").cast("long").alias("n_samples")), V.samples(s, d).select("subject", F.col("trial").alias("session"), "i", "x")),
        "subject session i", "x", "SELECT subject, trial AS session, (trial - 1) * 64 + i AS i, x FROM samples", "samples",
    ),
    "h1_bind_rows": q(lambda s, d: sets.bind_rows(V.trials(s, d).select("subject", "unit"), V.subjects(s, d).select("subject", "uid")), "subject unit uid", "", "SELECT subject, unit, NULL AS uid FROM trials UNION ALL SELECT subject, NULL, uid FROM subjects", "trials subjects"),
    "h2_distinct_union": q(lambda s, d: sets.distinct_union(V.trials(s, d).select("subject"), V.subjects(s, d).select("subject")), "subject", "", "SELECT subject FROM trials UNION SELECT subject FROM subjects", "trials subjects"),
    "h3_except": q(lambda s, d: sets.except_rows(V.subjects(s, d).select("subject"), V.trials(s, d).select("subject")), "subject", "", "SELECT subject FROM subjects EXCEPT SELECT subject FROM trials", "trials subjects"),
    "h4_intersect": q(lambda s, d: sets.intersect_rows(V.subjects(s, d).select("subject"), V.trials(s, d).select("subject")), "subject", "", "SELECT subject FROM subjects INTERSECT SELECT subject FROM trials", "trials subjects"),
    "k4_source_trial": q(
        lambda s, d: sinks.source_trial_table(*[V.metrics_wide(s, d).where(w).select("subject", "trial", "unit", *c) for w, c in (("quantity < 30", ["tax"]), ("quantity > 20", ["tax", "discount"]), ("quantity > 40", ["quantity"]))]),
        "subject trial unit", "tax discount quantity", "SELECT subject, trial, unit, CASE WHEN quantity < 30 THEN tax END AS tax, CASE WHEN quantity > 20 THEN discount END AS discount, CASE WHEN quantity > 40 THEN quantity END AS quantity FROM metrics_wide", "metrics_wide",
    ),
    "k5_source_ga": q(
        lambda s, d: sinks.source_ga_table([V.metrics_wide(s, d).groupBy("subject", "unit").agg(F.avg("tax").alias("pre")), V.metrics_wide(s, d).where("quantity > 25").groupBy("subject", "unit").agg(F.avg("tax").alias("post"))], V.metrics_wide(s, d).groupBy("subject", "unit").agg(F.max("discount").alias("tvi"))),
        "subject unit", "pre post tvi", "SELECT subject, unit, avg(tax) AS pre, avg(tax) FILTER (quantity > 25) AS post, max(discount) AS tvi FROM metrics_wide GROUP BY ALL", "metrics_wide",
    ),
    "k8_upsert_by_subject": q(lambda s, d: sets.upsert_by_subject(V.metrics_wide(s, d).select("subject", "trial", "unit", "tax"), V.metrics_wide(s, d).where("subject % 3 = 0 AND quantity > 25").selectExpr("subject", "trial", "unit", "-tax AS tax")), "subject trial unit", "tax", "SELECT subject, trial, unit, tax FROM metrics_wide WHERE subject NOT IN (SELECT subject FROM metrics_wide WHERE subject % 3 = 0 AND quantity > 25) UNION ALL SELECT subject, trial, unit, -tax FROM metrics_wide WHERE subject % 3 = 0 AND quantity > 25", "metrics_wide"),
    "k9_upsert_by_key": q(lambda s, d: sets.upsert_by_key(V.metrics_wide(s, d).select("subject", "trial", "unit", "tax"), V.metrics_wide(s, d).where("quantity > 25").selectExpr("subject", "trial", "unit", "-tax AS tax", "discount"), ["subject", "trial", "unit"]), "subject trial unit", "tax discount", "SELECT subject, trial, unit, CASE WHEN quantity > 25 THEN -tax ELSE tax END AS tax, CASE WHEN quantity > 25 THEN discount END AS discount FROM metrics_wide", "metrics_wide"),
    "k10_upsert_results": q(lambda s, d: sets.upsert_by_key(V.metrics_wide(s, d).groupBy(F.lit("source").alias("level"), F.col("unit").alias("group_value"), (F.col("subject") % 5).alias("model_name")).agg(F.avg("tax").alias("aic")), V.metrics_wide(s, d).where("unit = 'AF'").groupBy(F.lit("source").alias("level"), F.col("unit").alias("group_value"), (F.col("subject") % 3).alias("model_name")).agg(F.max("tax").alias("aic")), ["level", "group_value", "model_name"]), "level group_value model_name", "aic", "WITH a AS (SELECT 'source' AS level, unit AS group_value, subject % 5 AS model_name, avg(tax) AS aic FROM metrics_wide GROUP BY ALL), b AS (SELECT 'source' AS level, unit AS group_value, subject % 3 AS model_name, max(tax) AS aic FROM metrics_wide WHERE unit = 'AF' GROUP BY ALL) SELECT * FROM a WHERE (group_value, model_name) NOT IN (SELECT (group_value, model_name) FROM b) UNION ALL SELECT * FROM b", "metrics_wide"),
    "k12_skip_completed": q(lambda s, d: sets.skip_completed(V.subjects(s, d).select("subject", "uid"), V.trials(s, d), ["subject"]), "subject uid", "", "SELECT subject, uid FROM subjects WHERE subject NOT IN (SELECT subject FROM trials)", "subjects trials"),
    "f11_quota_split": q(_split, "subject cap_size split_group", "", SPLIT + " SELECT * FROM split", "subjects"),
}
