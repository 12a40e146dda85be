"""Queries that write what they read through a sink and scan it again, and incremental ingestion."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from cadenza.functions import cleaning as C
from cadenza.operators import features as E
from cadenza.operators import joins
from cadenza.operators import models as L
from cadenza.operators import signals as J
from cadenza.operators import summaries as S
from cadenza.plans import views as V
from cadenza.plans.cleaning_queries import SPLIT
from cadenza.plans.feature_queries import IDS, features
from cadenza.plans.feature_queries import QUERIES as FEATURES
from cadenza.plans.spec import q
from cadenza.sources import scans, sinks, snapshots
from cadenza.sources.scratch import scratch_path
from cadenza.streaming import incremental


def csv(df, path, sep=","):
    df.write.option("header", True).option("sep", sep).csv(path)
    return path


def behaviour(s, d):
    rows = V.trials(s, d).selectExpr("subject AS ID", "trial AS Trial_Num", "cast(laser_power AS string) AS laser_power", "if(trial % 5 = 0, 'NaN', cast(pain_rating AS string)) AS Painrating")
    return scans.scan_behaviour(s, csv(rows, scratch_path(s, "26ByLab_behaviour")), ["26ByLab", "30ByOther"], "*.csv")


def participants(s, d):
    rows = V.table(s, d, "customer").selectExpr("concat('sub-', lpad(c_custkey, 6, '0')) AS participant_id", "if(c_custkey % 4 = 0, 'n/a', cast(c_custkey % 60 + 18 AS string)) AS Age", "if(c_custkey % 2 = 0, 'female', 'M') AS gender")
    return scans.scan_participants(s, csv(rows, scratch_path(s, "participants"), "\t"), "*.csv")


def ratings(s, d):
    # A subject's rows are in one file, in their order; subjects are spread over files.
    rows = V.trials(s, d).repartition("subject").sortWithinPartitions("subject", "trial").selectExpr("concat('sub', subject) AS `Subject-ID`", "pain_rating AS `Pain Rating`")
    return scans.scan_ratings(s, csv(rows, scratch_path(s, "ratings")), "*.csv")


def source_ga(s, d):
    rows = V.trials(s, d).groupBy("subject", F.col("unit").alias("roi")).agg(F.avg("pain_rating").alias("itc_mean")).selectExpr("concat('sub-', subject) AS subjects", "roi", "itc_mean")
    return scans.scan_source_ga(s, csv(rows, scratch_path(s, "source-ga")), "*.csv").withColumn("itc_mean", F.col("itc_mean").cast("double"))


def ga_features(s, d):
    rows = V.trials(s, d).selectExpr("subject AS subjid", "trial", "cast(pain_rating AS string) AS pow_slow", "if(trial % 2 = 0, 'bad', cast(laser_power AS string)) AS aperiodic_offset")
    return scans.scan_ga_features(s, csv(rows, scratch_path(s, "ga")), glob="*.csv").selectExpr("cast(subjid AS bigint) AS subjid", "cast(trial AS bigint) AS trial", "pow_slow_alpha", "fooof_offset")


def fits_json(s, d):
    fit = J.fit_aperiodic(J.welch_psd(V.signals(s, d), V.FS, 1.0, 0.5), 2.0, 30.0)
    names = {"offset": "aperiodic_offset", "exponent": "aperiodic_exponent", "r2": "r2", "error": "error", "alpha_cf": "alpha_cf", "alpha_pw": "alpha_pw", "alpha_bw": "alpha_bw", "fail_reason": "fail_reason"}
    inner = F.struct(F.col("trial").cast("int").alias("trial"), *[F.col(f"fit.{k}").alias(v) for k, v in names.items()])
    path = scratch_path(s, "fits")
    # One object is one subject's file.
    fit.groupBy("subject").agg(F.collect_list(inner).alias("trials")).write.partitionBy("subject").json(path)
    return scans.scan_fits_json(s, path)


def signals(s, d):
    path = scratch_path(s, "signals")
    V.signals(s, d).write.parquet(path)
    return J.explode_samples(scans.scan_signals(s, path), V.FS)


def unit_trial(s, d):
    path = scratch_path(s, "unit-trial")
    sinks.write_unit_trial(features(s, d), path, IDS)
    return s.read.parquet(path)


def ga_trial(s, d):
    keys = ["subject", "trial"]
    ga = E.ga_psd(V.psd(s, d), keys)
    line = J.aperiodic_line(ga, keys, 2.0, 30.0).selectExpr("subject", "trial", "offset AS fit_offset", "exponent AS fit_exponent")
    filled = E.alpha_peak_fill(ga, line.withColumns({c: F.lit(None).cast("double") for c in ("alpha_cf", "alpha_pw", "alpha_bw")}), keys)
    return sinks.ga_trial_table(E.alpha_features(ga, keys).select(*keys, "sf_balance"), line, filled, keys)


def subject_summary(s, d):
    path = scratch_path(s, "summary")
    rows = E.tvi(V.trials(s, d), ["subject"], "trial", "pain_rating").select("subject", "n", "tvi")
    sinks.append_subject_summary(rows.where("subject % 2 = 0"), path)
    sinks.append_subject_summary(rows.where("subject % 2 = 1"), path)
    return s.read.parquet(path)


def upserted(s, d):
    path = scratch_path(s, "upsert")
    rows = V.metrics_wide(s, d).select("subject", "trial", "unit", "tax")
    sinks.upsert_partitioned(rows, path, "subject", 16)
    sinks.upsert_partitioned(rows.where("subject % 3 = 0 AND tax > 0.04").selectExpr("subject", "trial", "unit", "-tax AS tax"), path, "subject", 16)
    return snapshots.read_snapshot(s, path)


def streamed(s, d):
    """The files of a folder that came in two goes."""
    source, target, mark = (scratch_path(s, n) for n in ("stream-source", "stream-target", "stream-mark"))
    rows = V.metrics_wide(s, d).select("subject", "trial", "unit", "tax")
    for part in (rows, rows.where("subject % 4 = 1").selectExpr("subject", "trial", "unit", "tax + 1 AS tax")):
        part.write.mode("append").parquet(source)
        incremental.ingest_new_files(s, source, "subject long, trial long, unit string, tax double", target, mark).awaitTermination()
    return snapshots.read_snapshot(s, target)


def streamed_split(s, d):
    """Each stratum's counts of train and holdout, assigned by a stateful stream that is stopped and goes on; some subjects
    come again in its second run."""
    source, mark, target = (scratch_path(s, n) for n in ("split-source", "split-mark", "split-target"))
    rows = V.subjects(s, d).select("subject", "cap_size")
    before = s.conf.get("spark.sql.streaming.stateStore.providerClass")
    s.conf.set("spark.sql.streaming.stateStore.providerClass", incremental.STORE)
    try:
        for part in (rows.where("subject % 3 != 1"), rows.where("subject % 3 != 2")):
            part.write.mode("append").parquet(source)
            stream = incremental.assign_stream(s.readStream.schema("subject long, cap_size string").parquet(source))
            stream.writeStream.option("checkpointLocation", mark).trigger(availableNow=True).format("parquet").option("path", target).outputMode("append").start().awaitTermination()
    finally:
        s.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return s.read.parquet(target).groupBy("cap_size", "split_group").agg(F.count("*").alias("n"))


def cap_size(s, d):
    size = F.element_at(F.array(*map(F.lit, (32, 62, 64))), (F.col("c_nationkey") % 3 + 1).cast("int"))
    rows = V.table(s, d, "customer").select(F.concat(F.lit("exp"), F.col("c_nationkey").cast("string")).alias("experiment_name"), F.col("c_nationkey").alias("experiment_id"), size.alias("cap_size"))
    return scans.scan_cap_size(s, csv(rows, scratch_path(s, "cap-size")))


def spectral_long(s, d):
    rows = V.metrics_wide(s, d).selectExpr("subject AS subjid", "trial", "1 AS chan_idx", "unit AS chan_label", "quantity AS Quantity", "extendedprice", "discount", "tax")
    return scans.scan_spectral_long(s, csv(rows, scratch_path(s, "spectral")), "*.csv")


def source_long(s, d):
    rows = V.metrics_wide(s, d).selectExpr("subject", "trial", "unit AS roi", "cast(discount AS string) AS Discount", "if(quantity > 40, 'bad', cast(quantity AS string)) AS Quantity")
    return scans.scan_source_long(s, csv(rows, scratch_path(s, "source")), "*.csv")


def montage(s, d):
    rows = V.table(s, d, "part").selectExpr("concat(' ', p_name) AS raw_label", "concat(p_brand, ' ') AS std_label")
    return scans.scan_montage(s, csv(rows, scratch_path(s, "montage"))).groupBy("raw_label").agg(F.count("*").alias("n"), F.max("std_label").alias("last")).where("n > 1")


def supplier_files(s, d, name):
    """Folders of text files by stage for each of up to 1,000 subjects, among whom the suppliers are dealt: a subject may have many files."""
    path = scratch_path(s, name)
    rows = V.table(s, d, "supplier").withColumn("stage", F.explode(F.expr("if(s_suppkey % 2 = 0, array('raw', 'clean'), array('raw'))")))
    rows.select(F.concat(F.lit("sub-"), (F.col("s_suppkey") % 1000).cast("string"), F.lit("_s1_"), F.col("stage")).alias("k"), F.col("s_name").alias("value")).write.partitionBy("k").text(path)
    return path


def latest_files(s, d):
    """Sessions by the names of the suppliers' files."""
    files = s.read.format("binaryFile").option("recursiveFileLookup", True).load(supplier_files(s, d, "files"))
    return scans.session_files(files.select(F.regexp_extract("path", r"sub-(\d+)", 1).cast("int").alias("subject"), F.regexp_extract("path", r"k=([^/]+)", 1).alias("name")), 2)


def channels(s, d):
    """A file of channel names for each session of ten: the ordinals are those of its file."""
    path = scratch_path(s, "channels")
    names = V.table(s, d, "supplier").select(F.expr("(s_suppkey - 1) DIV 10").alias("session"), "s_suppkey", F.col("s_name").alias("name"))
    names.repartition("session").sortWithinPartitions("session", "s_suppkey").drop("s_suppkey").write.partitionBy("session").option("header", True).option("sep", "\t").csv(path)
    return scans.scan_channels_tsv(s, path).withColumn("session", F.regexp_extract("file", r"session=(\d+)", 1).cast("long"))


def config(s, d):
    path = scratch_path(s, "config")
    V.trials(s, d).groupBy().agg(F.count("*").alias("n"), F.max("laser_power").alias("top")).select(F.struct("n", "top").alias("exp")).write.json(path)
    return scans.scan_config(s, path, {"exp.n": 0, "exp.top": 0.0, "psd.overlap": 0.5})


def newest(s, d):
    """Of each supplier's files the clean one, or else the raw one."""
    rows = scans.latest_file_per_subject(s, supplier_files(s, d, "stages"), "_clean/", "_raw/", 2)
    return rows.select("subject", F.regexp_extract("path", r"k=([^/]+)", 1).alias("name"))


def reported(name, query):
    """The rows of a registered query as a report table, written and read again."""

    def run(s, d):
        path = scratch_path(s, name)
        rows = query.make(s, d)
        sinks.write_named_report(rows, name, path)
        kinds = dict(rows.dtypes)
        return sinks.read_report(s, name, path).select(*[F.col(c).cast(kinds.get(c, "string")).alias(c) for c in sinks.REPORTS[name]])

    own = [c for c in sinks.REPORTS[name] if c in (*query.ids, *query.numbers)]
    ids, numbers = (" ".join(c for c in own if c in side) for side in (query.ids, query.numbers))
    return q(run, ids, numbers, query.sql, " ".join(query.views))


def tables(s, d):
    """The star schema made in an empty folder, one table filled, and made again: what is there stays."""
    root = scratch_path(s, "star")
    sinks.init_schema(s, root)
    V.subjects(s, d).selectExpr("uid AS global_subjid", "cast(experiment_id AS int) AS experiment_id", "cast(subject AS int) AS subject", "age", "sex", "cap_size").write.mode("append").parquet(f"{root}/subjects")
    if made := sinks.init_schema(s, root):
        raise ValueError(f"made again: {made}")
    out = s.read.parquet(f"{root}/subjects").groupBy("cap_size").agg(F.count("*").alias("n"), F.count("sex").alias("n_sex"))
    empty = [n for n in sinks.SCHEMAS if n != "subjects"]
    rows = [s.read.parquet(f"{root}/{n}").agg(F.lit(n).alias("cap_size"), F.count("*").alias("n"), F.count("*").alias("n_sex")) for n in empty]
    return functools.reduce(lambda a, b: a.unionAll(b), rows, out)


def result_rows(s, d):
    path = scratch_path(s, "results")
    rows = V.metrics_wide(s, d).groupBy(F.lit("source").alias("level"), F.col("unit").alias("group_value"), (F.col("subject") % 5).alias("model_name")).agg(F.avg("tax").alias("aic"))
    sinks.write_result_rows(rows, path)
    sinks.write_result_rows(rows.where("group_value = 'AF'").withColumn("aic", -F.col("aic")), path)
    return snapshots.read_snapshot(s, path)


def cv_rows(s, d):
    path = scratch_path(s, "cv")
    rows = S.eval_metrics(V.predictions(s, d), ["fold"], "actual", "predicted", False)
    for k in (0, 1):
        sinks.append_cv_rows(rows.where(f"fold % 2 = {k}"), path)
    return s.read.parquet(path)


def registry(s, d):
    """Each unit of the trials with every listed model."""
    rows = functools.reduce(lambda a, b: a.unionAll(b), [L.model_registry(s, models).withColumn("family", F.lit(family)) for family, models in L.MODELS.items()])
    return V.trials(s, d).select("unit").distinct().join(F.broadcast(rows)).select("unit", "family", "name", F.size("terms").alias("n_terms"), "aperiodic", "cap", "tensor")


def registry_sql():
    values = ", ".join(f"('{family}', '{name}', {len(terms)}, {a}, {c}, {t})".lower() for family, models in L.MODELS.items() for name, terms, a, c, t in models)
    return f"SELECT unit, family, name, n_terms, aperiodic, cap, tensor FROM (SELECT DISTINCT unit FROM trials), (VALUES {values}) AS m(family, name, n_terms, aperiodic, cap, tensor)"


QUERIES = {
    "a10_channels": q(channels, "session ordinal name", "", "SELECT (s_suppkey - 1) // 10 AS session, row_number() OVER (PARTITION BY (s_suppkey - 1) // 10 ORDER BY s_suppkey) AS ordinal, s_name AS name FROM supplier"),
    "a11_config": q(config, "exp_n", "exp_top psd_overlap", "SELECT count(*) AS exp_n, max(laser_power) AS exp_top, 0.5 AS psd_overlap FROM trials", "trials"),
    "a13_latest_file": q(newest, "subject name", "", "SELECT DISTINCT (s_suppkey % 1000)::INT AS subject, 'sub-' || s_suppkey % 1000 || CASE s_suppkey % 2 WHEN 0 THEN '_s1_clean' ELSE '_s1_raw' END AS name FROM supplier"),
    "a15_read_table": q(lambda s, d: scans.read_table(s, d, "supplier"), "s_suppkey s_name", "s_acctbal", "SELECT s_suppkey, s_name, s_acctbal FROM supplier"),
    "b1_clean_names": q(lambda s, d: C.clean_names(V.table(s, d, "customer").selectExpr("c_custkey AS ` c key `", "c_acctbal AS `acct.bal^2`")), "c_key", "acct_balr2", "SELECT c_custkey AS c_key, c_acctbal AS acct_balr2 FROM customer"),
    "b2_normalize_colnames": q(lambda s, d: C.normalize_colnames(V.table(s, d, "customer").selectExpr("c_custkey AS `Cust-Key`", "c_acctbal AS `--`")), "cust_key", "col2", "SELECT c_custkey AS cust_key, c_acctbal AS col2 FROM customer"),
    "b3_rename_first_match": q(lambda s, d: C.rename_first_match(V.table(s, d, "customer"), {"subject": ["id", "c_custkey"], "cap_size": ["c_mktsegment", "c_name"]}), "subject cap_size", "", "SELECT c_custkey AS subject, c_mktsegment AS cap_size FROM customer"),
    "d19_replicates": q(lambda s, d: joins.replicates(V.subjects(s, d), 5).groupBy("cap_size", "rep").agg(F.avg("age").alias("age")), "cap_size rep", "age", "SELECT cap_size, rep, avg(age) AS age FROM subjects, range(5) AS r(rep) GROUP BY ALL", "subjects"),
    "g6_canonical_order": q(lambda s, d: V.metrics_wide(s, d).repartition("subject").sortWithinPartitions("subject", "trial", "unit"), "subject trial unit", "tax", "SELECT subject, trial, unit, tax FROM metrics_wide", "metrics_wide"),
    "k6_spectrum_fits": reported("spectrum_fits", FEATURES["j13_fit_aperiodic"]),
    "k6_evoked_peaks": reported("evoked_peaks", FEATURES["e19_evoked_peaks"]),
    "k6_channel_psd": reported("channel_psd", FEATURES["e26_channel_ratios"]),
    "k6_component_psd": reported("component_psd", FEATURES["e27_component_metrics"]),
    "k6_phase_correlation": reported("phase_correlation", FEATURES["e17_circ_lin_corr"]),
    "k6_epoch_metadata": reported("epoch_metadata", FEATURES["j14_epoch_builder"]),
    "k7_init_schema": q(tables, "cap_size n n_sex", "", "SELECT cap_size, count(*) AS n, count(sex) AS n_sex FROM subjects GROUP BY cap_size UNION ALL SELECT unnest(['trials', 'spectral_metrics', 'source_metrics', 'subject_split', 'model_fits', 'cv_results', 'power_analysis']), 0, 0", "subjects"),
    "k10_write_results": q(result_rows, "level group_value model_name", "aic", "SELECT 'source' AS level, unit AS group_value, subject % 5 AS model_name, avg(tax) * max(CASE unit WHEN 'AF' THEN -1 ELSE 1 END) AS aic FROM metrics_wide GROUP BY ALL", "metrics_wide"),
    "a3_cap_size": q(cap_size, "experiment_name experiment_id cap_size", "", "SELECT DISTINCT 'exp' || c_nationkey AS experiment_name, c_nationkey::INT AS experiment_id, [32, 62, 64][c_nationkey % 3 + 1] AS cap_size FROM customer"),
    "a4_metrics_long": q(spectral_long, "subjid trial chan_label metric_name", "metric_value", "SELECT subject::INT AS subjid, trial::INT AS trial, unit AS chan_label, metric_name, metric_value FROM metrics_long", "metrics_long"),
    "a5_source_long": q(source_long, "subjid trial roi metric_name", "metric_value", "SELECT subject::INT AS subjid, trial::INT AS trial, unit AS roi, 'discount' AS metric_name, discount AS metric_value FROM metrics_wide UNION ALL SELECT subject, trial, unit, 'quantity', quantity FROM metrics_wide WHERE quantity <= 40", "metrics_wide"),
    "a9_montage_duplicates": q(montage, "raw_label n last", "", "SELECT trim(p_name) AS raw_label, count(*) AS n, max(trim(p_brand)) AS last FROM part GROUP BY 1 HAVING count(*) > 1"),
    "k11_append_cv": q(cv_rows, "fold n_obs", "pearson_r", "SELECT fold, count(*) AS n_obs, corr(actual, predicted) AS pearson_r FROM predictions GROUP BY fold", "predictions"),
    "l12_model_registry": q(registry, "unit family name n_terms aperiodic cap tensor", "", registry_sql(), "trials"),
    "a1_scan_behaviour": q(behaviour, "experiment subject trial", "laser_power pain_rating", "SELECT '26ByLab' AS experiment, subject, trial, laser_power, CASE WHEN trial % 5 <> 0 THEN pain_rating END AS pain_rating FROM trials", "trials"),
    "a2_scan_participants": q(participants, "subject sex", "age", "SELECT c_custkey AS subject, CASE c_custkey % 2 WHEN 0 THEN 'F' ELSE 'M' END AS sex, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 60 + 18 END AS age FROM customer"),
    "a6_scan_ga_features": q(ga_features, "subjid trial", "pow_slow_alpha fooof_offset", "SELECT subject AS subjid, trial, pain_rating AS pow_slow_alpha, CASE WHEN trial % 2 <> 0 THEN laser_power END AS fooof_offset FROM trials", "trials"),
    "a7_scan_source_ga": q(source_ga, "subject roi", "itc_mean", "SELECT subject, unit AS roi, avg(pain_rating) AS itc_mean FROM trials GROUP BY ALL", "trials"),
    "a8_scan_ratings": q(ratings, "subject ordinal", "rating", "SELECT subject, trial AS ordinal, pain_rating AS rating FROM trials", "trials"),
    "a12_scan_signals": q(signals, "subject trial unit i", "x", "SELECT * FROM samples", "samples"),
    "a14_session_files": q(latest_files, "subject session name", "", "SELECT DISTINCT (s_suppkey % 1000)::INT AS subject, 1 AS session, 'sub-' || s_suppkey % 1000 || CASE s_suppkey % 2 WHEN 0 THEN '_s1_clean' ELSE '_s1_raw' END AS name FROM supplier"),
    "a16_scan_fits": q(fits_json, "trial fail_reason", "aperiodic_offset aperiodic_exponent r2 error alpha_cf alpha_pw alpha_bw"),
    "k1_write_unit_trial": q(unit_trial, "subject trial unit", "sf_balance", None),
    "k2_ga_trial": q(ga_trial, "subject trial source", "sf_balance fit_offset fit_exponent cf_filled"),
    "k3_subject_summary": q(subject_summary, "subject n", "tvi", "WITH x AS (SELECT subject, pain_rating, pow(pain_rating - lag(pain_rating) OVER (PARTITION BY subject ORDER BY trial), 2) AS d FROM trials) SELECT subject, count(*) AS n, avg(d) / var_samp(pain_rating) AS tvi FROM x GROUP BY subject", "trials"),
    "k8_upsert_on_disk": q(upserted, "subject trial unit", "tax", "SELECT subject, trial, unit, tax FROM metrics_wide WHERE subject NOT IN (SELECT subject FROM metrics_wide WHERE subject % 3 = 0 AND tax > 0.04) UNION ALL SELECT subject, trial, unit, -tax FROM metrics_wide WHERE subject % 3 = 0 AND tax > 0.04", "metrics_wide"),
    "n1_ingest_new_files": q(streamed, "subject trial unit", "tax", "SELECT subject, trial, unit, tax + CASE WHEN subject % 4 = 1 THEN 1 ELSE 0 END AS tax FROM metrics_wide", "metrics_wide"),
    "n2_stream_split": q(streamed_split, "cap_size split_group n", "", SPLIT + " SELECT cap_size, split_group, count(*) AS n FROM split GROUP BY ALL", "subjects"),
    "n3_pending": q(lambda s, d: incremental.pending(V.subjects(s, d).select("subject").join(s.createDataFrame([("clean",), ("psd",)], "stage string")), V.trials(s, d).selectExpr("subject", "if(trial % 2 = 0, 'clean', 'psd') AS stage").where("trial < 3 OR subject > 50"), ["subject", "stage"]), "subject stage", "", "SELECT subject, stage FROM subjects, (VALUES ('clean'), ('psd')) AS v(stage) WHERE (subject, stage) NOT IN (SELECT (subject, CASE trial % 2 WHEN 0 THEN 'clean' ELSE 'psd' END) FROM trials WHERE trial < 3 OR subject > 50)", "subjects trials"),
    "n4_retry": q(lambda s, d: incremental.retry(V.subjects(s, d).select("subject"), V.trials(s, d).where("subject % 2 = 0").select("subject").distinct(), V.trials(s, d).select("subject"), "subject"), "subject retried", "", "SELECT subject, subject IN (SELECT subject FROM trials) AS retried FROM subjects WHERE subject NOT IN (SELECT subject FROM trials WHERE subject % 2 = 0)", "subjects trials"),
}
