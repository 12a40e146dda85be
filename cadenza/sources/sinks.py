"""Writers: feature tables, keyed upserts on disk, append-only results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.operators.joins import full_merge
from cadenza.sources.snapshots import upsert_snapshot

SCHEMAS = {
    "subjects": "global_subjid string, experiment_id int, subject int, age double, sex string, cap_size string",
    "trials": "global_subjid string, trial int, trial_index int, laser_power double, pain_rating double",
    "spectral_metrics": "global_subjid string, trial int, channel string, metric_name string, metric_value double",
    "source_metrics": "global_subjid string, trial int, roi string, metric_name string, metric_value double",
    "subject_split": "global_subjid string, cap_size string, split_group string, split_seed int, assigned_at timestamp",
    "model_fits": "level string, group_value string, model_name string, n_metrics int, edf array<double>, f array<double>, p array<double>, aic double, bic double, dev_expl double, r_sq double, n int, fitted_at timestamp",
    "cv_results": "fitted_at timestamp, cv_type string, level string, group_value string, metrics string, fold_id string, n_subjects int, n_trials int, pearson_r double, rmse double, r_sq double, mae double, spearman_rho double, n_obs int, extras map<string,double>",
    "power_analysis": "fitted_at timestamp, metric string, roi string, group_label string, power_target double, n_required int, achieved boolean, max_power double",
}


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def init_schema(spark: SparkSession, root: str) -> list[str]:
    """Creates the tables that are absent, empty; returns their names."""
    made = [n for n in SCHEMAS if not _exists(spark, f"{root}/{n}")]
    for n in made:
        spark.createDataFrame([], SCHEMAS[n]).write.parquet(f"{root}/{n}")
    return made


def unit_trial_table(features: DataFrame, ids: list[str]) -> DataFrame:
    """Ids, then numeric features in alphabetical order; other columns go."""
    numeric = ("double", "float", "int", "bigint", "boolean", "smallint", "tinyint")
    return features.select(*ids, *sorted(c for c, t in features.dtypes if c not in ids and t in numeric))


def write_unit_trial(features: DataFrame, path: str, ids: list[str], partition: str | None = None) -> None:
    rows = unit_trial_table(features, ids).sortWithinPartitions(*ids)
    (rows.write.partitionBy(partition) if partition else rows.write).mode("overwrite").parquet(path)


def ga_trial_table(features: DataFrame, fits: DataFrame, filled: DataFrame, keys: list[str]) -> DataFrame:
    """Features with the fits' columns, and those filled columns that have any value."""
    names = [c for c in filled.columns if c not in keys]
    counts = filled.agg(*[F.count(c).alias(c) for c in names]).first()
    kept = filled.select(*keys, *[c for c in names if counts[c]])
    return features.join(fits, keys, "left").join(kept, keys, "left")


def append_subject_summary(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def append_cv_rows(rows: DataFrame, path: str) -> None:
    rows.withColumn("fitted_at", F.current_timestamp()).write.mode("append").parquet(path)


def source_trial_table(pre: DataFrame, post: DataFrame, evoked: DataFrame) -> DataFrame:
    return full_merge([pre, post, evoked], ["subject", "trial", "unit"])


def source_ga_table(parts: list[DataFrame], tvi: DataFrame) -> DataFrame:
    return full_merge(parts, ["subject", "unit"]).join(tvi, ["subject", "unit"], "left")


def write_report(rows: DataFrame, path: str, csv: bool = True) -> None:
    """A flat table of a report: CSV with a header, or Parquet."""
    (rows.write.option("header", True).csv if csv else rows.write.parquet)(path, mode="overwrite")


#: Columns of the report tables, in their order.
REPORTS = {
    "spectrum_fits": ["subject", "trial", "unit", "offset", "exponent", "r2", "error", "alpha_cf", "alpha_pw", "alpha_bw", "fail_reason"],
    "evoked_peaks": ["subject", "trial", "unit", "n2_amp", "n2_lat_ms", "p2_amp", "p2_lat_ms", "n2p2_amp"],
    "channel_psd": ["subject", "trial", "unit", "line_ratio", "hf_ratio", "drift_ratio", "alpha_ratio"],
    "component_psd": ["subject", "trial", "unit", "peak_hz", "delta", "theta", "alpha", "beta", "gamma", "hf_ratio", "line_ratio"],
    "phase_correlation": ["subject", "unit", "r_cl", "p_perm"],
    "epoch_metadata": ["subject", "epoch_index", "code", "condition", "intensity"],
}


def write_named_report(rows: DataFrame, name: str, path: str) -> None:
    """The table of REPORTS of that name as CSV; columns that ``rows`` lacks are empty, others go."""
    kept = [F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in REPORTS[name]]
    write_report(rows.select(*kept), path)


def read_report(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A report, all columns as text."""
    return spark.read.option("header", True).schema(", ".join(f"`{c}` string" for c in REPORTS[name])).csv(path)


def upsert_partitioned(new: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """Replaces the rows of the keys of ``new`` in a versioned table: only the hash buckets that they fall into are read and
    written. ``snapshots.read_snapshot`` reads it."""
    upsert_snapshot(new, path, [key], buckets)


def write_result_rows(rows: DataFrame, path: str) -> None:
    """Replaces results by (level, group_value, model_name) in a versioned table, one version for all models of a job."""
    upsert_snapshot(rows, path, ["level", "group_value", "model_name"], 8)
