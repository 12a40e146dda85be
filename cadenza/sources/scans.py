"""Scans of behavioural, demographic, feature and signal files. Every column is read as text, renamed by aliases and cast."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.functions.cleaning import clean_names, coerce_numeric, experiment_from_path, harmonize_sex, melt, no_nan, normalize_colnames, rename_first_match, require_columns

# The column names that the input files use, the first one present counts.
BEHAVIOUR_ALIASES = {
    "subject": ["subjid", "ID", "id", "participant"],
    "trial": ["trial", "Trial", "trial_number", "Trial_Num", "trial_num"],
    "laser_power": ["laser_power", "laser", "laser_level"],
    "pain_rating": ["pain_rating", "pain", "rating", "Painrating"],
}
PARTICIPANT_ALIASES = {"subject": ["participant_id", "participant"], "age": ["age", "Age"], "sex": ["sex", "Sex", "gender", "Gender"]}
RATING_ID = ["subjid", "subject_id", "subjectid", "id", "participant", "participant_id", "participantid", "sub", "sub_id"]
RATING_VALUE = ["pain_rating", "painrating", "rating", "pain", "nrs", "nrs_score", "vrs", "vrs_score", "vas", "vas_score", "response", "score"]
GA_ALIASES = {
    "pow_slow_alpha": ["pow_slow"],
    "pow_fast_alpha": ["pow_fast"],
    "pow_alpha_total": ["pow_alpha"],
    "rel_slow_alpha": ["rel_slow"],
    "rel_fast_alpha": ["rel_fast"],
    "slow_alpha_frac": ["slow_frac", "sf_slow_frac"],
    "fooof_offset": ["aperiodic_offset"],
    "fooof_exponent": ["aperiodic_exponent"],
    "fooof_r2": ["fooof_r_2", "r2"],
    "fooof_error": ["error"],
    "fooof_alpha_cf": ["alpha_cf"],
    "fooof_alpha_pw": ["alpha_pw"],
    "fooof_alpha_bw": ["alpha_bw"],
}


def _place() -> Column:
    """The order of a file's rows: by file and place of the block in it, and within a block as its task reads it."""
    return F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("row"))


def _csv(spark: SparkSession, path: str, glob: str, sep: str = ",", *more: Column) -> DataFrame:
    rows = spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("sep", sep).option("inferSchema", False).csv(path)
    return rows.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_name").alias("_file"), *more)


def scan_behaviour(spark: SparkSession, path: str, experiments: Iterable[str], glob: str = "*_behaviour.csv") -> DataFrame:
    """experiment, subject, trial, laser_power, pain_rating; NaN and bad numbers are null."""
    rows = require_columns(rename_first_match(clean_names(_csv(spark, path, glob)), BEHAVIOUR_ALIASES), BEHAVIOUR_ALIASES)
    number = lambda c: coerce_numeric(F.col(c)).alias(c)
    return rows.select(experiment_from_path(F.col("_path"), experiments).alias("experiment"), F.col("subject").try_cast("int").alias("subject"), F.col("trial").try_cast("int").alias("trial"), number("laser_power"), number("pain_rating"))


def scan_participants(spark: SparkSession, path: str, glob: str = "participants.tsv") -> DataFrame:
    """subject, age, sex; absent columns are null."""
    rows = rename_first_match(_csv(spark, path, glob, "\t"), PARTICIPANT_ALIASES)
    has = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    return rows.select(F.regexp_replace(has("subject"), "^sub-", "").try_cast("int").alias("subject"), coerce_numeric(has("age")).alias("age"), harmonize_sex(has("sex")).alias("sex"), "_path")


def scan_cap_size(spark: SparkSession, path: str) -> DataFrame:
    """experiment_name, experiment_id, cap_size, one row an experiment; of several sizes the least."""
    rows = spark.read.option("header", True).csv(path)
    return rows.groupBy("experiment_name", F.col("experiment_id").try_cast("int").alias("experiment_id")).agg(F.min(F.col("cap_size").try_cast("int")).alias("cap_size"))


def scan_spectral_long(spark: SparkSession, path: str, glob: str = "*_spectral_chan_by_trial.csv") -> DataFrame:
    """subjid, trial, chan_label, metric_name, metric_value."""
    return melt(_numbered(_csv(spark, path, glob).drop("_path", "_file", "chan_idx")), ["subjid", "trial", "chan_label"])


def scan_source_long(spark: SparkSession, path: str, glob: str = "*_source_trial.csv") -> DataFrame:
    rows = rename_first_match(_csv(spark, path, glob).drop("_path", "_file"), {"subjid": ["subject"]})
    return melt(_numbered(rows), ["subjid", "trial", "roi"])


def _numbered(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.col(c).try_cast("int") for c in ("subjid", "trial")})


def scan_ga_features(spark: SparkSession, path: str, aliases: dict[str, list[str]] = GA_ALIASES, glob: str = "*_spectral_ga_by_trial.csv") -> DataFrame:
    """Grand-average features under their newer names, numbers where they are."""
    rows = rename_first_match(_csv(spark, path, glob).drop("_path", "_file"), aliases)
    return rows.select(*[c if c in ("subjid", "trial") or "source" in c else coerce_numeric(F.col(c)).alias(c) for c in rows.columns])


def scan_source_ga(spark: SparkSession, path: str, glob: str = "*_source_ga*.csv") -> DataFrame:
    """The subject is its column's number or else the file name's."""
    rows = rename_first_match(_csv(spark, path, glob), {"subject": ["subjects", "subjid"]})
    own = F.col("subject") if "subject" in rows.columns else F.lit(None).cast("string")
    named = F.nullif(F.regexp_extract("_file", r"sub-(\d+)", 1), F.lit(""))
    return rows.withColumn("subject", F.coalesce(F.regexp_replace(own, "^sub-", "").try_cast("int"), named.try_cast("int"))).drop("_path", "_file")


def scan_ratings(spark: SparkSession, path: str, glob: str = "participants_singletrial_*.csv") -> DataFrame:
    """subject, ordinal (row of the subject in the file), rating; columns are the first candidates present."""
    rows = normalize_colnames(_csv(spark, path, glob, ",", _place().alias("row_place")).drop("_path", "_file"))
    pick = lambda names: next(c for c in names if c in rows.columns)
    numbered = rows.select(F.regexp_extract(pick(RATING_ID), r"(\d+)$", 1).try_cast("int").alias("subject"), coerce_numeric(F.col(pick(RATING_VALUE))).alias("rating"), F.col("row_place").alias("_place"))
    return numbered.withColumn("ordinal", F.row_number().over(Window.partitionBy("subject").orderBy("_place"))).drop("_place")


def scan_montage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path).select(F.trim("raw_label").alias("raw_label"), F.trim("std_label").alias("std_label"))


def scan_channels_tsv(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame:
    """file, ordinal (row of the file), name, of one session's file or of a folder with many; in any file another count than
    expected, or a repeated name, is an error."""
    rows = spark.read.option("header", True).option("sep", "\t").option("recursiveFileLookup", True).csv(path)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.trim("name").alias("name"), _place().alias("_i"))
    counts = rows.groupBy("file").agg(F.count("*").alias("n"), F.count_distinct("name").alias("names"))
    wrong = counts.where((F.col("n") != F.col("names")) | (F.lit(False) if expected is None else F.col("n") != expected)).first()
    if wrong:
        raise ValueError(f"{wrong['file']}: {wrong['n']} channels of {wrong['names']} names, {expected} expected")
    return rows.select("file", F.row_number().over(Window.partitionBy("file").orderBy("_i")).alias("ordinal"), "name")


def scan_config(spark: SparkSession, path: str, defaults: dict[str, object]) -> DataFrame:
    """One row: the file's object, with the defaults (dotted names) for what it lacks, as flat columns."""
    rows = spark.read.option("multiLine", True).json(path)

    def has(schema: T.StructType, names: list[str]) -> bool:
        return names[0] in schema.names and (len(names) == 1 or isinstance(schema[names[0]].dataType, T.StructType) and has(schema[names[0]].dataType, names[1:]))

    made = []
    for name, value in defaults.items():
        other = F.lit(value) if not isinstance(value, list | dict) else F.lit(json.dumps(value))
        own = F.col(name) if has(rows.schema, name.split(".")) else None
        if own is not None and isinstance(value, list | dict):
            own = F.to_json(own)
        made.append((other if own is None else F.coalesce(own, other)).alias(name.replace(".", "_")))
    return rows.select(*made)


def scan_signals(spark: SparkSession, path: str) -> DataFrame:
    """subject, trial, unit, fs, t0_ms, samples; NaN samples become null."""
    rows = spark.read.parquet(path)
    return require_columns(rows, ["subject", "trial", "unit", "samples"]).withColumn("samples", F.transform("samples", no_nan))


def latest_file_per_subject(spark: SparkSession, path: str, preferred: str, fallback: str, parts: int = 1) -> DataFrame:
    """subject, path: the newest file whose name matches ``preferred``, or else ``fallback``; the name is the path's
    last ``parts`` parts. Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "modificationTime")
    name = F.array_join(F.slice(F.split("path", "/"), -parts, parts), "/")
    rank = F.when(F.rlike(name, F.lit(preferred)), 0).when(F.rlike(name, F.lit(fallback)), 1)
    rows = files.select("path", "modificationTime", rank.alias("_k"), F.regexp_extract(name, r"sub-(\d+)", 1).try_cast("int").alias("subject")).where("_k IS NOT NULL AND subject IS NOT NULL")
    w = Window.partitionBy("subject").orderBy("_k", F.desc("modificationTime"), "path")
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("subject", "path")


def session_files(files: DataFrame, sessions: int) -> DataFrame:
    """files (subject, name) to (subject, session, name): by a name with ``ses-NN``, else ``_sN``, else the n-th in order."""
    w = Window.partitionBy("subject").orderBy("name")
    named = F.coalesce(*[F.nullif(F.regexp_extract("name", p, 1), F.lit("")).try_cast("int") for p in (r"ses-0*(\d+)", r"_s(?:ession)?0*(\d+)[_.]")])
    rows = files.withColumn("session", F.coalesce(named, F.row_number().over(w))).where(F.col("session") <= sessions)
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy("subject", "session").orderBy("name"))).where("_r = 1").drop("_r")


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


FIT = "trial int, aperiodic_offset double, aperiodic_knee double, aperiodic_exponent double, r2 double, error double, alpha_cf double, alpha_pw double, alpha_bw double, fail_reason string"


def scan_fits_json(spark: SparkSession, path: str) -> DataFrame:
    """One row a trial of the files' ``trials`` arrays; NaN becomes null."""
    fields = ", ".join(f.replace(" ", ": ") for f in FIT.split(", "))
    rows = spark.read.option("multiLine", True).option("allowNonNumericNumbers", True).schema(f"trials array<struct<{fields}>>").json(path)
    flat = rows.select(F.inline("trials"))
    return flat.withColumns({c: no_nan(c) for c, t in flat.dtypes if t == "double"})
