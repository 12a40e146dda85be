"""The star schema over the driver tables, as DataFrames and as the same SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.functions.cleaning import harmonize_sex, subject_uid
from cadenza.operators.signals import explode_samples, psd_long, welch_psd

FS, T0_MS, STIMULUS = 64.0, -500.0, 32


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def trials(spark: SparkSession, d: str) -> DataFrame:
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    power = F.get_json_object("props", "$.k").try_cast("double")
    return table(spark, d, "events").select(F.col("user_id").alias("subject"), number.alias("trial"), F.col("event_type").alias("unit"), power.alias("laser_power"), F.col("value").alias("pain_rating"), "ts", "event_id")


def subjects(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    spelled = F.element_at(F.array(*map(F.lit, ("M", "female", " F ", "male", "?"))), (key % 5 + 1).cast("int"))
    return table(spark, d, "customer").select(
        key.alias("subject"), F.col("c_nationkey").cast("long").alias("experiment_id"), subject_uid(F.col("c_nationkey"), key).alias("uid"),
        F.col("c_mktsegment").alias("cap_size"), (key % 60 + 18).cast("double").alias("age"), harmonize_sex(spelled).alias("sex"),
    )


def metrics_wide(spark: SparkSession, d: str) -> DataFrame:
    """One row for each (subject, trial, unit): the line with the highest number, and the greatest values of equal ones."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = lines.groupBy(F.col("o_custkey").alias("subject"), F.col("l_orderkey").alias("trial"), F.concat("l_returnflag", "l_linestatus").alias("unit"))
    names = ("quantity", "extendedprice", "discount", "tax")
    last = rows.agg(F.max(F.struct("l_linenumber", *[f"l_{c}" for c in names])).alias("_l"))
    return last.select("subject", "trial", "unit", *[F.col(f"_l.l_{c}").alias(c) for c in names])


def metrics_long(spark: SparkSession, d: str) -> DataFrame:
    return metrics_wide(spark, d).unpivot(["subject", "trial", "unit"], ["quantity", "extendedprice", "discount", "tax"], "metric_name", "metric_value")


def signals(spark: SparkSession, d: str) -> DataFrame:
    number = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).cast("long")
    unit = F.concat(F.lit("ch"), (F.col("vec_id") % 4).cast("string"))
    return table(spark, d, "embeddings").select(F.col("label").cast("long").alias("subject"), number.alias("trial"), unit.alias("unit"), F.col("embedding").cast("array<double>").alias("samples"))


def samples(spark: SparkSession, d: str) -> DataFrame:
    return explode_samples(signals(spark, d), FS, T0_MS)


def psd(spark: SparkSession, d: str) -> DataFrame:
    """Whole epochs, one Hamming window, bins of 1 Hz."""
    return psd_long(welch_psd(signals(spark, d), FS, 1.0, 0.5))


def phase(spark: SparkSession, d: str) -> DataFrame:
    second = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    return trials(spark, d).select("subject", "trial", "unit", (2 * F.pi() * (second % 86400) / 86400).alias("phase"), F.col("pain_rating").alias("rating"))


def predictions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("fold"), F.col("l_returnflag").alias("model"), F.col("l_orderkey").alias("row_id"), F.col("l_linenumber").cast("long").alias("line"), F.col("l_extendedprice").alias("actual"), (F.col("l_quantity") * 1500.0 + 500.0).alias("predicted"))
    return rows


SQL = {
    "trials": """SELECT user_id AS subject, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS trial, event_type AS unit,
        TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS laser_power, value AS pain_rating, ts, event_id FROM events""",
    "subjects": """SELECT c_custkey AS subject, c_nationkey::BIGINT AS experiment_id, printf('E%02d_S%03d', c_nationkey, c_custkey) AS uid,
        c_mktsegment AS cap_size, (c_custkey % 60 + 18)::DOUBLE AS age,
        CASE c_custkey % 5 WHEN 0 THEN 'M' WHEN 1 THEN 'F' WHEN 2 THEN 'F' WHEN 3 THEN 'M' END AS sex FROM customer""",
    "metrics_wide": """SELECT o_custkey AS subject, l_orderkey AS trial, l_returnflag || l_linestatus AS unit,
        arg_max(l_quantity, k) AS quantity, arg_max(l_extendedprice, k) AS extendedprice, arg_max(l_discount, k) AS discount, arg_max(l_tax, k) AS tax
        FROM (SELECT *, (l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax) AS k FROM lineitem) JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""",
    "metrics_long": """SELECT subject, trial, unit, metric_name, metric_value FROM (FROM metrics_wide)
        UNPIVOT (metric_value FOR metric_name IN (quantity, extendedprice, discount, tax))""",
    "signals": """SELECT label::BIGINT AS subject, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS trial,
        'ch' || (vec_id % 4) AS unit, embedding::DOUBLE[] AS samples FROM embeddings""",
    "samples": """SELECT subject, trial, unit, i::BIGINT AS i, -500.0 + i * 1000.0 / 64 AS t_ms, x FROM (
        SELECT subject, trial, unit, unnest(range(len(samples))) AS i, unnest(samples) AS x FROM signals)""",
    "dft": """SELECT subject, trial, unit, k, sum(x * w * cos(2 * pi() * k * i / 64)) AS re, sum(x * w * sin(2 * pi() * k * i / 64)) AS im
        FROM (SELECT *, 0.54 - 0.46 * cos(2 * pi() * i / 63) AS w FROM samples), range(33) AS r(k) GROUP BY ALL""",
    "psd": """SELECT subject, trial, unit, k::DOUBLE AS f, (re * re + im * im) * CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END
        / (64 * (SELECT sum(pow(0.54 - 0.46 * cos(2 * pi() * i / 63), 2)) FROM range(64) AS q(i))) AS p FROM dft""",
    "halves": """SELECT *, CASE WHEN i < 32 THEN 'pre' ELSE 'post' END AS win, i % 32 AS j FROM samples""",
    "win_dft": """SELECT subject, trial, unit, win, k, sum(x * w * cos(2 * pi() * k * j / 32)) AS re, sum(x * w * sin(2 * pi() * k * j / 32)) AS im
        FROM (SELECT *, 0.54 - 0.46 * cos(2 * pi() * j / 31) AS w FROM halves), range(17) AS r(k) GROUP BY ALL""",
    "win_psd": """SELECT subject, trial, unit, win AS "window", 2.0 * k AS f, (re * re + im * im) * CASE WHEN k IN (0, 16) THEN 1 ELSE 2 END
        / (64 * (SELECT sum(pow(0.54 - 0.46 * cos(2 * pi() * i / 31), 2)) FROM range(32) AS q(i))) AS p FROM win_dft""",
    "phase": """SELECT subject, trial, unit, 2 * pi() * ((hour(ts) * 3600 + minute(ts) * 60 + second(ts)) % 86400) / 86400 AS phase,
        pain_rating AS rating FROM trials""",
    "predictions": """SELECT l_suppkey AS fold, l_returnflag AS model, l_orderkey AS row_id, l_linenumber::BIGINT AS line,
        l_extendedprice AS actual, l_quantity * 1500.0 + 500.0 AS predicted FROM lineitem""",
}
NEEDS = {"metrics_long": ["metrics_wide"], "samples": ["signals"], "dft": ["samples"], "psd": ["dft"], "halves": ["samples"], "win_dft": ["halves"], "win_psd": ["win_dft"], "phase": ["trials"]}


def with_views(body: str, *views: str) -> str:
    """The SQL with the views that it names, and those that these need, in front."""
    order: list[str] = []

    def add(v: str) -> None:
        for x in NEEDS.get(v, []):
            add(x)
        if v not in order:
            order.append(v)

    for v in views:
        add(v)
    heads = [f"{v} AS ({SQL[v]})" for v in order]
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join([*heads, body[5:]])
    return ("WITH " + ",\n".join(heads) + "\n" if heads else "") + body
