"""Joins of the star schema, of events and samples, and generators of combinations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows up to which a dimension is broadcast without asking its size again.
DIMENSION_ROWS = 100_000


def dimension(df: DataFrame) -> DataFrame:
    """A side that is broadcast if it is small; larger ones are left to the optimizer."""
    return F.broadcast(df) if df.limit(DIMENSION_ROWS + 1).count() <= DIMENSION_ROWS else df


def left_dimensions(facts: DataFrame, *dimensions: tuple[DataFrame, list[str]]) -> DataFrame:
    """Facts with the columns of each (dimension, keys); facts without a match stay."""
    return reduce(lambda rows, d: rows.join(dimension(d[0]), d[1], "left"), dimensions, facts)


def features_with_behaviour(features: DataFrame, behaviour: DataFrame, keys: list[str], subject: list[str]) -> DataFrame:
    """Features left-joined with trials; those of subjects without any trial are dropped."""
    known = features.join(behaviour.select(*subject).distinct(), subject, "left_semi")
    return known.join(behaviour, keys, "left")


def star(metrics: DataFrame, subjects: DataFrame, trials: DataFrame) -> DataFrame:
    return metrics.join(dimension(subjects), "subject").join(trials, ["subject", "trial"])


def full_merge(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """Full outer join; of a column that several have, the first one's stays."""
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t.drop(*[c for c in t.columns if c in out.columns and c not in keys]), keys, "full")
    return out


def unit_pairs(df: DataFrame, subject: str, unit: str, value: str) -> DataFrame:
    """(subject, unit_a, unit_b, a, b) of each pair of a subject's units, unit_a before unit_b."""
    a = df.select(subject, F.col(unit).alias("unit_a"), F.col(value).alias("a"))
    b = df.select(subject, F.col(unit).alias("unit_b"), F.col(value).alias("b"))
    return a.join(b, subject).where("unit_a < unit_b")


def epochs(recordings: DataFrame, events: DataFrame, before: int, after: int) -> DataFrame:
    """Cuts samples [at-before, at+after] around each event; those that cross an edge are dropped.

    recordings: subject, unit, samples; events: subject, event_id, at (sample number). Arrays are sliced, so the join
    is an equal one on the subject."""
    size = before + after + 1
    rows = recordings.join(events, "subject").where((F.col("at") >= before) & (F.col("at") + after < F.size("samples")))
    return rows.withColumn("samples", F.slice("samples", F.col("at").cast("int") - before + 1, size))


def epochs_long(samples: DataFrame, events: DataFrame, before: int, after: int) -> DataFrame:
    """The same over one row a sample: a range join by time buckets as wide as an epoch, so two buckets hold it."""
    width = before + after + 1
    bucket = lambda c: F.floor(c / width)
    low, high = F.col("at") - before, F.col("at") + after
    asked = events.withColumn("_b", F.explode(F.sequence(bucket(low), bucket(high))))
    rows = samples.withColumn("_b", bucket(F.col("i"))).join(asked, ["subject", "_b"]).where(F.col("i").between(low, high))
    return rows.withColumn("offset", F.col("i") - F.col("at")).drop("_b")


def nearest_sample(samples: DataFrame, keys: list[str], at: float, time: str = "t_ms") -> DataFrame:
    """Of each group the value at the time nearest to ``at``; the earlier of two equally near."""
    near = F.struct(F.abs(F.col(time) - at), F.col(time))
    return samples.groupBy(*keys).agg(F.min_by("x", near).alias("x"), F.min_by(time, near).alias(time))


def align_by_ordinal(left: DataFrame, right: DataFrame, keys: list[str], left_order: str, right_order: str, value: str) -> DataFrame:
    """The k-th row of a group on the left gets the k-th value on the right: missing ones are null, extra ones go."""
    number = lambda df, order: df.withColumn("ordinal", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    other = number(right, right_order).select(*keys, "ordinal", value)
    return number(left, left_order).join(other, [*keys, "ordinal"], "left")


def relabel(df: DataFrame, mapping: DataFrame, label: str, source: str, target: str) -> DataFrame:
    """Labels replaced by their mapping, whatever their case; others stay."""
    m = mapping.select(F.upper(source).alias("_key"), F.col(target).alias("_to"))
    return df.withColumn("_key", F.upper(label)).join(dimension(m), "_key", "left").withColumn(label, F.coalesce("_to", label)).drop("_key", "_to")


def first_match(mapping: DataFrame, key: str, order: str) -> DataFrame:
    return mapping.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_r = 1").drop("_r")


def label_events(events: DataFrame, mapping: DataFrame, code: str = "code", order: str = "position") -> DataFrame:
    """condition and intensity by the first mapping of a code, "unknown" where there is none."""
    rows = events.join(dimension(first_match(mapping, code, order).drop(order)), code, "left")
    return rows.withColumns({c: F.coalesce(c, F.lit("unknown")) for c in ("condition", "intensity")})


def interpolate(points: DataFrame, grid: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, x, y): linear between the neighbouring points of each grid x, the end values beyond them.

    Points and grid are dealt to buckets of x by one set of cuts, and of each bucket's neighbours the nearest points are carried
    into it, so no window holds all points of a key."""
    from cadenza.operators.windows import bucket_of, same_keys, value_cuts

    cuts = value_cuts(points, keys, ["x"])
    dealt = [df.alias("d").join(dimension(cuts).alias("c"), same_keys("d", "c", keys), "left").select("d.*", bucket_of("d.x", "_cuts0").alias("_b")) for df in (points.select(*keys, "x", "y").where("x IS NOT NULL"), grid.select(*keys, "x"))]
    edge = lambda f: f(F.struct("x", "y"))
    edges = dealt[0].groupBy(*keys, "_b").agg(edge(F.min).alias("first"), edge(F.max).alias("last"))
    asked = dealt[1].select(*keys, "_b", F.lit(None).cast(edges.schema["first"].dataType).alias("first"), F.lit(None).cast(edges.schema["last"].dataType).alias("last")).distinct()
    every = edges.unionAll(asked).groupBy(*keys, "_b").agg(F.first("first", ignorenulls=True).alias("first"), F.first("last", ignorenulls=True).alias("last"))
    own = Window.partitionBy(*keys).orderBy("_b")  # a row for each bucket
    before = F.last("last", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("first", ignorenulls=True).over(own.rowsBetween(1, Window.unboundedFollowing))
    carried = every.withColumns({"_before": before, "_after": after}).select(*keys, "_b", F.explode(F.array("_before", "_after")).alias("_p")).where("_p IS NOT NULL").select(*keys, "_p.x", "_p.y", "_b")
    known = dealt[0].select(*keys, "x", "y", "_b").unionAll(carried)
    rows = known.select(*keys, "_b", "x", F.col("y").alias("py"), F.col("x").alias("px"), F.lit(False).alias("asked"))
    sought = dealt[1].select(*keys, "_b", "x", F.lit(None).cast("double").alias("py"), F.lit(None).cast("double").alias("px"), F.lit(True).alias("asked"))
    w = Window.partitionBy(*keys, "_b").orderBy("x", "asked")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    near = rows.unionByName(sought).withColumns(
        {f"{n}{s}": f(c, ignorenulls=True).over(v) for s, f, v in (("0", F.last, back), ("1", F.first, ahead)) for n, c in (("x", "px"), ("y", "py"))}
    )
    slope = (F.col("y1") - F.col("y0")) / F.nullif(F.col("x1") - F.col("x0"), F.lit(0.0))
    value = F.coalesce(F.col("y0") + slope * (F.col("x") - F.col("x0")), "y0", "y1")
    return near.where("asked").select(*keys, "x", value.alias("y"))


def combinations(names: DataFrame, sizes: tuple[int, ...] = (1, 2), unit: str = "unit", metric: str = "metric_name") -> DataFrame:
    """(unit, n_metrics, metrics, model_name): every choice of a unit's metrics, and the baseline without any."""
    own = names.select(unit, metric).distinct()
    out = own.select(unit).distinct().select(unit, F.lit(0).alias("n_metrics"), F.array().cast("array<string>").alias("metrics"))
    now = own.select(unit, F.array(metric).alias("metrics"))
    for k in range(1, max(sizes) + 1):
        if k > 1:
            now = now.join(own, unit).where(F.col(metric) > F.element_at("metrics", -1)).select(unit, F.concat("metrics", F.array(metric)).alias("metrics"))
        if k in sizes:
            out = out.unionAll(now.select(unit, F.lit(k).alias("n_metrics"), "metrics"))
    return out.withColumn("model_name", F.when(F.size("metrics") == 0, "baseline").otherwise(F.concat_ws("+", "metrics")))


def replicates(df: DataFrame, n: int, name: str = "rep") -> DataFrame:
    """Each row once for each replicate number 0 to n-1, without a join."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def leave_one_out(df: DataFrame, key: str = "subject") -> DataFrame:
    """(fold, train) for each row: with k distinct keys, every row is in k folds. For reports on few subjects; model
    jobs subtract a fold's sums instead."""
    folds = df.select(F.col(key).alias("fold")).distinct()
    return df.join(dimension(folds)).withColumn("train", F.col(key) != F.col("fold"))


def best_unit(scores: DataFrame, concept: str, unit: str, score: str) -> DataFrame:
    """(concept, unit): the one with the highest mean score; the first by name of equal ones."""
    means = scores.groupBy(concept, unit).agg(F.avg(score).alias("m"))
    return means.withColumn("_r", F.row_number().over(Window.partitionBy(concept).orderBy(F.desc("m"), unit))).where("_r = 1").select(concept, unit)


def concat_sessions(sessions: DataFrame, samples: DataFrame) -> DataFrame:
    """samples (subject, session, i, x) renumbered over a subject's sessions (subject, session, n_samples) in order."""
    before = F.sum("n_samples").over(Window.partitionBy("subject").orderBy("session")) - F.col("n_samples")
    offsets = sessions.select("subject", "session", before.alias("_o"))
    return samples.join(dimension(offsets), ["subject", "session"]).withColumn("i", F.col("i") + F.col("_o")).drop("_o")


def registry(df: DataFrame, experiments: DataFrame, key: str) -> DataFrame:
    return df.join(dimension(experiments), key)


def attach_fitted(rows: DataFrame, fitted: DataFrame, row_id: str = "row_id") -> DataFrame:
    return rows.join(fitted.select(row_id, "fitted"), row_id, "left")


def concept_pairs(channel: DataFrame, source: DataFrame, concepts: DataFrame) -> DataFrame:
    """concepts (concept, channel_model, source_model) with both fits' AIC; a concept without a source fit stays."""
    c = channel.select(F.col("model_name").alias("channel_model"), F.col("aic").alias("channel_aic"))
    s = source.select(F.col("model_name").alias("source_model"), F.col("aic").alias("source_aic"))
    return concepts.join(c, "channel_model").join(s, "source_model", "left")
