"""Mixes sources to target weights by hash-threshold histograms, in DataFrame functions only.

Each document has a 60-bit hash. A source's budget of words is met by the documents whose hash lies below a
threshold: words are summed by source and hash bucket, the bucket in which the running sum passes the budget is
found, and only its documents are summed again by finer buckets, until the threshold is one hash value. What lies under
a threshold is nested: a larger budget takes all that a smaller one takes. What is missing then is less than the
documents of one hash have; by default (``fill``) the one document that fits the gap best is taken too, which a larger
budget need not take. Nothing is sorted but sums: at most BUCKETS rows a source, and one row a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, join_small, packed_row, stored, whole_text

#: Bits of the hash that each refinement looks at; five look at all 60.
LEVEL_BITS, LEVELS = 12, 5
WEIGHTS = (5, 2, 1)
MOST_COPIES = 3


def sizes(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Adds size (words), hash (of doc_id) and source_key (source, told apart from null) to the kept columns."""
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return docs.select(
        *(keep or ["doc_id"]),
        F.regexp_count(whole_text(), F.lit(WORD)).cast("long").alias("size"),
        F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("hash"),
        F.when(F.col("source").isNotNull(), F.concat(F.lit("="), "source")).otherwise(F.lit("")).alias("source_key"),
    )


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source_key, source_size, target): weights repeat over sources by code point, null last.

    Shares are filled like vessels: with sources in ascending order of most*size/weight, the first k are full,
    and the others share what is left by weight. One row a source is sorted in one task: names of sources are taken to be
    thousands, not one for each document."""
    total = sized.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    by_code = Window.orderBy(F.col("source_key") == "", "source_key")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_code) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = total.withColumn("weight", weight).withColumn("fills_at", F.col("source_size") * float(most) / F.col("weight"))
    up, rest = Window.orderBy("fills_at", "source_key"), Window.partitionBy()
    rows = rows.withColumns(
        {
            "full_before": F.sum("source_size").over(up) * most - F.col("source_size") * most,
            "weight_left": F.sum("weight").over(rest) - F.sum("weight").over(up) + F.col("weight"),
            "all": F.sum("source_size").over(rest),
        }
    )
    rows = rows.withColumn("level", (F.col("all") - F.col("full_before")).cast("double") / F.col("weight_left"))
    # The level of the first source that its share doesn't fill holds for all after it.
    level = F.min(F.when(F.col("level") <= F.col("fills_at"), F.struct("fills_at", "source_key", "level"))).over(rest)["level"]
    target = F.least(F.col("source_size") * float(most), F.coalesce(level, F.lit(float("inf"))) * F.col("weight"))
    return rows.select("source_key", "source_size", target.alias("target"))


def _bucket(level: int) -> Column:
    return F.shiftright("hash", LEVEL_BITS * (LEVELS - 1 - level))


def thresholds(sized: DataFrame, goals: DataFrame, fill: bool = True) -> DataFrame:
    """(source_key, source_size, target, copies, threshold, extra_hash).

    Every document is taken ``copies`` times, those with a hash under ``threshold`` once more, and with ``fill`` the one with
    ``extra_hash`` too: the hash at the threshold or, if that overshoots further, the largest document
    above it that still fits. Without it extra_hash is null and takes are nested."""
    state = goals.withColumns(
        {
            "copies": F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"),
            "prefix": F.lit(0).cast("long"),
        }
    ).withColumn("left", F.col("target") - F.col("copies") * F.col("source_size"))
    for level in range(LEVELS):
        inside = join_small(sized, state.select("source_key", "prefix"), "source_key", "inner")
        if level:
            inside = inside.where(_bucket(level - 1) == F.col("prefix"))
        sums = inside.groupBy("source_key", _bucket(level).alias("bucket")).agg(F.sum("size").alias("n"))
        running = Window.partitionBy("source_key").orderBy("bucket")
        sums = sums.join(state, "source_key").withColumn("through", F.sum("n").over(running))
        # The boundary is the first bucket whose running sum passes the budget; if none does, all is taken.
        passed = sums.where(F.col("through") > F.col("left")).groupBy("source_key").agg(F.min(F.struct("bucket", "through", "n")).alias("at"))
        state = stored(
            state.join(passed, "source_key", "left").select(
                "source_key", "source_size", "target", "copies",
                F.coalesce("at.bucket", F.when(F.lit(level == 0), F.lit(1 << LEVEL_BITS)).otherwise(F.shiftleft(F.col("prefix"), LEVEL_BITS))).alias("prefix"),
                (F.col("left") - F.coalesce(F.col("at.through") - F.col("at.n"), F.when(F.lit(level == 0), F.col("left")), F.lit(0))).alias("left"),
            ),
            "mix-thresholds",
        )
    if not fill:
        return state.select("source_key", "source_size", "target", "copies", F.col("prefix").alias("threshold"), F.lit(None).cast("long").alias("extra_hash"))
    above = join_small(sized, state.select("source_key", "prefix", "left"), "source_key", "inner").where(F.col("hash") >= F.col("prefix"))
    per_hash = above.where((F.col("hash") == F.col("prefix")) | (F.col("size") <= F.col("left"))).groupBy("source_key", "hash", "prefix", "left").agg(F.sum("size").alias("n"))
    gap = F.abs(F.col("left") - F.col("n"))
    best = per_hash.where((F.col("n") > 0) & (gap < F.col("left"))).groupBy("source_key").agg(F.min(F.struct(gap.alias("gap"), "hash")).alias("best"))
    return state.join(best, "source_key", "left").select("source_key", "source_size", "target", "copies", F.col("prefix").alias("threshold"), F.col("best.hash").alias("extra_hash"))


def times_taken() -> Column:
    once_more = (F.col("hash") < F.col("threshold")) | F.coalesce(F.col("hash") == F.col("extra_hash"), F.lit(False))
    return F.col("copies") + F.when(once_more & (F.col("copies") < MOST_COPIES), 1).otherwise(0)


def plan(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sized documents, thresholds); the text is read once, later passes read a few numbers a document."""
    sized = stored(sizes(docs), "mix-sizes")
    goals = stored(targets(sized), "mix-targets")
    return sized, thresholds(sized, goals)


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted) and copies of every document.

    Null texts have no words; rows with one doc_id have one hash and are taken alike; a document without words
    takes none, and is copied as its hash says. A null source is a source of its own. An empty table gives an empty report;
    texts of any length are counted whole; other columns, whatever they are called, are left out."""
    sized, limits = plan(docs)
    rows = join_small(sized, limits, "source_key").withColumn("copies", times_taken())
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mix(docs: DataFrame) -> DataFrame:
    """The mixed documents, repeated as often as they are taken, with the columns of ``docs``, whatever they are called.

    Null and empty texts have no words and are taken as their hash says; a null source is a source of its own; rows with
    one doc_id are taken alike; an empty table stays empty. Texts of any length are counted whole."""
    _, limits = plan(docs)
    rows = docs.select("doc_id", "text", "source", packed_row(docs).alias("_row"))
    taken = join_small(sizes(rows, ["_row"]), limits, "source_key").withColumn("copies", times_taken()).where(F.col("copies") > 0)
    return taken.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("_row.*")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS hash,
         CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS k
  FROM documents),
s AS (SELECT k, sum(size)::BIGINT AS source_size FROM sized GROUP BY k),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY k = '', k) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
f AS (SELECT *, source_size * 3.0::DOUBLE / weight AS fills_at FROM w),
g AS (SELECT *, sum(source_size) OVER u * 3 - source_size * 3 AS full_before,
             sum(weight) OVER () - sum(weight) OVER u + weight AS weight_left, sum(source_size) OVER () AS total
      FROM f WINDOW u AS (ORDER BY fills_at, k)),
h AS (SELECT *, (total - full_before)::DOUBLE / weight_left::DOUBLE AS level FROM g),
t AS (SELECT k, source_size, least(source_size * 3.0::DOUBLE,
             coalesce((SELECT arg_min(level, (fills_at, k)) FROM h WHERE level <= fills_at), 'inf'::DOUBLE) * weight) AS target FROM h),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM t),
r AS (SELECT *, target - copies * source_size AS budget FROM b),
p AS (SELECT k, hash, sum(size)::BIGINT AS n FROM sized GROUP BY k, hash),
c AS (SELECT p.*, budget, sum(n) OVER (PARTITION BY p.k ORDER BY hash) AS through FROM p JOIN r USING (k)),
l AS (SELECT k, min(CASE WHEN through > budget THEN hash END) AS threshold,
             any_value(budget) - coalesce(sum(CASE WHEN through <= budget THEN n END), 0) AS gap FROM c GROUP BY k),
x AS (SELECT p.k, arg_min(hash, (abs(gap - n), hash)) AS extra FROM p JOIN l USING (k)
      WHERE hash >= threshold AND (hash = threshold OR n <= gap) AND n > 0 AND abs(gap - n) < gap GROUP BY p.k)
SELECT doc_id, size, source_size, target,
       (copies + CASE WHEN copies < 3 AND (threshold IS NULL OR hash < threshold OR hash = extra) THEN 1 ELSE 0 END) * size AS taken,
       copies + CASE WHEN copies < 3 AND (threshold IS NULL OR hash < threshold OR hash = extra) THEN 1 ELSE 0 END AS copies
FROM sized JOIN r USING (k) JOIN l USING (k) LEFT JOIN x USING (k)
"""
