"""Quality scores from a sparse ensemble of rules over text statistics.

A small forest is grown on labelled statistics; each of its tree paths becomes a conjunctive rule; a logistic
model with a lasso penalty weighs the rules, most get weight 0, and those that stay are compiled into one Spark column
expression over the statistics. Growing and weighing run on at most FIT_ROWS labelled rows, those with the least
hashes of doc_id: that bound is a parameter. Statistics and scores cover every row and every whole text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEY_ROWS, join_small, packed_row, stored, whole_text

FIT_ROWS = 20_000
TREES, DEPTH, LASSO, SEED = 24, 3, 0.002, 7

#: The column of statistics.
STATS = "_text_statistics"
STATISTICS = [
    "log_bytes", "log_words", "word_length", "upper", "digits", "symbols", "marks", "pipes", "white", "non_ascii",
    "distinct_words", "top_word", "long_words", "shouted_words", "symbol_ended_words", "line_words", "repeated_lines",
    "short_lines", "sentence_ends", "repeated_pairs",
]
_CLASS = np.zeros(256, np.uint8)
_CLASS[list(range(65, 91))], _CLASS[list(range(48, 58))] = 1, 2
_CLASS[list(b"#$%&*+<=>@[]^_`{}~\\/")], _CLASS[list(b"!?;")], _CLASS[ord("|")] = 3, 4, 5
_CLASS[[9, 10, 11, 12, 13, 32]], _CLASS[128:] = 6, 7


def text_statistics(text: str) -> list[float]:
    """STATISTICS of a whole text; those of an empty one are 0."""
    raw = text.encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * len(STATISTICS)
    n = len(raw)
    kinds = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=8) / n
    words = raw.split()
    w = len(words) or 1
    seen: dict[bytes, int] = {}
    for x in words:
        seen[x] = seen.get(x, 0) + 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    m = len(lines) or 1
    return [
        math.log1p(n), math.log1p(len(words)), sum(map(len, words)) / w, kinds[1], kinds[2], kinds[3], kinds[4], kinds[5], kinds[6], kinds[7],
        len(seen) / w, max(seen.values(), default=0) / w, sum(len(x) > 20 for x in words) / w, sum(x.isupper() for x in words) / w,
        sum(x[-1] in b"#$%&*!|" for x in words) / w, w / m, 1 - len(set(lines)) / m if lines else 0.0,
        sum(len(x) < 30 for x in lines) / m, raw.count(b".") / w, 1 - len(set(zip(words, words[1:]))) / max(1, len(words) - 1) if len(words) > 1 else 0.0,
    ]


def statistics(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The kept columns (doc_id) and the column STATS, an array in the order of STATISTICS."""
    keep = keep or ["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([text_statistics(x.as_py()) for x in batch.column(len(keep))], float).round(9).reshape(len(batch), -1)
            stats = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * len(STATISTICS), pa.int32()), pa.array(made.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], stats], names=[*keep, STATS])

    rows = docs.select(*keep, whole_text().alias("_text"))
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[:-1])
    return rows.mapInArrow(run, f"{kinds}, {STATS} array<double>")


@dataclass(frozen=True)
class Rule:
    """Holds where each (statistic, at_most, bound) does: value <= bound, or value > bound."""

    terms: tuple[tuple[int, bool, float], ...]
    weight: float = 0.0

    def column(self, stats: str = STATS) -> Column:
        out = F.lit(True)
        for i, at_most, bound in self.terms:
            value = F.col(stats)[i]
            out = out & ((value <= bound) if at_most else (value > bound))
        return out

    def __str__(self) -> str:
        return " and ".join(f"{STATISTICS[i]} {'<=' if low else '>'} {b:.4g}" for i, low, b in self.terms) + f": {self.weight:+.3f}"


@dataclass(frozen=True)
class RuleModel:
    rules: tuple[Rule, ...]
    intercept: float

    def score(self, stats: str = STATS) -> Column:
        """The probability of label 1, as one expression of comparisons and sums."""
        total = F.lit(self.intercept)
        for rule in self.rules:
            total = total + F.when(rule.column(stats), F.lit(rule.weight)).otherwise(F.lit(0.0))
        return F.round(1 / (1 + F.exp(-total)), 9)


def tree_rules(forest: RandomForestClassificationModel) -> list[Rule]:
    """Each path from a root to a node below it, as a rule; repeated ones once."""
    found: dict[tuple, None] = {}
    path: list[tuple[int, tuple[int, bool, float]]] = []
    for line in forest.toDebugString.splitlines():
        if m := re.match(r"^( *)(If|Else) \(feature (\d+) (<=|>) ([-+.\dEe]+)\)", line):
            path = [x for x in path if x[0] < len(m[1])] + [(len(m[1]), (int(m[3]), m[4] == "<=", float(m[5])))]
            found.setdefault(tuple(sorted({term for _, term in path})))
        elif line.lstrip().startswith("Tree"):
            path = []
        elif line.lstrip().startswith(("If", "Else")):
            raise ValueError(f"a split of another form: {line.strip()}")
    return [Rule(x) for x in found]


def fit_rules(labelled: DataFrame) -> RuleModel:
    """``labelled``: STATS and label (0 or 1). With one label only, or none, the model is a constant."""
    rows = labelled.select(STATS, F.col("label").cast("double").alias("label"))
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n, good = sum(counts.values()), counts.get(1.0, 0)
    if not good or good == n:
        return RuleModel((), math.log((good + 0.5) / (n - good + 0.5)))
    vectors = rows.select("label", array_to_vector(STATS).alias("features"))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, maxBins=64, subsamplingRate=0.5, featureSubsetStrategy="onethird", minInstancesPerNode=3, seed=SEED).fit(vectors)
    rules = tree_rules(forest)
    if not rules:
        return RuleModel((), math.log(good / (n - good)))
    holds = F.array(*[r.column().cast("double") for r in rules])
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, maxIter=60, standardization=False).fit(rows.select("label", array_to_vector(holds).alias("features")))
    weights = lasso.coefficients.toArray()
    kept = tuple(Rule(r.terms, float(w)) for r, w in zip(rules, weights) if abs(w) > 1e-6)
    return RuleModel(kept, float(lasso.intercept))


def training_rows(stats: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> DataFrame:
    """(STATS, label) of labelled rows whose crc32(doc_id as text) mod 5 is not 0; of several labels of a
    doc_id the mean counts, and a half counts as 1; null labels don't count."""
    own = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    rows = stats.where(~held_out()).join(own, "doc_id")
    return rows.select(F.xxhash64("doc_id").alias("h"), "doc_id", STATS, "label").orderBy("h", "doc_id").limit(most).select(STATS, "label")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None) -> tuple[DataFrame, RuleModel]:
    """(stored statistics of every row with the kept columns, model)."""
    stats = stored(statistics(docs, keep), "quality-statistics")
    return stats, fit_rules(stored(training_rows(stats, labels), "quality-sample"))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row. Null and empty texts have the statistics 0 and a score;
    repeated rows are scored alike; a null doc_id is never held out and never labelled. An empty table gives no rows;
    texts of any length are taken whole; other columns, whatever they are called, are left out."""
    stats, model = fit(docs, labels)
    score = model.score()
    return stats.select("doc_id", held_out().alias("held_out"), score.alias("score"), (score >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with its columns, whatever they are called.

    A score depends on the text only, so texts are read once for their statistics and those of rejected texts leave by
    their 64-bit hashes. Null and empty texts are scored alike; repeated rows stay or go together; a null doc_id is
    scored like any other; an empty table stays empty. Texts of any length are taken whole."""
    keyed = docs.select("doc_id", "text", F.xxhash64(whole_text()).alias("_h"))
    stats, model = fit(keyed, labels, ["doc_id", "_h"])
    rejected = stored(stats.where(model.score() < threshold).select("_h").distinct(), "rejected")
    rows = docs.select(packed_row(docs).alias("_row"), F.xxhash64(whole_text()).alias("_h"))
    return join_small(rows, rejected, "_h", "left_anti", most=KEY_ROWS).select("_row.*")
