"""Connected components of links between 64-bit nodes by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Links that one task may take.
AT_ONCE = 20_000


def _star(links: DataFrame, large: bool) -> DataFrame:
    """``links``: (u, v) with v < u. large: every larger neighbour of u is linked to u's least neighbour;
    small: u and its smaller neighbours are linked to the least of them."""
    if large:
        both = links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = links.select("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    if large:
        least = least.withColumn("m", F.least("m", "u"))
    joined = both.join(least, "u")
    if large:
        return joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    moved = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def least_nodes(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the least node that each reaches) of some links."""
    nodes, places = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = places[: len(u)], places[len(u) :]
    label = np.arange(len(nodes))
    while len(a):
        high, low = np.maximum(label[a], label[b]), np.minimum(label[a], label[b])
        if (high == low).all():
            break
        np.minimum.at(label, high, low)
        while (label != label[label]).any():
            label = label[label]
    return nodes, nodes[label]


def _at_once(links: DataFrame) -> DataFrame:
    """The same as ``components`` in one task, of a table that was counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if parts:
            nodes, roots = least_nodes(*map(np.concatenate, zip(*parts)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], names=["node", "root"])

    return stored(links.coalesce(1).mapInArrow(run, "node long, root long"), "components")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of all nodes with a link, from links (u, v) in either order; root is the least node.

    Each round is two shuffles of the links that are left and is written to the shared folder; their number is
    logarithmic in the longest chain. Once no more than AT_ONCE links are left, one task ends the work."""
    now = links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = stored(now, "links")
    mark = None
    while True:
        if now.count() <= AT_ONCE:
            return _at_once(now)
        now = stored(_star(_star(now, large=True), large=False), "links")
        new = tuple(now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first())
        if new == mark:
            break
        mark = new
    own = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(own)
