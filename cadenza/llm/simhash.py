"""SimHash near-duplicates: fingerprints of word shingles, linked at few differing bits, by a popcount embedding.

Each fingerprint is mapped to the bit counts of its SEGMENTS segments. The Manhattan distance of two such vectors is
at most the Hamming distance of the fingerprints, so a range join under Manhattan distance loses no link.
The join's grid: the segments are dealt into g groups, by GROUPS as many as the fingerprints' number asks for, and vectors at
distance d or less agree wholly in g - d groups or more; those cells are the join keys. Candidates pass the Manhattan test, then the bits are compared.

Only distinct fingerprints are joined, so copies cost nothing. A cell with more than CELL distinct fingerprints is
cut into blocks of about CELL, every pair of blocks is one task, and of the links that it finds it returns a
spanning forest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEY_ROWS, join_small, packed_row, stored, whole_text
from .components import components
from .overlap import SEED, frequent_shingles, overlap_links, parities, prefix, shingle_hashes, shingles, short_parities, slices

SEGMENT_BITS = 2
#: Groups of segments for so many distinct fingerprints; more groups are more but smaller cells.
GROUPS = ((10**9, 6), (10**10, 7), (10**11, 8), (10**12, 9))
SEGMENTS = 64 // SEGMENT_BITS
CELL = 256


def fingerprint(text: str, shingle: int = 3) -> int:
    """A bit is 1 if set in over half of the shingles' XXH64; of no word 0, of fewer words their whole sequence."""
    return majority(shingle_hashes(text, shingle))


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of these shingles' hashes."""
    bits = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        bits += np.unpackbits(hashes[i : i + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, keep: list[str] | None = None, shingle: int = 3) -> DataFrame:
    """The kept columns (doc_id) and ``fp``, the fingerprint as a signed long."""
    keep = keep or ["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([fingerprint(x.as_py(), shingle) for x in batch.column(len(keep))], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], made], names=[*keep, "fp"])

    rows = docs.select(*keep, whole_text().alias("_text"))
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[:-1])
    return rows.mapInArrow(run, f"{kinds}, fp long")


def segment_counts(fp: str = "fp") -> Column:
    """The embedding, one bit count a segment, as an array."""
    mask = (1 << SEGMENT_BITS) - 1
    return F.array(*[F.bit_count(F.shiftrightunsigned(fp, SEGMENT_BITS * i).bitwiseAND(F.lit(mask))) for i in range(SEGMENTS)])


def groups_for(n: int) -> int:
    return next((g for most, g in GROUPS if n <= most), GROUPS[-1][1])


def _group_keys(groups: int, fp: str = "fp") -> list[Column]:
    """Of each group of segments, its counts as digits of one number."""
    mask, base, out = (1 << SEGMENT_BITS) - 1, SEGMENT_BITS + 1, []
    for g in range(groups):
        total = F.lit(0).cast("long")
        for i in range(g, SEGMENTS, groups):
            total = total * base + F.bit_count(F.shiftrightunsigned(fp, SEGMENT_BITS * i).bitwiseAND(F.lit(mask)))
        out.append(total)
    return out


def _manhattan(a: str, b: str) -> Column:
    mask, total = (1 << SEGMENT_BITS) - 1, F.lit(0)
    for i in range(SEGMENTS):
        x, y = (F.bit_count(F.shiftrightunsigned(c, SEGMENT_BITS * i).bitwiseAND(F.lit(mask))) for c in (a, b))
        total = total + F.abs(x - y)
    return total


def cells(distinct: DataFrame, most: int, groups: int) -> DataFrame:
    """(cell, fp): a row for each choice of the groups that must agree; cell hashes the choice and its counts."""
    keyed = distinct.select("fp", *[k.alias(f"k{g}") for g, k in enumerate(_group_keys(groups))])
    chosen = list(combinations(range(groups), max(0, groups - most)))
    made = [F.xxhash64(F.lit(i), *[F.col(f"k{g}") for g in some]) for i, some in enumerate(chosen)]
    return keyed.select("fp", F.explode(F.array(*made)).alias("cell"))


def _bits(a: np.ndarray, b: np.int64) -> np.ndarray:
    return np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64))


def _forest(nodes: np.ndarray, left: np.ndarray, right: np.ndarray, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the near pairs between two sets of places in ``nodes``; the least nodes come first, so cells
    that hold the same nodes tend to give the same links."""
    out, part = [], np.arange(len(nodes))
    for i in left[np.argsort(nodes[left])].tolist():
        hit = right[near(i, right)]
        hit = hit[part[hit] != part[i]]
        if len(hit):
            others, first = np.unique(part[hit], return_index=True)
            out += [(int(nodes[i]), int(y)) for y in nodes[hit[first]]]
            part[np.isin(part, others)] = part[i]
    return out


def _pairs(found: list[tuple[int, int]]) -> pa.Table:
    u, v = zip(*found) if found else ((), ())
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def links(distinct: DataFrame, most: int = 3, groups: int | None = None) -> DataFrame:
    """(u, v) of distinct fingerprints at Hamming distance ``most`` or less: all links of cells of CELL fingerprints at
    most, by a join; of a larger one a spanning forest of each pair of its blocks of about CELL, so that nothing linked is torn apart."""
    placed = stored(cells(distinct, most, groups or groups_for(distinct.count())), "cells")
    counted = placed.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    shared = placed.join(counted, "cell")
    small, large = shared.where(F.col("n") <= CELL), shared.where(F.col("n") > CELL)
    side = lambda k: small.select("cell", F.col("fp").alias(f"fp_{k}"))
    near = (_manhattan("fp_u", "fp_v") <= most) & (F.bit_count(F.col("fp_u").bitwiseXOR(F.col("fp_v"))) <= most)
    pairs = side("u").join(side("v"), "cell").where("fp_u > fp_v").where(near)

    def run(table: pa.Table) -> pa.Table:
        own, fp = table["own"].to_numpy(), table["fp"].to_numpy()
        mine = own == table["i"][0].as_py()
        left, right = np.flatnonzero(mine), np.flatnonzero(~mine)
        return _pairs(_forest(fp, left, right if len(right) else left, lambda x, rest: _bits(fp[rest], fp[x]) <= most))

    blocks = F.ceil(F.col("n") / CELL).cast("int")
    dealt = large.withColumns({"blocks": blocks, "own": F.pmod(F.xxhash64("fp"), blocks).cast("int")})
    faced = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    faced = faced.select("cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp")
    found = faced.groupBy("cell", "i", "j").applyInArrow(run, "u long, v long")
    return pairs.select(F.col("fp_u").alias("u"), F.col("fp_v").alias("v")).unionAll(found)


def near_duplicates(docs: DataFrame, most: int = 3, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the least doc_id reachable over links) of every row.

    Null and empty texts have fingerprint 0 and link like any other; rows with one doc_id may lie in two components;
    a component of null doc_ids only has a null component_id. An empty table gives no rows; texts of any length are taken whole;
    other columns, whatever they are called, are left out."""
    own = stored(fingerprints(docs, ["doc_id"], shingle), "fingerprints")
    labelled = component_table(own, links(own.select("fp").distinct(), most))
    return join_hot(own, labelled).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def component_table(own: DataFrame, pairs: DataFrame) -> DataFrame:
    """(fp, component_id) of each distinct fp of ``own`` (doc_id, fp), by links (u, v) between them."""
    least = stored(own.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    linked = stored(least.join(components(pairs).withColumnRenamed("node", "fp"), "fp"), "linked-fingerprints")
    heads = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    # One root may have a third of all fingerprints.
    labels = join_small(linked.select("fp", "root"), heads, "root", "left", salts=16).select("fp", "component_id")
    alone = least.join(linked, "fp", "left_anti").select("fp", F.col("first_id").alias("component_id"))
    return stored(labels.unionAll(alone), "components")


def join_hot(rows: DataFrame, labelled: DataFrame) -> DataFrame:
    """Fingerprints with very many rows take a small broadcast table, the others an ordinary join."""
    return join_small(rows, labelled, "fp", "left", salts=16)


def profiles(keyed: DataFrame, keep: list[str], shingle: int, similarity: float) -> DataFrame:
    """The kept columns, fp; and of the set of shingles s, its number, size, odd and short, its parities, and first, its prefix."""
    frequent, places = frequent_shingles(keyed, shingle)
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches):
            made = []
            for hashes in shingles(some.column(len(keep)).to_pylist(), shingle):
                own = np.unique(hashes)
                number = np.uint64(xxhash.xxh64_intdigest(own.tobytes(), SEED)).view(np.int64)
                made.append((majority(hashes), number, len(own), parities(own), short_parities(own), prefix(own, similarity, frequent, places).view(np.int64)))
            columns = [pa.array([m[i] for m in made], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*some.columns[: len(keep)], *columns], names=[*keep, "fp", "s", "size", "odd", "short", "first"])

    rows = keyed.select(*keep, "_text")
    types = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[:-1])
    return rows.mapInArrow(run, f"{types}, fp long, s long, size int, odd array<long>, short array<long>, first array<long>")


def one_of_each(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, most: int = 3) -> DataFrame:
    """Keeps, with the columns of ``docs``, one document of each group of near-duplicates: that with the least doc_id (of
    rows with one doc_id the one whose text has the least hash), and one of its rows if several are equal.

    Two documents are near-duplicates if the fingerprints of their five-word shingles differ in ``most`` bits or fewer
    (found by the grid, none missed); if their sets of shingles have a Jaccard similarity of ``similarity`` or more
    (by a prefix filter, none missed); or if they share a shingle of their prefixes and ``similarity`` of their
    fingerprints' bits. The grid can't reach so many bits: its cells would hold all documents.

    Null and empty texts are near-duplicates of each other; a null doc_id counts as larger than all others. An empty
    table stays empty; columns of any name are kept as they are. Texts of any length are taken whole."""
    keyed = docs.select("doc_id", whole_text().alias("_text"), F.xxhash64(whole_text()).alias("_h"))
    own = stored(profiles(keyed, ["doc_id", "_h"], shingle, similarity), "fingerprints")
    known = links(own.select("fp").distinct(), most)
    pairs = stored(overlap_links(own, keyed, known, similarity, shingle, int(64 * (1 - similarity) + 1e-9)), "near-duplicates")
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_h")
    firsts = own.groupBy("fp").agg(F.min(place).alias("first"))
    rooted = firsts.join(components(pairs).withColumnRenamed("node", "fp"), "fp", "left")
    heads = rooted.groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first")).select("first.doc_id", "first._h")
    ids = own.select("doc_id", "_h").groupBy("doc_id", "_h").agg((F.count("*") > 1).alias("repeated"))
    same = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}._h") == F.col(f"{b}._h"))
    gone = stored(ids.alias("i").join(heads.alias("h"), same("i", "h"), "left_anti").select("doc_id", "_h"), "removed")
    gone = F.broadcast(gone) if gone.count() <= KEY_ROWS else gone
    rows = docs.select(packed_row(docs).alias("_row"), "doc_id", F.xxhash64(whole_text()).alias("_h"))
    kept = rows.alias("r").join(gone.alias("g"), same("r", "g"), "left_anti")
    if not ids.where("repeated").isEmpty():
        kept = kept.dropDuplicates(["doc_id", "_h"])
    return kept.select("_row.*")
