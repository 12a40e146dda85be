"""Links between documents by the sets of their word shingles, with a prefix filter for candidates.

Shingles have one order for all documents: those that stand in many of them come last, the most frequent at the very
end, the others by their hash. Two sets of similarity t share one of their first n - ceil(t n) + 1 shingles in any such
order, so no pair is lost; this one keeps the lists of shared shingles short. All documents are counted. Most prefixes
hold only shingles of low hashes: those are all counted exactly, and are frequent from a fixed number of documents on, so that
lists don't grow with the corpus. Of the others a sketch tells which may be frequent in a share of all documents, and those are counted.

The first shingle that two sets share has all that they share behind it in both; where too few follow, it doesn't make the pair.

Every list is first linked to a few of its members. Pairs that links have joined already need no check; every other pair of
a list is checked. A pair is linked if its fingerprints are near, or if its whole sets reach the similarity; texts
are read only where sizes and parities allow that. A set's parities are bits, each of them whether an odd number of
shingles falls on it: as many as differ, and no fewer, are the shingles that only one of two sets has.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEY_ROWS, join_small, stored
from .components import components
from .vectors import segments, windows, words

SEED = 42
LIST_BLOCK = 2048
#: Members of a list that all its others are compared with first.
HUBS = 3
LEAST_BITS, SHORT_BITS = 64, 256
#: A shingle is frequent in so many documents, and in that share of all; the most that are told apart.
FREQUENT, FREQUENT_SHARE, FREQUENT_MOST = 4, 0.001, 300_000
#: Hashes below LOW are frequent in COMMON documents, however small a share that is: a prefix is a fifth of a set, so it
#: reaches beyond LOW only where over 0.6 of the lower ones are frequent.
LOW, COMMON = 1 << 63, 10
#: Rows of the sketch, bits of a counter's number in a row, and blocks in which the tasks' counters are added up.
SKETCH_ROWS, SKETCH_BITS, SKETCH_BLOCKS = 2, 20, 256
#: Shingles that are gathered before they are added to a task's counters.
SKETCH_STEP = 1 << 19


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """XXH64 of the runs of ``shingle`` words, of fewer words of their whole sequence, of no word none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    joined, k = b" ".join(words), min(shingle, len(words))
    own = xxhash.xxh64_intdigest
    return np.fromiter((own(joined[a:b], SEED) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist())), np.uint64, len(words) - k + 1)


def shingles(texts: list[str], shingle: int) -> Iterator[np.ndarray]:
    """Of each text the same runs as ``shingle_hashes`` has, by a hash that is made for many texts at once."""
    for _, _, joined, starts in segments([t.encode("utf-8", "surrogatepass").lower() for t in texts]):
        _, _, own, offsets = words(joined, starts)
        whole, at = windows(own, shingle), offsets.tolist()
        for a, b in zip(at, at[1:]):
            yield whole[a : b - shingle + 1] if b - a >= shingle else windows(own[a:b], b - a) if b > a else whole[:0]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 200) -> Iterator[pa.RecordBatch]:
    """The batches in smaller ones, so that few texts are held as Python objects."""
    for batch in batches:
        for k in range(0, len(batch), rows):
            yield batch.slice(k, rows)


def prefix(distinct: np.ndarray, similarity: float, frequent: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The first shingles of a sorted set, by which it meets each set of ``similarity`` or more."""
    n = len(distinct)
    if not n:
        return distinct
    size = n - math.ceil(similarity * n - 1e-9) + 1
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, distinct), len(frequent) - 1)
        late = np.where(frequent[at] == distinct, places[at], 0)
        if late.any():
            return distinct[np.argsort(late, kind="stable")][:size]
    return distinct[:size]


def parities(distinct: np.ndarray) -> np.ndarray:
    """As many bits as shingles, up to the next power of 2 from LEAST_BITS on."""
    bits = max(LEAST_BITS, 1 << (len(distinct) - 1).bit_length()) if len(distinct) else LEAST_BITS
    odd = np.bincount((distinct >> np.uint64(20)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def short_parities(distinct: np.ndarray) -> np.ndarray:
    """SHORT_BITS bits for a set of any size, by which small sets are told apart in passing."""
    odd = np.bincount((distinct >> np.uint64(40)).astype(np.int64) % SHORT_BITS, minlength=SHORT_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def likely(similarity: float) -> Column:
    """Whether sizes and short parities of the pair size_u, q0_u, ..., size_v, q0_v, ... leave the similarity possible."""
    apart = F.lit(0)
    for i in range(SHORT_BITS // 64):
        apart = apart + F.bit_count(F.col(f"q{i}_u").bitwiseXOR(F.col(f"q{i}_v")))
    return similar_sizes(similarity) & (apart <= (1 - similarity) / (1 + similarity) * (F.col("size_u") + F.col("size_v")) + 1e-6)


def possible(similarity: float) -> Column:
    """Whether sizes and parities of the pair size_u, odd_u, size_v, odd_v leave the similarity possible.

    Of sets of similar sizes one has at most twice the other's bits; its halves, laid over each other, are its parities by half as many."""

    def fitted(own: str, other: str) -> Column:
        n = F.size(other)
        halves = F.zip_with(F.slice(own, 1, n), F.slice(own, n + 1, n), lambda a, b: a.bitwiseXOR(F.coalesce(b, F.lit(0).cast("long"))))
        return F.when(F.size(own) > n, halves).otherwise(F.col(own))

    differ = F.zip_with(fitted("odd_u", "odd_v"), fitted("odd_v", "odd_u"), lambda a, b: F.bit_count(a.bitwiseXOR(b)))
    apart = F.aggregate(differ, F.lit(0), lambda a, x: a + x)
    return similar_sizes(similarity) & (apart <= (1 - similarity) / (1 + similarity) * (F.col("size_u") + F.col("size_v")) + 1e-6)


def _counters(hashes: np.ndarray, row: int) -> np.ndarray:
    return ((hashes >> np.uint64(row * SKETCH_BITS)) & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)


def maybe_frequent(keyed: DataFrame, shingle: int, least: int) -> np.ndarray:
    """Of each counter of a count-min sketch of all texts whether it reaches ``least``, by row: a shingle from LOW on in as many
    texts has only such counters. Tasks send their counters in blocks; of each counter one bit comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = np.zeros((SKETCH_ROWS, 1 << SKETCH_BITS), np.int32), [], 0

        def add() -> None:
            hashes = np.concatenate(held)
            for row in range(SKETCH_ROWS):
                total[row] += np.bincount(_counters(hashes, row), minlength=1 << SKETCH_BITS).astype(np.int32)
            held.clear()

        for batch in slices(batches):
            for own in shingles(batch.column(0).to_pylist(), shingle):
                held.append(own[own >= np.uint64(LOW)])
                size += len(held[-1])
                if size >= SKETCH_STEP:
                    add()
                    size = 0
        if held:
            add()
        for i, part in enumerate(np.split(total.ravel(), SKETCH_BLOCKS)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=["block", "counts"])

    def merge(table: pa.Table) -> pa.Table:
        total = np.zeros(SKETCH_ROWS * (1 << SKETCH_BITS) // SKETCH_BLOCKS, np.int64)
        for counts in table["counts"]:
            total += np.frombuffer(zlib.decompress(counts.as_py()), np.int32)
        return pa.table({"block": table["block"][:1], "bits": pa.array([np.packbits(total >= least).tobytes()], pa.binary())})

    rows = keyed.select("_text").mapInArrow(count, "block int, counts binary").groupBy("block").applyInArrow(merge, "block int, bits binary").collect()
    bits = np.zeros((SKETCH_BLOCKS, SKETCH_ROWS * (1 << SKETCH_BITS) // SKETCH_BLOCKS // 8), np.uint8)
    for r in rows:
        bits[r["block"]] = np.frombuffer(r["bits"], np.uint8)
    return bits.reshape(SKETCH_ROWS, -1)


def frequent_shingles(keyed: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted shingles, their places from 1 by rising frequency) of those in FREQUENT texts and FREQUENT_SHARE of all rows
    of ``keyed`` or more, below LOW also of those in COMMON, each counted over all rows. At most FREQUENT_MOST come to the
    driver: those in as many texts as leaves no more."""
    least = max(FREQUENT, math.ceil(FREQUENT_SHARE * keyed.count()))
    bits = maybe_frequent(keyed, shingle, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.unpackbits(bits, axis=1).view(bool)
        for batch in slices(batches):
            found = []
            for own in shingles(batch.column(0).to_pylist(), shingle):
                low = own < np.uint64(LOW)
                high = own[~low]
                for row in range(SKETCH_ROWS):
                    high = high[often[row][_counters(high, row)]]
                found += [np.unique(own[low]), np.unique(high)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["token"])

    wanted = F.when(F.col("token") >= 0, min(least, COMMON)).otherwise(least)
    counts = keyed.select("_text").mapInArrow(run, "token long").groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= wanted)
    counts = stored(counts, "frequent-shingles")
    enough, seen = 0, 0
    for n, tokens_n in sorted(map(tuple, counts.groupBy("n").agg(F.count("*")).collect()), reverse=True):
        seen += tokens_n
        if seen > FREQUENT_MOST:
            enough = n + 1
            break
    rows = counts.where(F.col("n") >= enough).toArrow()
    tokens, n = rows["token"].to_numpy(), rows["n"].to_numpy()
    places = np.empty(len(tokens), np.int32)
    places[np.lexsort((tokens, -n))] = np.arange(len(tokens), 0, -1)
    order = np.argsort(tokens.view(np.uint64))
    return tokens.view(np.uint64)[order], places[order]


def near(bits: int) -> Column:
    return F.bit_count(F.col("fp_u").bitwiseXOR(F.col("fp_v"))) <= bits


def similar_sizes(similarity: float) -> Column:
    return F.least("size_u", "size_v") >= similarity * F.greatest("size_u", "size_v") - 1e-9


def fits(similarity: float) -> Column:
    """Whether the similarity is possible of sets whose first shared shingle stands at pos_u and pos_v (from 0) in their order."""
    behind = F.least(F.col("size_u") - F.col("pos_u"), F.col("size_v") - F.col("pos_v"))
    return behind >= similarity / (1 + similarity) * (F.col("size_u") + F.col("size_v")) - 1e-6


def decided(pairs: DataFrame, sets: DataFrame, keyed: DataFrame, similarity: float, shingle: int, bits: int) -> DataFrame:
    """(u, v) as fp of those pairs (s_u, s_v, fp_u, fp_v) that are near, or whose whole sets reach the similarity."""
    pairs = stored(pairs, "candidate-pairs")
    links = pairs.where(near(bits)).select(F.col("fp_u").alias("u"), F.col("fp_v").alias("v")).distinct()
    return links.unionAll(verified(pairs.where(~near(bits)).select("s_u", "s_v"), sets, keyed, similarity, shingle))


def verified(pairs: DataFrame, sets: DataFrame, keyed: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """(u, v) as fp of those pairs (s_u, s_v) whose whole sets reach the similarity; texts are read for these only."""
    of = lambda k: sets.select(*[F.col(c).alias(f"{c}_{k}") for c in ("s", "size", "odd")])
    pairs = stored(pairs.join(of("u"), "s_u").join(of("v"), "s_v").where(possible(similarity)).select("s_u", "s_v"), "overlap-pairs")
    members = pairs.select(F.col("s_u").alias("s")).unionAll(pairs.select(F.col("s_v").alias("s"))).distinct()
    needed = stored(sets.join(members, "s").select("s", "fp", "_h"), "overlap-members")
    texts = join_small(keyed.select("_h", "_text"), needed.select("_h").distinct(), "_h", "left_semi", most=KEY_ROWS).dropDuplicates(["_h"])
    texts = stored(needed.join(texts, "_h").select("s", "fp", "_text"), "overlap-texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 50):
            left, right = (map(np.unique, shingles(batch.column(i).to_pylist(), shingle)) for i in (2, 3))
            keep = []
            for a, b in zip(left, right):
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both >= similarity * (len(a) + len(b) - both) - 1e-9)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    side = lambda k: texts.select(F.col("s").alias(f"s_{k}"), F.col("fp").alias(f"fp_{k}"), F.col("_text").alias(f"text_{k}"))
    whole = pairs.join(side("u"), "s_u").join(side("v"), "s_v").select(F.col("fp_u").alias("u"), F.col("fp_v").alias("v"), "text_u", "text_v")
    return stored(whole.mapInArrow(run, "u long, v long"), "overlap-links")


def _edges(roots: DataFrame) -> DataFrame:
    """(u, v): each node and its root, which join the same nodes as the links that they came from."""
    return roots.where("node != root").select(F.col("node").alias("u"), F.col("root").alias("v"))


def overlap_links(own: DataFrame, keyed: DataFrame, known: DataFrame, similarity: float, shingle: int, bits: int) -> DataFrame:
    """Links that join what the ``known`` links (u, v) join between the fingerprints fp of ``own`` (_h, fp, s: a number of the
    shingle set, size, odd and short: its parities, first: its prefix), all other pairs of sets of ``similarity`` or more,
    and all that share a shingle of their prefixes and have fingerprints at ``bits`` or less."""
    some = own.where("size > 0")
    light = some.groupBy("s").agg(F.min(F.struct("fp", "_h", "size", "odd", "short")).alias("m")).select("s", "m.*")
    equal = some.select("s", F.col("fp").alias("u")).distinct().join(light.select("s", F.col("fp").alias("v")), "s").where("u != v").select("u", "v")
    roots = components(known.unionAll(equal))
    sets = stored(_rooted(light, roots), "shingle-sets")
    tokens = some.select("s", "first").dropDuplicates(["s"]).select("s", F.posexplode("first").alias("pos", "token"))
    # A list's hubs: its least member, and the least in other orders; a list may hold a third of all sets, so it is counted, not gathered.
    hubs = [F.min("s"), *[F.min_by("s", F.xxhash64(F.lit(k), "s")) for k in range(1, HUBS)]]
    counted = tokens.groupBy("token").agg(F.count("*").alias("n"), F.array(*hubs).alias("hubs")).where("n > 1")
    listed = stored(tokens.join(counted, "token"), "shared-shingles")

    shorts = [f"q{i}" for i in range(SHORT_BITS // 64)]
    flat = lambda rows: rows.select("s", "fp", "size", "root", *[F.col("short")[i].alias(q) for i, q in enumerate(shorts)])
    of = lambda k: flat(sets).select(*[F.col(c).alias(f"{c}_{k}") for c in ("s", "fp", "size", "root", *shorts)])
    spokes = listed.select("s", F.explode("hubs").alias("hub")).where("s != hub").select(F.greatest("s", "hub").alias("s_u"), F.least("s", "hub").alias("s_v")).distinct()
    spokes = spokes.join(of("u"), "s_u").join(of("v"), "s_v").where(F.col("root_u") != F.col("root_v")).where(near(bits) | likely(similarity))
    roots = components(_edges(roots).unionAll(decided(spokes.select("s_u", "s_v", "fp_u", "fp_v"), sets, keyed, similarity, shingle, bits)))

    labelled = stored(flat(_rooted(sets.drop("root"), roots)), "overlap-roots")
    apart = listed.select("token", "pos", "s", "n").join(labelled, "s")
    torn = apart.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("token")
    apart = stored(apart.join(torn, "token").select("token", "pos", "s", "fp", "size", "root", *shorts, F.ceil(F.col("n") / LIST_BLOCK).cast("int").alias("blocks")), "overlap-apart")
    left = apart.withColumn("block", F.pmod(F.xxhash64("s"), "blocks").cast("int"))
    right = apart.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # Each block of a long list meets its whole list, in several parts.
    side = lambda rows, k: rows.select("token", "block", *[F.col(c).alias(f"{c}_{k}") for c in ("s", "pos", "fp", "size", "root", *shorts)])
    pairs = side(left, "u").join(side(right, "v"), ["token", "block"]).where((F.col("s_u") > F.col("s_v")) & (F.col("root_u") != F.col("root_v")))
    pairs = pairs.where(near(bits) | fits(similarity) & likely(similarity))
    pairs = stored(pairs.select("s_u", "s_v", "fp_u", "fp_v", "root_u", "root_v").distinct(), "candidate-pairs")
    # What is joined already is joined by its roots, so one link for each pair of roots is enough.
    close = pairs.where(near(bits)).select(F.greatest("root_u", "root_v").alias("u"), F.least("root_u", "root_v").alias("v")).distinct()
    roots = components(_edges(roots).unionAll(close))
    now = lambda k: roots.select(F.col("node").alias(f"root_{k}"), F.col("root").alias(f"now_{k}"))
    rest = pairs.where(~near(bits)).join(now("u"), "root_u", "left").join(now("v"), "root_v", "left")
    rest = rest.where(F.coalesce("now_u", "root_u") != F.coalesce("now_v", "root_v")).select("s_u", "s_v")
    return _edges(roots).unionAll(verified(rest, sets, keyed, similarity, shingle))


def _rooted(sets: DataFrame, roots: DataFrame) -> DataFrame:
    return sets.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
