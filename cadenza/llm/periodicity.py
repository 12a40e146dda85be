"""Runs of words that repeat with a period, by block convolution.

A run is a stretch of words that are identical at distance q, its smallest period, at least LEAST words and PERIODS periods long, and
that can't be made longer. With q in [B, 2B) for a power B of two it is long enough to hold a whole block of the grid of
B words together with the block's next occurrence at distance q. So at each scale B the sums of squared differences
between a block and its window, one sum for each distance in [B, 2B), show every run: they are 0 at its period. The sums are
products of number-theoretic transforms modulo PRIME, many blocks at a time; blocks and distances with sum 0 are
seeds, whose words are compared and extended to both sides. The lowest scale takes all distances under 2 LOWEST.

Two exact rules keep blocks out: a block can only repeat if its first LOWEST words recur in the document less than 2B words on; and
where a known run of a period p of at most B covers block, distance and next occurrence, a longer period is a
multiple of p (Fine and Wilf), so not the smallest.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, whole_text

LEAST, PERIODS = 24, 3
LOWEST = 8
#: 3 * 2**30 + 1, with the primitive root 5: products of residues fit 64 bits, transforms reach 2**30 words.
PRIME, ROOT = 3 * 2**30 + 1, 5
#: Words that are transformed at once, and bytes of texts whose words are numbered together; one longer text is alone.
TRANSFORMED, BATCH_BYTES = 1 << 19, 1 << 21
_P = np.uint64(PRIME)


@cache
def _roots(size: int, inverse: bool) -> list[np.ndarray]:
    """Of each butterfly level from ``size`` down to 2 the powers of its root."""
    out = []
    while size > 1:
        root = pow(ROOT, (PRIME - 1) // size, PRIME)
        root = pow(root, -1, PRIME) if inverse else root
        out.append(np.fromiter(accumulate(range(size // 2 - 1), lambda x, _: x * root % PRIME, initial=1), np.uint64, size // 2))
        size //= 2
    return out


def transform(rows: np.ndarray) -> np.ndarray:
    """The transform of each row of residues, in bit-reversed order."""
    n, size = rows.shape
    for level, powers in enumerate(_roots(size, False)):
        x = rows.reshape(n, 1 << level, 2, -1)
        a, b = x[:, :, 0], x[:, :, 1]
        rows = np.stack(((a + b) % _P, (a + (_P - b)) % _P * powers % _P), 2)
    return rows.reshape(n, size)


def restored(rows: np.ndarray) -> np.ndarray:
    """The inverse of ``transform``."""
    n, size = rows.shape
    levels = _roots(size, True)
    for level in range(len(levels) - 1, -1, -1):
        x = rows.reshape(n, 1 << level, 2, -1)
        a, b = x[:, :, 0], x[:, :, 1] * levels[level] % _P
        rows = np.stack(((a + b) % _P, (a + (_P - b)) % _P), 2)
    return rows.reshape(n, size) * np.uint64(pow(size, -1, PRIME)) % _P


def squared_differences(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Modulo PRIME, for each row and offset q: the sum over j of (blocks[j] - windows[q + j]) squared."""
    n, width = blocks.shape
    count = windows.shape[1] - width + 1
    size = 1 << (windows.shape[1] - 1).bit_length()
    a, b = np.zeros((n, size), np.uint64), np.zeros((n, size), np.uint64)
    a[:, (-np.arange(width)) % size] = blocks
    b[:, : windows.shape[1]] = windows
    both = restored(transform(a) * transform(b) % _P)[:, :count]
    sums = np.cumsum(np.pad(windows * windows % _P, ((0, 0), (1, 0))), axis=1)
    squares = (sums[:, width:] - sums[:, :count]) % _P + (blocks * blocks % _P).sum(1, keepdims=True) % _P
    return (squares + (_P - both) + (_P - both)) % _P


def _agree(own: np.ndarray, at: int, q: int, step: int) -> int:
    """How many words from ``at`` on (step 1), or before it (step -1), equal those q words on."""
    found, size = 0, 64
    while True:
        if step > 0:
            a, b = own[at + found : at + found + size], own[at + q + found : at + q + found + size]
        else:
            low = max(0, at - found - size)
            a, b = own[low : at - found][::-1], own[low + q : at - found + q][::-1]
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[:n] != b[:n])
        if len(differ):
            return found + int(differ[0])
        found += n
        if n < size:
            return found
        size *= 2


def _prime_factors(q: int) -> Iterator[int]:
    d = 2
    while d * d <= q:
        if q % d == 0:
            yield d
            while q % d == 0:
                q //= d
        d += 1
    if q > 1:
        yield q


def _extended(own: np.ndarray, seeds: np.ndarray, q: int, block: int, least: int, periods: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, q) of the runs of smallest period q around sorted ``seeds``."""
    k = 0
    while k < len(seeds):
        x = int(seeds[k])
        right = _agree(own, x, q, 1)
        if right < block:  # the sum was a multiple of PRIME
            k += 1
            continue
        start, end = x - _agree(own, x, q, -1), x + right + q
        if end - start >= max(least, periods * q) and not any(_agree(own, start, q // r, 1) >= end - start - q // r for r in _prime_factors(q)):
            yield start, end, q
        k = int(np.searchsorted(seeds, end - q - block, "right")) if end - q - block >= x else k + 1


def _repeats(own: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Distance from each word to the next place in its document where the same LOWEST words begin; 0 for none."""
    n = len(own) - LOWEST + 1
    grams = np.zeros(n, np.uint64)
    for j in range(LOWEST):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + own[j : j + n].astype(np.uint64) + np.uint64(1)
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    first, later = order[:-1][same], order[1:][same]
    inside = later < ends[first]
    out = np.zeros(n, np.int64)
    out[first[inside]] = (later - first)[inside]
    return out


def find_runs(own: np.ndarray, offsets: np.ndarray, least: int = LEAST, periods: int = PERIODS) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs, sorted, in numbered words of documents that start at ``offsets`` and end with
    a number that occurs once. ``least`` is 3 LOWEST or more, ``periods`` 3 or more."""
    if len(own) <= LOWEST or least < 3 * LOWEST or periods < 3:
        if len(own) > LOWEST:
            raise ValueError("runs under three periods or 24 words aren't sought")
        return []
    sizes = np.diff(np.r_[offsets, len(own)])
    ends = np.repeat(offsets + sizes, sizes)
    again = _repeats(own, ends)
    found: dict[tuple[int, int, int], None] = {}
    block = LOWEST
    while periods * block <= sizes.max() and (block > LOWEST or again.any()):
        low, count = (1, 2 * block - 1) if block == LOWEST else (block, block)
        places = np.arange(0, len(again), block)
        covered = np.zeros(len(places), np.int64)  # distances up to these give multiples of known periods
        if block > LOWEST:
            for s, e, _ in found:
                if e - s >= 2 * block:
                    k = np.arange(-(-s // block), min(len(places), (e - 2 * block) // block + 1))
                    covered[k] = np.maximum(covered[k], e - k * block - block)
        most = np.minimum(low + count - 1, ends[places] - places - block)  # the next occurrence ends in the document
        open_ = (again[places] > 0) & (again[places] < 2 * block) & (most >= low) & (most > covered)
        chosen = np.flatnonzero(open_)
        width = count + block - 1
        rows = max(1, TRANSFORMED // (4 * block))
        seeds: list[tuple[np.ndarray, np.ndarray]] = []
        for k in range(0, len(chosen), rows):
            some = chosen[k : k + rows]
            x = places[some]
            at = np.minimum(x[:, None] + low + np.arange(width), len(own) - 1)
            sums = squared_differences(own[x[:, None] + np.arange(block)].astype(np.uint64), own[at].astype(np.uint64))
            row, q = np.nonzero(sums == 0)
            q = q + low
            right = (q <= most[some][row]) & (q > covered[some][row])
            seeds.append((q[right], x[row[right]]))
        if seeds:
            q, x = (np.concatenate(v) for v in zip(*seeds))
            order = np.lexsort((x, q))
            q, x = q[order], x[order]
            for part in np.split(np.arange(len(q)), np.flatnonzero(np.diff(q)) + 1):
                if len(part):
                    found.update(dict.fromkeys(_extended(own, x[part], int(q[part[0]]), block, least, periods)))
        block *= 2
    return sorted((s, e, q) for s, e, q in found)


def _documents(texts: list[bytes], least: int, periods: int) -> Iterator[tuple[int, list[tuple[int, int, int]], bytes]]:
    """(words, runs as (start, length, period), the words that are kept) of each text."""
    split = [x.split() for x in texts]
    numbers: dict[bytes, int] = {}
    own = np.fromiter((numbers.setdefault(w, len(numbers)) for ws in split for w in (*ws, b" ")), np.int64, sum(len(ws) + 1 for ws in split))
    offsets = np.cumsum([0, *(len(ws) + 1 for ws in split)])[:-1]
    own[offsets + [len(ws) for ws in split]] = len(numbers) + np.arange(len(split))  # an end that occurs once
    runs = find_runs(own, offsets, least, periods)
    of = np.searchsorted(offsets, [s for s, _, _ in runs], "right") - 1
    by: dict[int, list[tuple[int, int, int]]] = {}
    for d, (s, e, q) in zip(of.tolist(), runs):
        by.setdefault(d, []).append((s - int(offsets[d]), e - s, q))
    for d, ws in enumerate(split):
        mine = by.get(d, [])
        if mine:
            keep = np.ones(len(ws), bool)
            for s, n, q in mine:
                keep[s + q : s + n] = False
            yield len(ws), mine, b" ".join([ws[i] for i in np.flatnonzero(keep).tolist()])
        else:
            yield len(ws), [], b" ".join(ws)


RUNS = "array<struct<start:long,length:long,period:long>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, least: int = LEAST, periods: int = PERIODS) -> DataFrame:
    """doc_id, n_words, runs (start and length in words, smallest period; by start, then period) and collapsed: the words that
    remain, joined by one space, when of each run only its first period is kept.

    Words are separated by ASCII white space and compared as they are. Null and empty texts have no words and no runs;
    repeated rows give repeated rows; a null doc_id is kept; an empty table gives no rows; other columns, whatever they are called,
    are left out. Texts of any length are taken whole: one over BATCH_BYTES is numbered alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum([len(x.as_buffer() or b"") for x in batch.column(1)])
            cuts = [0, *(np.flatnonzero(np.diff(sizes // BATCH_BYTES)) + 1).tolist(), len(batch)]
            for a, b in zip(cuts, cuts[1:]):
                part = batch.slice(a, b - a)
                texts = [t.encode("utf-8", "surrogatepass") for t in part.column(1).to_pylist()]
                made = list(_documents(texts, least, periods))
                runs = [[{"start": s, "length": n, "period": q} for s, n, q in m[1]] for m in made]
                kept = pa.array([m[2].decode("utf-8", "surrogatepass") for m in made], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([m[0] for m in made], pa.int64()), pa.array(runs, pa.list_(_RUN)), kept], names=["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(run, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every document whose id's checksum divides by 10 repeats, from some word on, the words from there."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    n = F.size("_words").cast("long")
    a = (g % n).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
    tail = F.transform(F.sequence(F.lit(0), F.size("_words") - a - 1), lambda i: F.element_at("_words", (a + i % p + 1).cast("int")))
    text = F.when(F.size("_words") > 0, F.concat_ws(" ", F.slice("_words", 1, a), tail)).otherwise(F.col("text"))
    words = F.when(h % 10 == 0, F.regexp_extract_all(whole_text(), F.lit(WORD), F.lit(0))).otherwise(F.array().cast("array<string>"))
    return docs.select("doc_id", "text", words.alias("_words")).select("doc_id", text.alias("text"))


def _longer(a: Column, b: Column) -> Column:
    """Orders runs by length over period, the greatest first, then by start and period."""
    left, right = a["length"] * b["period"], b["length"] * a["period"]
    tied = F.when(a["start"] != b["start"], F.signum(a["start"] - b["start"])).otherwise(F.signum(a["period"] - b["period"]))
    return F.when(left > right, -1).when(left < right, 1).otherwise(tied).cast("int")


def run_report(docs: DataFrame) -> DataFrame:
    """``periodic_runs`` as numbers and digests: doc_id, n_runs, the run of most periods, runs_sha256, collapsed_sha256."""
    best = F.get(F.array_sort("runs", _longer), 0)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return periodic_runs(docs).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        "n_words",
    )
