"""Tokens of two tokenizers over the same bytes, aligned where both end.

Offsets at which a token of A and one of B end are cuts; the tokens between two cuts are a group. Cuts are found by
divide and conquer: in a stretch of tokens the end of A nearest to the middle that is an end of B too, sought by
bisection, parts it in two, and both halves go on the same way; a stretch without a cut inside is a leaf, one group. All
stretches of a batch of texts take each step together.

The tokens that end at a cut are linked. How many links a pair of ids has is counted over the whole corpus by Spark, and the
counts go back to the texts' distinct pairs.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_small, stored, whole_text
from .exchange import loosen, squeeze

#: Texts are aligned in batches of about so many bytes; a longer text is one of its own.
BATCH_BYTES = 1 << 20
#: Counted id pairs that every task may hold, 16 bytes each; more are joined.
HELD_PAIRS = 2_000_000
#: Ends that all stretches try one by one before the rest of a stretch is looked through at once.
STEPS = 8
#: Stretches of white space that the faster of two equal libraries doesn't take.
_LONG_SPACE = re.compile(r"\s{20000}")


class ByteBPE:
    """A byte-level BPE vocabulary file: ids of texts, and the bytes of each id. ``tiktoken`` encodes with the file's own
    ranks and the splitting pattern that such files stand for; white space that it can't take goes to ``tokenizers``."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        special = {x["id"] for x in parts["added_tokens"]}
        self.pieces = _table({i: byte_level(x) for x, i in parts["model"]["vocab"].items()} | {x["id"]: x["content"].encode() for x in parts["added_tokens"]})
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks={x: i for i, x in enumerate(self.pieces) if i not in special}, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.whole.encode(x, add_special_tokens=False).ids if len(x) >= 20000 and _LONG_SPACE.search(x) else self.fast.encode_ordinary(x) for x in texts]


class Pieces:
    """A piece vocabulary file with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        piece = self.model.id_to_piece
        self.pieces = [bytes([int(piece(i)[3:5], 16)]) if self.model.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(self.model.get_piece_size())]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def byte_level(entry: str) -> bytes:
    """The bytes that an entry of a byte-level vocabulary stands for: printable Latin-1 is itself, the other bytes follow from U+0100 on."""
    return bytes(_BYTE_OF[c] for c in entry)


_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_OF = {chr(b): b for b in _PRINTED} | {chr(0x100 + k): b for k, b in enumerate(x for x in range(256) if x not in set(_PRINTED))}


def _table(pieces: dict[int, bytes]) -> list[bytes]:
    return [pieces.get(i, b"") for i in range(max(pieces) + 1)]


_LOADED: dict[tuple[type, str], ByteBPE | Pieces] = {}


def loaded(kind: type, path: str) -> ByteBPE | Pieces:
    """One of each for a worker process."""
    if (kind, path) not in _LOADED:
        _LOADED[kind, path] = kind(path)
    return _LOADED[kind, path]


def common_ends(a: np.ndarray, b: np.ndarray, a_from: np.ndarray, b_from: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j), sorted, of all tokens of A and B that end together. ``a``, ``b``: rising ends of the tokens of all texts;
    ``a_from``, ``b_from``: where each text's tokens begin, and their number at last; texts end together."""
    texts = np.flatnonzero(np.diff(a_from))
    found = [(a_from[1:][texts] - 1, b_from[1:][texts] - 1)]
    # Stretches of tokens [lo, hi) of both, whose ends at hi - 1 are a known cut.
    a_lo, a_hi, b_lo, b_hi = a_from[:-1][texts], a_from[1:][texts], b_from[:-1][texts], b_from[1:][texts]
    while len(a_lo):
        some = np.minimum(a_hi - a_lo, b_hi - b_lo) > 1
        a_lo, a_hi, b_lo, b_hi = a_lo[some], a_hi[some], b_lo[some], b_hi[some]
        middle, cut_a, cut_b = (a_lo + a_hi - 2) >> 1, np.full(len(a_lo), -1), np.full(len(a_lo), -1)
        left = np.arange(len(a_lo))
        for step in range(STEPS):
            i = middle[left] + ((step + 1) >> 1) * (1 if step & 1 else -1)
            inside = (i >= a_lo[left]) & (i < a_hi[left] - 1)
            ends = a[np.where(inside, i, a_lo[left])]
            j = np.searchsorted(b, ends)
            hit = inside & (b[j] == ends)
            cut_a[left[hit]], cut_b[left[hit]] = i[hit], j[hit]
            left = left[~hit & (a_hi[left] - a_lo[left] - 1 > step)]
            if not len(left):
                break
        for k in left.tolist():
            own = a[a_lo[k] : a_hi[k] - 1]
            j = np.searchsorted(b, own)
            hit = np.flatnonzero(b[j] == own)
            if len(hit):
                n = hit[np.argmin(np.abs(hit + a_lo[k] - middle[k]))]
                cut_a[k], cut_b[k] = a_lo[k] + n, j[n]
        parted = cut_a >= 0
        i, j = cut_a[parted], cut_b[parted]
        found.append((i, j))
        a_lo, a_hi, b_lo, b_hi = (np.concatenate(x) for x in ((a_lo[parted], i + 1), (i + 1, a_hi[parted]), (b_lo[parted], j + 1), (j + 1, b_hi[parted])))
    i, j = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(i)
    return i[order], j[order]


@dataclass
class Aligned:
    """Tokens of some texts: ids, where each text's begin, and the cuts (places of the tokens that end there; ``cut_from`` by text)."""

    a: np.ndarray
    b: np.ndarray
    a_from: np.ndarray
    b_from: np.ndarray
    cut_a: np.ndarray
    cut_b: np.ndarray
    cut_from: np.ndarray


def align(texts: list[str], first: ByteBPE, second: Pieces) -> Aligned:
    """Texts whose tokens don't spell a space and the text have no tokens."""
    a_ids, b_ids = first.encode([f" {t}" for t in texts]), second.encode(texts)
    for k, t in enumerate(texts):
        raw = f" {t}".encode()
        if not t or any(b"".join(map(x.pieces.__getitem__, ids)) != raw for x, ids in ((first, a_ids[k]), (second, b_ids[k]))):
            a_ids[k], b_ids[k] = [], []
    (a, a_from), (b, b_from) = map(_joined, (a_ids, b_ids))
    sizes = [np.fromiter(map(len, x.pieces), np.int64, len(x.pieces)) for x in (first, second)]
    cut_a, cut_b = common_ends(np.cumsum(sizes[0][a]), np.cumsum(sizes[1][b]), a_from, b_from)
    return Aligned(a, b, a_from, b_from, cut_a, cut_b, np.searchsorted(cut_a, a_from))


def _joined(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.cumsum([0, *map(len, ids)])
    return np.fromiter((x for own in ids for x in own), np.int64, int(offsets[-1])), offsets


class Printed:
    """Decimal ids with the mark that follows, as rows of bytes, 0 where shorter."""

    def __init__(self, most: int, marks: bytes):
        width = len(str(most)) + 1
        self.rows = np.array([[b"%d%c" % (i, m) for m in marks] for i in range(most + 1)], f"S{width}").view(np.uint8).reshape(most + 1, len(marks), width)


def printed_groups(x: Aligned, first: Printed, second: Printed) -> Iterator[bytes]:
    """Of each text its groups as `a1,a2|b1;a3|b2,b3`."""
    last_a, last_b = np.zeros(len(x.a), np.int64), np.zeros(len(x.b), np.int64)
    last_a[x.cut_a], last_b[x.cut_b] = 1, 1
    # Each token's place: those of its own kind before it, and those of the other kind in groups before it (B: with its own).
    before = np.diff(np.r_[0, x.cut_b + 1])
    place_a = np.arange(len(x.a)) + np.r_[0, np.cumsum(before)][np.cumsum(last_a) - last_a]
    place_b = np.arange(len(x.b)) + (x.cut_a + 1)[np.cumsum(last_b) - last_b] if len(x.b) else np.zeros(0, np.int64)
    width = max(first.rows.shape[2], second.rows.shape[2])
    out = np.zeros((len(x.a) + len(x.b), width), np.uint8)
    out[place_a, : first.rows.shape[2]] = first.rows[x.a, last_a]
    out[place_b, : second.rows.shape[2]] = second.rows[x.b, last_b]
    both = x.a_from + x.b_from
    for p, q in zip(both[:-1].tolist(), both[1:].tolist()):
        own = out[p:q].ravel()
        yield own[own != 0].tobytes()[:-1]


GROUPS = "array<struct<a:array<int>,b:array<int>>>"
_PLAIN = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs binary, times binary"


def _batches(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sizes = np.cumsum([len(x.as_buffer()) for x in batch.column(1)])
    cuts = [0, *(np.flatnonzero(np.diff(sizes // BATCH_BYTES)) + 1).tolist(), len(batch)]
    for p, q in zip(cuts, cuts[1:]):
        yield batch.slice(p, q - p)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))


def token_groups(docs: DataFrame, first: str, second: str) -> DataFrame:
    """(doc_id, groups): of each document the groups of ids of A (``first``, a byte-level file) and B (``second``, a piece file).

    Null and empty texts, and texts that the tokens don't spell, have none; the rest is as in ``alignment_report``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _batches(batch):
                x = align(part.column(1).to_pylist(), loaded(ByteBPE, first), loaded(Pieces, second))
                a, b = np.r_[0, x.cut_a + 1].tolist(), np.r_[0, x.cut_b + 1].tolist()
                groups = [{"a": x.a[p:q], "b": x.b[r:s]} for p, q, r, s in zip(a, a[1:], b, b[1:])]
                c = x.cut_from.tolist()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([groups[p:q] for p, q in zip(c, c[1:])], _PLAIN)], names=["doc_id", "groups"])

    return _rows(docs).mapInArrow(run, f"doc_id long, groups {GROUPS}")


def aligned(docs: DataFrame, first: str, second: str) -> DataFrame:
    """ALIGNED rows, stored: counts, the groups' digest, and each document's distinct linked id pairs (a * 2**32 + b, sorted, packed) with how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = loaded(ByteBPE, first), loaded(Pieces, second)
        print_a, print_b = Printed(len(one.pieces) - 1, b",|"), Printed(len(two.pieces) - 1, b",;")
        for batch in batches:
            for part in _batches(batch):
                x = align(part.column(1).to_pylist(), one, two)
                keys = x.a[x.cut_a] << 32 | x.b[x.cut_b]
                pairs, times = [], []
                for p, q in zip(x.cut_from[:-1].tolist(), x.cut_from[1:].tolist()):
                    own, n = np.unique(keys[p:q], return_counts=True)
                    pairs.append(squeeze(own))
                    times.append(squeeze(n.astype(np.uint32)))
                sums = [hashlib.sha256(g).hexdigest() if g else "" for g in printed_groups(x, print_a, print_b)]
                columns = [pa.array(np.diff(v)) for v in (x.a_from, x.b_from, x.cut_from)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns, pa.array(sums, pa.string()), pa.array(pairs, pa.binary()), pa.array(times, pa.binary())], names=[c.split()[0] for c in ALIGNED.split(", ")])

    return stored(_rows(docs).mapInArrow(run, ALIGNED), "aligned")


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, best) over all ``rows`` of ``aligned``: the links that hold the pair; whether no pair with its id of B has more. Stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                keys = np.concatenate([loosen(x.as_py(), np.int64) for x in batch.column(0)])
                times = np.concatenate([loosen(x.as_py(), np.uint32) for x in batch.column(1)])
                order = np.argsort(keys)
                keys = keys[order]
                new = np.flatnonzero(np.diff(keys, prepend=-1))
                sums = np.add.reduceat(times[order].astype(np.int64), new) if len(keys) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys[new]), pa.array(sums)], names=["pair", "n"])

    sums = rows.select("pairs", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    sums = stored(sums, "pair-sums").withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    most = sums.groupBy("b").agg(F.max("n").alias("most"))
    return stored(join_small(sums, most, "b", "inner", salts=16).select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pair-counts")


def _by_held(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """``rows`` with n_best and count_sum, by counts that every task holds."""
    table = counts.toArrow()
    order = np.argsort(table["pair"].to_numpy())
    keys, n, best = (table[c].to_numpy()[order] for c in ("pair", "n", "best"))
    held = rows.sparkSession.sparkContext.broadcast((keys, np.where(best, n, -n)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, signed = held.value
        for batch in batches:
            sums = []
            for own, times in zip(batch.column("pairs"), batch.column("times")):
                n = loosen(times.as_py(), np.uint32).astype(np.int64)
                found = signed[np.searchsorted(keys, loosen(own.as_py(), np.int64))] if len(n) else n
                sums.append((int(n[found > 0].sum()), int((np.abs(found) * n).sum())))
            kept = [c for c in batch.schema.names if c not in ("pairs", "times")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array([s[i] for s in sums], pa.int64()) for i in (0, 1))], names=[*kept, "n_best", "count_sum"])

    kinds = ", ".join(f"{c} {t}" for c, t in rows.drop("pairs", "times").dtypes)
    return rows.mapInArrow(run, f"{kinds}, n_best long, count_sum long")


def _by_join(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """The same for counts of any number: the pairs of each row meet them in a join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, own, times in zip(batch.column(0), batch.column(1), batch.column(2)):
                pairs, n = loosen(own.as_py(), np.int64), loosen(times.as_py(), np.uint32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), place.as_py())), pa.array(pairs), pa.array(n.astype(np.int64))], names=["_row", "pair", "times"])

    numbered = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "aligned-rows")
    pairs = numbered.select("_row", "pairs", "times").mapInArrow(run, "_row long, pair long, times long")
    of = join_small(pairs, counts, "pair", "inner", salts=32)
    sums = of.groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    out = numbered.drop("pairs", "times").join(sums, "_row", "left").drop("_row")
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_best", "count_sum")})


def alignment_report(docs: DataFrame, first: str, second: str) -> DataFrame:
    """doc_id, n_a and n_b (tokens), n_groups, n_links, n_best (links whose pair no other with its id of B exceeds in the
    corpus), count_sum (of the links' corpus counts), groups_sha256.

    ``first``: a byte-level vocabulary file (A), ``second``: a piece file (B). Null and empty texts, and texts that the
    tokens don't spell, have no tokens: zeros and an empty digest. Repeated rows are counted each; a null doc_id is kept;
    an empty table gives no rows; other columns, whatever they are called, are left out. Texts of any length are taken whole."""
    rows = aligned(docs, first, second)
    counts = pair_counts(rows)
    made = (_by_held if counts.count() <= HELD_PAIRS else _by_join)(rows, counts)
    return made.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")
