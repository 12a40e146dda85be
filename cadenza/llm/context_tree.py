"""Language-model scores by context-tree weighting over bytes, learned from the whole training part of a corpus.

Texts are bytes with A-Z in lower case and an end symbol. A byte is eight binary decisions; each decision has a
node in the context of every depth, the empty context to the ``depth`` preceding bytes, with counts of 0 and 1 and
the Krichevsky-Trofimov estimate of both. The weighted probability of a node is half its own estimate's and
half the product of its children's, from the deepest up; the share that its own estimate has in it is its weight, and
a decision's probability mixes the estimates of all depths by these weights. Summed logarithms are the
code length of a text.

Counts come from all training texts: chunks send their distinct grams of ``depth`` + 1 bytes with training counts to
blocks. A block has all grams of the contexts of TOP bytes that fall to it, so it weighs the subtrees below them by itself;
the levels above are aggregations of node tables, and the code lengths of the grams go back to the chunks that
hold them. Words for the unigram score take the same way; they are told apart by 64-bit hashes. No table of the model
is broadcast or collected.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .exchange import ANSWERED, Chunk, Corpus, joined, loosen, parted, split_sorted, squeeze
from .vectors import numbered, runs, segments, spread, words

#: Bytes of context; 3 to 7, so that a gram is one 64-bit key.
DEPTH = 5
#: Bytes of the contexts whose subtrees are weighed whole, by one block each.
TOP = 3
END, START = 0xFF, b"\n"
_SCRAMBLE, _LOW = 0x9E3779B1, np.uint64((1 << 8 * TOP) - 1)
_UNSCRAMBLE = np.uint64(pow(_SCRAMBLE, -1, 1 << 8 * TOP))
WORDS, GRAMS = 0, 1


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def training(chunk: Chunk) -> np.ndarray:
    return np.array([not is_held_out(i) for i in chunk.doc_ids()], bool)


def grams(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(key of each byte and end, offset of each document). A key has, from its first bits down, the TOP bytes before the
    symbol, scrambled so that they fall evenly into blocks; the bytes before these, latest first; and the symbol."""
    raw = np.frombuffer(b"".join(x for t in texts for x in (START * depth, t, bytes([END]))), np.uint8).astype(np.uint64)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    out = np.zeros(len(raw), np.uint64)
    for back in range(1, depth + 1):
        out[back:] |= raw[:-back] << np.uint64(8 * (depth - back))
    rest = np.uint64(8 * (depth - TOP))
    top = (out >> rest) * np.uint64(_SCRAMBLE) & _LOW
    out = (top << rest | out & ((np.uint64(1) << rest) - np.uint64(1))) << np.uint64(8) | raw
    symbol = np.ones(len(raw), bool)
    first = np.cumsum(sizes + depth) - sizes - depth
    for k in range(depth):
        symbol[first + k] = False
    return out[symbol], np.r_[0, np.cumsum(sizes)]


def chunk_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, offset of each document)."""
    hashes, offsets, done = [], [np.zeros(1, np.int64)], 0
    for _, _, text, starts in segments(texts):
        _, _, own, at = words(text, starts)
        hashes.append(own)
        offsets.append(at[1:] + done)
        done += len(own)
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.concatenate(offsets)


def _counted(keys: np.ndarray, taught: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of so many bits, and how often each is among those that are ``taught``."""
    if bits < 64:
        ordered = np.sort(keys << np.uint64(1) | taught)
        ordered, flags = ordered >> np.uint64(1), ordered & np.uint64(1)
    else:
        order = np.argsort(keys)
        ordered, flags = keys[order], taught[order]
    run = runs(ordered)
    return ordered[run], (np.add.reduceat(flags.astype(np.int64), run) if len(run) else run).astype(np.uint32)


_HALF = np.r_[math.lgamma(0.5), math.lgamma(0.5) + np.cumsum(np.log(np.arange(1 << 16) + 0.5))]
_WHOLE = np.r_[0.0, np.cumsum(np.log(np.arange(1, (1 << 16) + 1)))]


def _log_gamma(n: np.ndarray, table: np.ndarray, plus: float) -> np.ndarray:
    """Of n + plus, from the table as far as it goes, by Stirling's series beyond."""
    y = np.maximum(n, 1.0) + plus
    far = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3)
    return np.where(n < len(table), table[np.minimum(n, len(table) - 1)], far)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The logarithm of the Krichevsky-Trofimov probability of a zeros and b ones, in some order."""
    return _log_gamma(a, _HALF, 0.5) + _log_gamma(b, _HALF, 0.5) - _log_gamma(a + b, _WHOLE, 1.0) - math.log(math.pi)


class Subtrees:
    """The nodes below the contexts of TOP bytes of these sorted keys, by depth and decision.

    ``names[d][j]``: context and the j bits before the decision, sorted; ``up[d][j]``: the place of each node's parent at
    depth d - 1; n0, n1, weighted and weight likewise."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int):
        self.keys, self.depth = keys, depth
        self.names: dict[int, list[np.ndarray]] = {}
        self.n0, self.n1, self.weighted, self.weight, self.up = {}, {}, {}, {}, {}
        symbol = keys & np.uint64(255)
        for d in range(depth, TOP - 1, -1):
            own = keys >> np.uint64(8 * (depth - d) + 8) << np.uint64(8) | symbol
            if d < depth:
                own, inverse = np.unique(own, return_inverse=True)
                sums = np.bincount(inverse, weights=counts, minlength=len(own)).astype(np.int64)
            else:
                sums = counts.astype(np.int64)
            rows = ([], [], [], [], [])
            for j in range(8):
                names = own >> np.uint64(8 - j)
                run = np.flatnonzero(np.r_[True, names[1:] != names[:-1]]) if len(names) else np.zeros(0, np.int64)
                ones = np.where(own >> np.uint64(7 - j) & np.uint64(1), sums, 0)
                n1 = np.add.reduceat(ones, run) if len(run) else run
                n0 = (np.add.reduceat(sums, run) if len(run) else run) - n1
                alone = log_kt(n0, n1)
                if d == depth:
                    weighted, weight = alone, np.ones(len(run))
                else:
                    below, lower = self.names[d + 1][j], self.weighted[d + 1][j]
                    parent = np.searchsorted(names[run], below >> np.uint64(8 + j) << np.uint64(j) | below & np.uint64((1 << j) - 1))
                    self.up.setdefault(d + 1, []).append(parent)
                    product = np.bincount(parent, weights=lower, minlength=len(run))
                    total = np.logaddexp(alone, product)
                    weighted, weight = total - math.log(2.0), np.exp(alone - total)
                for column, x in zip(rows, (names[run], n0, n1, weighted, weight)):
                    column.append(x)
            self.names[d], self.n0[d], self.n1[d], self.weighted[d], self.weight[d] = rows

    def heads(self) -> pa.Table:
        """The nodes at depth TOP: c (its bytes, oldest first), node, n0, n1, weighted, weight."""
        node = [(names & np.uint64((1 << j) - 1)) | np.uint64(1 << j) for j, names in enumerate(self.names[TOP])]
        context = [plain_context(names >> np.uint64(j)) for j, names in enumerate(self.names[TOP])]
        columns = (context, node, self.n0[TOP], self.n1[TOP], self.weighted[TOP], self.weight[TOP])
        kinds = [np.int64] * 4 + [np.float64] * 2
        return pa.table([pa.array(np.concatenate(c).astype(k)) for c, k in zip(columns, kinds)], names=["c", "node", "n0", "n1", "weighted", "weight"])

    def code_lengths(self, context: np.ndarray, node: np.ndarray, p: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """The bits of each key, from what the levels down to TOP give its nodes: the part of the probability of a 1
        that is settled, and the share of the depths below."""
        bits = np.zeros(len(self.keys))
        level = np.frexp(node.astype(float))[1] - 1
        for j in range(8):
            mine = np.flatnonzero(level == j)
            name = scrambled_context(context[mine]) << np.uint64(j) | node[mine].astype(np.uint64) & np.uint64((1 << j) - 1)
            mine = mine[np.argsort(name)]
            one, left = p[mine], rest[mine]
            for d in range(TOP + 1, self.depth + 1):
                up, weight = self.up[d][j], self.weight[d][j]
                estimate = (self.n1[d][j] + 0.5) / (self.n0[d][j] + self.n1[d][j] + 1.0)
                one, left = one[up] + left[up] * weight * estimate, left[up] * (1 - weight)
            at = np.searchsorted(self.names[self.depth][j], self.keys >> np.uint64(8 - j))
            bit = self.keys >> np.uint64(7 - j) & np.uint64(1)
            bits -= np.log2(np.where(bit == 1, one[at], 1 - one[at]))
        return bits


def plain_context(scrambled: np.ndarray) -> np.ndarray:
    """A key's first bits as a number whose lowest byte is the latest."""
    x = scrambled * _UNSCRAMBLE & _LOW
    return sum(((x >> np.uint64(8 * i) & np.uint64(255)) << np.uint64(8 * (TOP - 1 - i)) for i in range(TOP)), np.zeros(len(x), np.uint64))


def scrambled_context(plain: np.ndarray) -> np.ndarray:
    x = plain.astype(np.uint64)
    x = sum(((x >> np.uint64(8 * i) & np.uint64(255)) << np.uint64(8 * (TOP - 1 - i)) for i in range(TOP)), np.zeros(len(x), np.uint64))
    return x * np.uint64(_SCRAMBLE) & _LOW


def mixed_heads(heads: DataFrame) -> DataFrame:
    """(block, c, node, p, rest) of the nodes ``heads`` at depth TOP: the levels above weighed and mixed down to them."""
    levels, now = [heads], heads
    for depth in range(TOP - 1, -1, -1):
        mask = (1 << 8 * depth) - 1
        up = now.groupBy(F.col("c").bitwiseAND(F.lit(mask)).alias("c"), "node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("weighted").alias("below"))
        up = up.withColumn("own", _log_kt(F.col("n0"), F.col("n1")))
        # log(exp(own) / 2 + exp(below) / 2), and the share of the first.
        high = F.greatest("own", "below")
        total = high + F.log(F.exp(F.col("own") - high) + F.exp(F.col("below") - high))
        up = up.withColumns({"weighted": total - math.log(2.0), "weight": F.exp(F.col("own") - total)})
        now = stored(up.select("c", "node", "n0", "n1", "weighted", "weight"), "context-nodes")
        levels.append(now)
    estimate = (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1.0)
    mixed = levels[-1].select("c", "node", (F.col("weight") * estimate).alias("p"), (1 - F.col("weight")).alias("rest"))
    for depth in range(1, TOP + 1):
        level = levels[TOP - depth].withColumn("up", F.col("c").bitwiseAND(F.lit((1 << 8 * (depth - 1)) - 1)))
        parent = mixed.select(F.col("c").alias("up"), "node", "p", "rest")
        block = ["block"] if depth == TOP else []
        mixed = level.join(parent, ["up", "node"]).select(*block, "c", "node", (F.col("p") + F.col("rest") * F.col("weight") * estimate).alias("p"), (F.col("rest") * (1 - F.col("weight"))).alias("rest"))
    return mixed


def _log_kt(a: Column, b: Column) -> Column:
    return _log_gamma_of(a + 0.5) + _log_gamma_of(b + 0.5) - _log_gamma_of(a + b + 1.0) - math.log(math.pi)


def _log_gamma_of(x: Column) -> Column:
    """For x > 0, by Stirling's series at x + 6."""
    y = x + 6.0
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5.0)))
    return series - F.log(x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of all parts with the sums of their counts."""
    keys = np.concatenate([k for k, _ in parts])
    order = np.argsort(keys, kind="stable")
    run = np.flatnonzero(np.r_[True, np.diff(keys[order]) != 0])
    return keys[order][run], np.add.reduceat(np.concatenate([c for _, c in parts]).astype(np.int64)[order], run)


def _lists(asked: pa.ChunkedArray, kind: type) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for x in asked.to_pylist():
        keys, counts = parted(x)
        out.append((np.cumsum(loosen(keys, kind), dtype=kind), loosen(counts, np.uint32)))
    return out


def score(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte of every row.

    Null and empty texts have the end only. A null doc_id is never held out; repeated rows are scored alike; an empty
    table gives no rows. Without a training row all counts are 0 and every decision costs one bit. Texts of any length
    are taken whole; other columns, whatever they are called, are left out."""
    if not TOP <= depth <= 7:
        raise ValueError(f"a context has {TOP} to 7 bytes")
    corpus = Corpus(docs)
    word_bits, gram_bits, key_bits = corpus.bits(corpus.bytes / 25), corpus.bits(corpus.bytes / 10), 8 * (depth + 1)

    def asks(chunk: Chunk) -> Iterator[tuple[int, bytes]]:
        texts, taught = [t.lower() for t in chunk.texts], training(chunk)
        for what, (keys, offsets), size, bits in ((WORDS, chunk_words(texts), 64, word_bits), (GRAMS, grams(texts, depth), key_bits, gram_bits)):
            distinct, counts = _counted(keys, np.repeat(taught, np.diff(offsets)), size)
            for lead, a, b in split_sorted(distinct, size - bits):
                yield lead << 1 | what, joined(squeeze(np.diff(distinct[a:b], prepend=distinct.dtype.type(0))), squeeze(counts[a:b]))

    asked = stored(corpus.ask(asks), "language-model-counts")

    def word_answers(table: pa.Table) -> pa.Table:
        lists = _lists(table["asked"], np.uint64)
        keys, counts = _merged(lists)
        made = [squeeze(counts[np.searchsorted(keys, k)].astype(np.uint64)) for k, _ in lists]
        first = [1, *[0] * (len(lists) - 1)]
        sums = [[int(x) * f for f in first] for x in ((counts > 0).sum(), counts.sum())]
        return pa.table({"chunk": table["chunk"], "block": table["block"], "answer": pa.array(made, pa.binary()), "v": pa.array(sums[0], pa.int64()), "n": pa.array(sums[1], pa.int64())})

    word_rows = stored(asked.where(F.col("block") % 2 == WORDS).groupBy("block").applyInArrow(word_answers, ANSWERED + ", v long, n long"), "word-counts")
    sums = word_rows.agg(F.coalesce(F.sum("v"), F.lit(0)).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    ends = docs.where(~held_out()).count()
    total, vocabulary = sums["n"] + ends, sums["v"] + (ends > 0)

    def gram_heads(table: pa.Table) -> pa.Table:
        heads = Subtrees(*_merged(_lists(table["asked"], np.uint64)), depth).heads()
        return heads.append_column("block", pa.array([table["block"][0].as_py()] * len(heads), pa.int64()))

    gram_lists = asked.where(F.col("block") % 2 == GRAMS)
    heads = gram_lists.groupBy("block").applyInArrow(gram_heads, "c long, node long, n0 long, n1 long, weighted double, weight double, block long")
    mixed = mixed_heads(stored(heads, "context-heads"))

    def gram_answers(table: pa.Table, above: pa.Table) -> pa.Table:
        lists = _lists(table["asked"], np.uint64)
        keys, counts = _merged(lists)
        bits = Subtrees(keys, counts, depth).code_lengths(*(above[c].to_numpy() for c in ("c", "node", "p", "rest"))).astype(np.float32)
        made = [squeeze(bits[np.searchsorted(keys, k)]) for k, _ in lists]
        return pa.table({"chunk": table["chunk"], "block": table["block"], "answer": pa.array(made, pa.binary())})

    gram_rows = gram_lists.groupBy("block").cogroup(mixed.groupBy("block")).applyInArrow(gram_answers, ANSWERED)
    answers = word_rows.select("chunk", "block", "answer").unionAll(gram_rows)
    base_of = math.log10(total + vocabulary + 1)

    def tells(chunk: Chunk, replies: dict[int, bytes]) -> pa.Table:
        texts = [t.lower() for t in chunk.texts]
        out = []
        for what, (keys, offsets), kind in ((WORDS, chunk_words(texts), np.uint64), (GRAMS, grams(texts, depth), np.float32)):
            values = [loosen(replies[b], kind) for b in sorted(replies) if b % 2 == what]
            values = np.concatenate(values) if values else np.zeros(0, kind)
            _, order, counts = numbered(keys)
            each = spread(values, order, counts)
            for x in ((np.log10(each + 1.0), each > 0) if what == WORDS else (each,)):
                running = np.r_[0.0, np.cumsum(x, dtype=np.float64)]
                out.append(running[offsets[1:]] - running[offsets[:-1]])
        log_counts, known, bits = out
        n = np.array([len(t.split()) for t in texts], np.int64) + 1
        base = log_counts + math.log10(ends + 1.0) - n * base_of
        ids = chunk.doc_ids()
        size = np.array([len(t) for t in chunk.texts], np.int64)
        columns = (ids, [is_held_out(i) for i in ids], n, known.astype(np.int64) + (ends > 0), [total] * len(n), base, -bits * math.log10(2), size, bits / np.maximum(size, 1))
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.float64())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=NAMES)

    return corpus.tell(answers, tells, SCHEMA)


NAMES = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte"]
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"
