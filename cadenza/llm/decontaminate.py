"""Finds documents that hold benchmark items, in order or reordered, by greedy string tiling.

Texts and items are compared as tokens: letters and digits, A-Z in lower case, all other ASCII taken as
white space. Running Karp-Rabin hashes of SEED_TOKENS tokens join documents to items; for a pair
that shares seeds enough, the longest match of unmarked tokens is marked again and again (ties: first in the item,
then in the text), so tiles never overlap. The share of the item's tokens under tiles decides.

The benchmark is the query set. Up to HELD_BYTES of text, counted, every task holds its seeds and each document is
read once and shuffled never. A larger one is joined: distinct seeds of documents and of items meet by their hashes,
pairs are counted, and only those with seeds enough are tiled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import KEY_ROWS, join_small, packed_row, stored, whole_text
from .vectors import mixed, segments, stretch_hashes, token_sums, windows, within, words

SEED_TOKENS, COVERAGE = 5, 0.8
#: Bytes of items that tasks hold; some ten times as much with their hashes.
HELD_BYTES = 8_000_000
_TOKENS = bytes(b if b >= 128 or chr(b).isalnum() and not 65 <= b <= 90 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def tokens(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(_TOKENS)


def _free(taken: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """From each place on: the tokens up to the next taken one or the end of its stretch."""
    stops = np.append(np.flatnonzero(taken), len(taken))
    return np.minimum(ends, stops[np.searchsorted(stops, np.arange(len(taken)))]) - np.arange(len(taken))


def greedy_tiles(item: np.ndarray, text: np.ndarray, least: int = SEED_TOKENS) -> list[tuple[int, int, int]]:
    """Non-overlapping (start in item, start in text, length) of equal tokens, given as numbers, ``least`` or longer.

    The longest match of tokens that aren't marked is marked, again and again; of equal ones that which comes first in the item, then
    in the text. Its length is found by bisection, by running hashes of the stretches of a length that aren't marked."""
    near = np.flatnonzero(np.isin(windows(_hashed(text), least), windows(_hashed(item), least)))
    cover = np.zeros(len(text) + 1, np.int64)
    np.add.at(cover, near, 1)
    np.add.at(cover, near + least, -1)
    places = np.flatnonzero(np.cumsum(cover)[:-1] > 0)  # of the text only what seeds cover
    if not len(places):
        return []
    own = text[places]
    breaks = np.append(np.flatnonzero(np.diff(places) > 1) + 1, len(places))
    ends = breaks[np.searchsorted(breaks, np.arange(len(places)), "right")]
    sums = [token_sums(_hashed(x)) for x in (item, own)]
    taken = [np.zeros(len(x), bool) for x in (item, own)]
    whole = [np.full(len(item), len(item)), ends]
    tiles, longest = [], len(item)

    def starts(size: int) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for k in (0, 1):
            at = np.flatnonzero(free[k] >= size)
            out.append((at, stretch_hashes(sums[k], at, at + size)))
        return out

    while longest >= least:
        free = [_free(t, e) for t, e in zip(taken, whole)]
        low, high = least - 1, min(longest, int(free[0].max()), int(free[1].max()))
        while low < high:
            size = (low + high + 1) >> 1
            (_, a), (_, b) = starts(size)
            if len(a) and len(b) and np.isin(a, b).any():
                low = size
            else:
                high = size - 1
        if low < least:
            break
        (at, a), (to, b) = starts(low)
        order = np.argsort(b, kind="stable")
        to, b = to[order], b[order]
        free_from = 0
        for i, lo, hi in zip(at.tolist(), np.searchsorted(b, a).tolist(), np.searchsorted(b, a, "right").tolist()):
            if lo == hi or i < free_from:
                continue
            while lo < hi:
                j = int(to[lo])
                marked = np.flatnonzero(taken[1][j : j + low])
                if len(marked):
                    lo += int(np.searchsorted(to[lo:hi], j + int(marked[-1]) + 1))
                elif (item[i : i + low] == own[j : j + low]).all():
                    taken[0][i : i + low] = taken[1][j : j + low] = True
                    tiles.append((i, int(places[j]), low))
                    free_from = i + low
                    break
                else:
                    lo += 1
        longest = low - 1
    return tiles


def _hashed(numbers: np.ndarray) -> np.ndarray:
    return mixed(numbers.astype(np.uint64) + np.uint64(1))


def _grams(raw: bytes, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the tokens, of their runs of ``least``) of one text."""
    own = words(raw + b" ", np.array([0, len(raw) + 1]))[2]
    return own, windows(own, least)


def tiled(item: bytes, text: bytes, least: int, coverage: float) -> tuple[int, int, int] | None:
    """(item's tokens, covered ones, tiles) if enough of the item is covered. Seeds' hashes exclude pairs, tokens decide."""
    (a, seeds_a), (_, seeds_b) = _grams(item, least), _grams(text, least)
    if not len(a) or int(np.isin(seeds_a, seeds_b).sum()) * least < coverage * len(a):
        return None  # each seed covers at most ``least`` tokens
    numbers: dict[bytes, int] = {}
    own = np.array([numbers.setdefault(w, len(numbers)) for w in item.split()])
    other = np.array([numbers.get(w, len(numbers)) for w in text.split()])  # one number for all that the item lacks
    tiles = greedy_tiles(own, other, least)
    covered = sum(x[2] for x in tiles)
    return (len(a), covered, len(tiles)) if covered >= coverage * len(a) else None


class Items:
    """Some items, ready to be sought: sorted seed hashes with the item of each."""

    def __init__(self, rows: list[tuple[int, str]], least: int = SEED_TOKENS):
        self.least, self.ids, self.texts, self.least_seeds = least, [], [], []
        hashes, owners = [], []
        for item_id, text in rows:
            raw = tokens(text)
            own, grams = _grams(raw, least)
            if item_id is None or len(own) < least:
                continue
            distinct, counts = np.unique(grams, return_counts=True)
            hashes.append(distinct)
            # A shared seed covers ``least`` tokens at each of its places in the item, at most.
            self.least_seeds.append(len(own) / least / int(counts.max()))
            owners.append(np.full(len(hashes[-1]), len(self.ids)))
            self.ids.append(item_id)
            self.texts.append(raw)
        all_hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(all_hashes, kind="stable")
        self.hashes, self.owners = all_hashes[order], (np.concatenate(owners) if owners else np.zeros(0, np.int64))[order]

    def matches(self, texts: list[bytes], coverage: float) -> Iterator[tuple[int, int, int, int, int]]:
        """(document, item_id, item tokens, covered tokens, tiles) of pairs with enough coverage."""
        if not len(self.hashes):
            return
        for first, _, joined, starts in segments(texts):
            _, _, hashes, offsets = words(joined, starts)
            grams = windows(hashes, self.least)
            at = np.searchsorted(self.hashes, grams)
            at[at == len(self.hashes)] = 0
            hit = np.flatnonzero((self.hashes[at] == grams) & within(offsets, self.least, len(grams)))
            docs = np.searchsorted(offsets, hit, side="right") - 1
            for part in np.split(np.arange(len(hit)), np.flatnonzero(np.diff(docs)) + 1) if len(hit) else []:
                doc, found = int(docs[part[0]]), np.unique(grams[hit[part]])
                lo, hi = (np.searchsorted(self.hashes, found, side) for side in ("left", "right"))
                shared = Counter(x for a, b in zip(lo.tolist(), hi.tolist()) for x in self.owners[a:b].tolist())
                for item, n in sorted(shared.items()):
                    if n + 1e-9 >= coverage * self.least_seeds[item] and (made := tiled(self.texts[item], texts[first + doc], self.least, coverage)):
                        yield first + doc, self.ids[item], *made


def _items(benchmark: DataFrame) -> tuple[DataFrame, bool]:
    """(item_id, text) of the benchmark, and whether tasks may hold it: it was counted."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), whole_text().alias("text"))
    return rows, rows.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0] <= HELD_BYTES


FOUND = "doc_id long, item_id long, item_tokens long, covered long, tiles long"


def _held(rows: DataFrame, items: Items, coverage: float) -> DataFrame:
    """(doc_id, key, item_id, item_tokens, covered, tiles) of rows (doc_id, key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(items.matches([tokens(x.as_py()) for x in batch.column(2)], coverage))
            at = pa.array([x[0] for x in found], pa.int64())
            columns = [pa.array([x[i] for x in found], pa.int64()) for i in range(1, 5)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *columns], names=["doc_id", "key", *FOUND.replace(" long", "").split(", ")[1:]])

    return rows.mapInArrow(run, f"key long, {FOUND}".replace("key long, doc_id long", "doc_id long, key long"))


def _seeds(rows: DataFrame, keys: list[str], least: int) -> DataFrame:
    """(keys, n: tokens, seed) of the distinct seeds of rows (keys, text)."""
    k = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x in enumerate(batch.column(k)):
                own, grams = _grams(tokens(x.as_py()), least)
                seeds, counts = np.unique(grams if len(own) >= least else grams[:0], return_counts=True)
                at = pa.array(np.full(len(seeds), i))
                yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns[:k]), pa.array(np.full(len(seeds), len(own))), pa.array(seeds.view(np.int64)), pa.array(counts)], names=[*keys, "n", "seed", "times"])

    return rows.select(*keys, "text").mapInArrow(run, ", ".join(f"{c} long" for c in [*keys, "n", "seed", "times"]))


def _joined(rows: DataFrame, items: DataFrame, coverage: float, least: int = SEED_TOKENS) -> DataFrame:
    """The same as ``_held`` for items (item_id, text) of any number: a join by seeds."""
    items = stored(items.where("item_id IS NOT NULL").withColumn("item", F.xxhash64("item_id", "text")).dropDuplicates(["item"]), "items")
    wanted = stored(_seeds(items, ["item"], least), "item-seeds")
    # An item that is covered shares seeds at coverage * n / least places or more. So those of its seeds that most items have needn't
    # meet documents, as long as they are at fewer places: the others must still share the rest.
    counted = join_small(wanted, wanted.groupBy("seed").agg(F.count("*").alias("items")), "seed", "inner")
    before = F.sum("times").over(Window.partitionBy("item").orderBy(F.desc("items"), "seed"))
    ranked = counted.withColumn("dropped", (F.col("items") > 1) & (before * least < coverage * F.col("n")))
    ranked = ranked.withColumn("left_out", F.sum(F.when(F.col("dropped"), F.col("times")).otherwise(0)).over(Window.partitionBy("item")))
    ranked = stored(ranked.where(~F.col("dropped")).select("item", "n", "seed", "times", "left_out"), "rare-seeds")
    # A seed of very many documents meets the few items that have it; its documents are spread by salts.
    salt = F.pmod(F.xxhash64("key"), F.lit(32)).cast("int")
    asked = _seeds(rows.dropDuplicates(["key"]), ["key"], least).select("key", "seed", salt.alias("salt"))
    offered = ranked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(31))))
    shared = asked.join(offered, ["seed", "salt"]).groupBy("key", "item").agg(F.sum("times").alias("places"), F.first("n").alias("n"), F.first("left_out").alias("left_out"))
    pairs = stored(shared.where((F.col("places") + F.col("left_out")) * least >= coverage * F.col("n")).select("key", "item"), "seed-pairs")
    texts = join_small(rows.select("key", "text"), pairs.select("key").distinct(), "key", "left_semi", most=KEY_ROWS).dropDuplicates(["key"])
    both = pairs.join(items.withColumnRenamed("text", "item_text"), "item").join(texts, "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                key, item_id, item, text = (c[i].as_py() for c in batch.columns)
                if made := tiled(tokens(item), tokens(text), least, coverage):
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (key, item_id, *made)], names=["key", *FOUND.replace(" long", "").split(", ")[1:]])

    found = both.select("key", "item_id", "item_text", "text").mapInArrow(run, f"key long, {FOUND.partition(', ')[2]}")
    return join_small(rows.select("doc_id", "key"), stored(found, "tiles").groupBy("key").agg(F.collect_list(F.struct("item_id", "item_tokens", "covered", "tiles")).alias("hits")), "key", "inner").select("doc_id", "key", F.inline("hits"))


def _found(docs: DataFrame, benchmark: DataFrame, coverage: float) -> DataFrame:
    """(doc_id, key: the text's hash, item_id, item_tokens, covered, tiles) of each row of ``docs`` and each item that it holds."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole_text()).alias("key"), whole_text().alias("text"))
    items, small = _items(benchmark)
    if not small:
        return _joined(rows, items, coverage)
    return _held(rows, Items([(r["item_id"], r["text"]) for r in items.distinct().orderBy("item_id", "text").collect()]), coverage)


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, item_tokens, covered, coverage, tiles) of each document and item with at least
    ``coverage`` of the item's tokens under tiles.

    Items under SEED_TOKENS tokens and null item_ids match nothing; null texts are empty; repeated rows of ``docs`` give
    repeated pairs, repeated items count once; rows without doc_id are reported with a null one. An empty benchmark or
    table gives no rows; other columns are left out. Texts of any length are taken whole."""
    return _found(docs, benchmark, coverage).select("doc_id", "item_id", "item_tokens", "covered", F.round(F.col("covered") / F.col("item_tokens"), 6).alias("coverage"), "tiles")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs``, with its columns, whatever they are called, that hold no benchmark item.

    Null and empty texts stay; repeated rows stay or go together; a null doc_id doesn't matter; an empty benchmark drops
    nothing and an empty table stays empty. Texts of any length are taken whole."""
    gone = stored(_found(docs, benchmark, coverage).select("key").distinct(), "contaminated")
    rows = docs.select(packed_row(docs).alias("_row"), F.xxhash64(whole_text()).alias("key"))
    return join_small(rows, gone, "key", "left_anti", most=KEY_ROWS).select("_row.*")
