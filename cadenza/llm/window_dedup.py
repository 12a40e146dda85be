"""Removes words under windows that also start in a document with a smaller doc_id, by a count-min prefilter.

Every chunk makes a count-min sketch of its window hashes: DEPTH rows of counters, kept as the sorted counters that
aren't 0, each as 1 or "more". The chunks' sketches are merged by adding, with "more" as 2, so an estimate is never under
the lesser of 2 and the true count, and a window with an estimate of 1 is its own only one. The second pass takes the windows estimated repeated,
and only these, and groups them by a 128-bit hash of their words: each gets the least doc_id that it starts in.

The rows have 2**bits counters, eight times the corpus's windows or more: with two rows, about one window in
sixty is counted too high. No window with a second occurrence is lost, whatever the width.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .exchange import Chunk, Corpus, answer, joined, loosen, parted, split_sorted, squeeze
from .vectors import counted, mixed, numbered, segments, spread, windows, within, words

WINDOW, DEPTH = 13, 2


def _words(chunk: Chunk) -> Iterator[tuple[int, list[bytes]]]:
    for i, text in enumerate(chunk.texts):
        yield i, text.split()


def window_starts(chunk: Chunk, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, word, hash) of every window of the chunk."""
    docs, at, hashes = [], [], []
    for first, _, text, starts in segments(chunk.texts):
        _, _, own, offsets = words(text, starts)
        made = windows(own, k)
        ok = np.flatnonzero(within(offsets, k, len(made)))
        doc = np.searchsorted(offsets, ok, side="right") - 1
        docs.append(doc + first)
        at.append(ok - offsets[doc])
        hashes.append(made[ok])
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(docs), np.concatenate(at), np.concatenate(hashes)


def counters(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The counter of each window in a row of the sketch."""
    return mixed(hashes + np.uint64(0x9E3779B97F4A7C15 * (row + 1) & (1 << 64) - 1)) >> np.uint64(64 - bits)


def sketch(hashes: np.ndarray, bits: int, block_bits: int) -> Iterator[tuple[int, bytes]]:
    """The rows' counters that aren't 0, in blocks: differences of sorted counters, and which are over 1."""
    for row in range(DEPTH):
        cells, counts = counted(counters(hashes, row, bits))
        for lead, a, b in split_sorted(cells, bits - block_bits):
            yield row << block_bits | lead, joined(squeeze(np.diff(cells[a:b], prepend=np.uint64(0))), np.packbits(counts[a:b] > 1).tobytes())


def merge_sketches(asked: list[bytes]) -> list[bytes]:
    """Of each sketch, which of its counters are over 1 when all are added."""
    cells, most = [], []
    for data in asked:
        packed, over = parted(data)
        cells.append(np.cumsum(loosen(packed, np.uint64), dtype=np.uint64))
        most.append(1 + np.unpackbits(np.frombuffer(over, np.uint8), count=len(cells[-1])))
    all_cells = np.concatenate(cells)
    order = np.argsort(all_cells, kind="stable")
    run = np.flatnonzero(np.diff(all_cells[order], prepend=all_cells[order[:1]] ^ np.uint64(1)))
    totals = np.add.reduceat(np.concatenate(most)[order].astype(np.int64), run)
    repeated = np.empty(len(all_cells), bool)
    repeated[order] = np.repeat(totals > 1, np.diff(np.r_[run, len(all_cells)]))
    return [np.packbits(x).tobytes() for x in np.split(repeated, np.cumsum([len(c) for c in cells])[:-1])]


def estimated_repeated(hashes: np.ndarray, answers: dict[int, bytes], bits: int, block_bits: int) -> np.ndarray:
    """Which windows have an estimate over 1 in every row of the merged sketch."""
    out = np.ones(len(hashes), bool)
    for row in range(DEPTH):
        cells, order, counts = numbered(counters(hashes, row, bits))
        over = np.zeros(len(cells), bool)
        for lead, a, b in split_sorted(cells, bits - block_bits):
            over[a:b] = np.unpackbits(np.frombuffer(answers[row << block_bits | lead], np.uint8), count=b - a).astype(bool)
        out &= spread(over, order, counts)
    return out


def exact_keys(chunk: Chunk, docs: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """[windows, 2] halves of the 128-bit hash of each window's words, joined by a space."""
    out = np.empty((len(docs), 2), np.uint64)
    digest, done = xxhash.xxh3_128_intdigest, 0
    low = (1 << 64) - 1
    for part in np.split(np.arange(len(docs)), np.flatnonzero(np.diff(docs)) + 1):
        if not len(part):
            continue
        own = chunk.texts[docs[part[0]]].split()
        ends = np.cumsum([len(w) + 1 for w in own])
        text, starts = b" ".join(own), np.r_[0, ends[:-1]]
        made = [digest(text[a:b]) for a, b in zip(starts[at[part]].tolist(), (ends[at[part] + k - 1] - 1).tolist())]
        out[done : done + len(part), 0] = np.fromiter((x >> 64 for x in made), np.uint64, len(made))
        out[done : done + len(part), 1] = np.fromiter((x & low for x in made), np.uint64, len(made))
        done += len(part)
    return out


def least_ids(asked: list[bytes]) -> list[bytes]:
    """Of each chunk's keys the least doc_id over all chunks."""
    parts = [parted(x) for x in asked]
    high = [loosen(p[0], np.uint64) for p in parts]
    key = np.stack((np.concatenate(high), np.concatenate([loosen(p[1], np.uint64) for p in parts])))
    ids = np.concatenate([loosen(p[2], np.int64) for p in parts])
    order = np.lexsort((key[1], key[0]))
    new = np.r_[True, (np.diff(key[0][order]) != 0) | (np.diff(key[1][order]) != 0)]
    run = np.flatnonzero(new)
    least = np.empty(len(ids), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(ids[order], run), np.diff(np.r_[run, len(ids)]))
    return [squeeze(x) for x in np.split(least, np.cumsum([len(h) for h in high])[:-1])]


def covered(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n words lie in a window of k that starts at one of ``starts``."""
    turns = np.zeros(n + 1, np.int64)
    np.add.at(turns, starts, 1)
    np.add.at(turns, starts + k, -1)
    return np.cumsum(turns)[:n] > 0


def dedup_windows(docs: DataFrame, k: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the other words joined by a space) of every row.

    Null and empty texts have no words. Of rows with one doc_id none has the smaller one, so they don't clear each
    other; a null doc_id counts as the largest long. Texts under k words have no window; an empty table gives no rows.
    Texts of any length are taken whole, and other columns are left out."""
    corpus = Corpus(docs)
    guess = max(1.0, corpus.bytes / 4)
    bits, block_bits, key_bits = max(24, int(np.ceil(np.log2(8 * guess)))), corpus.bits(guess), corpus.bits(guess / 4)

    def asks(chunk: Chunk) -> Iterator[tuple[int, bytes]]:
        return sketch(window_starts(chunk, k)[2], bits, block_bits)

    def own_row(rows: list[tuple[int, bytes]]) -> pa.Table:
        return pa.table({"block": pa.array([b for b, _ in rows], pa.int64()), "asked": pa.array([x for _, x in rows], pa.binary())})

    def candidates(chunk: Chunk, answers: dict[int, bytes]) -> pa.Table:
        """Block -1: the chunk's own candidates, for itself; the others: their keys and least doc_ids."""
        doc, at, hashes = window_starts(chunk, k)
        some = estimated_repeated(hashes, answers, bits, block_bits)
        doc, at = doc[some], at[some]
        key = exact_keys(chunk, doc, at, k)
        order = np.lexsort((key[:, 1], key[:, 0]))
        sorted_key = key[order]
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(sorted_key[:, 0]) != 0) | (np.diff(sorted_key[:, 1]) != 0)
        run = np.flatnonzero(new)
        number = np.empty(len(order), np.uint32)
        number[order] = np.cumsum(new) - 1
        least = np.minimum.reduceat(chunk.ids[doc][order], run) if len(run) else np.zeros(0, np.int64)
        distinct = sorted_key[run]
        rows = [(-1, joined(squeeze(np.diff(doc, prepend=0).astype(np.uint32)), squeeze(np.diff(at, prepend=0).astype(np.int32)), squeeze(number)))] if len(doc) else []
        for lead, a, b in split_sorted(distinct[:, 0], 64 - key_bits):
            rows.append((lead, joined(squeeze(distinct[a:b, 0]), squeeze(distinct[a:b, 1]), squeeze(least[a:b]))))
        return own_row(rows).append_column("chunk", pa.array([chunk.number] * len(rows), pa.int64())).select(["block", "chunk", "asked"])

    found = stored(corpus.tell(answer(corpus.ask(asks), merge_sketches), candidates, "block long, chunk long, asked binary"), "window-candidates")
    own = found.where("block < 0").select("chunk", "block", F.col("asked").alias("answer"))
    replies = answer(found.where("block >= 0"), least_ids).unionAll(own)

    def clear(chunk: Chunk, answers: dict[int, bytes]) -> pa.Table:
        gone: dict[int, np.ndarray] = {}
        if -1 in answers:
            a, b, c = parted(answers.pop(-1))
            doc, at, number = np.cumsum(loosen(a, np.uint32), dtype=np.int64), np.cumsum(loosen(b, np.int32), dtype=np.int64), loosen(c, np.uint32)
            least = np.concatenate([loosen(answers[x], np.int64) for x in sorted(answers)])
            hit = least[number] < chunk.ids[doc]
            doc, at = doc[hit], at[hit]
            for part in np.split(np.arange(len(doc)), np.flatnonzero(np.diff(doc)) + 1):
                if len(part):
                    gone[int(doc[part[0]])] = at[part]
        rows, ids = [], chunk.doc_ids()
        for i, own_words in _words(chunk):
            n, removed = len(own_words), 0
            if i in gone:
                out = covered(gone[i], k, n)
                removed = int(out.sum())
                own_words = [w for w, x in zip(own_words, out.tolist()) if not x]
            rows.append((ids[i], n, removed, b" ".join(own_words).decode("utf-8", "surrogatepass")))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "n_words", "n_removed", "kept"])

    return corpus.tell(replies, clear, "doc_id long, n_words long, n_removed long, kept string")


def window_report(docs: DataFrame) -> DataFrame:
    """The digest of ``dedup_windows``: doc_id, n_words, n_removed, kept_sha256."""
    return dedup_windows(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


#: For tables whose doc_ids are distinct.
ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
k AS (SELECT doc_id, s, array_to_string(words[s : s + 12], ' ') AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS s FROM w WHERE len(words) >= 13)),
m AS (SELECT win, min(doc_id) AS first_id FROM k GROUP BY win),
g AS (SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS i FROM k JOIN m USING (win) WHERE first_id < doc_id),
r AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(array_to_string(list_filter(words, lambda x, i: NOT list_contains(coalesce(gone, []), i)), ' ')) AS kept_sha256
FROM w LEFT JOIN r ON w.doc_id = r.doc_id
"""
