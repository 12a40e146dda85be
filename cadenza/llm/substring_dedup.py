"""Removes bytes under long strings that start anywhere else in the corpus, by prefix-free parsing.

A rolling hash of GRAM bytes runs over every text. The trigger of a string of ``length`` bytes is the place of the least
hash in it (the first of equal ones), so equal strings have their triggers at the same place, and a text is cut by its
triggers into overlapping phrases: all strings with one trigger, from the first one's start to the last one's
end. Equal phrases are one entry of the dictionary, and the parse is the sequence of entries. Every string of
``length`` bytes lies in one phrase, so its place in the corpus's order follows from its place in the order of the
dictionary's suffixes, and how often it occurs from that order and from how often the parse has its entry:

1. triggers that occur once in the corpus carry no repeated string and are dropped;
2. entries that the parse has twice or more are repeated as a whole;
3. entries that it has once, and beside them one copy of each repeated entry with the same trigger, are sorted: a suffix
   array of each block of the dictionary, by prefix doubling, ordered up to ``length`` bytes. Neighbours that agree
   so far are repeated strings: the edges of matches.

A block holds whole triggers, dealt by a hash, and their number follows the bytes that are to be sorted. A trigger
with more than HOT occurrences (a licence with other text around it in a third of all documents) would fill
one block: its entries are told apart by 128-bit digests, dealt by digest, and so are their strings.

Highly repetitive text is many copies of few phrases: step 2 settles it without looking at single strings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .exchange import ANSWERED, Chunk, Corpus, answer, joined, loosen, parted, split_sorted, squeeze
from .vectors import byte_sums, counted, mixed, numbered, segments, spread, stretch_hashes

LENGTH, GRAM = 400, 256
#: Of shorter strings, whose bytes are counted only.
SHORTER, SHORTER_GRAM = 256, 112
#: Longer texts are looked at in overlapping stretches of so many starts.
STRETCH = 1 << 19
_PLACE_BITS = np.uint64(24)
_PLACE = np.uint64((1 << 24) - 1)
#: Occurrences from which on a trigger's entries are dealt by digest.
HOT = 4_000
#: Bytes of the dictionary that a block sorts, about.
SORTED_BYTES = 2_000_000
DROPPED, SHARED, SPREAD = 0, 1, 2
UNIQUE, REPEATED, SHOWN = 0, 1, 2
ROWS = "block long, chunk long, asked binary"
#: Blocks of entries dealt by digest have numbers from here.
_DIGESTS = 1 << 40
#: The block under which a chunk gets what another pass has found.
_BESIDE = -2


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    out, have = keys, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def phrases(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first string start, last string start, trigger) of the phrases of the texts."""
    own, begin, parts = [], [], []
    for i, text in enumerate(texts):
        for a in range(0, max(1, len(text) - length + 1), STRETCH):
            own.append(i)
            begin.append(a)
            parts.append(text if len(text) < STRETCH else text[a : a + STRETCH + length - 1])
    own, begin = np.array(own, np.int64), np.array(begin, np.int64)
    out: list[list[np.ndarray]] = [[], [], [], []]
    for first, _, text, starts in segments(parts):
        data = np.frombuffer(text, np.uint8)
        n = len(data) - length + 1
        if n <= 0:
            continue
        at = np.arange(len(data) - gram + 1)
        hashes = stretch_hashes(byte_sums(data), at, at + gram)
        place = (_least(hashes >> _PLACE_BITS << _PLACE_BITS | at.astype(np.uint64), length - gram + 1) & _PLACE).astype(np.int64)
        turns = np.zeros(n + 1, np.int64)
        count = np.diff(starts) - length  # a space ends each part
        some = count > 0
        np.add.at(turns, starts[:-1][some], 1)
        np.add.at(turns, (starts[:-1] + count)[some], -1)
        ok = np.flatnonzero(np.cumsum(turns)[:n] > 0)
        if not len(ok):
            continue
        cut = np.r_[0, np.flatnonzero((np.diff(place[ok]) != 0) | (np.diff(ok) != 1)) + 1, len(ok)]
        low, high = ok[cut[:-1]], ok[cut[1:] - 1]
        part = np.searchsorted(starts, low, side="right") - 1
        base = begin[first + part] - starts[part]
        # The least of many hashes is small; mixed once more, triggers fall evenly into blocks.
        for column, x in zip(out, (own[first + part], low + base, high + base, mixed(~hashes[place[low]]))):
            column.append(x)
    kinds = (np.int64, np.int64, np.int64, np.uint64)
    return tuple(np.concatenate(x) if x else np.zeros(0, k) for x, k in zip(out, kinds))


def digests(made: Iterator[bytes], n: int) -> np.ndarray:
    """[n, 2] halves of 128-bit digests."""
    out = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, made)), ">u8").reshape(n, 2)
    return out.astype(np.uint64)


def _distinct(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, starts of runs of equal keys in it, number of its run for each row); the first key leads."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= np.diff(k[order]) != 0
    number = np.empty(len(order), np.uint32)
    number[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), number


def _runs_over_one(run: np.ndarray, n: int) -> np.ndarray:
    return (np.diff(np.r_[run, n]) > 1).astype(np.uint8)


def _columns(asked: list[bytes], *kinds: type) -> tuple[list[np.ndarray], np.ndarray]:
    """The columns of all chunks' lists, joined; where each chunk's part ends but for the last."""
    parts = [[loosen(x, k) for x, k in zip(parted(data), kinds)] for data in asked]
    return [np.concatenate(c) for c in zip(*parts)], np.cumsum([len(p[0]) for p in parts])[:-1]


def judge_triggers(asked: list[bytes]) -> list[bytes]:
    """Of each chunk's triggers (differences, counts): DROPPED, SHARED, or SPREAD for those with over HOT occurrences."""
    parts = [[loosen(x, k) for x, k in zip(parted(data), (np.uint64, np.uint32))] for data in asked]
    keys = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
    counts = np.concatenate([p[1] for p in parts]).astype(np.int64)
    order, run, number = _distinct(keys)
    total = np.add.reduceat(counts[order], run)
    verdict = ((total > 1).astype(np.uint8) + (total > HOT))[number]
    return [squeeze(x) for x in np.split(verdict, np.cumsum([len(p[0]) for p in parts])[:-1])]


def judge_entries(asked: list[bytes], spread: bool = False) -> list[bytes]:
    """Of each chunk's entries (trigger, two halves of the digest, over one): UNIQUE, REPEATED, or SHOWN for the one
    repeated occurrence that stands for all beside unique ones of its trigger; of entries dealt by digest always."""
    (trigger, a, b, many), ends = _columns(asked, np.uint64, np.uint64, np.uint64, np.uint8)
    order, run, number = _distinct(trigger, a, b)
    repeated = np.add.reduceat(1 + many.astype(np.int64)[order], run) > 1
    own = trigger[order][run]
    group = np.cumsum(np.r_[True, np.diff(own) != 0]) - 1
    lone = np.bincount(group, weights=~repeated) > 0
    verdict = np.where(repeated, REPEATED, UNIQUE).astype(np.uint8)[number]
    verdict[order[run[repeated & (lone[group] | spread)]]] = SHOWN
    return [squeeze(x) for x in np.split(verdict, ends)]


def judge_strings(asked: list[bytes]) -> list[bytes]:
    """Which of each chunk's strings (two halves of the digest, over one) occur twice or more among all that were listed."""
    (a, b, many), ends = _columns(asked, np.uint64, np.uint64, np.uint8)
    order, run, number = _distinct(a, b)
    return [squeeze(x) for x in np.split((np.add.reduceat(1 + many.astype(np.int64)[order], run) > 1).astype(np.uint8)[number], ends)]


def suffix_order(text: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of the suffixes at ``at`` by their first ``length`` bytes, which of them, in that order, equal the one
    before); prefix doubling: ranks by 8, 16, 32 bytes and so on, and at last by two overlapping stretches."""
    padded = np.r_[text, np.zeros(8, np.uint8)]
    words = np.zeros(len(text), np.uint64)
    for k in range(8):
        words = words << np.uint64(8) | padded[k : k + len(text)]
    known = 8
    while True:
        distinct, order, counts = numbered(words)
        ranks = spread(np.arange(len(distinct), dtype=np.uint64), order, counts)
        step = min(known, length - known)
        later = np.zeros(len(text), np.uint64)
        later[: len(text) - step] = ranks[step:]
        words = ranks << np.uint64(32) | later
        known += step
        if known == length:
            break
    keys = words[at]
    order = np.argsort(keys, kind="stable")
    return order, np.r_[False, np.diff(keys[order]) == 0][: len(at)]


def sort_entries(asked: list[bytes], length: int) -> list[bytes]:
    """Which strings of each chunk's entries (sizes, bytes) occur twice or more in this block of the dictionary."""
    sizes, texts = zip(*[(loosen(size, np.uint32).astype(np.int64), loosen(text, np.uint8)) for size, text in map(parted, asked)])
    size = np.concatenate(sizes)
    starts = np.cumsum(size) - size
    at = _steps(starts, size - length + 1)
    order, same = suffix_order(np.concatenate(texts), at, length)
    repeated = np.zeros(len(at), bool)
    repeated[order[same]] = True
    repeated[order[np.flatnonzero(same) - 1]] = True
    ends = np.cumsum([(s - length + 1).sum() for s in sizes])[:-1]
    return [np.packbits(x).tobytes() for x in np.split(repeated, ends)]


def _steps(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1 and so on, ``counts`` of each."""
    return np.repeat(starts - np.r_[0, np.cumsum(counts)[:-1]][: len(counts)], counts) + np.arange(counts.sum())


def _table(rows: list[tuple[int, bytes]], chunk: int) -> pa.Table:
    return pa.table({"block": pa.array([b for b, _ in rows], pa.int64()), "chunk": pa.array([chunk] * len(rows), pa.int64()), "asked": pa.array([x for _, x in rows], pa.binary())})


def _answers(found: DataFrame, whole: Callable, digested: Callable) -> DataFrame:
    """The chunks' own rows (block -1) and the answers of blocks of whole triggers and of blocks by digest."""
    own = found.where("block < 0").select("chunk", "block", F.col("asked").alias("answer"))
    return own.unionAll(answer(found.where((F.col("block") >= 0) & (F.col("block") < _DIGESTS)), whole)).unionAll(answer(found.where(F.col("block") >= _DIGESTS), digested))


def _routes(hot: np.ndarray, trigger: np.ndarray, high: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(block, start, end) of entries sorted by (hot, trigger or digest)."""
    n = int(len(hot) - hot.sum())
    yield from split_sorted(trigger[:n], 64 - bits)
    for lead, a, b in split_sorted(high[n:], 64 - bits):
        yield _DIGESTS + lead, n + a, n + b


def _replies(answers: dict[int, bytes], low: int, high: int) -> list[bytes]:
    return [answers[b] for b in sorted(answers) if low <= b < high]


Spans = list[list[tuple[int, int]]]


def _matched(corpus: Corpus, length: int, gram: int, finish: Callable[[Chunk, Spans, bytes | None], pa.Table], schema: str, beside: DataFrame | None = None) -> DataFrame:
    """What ``finish`` makes of each chunk, of the maximal runs in each of its texts under strings of ``length`` bytes that start anywhere
    else, and of what ``beside`` (ANSWERED, block _BESIDE) has for the chunk."""
    bits = corpus.bits(corpus.bytes * 2 / (length - gram + 1))

    def asks(chunk: Chunk) -> Iterator[tuple[int, bytes]]:
        keys, counts = counted(phrases(chunk.texts, length, gram)[3])
        for lead, a, b in split_sorted(keys, 64 - bits):
            yield lead, joined(squeeze(np.diff(keys[a:b], prepend=np.uint64(0))), squeeze(counts[a:b].astype(np.uint32)))

    def entries(chunk: Chunk, answers: dict[int, bytes]) -> pa.Table:
        doc, low, high, trigger = phrases(chunk.texts, length, gram)
        _, order, counts = numbered(trigger)
        verdict = spread(np.concatenate([loosen(x, np.uint8) for x in _replies(answers, 0, _DIGESTS)] or [np.zeros(0, np.uint8)]), order, counts)
        some = verdict != DROPPED
        doc, low, high, trigger, hot = doc[some], low[some], high[some], trigger[some], verdict[some] == SPREAD
        n = len(doc)
        if not n:
            return _table([], 0)
        key = digests((chunk.texts[d][i : j + length] for d, i, j in zip(doc.tolist(), low.tolist(), high.tolist())), n)
        order, run, number = _distinct(hot, np.where(hot, key[:, 0], trigger), trigger, key[:, 0], key[:, 1])
        first = order[run]
        many, size = _runs_over_one(run, n), (high - low + length)[first].astype(np.uint32)
        rows = [(-1, joined(*(squeeze(x.astype(np.uint32)) for x in (doc, low, high - low)), squeeze(number), squeeze(hot[first].view(np.uint8)), squeeze(trigger[first])))]
        for block, a, b in _routes(hot[first], trigger[first], key[first, 0], bits):
            rows.append((block, joined(squeeze(trigger[first[a:b]]), squeeze(key[first[a:b], 0]), squeeze(key[first[a:b], 1]), squeeze(many[a:b]), squeeze(size[a:b]))))
        return _table(rows, chunk.number)

    found = stored(corpus.tell(answer(corpus.ask(asks), judge_triggers), entries, ROWS), "entries")
    judged = stored(_answers(found, judge_entries, lambda x: judge_entries(x, True)), "entry-verdicts")
    sort_bits, string_bits = _sizes(found, judged, length)

    def edges(chunk: Chunk, answers: dict[int, bytes]) -> pa.Table:
        if -1 not in answers:
            return _table([], 0)
        doc, low, extra, number, hot, trigger = (loosen(x, k) for x, k in zip(parted(answers.pop(-1)), [np.uint32] * 4 + [np.uint8, np.uint64]))
        doc, low, extra = (x.astype(np.int64) for x in (doc, low, extra))
        verdict = np.concatenate([loosen(x, np.uint8) for x in _replies(answers, 0, 2 * _DIGESTS)])
        whole = verdict[number] != UNIQUE
        # The first occurrence in this chunk stands for the entry.
        first = np.unique(number, return_index=True)[1]
        listed = first[verdict != REPEATED]
        apart = hot[number[listed]] == 1
        rows: list[tuple[int, bytes]] = []
        sort, digest = listed[~apart], listed[apart]
        for lead, a, b in split_sorted(trigger[number[sort]], 64 - sort_bits):
            size = extra[sort[a:b]] + length
            raw = b"".join(chunk.texts[doc[i]][low[i] : low[i] + n] for i, n in zip(sort[a:b], size))
            rows.append((lead, joined(squeeze(size.astype(np.uint32)), squeeze(np.frombuffer(raw, np.uint8)))))
        holder, place = np.repeat(doc[digest], extra[digest] + 1), _steps(low[digest], extra[digest] + 1)
        key = digests((chunk.texts[d][i : i + length] for d, i in zip(holder.tolist(), place.tolist())), len(place))
        order, run, string = _distinct(key[:, 0], key[:, 1])
        many, head = _runs_over_one(run, len(order)), key[order[run]]
        for lead, a, b in split_sorted(head[:, 0], 64 - string_bits):
            rows.append((_DIGESTS + lead, joined(squeeze(head[a:b, 0]), squeeze(head[a:b, 1]), squeeze(many[a:b]))))
        mine = (doc[whole], low[whole], extra[whole], doc[sort], low[sort], extra[sort], holder, place)
        rows.append((-1, joined(*(squeeze(x.astype(np.uint32)) for x in mine), squeeze(string), squeeze((trigger[number[sort]] >> np.uint64(64 - sort_bits)).astype(np.uint32)))))
        return _table(rows, chunk.number)

    listed = stored(corpus.tell(judged, edges, ROWS), "edges")

    def clear(chunk: Chunk, answers: dict[int, bytes]) -> pa.Table:
        owner, begin, end = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        note = answers.pop(_BESIDE, None)
        if -1 in answers:
            doc, low, extra, d, p, e, holder, place, string, block = (loosen(x, np.uint32).astype(np.int64) for x in parted(answers.pop(-1)))
            bits_of = {b: np.unpackbits(np.frombuffer(x, np.uint8)).astype(bool) for b, x in answers.items() if b < _DIGESTS}
            sizes = np.bincount(block, weights=e + 1).astype(np.int64) if len(block) else []
            hit = np.concatenate([bits_of[b][: sizes[b]] for b in sorted(bits_of)] or [np.zeros(0, bool)])
            d, p = np.repeat(d, e + 1)[hit], _steps(p, e + 1)[hit]
            again = np.concatenate([loosen(x, np.uint8) for x in _replies(answers, _DIGESTS, 2 * _DIGESTS)] or [np.zeros(0, np.uint8)]).astype(bool)[string]
            owner, begin = np.r_[doc, d, holder[again]], np.r_[low, p, place[again]]
            end = np.r_[low + extra, p, place[again]] + length
        order = np.lexsort((begin, owner))
        owner, begin, end = owner[order], begin[order], end[order]
        edge = np.searchsorted(owner, np.arange(len(chunk.texts) + 1))
        return finish(chunk, [union(begin[a:b], end[a:b]) for a, b in zip(edge, edge[1:])], note)

    found = _answers(listed, lambda x: sort_entries(x, length), judge_strings)
    return corpus.tell(found if beside is None else found.unionAll(beside), clear, schema)


def dedup_substrings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shorter: tuple[int, int] | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary: the remaining bytes) of every row; and, with ``shorter`` (another length and
    gram), n_repeated: the bytes under strings of that length that start anywhere else, which are kept.

    Null and empty texts, and those under ``length`` bytes, keep all they have. Repeated rows are each other's copies.
    Strings are judged on the input; a run of one byte repeats itself and is removed. An empty table gives no rows; a
    null doc_id stays null; other columns are left out. Texts of any length are taken whole, long ones in stretches."""
    corpus = Corpus(docs)

    def covered(chunk: Chunk, spans: Spans, _: bytes | None) -> pa.Table:
        sums = squeeze(np.array([sum(b - a for a, b in own) for own in spans], np.int64))
        return pa.table({"chunk": pa.array([chunk.number], pa.int64()), "block": pa.array([_BESIDE], pa.int64()), "answer": pa.array([sums], pa.binary())})

    def cut(chunk: Chunk, spans: Spans, note: bytes | None) -> pa.Table:
        rows, ids = [], chunk.doc_ids()
        repeated = loosen(note, np.int64).tolist() if note is not None else [None] * len(spans)
        for i, text in enumerate(chunk.texts):
            at, kept = 0, []
            for a, b in spans[i]:
                kept.append(text[at:a])
                at = b
            kept.append(text[at:])
            left = b"".join(kept)
            rows.append((ids[i], len(text), len(text) - len(left), len(spans[i]), repeated[i], left))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "n_repeated", "kept"])

    beside = _matched(corpus, *shorter, covered, ANSWERED) if shorter else None
    out = _matched(corpus, length, gram, cut, "doc_id long, n_bytes long, n_removed long, n_spans long, n_repeated long, kept binary", beside)
    return out if shorter else out.drop("n_repeated")


def union(begin: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """The maximal runs that spans, sorted by their starts, cover."""
    if not len(begin):
        return []
    reach = np.maximum.accumulate(end)
    new = np.flatnonzero(np.r_[True, begin[1:] > reach[:-1]])
    return list(zip(begin[new].tolist(), reach[np.r_[new[1:] - 1, len(end) - 1]].tolist()))


def _sizes(found: DataFrame, judged: DataFrame, length: int) -> tuple[int, int]:
    """Leading bits for blocks to sort and for blocks of strings, by the bytes and strings that are to be listed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [0, 0]
            for block, asked, reply in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                size = loosen(parted(asked)[4], np.uint32).astype(np.int64)[loosen(reply, np.uint8) != REPEATED]
                sums[block >= _DIGESTS] += int((size if block < _DIGESTS else size - length + 1).sum())
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in sums], names=["bytes", "strings"])

    both = found.where("block >= 0").join(judged, ["block", "chunk"]).select("block", "asked", "answer")
    sums = both.mapInArrow(count, "bytes long, strings long").agg(F.sum("bytes").alias("bytes"), F.sum("strings").alias("strings")).first()
    bits = lambda n, most: max(4, int(np.ceil(np.log2(max(1.0, (n or 0) / most)))))
    return bits(sums["bytes"], SORTED_BYTES), bits(sums["strings"], 1_000_000)


def substring_report(docs: DataFrame) -> DataFrame:
    """The digest of ``dedup_substrings``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and n_repeated, the bytes under repeated
    strings of SHORTER bytes, about forty words: passages of fifty words are often shorter than LENGTH."""
    rows = dedup_substrings(docs, shorter=(SHORTER, SHORTER_GRAM))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_repeated")
