"""Words and windows of words as arrays of 64-bit hashes, many documents at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Documents are joined up to about so many bytes; one longer document is a segment of its own.
SEGMENT_BYTES = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEP = 0xD1342543DE82EF95
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            factors = np.full(max(n, SEGMENT_BYTES + 1), base, np.uint64)
            factors[0] = 1
            _powers[k] = np.multiply.accumulate(factors)
    return _powers[0], _powers[1]


def runs(ordered: np.ndarray) -> np.ndarray:
    """Where the runs of equal values of a sorted array begin."""
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return np.flatnonzero(new)


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and how often each occurs: one plain sort, much faster than np.unique on large arrays."""
    ordered = np.sort(keys)
    run = runs(ordered)
    return ordered[run], np.diff(np.r_[run, len(ordered)])


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, sorted, the order that sorts the keys, and how often each distinct one occurs."""
    order = np.argsort(keys)
    ordered = keys[order]
    run = runs(ordered)
    return ordered[run], order, np.diff(np.r_[run, len(ordered)])


def spread(values: np.ndarray, order: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each key the value of its distinct key, by ``numbered``."""
    out = np.empty(len(order), values.dtype)
    out[order] = np.repeat(values, counts)
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def byte_sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums of byte * base**position, from which the hash of any stretch follows."""
    up, _ = _tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return sums


def token_sums(hashes: np.ndarray) -> np.ndarray:
    """The same of tokens, given by hashes."""
    up, _ = _tables(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return sums


def stretch_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = _tables(len(sums))
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def segments(texts: list[bytes]) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """(first, last+1, joined, start of each document) of stretches of documents, each ended by a space."""
    first, size = 0, 0
    for i, x in enumerate(texts):
        if i > first and size + len(x) > SEGMENT_BYTES:
            yield _segment(texts, first, i)
            first, size = i, 0
        size += len(x) + 1
    if first < len(texts):
        yield _segment(texts, first, len(texts))


def _segment(texts: list[bytes], first: int, last: int) -> tuple[int, int, bytes, np.ndarray]:
    own = texts[first:last]
    starts = np.cumsum([0, *(len(x) + 1 for x in own)])
    return first, last, b" ".join((*own, b"")), starts


def words(joined: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end, hash) of every word; offsets [documents + 1] of each document's words among them."""
    data = np.frombuffer(joined, np.uint8)
    inside = ~_SPACE[data]
    turn = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    begin, end = turn[::2], turn[1::2]
    return begin, end, stretch_hashes(byte_sums(data), begin, end), np.searchsorted(begin, starts)


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k consecutive words, also across documents; at i, of words i to i+k-1."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += hashes[j : j + n] * np.uint64(pow(_STEP, j, 1 << 64))
    return mixed(out)


def within(offsets: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of the ``n`` window starts lie, with their window, in one document."""
    ok = np.zeros(n + 1, np.int64)
    count = np.maximum(0, np.diff(offsets) - k + 1)
    some = count > 0
    np.add.at(ok, offsets[:-1][some], 1)
    np.add.at(ok, (offsets[:-1] + count)[some], -1)
    return np.cumsum(ok)[:n] > 0
