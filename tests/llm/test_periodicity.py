"""Periodic runs against brute force."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from cadenza.llm import periodicity


def brute_runs(words):
    found = []
    n = len(words)
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            smaller = any(all(words[k] == words[k + d] for k in range(i, i + length - d)) for d in range(1, q))
            if length >= max(24, 3 * q) and not smaller:
                found.append((i, length, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    digest = hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
    numbers = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *numbers, digest, hashlib.sha256(kept.encode()).hexdigest())


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def plain(rows):
    return sorted(map(tuple, rows), key=lambda r: (str(r[0]), str(r[6:])))


def test_transform_inverts():
    rng = np.random.default_rng(0)
    for size in (2, 32, 256):
        rows = rng.integers(0, periodicity.PRIME, (3, size)).astype(np.uint64)
        assert (periodicity.restored(periodicity.transform(rows.copy())) == rows).all()


def test_squared_differences():
    rng = np.random.default_rng(1)
    for width, count in ((8, 15), (16, 16), (64, 64)):
        blocks, windows = rng.integers(0, 2**20, (5, width)), rng.integers(0, 2**20, (5, count + width - 1))
        expected = [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, w[q : q + width])) % periodicity.PRIME for q in range(count)] for x, w in zip(blocks, windows)]
        assert periodicity.squared_differences(blocks.astype(np.uint64), windows.astype(np.uint64)).tolist() == expected


@pytest.mark.parametrize("letters", [1, 2, 3, 40])
def test_runs_of_random_words(letters):
    rng = random.Random(letters)
    texts = []
    for _ in range(60):
        words = []
        while len(words) < 260:
            part = [f"w{rng.randrange(letters)}" for _ in range(rng.randrange(1, 40))]
            words += part * rng.choice([1, 1, 2, 3, 4, 9]) + part[: rng.randrange(len(part) + 1)]
        texts.append(words[: rng.randrange(20, 260)])
    made = list(periodicity._documents([" ".join(t).encode() for t in texts], 24, 3))
    assert [m[1] for m in made] == [brute_runs(t) for t in texts]


def test_report(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    short = [(r.doc_id, r.text) for r in docs.collect() if len(r.text or "") < 4000]
    a = "x y z ü "
    rows = [*short, (9001, None), (9002, ""), (None, "a " * 30), (9003, a * 8), (9003, a * 8), (9004, "a b " * 12), (9005, "a b " * 11 + "a"), (9006, "q" + " \t" + a * 6 + "\x0b end"), (9007, (a * 7 + "s ") * 3), (9008, "\x1c\x85 " * 30)]
    table = spark.createDataFrame([(i, t, 1, "r") for i, t in rows], "doc_id long, text string, start int, runs string")
    found = periodicity.run_report(periodicity.planted(table))
    assert plain(found.select(*COLUMNS).collect()) == plain(brute_row(i, t) for i, t in rows)
    assert periodicity.run_report(table.limit(0)).count() == 0


def test_spans_and_texts(spark):
    rows = [(1, "s " + "a b c " * 9 + "e"), (2, "a b")]
    found = {r.doc_id: r for r in periodicity.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(x) for x in found[1].runs] == [(1, 27, 3)] and found[1].collapsed == "s a b c e"
    assert found[2].runs == [] and found[2].collapsed == "a b"


def test_long_texts(spark):
    """Texts of over 1 MB: a log of one line, a period of a third of the text, and words that are all different."""
    rng = random.Random(5)
    part = [f"n{rng.randrange(10**6)}" for _ in range(60_000)]
    rows = [(1, "error in block seven " * 60_000), (2, " ".join(part * 3 + part[:100])), (3, " ".join(f"u{i}" for i in range(200_000)))]
    assert min(len(t) for _, t in rows) > 1_000_000
    found = {r.doc_id: r for r in periodicity.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(x) for x in found[1].runs] == [(0, 240_000, 4)] and found[1].collapsed == "error in block seven"
    assert [tuple(x) for x in found[2].runs] == [(0, 180_100, 60_000)] and found[2].collapsed == " ".join(part)
    assert found[3].runs == []
