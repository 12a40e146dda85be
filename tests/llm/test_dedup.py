"""Windows, substrings and SimHash against brute force, edge cases among real documents."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from cadenza.llm import components, exchange, overlap, simhash, substring_dedup, window_dedup

SCHEMA = "doc_id long, text string, lang string, chunk int, block int"


@pytest.fixture(scope="module")
def documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    a, b, c = (r.text for r in docs.where("length(text) > 3000").orderBy("doc_id").limit(3).collect())
    rng = random.Random(1)
    rows = [(100000, None), (100001, ""), (100002, "a" * 3000), (100003, "ab" * 500 + "x"), (None, a[:2000]), (None, a[:2000]), (-5, b[500:1100] + "é" + c[100:900]), (7, b[400:1000])]
    rows += [(100004, "zq" + b[501:899]), (100005, "zq" + b[501:902]), (100006, c[:450]), (100007, "q" * 10 + c[30:450] + "w" * 5), (100008, a[100:700] * 2), (100009, "a " * 40), (100010, "a " * 12), (100011, "\x0b\t\n ")]
    for i in range(30):
        at = rng.randrange(2000)
        rows.append((200000 + i, a[at : at + rng.randrange(300, 900)] + "".join(rng.choices("abc ", k=50)) + c[at : at + rng.randrange(300, 700)]))
    extra = spark.createDataFrame([(i, t, None, 1, 2) for i, t in rows], SCHEMA)
    return docs.selectExpr("doc_id", "text", "'x' AS lang", "1 AS chunk", "2 AS block").unionAll(extra).cache()


@pytest.fixture
def small_chunks(monkeypatch):
    for module in (substring_dedup, window_dedup):
        monkeypatch.setattr(module, "Corpus", lambda d: exchange.Corpus(d, 60_000))


def plain(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (str(r[0]), *map(str, r[1:])))


@pytest.mark.parametrize("hot, stretch", [(4000, 1 << 19), (2, 700)])
def test_substrings(documents, small_chunks, monkeypatch, hot, stretch):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    monkeypatch.setattr(substring_dedup, "STRETCH", stretch)
    rows = [(r.doc_id, (r.text or "").encode()) for r in documents.collect()]
    seen = {n: Counter(t[p : p + n] for _, t in rows for p in range(len(t) - n + 1)) for n in (256, 400)}
    expected = []

    def covered(t, n):
        out = bytearray(len(t))
        for p in range(len(t) - n + 1):
            if seen[n][t[p : p + n]] > 1:
                out[p : p + n] = b"\1" * n
        return out

    for i, t in rows:
        gone = covered(t, 400)
        runs = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        expected.append((i, len(t), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(t, gone) if not g)).hexdigest(), sum(covered(t, 256))))
    assert plain(substring_dedup.substring_report(documents).collect()) == plain(expected)


def test_suffix_order():
    rng = np.random.default_rng(8)
    for length in (9, 24, 40, 400):
        text = np.tile(rng.integers(0, 3, 700).astype(np.uint8), 2)
        at = np.sort(rng.choice(len(text) - length, 300, replace=False))
        order, same = substring_dedup.suffix_order(text, at, length)
        made = [text[i : i + length].tobytes() for i in at[order].tolist()]
        assert made == sorted(made)
        assert same.tolist() == [False] + [a == b for a, b in zip(made, made[1:])]


def test_union():
    begin, end = np.array([1, 2, 9, 12, 30]), np.array([4, 9, 11, 13, 31])
    assert substring_dedup.union(begin, end) == [(1, 11), (12, 13), (30, 31)]
    assert substring_dedup.union(begin[:0], end[:0]) == []


def test_windows(documents, small_chunks):
    rows = [(r.doc_id, (r.text or "").encode().split()) for r in documents.collect()]
    order = lambda d: (d is None, d or 0)
    first = {}
    for i, w in rows:
        for p in range(len(w) - 12):
            key = tuple(w[p : p + 13])
            first[key] = min(first.get(key, order(i)), order(i))
    expected = []
    for i, w in rows:
        gone = [False] * len(w)
        for p in range(len(w) - 12):
            if first[tuple(w[p : p + 13])] < order(i):
                gone[p : p + 13] = [True] * 13
        expected.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    assert plain(window_dedup.window_report(documents).collect()) == plain(expected)


def brute_components(prints):
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j][1]).bit_count() <= 3:
                parent[root(i)] = root(j)
    groups = {}
    for i, (d, _) in enumerate(prints):
        groups.setdefault(root(i), []).append(d)
    return sorted((d, f"{p:016x}", min((x for x in groups[root(i)] if x is not None), default=None)) for i, (d, p) in enumerate(prints) if d is not None)


def naive_print(text):
    import xxhash

    w = (text or "").encode().lower().split()
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("cell", [256, 2])
def test_simhash(documents, monkeypatch, cell):
    monkeypatch.setattr(simhash, "CELL", cell)
    monkeypatch.setattr(components, "AT_ONCE", 20_000 if cell == 256 else 0)
    prints = [(r.doc_id, naive_print(r.text)) for r in documents.collect()]
    found = simhash.near_duplicates(documents).where("doc_id IS NOT NULL").collect()
    assert sorted(map(tuple, found)) == brute_components(prints)


def naive_near(rows, order):
    """Pairs of places of near-duplicates among (doc_id, text), all pairs compared."""
    made = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        runs = [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []
        hashes = next(iter(overlap.shingles([text or ""], 5)))
        assert len(hashes) == len(runs)
        bits = sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in hashes) > len(runs))
        first = overlap.prefix(np.unique(hashes), 0.8, *order)
        made.append((bits, set(runs), set(first.tolist())))
    for i, (a, x, p) in enumerate(made):
        for j, (b, y, q) in enumerate(made[:i]):
            apart, both = (a ^ b).bit_count(), len(x & y)
            if apart <= 3 or x and y and 10 * both >= 8 * (len(x) + len(y) - both) or apart <= 12 and p & q:
                yield i, j


@pytest.mark.parametrize("block", [2048, 3])
def test_one_of_each(spark, documents, monkeypatch, block):
    monkeypatch.setattr(overlap, "LIST_BLOCK", block)
    monkeypatch.setattr(simhash, "CELL", block)
    docs = documents.selectExpr("doc_id", "text", "doc_id % 7 AS _h", "'t' AS _text", "chunk AS root", "'r' AS _row")
    rows = sorted({(r.doc_id is None, r.doc_id or 0, r.text or "") for r in docs.collect()})
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keyed = docs.selectExpr("coalesce(text, '') AS _text", "xxhash64(coalesce(text, '')) AS _h")
    for i, j in naive_near([(d, t) for _, d, t in rows], overlap.frequent_shingles(keyed, 5)):
        parent[root(i)] = root(j)
    groups = {}
    for i, (unknown, d, _) in enumerate(rows):
        groups.setdefault(root(i), []).append((unknown, d))
    wanted = sorted(min(g) for g in groups.values())
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    rows_kept = kept.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows_kept) == wanted
    assert all(r._text == "t" and r._row == "r" and r._h == (None if r.doc_id is None else int(math.fmod(r.doc_id, 7))) for r in rows_kept)
    assert len(wanted) < len(rows)


def test_edited_copies_go(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 9))) for _ in range(900)]
    docs = []
    for i in range(40):
        text = rng.choices(words, k=240)
        docs.append((3 * i, " ".join(text)))
        edited = list(text)
        for at in rng.sample(range(240), 2):
            edited[at] = "edit" + str(at)
        docs.append((3 * i + 1, " ".join(edited)))
    kept = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {3 * i for i in range(40)} <= kept
    assert sum(3 * i + 1 not in kept for i in range(40)) >= 36


def test_parities_never_exclude(spark):
    rng = np.random.default_rng(6)
    rows, similar = [], []
    for n in rng.integers(1, 700, 150).tolist():
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        b = np.r_[a[: n - int(n * rng.random() * 0.25)], rng.integers(0, 1 << 63, int(n * rng.random() * 0.2)).astype(np.uint64)]
        a, b = np.unique(a), np.unique(b)
        both = len(np.intersect1d(a, b))
        similar.append(10 * both >= 8 * (len(a) + len(b) - both))
        rows.append((len(a), len(b), overlap.parities(a).tolist(), overlap.parities(b).tolist(), *overlap.short_parities(a).tolist(), *overlap.short_parities(b).tolist()))
    shorts = ", ".join(f"q{i}_{k} long" for k in "uv" for i in range(4))
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, size_u int, size_v int, odd_u array<long>, odd_v array<long>, {shorts}")
    passed = {r.i for r in table.where(overlap.possible(0.8)).collect()}
    assert {i for i, x in enumerate(similar) if x} <= passed and 20 < sum(similar)
    assert len(passed) < sum(similar) + 60
    assert {i for i, x in enumerate(similar) if x} <= {r.i for r in table.where(overlap.likely(0.8)).collect()}


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    for made in (substring_dedup.substring_report, window_dedup.window_report, simhash.near_duplicates, simhash.one_of_each):
        assert made(none).count() == 0


def test_sketch_never_undercounts():
    rng = np.random.default_rng(3)
    chunks = [rng.integers(0, 400, 300).astype(np.uint64) for _ in range(5)]
    hashes = [window_dedup.mixed(c) for c in chunks]
    asked = {}
    for n, h in enumerate(hashes):
        for block, data in window_dedup.sketch(h, 12, 4):
            asked.setdefault(block, []).append((n, data))
    answers = [{} for _ in chunks]
    for block, rows in asked.items():
        for (n, _), reply in zip(rows, window_dedup.merge_sketches([d for _, d in rows])):
            answers[n][block] = reply
    total = Counter(x for h in hashes for x in h.tolist())
    for h, a in zip(hashes, answers):
        over = window_dedup.estimated_repeated(h, a, 12, 4)
        assert all(o for x, o in zip(h.tolist(), over.tolist()) if total[x] > 1)


def test_all_pairs_of_high_overlap_go(spark, monkeypatch):
    monkeypatch.setattr(overlap, "LIST_BLOCK", 4)
    monkeypatch.setattr(overlap, "FREQUENT", 2)
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 9))) for _ in range(3000)]
    docs = []
    for i in range(60):
        text = rng.choices(words, k=rng.randrange(60, 900))
        edited, n = list(text), len(text)
        if i % 4 == 0:
            edited = text[: n * rng.randrange(82, 96) // 100]
        elif i % 4 == 1:
            edited = text + rng.choices(words, k=n * rng.randrange(4, 20) // 100)
        elif i % 4 == 2:
            for at in rng.sample(range(n), n // 50):
                edited[at] = "edit" + str(at)
        else:
            edited = text[n // 2 :] + text[: n // 2]
        docs += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(edited))]
    docs += [(1000 + i, docs[0][1] + f" end {i}") for i in range(50)]
    sets = {d: set(zip(*[t.split()[k:] for k in range(5)])) for d, t in docs}
    over = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    assert sum(a < 1000 and b == a + 1 for a, b in over) > 40
    kept = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert not [p for p in over if kept.issuperset(p)]
    order = overlap.frequent_shingles(spark.createDataFrame([(t,) for _, t in docs], "_text string").selectExpr("_text", "xxhash64(_text) AS _h"), 5)
    near = {docs[x][0] for p in naive_near(docs, order) for x in p}
    assert all(d in kept for d, _ in docs if d not in near)


@pytest.mark.parametrize("groups", [4, 7, 9])
def test_any_number_of_groups_links_the_same(spark, groups):
    rng = np.random.default_rng(5)
    values = rng.integers(0, 2**63, 60).tolist()
    for v in values[:30]:
        flips = rng.choice(63, int(rng.integers(1, 6)), replace=False).tolist()
        values.append(v ^ sum(1 << int(b) for b in flips))
    found = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long").distinct(), 3, groups).collect()
    near = {(a, b) for a in values for b in values if a > b and (a ^ b).bit_count() <= 3}
    assert {(max(r.u, r.v), min(r.u, r.v)) for r in found} == near and simhash.groups_for(10**9 + 1) == 7


def test_gathered_buckets(documents, monkeypatch):
    expected = plain(window_dedup.window_report(documents).collect())
    monkeypatch.setattr(window_dedup, "Corpus", lambda d: exchange.Corpus(d, 60_000))
    monkeypatch.setattr(exchange, "FINE_BUCKETS", 1)
    monkeypatch.setattr(exchange, "BUCKET_BYTES", 200_000)
    assert plain(window_dedup.window_report(documents).collect()) == expected


def test_components_of_chains_and_stars(spark, monkeypatch):
    rng = np.random.default_rng(1)
    pairs = [(i, i + 1) for i in range(300)] + [(1000, int(x)) for x in rng.integers(1001, 1100, 90)] + rng.integers(2000, 2150, (100, 2)).tolist() + [(7, 7), (5000, 5000)]
    root = {n: n for p in pairs for n in p}
    for _ in range(400):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    expected = {n: r for n, r in root.items() if n != 5000}
    frame = spark.createDataFrame([(int(a), int(b)) for a, b in pairs], "u long, v long")
    for most in (20_000, 0, 150):
        monkeypatch.setattr(components, "AT_ONCE", most)
        assert {r.node: r.root for r in components.components(frame).collect()} == expected
    assert components.components(frame.limit(0)).count() == 0


def test_frequent_shingles_are_counted_over_all_documents(spark):
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(9)]
    texts = [" ".join(rng.choices(words, k=rng.randrange(0, 12))) for _ in range(9000)] + ["one text of many copies " * 3] * 200
    docs = spark.createDataFrame([(t,) for t in texts], "_text string").selectExpr("_text", "xxhash64(_text) AS _h")
    seen = Counter(x for own in overlap.shingles(texts, 5) for x in np.unique(own).view(np.int64).tolist())
    wanted = sorted((x for x, n in seen.items() if n >= 10), key=lambda x: (-seen[x], x))
    tokens, places = overlap.frequent_shingles(docs, 5)
    assert len(wanted) > 9 and tokens.tolist() == sorted(tokens.tolist())
    assert tokens[np.argsort(-places)].view(np.int64).tolist() == wanted


def test_low_shingles_are_frequent_in_a_fixed_number_of_documents(spark, monkeypatch):
    monkeypatch.setattr(overlap, "FREQUENT", 50)  # as in a large corpus, of which a share is many documents
    rng = random.Random(21)
    passage = " ".join(f"p{i}" for i in range(200))
    texts = [" ".join(f"w{rng.randrange(10**9)}" for _ in range(60)) + " " + passage for _ in range(12)]
    docs = spark.createDataFrame([(t,) for t in texts], "_text string").selectExpr("_text", "xxhash64(_text) AS _h")
    seen = Counter(x for own in overlap.shingles(texts, 5) for x in np.unique(own).tolist())
    tokens, _ = overlap.frequent_shingles(docs, 5)
    assert tokens.tolist() == sorted(x for x, n in seen.items() if n >= 10 and x < 1 << 63) and len(tokens) > 50


def test_first_shared_shingles_of_similar_sets_fit(spark):
    rng = np.random.default_rng(17)
    rows, similar = [], []
    for n in rng.integers(1, 300, 200).tolist():
        a = rng.integers(0, 1 << 63, n)
        b = np.r_[a[: n - int(n * rng.random() * 0.25)], rng.integers(0, 1 << 63, int(n * rng.random() * 0.2))]
        a, b = np.unique(a), np.unique(b)
        both = np.intersect1d(a, b)
        similar.append(10 * len(both) >= 8 * (len(a) + len(b) - len(both)))
        rows.append((len(rows), len(a), len(b), int(np.searchsorted(a, both[0])), int(np.searchsorted(b, both[0]))))
    table = spark.createDataFrame(rows, "i int, size_u int, size_v int, pos_u int, pos_v int")
    passed = {r.i for r in table.where(overlap.fits(0.8)).collect()}
    assert {i for i, x in enumerate(similar) if x} <= passed and 20 < sum(similar)
    late = spark.createDataFrame([(0, 100, 100, 12, 0), (1, 100, 100, 11, 11), (2, 100, 80, 20, 0)], table.schema)
    assert {r.i for r in late.where(overlap.fits(0.8)).collect()} == {1, 2}
