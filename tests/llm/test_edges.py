"""Every operator and stage on texts of over 1 MB, copies of parts of them, null and empty texts, null ids and clashing columns."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from cadenza.llm import context_tree, decontaminate, media, mixing, quality, secrets, simhash, substring_dedup, tokens, window_dedup

RNG = random.Random(11)
LONG = " ".join("".join(RNG.choices("abcdefghij", k=RNG.randint(2, 9))) for _ in range(190_000))
HALF = LONG[len(LONG) // 2 :]
ITEM = "these words of an item stand in one long text and nowhere else at all"
ROWS = [(1, LONG + " " + ITEM, "a"), (2, HALF, "b"), (3, None, "a"), (4, "", None), (None, "short text without an id", "b"), (5, "short text without an id", "b"), (5, "short text without an id", "b"), (6, "x", "a")]
CLASHING = {"_row": 1, "key": 2, "_h": 3, "h": 4, "hash": 5, "size": 6, "chunk": 7, "block": 8, "score": 9, "copies": 10, "fp": 11, "root": 12, "label": 13, "_text": 14, "item": 15}


@pytest.fixture(scope="module")
def docs(spark):
    table = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    assert len(LONG) > 1_000_000
    return table.selectExpr("*", "'en' AS lang", "1 AS n_chars", *[f"{v} AS `{c}`" for c, v in CLASHING.items()]).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 0), (6, 0, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")


def ids(df, column="doc_id"):
    return sorted(str(r[column]) for r in df.collect())


ALL = sorted(str(i) for i, _, _ in ROWS)


def test_quality(docs, labels):
    found = quality.score_documents(docs, labels).collect()
    assert sorted(str(r.doc_id) for r in found) == ALL and all(0 <= r.score <= 1 for r in found)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns


def test_media(docs):
    found = {str(r.doc_id): r for r in media.features(media.encode(docs)).collect()}
    assert found["1"].n_bytes == len(ROWS[0][1]) and found["1"].payload_bytes % 192 == 0
    samples = np.frombuffer(media.payload(ROWS[0][1])[0], np.uint8).reshape(-1, 192, 1)
    assert found["1"].feature == media.cosine_hash(samples).hex() == bytes(found["1"].cosine_hash).hex()


def test_cosine_hash_and_media_digest_naively(docs):
    """Means, cosines and the median by plain sums; the digests are of the stored image."""
    stored = {str(r.doc_id): bytes(r.media) for r in media.encode(docs.where("doc_id IN (2, 6)")).collect()}
    for r in media.features(media.encode(docs.where("doc_id IN (2, 6)"))).collect():
        image = stored[str(r.doc_id)]
        assert (r.media_bytes, r.media_sha256) == (len(image), hashlib.sha256(image).hexdigest())
    rng = np.random.default_rng(0)
    for height in (1, 5, 32, 70):
        grey = rng.integers(0, 256, (height, 192)).astype(float)
        fine = np.repeat(np.repeat(grey, 32, axis=0), 1, axis=1)  # each row 32 times: any 32nd of the height is whole rows
        small = [[fine[i * height : (i + 1) * height, j * 6 : (j + 1) * 6].mean() for j in range(32)] for i in range(32)]
        low = [sum(small[y][x] * math.cos(math.pi * v * (2 * y + 1) / 64) * math.cos(math.pi * u * (2 * x + 1) / 64) for y in range(32) for x in range(32)) for v in range(8) for u in range(8)]
        low = np.round(low, 6)
        bits = "".join("1" if c > np.median(low[1:]) else "0" for c in low)
        assert media.cosine_hash(grey[:, :, None].astype(np.uint8)).hex() == f"{int(bits, 2):016x}"


def test_mixing(docs):
    found = mixing.mix_report(docs).collect()
    assert sorted(str(r.doc_id) for r in found) == ALL and {r["size"] for r in found if r.doc_id == 2} == {len(HALF.split())}
    assert mixing.mix(docs).columns == docs.columns


def test_substrings_and_windows(docs):
    found = {str(r.doc_id): r for r in substring_dedup.substring_report(docs).collect()}
    assert found["2"].n_removed == len(HALF) and found["1"].n_removed >= len(HALF) and found["1"].n_spans == 1 and found["3"].n_removed == 0
    windows = {str(r.doc_id): r for r in window_dedup.window_report(docs).collect()}
    assert windows["1"].n_removed == 0 and windows["2"].n_removed >= len(HALF.split()) - 1
    assert sorted(found) == sorted(windows) == sorted(set(ALL))


def test_secrets(docs):
    found = secrets.secret_report(docs).collect()
    assert sorted(str(r.doc_id) for r in found) == ALL and {r.base_sha256 for r in found} == {hashlib.sha256(b"").hexdigest()}


def test_scores(docs):
    found = context_tree.score(docs).collect()
    assert sorted(str(r.doc_id) for r in found) == ALL and all(r.score <= 0 and math.isfinite(r.score) for r in found)
    assert next(r.n_tokens for r in found if r.doc_id == 2) == len(HALF.split()) + 1


def test_fingerprints(docs):
    found = simhash.near_duplicates(docs).collect()
    assert sorted(str(r.doc_id) for r in found) == ALL and {r.component_id for r in found if r.doc_id in (3, 4)} == {3}


def test_archives(docs):
    path = tokens.public_tokenizer("word_bpe_49k.json")
    found = {str(r.doc_id): r for r in tokens.token_index(tokens.write_archives(docs, path)).collect()}
    own = np.array(tokens.encoder(path).tokenizer.encode(HALF, add_special_tokens=False).ids + [1], "<u4")
    assert (found["2"].n_tokens, found["2"].ids_crc32) == (len(own), zlib.crc32(own.tobytes()))


def test_tiles(spark, docs):
    items = spark.createDataFrame([(9, ITEM), (10, " ".join(ITEM.split()[7:] + ITEM.split()[:7])), (11, "not " * 9)], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()) == [(1, 9), (1, 10)]
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and ids(kept) == sorted(i for i in ALL if i != "1")


def test_stages(spark, docs, labels, tmp_path):
    """All stages in a row on these rows: columns and values of the documents stay until the last."""
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(9, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, now if name != "quality" else docs, str(tmp_path))
        assert made.columns == docs.columns
        now = spark.createDataFrame(made.collect(), made.schema)
        assert all(r[c] == v for r in now.collect() for c, v in CLASHING.items())
    last = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path))
    assert last.count() == now.count()


@pytest.mark.parametrize("column", ["text", "doc_id", "source"])
def test_a_column_of_nulls(spark, docs, labels, column):
    rows = [tuple(None if c == column else v for c, v in zip(("doc_id", "text", "source"), r)) for r in ROWS[2:]]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for make in (mixing.mix_report, substring_dedup.substring_report, window_dedup.window_report, context_tree.score, simhash.near_duplicates, secrets.secret_report, lambda d: quality.score_documents(d, labels)):
        assert make(table).count() == len(rows)
