"""Media, mixing, token archives and the pipeline."""

import hashlib
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from cadenza.llm import common, media, mixing, tokens


def test_png_round_trip(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    docs = docs.unionAll(spark.createDataFrame([(9001, None), (9002, ""), (None, "é" * 96), (9003, "x" * 193)], docs.schema))
    texts = sorted((str(r.doc_id), r.text or "") for r in docs.collect())
    found = {str(r.doc_id): r for r in media.features(media.encode(docs)).collect()}
    assert len(found) == len(texts)
    for i, t in texts:
        raw = t.encode()
        full = raw + b" " * (192 if not raw else -len(raw) % 192)
        r = found[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))
    assert found["9001"].feature == found["9002"].feature
    assert media.features(media.encode(docs.limit(0))).count() == 0


def test_all_filters_and_damage():
    rng = np.random.default_rng(0)
    rows = rng.integers(0, 256, (10, 12), np.uint8)
    for step in (1, 3):
        stored = np.zeros((10, 13), np.uint8)
        for y in range(10):
            kind = y % 5
            stored[y, 0] = kind
            for x in range(12):
                left = int(rows[y, x - step]) if x >= step else 0
                up = int(rows[y - 1, x]) if y else 0
                corner = int(rows[y - 1, x - step]) if y and x >= step else 0
                p = left + up - corner
                nearest = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
                guess = (0, left, up, (left + up) // 2, nearest)[kind]
                stored[y, 1 + x] = (int(rows[y, x]) - guess) % 256
        assert (media._unfilter(stored[:, 0], stored[:, 1:], step) == rows).all()
    image = media.encode_png(bytes(range(192)) * 3)
    assert media.decode_png(image).tobytes() == bytes(range(192)) * 3
    with pytest.raises(ValueError):
        media.decode_png(image[:60] + bytes([image[60] ^ 1]) + image[61:])


def test_mix(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    extra = spark.createDataFrame([(9001, None, "x", None, 0), (9002, "a b c", "x", None, 0), (9002, "a b c", "x", None, 0), (None, "d e", "x", "zz", 0), (9003, "", "x", "empty", 0)], docs.schema)
    every = docs.unionAll(extra).cache()
    found = mixing.mix_report(every).toPandas()
    con = duckdb.connect()
    con.register("documents", every.toArrow())
    expected = con.sql(mixing.ORACLE).df()[list(found.columns)]
    key = ["doc_id", "size", "target"]
    a, b = (x.sort_values(key).reset_index(drop=True) for x in (found, expected))
    assert np.array_equal(a.astype(float).fillna(-1).to_numpy(), b.astype(float).fillna(-1).to_numpy())
    assert (found.taken <= 3 * found["size"]).all()
    goals = found.assign(s=found.target).groupby("target").agg(taken=("taken", "sum"), target=("target", "first"))
    assert found["size"].sum() == pytest.approx(sum({(r.source_size, r.target): r.target for r in found.itertuples()}.values()), rel=0.2)
    assert len(goals)
    clashing = every.selectExpr("*", "1 AS size", "2 AS hash", "'s' AS source_key", "3 AS copies", "4 AS threshold")
    mixed = mixing.mix(clashing)
    assert mixed.columns == clashing.columns
    assert mixed.count() == found.copies.sum()
    assert mixing.mix_report(docs.limit(0)).count() == 0


def test_takes_are_nested(spark, data):
    sized = mixing.sizes(spark.read.parquet(f"{data}/documents.parquet")).cache()
    goals = mixing.targets(sized)
    before = set()
    for share in (0.1, 0.35, 0.8, 1.3):
        limits = mixing.thresholds(sized, goals.withColumn("target", share * goals.target), fill=False)
        rows = sized.join(limits, "source_key").withColumn("copies", mixing.times_taken()).collect()
        taken = {(r.doc_id, k) for r in rows for k in range(r.copies)}
        assert before < taken
        before = taken
        for key in {r.source_key for r in rows}:
            own = [r for r in rows if r.source_key == key]
            gap = own[0].target - sum(r.copies * r["size"] for r in own)
            assert 0 <= gap + 1e-6 and (gap < max(r["size"] for r in own) or min(r.copies for r in own) == 3)


def test_targets_are_filled(spark):
    docs = spark.createDataFrame([(i, "w " * n, s) for i, (n, s) in enumerate([(10, "a"), (500, "b"), (500, "c"), (7, None)])], "doc_id long, text string, source string")
    got = {r.source_key: r.target for r in mixing.targets(mixing.sizes(docs)).collect()}
    # a stops at 30, null at 21; b and c share the rest 2 to 1.
    assert got["=a"] == 30 and got[""] == 21
    assert got["=b"] == pytest.approx((1017 - 51) * 2 / 3) and got["=c"] == pytest.approx((1017 - 51) / 3)


def test_join_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    big = spark.range(100).selectExpr("id", "id % 3 AS k")
    small = spark.range(3).selectExpr("id AS k", "id * 10 AS v")
    assert sorted((r.id, r.v) for r in common.join_small(big, small, "k").collect()) == [(i, i % 3 * 10) for i in range(100)]


def test_repeated_rows_are_not_broadcast(spark, monkeypatch):
    """Beyond the bound the salted rows are many times those that Spark expects."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    big, small = spark.range(100).selectExpr("id", "id % 3 AS k"), spark.range(2).selectExpr("id AS k")
    for how, left in (("left_anti", 33), ("left_semi", 67), ("inner", 67), ("left", 100)):
        joined = common.join_small(big, small, "k", how)
        assert joined.count() == left and "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()


ODD = ["It's he'LL  ’s naïve ＡＢＣ ΣΑΣ <|endoftext|> x<|startoftext|>y²³ 1234 a b\u0085c\x1cd İ ǅ é 한글 하 don't'rest \x7f zero​w \xad", "", "  ", "ß ẞ ŉ ɐ Ⱥ", "\x00\x01 nul"]


def test_token_archives(spark, data):
    path = tokens.public_tokenizer("word_bpe_49k.json")
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.unionAll(spark.createDataFrame([(9000 + i, t, "") for i, t in enumerate(ODD)] + [(None, None, ""), (-3, "a b", None), (-3, "a b", None)], docs.schema)).cache()
    own = tokens.encoder(path).tokenizer
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in docs.collect()))
    start, expected = 0, []
    for known, i, t in rows:
        ids = np.array(own.encode(t, add_special_tokens=False).ids + [1], "<u4")
        expected.append((i if known else None, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    archives = tokens.write_archives(docs, path, partitions=3)
    found = sorted(map(tuple, tokens.token_index(archives).collect()), key=lambda r: r[1])
    assert found == expected
    some = tokens.read_archives(archives, [5, 9001]).collect()
    assert sorted(r.doc_id for r in some) == [5, 9001]
    assert tokens.token_index(tokens.write_archives(docs.limit(0), path)).count() == 0


def test_words_have_the_ids_of_whole_texts():
    own = tokens.WordEncoder(tokens.public_tokenizer("word_bpe_49k.json"), remembered=500)
    rng = np.random.default_rng(4)
    texts = ["".join(map(chr, rng.integers(0, 0x370, n))) for n in rng.integers(1, 12, 4000)]
    letters = [*range(65, 91), *range(97, 123), *range(0x300, 0x370), *range(0x370, 0x400), *range(0x1100, 0x1113), *range(0x1161, 0x1176), *range(0x1E00, 0x1F00), *map(ord, " .,'-")]
    texts += ["".join(map(chr, rng.choice(letters, n))) for n in rng.integers(1, 12, 12000)]
    texts += [chr(c) + chr(m) + end for c in range(65, 91) for m in range(0x300, 0x370) for end in ("", ".", "x,")] + ["J\u030c H\u0331 T\u0308 W\u030a Y\u030a"]
    texts += ["\x7féa", "a\x85é", "<|STARTOFTEXT|>. It's A.B, DON'T! a\u0301. É\u0327. x²? ĳ; ", "I\u0307. K\u0301!", "é" * 5000 + " \u0301b"]
    wanted = [np.array(own.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert list(map(own.encode, texts)) == wanted


def test_archive_is_plain_zstandard_and_checked():
    import io

    import zstandard

    ids = [np.arange(n, dtype="<u4").tobytes() for n in (3, 20_000, 0, 5)]
    image = tokens.pack_archive([1, None, 3, 4], ids)
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(image), read_across_frames=True).read() == b"".join(ids)
    assert [(d, x) for _, d, _, x in tokens.read_documents(image, {3, 4})] == [(3, ids[2]), (4, ids[3])]
    broken = bytearray(image)
    broken[-13] ^= 1
    with pytest.raises(ValueError):
        list(tokens.read_documents(bytes(broken)))


def test_pipeline(spark, data):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows, before = docs, docs.count()
    for name, stage in p.STAGES[:-1]:
        rows = stage(spark, rows, data)
        assert rows.columns == docs.columns, name
        if name != "mixing":
            after = rows.count()
            assert 0 < after <= before, name
            before = after
    assert p.run(spark, data).count() == rows.count()
    empty = docs.limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, empty, data).count() == 0


def test_the_pipeline_bounds_what_workers_remember(spark, monkeypatch):
    import corpus_pipeline

    monkeypatch.setattr(corpus_pipeline, "REMEMBERED", 40)
    docs = spark.range(600).selectExpr("id AS doc_id", "concat('w', id * 7919, ' ', sha2(string(id), 256), ' q', id) AS text")
    whole = tokens.token_index(tokens.write_archives(docs, path := tokens.public_tokenizer("word_bpe_49k.json")))
    assert sorted(corpus_pipeline.token_archives(spark, docs, "").collect()) == sorted(whole.collect())

    def held(batches):
        for batch in batches:
            own = tokens._ENCODERS.get((path, 40))
            yield pa.RecordBatch.from_arrays([pa.array([len(own) + len(own.older) if own else 0] * len(batch))], names=["n"])

    most = max(r.n for r in spark.range(0, 40, 1, 8).mapInArrow(held, "n long").collect())
    assert 0 < most <= 2 * (40 + 6)
