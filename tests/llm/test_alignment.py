"""Alignment of two tokenizers against brute force over whole texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cadenza.llm import alignment, common

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    whole = Tokenizer.from_file(A)
    whole.encode_special_tokens = True
    return whole, sentencepiece.SentencePieceProcessor(model_file=B)


def brute(rows, libraries):
    """Byte strings of tokens from the libraries' own decoders, ends in sets."""
    whole, model = libraries
    letters = {}
    for b in range(256):
        (entry,) = [e for e in whole.get_vocab() if len(e) == 1 and alignment.byte_level(e) == bytes([b])]
        letters[entry] = b
    made, totals = [], Counter()
    for doc_id, text in rows:
        a, b = (whole.encode(" " + text, add_special_tokens=False).ids, model.encode(text)) if text else ([], [])
        a_bytes = [bytes(letters[c] for c in whole.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [model.id_to_piece(i)]]
        if text and not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
            a = b = a_bytes = b_bytes = []
        ends = [np.cumsum([len(x) for x in own], dtype=int).tolist() for own in (a_bytes, b_bytes)]
        both = sorted(set(ends[0]) & set(ends[1]))
        links = [(a[ends[0].index(e)], b[ends[1].index(e)]) for e in both] if len(both) < 3000 else [(dict(zip(ends[0], a))[e], dict(zip(ends[1], b))[e]) for e in both]
        groups, p, q = [], 0, 0
        for e in both:
            i, j = p, q
            while i < len(a) and ends[0][i] <= e:
                i += 1
            while j < len(b) and ends[1][j] <= e:
                j += 1
            groups.append(",".join(map(str, a[p:i])) + "|" + ",".join(map(str, b[q:j])))
            p, q = i, j
        totals.update(links)
        made.append((doc_id, len(a), len(b), len(groups), links, ";".join(groups)))
    most = Counter()
    for (_, y), n in totals.items():
        most[y] = max(most[y], n)
    for doc_id, n_a, n_b, n_groups, links, groups in made:
        yield (doc_id, n_a, n_b, n_groups, len(links), sum(totals[x] == most[x[1]] for x in links), sum(totals[x] for x in links), hashlib.sha256(groups.encode()).hexdigest() if n_a else "")


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def plain(rows):
    return sorted(map(tuple, rows), key=lambda r: (str(r[0]), str(r)))


@pytest.mark.parametrize("held", [alignment.HELD_PAIRS, 0])
def test_report(spark, data, libraries, monkeypatch, held):
    monkeypatch.setattr(alignment, "HELD_PAIRS", held)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 20_000 if held else 0)
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text) for r in docs if len(r.text or "") < 6000][::2]
    rng = random.Random(3)
    rows += [(9001, None), (9002, ""), (9003, " "), (None, "a b"), (9004, "x▁y"), (9005, "<|endoftext|> </s> <s>"), (9006, "日本語 \U0001f600 é́ \x00 \r\n\t"), (9007, "same"), (9007, "same"), (9008, " leading and  double ")]
    rows += [(9100 + i, "".join(chr(rng.choice([rng.randrange(1, 0x250), rng.randrange(1, 0xD800), rng.randrange(32, 127), 32])) for _ in range(60))) for i in range(40)]
    table = spark.createDataFrame([(i, t, 1, "p") for i, t in rows], "doc_id long, text string, n_a int, pairs string")
    found = alignment.alignment_report(table, A, B)
    assert found.columns == COLUMNS
    assert plain(found.collect()) == plain(brute(rows, libraries))
    assert alignment.alignment_report(table.limit(0), A, B).count() == 0


def test_fast_encoder_equals_the_library(libraries):
    own, rng = alignment.ByteBPE(A), random.Random(4)
    texts = [" " + "".join(rng.choices(letters, k=80)) for letters in ("ab '\n\t 1.", "éÀǅ́  x9", "\x1c\x1d\x85 　 a'", "日本ㄱำ 5ⅷ²", "<|endoftext|> ") for _ in range(300)]
    texts += [" " * 30_000 + "x", "\n" * 25_000, " a" * 30_000, "don't we'll I'M x'S"]
    texts += [f" a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)} !{chr(c)} {chr(c)}" for c in range(0, 0x30000, 7) if not 0xD800 <= c < 0xE000]
    assert own.encode(texts) == [libraries[0].encode(t, add_special_tokens=False).ids for t in texts]


def test_divide_and_conquer_finds_every_cut():
    rng = np.random.default_rng(0)
    for share in (0.02, 0.3, 0.9):
        texts = [(np.unique(rng.integers(1, n + 1, max(1, int(n * share)))), np.unique(rng.integers(1, n + 1, max(1, int(n * share)))), n) for n in (1, 2, 5, 60, 3000)]
        a, b = [np.union1d(x, [n]) for x, _, n in texts], [np.union1d(y, [n]) for _, y, n in texts]
        base = np.cumsum([0, *(n for _, _, n in texts)])
        a_all, b_all = (np.concatenate([x + s for x, s in zip(own, base)]) for own in (a, b))
        i, j = alignment.common_ends(a_all, b_all, np.cumsum([0, *map(len, a)]), np.cumsum([0, *map(len, b)]))
        assert a_all[i].tolist() == np.intersect1d(a_all, b_all).tolist() and (a_all[i] == b_all[j]).all()


def test_groups_and_long_texts(spark):
    long = "naïve tokens " * 90_000
    table = spark.createDataFrame([(1, "naïve tokens"), (2, long), (3, None)], "doc_id long, text string")
    found = {r.doc_id: r.groups for r in alignment.token_groups(table, A, B).collect()}
    assert found[3] == []
    one, two = alignment.ByteBPE(A), alignment.Pieces(B)
    for doc_id, text in ((1, "naïve tokens"), (2, long)):
        spelt = [(b"".join(one.pieces[i] for i in g.a), b"".join(two.pieces[i] for i in g.b)) for g in found[doc_id]]
        assert all(x == y for x, y in spelt) and b"".join(x for x, _ in spelt).decode() == " " + text
    (row,) = alignment.alignment_report(table.where("doc_id = 2"), A, B).collect()
    assert row.n_groups == len(found[2]) and row.n_a == sum(len(g.a) for g in found[2])
