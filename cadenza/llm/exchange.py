"""Questions that chunks of documents ask of the whole corpus, in packed rows.

A corpus is packed where it lies into compressed chunks of about CHUNK_BYTES of text and written once, bucketed by chunk;
its texts are never shuffled. A chunk sends the distinct keys of what it holds (windows, words), sorted, once each with
what it knows of them; the keys of all chunks meet in blocks by their leading bits; a block answers each chunk in the
order in which it asked, and the answers travel to the chunk's bucket. A key that a third of all documents hold is one
entry for each chunk, however often it occurs there. Chunks and blocks are of bounded size: their numbers follow the
corpus. Only a text longer than a chunk makes a larger one.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete_at_end, scratch_dir, whole_text

CHUNK_BYTES = 4_000_000
#: Small corpora have smaller chunks, about so many.
LEAST_CHUNKS = 64
#: A bucket is a task of about BUCKET_CHUNKS chunks; beyond FINE_BUCKETS buckets they are as many as hold BUCKET_BYTES each, taken chunk by chunk.
BUCKET_CHUNKS, FINE_BUCKETS, BUCKET_BYTES = 2, 20_000, 512_000_000
BLOCK_KEYS = 1_500_000
#: Stands for a null doc_id, as larger than all others.
NULL_ID = np.iinfo(np.int64).max

ASKED = "block long, chunk long, asked binary"
ANSWERED = "chunk long, block long, answer binary"


@dataclass
class Chunk:
    number: int
    ids: np.ndarray  # doc_ids, NULL_ID for null
    nulls: np.ndarray
    texts: list[bytes]

    def doc_ids(self) -> list[int | None]:
        return [None if n else i for i, n in zip(self.ids.tolist(), self.nulls.tolist())]


def squeeze(a: np.ndarray) -> bytes:
    """An array, its bytes sorted by significance, compressed."""
    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T if len(a) else a.view(np.uint8)
    return struct.pack("<I", len(a)) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def loosen(data: bytes, kind: str | np.dtype) -> np.ndarray:
    (n,) = struct.unpack_from("<I", data)
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[4:], max_output_size=max(1, n * size)), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).reshape(n) if n else np.zeros(0, kind)


def joined(*parts: bytes) -> bytes:
    return b"".join(struct.pack("<I", len(x)) + x for x in parts)


def parted(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        (n,) = struct.unpack_from("<I", data, at)
        out.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return out


class Corpus:
    """``docs`` (doc_id, text; null texts are empty) in chunks."""

    def __init__(self, docs: DataFrame, chunk_bytes: int | None = None):
        self.bytes = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        size = chunk_bytes or min(CHUNK_BYTES, max(CHUNK_BYTES // 16, self.bytes // LEAST_CHUNKS))
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
        fine = int(1 + self.bytes // (size * BUCKET_CHUNKS))
        buckets = min(fine, max(FINE_BUCKETS, int(self.bytes // BUCKET_BYTES)))
        packed = rows.mapInArrow(lambda batches: _pack(batches, size), "chunk long, blob binary")
        # Few buckets are written where chunks are packed, a file for each chunk; many are gathered first, a file for each bucket.
        self.packed = _bucketed(packed if fine <= FINE_BUCKETS else packed.repartition(buckets, "chunk"), buckets)

    def bits(self, keys: float) -> int:
        """Leading bits by which about so many keys, over the corpus, fall into blocks of BLOCK_KEYS."""
        return max(4, int(np.ceil(np.log2(max(1.0, keys / BLOCK_KEYS)))))

    def ask(self, asks: Callable[[Chunk], Iterator[tuple[int, bytes]]]) -> DataFrame:
        """(block, chunk, asked) of every chunk."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for number, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                    for block, data in asks(_unpack(number, blob.as_py())):
                        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([number], pa.int64()), pa.array([data], pa.binary())], names=["block", "chunk", "asked"])

        return self.packed.mapInArrow(run, ASKED)

    def tell(self, answers: DataFrame, tells: Callable[[Chunk, dict[int, bytes]], pa.Table], schema: str) -> DataFrame:
        """What ``tells`` makes of each chunk and its answers by block."""

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            chunk = _unpack(left["chunk"][0].as_py(), left["blob"][0].as_py())
            return tells(chunk, dict(zip(right["block"].to_pylist(), right["answer"].to_pylist())))

        return self.packed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)


def _bucketed(packed: DataFrame, buckets: int) -> DataFrame:
    """``packed`` written to the shared folder in buckets by chunk, and read back. The session's catalog keeps no name of it."""
    spark, name = packed.sparkSession, f"chunks_{uuid.uuid4().hex}"
    path = f"{scratch_dir(spark)}/{name}"
    packed.write.bucketBy(buckets, "chunk").option("path", path).saveAsTable(name)
    delete_at_end(spark, path)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out


def answer(asked: DataFrame, answers: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """Each block's answers to the chunks that asked it, in their order."""

    def run(table: pa.Table) -> pa.Table:
        made = answers(table["asked"].to_pylist())
        return pa.table({"chunk": table["chunk"], "block": table["block"], "answer": pa.array(made, pa.binary())})

    return asked.groupBy("block").applyInArrow(run, ANSWERED)


def _pack(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(chunk, blob) of a partition's documents, in their order, in chunks of about ``size`` bytes."""
    zstd, first, made = zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId() << 32, 0
    heads: list[bytes] = []
    texts: list[bytes] = []
    held = 0

    def chunk() -> pa.RecordBatch:
        blob = zstd.compress(struct.pack("<I", len(heads)) + b"".join(heads) + b"".join(texts))
        return pa.RecordBatch.from_arrays([pa.array([first + made], pa.int64()), pa.array([blob], pa.binary())], names=["chunk", "blob"])

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            raw = text.as_py().encode("utf-8", "surrogatepass")
            heads.append(struct.pack("<q?I", NULL_ID if doc_id is None else doc_id, doc_id is None, len(raw)))
            texts.append(raw)
            held += len(raw) + 20
            if held >= size:
                yield chunk()
                heads, texts, held, made = [], [], 0, made + 1
    if heads:
        yield chunk()


def _unpack(number: int, blob: bytes) -> Chunk:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    (n,) = struct.unpack_from("<I", raw)
    at = 4 + 13 * n
    ids, nulls, texts = np.zeros(n, np.int64), np.zeros(n, bool), []
    for i, (ids[i], nulls[i], size) in enumerate(struct.iter_unpack("<q?I", raw[4:at])):
        texts.append(raw[at : at + size])
        at += size
    return Chunk(number, ids, nulls, texts)


def split_sorted(keys: np.ndarray, shift: int) -> Iterator[tuple[int, int, int]]:
    """(block, start, end) of stretches of sorted unsigned keys that share the bits above ``shift``."""
    lead = keys >> np.uint64(shift)
    edges = np.flatnonzero(np.diff(lead)) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(keys)]):
        if b > a:
            yield int(lead[a]), a, b
