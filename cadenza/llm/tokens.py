"""Token ids as seekable archives: independent zstandard frames, a document index and a trailing seek table.

An archive is a valid zstandard stream: data frames of little-endian unsigned 32-bit ids, a skippable frame
with the document index, and a skippable frame with the seek table of the public zstd seekable format
(sizes of each frame and the low 32 bits of XXH64 of its content). ``read_documents`` decompresses
only the frames that hold the documents asked for, and checks their sums.

Archives are rows of a table with a binary column, so Spark's committer writes them to any store that Spark
reaches and a lost executor's archive is written again.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, whole_text

END_ID = 1
FRAME_TOKENS = 16_384
ARCHIVE_TOKENS = 4_000_000
#: Words that a worker remembers, and as many used before; those in use stay.
REMEMBERED = 1_000_000
#: Marks that end a word.
MARKS = frozenset(b"%c" % c for c in b".,;:!?")

# Fixed values of the zstd seekable format.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_SEEK = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
HAS_CHECKSUMS = 0x80

ARCHIVES = "part int, archive int, first_id long, last_id long, n_docs long, n_tokens long, image binary"


class WordEncoder(dict[bytes, bytes]):
    """Encodes texts as ``Tokenizer.encode(text, add_special_tokens=False)`` does, remembering words.

    For tokenizers that drop white space and whose normaliser and splitter never look across it, the
    ids of a text are those of its words in order. The library encodes each distinct word; of a tokenizer that
    lower-cases and parts letters from marks, as here, the small letters of a word of ASCII, and apart a mark after an ASCII letter.
    Other words are encoded as they are: composing comes before lower-casing, and a capital may not compose where its small letter does.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.remembered = remembered
        self.older: dict[bytes, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            if word[-1:] in MARKS and word[-2:-1].isalpha() and b"<|" not in word:
                ids = self[word[:-1]] + self[word[-1:]]
            elif word.isascii() and (small := word.lower()) != word and b"<|" not in word:
                ids = self[small]
            else:
                ids = array("I", self.tokenizer.encode(word.decode(), add_special_tokens=False).ids).tobytes()
        self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if len(self) > self.remembered:
            self.older = dict(self)
            self.clear()
        return b"".join(map(self.__getitem__, text.encode("utf-8", "surrogatepass").split()))


_ENCODERS: dict[tuple[str, int], WordEncoder] = {}


def encoder(path: str, remembered: int = REMEMBERED) -> WordEncoder:
    """One for each worker process, vocabulary and number of words; a task has one core. It stays as long as its worker does."""
    if (path, remembered) not in _ENCODERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _ENCODERS[path, remembered] = WordEncoder(path, remembered)
    return _ENCODERS[path, remembered]


def pack_archive(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """``ids``: of each document, in order; a document is never split over frames."""
    zstd, frames, table, frame_of = zstandard.ZstdCompressor(level=3), [], [], []
    held: list[bytes] = []
    size = 0

    def close() -> None:
        nonlocal held, size
        raw = b"".join(held)
        frames.append(zstd.compress(raw))
        table.append((len(frames[-1]), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        held, size = [], 0

    for x in ids:
        if held and size + len(x) > 4 * FRAME_TOKENS:
            close()
        frame_of.append(len(frames))
        held.append(x)
        size += len(x)
    if held:
        close()
    index = struct.pack("<I", len(ids)) + b"".join(
        (
            np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(),
            np.array([d is None for d in doc_ids], "u1").tobytes(),
            np.array([len(x) // 4 for x in ids], "<u4").tobytes(),
            np.array(frame_of, "<u4").tobytes(),
        )
    )
    seek = b"".join(struct.pack("<III", *x) for x in table) + struct.pack("<IBI", len(table), HAS_CHECKSUMS, SEEKABLE_MAGIC)
    return b"".join((*frames, struct.pack("<II", SKIPPABLE_INDEX, len(index)), index, struct.pack("<II", SKIPPABLE_SEEK, len(seek)), seek))


def read_index(image: bytes) -> tuple[list[tuple[int, int, int, int]], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Frames (offset, compressed, raw, checksum); doc_ids, their nulls, token counts and frames of the documents."""
    n, flags, magic = struct.unpack("<IBI", image[-9:])
    if magic != SEEKABLE_MAGIC or not flags & HAS_CHECKSUMS:
        raise ValueError("not a seekable archive with checksums")
    rows = struct.iter_unpack("<III", image[-9 - 12 * n : -9])
    frames, at = [], 0
    for packed, raw, check in rows:
        frames.append((at, packed, raw, check))
        at += packed
    magic, _ = struct.unpack("<II", image[at : at + 8])
    if magic != SKIPPABLE_INDEX:
        raise ValueError("the document index is missing")
    (docs,) = struct.unpack("<I", image[at + 8 : at + 12])
    at += 12
    out = []
    for kind, width in (("<i8", 8), ("u1", 1), ("<u4", 4), ("<u4", 4)):
        out.append(np.frombuffer(image, kind, docs, at))
        at += width * docs
    return frames, *out


def read_documents(image: bytes, wanted: set[int] | None = None) -> Iterator[tuple[int, int | None, int, bytes]]:
    """(ordinal, doc_id, ids before it in the archive, its ids) of the wanted documents, or of all."""
    frames, doc_ids, nulls, counts, frame_of = read_index(image)
    starts = np.cumsum(counts, dtype=np.int64) - counts
    zstd, opened, raw, base = zstandard.ZstdDecompressor(), -1, b"", 0
    for i, doc_id in enumerate(doc_ids.tolist()):
        doc = None if nulls[i] else doc_id
        if wanted is not None and doc not in wanted:
            continue
        if (f := int(frame_of[i])) != opened:
            at, packed, size, check = frames[f]
            raw = zstd.decompress(image[at : at + packed], max_output_size=size)
            if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
                raise ValueError(f"frame {f} is damaged")
            opened, base = f, int(starts[np.searchsorted(frame_of, f)])
        at = 4 * (int(starts[i]) - base)
        yield i, doc, int(starts[i]), raw[at : at + 4 * int(counts[i])]


def write_archives(docs: DataFrame, tokenizer_path: str, partitions: int | None = None, name: str = "tokens", remembered: int = REMEMBERED) -> DataFrame:
    """The table of archives, stored: documents in ascending doc_id order (null first, ties by text) over
    (part, archive). ``docs`` needs doc_id and text; null texts count as empty, other columns are left out.

    A text of any length is one document in one frame of its own; repeated rows are stored each. An empty table gives
    no archive. ``remembered``: as for WordEncoder; fewer words need less memory and more time, ids are the same."""
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, number = encoder(tokenizer_path, remembered), TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        ids: list[bytes] = []
        size = 0
        end = struct.pack("<I", END_ID)

        def archive() -> pa.RecordBatch:
            row = [part, number, doc_ids[0], doc_ids[-1], len(ids), size // 4, pack_archive(doc_ids, ids)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=["part", "archive", "first_id", "last_id", "n_docs", "n_tokens", "image"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                doc_ids.append(doc_id)
                ids.append(own.encode(text.as_py()) + end)
                size += len(ids[-1])
                if size >= 4 * ARCHIVE_TOKENS:
                    yield archive()
                    doc_ids, ids, size, number = [], [], 0, number + 1
        if ids:
            yield archive()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    ordered = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return stored(ordered.mapInArrow(write, ARCHIVES), name)


def read_archives(archives: DataFrame, wanted: list[int] | None = None) -> DataFrame:
    """One row a document, or a wanted one: part, archive, ordinal, doc_id, local_start, ids (binary)."""
    if wanted is not None:
        hit = F.exists(F.array(*[F.lit(w).cast("long") for w in wanted]), lambda w: (F.col("first_id").isNull() | (w >= F.col("first_id"))) & (w <= F.col("last_id")))
        archives = archives.where(hit)
    chosen = None if wanted is None else set(wanted)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, image in zip(*(batch.column(i).to_pylist() for i in range(3))):
                rows = list(read_documents(image, chosen))
                for k in range(0, len(rows), 2000):
                    some = rows[k : k + 2000]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([part] * len(some), pa.int32()),
                            pa.array([number] * len(some), pa.int32()),
                            pa.array([x[0] for x in some], pa.int64()),
                            pa.array([x[1] for x in some], pa.int64()),
                            pa.array([x[2] for x in some], pa.int64()),
                            pa.array([len(x[3]) // 4 for x in some], pa.int64()),
                            pa.array([zlib.crc32(x[3]) for x in some], pa.int64()),
                            pa.array([x[3] for x in some], pa.binary()),
                        ],
                        names=["part", "archive", "ordinal", "doc_id", "local_start", "n_tokens", "ids_crc32", "ids"],
                    )

    return archives.select("part", "archive", "image").mapInArrow(decode, "part int, archive int, ordinal long, doc_id long, local_start long, n_tokens long, ids_crc32 long, ids binary")


def archive_starts(archives: DataFrame) -> DataFrame:
    """(part, archive, archive_start): ids in all archives before it. Only the sums of parts meet in one task."""
    parts = archives.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    own = Window.partitionBy("part").orderBy("archive")
    within = archives.select("part", "archive", (F.sum("n_tokens").over(own) - F.col("n_tokens")).alias("own_start"))
    return within.join(before, "part").select("part", "archive", (F.col("part_start") + F.col("own_start")).alias("archive_start"))


def token_index(archives: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the archives."""
    rows = read_archives(archives).drop("ids")
    return rows.join(archive_starts(archives), ["part", "archive"]).select("doc_id", (F.col("archive_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def public_tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
