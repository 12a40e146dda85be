"""Texts as grey-scale PNG images in a binary column, and low-frequency cosine-transform hashes of images.

``encode`` writes each payload as a PNG of WIDTH samples a row (signature, IHDR, IDAT chunks of one zlib
stream, IEND; a CRC-32 for every chunk). ``decode_png`` reads any non-interlaced 8-bit PNG: it tests each
checksum, inflates, and undoes all five row filters with numpy. A damaged image raises an error.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text

WIDTH, PAD = 192, 32
CHUNK_BYTES = 1 << 16
SIDE, LOW = 32, 8
# Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SAMPLES_OF_COLOUR = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def payload(text: str) -> tuple[bytes, int]:
    """UTF-8 with spaces appended up to a positive multiple of WIDTH; the length before."""
    raw = text.encode("utf-8", "surrogatepass")
    return raw + bytes([PAD]) * (WIDTH - len(raw) if not raw else -len(raw) % WIDTH), len(raw)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(data: bytes, width: int = WIDTH) -> bytes:
    """8-bit grey; each row takes the filter None, Sub or Up with the least sum of signed magnitudes."""
    rows = np.frombuffer(data, np.uint8).reshape(-1, width)
    tried = np.stack([rows, np.diff(rows, axis=1, prepend=np.uint8(0)), np.diff(rows, axis=0, prepend=np.zeros((1, width), np.uint8))])
    cost = np.minimum(tried, np.uint8(0) - tried).sum(axis=2, dtype=np.int64)
    best = cost.argmin(axis=0)
    body = np.empty((len(rows), width + 1), np.uint8)
    body[:, 0] = best
    body[:, 1:] = tried[best, np.arange(len(rows))]
    packed = zlib.compress(body.tobytes(), 6)
    parts = [_chunk(b"IDAT", packed[i : i + CHUNK_BYTES]) for i in range(0, len(packed), CHUNK_BYTES)]
    return b"".join((SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)), *parts, _chunk(b"IEND", b"")))


def _diagonals(kind: int, rows: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Rows [height, width, samples] with the filter Average (3) or Paeth (4). A sample needs those to its left, above it
    and between the two, so all samples of one diagonal are undone at once."""
    height, width, step = rows.shape
    out = np.zeros((height + 1, width + 1, step), np.int16)
    out[0, 1:] = above
    for d in range(height + width - 1):
        y = np.arange(max(0, d - width + 1), min(height, d + 1))
        x = d - y
        left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        if kind == 3:
            guess = (left + up) // 2
        else:
            p = left + up - corner
            to_left, to_up, to_corner = abs(p - left), abs(p - up), abs(p - corner)
            guess = np.where((to_left <= to_up) & (to_left <= to_corner), left, np.where(to_up <= to_corner, up, corner))
        out[y + 1, x + 1] = (rows[y, x] + guess) & 255
    return out[1:, 1:].astype(np.uint8)


def _unfilter(kinds: np.ndarray, rows: np.ndarray, step: int) -> np.ndarray:
    """``rows`` [height, width*step] as stored; runs of rows with one of the filters None, Sub, Up at once."""
    out, n = np.empty_like(rows), len(rows)
    edges = np.flatnonzero(np.diff(kinds)) + 1
    for a, b in zip(np.r_[0, edges], np.r_[edges, n]):
        kind, part = (int(kinds[a]), rows[a:b]) if n else (0, rows)
        above = out[a - 1] if a else np.zeros(rows.shape[1], np.uint8)
        if kind == 0:
            out[a:b] = part
        elif kind == 1:
            out[a:b] = np.add.accumulate(part.reshape(len(part), -1, step), axis=1, dtype=np.uint8).reshape(part.shape)
        elif kind == 2:
            out[a:b] = np.add.accumulate(np.vstack((above[None], part)), axis=0, dtype=np.uint8)[1:]
        elif kind in (3, 4):
            out[a:b] = _diagonals(kind, part.reshape(len(part), -1, step), above.reshape(-1, step)).reshape(part.shape)
        else:
            raise ValueError(f"row filter {kind} is unknown")
    return out


def decode_png(image: bytes) -> np.ndarray:
    """[height, width, samples] of an 8-bit PNG that isn't interlaced."""
    if image[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, packed, ended = 8, b"", [], False
    while at < len(image) and not ended:
        (n,) = struct.unpack_from(">I", image, at)
        kind, data = image[at + 4 : at + 8], image[at + 8 : at + 8 + n]
        if len(data) != n or struct.unpack_from(">I", image, at + 8 + n)[0] != zlib.crc32(kind + data):
            raise ValueError(f"chunk {kind!r} is damaged")
        if kind == b"IHDR":
            head = data
        elif kind == b"IDAT":
            packed.append(data)
        ended = kind == b"IEND"
        at += 12 + n
    if not ended:
        raise ValueError("the image ends early")
    width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", head)
    if depth != 8 or interlaced or colour not in SAMPLES_OF_COLOUR:
        raise ValueError("only 8-bit images without interlacing are read")
    step = SAMPLES_OF_COLOUR[colour]
    body = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width * step + 1)
    return _unfilter(body[:, 0], body[:, 1:], step).reshape(height, width, step)


_K = np.arange(SIDE)
COSINES = np.cos(np.pi * np.outer(np.arange(LOW), 2 * _K + 1) / (2 * SIDE))


def _means(a: np.ndarray, n: int) -> np.ndarray:
    """Means over ``n`` equal stretches of the rows of ``a``, rows being cut where a stretch ends inside one."""
    edges = np.linspace(0, len(a), n + 1)
    whole = np.minimum(edges.astype(int), len(a) - 1)
    sums = np.vstack((np.zeros((1, a.shape[1])), np.cumsum(a, axis=0)))
    at = sums[whole] + (edges - whole)[:, None] * a[whole]
    return np.diff(at, axis=0) / (len(a) / n)


def cosine_hash(samples: np.ndarray) -> bytes:
    """64 bits: which of the LOW x LOW lowest cosine coefficients of the SIDE x SIDE means exceed their median;
    the constant one doesn't count for the median."""
    grey = samples.mean(axis=2) if samples.shape[2] > 1 else samples[:, :, 0].astype(float)
    small = _means(_means(grey, SIDE).T, SIDE).T
    low = (COSINES @ small @ COSINES.T).ravel().round(6)
    return np.packbits(low > np.median(low[1:])).tobytes()


def encode(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (a PNG) of every document; a null or empty text is one row of spaces.

    Equal texts make equal images; a null doc_id stays null; an empty table gives no rows; other columns are left out. A
    text of any length is one image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 256):
                some = batch.slice(k, 256)
                made = [payload(x.as_py()) for x in some.column(1)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([n for _, n in made], pa.int64()), pa.array([encode_png(x) for x, _ in made], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def features(media: DataFrame) -> DataFrame:
    """Reads the stored images: payload digests, cosine_hash (binary) and, as feature, the same in hex. One row an image,
    whatever its doc_id; an empty table gives no rows; a damaged image is an error; other columns are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 256):
                some = batch.slice(k, 256)
                images = some.column(2).to_pylist()
                rows = []
                for image in images:
                    samples = decode_png(image)
                    data, own = samples.tobytes(), cosine_hash(samples)
                    rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(image), hashlib.sha256(image).hexdigest(), own.hex(), own))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], names=NAMES)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, SCHEMA)


NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "cosine_hash"]
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, cosine_hash binary"
