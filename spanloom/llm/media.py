"""Media columns: bytes kept losslessly as PNG images in a binary column, and low-frequency cosine hashes of them.

write: payload -> 8-bit grey PNG, WIDTH samples a row, each row with the filter (none, Sub or Up) whose values have the least sum of
magnitudes, IHDR/IDAT/IEND chunks with CRC-32.
read: chunks are walked with a checksum test each, image data inflated, rows unfiltered with numpy (all five
filters; Average and Paeth along anti-diagonals), samples returned. The hash shrinks the image to 32 x 32 by area means, takes the 8 x 8 lowest frequencies of
its cosine transform, and sets a bit for each that is above the median of the others.

Null text counts as empty (one row of padding). Texts of any length go through whole. Repeated rows give equal
values; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spanloom.llm.common import ids_and_texts, lean, scratch

WIDTH = 576
SIGNATURE = b"\x89PNG\r\n\x1a\n"
_SIDE, _LOW = 32, 8
_K = np.arange(_SIDE)
_COSINES = np.cos(np.pi * (2 * _K[None, :] + 1) * _K[:_LOW, None] / (2 * _SIDE))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def filtered(image: np.ndarray, kinds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The rows with a filter each, and the filters: those given, or of none, Sub and Up the one with the least sum of magnitudes."""
    left, up = np.zeros_like(image), np.zeros_like(image)
    left[:, 1:] = image[:, :-1]
    up[1:] = image[:-1]
    choices = [image, image - left, image - up]
    if kinds is None:
        # bytes count as signed numbers, as decoders' guides advise
        size = [np.abs(c.view(np.int8).astype(np.int16)).sum(1, dtype=np.int64) for c in choices]
        kinds = np.argmin(size, axis=0).astype(np.uint8)
    elif kinds.max() > 2:
        corner = np.zeros_like(image)
        corner[1:, 1:] = image[:-1, :-1]
        a, b, c = (x.astype(np.int16) for x in (left, up, corner))
        choices += [image - ((a + b) >> 1).astype(np.uint8), image - _paeth(a, b, c).astype(np.uint8)]
    return np.choose(kinds[:, None], choices), kinds


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    pa, pb, pc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
    return np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))


def encode_png(samples: bytes, width: int = WIDTH, level: int = 1, kinds: np.ndarray | None = None) -> bytes:
    """8-bit grey samples, a multiple of `width`, as a PNG; kinds: a filter for each row instead of the best one."""
    rows = len(samples) // width
    if not rows or rows * width != len(samples):
        raise ValueError("the samples must be a positive multiple of the width")
    raw = np.empty((rows, width + 1), np.uint8)
    raw[:, 1:], raw[:, 0] = filtered(np.frombuffer(samples, np.uint8).reshape(rows, width), kinds)
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, rows, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(raw.data, level)) + _chunk(b"IEND", b"")


def png_chunks(png: bytes):
    """(kind, data) of each chunk; raises where the signature, a length or a checksum is wrong."""
    if png[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at = 8
    while at < len(png):
        if at + 12 > len(png):
            raise ValueError("a chunk is cut off")
        n, kind = struct.unpack_from(">I4s", png, at)
        data = png[at + 8 : at + 8 + n]
        if len(data) != n or at + 12 + n > len(png):
            raise ValueError("a chunk is cut off")
        if zlib.crc32(kind + data) != struct.unpack_from(">I", png, at + 8 + n)[0]:
            raise ValueError(f"the checksum of chunk {kind!r} is wrong")
        yield kind, data
        at += 12 + n
        if kind == b"IEND":
            return
    raise ValueError("IEND is missing")


def unfilter(raw: np.ndarray, filters: np.ndarray, step: int = 1) -> np.ndarray:
    """Undoes the row filters; `step` is the number of bytes of a pixel. Runs of rows of one filter go at once: sums along rows or columns for
    Sub and Up, anti-diagonals (whose pixels don't need each other) for Average and Paeth."""
    rows, width = raw.shape
    if not filters.any():
        return raw
    if filters.max() > 4:
        raise ValueError("unknown filter")
    out = np.zeros((rows, width), np.uint8)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(filters)) + 1, [rows]]).tolist()
    for at, end in zip(cuts[:-1], cuts[1:]):
        kind, block = int(filters[at]), raw[at:end]
        above = out[at - 1] if at else np.zeros(width, np.uint8)
        if kind == 0:
            out[at:end] = block
        elif kind == 1:
            for c in range(step):
                np.cumsum(block[:, c::step], axis=1, dtype=np.uint8, out=out[at:end, c::step])
        elif kind == 2:
            np.cumsum(block, axis=0, dtype=np.uint8, out=out[at:end])
            out[at:end] += above
        else:
            # a frame of the row above and of zeros at the left; work holds what is done already
            n = end - at
            work = np.zeros((n + 1, width + step), np.int16)
            work[0, step:] = above
            for d in range(n + (width + step - 1) // step - 1):
                r = np.arange(max(0, d - (width - 1) // step), min(n, d + 1))
                for c in range(step):
                    x = (d - r) * step + c
                    i, j = r[x < width] + 1, x[x < width] + step
                    a, b, corner = work[i, j - step], work[i - 1, j], work[i - 1, j - step]
                    guess = (a + b) >> 1 if kind == 3 else _paeth(a, b, corner)
                    work[i, j] = (block[i - 1, j - step] + guess) & 255
            out[at:end] = work[1:, step:]
    return out


def decode_png(png: bytes) -> np.ndarray:
    """The samples of an 8-bit grey PNG that isn't interlaced, as rows."""
    header, data = None, []
    for kind, part in png_chunks(png):
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            data.append(part)
    if header is None or header[2:] != (8, 0, 0, 0, 0):
        raise ValueError("only 8-bit grey images without interlacing are read")
    width, rows = header[:2]
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    if raw.size != rows * (width + 1):
        raise ValueError("the image data have a wrong length")
    raw = raw.reshape(rows, width + 1)
    return unfilter(raw[:, 1:], raw[:, 0])


def _means(x: np.ndarray, axis: int) -> np.ndarray:
    """_SIDE area means along an axis; with fewer samples than that, they are repeated."""
    n = x.shape[axis]
    if n < _SIDE:
        return np.take(x, np.arange(_SIDE) * n // _SIDE, axis).astype(np.float64)
    cuts = np.arange(_SIDE + 1) * n // _SIDE
    sums = np.add.reduceat(x, cuts[:-1], axis=axis, dtype=np.float64)
    sizes = np.diff(cuts)
    return sums / (sizes[:, None] if axis == 0 else sizes[None, :])


def cosine_hash(samples: np.ndarray) -> str:
    """64 bits as hex: which of the lowest frequencies exceed the median; the constant term doesn't count for it."""
    low = _COSINES @ _means(_means(samples, 1), 0) @ _COSINES.T
    flat = np.round(low.ravel(), 6)
    return np.packbits(flat > np.median(flat[1:])).tobytes().hex()


def payload_of(text: str, width: int = WIDTH) -> tuple[int, bytes]:
    data = text.encode()
    size = max(1, -(-len(data) // width)) * width
    return len(data), data.ljust(size, b"\xff")  # byte 255 is in no UTF-8


def write_media(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Stores each text as a row (doc_id, media) of a table with a binary column, and returns that table as read again."""

    def run(batches):
        for batch in batches:
            media = [encode_png(payload_of(t)[1]) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(media, pa.binary())], names=["doc_id", "media"])

    schema = "doc_id long, media binary"
    ids_and_texts(df, key, text).mapInArrow(lean(run), schema).write.option("compression", "uncompressed").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


_FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(media: DataFrame) -> DataFrame:
    """Reads the images of a (doc_id, media) table back and describes them."""

    def run(batches):
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for png in batch.column("media").to_pylist():
                samples = decode_png(png)
                payload = samples.tobytes()
                for col, x in zip(cols, (len(payload.rstrip(b"\xff")), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(png), hashlib.sha256(png).hexdigest(), cosine_hash(samples))):
                    col.append(x)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.mapInArrow(lean(run), _FEATURES)


def media_columns(docs: DataFrame) -> DataFrame:
    return features(write_media(docs, scratch(docs.sparkSession, "media")))
