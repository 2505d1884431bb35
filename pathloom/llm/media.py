"""Media columns: PNG images in binary columns, decoded with numpy, and cosine-transform hashes.

``encode_png`` writes 8-bit greyscale images: signature, IHDR, zlib-compressed
IDAT chunks and IEND, each chunk with its CRC-32.  Decoding tests every checksum,
inflates the IDAT chunks as one stream and undoes the five row filters with numpy,
for many images at once: a sample needs its left, upper and corner neighbours, so
all samples on one diagonal of their images are computed together, and a batch
takes as many steps as its tallest image has rows, and 64.  ``cosine_hash`` averages the image into a 32 x 32 grid and takes
the signs of its 64 lowest frequencies against their median.

``payload`` is what a text is stored as: its UTF-8 bytes, padded with bytes 0 to
a positive multiple of 64, as an image 64 samples wide.

Defined cases: a null or empty text is a payload of 64 bytes 0; a null image
decodes to null; a damaged one raises; equal texts give equal values; an empty
table gives no rows; other columns stay (those named as outputs are replaced).
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .words import slices

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH, CHUNK, SLICE = 64, 1 << 18, 4 << 20
FILTERS = {"none": 0, "sub": 1, "up": 2, "average": 3, "paeth": 4}


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    p = a + b - c
    pa_, pb, pc = abs(p - a), abs(p - b), abs(p - c)
    return np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c))


def filter_rows(rows: np.ndarray, row_filter: str, first: np.ndarray) -> np.ndarray:
    """(rows, 1 + width) filtered rows of images below each other; ``first`` marks their first rows.

    ``adaptive`` takes for each row the filter of the least sum of absolute values.
    """
    x = rows.astype(np.int16)
    left, up, corner = np.zeros_like(x), np.zeros_like(x), np.zeros_like(x)
    left[:, 1:], up[1:] = x[:, :-1], x[:-1]
    up[first] = 0
    corner[:, 1:] = up[:, :-1]

    def by(kind: int) -> np.ndarray:
        guess = (0, left, up, (left + up) >> 1, None)[kind] if kind < 4 else _paeth(left, up, corner)
        return ((x - guess) & 255).astype(np.uint8)

    out = np.empty((len(rows), rows.shape[1] + 1), np.uint8)
    if row_filter != "adaptive":
        out[:, 0], out[:, 1:] = FILTERS[row_filter], by(FILTERS[row_filter])
        return out
    best = np.full(len(rows), 1 << 30, np.int64)
    for kind in range(5):
        own = by(kind)
        cost = np.abs(own.view(np.int8).astype(np.int16)).sum(axis=1)
        better = cost < best
        best[better] = cost[better]
        out[better, 0], out[better, 1:] = kind, own[better]
    return out


def _file(filtered: np.ndarray, level: int) -> bytes:
    height, width = filtered.shape[0], filtered.shape[1] - 1
    packed = zlib.compress(filtered.tobytes(), level)
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return b"".join([SIGNATURE, _chunk(b"IHDR", head), *[_chunk(b"IDAT", packed[i : i + CHUNK]) for i in range(0, len(packed), CHUNK)], _chunk(b"IEND", b"")])


def _starts(heights: np.ndarray) -> np.ndarray:
    return np.cumsum(heights) - heights


def encode_many(rows: np.ndarray, heights: np.ndarray, row_filter: str = "adaptive", level: int = 6) -> list[bytes]:
    """PNGs of images of the same width, given below each other."""
    at = _starts(heights)
    filtered = filter_rows(rows, row_filter, at)
    return [_file(filtered[a : a + h], level) for a, h in zip(at.tolist(), heights.tolist())]


def encode_png(image: np.ndarray, row_filter: str = "adaptive", level: int = 6) -> bytes:
    """A PNG of a (height, width) uint8 array."""
    return encode_many(image, np.array([len(image)]), row_filter, level)[0]


def unfilter(raw: np.ndarray, heights: np.ndarray) -> np.ndarray:
    """Samples of images below each other, from their (rows, 1 + width) filtered rows."""
    if raw[:, 0].max(initial=0) > 4:
        raise ValueError("unknown row filter")
    count, width = raw.shape[0], raw.shape[1] - 1
    y = np.arange(count) - np.repeat(_starts(heights), heights)
    order = np.argsort(y, kind="stable")  # rows by their place in their image
    y = y[order]
    kinds = raw[order, 0]
    place = np.empty(count, np.int64)
    place[order] = np.arange(count)
    above = np.where(y > 0, place[np.maximum(order - 1, 0)] + 1, 0) * (width + 1)
    own = (np.arange(count) + 1) * (width + 1)
    body = raw[order, 1:].astype(np.int16).ravel()
    out = np.zeros((count + 1) * (width + 1), np.int16)  # a row and a column of zeros around the samples
    least = np.searchsorted(y, np.arange(int(heights.max(initial=0)) + 2 * width), "left")
    for t in range(int(heights.max(initial=0)) + width - 1):
        lo, hi = least[max(0, t - width + 1)], least[t + 1]
        x = t - y[lo:hi]
        at, over = own[lo:hi] + x, above[lo:hi] + x
        left, up, corner = out[at], out[over + 1], out[over]
        kind = kinds[lo:hi]
        guess = np.choose(kind, (0, left, up, (left + up) >> 1, _paeth(left, up, corner)))
        out[at + 1] = (body[np.arange(lo, hi) * width + x] + guess) & 255
    samples = np.empty((count, width), np.uint8)
    samples[order] = out.reshape(count + 1, width + 1)[1:, 1:]
    return samples


def inflate(data: bytes) -> np.ndarray:
    """The (height, 1 + width) filtered rows of an 8-bit greyscale PNG; ValueError if it is damaged."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, size, parts, ended = 8, None, [], False
    while at + 12 <= len(data) and not ended:
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if len(data) < at + 12 + n or zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError("a chunk's checksum differs")
        if kind == b"IHDR":
            width, height, depth, colour, *rest = struct.unpack(">IIBBBBB", body)
            if (depth, colour, *rest) != (8, 0, 0, 0, 0):
                raise ValueError("not a plain 8-bit greyscale image")
            size = height, width
        elif kind == b"IDAT":
            parts.append(body)
        elif kind == b"IEND":
            ended = True
        elif not kind[0] & 32:
            raise ValueError("unknown critical chunk")
        at += 12 + n
    if size is None or not ended:
        raise ValueError("chunks are missing")
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8)
    if len(raw) != size[0] * (size[1] + 1):
        raise ValueError("wrong number of samples")
    return raw.reshape(size[0], size[1] + 1)


def decode_many(data: list[bytes]) -> list[np.ndarray]:
    """The (height, width) samples of each image."""
    out: list = [None] * len(data)
    rows = [inflate(d) for d in data]
    for width in {r.shape[1] for r in rows}:
        own = [i for i, r in enumerate(rows) if r.shape[1] == width]
        heights = np.array([len(rows[i]) for i in own])
        samples = unfilter(np.concatenate([rows[i] for i in own]), heights)
        for i, a, h in zip(own, _starts(heights).tolist(), heights.tolist()):
            out[i] = samples[a : a + h]
    return out


def decode_png(data: bytes) -> np.ndarray:
    """The (height, width) samples of one image."""
    return decode_many([data])[0]


_GRID = 32
_BASIS = np.cos(np.pi * np.arange(8)[:, None] * (2 * np.arange(_GRID)[None] + 1) / (2 * _GRID))


def _squeeze(x: np.ndarray, axis: int) -> np.ndarray:
    """Means of 32 equal runs along an axis; a shorter axis repeats its values."""
    n = x.shape[axis]
    first = np.arange(_GRID) * n // _GRID
    if n < _GRID:
        return np.take(x, first, axis)
    size = np.diff(np.append(first, n))
    shape = [1, 1]
    shape[axis] = _GRID
    return np.add.reduceat(x, first, axis) / size.reshape(shape)


def cosine_hash(image: np.ndarray) -> str:
    """16 hex digits: the 64 lowest frequencies above their median, row by row."""
    grid = _squeeze(_squeeze(image.astype(np.float64), 0), 1)
    low = np.round(_BASIS @ grid @ _BASIS.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def payload(text: str | None) -> tuple[bytes, int]:
    """(padded bytes, bytes before padding)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % 64 if raw else 64), len(raw)


def store_texts(docs: DataFrame, text: str = "text", row_filter: str = "adaptive") -> DataFrame:
    """``docs`` with ``media`` (PNG, binary) and ``n_bytes``; ``text`` goes."""
    keep = [f for f in docs.schema if f.name not in (text, "media", "n_bytes")]

    def run(batches):
        for batch in batches:
            media, sizes = [], []
            texts = batch.column(batch.schema.get_field_index(text))
            for a, b in slices(texts, SLICE):
                bodies = [payload(t.as_py()) for t in texts[a:b]]
                sizes += [n for _, n in bodies]
                rows = np.frombuffer(b"".join(x for x, _ in bodies), np.uint8).reshape(-1, WIDTH)
                media += encode_many(rows, np.array([len(x) // WIDTH for x, _ in bodies]), row_filter)
            cols = [batch.column(batch.schema.get_field_index(f.name)) for f in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(media, pa.binary()), pa.array(sizes, pa.int64())], names=[*[f.name for f in keep], "media", "n_bytes"])

    out = docs.select(*[f.name for f in keep], F.lit(b"").alias("media"), F.lit(0).cast("long").alias("n_bytes")).schema
    return docs.drop("media", "n_bytes").mapInArrow(run, out)


def read_media(media: DataFrame) -> DataFrame:
    """Rows of a ``media`` column with what is read back from it: payload (binary) and feature."""
    names = [c for c in media.columns if c not in ("payload", "feature")]

    def run(batches):
        for batch in batches:
            bodies, feats = [], []
            media = batch.column(batch.schema.get_field_index("media"))
            for a, b in slices(media, SLICE // 2):
                own = media[a:b].to_pylist()
                images = iter(decode_many([m for m in own if m is not None]))
                for m in own:
                    image = None if m is None else next(images)
                    bodies.append(None if image is None else image.tobytes())
                    feats.append(None if image is None else cosine_hash(image))
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in names], pa.array(bodies, pa.binary()), pa.array(feats, pa.string())], names=[*names, "payload", "feature"])

    out = media.select(*names, F.lit(b"").alias("payload"), F.lit("").alias("feature")).schema
    return media.select(*names).mapInArrow(run, out)


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    stored = shared.cut(store_texts(docs), shared.folder(spark, "media"))
    back = read_media(stored)
    return back.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).cast("long").alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
