"""Media columns: payloads as greyscale PNG images in a binary column, read back and hashed.

Every row of an image gets the filter, of the five, whose residuals have the least sum of absolute values; the filtered
rows are written as zlib data, split into IDAT chunks of bounded size. Reading tests the signature, every chunk's CRC-32,
the zlib Adler-32 and the size, undoes the row filters in numpy, diagonal by diagonal for many images at once, and takes
a low-frequency cosine-transform hash of the samples.
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
from pyspark.sql import types as T

from .common import as_bytes, batch_of, bound_batches, keyed, lots, stored

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
IDAT_BYTES = 1 << 16
#: Bytes of images that are taken at once (one larger image is a lot of its own), and rows that are filtered at once.
LOT_BYTES, ROWS = 1 << 20, 1 << 14
#: The hash looks at a SIDE x SIDE reduction of the image and keeps the KEEP x KEEP lowest frequencies.
SIDE, KEEP = 32, 8


class MediaError(ValueError):
    """The stored bytes are no whole, intact image of the kind that this module writes."""


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def pad(payload: bytes, width: int = WIDTH) -> bytes:
    """Append zero bytes up to a positive multiple of width; a payload that is one already stays."""
    return payload.ljust(max(width, -(-len(payload) // width) * width), b"\0")


def _residuals(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(5, rows, width): the rows less the guesses of filters 0-4; `first` marks rows that have none above."""
    left, up, corner = np.zeros_like(rows), np.zeros_like(rows), np.zeros_like(rows)
    left[:, 1:], up[1:] = rows[:, :-1], rows[:-1]
    up[first] = 0
    corner[:, 1:] = up[:, :-1]
    average = ((left.astype(np.uint16) + up) >> 1).astype(np.uint8)
    return np.stack([rows, rows - left, rows - up, rows - average, rows - _paeth(left, up, corner)])


def filtered(payloads: list[bytes], width: int = WIDTH, filter_type: int | None = None) -> Iterator[np.ndarray]:
    """Rows with their filter's number in front, of each payload: the filter of least residuals, or filter_type."""
    heights = np.array([len(x) // width for x in payloads])
    ends = np.cumsum(heights)
    rows = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, width)
    first = np.zeros(len(rows), bool)
    first[(ends - heights)[heights > 0]] = True
    body = np.empty((len(rows), width + 1), np.uint8)
    for lo in range(0, len(rows), ROWS):
        above = max(0, lo - 1)
        every = _residuals(rows[above : lo + ROWS], first[above : lo + ROWS])[:, lo - above :]
        kind = np.abs(every.view(np.int8).astype(np.int16)).sum(axis=2).argmin(axis=0) if filter_type is None else np.full(every.shape[1], filter_type)
        body[lo : lo + ROWS, 0] = kind
        body[lo : lo + ROWS, 1:] = every[kind, np.arange(len(kind))]
    for lo, hi in zip(ends - heights, ends, strict=True):
        yield body[lo:hi]


def encode_png(body: np.ndarray, level: int = 1) -> bytes:
    """A greyscale 8-bit PNG of filtered rows, one sample a byte."""
    packed = zlib.compress(np.ascontiguousarray(body), level)
    parts = [SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", body.shape[1] - 1, len(body), 8, 0, 0, 0, 0))]
    parts += [_chunk(b"IDAT", packed[k : k + IDAT_BYTES]) for k in range(0, len(packed), IDAT_BYTES)]
    return b"".join([*parts, _chunk(b"IEND", b"")])


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    x, y, z = a.astype(np.int16), b.astype(np.int16), c.astype(np.int16)
    da, db, dc = np.abs(y - z), np.abs(x - z), np.abs(x + y - 2 * z)
    return np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c)).astype(np.uint8)


def decode_png(data: bytes) -> np.ndarray:
    """Filtered rows (rows, 1 + width) of a greyscale 8-bit PNG. Raises MediaError for damage or another kind of image."""
    if not data.startswith(SIGNATURE):
        raise MediaError("no PNG signature")
    at, size, packed, ended = len(SIGNATURE), None, [], False
    while at < len(data):
        if ended or at + 12 > len(data):
            raise MediaError("bytes after the end, or a cut chunk")
        (length,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + length]
        if len(body) < length or at + 12 + length > len(data):
            raise MediaError("a cut chunk")
        if zlib.crc32(body, zlib.crc32(kind)) != struct.unpack_from(">I", data, at + 8 + length)[0]:
            raise MediaError("a chunk's checksum differs")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        ended = kind == b"IEND"
        at += 12 + length
    if not ended or size is None or size[2:] != (8, 0, 0, 0, 0):
        raise MediaError("not a whole greyscale 8-bit image")
    width, height = size[:2]
    try:
        raw = zlib.decompress(b"".join(packed))
    except zlib.error as e:
        raise MediaError(str(e)) from e
    if len(raw) != height * (width + 1):
        raise MediaError("the samples' number differs from the header")
    body = np.frombuffer(raw, np.uint8).reshape(height, width + 1)
    if height and body[:, 0].max() > 4:
        raise MediaError("an unknown row filter")
    return body


def unfilter(bodies: list[np.ndarray]) -> list[np.ndarray]:
    """Samples of filtered images of one width.

    A sample needs those to its left, above and above left. Samples of one diagonal (row + column) of all images need
    only earlier diagonals, so each diagonal is undone at once.
    """
    heights = [len(x) for x in bodies]
    total, width = sum(heights), bodies[0].shape[1] - 1
    number = np.concatenate([np.arange(n) for n in heights])  # of a row in its image
    order = np.argsort(number, kind="stable")
    number = number[order]
    place = np.empty(total, np.int64)
    place[order] = np.arange(1, total + 1)
    above = np.where(number > 0, np.r_[0, place[:-1]][order] if total else 0, 0)  # where the row above lies; row 0 is empty
    body = np.concatenate(bodies)[order]
    step = width + 1
    out = np.zeros((total + 1) * step, np.int16)  # a column of zeros in front of every row
    coded = body[:, 1:].astype(np.int16).ravel()
    kind = body[:, 0]
    sub, up, mean, paeth = ((kind == k).astype(np.int16) for k in (1, 2, 3, 4))
    own, over = (np.arange(1, total + 1) * step), above * step
    codes = np.arange(total) * width
    for d in range(int(number[-1]) + width if total else 0):
        lo, hi = np.searchsorted(number, (d - width + 1, d + 1))
        column = d - number[lo:hi]
        at, top = own[lo:hi] + column, over[lo:hi] + column
        a, b, c = out[at], out[top + 1], out[top]
        da, db, dc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
        nearest = np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c))
        guess = a * sub[lo:hi] + b * up[lo:hi] + ((a + b) >> 1) * mean[lo:hi] + nearest * paeth[lo:hi]
        out[at + 1] = (coded[codes[lo:hi] + column] + guess) & 255
    samples = out.reshape(total + 1, step)[1:, 1:].astype(np.uint8)[place - 1]
    return np.split(samples, np.cumsum(heights)[:-1])


def _cosines() -> np.ndarray:
    k, x = np.arange(KEEP)[:, None], np.arange(SIDE)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * SIDE))


_COS = _cosines()


def cosine_hash(samples: np.ndarray) -> bytes:
    """64 bits: which of the 8 x 8 lowest cosine frequencies of the reduced image lie above their median."""
    height, width = samples.shape
    rows = np.linspace(0, height, SIDE + 1).astype(int)
    cols = np.linspace(0, width, SIDE + 1).astype(int)
    sums = np.zeros((height + 1, width + 1), np.int64)
    np.cumsum(np.cumsum(samples, axis=0, dtype=np.int64), axis=1, out=sums[1:, 1:])
    lo, hi = np.minimum(rows[:-1], height - 1), np.maximum(rows[1:], np.minimum(rows[:-1], height - 1) + 1)
    left, right = cols[:-1], np.maximum(cols[1:], cols[:-1] + 1)
    area = (hi - lo)[:, None] * (right - left)[None, :]
    small = (sums[hi][:, right] - sums[lo][:, right] - sums[hi][:, left] + sums[lo][:, left]) / area
    low = np.round(_COS @ small @ _COS.T, 6)
    return np.packbits(low.ravel() > np.median(low)).tobytes()


def to_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", level: int = 1) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as UTF-8, zero-padded, stored as a PNG in a binary column.

    Null and empty texts become one row of 64 zeros. Repeated rows give repeated rows; a null id stays null. Other
    columns are not read. An empty table gives an empty table.
    """
    names, types = ["doc_id", "n_bytes", "media"], [pa.int64(), pa.int64(), pa.binary()]
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in lots(batch.column(1), LOT_BYTES):
                texts = as_bytes(batch.column(1).slice(lo, hi - lo))
                media = [encode_png(x, level) for x in filtered([pad(x) for x in texts])]
                yield batch_of(names, [batch.column(0).slice(lo, hi - lo), [len(x) for x in texts], media], types)

    return keyed(df, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def _features(samples: np.ndarray, data: bytes) -> tuple:
    payload = samples.tobytes()
    return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), cosine_hash(samples))


def media_features(df: DataFrame, id_col: str = "doc_id", media_col: str = "media", on_error: str = "raise", keep: tuple[str, ...] = ()) -> DataFrame:
    """Read stored images back: (doc_id, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature).

    feature is the cosine hash as binary; `keep` names columns of df that stay besides, under names that are not those.
    A null image has null results. A damaged one raises MediaError, or with on_error="null" has null results as well. An
    empty table gives an empty table, repeated rows repeated rows, a null id stays null.
    """
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    bound_batches(df.sparkSession)

    def read(data: bytes | None) -> np.ndarray | None:
        if data is None:
            return None
        try:
            return decode_png(data)
        except MediaError:
            if on_error == "raise":
                raise
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in lots(batch.column(1), LOT_BYTES):
                media = batch.column(1).slice(lo, hi - lo).to_pylist()
                bodies = [read(x) for x in media]
                rows: list[tuple] = [(None,) * 6] * len(media)
                for width in {x.shape[1] for x in bodies if x is not None}:
                    own = [k for k, x in enumerate(bodies) if x is not None and x.shape[1] == width]
                    for k, samples in zip(own, unfilter([bodies[k] for k in own]), strict=True):
                        rows[k] = _features(samples, media[k])
                columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)]
                held = [batch.column(k).slice(lo, hi - lo) for k in (0, *range(2, batch.num_columns))]
                yield pa.RecordBatch.from_arrays([held[0], *columns, *held[1:]], names=["doc_id", *names, *keep])

    picked = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media"), *keep)
    kinds = "doc_id long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature binary"
    return picked.mapInArrow(run, T.StructType([*T._parse_datatype_string(kinds).fields, *picked.schema.fields[2:]]))


def media_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text as an image in a Parquet table, read that back: a row a document; n_bytes is the unpadded size.

    Nulls, empty texts, repeated rows and empty tables as in to_media.
    """
    held = stored(to_media(df, id_col, text_col), "media")
    out = media_features(held, keep=("n_bytes",)).withColumn("feature", F.lower(F.hex("feature")))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
