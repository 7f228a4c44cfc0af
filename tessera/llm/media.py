"""Media columns: PNG files in binary columns, and cosine-transform hashes.

Writing: bytes become the samples of an 8-bit RGB image of ``width`` pixels, each
row filtered by that of the five filters whose differences have the least sum,
deflated into IDAT chunks, each chunk with its CRC-32.
Reading: every chunk's CRC is tested, zlib tests the Adler-32 of the stream,
and numpy undoes the filters, for the images of a portion at once: a pixel needs
those left, above and left above, so all pixels with the same sum of row and
column are done in one step.  The feature is the sign of the 64
lowest-frequency coefficients of the cosine transform of a 32 x 32 grey
reduction against their median, as 16 hex digits.

The images are written as a Parquet table in the shared folder and decoded from
what that table gives back.  Rows are independent: no shuffle, no state, and a
lost executor repeats only its own rows.

Defined cases: a null or empty text is a payload of 192 spaces; an image that
fails a check gives nulls and the reason in ``media_error``; equal texts give
equal values; repeated rows stay; extra columns are not read.
"""

from __future__ import annotations

import binascii
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, stored, whole_text

SIGNATURE = b"\x89PNG\r\n\x1a\n"  # fixed by the PNG format
CHANNELS = 3


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", binascii.crc32(kind + data))


def _average(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a.astype(np.uint16) + b) >> 1).astype(np.uint8)


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    a, b, c = (x.astype(np.int16) for x in (a, b, c))
    pa, pb, pc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
    return np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c)).astype(np.uint8)


def filter_rows(rows: np.ndarray, first: np.ndarray, kinds: np.ndarray | None = None) -> np.ndarray:
    """Rows (n, 3 w) of images, ``first`` where one begins, filtered, the kind in front.

    ``kinds``: the filter of each row; without it that of the least sum of
    absolute (signed) differences, the lowest on a tie.
    """
    left, up, corner = np.zeros_like(rows), np.zeros_like(rows), np.zeros_like(rows)
    left[:, CHANNELS:], up[1:] = rows[:, :-CHANNELS], rows[:-1]
    up[first] = 0
    corner[:, CHANNELS:] = up[:, :-CHANNELS]
    made = np.stack([rows, rows - left, rows - up, rows - _average(left, up), rows - _paeth(left, up, corner)])
    if kinds is None:
        kinds = np.abs(made.view(np.int8).astype(np.int16)).sum(axis=2, dtype=np.int64).argmin(axis=0)
    out = np.empty((rows.shape[0], rows.shape[1] + 1), np.uint8)
    out[:, 0] = kinds
    out[:, 1:] = made[kinds.astype(np.intp), np.arange(len(rows))]
    return out


def unfilter_rows(lines: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Undo the row filters of images of one width, ``first`` where one begins."""
    kinds = lines[:, 0]
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown row filter")
    n, width = len(lines), (lines.shape[1] - 1) // CHANNELS
    coded = lines[:, 1:].reshape(n, width, CHANNELS)
    out = np.zeros((n + 1, width + 1, CHANNELS), np.uint8)  # with a row and a column of zeros in front
    begin = np.flatnonzero(first)
    row = np.arange(n) - np.repeat(begin, np.diff(np.append(begin, n)))  # in its image
    above = np.where(first, 0, np.arange(n))  # the row before, counted from 1
    order = np.argsort(row, kind="stable")
    ends = np.searchsorted(row[order], np.arange(-width, (row.max(initial=-1) + 1) + width + 1), "right")
    for t in range(int(row.max(initial=-1)) + width):
        some = order[ends[t] : ends[t + width]]  # rows from t - width + 1 to t of their images
        x = t - row[some]
        a, b, c = out[some + 1, x], out[above[some], x + 1], out[above[some], x]
        kind = kinds[some][:, None]
        guess = np.where(kind == 1, a, np.where(kind == 2, b, np.uint8(0)))
        guess = np.where(kind == 3, _average(a, b), np.where(kind == 4, _paeth(a, b, c), guess))
        out[some + 1, x + 1] = coded[some, x] + guess
    return out[1:, 1:].reshape(n, -1)


def _first_rows(heights: list[int]) -> np.ndarray:
    first = np.zeros(sum(heights), bool)
    first[np.cumsum([0, *heights[:-1]])[: len(heights)]] = True
    return first


def encode_images(payloads: list[bytes], width: int = 64, level: int = 6, kinds: np.ndarray | None = None, part: int = 1 << 16) -> list[bytes]:
    """Each payload, a positive multiple of 3 x width bytes, as a PNG file."""
    if not payloads:
        return []
    heights = [len(x) // (CHANNELS * width) for x in payloads]
    lines = filter_rows(np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, CHANNELS * width), _first_rows(heights), kinds)
    out, at = [], 0
    for height in heights:
        packed = zlib.compress(lines[at : at + height].tobytes(), level)
        head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
        body = b"".join(_chunk(b"IDAT", packed[i : i + part]) for i in range(0, len(packed), part))
        out.append(SIGNATURE + _chunk(b"IHDR", head) + body + _chunk(b"IEND", b""))
        at += height
    return out


def read_lines(data: bytes) -> np.ndarray:
    """The filtered rows of a PNG file, the kind in front; ValueError if a check fails."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, head, packed, ended = 8, None, [], False
    while at + 12 <= len(data) and not ended:
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if len(body) < n or len(data) < at + 12 + n:
            raise ValueError("cut chunk")
        if binascii.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError(f"wrong checksum in {kind.decode('latin-1')}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        ended = kind == b"IEND"
        at += 12 + n
    if head is None or not ended:
        raise ValueError("no header or end")
    if head[2:] != (8, 2, 0, 0, 0):
        raise ValueError("not an 8-bit RGB image without interlacing")
    try:
        raw = zlib.decompress(b"".join(packed))
    except zlib.error as e:
        raise ValueError(f"deflate: {e}") from e
    width, height = head[:2]
    if len(raw) != height * (CHANNELS * width + 1):
        raise ValueError("wrong number of samples")
    lines = np.frombuffer(raw, np.uint8).reshape(height, -1)
    if lines[:, 0].max(initial=0) > 4:
        raise ValueError("unknown row filter")
    return lines


def decode_images(files: list[bytes]) -> list[np.ndarray | ValueError]:
    """The (height, width, 3) samples of each PNG file, or what is wrong with it."""
    out: list = []
    for data in files:
        try:
            out.append(read_lines(data))
        except ValueError as e:
            out.append(e)
    for size in {x.shape[1] for x in out if not isinstance(x, ValueError) and len(x)}:
        own = [i for i, x in enumerate(out) if not isinstance(x, ValueError) and x.shape[1] == size and len(x)]
        heights = [len(out[i]) for i in own]
        rows = unfilter_rows(np.concatenate([out[i] for i in own]), _first_rows(heights))
        for i, pixels in zip(own, np.split(rows, np.cumsum(heights)[:-1]), strict=True):
            out[i] = pixels.reshape(len(pixels), -1, CHANNELS)
    return out


def cosine_basis(n: int, keep: int) -> np.ndarray:
    k, x = np.arange(keep)[:, None], np.arange(n)[None, :]
    basis = np.cos(np.pi * (2 * x + 1) * k / (2 * n)) * np.sqrt(2 / n)
    basis[0] /= np.sqrt(2)
    return basis


BASIS = cosine_basis(32, 8)


def _bins(n: int, cells: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """First sample and number of samples of each cell; small sides repeat samples."""
    edges = np.arange(cells) * n // cells
    ends = np.maximum((np.arange(cells) + 1) * n // cells, edges + 1)
    return edges, ends - edges


def cosine_hash(pixels: np.ndarray) -> str:
    grey = pixels.astype(np.float64) @ (np.array([299, 587, 114]) / 1000)  # fixed values: BT.601 luma
    for axis in (0, 1):
        edges, counts = _bins(grey.shape[axis])
        total = np.concatenate([np.zeros((1, grey.shape[1 - axis])), np.cumsum(grey if axis == 0 else grey.T, axis=0)])
        mean = (total[edges + counts] - total[edges]) / counts[:, None]
        grey = mean if axis == 0 else mean.T
    low = np.round(BASIS @ grey @ BASIS.T, 6).ravel()
    bits = low > np.median(low[1:])
    bits[0] = False  # the mean brightness says nothing of the shape
    return np.packbits(bits).tobytes().hex()


def pad(data: bytes, unit: int) -> bytes:
    """Spaces up to a positive multiple of ``unit``."""
    return data + b" " * (-len(data) % unit if data else unit)


def portions(sizes: list[int], size: int = 1 << 20) -> Iterator[slice]:
    """Runs of images of about ``size`` bytes, so that arrays stay small."""
    start = n = 0
    for i, x in enumerate(sizes):
        n += x
        if n >= size:
            yield slice(start, i + 1)
            start, n = i + 1, 0
    if start < len(sizes):
        yield slice(start, len(sizes))


def write_media(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 64) -> DataFrame:
    """key, n_bytes, media: each whole text as a PNG."""
    unit = CHANNELS * width

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            data = [t.encode("utf-8") for t in batch["t"]]
            for some in portions([len(x) for x in data]):
                yield pd.DataFrame({key: batch[key].iloc[some], "n_bytes": [len(x) for x in data[some]], "media": encode_images([pad(x, unit) for x in data[some]], width)})

    rows = docs.select(F.col(key).cast("long"), whole_text(text).alias("t"))
    return rows.mapInPandas(encode, f"{key} long, n_bytes long, media binary")


def read_media(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """Decode the stored images, test them and compute the features."""
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media_error"]

    def told(data: bytes, pixels: np.ndarray | ValueError) -> tuple:
        base = (len(data), hashlib.sha256(data).hexdigest())
        if isinstance(pixels, ValueError):
            return (None, None, None, *base, None, str(pixels))
        payload = pixels.tobytes()
        return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), *base, cosine_hash(pixels), None)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            files = [bytes(x) for x in batch["media"]]
            for some in portions([int(x) for x in batch["n_bytes"]]):
                out = [told(data, pixels) for data, pixels in zip(files[some], decode_images(files[some]), strict=True)]
                found = pd.DataFrame(out, columns=names).astype({"payload_bytes": "Int64", "tail_crc32": "Int64"})
                yield pd.concat([batch[[key, "n_bytes"]].iloc[some].reset_index(drop=True), found], axis=1)

    schema = f"{key} long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media_error string"
    return media.mapInPandas(decode, schema)


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_media(stored(write_media(documents(spark, sf_dir)), "media"))
