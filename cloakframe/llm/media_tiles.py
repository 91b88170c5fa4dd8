"""Media columns: Netpbm and BMP images to numpy arrays, NPY tiles and difference hashes.

Images are decoded to uint8 arrays (height, width, channels), reduced by exact
area averages taken from integral images, and written as NPY tiles with a 64-bit
difference hash. A text column is stored losslessly as 8-bit grey samples, 64 to a
row: as binary PGM when the number of rows is even, else as 8-bit BMP.

Defined results: null text counts as empty (one row of zeros); a binary column with
null, empty or undecodable content, samples out of range among it, gives null height,
width, tile and hash, with the reason in `error`; rows repeat as given; null ids stay
null; an empty table gives no rows; extra columns of the input are ignored; very long
texts are stored whole, and reduced strip by strip.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts

ROW = 64
COMMENT = re.compile(rb"#[^\n]*")
#: Rows of an image whose integral image is held at one time.
STRIP = 4096


class MediaError(ValueError):
    """Content that is no image of the two families."""


def netpbm_tokens(data: bytes, count: int, at: int) -> tuple[list[int], int]:
    """Header numbers, skipping white space and comments; the position after the last one."""
    out: list[int] = []
    while len(out) < count:
        while at < len(data) and (data[at : at + 1].isspace() or data[at] == 35):
            if data[at] == 35:
                end = data.find(b"\n", at)
                at = len(data) if end < 0 else end
            else:
                at += 1
        start = at
        while at < len(data) and 48 <= data[at] <= 57:
            at += 1
        if not 0 < at - start < 10:
            raise MediaError("netpbm header")
        out.append(int(data[start:at]))
    return out, at


def plain_samples(data: bytes, n: int, top: int) -> np.ndarray:
    """n numbers of 0 to `top` in decimal, comments left out."""
    found = COMMENT.sub(b" ", data).split()[:n]
    if any(not x.isdigit() or len(x) > 9 for x in found):
        raise MediaError("netpbm sample")
    return np.array(found, dtype=np.int64)


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6; samples scaled to 0..255."""
    kind = data[1] - 48
    channels = 3 if kind in (3, 6) else 1
    bitmap = kind in (1, 4)
    head, at = netpbm_tokens(data, 2 if bitmap else 3, 2)
    width, height, top = head[0], head[1], 1 if bitmap else head[2]
    n = width * height * channels
    if not n or not 0 < top < 65536:
        raise MediaError("netpbm size")
    if kind == 1:
        drawn = b"".join(COMMENT.sub(b" ", data[at:]).split())[:n]
        if drawn.strip(b"01"):
            raise MediaError("netpbm sample")
        flat = np.frombuffer(drawn, np.uint8) - 48
    elif kind in (2, 3):
        flat = plain_samples(data[at:], n, top)
    elif kind == 4:
        stride = (width + 7) // 8
        raw = np.frombuffer(data, np.uint8, offset=at + 1)[: stride * height]
        if raw.size < stride * height:
            raise MediaError("netpbm data")
        flat = np.unpackbits(raw.reshape(height, stride), axis=1)[:, :width].ravel()
    else:
        flat = np.frombuffer(data, np.uint8 if top < 256 else ">u2", count=min(n, (len(data) - at - 1) // (1 + (top > 255))), offset=at + 1)
    if flat.size < n:
        raise MediaError("netpbm data")
    if flat.max() > top:
        raise MediaError("netpbm sample")
    if bitmap:
        flat = 1 - flat
    if top != 255:
        flat = (flat.astype(np.int64) * 255 + top // 2) // top
    return flat.astype(np.uint8).reshape(height, width, channels)


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 24 or 32 bits; palettes resolved, grey palettes to one channel."""
    if len(data) < 54:
        raise MediaError("bmp header")
    offset, size, width, height, planes, bits, packed = struct.unpack_from("<I I i i H H I", data, 10)
    used = struct.unpack_from("<I", data, 46)[0]
    rows = abs(height)
    # cores of 12 bytes hold other fields in other places
    if size < 40 or planes != 1 or packed or bits not in (1, 4, 8, 24, 32) or width <= 0 or not rows:
        raise MediaError("bmp kind")
    if offset < 14 + size or bits < 24 and used > 1 << bits:
        raise MediaError("bmp header")
    stride = (width * bits + 31) // 32 * 4
    if len(data) < offset + stride * rows:
        raise MediaError("bmp data")
    raw = np.frombuffer(data, np.uint8, count=stride * rows, offset=offset).reshape(rows, stride)
    if bits >= 24:
        out = raw[:, : width * bits // 8].reshape(rows, width, bits // 8)[:, :, 2::-1]
    else:
        palette = np.frombuffer(data[14 + size : offset], np.uint8)[: 4 * (used or 1 << bits)]
        palette = palette[: len(palette) // 4 * 4].reshape(-1, 4)[:, 2::-1]
        if bits == 8:
            index = raw[:, :width]
        elif bits == 4:
            index = np.stack([raw >> 4, raw & 15], axis=2).reshape(rows, -1)[:, :width]
        else:
            index = np.unpackbits(raw, axis=1)[:, :width]
        if index.max(initial=0) >= len(palette):
            raise MediaError("bmp palette")
        grey = len(palette) and (palette[:, 0] == palette[:, 1]).all() and (palette[:, 1] == palette[:, 2]).all()
        out = palette[index][:, :, :1] if grey else palette[index]
    return out if height < 0 else out[::-1]


def decode(data: bytes) -> np.ndarray:
    if len(data) > 2 and data[:1] == b"P" and data[1:2] in (b"1", b"2", b"3", b"4", b"5", b"6"):
        return decode_netpbm(data)
    if data[:2] == b"BM":
        return decode_bmp(data)
    raise MediaError("no netpbm or bmp")


def encode_pgm(grey: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (grey.shape[1], grey.shape[0]) + grey.tobytes()


def encode_bmp(grey: np.ndarray) -> bytes:
    """8 bits with a grey palette, rows from the bottom up, each padded to four bytes."""
    height, width = grey.shape
    body = np.pad(grey[::-1], ((0, 0), (0, -width % 4))).tobytes()
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4) * np.array([1, 1, 1, 0], np.uint8)
    offset = 54 + 1024
    head = struct.pack("<2sIHHI", b"BM", offset + len(body), 0, 0, offset)
    return head + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8, 0, len(body), 2835, 2835, 256, 0) + palette.tobytes() + body


def between(sums: np.ndarray, low: np.ndarray, rest: np.ndarray, parts: int) -> np.ndarray:
    """`parts` times the running sums at low + rest / parts along the last axis, in whole numbers."""
    high = np.minimum(low + 1, sums.shape[-1] - 1)
    return sums[..., low] * parts + (sums[..., high] - sums[..., low]) * rest


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Exact area averages, rounded half up; the integral image is built strip by strip.

    Only the integral's rows at the output's edges are kept, so memory is bounded by
    one strip however tall the image is. All arithmetic is in whole numbers.
    """
    rows, columns, channels = image.shape
    x_low, x_rest = np.divmod(np.arange(width + 1) * columns, width)
    y_low, y_rest = np.divmod(np.arange(height + 1) * rows, height)
    out = np.zeros((height, width, channels), np.uint8)
    for c in range(channels):
        at_edges = np.zeros((height + 1, width + 1), np.int64)
        total = np.zeros((1, columns), np.int64)
        for top in range(0, rows, STRIP):
            strip = image[top : top + STRIP, :, c]
            down = np.concatenate([total, total + np.cumsum(strip, axis=0, dtype=np.int64)])
            here = np.flatnonzero((y_low >= top) & (y_low + (y_rest > 0) <= top + len(strip)))
            lines = between(down.T, y_low[here] - top, y_rest[here], height).T
            across = np.concatenate([np.zeros((len(here), 1), np.int64), np.cumsum(lines, axis=1)], axis=1)
            at_edges[here] = between(across, x_low, x_rest, width)
            total = down[-1:]
        area = at_edges[1:, 1:] - at_edges[:-1, 1:] - at_edges[1:, :-1] + at_edges[:-1, :-1]
        out[:, :, c] = (2 * area + rows * columns) // (2 * rows * columns)
    return out


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(array), allow_pickle=False)
    return out.getvalue()


def difference_hash(image: np.ndarray) -> str:
    """16 hex digits: whether each of 8 x 8 areas is brighter than its right neighbour."""
    small = area_resize(image, 8, 9).sum(axis=2, dtype=np.int32)
    return np.packbits(small[:, :-1] > small[:, 1:]).tobytes().hex()


def media_tiles(df: DataFrame, id_col: str, content_col: str, tile: tuple[int, int] = (32, 32)) -> DataFrame:
    """id, height, width, channels, tile_npy (binary NPY of the reduced image), dhash, error."""
    rows = df.select(F.col(id_col).alias("id"), F.col(content_col).cast("binary").alias("content"))
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string()]
    names = ["height", "width", "channels", "tile_npy", "dhash", "error"]

    def one(content: bytes | None) -> tuple:
        try:
            image = decode(content or b"")
        except MediaError as e:
            return (None, None, None, None, None, str(e)[:80])
        except (ValueError, OverflowError, struct.error):
            return (None, None, None, None, None, "malformed content")
        return (*image.shape, npy(area_resize(image, *tile)), difference_hash(image), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = [one(x.as_py()) for x in b.column("content")]
            columns = list(zip(*values, strict=True)) if values else [[] for _ in names]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), *(pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True))],
                names=["id", *names],
            )

    added = T.StructType.fromDDL("height int, width int, channels int, tile_npy binary, dhash string, error string")
    return rows.mapInArrow(run, T.StructType([T.StructField("id", rows.schema["id"].dataType), *added])).withColumnRenamed("id", id_col)


def store_text(text: str) -> tuple[int, bytes]:
    """The UTF-8 length of a text and its stored image."""
    raw = text.encode("utf-8")
    size = max(ROW, -(-len(raw) // ROW) * ROW)
    grey = np.frombuffer(raw.ljust(size, b"\0"), np.uint8).reshape(-1, ROW)
    return len(raw), encode_pgm(grey) if len(grey) % 2 == 0 else encode_bmp(grey)


def text_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes and media (the stored image) for every whole text."""
    return map_texts(df, id_col, text_col, lambda: store_text, "n_bytes bigint, media binary")


def text_media_features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tile: tuple[int, int] = (16, 16)) -> DataFrame:
    """Store each text, read the stored bytes back, and derive digests and features from what was read."""

    def one(text: str) -> tuple:
        n, media = store_text(text)
        image = decode(media)
        payload = image.tobytes()
        reduced = hashlib.sha256(npy(area_resize(image, *tile))).hexdigest()
        return (
            n,
            len(payload),
            hashlib.sha256(payload).hexdigest(),
            zlib.crc32(payload[-ROW:]),
            len(media),
            hashlib.sha256(media).hexdigest(),
            f"dhash={difference_hash(image)};tile={reduced}",
        )

    fields = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return map_texts(df, id_col, text_col, lambda: one, fields)
