"""Media columns: Netpbm and BMP bytes as numpy arrays, area resizing by integral images, NPY tiles.

Samples are scaled to their type's full range: 8 bits, or 16 where the largest level is over 255. Tiles have 8 bits.

Cases: bytes that are no known image, or whose header asks for more than they hold, raise ``ValueError`` in ``decode`` and
give a null row in ``tiles``; a null text is empty; equal bytes give equal features; ids may be null or repeat; texts of any
length are stored whole; empty tables give empty tables; columns that are not named are not read.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame

from .common import documents, map_arrow

#: Samples in a row of a stored payload, which is also the block to which a payload is filled up.
WIDTH = 64
_SPACE = rb"(?:[ \t\r\n\v\f]|#[^\r\n]*[\r\n])"


def decode(data: bytes) -> np.ndarray:
    """Rows x columns (grey) or rows x columns x 3 (colour); 8 bits, 16 where the maximum is over 255."""
    if data[:2] == b"BM":
        return _bmp(data)
    if re.match(rb"P[1-6]\s", data):
        return _netpbm(data)
    raise ValueError("neither Netpbm nor BMP")


def _netpbm(data: bytes) -> np.ndarray:
    kind, fields, at = data[1] - 48, [], 2
    for _ in range(2 if kind in (1, 4) else 3):
        m = re.compile(_SPACE + rb"+(\d{1,9})(?!\d)").match(data, at)
        if not m:
            raise ValueError("broken header")
        fields.append(int(m[1]))
        at = m.end()
    (w, h), top = fields[:2], (fields + [1])[2]
    bands = 3 if kind in (3, 6) else 1
    if not 0 < top < 65536:
        raise ValueError("broken largest level")
    if w * h * bands > 8 * len(data):
        raise ValueError("too few samples")
    if kind <= 3:
        body = re.sub(rb"#[^\r\n]*", b" ", data[at:])
        values = [c - 48 for c in body if c in b"01"] if kind == 1 else body.split()
        values = values[: w * h * bands]
        if kind > 1 and not all(re.fullmatch(rb"\d{1,9}", v) for v in values):
            raise ValueError("no number")
        flat = np.array(values, dtype=np.int64)
    elif kind == 4:
        packed = np.frombuffer(data, np.uint8, h * ((w + 7) // 8), at + 1).reshape(h, -1)
        flat = np.unpackbits(packed, axis=1)[:, :w].reshape(-1)
    else:
        flat = np.frombuffer(data, ">u2" if top > 255 else np.uint8, w * h * bands, at + 1)
    if flat.size != w * h * bands:
        raise ValueError("too few samples")
    if kind in (1, 4):
        flat = (1 - flat) * 255
    elif flat.size and flat.max() > top:
        raise ValueError("a level over the largest")
    elif top not in (255, 65535):
        full = 65535 if top > 255 else 255
        flat = (flat.astype(np.int64) * full + top // 2) // top
    flat = flat.astype(np.uint16 if top > 255 else np.uint8)
    return flat.reshape((h, w, 3) if bands == 3 else (h, w))


def _bmp(data: bytes) -> np.ndarray:
    """Rows of 1, 4, 8, 24 or 32 bits without packing; headers of 12 bytes have 16-bit sizes and palettes of three bytes."""
    start, head = struct.unpack_from("<II", data, 10)
    if head == 12:
        (w, h, _, bits), packing, used, unit = struct.unpack_from("<HHHH", data, 18), 0, 0, 3
    elif head >= 40:
        w, h, _, bits, packing = struct.unpack_from("<iiHHI", data, 18)
        used, unit = struct.unpack_from("<I", data, 46)[0], 4
    else:
        raise ValueError("unknown BMP header")
    if packing == 3 and (bits != 32 or struct.unpack_from("<III", data, 54) != (0xFF0000, 0xFF00, 0xFF)):
        raise ValueError("unknown BMP masks")
    if packing not in (0, 3) or bits not in (1, 4, 8, 24, 32) or w <= 0:
        raise ValueError("packed BMP")
    rows, stride = abs(h), (w * bits + 31) // 32 * 4
    if rows * stride > len(data):
        raise ValueError("too few samples")
    raw = np.frombuffer(data, np.uint8, rows * stride, start).reshape(rows, stride)
    if bits >= 24:
        out = raw[:, : w * bits // 8].reshape(rows, w, bits // 8)[:, :, 2::-1]
    else:
        used = min(used or 1 << bits, 1 << bits)
        palette = np.frombuffer(data, np.uint8, used * unit, 14 + head).reshape(-1, unit)[:, 2::-1]
        index = raw if bits == 8 else (np.unpackbits(raw, axis=1) if bits == 1 else np.stack([raw >> 4, raw & 15], 2).reshape(rows, -1))
        out = palette[index[:, :w]]
        if (palette[:, 0] == palette[:, 1]).all() and (palette[:, 1] == palette[:, 2]).all():
            out = out[:, :, 0]
    return np.ascontiguousarray(out[::-1] if h > 0 else out)


def encode_pgm(samples: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + samples.astype(np.uint8).tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """Grey samples as an 8-bit BMP with a grey palette."""
    h, w = samples.shape
    stride = (w + 3) // 4 * 4
    rows = np.zeros((h, stride), np.uint8)
    rows[:, :w] = samples[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4).copy()
    palette[:, 3] = 0
    at = 54 + 1024
    return b"BM" + struct.pack("<IHHIIiiHHIIiiII", at + rows.size, 0, 0, at, 40, w, h, 1, 8, 0, rows.size, 2835, 2835, 256, 0) + palette.tobytes() + rows.tobytes()


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else image.astype(np.float64) @ np.array([0.299, 0.587, 0.114])


def eight_bits(image: np.ndarray) -> np.ndarray:
    return image / 257.0 if image.dtype == np.uint16 else image


def integral(image: np.ndarray) -> np.ndarray:
    """Sums of all samples above and left, with a zero row and column in front."""
    kind = np.int64 if image.dtype.kind in "ui" else np.float64
    out = np.zeros((image.shape[0] + 1, image.shape[1] + 1), kind)
    np.cumsum(image, axis=0, out=out[1:, 1:], dtype=kind)
    np.cumsum(out[1:, 1:], axis=1, out=out[1:, 1:])
    return out


def _at(sums: np.ndarray, axis: int, cuts: np.ndarray) -> np.ndarray:
    """The integral at fractional cuts along an axis: linear between the samples' borders."""
    low = np.minimum(cuts.astype(np.int64), sums.shape[axis] - 2)
    a, b = np.take(sums, low, axis).astype(np.float64), np.take(sums, low + 1, axis).astype(np.float64)
    share = (cuts - low).reshape((-1, 1) if axis == 0 else (1, -1))
    return a + (b - a) * share


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each target cell's area, parts of samples counted by their share."""
    h, w = image.shape
    at = _at(_at(integral(image), 0, np.arange(height + 1) * h / height), 1, np.arange(width + 1) * w / width)
    return (at[1:, 1:] - at[:-1, 1:] - at[1:, :-1] + at[:-1, :-1]) / ((h / height) * (w / width))


def difference_hash(image: np.ndarray) -> str:
    """64 bits: whether each of 8 x 8 cells is darker than its right neighbour."""
    small = np.round(area_resize(grey(image), 8, 9), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def tiles(df: DataFrame, id_col: str, media_col: str, size: int = 32) -> DataFrame:
    """Decode every image and resize it: ``id, height, width, tile`` (NPY bytes), ``dhash``; null where undecodable."""

    def run(batch):
        out = {k: [] for k in ("height", "width", "tile", "dhash")}
        for data in batch.column("media").to_pylist():
            try:
                image = decode(data or b"")
                if 0 in image.shape:
                    raise ValueError("no samples")
            except (ValueError, struct.error, IndexError, OverflowError):
                row = (None,) * 4
            else:
                small = np.rint(area_resize(eight_bits(grey(image)) if image.ndim == 2 else grey(eight_bits(image)), size, size)).astype(np.uint8)
                row = (image.shape[0], image.shape[1], npy(small), difference_hash(image))
            for k, v in zip(out, row):
                out[k].append(v)
        return out | {"id": batch.column("id")}

    source = df.select(df[id_col].alias("id"), df[media_col].alias("media"))
    return map_arrow(source, run, f"id {source.schema['id'].dataType.simpleString()}, height int, width int, tile binary, dhash string")


def payload(text: str) -> bytes:
    data = text.encode()
    return data + bytes(-len(data) % WIDTH if data else WIDTH)


def store_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tile: int = 16) -> DataFrame:
    """Each text as an 8-bit PGM, read back from the stored bytes; features come from what was read back: ``tile`` is an
    NPY file of ``tile`` x ``tile`` samples, ``feature`` the difference hash and the start of the tile's digest."""
    names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile")

    def run(batch):
        out = {k: [] for k in names}
        for text in batch.column("text").to_pylist():
            data = payload(text)
            media = encode_pgm(np.frombuffer(data, np.uint8).reshape(-1, WIDTH))
            image = decode(media)
            back = image.tobytes()
            small = npy(np.rint(area_resize(image, tile, tile)).astype(np.uint8))
            feature = f"{difference_hash(image)}:{hashlib.sha256(small).hexdigest()[:16]}"
            row = (len(text.encode()), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature, small)
            for k, v in zip(names, row):
                out[k].append(v)
        return out | {"doc_id": batch.column("doc_id")}

    source = documents(docs, id_col, text_col)
    return map_arrow(source, run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary")
