"""Media columns: Netpbm and BMP images as bytes, decoded to numpy arrays, resized by area and hashed by differences.

Images are resized with an integral image: its linear interpolation at fractional cell borders gives each target cell the
exact mean of the area that it covers. Results are tiles in NPY format and difference hashes.

Samples count in parts of the image's sample maximum: tiles and hashes see grey levels from 0 to 255 whatever the depth.

Defined results: a null text counts as empty (a payload of 64 zero bytes); a null or damaged image (too few samples, samples that
are negative or over the maximum, a maximum outside 1 to 65535, sizes that its bytes can't hold) gives null features. A very long
text is one tall image; its integral image is made in bands, so memory is a small multiple of the image's. Repeated rows
give equal results; extra columns are kept by `features` (those named like its results are replaced) and ignored by `store_texts`.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import map_arrow, text_or_empty

WIDTH = 64
HEADER = re.compile(rb"P([1-6])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)")
#: Samples of the integral image that are made at once.
BAND = 1 << 20
DEPTH = re.compile(rb"(?:\s|#[^\n]*\n)+(\d+)")


def encode_pgm(samples: np.ndarray) -> bytes:
    """A two-dimensional uint8 array as binary Netpbm (P5)."""
    height, width = samples.shape
    return b"P5\n%d %d\n255\n" % (width, height) + samples.tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """A uint8 array as an uncompressed BMP: (height, width, 3) in RGB with 24 bits, (height, width) with 8 and a grey palette."""
    height, width = samples.shape[:2]
    bits = 8 if samples.ndim == 2 else 24
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4) * np.array([1, 1, 1, 0], np.uint8) if bits == 8 else np.zeros((0, 4), np.uint8)
    stride = (bits // 8 * width + 3) // 4 * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, : bits // 8 * width] = samples[::-1] if bits == 8 else samples[::-1, :, ::-1].reshape(height, 3 * width)
    start = 54 + palette.size
    head = struct.pack("<2sIHHI", b"BM", start + rows.size, 0, 0, start)
    return head + struct.pack("<IiiHHIIiiII", 40, width, height, 1, bits, 0, rows.size, 2835, 2835, len(palette), 0) + palette.tobytes() + rows.tobytes()


def decode_netpbm(data: bytes) -> tuple[np.ndarray, int]:
    """P1 to P6 as (height, width) or (height, width, 3), samples as stored, and the sample maximum; P1 and P4 give 0 for
    black and 1 for white."""
    if not (m := HEADER.match(data)):
        raise ValueError("not a Netpbm image")
    kind, width, height = int(m[1]), int(m[2]), int(m[3])
    at, most = m.end(), 1
    if kind not in (1, 4):
        if not (d := DEPTH.match(data, at)):
            raise ValueError("no sample maximum")
        at, most = d.end(), int(d[1])
        if not 1 <= most <= 65535:
            raise ValueError("sample maximum out of range")
    planes = 3 if kind in (3, 6) else 1
    count = width * height * planes
    if count > 8 * len(data):
        raise ValueError("too few samples")
    if kind in (1, 2, 3):
        body = re.sub(rb"#[^\n]*", b"", data[at:])
        flat = np.array([int(c) for c in (re.findall(rb"[01]", body) if kind == 1 else body.split())[:count]], np.int64)
    elif kind == 4:
        stride = (width + 7) // 8
        bits = np.frombuffer(data, np.uint8, stride * height, at + 1).reshape(height, stride)
        flat = np.unpackbits(bits, axis=1)[:, :width].ravel()
    else:
        flat = np.frombuffer(data, np.uint8 if most < 256 else ">u2", count, at + 1)
    if len(flat) < count:
        raise ValueError("too few samples")
    if count and (flat.min() < 0 or flat.max() > most):
        raise ValueError("samples out of range")
    if kind in (1, 2, 3):
        flat = flat.astype(np.uint8 if most < 256 else ">u2")
    if kind in (1, 4):
        flat = 1 - flat
    return flat.reshape((height, width, 3) if planes == 3 else (height, width)), most


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 bits (by its palette; one plane if that is the ramp of all greys), 24 or 32 bits, in RGB."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not a BMP image")
    start, head, width, height = struct.unpack_from("<IIii", data, 10)
    bits, packing = struct.unpack_from("<HI", data, 28)
    if packing or bits not in (8, 24, 32) or width < 0:
        raise ValueError("unsupported BMP")
    stride = (width * bits // 8 + 3) // 4 * 4
    if stride * abs(height) > len(data):
        raise ValueError("too few samples")
    rows = np.frombuffer(data, np.uint8, stride * abs(height), start).reshape(abs(height), stride)
    rows = rows[:, : width * bits // 8]
    if height > 0:
        rows = rows[::-1]
    if bits == 8:
        colours = (start - 14 - head) // 4
        if colours < 1:
            raise ValueError("no palette")
        palette = np.frombuffer(data, np.uint8, 4 * colours, 14 + head).reshape(-1, 4)[:, 2::-1]
        if colours == 256 and (palette == np.arange(256)[:, None]).all():
            return rows
        return palette[rows]
    return rows.reshape(abs(height), width, bits // 8)[:, :, 2::-1]


def decode(data: bytes) -> tuple[np.ndarray, int]:
    """The samples and their maximum."""
    return (decode_bmp(data), 255) if data[:2] == b"BM" else decode_netpbm(data)


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over the areas of the target's cells, by an integral image."""
    h, w = image.shape
    def at(n: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
        border = np.arange(cells + 1) * n / cells
        low = np.minimum(border.astype(np.int64), n - 1)
        return low, border - low

    (r, fr), (c, fc) = at(h, height), at(w, width)
    # the integral image's rows at borders; the others are passed through in bands
    wanted = np.unique(np.concatenate([r, r + 1]))
    total, carry = np.zeros((len(wanted), w + 1)), np.zeros(w)
    band = max(1, BAND // max(w, 1))
    for lo in range(0, h, band):
        sums = np.cumsum(image[lo : lo + band], axis=0, dtype=np.float64) + carry
        here = (wanted > lo) & (wanted <= lo + len(sums))
        total[here, 1:] = sums[wanted[here] - lo - 1]
        carry = sums[-1]
    np.cumsum(total, axis=1, out=total)
    low, high = (np.searchsorted(wanted, x) for x in (r, r + 1))
    rows = total[low] * (1 - fr[:, None]) + total[high] * fr[:, None]
    both = rows[:, c] * (1 - fc) + rows[:, c + 1] * fc
    return np.diff(np.diff(both, axis=0), axis=1) * (height * width / (h * w))


def difference_hash(image: np.ndarray) -> int:
    """64 bits: whether each of 8 x 9 cells is darker than its right neighbour."""
    small = np.round(area_resize(image, 8, 9), 6)
    return int.from_bytes(np.packbits(small[:, :-1] < small[:, 1:]).tobytes(), "big")


def npy(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, tile, allow_pickle=False)
    return out.getvalue()


def tile_of(image: np.ndarray, side: int = 16, most: int = 255) -> bytes:
    """A square tile of 8-bit samples in NPY format, from samples of up to `most`."""
    return npy(np.clip(np.rint(area_resize(image, side, side) * (255 / most)), 0, 255).astype(np.uint8))


def store_texts(docs: DataFrame, *, text: str = "text", key: str = "doc_id", with_bmp: bool = False) -> DataFrame:
    """Each whole text as UTF-8, padded with bytes 0 to a positive multiple of 64 and stored as a PGM image 64 samples wide.

    Returns key, n_bytes (unpadded) and media (binary); with `with_bmp` also bmp, the same samples as an 8-bit grey BMP.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, media, bmp = [], [], []
        for t in batch.column(1).to_pylist():
            raw = t.encode()
            n.append(len(raw))
            padded = np.frombuffer(raw.ljust(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH), b"\0"), np.uint8).reshape(-1, WIDTH)
            media.append(encode_pgm(padded))
            if with_bmp:
                bmp.append(encode_bmp(padded))
        columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(media, pa.binary()), *([pa.array(bmp, pa.binary())] if with_bmp else [])]
        return pa.RecordBatch.from_arrays(columns, [key, "n_bytes", "media", "bmp"][: len(columns)])

    kind = docs.schema[key].dataType.simpleString()
    return map_arrow(docs.select(F.col(key), text_or_empty(text).alias("text")), run, f"`{key}` {kind}, n_bytes long, media binary" + (", bmp binary" if with_bmp else ""))


RESULTS = {
    "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "dhash": "string", "tile_npy": "binary",
}


def features(images: DataFrame, *, media: str = "media", side: int = 16, keep_media: bool = True, prefix: str = "") -> DataFrame:
    """Decode each image (Netpbm or BMP) and add what is read from it.

    Adds, with `prefix` before their names, payload_bytes and payload_sha256 (of the samples as stored), tail_crc32 (of the last
    64 bytes), media_bytes, media_sha256, dhash (16 hexadecimal digits) and tile_npy (an NPY tile of side x side grey levels).
    All are null for a null image; all but media_bytes and media_sha256 also for one that can't be decoded or has no samples.
    """
    names = [prefix + n for n in RESULTS]
    kept = [c for c in images.columns if c not in names and (keep_media or c != media)]

    def row(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 7
        stored = len(data), hashlib.sha256(data).hexdigest()
        try:
            image, most = decode(data)
            if not image.size:
                raise ValueError("no samples")
        except (ValueError, IndexError, OverflowError, struct.error):
            return None, None, None, *stored, None, None
        payload, g = image.tobytes(), grey(image)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), *stored, f"{difference_hash(g):016x}", tile_of(g, side, most)

    types = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t] for t in RESULTS.values()]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [row(x.as_py()) for x in batch.column(0)]
        made = [pa.array(list(x), kind) for x, kind in zip(zip(*rows, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays([*batch.columns[1:], *made], [*(f"c{i}" for i in range(len(kept))), *RESULTS])

    schema = ", ".join([*(f"c{i} {images.schema[c].dataType.simpleString()}" for i, c in enumerate(kept)), *(f"{n} {t}" for n, t in RESULTS.items())])
    source = images.select(F.col(media).alias("media"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(kept)))
    return map_arrow(source, run, schema).toDF(*kept, *names)
