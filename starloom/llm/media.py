"""Op 9. Media columns: Netpbm and BMP decoded to arrays, area-resized, tiled as NPY.

Defined results: a null text counts as empty; an empty text is one block of padding;
repeated rows give repeated results; other columns of the input are ignored, whatever
their names; an empty table gives an empty result. A null media value decodes to null
tiles, and bytes that are no supported image do so as well, with the reason in `error`.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import store, textops

BLOCK = 576
PAD = b"\xff"
#: Samples of an image that are summed at a time.
STRIP = 1 << 18


def encode_pgm(payload: bytes, width: int = 24) -> bytes:
    return b"P5\n%d %d\n255\n" % (width, len(payload) // width) + payload


def encode_ppm(payload: bytes, width: int = 24) -> bytes:
    return b"P6\n%d %d\n255\n" % (width, len(payload) // (3 * width)) + payload


def encode_bmp(payload: bytes, width: int = 24) -> bytes:
    """24-bit rows, bottom up; the width keeps rows a multiple of four bytes, so none is padded."""
    height = len(payload) // (3 * width)
    rows = np.frombuffer(payload, np.uint8).reshape(height, width, 3)[::-1, :, ::-1]
    head = b"BM" + struct.pack("<IHHI", 54 + len(payload), 0, 0, 54)
    info = struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, len(payload), 2835, 2835, 0, 0)
    return head + info + rows.tobytes()


ENCODERS = (encode_pgm, encode_ppm, encode_bmp)


def _token(data: bytes, at: int) -> tuple[bytes, int]:
    """The next token of a Netpbm header, after white space and comments, and where it ends."""
    while True:
        while at < len(data) and data[at] in b" \t\n\v\f\r":
            at += 1
        if data[at : at + 1] != b"#":
            break
        end = data.find(b"\n", at)
        at = len(data) if end < 0 else end + 1
    end = at
    while end < len(data) and data[end] not in b" \t\n\v\f\r#":
        end += 1
    return data[at:end], end


def _netpbm(data: bytes) -> np.ndarray:
    kind = data[:2]
    sizes, at = [], 2
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        word, at = _token(data, at)
        sizes.append(int(word))
    width, height, top = *sizes[:2], (sizes[2] if len(sizes) > 2 else 1)
    if not (0 < width and 0 < height and 0 < top < 65536):
        raise ValueError("netpbm: bad sizes")
    planes = 3 if kind in (b"P3", b"P6") else 1
    n = width * height * planes
    # a sample takes a bit at least
    if n > 8 * len(data):
        raise ValueError("netpbm: data cut short")
    if kind in (b"P1", b"P2", b"P3"):
        body = b"\n".join(line.split(b"#", 1)[0] for line in data[at:].split(b"\n"))
        got = np.array([c - 48 for c in body if c in b"01"] if kind == b"P1" else body.split(), np.int64)
    elif kind == b"P4":
        packed = np.frombuffer(data, np.uint8, height * ((width + 7) // 8), at + 1)
        got = np.unpackbits(packed.reshape(height, -1), axis=1)[:, :width].ravel().astype(np.int64)
    else:
        got = np.frombuffer(data, np.uint8 if top < 256 else ">u2", n, at + 1)
    if len(got) < n:
        raise ValueError("netpbm: data cut short")
    got = got[:n]
    if kind in (b"P1", b"P4"):
        got = (1 - got) * 255
    elif top != 255:
        got = got.astype(np.int64) * 255 // top
    return got.astype(np.uint8).reshape(height, width, planes)


def _bmp(data: bytes) -> np.ndarray:
    start, head = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    width, height, _, bits, packing = struct.unpack_from("<iiHHI", data, 18)
    if packing or bits not in (8, 24, 32) or width <= 0 or not height:
        raise ValueError(f"bmp: {bits} bits with compression {packing} is not supported")
    tall, row = abs(height), (width * bits // 8 + 3) // 4 * 4
    if tall * row > len(data):
        raise ValueError("bmp: data cut short")
    got = np.frombuffer(data, np.uint8, tall * row, start).reshape(tall, row)[:, : width * bits // 8]
    if bits == 8:
        colours = struct.unpack_from("<I", data, 46)[0] or 256
        table = np.frombuffer(data, np.uint8, 4 * colours, 14 + head).reshape(-1, 4)
        got = table[got][:, :, 2::-1]
    else:
        got = got.reshape(tall, width, bits // 8)[:, :, 2::-1]
    return got[::-1] if height > 0 else got


def decode(data: bytes) -> np.ndarray:
    """Rows x columns x planes of 8-bit samples. ValueError for anything else."""
    try:
        if data[:2] == b"BM":
            return _bmp(data)
        if data[:1] == b"P" and data[1:2] in b"123456" and len(data) > 2:
            return _netpbm(data)
    except (struct.error, IndexError, OverflowError) as why:
        raise ValueError(str(why)) from why
    raise ValueError("neither Netpbm nor BMP")


def integral_rows(pixels: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Some rows of the integral image: sums of all samples above each of the ascending places and to the left.

    The image is read in strips, so that what is kept is a strip and the rows asked for.
    """
    tall, wide, planes = pixels.shape
    out = np.zeros((len(places), wide + 1, planes))
    above, strip = np.zeros((wide + 1, planes)), max(1, STRIP // (wide * planes))
    for y in range(0, tall, strip):
        part = pixels[y : y + strip]
        total = np.zeros((len(part) + 1, wide + 1, planes))
        np.cumsum(part, axis=1, dtype=np.float64, out=total[1:, 1:])
        total[0] = above
        flat = total.reshape(len(total), -1)
        np.cumsum(flat, axis=0, out=flat)
        i, j = np.searchsorted(places, y), np.searchsorted(places, y + len(part), side="right")
        out[i:j] = total[places[i:j] - y]
        above = total[-1]
    return out


def _places(size: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n + 1 even, fractional places from 0 to size: whole parts (below size), and the rest."""
    at = np.arange(n + 1) * (size / n)
    low = np.minimum(at.astype(np.int64), size - 1)
    return low, at - low


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each target cell's exact area, from the integral image taken at fractional places."""
    tall, wide = pixels.shape[:2]
    low, part = _places(tall, height)
    need = np.unique(np.concatenate([low, low + 1]))
    total = integral_rows(pixels, need)
    upper, lower = total[np.searchsorted(need, low + 1)], total[np.searchsorted(need, low)]
    rows = np.diff(lower + (upper - lower) * part[:, None, None], axis=0)
    low, part = _places(wide, width)
    both = rows[:, low] + (rows[:, low + 1] - rows[:, low]) * part[None, :, None]
    cells = np.diff(both, axis=1) * (height * width / (tall * wide))
    return (cells + 0.5).astype(np.uint8)


def difference_hash(pixels: np.ndarray) -> str:
    """64 bits: whether each cell of an 8 x 9 grey reduction is darker than its right neighbour."""
    grey = area_resize(pixels, 8, 9)
    grey = grey[:, :, 0] if grey.shape[2] == 1 else grey @ np.array((299, 587, 114))
    return np.packbits(grey[:, :-1] < grey[:, 1:]).tobytes().hex()


def npy(tile: np.ndarray) -> bytes:
    """The tile as a version 1.0 NPY file."""
    head = f"{{'descr': '{tile.dtype.str}', 'fortran_order': False, 'shape': {tile.shape}, }}"
    head += " " * (-(len(head) + 11) % 64) + "\n"
    return b"\x93NUMPY\x01\x00" + struct.pack("<H", len(head)) + head.encode("latin1") + np.ascontiguousarray(tile).tobytes()


def as_image(text: bytes) -> bytes:
    """The text's bytes, padded, as an image whose format follows from their number of blocks."""
    payload = text + PAD * (-len(text) % BLOCK or BLOCK * (not text))
    return ENCODERS[len(payload) // BLOCK % 3](payload)


def decode_media(df: DataFrame, id_col: str, media_col: str, height: int = 16, width: int = 16) -> DataFrame:
    """Per media value: id, height, width, planes, an NPY tile of the given size, difference hash, error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column(1):
                try:
                    if (raw := data.as_py()) is None:
                        rows.append((None,) * 6)
                        continue
                    got = decode(raw)
                    rows.append((*got.shape, npy(area_resize(got, height, width)), difference_hash(got), None))
                except ValueError as why:
                    rows.append((None,) * 5 + (str(why)[:200],))
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string())
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["id", "height", "width", "planes", "tile", "dhash", "error"])

    kind = df.schema[id_col].dataType.simpleString()
    return store.mapped(df.select(df[id_col].alias("id"), df[media_col].alias("media")), run, f"id {kind}, height int, width int, planes int, tile binary, dhash string, error string")


def text_media(docs: DataFrame) -> DataFrame:
    """Every text stored as an image: doc_id, n_bytes, media (the stored bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = textops.strings(batch, "text")
            for a, b in textops.slices(texts, 8 << 20):
                raw = [x.as_buffer().to_pybytes() for x in texts[a:b]]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array([len(x) for x in raw], pa.int64()), pa.array([as_image(x) for x in raw], pa.large_binary()).cast(pa.binary())], names=["doc_id", "n_bytes", "media"])

    return store.mapped(docs.select("doc_id", "text"), run, "doc_id long, n_bytes long, media binary")


FIELDS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_sha256 string"


def media_digest(docs: DataFrame) -> DataFrame:
    """Stores every text as an image, reads the stored bytes back and digests what was read."""

    def row(text: bytes) -> tuple:
        media = as_image(text)
        got = decode(media)
        payload = np.ascontiguousarray(got)
        tile = npy(area_resize(got, 16, 16))
        tail = zlib.crc32(payload.reshape(-1)[-32:])
        return len(text), payload.nbytes, hashlib.sha256(payload).hexdigest(), tail, len(media), hashlib.sha256(media).hexdigest(), difference_hash(got), hashlib.sha256(tile).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row(x.as_buffer().to_pybytes()) for x in textops.strings(batch, "text")]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 8, kinds))], names=[f.split()[0] for f in FIELDS.split(", ")])

    return store.mapped(docs.select("doc_id", "text"), run, FIELDS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
