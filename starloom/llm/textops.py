"""Vectorised text primitives over Arrow string columns.

Work is done on UTF-8 bytes of many rows at once: short rows in slices of about half a
megabyte, and the bytes of a longer text in windows. What is kept for a whole text is a few
numbers for each of its words, so a very long one takes some 10 bytes for each of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE, _GOLDEN = 0x9FB21C651E98DF25, 0x9E3779B97F4A7C15
#: Bytes (or words) that are worked on at a time.
WINDOW = 1 << 18
_tables: dict[int, np.ndarray] = {}

#: Letters, digits, underscore and every byte of a non-ASCII character.
WORD = np.zeros(256, bool)
WORD[[*b"0123456789_abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = True
WORD[128:] = True
#: The complement of the six ASCII white-space bytes.
SOLID = np.ones(256, bool)
SOLID[[0x20, 9, 10, 11, 12, 13]] = False


def splitmix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixer, elementwise."""
    z = x.astype(U64, copy=True)
    z += U64(_GOLDEN)
    z ^= z >> U64(30)
    z *= U64(0xBF58476D1CE4E5B9)
    z ^= z >> U64(27)
    z *= U64(0x94D049BB133111EB)
    z ^= z >> U64(31)
    return z


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64; kept for the sizes of a window only."""
    got = _tables.get(base)
    if got is None or len(got) < n:
        got = np.full(max(n, 2 * WINDOW), base, U64)
        got[0] = 1
        got = np.cumprod(got, dtype=U64)
        if len(got) <= 2 * WINDOW:
            _tables[base] = got
    return got[:n]


def slices(col: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes of text; a longer text stands alone."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0), np.int64)
    at, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > most or i - at >= 4096:
            yield at, i
            at, held = i, 0
        held += size
    if at < len(sizes):
        yield at, len(sizes)


def as_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end and where each begins; null counts as empty."""
    col = pc.fill_null(col, "").cast(pa.large_string())
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = col.buffers()
    offsets = np.frombuffer(at, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(buf: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of bytes of the kind; no run crosses rows."""
    n = len(buf)
    starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for w in range(0, n, WINDOW):
        z = min(n, w + WINDOW)
        inside = kind[buf[w:z]]
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        opens[0] &= not (w and kind[buf[w - 1]])
        closes[-1] &= not (z < n and kind[buf[z]])
        i, j = np.searchsorted(offsets, (w, z))
        first = offsets[i:j] - w
        opens[first] = inside[first]
        i, j = np.searchsorted(offsets, (w + 1, z + 1))
        last = offsets[i:j] - 1 - w
        closes[last] = inside[last]
        starts.append(np.flatnonzero(opens) + w)
        ends.append(np.flatnonzero(closes) + w + 1)
    start = np.concatenate(starts)
    return start, np.concatenate(ends), np.searchsorted(offsets, start, side="right") - 1


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each of some ascending, disjoint spans, the same wherever it stands."""
    out = np.zeros(len(starts), U64)
    up, down = powers(_BASE, WINDOW), powers(pow(_BASE, -1, 1 << 64), WINDOW + 1)
    for w in range(0, len(buf), WINDOW):
        z = min(len(buf), w + WINDOW)
        i, j = np.searchsorted(ends, w, side="right"), np.searchsorted(starts, z)
        if i >= j:
            continue
        total = np.zeros(z - w + 1, U64)
        np.cumsum((buf[w:z].astype(U64) + U64(1)) * up[: z - w], dtype=U64, out=total[1:])
        a, b = np.maximum(starts[i:j] - w, 0), np.minimum(ends[i:j], z) - w
        value = (total[b] - total[a]) * down[a]
        if starts[i] < w:  # what stands in this window of a span that began before it
            value[:1] *= U64(pow(_BASE, int(w - starts[i]), 1 << 64))
        out[i:j] += value
    return splitmix(out + (ends - starts).astype(U64) * U64(_GOLDEN))


def range_hashes(values: np.ndarray, base: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A polynomial hash of values[a:b] for each pair, a ascending; ranges may overlap."""
    out = np.zeros(len(a), U64)
    for i in range(0, len(a), WINDOW):
        x, y = a[i : i + WINDOW], b[i : i + WINDOW]
        low, high = int(x[0]), int(y.max())
        total = np.zeros(high - low + 1, U64)
        np.cumsum(values[low:high] * powers(base, high - low), dtype=U64, out=total[1:])
        out[i : i + WINDOW] = (total[y - low] - total[x - low]) * powers(pow(base, -1, 1 << 64), high - low + 1)[x - low]
    return out


def words(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all rows, and the position of each row's first word."""
    buf, offsets = as_bytes(pc.utf8_lower(pc.fill_null(col, "")))
    starts, ends, _ = runs(buf, offsets, WORD)
    return hashes(buf, starts, ends), np.searchsorted(starts, offsets)


def ngrams(tokens: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of n tokens and where each row's begin; a row of 1 to n-1 tokens has one, of all."""
    counts = np.diff(first)
    made = np.where(counts >= n, counts - n + 1, (counts > 0).astype(counts.dtype))
    at = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(made, out=at[1:])
    row = np.repeat(np.arange(len(counts)), made)
    start = first[:-1][row] + (np.arange(at[-1]) - at[:-1][row])
    out = np.zeros(len(start), U64)
    ext = np.concatenate([tokens, np.zeros(n, U64)])
    left = first[1:][row] - start
    for k in range(n):
        out *= U64(0xD6E8FEB86659FD93)
        out += np.where(left > k, ext[start + k], U64(0))
    return splitmix(out + np.minimum(left, n).astype(U64)), at


def strings(batch: pa.RecordBatch, name: str) -> pa.Array:
    col = batch.column(batch.schema.get_field_index(name))
    return pc.fill_null(col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col, "")
