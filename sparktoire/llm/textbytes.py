"""Whole-batch text primitives on the UTF-8 bytes of an Arrow column.

A batch of texts is one byte array plus document offsets. Words are runs of bytes outside
``[\\x20\\x09-\\x0D]``; each gets a 64-bit hash computed for the whole batch at once, so no Python
code runs per word. Nulls count as empty texts.

``span_hashes`` mixes eight bytes at a time, so no structure of the bytes makes hashes meet: spans
of one length up to 8 bytes never do, others with the chance of random numbers. ``span_numbers``
compares the bytes themselves. ``rolling_hashes`` are polynomials, cheap for spans that overlap, but
there are texts that they confuse: they only say where to look.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 4 << 20
_SEED = np.random.default_rng(20240607)
_TABLE = _SEED.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
ODD = _SEED.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


_BLOCK = 1 << 18


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_LOW, _LOW_INVERSE = _powers(_BASE, _BLOCK), _powers(_INVERSE, _BLOCK)


def _high(base: int, n: int) -> np.ndarray:
    """Powers of the base at the beginnings of the blocks of ``n`` bytes."""
    return np.array([pow(base, k * _BLOCK, 1 << 64) for k in range(n // _BLOCK + 1)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that any of their bits can be used."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield ``(first row, last row + 1, bytes, offsets)`` of about ``most`` bytes, whole rows only."""
    col = batch.column(batch.schema.get_field_index(column))
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = pc.cast(col, pa.large_string())
    if col.null_count:
        col = pc.fill_null(col, "")
    n = len(col)
    if not n:
        return
    offsets = np.frombuffer(col.buffers()[1], np.int64, n + 1, col.offset * 8)
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        end = min(end, n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


_BYTES_OF_BLOCK = 64
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_LENGTH, _LANE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans; equal bytes give equal hashes wherever they stand.

    A span of several blocks is the hash of its blocks' hashes.
    """
    size = ends - starts
    out = mix(size.astype(np.uint64) * _LENGTH + np.uint64(1))
    if not len(starts):
        return out
    short = size <= _BYTES_OF_BLOCK
    if not short.all():
        long = np.flatnonzero(~short)
        n = -(-size[long] // _BYTES_OF_BLOCK)
        edge = np.append(0, np.cumsum(n))
        begin = np.repeat(starts[long] - edge[:-1] * _BYTES_OF_BLOCK, n) + np.arange(edge[-1]) * _BYTES_OF_BLOCK
        blocks = span_hashes(buf, begin, np.minimum(begin + _BYTES_OF_BLOCK, np.repeat(ends[long], n)))
        out[long] = mix(out[long] ^ span_hashes(blocks.view(np.uint8), edge[:-1] * 8, edge[1:] * 8))
    lanes = np.ndarray((len(buf) + 1,), "<u8", np.append(buf, np.zeros(8, np.uint8)), strides=(1,))
    some = None if short.all() else np.flatnonzero(short)
    for at in range(0, _BYTES_OF_BLOCK, 8):
        x = size if some is None else size[some]
        left = np.flatnonzero(x > at)
        if not len(left):
            break
        some = left if some is None else some[left]
        lane = lanes[starts[some] + at] & _KEEP[np.minimum(size[some] - at, 8)]
        out[some] = mix(out[some] ^ lane * _LANE)
    return out


def span_numbers(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """A number for each span: the same for equal bytes, and for these only."""
    size = ends - starts
    _, first, number = np.unique(span_hashes(buf, starts, ends), return_index=True, return_inverse=True)
    model = first[number]
    differs = size != size[model]
    check = np.flatnonzero((model != np.arange(len(model))) & ~differs & (size > 0))
    total = np.append(0, np.cumsum(size[check]))
    at = 0
    while at < len(check):
        end = max(at + 1, int(np.searchsorted(total, total[at] + block, "right")) - 1)
        x, n = check[at:end], size[check[at:end]]
        step = np.arange(total[end] - total[at]) - np.repeat(total[at:end] - total[at], n)
        unlike = buf[np.repeat(starts[x], n) + step] != buf[np.repeat(starts[model[x]], n) + step]
        if unlike.any():
            differs[x] = np.logical_or.reduceat(unlike, total[at:end] - total[at])
        at = end
    others: dict[bytes, int] = {}
    for i in np.flatnonzero(differs):
        number[i] = others.setdefault(buf[starts[i] : ends[i]].tobytes(), len(first) + len(others))
    return number


def rolling_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of the byte spans, from sums over the whole buffer."""
    high, high_inverse = _high(_BASE, len(buf)), _high(_INVERSE, len(buf))
    total = np.zeros(len(buf) + 1, np.uint64)
    for k, at in enumerate(range(0, len(buf), _BLOCK)):
        part = buf[at : at + _BLOCK]
        np.cumsum(_TABLE[part] * _LOW[: len(part)], out=total[at + 1 : at + len(part) + 1])
        total[at + 1 : at + len(part) + 1] *= high[k]
        total[at + 1 : at + len(part) + 1] += total[at]
    shift = _LOW_INVERSE[starts & (_BLOCK - 1)] * high_inverse[starts >> 18]
    return mix((total[ends] - total[starts]) * shift + (ends - starts).astype(np.uint64))


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(starts, ends, first)``: byte spans of all words, and the index of each document's first word."""
    solid = ~IS_SPACE[buf]
    before = np.zeros(len(buf), bool)
    before[1:] = solid[:-1]
    edge = offsets[:-1][offsets[:-1] < len(buf)]
    before[edge] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.zeros(len(buf), bool)
    after[:-1] = solid[1:]
    after[edge[edge > 0] - 1] = False
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def shingle_hashes(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``n``-word windows and each document's first window.

    A document of fewer than ``n`` words, but one at least, has one window: all its words.
    """
    size = np.diff(first)
    count = np.where(size >= n, size - n + 1, np.minimum(size, 1))
    at = np.zeros(len(size) + 1, np.int64)
    np.cumsum(count, out=at[1:])
    where = np.repeat(first[:-1] - at[:-1], count) + np.arange(at[-1])
    padded = np.concatenate([hashes, np.zeros(n, np.uint64)])
    out = np.zeros(at[-1], np.uint64)
    if len(out) and int(size[size > 0].min()) >= n:
        for j in range(n):
            out += padded[where + j] * ODD[j]
    elif len(out):
        left = np.repeat(first[1:], count) - where
        for j in range(n):
            out += np.where(left > j, padded[where + j] * ODD[j], np.uint64(0))
    return mix(out), at
