"""Keys and counts that parts of a corpus exchange, packed.

A part sends its sorted distinct 64-bit hashes to buckets, each of which has an equal range of them;
answers come back in the order of the keys, so without them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(sorted distinct keys, the place of each among them)``."""
    by = np.argsort(key)
    key = key[by]
    head = np.append(True, key[1:] != key[:-1])[: len(key)]
    at = np.empty(len(key), np.int64)
    at[by] = np.cumsum(head) - 1
    return key[head], at


def edge(bucket: int, n_buckets: int) -> int:
    """The least key of a bucket: buckets are equal parts of all 64-bit numbers."""
    return -(-(bucket << 64) // n_buckets)


def dealt(key: np.ndarray, n_buckets: int) -> Iterator[tuple[int, slice]]:
    """Each bucket of sorted keys and where they stand."""
    at = np.searchsorted(key, np.array([edge(b, n_buckets) for b in range(n_buckets)], np.uint64))
    at = np.append(at, len(key))
    for b in np.flatnonzero(np.diff(at)):
        yield int(b), slice(int(at[b]), int(at[b + 1]))


def packed(key: np.ndarray, bucket: int, n_buckets: int) -> bytes:
    """Sorted keys of a bucket: their differences byte by byte, the zeros of the high ones together."""
    return planes(np.diff(key, prepend=np.uint64(edge(bucket, n_buckets))))


def unpacked(data: pa.Buffer, bucket: int, n_buckets: int) -> np.ndarray:
    return np.cumsum(of_planes(data).view(np.uint64), dtype=np.uint64) + np.uint64(edge(bucket, n_buckets))


def packed_counts(n: np.ndarray) -> bytes:
    """Whole numbers from 0 on: a byte each, those from 255 on in eight more at the end."""
    large = n >= 255
    return np.where(large, 255, n).astype(np.uint8).tobytes() + n[large].astype(np.uint64).tobytes()


def unpacked_counts(data: pa.Buffer, size: int) -> np.ndarray:
    out = np.frombuffer(data, np.uint8, size).astype(np.int64)
    large = np.flatnonzero(out == 255)
    out[large] = np.frombuffer(data, np.uint64, len(large), size) if len(large) else 0
    return out


def planes(x: np.ndarray) -> bytes:
    """Eight-byte numbers byte by byte: what is alike in them stands together."""
    return x.view(np.uint8).reshape(-1, 8).T.tobytes()


def of_planes(data: pa.Buffer) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.float64).ravel()


def arrow_table(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])
