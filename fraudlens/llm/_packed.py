"""Packed integer columns: arrays that travel through a shuffle as compressed binary values."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64


def pack(values: np.ndarray) -> bytes:
    """Bytes of an integer array, planes of equal significance together, compressed."""
    a = np.ascontiguousarray(values)
    if not len(a):
        return b"\0\0\0\0"
    planes = a.view(np.uint8).reshape(len(a), a.itemsize).T
    return len(a).to_bytes(4, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes, kind: type) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    if not n:
        return np.zeros(0, kind)
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data[4:], decompressed_size=n * size, codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).reshape(n)


def pack_sorted(values: np.ndarray) -> bytes:
    """pack() of the steps between ascending 64-bit integers."""
    v = values.astype(np.int64)
    return pack(np.diff(v, prepend=np.int64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.int64))


def runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """(from, to) of each run of equal values."""
    if len(values):
        cuts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]).tolist()
        yield from zip(cuts, [*cuts[1:], len(values)])


def leads(*columns: np.ndarray) -> np.ndarray:
    """For rows sorted by the columns: the index of the first row of each row's run."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(n), 0)) if n else np.zeros(0, np.int64)


def record_batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 256) -> Iterator[pa.RecordBatch]:
    some: list[tuple] = []
    for row in rows:
        some.append(row)
        if len(some) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), schema.types)], schema=schema)
            some = []
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), schema.types)], schema=schema)


def spread(ids: np.ndarray, n: int) -> np.ndarray:
    """A number below n for each integer, evenly dealt."""
    h = ids.astype(np.int64).view(_U) * _U(0x9E3779B97F4A7C15)
    return ((h >> _U(33)) % _U(n)).astype(np.int32)
