"""A Bloom filter over 64-bit ids, as a cheap semi-join before a shuffle.

It only keeps needless rows from a shuffle: what it lets through is joined
exactly afterwards, so its size never changes a result.  The size follows the
number of ids, up to 2**27 bits (16 MB), which bounds the broadcast; with more
ids than that fits it lets more rows through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._lean import lean
from ._words import mix64

_U = np.uint64


def _places(ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix64(ids.astype(np.int64).view(_U) + _U(1))
    mask = _U(size - 1)
    return h & mask, (h >> _U(32)) & mask


class Bitmap:
    """The filter in a task; holds the packed bits only."""

    def __init__(self, raw: bytes):
        self.words = np.frombuffer(raw, _U)

    def has(self, ids: np.ndarray) -> np.ndarray:
        out = np.ones(len(ids), bool)
        for place in _places(ids, 64 * len(self.words)):
            out &= (self.words[(place >> _U(6)).astype(np.int64)] >> (place & _U(63)) & _U(1)).astype(bool)
        return out


def member_bitmap(ids: DataFrame):
    """The filter over the one column of ids, sent to all executors: its bytes, for Bitmap()."""
    spark = ids.sparkSession
    bits = min(27, max(16, int(np.ceil(np.log2(16 * max(1, ids.count()))))))

    @lean
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            if batch.num_rows:
                place = np.concatenate(_places(batch.column(0).to_numpy(), 1 << bits))
                place = np.sort(place)
                at = (place >> _U(6)).astype(np.int64)
                first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                word = np.bitwise_or.reduceat(_U(1) << (place & _U(63)), first)
                yield pa.RecordBatch.from_arrays([pa.array(at[first]), pa.array(word.view(np.int64))], ["at", "word"])

    # 2**21 words at most, whatever the number of ids.
    found = ids.mapInArrow(run, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    words = np.zeros((1 << bits) // 64, np.int64)
    words[found.column("at").to_numpy()] = found.column("word").to_numpy()
    return spark.sparkContext.broadcast(words.tobytes())
