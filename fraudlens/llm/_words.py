"""Vectorised word hashing over Arrow text columns.

Every function here works on whole texts.  A text is split into words on the
six ASCII blanks (space and 0x09-0x0D); each word gets a 64-bit polynomial
(Rabin-Karp) hash of its bytes, read off prefix sums, so no Python loop runs
per word or per document.  Texts are processed in blocks of a few MB that end
between words, which bounds the working memory whatever the text length; only
a single word longer than a block makes a block longer.

Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_BLOCK = 1 << 20
_MASK = (1 << 64) - 1


def _splitmix(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & _MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit values."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class Hasher:
    """Byte-polynomial word hashes; two hashers of other seeds are independent."""

    def __init__(self, seed: int = 1, lower: bool = False, block: int = _BLOCK):
        self.block = block
        self.table = np.array([_splitmix(seed * 1000 + b) for b in range(256)], dtype=_U)
        if lower:
            self.table[65:91] = self.table[97:123]
        self.p = (_splitmix(seed + 77) & ~7 & _MASK) | 3
        self.ip = pow(self.p, -1, 1 << 64)
        self.pw = self.ipw = np.ones(1, dtype=_U)

    def _powers(self, n: int) -> None:
        if len(self.pw) >= n:
            return
        for name, base in (("pw", self.p), ("ipw", self.ip)):
            out = np.ones(n, dtype=_U)
            k = 1
            while k < n:
                m = min(k, n - k)
                out[k : k + m] = out[:m] * _U(pow(base, k, 1 << 64))
                k += m
            setattr(self, name, out)

    def hash(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of data[start:end] for ascending, non-overlapping ranges, block by block."""
        out = np.empty(len(start), dtype=_U)
        i, n = 0, len(start)
        while i < n:
            lo = int(start[i])
            j = int(np.searchsorted(end, lo + self.block, side="right"))
            j = max(j, i + 1)
            hi = int(end[j - 1])
            self._powers(hi - lo + 1)
            acc = self.table[data[lo:hi]]
            acc *= self.pw[: hi - lo]
            sums = np.empty(hi - lo + 1, dtype=_U)
            sums[0] = 0
            np.cumsum(acc, out=sums[1:])
            s, e = start[i:j] - lo, end[i:j] - lo
            h = (sums[e] - sums[s]) * self.ipw[s]
            h += (e - s).astype(_U) * _U(0x9E3779B97F4A7C15)
            out[i:j] = mix64(h)
            i = j
        return out


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; offsets has one entry more than rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # no or many chunks
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, off


#: Bytes of words between blanks, and bytes of words of letters and digits (all beyond ASCII count as letters).
NOT_BLANK = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])
LETTERS = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def word_bounds(data: np.ndarray, off: np.ndarray, table: np.ndarray = NOT_BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): byte ranges of all words, and for each text the index of its first word (plus the total)."""
    lo, hi = int(off[0]), int(off[-1])
    starts, ends = [], []
    cuts = off[1:-1]
    at = lo
    carry = False  # whether the byte before `at` belongs to a word of the same text
    while at < hi:
        to = min(hi, at + 4 * _BLOCK)
        word = table[data[at:to]]
        before = np.empty(len(word), dtype=bool)
        before[1:] = word[:-1]
        before[0] = carry
        inside = cuts[(cuts >= at) & (cuts < to)] - at
        first = word & ~before
        last = ~word & before
        s = np.flatnonzero(first) + at
        e = np.flatnonzero(last) + at
        # A word that runs over the end of a text is cut there.
        glued = distinct(inside[word[inside] & before[inside]]) + at  # empty texts repeat a border
        if len(glued):
            s = np.insert(s, np.searchsorted(s, glued), glued)
            e = np.insert(e, np.searchsorted(e, glued), glued)
        starts.append(s)
        ends.append(e)
        carry = bool(word[-1])
        at = to
    if carry:
        ends.append(np.array([hi]))
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
    return start, end, np.searchsorted(start, off, side="left")


def distinct(values: np.ndarray) -> np.ndarray:
    """The different values, ascending; np.unique hashes first, which is slower on many different values."""
    values = np.sort(values)
    if len(values) > 1:
        values = values[np.r_[True, values[1:] != values[:-1]]]
    return values


def windows(h: np.ndarray, first: np.ndarray, n: int, base: int = 0xD6E8FEB86659FD93) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hashes of all windows of n words within one text.

    Returns (hash, index of the window's first word).  Windows over text
    borders are left out.  The rolling polynomial is built by doubling.
    """
    if len(h) < n:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    p, out, have, part, size = base, None, 0, h, 1
    todo = n
    with np.errstate(over="ignore"):
        while todo:
            if todo & 1:
                if out is None:
                    out, have = part, size
                else:
                    m = len(h) - have - size + 1
                    out = out[:m] * _U(pow(p, size, 1 << 64)) + part[have : have + m]
                    have += size
            todo >>= 1
            if todo:
                m = max(0, len(part) - size)
                part = part[:m] * _U(pow(p, size, 1 << 64)) + part[size : size + m]
                size *= 2
    counts = np.diff(first)
    doc = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(out))
    ok = doc[at] == doc[at + n - 1]
    return mix64(out[ok]), at[ok]


def with_fields(df, **fields: str):
    """The schema of df with fields added; unlike StructType.add it leaves df's own schema alone."""
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    return StructType([*df.schema.fields, *(StructField(k, _parse_datatype_string(v)) for k, v in fields.items())])


def batches(rows: Iterator[pa.RecordBatch], most: int = 8 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts add up to about `most` bytes; a longer text is a slice of its own."""
    for batch in rows:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        total = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = int(total[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(total, done + most, side="right")))
            yield batch.slice(at, to - at)
            at = to
