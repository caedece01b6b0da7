"""Fuzzy line dedup: one line of each group of near-equal lines is kept in the whole corpus.

Lines end at line feeds.  A line is normalised to its words (runs of letters and
digits, A-Z lower-cased) joined by one blank; lines without words are left
alone.  Two lines are linked if their normal forms are equal, or, both having at
least `least` words, if the edit similarity 1 - distance / longer length of
their normal forms is at least `similarity` and they are found as candidates.
Of each connected group the occurrence with the smallest (doc_id, text digest,
line number) stays; all others are removed.

Candidates share a pigeonhole block and differ in at most `bits` of the 128
places of their SimHashes.  Cutting such a SimHash itself into blocks finds few
lines of edit similarity 0.8 (a changed word moves some 14 bits), so the pigeonholes are dealt
out before the majority is taken: a line's features fall by their hash into
BLOCKS blocks, and each block has a hash of its own features.  Lines that differ
in fewer than BLOCKS features have a block in common for certain, others very
likely.  The features are the different words for long lines, in blocks of at
least three; short lines have too few words for that, and take adjacent pairs.
Lines of middle length have both kinds.  What is missed are lines edited in most
of their words; the README has the recall measured.

1. One pass over the texts hashes the lines and sketches them.  The sketches are
   dealt out packed, once for each block, by the block's hash.  What comes out is
   each block's lines that have a candidate in it; no pair is emitted.
2. The places of all lines go the same way, packed, dealt out evenly whatever the
   line; equal lines meet in a grouped minimum.
3. The normal forms of these lines are read again (a bitmap keeps others out) and
   sent to their blocks, where candidates are verified by Myers' bit-parallel
   distance, each pair in the first block that it shares, and none that is
   connected already; see _graph.confirmed() for large blocks.  A few blocks come
   first, as most links show there.
4. Components of the verified links give the groups.  Keys that hold more lines
   than a shuffle partition's share are few, so these meet their lines by a
   broadcast, the others by a join.

A null text stays null, an empty one empty.  Rows are told apart by doc_id and
text: equal ones are the same document and lose the same lines, others of one
doc_id are judged each by itself.  Rows with a null doc_id take no part and keep
all lines.  Texts and lines may have any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ._bitmap import Bitmap, member_bitmap
from ._checkpoint import checkpoint, release, stored
from ._graph import confirmed, connected, pack_edges
from ._lean import lean
from ._packed import pack, pack_sorted, record_batches, runs, unpack, unpack_sorted
from ._words import LETTERS, Hasher, batches, distinct, mix64, text_buffers, word_bounds

_U = np.uint64
_HASHER = Hasher(131, lower=True, block=1 << 16)  # its sums stay in the processor's cache
#: Blocks of each kind of features.
BLOCKS = 12
#: Lines of fewer words than the first number may need blocks of pairs, those of at least the second blocks of words.
#: They overlap so far that lines of edit similarity 0.8 have a kind in common: 24 words are the border.
PAIRS_BELOW, WORDS_FROM = 32, 18
#: Blocks that are looked at first.
EARLY = 3
#: Places of 128 in which the SimHashes of candidates may differ.
BITS = 34


def _lines(column: pa.Array, least: int):
    """For the lines of `least` words: key, text number, line number, slice of words; all words' hashes; and a function for lines' code points."""
    data, off = text_buffers(column)
    start, end, first = word_bounds(data, off, LETTERS)
    words = _HASHER.hash(data, start, end)
    lo, hi = int(off[0]), int(off[-1])
    feeds = np.flatnonzero(data[lo:hi] == 10) + lo
    # A line's first word is the first of a text or the next one after a line feed.
    new = np.zeros(len(words) + 1, bool)
    new[first[:-1]] = new[np.searchsorted(start, feeds)] = True
    at = np.flatnonzero(new[:-1])
    doc = np.searchsorted(off, start[at], side="right") - 1
    line = np.searchsorted(feeds, start[at]) - np.searchsorted(feeds, off[doc])
    n = np.diff(np.r_[at, len(words)])
    if len(at):
        # The position in the line makes the sum depend on the order.
        place = (np.arange(len(words)) - np.repeat(at, n)).astype(_U)
        key = mix64(np.add.reduceat(mix64(words + (place + _U(1)) * _U(0x9E3779B97F4A7C15)), at) + n.astype(_U))
    else:
        key = np.zeros(0, _U)

    def size(at: np.ndarray, n: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(end - start)]
        # Bytes that continue a code point stand in words.
        more = np.flatnonzero(data[lo:hi].view(np.int8) < -64) + lo
        return total[at + n] - total[at] - np.searchsorted(more, end[at + n - 1]) + np.searchsorted(more, start[at]) + n - 1

    enough = n >= least
    return key[enough], doc[enough], line[enough], at[enough], n[enough], words, size


#: Eight counters of 8 bits, each at 1.
_LANES = _U(0x0101010101010101)


def _sets(features: np.ndarray, line: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(40 bits of each different feature, first): the sets of n lines one after another, ascending."""
    both = distinct(line.astype(_U) << _U(40) | features >> _U(24))  # up to 2**24 lines at once
    return both & _U((1 << 40) - 1), np.searchsorted(both, np.arange(n + 1, dtype=_U) << _U(40))


def _majority(feature: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The SimHash of each set, two numbers of 64 bits: the majority of each bit."""
    m = np.diff(first)
    out = np.zeros((len(m), 2), _U)
    if not len(m):
        return out
    most = np.minimum(m >> 1, 255).astype(np.uint8)[:, None, None]
    for half in range(2):
        bits = mix64(feature + _U(1 + 977 * half))
        octets = bits.view(np.uint8).reshape(-1, 8)
        sums = np.empty((len(m), 8), _U)
        for b in range(8):  # this bit of all octets
            sums[:, b] = np.add.reduceat(bits >> _U(b) & _LANES, first[:-1])
        over = sums.view(np.uint8).reshape(-1, 8, 8) > most
        out[:, half] = np.packbits(over.transpose(0, 2, 1).reshape(-1, 64), axis=1, bitorder="little").view(_U)[:, 0]
        for i in np.flatnonzero(m >= 256):  # counters of 8 bits don't hold these
            part = octets[first[i] : first[i + 1]]
            sums = sum(np.unpackbits(part[j : j + 65536], axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for j in range(0, len(part), 65536))
            out[i, half] = np.packbits(2 * sums > m[i], bitorder="little").view(_U)[0]
    return out


def _pigeonholes(feature: np.ndarray, first: np.ndarray, kind: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, number and hash) of each block of at least `least` features; blocks of another number have other hashes."""
    line = np.repeat(np.arange(len(first) - 1), np.diff(first))
    # Features ascend within a line, and so do their blocks.
    block = line * BLOCKS + ((feature >> _U(8)) * _U(BLOCKS) >> _U(32)).astype(np.int64)
    cut = np.flatnonzero(np.r_[True, block[1:] != block[:-1]][: len(block)])
    if not len(cut):
        return cut, np.zeros(0, _U)
    size = np.diff(np.r_[cut, len(block)])
    which = block[cut]
    number = (which % BLOCKS + BLOCKS * kind).astype(_U)
    key = mix64(np.add.reduceat(mix64(feature ^ _U(0x5BD1E995)), cut) + number) >> _U(32) | number << _U(32)
    enough = size >= least
    return which[enough] // BLOCKS, key[enough]


def sketch(words: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For lines as slices of words: their SimHashes, and (line, number and hash of 32 bits) of their pigeonhole blocks."""
    if not len(at):
        return np.zeros((0, 2), _U), np.zeros(0, np.int64), np.zeros(0, _U)
    first = np.cumsum(n) - n
    line = np.repeat(np.arange(len(at)), n)
    own = words[np.arange(int(n.sum())) - np.repeat(first, n) + np.repeat(at, n)]
    feature, cuts = _sets(own, line, len(at))
    sim = _majority(feature, cuts)
    long = np.repeat(n >= WORDS_FROM, np.diff(cuts))
    cut = np.r_[0, np.cumsum(np.where(n >= WORDS_FROM, np.diff(cuts), 0))]
    who, hole = _pigeonholes(feature[long], cut, 0, 3)
    short = np.flatnonzero(n < PAIRS_BELOW)
    of = np.flatnonzero((n < PAIRS_BELOW)[line])
    # The borders of the line make pairs with its first and last word.
    before = np.where(of == first[line[of]], _U(1), own[of - 1])
    ends = own[(first + n - 1)[short]]
    feature, cut = _sets(np.r_[mix64(before * _U(3) + mix64(own[of] + _U(7))), mix64(ends * _U(3) + _U(2))], np.r_[line[of], short], len(at))
    who2, hole2 = _pigeonholes(feature, cut, 1, 1)
    return sim, np.r_[who, who2], np.r_[hole, hole2]


def _long(size: np.ndarray) -> np.ndarray:
    """Sixteenths of the binary logarithm of a length."""
    return np.minimum(16 * np.log2(np.maximum(size, 1)), 255).astype(np.uint8)


def _deal(buckets: int, least: int):
    """Over (doc_id, h, text): sketches dealt out by block, and all lines' places.

    A row for each bucket has the blocks' numbers and hashes and the lines' keys,
    SimHashes and lengths; one without numbers has places: doc_ids, keys, hashes
    of the texts and line numbers.
    """
    schema = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("number", "hole", "key", "sim", "size"))])

    def flush(held: list[tuple]) -> Iterator[tuple]:
        key, sim, size, who, hole = (np.concatenate(x) for x in zip(*held))
        base = np.repeat(np.cumsum([0, *(len(x[0]) for x in held[:-1])]), [len(x[3]) for x in held])
        who = who + base
        _, one = np.unique(key, return_index=True)
        ok = np.zeros(len(key), bool)
        ok[one] = True
        ok = ok[who]
        who, hole = who[ok], hole[ok]
        to = ((mix64(hole) >> _U(32)) % _U(buckets)).astype(np.int32)
        rank = np.empty(len(key), np.int64)
        rank[np.argsort(key.view(np.int64))] = np.arange(len(key))
        order = np.argsort(to.astype(np.int64) << 32 | rank[who])
        who, hole, to = who[order], hole[order], to[order]
        for a, b in runs(to):
            w = who[a:b]
            yield int(to[a]), pack((hole[a:b] >> _U(32)).astype(np.uint8)), pack(hole[a:b].astype(np.uint32)), pack_sorted(key[w].view(np.int64)), pack(sim[w].reshape(-1)), pack(size[w])

    def places(key: np.ndarray, doc: np.ndarray, h: np.ndarray, line: np.ndarray) -> Iterator[tuple]:
        for k in range(0, len(key), 4096):
            a, one = slice(k, k + 4096), slice(k, k + 1)
            yield int(_at(doc[one], h[one], line[one]).view(_U)[0] % _U(buckets)), None, pack(doc[a]), pack(key[a]), pack(h[a]), pack(line[a].astype(np.int32))

    @lean
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches(rows, 2 << 20):
            key, doc, line, at, m, words, size = _lines(batch.column(2), 1)
            yield from record_batches(places(key, batch.column(0).to_numpy()[doc], batch.column(1).to_numpy()[doc], line), schema, 16)
            enough = np.flatnonzero(m >= least)
            pick = enough[np.unique(key[enough], return_index=True)[1]]
            sim, who, hole = sketch(words, at[pick], m[pick])
            held.append((key[pick], sim, _long(size(at[pick], m[pick])), who, hole))
            n += len(pick)
            if n >= 1 << 16:
                yield from record_batches(flush(held), schema, 16)
                held, n = [], 0
        if n:
            yield from record_batches(flush(held), schema, 16)

    return run


def near(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    count = np.bitwise_count(a ^ b)
    return count[..., 0] + count[..., 1] <= bits


def _pair_up(bits: int, similarity: float):
    """Over rows sorted by bucket: (component, node) of each block and the lines that have a candidate in it, and (node, doc_id, h, line) of all lines."""
    schema = pa.schema([*((c, pa.int64()) for c in ("component", "node", "doc_id", "h")), ("line", pa.int32())])

    def batch(n: int, **columns: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[c]) if c in columns else pa.nulls(n, kind) for c, kind in zip(schema.names, schema.types)], schema=schema)
    # Lengths are rounded down.
    longer = int(16 * np.log2(1 / similarity)) + 1

    def close(part: list) -> Iterator[pa.RecordBatch]:
        number, hole = (np.concatenate([unpack(x[k], kind) for x in part]).astype(np.int64) for k, kind in ((0, np.uint8), (1, np.uint32)))
        hole |= number << 32
        key = np.concatenate([unpack_sorted(x[2]) for x in part])
        sim = np.concatenate([unpack(x[3], _U) for x in part]).reshape(-1, 2)
        size = np.concatenate([unpack(x[4], np.uint8) for x in part]).astype(np.int16)
        part.clear()
        # Most blocks have one line.
        order = np.argsort(hole)
        pair = hole[order[1:]] == hole[order[:-1]]
        order = order[np.r_[pair, False] | np.r_[False, pair]] if len(pair) else order[:0]
        order = order[np.lexsort((key[order], hole[order]))]
        hole, key = hole[order], key[order]
        # Tasks send equal lines each.
        new = np.r_[True, (hole[1:] != hole[:-1]) | (key[1:] != key[:-1])][: len(hole)]
        hole, key, order = hole[new], key[new], order[new]
        sim, size = sim[order], size[order]
        found = np.zeros(len(hole), bool)
        cuts = np.flatnonzero(np.r_[True, hole[1:] != hole[:-1], True][: len(hole) + 1])
        after = np.repeat(cuts[1:], np.diff(cuts)) - np.arange(len(hole)) - 1  # lines of the block that follow
        apart, same = 1, np.flatnonzero(after)  # lines with another of their block so many places on
        while len(same):
            other = same + apart
            unsure = np.flatnonzero(~(found[same] & found[other]))
            one, two = same[unsure], other[unsure]
            ok = near(sim[one], sim[two], bits) & (np.abs(size[one] - size[two]) <= longer)
            found[one[ok]] = found[two[ok]] = True
            apart += 1
            same = same[after[same] >= apart]
        at = np.flatnonzero(found)
        for k in range(0, len(at), 50_000):
            some = at[k : k + 50_000]
            yield batch(len(some), component=hole[some], node=key[some])

    @lean
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part = None, []
        for some in rows:
            for bucket, *packed in zip(*(c.to_pylist() for c in some.columns)):
                if packed[0] is None:
                    doc, key, h = (unpack(x, np.int64) for x in packed[1:4])
                    yield batch(len(key), node=key, doc_id=doc, h=h, line=unpack(packed[4], np.int32))
                    continue
                if bucket != at and part:
                    yield from close(part)
                at = bucket
                part.append(packed)
        if part:
            yield from close(part)

    return run


def _trimmed(a, b):
    """a and b without what they have in common at both ends; strings or lists."""
    k, most = 0, min(len(a), len(b))
    while k < most and a[k] == b[k]:
        k += 1
    e = 0
    while e < most - k and a[-1 - e] == b[-1 - e]:
        e += 1
    return a[k : len(a) - e], b[k : len(b) - e]


def _myers(a, b, most: int) -> int:
    """The edit distance of two sequences that aren't empty, or some number above `most`; a bit-parallel column step on long integers."""
    m, peq = len(a), {}
    for i, c in enumerate(a):
        peq[c] = peq.get(c, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    for left, c in zip(range(len(b) - 1, -1, -1), b):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = (mv | ~(xh | pv)) & full, pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        if score - left > most:
            return most + 1
        ph, mh = (ph << 1 | 1) & full, (mh << 1) & full
        pv, mv = (mh | ~(xv | ph)) & full, ph & xv
    return score


def distance_within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is at most `most`."""
    if abs(len(a) - len(b)) > most:
        return False
    a, b = _trimmed(a, b)
    if max(len(a), len(b)) <= most:
        return True
    if not a or not b:
        return False
    # A step for each letter of the shorter one.
    return (_myers(b, a, most) if len(a) < len(b) else _myers(a, b, most)) <= most


def _steps(a: list[str], b: list[str], reach: int = 10) -> tuple[int, list[tuple[str, str]]]:
    """(an upper bound of the distance of the joined words, the pieces that differ) of one alignment by words.

    Where the words differ, the nearest place within `reach` words is taken
    where they agree again; beyond that, all that is left differs.
    """
    i = j = cost = 0
    m, n, pieces = len(a), len(b), []
    while True:
        while i < m and j < n and a[i] == b[j]:
            i += 1
            j += 1
        if i == m and j == n:
            return cost, pieces
        x, y = m - i, n - j
        for total in range(1, min(reach, x + y - 1)):
            # As many words of each first.
            for k in range(total + 1):
                p = (total + (k if (total + k) % 2 == 0 else -k - 1)) // 2
                if 0 <= p < m - i and 0 <= total - p < n - j and a[i + p] == b[j + total - p]:
                    x, y = p, total - p
                    break
            else:
                continue
            break
        left, right = " ".join(a[i : i + x]), " ".join(b[j : j + y])
        # A piece against none goes with one of its blanks.
        cost += max(len(left), len(right)) + (not x or not y)
        pieces.append((left, right))
        i += x
        j += y


def by_words(a: list[str], b: list[str], most: int) -> bool:
    """Whether an alignment by words shows that the distance is within `most`: a quick yes, no means nothing."""
    cost, pieces = _steps(a, b)
    if cost <= most or cost > 2 * most:
        return cost <= most
    return sum(_myers(x, y, most) if x and y else len(x) + len(y) + 1 for x, y in pieces) <= most


def alike(a: str, b: str, similarity: float, pairs: dict[str, np.ndarray]) -> bool:
    """Whether the edit similarity is reached; pairs is a cache of pairs_of()."""
    most = int(max(len(a), len(b)) * (1 - similarity) + 1e-9)
    if by_words(a.split(" "), b.split(" "), most):
        return True
    return possible(a, b, pairs, most) and distance_within(a, b, most)


def pairs_of(form: str) -> np.ndarray:
    """Counts of the pairs of adjacent characters, hashed to 512 places."""
    c = np.frombuffer(form.encode("utf-32-le"), np.uint32)
    return np.bincount((c[:-1] * np.uint32(29) + c[1:]) & np.uint32(511), minlength=512)


def possible(a: str, b: str, pairs: dict[str, np.ndarray], most: int) -> bool:
    """Whether the forms can be within `most` edits: an edit spoils two pairs of characters at most."""
    longer = max(len(a), len(b))
    if longer - min(len(a), len(b)) > most:
        return False
    for x in (a, b):
        if x not in pairs:
            pairs[x] = pairs_of(x)
    return int(np.minimum(pairs[a], pairs[b]).sum()) >= longer - 1 - 2 * most


def _at(doc: np.ndarray, h: np.ndarray, line: np.ndarray) -> np.ndarray:
    """One number for a place in the corpus, for the bitmap."""
    return mix64(mix64(doc.astype(np.int64).view(_U) + mix64(h.view(_U))) + line.astype(_U)).view(np.int64)


def _forms(raw):
    """(doc_id, h, line, form): normal forms of the lines at the places that the bitmap may have."""
    lower = bytes(ord(chr(b).lower()) if b < 128 and LETTERS[b] else b if LETTERS[b] else 32 for b in range(256))

    @lean
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = Bitmap(raw.value)
        for batch in batches(rows, 2 << 20):
            data, off = text_buffers(batch.column(2))
            feeds = np.flatnonzero(data[off[0] : off[-1]] == 10) + int(off[0])
            # Borders of all lines of all texts: a line starts at a text's start and after each feed.
            doc = np.r_[np.arange(len(off) - 1), np.searchsorted(off, feeds, side="right") - 1]
            start = np.r_[off[:-1], feeds + 1]
            order = np.lexsort((start, doc))
            doc, start = doc[order], start[order]
            end = np.r_[start[1:] - 1, off[-1]]
            last = np.r_[doc[1:] != doc[:-1], True]
            end[last] = off[1:][doc[last]]
            line = np.arange(len(doc)) - np.searchsorted(doc, doc)
            hit = np.flatnonzero(bitmap.has(_at(batch.column(0).to_numpy()[doc], batch.column(1).to_numpy()[doc], line)))
            forms = [b" ".join(data[s:e].tobytes().translate(lower).split()).decode() for s, e in zip(start[hit].tolist(), end[hit].tolist())]
            where = pa.array(doc[hit])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(where), batch.column(1).take(where), pa.array(line[hit].astype(np.int32)), pa.array(forms, pa.string())], ["doc_id", "h", "line", "form"])

    return run


def _place_column(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        yield pa.RecordBatch.from_arrays([pa.array(_at(*(c.to_numpy() for c in batch.columns)))], ["place"])


def _verify(bits: int, similarity: float):
    """Over rows (component, one, two, side, node, form, label) sorted by the first four: verified links as packed forests.

    A component is a block; a pair is verified in the first block that it has in
    common, unless its labels are equal: then it is connected already.
    """
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    @lean
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, lines, left, right = None, [], [], []

        def close() -> None:
            if len(lines) < 2:
                return
            side, key, form, label, low, high, holes = zip(*lines)
            size = [*map(len, form)]
            known: dict[int, int] = {}
            root = [known.setdefault(x, i) for i, x in enumerate(label)]

            def find(x: int) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            pairs: dict[str, np.ndarray] = {}
            # Across two sides only the second side's lines look back, at the first side's.
            begin, upto = (1, None) if side[-1] == side[0] else (side.index(1), side.index(1))
            if len(lines) <= 12:  # calls on arrays would cost more than they save
                similar = lambda i, m: [j for j in range(m) if (low[i] ^ low[j]).bit_count() + (high[i] ^ high[j]).bit_count() <= bits and min(size[i], size[j]) >= max(size[i], size[j]) * similarity - 1e-6]
            else:
                sims, sizes = np.array([low, high], _U).T, np.array(size)
                similar = lambda i, m: np.flatnonzero(near(sims[:m], sims[i], bits) & (np.minimum(sizes[:m], sizes[i]) >= np.maximum(sizes[:m], sizes[i]) * similarity - 1e-6)).tolist()
            for i in range(begin, len(lines)):
                m = i if upto is None else upto
                for j in similar(i, m):
                    a, b = find(i), find(j)
                    if a != b and min(holes[i] & holes[j]) == at[0] and alike(form[i], form[j], similarity, pairs):
                        root[max(a, b)] = min(a, b)
                        left.append(key[i])
                        right.append(key[j])

        for batch in batches(rows, 2 << 20, "form"):
            raw, offsets = text_buffers(batch.column(5))
            start, end, first = word_bounds(raw, offsets, LETTERS)
            sims, who, hole = sketch(_HASHER.hash(raw, start, end), first[:-1], np.diff(first))
            order = np.argsort(who, kind="stable")
            cut, hole = np.searchsorted(who[order], np.arange(batch.num_rows + 1)), hole[order].tolist()
            holes = [frozenset(hole[a:b]) for a, b in zip(cut, cut[1:])]
            for component, one, two, side, key, form, label, low, high, own in zip(*(c.to_pylist() for c in batch.columns), *sims.T.tolist(), holes):
                if (component, one, two) != at:
                    close()
                    at, lines = (component, one, two), []
                lines.append((side, key, form, label, low, high, own))
        close()
        if left:
            a, b = np.array(left, np.int64), np.array(right, np.int64)
            order = np.argsort(a, kind="stable")
            yield from record_batches([pack_edges(a[order], b[order])], schema)

    return run


def removals(docs: DataFrame, least: int = 5, bits: int = BITS, similarity: float = 0.8, most: int = 500) -> DataFrame:
    """(doc_id, h, gone): the line numbers, from 0, that each document loses; h is the text's 64-bit hash."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.col("text").cast("string")
    docs = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    dealt = docs.mapInArrow(_deal(parts, least), "bucket int, number binary, hole binary, key binary, sim binary, size binary")
    paired = dealt.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_pair_up(bits, similarity), "component long, node long, doc_id long, h long, line int")
    both = stored(paired)
    del dealt, paired
    release(spark)  # the sketches are the largest shuffle here
    blocks = both.where("component IS NOT NULL").select("component", "node")
    seen = both.where("component IS NULL").select(F.col("node").alias("key"), "doc_id", "h", "line")
    nodes = blocks.select(F.col("node").alias("key")).distinct().withColumn("member", F.lit(True))
    lines = seen.groupBy("key").agg(F.min(F.struct("doc_id", "h", "line")).alias("first"), F.count("*").alias("n"))
    lines = checkpoint(lines.join(nodes, "key", "left").where("n > 1 OR member"))  # other lines stay
    members = lines.where("member").select(F.col("key").alias("node"), "first.*", "n")
    places = members.select("doc_id", "h", "line").mapInArrow(_place_column, "place long")
    forms = docs.mapInArrow(_forms(member_bitmap(places)), "doc_id long, h long, line int, form string")
    # Equal rows hold a line each.
    forms = checkpoint(forms.join(members.drop("n"), ["doc_id", "h", "line"]).select("node", "form").dropDuplicates(["node"]))
    # Most links show in the first few blocks; of the others only those matter that still hold lines of different sets.
    early = F.shiftright("component", 32) % BLOCKS < EARLY
    found = confirmed(blocks.where(early), forms.withColumn("label", F.col("node")), _verify(bits, similarity), most, adaptive=True)
    label = found.select("node", F.col("component").alias("label"))
    late = blocks.where(~early).join(label, "node", "left").select("component", "node", F.coalesce("label", "node").alias("label"))
    mixed = late.groupBy("component").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("component")
    late = checkpoint(late.join(mixed, "component").select("component", "node"))
    labelled = forms.join(label, "node", "left").select("node", "form", F.coalesce("label", "node").alias("label"))
    more = confirmed(late, labelled, _verify(bits, similarity), most, adaptive=True)
    found = connected(found.union(more).toDF("a", "b"))
    del late, mixed, labelled, more, forms
    release(spark)
    # What is linked is a member of a block; a line that isn't makes a group by itself.
    linked = checkpoint(found.join(members, "node").select(F.col("node").alias("key"), "component", F.struct("doc_id", "h", "line").alias("first"), "n"))
    kept = linked.groupBy("component").agg(F.min("first").alias("kept"))
    alone = lines.where("n > 1").join(linked.select("key"), "key", "left_anti").select("key", "n", F.col("first").alias("kept"))
    stays = checkpoint(linked.join(kept, "component").select("key", "n", "kept").unionByName(alone))
    # At most `parts` keys can hold more than the share of a partition.
    share = max(1, seen.count()) / parts
    hot = F.broadcast(stays.where(F.col("n") > share).select("key", "kept"))
    rows = seen.join(hot, "key").unionByName(seen.join(hot.select("key"), "key", "left_anti").join(stays.where(F.col("n") <= share).select("key", "kept"), "key"))
    gone = rows.where(F.struct("doc_id", "h", "line") != F.col("kept"))
    return gone.groupBy("doc_id", "h").agg(F.sort_array(F.collect_set("line")).alias("gone"))  # bounded by the document's own lines


def _cut(at: int, names: list[str]):
    """Rows (the document's columns as a struct, gone) to those columns, n_lines and n_removed; text without the lines gone."""

    @lean
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(k, 500) for whole in rows for k in range(0, whole.num_rows, 500)):
            columns = batch.column(0).flatten()
            texts, n, removed = [], [], []
            # One call for all lists' numbers: lists converted one by one would cost more than the texts.
            numbers, ends = pc.list_flatten(batch.column(1)).to_pylist(), np.cumsum(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy()).tolist()
            for text, a, b in zip(columns[at].to_pylist(), [0, *ends], ends):
                gone = numbers[a:b]
                if text is not None and gone:
                    lines, drop = text.split("\n"), set(gone)
                    text = "\n".join([x for k, x in enumerate(lines) if k not in drop])
                    n.append(len(lines))
                else:
                    n.append(0 if text is None else text.count("\n") + 1)
                texts.append(text)
                removed.append(len(gone))
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(removed, pa.int64())], names)

    return run


def remove_lines(docs: DataFrame, **options) -> DataFrame:
    """All columns of docs, text without the removed lines, plus n_lines and n_removed (long; columns of these names are replaced)."""
    docs = docs.drop("n_lines", "n_removed")
    docs = docs.withColumn("text", F.col("text").cast("string"))
    gone = removals(docs, **options).select(F.col("doc_id").alias("of"), F.col("h").alias("hash"), "gone")
    whole = docs.select(F.struct(*docs.columns).alias("row"))
    joined = whole.join(gone, (F.col("row.doc_id").cast("long") == F.col("of")) & (F.xxhash64("row.text") == F.col("hash")), "left").select("row", "gone")
    schema = StructType([*docs.schema.fields, StructField("n_lines", LongType()), StructField("n_removed", LongType())])
    return joined.mapInArrow(_cut(docs.columns.index("text"), schema.names), schema)
