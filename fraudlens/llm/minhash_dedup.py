"""Near-duplicate documents by MinHash with tensored banding, confirmed on full shingle sets.

A document's set holds its distinct shingles of `width` words (A-Z lower-cased);
a text with fewer words has its whole word sequence as the one shingle; a text
without words, and a null, have an empty set and are linked with nothing.  Two
documents are linked if 100 * |intersection| >= percent * |union|.

1. A narrow pass makes each document's sketch: the size and a 128-bit digest of
   its set, and 2 * groups half keys of `half` minhashes each.
2. Documents of equal sets collapse to the one with the smallest doc_id.
3. Tensored banding: the table key (i, j) joins the i-th half key of the first
   collection with the j-th of the second, so groups**2 tables cost only
   2 * groups * half minhashes.  Keys are dealt out packed.  Each task first
   joins equal keys among its own documents and sends one of them on, so a key
   that a third of the documents share costs one entry per task.
4. Documents that share keys form candidate clusters (a forest, then connected
   components); this only gathers what must be compared.
5. The texts of clustered documents are read again (a bitmap keeps others from
   the shuffle) and sent to their cluster, where intersections of all pairs are
   counted exactly as a product of membership matrices, in memory and without
   emitting pairs.  A cluster above `block` documents is cut into blocks, first
   compared each in itself; then only sets that aren't linked yet are compared,
   see _graph.confirmed().  No task holds more than two blocks and no pair of
   different sets is left out.
6. The confirmed links give the components.  Sets with more copies than a shuffle
   partition's share meet their rows by a broadcast (at most one for each
   partition can be that large); rows with an empty set need no join.

A pair at similarity s shares a table with probability (1-(1-s**half)**groups)**2,
0.9998 at the default threshold.

Rows with one doc_id are one node: their links are joined if they are the
smallest doc_id of their sets.  Rows with a null doc_id
take no part: their component_id is null and they are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bitmap import Bitmap, member_bitmap
from ._checkpoint import checkpoint, stored
from ._graph import confirmed, connected, forest, merge_forests, pack_edges
from ._lean import lean
from ._packed import leads, pack, record_batches, runs, unpack
from ._words import Hasher, _splitmix, batches, mix64, text_buffers, windows, word_bounds

_U = np.uint64


class Shingler:
    """Distinct shingle hashes of each text of a column."""

    def __init__(self, width: int):
        self.width = width
        self.hasher = Hasher(71, lower=True)

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(hash, first): the sets one after another, and where each text's set starts (plus the total)."""
        data, off = text_buffers(column)
        start, end, first = word_bounds(data, off)
        words = self.hasher.hash(data, start, end)
        h, at = windows(words, first, self.width)
        doc = np.searchsorted(first, at, side="right") - 1
        hs, docs = [h], [doc]
        count = np.diff(first)
        for n in range(1, self.width):
            few = np.flatnonzero(count == n)
            if len(few):
                v = np.full(len(few), _U(n))
                for k in range(n):
                    v = mix64(v) + words[first[few] + k]
                hs.append(mix64(v))
                docs.append(few)
        h, doc = np.concatenate(hs), np.concatenate(docs)
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        return h[new], np.searchsorted(doc[new], np.arange(len(off)))


def _sketch(width: int, groups: int, half: int):
    shingles = Shingler(width)
    factors = [_U(_splitmix(900 + k) | 1) for k in range(2 * groups * half)]
    salt = _U(_splitmix(899))

    @lean
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, 2 << 20):
            h, first = shingles(batch.column(1))
            n = np.diff(first)
            some = np.flatnonzero(n)
            keys = np.zeros((batch.num_rows, 2 * groups), np.uint32)
            hi, lo = np.zeros(batch.num_rows, _U), np.zeros(batch.num_rows, _U)
            if len(some):
                at = first[some]
                hi[some] = np.add.reduceat(mix64(h), at)
                lo[some] = np.add.reduceat(mix64(h ^ salt), at)
                for k in range(2 * groups):
                    key = np.full(len(some), _U(k + 1))
                    for f in factors[k * half : (k + 1) * half]:
                        key = mix64(key) + np.minimum.reduceat(h * f, at)
                    keys[some, k] = mix64(key) >> _U(32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n.astype(np.int64)), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), pa.array([k.tobytes() for k in keys], pa.binary())], ["doc_id", "h", "n_shingles", "hi", "lo", "keys"])

    return run


def _bands(groups: int, buckets: int):
    """Deals the table keys of a task's documents out; keys shared inside the task become edges at once."""
    schema = pa.schema([("bucket", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])

    def flush(doc: np.ndarray, keys: np.ndarray) -> Iterator[tuple]:
        order = np.argsort(doc)
        doc, keys = doc[order], keys[order].astype(_U)
        left, right = [], []
        sent: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(buckets)]
        for i in range(groups):
            base = mix64(keys[:, i] + (_U(i + 1) << _U(32)))
            for j in range(groups):
                key = mix64(base + keys[:, groups + j] + (_U(j + 1) << _U(32)))
                o = np.argsort(key, kind="stable")
                k, d = key[o], doc[o]
                lead = leads(k)
                joined = lead != np.arange(len(lead))
                left.append(d[joined])
                right.append(d[lead[joined]])
                k, d = k[~joined], d[~joined]
                to = ((k >> _U(40)) % _U(buckets)).astype(np.int64)
                o = np.argsort(to, kind="stable")
                k, d, to = k[o], d[o], to[o]
                for a, b in runs(to):
                    sent[to[a]].append((k[a:b] & _U((1 << 40) - 1), d[a:b]))
        for bucket, part in enumerate(sent):
            if part:
                k, d = np.concatenate([x for x, _ in part]), np.concatenate([x for _, x in part])
                o = np.argsort(d, kind="stable")
                yield bucket, pack(k[o]), pack(np.diff(d[o], prepend=np.int64(0)))
        a, b = forest(np.concatenate(left), np.concatenate(right))
        if len(a):
            yield -1, *pack_edges(a, b)

    @lean
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, keys, held = [], [], 0
        for batch in rows:
            if batch.num_rows:
                doc.append(batch.column(0).to_numpy().astype(np.int64))
                keys.append(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(batch.num_rows, 2 * groups))
                held += batch.num_rows
            if held >= 10_000:
                yield from record_batches(flush(np.concatenate(doc), np.concatenate(keys)), schema)
                doc, keys, held = [], [], 0
        if held:
            yield from record_batches(flush(np.concatenate(doc), np.concatenate(keys)), schema)

    return run


@lean
def _meet(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by bucket: edges between the documents that share a key, as packed forests."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])
    at, part, left, right = None, [], [], []

    def close() -> None:
        key = np.concatenate([unpack(k, _U) for k, _ in part])
        doc = np.concatenate([np.cumsum(unpack(d, np.int64)) for _, d in part])
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        lead = leads(key)
        joined = lead != np.arange(len(lead))
        left.append(doc[joined])
        right.append(doc[lead[joined]])

    for batch in rows:
        for bucket, a, b in zip(*batch.columns):
            bucket, a, b = bucket.as_py(), a.as_py(), b.as_py()
            if bucket < 0:
                left.append(np.cumsum(unpack(a, np.int64)))
                right.append(unpack(b, np.int64))
                continue
            if bucket != at and part:
                close()
                part.clear()
            at = bucket
            part.append((a, b))
            if sum(map(len, left)) > 2_000_000:
                x, y = forest(np.concatenate(left), np.concatenate(right))
                left[:], right[:] = [x], [y]
    if part:
        close()
    if left:
        x, y = forest(np.concatenate(left), np.concatenate(right))
        if len(x):
            yield from record_batches([pack_edges(x, y)], schema)


def _members(raw):
    """(node, z): the compressed texts of the documents that the bitmap may have."""

    @lean
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress
        bitmap = Bitmap(raw.value)
        for batch in batches(rows):
            batch = batch.filter(pa.array(bitmap.has(batch.column(0).to_numpy())))
            z = [squeeze((t.as_py() or "").encode()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(z, pa.binary())], ["node", "z"])

    return run


def links(sets: list[np.ndarray], percent: int, split: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (x, y), x > y, of sets with 100 * |intersection| >= percent * |union|.

    With split, only pairs of one before and one from number `split` on.  The
    intersections are products of the 0/1 membership matrix over the elements
    that at least two sets have, a few thousand elements at a time.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), size)
    _, element, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[element] > 1
    owner, element = owner[shared], element[shared]
    order = np.argsort(element, kind="stable")
    owner, element = owner[order], element[order]
    if len(element):
        element = np.cumsum(np.r_[0, element[1:] != element[:-1]])
    both = np.zeros((n, n), np.float32)
    wide = max(64, min(4096, (4 << 20) // max(1, n)))
    total = int(element[-1]) + 1 if len(element) else 0
    for k in range(0, total, wide):
        a, b = np.searchsorted(element, [k, k + wide])
        m = np.zeros((n, min(wide, total - k)), np.float32)
        m[owner[a:b], element[a:b] - k] = 1
        both += m @ m.T
    either = size[:, None] + size[None, :] - both
    linked = np.tril(100 * both.astype(np.int64) >= percent * either.astype(np.int64), -1)
    if split is not None:
        linked[:split, :split] = False
        linked[split:, split:] = False
    return np.nonzero(linked)


def _confirm(width: int, percent: int):
    """Over rows (cluster, one, two, side, doc_id, z) sorted by the first four: forests of confirmed links, packed."""
    shingles = Shingler(width)
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    @lean
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unzip = zstandard.ZstdDecompressor().decompress
        at, docs, sets, side, left, right = None, [], [], [], [], []

        def close() -> None:
            if len(docs) > 1:
                split = side.count(0) if side[-1] else None
                x, y = links(sets, percent, split)
                if len(x):
                    d = np.array(docs)
                    a, b = forest(d[x], d[y])
                    left.append(a)
                    right.append(b)

        for batch in rows:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                h, first = shingles(pa.array([unzip(z.as_py()) for z in part.column(5)], pa.large_binary()).cast(pa.large_string()))
                for r, (cluster, one, two, which, doc) in enumerate(zip(*(part.column(c).to_pylist() for c in range(5)))):
                    if (cluster, one, two) != at:
                        close()
                        at, docs, sets, side = (cluster, one, two), [], [], []
                    docs.append(doc)
                    side.append(which)
                    sets.append(h[first[r] : first[r + 1]])
        close()
        if left:
            a, b = np.concatenate(left), np.concatenate(right)
            order = np.argsort(a, kind="stable")
            yield from record_batches([pack_edges(a[order], b[order])], schema)

    return run


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, groups: int = 14, half: int = 3, block: int = 1000) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs, and h, the 64-bit hash of its text (see the module's text)."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    sketch = stored(docs.mapInArrow(_sketch(width, groups, half), "doc_id long, h long, n_shingles long, hi long, lo long, keys binary"))
    named = sketch.where("doc_id IS NOT NULL AND n_shingles > 0")
    reps = checkpoint(named.groupBy("hi", "lo", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("keys").alias("keys")))
    bands = reps.select("rep", "keys").mapInArrow(_bands(groups, 2 * parts), "bucket int, a binary, b binary")
    met = bands.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_meet, "a binary, b binary")
    clusters = connected(merge_forests(met, max(1, parts // 4)))
    texts = docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(_members(member_bitmap(clusters.select("node"))), "node long, z binary")
    found = confirmed(clusters, texts, _confirm(width, percent), block)
    sets = reps.join(found, F.col("rep") == F.col("node"), "left").select("hi", "lo", "n_shingles", "copies", F.coalesce("component", "rep").alias("component_id"))
    # At most `parts` sets can have more copies than a partition's share: their rows meet them by a broadcast.
    sets = checkpoint(sets)
    key = ["hi", "lo", "n_shingles"]
    share = max(1, sketch.count()) / parts
    hot = F.broadcast(sets.where(F.col("copies") > share).drop("copies"))
    rows = named.drop("keys")
    labelled = rows.join(hot, key).unionByName(rows.join(hot.select(*key), key, "left_anti").join(sets.where(F.col("copies") <= share).drop("copies"), key))
    # Rows without a set, or without an id, stand alone.
    alone = sketch.where("doc_id IS NULL OR n_shingles = 0").drop("keys").withColumn("component_id", F.col("doc_id"))
    out = labelled.unionByName(alone)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "h")
