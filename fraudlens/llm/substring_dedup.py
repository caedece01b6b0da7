"""Substring dedup: removes words covered by a repeated window of consecutive words.

Every window of `width` words of every text gets a Rabin-Karp hash, rolled over
64-bit word hashes.  A window is repeated if the same hash starts earlier: in a
smaller doc_id, or earlier in the same document.  Repeated windows merge into
maximal intervals, which are cut out.

How it is spread over the cluster:

* A task rolls the hashes of some millions of windows, keeps only the earliest
  start of each hash that it met itself (a map-side combine, so a window that a
  third of all documents share is sent once per task and not once per copy),
  knows the others as repeated already, and deals the rest out to buckets,
  packed in binary columns: the hash, the document and the start, the latter two
  delta coded and compressed.
* Each bucket sorts its hashes and finds the earliest start of each; the others
  go back to the documents' chunk as packed (doc_id, start) lists.
* The texts are shuffled once, compressed, and meet the starts in their chunk.

Buckets are dealt by a second rolling hash, which adds its bits to the 64 that
are compared: any two of n different windows are taken for the same with a
probability of about n**2 / (buckets * 2**65).

Nulls and empty texts have no words and lose none.  doc_id must be an integer;
rows with a null doc_id take no part in the comparison and keep their words.
With repeated doc_ids each row is compared by (doc_id, start), so equal starts of
two rows of one doc_id don't remove each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._lean import lean
from ._packed import leads, pack, pack_sorted, record_batches, runs, spread, unpack, unpack_sorted
from ._words import Hasher, batches, distinct, text_buffers, windows, word_bounds

_U = np.uint64
_SENT = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("hash", pa.binary()), ("doc", pa.binary()), ("pos", pa.binary())])


def _scatter(width: int, buckets: int, chunks: int, most: int):
    hasher = Hasher(11)

    def flush(held: list[tuple[np.ndarray, ...]]) -> Iterator[tuple]:
        h, bucket, doc, pos = (np.concatenate(x) for x in zip(*held))
        held.clear()
        if np.any(doc[1:] < doc[:-1]):
            order = np.argsort(doc, kind="stable")
            h, bucket, doc, pos = h[order], bucket[order], doc[order], pos[order]
        order = np.lexsort((h, bucket))  # stable: the earliest start of a hash comes first
        s, t = h[order], bucket[order]
        lead = leads(t, s)
        first = order[lead]
        other = lead != np.arange(len(lead))
        again = other & ((doc[order] != doc[first]) | (pos[order] != pos[first]))
        for c, d, p in _answers(doc[order[again]], pos[order[again]], chunks):
            yield -1 - c, c, b"", d, p
        keep = np.sort(order[~other])
        keep = keep[np.argsort(bucket[keep], kind="stable")]
        h, bucket, doc, pos = h[keep], bucket[keep], doc[keep], pos[keep]
        for a, b in runs(bucket):
            yield int(bucket[a]), -1, h[a:b].tobytes(), pack_sorted(doc[a:b]), pack(pos[a:b].astype(np.uint32))

    @lean
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches(rows, 4 << 20):
            batch = batch.filter(batch.column(0).is_valid())
            data, off = text_buffers(batch.column(1))
            start, end, first = word_bounds(data, off)
            words = hasher.hash(data, start, end)
            found, at = windows(words, first, width)
            deal, _ = windows(words, first, width, 0xB492B66FBE98F273)
            of = np.searchsorted(first, at, side="right") - 1
            doc = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)[of]
            held.append((found, ((deal >> _U(32)) % _U(buckets)).astype(np.int32), doc, (at - first[of]).astype(np.int32)))
            n += len(found)
            if n >= most:
                yield from record_batches(flush(held), _SENT)
                n = 0
        if n:
            yield from record_batches(flush(held), _SENT)

    return run


def _answers(doc: np.ndarray, pos: np.ndarray, chunks: int) -> Iterator[tuple[int, bytes, bytes]]:
    """Repeated windows as (chunk, packed doc_ids, packed starts)."""
    chunk = spread(doc, chunks)
    order = np.lexsort((pos, doc, chunk))
    doc, pos, chunk = doc[order], pos[order], chunk[order]
    for a, b in runs(chunk):
        yield int(chunk[a]), pack_sorted(doc[a:b]), pack(pos[a:b].astype(np.uint32))


def _compare(chunks: int, most: int = 1 << 20):
    """Over rows sorted by bucket: the repeated windows, gathered over a task's buckets."""
    schema = pa.schema([("chunk", pa.int32()), ("doc", pa.binary()), ("pos", pa.binary())])

    def repeated(part: list[tuple[bytes, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        h = np.concatenate([np.frombuffer(x, _U) for x, _, _ in part])
        doc = np.concatenate([unpack_sorted(x) for _, x, _ in part])
        pos = np.concatenate([unpack(x, np.uint32) for _, _, x in part])
        order = np.argsort(h)
        s = h[order]
        same = s[1:] == s[:-1]
        shared = order[np.r_[False, same] | np.r_[same, False]]
        h, doc, pos = h[shared], doc[shared], pos[shared]
        order = np.lexsort((pos, doc, h))
        doc, pos = doc[order], pos[order]
        lead = leads(h[order])
        again = (doc != doc[lead]) | (pos != pos[lead])
        return doc[again], pos[again]

    @lean
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part, found, n = None, [], [], 0
        for batch in rows:
            for bucket, h, doc, pos in zip(*(batch.column(k) for k in (0, 2, 3, 4))):
                bucket = bucket.as_py()
                if bucket != at and part:
                    found.append(repeated(part))
                    n += len(found[-1][0])
                    part = []
                at = bucket
                if bucket < 0:  # found by the sending task itself
                    found.append((unpack_sorted(doc.as_py()), unpack(pos.as_py(), np.uint32)))
                    n += len(found[-1][0])
                else:
                    part.append((h.as_py(), doc.as_py(), pos.as_py()))
                if n >= most:
                    yield from record_batches(_answers(*(np.concatenate(x) for x in zip(*found)), chunks), schema)
                    found, n = [], 0
        if part:
            found.append(repeated(part))
        if found:
            yield from record_batches(_answers(*(np.concatenate(x) for x in zip(*found)), chunks), schema)

    return run


def _squeeze(chunks: int):
    """Deals the texts out to their chunks, compressed for the way through the shuffle."""

    @lean
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in rows:
            doc = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            z = [squeeze((t.as_py() or "").encode()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array(spread(doc, chunks)), batch.column(0), pa.array(z, pa.binary())], ["chunk", "doc_id", "z"])

    return run


def _cut(width: int, texts: bool):
    """For one chunk: the texts without the words that the answered windows cover."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        import zstandard

        unzip = zstandard.ZstdDecompressor().decompress
        doc = [unpack_sorted(x.as_py()) for x in answers.column("doc")]
        pos = [unpack(x.as_py(), np.uint32).astype(np.int64) for x in answers.column("pos")]
        doc, pos = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (doc, pos))
        order = np.argsort(doc, kind="stable")
        doc, pos = doc[order], pos[order]
        ids, words, removed, digest, kept = [], [], [], [], []
        for i, z in zip(docs.column("doc_id"), docs.column("z")):
            raw = unzip(z.as_py())
            data = np.frombuffer(raw, np.uint8)
            start, end, _ = word_bounds(data, np.array([0, len(data)]))
            i = i.as_py()
            a, b = (np.searchsorted(doc, i), np.searchsorted(doc, i, side="right")) if i is not None else (0, 0)
            cover = np.zeros(len(start) + 1, np.int64)
            at = distinct(pos[a:b])
            at = at[at + width <= len(start)]
            np.add.at(cover, at, 1)
            np.add.at(cover, at + width, -1)
            keep = np.cumsum(cover)[:-1] == 0
            text = b" ".join([raw[s:e] for s, e in zip(start[keep].tolist(), end[keep].tolist())])
            ids.append(i)
            words.append(len(start))
            removed.append(int(len(start) - keep.sum()))
            digest.append(hashlib.sha256(text).hexdigest())
            if texts:
                kept.append(text.decode())
        out = {"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(words, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
        return pa.table(out | ({"kept": pa.array(kept, pa.string())} if texts else {}))

    return run


def remove_repeats(docs: DataFrame, width: int = 20, most: int = 1 << 20, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and with `texts` the kept words as column kept) of every row of docs.

    docs needs doc_id and text; other columns are not read.  `most` is the
    number of windows that a task holds at once.  There are eight buckets and two
    chunks to a shuffle partition, so spark.sql.shuffle.partitions sizes them.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets, chunks = 8 * parts, 2 * parts
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sent = docs.mapInArrow(_scatter(width, buckets, chunks, most), "bucket int, chunk int, hash binary, doc binary, pos binary")
    answers = sent.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_compare(chunks), "chunk int, doc binary, pos binary")
    dealt = docs.mapInArrow(_squeeze(chunks), "chunk int, doc_id long, z binary")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_cut(width, texts), schema)
