"""Quality by the perplexity of an interpolated modified Kneser-Ney n-gram model.

The n-grams are over UTF-8 bytes (order 5, padded with zero bytes at a text's
start), trained on trusted text: documents labelled with quality 1, but for
every `left_out`-th of them by a hash of doc_id, which set the threshold.  Lower
orders use continuation counts; each order has the three discounts of modified
Kneser-Ney, from its counts of counts.  A document's perplexity is
exp(-mean log p of its bytes); it is kept if that is at most the `quantile` of
the perplexities of the trusted documents left out of the counts in its language
(of all documents' in a language without any).

Each task counts its documents' distinct n-grams first, and a text of natural
bytes has few, so what is shuffled is a row per task and n-gram and not one per
byte.  The counts of all orders are sharded by n-gram; the probabilities of all
n-grams that occur in the corpus come from joins of these shards, order by
order.  They reach the documents by a broadcast if counted to be few, else
documents and n-grams are dealt out to chunks and meet there.

Null and empty texts have a null perplexity and are not kept.  Without trusted
text all bytes are equally likely.  A null language is a language of its own.
Several labels of one doc_id: quality 1 in any of them makes it trusted.  Equal
texts of one language are judged alike, whatever their batch; rows of one doc_id
each by their text.  A very long text is one row's work, in a task of its own
batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._checkpoint import checkpoint
from ._lean import lean
from ._packed import spread
from ._words import batches, distinct, text_buffers

ORDER = 5
_U = np.uint64


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(codes, offsets): the n-gram that ends at each byte, texts one after another."""
    data, off = text_buffers(column)
    lo, hi = int(off[0]), int(off[-1])
    b, off = data[lo:hi], off - lo
    code = b.astype(_U)
    place = np.arange(len(b)) - np.repeat(off[:-1], np.diff(off))
    for k in range(1, ORDER):
        part = np.zeros(len(b), _U)
        part[k:] = b[:-k] if len(b) > k else part[k:]
        part[place < k] = 0
        code |= part << _U(8 * k)
    return code.view(np.int64), off


def _count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, n): each n-gram of a task's documents with its count in trusted ones."""
    code, n = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        c, m = (np.concatenate(x) for x in zip(*parts))
        code, back = np.unique(c, return_inverse=True)
        return code, np.bincount(back, m, len(code)).astype(np.int64)

    held, size = [(code, n)], 0
    for batch in batches(rows, 4 << 20):
        trusted = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for flag in (False, True):
            c, _ = grams(batch.column(0).filter(pa.array(trusted == flag)))
            c, m = np.unique(c, return_counts=True)
            held.append((c, m * flag))
            size += len(c)
        if size > 2_000_000:
            held = [merge(held)]
            size = len(held[0][0]) // 2
    code, n = merge(held)
    for k in range(0, len(code), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(code[k : k + 100_000]), pa.array(n[k : k + 100_000])], ["gram", "n"])


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """D1, D2 and D3+ from the counts of counts, within their bounds where these are too small to tell."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    out = []
    for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        d = k - (k + 1) * y * b / a if a else k / 2
        out.append(min(max(d, 0.05), k - 0.05))
    return out[0], out[1], out[2]


def probabilities(counts: DataFrame) -> DataFrame:
    """(gram, logp) of every n-gram of counts(gram, n), where n is the count in trusted text."""
    mask = [(1 << 8 * k) - 1 for k in range(ORDER + 1)]
    seen = {ORDER: counts.where("n > 0").select("gram", F.col("n").alias("c"))}
    for k in range(ORDER - 1, 0, -1):
        seen[k] = checkpoint(seen[k + 1].groupBy(F.col("gram").bitwiseAND(mask[k]).alias("gram")).agg(F.count("*").alias("c")))
    asked = {ORDER: counts.select("gram")}
    for k in range(ORDER - 1, 0, -1):
        asked[k] = asked[k + 1].select(F.col("gram").bitwiseAND(mask[k]).alias("gram")).distinct()
    below = None
    for k in range(1, ORDER + 1):
        of = seen[k].agg(*(F.count_if(F.col("c") == i).alias(f"n{i}") for i in range(1, 5))).first()
        d1, d2, d3 = discounts(*of)
        discount = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        context = seen[k].groupBy(F.shiftright("gram", 8).alias("h")).agg(
            F.sum("c").alias("total"), (F.sum(discount)).alias("freed"))
        now = asked[k].join(seen[k], "gram", "left").withColumn("h", F.shiftright("gram", 8))
        now = now.join(context, "h", "left").withColumn("low", F.col("gram").bitwiseAND(mask[k - 1]))
        if below is None:
            now = now.withColumn("q", F.lit(1 / 256))
        else:
            now = now.join(below.select(F.col("gram").alias("low"), F.col("p").alias("q")), "low")
        own = F.coalesce(F.col("c") - discount, F.lit(0.0))
        p = F.when(F.col("total").isNull(), F.col("q")).otherwise((own + F.col("freed") * F.col("q")) / F.col("total"))
        below = checkpoint(now.select("gram", p.alias("p")))
    return below.select("gram", F.log("p").alias("logp"))


def _sums(code: np.ndarray, off: np.ndarray, known: np.ndarray, logp: np.ndarray) -> np.ndarray:
    """Sum of log p of each text."""
    if not len(code):
        return np.zeros(len(off) - 1)
    distinct, back = np.unique(code, return_inverse=True)
    value = logp[np.searchsorted(known, distinct)][back]
    # Each text by itself, so that equal texts have equal sums whatever stands beside them.
    out, some = np.zeros(len(off) - 1), np.flatnonzero(np.diff(off))
    out[some] = np.add.reduceat(value, off[some])
    return out


def _score(model):
    """(doc_id, lang, trusted, bytes, total) by a broadcast (sorted n-grams, log p)."""

    @lean
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, logp = model.value
        for batch in batches(rows, 4 << 20):
            code, off = grams(batch.column(3))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(off)), pa.array(_sums(code, off, known, logp))], ["doc_id", "lang", "trusted", "bytes", "total"])

    return run


def _deal(chunks: int):
    """(chunk, doc_id, lang, trusted, z): documents dealt out, compressed."""

    @lean
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in rows:
            doc = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            z = [squeeze((t.as_py() or "").encode()) for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([pa.array(spread(doc, chunks)), *batch.columns[:3], pa.array(z, pa.binary())], ["chunk", "doc_id", "lang", "trusted", "z"])

    return run


def _wanted(chunks: int):
    """(gram, chunk): the n-grams that the documents of each chunk ask for, each once per task."""

    @lean
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, 16 << 20):
            code, off = grams(batch.column(1))
            chunk = np.repeat(spread(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False), chunks), np.diff(off))
            both = distinct(chunk.astype(np.int64) << 40 | code)  # fewer than 2**23 chunks
            chunk, code = both >> 40, both & ((1 << 40) - 1)
            for k in range(0, len(code), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(code[k : k + 100_000]), pa.array(chunk[k : k + 100_000].astype(np.int32))], ["gram", "chunk"])

    return run


def _meet(docs: pa.Table, model: pa.Table) -> pa.Table:
    """_score() for one chunk, with the n-grams that it asked for."""
    import zstandard

    unzip = zstandard.ZstdDecompressor().decompress
    known = model.column("gram").to_numpy()
    order = np.argsort(known)
    known, logp = known[order], model.column("logp").to_numpy()[order]
    sizes, totals = [], []
    for z in docs.column("z"):
        code, off = grams(pa.array([unzip(z.as_py())], pa.large_binary()).cast(pa.large_string()))
        sizes.append(int(off[-1]))
        totals.append(float(_sums(code, off, known, logp)[0]))
    return pa.table({"doc_id": docs.column("doc_id"), "lang": docs.column("lang"), "trusted": docs.column("trusted"), "bytes": pa.array(sizes, pa.int64()), "total": pa.array(totals, pa.float64())})


def judge(docs: DataFrame, labels: DataFrame, quantile: float = 0.98, broadcast_rows: int = 8_000_000, trusted_rows: int = 1_000_000, left_out: int = 5, chunk_bytes: int = 64 << 20) -> DataFrame:
    """doc_id, lang, perplexity, threshold and kept of every row of docs."""
    spark = docs.sparkSession
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(True).alias("trusted")).distinct()
    if good.count() <= trusted_rows:  # ids only; beyond, a shuffled join
        good = F.broadcast(good)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    docs = docs.join(good, "doc_id", "left").select("doc_id", "lang", F.coalesce("trusted", F.lit(False)).alias("trusted"), "text")
    measures = F.pmod(F.xxhash64("doc_id"), F.lit(left_out)) == 0
    counts = checkpoint(docs.select("text", F.col("trusted") & ~measures).mapInArrow(_count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")))
    model = checkpoint(probabilities(counts))
    schema = "doc_id long, lang string, trusted boolean, bytes long, total double"
    if model.count() <= broadcast_rows:
        table = model.withColumn("logp", F.col("logp").cast("float")).toArrow()
        order = np.argsort(table.column("gram").to_numpy())
        pair = table.column("gram").to_numpy()[order], table.column("logp").to_numpy()[order].astype(np.float64)
        scored = docs.mapInArrow(_score(spark.sparkContext.broadcast(pair)), schema)
    else:
        # A chunk's texts and n-grams meet in one call: their bytes are counted, so the number of chunks follows the data.
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        chunks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // chunk_bytes))
        asked = docs.select("doc_id", "text").mapInArrow(_wanted(chunks), "gram long, chunk int").distinct()
        sent = asked.join(model, "gram").select("chunk", "gram", F.col("logp").cast("float").cast("double").alias("logp"))
        dealt = docs.mapInArrow(_deal(chunks), "chunk int, doc_id long, lang string, trusted boolean, z binary")
        dealt, sent = dealt.repartition(chunks, "chunk"), sent.repartition(chunks, "chunk")
        scored = dealt.groupBy("chunk").cogroup(sent.groupBy("chunk")).applyInArrow(_meet, schema)
    scored = checkpoint(scored.select("doc_id", "lang", "trusted", F.when(F.col("bytes") > 0, F.exp(-F.col("total") / F.col("bytes"))).alias("perplexity")))
    at = scored.groupBy("lang").agg(
        F.percentile_approx(F.when(F.col("trusted") & measures, F.col("perplexity")), quantile, 10_000).alias("own"),
        F.percentile_approx("perplexity", quantile, 10_000).alias("any"),
    ).select(F.col("lang").alias("of"), F.coalesce("own", "any").alias("threshold"))
    joined = scored.join(at, F.col("lang").eqNullSafe(F.col("of")), "left")
    return joined.select("doc_id", "lang", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False)).alias("kept"))
