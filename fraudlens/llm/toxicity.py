"""Toxicity: a factorisation machine over hashed terms.

Terms are words (runs of letters and digits, A-Z lower-cased) and their
beginnings of a few byte lengths, hashed into a fixed number of slots; a
document has the set of its terms.  The score is the logistic of
w0 + sum w_i + sum_{i<j} <v_i, v_j>, so a pair of terms can count for more
than the two alone.  It is trained here, by Adam over the whole batch, on the
slots that a G test doesn't take for noise.

Training uses a bounded sample of the labelled rows: at most `train_rows`
documents, those with the smallest hash of doc_id.  The model's size is fixed
by its parameters (2**bits slots of 1 + factors floats), so it is broadcast.
Scoring is a narrow operation over whole texts.

A null or empty text has no terms and scores the logistic of w0.  Without
labels every score is 0.  A doc_id with contradicting labels counts as toxic.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._lean import lean
from ._words import LETTERS, Hasher, batches, distinct, text_buffers, with_fields, word_bounds

STARTS = (4, 6, 8)
#: Bytes of text that are looked at together: each takes some twenty bytes of memory for the while.
AT_ONCE = 1 << 19


class Terms:
    """Hashed terms of texts: (slot, text number) without repeats, by text."""

    def __init__(self, bits: int):
        self.bits = np.uint64(64 - bits)
        self.hashers = [Hasher(31 + k, lower=True) for k in range(1 + len(STARTS))]

    def __call__(self, column: pa.Array, useful: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        data, off = text_buffers(column)
        start, end, first = word_bounds(data, off, LETTERS)
        doc = np.repeat(np.arange(len(off) - 1, dtype=np.int64), np.diff(first))
        found = []
        for hasher, most in zip(self.hashers, (None, *STARTS)):
            if most is None:
                s, e, d = start, end, doc
            else:  # words not longer than this beginning have it already
                long = end - start > most
                s, d = start[long], doc[long]
                e = s + most
            slot = (hasher.hash(data, s, e) >> self.bits).astype(np.int64)
            if useful is not None:
                ok = useful[slot]
                slot, d = slot[ok], d[ok]
            found.append(d << 32 | slot)
        both = distinct(np.concatenate(found))
        return both & 0xFFFFFFFF, both >> 32


@dataclass
class Machine:
    bias: float
    weight: np.ndarray  # by slot
    factor: np.ndarray  # (factors, slots)

    def score(self, slot: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(slot, doc, n)[0], -40, 40)))

    def raw(self, slot: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        z = self.bias + np.bincount(doc, self.weight[slot], n)
        sums = np.empty((len(self.factor), n))
        for k, v in enumerate(self.factor):
            x = v[slot]
            sums[k] = np.bincount(doc, x, n)
            z += 0.5 * (sums[k] ** 2 - np.bincount(doc, x * x, n))
        return z, sums


def association(slot: np.ndarray, doc: np.ndarray, label: np.ndarray, size: int) -> np.ndarray:
    """The G statistic of each slot against the label (0 for slots of fewer than 3 documents)."""

    def entropy(p: np.ndarray) -> np.ndarray:
        p = np.clip(p, 1e-12, 1 - 1e-12)
        return -(p * np.log(p) + (1 - p) * np.log(1 - p))

    n = len(label)
    df, pos = np.bincount(slot, minlength=size), np.bincount(slot, label[doc], minlength=size)
    inside, outside = pos / np.maximum(df, 1), (label.sum() - pos) / np.maximum(n - df, 1)
    g = 2 * n * entropy(label.mean()) - 2 * (df * entropy(inside) + (n - df) * entropy(outside))
    return np.where(df >= 3, g, 0)


def fit(slot: np.ndarray, doc: np.ndarray, label: np.ndarray, bits: int, factors: int, rounds: int = 150, rate: float = 0.06, keep: float = 2e-4, least: float = 25.0, seed: int = 7) -> Machine:
    """Adam on the mean log loss plus an L2 penalty, over the slots whose G statistic is at least `least`."""
    n, size = len(label), 1 << bits
    used = np.flatnonzero(association(slot, doc, label, size) >= least)
    at = np.full(size, -1, np.int64)
    at[used] = np.arange(len(used))
    slot = at[slot]
    doc, slot = doc[slot >= 0], slot[slot >= 0]
    rng = np.random.default_rng(seed)
    rate0 = (label.sum() + 0.5) / (n + 1)
    params = [np.array([np.log(rate0 / (1 - rate0))]), np.zeros(len(used)), *(rng.normal(0, 0.01, len(used)) for _ in range(factors))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, rounds + 1):
        m = Machine(params[0][0], params[1], np.array(params[2:]).reshape(factors, len(used)))
        z, sums = m.raw(slot, doc, n)
        g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - label) / n
        per = g[doc]
        grads = [np.array([g.sum()]), np.bincount(slot, per, len(used)) + keep * params[1] / 10]
        diag = np.bincount(slot, per, len(used))
        for k in range(factors):
            grads.append(np.bincount(slot, per * sums[k][doc], len(used)) - m.factor[k] * diag + keep * m.factor[k])
        for p, q, a, b in zip(params, grads, first, second):
            a += 0.1 * (q - a)
            b += 0.01 * (q * q - b)
            p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-7)
    weight, factor = np.zeros(size, np.float32), np.zeros((factors, size), np.float32)
    weight[used], factor[:, used] = params[1], np.array(params[2:]).reshape(factors, len(used))
    return Machine(float(params[0][0]), weight, factor)


def held_out(doc_id: Column) -> Column:
    """The rows whose labels are never learnt."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, bits: int = 18, factors: int = 4, train_rows: int = 12000) -> Machine | None:
    """A machine fitted to at most train_rows labelled documents that are not held out; None without labels."""
    wanted = (
        labels.select("doc_id", "toxic")
        .where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(train_rows)
    )
    terms = Terms(bits)

    @lean
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, AT_ONCE):
            slot, doc = terms(batch.column(0))
            cuts = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            packed = [slot[a:b].astype(np.int32).tobytes() for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(packed, pa.binary())], ["doc_id", "toxic", "slots"])

    # The sample has at most train_rows rows, which is what makes the broadcast safe.
    sample = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id")
    rows = sample.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "doc_id long, toxic int, slots binary").toArrow()
    if not rows.num_rows:
        return None
    rows = rows.sort_by("doc_id")
    parts = [np.frombuffer(x.as_py(), np.int32) for x in rows.column("slots")]
    doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    return fit(np.concatenate(parts).astype(np.int64), doc, rows.column("toxic").to_numpy().astype(float), bits, factors)


def scores(rows: Iterator[pa.RecordBatch], m: Machine, terms: Terms) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of the batches with the scores of their column text."""
    useful = (m.weight != 0) | (m.factor != 0).any(axis=0)
    for batch in batches(rows, AT_ONCE):
        slot, doc = terms(batch.column(batch.schema.get_field_index("text")), useful)
        yield batch, m.score(slot, doc, batch.num_rows)


def score(docs: DataFrame, machine: Machine | None, bits: int = 18, threshold: float = 0.7) -> DataFrame:
    """All columns of docs with score double and predicted int added (existing columns of these names are replaced)."""
    docs = docs.drop("score", "predicted")
    if machine is None:
        return docs.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)})
    model, terms = docs.sparkSession.sparkContext.broadcast(machine), Terms(bits)

    @lean
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, p in scores(rows, model.value, terms):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    return docs.mapInArrow(run, with_fields(docs, score="double", predicted="int"))
