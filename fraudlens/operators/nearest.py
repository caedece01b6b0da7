"""Nearest centroids, and nearest vectors, by matrix products over Arrow batches.

All values are integers below 2**24 in magnitude and all sums of their products
are below 2**53, so the products are exact in doubles and the results equal
integer arithmetic.  Centroids are bounded (at most 2048), which is what makes
it safe to send them to every executor; a vector's nearest ones are found in its
own row, without a shuffle.

Vectors are searched in one of two ways.  A table counted to be small is held by
every worker (`Held`), and a query's nearest are found in its own row.  A larger
one meets its queries in groups of bounded size (`nearest_in_groups`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import DIMS, MAX_CENTROIDS, QUANTISED_LIMIT

_ROWS = 2048  # vectors compared at once, which bounds the matrix of distances
_SPAN = 4096  # vectors that one product compares with queries
_AREA = 1 << 20  # distances in one product
GROUP = 8192  # vectors in a group
#: An entry of a held table is packed as distance, rank of its cell and place, in 36 + 8 + 19 bits: their order is that of the result.
_RANK_BITS, _PLACE_BITS = 8, 19
MAX_HELD, MAX_HELD_PROBES = 1 << _PLACE_BITS, 1 << _RANK_BITS
_NONE = np.iinfo(np.int64).max
assert DIMS * (2 * QUANTISED_LIMIT) ** 2 < 1 << 36


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)[:, :DIMS]


class _Centroids:
    def __init__(self, centroids: DataFrame, scale: int):
        rows = sorted((r.cell_id, r.c[:DIMS]) for r in centroids.select("cell_id", "c").collect())
        if len(rows) > MAX_CENTROIDS:
            raise ValueError(f"more than {MAX_CENTROIDS} centroids")
        self.cells = np.array([c for c, _ in rows], np.int64)
        self.c = np.array([v for _, v in rows], np.float64).reshape(len(rows), DIMS)
        self.squares = (self.c * self.c).sum(axis=1)
        self.scale = float(scale)

    def distances(self, q: np.ndarray) -> np.ndarray:
        """Exact squared distances, vectors by centroids."""
        q = q * self.scale
        return ((q * q).sum(axis=1)[:, None] - 2 * (q @ self.c.T) + self.squares).astype(np.int64)

    def nearest(self, q: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, distances) of the n nearest centroids of each vector, ties to the lower cell."""
        d = self.distances(q)
        packed = d * MAX_CENTROIDS + np.arange(len(self.cells))
        n = min(n, len(self.cells))
        best = packed.min(axis=1, keepdims=True) if n == 1 else np.sort(np.partition(packed, n - 1, axis=1)[:, :n], axis=1)
        return best % MAX_CENTROIDS, best // MAX_CENTROIDS


def nearest_cells(vectors: DataFrame, key: str, centroids: DataFrame, n: int, scale: int = 1) -> DataFrame:
    """(key, cell_id, d, rank): the n nearest centroids of each vector q (scaled up by `scale`), rank from 1."""
    m = _Centroids(centroids, scale)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for k in range(0, batch.num_rows, _ROWS):
                part = batch.slice(k, _ROWS)
                at, d = m.nearest(_matrix(part.column(1)), n)
                keys = part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), at.shape[1])))
                rank = np.tile(np.arange(1, at.shape[1] + 1, dtype=np.int32), part.num_rows)
                yield pa.RecordBatch.from_arrays([keys, pa.array(m.cells[at.reshape(-1)].astype(np.int32)), pa.array(d.reshape(-1)), pa.array(rank)], [key, "cell_id", "d", "rank"])

    kind = vectors.schema[key].dataType.simpleString()
    return vectors.select(key, "q").where("q IS NOT NULL").mapInArrow(run, f"{key} {kind}, cell_id int, d bigint, rank int")


def cell_sums(vectors: DataFrame, centroids: DataFrame, scale: int) -> DataFrame:
    """(cell_id, n, s0, s1, ...): counts and sums of the scaled vectors nearest to each centroid, summed up in each batch already."""
    m = _Centroids(centroids, scale)
    names = ["cell_id", "n", *(f"s{i}" for i in range(DIMS))]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(len(m.cells), np.int64), np.zeros((len(m.cells), DIMS), np.int64)
        for batch in rows:
            for k in range(0, batch.num_rows, _ROWS):
                q = _matrix(batch.slice(k, _ROWS).column(0))
                at = m.nearest(q, 1)[0][:, 0]
                n += np.bincount(at, minlength=len(n))
                np.add.at(sums, at, (q * m.scale).astype(np.int64))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(m.cells[some].astype(np.int32)), pa.array(n[some]), *(pa.array(sums[some, i]) for i in range(DIMS))], names)

    parts = vectors.select("q").where("q IS NOT NULL").mapInArrow(run, "cell_id int, " + ", ".join(f"{c} bigint" for c in names[1:]))
    return parts.groupBy("cell_id").agg(*(F.sum(c).alias(c) for c in names[1:]))


def _augmented(v: np.ndarray) -> np.ndarray:
    """Columns that make _products() give distance * _SPAN * 2 + column: exact, as it is below 2**50."""
    v = v.astype(np.float64)
    return np.vstack([v.T, (v * v).sum(axis=1) * (2 * _SPAN) + np.arange(len(v)), np.ones(len(v))])


def _products(q: np.ndarray, columns: np.ndarray) -> np.ndarray:
    return np.hstack([q * (-4.0 * _SPAN), np.ones((len(q), 1)), (q * q).sum(axis=1, keepdims=True) * (2 * _SPAN)]) @ columns


def _improve(best: np.ndarray, rows: np.ndarray, ranks: np.ndarray, q: np.ndarray, v: np.ndarray, first: int) -> None:
    """Takes the vectors v, at places from `first`, into the packed entries best[rows] (sorted; as many are kept)."""
    k = best.shape[1]
    for at in range(0, len(v), _SPAN):
        columns = _augmented(v[at : at + _SPAN])
        step = max(1, _AREA // columns.shape[1])
        for i in range(0, len(rows), step):
            r, rank = rows[i : i + step], ranks[i : i + step]
            found = _products(q[r], columns)
            # At most as far as the last entry: one at its distance may win the tie.
            near = found.min(axis=1).astype(np.int64) // (2 * _SPAN) <= best[r, -1] >> (_RANK_BITS + _PLACE_BITS)
            if not near.any():
                continue
            found, r, rank = found[near], r[near], rank[near]
            if found.shape[1] > k:
                found = np.partition(found, k - 1, axis=1)[:, :k]
            found = found.astype(np.int64)
            d, place = found // (2 * _SPAN), found % (2 * _SPAN) + (first + at)
            entry = (((d << _RANK_BITS) + rank[:, None]) << _PLACE_BITS) + place
            best[r] = np.sort(np.hstack([best[r], entry]), axis=1)[:, :k]


class Held:
    """Vectors in the order of their ties, in cells one after another; at most MAX_HELD."""

    def __init__(self, table: pa.Table, centroids: DataFrame | None = None):
        """`table` has id, label and q, is sorted, and has cell_id and pos if there are centroids."""
        table = table.combine_chunks()
        self.table = table.drop_columns(["q"])
        self.q = _matrix(table["q"]).astype(np.int16) if len(table) else np.zeros((0, DIMS), np.int16)
        self.labels = table["label"].fill_null(0).to_numpy().astype(np.int64)
        self.centroids = _Centroids(centroids, 1) if centroids is not None else None
        if self.centroids:
            cells = table["cell_id"].to_numpy()
            self.start = np.searchsorted(cells, self.centroids.cells, "left")
            self.end = np.searchsorted(cells, self.centroids.cells, "right")

    def search(self, q: np.ndarray, nprobe: int, k: int) -> np.ndarray:
        """Packed entries of the k nearest in the nprobe nearest cells, ties in scan order; _NONE where there are fewer."""
        best = np.full((len(q), k), _NONE)
        if not self.centroids:
            _improve(best, np.arange(len(q)), np.zeros(len(q), np.int64), q, self.q, 0)
            return best
        probes = self.centroids.nearest(q, nprobe)[0].astype(np.int64)
        for ranks in (np.arange(1), np.arange(1, probes.shape[1])):  # the nearest cell first: it bounds the others
            flat = probes[:, ranks].reshape(-1)
            order = np.argsort(flat, kind="stable")
            edges = np.searchsorted(flat[order], np.arange(len(self.start) + 1))
            for c in np.flatnonzero(np.diff(edges)):
                at = order[edges[c] : edges[c + 1]]
                _improve(best, at // len(ranks), ranks[at % len(ranks)], q, self.q[self.start[c] : self.end[c]], self.start[c])
        return best

    def rows(self, queries: DataFrame, nprobe: int, k: int) -> DataFrame:
        """(qid, rn, id, label, d, pos, vq) of the k nearest of each query; pos only with cells."""
        held, key = self, queries.schema["qid"].dataType.simpleString()
        kinds = [("id", _kind(self.table["id"])), ("label", _kind(self.table["label"]))]
        extra = ["pos"] if self.centroids else []

        def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for qid, q in _chunks(rows):
                best = held.search(q, nprobe, k)
                r, rn = np.nonzero(best != _NONE)
                entry = best[r, rn]
                place = entry & (MAX_HELD - 1)
                at = pa.array(place)
                own = {c: held.table[c].take(at).combine_chunks() for c in ("id", "label", *extra)}
                d = pa.array(entry >> (_RANK_BITS + _PLACE_BITS))
                yield pa.RecordBatch.from_arrays([qid.take(pa.array(r)), pa.array((rn + 1).astype(np.int32)), own["id"], own["label"], d, *(own[c] for c in extra), _lists(held.q[place])], ["qid", "rn", "id", "label", "d", *extra, "vq"])

        schema = f"qid {key}, rn int, " + ", ".join(f"{n} {t}" for n, t in kinds) + ", d bigint, " + "".join(f"{c} bigint, " for c in extra) + "vq array<smallint>"
        return queries.select("qid", "q").where("q IS NOT NULL").mapInArrow(run, schema)

    def votes(self, queries: DataFrame, nprobe: int, k: int, scale: float) -> DataFrame:
        """(qid, fraud_count, bits): the k nearest, ranked by the unquantised query x (ties in the quantised order)."""
        held, key = self, queries.schema["qid"].dataType.simpleString()

        def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for qid, q, x in _chunks(rows, exact=True):
                best = held.search(q, nprobe, k)
                place = best & (MAX_HELD - 1)
                some = best != _NONE
                place[~some] = 0
                d = np.zeros(best.shape)
                for i in range(DIMS):  # summed in the order of the dimensions, as squared_distance_exact() does
                    step = x[:, i : i + 1] - held.q[place, i] / scale
                    d += step * step
                d[~some] = np.inf
                order = np.argsort(np.where(np.isnan(d), np.finfo(float).max, d), axis=1, kind="stable")
                fraud = np.where(some, held.labels[place], 0)
                bits = (np.take_along_axis(fraud, order, 1) << np.arange(k)).sum(axis=1)
                out = pa.RecordBatch.from_arrays([qid, pa.array(fraud.sum(axis=1).astype(np.int32)), pa.array(bits.astype(np.int32))], ["qid", "fraud_count", "bits"])
                yield out.filter(pa.array(some.any(axis=1)))

        return queries.select("qid", "q", "x").where("q IS NOT NULL").mapInArrow(run, f"qid {key}, fraud_count int, bits int")


def _kind(column: pa.ChunkedArray) -> str:
    from pyspark.sql.pandas.types import from_arrow_type

    return from_arrow_type(column.type).simpleString()


def _lists(q: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, q.size + 1, DIMS, dtype=np.int32)), pa.array(q.reshape(-1)))


def _chunks(rows: Iterator[pa.RecordBatch], exact: bool = False) -> Iterator[tuple]:
    """(qid, q) or, if exact, (qid, q, x) of at most 2 * _ROWS queries."""
    for batch in rows:
        for k in range(0, batch.num_rows, 2 * _ROWS):
            part = batch.slice(k, 2 * _ROWS)
            yield (part.column(0), *(_matrix(part.column(i)) for i in range(1, 3 if exact else 2)))


def nearest_in_groups(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(qid, cell_rank, pos, id, label, vq, d): the k nearest vectors of a query's group, ties to the lower pos.

    `queries` has grp, qid, cell_rank and q, `vectors` grp, pos, id, label and q.
    A group's vectors come before its queries in one task and are all that is
    held, so groups should hold about GROUP vectors.
    """
    kind = {c: vectors.schema[c].dataType.simpleString() for c in ("pos", "id", "label")}
    key = queries.schema["qid"].dataType.simpleString()
    null = lambda t, c: F.lit(None).cast(t).alias(c)
    held = vectors.select("grp", F.lit(0).alias("asks"), "pos", "id", "label", null(key, "qid"), null("int", "cell_rank"), "q")
    asked = queries.select("grp", F.lit(1).alias("asks"), *(null(t, c) for c, t in kind.items()), "qid", F.col("cell_rank").cast("int").alias("cell_rank"), "q")
    rows = held.unionByName(asked).where("q IS NOT NULL").repartition("grp").sortWithinPartitions("grp", "asks", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, kept, spans = None, [], None
        for batch in batches:
            grp, asks = batch["grp"].to_numpy(), batch["asks"].to_numpy()
            edges = [0, *(np.flatnonzero((np.diff(grp) != 0) | (np.diff(asks) != 0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if grp[a] != group:
                    group, kept, spans = grp[a], [], None
                part = batch.slice(a, b - a)
                if not asks[a]:
                    kept.append(part.select(["pos", "id", "label", "q"]))
                elif kept:
                    if spans is None:
                        table = pa.Table.from_batches(kept).combine_chunks()
                        v = _matrix(table["q"])
                        spans = [(i, _augmented(v[i : i + _SPAN])) for i in range(0, len(v), _SPAN)]
                    for i in range(0, part.num_rows, _AREA // _SPAN):
                        yield answer(part.slice(i, _AREA // _SPAN), table, v, spans)

    def answer(part: pa.RecordBatch, table: pa.Table, v: np.ndarray, spans: list) -> pa.RecordBatch:
        q, best = _matrix(part["q"]), None
        for first, columns in spans:
            found = _products(q, columns)
            if found.shape[1] > k:
                found = np.partition(found, k - 1, axis=1)[:, :k]
            found = found.astype(np.int64)
            found = np.stack([found // (2 * _SPAN), found % (2 * _SPAN) + first])
            best = found if best is None else np.concatenate([best, found], axis=2)
        order = np.lexsort((best[1], best[0]), axis=1)[:, :k]
        d, place = np.take_along_axis(best[0], order, 1).reshape(-1), np.take_along_axis(best[1], order, 1).reshape(-1)
        row, at = pa.array(np.repeat(np.arange(len(q)), order.shape[1])), pa.array(place)
        own = [table[c].take(at).combine_chunks() for c in ("pos", "id", "label")]
        return pa.RecordBatch.from_arrays([part["qid"].take(row), part["cell_rank"].take(row), *own, _lists(v[place].astype(np.int16)), pa.array(d)], ["qid", "cell_rank", "pos", "id", "label", "vq", "d"])

    return rows.mapInArrow(run, f"qid {key}, cell_rank int, " + ", ".join(f"{c} {t}" for c, t in kind.items()) + ", vq array<smallint>, d bigint")
