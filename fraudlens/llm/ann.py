"""Approximate nearest neighbours by cosine: an NN-descent graph and greedy search in it.

Rows whose id or vector is null, and vectors that are empty, zero, or hold null
or non-finite components, take no part.  Vectors are only compared with those of
their own length, each length having a graph of its own.  Equal vectors collapse
to one node, so copies of a vector don't fill each other's neighbour lists;
results are expanded to the copies with the smallest ids again.  Of several rows
of one id the one whose vector has the smallest digest counts.  An empty table
gives no rows; scores of equal size go by the smaller id.

Nodes are dealt at random into shards, each small enough for the memory of one
task, and each shard gets a graph of its own.

Building, in the task's memory: nodes get first neighbours from the leaves of a
few trees of random projections, then NN-descent: each round a node's neighbours,
and the nearest `k` of those that have it as one, are compared with one another,
but for pairs that met in a round before.  Rounds go on until fewer than a
hundredth of all list entries change.

Search: each query is searched in each shard's graph, once for all rows that hold
its vector.  Its beam starts from the best of a sample of nodes, and from its own
node in that node's shard; each round expands the best nodes of each beam that are
not yet expanded, by their lists, both ways, until no beam has a node left to
expand.  The best of all shards are then scored again in double precision on the
original vectors.  So recall depends on the size of a shard, whose root the beam
follows, not on the table's; the time of searches grows with queries times shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._checkpoint import checkpoint
from ._lean import lean
from ._packed import runs

def _floats(column: pa.Array, kind: type, dims: int) -> np.ndarray:
    """The rows of a binary column of equal lengths as a matrix."""
    if not len(column):
        return np.zeros((0, dims), kind)
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), dims)


def _ranked(row: np.ndarray, sim: np.ndarray) -> np.ndarray:
    """The order by row and falling similarity (of 30 bits; equal ones by place)."""
    return np.argsort(row.astype(np.int64) << 32 | ((1.5 - sim) * (1 << 30)).astype(np.int64), kind="stable")


class Graph:
    """The k nearest neighbours of unit vectors by NN-descent; places, not ids, and -1 where there are fewer.

    Lists fall by similarity.  `fresh` marks entries that no local join has seen.
    """

    def __init__(self, v: np.ndarray, k: int, leaf: int = 128, trees: int = 4, seed: int = 5):
        m = len(v)
        self.v, self.k = v, min(k, max(m - 1, 1))
        self.near = np.full((m, self.k), -1, np.int32)
        self.sim = np.full((m, self.k), -2, np.float32)
        self.fresh = np.zeros((m, self.k), bool)
        self.held, self.n_held = [], 0
        rng = np.random.default_rng(seed)
        for _ in range(trees if m > leaf else 1):
            self._tree(rng, leaf)
        while self._round() > 0.01 * m * self.k:
            pass
        self.links = np.concatenate([self.near, self._turned()[0]], axis=1)

    def _tree(self, rng: np.random.Generator, leaf: int) -> None:
        """Compares the members of each leaf of a tree of random projections, halved at medians."""
        m, levels = len(self.v), 0
        order = np.arange(m)
        while m >> levels > leaf:
            side = self.v @ rng.normal(size=self.v.shape[1]).astype(np.float32)
            order = order[np.lexsort((side[order], (np.arange(m) << levels) // m))]
            levels += 1
        width = min(m, (m >> levels) + 1)
        starts = np.minimum((np.arange(1 << levels) * m) >> levels, m - width)
        top = min(self.k, width - 1)
        if not top:
            return
        for a in range(0, len(starts), 64):
            who = order[starts[a : a + 64, None] + np.arange(width)]
            block = self.v[who]
            s = block @ block.transpose(0, 2, 1)
            s[:, np.arange(width), np.arange(width)] = -3
            pick = np.argpartition(-s, top - 1, axis=2)[:, :, :top]
            other = np.take_along_axis(np.broadcast_to(who[:, None, :], s.shape), pick, axis=2)
            self._offer(np.repeat(who.reshape(-1), top), other.reshape(-1), np.take_along_axis(s, pick, axis=2).reshape(-1))
        self._take()

    def _offer(self, target: np.ndarray, other: np.ndarray, sim: np.ndarray) -> None:
        self.held.append((target, other, sim))
        self.n_held += len(target)
        if self.n_held > 2_000_000:
            self._take()

    def _take(self) -> int:
        """Puts the best of what was offered into the lists; how many entries are new."""
        if not self.n_held:
            return 0
        m, k = len(self.v), self.k
        target, other, sim = (np.concatenate(x) for x in zip(*self.held))
        self.held, self.n_held = [], 0
        ok = (sim > self.sim[target, -1]) & (target != other)
        target, other, sim = target[ok], other[ok], sim[ok]
        at = np.unique(target)
        n = len(at)
        old = self.near[at].reshape(-1)
        there = old >= 0
        row = np.r_[np.repeat(np.arange(n), k)[there], np.searchsorted(at, target)]
        other = np.r_[old[there], other].astype(np.int64)
        sim = np.r_[self.sim[at].reshape(-1)[there], sim]
        # Of one neighbour the old entry stays; 0: joined before, 1: in the list, 2: offered now.
        age = np.r_[self.fresh[at].reshape(-1)[there].astype(np.int64), np.full(len(target), 2)]
        order = np.argsort((row * m + other) * 3 + age)
        row, other, sim, age = row[order], other[order], sim[order], age[order]
        first = np.r_[True, (row[1:] != row[:-1]) | (other[1:] != other[:-1])][: len(row)]
        row, other, sim, age = row[first], other[first], sim[first], age[first]
        order = _ranked(row, sim)
        row, other, sim, age = row[order], other[order], sim[order], age[order]
        place = np.arange(len(row)) - np.searchsorted(row, np.arange(n))[row]
        keep = place < k
        row, other, sim, age, place = row[keep], other[keep], sim[keep], age[keep], place[keep]
        near, sims, fresh = np.full((n, k), -1, np.int32), np.full((n, k), -2, np.float32), np.zeros((n, k), bool)
        near[row, place], sims[row, place], fresh[row, place] = other, sim, age > 0
        self.near[at], self.sim[at], self.fresh[at] = near, sims, fresh
        return int((age == 2).sum())

    def _turned(self) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, fresh): for each node the k nearest that have it as a neighbour and aren't its neighbours."""
        m, k = self.near.shape
        own, place = np.nonzero(self.near >= 0)
        to = self.near[own, place]
        order = _ranked(to, self.sim[own, place])
        own, place, to = own[order], place[order], to[order]
        both = np.concatenate([(self.near[to[a : a + 65536]] == own[a : a + 65536, None]).any(axis=1) for a in range(0, len(to), 65536)] or [np.zeros(0, bool)])
        own, place, to = own[~both], place[~both], to[~both]
        at = np.arange(len(to)) - np.searchsorted(to, np.arange(m))[to]
        ok = at < k
        back, fresh = np.full((m, k), -1, np.int32), np.zeros((m, k), bool)
        back[to[ok], at[ok]], fresh[to[ok], at[ok]] = own[ok], self.fresh[own[ok], place[ok]]
        return back, fresh

    def _round(self, size: int = 512) -> int:
        """Compares each node's neighbours, both ways, with one another, but for pairs that met before; how many list entries changed."""
        back, new = self._turned()
        members, new = np.concatenate([self.near, back], axis=1), np.concatenate([self.fresh, new], axis=1)
        self.fresh[:] = False
        changed = 0
        for a in range(0, len(members), size):
            some = new[a : a + size].any(axis=1)
            who, fresh = members[a : a + size][some], new[a : a + size][some]
            block = self.v[who]
            s = block @ block.transpose(0, 2, 1)
            # An end that isn't there takes nothing and is nothing.
            low = np.where(who >= 0, self.sim[who, -1], 9)
            better = s > low[:, :, None]
            better &= fresh[:, :, None] | fresh[:, None, :]
            better &= (who >= 0)[:, None, :]
            g, i, j = np.nonzero(better)
            self.held.append((who[g, i], who[g, j], s[g, i, j]))
            self.n_held += len(g)
            if self.n_held > 2_000_000:
                changed += self._take()
        return changed + self._take()

    def search(self, q: np.ndarray, beam: int, width: int, own: np.ndarray, sample: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """(places, similarities) of each query's beam, -1 where nothing stands; own is a query's own place, or -1.

        A beam starts from the best of a sample of nodes and from the own place;
        each round expands its best `width` nodes that aren't yet expanded, until
        none is left.
        """
        m, out = len(self.v), []
        some = np.unique(np.linspace(0, m - 1, min(m, sample)).astype(np.int64))
        # What a group of queries has seen is a bit map of 32 MB.
        for a in range(0, len(q), size := max(1, min(512, (1 << 25) // m))):
            part, mine = q[a : a + size], own[a : a + size]
            n = len(part)
            seen = np.zeros(n * m, bool)
            s = part @ self.v[some].T
            pick = np.argsort(-s, axis=1)[:, : beam // 2 + 1]
            ids = np.full((n, beam), -1, np.int64)
            sims = np.full((n, beam), -3, np.float32)
            c = min(beam, pick.shape[1])
            ids[:, :c], sims[:, :c] = some[pick[:, :c]], np.take_along_axis(s, pick[:, :c], axis=1)
            row, col = np.nonzero(ids >= 0)
            seen[row * m + ids[row, col]] = True
            has = np.flatnonzero(mine >= 0)
            has = has[~seen[has * m + mine[has]]]
            ids[has, -1], sims[has, -1] = mine[has], 1
            seen[has * m + mine[has]] = True
            order = np.argsort(-sims, axis=1, kind="stable")
            ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
            done = ids < 0
            while not done.all():
                now = ~done & (np.cumsum(~done, axis=1) <= width)
                row, col = np.nonzero(now)
                done |= now
                to = self.links[ids[row, col]]
                at = (row[:, None] * m + to)[to >= 0]
                at = np.unique(at[~seen[at]])
                seen[at] = True
                row, to = at // m, at % m
                s = np.concatenate([np.einsum("ij,ij->i", part[row[b : b + 8192]], self.v[to[b : b + 8192]]) for b in range(0, len(at), 8192)] or [np.zeros(0, np.float32)])
                ok = s > sims[row, -1]
                row, to, s = row[ok], to[ok], s[ok]
                place = np.arange(len(row)) - np.searchsorted(row, np.arange(n))[row]
                more = int(place.max()) + 1 if len(place) else 0
                ids_, sims_, done_ = np.full((n, beam + more), -1, np.int64), np.full((n, beam + more), -3, np.float32), np.ones((n, beam + more), bool)
                ids_[:, :beam], sims_[:, :beam], done_[:, :beam] = ids, sims, done
                ids_[row, beam + place], sims_[row, beam + place], done_[row, beam + place] = to, s, False
                order = np.argsort(-sims_, axis=1, kind="stable")[:, :beam]
                ids, sims, done = (np.take_along_axis(x, order, 1) for x in (ids_, sims_, done_))
            out.append((ids, sims))
        return tuple(np.concatenate(x) for x in zip(*out))


def _units(vec: np.ndarray) -> np.ndarray:
    """Rows over their lengths, in double precision, without overflow or underflow for any finite components."""
    big = np.abs(vec).max(axis=1, keepdims=True)
    # Plain values stay as they are.
    unit = np.where((big > 1e100) | (big < 1e-100), vec / big, vec)
    return unit / np.sqrt((unit * unit).sum(axis=1, keepdims=True))


def _normalised(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        if batch.num_rows:
            vec = np.array(batch.column(1).to_pylist(), np.float64)
            unit = _units(vec).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes() for v in unit], pa.binary()), pa.array([v.tobytes() for v in vec], pa.binary())], ["id", "vec", "exact"])


def nodes(table: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, d, class, vec, exact) of the rows that take part; d is the vector's length, class the smallest id of equal vectors."""
    value = F.col(vector).cast("array<double>")
    ok = table.select(F.col(key).cast("long").alias("id"), value.alias("e")).where("id IS NOT NULL AND e IS NOT NULL")
    bad = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = ok.where(~F.coalesce(bad, F.lit(True)) & F.exists("e", lambda x: x != 0))
    units = ok.select("id", "e").mapInArrow(_by_length, "id long, vec binary, exact binary")
    units = units.groupBy("id").agg(F.min(F.struct(F.md5("exact").alias("h"), "vec", "exact")).alias("u")).select("id", "u.*")
    units = checkpoint(units)
    classes = units.groupBy("h").agg(F.min("id").alias("class"))
    return checkpoint(units.join(classes, "h").select("id", (F.octet_length("exact") / 8).cast("int").alias("d"), "class", "vec", "exact"))


def _by_length(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_normalised() for the vectors of each length."""
    for batch in rows:
        sizes = np.diff(batch.column(1).offsets.to_numpy())
        for d in np.unique(sizes):
            yield from _normalised(iter([batch.filter(pa.array(sizes == d))]))


def _find(dims: int, k: int, beam: float, width: int, most: int):
    """(q, nb, sim) over rows (key, kind, id, vec) sorted by key and kind: the nodes of a shard (kind 0) become its graph, its queries (kind 1) are searched there."""

    @lean
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, vecs, graph = None, [], [], None
        for whole in rows:
            for start in range(0, whole.num_rows, 2000):
                batch = whole.slice(start, 2000)
                both = batch.column(0).to_numpy().astype(np.int64) * 2 + batch.column(1).to_numpy()
                own, v = batch.column(2).to_numpy(), _floats(batch.column(3), np.float32, dims)
                for a, b in runs(both):
                    if both[a] // 2 != at:
                        at, ids, vecs, graph = both[a] // 2, [], [], None
                    if both[a] % 2 == 0:
                        ids.append(own[a:b])
                        vecs.append(v[a:b])
                        continue
                    if not ids:
                        continue
                    if graph is None:
                        names = np.concatenate(ids)
                        order = np.argsort(names)
                        names, vec = names[order], np.concatenate(vecs)[order]
                        vecs = []
                        graph = Graph(vec, k)
                    place = np.minimum(np.searchsorted(names, own[a:b]), len(names) - 1)
                    place = np.where(names[place] == own[a:b], place, -1)
                    found, sims = graph.search(v[a:b], max(most, int(beam * np.sqrt(len(names)))), width, place)
                    found, sims = found[:, :most], sims[:, :most]
                    nb = [names[f[f >= 0]].tobytes() for f in found]
                    yield pa.RecordBatch.from_arrays([pa.array(own[a:b]), pa.array(nb, pa.binary()), pa.array([x[f >= 0].tobytes() for f, x in zip(found, sims)], pa.binary())], ["q", "nb", "sim"])

    return run


def _nearest(most: int):
    """(q, class) of the best of all shards' lists, and each query itself for its copies."""

    @lean
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            q, found = [], []
            for i, lists in zip(*(batch.column(c).to_pylist() for c in range(2))):
                n = np.frombuffer(b"".join(x["nb"] for x in lists), np.int64)
                sim = np.frombuffer(b"".join(x["sim"] for x in lists), np.float32)
                n = n[np.lexsort((n, -sim))[:most]].tolist()
                n = list(dict.fromkeys([i, *n]))
                q += [i] * len(n)
                found += n
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(found, pa.int64())], ["q", "class"])

    return run


def _exact(dims: int):
    @lean
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            if batch.num_rows:
                a, b = _floats(batch.column(1), np.float64, dims), _floats(batch.column(3), np.float64, dims)
                plain = (np.abs(a).max(axis=1) < 1e100) & (np.abs(b).max(axis=1) < 1e100) & (np.abs(a).max(axis=1) > 1e-100) & (np.abs(b).max(axis=1) > 1e-100)
                score = (_units(a) * _units(b)).sum(axis=1)
                a, b = a[plain], b[plain]
                score[plain] = (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score)], ["own", "class", "score"])

    return run


_RESULT = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])


def search(table: DataFrame, wanted: Column, top: int = 5, key: str = "vec_id", vector: str = "embedding", **options) -> DataFrame:
    """query_id, rank, vec_id and score of the nearest rows to each row of the table that `wanted` holds for.

    `wanted` is a condition on the column id.  The result has fewer than `top`
    rows for a query only if fewer other rows take part.
    """
    all_nodes = nodes(table, key, vector)
    out = None
    for row in all_nodes.select("d").distinct().orderBy("d").collect():  # lengths of vectors, usually one
        one = _search(all_nodes.where(F.col("d") == row.d).drop("d"), row.d, wanted, top, **options)
        out = one if out is None else out.union(one)
    return table.sparkSession.createDataFrame([], _RESULT) if out is None else out


def _keys(spark: SparkSession, n: int) -> list[int]:
    """A number for each of n partitions that hashing sends there, so that no two shards share one."""
    wide = 20 * n + 200
    rows = spark.range(wide).select(F.col("id").cast("int").alias("k")).groupBy(F.expr(f"pmod(hash(k), {n})").alias("p")).agg(F.min("k").alias("k")).collect()
    keys = {r.p: r.k for r in rows}
    return [keys.get(p, wide + p) for p in range(n)]


def _search(all_nodes: DataFrame, dims: int, wanted: Column, top: int, k: int = 24, beam: float = 1.0, width: int = 16, shard: int = 1 << 23, least: int = 2048) -> DataFrame:
    """search() among vectors of one length; shards hold about `shard` components, `least` nodes if there are cores enough, beams `beam` times the root of a shard's nodes."""
    spark = all_nodes.sparkSession
    reps = all_nodes.where("id = class").select("id", "vec")
    n = reps.count()
    shards = max(-(-n * dims // shard), min(spark.sparkContext.defaultParallelism, -(-n // least)), 1)
    keys = F.array(*map(F.lit, _keys(spark, shards)))
    key = lambda place: F.element_at(keys, (place + 1).cast("int"))
    # Equal queries are searched once; equal vectors have equal units.
    asked = all_nodes.where(wanted).groupBy("class").agg(F.first("vec").alias("vec"))
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("s"), "class", "vec").select(key(F.col("s")).alias("key"), F.lit(1).alias("kind"), F.col("class").alias("id"), "vec")
    dealt = reps.select(key(F.expr(f"pmod(xxhash64(id), {shards})")).alias("key"), F.lit(0).alias("kind"), "id", "vec").union(asked)
    found = dealt.repartition(shards, "key").sortWithinPartitions("key", "kind").mapInArrow(_find(dims, k, beam, width, 2 * top + 1), "q long, nb binary, sim binary")
    found = found.groupBy("q").agg(F.collect_list(F.struct("nb", "sim")).alias("lists")).mapInArrow(_nearest(4 * top), "q long, class long")
    exact = all_nodes.where("id = class").select("class", "exact")
    scored = found.join(exact.withColumnRenamed("exact", "other"), "class").join(exact.withColumnRenamed("class", "q"), "q").select("q", "exact", "class", "other").mapInArrow(_exact(dims), "own long, class long, score double")
    copies = all_nodes.select("class", F.col("id").alias("vec_id")).withColumn("c", F.row_number().over(Window.partitionBy("class").orderBy("vec_id"))).where(F.col("c") <= top + 1).drop("c")
    # A query leaves out one row, its own, of the class's best.
    best = scored.join(copies, "class").withColumn("r", F.row_number().over(Window.partitionBy("own").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= top + 1)
    best = best.groupBy("own").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("best"))
    rows = all_nodes.where(wanted).select(F.col("id").alias("query_id"), F.col("class").alias("own")).join(best, "own")
    rows = rows.select("query_id", F.posexplode(F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, top)).alias("at", "x"))
    return rows.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
