"""Connected components: inside one array of edges, and of an edge table; confirmation of links within clusters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._checkpoint import checkpoint
from ._lean import lean
from ._packed import pack, pack_sorted, unpack, unpack_sorted


def components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for all nodes of the edges a-b."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        # Hook the roots of both ends and the ends themselves to the smaller label.
        for target in (label[x], label[y], x, y):
            np.minimum.at(new, target, low)
        while True:
            jump = new[new]
            if np.array_equal(jump, new):
                break
            new = jump
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, root) with the same components; at most one for each node."""
    node, root = components(a, b)
    apart = node != root
    return node[apart], root[apart]


def merge_forests(packed: DataFrame, parts: int) -> DataFrame:
    """(a, b) edges from packed rows (a binary, b binary), thinned to a forest in each of `parts` tasks."""

    @lean
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in rows:
            left = [unpack_sorted(x.as_py()) for x in batch.column(0)]
            right = [unpack(x.as_py(), np.int64) for x in batch.column(1)]
            a, b = forest(np.concatenate([a, *left]), np.concatenate([b, *right]))
        for k in range(0, len(a), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(a[k : k + 50_000]), pa.array(b[k : k + 50_000])], ["a", "b"])

    return packed.repartition(parts).mapInArrow(run, "a long, b long")


def pack_edges(a: np.ndarray, b: np.ndarray) -> tuple[bytes, bytes]:
    """Edges as one packed row; a must be ascending."""
    return pack_sorted(a), pack(b)


def _solve(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all edges in one task."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in rows if b.num_rows]
    if parts:
        node, root = components(*(np.concatenate(x) for x in zip(*parts)))
        for k in range(0, len(node), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(node[k : k + 50_000]), pa.array(root[k : k + 50_000])], ["node", "component"])


def connected(edges: DataFrame, few: int = 1_000_000) -> DataFrame:
    """(node, component): every node of edges(a, b) with the smallest node of its component.

    Up to `few` edges, which are counted, fit into one task.  More take
    alternating large-star and small-star steps, each a grouped minimum and a
    join, checkpointed each round; about log(diameter) rounds, until nothing
    changes.  Loops and repeated edges are allowed; nulls are dropped.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = checkpoint(edges)
    if edges.count() <= few:
        return checkpoint(edges.coalesce(1).mapInArrow(_solve, "node long, component long"))
    edges = edges.distinct()
    mark = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        edges = checkpoint(small.select(F.col("v").alias("a"), F.col("m").alias("b")).union(low).where("a <> b").distinct())
        row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(row) == mark:
            break
        mark = tuple(row)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())


def confirmed(clusters: DataFrame, payload: DataFrame, check: Callable, most: int, adaptive: bool = False) -> DataFrame:
    """(node, component): components of the confirmed links among the nodes of each cluster.

    clusters(node, component) says which nodes must be compared, and a node may be
    in several; payload has a column node and what `check` needs.  check is given rows (component, one, two,
    side, node, payload columns) sorted by the first four; it compares all rows
    of a (component, one, two), or only those of side 0 with those of side 1 if
    both occur, and returns confirmed links as packed forests.

    A cluster of up to `most` nodes is one group.  A larger one is cut into
    blocks of about that size, and

    1. each block is compared in itself;
    2. one node of each set found so far is compared with those of the other sets;
    3. what is not in the cluster's largest set by then is compared with every
       node of the cluster.

    So no link between two sets is left out, and a cluster whose nodes mostly
    belong together costs a few texts a node, not one for each other block.
    With adaptive, Spark chooses the number of tasks of 2. and 3. by their bytes,
    else there are as many as shuffle partitions.
    """
    spark = payload.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = [c for c in payload.columns if c != "node"]
    count = lambda n: F.ceil(n / most).cast("int")
    of = lambda blocks, salt=0: F.pmod(F.xxhash64("node", F.lit(salt)), blocks).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    later = () if adaptive else (parts,)

    def run(rows: DataFrame, *number: int) -> DataFrame:
        rows = rows.select("component", "one", "two", "side", "node").join(texts, "node").select("component", "one", "two", "side", "node", *columns)
        rows = rows.repartition(*number, "component", "one", "two").sortWithinPartitions("component", "one", "two", "side")
        return merge_forests(rows.mapInArrow(check, "a binary, b binary"), max(1, parts // 4))

    sizes = clusters.groupBy("component").agg(F.count("*").alias("size"))
    sizes = sizes.withColumn("blocks", count(F.col("size")))
    placed = checkpoint(clusters.join(sizes, "component").select("component", "node", "blocks"))
    texts = payload.join(clusters.select("node").distinct(), "node", "left_semi")
    large = placed.where("blocks > 1")
    if not large.limit(1).count():
        return connected(run(placed.select("component", "node", F.lit(0).alias("one"), F.lit(0).alias("two"), F.lit(0).alias("side")), parts))
    texts = checkpoint(texts)
    own = of(F.col("blocks"))
    edges = checkpoint(run(placed.select("component", "node", own.alias("one"), own.alias("two"), F.lit(0).alias("side")), parts))

    def labelled() -> DataFrame:
        found = connected(edges).withColumnRenamed("component", "label")
        return checkpoint(large.join(found, "node", "left").select("component", "node", "blocks", F.coalesce("label", "node").alias("label")))

    heads = labelled().groupBy("component", "label").agg(F.min("node").alias("node")).drop("label")
    heads = heads.join(heads.groupBy("component").agg(count(F.count("*")).alias("n")), "component")
    mine = heads.withColumn("own", of(F.col("n"), 1)).select("component", "node", "own", upto("n").alias("other"))
    low = F.least("own", "other")
    edges = checkpoint(edges.union(run(mine.select("component", "node", low.alias("one"), F.greatest("own", "other").alias("two"), (F.col("own") > low).cast("int").alias("side")), *later)))
    now = labelled()
    main = now.groupBy("component", "label").count().groupBy("component").agg(F.max(F.struct("count", "label"))["label"].alias("main"))
    rest = now.join(main, "component").where("label <> main").select("component", "node", "blocks")
    some = rest.groupBy("component").agg(count(F.count("*")).alias("n"))
    left = rest.join(some, "component").select("component", "node", of(F.col("n"), 2).alias("one"), upto("blocks").alias("two"), F.lit(0).alias("side"))
    right = now.join(some, "component").select("component", "node", own.alias("two"), upto("n").alias("one"), F.lit(1).alias("side"))
    return connected(edges.union(run(left.unionByName(right), *later)))
