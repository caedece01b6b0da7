"""Building, writing, reading and checking the inverted-file index.

Vectors have columns id, q (array<smallint>) and label.  Centroids are bounded
(at most 2048), so they are sent to the vectors, and a Lloyd step shuffles
nothing but sums.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..lineage import checkpoint
from .nearest import cell_sums, nearest_cells

MAGIC = "fraudlens-ivf"


@dataclass
class Index:
    """centroids(cell_id, c), cells(cell_id, cnt, start, min_q, max_q), blocks(cell_id, block_no, n, min_q, max_q), vectors(cell_id, pos, block_no, id, q, label, d_own), meta(one row)."""

    centroids: DataFrame
    cells: DataFrame
    blocks: DataFrame
    vectors: DataFrame
    meta: DataFrame


def hash_order() -> Column:
    """A fixed pseudo-random order of ids: multiplicative hashing."""
    return F.pmod(F.pmod(F.col("id"), F.lit(1 << 31)) * F.lit(2654435761), F.lit(1 << 32))


def initial_centroids(vectors: DataFrame, k: int, order: Column | None = None) -> DataFrame:
    """(cell_id, c): k vectors in the given order (default: a hash of the id), at fine resolution."""
    if not 1 <= k <= S.MAX_CENTROIDS:
        raise ValueError(f"the number of centroids must be 1 to {S.MAX_CENTROIDS}")
    order = hash_order() if order is None else order
    first = vectors.orderBy(order, "id").limit(k)
    # k rows at most.
    numbered = first.withColumn("cell_id", F.row_number().over(Window.orderBy(order, "id")) - 1)
    return numbered.select("cell_id", F.transform("q", lambda x: x.cast("bigint") * S.CENTROID_FINE).alias("c"))


def assign(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """(id, cell_id, d): the nearest fine centroid of each vector, ties to the lowest cell; no shuffle."""
    return nearest_cells(vectors, "id", centroids, 1, S.CENTROID_FINE).select("id", "cell_id", "d")


def lloyd_step(vectors: DataFrame, centroids: DataFrame, initial: DataFrame) -> DataFrame:
    """New fine centroids: means of the assigned vectors; a cell that lost all gets its initial vector back.

    What is shuffled is a row for each task and cell.
    """
    sums = cell_sums(vectors, centroids, S.CENTROID_FINE)
    mean = F.array(*(F.expr(f"cast(signum(s{i}) as bigint) * ((2 * abs(s{i}) + n) div (2 * n))") for i in range(S.DIMS)))
    return initial.join(sums.select("cell_id", mean.alias("mean")), "cell_id", "left").select("cell_id", F.coalesce("mean", "c").alias("c"))


def kmeans(vectors: DataFrame, k: int, iterations: int = S.KMEANS_ITERATIONS, order: Column | None = None) -> DataFrame:
    """Fine centroids after exactly `iterations` Lloyd steps."""
    spark, schema = vectors.sparkSession, "cell_id int, c array<bigint>"
    local = lambda c: spark.createDataFrame(c.select("cell_id", "c").collect(), schema)  # noqa: E731  2048 rows at most
    initial = centroids = local(initial_centroids(vectors, k, order))
    if initial.count() < k:
        raise ValueError(f"fewer than {k} vectors")
    for _ in range(iterations):
        centroids = local(lloyd_step(vectors, centroids, initial))
    return centroids


def stored(centroids: DataFrame) -> DataFrame:
    """Centroids at the resolution of the vectors."""
    return centroids.select("cell_id", F.transform("c", lambda x: F.round(x / F.lit(float(S.CENTROID_FINE))).cast("smallint")).alias("c"))


def bounds(rows: DataFrame, *keys: str) -> DataFrame:
    """n, min_q and max_q of each group."""
    low = [F.min(F.col("q")[i]).alias(f"lo{i}") for i in range(S.DIMS)]
    high = [F.max(F.col("q")[i]).alias(f"hi{i}") for i in range(S.DIMS)]
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), *low, *high)
    return out.select(*keys, "n", F.array(*(f"lo{i}" for i in range(S.DIMS))).alias("min_q"), F.array(*(f"hi{i}" for i in range(S.DIMS))).alias("max_q"))


def offsets(assigned: DataFrame, centroids: DataFrame) -> DataFrame:
    """(cell_id, cnt, start) of every cell, empty ones too; the running sum is over 2048 rows at most."""
    counts = centroids.select("cell_id").join(assigned.groupBy("cell_id").count(), "cell_id", "left").select("cell_id", F.coalesce("count", F.lit(0)).alias("cnt"))
    upto = Window.orderBy("cell_id").rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("start", F.sum("cnt").over(upto) - F.col("cnt"))


def ordered(vectors: DataFrame, assigned: DataFrame, cells: DataFrame, block_size: int) -> DataFrame:
    """Vectors in cell order: by distance to the own centroid, then id; pos counts over all cells."""
    rn = F.row_number().over(Window.partitionBy("cell_id").orderBy("d", "id"))
    out = vectors.join(assigned, "id").withColumn("rn", rn).join(F.broadcast(cells.select("cell_id", "start")), "cell_id")
    return out.select("cell_id", (F.col("start") + F.col("rn") - 1).cast("bigint").alias("pos"), F.floor((F.col("rn") - 1) / block_size).cast("int").alias("block_no"), "id", "q", "label", F.col("d").alias("d_own"))


def build(vectors: DataFrame, k: int = S.MAX_CENTROIDS, iterations: int = S.KMEANS_ITERATIONS, block_size: int = S.BLOCK_SIZE, order: Column | None = None) -> Index:
    """Assigns by the fine centroids and only then quantises them."""
    fine = kmeans(vectors, k, iterations, order)
    assigned = checkpoint(assign(vectors, fine))
    cells = offsets(assigned, fine)
    rows = checkpoint(ordered(vectors, assigned, cells, block_size))
    zero = F.array(*[F.lit(0).cast("smallint")] * S.DIMS)
    boxed = cells.join(bounds(rows, "cell_id").drop("n"), "cell_id", "left").select("cell_id", "cnt", "start", F.coalesce("min_q", zero).alias("min_q"), F.coalesce("max_q", zero).alias("max_q"))
    meta = rows.agg(F.count("*").alias("num_vectors")).select(F.lit(MAGIC).alias("magic"), F.lit(5).alias("version"), "num_vectors", F.lit(k).alias("num_centroids"), F.lit(S.DIMS_PADDED).alias("dims_padded"), F.lit(block_size).alias("block_size"))
    return Index(stored(fine), boxed, bounds(rows, "cell_id", "block_no"), rows, meta)


def write(index: Index, path: str) -> None:
    """One folder of Parquet tables; vectors are clustered by cell so that a scan of a few cells skips the rest."""
    index.vectors.repartitionByRange("cell_id").sortWithinPartitions("cell_id", "pos").write.mode("overwrite").parquet(f"{path}/vectors")
    for name in ("centroids", "cells", "blocks", "meta"):
        getattr(index, name).write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> Index:
    """Reads and validates an index; raises if it is none.  Versions before 5 may lack the cells' boxes."""
    index = Index(*(spark.read.parquet(f"{path}/{n}") for n in ("centroids", "cells", "blocks", "vectors", "meta")))
    row = validate(index).first()
    if row is None or not row.ok:
        raise ValueError(f"no valid index in {path}")
    return index


def validate(index: Index) -> DataFrame:
    """One row: the header's values, what the tables hold, and whether they agree."""
    held = index.vectors.agg(F.count("*").alias("found_vectors"))
    cells = index.cells.agg(F.count("*").alias("found_cells"), F.sum("cnt").alias("sum_cnt"))
    one = index.meta.crossJoin(F.broadcast(held)).crossJoin(F.broadcast(cells))
    ok = (F.col("magic") == MAGIC) & F.col("version").isin(*S.INDEX_VERSIONS) & (F.col("dims_padded") == S.DIMS_PADDED)
    ok = ok & (F.col("found_vectors") == F.col("num_vectors")) & (F.col("sum_cnt") == F.col("num_vectors")) & (F.col("found_cells") == F.col("num_centroids"))
    return one.select("version", "num_vectors", "num_centroids", "found_vectors", "found_cells", "sum_cnt", ok.alias("ok"))
