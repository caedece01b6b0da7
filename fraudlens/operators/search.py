"""Search modes: exact, fixed probing, and the adaptive ones.

Queries have columns qid, q (quantised) and x (doubles).  Distances are exact
matrix products (`nearest.py`); what several tasks find for a query is merged by
row_number filters, which Spark plans as a group limit before the shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.decision import score
from ..functions.quantize import box_lower_bound, squared_distance, squared_distance_exact
from ..lineage import checkpoint
from .index import Index
from .nearest import GROUP, MAX_HELD, MAX_HELD_PROBES, Held, nearest_cells, nearest_in_groups


@dataclass(frozen=True)
class QueryOptions:
    nprobe: int = 10
    mode: str = "pattern"  # exact, fixed, pattern, ambiguous or bbox
    repair_min: int = S.REPAIR_MIN
    repair_max: int = S.REPAIR_MAX
    repair_candidates: int = S.REPAIR_CANDIDATES

    def clamped(self) -> QueryOptions:
        return QueryOptions(min(max(self.nprobe, 1), S.MAX_NPROBE), self.mode, min(self.repair_min, S.K), min(self.repair_max, S.K), min(max(self.repair_candidates, 1), S.MAX_REPAIR_CANDIDATES))


def _rank(key: str, *order: str | Column) -> Column:
    return F.row_number().over(Window.partitionBy(key).orderBy(*order))


def _spread(queries: DataFrame) -> DataFrame:
    """Queries dealt out, if counted to be so few that their file may be a single task; more come in tasks of their own."""
    n = queries.count()
    if n > 200_000:
        return queries
    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return queries.repartition(max(1, min(parts, n // 512)), "qid")


def exact(queries: DataFrame, vectors: DataFrame, k: int = S.K, broadcast_rows: int = MAX_HELD) -> DataFrame:
    """(qid, rn, id, label, d): the k nearest of all vectors, ties to the lower id.

    Vectors counted to be few are held by every worker; more are dealt out in
    groups that every query meets.
    """
    v = vectors.select("id", "q", "label").where("q IS NOT NULL")
    n = v.count()
    if n <= min(broadcast_rows, MAX_HELD):
        table = v.toArrow()
        held = Held(table.sort_by("id"))
        return held.rows(_spread(queries.select("qid", "q")), 1, k).select("qid", "rn", "id", "label", "d")
    groups = -(-n // min(broadcast_rows, GROUP))
    v = v.select(F.expr(f"pmod(xxhash64(id), {groups})").alias("grp"), F.col("id").alias("pos"), "id", "label", "q")
    q = queries.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint"))).alias("grp"), "qid", F.lit(1).alias("cell_rank"), "q")
    near = nearest_in_groups(q, v, k)
    return near.withColumn("rn", _rank("qid", "d", "id")).where(F.col("rn") <= k).select("qid", "rn", "id", "label", "d")


def coarse(queries: DataFrame, centroids: DataFrame) -> DataFrame:
    """(qid, cell_id, cdist) of every query and centroid; centroids are at most 2048."""
    return queries.select("qid", "q").crossJoin(F.broadcast(centroids)).select("qid", "cell_id", squared_distance(F.col("q"), F.col("c")).alias("cdist"))


def probe(queries: DataFrame, centroids: DataFrame, nprobe: int) -> DataFrame:
    """(qid, cell_id, cdist, cell_rank) of the nearest cells, ties to the lower cell; found in the query's row."""
    return nearest_cells(queries, "qid", centroids, nprobe).select("qid", "cell_id", F.col("d").alias("cdist"), F.col("rank").alias("cell_rank"))


def held(index: Index, most: int = MAX_HELD) -> Held | None:
    """The index's vectors for every worker, if counted to be few."""
    v = index.vectors.where("q IS NOT NULL")
    if v.count() > min(most, MAX_HELD):
        return None
    table = v.select("cell_id", "pos", "id", "label", "q").toArrow()
    return Held(table.sort_by([("cell_id", "ascending"), ("pos", "ascending")]), index.centroids)


def scan(queries: DataFrame, probes: DataFrame | int, index: Index, k: int = S.K, most: int = MAX_HELD) -> DataFrame:
    """(qid, rn, id, label, d, pos, vq): the k nearest in the probed cells, or in so many nearest cells, ties in scan order.

    Of an index of at most `most` vectors, the nearest cells are searched in the
    query's own row; else queries meet the cells in groups of positions.
    """
    if isinstance(probes, int):
        own = held(index, most) if probes <= MAX_HELD_PROBES else None
        if own:
            return own.rows(_spread(queries.select("qid", "q")), probes, k)
        probes = probe(queries, index.centroids, probes)
    first, last = F.floor(F.col("start") / GROUP), F.floor((F.col("start") + F.col("cnt") - 1) / GROUP)
    group = lambda part: F.shiftleft(F.col("cell_id").cast("bigint"), 40) + part.cast("bigint")
    parts = index.cells.where("cnt > 0").select("cell_id", F.explode(F.sequence(first, last)).alias("part"))
    wanted = probes.select("qid", "cell_id", "cell_rank").join(F.broadcast(parts), "cell_id").join(queries.select("qid", "q"), "qid")
    vectors = index.vectors.select(group(F.floor(F.col("pos") / GROUP)).alias("grp"), F.col("pos").cast("bigint").alias("pos"), "id", "label", "q")
    near = nearest_in_groups(wanted.select(group(F.col("part")).alias("grp"), "qid", "cell_rank", "q"), vectors, k)
    return near.withColumn("rn", _rank("qid", "d", "cell_rank", "pos")).where(F.col("rn") <= k).select("qid", "rn", "id", "label", "d", "pos", "vq")


def rerank(queries: DataFrame, top: DataFrame) -> DataFrame:
    """Adds d_exact and rank: the order by the unquantised query, ties in the quantised order."""
    out = top.join(queries.select("qid", "x"), "qid").withColumn("d_exact", squared_distance_exact(F.col("x"), F.col("vq")))
    return out.withColumn("rank", _rank("qid", "d_exact", "rn")).drop("x")


def vote(ranked: DataFrame, rank: str = "rank") -> DataFrame:
    """(qid, fraud_count, bits, fraud_score); bit 0 of bits is the nearest."""
    bits = F.bit_or(F.expr(f"shiftleft(cast(label as int), {rank} - 1)"))
    out = ranked.groupBy("qid").agg(F.sum("label").cast("int").alias("fraud_count"), bits.alias("bits"))
    return out.withColumn("fraud_score", score(F.col("fraud_count")))


def fixed(queries: DataFrame, index: Index, nprobe: int, most: int = MAX_HELD) -> DataFrame:
    """Votes over the nearest cells; in the query's own row, without a shuffle, for an index of at most `most` vectors."""
    own = held(index, most) if nprobe <= MAX_HELD_PROBES else None
    if own:
        votes = own.votes(_spread(queries.select("qid", "q", "x")), nprobe, S.K, float(S.SCALE))
        return votes.withColumn("fraud_score", score(F.col("fraud_count")))
    return vote(rerank(queries, scan(queries, probe(queries, index.centroids, nprobe), index)))


def gaps(probes: DataFrame, nprobe: int) -> DataFrame:
    """(qid, gap): distance of the first centroid that isn't probed less that of the last that is, from probes of nprobe + 1 cells."""
    ranked = probes.where(F.col("cell_rank") >= nprobe)
    both = ranked.groupBy("qid").agg(F.max("cdist").alias("hi"), F.min("cdist").alias("lo"), F.count("*").alias("n"))
    return both.where("n = 2").select("qid", (F.col("hi") - F.col("lo")).alias("gap"))


def risky(voted: DataFrame, gap: DataFrame, nprobe: int) -> DataFrame:
    """qids whose rank bits and gap are in the table of risky patterns."""
    table = F.broadcast(voted.sparkSession.createDataFrame(S.RISKY_PATTERNS, "nprobe int, pbits int, max_gap long").where(F.col("nprobe") == nprobe))
    return voted.join(gap, "qid").join(table, (F.col("bits") == F.col("pbits")) & (F.col("gap") <= F.col("max_gap"))).select("qid")


def ambiguous(voted: DataFrame, low: int, high: int) -> DataFrame:
    return voted.where(F.col("fraud_count").between(low, high)).select("qid")


def _extend(queries: DataFrame, index: Index, first: DataFrame, chosen: DataFrame) -> DataFrame:
    """Replaces the votes of the chosen queries by those over more cells."""
    again = fixed(queries.join(chosen, "qid", "left_semi"), index, S.ADAPTIVE_TARGET).withColumn("expanded", F.lit(True))
    rest = first.join(chosen, "qid", "left_anti").withColumn("expanded", F.lit(False))
    return rest.unionByName(again)


def adaptive_pattern(queries: DataFrame, index: Index, nprobe: int = 10) -> DataFrame:
    first = checkpoint(fixed(queries, index, nprobe))
    return _extend(queries, index, first, risky(first, gaps(probe(queries, index.centroids, nprobe + 1), nprobe), nprobe))


def adaptive_ambiguous(queries: DataFrame, index: Index, nprobe: int = 10, low: int = S.REPAIR_MIN, high: int = S.REPAIR_MAX) -> DataFrame:
    first = checkpoint(fixed(queries, index, nprobe))
    return _extend(queries, index, first, ambiguous(first, low, high))


def adaptive_bbox(queries: DataFrame, index: Index, nprobe: int = 10, low: int = S.REPAIR_MIN, high: int = S.REPAIR_MAX, candidates: int = S.REPAIR_CANDIDATES) -> DataFrame:
    """Ambiguous queries visit further cells by the lower bound of their boxes, until the bound or the vote settles it.

    (qid, fraud_count, fraud_score, visited).  The fold over a query's cells is
    one expression; each cell brings only its own five best, as no others of it
    can be among the five best of all.  In an index without boxes (before version
    5) nothing is visited: the first vote counts.
    """
    if not {"min_q", "max_q"} <= set(index.cells.columns) or index.meta.where("version < 5").limit(1).count():
        return fixed(queries, index, nprobe).select("qid", "fraud_count", F.lit(0).alias("visited"), "fraud_score")
    probes = probe(queries, index.centroids, nprobe)
    top = scan(queries, probes, index)
    first = vote(rerank(queries, top))
    chosen = ambiguous(first, low, high)
    hit = queries.join(chosen, "qid", "left_semi")
    fifth = top.join(chosen, "qid", "left_semi").groupBy("qid").agg(F.max("d").alias("worst"), F.count("*").alias("held"))
    limit = F.when(F.col("held") >= S.K, F.col("worst"))
    boxes = F.broadcast(index.cells.where("cnt > 0").select("cell_id", "min_q", "max_q"))
    able = hit.select("qid", "q").crossJoin(boxes).select("qid", "cell_id", box_lower_bound(F.col("q"), F.col("min_q"), F.col("max_q")).alias("lb"))
    able = able.join(probes.select("qid", "cell_id"), ["qid", "cell_id"], "left_anti").join(fifth, "qid").where(limit.isNull() | (F.col("lb") < limit))
    able = able.withColumn("visit", _rank("qid", "lb", "cell_id")).where(F.col("visit") <= candidates).select("qid", "cell_id", "lb", "visit")
    near = able.join(hit.select("qid", F.col("q").alias("qq")), "qid").join(index.vectors.select("cell_id", "pos", "q", "label"), "cell_id")
    near = near.select("qid", "cell_id", "lb", "visit", "pos", F.col("label").cast("int").alias("label"), squared_distance(F.col("qq"), F.col("q")).alias("d"))
    own = Window.partitionBy("qid", "visit").orderBy("d", "pos")
    near = near.withColumn("r", F.row_number().over(own)).where(F.col("r") <= S.K)
    entry = F.struct("d", "visit", F.col("pos").cast("long").alias("pos"), "label")
    cells = near.groupBy("qid", "visit", "lb").agg(F.sort_array(F.collect_list(entry)).alias("top"))
    folded = cells.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("visit", "lb", "top"))).alias("cells"))
    start = top.join(chosen, "qid", "left_semi").groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("d", F.lit(0).alias("visit"), F.col("rn").cast("long").alias("pos"), F.col("label").cast("int").alias("label")))).alias("top"))
    joined = start.join(folded, "qid", "left").withColumn("cells", F.coalesce("cells", F.array().cast("array<struct<visit:int,lb:bigint,top:array<struct<d:bigint,visit:int,pos:bigint,label:int>>>>")))
    fold = f"""aggregate(cells, named_struct('top', top, 'done', false, 'visited', 0), (acc, c) ->
        CASE WHEN acc.done OR (size(acc.top) >= {S.K} AND c.lb >= acc.top[{S.K - 1}].d) THEN named_struct('top', acc.top, 'done', true, 'visited', acc.visited)
        ELSE transform(array(slice(array_sort(concat(acc.top, c.top)), 1, {S.K})), t ->
            named_struct('top', t, 'done', NOT (aggregate(t, 0, (s, e) -> s + e.label) BETWEEN {low} AND {high}), 'visited', acc.visited + 1))[0] END)"""
    repaired = joined.select("qid", F.expr(fold).alias("r")).select("qid", F.expr("aggregate(r.top, 0, (s, e) -> s + e.label)").alias("fraud_count"), F.col("r.visited").alias("visited"))
    rest = first.join(chosen, "qid", "left_anti").select("qid", "fraud_count", F.lit(0).alias("visited"))
    return rest.unionByName(repaired).withColumn("fraud_score", score(F.col("fraud_count")))


def pruned_scan(queries: DataFrame, probes: DataFrame, index: Index, k: int = S.K) -> DataFrame:
    """scan(), but reading only the blocks that can matter.

    A first bound comes from the nearest cells that hold k vectors together; only
    blocks whose box may hold a vector within it are joined, which loses nothing.
    """
    counted = probes.join(F.broadcast(index.cells.select("cell_id", "cnt")), "cell_id")
    before = F.sum("cnt").over(Window.partitionBy("qid").orderBy("cell_rank").rowsBetween(Window.unboundedPreceding, -1))
    near = counted.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < k)
    bound = scan(queries, near, index, k).groupBy("qid").agg(F.max("d").alias("worst"), F.count("*").alias("held"))
    boxed = probes.join(queries.select("qid", F.col("q").alias("qq")), "qid").join(index.blocks, "cell_id")
    boxed = boxed.withColumn("lb", box_lower_bound(F.col("qq"), F.col("min_q"), F.col("max_q"))).join(bound, "qid", "left")
    # At most the bound, not below it: a vector at the bound may win its tie.
    alive = boxed.where(F.col("held").isNull() | (F.col("held") < k) | (F.col("lb") <= F.col("worst"))).select("qid", "qq", "cell_id", "cell_rank", "block_no")
    found = alive.join(index.vectors.select("cell_id", "block_no", "pos", "id", "q", "label"), ["cell_id", "block_no"])
    found = found.select("qid", "cell_rank", "pos", "id", "label", F.col("q").alias("vq"), squared_distance(F.col("qq"), F.col("q")).alias("d"))
    return found.withColumn("rn", _rank("qid", "d", "cell_rank", "pos")).where(F.col("rn") <= k).select("qid", "rn", "id", "label", "d", "pos", "vq")


def search(queries: DataFrame, index: Index, options: QueryOptions = QueryOptions()) -> DataFrame:
    """(qid, fraud_count, fraud_score) by any mode; queries without a neighbour have no row."""
    o = options.clamped()
    if o.mode == "exact":
        out = vote(exact(queries, index.vectors), "rn")
    elif o.mode == "fixed":
        out = fixed(queries, index, o.nprobe)
    elif o.mode == "ambiguous":
        out = adaptive_ambiguous(queries, index, o.nprobe, o.repair_min, o.repair_max)
    elif o.mode == "bbox":
        out = adaptive_bbox(queries, index, o.nprobe, o.repair_min, o.repair_max, o.repair_candidates)
    elif o.mode == "pattern":
        out = adaptive_pattern(queries, index, o.nprobe) if o.nprobe in {n for n, _, _ in S.RISKY_PATTERNS} else fixed(queries, index, o.nprobe)
    else:
        raise ValueError(f"no such mode: {o.mode}")
    return out.select("qid", "fraud_count", "fraud_score")
