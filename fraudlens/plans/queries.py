"""The engine's queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import decision as D
from ..functions import features as X
from ..functions.payload import parse, unknown_merchant
from ..functions.quantize import box_lower_bound, squared_distance
from ..operators import evaluate as E
from ..operators import index as I
from ..operators import search as Q
from ..operators.scoring import score_requests, vectorise
from ..lineage import checkpoint, scratch
from ..sources.requests import entries, read_references, read_test_data, routed, warm_up, write_references, write_test_data
from . import fixtures as Fx

_NP = Fx.NPROBE


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse(Fx.payloads(spark, sf_dir))


def _valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).where("is_valid")


def _long(array: Column, index: str, value: str) -> list[Column]:
    return [F.posexplode(array).alias(index, value)]


def scan_reference(spark, sf_dir):
    rows = Fx.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("vector"), F.when(F.col("label") % 2 == 1, "fraud").otherwise("legit").alias("label"))
    return entries(rows).select("id", F.col("label").cast("long").alias("label"), *_long(F.col("q"), "dim", "q")).select("id", "label", F.col("dim").cast("long").alias("dim"), F.col("q").cast("long").alias("q"))


def parse_payload(spark, sf_dir):
    p = F.col("p")
    at = lambda path: F.when(F.col("is_valid"), F.col(f"p.{path}"))
    return _parsed(spark, sf_dir).select(
        "request_id", "is_valid", at("transaction.amount").alias("amount"), at("transaction.installments").cast("long").alias("installments"), at("transaction.requested_at").alias("requested_at"),
        at("customer.avg_amount").alias("customer_avg"), at("customer.tx_count_24h").cast("long").alias("tx_count"), F.when(F.col("is_valid"), F.size(p["customer"]["known_merchants"])).cast("long").alias("n_known"),
        at("merchant.id").alias("merchant_id"), at("merchant.mcc").alias("mcc"), at("merchant.avg_amount").alias("merchant_avg"), at("terminal.is_online").alias("is_online"), at("terminal.card_present").alias("card_present"),
        at("terminal.km_from_home").alias("km_home"), at("last_transaction.timestamp").alias("last_at"), at("last_transaction.km_from_current").alias("last_km"),
    )


def known_merchant_flag(spark, sf_dir):
    return _valid(spark, sf_dir).select("request_id", unknown_merchant(F.col("p")).cast("long").alias("unknown_merchant"))


def route_requests(spark, sf_dir):
    return routed(Fx.raw_requests(spark, sf_dir)).select("request_id", "kind", "content_length", "body", "consumed")


def fail_open(spark, sf_dir):
    parsed = _parsed(spark, sf_dir)
    fraud = F.when(F.col("is_valid"), F.col("request_id") % 6).otherwise(0).cast("int")
    return parsed.select("request_id", fraud.cast("long").alias("fraud_count"), D.body(fraud).alias("response"))


def warmup_vectors(spark, sf_dir):
    return warm_up(spark).select("i", *_long(F.col("x"), "dim", "value")).select("i", F.col("dim").cast("long").alias("dim"), "value")


def _features(spark, sf_dir, dims: dict[int, str]) -> DataFrame:
    f = X.features(F.col("p"))
    return _valid(spark, sf_dir).select("request_id", *(f[d].alias(n) for d, n in dims.items()))


def amount_features(spark, sf_dir):
    return _features(spark, sf_dir, {0: "amount", 1: "installments", 2: "amount_vs_avg"})


def time_features(spark, sf_dir):
    return _features(spark, sf_dir, {3: "hour", 4: "weekday"})


def minutes_diff(spark, sf_dir):
    p = F.col("p")
    return _valid(spark, sf_dir).where("p.last_transaction IS NOT NULL").select("request_id", X.minutes_between(p["transaction"]["requested_at"], p["last_transaction"]["timestamp"]).alias("minutes"))


def history_features(spark, sf_dir):
    return _features(spark, sf_dir, {5: "minutes_since", 6: "km_since"})


def terminal_features(spark, sf_dir):
    return _features(spark, sf_dir, {7: "km_home", 8: "tx_count", 9: "is_online", 10: "card_present"})


def mcc_risk(spark, sf_dir):
    return _features(spark, sf_dir, {12: "risk"})


def feature_vector(spark, sf_dir):
    return _valid(spark, sf_dir).select("request_id", *_long(X.feature_vector(F.col("p")), "dim", "value")).select("request_id", F.col("dim").cast("long").alias("dim"), "value")


def quantized_features(spark, sf_dir):
    return vectorise(Fx.payloads(spark, sf_dir)).select("qid", *_long(F.col("q"), "dim", "q")).select("qid", F.col("dim").cast("long").alias("dim"), F.col("q").cast("long").alias("q"))


def distance_i16(spark, sf_dir):
    v = Fx.references(spark, sf_dir).select("id", "q")
    q = Fx.queries(spark, sf_dir).select("qid", F.col("q").alias("qq"))
    return v.crossJoin(F.broadcast(q)).select("qid", "id", squared_distance(F.col("qq"), F.col("q")).alias("d"))


def bbox_lower_bound(spark, sf_dir):
    boxes = I.bounds(Fx.references(spark, sf_dir).withColumn("cell_id", F.col("id") % 16), "cell_id")
    q = Fx.queries(spark, sf_dir).select("qid", F.col("q").alias("qq"))
    return q.crossJoin(F.broadcast(boxes)).select("qid", "cell_id", box_lower_bound(F.col("qq"), F.col("min_q"), F.col("max_q")).alias("lb"))


def assign_cells(spark, sf_dir):
    refs = Fx.references(spark, sf_dir)
    return I.assign(refs, I.initial_centroids(refs, Fx.CELLS, F.col("id"))).select("id", F.col("cell_id").cast("long").alias("cell_id"), "d")


def _centroid_rows(c: DataFrame) -> DataFrame:
    return c.select(F.col("cell_id").cast("long").alias("cell_id"), *_long(F.col("c"), "dim", "c")).select("cell_id", F.col("dim").cast("long").alias("dim"), F.col("c").cast("long").alias("c"))


def kmeans_step(spark, sf_dir):
    return _centroid_rows(Fx.fine_centroids(spark, sf_dir, 1))


def kmeans_fit(spark, sf_dir):
    return _centroid_rows(Fx.fine_centroids(spark, sf_dir))


def cell_offsets(spark, sf_dir):
    return Fx.index(spark, sf_dir).cells.select(F.col("cell_id").cast("long").alias("cell_id"), F.col("cnt").cast("long").alias("cnt"), F.col("start").cast("long").alias("start"))


def cell_order(spark, sf_dir):
    return Fx.index(spark, sf_dir).vectors.select(F.col("cell_id").cast("long").alias("cell_id"), "pos", F.col("block_no").cast("long").alias("block_no"), "id", "d_own")


def _box_rows(boxes: DataFrame, *keys: str) -> DataFrame:
    zipped = F.arrays_zip(F.col("min_q").alias("lo"), F.col("max_q").alias("hi"))
    return boxes.select(*(F.col(k).cast("long").alias(k) for k in keys), F.posexplode(zipped).alias("dim", "b")).select(*keys, F.col("dim").cast("long").alias("dim"), F.col("b.lo").cast("long").alias("lo"), F.col("b.hi").cast("long").alias("hi"))


def cell_bounds(spark, sf_dir):
    return _box_rows(Fx.index(spark, sf_dir).cells, "cell_id")


def block_bounds(spark, sf_dir):
    return _box_rows(Fx.index(spark, sf_dir).blocks, "cell_id", "block_no")


def index_validate(spark, sf_dir):
    return I.validate(Fx.index(spark, sf_dir)).select(*(F.col(c).cast("long").alias(c) for c in ("version", "num_vectors", "num_centroids", "found_vectors", "found_cells", "sum_cnt")), "ok")


def coarse_distances(spark, sf_dir):
    return Q.coarse(Fx.queries(spark, sf_dir), Fx.index(spark, sf_dir).centroids).select("qid", F.col("cell_id").cast("long").alias("cell_id"), "cdist")


def probe_cells(spark, sf_dir):
    return Q.probe(Fx.queries(spark, sf_dir), Fx.index(spark, sf_dir).centroids, _NP).select("qid", F.col("cell_id").cast("long").alias("cell_id"), "cdist", F.col("cell_rank").cast("long").alias("cell_rank"))


def exact_knn(spark, sf_dir):
    out = Q.exact(Fx.queries(spark, sf_dir), Fx.references(spark, sf_dir))
    return out.select("qid", F.col("rn").cast("long").alias("rn"), "id", F.col("label").cast("long").alias("label"), "d")


def _top(spark, sf_dir, nprobe: int = _NP):
    q, index = Fx.queries(spark, sf_dir), Fx.index(spark, sf_dir)
    return q, index, Q.scan(q, nprobe, index)


def _top_rows(top: DataFrame) -> DataFrame:
    return top.select("qid", F.col("rn").cast("long").alias("rn"), "id", F.col("label").cast("long").alias("label"), "d", "pos")


def ivf_topk_fixed(spark, sf_dir):
    return _top_rows(_top(spark, sf_dir)[2])


def block_prune_check(spark, sf_dir):
    q, index = Fx.queries(spark, sf_dir), Fx.index(spark, sf_dir)
    return _top_rows(Q.pruned_scan(q, Q.probe(q, index.centroids, _NP), index))


def rerank(spark, sf_dir):
    q, _, top = _top(spark, sf_dir)
    return Q.rerank(q, top).select("qid", "id", F.col("rank").cast("long").alias("rank"), F.round("d_exact", 9).alias("d_exact"))


def vote(spark, sf_dir):
    q, _, top = _top(spark, sf_dir)
    return Q.vote(Q.rerank(q, top)).select("qid", F.col("fraud_count").cast("long").alias("fraud_count"), "fraud_score")


def rank_bits(spark, sf_dir):
    q, _, top = _top(spark, sf_dir)
    return Q.vote(Q.rerank(q, top)).select("qid", F.col("bits").cast("long").alias("bits"))


def _adaptive(out: DataFrame) -> DataFrame:
    return out.select("qid", F.col("fraud_count").cast("long").alias("fraud_count"), "fraud_score", "expanded")


def adaptive_pattern(spark, sf_dir):
    return _adaptive(Q.adaptive_pattern(Fx.queries(spark, sf_dir), Fx.index(spark, sf_dir), _NP))


def adaptive_ambiguous(spark, sf_dir):
    return _adaptive(Q.adaptive_ambiguous(Fx.queries(spark, sf_dir), Fx.index(spark, sf_dir), _NP))


def adaptive_bbox(spark, sf_dir):
    out = Q.adaptive_bbox(Fx.queries(spark, sf_dir), Fx.index(spark, sf_dir), _NP, candidates=8)
    return out.select("qid", F.col("fraud_count").cast("long").alias("fraud_count"), "fraud_score", F.col("visited").cast("long").alias("visited"))


def decision(spark, sf_dir):
    q, _, top = _top(spark, sf_dir)
    return Q.vote(Q.rerank(q, top)).select("qid", D.approved(F.col("fraud_count")).alias("approved"), "fraud_score")


def response_body(spark, sf_dir):
    n = F.col("event_id") % 8
    return Fx.table(spark, sf_dir, "events").select(F.col("event_id"), D.body(n.cast("int")).alias("response"))


def confusion_class(spark, sf_dir):
    return Fx.predictions(spark, sf_dir, False).select("qid", E.confusion_class(F.col("status"), F.col("approved"), F.col("expected_approved")).alias("class"))


def confusion_counts(spark, sf_dir):
    return E.confusion_counts(Fx.predictions(spark, sf_dir, False))


def _rounded(scores: DataFrame) -> DataFrame:
    exact = ("tp", "tn", "fp", "fn", "err", "n", "failures", "weighted_errors")
    return scores.select(*exact, *(F.round(c, 6).alias(c) for c in ("failure_rate", "epsilon", "accuracy", "detection_score")))


def detection_score(spark, sf_dir):
    return _rounded(E.detection(E.confusion_counts(Fx.predictions(spark, sf_dir, False))))


def detection_score_cut(spark, sf_dir):
    return _rounded(E.detection(E.confusion_counts(Fx.predictions(spark, sf_dir, True))))


def dataset_stats(spark, sf_dir):
    return E.dataset_stats(Fx.vectors(spark, sf_dir))


def latency_p99(spark, sf_dir):
    return E.latency(Fx.table(spark, sf_dir, "events"), "value").select(F.round("p99", 6).alias("p99"))


def p99_score(spark, sf_dir):
    by_type = Fx.table(spark, sf_dir, "events").groupBy("event_type").agg(F.percentile("value", 0.99).alias("p99"))
    return by_type.select("event_type", F.round(E.p99_score(F.col("p99")), 6).alias("score"))


def recall_by_nprobe(spark, sf_dir):
    q, index = Fx.queries(spark, sf_dir), Fx.index(spark, sf_dir)
    truth = checkpoint(Q.exact(q, Fx.references(spark, sf_dir)).select("qid", "id"))  # read six times
    out = None
    for n in (1, 4, 10, 32, 64):
        hit = Q.scan(q, n, index).join(truth, ["qid", "id"]).agg(F.count("*").alias("hits")).withColumn("nprobe", F.lit(n).cast("long"))
        out = hit if out is None else out.unionByName(hit)
    total = truth.agg(F.count("*").alias("total"))
    return out.crossJoin(F.broadcast(total)).select("nprobe", "hits", F.round(F.col("hits") / F.col("total"), 6).alias("recall"))


def score_payloads(spark, sf_dir):
    """From request text to response, by fixed probing of the index."""
    index = Fx.index(spark, sf_dir)
    out = score_requests(Fx.payloads(spark, sf_dir), index, Q.QueryOptions(nprobe=_NP, mode="fixed"))
    return out.select("request_id", "is_valid", F.col("fraud_count").cast("long").alias("fraud_count"), "approved", "response")


def http_responses(spark, sf_dir):
    routed_ = routed(Fx.raw_requests(spark, sf_dir))
    return routed_.select("request_id", D.full_response(F.col("kind"), (F.col("request_id") % 7).cast("int")).alias("response"))


def scan_reference_file(spark, sf_dir):
    """The embeddings through a gzipped JSON array and back; ids are dealt anew, so rows are told by their values."""
    rows = Fx.table(spark, sf_dir, "embeddings").select(F.transform("embedding", lambda v: v.cast("double")).alias("vector"), F.when(F.col("label") % 2 == 1, "fraud").otherwise("legit").alias("label"))
    path = scratch(spark, "references")
    write_references(rows, path)
    read = read_references(spark, path)
    return read.select(F.col("label").cast("long").alias("label"), *_long(F.col("q"), "dim", "q")).groupBy("label", F.col("dim").cast("long").alias("dim"), F.col("q").cast("long").alias("q")).agg(F.count("*").alias("n"))


def scan_test_data(spark, sf_dir):
    """The payloads through a labelled test file and back; a broken one gives a request of nulls."""
    path = scratch(spark, "test-data")
    write_test_data(Fx.payloads(spark, sf_dir).where("body <> 'not json'").select("body", (F.col("request_id") % 3 > 0).alias("expected_approved")), path, compression="gzip")
    read = read_test_data(spark, path)
    id_ = F.regexp_extract(F.get_json_object("body", "$.id"), "tx-([0-9]+)", 1).cast("long")
    return read.select(id_.alias("request_id"), "expected_approved", F.get_json_object("body", "$.transaction.amount").cast("double").alias("amount"))


def initial_centroids(spark, sf_dir):
    return _centroid_rows(I.initial_centroids(Fx.references(spark, sf_dir), Fx.CELLS))


def option_clamping(spark, sf_dir):
    rows = []
    for i in range(200):
        o = Q.QueryOptions(nprobe=i - 20, repair_min=i % 9, repair_max=i % 11, repair_candidates=2 * i - 40).clamped()
        rows.append((i, o.nprobe, o.repair_min, o.repair_max, o.repair_candidates))
    return spark.createDataFrame(rows, "i long, nprobe long, repair_min long, repair_max long, repair_candidates long")


def final_score(spark, sf_dir):
    """The results file, written and read back."""
    p99 = E.latency(Fx.table(spark, sf_dir, "events"), "value")
    path = scratch(spark, "results")
    E.write_report(E.report(E.confusion_counts(Fx.predictions(spark, sf_dir, False)), p99), path)
    raw = "p99 double, failure_rate double, epsilon double, p99_score double, detection_score double, final_score double"
    read = spark.read.schema(f"p99 string, scoring struct<weighted_errors_E: long, final_score: double, raw: struct<{raw.replace(' ', ': ').replace(',:', ',')}>>").json(path)
    # The final score is the sum with the detection score as it is shown.
    shown = F.round("scoring.raw.detection_score", 6)
    final = F.col("scoring.raw.final_score") - F.col("scoring.raw.detection_score") + shown
    return read.select(F.col("scoring.weighted_errors_E").alias("weighted_errors"), *(F.round(f"scoring.raw.{c}", 6).alias(c) for c in ("p99", "p99_score")), shown.alias("detection_score"), F.round(final, 6).alias("final_score"))


def throughput(spark, sf_dir):
    times = Fx.table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), (F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))).alias("seconds"))
    return times.select("event_type", "n", F.round(E.throughput(F.col("n"), F.col("seconds")), 9).alias("per_second"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings -> quantise -> exact five nearest -> vote -> decision."""
    votes = Q.vote(Q.exact(Fx.queries(spark, sf_dir), Fx.references(spark, sf_dir)), "rn")
    return votes.select("qid", F.col("fraud_count").cast("long").alias("fraud_count"), "fraud_score", D.approved(F.col("fraud_count")).alias("approved"), D.body(F.col("fraud_count")).alias("response"))


_ALL = [
    scan_reference, parse_payload, known_merchant_flag, route_requests, fail_open, warmup_vectors, amount_features, time_features, minutes_diff, history_features, terminal_features, mcc_risk,
    feature_vector, quantized_features, distance_i16, bbox_lower_bound, assign_cells, kmeans_step, kmeans_fit, cell_offsets, cell_order, cell_bounds, block_bounds, index_validate,
    coarse_distances, probe_cells, exact_knn, ivf_topk_fixed, block_prune_check, rerank, vote, rank_bits, adaptive_pattern, adaptive_ambiguous, adaptive_bbox, decision, response_body,
    confusion_class, confusion_counts, detection_score, detection_score_cut, dataset_stats, latency_p99, p99_score, recall_by_nprobe, score_payloads, flagship,
    http_responses, scan_reference_file, scan_test_data, initial_centroids, option_clamping, final_score, throughput,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}
