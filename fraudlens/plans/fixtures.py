"""Vectors and payloads made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.quantize import quantize
from ..lineage import scratch
from ..operators import index as I
from ..operators import search as Q

CELLS, BLOCK, ROUNDS, NPROBE = 64, 8, 3, 10
MCCS = [*S.MCC_RISK, "0000", "9999"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x, q, label) of all embeddings: the first 14 dimensions, fraud where the label is odd."""
    x = F.transform(F.slice("embedding", 1, S.DIMS), lambda v: v.cast("double"))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), x.alias("x"), (F.col("label") % 2).cast("int").alias("label"))
    return rows.withColumn("q", quantize(F.col("x")))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors; a query's own is among them."""
    return vectors(spark, sf_dir).select("id", "q", "label")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).where("id % 10 = 0").select(F.col("id").alias("qid"), "x", "q", F.col("label").alias("qlabel"))


def fine_centroids(spark: SparkSession, sf_dir: str, rounds: int = ROUNDS) -> DataFrame:
    return I.kmeans(references(spark, sf_dir), CELLS, rounds, F.col("id"))


_BUILT: dict[tuple[str, str], str] = {}


def index(spark: SparkSession, sf_dir: str) -> I.Index:
    """The index over references(), written once for each folder and application, and loaded (with its checks) after that."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _BUILT:
        path = scratch(spark, "index")
        I.write(I.build(references(spark, sf_dir), CELLS, ROUNDS, BLOCK, F.col("id")), path)
        _BUILT[key] = path
    return I.load(spark, _BUILT[key])


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int")).withColumn("cents", F.round(F.col("value") * 100).cast("bigint"))


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, body): a JSON payload for each event; some of them broken."""
    e = events(spark, sf_dir)
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    merc = F.concat(F.lit("MERC-"), F.lpad(F.col("k").cast("string"), 3, "0"))
    users = e.groupBy("user_id").agg(
        (F.sum("cents") * 40 / F.count("*") / 100).alias("user_avg"),
        F.sort_array(F.collect_set(F.when(F.col("k") % 3 == 0, merc))).alias("known"),  # 100 merchants at most
    )
    merchants = e.groupBy("k").agg((F.sum("cents") * 40 / F.count("*") / 100).alias("merchant_avg"))
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = e.withColumn("last_ts", before).join(users, "user_id").join(F.broadcast(merchants), "k")
    last = F.when(F.col("last_ts").isNotNull(), F.struct(iso(F.col("last_ts")).alias("timestamp"), ((F.col("event_id") * 7) % 1200).cast("double").alias("km_from_current")))
    mcc = F.array(*map(F.lit, MCCS))[F.col("k") % 12]
    body = F.to_json(
        F.struct(
            F.concat(F.lit("tx-"), F.col("event_id").cast("string")).alias("id"),
            F.struct((F.col("value") * 40).alias("amount"), (F.col("event_id") % 15).cast("int").alias("installments"), iso(F.col("ts")).alias("requested_at")).alias("transaction"),
            F.struct(F.when(F.col("user_id") % 17 == 0, 0.0).otherwise(F.col("user_avg")).alias("avg_amount"), (F.col("event_id") % 25).cast("int").alias("tx_count_24h"), F.col("known").alias("known_merchants")).alias("customer"),
            F.struct(merc.alias("id"), mcc.alias("mcc"), F.col("merchant_avg").alias("avg_amount")).alias("merchant"),
            F.struct(F.col("event_type").isin("click", "view").alias("is_online"), (F.col("event_type") == "purchase").alias("card_present"), ((F.col("user_id") * 37 + F.col("event_id") * 13) % 1500).cast("double").alias("km_from_home")).alias("terminal"),
            last.alias("last_transaction"),
        ),
        {"ignoreNullFields": "false"},
    )
    kind = F.col("event_id") % 101
    broken = (
        F.when(kind == 1, F.regexp_replace("body", '"mcc":"[^"]*",', ""))
        .when(kind == 2, F.regexp_replace("body", '("requested_at":"[^"]*)Z"', '$1"'))
        .when(kind == 3, F.regexp_replace("body", ',"last_transaction":.*$', "}"))
        .when(kind == 4, F.lit("not json"))
        .otherwise(F.col("body"))
    )
    return rows.select(F.col("event_id").alias("request_id"), body.alias("body"), "event_id").withColumn("body", broken).drop("event_id")


def raw_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, raw): HTTP requests of ten kinds, also incomplete ones and such with bytes of the next request."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), F.col("props").alias("b"))
    n, kind, end = F.length("b").cast("string"), F.col("request_id") % 10, F.lit("\r\n\r\n")
    post = lambda line, name, length=n: F.concat(F.lit(f"{line} HTTP/1.1\r\n{name}"), length, end, F.col("b"))
    raw = (
        F.when(kind == 0, F.lit("GET /ready HTTP/1.1\r\nHost: a\r\n\r\n"))
        .when(kind == 1, F.lit("GET /other HTTP/1.1\r\n\r\n"))
        .when(kind == 2, post("POST /fraud-score", "Content-Length: "))
        .when(kind == 3, post("POST /x", "content-length:"))
        .when(kind == 4, post("PUT /y", "CONTENT-LENGTH: \t"))
        .when(kind == 5, F.concat(post("POST /fraud-score", "Content-Length: "), F.lit("GET /ready HTTP/1.1\r\n\r\n")))  # the next request follows
        .when(kind == 6, post("POST /fraud-score", "Content-Length: 9"))  # more bytes must come
        .when(kind == 7, F.concat(F.lit("POST /z HTTP/1.1\r\nHost: a\r\n\r\nContent-Length: 7"), F.col("b")))  # the name stands in the body only
        .when(kind == 8, F.lit("GET /ready\r\n\r\n"))  # no version
        .otherwise(F.concat(F.lit("POST /fraud-score HTTP/1.1\r\nContent-Length: "), n))  # no end of headers
    )
    return e.select("request_id", raw.alias("raw"))


def predictions(spark: SparkSession, sf_dir: str, against_label: bool) -> DataFrame:
    """(qid, approved, expected_approved, status): the Pattern mode against exact search, or against the labels."""
    q = queries(spark, sf_dir)
    got = Q.adaptive_pattern(q, index(spark, sf_dir), NPROBE).select("qid", (F.col("fraud_count") < 3).alias("approved"))
    if against_label:
        truth, status = q.select("qid", (F.col("qlabel") == 0).alias("expected_approved")), F.lit(200)
    else:
        truth = Q.vote(Q.exact(q, references(spark, sf_dir)), "rn").select("qid", (F.col("fraud_count") < 3).alias("expected_approved"))
        status = F.when(F.col("qid") % 250 == 0, 500).otherwise(200)
    return got.join(truth, "qid").withColumn("status", status)
