"""Golden values of the scoring rules, and invariants of the index."""

import json

import pytest
from pyspark.sql import functions as F

from fraudlens import schema as S
from fraudlens.functions import decision as D
from fraudlens.functions import features as X
from fraudlens.functions.payload import minute, parse
from fraudlens.functions.quantize import box_lower_bound, quantize, quantize_one, squared_distance
from fraudlens.operators import evaluate as E
from fraudlens.operators import index as I
from fraudlens.operators import search as Q
from fraudlens.operators.scoring import score_requests
from fraudlens.sources.requests import routed


def payload(**changes):
    p = {
        "id": "tx-1",
        "transaction": {"amount": 384.88, "installments": 3, "requested_at": "2026-01-05T20:23:35Z"},
        "customer": {"avg_amount": 769.76, "tx_count_24h": 3, "known_merchants": ["MERC-009", "MERC-001", "MERC-001"]},
        "merchant": {"id": "MERC-001", "mcc": "5912", "avg_amount": 298.95},
        "terminal": {"is_online": False, "card_present": True, "km_from_home": 13.7},
        "last_transaction": None,
    }
    for k, v in changes.items():
        section, _, name = k.partition("__")
        if name:
            p[section] = {**p[section], name: v}
        else:
            p[section] = v
    return p


def parsed(spark, *bodies):
    return parse(spark.createDataFrame([(i, b if isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)], "request_id long, body string"))


def vector(spark, p):
    return parsed(spark, p).where("is_valid").select(X.feature_vector(F.col("p")).alias("v")).first().v


def test_weekday_hour_minutes(spark):
    row = spark.range(1).select(
        F.weekday(minute(F.lit("2000-01-01T00:00:00Z"))), F.weekday(minute(F.lit("2026-01-05T00:00:00Z"))), F.hour(minute(F.lit("2026-01-05T09:10:11Z"))),
        X.minutes_between(F.lit("2026-01-05T16:40:30Z"), F.lit("2026-01-05T15:10:10Z")), X.minutes_between(F.lit("2026-01-05T00:01:05Z"), F.lit("2026-01-05T00:00:55Z")),
    ).first()
    assert tuple(row) == (5, 0, 9, 90, 1)


def test_null_history(spark):
    v = vector(spark, payload())
    assert v[5] == v[6] == -1 and v[9] == 0 and v[10] == 1 and v[11] == 0 and v[12] == 0.20
    assert v[4] == 0 and v[3] == 20 / 23 and v[2] == pytest.approx(0.05)


def test_history(spark):
    v = vector(spark, payload(last_transaction={"timestamp": "2026-01-05T14:58:35Z", "km_from_current": 18.8}))
    assert v[5] == 325 / 1440 and v[6] == pytest.approx(0.0188)


def test_clamping_and_unknown(spark):
    p = payload(transaction__amount=1e6, transaction__installments=99, customer__avg_amount=1.0, customer__tx_count_24h=50, terminal__km_from_home=9e9, merchant__mcc="7995", merchant__id="MERC-X")
    v = vector(spark, p)
    assert v[0] == v[1] == v[2] == v[7] == v[8] == v[11] == 1 and v[12] == 0.85
    assert vector(spark, payload(merchant__mcc="1111", customer__avg_amount=0.0))[12] == 0.5


def test_validity(spark):
    no_key = payload()
    del no_key["last_transaction"]
    no_mcc = payload()
    del no_mcc["merchant"]["mcc"]
    bad = ["not json", "{}", no_key, no_mcc, payload(transaction__requested_at="2026-01-05T20:23:35"), payload(transaction__requested_at="2026-13-05T20:23:35Z"), payload(transaction__installments=-1), payload(last_transaction={"timestamp": "2026-01-05T14:58:35Z"})]
    assert [r.is_valid for r in parsed(spark, *bad, payload()).orderBy("request_id").collect()] == [False] * len(bad) + [True]


def test_quantize(spark):
    row = spark.range(1).select(*(quantize_one(F.lit(x)) for x in (-1.0, 0.00005, -0.00005, 9.9, float("nan"), 0.12344999))).first()
    assert tuple(row) == (-10000, 1, -1, 32767, 0, 1234)
    a, b = F.array(*[F.lit(-10000)] * 14), F.array(*[F.lit(10000)] * 14)
    assert spark.range(1).select(squared_distance(a, b)).first()[0] == 14 * 20000**2
    low, high = F.array(*[F.lit(0)] * 14), F.array(*[F.lit(10)] * 14)
    q = F.array(F.lit(-3), F.lit(14), *[F.lit(5)] * 12)
    assert spark.range(1).select(box_lower_bound(q, low, high)).first()[0] == 9 + 16


def test_decision(spark):
    rows = spark.createDataFrame([(i,) for i in [*range(6), 99]], "n int").select(D.approved(F.col("n")).alias("a"), D.body(F.col("n")).alias("b")).collect()
    assert [r.a for r in rows] == [True] * 3 + [False] * 3 + [True]
    assert rows[0].b == rows[6].b == '{"approved":true,"fraud_score":0.0}' and rows[3].b == '{"approved":false,"fraud_score":0.6}'


def test_route(spark):
    """Kinds need the end of the headers; bodies have the bytes that the headers say, and only the headers are searched."""
    end = "\r\n\r\n"
    cases = {
        f"GET /ready HTTP/1.1{end}": ("ready", 0, "", 23),
        f"GET / HTTP/1.1{end}": ("not_found", 0, "", 18),
        f"GET /ready{end}": ("not_found", 0, "", 14),
        f"GET /ready\r\nHost: a b{end}": ("not_found", 0, "", 25),
        f"POST /any HTTP/1.1{end}": ("fraud", 0, "", 22),
        f"POST /any HTTP/1.1\r\nContent-Length: 4{end}é12GET /": ("fraud", 4, "é12", 45),
        f"POST /any HTTP/1.1\r\ncontent-length:4\r\nContent-Length: 2{end}1234": ("fraud", 2, "12", 61),
        f"POST /any HTTP/1.1\r\nCONTENT-length:\t3{end}12": ("need", 3, "", 0),
        f"POST /any HTTP/1.1\r\nContent-Length: none{end}12": ("fraud", 0, "", 44),
        f"POST /any HTTP/1.1{end}Content-Length: 3": ("fraud", 0, "", 22),
        "POST /any HTTP/1.1\r\nContent-Length: 0\r\n": ("need", 0, "", 0),
        "": ("need", 0, "", 0),
    }
    out = routed(spark.createDataFrame([(k,) for k in cases], "raw string")).collect()
    assert {r.raw: (r.kind, r.content_length, r.body, r.consumed) for r in out} == cases


def mini(spark):
    """Two cells of three vectors each."""
    rows = [(i, [int(v * 10000)] + [0] * 13, l) for i, (v, l) in enumerate([(0.0, 0), (0.1, 1), (0.2, 0), (0.9, 1), (1.0, 1), (0.95, 1)])]
    vectors = spark.createDataFrame(rows, "id long, q array<smallint>, label int")
    assigned = vectors.select("id", (F.col("id") >= 3).cast("int").alias("cell_id"), F.lit(0).cast("long").alias("d"))
    centroids = spark.createDataFrame([(0, [1000] + [0] * 13), (1, [9500] + [0] * 13)], "cell_id int, c array<smallint>")
    cells = I.offsets(assigned, centroids)
    ordered = I.ordered(vectors, assigned, cells, 128)
    boxed = cells.join(I.bounds(ordered, "cell_id").drop("n"), "cell_id")
    meta = spark.createDataFrame([(I.MAGIC, 5, 6, 2, 16, 128)], "magic string, version int, num_vectors long, num_centroids int, dims_padded int, block_size int")
    return I.Index(centroids, boxed, I.bounds(ordered, "cell_id", "block_no"), ordered, meta)


def ask(spark, *values):
    rows = spark.createDataFrame([(i, [v] + [0.0] * 13) for i, v in enumerate(values)], "qid long, x array<double>")
    return rows.withColumn("q", quantize(F.col("x")))


def test_mini_index(spark):
    index = mini(spark)
    assert Q.fixed(ask(spark, 0.05), index, 2).select("fraud_count", "fraud_score").first() == (3, 0.6)
    assert Q.fixed(ask(spark, 0.97), index, 1).select("fraud_count").first()[0] == 3


@pytest.fixture(scope="module")
def random_index(spark):
    rows = spark.range(600).select("id", F.array(*(((F.xxhash64("id", F.lit(d)) % 3000)).cast("smallint") for d in range(14))).alias("q"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    return rows, I.build(rows.checkpoint(), 20, 3, 8)


def questions(rows):
    return rows.where("id % 20 = 0").select(F.col("id").alias("qid"), "q", F.transform("q", lambda v: v / 10000.0).alias("x"))


def test_all_cells_equal_exact_and_pruning_loses_nothing(spark, random_index):
    rows, index = random_index
    q = questions(rows)
    exact = {(r.qid, r.d) for r in Q.exact(q, rows).collect()}
    assert {(r.qid, r.d) for r in Q.scan(q, Q.probe(q, index.centroids, 20), index).collect()} == exact
    probes = Q.probe(q, index.centroids, 6)
    key = ["qid", "rn", "id", "d", "pos"]
    assert sorted(Q.scan(q, probes, index).select(key).collect()) == sorted(Q.pruned_scan(q, probes, index).select(key).collect())
    assert {(r.qid, r.d) for r in Q.exact(q, rows, broadcast_rows=7).collect()} == exact


def test_bbox_against_a_loop(spark, random_index):
    rows, index = random_index
    q = questions(rows)
    got = {r.qid: (r.fraud_count, r.visited) for r in Q.adaptive_bbox(q, index, 3, 1, 4, 5).collect()}
    cells = {r.cell_id: r for r in index.cells.collect()}
    held = {}
    for r in index.vectors.orderBy("pos").collect():
        held.setdefault(r.cell_id, []).append(r)
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    cents = {r.cell_id: r.c for r in index.centroids.collect()}
    for r in q.collect():
        order = sorted(cents, key=lambda c: (dist(r.q, cents[c]), c))[:3]
        top = sorted((dist(r.q, v.q), 0, k, v.pos, v.label) for k, c in enumerate(order) for v in held.get(c, []))[:5]
        fraud, visited = sum(t[4] for t in top), 0
        if 1 <= fraud <= 4:
            bound = lambda c: sum(max(lo - x, 0, x - hi) ** 2 for x, lo, hi in zip(r.q, cells[c].min_q, cells[c].max_q))
            rest = sorted((bound(c), c) for c in held if c not in order)
            rest = [x for x in rest if len(top) < 5 or x[0] < top[4][0]][:5]
            for n, (lb, c) in enumerate(rest, 1):
                if len(top) == 5 and lb >= top[4][0]:
                    break
                top = sorted(top + [(dist(r.q, v.q), n, 0, v.pos, v.label) for v in held[c]])[:5]
                fraud, visited = sum(t[4] for t in top), visited + 1
                if not 1 <= fraud <= 4:
                    break
        assert got[r.qid] == (fraud, visited)


def test_round_trip_and_corruption(spark, random_index, tmp_path):
    _, index = random_index
    I.write(index, str(tmp_path / "ok"))
    loaded = I.load(spark, str(tmp_path / "ok"))
    assert sorted(loaded.vectors.select("pos", "id").collect()) == sorted(index.vectors.select("pos", "id").collect())
    bad = I.Index(index.centroids, index.cells, index.blocks, index.vectors, index.meta.withColumn("version", F.lit(2)))
    I.write(bad, str(tmp_path / "bad"))
    with pytest.raises(ValueError):
        I.load(spark, str(tmp_path / "bad"))
    with pytest.raises(ValueError):
        I.build(spark.range(3).select("id", F.array(*[F.lit(0).cast("smallint")] * 14).alias("q"), F.lit(0).alias("label")), 5, 1)


def test_fail_open_scoring(spark):
    index = mini(spark)
    rows = spark.createDataFrame([(1, "not json"), (2, json.dumps(payload()))], "request_id long, body string")
    got = {r.request_id: r for r in score_requests(rows, index, Q.QueryOptions(nprobe=2, mode="fixed")).collect()}
    assert not got[1].is_valid and got[1].approved and got[1].response == '{"approved":true,"fraud_score":0.0}'
    assert got[2].is_valid and got[2].fraud_count in range(6)


def test_scores(spark):
    counts = spark.createDataFrame([(5, 90, 3, 2, 0), (0, 0, 0, 0, 0), (1, 1, 8, 0, 0), (50, 50, 0, 0, 0)], "tp long, tn long, fp long, fn long, err long")
    rows = E.detection(counts).select("detection_score", "n").collect()
    assert rows[0].detection_score == pytest.approx(1000 * 1.0457574905606752 - 300.0) and rows[2].detection_score == -3000 and rows[3].detection_score == 3000
    got = spark.createDataFrame([(0.0,), (0.5,), (10.0,), (2001.0,)], "p double").select(E.p99_score(F.col("p")).alias("s")).collect()
    assert [r.s for r in got] == [0, 3000, 2000, -3000]
    text = spark.createDataFrame([(1500.0, 0.5), (12.0, 90_000.0)], "b double, ms double").select(E.humanize_bytes(F.col("b")).alias("b"), E.humanize_ms(F.col("ms")).alias("ms")).collect()
    assert [tuple(r) for r in text] == [("1.5 kB", "500.00us"), ("12 B", "1m30s")]


def test_risky_table():
    assert all(bin(b).count("1") in (2, 3) for _, b, _ in S.RISKY_PATTERNS) and len(S.RISKY_PATTERNS) == 13


def test_stream(spark, tmp_path):
    from fraudlens.streaming.scoring import coarse_stream, parquet_sink, read_requests, score_stream

    index = mini(spark)
    rows = spark.createDataFrame([(1, "not json"), (2, json.dumps(payload()))], "request_id long, body string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = read_requests(spark, str(tmp_path / "in"))
    query = score_stream(stream, index, str(tmp_path / "cp"), parquet_sink(str(tmp_path / "out")), Q.QueryOptions(nprobe=2, mode="fixed"))
    query.processAllAvailable()
    query.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    plain = coarse_stream(stream, index).writeStream.format("memory").queryName("coarse").outputMode("append").start()
    plain.processAllAvailable()
    plain.stop()
    assert spark.sql("SELECT * FROM coarse").count() == 2


def test_sources(spark, tmp_path):
    import gzip

    from fraudlens.sources.requests import read_references, read_test_data

    with gzip.open(tmp_path / "refs.json.gz", "wt") as f:
        json.dump([{"vector": [0.1] * 14, "label": "fraud"}, {"vector": [0.2] * 10, "label": "legit"}], f)
    got = sorted((r.label, list(r.q)) for r in read_references(spark, str(tmp_path / "refs.json.gz")).collect())
    assert got == [(0, [2000] * 10 + [0] * 4), (1, [1000] * 14)]
    (tmp_path / "test.json").write_text(json.dumps({"entries": [{"request": payload(), "expected_approved": True}], "stats": {}}))
    rows = parse(read_test_data(spark, str(tmp_path / "test.json"))).collect()
    assert rows[0].is_valid and rows[0].expected_approved


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_search_makes_no_row_for_each_pair(spark, random_index):
    """Pairs of a query and a vector are never rows: no join of the two, but for one that deals out groups."""
    rows, index = random_index
    q = questions(rows)
    assert "Join" not in plan(Q.exact(q, rows)) and "Cartesian" not in plan(Q.exact(q, rows, broadcast_rows=7))
    assert "Join" not in plan(Q.scan(q, 6, index)) and "Join" not in plan(Q.fixed(q, index, 6)) and "Exchange" not in plan(Q.fixed(q, index, 6)).replace("REPARTITION_BY_NUM", "").split("MapInArrow")[0]


def test_held_and_grouped_search_agree_on_ties(spark, random_index, monkeypatch):
    """Copies tie in every distance; both ways follow the loop's order, within small groups too."""
    rows, _ = random_index
    rows = rows.where("id < 200").select(F.explode(F.array(*(F.col("id") + 1000 * i for i in range(4)))).alias("id"), "q", "label").checkpoint()
    index = I.build(rows, 6, 2, 8)
    q = rows.where("id % 10 = 0 AND id < 200").select(F.col("id").alias("qid"), "q", F.transform("q", lambda v: v / 10000.0 + 0.00003).alias("x"))
    monkeypatch.setattr(Q, "GROUP", 50)
    key = ["qid", "rn", "id", "label", "d", "pos", "vq"]
    assert sorted(Q.scan(q, 3, index).select(key).collect()) == sorted(Q.scan(q, 3, index, most=0).select(key).collect())
    assert sorted(Q.fixed(q, index, 3).collect()) == sorted(Q.fixed(q, index, 3, most=0).select("qid", "fraud_count", "bits", "fraud_score").collect())
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    all_ = rows.collect()
    want = sorted((a.qid, k + 1, i, d) for a in q.collect() for k, (d, i) in enumerate(sorted((dist(a.q, v.q), v.id) for v in all_)[:5]))
    for most in (10_000, 90):
        assert sorted(tuple(r) for r in Q.exact(q, rows, broadcast_rows=most).select("qid", "rn", "id", "d").collect()) == want


def test_search_of_extremes_is_exact(spark):
    """The largest distances that 16 bits allow, and fewer vectors than wanted."""
    big = [[32767] * 14, [-32767] * 14, [32766] + [32767] * 13]
    rows = spark.createDataFrame([(i, v, i % 2) for i, v in enumerate(big)], "id long, q array<smallint>, label int")
    q = rows.where("id < 2").select(F.col("id").alias("qid"), "q")
    want = [(0, 0, 0), (0, 1, 14 * 65534**2), (0, 2, 1), (1, 0, 14 * 65534**2), (1, 1, 0), (1, 2, 13 * 65534**2 + 65533**2)]
    for most in (10, 1):
        assert sorted(Q.exact(q, rows, broadcast_rows=most).select("qid", "id", "d").collect()) == want


def test_test_data_is_written_in_files_of_bounded_size(spark, tmp_path):
    from fraudlens.sources.requests import read_test_data, write_test_data

    rows = spark.createDataFrame([(json.dumps(payload()), i % 2 == 0) for i in range(23)], "body string, expected_approved boolean").repartition(2)
    write_test_data(rows, str(tmp_path / "parts"), entries=4)
    files = [p for p in (tmp_path / "parts").iterdir() if p.name.endswith(".txt") and p.stat().st_size]
    sizes = [len(json.loads(p.read_text())["entries"]) for p in files]
    assert sum(sizes) == 23 and max(sizes) == 4
    got = parse(read_test_data(spark, str(tmp_path / "parts"))).collect()
    assert len(got) == 23 and all(r.is_valid for r in got) and sum(r.expected_approved for r in got) == 12
    write_test_data(rows.where("body IS NULL"), str(tmp_path / "none"))
    assert read_test_data(spark, str(tmp_path / "none")).count() == 0
