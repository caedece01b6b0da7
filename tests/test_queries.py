"""The engine's queries against DuckDB on the smallest tables."""

import glob
import os

import pytest

from fraudlens.plans import oracles, queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
#: Queries that share most of their plan with one of these are left to the correctness run.
NAMES = [
    "scan_reference", "parse_payload", "route_requests", "fail_open", "warmup_vectors", "feature_vector", "quantized_features", "minutes_diff", "distance_i16", "bbox_lower_bound", "assign_cells", "kmeans_fit",
    "cell_order", "cell_bounds", "block_bounds", "probe_cells", "exact_knn", "block_prune_check", "rerank", "adaptive_pattern", "adaptive_ambiguous", "adaptive_bbox", "response_body", "final_score", "latency_p99", "flagship",
    "http_responses", "scan_reference_file", "scan_test_data", "initial_centroids", "option_clamping", "throughput", "score_payloads",
]


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_matches_duckdb(spark, duck, name):
    df = queries.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    found = duck.execute(oracles.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in found.fetchall())


def test_every_oracle_has_a_query():
    assert set(oracles.oracle_sql()) <= set(queries.queries())


@pytest.mark.parametrize("name, most", [("feature_vector", 1), ("parse_payload", 1), ("score_payloads", 0)])
def test_bodies_are_parsed_once(spark, name, most):
    """One from_json in the plan, or none after a checkpoint: the optimiser copies none into predicates or features."""
    plan = queries.queries()[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") <= most


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_final_score_adds_the_shown_detection_score(spark):
    r = queries.queries()["final_score"](spark, "/root/testdata/sf0.01").first()
    assert r.final_score == round(r.p99_score + r.detection_score, 6) == 650.357244


def test_payload_votes_are_found_in_the_request_s_row(spark):
    """Requests meet no vectors in a join: a request brings one row to the votes, not five for each of its cells."""
    plan = queries.queries()["score_payloads"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window") == 0 and plan.count("Join") == 1
