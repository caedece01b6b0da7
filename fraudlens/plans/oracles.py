"""DuckDB SQL for the engine's queries, written apart from the Spark plans."""

from __future__ import annotations

from ..schema import CENTROID_FINE, MAX_CENTROIDS, MCC_RISK, RISKY_PATTERNS
from .fixtures import BLOCK, CELLS, MCCS, NPROBE, ROUNDS

_VEC = """
vec AS (SELECT vec_id AS id, list_transform(embedding[1:14], lambda v: CAST(v AS DOUBLE)) AS x,
  list_transform(embedding[1:14], lambda v: CAST(greatest(-32767, least(32767, round(CAST(v AS DOUBLE) * 10000))) AS BIGINT)) AS q,
  CAST(label % 2 AS BIGINT) AS label FROM embeddings),
ref AS (SELECT id, q, label FROM vec),
qry AS (SELECT id AS qid, x, q, label AS qlabel FROM vec WHERE id % 10 = 0)"""


def _d(a: str, b: str) -> str:
    return f"CAST(list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"


def _fine(rounds: int) -> str:
    """CTEs cen0 to cen<rounds>: fine centroids after each Lloyd step."""
    out = f"cen0 AS (SELECT row_number() OVER (ORDER BY id) - 1 AS cell_id, list_transform(q, lambda v: v * {CENTROID_FINE}) AS c FROM (SELECT * FROM ref ORDER BY id LIMIT {CELLS}))"
    for r in range(rounds + 1):
        fine = f"list_transform(r.q, lambda v: v * {CENTROID_FINE})"
        out += f""",
asg{r} AS (SELECT id, m % {MAX_CENTROIDS} AS cell_id, m // {MAX_CENTROIDS} AS d FROM (SELECT r.id, min({_d(fine, 'c.c')} * {MAX_CENTROIDS} + c.cell_id) AS m FROM ref r CROSS JOIN cen{r} c GROUP BY r.id))"""
        if r < rounds:
            out += f""",
sum{r} AS (SELECT a.cell_id, t.i, CAST(sum(ref.q[t.i] * {CENTROID_FINE}) AS BIGINT) AS s, count(*) AS n FROM asg{r} a JOIN ref ON ref.id = a.id CROSS JOIN range(1, 15) t(i) GROUP BY a.cell_id, t.i),
mean{r} AS (SELECT cell_id, list(CAST(sign(s) AS BIGINT) * ((2 * abs(s) + n) // (2 * n)) ORDER BY i) AS c FROM sum{r} GROUP BY cell_id),
cen{r + 1} AS (SELECT i.cell_id, coalesce(m.c, i.c) AS c FROM cen0 i LEFT JOIN mean{r} m ON m.cell_id = i.cell_id)"""
    return out


_INDEX = f"""{_VEC}, {_fine(ROUNDS)},
cen AS (SELECT cell_id, list_transform(c, lambda v: CAST(round(v / {CENTROID_FINE}.0) AS BIGINT)) AS c FROM cen{ROUNDS}),
cells AS (SELECT c.cell_id, coalesce(a.n, 0) AS cnt, CAST(sum(coalesce(a.n, 0)) OVER (ORDER BY c.cell_id ROWS UNBOUNDED PRECEDING) - coalesce(a.n, 0) AS BIGINT) AS start
  FROM cen c LEFT JOIN (SELECT cell_id, count(*) AS n FROM asg{ROUNDS} GROUP BY cell_id) a ON a.cell_id = c.cell_id),
iv AS (SELECT s.cell_id, c.start + s.rn - 1 AS pos, (s.rn - 1) // {BLOCK} AS block_no, s.id, s.q, s.label, s.d AS d_own
  FROM (SELECT a.cell_id, a.id, a.d, r.q, r.label, row_number() OVER (PARTITION BY a.cell_id ORDER BY a.d, a.id) AS rn FROM asg{ROUNDS} a JOIN ref r ON r.id = a.id) s JOIN cells c ON c.cell_id = s.cell_id),
coarse AS (SELECT q.qid, c.cell_id, {_d('q.q', 'c.c')} AS cdist FROM qry q CROSS JOIN cen c),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cdist, cell_id) AS cell_rank FROM coarse)"""


def _scan(name: str, nprobe: int, only: str = "") -> str:
    """CTEs of a fixed-probe search: <name>t (five nearest), <name>r (reranked), <name>v (votes)."""
    return f"""
{name}t AS (SELECT * FROM (SELECT p.qid, v.id, v.label, v.pos, v.q AS vq, q.x, {_d('q.q', 'v.q')} AS d,
    row_number() OVER (PARTITION BY p.qid ORDER BY {_d('q.q', 'v.q')}, p.cell_rank, v.pos) AS rn
  FROM ranked p JOIN qry q ON q.qid = p.qid JOIN iv v ON v.cell_id = p.cell_id WHERE p.cell_rank <= {nprobe}{only}) WHERE rn <= 5),
{name}e AS (SELECT *, list_sum(list_transform(list_zip(x, vq), lambda z: (z[1] - z[2] / 10000.0) * (z[1] - z[2] / 10000.0))) AS d_exact FROM {name}t),
{name}r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d_exact, rn) AS rank FROM {name}e),
{name}v AS (SELECT qid, CAST(sum(label) AS BIGINT) AS fraud_count, CAST(sum(label * CAST(power(2, rank - 1) AS BIGINT)) AS BIGINT) AS bits, sum(label) / 5.0 AS fraud_score FROM {name}r GROUP BY qid)"""


_EXACT = f"""ex AS (SELECT * FROM (SELECT q.qid, r.id, r.label, {_d('q.q', 'r.q')} AS d, row_number() OVER (PARTITION BY q.qid ORDER BY {_d('q.q', 'r.q')}, r.id) AS rn FROM qry q CROSS JOIN ref r) WHERE rn <= 5),
exv AS (SELECT qid, CAST(sum(label) AS BIGINT) AS fraud_count FROM ex GROUP BY qid)"""

_RISKY = "risky(bits, max_gap) AS (VALUES " + ", ".join(f"({b}, {g})" for n, b, g in RISKY_PATTERNS if n == NPROBE) + ")"
_GAP = f"gap AS (SELECT a.qid, b.cdist - a.cdist AS gap FROM ranked a JOIN ranked b ON a.qid = b.qid AND a.cell_rank = {NPROBE} AND b.cell_rank = {NPROBE + 1})"
_PATTERN = f"""{_RISKY}, {_GAP}, chosen AS (SELECT v.qid FROM p1v v JOIN gap g ON g.qid = v.qid JOIN risky r ON r.bits = v.bits AND g.gap <= r.max_gap)"""
_AMBIGUOUS = "chosen AS (SELECT qid FROM p1v WHERE fraud_count BETWEEN 1 AND 4)"
_MERGED = "merged AS (SELECT qid, fraud_count, fraud_score, FALSE AS expanded FROM p1v WHERE qid NOT IN (SELECT qid FROM chosen) UNION ALL SELECT qid, fraud_count, fraud_score, TRUE FROM p2v)"
_WIDE = _scan("p2", 48, " AND p.qid IN (SELECT qid FROM chosen)")
_ADAPTIVE = f"{_INDEX}, {_scan('p1', NPROBE)}, {_PATTERN}, {_WIDE}, {_MERGED}"

#: rep(qid, fraud_count, visited): ambiguous queries visit up to 8 further cells by the lower bound of their boxes.
_FRAUD = "CAST(list_sum(list_transform({}, lambda t: t.label)) AS BIGINT)"
_NEXT = "list_sort(list_concat(s.top, c.top))[1:5]"
_REPAIR = f"""fifth AS (SELECT qid, CASE WHEN count(*) >= 5 THEN max(d) END AS worst FROM p1t GROUP BY qid),
box AS (SELECT cell_id, t.i, min(q[t.i]) AS lo, max(q[t.i]) AS hi FROM iv CROSS JOIN range(1, 15) t(i) GROUP BY cell_id, t.i),
low AS (SELECT y.qid, b.cell_id, CAST(sum(power(greatest(b.lo - y.q[b.i], 0, y.q[b.i] - b.hi), 2)) AS BIGINT) AS lb FROM qry y JOIN chosen USING (qid) CROSS JOIN box b GROUP BY y.qid, b.cell_id),
able AS (SELECT l.qid, l.cell_id, l.lb, row_number() OVER (PARTITION BY l.qid ORDER BY l.lb, l.cell_id) AS visit FROM low l LEFT JOIN fifth f ON f.qid = l.qid
  WHERE (f.worst IS NULL OR l.lb < f.worst) AND NOT EXISTS (SELECT 1 FROM ranked r WHERE r.qid = l.qid AND r.cell_id = l.cell_id AND r.cell_rank <= {NPROBE})),
near AS (SELECT a.qid, a.visit, a.lb, v.pos, v.label, {_d('y.q', 'v.q')} AS d FROM able a JOIN qry y ON y.qid = a.qid JOIN iv v ON v.cell_id = a.cell_id WHERE a.visit <= 8),
five AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY qid, visit ORDER BY d, pos) <= 5),
cell AS (SELECT qid, visit, lb, list({{'d': d, 'visit': CAST(visit AS BIGINT), 'pos': CAST(pos AS BIGINT), 'label': CAST(label AS BIGINT)}}) AS top FROM five GROUP BY qid, visit, lb),
begun AS (SELECT qid, list_sort(list({{'d': d, 'visit': CAST(0 AS BIGINT), 'pos': CAST(rn AS BIGINT), 'label': CAST(label AS BIGINT)}})) AS top FROM p1t JOIN chosen USING (qid) GROUP BY qid),
st AS (SELECT qid, CAST(0 AS BIGINT) AS v, top, FALSE AS done FROM begun UNION ALL
  SELECT s.qid, s.v + 1, {_NEXT}, {_FRAUD.format(_NEXT)} NOT BETWEEN 1 AND 4 FROM st s JOIN cell c ON c.qid = s.qid AND c.visit = s.v + 1 WHERE NOT s.done AND NOT (len(s.top) >= 5 AND c.lb >= s.top[5].d)),
rep AS (SELECT qid, {_FRAUD.format('top')} AS fraud_count, v AS visited FROM st QUALIFY row_number() OVER (PARTITION BY qid ORDER BY v DESC) = 1)"""
_RISK = "CASE mcc " + " ".join(f"WHEN '{m}' THEN {r}" for m, r in MCC_RISK.items()) + " ELSE 0.5 END"
_MCC = "[" + ", ".join(f"'{m}'" for m in MCCS) + "]"
_PAY = f"""
ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(round(value * 100) AS BIGINT) AS cents FROM events),
us AS (SELECT user_id, CAST(sum(cents) AS BIGINT) * 40 / CAST(count(*) AS DOUBLE) / 100 AS user_avg, list_sort(list_distinct(list('MERC-' || lpad(CAST(k AS VARCHAR), 3, '0')) FILTER (k % 3 = 0))) AS known FROM ev GROUP BY user_id),
me AS (SELECT k, CAST(sum(cents) AS BIGINT) * 40 / CAST(count(*) AS DOUBLE) / 100 AS merchant_avg FROM ev GROUP BY k),
pl AS (SELECT e.event_id AS request_id, e.event_id % 101 NOT IN (1, 2, 3, 4) AS is_valid, e.value * 40 AS amount, e.event_id % 15 AS installments, e.ts,
  CASE WHEN e.user_id % 17 = 0 THEN 0.0 ELSE u.user_avg END AS customer_avg, e.event_id % 25 AS tx_count, coalesce(u.known, []) AS known,
  'MERC-' || lpad(CAST(e.k AS VARCHAR), 3, '0') AS merchant_id, {_MCC}[e.k % 12 + 1] AS mcc, m.merchant_avg,
  e.event_type IN ('click', 'view') AS is_online, e.event_type = 'purchase' AS card_present, CAST((e.user_id * 37 + e.event_id * 13) % 1500 AS DOUBLE) AS km_home,
  lag(e.ts) OVER (PARTITION BY e.user_id ORDER BY e.ts, e.event_id) AS last_ts, CAST((e.event_id * 7) % 1200 AS DOUBLE) AS last_km
  FROM ev e JOIN us u ON u.user_id = e.user_id JOIN me m ON m.k = e.k),
ok AS (SELECT *, date_diff('minute', last_ts, ts) AS minutes FROM pl WHERE is_valid),
ft AS (SELECT request_id, [least(1.0, greatest(0.0, amount / 10000)), least(1.0, installments / 12.0), CASE WHEN customer_avg > 0 THEN least(1.0, greatest(0.0, amount / customer_avg / 10)) ELSE 0.0 END,
  hour(ts) / 23.0, (isodow(ts) - 1) / 6.0, CASE WHEN last_ts IS NULL THEN -1.0 ELSE least(1.0, greatest(0.0, minutes / 1440.0)) END, CASE WHEN last_ts IS NULL THEN -1.0 ELSE least(1.0, last_km / 1000) END,
  least(1.0, km_home / 1000), least(1.0, tx_count / 20.0), CAST(is_online AS INT), CAST(card_present AS INT), CASE WHEN list_contains(known[1:16], merchant_id) THEN 0.0 ELSE 1.0 END, {_RISK}, least(1.0, merchant_avg / 10000)]::DOUBLE[] AS f FROM ok)"""
_ISO = "strftime({}, '%Y-%m-%dT%H:%M:%SZ')"


def _f(*names: str, start: int) -> str:
    return f"WITH {_PAY} SELECT request_id, " + ", ".join(f"f[{start + i}] AS {n}" for i, n in enumerate(names)) + " FROM ft"


_BODY = "'{{\"approved\":' || CASE WHEN {0} < 3 THEN 'true' ELSE 'false' END || ',\"fraud_score\":' || CAST(CAST({0} AS DOUBLE) / 5 AS VARCHAR) || '}}'"
_CLASS = "CASE WHEN status <> 200 THEN 'err' WHEN approved = expected THEN CASE WHEN approved THEN 'tn' ELSE 'tp' END WHEN approved THEN 'fn' ELSE 'fp' END"
_PRED = f"{_ADAPTIVE}, {_EXACT}, pr AS (SELECT m.qid, m.fraud_count < 3 AS approved, e.fraud_count < 3 AS expected, CASE WHEN m.qid % 250 = 0 THEN 500 ELSE 200 END AS status FROM merged m JOIN exv e ON e.qid = m.qid)"
_PRED_LABEL = f"{_ADAPTIVE}, pr AS (SELECT m.qid, m.fraud_count < 3 AS approved, q.qlabel = 0 AS expected, 200 AS status FROM merged m JOIN qry q ON q.qid = m.qid)"
_COUNTS = "cc AS (SELECT " + ", ".join(f"count(*) FILTER (c = '{k}') AS {k}" for k in ("tp", "tn", "fp", "fn", "err")) + f" FROM (SELECT {_CLASS} AS c FROM pr))"
_SCORE = """s AS (SELECT *, tp + tn + fp + fn + err AS n, fp + fn + err AS failures, fp + 3 * fn + 5 * err AS weighted_errors FROM cc)
SELECT tp, tn, fp, fn, err, n, failures, weighted_errors, round(failures / CAST(n AS DOUBLE), 6) AS failure_rate, round(weighted_errors / CAST(n AS DOUBLE), 6) AS epsilon, round((tp + tn) / CAST(n AS DOUBLE), 6) AS accuracy,
  CASE WHEN failures / CAST(n AS DOUBLE) > 0.15 THEN -3000.0 ELSE round(1000 * log10(1 / greatest(weighted_errors / CAST(n AS DOUBLE), 0.001)) - 300 * log10(1.0 + weighted_errors), 6) END::DOUBLE AS detection_score FROM s"""
_QIV = f"""{_PAY}, {_INDEX.replace('qry AS (SELECT id AS qid, x, q, label AS qlabel FROM vec WHERE id % 10 = 0)', "qry AS (SELECT request_id AS qid, f AS x, list_transform(f, lambda v: CAST(greatest(-32767, least(32767, round(v * 10000))) AS BIGINT)) AS q FROM ft)")}, {_scan('p1', NPROBE)}"""


def _dims(source: str, keys: str, array: str, value: str) -> str:
    return f"SELECT {keys}, CAST(t.i - 1 AS BIGINT) AS dim, {array}[t.i] AS {value} FROM {source} CROSS JOIN range(1, 15) t(i)"


def oracle_sql() -> dict[str, str]:
    index, fixed = f"WITH {_INDEX}", f"WITH {_INDEX}, {_scan('p1', NPROBE)}"
    zero = "CAST(0 AS BIGINT)"
    top = f"{fixed} SELECT qid, rn, id, label, d, pos FROM p1t"
    recall = ", ".join(_scan(f"n{n}", n) for n in (1, 4, 10, 32, 64))
    hits = " UNION ALL ".join(f"SELECT CAST({n} AS BIGINT) AS nprobe, count(*) AS hits FROM n{n}t a JOIN ex e ON e.qid = a.qid AND e.id = a.id" for n in (1, 4, 10, 32, 64))
    return {
        "scan_reference": f"WITH {_VEC} {_dims('vec', 'id, label', 'q', 'q')}",
        "parse_payload": f"WITH {_PAY} SELECT request_id, is_valid, " + ", ".join(
            f"CASE WHEN is_valid THEN {e} END AS {n}" for n, e in {
                "amount": "amount", "installments": "installments", "requested_at": _ISO.format("ts"), "customer_avg": "customer_avg", "tx_count": "tx_count", "n_known": "len(known)", "merchant_id": "merchant_id", "mcc": "mcc",
                "merchant_avg": "merchant_avg", "is_online": "is_online", "card_present": "card_present", "km_home": "km_home", "last_at": _ISO.format("last_ts"), "last_km": "CASE WHEN last_ts IS NOT NULL THEN last_km END",
            }.items()) + " FROM pl",
        "known_merchant_flag": f"WITH {_PAY} SELECT request_id, CAST(f[12] AS BIGINT) AS unknown_merchant FROM ft",
        "route_requests": """WITH r AS (SELECT event_id AS request_id, event_id % 10 AS k, props, strlen(props) AS n FROM events)
            SELECT request_id, CASE WHEN k = 0 THEN 'ready' WHEN k IN (1, 8) THEN 'not_found' WHEN k IN (6, 9) THEN 'need' ELSE 'fraud' END AS kind,
            CASE WHEN k IN (2, 3, 4, 5) THEN n WHEN k = 6 THEN CAST('9' || n AS BIGINT) ELSE 0 END AS content_length, CASE WHEN k IN (2, 3, 4, 5) THEN props ELSE '' END AS body,
            CASE k WHEN 0 THEN 32 WHEN 1 THEN 23 WHEN 2 THEN 49 + len(CAST(n AS VARCHAR)) + n - 1 WHEN 3 THEN 37 + len(CAST(n AS VARCHAR)) + n WHEN 4 THEN 38 + len(CAST(n AS VARCHAR)) + n WHEN 5 THEN 48 + len(CAST(n AS VARCHAR)) + n WHEN 7 THEN 29 WHEN 8 THEN 14 ELSE 0 END AS consumed FROM r""",
        "http_responses": f"""WITH r AS (SELECT event_id AS request_id, event_id % 10 AS k, CASE WHEN event_id % 7 <= 5 THEN event_id % 7 ELSE 0 END AS f FROM events), b AS (SELECT *, {_BODY.format('f')} AS body FROM r)
            SELECT request_id, CASE WHEN k = 0 THEN 'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Length:0' || chr(13) || chr(10) || chr(13) || chr(10) WHEN k IN (1, 8) THEN 'HTTP/1.1 404 Not Found' || chr(13) || chr(10) || 'Content-Length:0' || chr(13) || chr(10) || chr(13) || chr(10)
            WHEN k NOT IN (6, 9) THEN 'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Length:' || len(body) || chr(13) || chr(10) || chr(13) || chr(10) || body END AS response FROM b""",
        "scan_reference_file": f"WITH {_VEC}, l AS ({_dims('vec', 'label', 'q', 'q')}) SELECT label, dim, q, count(*) AS n FROM l GROUP BY label, dim, q",
        "scan_test_data": f"WITH {_PAY} SELECT request_id, request_id % 3 > 0 AS expected_approved, amount FROM pl WHERE request_id % 101 <> 4",
        "initial_centroids": f"WITH {_VEC}, c AS (SELECT row_number() OVER (ORDER BY (id % 2147483648) * 2654435761 % 4294967296, id) - 1 AS cell_id, q FROM ref QUALIFY cell_id < {CELLS}) {_dims('c', 'cell_id', f'list_transform(q, lambda v: v * {CENTROID_FINE})', 'c')}",
        "option_clamping": "SELECT i, greatest(1, least(64, i - 20)) AS nprobe, least(i % 9, 5) AS repair_min, least(i % 11, 5) AS repair_max, greatest(1, least(128, 2 * i - 40)) AS repair_candidates FROM (SELECT unnest(range(200)) AS i)",
        "final_score": f"""WITH {_PRED}, {_COUNTS}, {_SCORE.replace('SELECT tp,', ', sc AS (SELECT tp,', 1)}), l AS (SELECT quantile_cont(value, 0.99) AS p FROM events), t AS (SELECT p, CASE WHEN p <= 0 THEN 0.0 WHEN p > 2000 THEN -3000.0 ELSE 1000 * log10(1000 / greatest(p, 1.0)) END::DOUBLE AS ps FROM l)
            SELECT weighted_errors, round(p, 6) AS p99, round(ps, 6) AS p99_score, detection_score, round(ps + detection_score, 6) AS final_score FROM sc, t""",
        "throughput": "SELECT event_type, count(*) AS n, round(count(*) / CAST(epoch(max(date_trunc('second', ts))) - epoch(min(date_trunc('second', ts))) AS DOUBLE), 9) AS per_second FROM events GROUP BY event_type",
        "fail_open": f"WITH {_PAY}, n AS (SELECT request_id, CASE WHEN is_valid THEN request_id % 6 ELSE 0 END AS fraud_count FROM pl) SELECT request_id, fraud_count, {_BODY.format('fraud_count')} AS response FROM n",
        "warmup_vectors": "SELECT CAST(i AS BIGINT) AS i, CAST(d AS BIGINT) AS dim, CASE WHEN i % 4 = 0 AND d IN (5, 6) THEN -1.0 ELSE ((i * 131 + d * 17) % 1000) / 1000.0 END::DOUBLE AS value FROM range(2048) a(i) CROSS JOIN range(14) b(d)",
        "amount_features": _f("amount", "installments", "amount_vs_avg", start=1),
        "time_features": _f("hour", "weekday", start=4),
        "minutes_diff": f"WITH {_PAY} SELECT request_id, minutes FROM ok WHERE last_ts IS NOT NULL",
        "history_features": _f("minutes_since", "km_since", start=6),
        "terminal_features": _f("km_home", "tx_count", "is_online", "card_present", start=8),
        "mcc_risk": _f("risk", start=13),
        "feature_vector": f"WITH {_PAY} {_dims('ft', 'request_id', 'f', 'value')}",
        "quantized_features": f"WITH {_PAY} {_dims('(SELECT request_id AS qid, list_transform(f, lambda v: CAST(greatest(-32767, least(32767, round(v * 10000))) AS BIGINT)) AS q FROM ft)', 'qid', 'q', 'q')}",
        "distance_i16": f"WITH {_VEC} SELECT qry.qid, ref.id, {_d('qry.q', 'ref.q')} AS d FROM qry CROSS JOIN ref",
        "bbox_lower_bound": f"""WITH {_VEC}, b AS (SELECT id % 16 AS cell_id, t.i, min(q[t.i]) AS lo, max(q[t.i]) AS hi FROM ref CROSS JOIN range(1, 15) t(i) GROUP BY id % 16, t.i)
            SELECT qid, cell_id, CAST(sum(power(greatest(lo - q[i], 0, q[i] - hi), 2)) AS BIGINT) AS lb FROM qry CROSS JOIN b GROUP BY qid, cell_id""",
        "assign_cells": f"WITH {_VEC}, {_fine(0)} SELECT id, cell_id, d FROM asg0",
        "kmeans_step": f"WITH {_VEC}, {_fine(1)} {_dims('cen1', 'cell_id', 'c', 'c')}",
        "kmeans_fit": f"WITH {_VEC}, {_fine(ROUNDS)} {_dims(f'cen{ROUNDS}', 'cell_id', 'c', 'c')}",
        "cell_offsets": f"{index} SELECT cell_id, cnt, start FROM cells",
        "cell_order": f"{index} SELECT cell_id, pos, block_no, id, d_own FROM iv",
        "cell_bounds": f"{index} SELECT c.cell_id, CAST(t.i - 1 AS BIGINT) AS dim, coalesce(min(v.q[t.i]), {zero}) AS lo, coalesce(max(v.q[t.i]), {zero}) AS hi FROM cells c CROSS JOIN range(1, 15) t(i) LEFT JOIN iv v ON v.cell_id = c.cell_id GROUP BY c.cell_id, t.i",
        "block_bounds": f"{index} SELECT cell_id, block_no, CAST(t.i - 1 AS BIGINT) AS dim, min(q[t.i]) AS lo, max(q[t.i]) AS hi FROM iv CROSS JOIN range(1, 15) t(i) GROUP BY cell_id, block_no, t.i",
        "index_validate": f"{index} SELECT CAST(5 AS BIGINT) AS version, count(*) AS num_vectors, CAST({CELLS} AS BIGINT) AS num_centroids, count(*) AS found_vectors, (SELECT count(*) FROM cells) AS found_cells, (SELECT CAST(sum(cnt) AS BIGINT) FROM cells) AS sum_cnt, TRUE AS ok FROM iv",
        "coarse_distances": f"{index} SELECT qid, cell_id, cdist FROM coarse",
        "probe_cells": f"{index} SELECT qid, cell_id, cdist, cell_rank FROM ranked WHERE cell_rank <= {NPROBE}",
        "exact_knn": f"WITH {_VEC}, {_EXACT} SELECT qid, rn, id, label, d FROM ex",
        "ivf_topk_fixed": top,
        "block_prune_check": top,
        "rerank": f"{fixed} SELECT qid, id, rank, round(d_exact, 9) AS d_exact FROM p1r",
        "vote": f"{fixed} SELECT qid, fraud_count, fraud_score FROM p1v",
        "rank_bits": f"{fixed} SELECT qid, bits FROM p1v",
        "adaptive_pattern": f"WITH {_ADAPTIVE} SELECT qid, fraud_count, fraud_score, expanded FROM merged",
        "adaptive_ambiguous": f"WITH {_INDEX}, {_scan('p1', NPROBE)}, {_AMBIGUOUS}, {_WIDE}, {_MERGED} SELECT qid, fraud_count, fraud_score, expanded FROM merged",
        "adaptive_bbox": f"WITH RECURSIVE {_INDEX}, {_scan('p1', NPROBE)}, {_AMBIGUOUS}, {_REPAIR} SELECT v.qid, coalesce(r.fraud_count, v.fraud_count) AS fraud_count, coalesce(r.fraud_count, v.fraud_count) / 5.0 AS fraud_score, coalesce(r.visited, 0) AS visited FROM p1v v LEFT JOIN rep r ON r.qid = v.qid",
        "decision": f"{fixed} SELECT qid, fraud_count < 3 AS approved, fraud_score FROM p1v",
        "response_body": f"WITH n AS (SELECT event_id, CASE WHEN event_id % 8 <= 5 THEN event_id % 8 ELSE 0 END AS f FROM events) SELECT event_id, {_BODY.format('f')} AS response FROM n",
        "confusion_class": f"WITH {_PRED} SELECT qid, {_CLASS} AS class FROM pr",
        "confusion_counts": f"WITH {_PRED}, {_COUNTS} SELECT * FROM cc",
        "detection_score": f"WITH {_PRED}, {_COUNTS}, {_SCORE}",
        "detection_score_cut": f"WITH {_PRED_LABEL}, {_COUNTS}, {_SCORE}",
        "dataset_stats": f"WITH {_VEC} SELECT count(*) AS total, count(*) FILTER (label = 1) AS fraud_count, count(*) FILTER (label = 0) AS legit_count, count(*) FILTER (label = 1) / CAST(count(*) AS DOUBLE) AS fraud_rate, count(*) FILTER (label = 0) / CAST(count(*) AS DOUBLE) AS legit_rate FROM vec",
        "latency_p99": "SELECT round(quantile_cont(value, 0.99), 6) AS p99 FROM events",
        "p99_score": "SELECT event_type, round(CASE WHEN p <= 0 THEN 0.0 WHEN p > 2000 THEN -3000.0 ELSE 1000 * log10(1000 / greatest(p, 1.0)) END, 6)::DOUBLE AS score FROM (SELECT event_type, quantile_cont(value, 0.99) AS p FROM events GROUP BY event_type)",
        "recall_by_nprobe": f"WITH {_INDEX}, {_EXACT}, {recall}, h AS ({hits}) SELECT nprobe, hits, round(hits / CAST((SELECT count(*) FROM ex) AS DOUBLE), 6) AS recall FROM h",
        "score_payloads": f"WITH {_QIV}, o AS (SELECT p.request_id, p.is_valid, coalesce(v.fraud_count, 0) AS fraud_count FROM pl p LEFT JOIN p1v v ON v.qid = p.request_id) SELECT request_id, is_valid, fraud_count, fraud_count < 3 AS approved, {_BODY.format('fraud_count')} AS response FROM o",
        "flagship": f"WITH {_VEC}, {_EXACT} SELECT qid, fraud_count, fraud_count / 5.0 AS fraud_score, fraud_count < 3 AS approved, {_BODY.format('fraud_count')} AS response FROM exv",
    }
