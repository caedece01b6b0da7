"""The operators against brute force on small tables."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fraudlens.llm import _graph, ann, bpe, line_dedup, minhash_dedup, pii, quality, substring_dedup, toxicity, url_filter

from . import fixtures as Fx

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Sets:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


@pytest.mark.parametrize("width,block", [(4, 1000), (5, 1000), (4, 3)])
def test_minhash(spark, width, block):
    rows = Fx.documents()
    sets = {}
    for i, t, *_ in rows:
        w = WORD.findall((t or "").translate(UPPER))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    groups = Sets(sets)
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                groups.join(a, b)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(Fx.frame(spark, rows), width, block=block).collect()}
    assert got == {i: (len(s), groups.find(i), groups.find(i) == i) for i, s in sets.items()}


@pytest.mark.parametrize("most", [50, 1 << 20])
def test_substring(spark, most):
    rows, seen, expected = Fx.documents(), set(), {}
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        covered = [False] * len(w)
        for p in range(len(w) - 19):
            k = tuple(w[p : p + 20])
            if k in seen:
                covered[p : p + 20] = [True] * 20
            seen.add(k)
        kept = [x for x, c in zip(w, covered) if not c]
        expected[i] = (len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    out = substring_dedup.remove_repeats(Fx.frame(spark, rows), most=most, texts=True).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out} == expected
    assert sum(e[1] for e in expected.values()) > 300 and all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in out)


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance():
    import random

    rng = random.Random(1)
    for _ in range(400):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 14))) for _ in range(2))
        for most in range(6):
            assert line_dedup.distance_within(a, b, most) == (levenshtein(a, b) <= most)


@pytest.mark.parametrize("most", [500, 2])
def test_lines(spark, most):
    """All pairs of lines against plain edit similarity, with no test of SimHashes or blocks."""
    rng = __import__("random").Random(9)
    rows = [r for r in Fx.documents() if len(r[1] or "") < 1500]
    line = " ".join(Fx.words(rng, 60))
    rows += [(1000 + k, f"{line} tail\n{line}", "en", "s", 1) for k in range(3)] + [(2000, line + " other", "en", "s", 1)]
    seen = []
    for i, t, *_ in rows:
        for k, l in enumerate((t or "").split("\n")):
            if w := re.findall(r"(?:[A-Za-z0-9]|[^\x00-\x7f])+", l.translate(UPPER)):
                seen.append((i, k, " ".join(w)))
    forms = sorted({f for *_, f in seen})
    groups, linked = Sets(range(len(forms))), 0
    for a in range(len(forms)):
        for b in range(a):
            longer = max(len(forms[a]), len(forms[b]))
            if min(forms[a].count(" "), forms[b].count(" ")) >= 4 and 5 * min(len(forms[a]), len(forms[b])) >= 4 * longer and levenshtein(forms[a], forms[b]) * 5 <= longer:
                groups.join(a, b)
                linked += 1
    assert linked >= 14
    first, number = {}, {f: n for n, f in enumerate(forms)}
    for i, k, f in seen:
        g = groups.find(number[f])
        first[g] = min(first.get(g, (i, k)), (i, k))
    gone = {}
    for i, k, f in seen:
        if first[groups.find(number[f])] != (i, k):
            gone.setdefault(i, set()).add(k)
    out = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.remove_lines(Fx.frame(spark, rows), most=most).collect()}
    for i, t, *_ in rows:
        kept = None if t is None else "\n".join(l for k, l in enumerate(t.split("\n")) if k not in gone.get(i, ()))
        assert out[i] == (kept, len(gone.get(i, ())))


def test_lines_of_repeated_rows_and_ids(spark):
    """Equal rows are one document; two texts of one doc_id are judged each by itself; a null doc_id takes no part."""
    rows = [(3, "the first line\nonly here"), (3, "the first line\nonly here"), (4, "the first line\nbefore"), (4, "unlike it\nthe first line"), (None, "the first line"), (5, None), (5, "")]
    out = line_dedup.remove_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    expected = [(3, "the first line\nonly here", 2, 0)] * 2 + [(4, "before", 2, 1), (4, "unlike it", 2, 1), (None, "the first line", 1, 0), (5, None, 0, 0), (5, "", 1, 0)]
    assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, expected))


def test_distance_bounds():
    """What the verification skips or accepts early never differs from the plain distance."""
    rng = __import__("random").Random(3)
    for _ in range(300):
        w = Fx.words(rng, rng.randint(1, 14))
        v = list(w)
        for _ in range(rng.randint(0, 5)):
            k = rng.randrange(len(v) + 1)
            v[k : k + rng.randint(0, 1)] = rng.choice(([], ["so"], ["other", "ka"]))
        a, b = " ".join(w), " ".join(v)
        if b:
            assert line_dedup.alike(a, b, 0.8, {}) == (levenshtein(a, b) <= int(max(len(a), len(b)) * 0.2 + 1e-9))


def ranks():
    """Byte ranks and a few merges, learnt from nothing but their order."""
    table = {bytes((b,)): b for b in range(256)}
    for t in (b"th", b"he", b"the", b" t", b" the", b"in", b"ing", b"er", b"her", b"\xf0\x9f", b"\xc3\xa9", b"aa", b"aaaa", b"ab", b"ba", b"aba"):
        table[t] = len(table)
    return table


def test_bpe_against_plain_merging():
    import random

    table = ranks()
    fst, rng = bpe.Transducer(table, most_states=40), random.Random(4)
    for _ in range(500):
        piece = "".join(rng.choice(["a", "b", "t", "h", "e", "r", "i", "n", "g", " ", "é", "🙂"]) for _ in range(rng.randint(1, 40))).encode()
        assert list(fst.stream(piece, every=7)) == fst.merge(piece)
        assert list(fst.encode_piece(piece)) == ([table[piece]] if piece in table else fst.merge(piece))


def test_bpe_against_tiktoken(spark):
    tiktoken, public = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        known = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=bpe.load_ranks(f.read()), special_tokens={})
    rows = Fx.documents()
    df = Fx.frame(spark, rows)
    expected = {i: known.encode_ordinary(t or "") for i, t, *_ in rows}
    assert {r.doc_id: r.ids for r in bpe.encode(df, path, public.PATTERN).collect()} == expected
    decoded = bpe.decode(bpe.encode(df, path, public.PATTERN), path).collect()
    assert all(r.decoded == (r.text or "") for r in decoded)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digest(df, path, public.PATTERN).collect()}
    assert got == {i: (len(expected[i]), sha(" ".join(map(str, expected[i])).encode()), sha((t or "").encode())) for i, t, *_ in rows}


def test_utf8_machine():
    text = "aé€🙂z"
    machine, out = bpe.Utf8Machine(), b""
    for b in text.encode():
        part = machine.feed(bytes((b,)))
        part.decode()
        out += part
    assert out + machine.finish() == text.encode()
    machine = bpe.Utf8Machine()
    assert machine.feed(b"\xe2\x28") == b"\xe2\x28" and machine.feed(b"\xf0\x9f") == b"" and machine.finish() == b"\xf0\x9f"


def kneser_ney(texts, trusted):
    counts = {5: Counter()}
    for i in trusted:
        x = b"\0" * 4 + texts[i]
        counts[5].update(x[k - 4 : k + 1] for k in range(4, len(x)))
    for k in (4, 3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    off = {k: quality.discounts(*(Counter(c.values())[i] for i in (1, 2, 3, 4))) for k, c in counts.items()}
    total, freed = Counter(), Counter()
    for k, c in counts.items():
        for g, n in c.items():
            total[g[:-1], k] += n
            freed[g[:-1], k] += off[k][min(n, 3) - 1]

    def p(g):
        if not g:
            return 1 / 256
        k, q = len(g), p(g[1:])
        h = g[:-1], k
        if h not in total:
            return q
        n = counts[k][g]
        return ((n - off[k][min(n, 3) - 1] if n else 0) + freed[h] * q) / total[h]

    return p


@pytest.mark.parametrize("rows_broadcast", [0, 8_000_000])
def test_quality(spark, rows_broadcast):
    """Perplexity, threshold and decision of every document against a plain model."""
    rows = [(i, (t or "")[:300] if t else t, *rest) for i, t, *rest in Fx.documents()]
    trusted = {i for i, *_ in rows[:40] if i % 3}
    labels = spark.createDataFrame([(i, int(i in trusted), 0) for i, *_ in rows[:40]], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in quality.judge(Fx.frame(spark, rows), labels, quantile=0.8, broadcast_rows=rows_broadcast).collect()}
    texts = {i: (t or "").encode() for i, t, *_ in rows}
    measures = {r.id for r in spark.range(200).where(F.pmod(F.xxhash64("id"), F.lit(5)) == 0).collect()}
    p = kneser_ney(texts, [i for i in texts if i in trusted - measures])
    assert sum(p(b"kalo" + bytes((b,))) for b in range(256)) == pytest.approx(1)
    for i in texts:
        x = b"\0" * 4 + texts[i]
        if len(x) > 4:
            assert out[i].perplexity == pytest.approx(math.exp(-sum(math.log(p(x[k - 4 : k + 1])) for k in range(4, len(x))) / (len(x) - 4)), rel=1e-5)
        else:
            assert out[i].perplexity is None and not out[i].kept
    for lang in ("en", "fr"):
        mine = [i for i, _, l, *_ in rows if l == lang]
        value = lambda some: sorted(out[i].perplexity for i in some if out[i].perplexity is not None)
        base = value(i for i in mine if i in trusted & measures) or value(mine)
        threshold = base[math.ceil(0.8 * len(base)) - 1]
        assert all(out[i].threshold == threshold and out[i].kept == (bool(texts[i]) and out[i].perplexity <= threshold) for i in mine)
    same = {}
    for i, t in texts.items():
        same.setdefault(t, set()).add(out[i].perplexity)
    assert all(len(v) == 1 for v in same.values())  # whatever batch they were in


EMAIL, IP, CARD, PHONE = (re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"))


def plain_spans(t):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(t) if 12 <= len(d := re.sub("[ -]", "", m.group())) <= 19 and pii.luhn(d)]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out)


def test_base_patterns():
    import random

    rng = random.Random(2)
    parts = ["a", "b@", "@", ".", "..", "1", "25", "256", "0", "-", " ", "+", "(", ")", "4", "x.y", "é", "_", "%", "555-", "4111111111111111", "00012"]
    for _ in range(5000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == plain_spans(t)
    assert pii.base_spans("1" * 200_000) == [] and pii.base_spans("a" * 200_000) == []


def test_disclosing_terms(spark):
    rng = __import__("random").Random(5)
    rows = [(i, " ".join(Fx.words(rng, 20)), "en", "s", 1) for i in range(100)]
    for i in (3, 40, 77):
        rows[i] = (i, f"ask Zanzibar Jones at zj@mail.example.com about {' '.join(Fx.words(rng, 12))}", "en", "s", 1)
    rows[50] = (50, "Zanzibar was here", "en", "s", 1)
    docs = Fx.frame(spark, rows)
    out = {r.doc_id: r for r in pii.find(docs).collect()}
    assert out[3].spans.startswith("term:0:3,term:4:12,term:13:18,email:22:41") and out[3].n_email == 1
    assert out[50].spans == "term:0:8" and out[50].base_sha256 == hashlib.sha256(b"").hexdigest()
    clean = {r.doc_id: r.clean for r in pii.sanitise(docs.join(pii.find(docs).select("doc_id", "spans"), "doc_id")).collect()}
    assert clean[50] == " was here" and "[EMAIL]" in clean[3] and "Jones" not in clean[3]
    # c(t) and c(e) by hand: 'ask' is in three documents, as the address
    assert sum("term" in r.spans for r in out.values()) == 4


def test_disclosure_by_counting(spark):
    """Every term span against co-occurrences counted one by one."""
    rng = __import__("random").Random(12)
    names = ["Brandol", "Kessen", "McIvor", "Tulip", "quartz", "violet"]
    rows = []
    for i in range(150):
        w = Fx.words(rng, 25)
        if i % 4 == 0:
            k = rng.randrange(6)
            w[10:10] = [names[k], rng.choice(["at", "on the"]), f"u{k}@mail.example.com", names[(k + i) % 6]]
        elif i % 7 == 0:
            w[3] = rng.choice(names)
        rows.append((None if i == 8 else i % 140, " ".join(w), "en", "s", 1))
    rows.append((200, "Solitary wrote from 10.1.2.3 once", "en", "s", 1))
    rows.append((201, "then Solitary left", "en", "s", 1))
    word, docs = re.compile(r"(?:[A-Za-z0-9]|[^\x00-\x7f])+"), {}
    for i, t, *_ in rows:
        base = plain_spans(t)
        found = [(m.start(), m.end(), m.group().translate(UPPER)) for m in word.finditer(t) if len(m.group().encode()) >= 3]
        free = [x for x in found if not any(x[0] < e and x[1] > s for s, _, e in base)]
        docs[i, t] = base, found, free
    both, named, of_entity, of_term = Counter(), Counter(), Counter(), Counter()
    for i, t, *_ in rows:
        base, found, free = docs[i, t]
        of_term.update({x for *_, x in found})
        pairs, caps = set(), set()
        for s, k, e in base:
            at = sum(x[0] < s for x in free)
            for a, b, x in free[max(0, at - 8) : at + 8]:
                pairs.add((x, k, t[s:e]))
                if re.match("[A-Z][^A-Z]", t[a:b]):
                    caps.add((x, k, t[s:e]))
        both.update(pairs)
        named.update(caps)
        of_entity.update({(k, t[s:e]) for s, k, e in base})
    n = len(rows)
    secret = {x for (x, *e), c in both.items() if (c >= 2 or named[x, *e]) and 1 - math.log(of_term[x] / c) / math.log(n / of_entity[tuple(e)]) >= 0.8}
    assert "solitary" in secret and "kessen" in secret and len(secret) < 60
    got = sorted((repr(r.doc_id), r.spans) for r in pii.find(Fx.frame(spark, rows)).collect())
    expected = []
    for i, t, *_ in rows:
        base, found, free = docs[i, t]
        spans = sorted(base + [(a, 4, b) for a, b, x in free if x in secret])
        expected.append((repr(i), ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)))
    assert got == sorted(expected)


def test_toxicity_held_out(spark):
    import zlib

    rng = __import__("random").Random(6)
    rows, labels = [], []
    for i in range(900):
        bad = i % 4 == 0
        w = Fx.words(rng, 40)
        if bad:
            w[rng.randrange(40)] = rng.choice(["stupid", "idiot"])
        rows.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, 1, int(bad)))
    docs, marks = Fx.frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    machine = toxicity.train(docs, marks)
    out = toxicity.score(docs, machine).select("doc_id", "predicted", toxicity.held_out(F.col("doc_id")).alias("held")).collect()
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    held = [r for r in out if r.held]
    assert np.mean([r.predicted == int(r.doc_id % 4 == 0) for r in held]) > 0.95


def test_scores_sum_over_all_pairs():
    """The machine's score against w0, the weights and every pair of factors summed one by one."""
    rng = np.random.default_rng(4)
    m = toxicity.Machine(0.3, rng.normal(size=32), rng.normal(size=(3, 32)))
    docs = [sorted(rng.choice(32, rng.integers(0, 9), replace=False).tolist()) for _ in range(40)]
    slot, doc = np.array([x for d in docs for x in d], np.int64), np.repeat(np.arange(40), [len(d) for d in docs])
    got = m.score(slot, doc, 40)
    for d, p in zip(docs, got):
        z = 0.3 + sum(m.weight[i] for i in d) + sum(float(m.factor[:, i] @ m.factor[:, j]) for k, i in enumerate(d) for j in d[:k])
        assert p == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-12)


def test_factorisation_learns_a_pair():
    rng = np.random.default_rng(1)
    n, bits = 1200, 10
    has = rng.random((n, 6)) < 0.5
    label = (has[:, 0] & has[:, 1]).astype(float)
    doc, slot = np.nonzero(has)
    pair, lone = (toxicity.fit(slot, doc, label, bits, k, rounds=400, least=0) for k in (4, 0))
    loss = lambda m: -np.mean(np.log(np.where(label == 1, m.score(slot, doc, n), 1 - m.score(slot, doc, n)) + 1e-9))
    assert loss(pair) < 0.5 * loss(lone)


def test_nearest(spark):
    rng = np.random.default_rng(2)
    vec = rng.normal(size=(700, 16)).astype(np.float32)
    vec[100:200] = vec[100]  # a hundred copies
    rows = [(i, v.tolist()) for i, v in enumerate(vec)]
    rows += [(700, None), (701, [0.0] * 16), (702, [float("nan")] * 16), (703, [None] * 16), (704, [1.0] * 3), (705, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = {}
    for r in ann.search(table, F.col("id") % 10 == 0).collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    unit = vec.astype(float) / np.linalg.norm(vec.astype(float), axis=1, keepdims=True)
    hits = 0
    assert sorted(out) == list(range(0, 700, 10))
    for q, found in out.items():
        cos = unit @ unit[q]
        cos[q] = -9
        order = np.lexsort((np.arange(700), -cos.round(12)))[:5]
        hits += len({v for _, v, _ in found} & set(order.tolist()))
        assert [r for r, *_ in sorted(found)] == [1, 2, 3, 4, 5] and all(s == pytest.approx(cos[v], abs=1e-12) for _, v, s in found)
    assert hits >= 0.9 * 5 * len(out)
    few = ann.search(spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>"), F.col("id") == 0).collect()
    assert len(few) == 2


def test_nearest_over_shards(spark):
    """Several shards, more copies of a vector than places, and a handful of Spark jobs instead of some for each round."""
    rng = np.random.default_rng(3)
    vec = rng.normal(size=(3000, 24)).astype(np.float32)
    vec[100:400] = vec[50]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vec)], "vec_id long, embedding array<float>")
    spark.sparkContext.setJobGroup("nearest over shards", "")
    got = ann.search(table, F.col("id") % 50 == 0, least=500, shard=24 * 500).collect()
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("nearest over shards")) < 40
    spark.sparkContext.setJobGroup("", "")
    out = {}
    for r in sorted(got):
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    unit = vec.astype(float) / np.linalg.norm(vec.astype(float), axis=1, keepdims=True)
    hits = 0
    assert sorted(out) == list(range(0, 3000, 50))
    for q, found in out.items():
        cos = unit @ unit[q]
        cos[q] = -9
        order = np.lexsort((np.arange(3000), -cos.round(12)))[:5]
        if q == 50 or 100 <= q < 400:
            assert [v for _, v, _ in found] == order.tolist()
        hits += len({v for _, v, _ in found} & set(order.tolist()))
        assert [r for r, *_ in found] == [1, 2, 3, 4, 5] and all(s == pytest.approx(cos[v], abs=1e-12) for _, v, s in found)
    assert hits >= 0.9 * 5 * len(out)


def test_graph_of_few_nodes():
    for m in (1, 2, 3, 130):
        v = np.random.default_rng(m).normal(size=(m, 5)).astype(np.float32)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        graph = ann.Graph(v, 24)
        assert [sorted(x for x in row if x >= 0) for row in graph.near[:3].tolist()] == [sorted(np.argsort(-(v @ v[i]), kind="stable")[1 : 25].tolist()) for i in range(min(m, 3))]
        found, sims = graph.search(v, 40, 8, np.arange(m))
        assert (found[:, 0] == np.arange(m)).all() and np.allclose(sims[:, 0], 1)


def test_nearest_of_awkward_vectors(spark):
    """Components near the largest and smallest doubles, repeated ids, several lengths."""
    rows = [(0, [1e200, 1e200]), (1, [1e200, 2e200]), (2, [1.0, 1.0]), (3, [1e-200, 1e-200]), (4, [-1.0, 0.0]), (50, [3.0, 0.0, 0.0]), (51, [1.0, 1.0, 0.0]), (52, [float("inf"), 0.0, 0.0]), (2, [1.0, 1.0])]
    out = {}
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 50 == 0).collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, round(r.score, 12)))
    third = round(3 / math.sqrt(10), 12)
    assert {k: sorted(v) for k, v in out.items()} == {0: [(1, 2, 1.0), (2, 3, 1.0), (3, 1, third), (4, 4, round(-math.sqrt(0.5), 12))], 50: [(1, 51, round(math.sqrt(0.5), 12))]}
    twice = [(0, [1.0, 0.0]), (7, [1.0, 1.0]), (7, [0.0, 1.0]), (8, [1.0, 3.0])]
    first = [tuple(r) for r in ann.search(spark.createDataFrame(twice, "vec_id long, embedding array<double>"), F.col("id") == 0).collect()]
    again = [tuple(r) for r in ann.search(spark.createDataFrame(twice[::-1], "vec_id long, embedding array<double>"), F.col("id") == 0).collect()]
    assert first == again and [r[2] for r in first].count(7) == 1


def test_urls(spark):
    urls = [None, "no scheme", "http://Org/x", "http://a.ORG", "https://b.example.org/es/1?x#y", "x://example.org/en/12", "http://example.org/en/2", "http://sub.com/fr/", "http://com/de/?q", "a://b://c/d", "http://spam.net/1", "http://good.net/2", "http://notorg/"]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(100 + i, "http://spam.net/x") for i in range(40)] + [(200 + i, f"http://h{i}.info/") for i in range(40)], "page_id long, url string")
    labels = spark.createDataFrame([(100 + i, 0, 0) for i in range(40)] + [(200 + i, 1, 0) for i in range(40)] + [(100, None, None)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in url_filter.filter_urls(pages, labels).collect()}
    assert [(got[i].host, got[i].path) for i in (0, 1, 3, 4, 9)] == [("", ""), ("", ""), ("a.org", ""), ("b.example.org", "/es/1"), ("b:", "//c/d")]
    assert [(got[i].rule, got[i].verdict) for i in (2, 4, 5, 6, 7, 8)] == [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("org/", "allow"), ("com/fr/", "allow"), ("com/de/", "block")]
    assert got[3].rule is None and got[10].verdict == "block" and got[201].verdict == "allow" and got[12].rule is None


def test_host_reputation_by_hand(spark):
    """Verdicts against beta-binomial shrinkage in plain Python, from suffix to domain to host."""
    rng = __import__("random").Random(17)
    pages, labels = [], []
    for h in range(40):
        host = f"h{h}.d{h % 9}.{['net', 'info', 'xyz'][h % 3]}"
        rate = rng.random() ** 3
        for _ in range(rng.randrange(1, 30)):
            i = len(pages)
            pages.append((i, f"http://{host}/p{i}"))
            if rng.random() < 0.7:
                labels.append((i, int(rng.random() > rate), int(rng.random() < rate / 3)))
    pages += [(5000, "http://new.d1.net/"), (5001, "http://other.museum/"), (5002, None)]
    bad_of = {i: int(q == 0 or t == 1) for i, q, t in labels}
    names = {i: (".".join(u.split("/")[2].split(".")[-1:]), ".".join(u.split("/")[2].split(".")[-2:]), u.split("/")[2]) for i, u in pages if u}
    above = None
    for level in range(3):
        n, bad, parent = Counter(), Counter(), {}
        for i, b in bad_of.items():
            k = names[i][level]
            n[k] += 1
            bad[k] += b
            parent[k] = names[i][level - 1] if level else None
        total = sum(n.values())
        mu = sum(bad.values()) / total
        spread = sum(bad[k] ** 2 / n[k] for k in n) / total - mu * mu
        noise = mu * (1 - mu) * len(n) / total
        m = min(1000.0, max(1.0, (mu * (1 - mu) - spread) / (spread - noise))) if spread > noise else 1000.0
        up = {k: mu if above is None else above[parent[k]] for k in n}
        above = {k: (bad[k] + m * up[k]) / (n[k] + m) for k in n}
    low = {}
    for k in n:
        a, b = bad[k] + m * up[k], n[k] - bad[k] + m * (1 - up[k])
        low[k] = a / (a + b) - 1.64 * math.sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))
    got = url_filter.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    expected = {i: "block" if i in names and low.get(names[i][2], 0) > 0.25 else "allow" for i, _ in pages}
    assert {r.page_id: r.verdict for r in got} == expected and 5 < sum(v == "block" for v in expected.values()) < len(pages) - 5


@pytest.mark.parametrize("few", [10**6, 0])
def test_components(spark, few):
    """The task for few edges and the rounds for many, against union by hand."""
    rng = __import__("random").Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000, 1000 + k) for k in range(1, 60)] + [(2000 + k, 2001 + k) for k in range(40)] + [(7, 7)]
    groups = Sets({x for e in edges for x in e})
    for a, b in edges:
        groups.join(a, b)
    low = {}
    for x in {x for a, b in edges if a != b for x in (a, b)}:
        low.setdefault(groups.find(x), []).append(x)
    expected = {x: min(g) for g in low.values() for x in g}
    df = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    assert {r.node: r.component for r in _graph.connected(df, few).collect()} == expected
