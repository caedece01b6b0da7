"""The registered queries do the whole job: what their production parameters must find."""

import random

from fraudlens.llm import queries

from . import fixtures as Fx
from .test_brute_force import levenshtein


def test_lines_by_edit_similarity(spark, tmp_path):
    """Lines with a changed, left out or added word, or a few of them, against plain edit similarity."""
    rng = random.Random(21)
    rows, near = [], []
    for i in range(60):
        w = Fx.words(rng, rng.randint(12, 40))
        v = list(w)
        for _ in range(rng.randint(1, max(1, len(w) // 8))):
            k = rng.randrange(len(v))
            v[k : k + 1] = rng.choice(([], ["other"], [v[k], "more"]))
        a, b = " ".join(w), " ".join(v)
        rows += [(2 * i, a, "en", "s", 1), (2 * i + 1, b, "en", "s", 1)]
        if levenshtein(a, b) * 5 <= max(len(a), len(b)):
            near.append(2 * i + 1)
    Fx.frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    gone = {r.doc_id for r in queries.op3_line_dedup(spark, str(tmp_path)).collect() if r.n_removed}
    assert len(near) > 40 and gone <= set(near)
    assert len(gone) >= 0.95 * len(near)


def test_short_lines_that_repeat(spark, tmp_path):
    """Lines of one to four words stay once in the whole corpus; near-equal ones and lines without words stay."""
    rows = [(i, f"Read more\n--\nPage {i} of {i + 1}\nHome\nall rights are reserved", "en", "s", 1) for i in range(5)]
    Fx.frame(spark, [*rows, (9, "home!\nall rights were reserved\n\n", "en", "s", 1)]).write.parquet(str(tmp_path / "documents.parquet"))
    out = {r.doc_id: (r.n_lines, r.n_removed) for r in queries.op3_line_dedup(spark, str(tmp_path)).collect()}
    assert out == {0: (5, 0), **{i: (5, 3) for i in range(1, 5)}, 9: (4, 1)}


def test_terms_are_located_in_the_document_s_row(spark):
    """A term that every document holds many times makes no rows of its own; the way for too many terms finds the same."""
    from fraudlens.llm import pii

    rows = [(i, f"Quentin Marlow wrote from quentin@marlow.org, Marlow said.\n" + "Marlow again " * (i % 4), "en", "s", 1) for i in range(40)]
    rows += [(100 + i, " ".join(Fx.words(random.Random(i), 30)), "en", "s", 1) for i in range(160)]
    docs = Fx.frame(spark, [*rows, (1, None, "en", "s", 1), rows[3], rows[3]])
    found = pii.find(docs)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    got = sorted(map(repr, found.collect()))
    assert got == sorted(map(repr, pii.find(docs, held_terms=0).collect())) and sum("term:" in r for r in got) >= 40


def test_a_task_encodes_each_of_its_pieces_once():
    """A task of 16 MB has some 280,000 different pieces and 140,000 states: neither is forgotten while it runs."""
    import itertools

    import public_tokenizers

    from fraudlens.llm import bpe

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        enc = bpe.Encoder(bpe.load_ranks(f.read()), public_tokenizers.PATTERN)
    text = " ".join(map("".join, itertools.islice(itertools.product("abcdefghij", repeat=6), 200_000)))
    first = enc.decimal(text)
    enc.fst.encode_piece = None  # any piece that isn't known any more would call it
    assert enc.decimal(text) == first


def test_pieces_met_again_are_not_forgotten():
    from fraudlens.llm import bpe

    enc = bpe.Encoder({bytes([b]): b for b in range(256)}, r"\s?\S+", most_pieces=30)
    enc.decimal("often")
    for k in range(200):
        enc.decimal(f"often once{k}")
        assert "often" in enc.known or "often" in enc.older
    assert len(enc.known) <= 20 and len(enc.older) <= 20


def test_ascii_texts_split_alike():
    import random

    import public_tokenizers

    from fraudlens.llm import bpe

    wide, plain, rng = bpe.compile_pattern(public_tokenizers.PATTERN), bpe.ascii_pattern(public_tokenizers.PATTERN), random.Random(5)
    assert plain is not None
    for _ in range(3000):
        text = "".join(rng.choices([chr(i) for i in range(128)] + [" ", " ", "'", "s", "\n", "7"] * 8, k=40))
        assert plain.findall(text) == wide.findall(text)
    assert bpe.ascii_pattern(r"[a-c&&b]+") is None and bpe.ascii_pattern(r"\p{Lu}") is None and bpe.ascii_pattern(r"(?i)a") is None


def test_scoring_toxicity_takes_little_memory():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from fraudlens.llm import toxicity

    rng = np.random.default_rng(3)
    texts = [" ".join(f"word{x}" for x in rng.integers(0, 50_000, 300)) for _ in range(3_000)]  # 8 MB
    weight = rng.normal(size=1 << 18).astype(np.float32)
    machine, terms = toxicity.Machine(0.1, weight, np.stack([weight] * 2)), toxicity.Terms(18)
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    slot, doc = terms(batch.column(0))
    expected = machine.score(slot, doc, len(texts))
    del slot, doc
    tracemalloc.start()
    got = np.concatenate([p for _, p in toxicity.scores(iter([batch]), machine, terms)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(got, expected) and peak < 40e6


def test_stages_begin_with_shrunk_executors(spark, tmp_path):
    """What a stage leaves in an executor's heap doesn't stay beside the next one's Python workers."""
    import corpus_pipeline

    docs = Fx.frame(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "some item of it")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    full = lambda: sum(x.getCollectionCount() for x in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in x.getName())
    for name, stage in corpus_pipeline.STAGES:
        before = full()  # executor and driver are one here
        stage(spark, docs, str(tmp_path))
        assert full() > before, name


def test_changed_words_need_no_distance_of_letters(monkeypatch):
    """Lines with some changed, left out and added words beside much longer ones are settled by an alignment of their words, which is never too kind."""
    from fraudlens.llm import line_dedup

    rng = random.Random(12)
    long = ["internationalisation", "counterrevolutionary"] * 4
    for _ in range(300):
        a = rng.sample(Fx.words(rng, 40) + long, 48)
        b = list(a)
        for _ in range(rng.randint(1, 14)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randint(0, 2)] = rng.choice(([], ["so"], ["other", "ka"], Fx.words(rng, 3)))
        d = levenshtein(" ".join(a), " ".join(b))
        for most in (d - 1, d, d + 3):
            assert not line_dedup.by_words(a, b, most) or d <= most
    words = [f"word{k}" for k in range(30)] + long
    other = [w if k % 4 or k > 30 else "ward" + w[4:] for k, w in enumerate(words)]

    def never(*_):
        raise AssertionError("all letters were compared")

    monkeypatch.setattr(line_dedup, "distance_within", never)
    assert line_dedup.alike(" ".join(words), " ".join(other[:20] + other[21:]), 0.8, {})


def test_lines_are_hashed_and_sketched_in_one_pass(spark):
    """The texts are computed three times: for the lines, for the candidates' forms, and for what is returned."""
    from fraudlens.llm import line_dedup

    passes = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            passes.add(batch.num_rows)
            yield batch

    rows = [(i, f"Home\nthe same line of seven words here\n{' '.join(Fx.words(random.Random(i // 2), 20))} {i}", "en", "s", 1) for i in range(40)]
    docs = Fx.frame(spark, rows).select("doc_id", "text").mapInArrow(counted, "doc_id long, text string")
    out = {r.doc_id: r.n_removed for r in line_dedup.remove_lines(docs).collect()}
    assert out == {i: (i > 0) * 2 + i % 2 for i in range(40)}
    assert passes.value == 3 * len(rows)


def test_places_of_a_line_are_dealt_out_evenly():
    """Places of one very common line go to many buckets, and come back whole beside the candidates."""
    import numpy as np
    import pyarrow as pa

    from fraudlens.llm import line_dedup

    n, text = 300, "Home\n" * 200 + "ünd sö wéiter in fünf wörtern\nHome"
    docs = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(np.arange(n) * -7), pa.array([f"{text}\nein Wort mehr als sonst {k}" for k in range(n)])], ["doc_id", "h", "text"])
    dealt = pa.Table.from_batches(line_dedup._deal(16, 5)(iter([docs.slice(0, n // 2), docs.slice(n // 2)]))).sort_by("bucket")
    held = dealt.filter(pa.compute.is_null(dealt["number"]))["bucket"].value_counts().to_pylist()
    assert len(held) > 5 and max(x["counts"] for x in held) <= 6
    out = pa.Table.from_batches(line_dedup._pair_up(line_dedup.BITS, 0.8)(iter(dealt.to_batches()))).to_pylist()
    places = [(r["doc_id"], r["h"], r["line"]) for r in out if r["component"] is None]
    assert sorted(places) == sorted((k, -7 * k, line) for k in range(n) for line in range(203))
    assert len({r["node"] for r in out if r["component"] is None}) == n + 2
    key, *_, at, m, words, _ = line_dedup._lines(docs.column(2), 5)
    sim, who, hole = line_dedup.sketch(words, at, m)
    blocks = {}
    for i, x in zip(who.tolist(), hole.tolist()):
        blocks.setdefault(x, {})[int(key[i].view(np.int64))] = [int(x) for x in sim[i]]
    differ = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(a, b))
    near = {(x, a) for x, held in blocks.items() for a in held for b in held if a != b and differ(held[a], held[b]) <= line_dedup.BITS}
    assert len(near) > n and {(r["component"], r["node"]) for r in out if r["component"] is not None} == near


def test_simhashes_lengths_and_steps(monkeypatch):
    """SimHashes are plain majorities, lengths count code points; the distance takes a step for each letter of the shorter line."""
    import numpy as np
    import pyarrow as pa

    from fraudlens.llm import line_dedup
    from fraudlens.llm._words import mix64

    rng = np.random.default_rng(5)
    sets = [rng.integers(0, 1 << 40, n).astype(np.uint64) for n in (1, 2, 3, 7, 64, 254, 255, 256, 257, 511, 3000)]
    out = line_dedup._majority(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))
    for features, found in zip(sets, out.tolist()):
        for half in range(2):
            bits = [int(x) for x in mix64(features + np.uint64(1 + 977 * half))]
            assert found[half] == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in bits) > len(bits))
    texts = ["  Größe, über 9 €\n\n--\nzwei", None, "", "a-b\n日本 語 x\n", "\n", "ein Wort"]
    key, doc, line, at, n, _, size = line_dedup._lines(pa.array(texts), 1)
    assert [*zip(doc.tolist(), line.tolist(), n.tolist(), size(at, n).tolist())] == [(0, 0, 4, len("größe über 9 €")), (0, 3, 1, 4), (3, 0, 2, 3), (3, 1, 3, 6), (5, 0, 2, 8)]
    steps = []
    myers = line_dedup._myers
    monkeypatch.setattr(line_dedup, "_myers", lambda a, b, most: steps.append(len(b)) or myers(a, b, most))
    for a, b in (("abcdefgh" * 9, "hbxdefg" * 9), ("hbxdefg" * 9, "abcdefgh" * 9)):
        assert line_dedup.distance_within(a, b, 40) == (levenshtein(a, b) <= 40)
    assert steps == [63, 63]
    assert not line_dedup.distance_within("abcdefgh" * 9, "hgfedcba" * 9, 20)  # of one length
