"""Empty tables, nulls, repeated rows and clashing columns: defined results, no crash."""

import pytest
from pyspark.sql import functions as F

from fraudlens.llm import ann, bpe, decontaminate, line_dedup, minhash_dedup, pii, quality, substring_dedup, toxicity, url_filter

from . import fixtures as Fx


def labels(spark, empty=False):
    rows = [] if empty else [(i, i % 2, int(i % 5 == 0)) for i in range(30)] + [(None, 1, 1), (4, None, None), (4, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def bench(spark):
    return spark.createDataFrame([(1, "some words that no document has in this order"), (None, None)], "item_id long, text string")


def encoded(spark, docs):
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def digest(spark, docs):
    import public_tokenizers

    return bpe.digest(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


OPERATORS = {
    "minhash": lambda s, d: minhash_dedup.near_duplicates(d),
    "quality": lambda s, d: quality.judge(d, labels(s)),
    "quality without labels": lambda s, d: quality.judge(d, labels(s, True)),
    "lines": lambda s, d: line_dedup.remove_lines(d),
    "toxicity": lambda s, d: toxicity.score(d, toxicity.train(d, labels(s))),
    "toxicity without labels": lambda s, d: toxicity.score(d, toxicity.train(d, labels(s, True))),
    "pii": lambda s, d: pii.find(d),
    "bpe": encoded,
    "digest": digest,
    "decontaminate": lambda s, d: decontaminate.judge(d, bench(s)),
    "substring": lambda s, d: substring_dedup.remove_repeats(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_documents(spark, name):
    run = OPERATORS[name]
    assert run(spark, Fx.frame(spark, [])).count() == 0
    odd = Fx.odd(spark)
    assert run(spark, odd).count() == odd.count()
    rows = Fx.documents()[:12]
    clash, plain = (run(spark, f(spark, rows)) for f in (Fx.clashing, Fx.frame))
    shared = [c for c in plain.columns if c in clash.columns]
    assert sorted(map(repr, clash.select(shared).collect())) == sorted(map(repr, plain.select(shared).collect()))


def test_null_ids(spark):
    out = {r.doc_id: r for r in minhash_dedup.near_duplicates(Fx.odd(spark)).collect()}
    assert out[None].component_id is None and out[None].kept
    kept = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(Fx.odd(spark)).collect()}
    assert kept[None] == 0


def test_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.search(empty, F.col("id") % 2 == 0).count() == 0
    one = spark.createDataFrame([(2, [1.0, 2.0], "x"), (None, [1.0, 1.0], "y"), (4, [2.0, 4.0], "z"), (4, [2.0, 4.0], "z")], "vec_id long, embedding array<float>, node string")
    assert [(r.query_id, r.vec_id) for r in ann.search(one, F.col("id") == 2).collect()] == [(2, 4)]


def test_pages(spark):
    empty = spark.createDataFrame([], "page_id long, url string, host string")
    assert url_filter.filter_urls(empty, labels(spark)).count() == 0
    pages = spark.createDataFrame([(1, "http://a.net/"), (1, "http://a.net/"), (None, None)], "page_id long, url string")
    assert url_filter.filter_urls(pages, labels(spark, True)).count() == 3
    assert url_filter.filter_urls(pages, labels(spark)).count() == 3
