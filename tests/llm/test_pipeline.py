"""The pipeline's stages, one after another, on a small corpus."""

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from . import fixtures as Fx  # noqa: E402


def test_stages(spark, tmp_path):
    rng = __import__("random").Random(8)
    rows = [(i, " ".join(Fx.words(rng, 60)), "en", "s", 1) for i in range(400)]
    marks = []
    for i in range(0, 400, 3):
        bad = i % 2 == 0
        if bad:
            rows[i] = (i, rows[i][1] + " idiot moron", "en", "s", 1)
        marks.append((i, 1, int(bad)))
    item = " ".join(Fx.words(rng, 25))
    rows[1] = (1, rows[1][1] + " " + item, "en", "s", 1)
    rows += [(500, rows[2][1] + "\n" + rows[5][1], "en", "s", 1), (501, __import__("re").sub(r"((?:\S+ ){3}\S+) ", r"\1\n", rows[7][1]) + " more", "en", "s", 1), (502, None, None, None, None), (503, "", "en", "s", 0)]
    Fx.frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, columns = spark.read.parquet(str(tmp_path / "documents.parquet")), None
    seen = {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        seen[name] = docs = spark.read.parquet(str(tmp_path / name))
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], columns
    ids = {k: {r.doc_id for r in v.select("doc_id").collect()} for k, v in seen.items()}
    toxic = {i for i, _, bad in marks if bad}
    assert not ids["toxicity"] & toxic and len(ids["toxicity"]) == len(rows) - len(toxic)
    texts = {r.doc_id: r.text for r in seen["line_dedup"].collect()}
    assert texts[500] == "" and texts[502] is None and texts[7] == rows[7][1]
    assert 501 not in ids["minhash_dedup"] and 7 in ids["minhash_dedup"]
    assert 1 not in ids["decontaminate"] and ids["bpe"] == ids["decontaminate"]
    assert {r.doc_id for r in pipeline.run(spark, str(tmp_path)).select("doc_id").collect()} == ids["bpe"]


CLASH = ["n_lines", "n_removed", "score", "predicted", "row", "i", "h", "words", "kept", "gone", "of", "hash", "_doc", "_gone", "node", "first"]


@pytest.mark.parametrize("name, stage", pipeline.STAGES)
def test_awkward_tables(spark, tmp_path, name, stage):
    """Nulls, repeated rows and ids, clashing columns and empty tables: each stage keeps all rows that it has no reason to drop."""
    from pyspark.sql import functions as F

    long = " ".join(f"w{k}" for k in range(3000))
    rows = [(3, "some text that three rows share word for word"), (5, "some text that three rows share word for word"), (5, "another text of the same id that is nowhere else"), (5, "another text of the same id that is nowhere else"), (None, "a text without an id but with words"), (6, None), (7, ""), (8, " \n "), (9, long)]
    docs = spark.createDataFrame([(i, t, None if i == 3 else "en", None, len(t or "")) for i, t in rows], Fx.SCHEMA).select("*", *(F.lit("x").alias(c) for c in CLASH))
    marks = spark.createDataFrame([(None, None, None), (3, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    item = "which number comes after the number seven in order"
    for full in (True, False):
        at = str(tmp_path / str(full))
        (marks if full else marks.limit(0)).write.parquet(f"{at}/labels.parquet")
        spark.createDataFrame([(1, item), (2, None)] if full else [], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        some = docs if full else docs.limit(0)
        out = stage(spark, some, at)
        got = out.collect()
        if not full:
            assert not got
        elif name == "bpe":
            assert len(got) == len(rows)
        else:
            assert out.columns == docs.columns and all(r[c] == "x" for r in got for c in CLASH)
            left = sorted(repr((r.doc_id, r.text)) for r in got)
            if name == "minhash_dedup":
                assert left == sorted(map(repr, {*rows} - {rows[1]}))
            elif name == "line_dedup":
                expected = [(i, "" if (i, t) == rows[1] else t) for i, t in rows]
                assert left == sorted(map(repr, expected))
                assert all(r.n_chars == len(r.text) for r in got if r.text is not None)
            else:
                assert left == sorted(map(repr, rows))
