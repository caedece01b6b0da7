"""The corpus pipeline: documents through five stages, each written as Parquet and read again.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept.  All but the last return exactly the columns of docs, whatever their
names; nulls may stand in any column, rows and doc_ids may repeat, tables may be
empty and texts of any length.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraudlens.lineage import scratch, shrink
from fraudlens.llm import bpe, decontaminate, line_dedup, minhash_dedup, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _wrapped(docs: DataFrame) -> DataFrame:
    """doc_id, text and the whole row in one column, so that no other name can clash."""
    return docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine rejects go (score of at least 0.7).

    Rows are judged one by one by their text; a null or empty text has the
    machine's bias as its score.  Without labels nothing goes.
    """
    machine = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(_wrapped(docs), machine).where("predicted = 0").select("row.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated and near-equal lines go, but for the first of each group; n_chars follows the text.

    Every row stays, with what is left of its text; a null text stays null.
    Rows equal in doc_id and text lose the same lines; rows without a doc_id
    lose none.
    """
    out = line_dedup.remove_lines(_wrapped(docs))
    length = F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    new = {"text": F.col("text"), "n_chars": length}
    return out.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (five words, similarity 0.8): that with the smallest doc_id.

    Rows are judged by their texts, also if a doc_id repeats; rows equal in
    doc_id and text count as one and one of them stays.  Rows without words,
    and those without a doc_id, all stay.
    """
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("i"), F.xxhash64(text).alias("h"), F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("words"), F.struct(*docs.columns).alias("row"))
    stays = minhash_dedup.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("i"), "h").distinct()
    one = rows.where("words AND i IS NOT NULL").join(stays, ["i", "h"], "left_semi").dropDuplicates(["i", "h"])
    return one.unionByName(rows.where("NOT words OR i IS NULL")).select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go; null and empty texts stay, and so do all without a benchmark.

    Rows are judged by their own text, also if a doc_id repeats or is null.
    """
    rows = docs.select(F.struct("doc_id", F.xxhash64(F.col("text").cast("string")).alias("h")).alias("doc_id"), "text", F.struct(*docs.columns).alias("row"))
    return decontaminate.drop_contaminated(rows, _table(spark, sf_dir, "benchmark")).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the token ids and of the bytes decoded from them; a null text counts as empty."""
    import public_tokenizers

    return bpe.digest(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def _lean(stage: Callable) -> Callable:
    """The stage, begun by executors that hold nothing more of the stage before."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        shrink(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", _lean(drop_toxic)),
    ("line_dedup", _lean(drop_lines)),
    ("minhash_dedup", _lean(drop_near_duplicates)),
    ("decontaminate", _lean(drop_contaminated)),
    ("bpe", _lean(encode)),
]

#: Training, SimHash and MinHash have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; what lies between two stages is written below spark.checkpoint.dir, until the application ends."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
