"""Sources: reference vectors, labelled test data, raw requests, warm-up queries."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StructField, StructType

from .. import schema as S
from ..functions.payload import content_length, header_end, headers, route
from ..functions.quantize import quantize


def label_of(text: Column) -> Column:
    return F.when(text == "fraud", 1).otherwise(0)


def pad(vector: Column, size: int) -> Column:
    """The first 14 values (fewer are kept), then zeros up to `size`."""
    cut = F.slice(vector, 1, S.DIMS)
    return F.concat(cut, F.array_repeat(F.lit(0.0), F.lit(size) - F.size(cut)))


def entries(rows: DataFrame) -> DataFrame:
    """(id, x, q, label) from rows (id, vector, label text)."""
    x = pad(F.col("vector"), S.DIMS)
    return rows.select("id", x.alias("x"), quantize(x).alias("q"), label_of(F.col("label")).alias("label"))


def read_references(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Reference entries of a JSON array, also gzipped; one array is one task to read, so rows are dealt out after it."""
    rows = spark.read.schema(S.REFERENCE_ENTRY).option("multiLine", True).json(path)
    rows = rows.repartition(partitions or int(spark.conf.get("spark.sql.shuffle.partitions")))
    return entries(rows.withColumn("id", F.monotonically_increasing_id()))


def read_test_data(spark: SparkSession, path: str) -> DataFrame:
    """(entry, body, expected_approved) of a labelled test file, or of a folder of them; entry counts within a file."""
    entry = StructType([StructField("request", S.PAYLOAD), StructField("expected_approved", BooleanType())])
    rows = spark.read.schema(StructType([StructField("entries", ArrayType(entry))])).option("multiLine", True).json(path)
    one = rows.select(F.posexplode("entries").alias("entry", "e"))
    return one.select("entry", F.to_json("e.request", {"ignoreNullFields": "false"}).alias("body"), F.col("e.expected_approved").alias("expected_approved"))


def routed(requests: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds kind, content_length, body and consumed (bytes) to raw HTTP requests.

    A body has exactly as many bytes as its headers say; what follows belongs to
    the next request.  An incomplete request consumes nothing.
    """
    text = F.coalesce(F.col(raw), F.lit(""))
    kind, length, start = route(text), content_length(headers(text)), header_end(text)
    body = F.decode(F.substring(F.encode(text, "UTF-8"), start + 1, length.cast("int")), "UTF-8")
    is_fraud = kind == "fraud"
    return requests.withColumns(
        {
            "kind": kind,
            "content_length": length,
            "body": F.when(is_fraud, body).otherwise(""),
            "consumed": F.when(kind == "need", 0).when(is_fraud, start + length).otherwise(start).cast("bigint"),
        }
    )


def warm_up(spark: SparkSession, n: int = 2048) -> DataFrame:
    """(i, x): n synthetic query vectors; every fourth has no history."""
    value = lambda d: ((F.col("i") * 131 + d * 17) % 1000) / 1000.0
    cells = [F.when((F.col("i") % 4 == 0), -1.0).otherwise(value(d)) if d in (5, 6) else value(d) for d in range(S.DIMS)]
    return spark.range(n).withColumnRenamed("id", "i").select("i", F.array(*cells).alias("x"))


def write_references(rows: DataFrame, path: str) -> None:
    """rows(vector, label) as one gzipped JSON array, the form read_references() takes; for files of test size, as one array is one task."""
    rows.agg(F.to_json(F.collect_list(F.struct("vector", "label"))).alias("value")).coalesce(1).write.option("compression", "gzip").text(path)


def write_test_data(rows: DataFrame, path: str, entries: int = 5_000, compression: str = "none") -> None:
    """rows(body, expected_approved) as labelled test files, the form read_test_data() takes.

    Each file holds at most `entries` requests of one task: a file is one row to
    read, and no more than its own requests are held at once.
    """
    entry = F.to_json(F.struct(F.from_json("body", S.PAYLOAD).alias("request"), "expected_approved"), {"ignoreNullFields": "false"})

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []

        def file() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(['{"entries":[' + ",".join(held) + "]}"])], ["value"])
            held.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.append(text)
                if len(held) == entries:
                    yield file()
        if held:
            yield file()

    rows.select(entry.alias("value")).mapInArrow(files, "value string").write.option("maxRecordsPerFile", 1).text(path, compression=compression)
