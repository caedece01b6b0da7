"""Stateless streaming: request files in, responses out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import Index
from ..operators.scoring import score_requests, vectorise
from ..operators.search import QueryOptions, coarse

_SCHEMA = "request_id long, body string"


def read_requests(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def coarse_stream(requests: DataFrame, index: Index) -> DataFrame:
    """The stages that need no ranking, as a plain append stream: parse, features, centroid distances."""
    return coarse(vectorise(requests), index.centroids)


def score_stream(requests: DataFrame, index: Index, checkpoint: str, sink: Callable[[DataFrame, int], None], options: QueryOptions = QueryOptions()) -> StreamingQuery:
    """Scores each micro-batch as a batch job, as ranking is not defined on streams; sink gets (responses, batch id)."""

    def one(batch: DataFrame, number: int) -> None:
        sink(score_requests(batch, index, options), number)

    return requests.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()


def parquet_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that is safe to repeat: each batch has a folder of its own."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
