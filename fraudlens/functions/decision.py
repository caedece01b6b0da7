"""From votes to decisions and response texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import K


def score(fraud: Column) -> Column:
    """fraud votes / 5; the denominator is 5 also with fewer neighbours."""
    return fraud / F.lit(float(K))


def in_range(fraud: Column) -> Column:
    """Votes outside 0..5, and no vote, count as 0."""
    return F.when(fraud.between(0, K), fraud).otherwise(0)


def approved(fraud: Column) -> Column:
    return in_range(fraud) < 3


def body(fraud: Column) -> Column:
    """The response text."""
    return F.to_json(F.struct(approved(fraud).alias("approved"), score(in_range(fraud)).alias("fraud_score")))


def full_response(kind: Column, fraud: Column) -> Column:
    """The whole HTTP response to a request of a kind that route() gives; null while more bytes must come."""
    text = body(fraud)
    ok, none = "HTTP/1.1 200 OK\r\nContent-Length:", "0\r\n\r\n"
    return (
        F.when(kind == "fraud", F.concat(F.lit(ok), F.octet_length(text).cast("string"), F.lit("\r\n\r\n"), text))
        .when(kind == "ready", ok + none)
        .when(kind == "not_found", "HTTP/1.1 404 Not Found\r\nContent-Length:" + none)
    )
