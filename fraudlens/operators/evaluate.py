"""Evaluation of predictions: confusion counts, detection score, latency score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion_class(status: Column, approved: Column, expected: Column) -> Column:
    """err unless the status is 200; a rejection is the positive class."""
    return (
        F.when(status != 200, "err")
        .when(approved == expected, F.when(approved, "tn").otherwise("tp"))
        .otherwise(F.when(approved, "fn").otherwise("fp"))
    )


def confusion_counts(predictions: DataFrame) -> DataFrame:
    """One row: tp, tn, fp, fn, err."""
    c = confusion_class(F.col("status"), F.col("approved"), F.col("expected_approved"))
    return predictions.select(c.alias("c")).agg(*(F.count_if(F.col("c") == k).alias(k) for k in ("tp", "tn", "fp", "fn", "err")))


def detection(counts: DataFrame) -> DataFrame:
    """One row: the counts, n, failures, failure_rate, weighted_errors, epsilon, accuracy, detection_score."""
    out = counts.withColumns({"n": F.expr("tp + tn + fp + fn + err"), "failures": F.expr("fp + fn + err"), "weighted_errors": F.expr("fp + 3 * fn + 5 * err")})
    rate = lambda x: F.when(F.col("n") > 0, F.col(x) / F.nullif(F.col("n"), F.lit(0))).otherwise(0.0)
    out = out.withColumns({"failure_rate": rate("failures"), "epsilon": rate("weighted_errors")})
    out = out.withColumn("accuracy", F.when(F.col("n") > 0, (F.col("tp") + F.col("tn")) / F.nullif(F.col("n"), F.lit(0))).otherwise(0.0))
    good = 1000 * F.log10(1 / F.greatest(F.col("epsilon"), F.lit(0.001))) - 300 * F.log10(1.0 + F.col("weighted_errors"))
    return out.withColumn("detection_score", F.when(F.col("failure_rate") > 0.15, -3000.0).otherwise(good))


def p99_score(p99: Column) -> Column:
    return F.when(p99 <= 0, 0.0).when(p99 > 2000, -3000.0).otherwise(1000 * F.log10(1000 / F.greatest(p99, F.lit(1.0))))


def latency(samples: DataFrame, column: str) -> DataFrame:
    """One row: the exact interpolated 99th percentile in ms and its score."""
    return samples.agg(F.percentile(column, 0.99).alias("p99")).withColumn("p99_score", p99_score(F.col("p99")))


def dataset_stats(labelled: DataFrame, label: str = "label") -> DataFrame:
    """One row: total, and counts and rates of fraud and legitimate rows."""
    out = labelled.agg(F.count("*").alias("total"), F.count_if(F.col(label) == 1).alias("fraud_count"), F.count_if(F.col(label) == 0).alias("legit_count"))
    total = F.nullif(F.col("total"), F.lit(0))
    return out.withColumns({"fraud_rate": F.coalesce(F.col("fraud_count") / total, F.lit(0.0)), "legit_rate": F.coalesce(F.col("legit_count") / total, F.lit(0.0))})


def throughput(n: Column, seconds: Column) -> Column:
    """Requests a second; null for no time."""
    return n / F.nullif(seconds.cast("double"), F.lit(0.0))


def report(counts: DataFrame, p99: DataFrame) -> DataFrame:
    """One row with the scores of confusion counts and of latency(): what the results file holds."""
    scored = detection(counts).crossJoin(F.broadcast(p99.select("p99", "p99_score")))  # one row each
    return scored.withColumn("final_score", F.col("p99_score") + F.col("detection_score")).withColumns(
        {"p99_cut": F.col("p99") > 2000, "detection_cut": F.col("failure_rate") > 0.15}
    )


def write_report(results: DataFrame, path: str, decimals: int = 2) -> None:
    """report() as one JSON object: rounded for reading, and raw."""
    r = lambda c, d=decimals: F.round(c, d)
    breakdown = F.struct(F.col("fp").alias("false_positive_detections"), F.col("fn").alias("false_negative_detections"), F.col("tp").alias("true_positive_detections"), F.col("tn").alias("true_negative_detections"), F.col("err").alias("http_errors"))
    scoring = F.struct(
        breakdown.alias("breakdown"), F.concat(r(F.col("failure_rate") * 100).cast("string"), F.lit("%")).alias("failure_rate"), F.col("weighted_errors").alias("weighted_errors_E"), r("epsilon", decimals + 4).alias("error_rate_epsilon"),
        F.struct(r("p99_score").alias("value"), F.col("p99_cut").alias("cut_triggered")).alias("p99_score"), F.struct(r("detection_score").alias("value"), F.col("detection_cut").alias("cut_triggered")).alias("detection_score"),
        r("final_score").alias("final_score"), F.struct("p99", "failure_rate", "epsilon", "p99_score", "detection_score", "final_score").alias("raw"),
    )
    out = results.select(F.concat(r("p99").cast("string"), F.lit("ms")).alias("p99"), scoring.alias("scoring"))
    out.coalesce(1).write.mode("overwrite").json(path)  # one row


def final_score(p99: Column, detection_score: Column) -> Column:
    return p99_score(p99) + detection_score


def humanize_bytes(n: Column) -> Column:
    """1500 -> '1.5 kB'."""
    text, units = F.concat(F.format_string("%.0f", n.cast("double")), F.lit(" B")), ("kB", "MB", "GB", "TB", "PB")
    for k, unit in enumerate(units, 1):
        text = F.when(n >= 1000**k, F.concat(F.format_string("%.1f", n / float(1000**k)), F.lit(f" {unit}"))).otherwise(text)
    return text


def humanize_ms(ms: Column) -> Column:
    """A duration in ms as us, ms, s or m and s."""
    return (
        F.when(ms < 1, F.format_string("%.2fus", ms * 1000))
        .when(ms < 1000, F.format_string("%.2fms", ms))
        .when(ms < 60_000, F.format_string("%.2fs", ms / 1000))
        .otherwise(F.concat(F.floor(ms / 60_000).cast("string"), F.lit("m"), F.floor((ms % 60_000) / 1000).cast("string"), F.lit("s")))
    )
