"""Runs against stored baselines, score history and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def snapshot(results: DataFrame, keys: list[str], order: str = "position") -> DataFrame:
    """The last result of each case: status, a stable hash of the response, latency and score."""
    last = F.max_by(F.struct("status", F.xxhash64("response").alias("response_hash"), "latency_ms", "score"), order)
    return results.groupBy(*keys).agg(last.alias("s")).select(*keys, "s.*")


def compare(current: DataFrame, baseline: DataFrame, key: str = "case_id") -> DataFrame:
    """Regressions of cases that both have: at most one row each for status, latency and score, in that order.

    Status: passed before and failed now.  Latency: over 1.5 times a positive baseline.  Score: more than 0.15 lower;
    a score of zero counts as absent.
    """
    b = baseline.select(F.col(key), *[F.col(c).alias(f"b_{c}") for c in ("status", "latency_ms", "score")])
    both = current.join(b, key)
    row = lambda kind, severity, was, now: F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), was.cast("string").alias("baseline"), now.cast("string").alias("current"))
    c = F.col
    found = F.array(
        F.when((c("b_status") == "passed") & (c("status") == "failed"), row("status", "high", c("b_status"), c("status"))),
        F.when((c("b_latency_ms") > 0) & (c("latency_ms") > 1.5 * c("b_latency_ms")), row("latency", "medium", c("b_latency_ms"), c("latency_ms"))),
        F.when((c("b_score") != 0) & (c("score") != 0) & (c("score") < c("b_score") - 0.15), row("score", "medium", c("b_score"), c("score"))),
    )
    return both.select(key, F.posexplode(F.array_compact(found)).alias("place", "r")).select(key, "place", "r.*")


def latest(history: DataFrame, keys: list[str] = ()) -> DataFrame:
    """The latest entry by timestamp; of equal ones the earliest stored."""
    last = F.max_by(F.struct(*history.columns), F.struct("timestamp", -F.col("position")))
    return history.groupBy(*keys).agg(last.alias("r")).where("r is not null").select("r.*")


def score_history(history: DataFrame, limit: int = 10, tag: str | None = None) -> DataFrame:
    rows = history.where(F.col("tag") == tag) if tag else history
    return rows.orderBy(F.desc("timestamp"), "position").limit(limit).select("timestamp", "score", "bsp_version", "passed", "tag")


def improvements(history: DataFrame, keys: list[str], threshold: float = 0.0) -> DataFrame:
    """Each score against the one before it: improvement, and whether to push (a first one only if it passed)."""
    w = Window.partitionBy(*keys).orderBy("timestamp", "position")
    before = F.lag("score").over(w)
    rows = history.withColumn("previous", before).withColumn("improvement", F.col("score") - F.col("previous"))
    return rows.withColumn("push", should_push(F.col("previous"), F.col("score"), F.col("passed"), threshold))


def should_push(previous: Column, score: Column, passed: Column, threshold: float) -> Column:
    return F.when(previous.isNull(), passed).otherwise(score - previous > threshold)


def update_if_improved(latest_score: Column, score: Column, threshold: float = 0.0) -> Column:
    """Without a baseline always; else strictly above the threshold."""
    return F.when(latest_score.isNull(), True).otherwise(score - latest_score > threshold)
