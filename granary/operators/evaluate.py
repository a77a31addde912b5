"""Scoring of resolved metrics against a gold table, and coverage reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary import registry as R
from granary.functions.text import close_relative, printed


def gold_scores(gold: DataFrame, resolved: DataFrame) -> DataFrame:
    """One row: gold_valid, verified_correct, review_correct, review_incorrect, missing, false_acceptances,
    reviewable and verified coverage. ``gold`` has doc_id, metric_name, year, status, expected_value."""
    j = gold.filter("status = 'valid'").join(resolved.select("doc_id", "metric_name", "year", "value", "verification_state"), ["doc_id", "metric_name", "year"], "left")
    right = F.coalesce(close_relative(F.col("value"), F.col("expected_value"), 0.01), F.lit(False))
    ok, state, there = right, F.coalesce("verification_state", F.lit("")), F.col("value").isNotNull()
    n = lambda c: F.count_if(c)
    out = j.agg(
        F.count(F.lit(1)).alias("gold_valid"), n(there & ok & (state == "VERIFIED")).alias("verified_correct"), n(there & ok & (state != "VERIFIED")).alias("review_correct"),
        n(there & ~ok & (state != "VERIFIED")).alias("review_incorrect"), n(~there).alias("missing"), n(there & ~ok & (state == "VERIFIED")).alias("false_acceptances"),
    )
    return out.withColumn("reviewable_coverage", F.try_divide(F.col("verified_correct") + F.col("review_correct"), F.col("gold_valid"))).withColumn("verified_coverage", F.try_divide(F.col("verified_correct"), F.col("gold_valid")))


def coverage(candidates: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """Per document: metrics found of 17, percent to one decimal, missing metrics, candidates by confidence; with
    ``calls`` (doc_id, latency_s) also the seconds of all calls and of one on average, to two decimals, 0 without
    calls."""
    by = candidates.groupBy("doc_id").agg(
        F.countDistinct("metric_name").alias("found"), F.array_sort(F.collect_set("metric_name")).alias("has"), *[F.count_if(F.col("confidence") == c).alias(c) for c in ("high", "medium", "low")]
    )
    missing = F.array_except(F.array(*[F.lit(m) for m in R.METRIC_NAMES]), "has")
    out = by.select("doc_id", "found", F.round(F.col("found") * 100.0 / len(R.METRIC_NAMES), 1).alias("pct"), F.array_join(missing, ",").alias("missing"), "high", "medium", "low")
    if calls is None:
        return out
    total = F.coalesce("_s", F.lit(0.0))
    seconds = calls.groupBy("doc_id").agg(F.sum("latency_s").alias("_s"), F.count(F.lit(1)).alias("_n"))
    two = lambda c: printed(c, 2).cast("double")
    out = out.join(seconds, "doc_id", "left")
    return out.withColumn("total_latency_s", two(total)).withColumn("avg_latency_per_call_s", two(total / F.greatest(F.coalesce("_n", F.lit(0)), F.lit(1)))).drop("_s", "_n")
