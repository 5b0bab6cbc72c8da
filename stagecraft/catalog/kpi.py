"""Estate indicators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def report(jobs: DataFrame) -> DataFrame:
    """jobs(job_id, status, confidence, stages) -> one row."""
    def n(status: str) -> Column:
        return F.count(F.when(F.col("status") == status, 1))

    return jobs.agg(
        F.count(F.lit(1)).alias("total_jobs"), n("completed").alias("successful"),
        n("escalated").alias("escalated"), n("failed").alias("failed"),
        F.sum(F.col("confidence").cast("decimal(18,4)")).cast("double").alias("_c"),
        F.coalesce(F.sum(F.when(F.col("status") == "completed", F.col("stages"))), F.lit(0)).cast("bigint")
        .alias("total_stages_migrated"),
    ).select(
        "total_jobs", "successful", "escalated", "failed",
        F.when(F.col("total_jobs") > 0, F.col("successful") / F.col("total_jobs")).otherwise(0.0).alias("success_rate"),
        F.when(F.col("total_jobs") > 0, F.col("_c") / F.col("total_jobs")).otherwise(0.0).alias("avg_confidence"),
        "total_stages_migrated",
    )


def dashboard(jobs: DataFrame) -> DataFrame:
    """jobs(job_id, status, confidence, complexity).  Confidence up to 1 counts as a fraction."""
    c = F.coalesce(F.col("confidence"), F.lit(0)).cast("decimal(18,4)")
    scaled = F.when(c <= 1, c * 100).otherwise(c)
    done = F.col("status") == "completed"

    def n(kind: str) -> Column:
        return F.count(F.when(F.lower("complexity") == kind, 1)).alias(kind)

    def pct(part: str) -> Column:
        return F.when(F.col("total") > 0, F.floor(F.col(part) * 100 / F.col("total") + 0.5)).otherwise(0).cast("bigint")

    return jobs.agg(
        F.count(F.lit(1)).alias("total"), F.count(F.when(done, 1)).alias("completed"),
        F.sum(F.when(done, scaled)).cast("double").alias("_c"), n("simple"), n("medium"), n("complex"),
    ).select(
        "total", "completed", pct("completed").alias("success_pct"),
        F.when(F.col("completed") > 0, F.round(F.col("_c") / F.col("completed"), 1)).otherwise(0.0).alias("avg_confidence"),
        "simple", "medium", "complex", pct("simple").alias("simple_pct"), pct("medium").alias("medium_pct"),
        pct("complex").alias("complex_pct"),
    )


def job_table(jobs: DataFrame, scored: DataFrame, validated: DataFrame) -> DataFrame:
    """One row per job, for listing newest first (see ``newest_first``)."""
    return (
        jobs.join(scored.select("job_id", "score", "complexity", "action"), "job_id", "left")
        .join(validated.select("job_id", "overall_status", "overall_score"), "job_id", "left")
    )


def newest_first(rows: DataFrame, created: str) -> DataFrame:
    return rows.orderBy(F.col(created).desc(), F.col("job_id"))
