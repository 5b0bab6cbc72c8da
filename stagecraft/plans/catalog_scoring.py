"""From a job catalog to hints, scores, routes, validation and indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stagecraft.catalog import describe, expressions, kpi, scoring, validation
from stagecraft.runtime import store


def score(stages: DataFrame, links: DataFrame, derivations: DataFrame) -> dict[str, DataFrame]:
    """The roles of stages and the counts of derivations each feed several parts, so both are stored once, without properties."""
    classified = store(describe.classify_io(stages.drop("props", "description"), links), "classified")
    counts = store(describe.derivation_counts(derivations), "derivation-counts")
    hints = describe.complexity_hints(stages, derivations, counts)
    factor_rows = scoring.factors(classified, hints, derivations, counts)
    jobs = stages.select("job_id").distinct()
    return {
        "classified": classified, "hints": hints, "factors": factor_rows,
        "scores": scoring.scores(jobs, factor_rows),
    }


def validate(stages, links, columns, derivations, artifacts) -> DataFrame:
    translated = expressions.with_translation(derivations)
    return validation.all_checks(stages, links, columns, translated, artifacts, "translated")


def job_status(scored: DataFrame, validated: DataFrame, stage_counts: DataFrame) -> DataFrame:
    """(job_id, status, confidence, complexity, stages, ...): failed, escalated or completed."""
    status = (
        F.when(F.col("complexity") != "simple", "escalated")
        .when(F.col("overall_status") == "fail", "failed").otherwise("completed")
    )
    return (
        scored.join(validated, "job_id").join(stage_counts, "job_id")
        .select("job_id", status.alias("status"), F.col("score").alias("confidence"), "complexity",
                "action", F.col("total_stages").alias("stages"), "overall_status", "overall_score")
    )


def indicators(statuses: DataFrame) -> DataFrame:
    return kpi.report(statuses)
