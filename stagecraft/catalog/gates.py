"""Quality gates over a source catalog and what an implementation declares."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# Artifacts of a finished job, least size, passing score.
ARTIFACTS = ("pyspark", "datafusion", "migration_report", "validation_report", "metadata", "lineage",
             "ddl", "test_harness")
MIN_ARTIFACT_BYTES = 100
PASS_SCORE = 90

# Text rules for credentials and hosts; each hit is reported with its rule.
CREDENTIAL_RULES = {
    "jdbc_url": r"jdbc:[a-z0-9]+:\S+",
    "url_user": r"[a-z][a-z0-9+.-]*://[^\s/:@]+:[^\s/@]+@\S+",
    "password": r"(?i)(password|passwd|pwd)\s*[=:]\s*\S+",
    "access_key": r"AKIA[0-9A-Z]{16}",
    "host_port": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(:\d+)?\b",
}

# What a hit of each rule must contain (letters of any case for passwords).
FIXED_PARTS = {
    "jdbc_url": ["jdbc:"], "url_user": ["://"], "password": ["password", "passwd", "pwd"], "access_key": ["AKIA"], "host_port": ["."],
}


def match_once(expected: DataFrame, declared: DataFrame, keys: list[str]) -> DataFrame:
    """Each expected key must be declared exactly once, and nothing else.

    Both sides meet in one aggregate.  A key with a NULL is equal to no other: it is missing on one side and extra on the other.
    """
    side, n_a, n_b = F.col("_side"), F.col("_expected"), F.col("_declared")
    alone = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])

    def rows(df: DataFrame, a: int, b: int) -> DataFrame:
        return df.select(*keys, F.when(alone, b).alias("_side"), F.lit(a).alias("_expected"), F.lit(b).alias("_declared"))

    counted = rows(expected, 1, 0).unionByName(rows(declared, 0, 1)).groupBy(*keys, side).agg(
        F.sum(n_a).alias("_expected"), F.sum(n_b).alias("_declared"))
    verdict = (
        F.when(n_a == 0, "extra").when(n_b == 0, "missing").when(n_b > 1, "repeated").otherwise("ok")
    )
    return counted.select(*keys, n_a.alias("expected"), n_b.alias("declared"), verdict.alias("verdict"))


def derivations_recorded(derivations: DataFrame, metadata: DataFrame) -> DataFrame:
    """Derivations whose expression the column metadata does not hold."""
    held = metadata.where("derivation_expression IS NOT NULL").select(
        "job_id", "stage_id", F.col("name").alias("output_column")
    ).distinct()
    return derivations.where("expression IS NOT NULL").join(
        held, ["job_id", "stage_id", "output_column"], "left_anti"
    )


def reject_paths(stages: DataFrame, quarantines: DataFrame) -> DataFrame:
    """Branching stages without a quarantine sink."""
    return stages.where("output_pins > 1").select("job_id", "stage_id").join(
        quarantines.select("job_id", "stage_id").distinct(), ["job_id", "stage_id"], "left_anti"
    )


def credentials_scan(texts: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, rule, match): every hit in the whole text."""
    def hits_of(rule: str, pattern: str) -> Column:
        # Few texts hold a rule's fixed part, and a plain search for it is cheaper than the pattern.
        text = F.lower(text_column) if rule == "password" else F.col(text_column)
        may = reduce(lambda a, b: a | b, [text.contains(p) for p in FIXED_PARTS[rule]])
        none = F.array().cast("array<string>")
        found = F.when(may, F.regexp_extract_all(text_column, F.lit(pattern), F.lit(0))).otherwise(none)
        return F.transform(found, lambda m: F.struct(F.lit(rule).alias("rule"), m.alias("match")))

    hits = F.concat(*[hits_of(rule, pattern) for rule, pattern in CREDENTIAL_RULES.items()])
    return texts.select(id_column, F.explode(hits).alias("h")).select(id_column, "h.rule", "h.match")


def empty_fields(df: DataFrame, keys: list[str], required: list[str]) -> DataFrame:
    """(keys, field, empty): how often a required field is NULL or empty."""
    def is_empty(c: str) -> Column:
        return F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")

    counts = df.groupBy(*keys).agg(*[F.count(F.when(is_empty(c), 1)).alias(c) for c in required])
    return counts.unpivot(keys, required, "field", "empty")


def completeness_present(jobs: DataFrame, reports: DataFrame) -> DataFrame:
    """Jobs whose report has no completeness figure."""
    return jobs.select("job_id").join(
        reports.where("completeness_pct IS NOT NULL").select("job_id").distinct(), "job_id", "left_anti"
    )


def artifacts_present(jobs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(job_id, artifact_type, state) for the eight required artifacts of every job."""
    required = jobs.select("job_id", F.explode(F.array(*[F.lit(a) for a in ARTIFACTS])).alias("artifact_type"))
    have = artifacts.groupBy("job_id", "artifact_type").agg(F.max("size_bytes").alias("size_bytes"))
    state = F.when(F.col("size_bytes") > MIN_ARTIFACT_BYTES, "present").otherwise("missing_or_empty")
    return required.join(have, ["job_id", "artifact_type"], "left").select(
        "job_id", "artifact_type", state.alias("state")
    )


def gate_summary(results: DataFrame, scores: DataFrame) -> DataFrame:
    """results(job_id, gate, result), scores(job_id, score, critical_issues)."""
    counted = results.groupBy("job_id").agg(
        F.count(F.when(F.col("result") == "PASS", 1)).alias("gates_passed"),
        F.count(F.when(F.col("result") == "FAIL", 1)).alias("gates_failed"),
    )
    passed = (F.col("score") >= PASS_SCORE) & ~F.coalesce("critical_issues", F.lit(False))
    return counted.join(scores, "job_id").select(
        "job_id", "gates_passed", "gates_failed", "score",
        F.when(passed, 1).otherwise(0).alias("passed"),
    )
