"""Data checks and reconciliation of stage inputs and outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F


def rule_report(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, passed, failed, is_null): all rules in one scan.  NULL neither passes nor fails."""
    def counts(cond: Column) -> Column:
        return F.struct(
            F.count(F.when(cond, 1)).alias("passed"), F.count(F.when(~cond, 1)).alias("failed"),
            F.count(F.when(cond.isNull(), 1)).alias("is_null"),
        )

    one = df.agg(*[counts(c).alias(n) for n, c in rules.items()])
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("rule"), F.col(n).alias("c")) for n in rules
    ])).alias("r")).select("r.rule", "r.c.*")


def join_report(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Matched, unmatched and fan-out of a join, from key counts: no pair is ever built."""
    a = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("l"))
    b = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("r"))
    has_l, has_r = F.col("l").isNotNull(), F.col("r").isNotNull()

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value), F.lit(0)).cast("bigint")

    return a.join(b, keys, "full").agg(
        total(F.when(has_l & has_r, F.col("l"))).alias("matched_left"),
        total(F.when(has_l & ~has_r, F.col("l"))).alias("unmatched_left"),
        total(F.when(has_r & ~has_l, F.col("r"))).alias("unmatched_right"),
        total(F.when(has_l & has_r, F.col("l") * F.col("r"))).alias("joined_rows"),
        F.coalesce(F.max(F.when(has_l & has_r, F.col("r"))), F.lit(0)).alias("max_fan_out"),
    )


def reconcile_totals(source: DataFrame, target: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """(measure, source, target, difference): two one-row aggregates compared."""
    def totals(df: DataFrame) -> DataFrame:
        wanted = {"rows": F.count(F.lit(1)).cast("decimal(28,4)"),
                  **{n: c.cast("decimal(28,4)") for n, c in measures.items()}}
        names = list(wanted)
        one = df.agg(*[c.alias(n) for n, c in wanted.items()])
        return one.select(F.explode(F.array(*[
            F.struct(F.lit(n).alias("measure"), F.col(n).alias("v")) for n in names
        ])).alias("m")).select("m.measure", "m.v")

    a = totals(source).withColumnRenamed("v", "source")
    b = totals(target).withColumnRenamed("v", "target")
    return a.join(b, "measure").withColumn("difference", F.col("target") - F.col("source"))


def reconcile_rows(source: DataFrame, target: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, state, changed): missing, extra and changed rows; keys are unique on both sides."""
    a = source.select(*keys, *columns).withColumn("_in", F.lit(True)).alias("a")
    b = target.select(*keys, *columns).withColumn("_in", F.lit(True)).alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    changed = F.concat_ws(",", *[
        F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in columns
    ])
    state = F.when(F.col("b._in").isNull(), "missing").when(F.col("a._in").isNull(), "extra").otherwise("changed")
    return (
        a.join(b, on, "full")
        .select(*[F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in keys],
                state.alias("state"), F.when(state == "changed", changed).otherwise("").alias("changed"))
        .where("state <> 'changed' OR changed <> ''")
    )


def required_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, nulls, ok) for columns declared NOT NULL, in one scan."""
    one = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in columns
    ])).alias("r")).select("r.column", "r.nulls", F.when(F.col("r.nulls") == 0, 1).otherwise(0).alias("ok"))


def stage_row_counts(named: dict[str, DataFrame]) -> DataFrame:
    """(stage, rows) of several stage outputs in one job; 0 rows is a failed stage."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("stage"), "rows")
             for n, df in named.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("ok", F.when(F.col("rows") > 0, 1).otherwise(0))


class StageCounts:
    """Row counts of the stages of a job, observed while the job's own action runs: no output is read for its count.

    ``watch`` each stage's output and go on with what it returns; after the action, ``report``.
    """

    def __init__(self) -> None:
        self.seen: dict[str, Observation] = {}

    def watch(self, df: DataFrame, stage: str, **conditions: Column) -> DataFrame:
        """The same rows; counted, and for each name those that meet a condition."""
        if stage in self.seen:
            raise ValueError(f"stage {stage} is watched already")
        self.seen[stage] = Observation()
        counts = {"rows": F.count(F.lit(1)), **{n: F.count(F.when(c, 1)) for n, c in conditions.items()}}
        return df.observe(self.seen[stage], *[c.alias(n) for n, c in counts.items()])

    def report(self, spark: SparkSession) -> DataFrame:
        """(stage, metric, n, ok): 0 rows is a failed stage; n and ok are NULL where Spark found that it need not run the stage."""
        found = []
        for stage, seen in self.seen.items():
            counts = dict(seen.get)
            for metric, n in counts.items() if counts else [("rows", None)]:
                found.append((stage, metric, n, None if n is None else int(n > 0 or metric != "rows")))
        return spark.createDataFrame(found, "stage string, metric string, n long, ok int")
