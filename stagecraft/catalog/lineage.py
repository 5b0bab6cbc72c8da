"""Column lineage: nodes, edges and end-to-end source columns."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, functions as F

from stagecraft.catalog.expressions import references
from stagecraft.catalog.graph import leading_to
from stagecraft.runtime import cut_lineage

NODE = ["job_id", "stage_id", "column_name"]
BARE_NAME = r"^\s*[A-Za-z_]\w*\s*$"
EDGE_TYPES = ["Aggregation", "Cast", "Derivation", "Filter", "Join", "Lookup", "PassThrough", "Rename"]  # by name
CAST_CALL = r"^\s*(Char|Str|Num)\("


def held_columns(columns: DataFrame, derivations: DataFrame, stages: DataFrame) -> DataFrame:
    """(job_id, stage_id, column_name, derived, category, staged): each column of a stage once, by one shuffle by stage.

    A column whose stage is not in ``stages`` has ``staged`` NULL; a stage that is there twice has its columns twice.
    """
    every = (
        columns.select("job_id", "stage_id", F.col("name").alias("column_name"), F.lit(0).alias("d"))
        .unionByName(derivations.select("job_id", "stage_id", F.col("output_column").alias("column_name"),
                                        F.lit(1).alias("d")))
        .repartition("job_id", "stage_id").groupBy(*NODE).agg(F.max("d").alias("derived"))
    )
    return every.join(stages.select("job_id", "stage_id", "category", F.lit(True).alias("staged")), ["job_id", "stage_id"], "left")


def nodes(columns: DataFrame, derivations: DataFrame, stages: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """One node per (stage, column), typed by the stage's category; ``held``: ``held_columns``, where a caller has them."""
    every = held_columns(columns, derivations, stages) if held is None else held
    kind = (
        F.when(F.col("category") == "source", "SourceColumn")
        .when(F.col("category") == "target", "TargetColumn")
        .when(F.col("derived") == 1, "DerivedColumn")
        .otherwise("Intermediate")
    )
    return every.where("staged").select(*NODE, kind.alias("node_type"))


def _own_type(expression: Column) -> Column:
    """The place in ``EDGE_TYPES`` of an edge into a stage that is of none of the categories below."""
    at = EDGE_TYPES.index
    return (
        F.when(expression.isNull(), at("PassThrough")).when(expression.rlike(BARE_NAME), at("Rename"))
        .when(expression.rlike(CAST_CALL), at("Cast")).otherwise(at("Derivation"))
    )


def _edge_type(category: Column, own: Column) -> Column:
    at = EDGE_TYPES.index
    return (
        F.when(category == "aggregation", at("Aggregation")).when(category == "lookup", at("Lookup"))
        .when(category == "join", at("Join")).when(category == "filter", at("Filter")).otherwise(own)
    )


def _confidence(expression: Column) -> Column:
    """1.00 less 0.05 per call and 0.10 per ``If``, at least 0.50."""
    calls = F.regexp_count(expression, F.lit(r"\w\("))
    ifs = F.regexp_count(F.lower(expression), F.lit("if "))
    loss = (calls * 5 + ifs * 10).cast("decimal(9,2)") / F.lit(100).cast("decimal(9,2)")
    one = F.lit("1.00").cast("decimal(9,2)")
    return F.greatest(one - loss, F.lit("0.50").cast("decimal(9,2)")).cast("decimal(4,2)")


def edges(columns: DataFrame, derivations: DataFrame, stages: DataFrame, links: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """Edges from upstream columns to the columns a stage puts out.

    A derived column reads the upstream columns its expression names; another column of the stage
    passes through from the upstream column of the same name.  What an expression says of its edges is two numbers before
    the joins, so no expression is shuffled.
    """
    hops = links.select("job_id", "from_stage", F.col("to_stage").alias("stage_id")).distinct()
    held = held_columns(columns, derivations, stages) if held is None else held
    e = F.col("expression")
    derived = derivations.where(e.isNotNull()).select(
        "job_id", "stage_id", F.col("output_column").alias("column_name"), _own_type(e).alias("own"), _confidence(e).alias("confidence"),
        F.explode(references("expression")).alias("from_column"),
    )
    passed = held.where("derived = 0").select(
        *NODE, F.lit(EDGE_TYPES.index("PassThrough")).alias("own"), F.lit("1.00").cast("decimal(4,2)").alias("confidence"),
        F.col("column_name").alias("from_column"))
    wanted = derived.unionByName(passed)
    upstream = held.select("job_id", F.col("stage_id").alias("from_stage"), F.col("column_name").alias("from_column"))
    # The stage's category goes along with its links, of which there are fewer than columns.
    into = hops.join(stages.select("job_id", "stage_id", "category"), ["job_id", "stage_id"])
    found = wanted.join(into, ["job_id", "stage_id"]).withColumn("kind", _edge_type(F.col("category"), F.col("own"))).drop("category", "own")
    return found.join(upstream, ["job_id", "from_stage", "from_column"]).groupBy(
        "job_id", "from_stage", "from_column", "stage_id", "column_name").agg(
        F.min("kind").alias("kind"), F.min("confidence").alias("confidence")
    ).select("job_id", "from_stage", "from_column", "stage_id", "column_name",
             F.element_at(F.array(*[F.lit(x) for x in EDGE_TYPES]), F.col("kind") + 1).alias("edge_type"), "confidence")


def end_to_end(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """Source columns of every target column: fewest hops, that path, lowest confidence on any path.

    State is one row per (source column, reached column), and only columns from which a target column can be reached are
    walked through, so every row lies on a way from a source to a target.  A round passes on only what it reached first
    or with a lower confidence than before; confidences cannot fall for ever, so a job with a cycle ends
    like the others.
    """
    step = cut_lineage(edge_rows.select(
        "job_id", F.col("from_stage").alias("at_stage"), F.col("from_column").alias("at_column"),
        F.col("stage_id").alias("to_stage"), F.col("column_name").alias("to_column"),
        F.col("confidence").alias("edge_confidence"),
    ))
    at = ["job_id", "at_stage", "at_column"]
    ends = cut_lineage(node_rows.where("node_type = 'TargetColumn'").select(
        "job_id", F.col("stage_id").alias("at_stage"), F.col("column_name").alias("at_column")
    ))
    useful = leading_to(ends, step, at, ["job_id", "to_stage", "to_column"])
    step = cut_lineage(step.join(useful.withColumnsRenamed({"at_stage": "to_stage", "at_column": "to_column"}), ["job_id", "to_stage", "to_column"], "left_semi"))
    state = cut_lineage(node_rows.where("node_type = 'SourceColumn'").select(
        "job_id", F.col("stage_id").alias("source_stage"), F.col("column_name").alias("source_column"),
        F.col("stage_id").alias("at_stage"), F.col("column_name").alias("at_column"),
        F.col("stage_id").alias("path"), F.lit("1.00").cast("decimal(4,2)").alias("confidence"),
    ).join(useful, at, "left_semi"))
    who = ["job_id", "source_stage", "source_column", "at_stage", "at_column"]
    reached: list[DataFrame] = []
    best = state.select(*who, "confidence")
    for hop in count(1):
        moved = state.join(step, ["job_id", "at_stage", "at_column"]).select(
            "job_id", "source_stage", "source_column",
            F.col("to_stage").alias("at_stage"), F.col("to_column").alias("at_column"),
            F.concat_ws("/", "path", "to_stage").alias("path"),
            F.least("confidence", "edge_confidence").alias("confidence"),
        )
        found = moved.groupBy(*who).agg(F.min("path").alias("path"), F.min("confidence").alias("confidence"))
        known = best.withColumnRenamed("confidence", "_best")
        state = cut_lineage(found.join(known, who, "left").where("_best IS NULL OR confidence < _best").drop("_best"))
        if state.isEmpty():
            break
        best = cut_lineage(best.unionByName(state.select(*who, "confidence")).groupBy(*who).agg(F.min("confidence").alias("confidence")))
        reached.append(state.join(ends, ["job_id", "at_stage", "at_column"], "left_semi").withColumn("hops", F.lit(hop)))
    if not reached:
        reached = [state.withColumn("hops", F.lit(0))]
    return reduce(DataFrame.unionByName, reached).groupBy(*who).agg(
        F.min("hops").alias("hops"), F.min_by("path", F.struct("hops", "path")).alias("path"),
        F.min("confidence").alias("confidence"),
    ).select(
        "job_id", "source_stage", "source_column", F.col("at_stage").alias("target_stage"),
        F.col("at_column").alias("target_column"), "hops", "path", "confidence",
    )
