"""Per-stage and per-job facts of a job catalog.

Tables: stages(job_id, stage_id, stage_type, category, description, input_pins, output_pins, props),
links(job_id, link_id, from_stage, to_stage, from_pin, to_pin), columns and derivations.  Results
that grow with a job are long tables (one row per item), so a job of any size is many rows and
never one list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stagecraft.catalog.vocab import support_level

# Stage types that count as joins in the checklist.
JOIN_STAGES = ("pxjoin", "pxlookup", "joiner")


def prop(*names: str) -> Column:
    """First non-empty property of these names."""
    return F.coalesce(*[F.nullif(F.try_element_at("props", F.lit(n)), F.lit("")) for n in names])


def var_name(stage_id: Column) -> Column:
    return F.concat(F.lit("df_"), F.regexp_replace(F.lower(stage_id), "[^a-z0-9_]", "_"))


def normalize_stages(stages: DataFrame) -> DataFrame:
    """Flat property columns with their fallbacks."""
    return stages.select(
        "job_id", "stage_id", "stage_type", "category",
        var_name(F.col("stage_id")).alias("var_name"),
        F.when(F.coalesce("description", F.lit("")) == "",
               F.initcap(F.replace(F.lower("stage_id"), F.lit("_"), F.lit(" "))))
        .otherwise(F.col("description")).alias("description"),
        prop("XMLProperties.SelectStatement", "SelectStatement").alias("sql_query"),
        prop("XMLProperties.TableName", "TableName").alias("table_name"),
        prop("XMLProperties.Schema", "Schema").alias("schema_name"),
        prop("Connection.DataSource", "DataSource").alias("connection_name"),
        prop("File", "FileName").alias("file_path"),
        F.coalesce(prop("XMLProperties.WriteMode", "WriteMode"), F.lit("APPEND")).alias("write_mode"),
        prop("Connection.ProjectId").alias("project"), prop("Connection.Dataset").alias("dataset"),
        prop("JoinType").alias("join_type"), prop("JoinKey").alias("join_key"),
        prop("FilterCondition").alias("filter_condition"),
        prop("GroupByKeys").alias("group_by_keys"), prop("Aggregations").alias("aggregations"),
        prop("SortKeys").alias("sort_keys"), prop("LookupKey").alias("lookup_key"),
        prop("LookupType").alias("lookup_type"), prop("NoMatchHandling").alias("no_match_handling"),
        F.col("input_pins").alias("input_pin_count"), F.col("output_pins").alias("output_pin_count"),
    )


def endpoints(links: DataFrame) -> DataFrame:
    """(job_id, stage_id, has_in, has_out): one row per stage that some link touches."""
    ends = F.array(
        F.struct(F.col("from_stage").alias("stage_id"), F.lit(0).alias("i"), F.lit(1).alias("o")),
        F.struct(F.col("to_stage").alias("stage_id"), F.lit(1).alias("i"), F.lit(0).alias("o")),
    )
    return (
        links.select("job_id", F.explode(ends).alias("e"))
        .groupBy("job_id", F.col("e.stage_id").alias("stage_id"))
        .agg(F.max("e.i").alias("has_in"), F.max("e.o").alias("has_out"))
    )


def classify_io(stages: DataFrame, links: DataFrame) -> DataFrame:
    """Adds ``io``: source, target or transformation."""
    joined = stages.join(endpoints(links), ["job_id", "stage_id"], "left")
    either = F.col("category") == "source_or_target"
    no_in = F.coalesce("has_in", F.lit(0)) == 0
    no_out = F.coalesce("has_out", F.lit(0)) == 0
    io = (
        F.when((F.col("category") == "source") | (either & no_in), "source")
        .when((F.col("category") == "target") | (either & no_out), "target")
        .otherwise("transformation")
    )
    return joined.withColumn("io", io).drop("has_in", "has_out")


def job_summary(classified: DataFrame, links: DataFrame) -> DataFrame:
    """Counts per job; stages and links meet in one aggregate instead of a join of two."""
    def part(kind: str) -> Column:
        return F.when(F.col("io") == kind, 1).otherwise(0)

    facts = classified.select(
        "job_id", F.lit(1).alias("stage"), F.lit(0).alias("link"), part("source").alias("source"),
        part("target").alias("target"), part("transformation").alias("transformation"), "stage_type",
    ).unionByName(links.select(
        "job_id", F.lit(0).alias("stage"), F.lit(1).alias("link"), F.lit(0).alias("source"),
        F.lit(0).alias("target"), F.lit(0).alias("transformation"), F.lit(None).cast("string").alias("stage_type"),
    ))
    return facts.groupBy("job_id").agg(
        F.sum("stage").alias("total_stages"), F.sum("link").alias("total_links"),
        F.sum("source").alias("source_count"), F.sum("target").alias("target_count"),
        F.sum("transformation").alias("transformation_count"),
        # A set of type names: bounded by the vocabulary, not by the job.
        F.array_join(F.sort_array(F.collect_set("stage_type")), ",").alias("stage_types"),
    )


def derivation_counts(derivations: DataFrame) -> DataFrame:
    """(job_id, stage_id, derivations, hashes): how many a stage has, and how many of them use a hash."""
    hashed = F.lower("expression")
    return derivations.groupBy("job_id", "stage_id").agg(
        F.count(F.lit(1)).alias("derivations"),
        F.count(F.when(hashed.contains("checksum") | hashed.contains("hash"), 1)).alias("hashes"),
    )


def complexity_hints(stages: DataFrame, derivations: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """(job_id, stage_id, hint, weight).  Stages give up to four hints each in one pass.

    ``counts`` are the ``derivation_counts`` where a caller has them already.
    """
    dec = "decimal(6,2)"

    def hint(cond: Column, name: str, weight: str) -> Column:
        return F.when(cond, F.struct(F.lit(name).alias("hint"), F.lit(weight).cast(dec).alias("weight")))

    # A name or value holds the mark as a whole: the lines keep them apart.
    text = F.lower(F.concat_ws("\n", F.map_keys("props"), F.map_values("props")))
    scd = text.contains("scd") | text.contains("slowly changing") | text.contains("eff_end_date")
    uses = derivation_counts(derivations) if counts is None else counts
    # What the properties say is one flag before the join; the properties themselves are not shuffled.
    joined = stages.select("job_id", "stage_id", "stage_type", scd.alias("scd")).join(uses, ["job_id", "stage_id"], "left")
    fixed = F.array_compact(F.array(
        hint(F.col("stage_type") == "PxLookup", "lookup_join", "0.2"),
        hint(F.col("stage_type").isin("PxChangeCapture", "PxMerge"), "cdc_or_merge", "0.3"),
        hint(F.col("derivations") > 5, "complex_transformer", "0.2"),
        hint(F.col("scd"), "scd_type2", "0.4"),
    ))
    per_use = F.array_repeat(
        F.struct(F.lit("hash_computation").alias("hint"), F.lit("0.1").cast(dec).alias("weight")),
        F.coalesce("hashes", F.lit(0)).cast("int"),
    )
    return joined.select(
        "job_id", "stage_id", F.explode(F.concat(fixed, per_use)).alias("h")
    ).select("job_id", "stage_id", "h.hint", "h.weight")


def orphans(stages: DataFrame, links: DataFrame) -> DataFrame:
    """Stages in no link, in jobs of more than one stage."""
    sizes = stages.groupBy("job_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    loose = stages.select("job_id", "stage_id").join(endpoints(links), ["job_id", "stage_id"], "left_anti")
    return loose.join(sizes.select("job_id"), "job_id", "left_semi")


def neighbours(links: DataFrame) -> DataFrame:
    """(job_id, stage_id, direction, neighbour): both directions of every link in one pass."""
    both = F.array(
        F.struct(F.col("to_stage").alias("stage_id"), F.lit("upstream").alias("direction"),
                 F.col("from_stage").alias("neighbour")),
        F.struct(F.col("from_stage").alias("stage_id"), F.lit("downstream").alias("direction"),
                 F.col("to_stage").alias("neighbour")),
    )
    return links.select("job_id", F.explode(both).alias("n")).select("job_id", "n.*")


def parameters(stages: DataFrame) -> DataFrame:
    """(job_id, name, stage_id): each ``${name}`` once per stage using it."""
    values = F.concat_ws("\n", F.map_values("props"))
    names = F.array_distinct(F.regexp_extract_all(values, F.lit(r"\$\{([^}]+)\}"), 1))
    return stages.select("job_id", F.explode(names).alias("name"), "stage_id")


def connections(normalized: DataFrame, order: str = "stage_id") -> DataFrame:
    """Connections per job with the first stage's type and the number of uses."""
    return (
        normalized.where(F.col("connection_name").isNotNull())
        .groupBy("job_id", "connection_name")
        .agg(F.min_by("stage_type", order).alias("stage_type"), F.count(F.lit(1)).alias("uses"))
    )


def connection_uses(normalized: DataFrame) -> DataFrame:
    return normalized.where(F.col("connection_name").isNotNull()).select(
        "job_id", "connection_name", "stage_id"
    )


def checklist(normalized: DataFrame, derivations: DataFrame) -> DataFrame:
    """(job_id, item, stage_id, detail): what an implementation of the job must contain."""
    none = F.lit(None).cast("string")

    def item(cond: Column, name: str, detail: Column) -> Column:
        return F.when(cond, F.struct(F.lit(name).alias("item"), detail.alias("detail")))

    items = F.array(
        item((F.lower("category") == "source") | (F.col("input_pin_count") == 0), "source", none),
        item((F.lower("category") == "target") | (F.col("output_pin_count") == 0), "sink", none),
        item(F.lower("stage_type").isin(*JOIN_STAGES), "join", F.coalesce("join_type", F.lit("unknown"))),
        item(F.col("output_pin_count") > 1, "branch", F.col("output_pin_count").cast("string")),
        item(F.lower("stage_id").contains("exception") | F.lower("stage_type").contains("peek"),
             "exception_sink", none),
        item(F.coalesce("sql_query", F.lit("")) != "", "source_sql", F.col("sql_query")),
    )
    staged = normalized.select("job_id", "stage_id", F.explode(items).alias("i")).where("i IS NOT NULL").select(
        "job_id", "i.item", "stage_id", "i.detail"
    )
    computed = derivations.where(F.coalesce("output_column", F.lit("")) != "").select(
        "job_id", F.lit("computed_column").alias("item"), "stage_id", F.col("output_column").alias("detail")
    )
    return staged.unionByName(computed)


def structural_diff(expected: DataFrame, declared: DataFrame) -> DataFrame:
    """Checklist against what an implementation declares: missing, extra or wrong.

    Items are identified by job, item and stage; computed columns by their name too.  Both sides meet in one aggregate;
    an item with a NULL in its key is equal to no other, so it stays with its side.
    """
    key = F.when(F.col("item") == "computed_column", F.col("detail")).otherwise(F.lit(""))
    ids = ["job_id", "item", "stage_id", "part"]
    alone = F.col("job_id").isNull() | F.col("item").isNull() | F.col("stage_id").isNull() | F.col("part").isNull()

    def side(df: DataFrame, impl: int) -> DataFrame:
        return df.select("job_id", "item", "stage_id", key.alias("part"), "detail").select(
            *ids, "detail", F.when(alone, impl).alias("side"), F.lit(1 - impl).alias("source"), F.lit(impl).alias("impl"))

    # One shuffle by item; equal details of both sides are one row before the texts are compared.
    rows = side(expected, 0).unionByName(side(declared, 1)).repartition(*ids, "side").groupBy(*ids, "side", "detail").agg(
        F.max("source").alias("source"), F.max("impl").alias("impl"))
    both = rows.groupBy(*ids, "side").agg(
        F.max("source").alias("source"), F.max("impl").alias("impl"), F.max(F.when(F.col("source") == 1, F.col("detail"))).alias("source_detail"),
        F.max(F.when(F.col("impl") == 1, F.col("detail"))).alias("impl_detail"))
    verdict = (
        F.when(F.col("impl") == 0, "missing")
        .when(F.col("source") == 0, "extra")
        .when(~F.col("source_detail").eqNullSafe(F.col("impl_detail")), "wrong")
        .otherwise("ok")
    )
    return both.select(*ids, verdict.alias("verdict"))


def column_metadata(columns: DataFrame, normalized: DataFrame, derivations: DataFrame) -> DataFrame:
    """Column catalog with key and derived marks."""
    keys = F.transform(
        F.split(F.concat_ws(",", "join_key", "lookup_key"), ","), lambda k: F.trim(k)
    )
    stage_keys = normalized.select("job_id", "stage_id", keys.alias("key_list"))
    derived = derivations.groupBy("job_id", "stage_id", F.col("output_column").alias("name")).agg(
        F.min_by("expression", "ord").alias("derivation_expression")
    )
    return (
        columns.join(stage_keys, ["job_id", "stage_id"], "left")
        .join(derived, ["job_id", "stage_id", "name"], "left")
        .select(
            "job_id", "stage_id", "ord", "name", "sql_type", "spark_type", "nullable",
            F.when(F.array_contains("key_list", F.col("name")), 1).otherwise(0).alias("is_key"),
            F.when(F.col("derivation_expression").isNotNull(), 1).otherwise(0).alias("is_derived"),
            "derivation_expression",
        )
    )


def migration_report(stages: DataFrame, scores: DataFrame) -> DataFrame:
    """Estate totals: stages by support, completeness %, average confidence."""
    level = support_level(F.col("stage_type"))
    counted = stages.agg(
        F.count(F.lit(1)).alias("total_stages"),
        F.count(F.when(level == "full", 1)).alias("fully"),
        F.count(F.when(level == "partial", 1)).alias("partially"),
        F.count(F.when(level.isin("complex", "unknown"), 1)).alias("unsupported"),
    ).withColumn(
        "completeness_pct",
        F.round((F.col("fully") * 1.0 + F.col("partially") * 0.5) / F.col("total_stages") * 100, 1).cast("double"),
    )
    overall = scores.agg(F.count(F.lit(1)).alias("jobs"), F.sum("score").cast("double").alias("_s"))
    # Two one-row aggregates side by side.
    return counted.join(F.broadcast(overall)).withColumn(
        "overall_confidence", F.round(F.col("_s") / F.col("jobs"), 6)
    ).drop("_s")
