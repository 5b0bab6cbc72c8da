"""Scoring, routing, validation, gate and indicator queries over the job catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stagecraft.catalog import describe, expressions as ex, gates, kpi, scoring, validation, vocab
from stagecraft.plans import catalog_scoring
from stagecraft.queries.binding import CATALOG_SQL, Catalog
from stagecraft.queries.catalog import HINTS_SQL, METADATA_SQL, ORPHANS_SQL
from stagecraft.queries.registry import Tables, query

c = F.col


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


LEVEL = (f"CASE WHEN stage_type IN {_in(vocab.FULL_SUPPORT)} THEN 'full' WHEN stage_type IN {_in(vocab.PARTIAL_SUPPORT)} THEN 'partial' "
         f"WHEN stage_type IN {_in(vocab.COMPLEX_SUPPORT)} THEN 'complex' ELSE 'unknown' END")

FACTORS_SQL = HINTS_SQL + f""",
    supported AS (SELECT *, {LEVEL} AS support FROM classified),
    sizes AS (SELECT job_id, count(*) AS n, count(*) FILTER (output_pins > 1) AS branching,
              count(*) FILTER (io = 'source') AS sources, count(*) FILTER (io = 'target') AS targets FROM classified GROUP BY ALL),
    factors AS (
      SELECT job_id, stage_id, 'partial_support_stage' AS factor, -0.08::DECIMAL(8,2) AS impact,
             stage_id || ' (' || stage_type || '): converts in part' AS reason FROM supported WHERE support = 'partial'
      UNION ALL SELECT job_id, stage_id, 'complex_stage', -0.20, stage_id || ' (' || stage_type || '): to be written by hand'
        FROM supported WHERE support = 'complex'
      UNION ALL SELECT job_id, stage_id, 'unknown_stage', -0.15, stage_id || ' (' || stage_type || '): type outside the vocabulary'
        FROM supported WHERE support = 'unknown'
      UNION ALL SELECT job_id, stage_id, 'hint_' || hint, -weight, stage_id || ': pattern ' || hint FROM hints
      UNION ALL SELECT job_id, stage_id, 'complex_transformer', -0.10, stage_id || ': ' || n || ' derivations in one stage' FROM per_stage WHERE n > 8
      UNION ALL SELECT job_id, NULL, 'high_stage_count', -least(0.15, (n - 15) * 0.01), n || ' stages, over the large-job mark' FROM sizes WHERE n > 15
      UNION ALL SELECT job_id, NULL, 'small_stage_count', 0.05, n || ' stages, within the small-job mark' FROM sizes WHERE n <= 5
      UNION ALL SELECT job_id, NULL, 'multi_output_stages', -branching * 0.05, branching || ' stages feed more than one link' FROM sizes WHERE branching > 0
      UNION ALL SELECT job_id, NULL, 'multi_source', -0.05, sources || ' inputs' FROM sizes WHERE sources >= 3
      UNION ALL SELECT job_id, NULL, 'multi_target', -0.05, targets || ' outputs' FROM sizes WHERE targets >= 2)"""

SCORES_SQL = FACTORS_SQL + """,
    scores AS (SELECT job_id, score, CASE WHEN score >= 0.75 THEN 'simple' WHEN score >= 0.45 THEN 'medium' ELSE 'complex' END AS complexity,
        CASE WHEN score >= 0.75 THEN 'auto_deploy' WHEN score >= 0.45 THEN 'flag_and_review' ELSE 'full_human_review' END AS action
      FROM (SELECT z.job_id, greatest(0, least(1, 1 + coalesce(sum(impact), 0)))::DECIMAL(4,2) AS score
            FROM sizes z LEFT JOIN factors f ON f.job_id = z.job_id GROUP BY ALL))"""


def _scored(t: Tables) -> tuple[Catalog, dict[str, DataFrame]]:
    cat = Catalog(t, shared=True)
    return cat, catalog_scoring.score(cat.stages, cat.links, cat.derivations)


@query("score_stage_support", FACTORS_SQL + """
    SELECT job_id, stage_id, stage_type, support, CASE support WHEN 'partial' THEN -0.08 WHEN 'complex' THEN -0.20 WHEN 'unknown' THEN -0.15
           ELSE 0 END::DOUBLE AS penalty FROM supported""")
def score_stage_support(t: Tables):
    return scoring.stage_support(Catalog(t).stages).select(
        "job_id", "stage_id", "stage_type", "support", c("penalty").cast("double").alias("penalty"))


@query("score_factors", FACTORS_SQL + " SELECT job_id, stage_id, factor, CAST(impact AS DOUBLE) AS impact, reason FROM factors")
def score_factors(t: Tables):
    return _scored(t)[1]["factors"].withColumn("impact", c("impact").cast("double"))


@query("score_confidence", SCORES_SQL + " SELECT job_id, CAST(score AS DOUBLE) AS score FROM scores")
def score_confidence(t: Tables):
    return _scored(t)[1]["scores"].select("job_id", c("score").cast("double").alias("score"))


@query("score_complexity", SCORES_SQL + " SELECT complexity, count(*) AS jobs FROM scores GROUP BY ALL")
def score_complexity(t: Tables):
    return _scored(t)[1]["scores"].groupBy("complexity").agg(F.count(F.lit(1)).alias("jobs"))


NOTES_SQL = SCORES_SQL + """
    SELECT job_id, stage_id, 'flag' AS kind, 'write_by_hand: ' || stage_id || ' as ' || stage_type AS text FROM supported WHERE support = 'complex'
    UNION ALL SELECT job_id, stage_id, 'flag', 'unlisted_type: ' || stage_type FROM supported WHERE support = 'unknown'
    UNION ALL SELECT job_id, stage_id, 'recommendation', 'read_stage: look at ' || stage_id || ' (' || stage_type || ') in person' FROM supported WHERE support = 'unknown'
    UNION ALL SELECT job_id, stage_id, 'flag', 'history_kept: the target keeps versions, so the load has to merge' FROM hints WHERE hint = 'scd_type2'
    UNION ALL SELECT job_id, stage_id, 'recommendation', 'check_history: compare the merged versions with the old job''s' FROM hints WHERE hint = 'scd_type2'
    UNION ALL SELECT job_id, stage_id, 'flag', 'changes_applied: the job compares or merges images of a table' FROM hints WHERE hint = 'cdc_or_merge'
    UNION ALL SELECT job_id, stage_id, 'recommendation', 'build_changes: use the change-capture and merge stages' FROM hints WHERE hint = 'cdc_or_merge'
    UNION ALL SELECT job_id, stage_id, 'flag', 'lookup_used: look at its key and at rows without a match' FROM hints WHERE hint = 'lookup_join'
    UNION ALL SELECT job_id, stage_id, 'flag', 'long_transformer: ' || stage_id || ', ' || n || ' derivations' FROM per_stage WHERE n > 8
    UNION ALL SELECT job_id, NULL, 'recommendation', 'no_review: convert as it is' FROM scores WHERE complexity = 'simple'
    UNION ALL SELECT job_id, NULL, 'recommendation', 'read_flags: look at what is flagged first' FROM scores WHERE complexity = 'medium'
    UNION ALL SELECT job_id, NULL, 'recommendation', 'run_checks: run the checks on sample rows' FROM scores WHERE complexity = 'medium'
    UNION ALL SELECT job_id, NULL, 'recommendation', 'read_all: a person reads the whole job first' FROM scores WHERE complexity = 'complex'
    UNION ALL SELECT job_id, NULL, 'recommendation', 'split_job: convert it in parts' FROM scores WHERE complexity = 'complex'
    UNION ALL SELECT job_id, NULL, 'recommendation', 'check_state: test histories and changes by hand' FROM scores WHERE complexity = 'complex'"""


@query("score_recommendations", NOTES_SQL)
def score_recommendations(t: Tables):
    cat, s = _scored(t)
    return scoring.flags_and_recommendations(s["factors"], s["classified"], s["scores"], cat.derivations)


@query("route_action", SCORES_SQL + " SELECT job_id, complexity, action FROM scores")
def route_action(t: Tables):
    return _scored(t)[1]["scores"].select("job_id", "complexity", "action")


@query("route_escalation", SCORES_SQL + f"""
    SELECT job_id, complexity, CASE WHEN complexity = 'simple' THEN 0 ELSE 1 END AS escalated,
           CASE WHEN complexity = 'simple' THEN 'proceed' ELSE 'human_review' END AS suggested_action,
           CASE WHEN complexity = 'simple' THEN '{scoring.INSTRUCTIONS['simple']}'
                ELSE '{scoring.INSTRUCTIONS['other'].replace("'", "''")}' END AS instructions FROM scores""")
def route_escalation(t: Tables):
    go, wait = scoring.escalate(_scored(t)[1]["scores"])
    return go.unionByName(wait)


@query("route_flagged_stages", SCORES_SQL + """
    SELECT f.job_id, f.stage_id, CAST(sum(impact) AS DOUBLE) AS impact FROM factors f JOIN scores s ON s.job_id = f.job_id AND s.complexity <> 'simple'
    WHERE f.stage_id IS NOT NULL GROUP BY ALL""")
def route_flagged_stages(t: Tables):
    s = _scored(t)[1]
    return scoring.flagged_stages(s["scores"], s["factors"]).withColumn("impact", c("impact").cast("double"))


# --- validation --------------------------------------------------------------------------------

CHECKS_SQL = ORPHANS_SQL + r""",
    all_jobs AS (SELECT DISTINCT job_id FROM stages),
    schema_cov AS (SELECT job_id, count(*) FILTER (src) AS total, count(*) FILTER (src AND has) AS covered FROM (
        SELECT job_id, category IN ('source', 'source_or_target') AS src,
               EXISTS (SELECT 1 FROM columns k WHERE k.job_id = s.job_id AND k.stage_id = s.stage_id) AS has FROM stages s) GROUP BY ALL),
    stage_cov AS (SELECT job_id, count(*) AS total, count(*) FILTER (category = 'unknown') AS unknown FROM stages GROUP BY ALL),
    expr_cov AS (SELECT s.job_id, count(*) FILTER (category = 'transformer') AS total,
        count(*) FILTER (category = 'transformer' AND d.n IS NOT NULL) AS covered, coalesce(max(res), 0) AS res
      FROM stages s LEFT JOIN (SELECT job_id, stage_id, count(*) AS n, max(CASE WHEN regexp_matches(expression, 'Upcase\(|Downcase\(|Year\(|Month\(|IsNull\(') THEN 1 ELSE 0 END) AS res
                               FROM derivations GROUP BY ALL) d ON d.job_id = s.job_id AND d.stage_id = s.stage_id GROUP BY ALL),
    outs AS (SELECT j.job_id, (SELECT count(DISTINCT artifact_type) FROM artifacts a WHERE a.job_id = j.job_id AND size_bytes > 0
                               AND artifact_type IN ('pyspark', 'datafusion')) AS n FROM all_jobs j),
    params AS (SELECT job_id, count(DISTINCT name) AS n FROM (SELECT job_id, unnest(regexp_extract_all(concat_ws(' ', p_sql, p_file), '\$\{([^}]+)\}', 1)) AS name FROM stages) GROUP BY ALL),
    checks AS (
      SELECT job_id, 'schema_coverage' AS name, CASE WHEN cov = 1 THEN 'pass' WHEN cov >= 0.5 THEN 'warn' ELSE 'fail' END AS status, round(cov, 3) AS score,
             covered || ' of ' || total || ' sources declare columns' AS detail
        FROM (SELECT *, CASE WHEN total > 0 THEN covered / total ELSE 1.0::DOUBLE END AS cov FROM schema_cov)
      UNION ALL SELECT job_id, 'stage_coverage', CASE WHEN unknown = 0 THEN 'pass' WHEN unknown <= 1 THEN 'warn' ELSE 'fail' END, round((total - unknown) / total, 3),
             (total - unknown) || ' of ' || total || ' stage types known, ' || unknown || ' not' FROM stage_cov
      UNION ALL SELECT j.job_id, 'dag_completeness', CASE WHEN coalesce(n, 0) = 0 THEN 'pass' ELSE 'warn' END, CASE WHEN coalesce(n, 0) = 0 THEN 1.0 ELSE 0.7 END,
             CASE WHEN coalesce(n, 0) = 0 THEN 'no loose stage' ELSE n || ' loose stages' END
        FROM all_jobs j LEFT JOIN (SELECT job_id, count(*) AS n FROM orphans GROUP BY ALL) o ON o.job_id = j.job_id
      UNION ALL SELECT job_id, 'expression_coverage', CASE WHEN cov = 1 AND {res} = 0 THEN 'pass' WHEN cov < 0.5 THEN 'fail' ELSE 'warn' END, round(cov, 3),
             covered || ' of ' || total || ' transformers derive columns'
        FROM (SELECT *, CASE WHEN total > 0 THEN covered / total ELSE 1.0::DOUBLE END AS cov FROM expr_cov)
      UNION ALL SELECT job_id, 'output_completeness', CASE n WHEN 2 THEN 'pass' WHEN 1 THEN 'warn' ELSE 'fail' END, n / 2, n || ' of 2 code outputs' FROM outs
      UNION ALL SELECT j.job_id, 'parameter_coverage', 'pass', 1.0, CASE WHEN n IS NULL THEN 'no parameters'
             ELSE n || ' parameters, set outside the job' END FROM all_jobs j LEFT JOIN params p ON p.job_id = j.job_id)"""

# Checked as written (raw) and after translation, where no legacy call is left.
RAW_CHECKS_SQL = CHECKS_SQL.replace("{res}", "res")
DONE_CHECKS_SQL = CHECKS_SQL.replace("{res}", "0")


def _check(name: str, sql: str, build) -> None:
    @query(f"val_{name}", sql + f" SELECT job_id, status, score, detail FROM checks WHERE name = '{name}'")
    def run(t: Tables):
        return build(Catalog(t)).drop("name")


_check("schema_coverage", RAW_CHECKS_SQL, lambda k: validation.schema_coverage(k.stages, k.columns))
_check("stage_coverage", RAW_CHECKS_SQL, lambda k: validation.stage_coverage(k.stages))
_check("dag_completeness", RAW_CHECKS_SQL, lambda k: validation.dag_completeness(k.stages, k.links))
_check("expression_coverage", RAW_CHECKS_SQL,
       lambda k: validation.expression_coverage(k.stages, k.derivations, "expression"))
_check("output_completeness", RAW_CHECKS_SQL, lambda k: validation.output_completeness(k.stages, k.artifacts))
_check("parameter_coverage", RAW_CHECKS_SQL, lambda k: validation.parameter_coverage(k.stages))

OVERALL_SQL = """,
    validated AS (SELECT job_id, count(*) AS total_checks, count(*) FILTER (status = 'pass') AS passed, count(*) FILTER (status = 'warn') AS warnings,
      count(*) FILTER (status = 'fail') AS failed, CASE WHEN count(*) FILTER (status = 'fail') = 0 THEN 'pass'
        WHEN count(*) FILTER (status = 'fail') <= 1 THEN 'warn' ELSE 'fail' END AS overall_status,
      round(count(*) FILTER (status = 'pass') / count(*), 3) AS overall_score FROM checks GROUP BY ALL)"""


def _validated(cat: Catalog) -> DataFrame:
    checks = catalog_scoring.validate(cat.stages, cat.links, cat.columns, cat.derivations, cat.artifacts)
    return validation.overall(checks)


@query("val_overall", DONE_CHECKS_SQL + OVERALL_SQL + " SELECT * FROM validated")
def val_overall(t: Tables):
    return _validated(Catalog(t, shared=True))


# --- quality gates -----------------------------------------------------------------------------
# The implementation: aggregations implemented twice, peeks not at all, one stage more per job.

IMPL_SQL = CATALOG_SQL + """,
    impl AS (SELECT job_id, stage_id FROM stages WHERE category <> 'passthrough'
      UNION ALL SELECT job_id, stage_id FROM stages WHERE category = 'aggregation'
      UNION ALL SELECT DISTINCT job_id, 'AUDIT' FROM stages),
    impl_links AS (SELECT job_id, from_stage, to_stage FROM links WHERE from_pin = 0
      UNION ALL SELECT job_id, from_stage, to_stage FROM links WHERE from_stage LIKE 'EXCEPTION%')"""


@query("qg_stage_match", IMPL_SQL + """
    SELECT coalesce(a.job_id, b.job_id) AS job_id, coalesce(a.stage_id, b.stage_id) AS stage_id, coalesce(a.n, 0) AS expected, coalesce(b.n, 0) AS declared,
           CASE WHEN a.n IS NULL THEN 'extra' WHEN b.n IS NULL THEN 'missing' WHEN b.n > 1 THEN 'repeated' ELSE 'ok' END AS verdict
    FROM (SELECT job_id, stage_id, count(*) AS n FROM stages GROUP BY ALL) a
    FULL JOIN (SELECT job_id, stage_id, count(*) AS n FROM impl GROUP BY ALL) b ON a.job_id = b.job_id AND a.stage_id = b.stage_id""")
def qg_stage_match(t: Tables):
    stages = Catalog(t, shared=True).stages.select("job_id", "stage_id", "category")
    ids = ["job_id", "stage_id"]
    impl = (
        stages.where("category <> 'passthrough'").select(*ids)
        .unionByName(stages.where("category = 'aggregation'").select(*ids))
        .unionByName(stages.select("job_id").distinct().withColumn("stage_id", F.lit("AUDIT")))
    )
    return gates.match_once(stages, impl, ids)


@query("qg_link_match", IMPL_SQL + """
    SELECT coalesce(a.job_id, b.job_id) AS job_id, coalesce(a.from_stage, b.from_stage) AS from_stage, coalesce(a.to_stage, b.to_stage) AS to_stage,
           coalesce(a.n, 0) AS expected, coalesce(b.n, 0) AS declared,
           CASE WHEN a.n IS NULL THEN 'extra' WHEN b.n IS NULL THEN 'missing' WHEN b.n > 1 THEN 'repeated' ELSE 'ok' END AS verdict
    FROM (SELECT job_id, from_stage, to_stage, count(*) AS n FROM links GROUP BY ALL) a
    FULL JOIN (SELECT job_id, from_stage, to_stage, count(*) AS n FROM impl_links GROUP BY ALL) b
      ON a.job_id = b.job_id AND a.from_stage = b.from_stage AND a.to_stage = b.to_stage""")
def qg_link_match(t: Tables):
    links = Catalog(t, shared=True).links.select("job_id", "from_stage", "to_stage", "from_pin")
    ids = ["job_id", "from_stage", "to_stage"]
    impl = links.where("from_pin = 0").select(*ids).unionByName(
        links.where(c("from_stage").startswith("EXCEPTION")).select(*ids))
    return gates.match_once(links, impl, ids)


@query("qg_derivations_recorded", CATALOG_SQL + "," + METADATA_SQL + """
    SELECT d.job_id, d.stage_id, d.ord, d.output_column FROM derivations d WHERE NOT EXISTS (SELECT 1 FROM metadata m
      WHERE m.job_id = d.job_id AND m.stage_id = d.stage_id AND m.name = d.output_column AND m.derivation_expression IS NOT NULL)""")
def qg_derivations_recorded(t: Tables):
    cat = Catalog(t)
    metadata = describe.column_metadata(cat.columns, describe.normalize_stages(cat.stages), cat.derivations)
    return gates.derivations_recorded(cat.derivations, metadata).select("job_id", "stage_id", "ord", "output_column")


@query("qg_reject_paths", CATALOG_SQL + """
    SELECT job_id, stage_id FROM stages s WHERE output_pins > 1 AND NOT EXISTS (SELECT 1 FROM links l
      WHERE l.job_id = s.job_id AND l.from_stage = s.stage_id AND l.to_stage LIKE 'EXCEPTION%')""")
def qg_reject_paths(t: Tables):
    cat = Catalog(t)
    sinks = cat.links.where(c("to_stage").startswith("EXCEPTION")).select("job_id", c("from_stage").alias("stage_id"))
    return gates.reject_paths(cat.stages, sinks)


def _scan_sql() -> str:
    parts = [
        f"SELECT {key}, '{rule}' AS rule, unnest(regexp_extract_all({text}, '{pattern}')) AS match FROM {name}"
        for rule, pattern in gates.CREDENTIAL_RULES.items()
        for name, key, text in (("documents", "'documents' AS source, doc_id AS id", "text"), ("pages", "'pages' AS source, page_id AS id", "html"))
    ]
    return " UNION ALL ".join(parts)


@query("qg_credentials_scan", _scan_sql())
def qg_credentials_scan(t: Tables):
    def hits(source: str, df: DataFrame) -> DataFrame:
        return gates.credentials_scan(df, "id", "text").withColumn("source", F.lit(source))

    return hits("documents", t.documents.select(c("doc_id").alias("id"), "text")).unionByName(
        hits("pages", t.pages.select(c("page_id").alias("id"), c("html").alias("text"))))


@query("qg_types_present", CATALOG_SQL + """
    SELECT job_id, 'sql_type_code' AS field, count(*) FILTER (sql_type_code = '') AS empty FROM columns GROUP BY ALL
    UNION ALL SELECT job_id, 'precision', count(*) FILTER (precision IS NULL) FROM columns GROUP BY ALL""")
def qg_types_present(t: Tables):
    return gates.empty_fields(Catalog(t).columns, ["job_id"], ["sql_type_code", "precision"])


@query("qg_confidence_present", CATALOG_SQL + """
    SELECT job_id, 'expression' AS field, count(*) FILTER (trim(expression) = '') AS empty FROM derivations GROUP BY ALL
    UNION ALL SELECT job_id, 'confidence', count(*) FILTER (expression LIKE 'If%') FROM derivations GROUP BY ALL""")
def qg_confidence_present(t: Tables):
    """Conditionals are the transformations nobody has scored yet."""
    scored = Catalog(t).derivations.withColumn("confidence", F.when(~c("expression").startswith("If"), F.lit(0.9)))
    return gates.empty_fields(scored, ["job_id"], ["expression", "confidence"])


@query("qg_unsupported_fields", FACTORS_SQL + """,
    gaps AS (SELECT job_id, stage_id, CASE WHEN support = 'complex' THEN 'true' END AS blocking, CASE WHEN output_pins > 0 THEN 8 * output_pins END AS hours
             FROM supported WHERE support IN ('complex', 'unknown'))
    SELECT job_id, 'blocking' AS field, count(*) FILTER (blocking IS NULL) AS empty FROM gaps GROUP BY ALL
    UNION ALL SELECT job_id, 'estimated_effort_hours', count(*) FILTER (hours IS NULL) FROM gaps GROUP BY ALL""")
def qg_unsupported_fields(t: Tables):
    gaps = scoring.stage_support(Catalog(t).stages).where("support IN ('complex', 'unknown')").select(
        "job_id", F.when(c("support") == "complex", "true").alias("blocking"),
        F.when(c("output_pins") > 0, 8 * c("output_pins")).alias("estimated_effort_hours"))
    return gates.empty_fields(gaps, ["job_id"], ["blocking", "estimated_effort_hours"])


@query("qg_completeness_present", FACTORS_SQL + """
    SELECT job_id FROM supported GROUP BY ALL HAVING count(*) FILTER (support IN ('full', 'partial')) = 0""")
def qg_completeness_present(t: Tables):
    """Jobs without any supported stage have no figure."""
    stages = scoring.stage_support(Catalog(t).stages)
    good = F.count(F.when(c("support").isin("full", "partial"), 1))
    reports = stages.groupBy("job_id").agg(
        F.when(good > 0, good * 100.0 / F.count(F.lit(1))).alias("completeness_pct"))
    return gates.completeness_present(reports.select("job_id"), reports)


PRESENT_SQL = """
    WITH jobs AS (SELECT DISTINCT conv_id AS job_id FROM conversations),
    kinds AS (SELECT unnest({kinds}) AS artifact_type, unnest(range(8)) AS k),
    have AS (SELECT conv_id AS job_id, turn % 8 AS k, max(length(text)) AS size FROM conversations GROUP BY ALL),
    present AS (SELECT j.job_id, artifact_type, CASE WHEN size > 100 THEN 'present' ELSE 'missing_or_empty' END AS state
      FROM jobs j CROSS JOIN kinds LEFT JOIN have ON have.job_id = j.job_id AND have.k = kinds.k)
    """.replace("{kinds}", "[" + ", ".join(f"'{a}'" for a in gates.ARTIFACTS) + "]")


def _present(t: Tables) -> DataFrame:
    artifacts = Catalog(t).artifacts
    return gates.artifacts_present(artifacts.select("job_id").distinct(), artifacts)


@query("qg_artifacts_present", PRESENT_SQL + " SELECT * FROM present")
def qg_artifacts_present(t: Tables):
    return _present(t)


@query("qg_gate_summary", PRESENT_SQL + """
    , s AS (SELECT conv_id AS job_id, max(length(text)) % 101 AS score, bool_or(role = 'system') AS critical FROM conversations GROUP BY ALL)
    SELECT p.job_id, count(*) FILTER (state = 'present') AS gates_passed, count(*) FILTER (state <> 'present') AS gates_failed,
           score, CASE WHEN score >= 90 AND NOT critical THEN 1 ELSE 0 END AS passed FROM present p JOIN s ON s.job_id = p.job_id GROUP BY p.job_id, score, critical""")
def qg_gate_summary(t: Tables):
    results = _present(t).select("job_id", F.when(c("state") == "present", "PASS").otherwise("FAIL").alias("result"))
    scores = t.conversations.groupBy(c("conv_id").alias("job_id")).agg(
        (F.max(F.length("text")).cast("bigint") % 101).alias("score"), F.bool_or(c("role") == "system").alias("critical_issues"))
    return gates.gate_summary(results, scores)


# --- indicators --------------------------------------------------------------------------------

STATUS_SQL = SCORES_SQL + "," + DONE_CHECKS_SQL.split("classified AS (", 1)[1].split("FROM stages s)", 1)[1].lstrip(",\n ") + OVERALL_SQL + """,
    statuses AS (SELECT s.job_id, s.score AS confidence, complexity, action, overall_status, overall_score, z.n AS stages,
      CASE WHEN complexity <> 'simple' THEN 'escalated' WHEN overall_status = 'fail' THEN 'failed' ELSE 'completed' END AS status
      FROM scores s JOIN validated v ON v.job_id = s.job_id JOIN sizes z ON z.job_id = s.job_id)"""


def _statuses(t: Tables) -> DataFrame:
    cat, s = _scored(t)
    counts = cat.stages.groupBy("job_id").agg(F.count(F.lit(1)).alias("total_stages"))
    return catalog_scoring.job_status(s["scores"], _validated(cat), counts)


KPI_SQL = """
    SELECT count(*) AS total_jobs, count(*) FILTER (status = 'completed') AS successful, count(*) FILTER (status = 'escalated') AS escalated,
           count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'completed') / count(*) AS success_rate,
           CAST(sum(confidence) AS DOUBLE) / count(*) AS avg_confidence,
           CAST(coalesce(sum(stages) FILTER (status = 'completed'), 0) AS BIGINT) AS total_stages_migrated FROM statuses"""


@query("kpi_report", STATUS_SQL + KPI_SQL)
def kpi_report(t: Tables):
    return kpi.report(_statuses(t))


@query("kpi_dashboard", STATUS_SQL + """
    , d AS (SELECT count(*) AS total, count(*) FILTER (status = 'completed') AS completed,
      CAST(sum(CASE WHEN confidence <= 1 THEN confidence * 100 ELSE confidence END) FILTER (status = 'completed') AS DOUBLE) AS conf,
      count(*) FILTER (complexity = 'simple') AS simple, count(*) FILTER (complexity = 'medium') AS medium,
      count(*) FILTER (complexity = 'complex') AS complex FROM statuses)
    SELECT total, completed, CAST(floor(completed * 100 / total + 0.5) AS BIGINT) AS success_pct,
           CASE WHEN completed > 0 THEN round(conf / completed, 1) ELSE 0 END AS avg_confidence, simple, medium, complex,
           CAST(floor(simple * 100 / total + 0.5) AS BIGINT) AS simple_pct, CAST(floor(medium * 100 / total + 0.5) AS BIGINT) AS medium_pct,
           CAST(floor(complex * 100 / total + 0.5) AS BIGINT) AS complex_pct FROM d""")
def kpi_dashboard(t: Tables):
    return kpi.dashboard(_statuses(t))


@query("kpi_job_table", STATUS_SQL + """
    SELECT o_orderkey AS job_id, strftime(o_orderdate, '%Y-%m-%d') AS created, CAST(score AS DOUBLE) AS score, s.complexity, s.action,
           overall_status, overall_score FROM orders LEFT JOIN scores s ON s.job_id = o_orderkey LEFT JOIN validated v ON v.job_id = o_orderkey""")
def kpi_job_table(t: Tables):
    cat, s = _scored(t)
    jobs = t.orders.select(c("o_orderkey").alias("job_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("created"))
    rows = kpi.job_table(jobs, s["scores"], _validated(cat)).withColumn("score", c("score").cast("double"))
    return kpi.newest_first(rows, "created")


@query("cat_migration_report", SCORES_SQL + """
    SELECT count(*) AS total_stages, count(*) FILTER (support = 'full') AS fully, count(*) FILTER (support = 'partial') AS partially,
           count(*) FILTER (support IN ('complex', 'unknown')) AS unsupported,
           round((count(*) FILTER (support = 'full') * 1.0::DOUBLE + count(*) FILTER (support = 'partial') * 0.5::DOUBLE) / count(*) * 100, 1) AS completeness_pct,
           (SELECT count(*) FROM scores) AS jobs, (SELECT round(CAST(sum(score) AS DOUBLE) / count(*), 6) FROM scores) AS overall_confidence FROM supported""")
def cat_migration_report(t: Tables):
    cat, s = _scored(t)
    return describe.migration_report(cat.stages, s["scores"])


@query("job_catalog_scoring", STATUS_SQL + """
    SELECT action, status, complexity, count(*) AS jobs, CAST(sum(confidence) AS DOUBLE) AS confidence, CAST(sum(stages) AS BIGINT) AS stages
    FROM statuses GROUP BY ALL""")
def job_catalog_scoring(t: Tables):
    return _statuses(t).groupBy("action", "status", "complexity").agg(
        F.count(F.lit(1)).alias("jobs"), F.sum(c("confidence").cast("decimal(18,2)")).cast("double").alias("confidence"),
        F.sum("stages").alias("stages"))
