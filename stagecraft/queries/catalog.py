"""Job-catalog queries: expressions, descriptions, graphs and lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stagecraft.catalog import describe, expressions as ex, graph, lineage, scoring, vocab
from stagecraft.queries.binding import CATALOG_SQL, SPARK_TYPES, SQL_TYPES, Catalog, case_map
from stagecraft.queries.registry import Tables, query
from stagecraft.runtime import cut_lineage, store

c = F.col


# --- expressions -------------------------------------------------------------------------------

def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _translate_sql(target: str) -> str:
    """The same rewriting as DuckDB SQL (RE2 has no lookaround: '=' is handled by its neighbours)."""
    e = r"regexp_replace(expression, '^\s+|\s+$', '', 'g')"
    calls = e
    for name, args, repl in ex.SPARK_REWRITES if target == "spark" else ex.SQL_REWRITES:
        repl = repl.replace("$", "\\")
        calls = f"regexp_replace({calls}, {_q(ex.call_pattern(name, args))}, {_q(repl)}, 'g')"
    branch = r"(?is)^If\s+(.+?)\s+Then\s+(.+)$"
    cond = rf"regexp_replace(trim(regexp_extract(p, '{branch}', 1)), '([^<>!=])=([^=])', '\1==\2', 'g')"
    cond = f"replace(replace({cond}, ' Is Not Null', ' is not null'), ' Is Null', ' is null')"
    value = rf"""regexp_replace(trim(regexp_extract(p, '{branch}', 2)), '(?s)^"(.*)"$', '''\1''')"""
    rest = r"""regexp_replace(trim(p), '(?s)^"(.*)"$', '''\1''')"""
    parts = rf"regexp_split_to_array({e}, '(?i)\s+Else\s+')"
    if target == "spark":
        piece = (f"CASE WHEN regexp_matches(p, '{branch}') THEN 'when(' || {cond} || ', ' || {value} || ')' "
                 f"ELSE 'otherwise(' || {rest} || ')' END")
        chain = f"array_to_string(list_transform({parts}, lambda p: {piece}), '.')"
        head = "concat("
    else:
        piece = (f"CASE WHEN regexp_matches(p, '{branch}') THEN 'WHEN ' || {cond} || ' THEN ' || {value} "
                 f"ELSE 'ELSE ' || {rest} END")
        chain = f"'CASE ' || array_to_string(list_transform({parts}, lambda p: {piece}), ' ') || ' END'"
        head = "CONCAT("
    joined = f"'{head}' || array_to_string(list_transform(string_split(calls, ':'), lambda x: trim(x)), ', ') || ')'"
    return f"""{CATALOG_SQL}, called AS (SELECT *, {calls} AS calls FROM derivations),
    translated AS (SELECT job_id, stage_id, ord, output_column, expression,
      CASE WHEN expression = '' THEN expression WHEN regexp_matches({e}, '(?i)^If\\s+') THEN {chain}
           WHEN contains({e}, ':') AND NOT starts_with({e}, 'jdbc') THEN {joined} ELSE calls END AS translated
      FROM called)"""


TRANSLATED_SQL = _translate_sql("spark")


@query("expr_translate_spark", TRANSLATED_SQL + " SELECT job_id, stage_id, ord, expression, translated FROM translated")
def expr_translate_spark(t: Tables):
    return ex.with_translation(Catalog(t).derivations).select("job_id", "stage_id", "ord", "expression", "translated")


@query("expr_translate_sql", _translate_sql("sql") + " SELECT job_id, stage_id, ord, expression, translated FROM translated")
def expr_translate_sql(t: Tables):
    return ex.with_translation(Catalog(t).derivations, "sql").select("job_id", "stage_id", "ord", "expression", "translated")


@query("expr_function_usage", CATALOG_SQL + r"""
    SELECT job_id, stage_id, f AS function, count(*) AS uses
    FROM (SELECT job_id, stage_id, unnest(regexp_extract_all(expression, '([A-Za-z_]\w*)\(', 1)) AS f FROM derivations)
    GROUP BY ALL""")
def expr_function_usage(t: Tables):
    return ex.function_usage(Catalog(t).derivations)


@query("expr_residual", TRANSLATED_SQL + """
    SELECT job_id, stage_id, ord, translated, concat_ws(',', CASE WHEN contains(translated, 'Upcase(') THEN 'Upcase(' END,
      CASE WHEN contains(translated, 'Downcase(') THEN 'Downcase(' END, CASE WHEN contains(translated, 'Year(') THEN 'Year(' END,
      CASE WHEN contains(translated, 'Month(') THEN 'Month(' END, CASE WHEN contains(translated, 'IsNull(') THEN 'IsNull(' END) AS residual
    FROM (SELECT job_id, stage_id, ord, replace(expression, 'Upcase', 'Ucase') AS translated FROM translated)
    WHERE residual <> ''""")
def expr_residual(t: Tables):
    """Checked on a half-done translation: only the upper-case call has been renamed."""
    half = F.replace("expression", F.lit("Upcase"), F.lit("Ucase"))
    return Catalog(t).derivations.select("job_id", "stage_id", "ord", half.alias("translated")).withColumn(
        "residual", ex.residual_calls(c("translated"))).where("residual <> ''")


@query("expr_conditional_flags", CATALOG_SQL + """
    SELECT job_id, stage_id, ord, CAST(len(regexp_extract_all(lower(expression), 'if ')) AS INTEGER) AS ifs,
           CASE WHEN len(regexp_extract_all(lower(expression), 'if ')) > 1 THEN 1 ELSE 0 END AS needs_review
    FROM derivations WHERE contains(lower(expression), 'if ')""")
def expr_conditional_flags(t: Tables):
    return ex.conditional_flags(Catalog(t).derivations).select("job_id", "stage_id", "ord", "ifs", "needs_review")


REFS_SQL = CATALOG_SQL + r""",
    refs AS (SELECT DISTINCT job_id, stage_id, output_column, ref FROM (
      SELECT job_id, stage_id, output_column, unnest(regexp_extract_all(regexp_replace(regexp_replace(expression,
        '"[^"]*"|''[^'']*''', ' ', 'g'), '[A-Za-z_]\w*\(', '(', 'g'), '([A-Za-z_]\w*)', 1)) AS ref FROM derivations)
      WHERE lower(ref) NOT IN ('if', 'then', 'else', 'and', 'or', 'not', 'is', 'null'))"""


@query("expr_column_refs", REFS_SQL + " SELECT * FROM refs")
def expr_column_refs(t: Tables):
    return ex.column_refs(Catalog(t).derivations)


@query("map_join_type", CATALOG_SQL + f"""
    SELECT job_id, stage_id, p_jtype AS declared, {case_map('p_jtype', vocab.JOIN_TYPES, "'inner'")} AS how
    FROM stages WHERE p_jtype IS NOT NULL""")
def map_join_type(t: Tables):
    rows = Catalog(t).stages.select("job_id", "stage_id", describe.prop("JoinType").alias("declared"))
    return rows.where("declared IS NOT NULL").withColumn("how", vocab.map_join_type(c("declared")))


# The expected names are spelled out here, so a wrong entry in the vocabulary shows.
@query("map_sql_names", CATALOG_SQL + """
    SELECT job_id, stage_id,
      CASE p_jtype WHEN 'LeftOuter' THEN 'LEFT OUTER' WHEN 'Lookup' THEN 'LEFT OUTER' WHEN 'RightOuter' THEN 'RIGHT OUTER'
           WHEN 'FullOuter' THEN 'FULL OUTER' WHEN 'Cross' THEN 'CROSS' ELSE 'INNER' END AS join_name,
      CASE upper(p_mode) WHEN 'OVERWRITE' THEN 'TRUNCATE_AND_INSERT' WHEN 'REPLACE' THEN 'TRUNCATE_AND_INSERT' WHEN 'MERGE' THEN 'UPSERT'
           ELSE 'INSERT' END AS write_mode FROM stages""")
def map_sql_names(t: Tables):
    return Catalog(t).stages.select(
        "job_id", "stage_id", vocab.sql_join_type(describe.prop("JoinType")).alias("join_name"),
        vocab.sql_write_mode(describe.prop("XMLProperties.WriteMode")).alias("write_mode"))


@query("map_write_mode", CATALOG_SQL + f"""
    SELECT job_id, stage_id, p_mode AS declared, {case_map('upper(p_mode)', vocab.WRITE_MODES, "'append'")} AS mode FROM stages""")
def map_write_mode(t: Tables):
    rows = Catalog(t).stages.select("job_id", "stage_id", describe.prop("XMLProperties.WriteMode").alias("declared"))
    return rows.withColumn("mode", vocab.map_write_mode(c("declared")))


PARSED_SQL = CATALOG_SQL + r""",
    parts AS (SELECT job_id, stage_id, unnest(string_split(p_agg, ',')) AS part, generate_subscripts(string_split(p_agg, ','), 1) - 1 AS pos
              FROM stages WHERE p_agg IS NOT NULL),
    parsed AS (SELECT job_id, stage_id, CAST(pos AS INTEGER) AS pos, upper(regexp_extract(trim(part), '(?i)^(\w+)\(([^)]+)\)\s+AS\s+(\w+)', 1)) AS function,
              trim(regexp_extract(trim(part), '(?i)^(\w+)\(([^)]+)\)\s+AS\s+(\w+)', 2)) AS "column",
              regexp_extract(trim(part), '(?i)^(\w+)\(([^)]+)\)\s+AS\s+(\w+)', 3) AS alias
              FROM parts WHERE regexp_matches(trim(part), '(?i)^(\w+)\(([^)]+)\)\s+AS\s+(\w+)'))"""


def _parsed(t: Tables) -> DataFrame:
    rows = Catalog(t).stages.select("job_id", "stage_id", describe.prop("Aggregations").alias("aggs"))
    return ex.parse_aggregations(rows, "aggs", ["job_id", "stage_id"])


@query("expr_aggregation_parse", PARSED_SQL + " SELECT * FROM parsed")
def expr_aggregation_parse(t: Tables):
    return _parsed(t)


@query("map_agg_fn", PARSED_SQL + f"""
    SELECT job_id, stage_id, pos, function, {case_map('function', vocab.AGGREGATE_NAMES, "'F.' || lower(function)")} AS mapped FROM parsed""")
def map_agg_fn(t: Tables):
    return _parsed(t).select("job_id", "stage_id", "pos", "function", vocab.map_aggregate(c("function")).alias("mapped"))


@query("map_sql_aggregate", PARSED_SQL + """
    SELECT job_id, stage_id, pos, function, CASE WHEN function IN ('SUM', 'COUNT', 'AVG', 'MAX', 'MIN', 'STDDEV', 'VARIANCE') THEN function END AS mapped
    FROM parsed""")
def map_sql_aggregate(t: Tables):
    return _parsed(t).select("job_id", "stage_id", "pos", "function", vocab.sql_aggregate(c("function")).alias("mapped"))


@query("map_connector", CATALOG_SQL + f"""
    SELECT job_id, stage_id, {case_map('stage_type', vocab.CONNECTOR_FORMATS, "'jdbc'")} AS format FROM stages""")
def map_connector(t: Tables):
    return Catalog(t).stages.select("job_id", "stage_id", vocab.map_connector(c("stage_type")).alias("format"))


# --- descriptions ------------------------------------------------------------------------------

@query("cat_stage_category", CATALOG_SQL + " SELECT category, count(*) AS stages FROM stages GROUP BY ALL")
def cat_stage_category(t: Tables):
    return Catalog(t).stages.groupBy("category").agg(F.count(F.lit(1)).alias("stages"))


@query("cat_column_types", CATALOG_SQL + f"""
    SELECT job_id, stage_id, ord, name, {case_map('sql_type_code', SQL_TYPES, "'VARCHAR'")} AS sql_type,
           {case_map('sql_type_code', SPARK_TYPES, "'string'")} AS spark_type, precision, scale, nullable FROM columns""")
def cat_column_types(t: Tables):
    return Catalog(t).columns.drop("sql_type_code")


@query("cat_normalize_stage", CATALOG_SQL + """
    SELECT job_id, stage_id, 'df_' || lower(stage_id) AS var_name,
           CASE WHEN description <> '' THEN description WHEN sk % 9 = 0 THEN 'Exception Out ' || ord ELSE 'Stage ' || ord END AS description,
           p_sql AS sql_query, p_table AS table_name, p_conn AS connection_name, p_file AS file_path,
           coalesce(p_mode, 'APPEND') AS write_mode, p_jtype AS join_type, p_jkey AS join_key, p_agg AS aggregations,
           p_lkey AS lookup_key, input_pins AS input_pin_count, output_pins AS output_pin_count FROM stages""")
def cat_normalize_stage(t: Tables):
    return describe.normalize_stages(Catalog(t).stages).select(
        "job_id", "stage_id", "var_name", "description", "sql_query", "table_name", "connection_name", "file_path",
        "write_mode", "join_type", "join_key", "aggregations", "lookup_key", "input_pin_count", "output_pin_count")


@query("cat_var_name", """
    SELECT p_partkey, 'df_' || regexp_replace(lower(p_brand || '.' || p_name), '[^a-z0-9_]', '_', 'g') AS var_name FROM part""")
def cat_var_name(t: Tables):
    return t.part.select("p_partkey", describe.var_name(F.concat_ws(".", "p_brand", "p_name")).alias("var_name"))


def _classified(t: Tables) -> tuple[Catalog, DataFrame]:
    cat = Catalog(t, shared=True)
    return cat, describe.classify_io(cat.stages, cat.links)


@query("cat_classify_io", CATALOG_SQL + " SELECT job_id, stage_id, category, io FROM classified")
def cat_classify_io(t: Tables):
    return _classified(t)[1].select("job_id", "stage_id", "category", "io")


@query("cat_summary", CATALOG_SQL + """
    SELECT job_id, CAST(count(*) AS BIGINT) AS total_stages,
           CAST(coalesce((SELECT count(*) FROM links l WHERE l.job_id = s.job_id), 0) AS BIGINT) AS total_links,
           CAST(count(*) FILTER (io = 'source') AS BIGINT) AS source_count, CAST(count(*) FILTER (io = 'target') AS BIGINT) AS target_count,
           CAST(count(*) FILTER (io = 'transformation') AS BIGINT) AS transformation_count,
           array_to_string(list_sort(list(DISTINCT stage_type)), ',') AS stage_types
    FROM classified s GROUP BY job_id""")
def cat_summary(t: Tables):
    cat, classified = _classified(t)
    return describe.job_summary(classified, cat.links)


HINTS_SQL = CATALOG_SQL + """,
    per_stage AS (SELECT job_id, stage_id, count(*) AS n,
        count(*) FILTER (contains(lower(expression), 'checksum') OR contains(lower(expression), 'hash')) AS h FROM derivations GROUP BY ALL),
    hints AS (
      SELECT job_id, stage_id, 'lookup_join' AS hint, 0.20::DECIMAL(6,2) AS weight FROM stages WHERE stage_type = 'PxLookup'
      UNION ALL SELECT job_id, stage_id, 'cdc_or_merge', 0.30 FROM stages WHERE stage_type IN ('PxChangeCapture', 'PxMerge')
      UNION ALL SELECT job_id, stage_id, 'complex_transformer', 0.20 FROM per_stage WHERE n > 5
      UNION ALL SELECT job_id, stage_id, 'scd_type2', 0.40 FROM stages WHERE mentions_scd
      UNION ALL SELECT job_id, stage_id, 'hash_computation', 0.10 FROM per_stage, range(12) r(i) WHERE i < h)"""


@query("cat_hints", HINTS_SQL + " SELECT job_id, stage_id, hint, CAST(weight AS DOUBLE) AS weight FROM hints")
def cat_hints(t: Tables):
    cat = Catalog(t)
    return describe.complexity_hints(cat.stages, cat.derivations).withColumn("weight", c("weight").cast("double"))


@query("cat_topological_level", CATALOG_SQL + """,
    walk AS (
      SELECT job_id, stage_id, 0 AS level FROM stages
      UNION SELECT w.job_id, l.to_stage, w.level + 1 FROM walk w JOIN links l ON l.job_id = w.job_id AND l.from_stage = w.stage_id)
    SELECT job_id, stage_id, max(level) AS level FROM walk GROUP BY ALL""")
def cat_topological_level(t: Tables):
    cat = Catalog(t, shared=True)
    return graph.topological_levels(cat.stages, cat.links)


@query("cat_cycle_check", CATALOG_SQL + """,
    looped AS (SELECT job_id, from_stage, to_stage FROM links
      UNION SELECT l.job_id, l.to_stage, l.from_stage FROM links l JOIN stages s ON s.job_id = l.job_id AND s.stage_id = l.from_stage
            WHERE s.output_pins = 3 AND s.ls = 'O'),
    walk AS (SELECT job_id, from_stage AS a, to_stage AS b FROM looped
      UNION SELECT w.job_id, w.a, l.to_stage FROM walk w JOIN looped l ON l.job_id = w.job_id AND l.from_stage = w.b),
    cyclic AS (SELECT DISTINCT job_id, a FROM walk WHERE a = b)
    SELECT c.job_id, c.a AS stage_id, min(there.b) AS component FROM cyclic c
      JOIN walk there ON there.job_id = c.job_id AND there.a = c.a
      JOIN walk back ON back.job_id = c.job_id AND back.a = there.b AND back.b = c.a GROUP BY ALL""")
def cat_cycle_check(t: Tables):
    """The catalog's links plus some that lead back."""
    cat = Catalog(t, shared=True)
    loops = cat.staged.where("output_pins = 3 AND is_open = 1").select("job_id", c("stage_id").alias("from_stage"))
    links = cut_lineage(cat.links.select("job_id", "from_stage", "to_stage"))
    back = links.join(loops, ["job_id", "from_stage"], "left_semi").select(
        "job_id", c("to_stage").alias("from_stage"), c("from_stage").alias("to_stage"))
    return graph.cycle_components(cat.stages, links.unionByName(back))


ORPHANS_SQL = CATALOG_SQL + """,
    orphans AS (SELECT job_id, stage_id FROM stages s WHERE (SELECT count(*) FROM stages x WHERE x.job_id = s.job_id) > 1
      AND NOT EXISTS (SELECT 1 FROM links l WHERE l.job_id = s.job_id AND (l.from_stage = s.stage_id OR l.to_stage = s.stage_id)))"""


@query("cat_orphans", ORPHANS_SQL + " SELECT * FROM orphans")
def cat_orphans(t: Tables):
    cat = Catalog(t, shared=True)
    return describe.orphans(cat.stages, cat.links)


@query("cat_neighbours", CATALOG_SQL + """
    SELECT job_id, to_stage AS stage_id, 'upstream' AS direction, from_stage AS neighbour FROM links
    UNION ALL SELECT job_id, from_stage, 'downstream', to_stage FROM links""")
def cat_neighbours(t: Tables):
    return describe.neighbours(Catalog(t).links)


@query("cat_lineage_closure", CATALOG_SQL + """,
    walk AS (SELECT job_id, stage_id AS source, stage_id, 0 AS hops FROM classified WHERE io = 'source'
      UNION SELECT w.job_id, w.source, l.to_stage, w.hops + 1 FROM walk w JOIN links l ON l.job_id = w.job_id AND l.from_stage = w.stage_id)
    SELECT w.job_id, w.source, w.stage_id AS target, min(hops) AS hops FROM walk w JOIN classified k
      ON k.job_id = w.job_id AND k.stage_id = w.stage_id AND k.io = 'target' GROUP BY ALL""")
def cat_lineage_closure(t: Tables):
    cat, classified = _classified(t)
    classified = cut_lineage(classified.select("job_id", "stage_id", "io"))
    links = cut_lineage(cat.links.select("job_id", "from_stage", "to_stage"))
    return graph.lineage_closure(classified, links)


@query("cat_parameters", CATALOG_SQL + r"""
    SELECT DISTINCT job_id, name, stage_id FROM (SELECT job_id, stage_id,
      unnest(regexp_extract_all(concat_ws(' ', p_sql, p_file), '\$\{([^}]+)\}', 1)) AS name FROM stages)""")
def cat_parameters(t: Tables):
    return describe.parameters(Catalog(t).stages)


@query("cat_connections", CATALOG_SQL + """
    SELECT job_id, p_conn AS connection_name, arg_min(stage_type, stage_id) AS stage_type, count(*) AS uses
    FROM stages WHERE p_conn IS NOT NULL GROUP BY ALL""")
def cat_connections(t: Tables):
    return describe.connections(describe.normalize_stages(Catalog(t).stages))


@query("cat_connection_uses", CATALOG_SQL + " SELECT job_id, p_conn AS connection_name, stage_id FROM stages WHERE p_conn IS NOT NULL")
def cat_connection_uses(t: Tables):
    return describe.connection_uses(describe.normalize_stages(Catalog(t).stages))


CHECKLIST_SQL = CATALOG_SQL + """,
    checklist AS (
      SELECT job_id, 'source' AS item, stage_id, NULL AS detail FROM stages WHERE category = 'source' OR input_pins = 0
      UNION ALL SELECT job_id, 'sink', stage_id, NULL FROM stages WHERE category = 'target' OR output_pins = 0
      UNION ALL SELECT job_id, 'join', stage_id, coalesce(p_jtype, 'unknown') FROM stages WHERE stage_type IN ('PxJoin', 'PxLookup')
      UNION ALL SELECT job_id, 'branch', stage_id, CAST(output_pins AS VARCHAR) FROM stages WHERE output_pins > 1
      UNION ALL SELECT job_id, 'exception_sink', stage_id, NULL FROM stages WHERE stage_id LIKE 'EXCEPTION%' OR stage_type = 'PxPeekStage'
      UNION ALL SELECT job_id, 'source_sql', stage_id, p_sql FROM stages WHERE p_sql IS NOT NULL
      UNION ALL SELECT job_id, 'computed_column', stage_id, output_column FROM derivations)"""


def _checklist(cat: Catalog) -> DataFrame:
    return describe.checklist(describe.normalize_stages(cat.stages), cat.derivations)


@query("cat_checklist", CHECKLIST_SQL + " SELECT * FROM checklist")
def cat_checklist(t: Tables):
    return _checklist(Catalog(t))


@query("cat_structural_diff", CHECKLIST_SQL + """,
    impl AS (SELECT job_id, item, CASE WHEN item = 'sink' AND stage_id LIKE 'EXCEPTION%' THEN stage_id || '_B' ELSE stage_id END AS stage_id,
                    CASE WHEN item = 'join' AND detail = 'LeftOuter' THEN 'Inner' ELSE detail END AS detail
             FROM checklist WHERE NOT (item = 'computed_column' AND detail = 'D_4')),
    a AS (SELECT job_id, item, stage_id, CASE WHEN item = 'computed_column' THEN detail ELSE '' END AS part, max(detail) AS d FROM checklist GROUP BY ALL),
    b AS (SELECT job_id, item, stage_id, CASE WHEN item = 'computed_column' THEN detail ELSE '' END AS part, max(detail) AS d FROM impl GROUP BY ALL)
    SELECT coalesce(a.job_id, b.job_id) AS job_id, coalesce(a.item, b.item) AS item, coalesce(a.stage_id, b.stage_id) AS stage_id,
           coalesce(a.part, b.part) AS part,
           CASE WHEN b.job_id IS NULL THEN 'missing' WHEN a.job_id IS NULL THEN 'extra' WHEN a.d IS DISTINCT FROM b.d THEN 'wrong' ELSE 'ok' END AS verdict
    FROM a FULL JOIN b ON a.job_id = b.job_id AND a.item = b.item AND a.stage_id = b.stage_id AND a.part = b.part""")
def cat_structural_diff(t: Tables):
    """Against an implementation with renamed exception sinks, inner for left joins and a lost column."""
    expected = store(_checklist(Catalog(t, shared=True)), "checklist")
    declared = expected.where("NOT (item = 'computed_column' AND detail = 'D_4')").select(
        "job_id", "item",
        F.when((c("item") == "sink") & c("stage_id").startswith("EXCEPTION"), F.concat("stage_id", F.lit("_B")))
        .otherwise(c("stage_id")).alias("stage_id"),
        F.when((c("item") == "join") & (c("detail") == "LeftOuter"), "Inner").otherwise(c("detail")).alias("detail"),
    )
    return describe.structural_diff(expected, declared)


# --- column lineage ----------------------------------------------------------------------------

LINEAGE_SQL = REFS_SQL + r""",
    held AS (SELECT job_id, stage_id, name AS column_name FROM columns UNION SELECT job_id, stage_id, output_column FROM derivations),
    nodes AS (SELECT h.job_id, h.stage_id, h.column_name,
        CASE WHEN category = 'source' THEN 'SourceColumn' WHEN category = 'target' THEN 'TargetColumn'
             WHEN EXISTS (SELECT 1 FROM derivations d WHERE d.job_id = h.job_id AND d.stage_id = h.stage_id AND d.output_column = h.column_name)
             THEN 'DerivedColumn' ELSE 'Intermediate' END AS node_type
      FROM held h JOIN stages s ON s.job_id = h.job_id AND s.stage_id = h.stage_id),
    wanted AS (
      SELECT r.job_id, r.stage_id, r.output_column AS column_name, d.expression AS e, r.ref FROM refs r
        JOIN derivations d ON d.job_id = r.job_id AND d.stage_id = r.stage_id AND d.output_column = r.output_column
      UNION ALL SELECT job_id, stage_id, name, NULL, name FROM columns k WHERE NOT EXISTS
        (SELECT 1 FROM derivations d WHERE d.job_id = k.job_id AND d.stage_id = k.stage_id AND d.output_column = k.name)),
    edges AS (
      SELECT w.job_id, l.from_stage, w.ref AS from_column, w.stage_id, w.column_name,
        min(CASE category WHEN 'aggregation' THEN 'Aggregation' WHEN 'lookup' THEN 'Lookup' WHEN 'join' THEN 'Join' WHEN 'filter' THEN 'Filter'
          ELSE CASE WHEN e IS NULL THEN 'PassThrough' WHEN regexp_matches(e, '^\s*[A-Za-z_]\w*\s*$') THEN 'Rename'
                    WHEN regexp_matches(e, '^\s*(Char|Str|Num)\(') THEN 'Cast' ELSE 'Derivation' END END) AS edge_type,
        min(CASE WHEN e IS NULL THEN 1.00 ELSE greatest(0.50, 1.00 - 0.05 * len(regexp_extract_all(e, '\w\('))
             - 0.10 * len(regexp_extract_all(lower(e), 'if '))) END::DECIMAL(4,2)) AS confidence
      FROM wanted w JOIN (SELECT DISTINCT job_id, from_stage, to_stage FROM links) l ON l.job_id = w.job_id AND l.to_stage = w.stage_id
      JOIN held h ON h.job_id = w.job_id AND h.stage_id = l.from_stage AND h.column_name = w.ref
      JOIN stages s ON s.job_id = w.job_id AND s.stage_id = w.stage_id GROUP BY ALL)"""


@query("cat_column_lineage", LINEAGE_SQL + """
    SELECT job_id, from_stage, from_column, stage_id, column_name, edge_type, CAST(confidence AS DOUBLE) AS confidence FROM edges""")
def cat_column_lineage(t: Tables):
    cat = Catalog(t, shared=True)
    return lineage.edges(cat.columns, cat.derivations, cat.stages, cat.links).withColumn(
        "confidence", c("confidence").cast("double"))


@query("cat_column_nodes", LINEAGE_SQL + " SELECT * FROM nodes")
def cat_column_nodes(t: Tables):
    cat = Catalog(t, shared=True)
    return lineage.nodes(cat.columns, cat.derivations, cat.stages)


@query("cat_column_lineage_e2e", LINEAGE_SQL + """,
    walk AS (SELECT job_id, stage_id AS ss, column_name AS sc, stage_id, column_name, stage_id AS path, 1.00::DECIMAL(4,2) AS conf, 0 AS hops
             FROM nodes WHERE node_type = 'SourceColumn'
      UNION ALL SELECT w.job_id, w.ss, w.sc, e.stage_id, e.column_name, w.path || '/' || e.stage_id, least(w.conf, e.confidence), w.hops + 1
             FROM walk w JOIN edges e ON e.job_id = w.job_id AND e.from_stage = w.stage_id AND e.from_column = w.column_name)
    SELECT w.job_id, ss AS source_stage, sc AS source_column, w.stage_id AS target_stage, w.column_name AS target_column,
           min(hops) AS hops, arg_min(path, (hops, path)) AS path, CAST(min(conf) AS DOUBLE) AS confidence
    FROM walk w JOIN nodes n ON n.job_id = w.job_id AND n.stage_id = w.stage_id AND n.column_name = w.column_name AND n.node_type = 'TargetColumn'
    WHERE hops > 0 GROUP BY ALL""")
def cat_column_lineage_e2e(t: Tables):
    cat = Catalog(t, shared=True)
    held = store(lineage.held_columns(cat.columns, cat.derivations, cat.stages), "held-columns")
    nodes = lineage.nodes(cat.columns, cat.derivations, cat.stages, held)
    edges = lineage.edges(cat.columns, cat.derivations, cat.stages, cat.links, held)
    return lineage.end_to_end(nodes, edges).withColumn("confidence", c("confidence").cast("double"))


METADATA_SQL = f"""
    metadata AS (SELECT k.job_id, k.stage_id, k.ord, k.name, {case_map('sql_type_code', SQL_TYPES, "'VARCHAR'")} AS sql_type,
      {case_map('sql_type_code', SPARK_TYPES, "'string'")} AS spark_type, nullable,
      CASE WHEN list_contains(list_transform(string_split(concat_ws(',', p_jkey, p_lkey), ','), lambda x: trim(x)), k.name) THEN 1 ELSE 0 END AS is_key,
      CASE WHEN d.expression IS NOT NULL THEN 1 ELSE 0 END AS is_derived, d.expression AS derivation_expression
    FROM columns k JOIN stages s ON s.job_id = k.job_id AND s.stage_id = k.stage_id
    LEFT JOIN (SELECT job_id, stage_id, output_column, arg_min(expression, ord) AS expression FROM derivations GROUP BY ALL) d
      ON d.job_id = k.job_id AND d.stage_id = k.stage_id AND d.output_column = k.name)"""


@query("cat_metadata", CATALOG_SQL + "," + METADATA_SQL + " SELECT * FROM metadata")
def cat_metadata(t: Tables):
    cat = Catalog(t, shared=True)
    return describe.column_metadata(cat.columns, describe.normalize_stages(cat.stages), cat.derivations)
