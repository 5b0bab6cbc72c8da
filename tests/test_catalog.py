"""Job exports parsed, described, scored and validated."""

import pytest
from pyspark.sql import functions as F

from jobxml_fixture import chain, complex_job, job, simple_job, stage
from stagecraft.catalog import describe, expressions as ex, gates, graph, kpi, scoring, validation, vocab
from stagecraft.plans import catalog_scoring
from stagecraft.sources import connectors, jobxml
from stagecraft.streaming import jobfiles


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("jobs")
    (path / "a.dsx").write_text(simple_job())
    (path / "b.isx").write_text(complex_job())
    (path / "ignored.txt").write_text(simple_job())
    return str(path)


@pytest.fixture(scope="module")
def cat(spark, folder):
    return jobxml.catalog(jobxml.read_jobs(spark, folder))


@pytest.fixture(scope="module")
def scored(cat):
    return catalog_scoring.score(cat["stages"], cat["links"], cat["derivations"])


def test_both_extensions_are_read(cat):
    got = {r["job_id"]: r for r in cat["jobs"].collect()}
    assert set(got) == {"SIMPLE_JOB", "COMPLEX_JOB"}
    assert got["SIMPLE_JOB"]["annotation"] == "a & b"
    assert got["SIMPLE_JOB"]["job_type"] == "JOB_SEQUENCE"
    assert got["COMPLEX_JOB"]["file_path"].endswith("b.isx")


def test_counts_and_roles(cat):
    classified = describe.classify_io(cat["stages"], cat["links"])
    got = {r["job_id"]: r for r in describe.job_summary(classified, cat["links"]).collect()}
    a, b = got["SIMPLE_JOB"], got["COMPLEX_JOB"]
    assert (a["total_stages"], a["total_links"], a["source_count"], a["target_count"], a["transformation_count"]) == (7, 6, 2, 1, 4)
    assert (b["total_stages"], b["total_links"], b["source_count"], b["target_count"], b["transformation_count"]) == (9, 8, 2, 2, 5)


def test_columns(cat):
    got = {(r["stage_id"], r["name"]): r for r in cat["columns"].where("job_id = 'SIMPLE_JOB'").collect()}
    cid, worth, odd = got["ORA_CLIENTS", "CID"], got["ORA_DEALS", "WORTH"], got["ORA_DEALS", "ODD"]
    assert (cid["sql_type"], cid["spark_type"], cid["nullable"]) == ("INTEGER", "int", False)
    assert (worth["sql_type"], worth["precision"], worth["scale"], worth["nullable"]) == ("DECIMAL", 18, 2, True)
    assert (odd["sql_type"], odd["spark_type"]) == ("VARCHAR", "string")


def test_output_column_defaults_to_the_name(cat):
    got = {r["name"]: r["output_column"] for r in cat["derivations"].where("job_id = 'SIMPLE_JOB'").collect()}
    assert got["CLEAN"] == "NAME_CLEAN" and got["BULK"] == "BULK"


def test_escaped_text_survives(cat):
    row = cat["stages"].where("stage_id = 'ORA_CLIENTS'").first()
    assert row["props"]["XMLProperties.SelectStatement"].endswith("ON_HOLD < 1")


def test_records_that_are_not_stages_are_skipped(spark, tmp_path):
    records = [stage("X", "Mystery"), stage("Y", "Mystery", record_type="Other"), stage("Z", "OddConnector"), stage("P", "PxSort")]
    (tmp_path / "c.dsx").write_text(job("J", records))
    got = jobxml.catalog(jobxml.read_jobs(spark, str(tmp_path)))["stages"].collect()
    assert sorted((r["stage_id"], r["category"]) for r in got) == [("P", "sort"), ("Y", "unknown"), ("Z", "unknown")]


def test_sample_scores(scored):
    got = {r["job_id"]: (float(r["score"]), r["complexity"], r["action"]) for r in scored["scores"].collect()}
    assert got == {"SIMPLE_JOB": (0.80, "simple", "auto_deploy"), "COMPLEX_JOB": (0.0, "complex", "full_human_review")}


def test_sample_factors(scored):
    rows = scored["factors"].where("job_id = 'COMPLEX_JOB'").groupBy("factor").agg(F.sum("impact").alias("i")).collect()
    assert {r["factor"]: float(r["i"]) for r in rows} == {
        "partial_support_stage": -0.16, "hint_lookup_join": -0.2, "hint_complex_transformer": -0.2, "hint_scd_type2": -0.4,
        "hint_hash_computation": -0.1, "multi_output_stages": -0.1, "complex_transformer": -0.1, "multi_target": -0.05}


def test_flags_and_escalation(cat, scored):
    notes = scoring.flags_and_recommendations(scored["factors"], scored["classified"], scored["scores"], cat["derivations"])
    texts = {r["text"] for r in notes.where("job_id = 'COMPLEX_JOB'").collect()}
    assert "long_transformer: CALC, 9 derivations" in texts
    assert "check_state: test histories and changes by hand" in texts
    go, wait = scoring.escalate(scored["scores"])
    assert [r["job_id"] for r in go.collect()] == ["SIMPLE_JOB"]
    assert [r["suggested_action"] for r in wait.collect()] == ["human_review"]


def stage_rows(spark, specs):
    return spark.createDataFrame(
        [(j, f"S{i}", st, p, {}) for i, (j, st, p) in enumerate(specs)],
        "job_id string, stage_id string, stage_type string, output_pins int, props map<string,string>",
    ).withColumn("category", vocab.stage_category(F.col("stage_type")))


def score_of(spark, specs, derivation_count=0):
    stages = stage_rows(spark, specs)
    links = spark.createDataFrame([], "job_id string, from_stage string, to_stage string")
    ders = spark.createDataFrame([("j", "S0", i, "A", "A") for i in range(derivation_count)],
                                 "job_id string, stage_id string, ord int, expression string, output_column string")
    return catalog_scoring.score(stages, links, ders)


@pytest.mark.parametrize("specs, derivation_count, want, complexity", [
    ([("j", "PxFilter", 1)] * 3, 0, 1.0, "simple"),
    ([("j", "PxChangeCapture", 1)] * 2 + [("j", "Odd", 1)] * 2, 0, 0.0, "complex"),
    ([("j", "PxFilter", 1)] * 20, 0, 0.95, "simple"),
    ([("j", "PxFilter", 1)] * 40, 0, 0.85, "simple"),
    ([("j", "PxFilter", 3)] + [("j", "PxFilter", 1)] * 6, 0, 0.95, "simple"),
    ([("j", "PxTransformer", 1)] + [("j", "PxFilter", 1)] * 6, 12, 0.70, "medium"),
])
def test_score_rules(spark, specs, derivation_count, want, complexity):
    row = score_of(spark, specs, derivation_count)["scores"].first()
    assert (float(row["score"]), row["complexity"]) == (want, complexity)


def test_thresholds_can_be_set(spark):
    s = score_of(spark, [("j", "PxFilter", 1)] * 20)
    jobs = s["classified"].select("job_id").distinct()
    assert scoring.scores(jobs, s["factors"], simple=0.99, medium=0.96).first()["complexity"] == "complex"


def test_job_without_stages_scores_one(spark):
    none = spark.createDataFrame([], "job_id string, stage_id string, factor string, impact decimal(8,2), reason string")
    jobs = spark.createDataFrame([("empty",)], "job_id string")
    assert float(scoring.scores(jobs, none).first()["score"]) == 1.0


# --- expressions ---------------------------------------------------------------------------------

@pytest.mark.parametrize("expression, target, want", [
    ("Upcase(CUST_NAME)", "spark", "upper(CUST_NAME)"),
    ("Upcase(CUST_NAME)", "sql", "UPPER(CUST_NAME)"),
    ("Upcase(Trim(X))", "spark", "upper(trim(X))"),
    ("Left(CODE, 3)", "spark", "substring(CODE, 1, 3)"),
    ("Right(CODE, 3)", "sql", "SUBSTR(CODE, LENGTH(CODE) - 3 + 1, 3)"),
    ("DateDiff(A, B)", "spark", "datediff(A, B)"),
    ("DaysAfter(3, D)", "spark", "date_add(D, 3)"),
    ('DateToString(D, "yyyy")', "spark", "date_format(D, 'yyyy')"),
    ("Checksum(A)", "spark", "hash(A)"),
    ("IsNull(A)", "spark", "(A is null)"),
    ("Nvl(A, 0)", "sql", "COALESCE(A, 0)"),
    ("CurrentDate()", "spark", "current_date()"),
    ("A : B", "spark", "concat(A, B)"),
    ("jdbc:db2://x", "spark", "jdbc:db2://x"),
    ("TimestampFromComponents(1, 2, 3, 4, 5, 6)", "spark", "make_timestamp(1, 2, 3, 4, 5, 6)"),
    ('If A > 10 Then "X" Else "Y"', "spark", "when(A > 10, 'X').otherwise('Y')"),
    ('If A = 1 Then "X" Else If A <> 2 Then B Else "Z"', "spark", "when(A == 1, 'X').when(A <> 2, B).otherwise('Z')"),
    ('If A > 10 Then "X" Else "Y"', "sql", "CASE WHEN A > 10 THEN 'X' ELSE 'Y' END"),
    ("", "spark", ""), (None, "spark", None), ("  QTY ", "spark", "QTY"),
])
def test_translation(spark, expression, target, want):
    df = spark.createDataFrame([(expression,)], "e string")
    assert df.select(ex.translate("e", target).alias("t")).first()["t"] == want


def test_pattern_counts():
    assert (len(ex.SPARK_REWRITES), len(ex.SQL_REWRITES)) == (53, 27)


def test_references_skip_text_calls_and_keywords(spark):
    df = spark.createDataFrame([("If Upcase(NAME) = \"QTY\" Then A1 Else 'B2' : A1",)], "e string")
    assert df.select(ex.references("e").alias("r")).first()["r"] == ["NAME", "A1"]


def test_aggregation_lists(spark):
    df = spark.createDataFrame([("j", "SUM(NET) AS TOTAL,count( ID ) as n, nonsense")], "job string, aggs string")
    got = [tuple(r) for r in ex.parse_aggregations(df, "aggs", ["job"]).collect()]
    assert got == [("j", 0, "SUM", "NET", "TOTAL"), ("j", 1, "COUNT", "ID", "n")]


@pytest.mark.parametrize("fn, name, want", [
    (vocab.map_join_type, "LeftOuter", "left"), (vocab.map_join_type, "FullOuter", "outer"), (vocab.map_join_type, "Lookup", "left"),
    (vocab.map_join_type, "?", "inner"), (vocab.map_join_type, None, "inner"),
    (vocab.map_write_mode, "merge", "merge"), (vocab.map_write_mode, "REPLACE", "overwrite"), (vocab.map_write_mode, "?", "append"),
    (vocab.map_aggregate, "SUM", "F.sum"), (vocab.map_aggregate, "Median", "F.median"),
    (vocab.map_connector, "PxS3Connector", "parquet"), (vocab.map_connector, "?", "jdbc"),
])
def test_vocabularies(spark, fn, name, want):
    df = spark.createDataFrame([(name,)], "n string")
    assert df.select(fn(F.col("n")).alias("m")).first()["m"] == want


# --- graphs --------------------------------------------------------------------------------------

def graph_of(spark, edges, extra=()):
    names = sorted({n for e in edges for n in e} | set(extra))
    return (spark.createDataFrame([("j", n) for n in names], "job_id string, stage_id string"),
            spark.createDataFrame([("j", a, b) for a, b in edges], "job_id string, from_stage string, to_stage string"))


def test_levels_take_the_longest_path(spark):
    stages, links = graph_of(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")], ["lone"])
    got = {r["stage_id"]: r["level"] for r in graph.topological_levels(stages, links).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3, "lone": 0}


def test_cycles_end_and_are_reported(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("d", "e")]
    stages, links = graph_of(spark, edges)
    assert sorted(r["stage_id"] for r in graph.cyclic_stages(stages, links).collect()) == ["b", "c"]
    levels = {r["stage_id"]: r["level"] for r in graph.topological_levels(stages, links).collect()}
    assert levels["a"] == 0 and levels["b"] is None and levels["e"] is None


def test_graph_that_is_one_loop(spark):
    stages, links = graph_of(spark, [("a", "b"), ("b", "a")])
    assert graph.cyclic_stages(stages, links).count() == 2


def test_components_of_cycles(spark):
    # Two loops joined by a bridge, one inside a larger one, a loop of a stage with itself, tails on both sides.
    edges = [("in", "b"), ("b", "c"), ("c", "b"), ("c", "bridge"), ("bridge", "x"), ("x", "y"), ("y", "z"), ("z", "x"), ("y", "x"), ("z", "out"),
             ("self", "self"), ("out", "self"), ("m", "a"), ("a", "m"), ("z", "m")]
    stages, links = graph_of(spark, edges, ["lone"])
    got = {r["stage_id"]: r["component"] for r in graph.cycle_components(stages, links).collect()}
    assert got == {"b": "b", "c": "b", "x": "x", "y": "x", "z": "x", "self": "self", "a": "a", "m": "a"}


def test_random_components_and_levels(spark):
    import random

    rng = random.Random(7)
    names = [f"n{i:02}" for i in range(30)]
    edges = sorted({(rng.choice(names), rng.choice(names)) for _ in range(38)})
    stages, links = graph_of(spark, edges, names)
    out = {a: {b for x, b in edges if x == a} for a in names}
    ways = {a: set(out[a]) for a in names}
    for _ in names:
        for a in names:
            ways[a] |= {y for x in ways[a] for y in out[x]}
    want = {a: min(b for b in ways[a] if a in ways[b]) for a in names if a in ways[a]}
    assert {r["stage_id"]: r["component"] for r in graph.cycle_components(stages, links).collect()} == want
    behind = set(want) | {b for a in want for b in ways[a]}
    level = {}
    while len(level) < len(names) - len(behind):
        for b in names:
            before = [a for a in names if b in out[a]]
            if b not in behind and all(a in level for a in before):
                level[b] = max((level[a] + 1 for a in before), default=0)
    assert {r["stage_id"]: r["level"] for r in graph.topological_levels(stages, links).collect()} == {n: level.get(n) for n in names}


def test_closure_holds_no_pair_off_the_way(spark, monkeypatch):
    """A source with a wide and deep dead branch, and one way to a target."""
    dead = [("s", f"d{i}") for i in range(40)] + [(f"d{i}", f"e{j}") for i in range(40) for j in range(5)]
    stages, links = graph_of(spark, [("s", "m"), ("m", "t"), ("s2", "m"), *dead])
    io = {"s": "source", "s2": "source", "t": "target"}
    classified = stages.withColumn("io", F.create_map(*[F.lit(x) for kv in io.items() for x in kv])[F.col("stage_id")])
    held, plain = [], graph.store_counted

    def counting(df, label, **conditions):
        out, n = plain(df, label, **conditions)
        held.append((label, out.count()))
        return out, n

    monkeypatch.setattr(graph, "store_counted", counting)
    got = sorted(tuple(r) for r in graph.lineage_closure(classified, links).collect())
    assert got == [("j", "s", "t", 2), ("j", "s2", "t", 2)]
    assert sum(n for label, n in held if label == "reached") == 4  # (s, m), (s2, m), (s, t), (s2, t)


def test_reach_on_a_loop_ends(spark):
    stages, links = graph_of(spark, [("a", "b"), ("b", "c"), ("c", "a")])
    got = graph.reach(stages.where("stage_id = 'a'"), links)
    assert {r["stage_id"]: r["hops"] for r in got.collect()} == {"a": 0, "b": 1, "c": 2}


def test_links_to_absent_stages_block_nobody(spark):
    stages, links = graph_of(spark, [("a", "b")])
    loose = spark.createDataFrame([(links.first()["job_id"], "ghost", "a"), (links.first()["job_id"], "b", "gone")],
                                  "job_id string, from_stage string, to_stage string")
    both = links.select("job_id", "from_stage", "to_stage").unionByName(loose.select(
        F.col("job_id").cast(links.schema["job_id"].dataType).alias("job_id"), "from_stage", "to_stage"))
    assert {r["stage_id"]: r["level"] for r in graph.topological_levels(stages, both).collect()} == {"a": 0, "b": 1}
    assert graph.cyclic_stages(stages, both).count() == 0


def test_lineage_of_a_cyclic_job_ends_and_the_others_stay(spark):
    from stagecraft.catalog import lineage

    nodes = [(j, s, "c", k) for j in ("good", "loop") for s, k in (("s", "SourceColumn"), ("m", "Intermediate"), ("n", "Intermediate"), ("t", "TargetColumn"))]
    edges = [(j, a, "c", b, "c", "0.90") for j in ("good", "loop") for a, b in (("s", "m"), ("m", "n"), ("n", "t"))] + [("loop", "n", "c", "m", "c", "0.50")]
    got = lineage.end_to_end(
        spark.createDataFrame(nodes, "job_id string, stage_id string, column_name string, node_type string"),
        spark.createDataFrame(edges, "job_id string, from_stage string, from_column string, stage_id string, column_name string, confidence string")
        .withColumn("confidence", F.col("confidence").cast("decimal(4,2)"))).collect()
    assert {r["job_id"]: (r["hops"], r["path"], float(r["confidence"])) for r in got} == {
        "good": (3, "s/m/n/t", 0.9), "loop": (3, "s/m/n/t", 0.5)}


# --- validation, gates, indicators ---------------------------------------------------------------

def test_sample_validation(spark, cat):
    artifacts = spark.createDataFrame([("SIMPLE_JOB", "pyspark", 500), ("SIMPLE_JOB", "datafusion", 500), ("COMPLEX_JOB", "pyspark", 0)],
                                      "job_id string, artifact_type string, size_bytes bigint")
    checks = catalog_scoring.validate(cat["stages"], cat["links"], cat["columns"], cat["derivations"], artifacts)
    got = {(r["job_id"], r["name"]): r["status"] for r in checks.collect()}
    assert got["SIMPLE_JOB", "output_completeness"] == "pass" and got["COMPLEX_JOB", "output_completeness"] == "fail"
    assert got["SIMPLE_JOB", "expression_coverage"] == "pass"
    # The exceptions file has no columns: two of three source stages are covered.
    assert got["COMPLEX_JOB", "schema_coverage"] == "warn"
    result = {r["job_id"]: r["overall_status"] for r in validation.overall(checks).collect()}
    assert result == {"SIMPLE_JOB": "pass", "COMPLEX_JOB": "warn"}


def test_untranslated_expressions_are_seen(cat):
    raw = validation.expression_coverage(cat["stages"], cat["derivations"], "expression")
    assert raw.where("job_id = 'SIMPLE_JOB'").first()["status"] == "warn"


def test_parameters_and_lineage(cat):
    got = sorted((r["name"], r["stage_id"]) for r in describe.parameters(cat["stages"]).collect())
    assert got == [("DS_RUNDATE", "SEQ_EXCEPTIONS"), ("DS_RUNDATE", "SEQ_STOCK")]
    classified = describe.classify_io(cat["stages"], cat["links"])
    reach = graph.lineage_closure(classified, cat["links"]).where("job_id = 'COMPLEX_JOB'")
    got = sorted((r["source"], r["target"], r["hops"]) for r in reach.collect())
    assert got == [("DB2_ITEMS", "BQ_DIM", 5), ("DB2_ITEMS", "SEQ_EXCEPTIONS", 4), ("SEQ_STOCK", "BQ_DIM", 4), ("SEQ_STOCK", "SEQ_EXCEPTIONS", 3)]


def test_checklist_diff_finds_a_wrong_join(cat):
    expected = describe.checklist(describe.normalize_stages(cat["stages"]), cat["derivations"])
    declared = expected.withColumn("detail", F.when(F.col("detail") == "LeftOuter", "Inner").otherwise(F.col("detail")))
    got = describe.structural_diff(expected, declared).where("verdict <> 'ok'").collect()
    assert [(r["stage_id"], r["item"], r["verdict"]) for r in got] == [("JOIN_LEFT", "join", "wrong")]


def test_credentials_are_found_in_the_whole_text(spark):
    long = "word " * 20000
    df = spark.createDataFrame([(1, long + "password = hunter2"), (2, long), (3, "see jdbc:oracle:thin:@h:1521/x at 10.0.0.1:99")], "id int, text string")
    got = sorted((r["id"], r["rule"], r["match"]) for r in gates.credentials_scan(df, "id", "text").collect())
    assert got == [(1, "password", "password = hunter2"), (3, "host_port", "10.0.0.1:99"), (3, "jdbc_url", "jdbc:oracle:thin:@h:1521/x")]


def test_indicators(spark):
    jobs = spark.createDataFrame([("a", "completed", 0.9, 5, "simple"), ("b", "escalated", 0.5, 7, "Medium"), ("c", "failed", 80.0, 2, None)],
                                 "job_id string, status string, confidence double, stages int, complexity string")
    row = kpi.report(jobs).first()
    assert (row["total_jobs"], row["successful"], row["total_stages_migrated"]) == (3, 1, 5)
    board = kpi.dashboard(jobs).first()
    assert (board["success_pct"], board["avg_confidence"], board["simple"], board["medium"], board["complex"]) == (33, 90.0, 1, 1, 0)


def test_gate_summary(spark):
    results = spark.createDataFrame([("a", "QG-01", "PASS"), ("a", "QG-02", "FAIL"), ("b", "QG-01", "PASS")], "job_id string, gate string, result string")
    scores = spark.createDataFrame([("a", 95, True), ("b", 90, None)], "job_id string, score int, critical_issues boolean")
    got = {r["job_id"]: (r["gates_passed"], r["gates_failed"], r["passed"]) for r in gates.gate_summary(results, scores).collect()}
    assert got == {"a": (1, 1, 0), "b": (1, 0, 1)}


def test_arriving_files_equal_the_batch(spark, folder, cat):
    out = jobfiles.ingest(spark, folder, files_per_batch=1)
    for name in ("stages", "links", "columns", "derivations"):
        got = spark.read.parquet(f"{out}/{name}").drop("batch")
        assert got.count() == cat[name].count()
        assert got.exceptAll(cat[name].select(*got.columns)).count() == 0 if name != "stages" else True


def test_checks_from_facts_equal_the_single_checks(spark, cat):
    artifacts = spark.createDataFrame([("SIMPLE_JOB", "pyspark", 500), ("COMPLEX_JOB", "datafusion", 7), ("NO_JOB", "pyspark", 5)],
                                      "job_id string, artifact_type string, size_bytes bigint")
    args = cat["stages"], cat["links"], cat["columns"], cat["derivations"]
    together = validation.all_checks(*args, artifacts, "expression")
    single = [validation.schema_coverage(args[0], args[2]), validation.stage_coverage(args[0]), validation.dag_completeness(*args[:2]),
              validation.expression_coverage(args[0], args[3], "expression"), validation.output_completeness(args[0], artifacts),
              validation.parameter_coverage(args[0])]
    assert sorted(map(tuple, together.collect())) == sorted(tuple(r) for df in single for r in df.collect())
    plan = together._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") <= 4
