"""Stream results equal batch results, also when the input comes in several batches."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stagecraft.streaming import drain, events as ev

SCHEMA = ("event_id bigint, ts timestamp, job_id bigint, event string, stage_id string, status string, level string, score int")
START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def event(i, seconds, job=1, kind="log", stage=None, status=None, level=None, score=None):
    return (i, START + dt.timedelta(seconds=seconds), job, kind, stage, status, level, score)


@pytest.fixture
def arriving(spark, tmp_path):
    """Each list of events becomes one file; the stream reads a file per batch."""
    def build(*files):
        path = str(tmp_path / "in")
        batches = [spark.createDataFrame(f, SCHEMA).coalesce(1) for f in files]
        for b in batches:
            b.write.mode("append").parquet(path)
        return ev.read_stream(spark, path, batches[0].schema, 1), spark.read.parquet(path)
    return build


RUN = [
    [event(1, 0, kind="stage", stage="A", status="active"), event(2, 10, kind="stage", stage="A", status="done"), event(3, 5, kind="stage", stage="B", status="active")],
    [event(4, 20, kind="stage", stage="A", status="active"), event(5, 32.54, kind="stage", stage="A", status="error"), event(6, 40, kind="stage", stage="A", status="active")],
    [event(7, 50, kind="stage", stage="C", status="done")],
]


def test_stage_durations(arriving):
    stream, batch = arriving(*RUN)
    want = {(r["job_id"], r["stage_id"]): (r["status"], r["started_at"], r["completed_at"], r["duration"]) for r in ev.stage_durations(batch).collect()}
    assert want[1, "A"][0] == "active" and want[1, "A"][3] == 12.5
    assert want[1, "B"][2] is None and want[1, "C"][1] is None and want[1, "C"][3] is None
    out = drain.drain_updates(ev.stage_durations_stream(stream), ["job_id", "stage_id"])
    out = out.withColumn("duration", F.when(~F.isnan("duration"), F.col("duration")))
    got = {(r["job_id"], r["stage_id"]): (r["status"], r["started_at"], r["completed_at"], r["duration"]) for r in out.collect()}
    assert got == want


def test_an_end_that_comes_after_later_starts(arriving):
    stream, batch = arriving(
        [event(1, 5, kind="stage", stage="A", status="active"), event(2, 20, kind="stage", stage="A", status="active")],
        [event(3, 10, kind="stage", stage="A", status="done")])
    assert ev.stage_durations(batch).first()["duration"] == 5.0
    out = drain.drain_updates(ev.stage_durations_stream(stream), ["job_id", "stage_id"])
    assert [(r["duration"], r["started_at"]) for r in out.collect()] == [(5.0, ev.stage_durations(batch).first()["started_at"])]


def test_a_file_and_a_folder_are_read_alike(spark, tmp_path):
    rows = spark.createDataFrame([event(i, i, level="info") for i in range(50)], SCHEMA)
    for name, parts in (("one", 1), ("many", 5)):
        rows.repartition(parts).write.parquet(str(tmp_path / name / "events.parquet"))
        out = drain.drain_updates(ev.job_state(ev.read_stream(spark, str(tmp_path / name / "events.parquet"), rows.schema)), ["job_id"])
        assert out.agg(F.sum("logs")).first()[0] == 50


def test_job_state(arriving, collected):
    stream, batch = arriving(
        [event(1, 0, kind="human_review"), event(2, 1, kind="stage", stage="A", status="active")],
        [event(3, 2, kind="failed"), event(4, 1.5, kind="completed"), event(5, 9, job=2)])
    out = drain.drain_updates(ev.job_state(stream), ["job_id"])
    assert collected(out) == collected(ev.job_state(batch))
    assert {r["job_id"]: r["status"] for r in out.collect()} == {1: "failed", 2: "processing"}


HOUR = 3600


def review(i, seconds, word=None, **more):
    return event(i, seconds, kind="decision" if word else "human_review", status=word, **more)


PROGRESS = [
    [review(1, 0), review(2, 10, "proceed"), review(3, 20), event(4, 21, kind="log"),
     review(5, 0, job=2), review(6, 5, "stop", job=2), review(7, 0, job=3), review(8, 5, "later", job=3),
     event(9, 1, job=4, kind="classification", level="", score=0), event(10, 0, job=6, kind="stage", stage="A", status="active")],
    [review(11, 30, job=2), event(12, 9, job=4, kind="classification", level="High", score=70),
     review(13, 50, "stop", job=5), review(14, 40, "proceed", job=5), event(15, 60, job=5, kind="log"),
     event(16, 10, job=6, kind="completed"), review(17, 10, job=6)],
]


def test_job_progress(arriving, collected):
    stream, batch = arriving(*PROGRESS)
    want = {r["job_id"]: r for r in ev.job_progress(batch).collect()}
    assert {j: (r["status"], r["decision"]) for j, r in want.items()} == {
        1: ("processing", "proceed"), 2: ("human_review", None), 3: ("human_review", None), 4: ("processing", None),
        5: ("failed", "stop"), 6: ("human_review", None)}
    assert (want[4]["complexity"], want[4]["confidence"]) == ("High", 70.0)
    assert (want[1]["logs"], want[6]["current_stage"]) == (1, "A")
    out = drain.drain_updates(ev.job_progress_stream(stream), ["job_id"])
    assert collected(out.withColumn("confidence", F.when(~F.isnan("confidence"), F.col("confidence")))) == collected(ev.job_progress(batch))


def test_a_classification_without_details(spark):
    only = spark.createDataFrame([event(1, 0, kind="classification")], SCHEMA)
    assert ev.job_progress(only).select("complexity", "confidence").first() == ("Medium", 85.0)
    assert ev.job_progress(only.limit(0)).count() == 0


def state_rows(stream, path, mode):
    """Drain a stream and return the state rows of its last trigger."""
    query = (stream.writeStream.outputMode(mode).foreachBatch(lambda b, i: b.write.mode("append").parquet(path + "/out"))
             .option("checkpointLocation", path + "/state").trigger(availableNow=True).start())
    query.awaitTermination()
    return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]][-1]


def test_state_ends(spark, arriving, tmp_path):
    after = [event(90, 40 * HOUR, job=9), event(91, 60 * HOUR, job=8), event(92, 70 * HOUR, job=8), event(93, 71 * HOUR, job=9), event(94, 71 * HOUR, job=9)]
    stream, _ = arriving(PROGRESS[0], *[[e] for e in after])
    kept = state_rows(ev.job_progress_stream(stream, idle_ms=HOUR * 1000), str(tmp_path / "a"), "update")
    assert kept == 4  # any and log of jobs 8 and 9
    rows = spark.read.parquet(str(tmp_path / "a/out"))
    assert rows.where("job_id = 9").agg(F.max("logs")).first()[0] == 2  # closed after 41 hours, begun anew at 71


def test_waits_keep_rows_of_bounded_size(spark, arriving, tmp_path, collected):
    asked = [event(i, i % 290, kind="human_review") for i in range(2500)]
    decided = [event(10_000 + i, 3 * i, kind="decision") for i in range(60)]
    marker = [[event(20_000 + i, (50 + i) * HOUR, job=7, kind="decision")] for i in range(3)]
    stream, batch = arriving(asked[:1700], decided, asked[1700:], *marker)
    out = drain.drain_append(ev.review_outcomes_stream(stream, chunk=100))
    want = ev.review_outcomes(batch)
    assert collected(out) == collected(want) and want.count() == 2500
    assert {r["outcome"] for r in want.select("outcome").distinct().collect()} == {"decided", "timeout"}


def test_retries_in_the_stream(arriving, collected):
    tries = {1: [50, 95, 20], 2: [1, 2, 3, 4, 99], 3: [1, 2, 3, 90], 4: [10, None], 5: [91]}
    rows = [event(10 * j + i, 60 * i, job=j, kind="validation_review", score=v) for j, scores in tries.items() for i, v in enumerate(scores)]
    late_first = rows[::-2], rows[-2::-2]
    stream, batch = arriving(*[list(f) for f in late_first])
    out = drain.drain_updates(ev.retry_outcomes_stream(stream), ["job_id"])
    assert collected(out) == collected(ev.retry_outcomes(batch))
    assert {r["job_id"]: (r["attempt"], r["outcome"]) for r in out.collect()} == {
        1: (2, "passed"), 2: (4, "retries_exhausted"), 3: (4, "passed"), 4: (2, "open"), 5: (1, "passed")}


def test_a_job_is_forgotten(spark, arriving, tmp_path):
    stream, _ = arriving([event(1, 0, kind="validation_review", score=95)], *[[event(9 + i, (i + 2) * HOUR, job=2, kind="validation_review", score=1)] for i in range(3)])
    assert state_rows(ev.retry_outcomes_stream(stream, idle_ms=HOUR * 1000 // 2), str(tmp_path / "a"), "update") <= 2


def test_log_levels_over_batches(arriving, collected):
    stream, batch = arriving([event(i, i * 600, level="info") for i in range(8)], [event(9, 4000, level="error")])
    out = drain.drain_updates(ev.log_levels(stream), ["window_start", "level"])
    assert collected(out) == collected(ev.log_levels(batch))


def test_late_events_are_dropped(arriving):
    stream, _ = arriving([event(1, 50_000, level="info")], [event(2, 60_000, level="info")], [event(3, 0, level="info")])
    out = drain.drain_updates(ev.log_levels(stream), ["window_start", "level"])
    assert out.agg(F.sum("n")).first()[0] == 2


def test_review_wait(spark):
    day = 86_400
    rows = [
        event(1, 0, kind="human_review"), event(2, 1800, kind="decision"),
        event(3, 5000, kind="human_review"), event(4, 6801, kind="decision"),
        event(5, day - 10, kind="human_review"), event(6, day + 10, kind="decision"), event(7, day + 20, kind="decision"),
        event(8, 2 * day, job=2, kind="human_review"), event(9, 2 * day, job=3, kind="decision"),
    ]
    got = ev.review_outcomes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["request_id"]: r["outcome"] for r in got} == {1: "decided", 3: "timeout", 5: "decided", 8: "timeout"}
    at = {r["request_id"]: r["decided_at"] for r in got}
    assert at[5].timestamp() == (START + dt.timedelta(seconds=day + 10)).timestamp()


def test_retries(spark):
    tries = [("pass", [50, 95, 20]), ("late", [1, 2, 3, 4, 99]), ("fourth", [1, 2, 3, 90]), ("open", [10, 20])]
    rows = [(j, START + dt.timedelta(seconds=i), i, s) for j, scores in tries for i, s in enumerate(scores)]
    got = ev.retry_outcomes(spark.createDataFrame(rows, "job_id string, ts timestamp, event_id bigint, score int")).collect()
    assert {r["job_id"]: (r["attempt"], r["score"], r["outcome"]) for r in got} == {
        "pass": (2, 95, "passed"), "late": (4, 4, "retries_exhausted"), "fourth": (4, 90, "passed"), "open": (2, 20, "open")}


def test_a_decision_is_held_in_two_review_cells(spark):
    """Each cell is a state of its own; with the cells of 300 seconds a decision was in seven."""
    import inspect

    width = inspect.signature(ev.review_outcomes_stream).parameters["cell_seconds"].default
    mark = spark.sql("SELECT TIMESTAMP '2024-01-01 10:10:00' AS ts, true AS is_decision")
    assert mark.select(F.size(ev._spread(mark, ev.REVIEW_SECONDS, width))).first()[0] == 2
