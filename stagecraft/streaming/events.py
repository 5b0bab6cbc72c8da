"""Run events of jobs: folded into stage durations, job state, reviews, retries and log counts.

Events: (event_id, ts, job_id, event, stage_id, status, level, score).  Every function takes a batch
or a streaming DataFrame unless it says otherwise, so the stream result can be held against the
batch result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stagecraft.operators.cells import width_cells

# Review wait, retries, passing score, log levels.
REVIEW_SECONDS = 1800
MAX_RETRIES = 3
PASS_SCORE = 90
LEVELS = ("info", "success", "warning", "error")
TERMINAL = ("done", "error")
# What a reviewer may decide, which of it lets a job go on, and a classification without details.
DECISIONS = ("proceed", "comment", "stop")
GO_ON = ("proceed", "comment")
COMPLEXITY, CONFIDENCE = "Medium", 85

WATERMARK = "10 minutes"


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1000) -> DataFrame:
    """A table's own path, a file or a folder of part files, as a stream; the batch size bounds one trigger.

    A stream source is a folder, so a single file is its folder with the file's name as the filter.
    """
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if store.getFileStatus(place).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", place.getName()).parquet(place.getParent().toString())


def _seconds(ts: Column) -> Column:
    return F.unix_micros(ts) / F.lit(1_000_000)


def with_processor(stream: DataFrame, processor: StatefulProcessor, keys: list[str], schema, mode: str) -> DataFrame:
    """A keyed processor with event-time timers.  Its map and list state needs the RocksDB store, which also keeps
    state on disk instead of in the executors' heap."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return stream.groupBy(*keys).transformWithStateInPandas(processor, schema, mode, "EventTime")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# --- stage durations -------------------------------------------------------------------------

def stage_durations(events: DataFrame) -> DataFrame:
    """Batch: last start, last end and its duration per (job, stage).

    The duration runs from the last start before the last end.  Two mergeable aggregates; the
    second reads only start events.
    """
    key = ["job_id", "stage_id"]
    marks = events.where("event = 'stage'")
    ended = F.col("status").isin(*TERMINAL)
    last = marks.groupBy(*key).agg(
        F.max_by("status", F.struct("ts", "event_id")).alias("status"),
        F.max(F.when(F.col("status") == "active", F.col("ts"))).alias("started_at"),
        F.max(F.when(ended, F.col("ts"))).alias("completed_at"),
    )
    ends = last.where("completed_at IS NOT NULL").select(*key, F.col("completed_at").alias("_end"))
    begun = (
        marks.where("status = 'active'").select(*key, "ts").join(ends, key)
        .where(F.col("ts") <= F.col("_end")).groupBy(*key).agg(F.max("ts").alias("_begin"))
    )
    took = F.round(_seconds(F.col("completed_at")) - _seconds(F.col("_begin")), 1)
    return last.join(begun, key, "left").select(
        *key, "status", "started_at", "completed_at", took.alias("duration")
    )


DURATION_SCHEMA = (
    "job_id bigint, stage_id string, status string, started_at timestamp, completed_at timestamp, duration double"
)


IDLE_MS = 7 * 24 * 3600 * 1000  # a stage without events for so long is closed and its state removed


def _update_duration(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Folds one trigger's events of one (job, stage).

    An end may arrive after later starts, so the starts a late end can still follow are kept: those the
    watermark has not passed, and the newest before it.  Event time closes the state.
    """
    if state.hasTimedOut:
        state.remove()
        return
    status, at, start, end, begin, starts = state.get if state.exists else (None, -1, None, None, None, [])
    opened = np.array(starts, dtype=np.int64)
    for pdf in batches:
        t, kind = pdf["micros"].to_numpy(), pdf["status"].to_numpy()
        newest = int(t.argmax())
        if t[newest] >= at:
            at, status = int(t[newest]), kind[newest]
        active, ended = t[kind == "active"], t[(kind == "done") | (kind == "error")]
        if active.size:
            start = int(active.max()) if start is None else max(start, int(active.max()))
        if ended.size:
            end = int(ended.max()) if end is None else max(end, int(ended.max()))
        opened = np.unique(np.concatenate([opened, active]))
    if end is not None:
        before = opened[opened <= end]
        if before.size:
            begin = int(before.max()) if begin is None else max(begin, int(before.max()))
        opened = opened[opened > end]
    passed = opened[opened < state.getCurrentWatermarkMs() * 1000]
    if passed.size > 1:
        opened = opened[opened >= passed[-1]]
    state.update((status, at, start, end, begin, opened.tolist()))
    state.setTimeoutTimestamp(max(at // 1000, state.getCurrentWatermarkMs()) + IDLE_MS)

    def stamp(v):
        return pd.NaT if v is None else pd.Timestamp(v, unit="us", tz="UTC")

    took = np.nan if end is None or begin is None else round((end - begin) / 1e6, 1)
    yield pd.DataFrame({
        "job_id": [key[0]], "stage_id": [key[1]], "status": [status],
        "started_at": [stamp(start)], "completed_at": [stamp(end)], "duration": [took],
    })


def stage_durations_stream(events: DataFrame, delay: str = WATERMARK) -> DataFrame:
    """Stream: the same per (job, stage); an end may come up to ``delay`` after later starts."""
    marks = events.where("event = 'stage'").withWatermark("ts", delay).select(
        "job_id", "stage_id", "status", "ts", F.unix_micros("ts").alias("micros")
    )
    return marks.groupBy("job_id", "stage_id").applyInPandasWithState(
        _update_duration, DURATION_SCHEMA,
        "status string, at bigint, start bigint, end bigint, begin bigint, starts array<bigint>",
        "update", GroupStateTimeout.EventTimeTimeout,
    )


# --- job state -------------------------------------------------------------------------------

def job_state(events: DataFrame) -> DataFrame:
    """Last state per job.  Only mergeable aggregates, so partial sums run before the shuffle."""
    order = F.struct("ts", "event_id")
    moves = F.col("event").isin("human_review", "validation_review", "completed", "failed")

    def last(value, cond: Column) -> Column:
        return F.max_by(value, F.when(cond, order))

    return events.groupBy("job_id").agg(
        F.coalesce(last(F.col("event"), moves), F.lit("processing")).alias("status"),
        last(F.col("stage_id"), (F.col("event") == "stage") & (F.col("status") == "active")).alias("current_stage"),
        F.count(F.when(F.col("event") == "log", 1)).alias("logs"),
        F.count(F.when(F.col("event") == "failed", 1)).alias("failures"),
        F.max("ts").alias("updated_at"),
    )


# --- job progress: the effects of classifications and decisions ------------------------------------

FACT = "job_id bigint, ts timestamp, fact string, event_id bigint, text string, number double, n bigint"


def _facts(events: DataFrame) -> DataFrame:
    """What an event says about its job: rows (job_id, ts, fact, event_id, text, number, n).

    A job's state is the newest row and the count of each fact, so facts combine in any order and in any split.
    """
    kind = F.col("event")
    decided = (kind == "decision") & F.col("status").isin(*DECISIONS)
    moved = kind.isin("validation_review", "completed", "failed")

    def fact(when: Column, name: str, text=None, number=None) -> Column:
        return F.when(when, F.struct(
            F.lit(name).alias("fact"), (F.lit(None) if text is None else text).cast("string").alias("text"),
            (F.lit(None) if number is None else number).cast("double").alias("number")))

    said = F.array_compact(F.array(
        fact(F.lit(True), "any"),
        fact((kind == "stage") & (F.col("status") == "active"), "stage", F.col("stage_id")),
        fact(kind == "classification", "classification", F.coalesce(F.nullif("level", F.lit("")), F.lit(COMPLEXITY)),
             F.coalesce(F.nullif(F.col("score").cast("double"), F.lit(0.0)), F.lit(CONFIDENCE))),
        fact(kind == "human_review", "human_review"),
        fact(decided, "decision", F.col("status")),
        fact(moved | decided, "move", F.when(moved, kind).when(F.col("status") == "stop", "failed").otherwise("processing")),
        fact(kind == "log", "log"), fact(kind == "failed", "failed"),
    ))
    return events.where("ts IS NOT NULL").select("job_id", "ts", F.coalesce("event_id", F.lit(-1)).cast("bigint").alias("event_id"), F.explode(said).alias("f")).select(
        "job_id", "ts", "f.fact", "event_id", "f.text", "f.number", F.lit(1).cast("bigint").alias("n"))


PROGRESS_SCHEMA = ("job_id bigint, status string, current_stage string, decision string, complexity string, confidence double, "
                   "logs bigint, failures bigint, updated_at timestamp")


def job_progress(events: DataFrame) -> DataFrame:
    """Batch: state of each job after all of its events.

    ``human_review`` waits for a reviewer unless the decision in force lets the job go on (``proceed``, ``comment``);
    otherwise it also withdraws that decision.  A decision puts the job back to work, ``stop`` fails it, any other word
    is no decision.  ``classification`` sets complexity (``level``) and confidence (``score``).  Events without a time say
    nothing; of equal times the greater event_id is later.

    No order within a job is needed.  Reviews before the last decision are outdone by it, and those after it count only
    if that decision is a stop or there is none: the status is the newest of two facts.  So the fold is one mergeable
    aggregate, whatever share of the events one job has.
    """
    order = F.struct("ts", "event_id")

    def newest(name: str, value) -> Column:
        return F.max_by(value, F.when(F.col("fact") == name, order)).alias(name + ("_at" if isinstance(value, Column) else ""))

    def count(name: str) -> Column:
        return F.sum(F.when(F.col("fact") == name, F.col("n")).otherwise(0)).alias(f"n_{name}")

    last = _facts(events).groupBy("job_id").agg(
        newest("stage", "text"), newest("classification", "text"), newest("decision", "text"), newest("move", "text"),
        newest("decision", order), newest("move", order), newest("human_review", order),
        F.max_by("number", F.when(F.col("fact") == "classification", order)).alias("confidence"),
        count("log"), count("failed"), F.max("ts").alias("updated_at"),
    )
    halts = F.col("human_review_at").isNotNull() & ~F.coalesce(F.col("decision").isin(*GO_ON), F.lit(False))
    waits = halts & (F.col("move_at").isNull() | (F.col("human_review_at") > F.col("move_at")))
    withdrawn = halts & (F.col("decision_at") < F.col("human_review_at"))
    return last.select(
        "job_id", F.when(waits, "human_review").otherwise(F.coalesce("move", F.lit("processing"))).alias("status"),
        F.col("stage").alias("current_stage"), F.when(~F.coalesce(withdrawn, F.lit(False)), F.col("decision")).alias("decision"),
        F.col("classification").alias("complexity"), "confidence", F.col("n_log").alias("logs"), F.col("n_failed").alias("failures"), "updated_at",
    )


def _combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Facts of one Arrow batch, one row per (job, fact): what a task sends to the keyed state."""
    for pdf in batches:
        pdf = pdf.sort_values(["ts", "event_id"], kind="stable")
        pdf["n"] = pdf.groupby(["job_id", "fact"], dropna=False)["n"].transform("sum")
        yield pdf.drop_duplicates(["job_id", "fact"], keep="last")


class JobProgress(StatefulProcessor):
    """Newest row and count of each fact of a job, one state row per fact; closed after ``idle_ms`` without events."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.facts = handle.getMapState("facts", "fact string", "at bigint, id bigint, text string, number double, n bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = {k[0]: tuple(v) for k, v in self.facts.iterator()}
        before, changed = held.get("any"), set()
        for pdf in rows:
            for f, at, i, text, number, n in zip(pdf["fact"], pdf["micros"], pdf["event_id"], pdf["text"], pdf["number"], pdf["n"]):
                new = (int(at), int(i), None if pd.isna(text) else text, None if pd.isna(number) else float(number), int(n))
                old = held.get(f)
                held[f] = new if old is None else (*max(old, new, key=lambda x: x[:2])[:4], old[4] + new[4])
                changed.add(f)
        for f in changed:
            self.facts.updateValue((f,), held[f])
        if before:
            self.handle.deleteTimer(self._closes(before))
        self.handle.registerTimer(max(self._closes(held["any"]), timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame([self._state(key[0], held)], columns=[x.split()[0] for x in PROGRESS_SCHEMA.split(", ")])

    def _closes(self, newest: tuple) -> int:
        return newest[0] // 1000 + self.idle_ms

    def _state(self, job, held: dict) -> tuple:
        none = (None,) * 4 + (0,)
        review, decision, move, kind = (held.get(f, none) for f in ("human_review", "decision", "move", "classification"))
        halts = review[0] is not None and decision[2] not in GO_ON
        waits = halts and (move[0] is None or review[:2] > move[:2])
        withdrawn = halts and decision[0] is not None and review[:2] > decision[:2]
        return (job, "human_review" if waits else move[2] or "processing", held.get("stage", none)[2], None if withdrawn else decision[2],
                kind[2], kind[3], held.get("log", none)[4], held.get("failed", none)[4], pd.Timestamp(held["any"][0], unit="us", tz="UTC"))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        newest = self.facts.getValue(("any",))
        if newest is None or self._closes(tuple(newest)) <= expiredTimerInfo.getExpiryTimeInMs():
            self.facts.clear()
        return iter(())

    def close(self) -> None:
        pass


def job_progress_stream(events: DataFrame, idle_ms: int = IDLE_MS, delay: str = WATERMARK) -> DataFrame:
    """Stream: the same, updated by every trigger.  Tasks combine their facts before the shuffle, a job's state is one row
    per fact, and it ends when the watermark is ``idle_ms`` past the job's last event: later events begin the job anew."""
    facts = _facts(events).mapInPandas(_combine, FACT).withWatermark("ts", delay).withColumn("micros", F.unix_micros("ts"))
    return with_processor(facts, JobProgress(idle_ms), ["job_id"], PROGRESS_SCHEMA, "Update")


# --- reviews ---------------------------------------------------------------------------------

def _spread(marks: DataFrame, wait: int, cell_seconds: int) -> Column:
    """The cells a mark is shown in: a request in its own, a decision also in those before it that
    can still wait for it."""
    cell = width_cells(_seconds(F.col("ts")), cell_seconds)
    reach = -(-wait // cell_seconds)
    return F.when(F.col("is_decision"), F.sequence(cell - reach, cell)).otherwise(F.array(cell))


def _marks(events: DataFrame) -> DataFrame:
    return events.where("event IN ('human_review', 'decision')").select(
        "event_id", "job_id", "ts", (F.col("event") == "decision").alias("is_decision")
    )


def review_outcomes(events: DataFrame, wait: int = REVIEW_SECONDS, cell_seconds: int = 300) -> DataFrame:
    """Batch: each review request with the first decision inside the wait, else ``timeout``.

    Requests and decisions share one timeline per (job, cell), so no pairs are built and a busy job
    is many cells.  Of a cell's decisions only the first is shown to the cells before it.
    """
    cell = width_cells(_seconds(F.col("ts")), cell_seconds)
    marks = _marks(events).withColumn("_cell", cell)
    reach = -(-wait // cell_seconds)
    first = marks.where("is_decision").groupBy("job_id", "_cell").agg(F.min("ts").alias("ts")).select(
        F.lit(None).cast("bigint").alias("event_id"), "job_id", "ts", F.lit(True).alias("is_decision"),
        F.explode(F.sequence(F.col("_cell") - reach, F.col("_cell") - 1)).alias("_cell"),
    )
    w = Window.partitionBy("job_id", "_cell").orderBy("ts", "is_decision").rowsBetween(
        Window.currentRow, Window.unboundedFollowing
    )
    timeline = marks.unionByName(first).withColumn("_next", F.min(F.when(F.col("is_decision"), F.col("ts"))).over(w))
    in_time = _seconds(F.col("_next")) - _seconds(F.col("ts")) <= wait
    return timeline.where(~F.col("is_decision")).select(
        F.col("event_id").alias("request_id"), "job_id", F.col("ts").alias("requested_at"),
        F.when(in_time, F.col("_next")).alias("decided_at"),
        F.when(in_time, "decided").otherwise("timeout").alias("outcome"),
    )


REVIEW_SCHEMA = "request_id bigint, job_id bigint, requested_at timestamp, decided_at timestamp, outcome string"


class ReviewWaits(StatefulProcessor):
    """The requests of a (job, cell) and the decisions they may wait for, as state rows of at most ``chunk`` marks.

    However many marks a cell gets, no state row grows with them; they are answered a row at a time, against the sorted
    times of the cell's decisions, when the watermark has passed the last decision that counts.
    """

    def __init__(self, wait: int, cell_seconds: int, chunk: int):
        self.wait, self.cell_seconds, self.chunk = wait, cell_seconds, chunk

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.requests = handle.getMapState("requests", "place bigint", "ids array<bigint>, at array<bigint>")
        self.decisions = handle.getMapState("decisions", "place bigint", "at array<bigint>")
        self.rows = handle.getValueState("rows", "requests bigint, decisions bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        asked, decided = self.rows.get() if self.rows.exists() else (0, 0)
        for pdf in rows:
            is_decision, at = pdf["is_decision"].to_numpy(dtype=bool), pdf["micros"].to_numpy()
            times, ids, waits = np.unique(at[is_decision]), pdf["event_id"].to_numpy()[~is_decision], at[~is_decision]
            for i in range(0, times.size, self.chunk):
                self.decisions.updateValue((decided,), (times[i:i + self.chunk].tolist(),))
                decided += 1
            for i in range(0, waits.size, self.chunk):
                self.requests.updateValue((asked,), (ids[i:i + self.chunk].tolist(), waits[i:i + self.chunk].tolist()))
                asked += 1
        self.rows.update((asked, decided))
        closes = ((int(key[1]) + 1) * self.cell_seconds + self.wait) * 1000
        self.handle.registerTimer(max(closes, timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = [np.array(v[0], dtype=np.int64) for v in self.decisions.values()]
        known = np.unique(np.concatenate(known)) if known else np.array([], dtype=np.int64)
        for ids, asked in self.requests.values():
            at = np.array(asked, dtype=np.int64)
            place = np.searchsorted(known, at, side="left")
            found = np.append(known, np.iinfo(np.int64).max)[place]
            in_time = (place < known.size) & (found - at <= self.wait * 1_000_000)
            yield pd.DataFrame({
                "request_id": list(ids), "job_id": key[0], "requested_at": pd.to_datetime(at, unit="us", utc=True),
                "decided_at": pd.to_datetime(pd.Series(found).where(pd.Series(in_time)).astype("Int64"), unit="us", utc=True),
                "outcome": np.where(in_time, "decided", "timeout"),
            })
        for state in (self.requests, self.decisions, self.rows):
            state.clear()

    def close(self) -> None:
        pass


def review_outcomes_stream(events: DataFrame, wait: int = REVIEW_SECONDS, cell_seconds: int = REVIEW_SECONDS, chunk: int = 1000) -> DataFrame:
    """Stream: the same, in append mode, once the watermark has passed the last possible decision.

    Sorted search instead of pairs; a busy job is spread over its cells, a cell over state rows of ``chunk`` marks, and a
    cell's state is gone when it has answered.
    A cell is as long as the wait: a decision is then held in two cells only, where shorter cells held it in many.
    """
    marks = _marks(events.withWatermark("ts", WATERMARK))
    spread = marks.select(
        "event_id", "job_id", "is_decision", "ts", F.unix_micros("ts").alias("micros"),
        F.explode(_spread(marks, wait, cell_seconds)).alias("cell"),
    )
    return with_processor(spread, ReviewWaits(wait, cell_seconds, chunk), ["job_id", "cell"], REVIEW_SCHEMA, "Append")


# --- retries ---------------------------------------------------------------------------------

def retry_outcomes(attempts: DataFrame, retries: int = MAX_RETRIES, passing: float = PASS_SCORE) -> DataFrame:
    """attempts(job_id, ts, event_id, score) -> the attempt each job stops at.

    The first passing attempt, else attempt ``retries + 1``, else the last so far.  Spark keeps at
    most ``retries + 1`` rows per job and task before the shuffle.
    """
    w = Window.partitionBy("job_id").orderBy("ts", "event_id")
    tried = attempts.withColumn("n", F.row_number().over(w)).where(F.col("n") <= retries + 1)
    passed = F.min(F.when(F.col("score") >= passing, F.col("n")))
    stop = tried.groupBy("job_id").agg(
        F.coalesce(passed, F.max("n")).alias("attempt"), passed.isNotNull().alias("_ok"),
        F.map_from_entries(F.collect_list(F.struct("n", "score"))).alias("_scores"),
    )
    return stop.select(
        "job_id", "attempt", F.try_element_at("_scores", F.col("attempt")).alias("score"),
        F.when(F.col("_ok"), "passed").when(F.col("attempt") > retries, "retries_exhausted")
        .otherwise("open").alias("outcome"),
    )


class RetryLoop(StatefulProcessor):
    """The first attempts of a job, at most ``retries + 1`` and none after a passing one, in one state row."""

    def __init__(self, retries: int, passing: float, idle_ms: int):
        self.retries, self.passing, self.idle_ms = retries, passing, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tries = handle.getValueState("tries", "at array<bigint>, ids array<bigint>, scores array<double>, closes bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        tries, closes, held = [], 0, None
        if self.tries.exists():
            at, ids, scores, closes = self.tries.get()
            held = tries = list(zip(at, ids, scores))
            self.handle.deleteTimer(closes)
        for pdf in rows:
            new = zip(pdf["micros"].tolist(), pdf["event_id"].tolist(), pdf["score"].tolist())
            tries = tries + [(t, i, None if pd.isna(v) else float(v)) for t, i, v in new]
            closes = max(closes, int(pdf["micros"].max()) // 1000 + self.idle_ms)
        tries = sorted(tries, key=lambda x: x[:2])[: self.retries + 1]
        passed = next((n for n, x in enumerate(tries, 1) if x[2] is not None and x[2] >= self.passing), None)
        tries = tries[:passed]
        closes = max(closes, timerValues.getCurrentWatermarkInMs() + 1)
        self.tries.update(tuple([x[i] for x in tries] for i in range(3)) + (closes,))
        self.handle.registerTimer(closes)
        if tries != held:
            outcome = "passed" if passed else "retries_exhausted" if len(tries) > self.retries else "open"
            yield pd.DataFrame({"job_id": [key[0]], "attempt": [len(tries)], "score": [tries[-1][2]], "outcome": [outcome]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.tries.clear()
        return iter(())

    def close(self) -> None:
        pass


def retry_outcomes_stream(attempts: DataFrame, retries: int = MAX_RETRIES, passing: float = PASS_SCORE,
                          idle_ms: int = IDLE_MS, delay: str = WATERMARK) -> DataFrame:
    """Stream: the same, updated when it changes.

    Only a job's first attempts decide, so a task sends at most ``retries + 1`` rows of a job per Arrow batch to the state
    and the state keeps no more, in whatever order they come.  A job is forgotten when the watermark is ``idle_ms`` past
    its last attempt; an attempt after that begins a new loop.
    """
    score = attempts.schema["score"].dataType

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.sort_values(["ts", "event_id"], kind="stable").groupby("job_id", dropna=False).head(retries + 1)

    rows = attempts.where("ts IS NOT NULL").select("job_id", "ts", F.coalesce("event_id", F.lit(-1)).cast("bigint").alias("event_id"), F.col("score").cast("double").alias("score"))
    cut = rows.mapInPandas(first, rows.schema).withWatermark("ts", delay).withColumn("micros", F.unix_micros("ts"))
    schema = T.StructType([attempts.schema["job_id"], *T.StructType.fromDDL("attempt int, score double, outcome string").fields])
    out = with_processor(cut, RetryLoop(retries, passing, idle_ms), ["job_id"], schema, "Update")
    return out.withColumn("score", F.when(~F.isnan("score"), F.col("score")).cast(score))


# --- log levels ------------------------------------------------------------------------------

def log_levels(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """Log events per tumbling window and level; late rows fall behind the watermark."""
    logs = events.where("event = 'log'")
    if events.isStreaming:
        logs = logs.withWatermark("ts", WATERMARK)
    return logs.groupBy(F.window("ts", width).alias("w"), "level").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("window_start"), "level", "n"
    )
