"""Stage graphs of all jobs at once: levels, cycles by component, and reachability.

Every round joins on (job_id, stage_id), so a huge job spreads over all tasks.  The rounds end with the longest path,
not with the number of jobs; each round writes one table to the shared folder, and that write also counts what the next
round needs to know.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame, functions as F

from stagecraft.runtime import store, store_counted


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def inner_links(stages: DataFrame, links: DataFrame) -> DataFrame:
    """Different links between stages of their job: (job_id, from_stage, to_stage)."""
    edges = links.select("job_id", "from_stage", "to_stage").distinct()
    for end in ("from_stage", "to_stage"):
        edges = edges.join(stages.select("job_id", F.col("stage_id").alias(end)), ["job_id", end], "left_semi")
    return edges


def peel(stages: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Take off the stages without inbound links, round by round.

    Returns (job_id, stage_id, level) and the leftovers (job_id, stage_id), which lie on or behind a cycle.  The level is
    the longest path from a stage without inbound links.  Links with an end that is no stage of the job are left out.
    A round carries how many inbound links of each remaining stage are still open and takes off those of the stages that
    just got their level; it takes off a stage or ends, so a deep job takes its rounds and no bound cuts them short.
    """
    edges = store(inner_links(stages, links), "links")
    inbound = edges.groupBy("job_id", F.col("to_stage").alias("stage_id")).agg(F.count(F.lit(1)).alias("n"))
    state = stages.select("job_id", "stage_id").join(inbound, ["job_id", "stage_id"], "left").select(
        "job_id", "stage_id", F.coalesce("n", F.lit(0)).cast("long").alias("open"))
    none, names = F.col("open") == 0, ["job_id", "stage_id"]
    done: list[DataFrame] = []
    for level in count():
        state, n = store_counted(state, "levels", ready=none, rest=~none)
        ready, rest = state.where(none).select(*names), state.where(~none)
        if n["ready"] or not done:
            done.append(ready.withColumn("level", F.lit(level)))
        if not n["ready"] or not n["rest"]:
            return _union(done), rest.select(*names)
        off = edges.join(ready.withColumnRenamed("stage_id", "from_stage"), ["job_id", "from_stage"], "left_semi").groupBy(
            "job_id", F.col("to_stage").alias("stage_id")).agg(F.count(F.lit(1)).alias("n"))
        state = rest.join(off, names, "left").select(*names, (F.col("open") - F.coalesce("n", F.lit(0))).alias("open"))


def topological_levels(stages: DataFrame, links: DataFrame) -> DataFrame:
    """Level per stage; stages on or behind a cycle have level NULL.  Order = (level, stage_id)."""
    leveled, rest = peel(stages, links)
    return leveled.unionByName(rest.withColumn("level", F.lit(None).cast("int")))


def turned(links: DataFrame) -> DataFrame:
    return links.select("job_id", F.col("to_stage").alias("from_stage"), F.col("from_stage").alias("to_stage"))


def cycle_components(stages: DataFrame, links: DataFrame) -> DataFrame:
    """(job_id, stage_id, component): the stages on a cycle, each with the least stage of its strongly connected component.

    First the stages before and behind all cycles are trimmed off.  Of the rest every stage takes the least name among the
    stages that lead to it; the stages from which that least stage can be reached inside its colour are its component.
    They leave, and the remaining ones (between two cycles, or in a component behind another) go through the same again.
    A stage alone is on a cycle only if it is linked to itself.
    """
    names = ["job_id", "stage_id"]
    links = store(inner_links(stages, links), "links")
    loops = links.where("from_stage = to_stage").select("job_id", F.col("from_stage").alias("stage_id"))
    edges, found = links.where("from_stage <> to_stage"), []
    while True:
        edges, some = trimmed(edges)
        if not some:
            break
        core = edges.select("job_id", F.col("from_stage").alias("stage_id")).distinct()
        colour = _coloured(core, edges)
        # Inside its colour, the component is what reaches the colour's own stage.
        of = lambda end: colour.select("job_id", F.col("stage_id").alias(end), F.col("colour").alias(f"{end}_colour"))
        inside = store(edges.join(of("from_stage"), ["job_id", "from_stage"]).join(of("to_stage"), ["job_id", "to_stage"]).where(
            "from_stage_colour = to_stage_colour").select("job_id", "from_stage", "to_stage"), "links")
        back = leading_to(colour.where("stage_id = colour").select(*names), inside.withColumnsRenamed({"from_stage": "stage_id"}), names, ["job_id", "to_stage"])
        members = store(colour.join(back, names, "left_semi"), "components")
        found.append(members)
        for end in ("from_stage", "to_stage"):
            edges = edges.join(members.select("job_id", F.col("stage_id").alias(end)), ["job_id", end], "left_anti")
    alone = loops.withColumn("colour", F.col("stage_id"))
    if not found:
        return alone.withColumnRenamed("colour", "component")
    parts = _union(found)
    large = parts.groupBy("job_id", "colour").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    cyclic = parts.join(large, ["job_id", "colour"], "left_semi").select(*names, "colour")
    return cyclic.unionByName(alone.join(cyclic, names, "left_anti")).withColumnRenamed("colour", "component")


def trimmed(edges: DataFrame) -> tuple[DataFrame, int]:
    """The links, stored, without those before and behind all cycles, and how many are left.

    A round drops the links that come from a stage without inbound links or lead to one without outbound links, so a path
    is shortened at both ends and a round without a loss is the last.
    """
    edges, n = store_counted(edges, "links", any=F.lit(True))
    while n["any"]:
        inbound = edges.select("job_id", F.col("to_stage").alias("from_stage"))
        outbound = edges.select("job_id", F.col("from_stage").alias("to_stage"))
        before = n["any"]
        edges, n = store_counted(edges.join(inbound, ["job_id", "from_stage"], "left_semi").join(
            outbound, ["job_id", "to_stage"], "left_semi"), "links", any=F.lit(True))
        if n["any"] == before:
            break
    return edges, n["any"]


def _coloured(stages: DataFrame, edges: DataFrame) -> DataFrame:
    """(job_id, stage_id, colour): the least stage that leads to each, itself included."""
    state = store(stages.select("job_id", "stage_id", F.col("stage_id").alias("colour")), "colours")
    while True:
        come = edges.join(state.select("job_id", F.col("stage_id").alias("from_stage"), F.col("colour").alias("given")), ["job_id", "from_stage"]).groupBy(
            "job_id", F.col("to_stage").alias("stage_id")).agg(F.min("given").alias("given"))
        state, n = store_counted(state.join(come, ["job_id", "stage_id"], "left").select(
            "job_id", "stage_id", F.least("colour", "given").alias("colour"), (F.col("given") < F.col("colour")).alias("changed")),
            "colours", changed=F.col("changed"))
        if not n["changed"]:
            return state.drop("changed")


def cyclic_stages(stages: DataFrame, links: DataFrame) -> DataFrame:
    """Stages on a cycle."""
    return cycle_components(stages, links).drop("component")


def leading_to(ends: DataFrame, edges: DataFrame, at: list[str], to: list[str]) -> DataFrame:
    """The nodes from which some end can be reached, the ends included; columns ``at``.

    ``edges`` has the columns ``at`` of where a link starts and ``to`` of where it leads.  State is one row for each node.
    """
    seen = frontier = store(ends.select(*at).distinct(), "leading")
    while True:
        before = edges.join(frontier.select(*[F.col(a).alias(t) for a, t in zip(at, to)]), to, "left_semi").select(*at).distinct()
        frontier, n = store_counted(before.join(seen, at, "left_anti"), "leading", any=F.lit(True))
        if not n["any"]:
            return seen
        seen = seen.unionByName(frontier)


def reach(starts: DataFrame, links: DataFrame) -> DataFrame:
    """(job_id, source, stage_id, hops): fewest links from each start to each stage it reaches."""
    edges = store(links.select("job_id", F.col("from_stage").alias("stage_id"), "to_stage").distinct(), "links")
    frontier = store(starts.select(
        "job_id", F.col("stage_id").alias("source"), "stage_id", F.lit(0).alias("hops")), "reached")
    seen, pair = [frontier], ["job_id", "source", "stage_id"]
    for hop in count(1):
        step = frontier.join(edges, ["job_id", "stage_id"]).select("job_id", "source", F.col("to_stage").alias("stage_id")).distinct()
        fresh = step.join(_union(seen).select(*pair), pair, "left_anti")
        frontier, n = store_counted(fresh.withColumn("hops", F.lit(hop)), "reached", any=F.lit(True))
        if not n["any"]:
            return _union(seen)
        seen.append(frontier)


def lineage_closure(classified: DataFrame, links: DataFrame) -> DataFrame:
    """(job_id, source, target, hops) for every source that reaches a target.

    The walk goes only through stages from which a target can be reached, so each (source, stage) it holds lies on a way
    from a source to a target, however many stages hang beside it.
    """
    sources = classified.where("io = 'source'")
    targets = store(classified.where("io = 'target'").select("job_id", "stage_id"), "targets")
    useful, kept = on_a_way(targets, links)
    return (
        reach(sources.join(useful, ["job_id", "stage_id"], "left_semi"), kept)
        .join(targets, ["job_id", "stage_id"], "left_semi")
        .select("job_id", "source", F.col("stage_id").alias("target"), "hops")
    )


def on_a_way(targets: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The stages that lead to a target, and the links between them."""
    edges = store(links.select("job_id", F.col("from_stage").alias("stage_id"), "to_stage").distinct(), "links")
    useful = leading_to(targets, edges, ["job_id", "stage_id"], ["job_id", "to_stage"])
    kept = edges.join(useful.withColumnRenamed("stage_id", "to_stage"), ["job_id", "to_stage"], "left_semi")
    return useful, kept.select("job_id", F.col("stage_id").alias("from_stage"), "to_stage")
