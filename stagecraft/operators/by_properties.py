"""Stages driven by their exported properties: a mapping onto the stage functions, no job runner."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from stagecraft.operators import aggregate, joins, project, shape
from stagecraft.operators.project import Branches


def _names(text: str | None) -> list[str]:
    return [n.strip() for n in (text or "").split(",") if n.strip()]


def _only(df: DataFrame) -> Branches:
    return Branches(df, df.where(F.lit(False)).withColumn("_reject_reason", F.lit("")))


def filter_stage(props: Mapping[str, str], df: DataFrame) -> Branches:
    """``FilterCondition``; no condition lets every row pass."""
    condition = props.get("FilterCondition")
    return project.filter_rows(df, F.expr(condition)) if condition else _only(df)


def join_stage(props: Mapping[str, str], left: DataFrame, right: DataFrame) -> Branches:
    """``JoinType`` and ``JoinKey``.  The reject output holds left rows an inner join finds no partner for."""
    keys, how = _names(props.get("JoinKey")), props.get("JoinType")
    if joins.join_type(how) == "inner":
        return joins.join_with_reject(left, right, keys)
    return _only(joins.join_stage(left, right, keys, how))


def lookup_stage(props: Mapping[str, str], df: DataFrame, reference: DataFrame) -> Branches:
    """``LookupKey`` and ``NoMatchHandling`` (any case, absent: Continue).

    A lookup never multiplies rows: of reference rows with one key the least by its other columns counts.
    """
    keys = _names(props.get("LookupKey"))
    order = [F.col(c) for c in reference.columns if c not in keys] or [F.lit(0)]
    return joins.lookup(df, joins.one_per_key(reference, keys, order), keys, (props.get("NoMatchHandling") or "Continue").strip().capitalize())


def top_level(text: str) -> list[str]:
    """The parts between commas that stand in no parentheses and no quotes."""
    parts, depth, quote = [""], 0, ""
    for ch in text:
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "'\"`":
            quote = ch
        elif ch in "()":
            depth += 1 if ch == "(" else -1
        elif ch == "," and not depth:
            parts.append("")
            continue
        parts[-1] += ch
    return [p.strip() for p in parts if p.strip()]


AGGREGATION = re.compile(r"(?is)^(\w+)\s*\((.*)\)\s+AS\s+(\w+)$")


def aggregations(text: str) -> list[tuple[str, str, str]]:
    """``SUM(ROUND(A, 2)) AS X, COUNT(DISTINCT B) AS N`` -> (function, what stands in its parentheses, name)."""
    out = []
    for part in top_level(text):
        found = AGGREGATION.match(part)
        if not found:
            raise ValueError(f"not an aggregation: {part}")
        function, inner, name = found.group(1).upper(), found.group(2).strip(), found.group(3)
        if function not in {*aggregate.AGGREGATES, "FIRST", "LAST", "COLLECT_LIST"}:
            raise ValueError(f"unknown aggregate: {function}")
        out.append((function, inner, name))
    return out


def measures(text: str, order: list[str] | None = None) -> dict[str, Column]:
    """Aggregates by name, of columns or of whole expressions.  FIRST and LAST need an order; COLLECT_LIST is no measure."""
    out: dict[str, Column] = {}
    for function, inner, name in aggregations(text):
        distinct = re.match(r"(?is)^DISTINCT\b(.*)$", inner)
        if function in ("FIRST", "LAST"):
            if not order:
                raise ValueError(f"{function} needs SortKeys")
            by = F.struct(*[F.col(o) for o in order])
            out[name] = (F.min_by if function == "FIRST" else F.max_by)(F.expr(inner), by)
        elif function == "COLLECT_LIST":
            raise ValueError("COLLECT_LIST gives several rows a group: use collect_pieces")
        elif function == "COUNT" and inner == "*":
            out[name] = F.count(F.lit(1))
        elif distinct and function == "COUNT":
            out[name] = F.count_distinct(*[F.expr(c) for c in top_level(distinct.group(1))])
        elif distinct:
            out[name] = F.expr(f"{function}(DISTINCT {distinct.group(1)})")
        else:
            out[name] = aggregate.AGGREGATES[function](F.expr(inner))
    return out


LIST_ROWS = 10_000


def aggregate_stage(props: Mapping[str, str], df: DataFrame) -> Branches:
    """``GroupByKeys``, ``Aggregations`` and, for FIRST and LAST, ``SortKeys``.

    COLLECT_LIST comes in pieces of at most ``LIST_ROWS`` values, each a row with its number in ``piece``; the other
    aggregates of the group stand on each of them.
    """
    order = [k.split()[0] for k in _names(props.get("SortKeys"))]
    keys, text = _names(props.get("GroupByKeys")), props.get("Aggregations") or ""
    lists = [a for a in aggregations(text) if a[0] == "COLLECT_LIST"]
    if not lists:
        return _only(aggregate.aggregate(df, keys, measures(text, order)))
    others = ", ".join(f"{f}({inner}) AS {name}" for f, inner, name in aggregations(text) if f != "COLLECT_LIST")
    out = aggregate.aggregate(df, keys, measures(others, order)) if others else df.select(*keys).distinct()
    for i, (_, inner, name) in enumerate(lists):
        pieces = aggregate.collect_pieces(df.select(*keys, F.expr(inner).alias(name)), keys, name, LIST_ROWS, name)
        on = keys if i == 0 else [*keys, "piece"]
        pieces = pieces.withColumnsRenamed({k: f"_own_{k}" for k in on})
        same = [F.col(k).eqNullSafe(F.col(f"_own_{k}")) for k in on]
        out = out.join(pieces, same, "left" if i == 0 else "full")
        if i:
            out = out.withColumns({k: F.coalesce(k, f"_own_{k}") for k in on})
        out = out.drop(*[f"_own_{k}" for k in on])
    return _only(out)


def sort_stage(props: Mapping[str, str], df: DataFrame) -> Branches:
    """``SortKeys`` such as ``A ASC, B DESC``."""
    return _only(shape.sort_rows(df, props["SortKeys"]))


STAGES = {
    "PxFilter": filter_stage, "PxJoin": join_stage, "PxLookup": lookup_stage, "PxAggregate": aggregate_stage, "PxSort": sort_stage,
}


def apply_stage(stage: Mapping, *inputs: DataFrame) -> Branches:
    """Run one stage (``stage_type``, ``properties``) on its inputs."""
    if stage["stage_type"] not in STAGES:
        raise ValueError(f"no stage function for {stage['stage_type']}")
    return STAGES[stage["stage_type"]](stage.get("properties", {}), *inputs)
