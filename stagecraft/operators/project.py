"""Transformer, filter, router, copy and peek stages."""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, functions as F

from stagecraft.runtime import store_split


class Branches(NamedTuple):
    """The two outputs of a stage with a reject pin."""

    main: DataFrame
    reject: DataFrame


def derive(df: DataFrame, derivations: list[tuple[str, Column]]) -> DataFrame:
    """Ordered derivations; a later one may read an earlier output."""
    for name, expression in derivations:
        df = df.withColumn(name, expression)
    return df


def holds(condition: Column) -> Column:
    """The condition with NULL read as false, so that a row is in exactly one half."""
    return F.coalesce(condition, F.lit(False))


def filter_rows(df: DataFrame, condition: Column) -> Branches:
    """``main`` keeps the bare condition, whose parts Spark can push into the scan."""
    return Branches(df.where(condition), df.where(~holds(condition)))


def with_route(df: DataFrame, routes: dict[str, Column], otherwise: str = "otherwise",
               column: str = "_route") -> DataFrame:
    """Tag each row with the first branch whose constraint holds; one evaluation per row."""
    chain = None
    for name, condition in routes.items():
        chain = (F if chain is None else chain).when(holds(condition), F.lit(name))
    tag = F.lit(otherwise) if chain is None else chain.otherwise(F.lit(otherwise))
    return df.withColumn(column, tag)


def route(df: DataFrame, routes: dict[str, Column], otherwise: str = "otherwise") -> dict[str, DataFrame]:
    """One DataFrame per branch, plus the otherwise branch.

    The input is evaluated once: its tagged rows are written to one folder per branch, and a branch reads its own.  On a
    stream, which has no such folders, each branch is a filter.
    """
    tagged = with_route(df, routes, otherwise)
    if not df.isStreaming:
        tagged = store_split(tagged, "_route", "routes")
    return {
        name: tagged.where(F.col("_route") == name).drop("_route")
        for name in [*routes, otherwise]
    }


def split_rows(df: DataFrame, condition: Column) -> Branches:
    """``filter_rows`` with the input evaluated once: both halves are written, each in a folder of its own."""
    out = route(df, {"main": condition}, "reject")
    return Branches(out["main"], out["reject"])


def copy_to(df: DataFrame, outputs: dict[str, list[str] | None]) -> dict[str, DataFrame]:
    """Same rows to each output; a list keeps only those columns."""
    return {name: df if cols is None else df.select(*cols) for name, cols in outputs.items()}


def peek(df: DataFrame, name: str, metrics: dict[str, Column] | None = None, sample: int = 0) -> tuple[DataFrame, Observation]:
    """Rows pass unchanged; counts, and up to ``sample`` rows, arrive with the one action that is run anyway.

    The sample is drawn by a hash of the row, so it does not depend on the order of rows, and is read by ``peeked``.
    """
    seen = Observation(name)
    wanted = {"rows": F.count(F.lit(1)), **(metrics or {})}
    if sample:
        text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
        order = F.xxhash64(text)
        wanted |= {f"{SAMPLED}{i}": F.min(F.when(F.pmod(order, F.lit(sample)) == i, F.struct(order.alias("order"), text.alias("row")))) for i in range(sample)}
    return df.observe(seen, *[c.alias(n) for n, c in wanted.items()]), seen


SAMPLED = "_sample_"


def peeked(seen: Observation) -> tuple[dict[str, object], list[dict]]:
    """The counts and the sampled rows of a peek, after its action."""
    found = seen.get
    rows = [v["row"] for k, v in sorted(found.items()) if k.startswith(SAMPLED) and v is not None]
    return {k: v for k, v in found.items() if not k.startswith(SAMPLED)}, [json.loads(r) for r in rows]


def null_safe(col, default=0) -> Column:
    """Operand for NULL-safe arithmetic."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(default))


def typed_cast(df: DataFrame, declared: list[tuple[str, str]], required: list[str] | None = None) -> Branches:
    """Cast to the declared types; rows where a present value does not fit, or a required one is NULL, are rejected."""
    casts = [F.col(n).try_cast(t).alias(n) for n, t in declared]
    names = {n for n, _ in declared}
    rest = [c for c in df.columns if c not in names]
    misfits = [
        F.when(F.col(n).isNotNull() & F.col(n).try_cast(t).isNull(), F.lit(n)) for n, t in declared
    ]
    absent = [F.when(F.col(n).isNull(), F.lit(n)) for n in required or []]
    reason = F.concat_ws(",", *misfits, *absent)
    fits = reason == ""
    main = df.where(fits).select(*rest, *casts)
    reject = df.where(~fits).withColumn("_reject_reason", F.concat(F.lit("bad value in "), reason))
    return Branches(main, reject)
