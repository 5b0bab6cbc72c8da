"""Join and lookup stages.

Inner, left and right joins are plain equi-joins, which AQE splits on skewed keys.  Spark cannot
split a skewed full outer join, so that one is a left join plus the unmatched right rows.
Broadcasts are left to Spark, which measures the side at run time, unless the caller asks for one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stagecraft.operators.project import Branches
from stagecraft.runtime import store_split

# The stage language's join names and the reject text.
JOIN_TYPES = {
    "Inner": "inner", "LeftOuter": "left", "RightOuter": "right",
    "FullOuter": "outer", "Cross": "cross", "Lookup": "left",
}

def join_type(name: str | None) -> str:
    """Spark join type of a declared join name; unknown names mean inner."""
    return JOIN_TYPES.get(name or "", "inner")


def join_stage(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equally named keys; ``how`` is a declared name or a Spark join type."""
    how = JOIN_TYPES.get(how, how)
    if how == "cross":
        return cross(left, right)
    if how in ("outer", "full"):
        return _full_outer(left, right, keys)
    if how not in ("inner", "left", "right"):
        how = "inner"
    return left.join(right, keys, how)


def _full_outer(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    matched = left.join(right, keys, "left")
    # left_anti reads only the other side's keys, once each.
    extra = right.join(left.select(*keys).distinct(), keys, "left_anti")
    return matched.unionByName(extra, allowMissingColumns=True)


def cross(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every left row with every right row, whatever their numbers; Spark picks how by their sizes."""
    return left.crossJoin(right)


def join_with_reject(left: DataFrame, right: DataFrame, keys: list[str],
                     reason: str | None = None) -> Branches:
    """Left outer join with two pins: matched rows, and left rows without a partner."""
    reason = reason or f"No match on {','.join(keys)}"
    return _matched_or_not(left, right, keys, reason)


def _matched_or_not(left: DataFrame, right: DataFrame, keys: list[str], reason: str) -> Branches:
    """Both pins of one join.

    The rows of a left join, tagged, are written once, to a folder for each pin.  Where that cannot be done (a stream, or
    both sides have a column of one name) each pin is a join of its own.
    """
    names = [c.lower() for c in (*left.columns, *[c for c in right.columns if c not in keys])]
    if left.isStreaming or right.isStreaming or len(set(names)) < len(names):
        main = left.join(right, keys, "inner")
        reject = left.join(right.select(*keys).distinct(), keys, "left_anti")
        return Branches(main, reject.withColumn("_reject_reason", F.lit(reason)))
    tagged = left.join(right.withColumn("_pin", F.lit("main")), keys, "left").withColumn("_pin", F.coalesce("_pin", F.lit("reject")))
    pins = store_split(tagged, "_pin")
    main, reject = (pins.where(F.col("_pin") == p).drop("_pin") for p in ("main", "reject"))
    return Branches(main, reject.select(*left.columns).withColumn("_reject_reason", F.lit(reason)))


def one_per_key(ref: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """A lookup reference holds one row per key.

    ``row_number() = 1`` lets Spark keep one row per key before the shuffle (window group limit),
    so a hot key costs one row per task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return ref.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def lookup(df: DataFrame, ref: DataFrame, keys: list[str], no_match: str = "Continue",
           defaults: dict[str, object] | None = None, how: str | None = None) -> Branches:
    """Lookup stage.  ``ref`` must be unique per key (see ``one_per_key``).

    no_match: Continue (keep, NULL or default), Drop, Reject (second output) or Fail (raise).
    ``how`` is a join hint (``broadcast``, ``merge``, ...) for callers who know the reference's size; without
    it Spark decides by the size measured at run time, against the session's broadcast bound.
    """
    side = ref.hint(how) if how else ref
    reason = F.lit(f"No match on {','.join(keys)}")
    nobody = df.where(F.lit(False)).withColumn("_reject_reason", reason)
    if no_match == "Drop":
        return Branches(df.join(side, keys, "inner"), nobody)
    if no_match == "Reject":
        return _matched_or_not(df, side, keys, f"No match on {','.join(keys)}")
    values = [c for c in ref.columns if c not in keys]
    flagged = df.join(side.withColumn("_hit", F.lit(True)), keys, "left")
    if no_match == "Fail":
        message = F.concat(F.lit(f"lookup failed on {','.join(keys)}: "),
                           F.concat_ws(",", *[F.col(k).cast("string") for k in keys]))
        # Raised inside the plan, on the row itself; no extra count.
        checked = F.when(F.col("_hit").isNull(), F.raise_error(message)).otherwise(F.lit(True))
        return Branches(flagged.where(checked).drop("_hit"), nobody)
    if no_match != "Continue":
        raise ValueError(f"unknown no-match handling: {no_match}")
    filled = [
        F.when(F.col("_hit").isNull(), F.lit(defaults[c])).otherwise(F.col(c)).alias(c)
        if defaults and c in defaults else F.col(c)
        for c in values
    ]
    return Branches(flagged.select(*df.columns, *filled), nobody)
