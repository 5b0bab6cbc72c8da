"""Duplicates, keys, change data and dimensions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from stagecraft.functions.maths import checksum
from stagecraft.operators.cells import RANGE, day_cells, neighbour, neighbour_by_size, number_rows, range_cells, rank_by_size
from stagecraft.runtime import store

OPEN_END = "9999-12-31"


def dedup(df: DataFrame, keys: list[str], order: list[str], keep: str = "first") -> DataFrame:
    """Remove-duplicates stage.  Spark limits each key to one row per task before the shuffle."""
    sort = [F.col(c).asc() if keep == "first" else F.col(c).desc() for c in order]
    w = Window.partitionBy(*keys).orderBy(*sort)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def rank_rows(df: DataFrame, keys: list[str], order: str, tiebreak: str, rows_per_cell: int = 2_000_000) -> DataFrame:
    """row_number, rank and lead of ``order`` per key, for groups of any size."""
    return rank_by_size(df, keys, order, tiebreak, rows_per_cell)


def surrogate_key(df: DataFrame, order: str, start: int = 0, name: str = "sk",
                  rows_per_cell: int = 2_000_000) -> DataFrame:
    """Dense ids ``start + 1 ...`` in the order of a unique column, without a global window."""
    dealt = range_cells(df, [F.col(order)], rows_per_cell)
    numbered = number_rows(dealt, [], [F.col(order)], F.col(RANGE), row_number=name)
    return numbered.withColumn(name, F.col(name) + F.lit(start)).drop(RANGE)


def assign_surrogate_keys(dim: DataFrame, incoming: DataFrame, business_key: str, sk: str = "sk",
                          rows_per_cell: int = 2_000_000) -> DataFrame:
    """New business keys continue after the dimension's highest id."""
    top = dim.agg(F.coalesce(F.max(sk), F.lit(0))).first()[0]
    fresh = incoming.join(dim.select(business_key), business_key, "left_anti")
    # The least row of each key, by its other columns in their order, so reruns agree.
    others = [c for c in incoming.columns if c != business_key]
    one = fresh.groupBy(business_key).agg(F.min(F.struct(*others)).alias("_row")) if others else fresh.distinct()
    picked = one.select(*[F.col(c) if c == business_key else F.col(f"_row.{c}").alias(c) for c in incoming.columns])
    return surrogate_key(store(picked, "new-keys"), business_key, top, sk, rows_per_cell)


def with_record_hash(df: DataFrame, columns: list[str], name: str = "record_hash") -> DataFrame:
    return df.withColumn(name, checksum(*columns))


def _struct(side: str, cols: list[str]) -> Column:
    return F.struct(*[F.col(f"{side}.{c}") for c in cols])


def _paired(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Both images side by side; NULL keys meet NULL keys.

    Each image holds a key at most once, so no key is hot here.
    """
    on = [F.col(f"b.{k}").eqNullSafe(F.col(f"a.{k}")) for k in keys]
    return (
        before.withColumn("_in", F.lit(True)).alias("b")
        .join(after.withColumn("_in", F.lit(True)).alias("a"), on, "full")
    )


def change_capture(before: DataFrame, after: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, ``change`` (insert / update / delete / unchanged), old_* and new_* values.

    NULL-safe compare of the columns themselves: no hash collisions, no text rendering.  A key that occurs twice in one
    image is an error.
    """
    change = (
        F.when(F.col("b._in").isNull(), "insert")
        .when(F.col("a._in").isNull(), "delete")
        .when(_struct("b", columns).eqNullSafe(_struct("a", columns)), "unchanged")
        .otherwise("update")
    )
    return _paired(single(before, keys, "before"), single(after, keys, "after"), keys).select(
        *[F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in keys],
        change.alias("change"),
        *[F.col(f"b.{c}").alias(f"old_{c}") for c in columns],
        *[F.col(f"a.{c}").alias(f"new_{c}") for c in columns],
    )


def single(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    """The same rows, but the plan raises an error where a key occurs twice."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return df.withColumn("_once", _at_most_one(n, keys, what)).where("_once").drop("_once")


def _at_most_one(n: Column, keys: list[str], what: str) -> Column:
    """True, or an error that names the key where ``n`` rows hold it."""
    message = F.concat(F.lit(f"{what}: key occurs more than once: "),
                       F.concat_ws(",", *[F.coalesce(F.col(k).cast("string"), F.lit("NULL")) for k in keys]))
    return F.when(n > 1, F.raise_error(message)).otherwise(F.lit(True))


def merge_upsert(master: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Update matched keys, insert new ones, keep the rest.  A matched NULL does overwrite.

    Two updates of one key are an error; master rows are taken as they are.
    """
    values = [c for c in master.columns if c not in keys]
    given = set(updates.columns)
    pairs = _paired(master, single(updates, keys, "merge"), keys)
    hit = F.col("a._in").isNotNull()
    return pairs.select(
        *[F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in keys],
        *[
            F.when(hit, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c) if c in given
            else F.col(f"b.{c}").alias(c)
            for c in values
        ],
    )


def merge_update_reject(master: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Update rows that have no master row."""
    return updates.join(master.select(*keys).distinct(), keys, "left_anti").withColumn(
        "_reject_reason", F.lit(f"No match on {','.join(keys)}")
    )


def change_apply(before: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Apply the rows of ``change_capture`` to a before-image."""
    acts = changes.where("change <> 'unchanged'")
    done = acts.select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    untouched = before.select(*keys, *columns).join(done, same, "left_anti")
    written = acts.where("change in ('insert', 'update')").select(
        *keys, *[F.col(f"new_{c}").alias(c) for c in columns]
    )
    return untouched.unionByName(written)


def scd1(dim: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Type 1: attributes are overwritten in place."""
    return merge_upsert(dim, updates, keys)


def collapse_unchanged(versions: DataFrame, keys: list[str], order: list[str], columns: list[str],
                       cell: Column | None = None, rows_per_cell: int = 2_000_000) -> DataFrame:
    """Drop a version whose columns equal those of the version before it.

    Without a ``cell`` of the caller's, keys of more than ``rows_per_cell`` versions are cut by row counts.
    """
    # The columns themselves are compared, NULL-safe: no text rendering can make two versions alike.
    before = {f"_last_{i}": c for i, c in enumerate(columns)}
    marked, values = versions.withColumn("_row", F.lit(True)), {"_has_last": "_row", **before}
    seen = (neighbour_by_size(marked, keys, order, values, -1, rows_per_cell) if cell is None
            else neighbour(marked, keys, order, cell, values, step=-1))
    same = F.col("_has_last").isNotNull()
    for last, column in before.items():
        same = same & F.col(column).eqNullSafe(F.col(last))
    return seen.where(~same).drop("_row", "_has_last", *before)


def scd2_history(versions: DataFrame, keys: list[str], order: list[str], cell: Column | None = None,
                 rows_per_cell: int = 2_000_000) -> DataFrame:
    """Type 2 history: EFF_END_DATE is the next version's start, the open one ends at 9999-12-31.

    Without a ``cell`` of the caller's, keys of more than ``rows_per_cell`` versions are cut by row counts.
    """
    start = order[0]
    out = (neighbour_by_size(versions, keys, order, {"_next": start}, 1, rows_per_cell) if cell is None
           else neighbour(versions, keys, order, cell, {"_next": start}))
    return (
        out.withColumn("EFF_END_DATE", F.coalesce(F.col("_next").cast("date"), F.lit(OPEN_END).cast("date")))
        .withColumn("IS_CURRENT_FLAG", F.when(F.col("_next").isNull(), 1).otherwise(0))
        .drop("_next")
    )


def scd2_merge(dim: DataFrame, snapshot: DataFrame, keys: list[str], columns: list[str],
               run_date: str, defaults: dict[str, Column] | None = None) -> DataFrame:
    """Type 2 load of a full snapshot.

    dim: keys, columns, EFF_START_DATE, EFF_END_DATE, IS_CURRENT_FLAG and any other columns.  Versions that are not
    current (flag 0, or NULL) stay as they are.  A changed current version is expired at the run date and followed by a
    new one; a new key is inserted; an unchanged or absent key stays open.  Loading the same snapshot again adds nothing.
    Other columns of the dimension stay with their versions; new versions get NULL there, or what ``defaults`` gives.
    NULL keys meet NULL keys; a key that occurs twice in the snapshot is an error.
    """
    day = F.lit(run_date).cast("date")
    is_current = F.coalesce(F.col("IS_CURRENT_FLAG") == 1, F.lit(False))
    others = [c for c in dim.columns if c not in {*keys, *columns, "EFF_START_DATE", "EFF_END_DATE", "IS_CURRENT_FLAG"}]

    def version(side: str, start: Column, end: Column, flag: Column, rest: dict[str, Column]) -> Column:
        """Fields by name, each cast to the dimension's own type."""
        return F.struct(*[F.col(f"{side}.{c}").cast(dim.schema[c].dataType).alias(c) for c in columns],
                        start.cast("date").alias("EFF_START_DATE"), end.cast("date").alias("EFF_END_DATE"),
                        flag.cast("int").alias("IS_CURRENT_FLAG"),
                        *[rest.get(c, F.lit(None)).cast(dim.schema[c].dataType).alias(c) for c in others])

    # Both images meet in one exchange by key; each row sees the snapshot's row of its key.
    before = dim.where(is_current).select(*keys, F.struct(*[c for c in dim.columns if c not in keys]).alias("_old"))
    after = snapshot.select(*keys, F.struct(F.lit(True).alias("_in"), *columns).alias("_new"))
    mate = Window.partitionBy(*keys)
    met = before.unionByName(after, allowMissingColumns=True).select(
        *keys, "_old", F.first("_new", ignorenulls=True).over(mate).alias("_new"),
        F.count("_old").over(mate).alias("_olds"), F.count("_new").over(mate).alias("_news")).where(_at_most_one(F.col("_news"), keys, "snapshot"))
    same = _struct("_old", columns).eqNullSafe(_struct("_new", columns))
    has_old, has_new = F.col("_old").isNotNull(), F.col("_new").isNotNull()
    changed = has_old & has_new & ~same
    old = version("_old", F.col("_old.EFF_START_DATE"), F.when(changed, day).otherwise(F.col("_old.EFF_END_DATE")),
                  F.when(changed, 0).otherwise(1), {c: F.col(f"_old.{c}") for c in others})
    new = version("_new", day, F.lit(OPEN_END), F.lit(1), defaults or {})
    versions = F.filter(
        F.array(F.when(has_old, old), F.when(has_new & (~has_old | changed), new)),
        lambda v: v.isNotNull(),
    )
    loaded = met.where(has_old | (F.col("_olds") == 0)).select(*keys, F.explode(versions).alias("_v")).select(*keys, "_v.*")
    return dim.where(~is_current).select(*loaded.columns).unionByName(loaded)


def scd3(versions: DataFrame, keys: list[str], order: list[str], column: str) -> DataFrame:
    """Type 3: current and previous value per key; two rows per key and task reach the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    top = versions.withColumn("_rn", F.row_number().over(w)).where("_rn <= 2")
    return top.groupBy(*keys).agg(
        F.max(F.when(F.col("_rn") == 1, F.col(column))).alias("current_value"),
        F.max(F.when(F.col("_rn") == 2, F.col(column))).alias("previous_value"),
    )


def as_of(dim: DataFrame, date) -> DataFrame:
    """The versions valid on a date: EFF_START_DATE <= d < EFF_END_DATE."""
    d = F.lit(date).cast("date") if isinstance(date, str) else date
    return dim.where((F.col("EFF_START_DATE") <= d) & (d < F.col("EFF_END_DATE")))


def join_as_of(facts: DataFrame, dim: DataFrame, keys: list[str], at: str, days: int = 30) -> DataFrame:
    """Each fact with the version of its key valid at its date (versions of a key do not overlap).

    Facts and versions share one timeline per (key, cell of ``days``) and the newest version is
    carried forward, so no fact meets more than one version and a hot key is many cells.  A cell
    starts with the last version of the key's earlier cells.
    """
    versions = [c for c in dim.columns if c not in keys]
    kept = F.struct(*versions)
    timeline = facts.withColumn("_at", F.col(at).cast("date")).withColumn("_kind", F.lit(2)).unionByName(
        dim.select(*keys, F.col("EFF_START_DATE").alias("_at"), F.lit(1).alias("_kind"), kept.alias("_version")),
        allowMissingColumns=True,
    ).withColumn("_cell", day_cells(F.col("_at"), days))
    ends = timeline.groupBy(*keys, "_cell").agg(
        F.max_by("_version", F.when(F.col("_kind") == 1, F.col("_at"))).alias("_version")
    )
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select(*keys, "_cell", F.last("_version", ignorenulls=True).over(before).alias("_version"),
                         F.lit(0).alias("_kind")).where("_version IS NOT NULL")
    so_far = Window.partitionBy(*keys, "_cell").orderBy(
        F.when(F.col("_kind") == 0, 0).otherwise(1), "_at", "_kind"
    ).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = timeline.unionByName(starts, allowMissingColumns=True).withColumn(
        "_valid", F.last("_version", ignorenulls=True).over(so_far)
    )
    # A NULL key is in no version's group by equality.
    for k in keys:
        placed = placed.where(F.col(k).isNotNull())
    return placed.where((F.col("_kind") == 2) & (F.col("_at") < F.col("_valid.EFF_END_DATE"))).select(
        *facts.columns, *[F.col(f"_valid.{v}").alias(v) for v in versions]
    )
