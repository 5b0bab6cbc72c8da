"""Mixing sources to target weights by Sainte-Laguë apportionment.

Everything here is a DataFrame or SQL function.  Each source gets a target in words: its share by weight of
the whole mix, at most ``cap`` times what it has, the excess shared again by weight.  The mix is dealt out in
blocks of equal size.  Sainte-Laguë gives each seat (block) to the highest quotient w / (2k - 1); it is used
twice, first among the sources with the targets as votes, then, inside a source, among its shards with
their words as votes, so every shard has an integer quota of blocks.  A shard's documents lie in a seeded
order; its word stream is cut into blocks and the quota takes blocks from the front, going round a second
time when the quota is larger than the stream.

Seats that are certain are counted by a formula: with divisor W / (S - n/2) no more than S seats pass, with
W / (S + n/2) at least S do, so only the seats between (about 2n of them) are listed and ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stagecraft.llm.ranks import running
from stagecraft.llm.util import free_names
from stagecraft.runtime import store

BLANKS = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of runs of characters other than the six ASCII blanks; NULL has none."""
    inner = F.btrim(F.coalesce(text.cast("string"), F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(inner == "", 0).otherwise(F.size(F.split(inner, BLANKS))).cast("long")


def seeded(id_col: str, text_col: str, seed: int) -> Column:
    """The position of a document in its shard; depends on the document and the seed alone."""
    return F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), F.lit(seed))


def source_key(source: Column) -> Column:
    """A source as a text that is never NULL and sorts by code point, NULL last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Add ``target`` to (key, source_size): shares by weight, filled up to the caps.

    Sources are taken by how soon their cap is reached (cap / weight); the level is that of the first
    source whose cap lies above what would be left for it.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = running(sources, [F.col("key").asc()]).withColumn("weight", weight).drop("rank")
    filled = store(running(ranked.withColumn("full_at", cap * F.col("source_size") / F.col("weight")),
                           [F.col("full_at").asc(), F.col("key").asc()],
                           caps=cap * F.col("source_size"), weights=F.col("weight")), "filled")
    words, weights_ = filled.agg(F.sum("source_size"), F.sum("weight")).first()  # two numbers
    level = (F.lit(share * (words or 0)) - F.col("caps")) / (F.lit(weights_ or 0.0) - F.col("weights"))
    line = filled.withColumn("level", level).where("level < full_at").agg(F.min_by("level", "rank")).first()[0]
    full = F.lit(cap) * F.col("source_size")
    return filled.select("key", "source_size", (full if line is None else F.least(F.lit(line) * F.col("weight"), full)).cast("double").alias("target"))


def apportion(df: DataFrame, key: str, votes: str, seats: str, group: str | None = None) -> DataFrame:
    """Add ``quota``: ``seats`` (the same number on all rows of a group) dealt out by highest quotients.

    ``key`` is unique inside a group and breaks ties; rows without votes get none.  Without ``group`` the
    whole table is one group.
    """
    by = [group] if group else []
    voting = df.where(F.col(votes) > 0)
    totals = [F.sum(votes).cast("double").alias("all_votes"), F.count(F.lit(1)).alias("voters"), F.max(seats).cast("long").alias("all_seats")]
    if by:
        joined = voting.join(voting.groupBy(*by).agg(*totals), by)
    else:
        joined = voting.withColumns({k: F.lit(v) for k, v in voting.agg(*totals).first().asDict().items()})
    part = F.col(votes) / F.col("all_votes")
    low = F.greatest(F.lit(0), F.floor(part * (F.col("all_seats") - F.col("voters") / 2) + 0.5 - 1e-9))
    high = F.floor(part * (F.col("all_seats") + F.col("voters") / 2) + 0.5 + 1e-9) + 1
    sized = joined.withColumns({"low": low.cast("long"), "high": high.cast("long")})
    given = (F.max("all_seats") - F.sum("low")).alias("open")
    listed = sized.select(*by, key, votes, F.explode(F.sequence(F.col("low") + 1, F.col("high"))).alias("seat")).withColumn(
        "quotient", F.col(votes) / (2 * F.col("seat") - 1))
    order = [F.col("quotient").desc(), F.col(key).asc(), F.col("seat").asc()]
    if by:
        # Ranked over the whole table, group after group: a group with very many voters is cut into ranges.
        ranked = store(running(listed, [F.col(group).asc(), *order]), "seats")
        first = ranked.groupBy(*by).agg(F.min("rank").alias("first"))
        won = ranked.join(first.join(sized.groupBy(*by).agg(given), by), by).withColumn("rank", F.col("rank") - F.col("first"))
    else:
        won = running(listed, order).withColumn("open", F.lit(sized.agg(given).first()[0] or 0))
    won = won.where("rank < open").groupBy(*by, key).agg(F.count(F.lit(1)).alias("won"))
    return df.join(sized.select(*by, key, "low").join(won, [*by, key], "left"), [*by, key], "left").withColumn(
        "quota", F.coalesce(F.col("low"), F.lit(0)) + F.coalesce(F.col("won"), F.lit(0))).drop("low", "won")


def plan_mix(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], share: float,
             cap: float, block: int, shard_docs: int, seed: int) -> DataFrame:
    """One row per document: size, source figures, shard, and where its words lie in the shard's stream."""
    sizes = store(docs.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), word_count(F.col(f"`{text_col}`")).alias("size"),
        seeded(id_col, text_col, seed).alias("place")).withColumn("key", source_key(F.col("source"))), "sizes")
    sources = sizes.groupBy("key").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    aimed = targets(sources.select("key", "source_size"), weights, share, cap)
    blocks = round((aimed.agg(F.sum("target")).first()[0] or 0) / block)
    quotas = store(apportion(aimed.withColumn("blocks", F.lit(blocks).cast("long")), "key", "target", "blocks").join(
        sources.select("key", "docs"), "key").select(
        "key", "source_size", "target", F.col("quota").alias("source_quota"), F.ceil(F.col("docs") / shard_docs).alias("shards")), "quotas")
    placed = sizes.join(quotas, "key").withColumn("shard", F.pmod(F.xxhash64("place"), F.col("shards")))
    streams = placed.groupBy("key", "shard").agg(F.sum("size").alias("stream"), F.max("source_quota").alias("source_quota"))
    shards = apportion(streams, "shard", "stream", "source_quota", "key").select("key", "shard", "stream", "quota")
    ahead = Window.partitionBy("key", "shard").orderBy("place", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    return placed.join(shards, ["key", "shard"]).withColumns({
        "before": F.coalesce(F.sum("size").over(ahead), F.lit(0)), "words": F.col("quota") * block})


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, block: int = 16,
        shard_docs: int = 4_000, seed: int = 20_240_601) -> DataFrame:
    """(id, size, source_size, target, taken) of each document; ``taken`` counts repeated words twice.

    NULL text has no words and takes none; NULL is a source of its own, sorted last; rows with equal id and
    text are interchangeable; an empty table gives an empty result; other columns are not read.  The result
    depends on the rows and the seed only, not on how they are partitioned.
    """
    placed = plan_mix(docs, id_col, text_col, source_col, weights, share, cap, block, shard_docs, seed)
    got = lambda turn: F.greatest(F.lit(0), F.least(F.col("words") - turn * F.col("stream") - F.col("before"), F.col("size")))
    return placed.select("id", "size", "source_size", "target", (got(0) + got(1)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, block: int = 16,
                    shard_docs: int = 4_000, seed: int = 20_240_601) -> DataFrame:
    """The documents of the mix, whole, once or twice each, with all their columns.

    A document is in as often as at least half of its words are taken.  Since documents lie in seeded
    order, that is a cut-off position per shard and turn; only these small rows are joined with the texts.
    """
    names = free_names(docs, "key", "shard", "shards", "place", "first", "second", "turn")
    placed = plan_mix(docs, id_col, text_col, source_col, weights, share, cap, block, shard_docs, seed)
    fits = lambda turn: turn * F.col("stream") + F.col("before") + F.col("size") / 2 <= F.col("words")
    cuts = store(placed.groupBy("key", "shard").agg(
        F.max("shards").alias("shards"), F.max(F.when(fits(0), F.col("place"))).alias("first"),
        F.max(F.when(fits(1), F.col("place"))).alias("second")), "cuts")
    counts = cuts.groupBy("key").agg(F.max("shards").alias(names["shards"])).withColumnRenamed("key", names["key"])
    cuts = cuts.select(*[F.col(c).alias(names[c]) for c in ("key", "shard", "first", "second")])
    marked = docs.withColumns({names["key"]: source_key(F.col(f"`{source_col}`")), names["place"]: seeded(id_col, text_col, seed)})
    marked = marked.join(counts, names["key"]).withColumn(
        names["shard"], F.pmod(F.xxhash64(names["place"]), F.col(names["shards"]))).join(cuts, [names["key"], names["shard"]])
    times = sum(F.coalesce(F.col(names["place"]) <= F.col(names[c]), F.lit(False)).cast("int") for c in ("first", "second"))
    return marked.withColumn(names["turn"], F.explode(F.array_repeat(F.lit(1), times))).select(*[F.col(f"`{c}`") for c in docs.columns])
