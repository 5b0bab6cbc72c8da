"""Session settings, the shared scratch folder, and lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

# Runtime SQL settings every plan relies on.  AQE splits skewed join partitions; the force
# flag keeps that split even where a later operator would have reused the join's partitioning.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # A property named twice in one stage keeps its last value.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings to a session somebody else built."""
    for key, value in SQL_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(app: str = "stagecraft", cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
    )
    for key, value in SQL_SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Only a local session that names none (tests, a laptop) gets a fresh temporary folder: on a cluster
    each executor would write to a disk of its own, and rows would be missing without an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if named is None and current is None and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if current is None:
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="stagecraft-"))
        current = spark.sparkContext.getCheckpointDir()
    return (named or current).rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss and ends plan growth in loops."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame, label: str = "table") -> DataFrame:
    """Write a table to the shared folder and read it back.

    Also ends lineage; preferred where several readers need few of many columns, since the scan
    prunes columns and knows the table's size.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def store_counted(df: DataFrame, label: str = "table", **conditions: Column) -> tuple[DataFrame, dict[str, int]]:
    """``store``, and how many of the written rows meet each condition, counted by the write itself."""
    seen = Observation()
    out = store(df.observe(seen, *[F.count(F.when(c, 1)).alias(k) for k, c in conditions.items()]), label)
    return out, dict(seen.get)


def store_split(df: DataFrame, column: str, label: str = "pins") -> DataFrame:
    """``store``, cut into a folder for each value of a text column: a reader of one value reads only its folder.

    The rows are computed once, however many outputs a stage has.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.partitionBy(column).parquet(path)
    return spark.read.schema(df.select(*[c for c in df.columns if c != column], column).schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


PART_BYTES = 4 << 20  # of a table's files, to one part of its shuffles


def spread(spark: SparkSession, folder: str, name: str) -> None:
    """Let shuffles start with as many parts as the size of a table's files asks for; AQE joins those that are small.

    With a fixed number of parts a task's share, and the memory it needs, would grow with the table.  AQE joins parts up
    to 16 MB, less than its default, since such rows are many times as large in memory.
    """
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16m")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    size = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(size // PART_BYTES, 20_000))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(parts))
