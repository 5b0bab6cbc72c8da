"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stagecraft.runtime import fresh_path, shared_folder

# A word is a run of bytes other than these; ``bytes.split()`` splits at exactly the same six.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def as_bytes(name: str) -> Column:
    """A text column as UTF-8 bytes, NULL as empty."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")).cast("binary")


def id_crc(name: str) -> Column:
    """CRC-32 of an id written as decimal text; a NULL id counts as empty text."""
    return F.crc32(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")).cast("binary"))


def free_names(df: DataFrame, *names: str) -> dict[str, str]:
    """Column names that clash with none of the table's own, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, {}
    for name in names:
        out[name] = f"own_{name}"
        while out[name] in taken:
            out[name] += "_"
    return out


def hex64(value: Column) -> Column:
    """A long as 16 lower-case hexadecimal digits of its two's complement."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))


class Memo(dict):
    """A bounded word cache: ``memo[word]`` computes a missing value and forgets all when full.

    Keys longer than ``longest`` are computed each time and not kept.
    """

    def __init__(self, compute: Callable, limit: int, longest: int = 64) -> None:
        super().__init__()
        self.compute, self.limit, self.longest = compute, limit, longest

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value


def tune_batches(spark: SparkSession) -> SparkSession:
    """Keep Arrow batches of long texts small: a Python worker holds a few megabytes of text at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return spark


def map_arrow(df: DataFrame, make: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with one ``RecordBatch -> dict of columns`` function per task.

    ``make()`` runs once in each task and may hold caches.
    """
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                for out in step(batch):
                    yield pa.RecordBatch.from_pydict(out, schema=arrow)
        step = batch = out = None
        release()

    return df.mapInArrow(run, schema)


def release() -> None:
    """Give memory that a task no longer needs back to the system: Python workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def drop_stored(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table written by ``store`` that nothing reads any more."""
    jvm, folder = spark.sparkContext._jvm, shared_folder(spark)
    for parent in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if folder.rpartition("/")[2] not in parent:
            raise ValueError(f"{parent} is not below {folder}")
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Tables of one computation below one folder of the shared folder, deleted when a round no longer needs them."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark, self.folder, self.stored = spark, fresh_path(spark, label), {}

    def store(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{len(self.stored)}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.stored[path] = out
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete tables of this folder; others, and those deleted before, are left alone."""
        for path, df in self.stored.items():
            if df is not None and any(df is t for t in tables):
                where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
                self.stored[path] = None
