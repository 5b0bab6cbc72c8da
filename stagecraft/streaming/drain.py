"""Running a stream to the end of its input, with exactly-once output folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from stagecraft.runtime import fresh_path


def drain_append(stream: DataFrame, path: str | None = None, state: str | None = None) -> DataFrame:
    """Append-mode parquet sink (exactly once by its own log); returns the written rows.

    Called again with the same path and state folder it goes on where it stopped.
    """
    spark = stream.sparkSession
    path = path or fresh_path(spark, "stream-out")
    state = state or fresh_path(spark, "stream-state")
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", state)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def drain_updates(stream: DataFrame, keys: list[str], path: str | None = None) -> DataFrame:
    """Update-mode rows, one folder per batch; a batch that runs twice overwrites its own folder.

    Returns the newest row of every key.
    """
    spark = stream.sparkSession
    path = path or fresh_path(spark, "stream-out")

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = (
        stream.writeStream.outputMode("update").foreachBatch(sink)
        .option("checkpointLocation", fresh_path(spark, "stream-state"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return newest(spark, path, stream, keys)


def newest(spark: SparkSession, path: str, like: DataFrame, keys: list[str]) -> DataFrame:
    values = [c for c in like.columns if c not in keys]
    schema = T.StructType([*like.schema.fields, T.StructField("batch", T.LongType())])
    rows = spark.read.schema(schema).parquet(path)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v")).select(
        *keys, *[F.col(f"_v.{v}").alias(v) for v in values]
    )
