"""Queries over ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stagecraft.llm import topk
from stagecraft.llm.queries.registry import query
from stagecraft.runtime import table

TOP_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@query("op6_exact_top_k", TOP_SQL)
def top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.exact_top_k(table(spark, folder, "embeddings"), F.col("id") % 20 == 0)
