"""Ranked search of the benchmark items in ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stagecraft.llm import fptree
from stagecraft.llm.queries.registry import query
from stagecraft.runtime import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

RANKED_SQL = rf"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT doc_id, count(*) AS n FROM d GROUP BY 1),
g AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM s),
p AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM d GROUP BY 1, 2),
f AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, g GROUP BY term, docs),
m AS (SELECT doc_id, 50 + (50 * n * docs) // terms AS m FROM s, g),
r AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
      FROM i JOIN f USING (term) JOIN p USING (term) JOIN m USING (doc_id) GROUP BY 1, 2),
o AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM r WHERE score > 0)
SELECT * FROM o WHERE rank <= 50
"""


@query("op11_ranked_search", RANKED_SQL)
def ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    found = fptree.ranked_search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("item_id", "rank", "doc_id", "score")
