"""Queries over ``conversations``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stagecraft.llm import chat, turntree
from stagecraft.llm.queries.registry import query
from stagecraft.runtime import table

FENCED = "</s>[INST] ok [/INST]"
EXTRA = [(-7, 0, "user", FENCED), (-7, 1, "assistant", FENCED)]


@query("op8_chat_format")
def chat_format(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(EXTRA, turns.schema)
    return chat.read_back(chat.format_conversations(turns.unionByName(extra)))


TREE_SQL = """
WITH raw AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT c, role, text, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, sha256(strlen(role)::VARCHAR || ':' || role || text)) - 1 AS p FROM raw),
k AS (SELECT DISTINCT c, c - c % 20 AS b, xor(list_reduce(
        list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
        lambda s, x: list_reduce(list_prepend(xor(s, x), range(8)), lambda q, i: CASE WHEN q & 1 = 1 THEN xor(q >> 1, 3988292384) ELSE q >> 1 END)),
        4294967295) % 4 AS h FROM t),
r AS (SELECT k.c, 0 AS part, p, role, text FROM k JOIN t ON t.c = k.b AND p < h
      UNION ALL SELECT k.c, 1, p, role, text FROM k JOIN t ON t.c = k.c AND p >= h),
s AS (SELECT k.c, coalesce(list({'role': role, 'text': text} ORDER BY part, p) FILTER (WHERE p IS NOT NULL), []) AS turns
      FROM k LEFT JOIN r ON r.c = k.c GROUP BY k.c),
m AS (SELECT c, len(turns) AS size, d AS depth, turns[1:d] AS path FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM s)),
n AS (SELECT path, depth, min(c) AS conv_id, count(*) AS n_convs,
             coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE size = depth), '') AS ends FROM m GROUP BY path, depth),
x AS (SELECT p.*, coalesce(z.n, 0) AS n_children, q.conv_id AS parent_conv_id,
             CASE WHEN p.depth > 0 THEN (p.n_convs - 1) * len(regexp_extract_all(p.path[-1].text, '[^\\x20\\x09-\\x0D]+')) ELSE 0 END AS saved
      FROM n p LEFT JOIN (SELECT path[1:depth - 1] AS path, depth - 1 AS depth, count(*) AS n FROM n WHERE depth > 0 GROUP BY 1, 2) z
             ON z.path = p.path AND z.depth = p.depth
           LEFT JOIN n q ON p.depth > 0 AND q.depth = p.depth - 1 AND q.path = p.path[1:p.depth - 1]),
u AS (SELECT path[1:d] AS path, d AS depth, sum((n_children = 0)::BIGINT) AS n_leaves, sum(saved) AS saved_tokens
      FROM (SELECT *, unnest(range(depth + 1)) AS d FROM x) GROUP BY 1, 2)
SELECT x.conv_id::BIGINT AS conv_id, x.depth::BIGINT AS depth, x.parent_conv_id::BIGINT AS parent_conv_id, x.n_convs::BIGINT AS n_convs,
       x.n_children::BIGINT AS n_children, u.n_leaves::BIGINT AS n_leaves, u.saved_tokens::BIGINT AS saved_tokens, sha256(x.ends) AS ends_sha256
FROM x JOIN u ON u.path = x.path AND u.depth = x.depth
"""


@query("op13_prefix_trie", TREE_SQL)
def prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return turntree.prefix_tree(table(spark, folder, "conversations"))
