"""Hard-negative mining as a registered query."""

from __future__ import annotations

from arborlift.llm import mining
from arborlift.llm.base import query, table

MINING_SQL = """
WITH e AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id%7=0 THEN (label+1)%10 ELSE label END AS label,
   [CAST(floor(CAST(x AS DOUBLE)*256) AS DOUBLE) FOR x IN embedding] AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
   AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x)))=0),
s AS MATERIALIZED (SELECT a.r, a.vec_id AS anchor_id, o.vec_id AS other_id, a.label=o.label AS same,
   CAST(list_dot_product(a.v, o.v) AS BIGINT) AS score FROM e a JOIN e o ON a.vec_id%50=0 AND a.r<>o.r),
p AS (SELECT r, other_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY r ORDER BY score DESC, other_id) AS k
  FROM s WHERE same QUALIFY k<=5),
n AS (SELECT s.anchor_id, p.positive_id, p.positive_score, s.other_id AS negative_id, s.score AS negative_score,
   row_number() OVER (PARTITION BY p.r, p.k ORDER BY s.score DESC, s.other_id) AS "rank"
  FROM p JOIN s ON p.r=s.r AND NOT same AND 50*positive_score<=100*score AND 100*score<=95*positive_score)
SELECT anchor_id, positive_id, CAST("rank" AS INT) AS "rank", negative_id, positive_score, negative_score FROM n WHERE "rank"<=3"""


@query("op11_hard_negatives", MINING_SQL)
def _(spark, d):
    return mining.hard_negatives(table(spark, d, "embeddings"))
