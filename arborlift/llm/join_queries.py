"""The n-gram Jaccard join as a registered query."""

from __future__ import annotations

from arborlift.llm import gram_join
from arborlift.llm.base import query, table

JOIN_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
   '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(w)=0 THEN [] WHEN len(w)<5 THEN [array_to_string(w, ' ')]
   ELSE [array_to_string(w[k:k+4], ' ') FOR k IN range(1, len(w)-3)] END) AS s FROM w),
g AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k, any_value(a.n) AS nu, any_value(b.n) AS nv
  FROM g a JOIN g b ON a.g=b.g AND a.doc_id<b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS MATERIALIZED (SELECT u, v FROM c WHERE 100*k>=80*(nu+nv-k)),
e AS MATERIALIZED (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT doc_id AS a, doc_id AS z FROM s UNION SELECT e.v AS a, r.z FROM r JOIN e ON e.u=r.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.component_id
FROM s JOIN (SELECT a AS doc_id, min(z) AS component_id FROM r GROUP BY a) m USING (doc_id)"""


@query("op12_ngram_join", JOIN_SQL)
def _(spark, d):
    return gram_join.similar_components(table(spark, d, "documents"))
