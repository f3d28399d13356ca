"""Fill-in-middle as a registered query."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborlift.llm import fill_middle
from arborlift.llm.base import query, table

FILL_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:'||coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS units,
  [CAST('0x'||substr(h, 8*k+1, 8) AS BIGINT) FOR k IN [0, 1, 2, 3]] AS r FROM d),
c AS (SELECT *, CAST(len(units) AS BIGINT) AS n, least(r[1]%(len(units)+1), r[2]%(len(units)+1)) AS a,
  greatest(r[1]%(len(units)+1), r[2]%(len(units)+1)) AS b,
  CASE WHEN text='' OR contains(text,'<P>') OR contains(text,'<S>') OR contains(text,'<M>') OR r[3]%100>=100 THEN 'plain'
    WHEN r[4]%100<50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(units[1:a], '') AS pre, array_to_string(units[a+1:b], '') AS mid, array_to_string(units[b+1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form<>'plain' THEN length(pre) END AS prefix_chars,
  CASE WHEN form<>'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>'||pre||'<S>'||suf||'<M>'||mid ELSE '<S>'||suf||'<P>'||pre||'<M>'||mid END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p"""


@query("op13_fill_in_middle", FILL_SQL)
def _(spark, d):
    made = fill_middle.fill_middle(table(spark, d, "documents"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
