"""Main text of pages and toxicity of documents as registered queries."""

from __future__ import annotations

from arborlift.llm import html_text, toxicity
from arborlift.llm.base import query, table


@query("op1_html_extraction")
def _(spark, d):
    return html_text.extract(table(spark, d, "pages"))


@query("op4_toxicity")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, d, "labels"))
    return toxicity.with_severity(docs, model).select("doc_id", "_toxicity.*")
