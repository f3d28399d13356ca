"""Language-model scores as a registered query."""

from __future__ import annotations

from arborlift.llm import mixing
from arborlift.llm.base import query, table


@query("op5_lm_scoring")
def _(spark, d):
    return mixing.score(table(spark, d, "documents"))
