"""Near-duplicate classes as a registered query."""

from __future__ import annotations

from arborlift.llm import near_dedup
from arborlift.llm.base import query, table


@query("op2_minhash_near_dedup")
def _(spark, d):
    return near_dedup.near_classes(table(spark, d, "documents"))
