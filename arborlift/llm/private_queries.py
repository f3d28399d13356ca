"""Personal data spans as a registered query."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from arborlift.llm import private_data as P
from arborlift.llm.base import query, table


def _joined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        frame["spans"] = [P.span_text(P.all_spans(b, m)) if m is not None else b for b, m in zip(frame["spans"], frame["more"], strict=True)]
        yield frame.drop(columns="more")


@query("op3_pii")
def _(spark, d):
    base, found = P.find_private(table(spark, d, "documents"))
    counts = [F.col("n")[i].alias(f"n_{k}") for i, k in enumerate(P.KINDS[:4])]
    added = [F.expr(f"coalesce(size(filter(more, m -> m.kind = '{k}')), 0)").cast("bigint").alias(f"n_{k}") for k in P.KINDS[4:]]
    rows = base.join(found, P.KEY, "left").select("doc_id", "gone", *counts, F.col("sha").alias("base_sha256"), "spans", *added, "more")
    plain = rows.where(F.col("more").isNull())
    kinds = ", ".join(f"n_{k} long" for k in P.KINDS[:4])
    more = rows.where(F.col("more").isNotNull()).mapInPandas(
        _joined, f"doc_id long, gone boolean, {kinds}, base_sha256 string, spans string, n_secret long, n_identifier long")
    return plain.drop("more").withColumns({c: F.lit(0).cast("bigint") for c in ("n_secret", "n_identifier")}).unionByName(more).withColumn(
        "doc_id", F.when(~F.col("gone"), F.col("doc_id"))).drop("gone")
