"""What the corpus operators share: registry, table access, text columns, batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# ASCII letters, and the white space that parts words.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = "\t\n\x0b\x0c\r "
SPACES = r"[\x20\x09-\x0D]+"


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def whole(text: str | Column) -> Column:
    """The text with null read as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def split_words(text: Column, gap: str = SPACES) -> Column:
    """Words between runs of ``gap``, as an array without empty strings."""
    return F.array_remove(F.split(text, gap), "")


def by_size(frames: Iterator[pd.DataFrame], text: str, limit: int) -> Iterator[pd.DataFrame]:
    """Cut batches into runs of rows of about ``limit`` characters, one row at least.

    Bounds what a task holds at once; no row is cut or left out.
    """
    for frame in frames:
        frame[text] = frame[text].fillna("")
        upto = frame[text].str.len().cumsum().to_numpy()
        first = 0
        while first < len(frame):
            before = upto[first - 1] if first else 0
            last = max(first + 1, int(upto.searchsorted(before + limit, side="right")))
            yield frame.iloc[first:last]
            first = last
