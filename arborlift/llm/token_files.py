"""Token-id files: documents in id order, ids coded by Simple-8b.

``write_token_files`` sorts documents by id over the whole table (range
partitions, ties by a hash of the text), encodes them where they lie, and writes
one table of groups. A group holds whole documents, about ``GROUP`` ids, one document at least:

    part, group   order of the groups over the files
    first         ids of the part before the group
    n_ids, escapes, words, offsets   Simple-8b blocks and the first word of each
    ids, nulls, lengths              document ids, which are null, ids in each

``read_token_files`` reads them back: per document its id, where its ids start
among those of all documents, and the ids. Spark's own writer and reader carry
the table, so files may lie in any store that Spark knows.

Null texts are empty and still get their end id; null document ids come first;
rows of equal id stay apart, in an order that is fixed but for equal texts. An
empty table gives a table without groups. No text is cut; a task holds a group, or the longest document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arborlift.llm import simple8b
from arborlift.llm.base import by_size, whole

GROUP = 1 << 18
#: Characters whose texts are encoded together.
BATCH = 1 << 21
WRITTEN = (
    "part int, `group` int, first long, n_ids long, escapes int, words binary, offsets binary, "
    "ids array<long>, nulls array<boolean>, lengths array<int>"
)


def _coder(path: str, end_id: int | None):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from arborlift.llm.tokens import encoder

        encode, part, group, first = encoder(path).encode_all, TaskContext.get().partitionId(), 0, 0
        end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        held: list[tuple[int, bool, np.ndarray]] = []
        size = 0

        def close() -> pd.DataFrame:
            values = np.concatenate([x[2] for x in held])
            words, offsets, escapes = simple8b.encode(values)
            return pd.DataFrame([{
                "part": part, "group": group, "first": first, "n_ids": len(values), "escapes": escapes,
                "words": words.astype("<u8").tobytes(), "offsets": offsets.astype("<u4").tobytes(),
                "ids": [x[0] for x in held], "nulls": [x[1] for x in held], "lengths": [len(x[2]) for x in held],
            }])

        for frame in by_size(frames, "text", BATCH):
            for doc, null, ids in zip(frame["doc"], frame["gone"], encode(frame["text"].tolist(), end), strict=True):
                if held and size + len(ids) > GROUP:
                    yield close()
                    group, first, held, size = group + 1, first + size, [], 0
                held.append((doc, null, ids))
                size += len(ids)
        if held:
            yield close()

    return run


def write_token_files(
    docs: DataFrame, path: str, vocabulary: str, *, doc: str = "doc_id", text: str = "text", end_id: int | None = 2,
) -> None:
    rows = docs.select(
        F.coalesce(F.col(doc).cast("bigint"), F.lit(0)).alias("doc"), F.col(doc).isNull().alias("gone"), whole(text).alias("text"))
    order = [F.col("gone").desc(), F.col("doc"), F.xxhash64("text")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.mapInPandas(_coder(vocabulary, end_id), WRITTEN).write.parquet(path)


def _decoder(with_ids: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                ids = simple8b.decode(
                    np.frombuffer(row.words, "<u8"), np.frombuffer(row.offsets, "<u4"), row.n_ids, row.escapes).astype("<u4")
                ends = np.cumsum(np.asarray(row.lengths, np.int64))
                starts = ends - row.lengths
                each = [ids[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pd.DataFrame({
                    "doc_id": row.ids, "gone": row.nulls, "start": row.before + row.first + starts, "n_tokens": row.lengths,
                    "ids_crc32": [zlib.crc32(x) for x in each], "ids": [x.tobytes() if with_ids else None for x in each],
                })

    return run


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and ids (little-endian unsigned 32-bit) per document.

    Without ids the documents are read all the same, for their checksums.
    """
    groups = spark.read.parquet(path)
    totals = groups.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row per written part
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    docs = groups.join(F.broadcast(before), "part").mapInPandas(
        _decoder(with_ids), "doc_id long, gone boolean, start long, n_tokens long, ids_crc32 long, ids binary")
    docs = docs.withColumn("doc_id", F.when(~F.col("gone"), F.col("doc_id"))).drop("gone")
    return docs if with_ids else docs.drop("ids")
