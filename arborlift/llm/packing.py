"""Sequence packing by length patterns: non-negative least squares, then best fit.

Documents are tokenized and cut into pieces of at most ``capacity`` ids. Only the
histogram of piece lengths (``capacity`` rows at most) reaches the driver, where a
plan is made:

1. lengths fall into ``CLASSES`` classes; patterns of one to three classes that
   fill a sequence are enumerated;
2. non-negative least squares fits repeat counts of the patterns to the class
   histogram; the counts are rounded down;
3. each pattern takes the longest pieces of its first classes, and what is left
   of the sequence is filled by the longest pieces that fit;
4. pieces that no pattern took are packed longest first, each sequence filled by best fit.

The plan says, for runs of equal pieces, into which sequences and at which offset
they go. Every piece gets its rank among those of equal length (buckets of
hashed ids, counts of earlier buckets added), and meets its run in a join on the
length: the plan is broadcast, as its size depends on ``capacity`` alone.

Null and empty texts are the end id alone; equal rows get places of their own;
an empty table gives no rows. Other columns of the input are left out.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborlift.llm.base import whole
from arborlift.session import stage

CLASSES = 128
#: Pieces of one length and bucket, about.
BUCKET_ROWS = 50_000
PIECES = "doc_id long, gone boolean, piece int, start long, length long, ids_crc32 long, ids binary"


def _cutter(path: str, capacity: int, end_id: int, with_ids: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from arborlift.llm.tokens import encoder

        encode, end = encoder(path).encode, np.array([end_id], "<u4").tobytes()
        step = 4 * capacity
        for frame in frames:
            out = []
            for doc, gone, text in zip(frame["doc"], frame["gone"], frame["text"], strict=True):
                ids = encode(text) + end
                for k, at in enumerate(range(0, len(ids), step)):
                    cut = ids[at:at + step]
                    out.append((doc, gone, k, at // 4, len(cut) // 4, zlib.crc32(cut), cut if with_ids else None))
            yield pd.DataFrame(out, columns=["doc_id", "gone", "piece", "start", "length", "ids_crc32", "ids"])

    return run


def pieces(
    docs: DataFrame, vocabulary: str, *, doc: str = "doc_id", text: str = "text", capacity: int = 2048, end_id: int = 0,
    with_ids: bool = False,
) -> DataFrame:
    rows = docs.select(
        F.coalesce(F.col(doc).cast("bigint"), F.lit(0)).alias("doc"), F.col(doc).isNull().alias("gone"), whole(text).alias("text"))
    cut = rows.mapInPandas(_cutter(vocabulary, capacity, end_id, with_ids), PIECES)
    out = cut.select(F.when(~F.col("gone"), F.col("doc_id")).alias("doc_id"), "piece", "start", "length", "ids_crc32", "ids")
    return out if with_ids else out.drop("ids")


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 600) -> np.ndarray:
    """x >= 0 that minimises |ax - b|, by an active set."""
    x, used = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    gram, slope, fit = a.T @ a, a.T @ b, a.T @ b
    tol = 1e-9 * max(1.0, float(np.abs(slope).max(initial=0)))
    for _ in range(rounds):
        free = np.where(used, -np.inf, slope)
        best = int(free.argmax())
        if free[best] <= tol:
            break
        used[best] = True
        while True:
            part = np.zeros_like(x)
            part[used] = np.linalg.lstsq(gram[np.ix_(used, used)], fit[used], rcond=1e-12)[0]
            if (part[used] > 0).all():
                x = part
                break
            low = used & (part <= 0)
            gap = x[low] - part[low]
            step = float(np.min(x[low] / np.where(gap > 0, gap, 1.0)))
            x = x + step * (part - x)
            used &= x > 1e-12
            x[~used] = 0
            if not used.any():
                break
        slope = fit - gram @ x
    return x


def patterns(classes: int = CLASSES) -> list[tuple[int, ...]]:
    """One to three classes, largest first, that fill a sequence of ``classes`` units."""
    out: list[tuple[int, ...]] = [(classes,)]
    out += [(classes - c, c) for c in range(1, classes // 2 + 1)]
    for first in range(classes - 2, 0, -1):
        rest = classes - first
        out += [(first, second, rest - second) for second in range(min(first, rest - 1), (rest - 1) // 2, -1)]
    return out


class _Left:
    """Pieces that have no place yet: counts by length."""

    def __init__(self, histogram: dict[int, int]) -> None:
        self.count = {k: v for k, v in histogram.items() if v > 0}
        self.lengths = sorted(self.count)

    def longest(self, most: int) -> int | None:
        at = bisect_right(self.lengths, most)
        return self.lengths[at - 1] if at else None

    def take(self, length: int, n: int) -> None:
        self.count[length] -= n
        if not self.count[length]:
            del self.count[length]
            self.lengths.remove(length)


def plan(histogram: dict[int, int], capacity: int = 2048) -> list[tuple[int, list[tuple[int, int]]]]:
    """(repeats, [(length, how many in each sequence)]) that place every piece."""
    left, made = _Left(histogram), []

    def fill(repeats: int, shape: list[tuple[int, int]], room: int) -> None:
        todo = [(repeats, shape, room)]
        while todo:
            repeats, shape, room = todo.pop()
            while room and (length := left.longest(room)) is not None:
                n = left.count[length]
                if n < repeats:  # too few for all repeats: the others are filled after these
                    todo.append((repeats - n, list(shape), room))
                    repeats = n
                each = min(room // length, n // repeats)
                left.take(length, each * repeats)
                shape.append((length, each))
                room -= each * length
            made.append((repeats, shape))

    unit = -(-capacity // CLASSES)
    known = patterns(CLASSES)
    sizes = np.zeros(CLASSES)
    for length, n in left.count.items():
        sizes[-(-length // unit) - 1] += n
    a = np.zeros((CLASSES, len(known)))
    for k, classes in enumerate(known):
        for c in classes:
            a[c - 1, k] += 1
    repeats = np.floor(nnls(a, sizes) + 1e-6).astype(np.int64)
    for k in sorted(np.flatnonzero(repeats), key=lambda k: (-known[k][0], known[k])):
        todo = int(repeats[k])
        while todo:
            shape, n, room = [], todo, capacity
            for c in known[k][:-1] if len(known[k]) > 1 else known[k]:
                length = left.longest(min(room, unit * c))
                if length is None or length <= unit * (c - 1):
                    n = 0
                    break
                n = min(n, left.count[length] // (1 + sum(x == length for x, _ in shape)))
                shape.append((length, 1))
                room -= length
            if not n:
                break
            for length, _ in shape:
                left.take(length, n)
            fill(n, shape, room)
            todo -= n
    while left.lengths:
        length = left.lengths[-1]
        n = left.count[length]
        each = min(capacity // length, n)
        repeats_ = n // each
        left.take(length, each * repeats_)
        fill(repeats_, [(length, each)], capacity - each * length)
    return made


def slots(made: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank after the last, first sequence, pieces in each, offset)."""
    out, ranked, sequence = [], defaultdict(int), 0
    for repeats, shape in made:
        offset = 0
        for length, each in shape:
            first = ranked[length]
            ranked[length] = first + repeats * each
            out.append((length, first, ranked[length], sequence, each, offset))
            offset += length * each
        sequence += repeats
    return out


def pack(cut: DataFrame, capacity: int = 2048) -> DataFrame:
    """``cut`` (doc_id, piece, length, ...) with sequence_id and offset."""
    spark = cut.sparkSession
    cut = stage(cut, "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not histogram:
        return cut.withColumns({"sequence_id": F.lit(None).cast("bigint"), "offset": F.lit(None).cast("bigint")})
    buckets = max(8, -(-max(histogram.values()) // BUCKET_ROWS))
    spread = cut.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    counts = spread.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select(
        "length", "_bucket",
        (F.sum("n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = spread.withColumn("_own", own - 1).join(before, ["length", "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_own")).drop("_before", "_own", "_bucket")
    places = spark.createDataFrame(
        pd.DataFrame(slots(plan(histogram, capacity)), columns=["_length", "_first", "_last", "_sequence", "_each", "_offset"]))
    at = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_last"))
    nth = F.col("_rank") - F.col("_first")
    return ranked.join(F.broadcast(places), at).select(
        *[c for c in cut.columns],
        (F.col("_sequence") + F.floor(nth / F.col("_each"))).cast("bigint").alias("sequence_id"),
        (F.col("_offset") + nth % F.col("_each") * F.col("length")).cast("bigint").alias("offset"),
    )
