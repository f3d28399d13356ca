"""Hard negatives by an inverted multi-index with certified windows.

Vectors are cut into two halves. Each half space has a codebook, fitted on a bounded sample
(``TRAIN_ROWS`` rows, in the order of a hash); a row belongs to the cell of its two nearest
code words. Every row is indexed. A cell knows the largest distances of its rows from the code
words, so that for a query q no row of cell (i, j) scores above

    q1.c1[i] + |q1| r1[i, j] + q2.c2[j] + |q2| r2[i, j].

Cells are dealt out to shards of about ``SHARD_ROWS`` rows; a cell that holds more (many rows with one
vector, say) is spread over as many shards as it needs. A query goes to the shards with a cell whose bound
reaches what the query already has for certain from the sample, and not to others. Within a shard the
multi-sequence heap visits cells by their summed half bounds: the code words of each half are sorted by
their bound, and the next best pair comes off a heap. The visit ends when the bound of all
that is left is below what each wanted window already holds. The first run finds the positives of each
anchor (one window: the best rows of its label); the second the negatives of each positive, whose
windows are the scores from half to 95 hundredths of that of the positive. Results of the shards are merged by rank. Nothing
is approximated: bounds only decide what need not be looked at. Where vectors have no
structure (random ones) the bounds exclude little, and nearly all cells are visited.

Scores are sums of products of integers, exact while they fit a long. Rows with a null id, label or
vector, or any null or non-finite component, take no part. Vectors of other lengths are
filled up with zeros. Each row counts for itself: a repeated anchor is an anchor twice, and each the other's
candidate. Ties go by the smaller id. An empty table gives no row; an anchor without positives or
without negatives in a window gives none either. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush
from math import ceil, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arborlift.session import stage

#: Rows the codebooks are fitted on, and the lower bounds of routing taken from.
TRAIN_ROWS, TRAIN_ROUNDS = 8192, 8
#: Rows of a cell on average, and code words of a half at most (a cell then holds more rows).
CELL_ROWS, MOST_WORDS = 32, 256
SHARD_ROWS, ANCHORS_AT_ONCE, FIRST_LOOK = 8192, 512, 128
POSITIVES, NEGATIVES = 5, 3
#: Share of the positive's score, in hundredths, that a negative's lies between.
LEAST, MOST = 50, 95
#: Sums of products below this are exact in doubles.
EXACT = 2.0 ** 52

PACK = "shard long, ids binary, labels binary, rows binary, vectors binary, one binary, two binary"
ASKED = "shard long, block long, row long, vec_id long, label long, v binary, want binary"


def usable_rows(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, v) of the rows that take part, labels moved and components made integers."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    moved = F.when(F.col(key) % 7 == 0, (F.col(label) + 1) % 10).otherwise(F.col(label))
    return vectors.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & sound).select(
        F.col(key).cast("bigint").alias("vec_id"), moved.cast("bigint").alias("label"),
        F.transform(vector, lambda x: F.floor(x.cast("double") * 256)).alias("v"))


def _matrix(vectors, dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims), np.int64)
    for at, v in enumerate(vectors):
        out[at, :len(v)] = v
    return out


def _gaps(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * (x @ words.T) + (words * words).sum(axis=1), 0)


def codebook(x: np.ndarray, size: int, rounds: int = TRAIN_ROUNDS) -> np.ndarray:
    """Code words of a half space by alternating means, from rows spread evenly over ``x``."""
    words = x[np.linspace(0, len(x) - 1, min(size, len(x))).astype(int)].astype(float)
    for _ in range(rounds):
        near = _gaps(x, words).argmin(axis=1)
        n = np.bincount(near, minlength=len(words))
        for k in np.flatnonzero(n):
            words[k] = x[near == k].mean(axis=0)
    return words


class Books:
    """The two codebooks, and how a vector is cut into halves."""

    def __init__(self, sample: np.ndarray, size: int):
        self.half = (sample.shape[1] + 1) // 2
        self.one, self.two = (codebook(x.astype(float), size) for x in self.halves(sample))

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, :self.half], x[:, self.half:]

    def place(self, x: np.ndarray):
        """Nearest code words of each row, and the distances from them."""
        found = []
        for part, words in zip(self.halves(x.astype(float)), (self.one, self.two)):
            word = _gaps(part, words).argmin(axis=1)
            found += [word, np.sqrt(((part - words[word]) ** 2).sum(axis=1))]
        return found


def scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact integer inner products; in doubles where these are exact."""
    top = float(np.abs(vectors).max(initial=0)) * float(np.abs(query).max(initial=0)) * query.shape[-1]
    if top < EXACT:
        return (vectors.astype(float) @ query.T.astype(float)).astype(np.int64)
    return vectors @ query.T


class Best:
    """The ``size`` best (score, id) of a window of scores seen so far."""

    def __init__(self, size: int, low: float, high: float, sure: float):
        self.size, self.low, self.high, self.sure = size, low, high, max(sure, low)
        self.score = self.ids = np.empty(0, np.int64)

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        fits = (score >= max(self.need(), self.low)) & (score <= self.high)
        if fits.any():
            score, ids = np.concatenate([self.score, score[fits]]), np.concatenate([self.ids, ids[fits]])
            keep = np.lexsort((ids, -score))[:self.size]
            self.score, self.ids = score[keep], ids[keep]

    def need(self) -> float:
        """A row that scores below this cannot be among the best."""
        return max(self.sure, self.score[-1]) if len(self.score) == self.size else self.sure


def cells_by_bound(one: np.ndarray, two: np.ndarray):
    """(bound, i, j) of all pairs by falling sum of two lists of bounds: the multi-sequence walk."""
    first, second = np.argsort(-one, kind="stable"), np.argsort(-two, kind="stable")
    a, b = one[first].tolist(), two[second].tolist()
    if not a or not b:
        return
    heap, reached = [(-(a[0] + b[0]), 0, 0)], [0] * len(a)  # how far each row of the grid has been walked
    while heap:
        bound, i, j = heappop(heap)
        yield -bound, first[i], second[j]
        reached[i] = j + 1
        if j + 1 < len(b) and (i == 0 or reached[i - 1] > j + 1):
            heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
        if i + 1 < len(a) and reached[i + 1] == j:
            heappush(heap, (-(a[i + 1] + b[j]), i + 1, j))


class Shard:
    """Rows of some cells, listed by cell."""

    def __init__(self, ids, labels, rows, vectors, one, two, books: Books):
        order = np.lexsort((two, one))
        self.ids, self.labels, self.rows, self.vectors = ids[order], labels[order], rows[order], vectors[order]
        one, two = one[order], two[order]
        self.ones, i = np.unique(one, return_inverse=True)
        self.twos, j = np.unique(two, return_inverse=True)
        self.books = books
        (a, b) = books.halves(self.vectors.astype(float))
        self.reach = []
        for part, words, which, at in ((a, books.one, self.ones, i), (b, books.two, self.twos, j)):
            far = np.zeros(len(which))
            np.maximum.at(far, at, np.sqrt(((part - words[which[at]]) ** 2).sum(axis=1)))
            self.reach.append(far)
        size = np.zeros((len(self.ones), len(self.twos)), np.int64)
        np.add.at(size, (i, j), 1)
        ends = np.cumsum(size.ravel()).reshape(size.shape)
        self.starts, self.ends = (ends - size).tolist(), ends.tolist()

    def visit(self, query: np.ndarray, row: int, label: int, same: bool, windows: list[Best]) -> None:
        """Fill the windows from the cells, best bound first, until none can gain any more."""
        q1, q2 = (x[0].astype(float) for x in self.books.halves(query[None, :]))
        bounds = [q @ words[which].T + np.sqrt(q @ q) * far for q, words, which, far in (
            (q1, self.books.one, self.ones, self.reach[0]), (q2, self.books.two, self.twos, self.reach[1]))]
        waiting, look, held = [], FIRST_LOOK, 0

        def settle() -> None:
            at = np.concatenate([np.arange(a, b) for a, b in waiting])
            fits = (self.labels[at] == label) == same
            at = at[fits & (self.rows[at] != row)]
            score, ids = scores(self.vectors[at], query), self.ids[at]
            for window in windows:
                window.add(score, ids)

        need = min(w.need() for w in windows)
        for bound, i, j in cells_by_bound(*bounds):
            if bound + 1e-9 * abs(bound) + 1 < need:
                break
            a, b = self.starts[i][j], self.ends[i][j]
            if a == b:
                continue
            waiting.append((a, b))
            held += b - a
            if held >= look:
                settle()
                waiting, held, look = [], 0, look * 2
                need = min(w.need() for w in windows)
        if waiting:
            settle()


def _packed(dims: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(frame["v"], dims)
        kind = np.int16 if np.abs(x).max(initial=0) < 1 << 15 else np.int64
        return pd.DataFrame([[
            frame["shard"].iloc[0], *(frame[c].to_numpy(np.int64).tobytes() for c in ("vec_id", "label", "row")),
            kind().dtype.char.encode() + x.astype(kind).tobytes(), frame["one"].to_numpy(np.int64).tobytes(), frame["two"].to_numpy(np.int64).tobytes(),
        ]], columns=["shard", "ids", "labels", "rows", "vectors", "one", "two"])

    return run


def _unpacked(pack: pd.Series, dims: int, books: Books) -> Shard:
    ids, labels, rows, one, two = (np.frombuffer(pack[c], np.int64) for c in ("ids", "labels", "rows", "one", "two"))
    x = np.frombuffer(pack["vectors"], np.dtype(pack["vectors"][:1].decode()), offset=1).reshape(-1, dims).astype(np.int64)
    return Shard(ids, labels, rows, x, one, two, books)


def _windows(wanted: np.ndarray | None, sure: np.ndarray | None = None) -> list[Best]:
    """The windows of an anchor: its positives', or one for each positive score."""
    if wanted is None:
        return [Best(POSITIVES, -np.inf, np.inf, -np.inf if sure is None else sure[0])]
    return [Best(NEGATIVES, -(-LEAST * int(p) // 100), MOST * int(p) // 100, -np.inf if sure is None else s)
            for p, s in zip(wanted, wanted if sure is None else sure)]


class Router:
    """Which shards an anchor has to ask."""

    def __init__(self, cells: pd.DataFrame, sample: pd.DataFrame, books: Books, dims: int):
        self.cells, self.books, self.dims = cells, books, dims
        self.ids, self.labels = sample["vec_id"].to_numpy(np.int64), sample["label"].to_numpy(np.int64)
        self.vectors = _matrix(sample["v"], dims)
        self.shards, self.starts = np.unique(cells["first"].to_numpy(np.int64), return_index=True)
        self.parts = np.maximum.reduceat(cells["parts"].to_numpy(np.int64), self.starts) if len(cells) else np.empty(0, np.int64)

    def sure(self, query: np.ndarray, vec_id: int, label: int, wanted: np.ndarray | None) -> list[float]:
        """What the windows hold of the sample alone, which their rows can only better."""
        fits = (self.ids != vec_id) & ((self.labels == label) == (wanted is None))
        windows, score = _windows(wanted), scores(self.vectors[fits], query)
        for window in windows:
            window.add(score, self.ids[fits])
        return [float(w.need()) for w in windows]

    def reached(self, queries: np.ndarray, needs: np.ndarray):
        """(query, shard) pairs whose best cell reaches what the query needs."""
        q1, q2 = (x.astype(float) for x in self.books.halves(queries))
        one, two = self.cells["one"].to_numpy(np.int64), self.cells["two"].to_numpy(np.int64)
        bound = (q1 @ self.books.one.T)[:, one] + (q2 @ self.books.two.T)[:, two]
        bound += np.sqrt((q1 * q1).sum(axis=1))[:, None] * self.cells["far_one"].to_numpy()
        bound += np.sqrt((q2 * q2).sum(axis=1))[:, None] * self.cells["far_two"].to_numpy()
        best = np.maximum.reduceat(bound, self.starts, axis=1)
        return np.nonzero(best + 1e-9 * np.abs(best) + 1 >= needs[:, None])

    def run(self, blocks: int):
        def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for whole in frames:
                for first in range(0, len(whole), 64):
                    frame = whole.iloc[first:first + 64]
                    queries = _matrix(frame["v"], self.dims)
                    wanted = [None if w is None else np.asarray(w, np.int64) for w in frame["want"]]
                    sure = [self.sure(q, i, lab, w) for q, i, lab, w in zip(queries, frame["vec_id"], frame["label"], wanted)]
                    who, at = self.reached(queries, np.array([min(s) for s in sure]))
                    parts = self.parts[at]
                    shard = np.repeat(self.shards[at], parts) + np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                    who = np.repeat(who, parts)
                    v = np.array([q.tobytes() for q in queries], object)
                    want = np.array([(np.empty(0) if w is None else w.astype(float)).tobytes() + np.array(s).tobytes() for w, s in zip(wanted, sure)], object)
                    asked = frame[["row", "vec_id", "label"]].iloc[who].reset_index(drop=True)
                    yield asked.assign(shard=shard, block=asked["row"].to_numpy() % blocks, v=v[who], want=want[who])

        return ask


def _answer(positive: bool, dims: int, books):
    """Visit a shard for some anchors: (row, place of the window, id, score) of what its windows hold."""

    def run(asked: pd.DataFrame, packs: pd.DataFrame) -> pd.DataFrame:
        out = {"row": [], "vec_id": [], "label": [], "at": [], "other": [], "score": []}
        if len(packs) and len(asked):
            shard = _unpacked(packs.iloc[0], dims, books.value)
            for row, vec_id, label, v, want in zip(asked["row"], asked["vec_id"], asked["label"], asked["v"], asked["want"]):
                held = np.frombuffer(want)
                wanted = None if positive else held[:len(held) // 2]
                windows = _windows(wanted, held if positive else held[len(held) // 2:])
                shard.visit(np.frombuffer(v, np.int64), row, label, positive, windows)
                for at, window in enumerate(windows):
                    n = len(window.ids)
                    for name, values in (("row", [row] * n), ("vec_id", [vec_id] * n), ("label", [label] * n), ("at", [at] * n),
                                         ("other", window.ids.tolist()), ("score", window.score.tolist())):
                        out[name] += values
        return pd.DataFrame(out).astype("int64")

    return run


class Index:
    """The multi-index of a table's rows."""

    def __init__(self, points: DataFrame):
        spark = points.sparkSession
        about = points.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
        self.n, self.dims = about["n"], max(about["d"] or 0, 2)
        self.sample = points.orderBy(F.xxhash64("vec_id"), "vec_id").limit(TRAIN_ROWS).toPandas()
        size = min(max(ceil(sqrt(self.n / CELL_ROWS)), 1), MOST_WORDS)
        books, dims = Books(_matrix(self.sample["v"], self.dims), size) if self.n else None, self.dims

        def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                one, far_one, two, far_two = books.place(_matrix(frame["v"], dims))
                yield frame.assign(one=one, two=two, far_one=far_one, far_two=far_two)

        numbered = points.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "v")
        schema = "row long, vec_id long, label long, v array<long>, one long, two long, far_one double, far_two double"
        self.placed = stage(numbered.mapInPandas(place, schema) if self.n else spark.createDataFrame([], schema), "mining-placed")
        self.books = spark.sparkContext.broadcast(books)
        self.cells = self._dealt()
        part = F.pmod(F.xxhash64("row"), F.col("parts"))
        where = F.broadcast(spark.createDataFrame(self.cells[["one", "two", "first", "parts"]])) if self.n else None
        self.packs = stage(self.placed.join(where, ["one", "two"]).select(
            (F.col("first") + part).alias("shard"), "row", "vec_id", "label", "v", "one", "two",
        ).groupBy("shard").applyInPandas(_packed(dims), PACK), "mining-index") if self.n else None

    def _dealt(self) -> pd.DataFrame:
        """Cells (``MOST_WORDS`` squared at most) with their reach, first shard and number of shards."""
        cells = self.placed.groupBy("one", "two").agg(
            F.count(F.lit(1)).alias("n"), F.max("far_one").alias("far_one"), F.max("far_two").alias("far_two"),
        ).toPandas().sort_values(["one", "two"]).reset_index(drop=True)
        first, parts, shard, held = [], [], 0, 0
        for n in cells["n"]:
            if n > SHARD_ROWS or held + n > SHARD_ROWS:
                shard, held = shard + (held > 0), 0
            first.append(shard)
            parts.append(-(-n // SHARD_ROWS))
            held += n
            if n > SHARD_ROWS:
                shard, held = shard + parts[-1], 0
        return cells.assign(first=np.array(first, np.int64), parts=np.array(parts, np.int64))

    def best(self, anchors: DataFrame, blocks: int, positive: bool) -> DataFrame:
        """(row, vec_id, label, at, other, score, rank): what the windows of the anchors hold over all shards."""
        router = self.placed.sparkSession.sparkContext.broadcast(Router(self.cells, self.sample, self.books.value, self.dims))

        def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            return router.value.run(blocks)(frames)

        asked = anchors.select("row", "vec_id", "label", "v", "want").mapInPandas(ask, ASKED)
        packs = self.packs.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        found = asked.groupBy("shard", "block").cogroup(packs.groupBy("shard", "block")).applyInPandas(
            _answer(positive, self.dims, self.books), "row long, vec_id long, label long, at long, other long, score long")
        order = Window.partitionBy("row", "at").orderBy(F.desc("score"), "other")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= (POSITIVES if positive else NEGATIVES))


def hard_negatives(vectors: DataFrame, *, every: int = 50, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Negatives of the positives of each anchor (a row whose id ``every`` divides).

    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    index = Index(usable_rows(vectors, key=key, vector=vector, label=label))
    anchors = index.placed.where(F.col("vec_id") % every == 0)
    blocks = max(ceil(anchors.count() / ANCHORS_AT_ONCE), 1)
    if not index.n:
        return vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    positives = stage(index.best(anchors.withColumn("want", F.lit(None).cast("array<long>")), blocks, True), "mining-positives")
    wanted = positives.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("got")).select(
        "row", F.transform("got", lambda x: x["score"]).alias("want"))
    negatives = index.best(anchors.join(wanted, "row"), blocks, False)
    of = positives.select("row", (F.col("rank") - 1).cast("long").alias("at"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
    return negatives.join(of, ["row", "at"]).select(
        F.col("vec_id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"),
        F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
