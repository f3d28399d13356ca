"""Language-model scoring by logistic context mixing, with a unigram base score.

The model reads the words of a text (white space parts them, A-Z lower-cased),
each followed by one space, then one end byte, and predicts every bit. Six
predictors look at the last 0 to 5 bytes: for a context and the bits of the byte
so far, zeros and ones are counted. Their log-odds are combined
by weights that a gate chooses (bit position and the longest context seen);
weights are learned online, and an adaptive map refines the mixed probability.

In Spark: tasks count runs of six bytes and words of the training texts, and one
aggregation sums them over the corpus; all counts follow from the sums, as the
bits of a byte are fixed by it. Counts are exact: no two contexts share one. The
distinct runs are parted by the last three bytes of their context, so that a part
has all that contexts of three bytes and more ask for; there are as many parts
as the corpus needs. Shorter contexts, of which bytes allow 65,793 in all, go to every task.

Weights are learned over all distinct runs, weighted by their
counts, each with one occurrence of its own taken out of the counts it sees;
every task learns from its parts one batch after another, and the tasks' weights
are averaged. The probability of a byte depends on its run alone: batches of
texts ask the parts for their distinct runs, a part computes each of these once, and
the answers meet their batch again.

Word counts grow without bound: words frequent enough to be among the first
``HEAD_WORDS`` are broadcast, the others meet their counts in a join. Words are
told apart by 64-bit hashes.

Null texts are empty (the end alone); a null id counts as training text; equal
rows each get their own row; with no training text every bit has probability
one half and counts are zero. Other columns take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlift.llm import shingles
from arborlift.llm.base import by_size, whole
from arborlift.session import stage

ORDERS, END, GAP = 6, 10, 32
#: Orders below are counted in a table for all tasks, the others in parts.
PARTED, SPREAD = 3, 0x9E3779B1
#: The least number of parts; distinct runs, and bytes of text, for each part beyond it.
LEAST_PARTS, RUNS_A_PART, BYTES_A_PART = 12, 1_000_000, 16_000_000
HEAD_WORDS, AT_ONCE, RUNS_AT_ONCE = 50_000, 3_000_000, 60_000
#: Added to both counts; steps of the adaptive map; rate, batch and rounds of learning.
PRIOR, LEVELS, RATE, BATCH, EPOCHS = 0.3, 33, 0.1, 256, 3
GATES = 8 * (ORDERS + 1)
RUN, WORD, TEXT = 0, 1, 2


def byte_runs(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Run of six bytes that ends at each modelled byte (top 48 bits), and its text."""
    encoded = [t.encode() for t in texts]
    raw = np.frombuffer(b"\n".join(encoded) + b"\n", np.uint8)
    size = np.array([len(t) + 1 for t in encoded], np.int64)
    ends = np.cumsum(size)
    space = shingles.SPACES[raw]
    before = np.concatenate([[True], space[:-1]])
    before[ends[:-1]] = True
    keep = ~space | ~before
    low = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
    low[space] = GAP
    kept = np.add.reduceat(keep, ends - size)
    # each text: five end bytes before, its bytes, the end byte
    width = kept + ORDERS
    first = np.cumsum(width) - width
    out = np.full(int(width.sum()) + 2, END, np.uint8)
    owner = np.repeat(np.arange(len(texts)), kept)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(kept) - kept, kept)
    out[first[owner] + ORDERS - 1 + place] = low[keep]
    view = np.ndarray((int(width.sum()) - ORDERS + 1,), ">u8", buffer=out.tobytes(), strides=(1,)) if len(texts) else np.empty(0, ">u8")
    real = np.ones(len(view), bool)
    for k in range(1, ORDERS):  # runs that would reach over into the next text
        at = first[1:] - k
        real[at] = False
    runs = (view.astype(np.uint64) & ~np.uint64(0xFFFF))[real]
    return runs, np.repeat(np.arange(len(texts)), kept + 1)


def _tally(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = np.sort(x)
    at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.empty(0, np.int64)
    return x[at], np.diff(np.append(at, len(x)))


def _count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in by_size(frames, "text", AT_ONCE):
        texts = frame["text"].tolist()
        runs, n = _tally(byte_runs(texts)[0] >> np.uint64(16))
        words, m = _tally(shingles.words(texts)[0])
        yield pd.DataFrame({
            "kind": np.repeat([RUN, WORD, TEXT], [len(runs), len(words), 1]),
            "key": np.concatenate([runs.view(np.int64), words.view(np.int64), [0]]),
            "n": np.concatenate([n, m, [len(texts)]]),
        })


def part_of(run: np.ndarray, parts: int) -> np.ndarray:
    """Part of the tables that has the run's contexts of three bytes and more."""
    context = (run >> np.uint64(8)) & np.uint64(0xFFFFFF)
    return ((context * np.uint64(SPREAD) >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)


def _part_column(parts: int) -> Column:
    context = F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFFFF))
    return (F.shiftright(context * F.lit(SPREAD), 20) % parts).cast("int")


def _node(byte: np.ndarray, bit: int) -> np.ndarray:
    return (1 << bit) | (byte >> (8 - bit))


Table = tuple[np.ndarray, np.ndarray]


def table_of(run: np.ndarray, n: np.ndarray, order: int) -> Table:
    """Distinct (context and byte) in order, and the counts before each."""
    key = run & np.uint64((1 << (8 * (order + 1))) - 1)
    by = np.argsort(key, kind="stable")
    key, upto = key[by], np.cumsum(n[by])
    last = np.flatnonzero(np.append(key[1:] != key[:-1], True)) if len(key) else np.empty(0, np.int64)
    return key[last], np.concatenate([[0], upto[last]])


def node_counts(tables: list[Table], run: np.ndarray) -> np.ndarray:
    """Zeros and ones seen after each run's contexts and bits so far: bit x 2 x runs x orders."""
    out = np.empty((8, 2, len(run), ORDERS), np.float32)
    byte = run & np.uint64(255)
    for order, (key, upto) in enumerate(tables):
        context = run & np.uint64(((1 << (8 * order)) - 1) << 8)
        low = upto[np.searchsorted(key, context)]
        high = upto[np.searchsorted(key, context + np.uint64(256))]
        for bit in range(8):
            half = np.uint64(1 << (7 - bit))
            first = context + (byte & ~(half + half - np.uint64(1)))
            middle = upto[np.searchsorted(key, first + half)]
            out[bit, 0, :, order], out[bit, 1, :, order] = middle - low, high - middle
            one = (byte & half) > 0
            low, high = np.where(one, middle, low), np.where(one, high, middle)
    return out


def _packed(key: np.ndarray) -> bytes:
    """Six bytes of each key, byte by byte: sorted keys compress well so."""
    return np.ascontiguousarray(key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(6, -1).T
    return out.view("<u8").ravel().astype(np.uint64)


HELD = "part int, keys binary, n binary"


def _hold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each part of this partition, which has all of its runs."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for frame in frames:
        for part, rows in frame.groupby("part"):
            held.setdefault(part, []).append((rows["key"].to_numpy().astype(np.uint64), rows["n"].to_numpy().astype(np.int64)))
    while held:
        part, pieces = held.popitem()
        key, n = (np.concatenate(x) for x in zip(*pieces, strict=True))
        by = np.argsort(key)
        yield pd.DataFrame([{"part": part, "keys": _packed(key[by]), "n": n[by].astype("<i8").tobytes()}])


@dataclass
class Model:
    """Weights by gate, the adaptive map by node and level, and counts: those of short contexts, and the parts in Spark."""

    weights: np.ndarray
    refined: np.ndarray
    low: list[Table]
    parts: int
    held: DataFrame | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"held": None}  # tasks are given the rows of their parts

    def tables(self, key: np.ndarray, n: np.ndarray) -> list[Table]:
        return self.low + [table_of(key, n, order) for order in range(PARTED, ORDERS)]

    def read(self, run: np.ndarray) -> list[Table]:
        """Tables of the parts that some few runs ask for, read by the driver."""
        rows = self.held.where(F.col("part").isin(np.unique(part_of(run, self.parts)).tolist())).collect() if self.held is not None else []
        return self.tables(*_runs_of(rows))


def _runs_of(rows) -> tuple[np.ndarray, np.ndarray]:
    key = [_unpacked(r["keys"]) for r in rows]
    n = [np.frombuffer(r["n"], "<i8") for r in rows]
    return np.concatenate([np.empty(0, np.uint64), *key]), np.concatenate([np.empty(0, np.int64), *n])


def _inputs(counts: np.ndarray, run: np.ndarray, bit: int, leave_out: bool):
    """Log-odds of each order with a constant, the gate, the node and the bit itself."""
    byte = (run & np.uint64(255)).astype(np.int64)
    node, one = _node(byte, bit), (byte >> (7 - bit)) & 1
    n0, n1 = counts[bit]
    if leave_out:
        n0, n1 = n0 - (1 - one)[:, None].astype(np.float32), n1 - one[:, None].astype(np.float32)
    x = np.empty((len(run), ORDERS + 1), np.float32)
    x[:, :ORDERS] = np.log((n1 + np.float32(PRIOR)) / (n0 + np.float32(PRIOR)))
    longest = np.zeros(len(run), np.int64)
    for order in range(ORDERS):
        longest[x[:, order] != 0] = order + 1
    x[:, ORDERS] = 0.3
    return x, bit * (ORDERS + 1) + longest, node, one


def _level(logit: np.ndarray) -> np.ndarray:
    return np.clip(np.rint((logit + 8) * ((LEVELS - 1) / 16)), 0, LEVELS - 1).astype(np.int64)


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -15, 15)))


def _learner(shared, refine: bool):
    """What to sum for each weight (share times weight, share) or cell of the map (all, ones)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model: Model = shared.value
        weights, power = model.weights.copy(), np.full_like(model.weights, 1e-2)
        seen, table, total = np.zeros(GATES), np.zeros((2, 256 * LEVELS)), 0.0
        for part in (row for frame in frames for row in frame.to_dict("records")):
            keys, numbers = _runs_of([part])
            tables = model.tables(keys, numbers)
            for begin in range(0, len(keys), RUNS_AT_ONCE):
                many = keys[begin:begin + RUNS_AT_ONCE]
                every = node_counts(tables, many)
                for at in range(0, len(many), BATCH):
                    key, counts = many[at:at + BATCH], every[:, :, at:at + BATCH]
                    n = numbers[begin + at:begin + at + len(key)].astype(np.float64)
                    total += n.sum()
                    for bit in range(8):
                        x, gate, node, one = _inputs(counts, key, bit, True)
                        logit = np.einsum("ij,ij->i", x, weights[gate])
                        if refine:
                            cell = node * LEVELS + _level(logit)
                            table[0] += np.bincount(cell, n, 256 * LEVELS)
                            table[1] += np.bincount(cell, n * one, 256 * LEVELS)
                            continue
                        share = np.bincount(gate, n, GATES)
                        step = np.zeros_like(weights)
                        np.add.at(step, gate, ((one - _squash(logit)) * n / share[gate])[:, None] * x)
                        power += step * step
                        weights += RATE * step / np.sqrt(power)
                        seen += share
        if total:
            a, b = table if refine else ((seen[:, None] * weights).ravel(), np.repeat(seen, ORDERS + 1))
            yield pd.DataFrame({"cell": np.arange(len(a)), "a": a, "b": b})

    return run


def train(docs: DataFrame) -> tuple[DataFrame, Model]:
    """Word counts (key, n; kind tells the texts) and the model, from columns id, text."""
    spark = docs.sparkSession
    counted = stage(
        docs.select("text").mapInPandas(_count, "kind int, key long, n long")
        .groupBy("kind", "key").agg(F.sum("n").alias("n")), "mixing-counts")
    runs = counted.where(F.col("kind") == RUN).select("key", "n")
    size = runs.agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    parts = max(LEAST_PARTS, -(-size["v"] // RUNS_A_PART), -(-size["n"] // BYTES_A_PART))
    held = stage(runs.withColumn("part", _part_column(parts)).repartitionById(parts, "part").mapInPandas(_hold, HELD), "mixing-parts")
    # short contexts: as many rows as there are runs of three bytes
    short = runs.groupBy(F.col("key").bitwiseAND(F.lit((1 << (8 * PARTED)) - 1)).alias("key")).agg(F.sum("n").alias("n")).toArrow()
    key, n = short["key"].to_numpy().astype(np.uint64), short["n"].to_numpy().astype(np.int64)
    weights = np.full((GATES, ORDERS + 1), 0.3)
    weights[:, ORDERS] = 0
    model = Model(weights, np.zeros((256, LEVELS)), [table_of(key, n, order) for order in range(PARTED)], parts, held)
    for epoch in range(EPOCHS + 1):
        shared = spark.sparkContext.broadcast(model)
        found = held.mapInPandas(_learner(shared, epoch == EPOCHS), "cell int, a double, b double").groupBy("cell").agg(
            F.sum("a").alias("a"), F.sum("b").alias("b")).orderBy("cell").toArrow()  # a row for each cell
        shared.destroy()
        if not len(found):
            break
        a, b = found["a"].to_numpy(), found["b"].to_numpy()
        if epoch < EPOCHS:
            model.weights = np.where(b > 0, a / np.maximum(b, 1e-9), model.weights.ravel()).reshape(GATES, ORDERS + 1)
        else:
            table = a.reshape(256, LEVELS), b.reshape(256, LEVELS)
            model.refined = np.log((table[1] + 0.5) / (table[0] - table[1] + 0.5))
            centre = (np.arange(LEVELS) * 16 / (LEVELS - 1) - 8)[None, :]
            model.refined = np.where(table[0] > 50, model.refined, centre)
    if not model.refined.any():
        model.refined = np.tile(np.arange(LEVELS) * 16 / (LEVELS - 1) - 8, (256, 1))
    return counted.where(F.col("kind") != RUN), model


def run_log2(model: Model, run: np.ndarray, tables: list[Table] | None = None) -> np.ndarray:
    """log2 probability of each run's last byte, given the five before; without ``tables`` they are read for these runs."""
    tables = model.read(run) if tables is None else tables
    out = np.empty(len(run))
    for at in range(0, len(run), RUNS_AT_ONCE):
        key = run[at:at + RUNS_AT_ONCE]
        counts, total = node_counts(tables, key), np.zeros(len(key))
        for bit in range(8):
            x, gate, node, one = _inputs(counts, key, bit, False)
            logit = np.einsum("ij,ij->i", x, model.weights[gate].astype(np.float32))
            p = 0.5 * _squash(logit) + 0.5 * _squash(model.refined[node, _level(logit)])
            total += np.log2(np.where(one == 1, p, 1 - p))
        out[at:at + RUNS_AT_ONCE] = total
    return out


ASKED = "batch long, part int, keys binary, row long, id long, gone boolean, held_out boolean, text string"


def _asker(parts: int):
    """Batches of texts (part -1), and for each part the distinct runs of the batch in order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batch = row = TaskContext.get().partitionId() << 40
        for whole_batch in by_size(frames, "text", AT_ONCE):
            for at in range(0, len(whole_batch), 1 << 16):
                frame = whole_batch.iloc[at:at + (1 << 16)]
                yield frame.assign(batch=batch, part=-1, keys=None, row=row + np.arange(len(frame)))
                key, part, first = _by_part(_tally(byte_runs(frame["text"].tolist())[0] >> np.uint64(16))[0], parts)[1:]
                yield pd.DataFrame({
                    "batch": batch, "part": part[first], "keys": [_packed(k) for k in np.split(key, first[1:])] if len(first) else [],
                    "row": 0, "id": 0, "gone": False, "held_out": False, "text": None})
                batch, row = batch + 1, row + len(frame)

    return run


def _by_part(key: np.ndarray, parts: int) -> tuple[np.ndarray, ...]:
    """The order of parts, keys and parts in it, and where each part begins."""
    part = part_of(key, parts)
    order = np.argsort(part, kind="stable")
    part = part[order]
    return order, key[order], part, np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.empty(0, np.int64)


ANSWERED = "batch long, part int, bits binary"


def _answerer(shared):
    def run(held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        model: Model = shared.value
        key = [_unpacked(k) for k in asked["keys"]]
        distinct, place = np.unique(np.concatenate([np.empty(0, np.uint64), *key]), return_inverse=True)
        bits = run_log2(model, distinct, model.tables(*_runs_of(held.to_dict("records")))).astype("<f4")[place]
        cut = np.cumsum([len(k) for k in key])[:-1] if key else []
        out = asked[["batch", "part"]].reset_index(drop=True)
        out["bits"] = [b.tobytes() for b in np.split(bits, cut)] if key else []
        return out

    return run


def _scorer(shared):
    def run(frame: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        parts, head, log_head = shared.value
        n, texts = len(frame), frame["text"].tolist()
        runs, owner = byte_runs(texts)
        size = np.bincount(owner, minlength=n)
        runs = np.sort(runs | owner.astype(np.uint64))
        key = runs >> np.uint64(16)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        distinct = np.empty(len(first))
        distinct[_by_part(key[first], parts)[0]] = np.frombuffer(b"".join(answers.sort_values("part")["bits"]), "<f4")
        bits = np.repeat(distinct, np.diff(np.append(first, len(key))))
        bits = np.bincount((runs & np.uint64(0xFFFF)).astype(np.int64), bits, n)
        words, text = shingles.words(texts)
        place = np.minimum(np.searchsorted(head, words), max(len(head) - 1, 0))
        known = head[place] == words if len(head) else np.zeros(len(words), bool)
        t, h, c = shingles.counted(words[~known], text[~known])
        cut = np.searchsorted(t, np.arange(1, n))
        return pd.DataFrame({
            "row": frame["row"].to_numpy(), "doc_id": frame["id"].to_numpy(), "gone": frame["gone"].to_numpy(),
            "held_out": frame["held_out"].to_numpy(), "n_words": np.bincount(text, minlength=n),
            "head_known": np.bincount(text[known], minlength=n),
            "head_log": np.bincount(text[known], log_head[place[known]], n) if known.any() else np.zeros(n),
            "bits": -bits, "n_bytes": size,
            "tail": np.split(h.view(np.int64), cut), "tail_n": np.split(c, cut),
        })

    return run


SCORED = (
    "row long, doc_id long, gone boolean, held_out boolean, n_words long, head_known long, head_log double, "
    "bits double, n_bytes long, tail array<long>, tail_n array<long>"
)


def score(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", fold: int = 2, folds: int = 7) -> DataFrame:
    """Scores of every row; rows whose crc32 of the id, modulo ``folds``, is ``fold`` are not learned from."""
    spark = docs.sparkSession
    out = F.pmod(F.crc32(F.coalesce(F.col(doc).cast("string"), F.lit(""))), F.lit(folds)) == fold
    rows = docs.select(
        F.coalesce(F.col(doc).cast("bigint"), F.lit(0)).alias("id"), F.col(doc).isNull().alias("gone"),
        out.alias("held_out"), whole(text).alias("text"))
    counts, model = train(rows.where(~F.col("held_out")))
    words = counts.where(F.col("kind") == WORD).select("key", "n")
    sums = words.agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    texts = counts.where(F.col("kind") == TEXT).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    total, distinct = sums["n"] + texts, sums["v"] + (1 if texts else 0)
    # the least count at which the words still fit the broadcast head
    step = F.floor(4 * F.log2(F.col("n"))).cast("int")
    fits, least = 0, None
    for r in words.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("s")).collect():
        if fits + r["k"] > HEAD_WORDS:
            break
        fits, least = fits + r["k"], r["s"]
    is_head = step >= least if least is not None else F.lit(False)
    top = words.where(is_head).toPandas()
    head = top["key"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(head)
    head, log_head = head[order], np.log10(top["n"].to_numpy().astype(np.float64)[order] + 1)
    del top
    batches = stage(rows.mapInPandas(_asker(model.parts), ASKED), "mixing-batches")
    asked = batches.where(F.col("part") >= 0).select("batch", "part", "keys")
    shared = spark.sparkContext.broadcast(model)
    answers = stage(model.held.groupBy("part").cogroup(asked.groupBy("part")).applyInPandas(_answerer(shared), ANSWERED), "mixing-answers")
    shared.destroy()  # the answers are written
    parts = model.parts
    del model
    shared = spark.sparkContext.broadcast((parts, head, log_head))
    texts_of = batches.where(F.col("part") < 0).select("batch", "row", "id", "gone", "held_out", "text")
    scored = stage(texts_of.groupBy("batch").cogroup(answers.groupBy("batch")).applyInPandas(_scorer(shared), SCORED), "mixing-scores")
    tail = scored.select("row", F.inline(F.arrays_zip("tail", "tail_n")).alias("key", "k"))
    rare = tail.join(words.where(~is_head), "key").groupBy("row").agg(
        F.sum("k").alias("tail_known"), F.sum(F.col("k") * F.log10(F.col("n") + 1)).alias("tail_log"))
    zero = F.lit(0).cast("bigint")
    n_tokens = F.col("n_words") + 1
    base = (F.col("head_log") + F.coalesce("tail_log", F.lit(0.0)) + math.log10(texts + 1)
            - n_tokens * math.log10(total + distinct + 1))
    return scored.join(rare, "row", "left").select(
        F.when(~F.col("gone"), F.col("doc_id")).alias("doc_id"), "held_out", n_tokens.alias("n_tokens"),
        (F.col("head_known") + F.coalesce("tail_known", zero) + (1 if texts else 0)).alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"), base.alias("base_score"),
        (F.col("bits") * -math.log10(2)).alias("score"), "n_bytes", "bits", (F.col("bits") / F.col("n_bytes")).alias("bits_per_byte"),
    )
