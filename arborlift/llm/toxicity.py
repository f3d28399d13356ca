"""Toxicity by cumulative-link ordinal regression on sparse text features.

P(grade >= k) is the logistic of (w . x - t_k): one weight per feature, shared by
all thresholds t_1 < t_2 < t_3. Features are the distinct words of a text and the
first four to seven letters of its longer words. The expected severity is the sum of
P(grade >= k); a text is toxic when P(grade >= 1) reaches ``LEAST``.

The model is fitted on at most ``TRAIN_ROWS`` labelled documents, the first by a
hash of the id (a documented bound; only features and figures of these reach the
driver). Their features are counted in Spark, and those that go with toxic
labels (z-score of the log-odds) take part. The labels tell toxic from not;
``graded`` makes severity of them: grade 1, 2 or 3 by how many different words that go with
toxicity the labelled text has (``STEPS``). Any table of grades 0 to 3 can be given instead.

Null texts are empty and get the model's prior; null ids, labels and unknown ids
do not train; a repeated label counts once, the most toxic; without toxic labels
nothing is toxic. Rows stay apart, whatever their ids, and other columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlift.llm.base import by_size, whole
from arborlift.session import stage

TRAIN_ROWS, MIN_DOCS, MIN_Z, LEAST = 20_000, 5, 3.3, 0.5
#: Most different toxic words of grade 1 and of grade 2; longer words also give their beginning.
STEPS, BEGINS, GRADES, PENALTY, TURNS = (3, 7), (4, 5, 6, 7), 3, 2e-4, 300
EDGES = ".,;:!?\"'()[]{}*%$&#|<>"


def features(text: str) -> set[str]:
    words = {w.strip(EDGES) for w in set(text.lower().split())}
    return words.union(*[{w[:n] + "+" for w in words if len(w) > n} for n in BEGINS])


def _emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in by_size(frames, "text", 2_000_000):
        found = [features(t) for t in frame["text"]]
        yield pd.DataFrame({
            "feature": [x for f in found for x in f],
            "toxic": np.repeat(frame["toxic"].to_numpy(), [len(f) for f in found]),
        })


@dataclass
class Model:
    weights: dict[str, float]
    thresholds: list[float]

    def at_least(self, texts: pd.Series) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..., a row per text."""
        get = self.weights.get
        score = np.array([sum(get(f, 0.0) for f in features(t or "")) for t in texts], float)
        return 1 / (1 + np.exp(np.clip(np.asarray(self.thresholds)[None, :] - score[:, None], -40, 40)))


def fit_cumulative(rows: list[np.ndarray], grades: np.ndarray, n_features: int, penalty: float = PENALTY, turns: int = TURNS):
    """Weights and ascending thresholds that maximise the penalised likelihood, by adaptive gradient steps."""
    top = max(int(grades.max(initial=0)), 1)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    index = np.concatenate(rows).astype(np.int64) if len(owner) else np.empty(0, np.int64)
    w = np.zeros(n_features)
    share = [min(max((grades >= k).mean(), 1e-3), 1 - 1e-3) for k in range(1, top + 1)]
    first = -math.log(share[0] / (1 - share[0]))
    gaps = np.full(top - 1, math.log(0.7))
    size = n_features + top
    mean, power = np.zeros(size), np.zeros(size)
    for turn in range(1, turns + 1):
        t = first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        score = np.bincount(owner, w[index], len(rows))
        above = np.concatenate([
            np.ones((len(rows), 1)), 1 / (1 + np.exp(np.clip(t[None, :] - score[:, None], -40, 40))), np.zeros((len(rows), 1))], axis=1)
        at = np.arange(len(rows))
        p = np.maximum(above[at, grades] - above[at, grades + 1], 1e-9)
        slope = above * (1 - above)  # of each cumulative probability in its argument
        d_score = (slope[at, grades] - slope[at, grades + 1]) / p
        d_t = np.zeros((len(rows), top + 2))
        d_t[at, grades] -= slope[at, grades] / p
        d_t[at, grades + 1] += slope[at, grades + 1] / p
        d_t = d_t[:, 1:top + 1].mean(axis=0)
        grad = np.concatenate([
            np.bincount(index, d_score[owner], n_features) / len(rows) - penalty * w,
            [d_t.sum()], np.exp(gaps) * np.array([d_t[k:].sum() for k in range(1, top)])])
        mean, power = 0.9 * mean + 0.1 * grad, 0.99 * power + 0.01 * grad * grad
        step = 0.1 * (mean / (1 - 0.9 ** turn)) / (np.sqrt(power / (1 - 0.99 ** turn)) + 1e-8)
        w, first, gaps = w + step[:n_features], first + step[n_features], gaps + step[n_features + 1:]
    return w, first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])


def graded(toxic: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """Grade 0 for texts that are not toxic, else 1 to 3 by the number of toxic words."""
    return np.where(toxic > 0, 1 + np.searchsorted(np.array(STEPS), hits, side="left"), 0)


def train(
    docs: DataFrame, labels: DataFrame, *, doc: str = "doc_id", text: str = "text", label: str = "toxic",
    rows: int = TRAIN_ROWS,
) -> Model:
    known = labels.select(F.col(doc).alias("_id"), F.col(label).cast("int").alias("toxic")).dropna()
    known = known.groupBy("_id").agg(F.max("toxic").alias("toxic"))
    sample = known.orderBy(F.xxhash64("_id"), "_id").limit(rows)  # rows of two numbers, so many at most
    texts = docs.select(F.col(doc).alias("_id"), whole(text).alias("text")).join(F.broadcast(sample), "_id")
    texts = stage(texts.dropDuplicates(["_id"]).select("text", "toxic"), "toxicity-sample")
    n = {r["toxic"] > 0: r["count"] for r in texts.groupBy("toxic").count().collect()}
    a, b = n.get(True, 0), n.get(False, 0)
    if not a:
        return Model({}, [40.0] * GRADES)
    if not b:
        return Model({}, [-40.0] + [40.0] * (GRADES - 1))
    counts = texts.mapInPandas(_emit, "feature string, toxic int").groupBy("feature").agg(
        F.sum(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") > 0, 0).otherwise(1)).alias("b"))
    z = (F.log((F.col("a") + 0.5) / (a + 1)) - F.log((F.col("b") + 0.5) / (b + 1))) / F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    chosen = counts.where((F.col("a") + F.col("b") >= MIN_DOCS) & (F.abs(z) >= MIN_Z)).select("feature", z.alias("z")).collect()
    names = sorted(r["feature"] for r in chosen)
    place = {f: k for k, f in enumerate(names)}
    toxic_words = {r["feature"] for r in chosen if r["z"] > 0 and not r["feature"].endswith("+")}

    def lookup(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in by_size(frames, "text", 2_000_000):
            found = [features(t) & place.keys() for t in frame["text"]]
            yield pd.DataFrame({
                "toxic": frame["toxic"].to_numpy(), "hits": [len(f & toxic_words) for f in found],
                "at": [sorted(place[x] for x in f) for f in found]})

    design = texts.mapInPandas(lookup, "toxic int, hits int, at array<int>").toPandas()
    grades = graded(design["toxic"].to_numpy(), design["hits"].to_numpy())
    w, t = fit_cumulative([np.asarray(x, np.int64) for x in design["at"]], grades, len(names))
    return Model(dict(zip(names, w.tolist(), strict=True)), t.tolist())


def with_severity(docs: DataFrame, model: Model, *, text: str = "text", least: float = LEAST) -> DataFrame:
    """``docs`` with a struct ``_toxicity``: severity, p_toxic, grade, toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("severity double, p_toxic double, grade int, toxic boolean")
    def judged(texts: pd.Series) -> pd.DataFrame:
        above = shared.value.at_least(texts)
        each = np.diff(np.concatenate([np.ones((len(texts), 1)), above, np.zeros((len(texts), 1))], axis=1), axis=1)
        return pd.DataFrame({
            "severity": above.sum(axis=1), "p_toxic": above[:, 0], "grade": (-each).argmax(axis=1).astype(np.int32),
            "toxic": above[:, 0] >= least})

    return docs.withColumn("_toxicity", judged(F.col(text)))
