"""Quality rules with robust multivariate outliers: minimum covariance determinant.

Base rules need counts of words, symbols, repeated lines and repeated word
triples; they are computed inside each row. Of rows that pass, a vector of four
transformed statistics (log mean word length, and square roots of the symbol
share, the repeated-line share and the repeated-triple share) is judged within
its (language, source):

1. start: coordinate-wise medians and median absolute deviations;
2. C-steps: keep the ``support`` share of rows nearest by the current distance,
   and take mean and covariance of these (each step lowers the determinant);
3. reject a row when its squared Mahalanobis distance is above ``cutoff``.

Only built-in functions are used. No group is ever gathered: medians come from
counts of value bins, and a C-step sums moments per (group, distance bin) before
the shuffle, then adds up the lowest bins until ``support`` is reached (the bin
that crosses it is taken whole). A group with a third of all rows is a few
hundred sums. Group estimates are one row per (language, source).

Spreads have floors (``FLOORS``), as most texts have no symbols or repeats at
all, and a group of fewer than ``min_rows`` rows rejects nothing by distance.
Null texts have no words and fail the base rules; null languages or sources form
groups of their own; repeated rows are judged alike; empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlift.llm.base import SPACE, split_words, whole
from arborlift.session import stage

SYMBOLS = "#*$%&|<>"
STATS = ("x1", "x2", "x3", "x4")
#: Least spread of each statistic, and the width of a bin for medians.
FLOORS, BIN = (0.15, 0.06, 0.3, 0.25), 0.01
#: For four dimensions and support 0.75: makes the covariance of the nearest rows that of all.
CONSISTENCY = 1.487
STEPS, SUPPORT, CUTOFF, MIN_ROWS, RIDGE = 3, 0.75, 30.0, 20, 0.25


def _sorted_runs(words: Column) -> Column:
    """(hash, position) of every run of three words, equal ones side by side."""
    last = F.size(words) - 3
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.array_sort(F.transform(starts, lambda i: F.struct(
        F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i"))))


def text_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    body = whole(text)
    with_word = F.filter(F.split(F.col("_body"), "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0)
    twice = F.filter("_runs", lambda r, i: (
        (F.get(F.col("_runs"), i - 1)["h"] == r["h"]) | (F.get(F.col("_runs"), i + 1)["h"] == r["h"])))
    at = F.array_sort(F.transform(twice, lambda r: r["i"]))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n"))
    inside = F.aggregate("_at", zero, lambda a, i: F.struct(
        (i + 3).alias("end"), (a["n"] + F.least(F.lit(3), i + 3 - a["end"])).alias("n")), lambda a: a["n"])
    long = lambda c: c.cast("bigint")
    return (
        docs.withColumn("_body", body)
        .withColumn("_words", split_words(F.col("_body")))
        .withColumn("_runs", _sorted_runs(F.col("_words")))
        .withColumn("_at", at)
        .withColumn("_lines", with_word)
        .withColumns({
            "n_words": long(F.size("_words")),
            "word_chars": long(F.length(F.translate("_body", SPACE, ""))),
            "n_symbols": long(F.length("_body") - F.length(F.translate("_body", SYMBOLS, ""))),
            "n_lines": long(F.size("_lines")),
            "n_dup_lines": long(F.size("_lines") - F.size(F.array_distinct("_lines"))),
            "n_repeat_words": inside,
        })
        .drop("_body", "_words", "_runs", "_at", "_lines")
    )


def _same(left: str = "lang", right: str = "source") -> list[Column]:
    return [F.col(f"v.{c}").eqNullSafe(F.col(f"g.{c}")) for c in (left, right)]


def _median(binned: DataFrame) -> DataFrame:
    """Median bin of ``b`` per (lang, source, stat), from counted bins."""
    counts = binned.groupBy("lang", "source", "stat", "b").count()
    w = Window.partitionBy("lang", "source", "stat")
    upto = counts.select(
        "lang", "source", "stat", "b",
        F.sum("count").over(w.orderBy("b")).alias("upto"), F.sum("count").over(w).alias("n"),
    )
    return upto.where(2 * F.col("upto") >= F.col("n")).groupBy("lang", "source", "stat").agg(
        F.min("b").alias("b"), F.max("n").alias("n"))


def _long(vectors: DataFrame, value) -> DataFrame:
    return vectors.select("v.lang", "v.source", F.inline(F.array(*[
        F.struct(F.lit(k).alias("stat"), F.floor(value(k) / BIN).cast("bigint").alias("b")) for k in STATS
    ])))


def _wide(medians: DataFrame, suffix: str) -> DataFrame:
    return medians.groupBy("lang", "source").agg(
        F.max("n").alias("n"), *[F.max(F.when(F.col("stat") == k, (F.col("b") + 0.5) * BIN)).alias(k + suffix) for k in STATS])


def lower_factor(a: dict[tuple[int, int], Column]) -> dict[tuple[int, int], Column]:
    """Cholesky factor of a 4x4 matrix given as expressions."""
    out: dict[tuple[int, int], Column] = {}
    for i in range(4):
        for j in range(i + 1):
            rest = reduce(lambda x, y: x - y, [out[i, k] * out[j, k] for k in range(j)], a[i, j])
            out[i, j] = F.sqrt(rest) if i == j else rest / out[j, j]
    return out


def squared_distance(z: list[Column], mean: list[Column], factor: list[list[Column]]) -> Column:
    y: list[Column] = []
    for i in range(4):
        rest = reduce(lambda x, k: x - factor[i][k] * y[k], range(i), z[i] - mean[i])
        y.append(rest / factor[i][i])
    return reduce(lambda x, v: x + v * v, y[1:], y[0] * y[0])


def mcd(vectors: DataFrame, *, steps: int = STEPS, support: float = SUPPORT) -> DataFrame:
    """Estimates per (lang, source) over columns lang, source, x1..x4 (none null).

    Columns: lang, source, n, x*_mid and x*_dev (centre and scale of the
    coordinates), m1..m4 (mean), f11..f44 (Cholesky factor of the covariance).
    """
    mid = stage(_wide(_median(_long(vectors.alias("v"), lambda k: F.col(f"v.{k}"))), "_mid"), "mcd-mid")
    off = vectors.alias("v").join(mid.alias("g"), _same())
    dev = _wide(_median(_long(off, lambda k: F.abs(F.col(f"v.{k}") - F.col(f"g.{k}_mid")))), "_dev").drop("n")
    dev = dev.select("lang", "source", *[
        F.greatest(F.col(f"{k}_dev") * 1.4826, F.lit(floor)).alias(f"{k}_dev") for k, floor in zip(STATS, FLOORS, strict=True)])
    scale = mid.alias("v").join(dev.alias("g"), _same()).select("v.*", *[f"g.{k}_dev" for k in STATS])
    at = {f"m{i + 1}": F.lit(0.0) for i in range(4)} | {
        f"f{i + 1}{j + 1}": F.lit(1.0 if i == j else 0.0) for i in range(4) for j in range(i + 1)}
    known = stage(scale.withColumns(at), "mcd-start")
    pairs = [(i, j) for i in range(4) for j in range(i + 1)]
    for _ in range(steps):
        z = scaled()
        near = vectors.alias("v").join(known.alias("g"), _same()).select(
            "v.lang", "v.source", *[c.alias(f"z{i + 1}") for i, c in enumerate(z)],
            F.floor(8 * F.log2(1e-6 + distance(z))).cast("bigint").alias("b"))
        sums = near.groupBy("lang", "source", "b").agg(
            F.count(F.lit(1)).alias("k"),
            *[F.sum(f"z{i + 1}").alias(f"s{i + 1}") for i in range(4)],
            *[F.sum(F.col(f"z{i + 1}") * F.col(f"z{j + 1}")).alias(f"p{i + 1}{j + 1}") for i, j in pairs])
        w = Window.partitionBy("lang", "source")
        taken = sums.select(
            "*", F.sum("k").over(w.orderBy("b")).alias("upto"), F.sum("k").over(w).alias("all"),
        ).where(F.col("upto") - F.col("k") < support * F.col("all"))
        totals = taken.groupBy("lang", "source").agg(*[F.sum(c).alias(c) for c in sums.columns[3:]])
        mean = [F.col(f"s{i + 1}") / F.col("k") for i in range(4)]
        cov = {(i, j): CONSISTENCY * (F.col(f"p{i + 1}{j + 1}") / F.col("k") - mean[i] * mean[j])
               + (RIDGE if i == j else 0.0) for i, j in pairs}
        fits = totals.select(
            "lang", "source", *[m.alias(f"m{i + 1}") for i, m in enumerate(mean)],
            *[c.alias(f"a{i + 1}{j + 1}") for (i, j), c in cov.items()])
        factor = lower_factor({(i, j): F.col(f"a{i + 1}{j + 1}") for i, j in pairs})
        fits = fits.select("lang", "source", "m1", "m2", "m3", "m4",
                           *[c.alias(f"f{i + 1}{j + 1}") for (i, j), c in factor.items()])
        base = known.select("lang", "source", "n", *[f"{k}_{s}" for s in ("mid", "dev") for k in STATS])
        known = stage(base.alias("v").join(fits.alias("g"), _same()).select("v.*", *[f"g.{c}" for c in fits.columns[2:]]), "mcd-step")
    return known


def scaled() -> list[Column]:
    return [(F.col(f"v.{k}") - F.col(f"g.{k}_mid")) / F.col(f"g.{k}_dev") for k in STATS]


def distance(z: list[Column]) -> Column:
    return squared_distance(z, [F.col(f"g.m{i + 1}") for i in range(4)],
                            [[F.col(f"g.f{i + 1}{j + 1}") for j in range(i + 1)] for i in range(4)])


def judge_quality(
    docs: DataFrame, *, doc: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source",
    cutoff: float = CUTOFF, min_rows: int = MIN_ROWS, steps: int = STEPS, support: float = SUPPORT,
) -> DataFrame:
    """Counts, base verdict, squared distance and verdict of every row."""
    named = docs.select(F.col(doc).alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text"))
    counts = text_counts(named).drop("text")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    share = lambda a, b: F.sqrt(F.col(a) / F.col(b))
    rows = stage(counts.withColumn("base_failed", failed).withColumns({
        "x1": F.when(~F.col("base_failed"), F.log(F.col("word_chars") / F.col("n_words"))),
        "x2": F.when(~F.col("base_failed"), share("n_symbols", "word_chars")),
        "x3": F.when(~F.col("base_failed"), share("n_dup_lines", "n_lines")),
        "x4": F.when(~F.col("base_failed"), share("n_repeat_words", "n_words")),
    }), "text-counts")
    known = mcd(rows.where(~F.col("base_failed")).select("lang", "source", *STATS), steps=steps, support=support)
    far = distance(scaled())
    judged = rows.alias("v").join(known.alias("g"), _same(), "left")
    kept = ~F.col("v.base_failed") & ((F.col("g.n") < min_rows) | (far <= cutoff))
    return judged.select(
        "v.doc_id", "v.n_words", "v.word_chars", "v.n_symbols", "v.n_dup_lines", "v.n_repeat_words", "v.base_failed",
        F.coalesce(kept, F.lit(False)).alias("kept"), F.when(~F.col("v.base_failed"), far).alias("distance2"),
    )
