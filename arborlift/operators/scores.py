"""Where every sampled row lies in its stratum's distance space.

Strata that fit a task are scored next to their pairing, in one grouped pass.
Larger ones are scored by iterated Spark aggregations: only sums per stratum
are shuffled, and partial sums are formed before the shuffle, so a stratum may
hold any share of the rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from arborlift.config import MatchConfig
from arborlift.functions import solve
from arborlift.functions.stats import quantiles
from arborlift.session import stage

STRATUM = ["id_numeric", "group"]


def sampled_size(cfg: MatchConfig) -> Column:
    """Rows of a stratum that are sampled."""
    take = F.least(F.col("n_treated") * cfg.control_multiplier, F.col("n_controls"))
    return F.least(F.col("n_treated"), F.lit(cfg.max_treatment_pixels)) + take


def coordinates(rows: DataFrame, strata_table: DataFrame, names: list[str], cfg: MatchConfig):
    """Split rows into task-sized strata and distributed-scored ones.

    Returns ``(local_rows, scored_rows or None, names)``. ``scored_rows`` has
    ``coords`` (array of double) and ``pscore``.
    """
    large = strata_table.filter(sampled_size(cfg) > cfg.local_rows).select(*STRATUM)
    rows = rows.select(*STRATUM, "cell", "treatment", *names)
    if large.isEmpty():
        return rows, None, names
    scored = distributed_coordinates(rows.join(large, STRATUM, "left_semi"), names, cfg)
    return rows.join(large, STRATUM, "left_anti"), scored, names


def _moments(rows: DataFrame, names: list[str]) -> DataFrame:
    aggs = [F.count("*").alias("n"), F.count_if("treatment").alias("n_t")]
    for c in names:
        aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")]
    return rows.groupBy(*STRATUM).agg(*aggs)


def distributed_coordinates(rows: DataFrame, names: list[str], cfg: MatchConfig) -> DataFrame:
    rows = stage(rows, "large-rows")
    stats = stage(_moments(rows, names), "large-moments")
    tiny = 1e-12
    scaled = rows.join(stats.filter("n_t > 0 AND n_t < n"), STRATUM).withColumns({
        c: F.when(F.col(f"s_{c}") > tiny * F.greatest(F.abs(f"m_{c}"), F.lit(1e-300)),
                  (F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).otherwise(0.0)
        for c in names
    }).select(*STRATUM, "cell", "treatment", "n", "n_t", *names)
    scaled = stage(scaled, "scaled-rows")
    glm = _logit_coordinates(scaled.filter(F.col("n_t") >= cfg.min_glm_treatment_pixels),
                             names, cfg)
    small = _mahalanobis_coordinates(
        scaled.filter(F.col("n_t") < cfg.min_glm_treatment_pixels), names
    )
    return stage(glm.unionByName(small), "large-coordinates")


def _upper(terms: list[Column]) -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(terms)) for j in range(i, len(terms))]


def _symmetric(flat: np.ndarray, p: int) -> np.ndarray:
    out = np.zeros((p, p))
    out[np.triu_indices(p)] = flat
    return out + np.triu(out, 1).T


def _predictor(names: list[str]) -> Column:
    """Intercept plus slopes times the standardized columns, clipped; what is not a number stays so."""
    terms = F.element_at("beta", 1)
    for i, c in enumerate(names):
        terms = terms + F.element_at("beta", i + 2) * F.col(c)
    limit = F.lit(solve.ETA_LIMIT)
    return F.when(F.isnan(terms), float("nan")).otherwise(F.least(F.greatest(terms, -limit), limit))


def _logit_step(rows: DataFrame, betas: DataFrame, names: list[str]) -> DataFrame:
    """One Newton step for every stratum: one aggregation and a tiny solve."""
    y = F.col("treatment").cast("double")
    open_betas = betas.filter("NOT done")
    df = rows.join(open_betas.select(*STRATUM, "beta"), STRATUM).withColumn("_eta", _predictor(names))
    df = df.withColumn("_mu", 1 / (1 + F.exp(-F.col("_eta"))))
    mu = F.col("_mu")
    terms = [F.lit(1.0), *[F.col(c) for c in names]]
    weight = mu * (1 - mu)
    gram = [F.sum(weight * terms[i] * terms[j]) for i, j in _upper(terms)]
    gradient = [F.sum(t * (y - mu)) for t in terms]
    loss = F.sum(F.when(F.col("treatment"), F.log(mu)).otherwise(F.log1p(-mu))) * -2
    # plain sums only: an array carried along would have every row sorted for the aggregation
    sums = df.groupBy(*STRATUM).agg(
        F.array(*gram).alias("gram"), F.array(*gradient).alias("gradient"), loss.alias("now"),
    ).join(open_betas.select(*STRATUM, "beta", "deviance"), STRATUM)
    p = len(terms)

    def step(gram: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        """Not a number where there is no step: the stratum is reported, the others go on."""
        if not (np.isfinite(gram).all() and np.isfinite(gradient).all()):
            return np.full(p, np.nan)
        return solve.newton_step(gram, gradient)

    @F.pandas_udf("array<double>")
    def solved(gram: pd.Series, gradient: pd.Series, beta: pd.Series) -> pd.Series:
        return pd.Series([
            (np.asarray(b) + step(_symmetric(np.asarray(g), p), np.asarray(d))).tolist()
            for g, d, b in zip(gram, gradient, beta)
        ])

    close = F.isnan("now") | (F.abs(F.col("now") - F.col("deviance")) < solve.TOLERANCE * (F.abs("now") + 0.1))
    return sums.select(
        *STRATUM,
        F.when(close, F.col("beta")).otherwise(solved("gram", "gradient", "beta")).alias("beta"),
        F.col("now").alias("deviance"), close.alias("done"),
    )


def fit_logit(rows: DataFrame, names: list[str]) -> DataFrame:
    """Coefficients ``(stratum, beta)`` of one logistic model per stratum.

    ``rows`` holds standardized columns. Strata leave the loop as they
    converge; the coefficient table is written after every round, so the plan
    does not grow.
    """
    start = rows.groupBy(*STRATUM).agg(F.avg(F.col("treatment").cast("double")).alias("_p"))
    zeros = [F.lit(0.0)] * len(names)
    betas = stage(start.select(
        *STRATUM, F.array(F.log(F.col("_p") / (1 - F.col("_p"))), *zeros).alias("beta"),
        F.lit(float("inf")).alias("deviance"), F.lit(False).alias("done"),
    ), "betas")
    for _ in range(solve.MAX_ITERATIONS):
        step = _logit_step(rows, betas, names)
        betas = stage(betas.filter("done").unionByName(step), "betas")
        if betas.filter("NOT done").isEmpty():
            break
    return betas.select(*STRATUM, "beta")


def pooled_spreads(scored: DataFrame, how: str) -> DataFrame:
    """Pooled spread of the score per stratum, falling back to sd, then 1."""
    arm = [*STRATUM, "treatment"]
    per_arm = scored.groupBy(*arm).agg(
        F.count("*").alias("n"), F.coalesce(F.stddev("lp"), F.lit(0.0)).alias("sd")
    )
    if how == "mad":
        mid = quantiles(scored, arm, "lp", [0.5]).select(*arm, F.col("quantile").alias("mid"))
        off = scored.join(mid, arm).withColumn("off", F.abs(F.col("lp") - F.col("mid")))
        mad = quantiles(off, arm, "off", [0.5]).select(
            *arm, (F.col("quantile") * solve.MAD_TO_SD).alias("mad")
        )
        per_arm = per_arm.join(mad, arm)
    else:
        per_arm = per_arm.withColumn("mad", F.col("sd"))

    def pooled(kind: str) -> Column:
        return F.sqrt(F.sum((F.col("n") - 1) * F.col(kind) * F.col(kind)) / (F.sum("n") - 2))

    both = per_arm.groupBy(*STRATUM).agg(pooled("mad").alias("a"), pooled("sd").alias("b"))
    tiny = 1e-12
    scale = F.when(F.col("a") > tiny, F.col("a")).when(F.col("b") > tiny, F.col("b"))
    return both.select(*STRATUM, F.coalesce(scale, F.lit(1.0)).alias("scale"))


def _logit_coordinates(rows: DataFrame, names: list[str], cfg: MatchConfig) -> DataFrame:
    betas = fit_logit(rows, names)
    scored = stage(rows.join(betas, STRATUM).select(
        *STRATUM, "cell", "treatment", _predictor(names).alias("lp")
    ), "large-scores")
    return scored.join(pooled_spreads(scored, cfg.distance_scale), STRATUM).select(
        *STRATUM, "cell", "treatment",
        F.array(F.round(F.col("lp") / F.col("scale"), solve.DECIMALS)).alias("coords"),
        (1 / (1 + F.exp(-F.col("lp")))).alias("pscore"),
    )


def _mahalanobis_coordinates(rows: DataFrame, names: list[str]) -> DataFrame:
    """Whiten by the pooled within-arm covariance, from sums alone."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    centred = [F.covar_pop(a, b) * F.count("*") for a, b in pairs]
    arms = rows.groupBy(*STRATUM, "treatment").agg(
        F.array(*centred).alias("scatter"), F.count("*").alias("m")
    )
    total = [F.sum(F.element_at("scatter", i + 1)) for i in range(len(pairs))]
    p = len(names)

    @F.pandas_udf("array<array<double>>")
    def whiten(scatter: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for flat, size in zip(scatter, n):
            cov = _symmetric(np.asarray(flat), p) / max(size - 2, 1)
            if not np.isfinite(cov).all():
                out.append(np.full((1, p), np.nan).tolist())
                continue
            w = solve.whitening(cov)
            out.append((w.T if w.shape[1] else np.zeros((1, p))).tolist())
        return pd.Series(out)

    axes = arms.groupBy(*STRATUM).agg(
        F.array(*total).alias("scatter"), F.sum("m").alias("m")
    ).select(*STRATUM, whiten("scatter", "m").alias("axes"))
    point = F.array(*[F.col(c) for c in names])
    along = F.transform("axes", lambda axis: F.aggregate(
        F.zip_with(axis, point, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v
    ))
    return rows.join(axes, STRATUM).select(
        *STRATUM, "cell", "treatment", along.alias("coords"),
        F.lit(None).cast("double").alias("pscore"),
    )
