"""Match sets: weights, and pairing within strata of bounded and any size."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from arborlift.config import MatchConfig
from arborlift.functions import solve
from arborlift.session import stage

SET_KEY = ("site_id", "group", "match_group")


def set_counts(matches: DataFrame, keys=SET_KEY) -> DataFrame:
    """Treated and control rows of every match set."""
    return matches.groupBy(*keys).agg(
        F.count_if("treatment").alias("n_treated"),
        F.count_if(~F.col("treatment")).alias("n_controls"),
    )


def with_match_weights(matches: DataFrame, keys=SET_KEY) -> DataFrame:
    """Treated rows weigh 1; the controls of a set together weigh its treated.

    Rows of sets lacking an arm are dropped. Counts are combined map-side and
    joined back, so a set of any size stays spread over the tasks.
    """
    both = set_counts(matches, keys).filter("n_treated > 0 AND n_controls > 0")
    weighted = matches.join(both, list(keys))
    return weighted.withColumn(
        "match_weight",
        F.when(F.col("treatment"), 1.0).otherwise(F.col("n_treated") / F.col("n_controls")),
    ).drop("n_treated", "n_controls")


STRATUM = ["id_numeric", "group"]
COORDS_SCHEMA = (
    "id_numeric int, group string, cell bigint, treatment boolean, coords array<double>, "
    "pscore double, error string"
)
SETS_SCHEMA = (
    "id_numeric int, group string, cell bigint, treatment boolean, match_group string, "
    "distance double, pscore double, error string"
)
FIRST_HORIZON = 16


def _columns(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def _failed(pdf: pd.DataFrame, why: str, schema: str) -> pd.DataFrame:
    """One row that says why a stratum has no result."""
    names = _columns(schema)
    row = dict.fromkeys(names) | {
        "id_numeric": pdf["id_numeric"].iloc[0], "group": pdf["group"].iloc[0], "error": why}
    return pd.DataFrame([[row[c] for c in names]], columns=names)


def _guarded(work, schema: str):
    """``work`` on a stratum; numbers it cannot work with give a row with the error, and the other strata go on."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
                return work(pdf)
        except (ArithmeticError, ValueError, np.linalg.LinAlgError) as exc:
            return _failed(pdf, f"{type(exc).__name__} in group {pdf['group'].iloc[0]}: {exc}", schema)
    return run


def score_stratum(pdf: pd.DataFrame, names: list[str], cfg: MatchConfig):
    """(coordinates, pscore) of one stratum; None when an arm is empty."""
    return score_rows(pdf[names].to_numpy(dtype=float), pdf["treatment"].to_numpy(dtype=bool), cfg)


def score_rows(x: np.ndarray, treated: np.ndarray, cfg: MatchConfig):
    n_t = int(treated.sum())
    if n_t == 0 or n_t == len(x):
        return None
    if not np.isfinite(x).all():
        raise ValueError("covariates are not finite")
    if n_t < cfg.min_glm_treatment_pixels:
        return solve.whitened(x, treated), np.full(len(x), np.nan)
    score = solve.logit_score(x, treated)
    scale = solve.pooled_scale(score, treated, cfg.distance_scale)
    return np.round(score / scale, solve.DECIMALS)[:, None], 1 / (1 + np.exp(-score))


def pair_stratum(pdf: pd.DataFrame, coords: np.ndarray, pscore: np.ndarray, cfg: MatchConfig,
                 horizon: int | None = None, most: bool = False) -> pd.DataFrame | None:
    """Match sets of one stratum; None when ``horizon`` is too short."""
    found = _paired(pdf["cell"].to_numpy(), pdf["treatment"].to_numpy(dtype=bool), coords, cfg, horizon, most)
    if found is None:
        return None
    at, owner, distance = found
    group = pdf["group"].iloc[0]
    labels = np.array([f"{group}:{cell}" for cell in owner], dtype=object)
    return pdf.iloc[at][[*STRATUM, "cell", "treatment"]].assign(
        match_group=labels, distance=distance, pscore=pscore[at], error=None)[_columns(SETS_SCHEMA)]


def _paired(cells: np.ndarray, treated: np.ndarray, coords: np.ndarray, cfg: MatchConfig,
            horizon: int | None = None, most: bool = False):
    """(rows, cell of the set's treated row, distance) of the pairs; None when ``horizon`` is too short."""
    t_at, c_at = np.flatnonzero(treated), np.flatnonzero(~treated)
    t_at = t_at[np.argsort(cells[t_at], kind="stable")]
    c_at = c_at[np.argsort(cells[c_at], kind="stable")]
    pairs = solve.greedy_pairs(
        coords[t_at], cells[t_at], coords[c_at], cells[c_at],
        cfg.max_controls_per_treatment, cfg.caliper_width, horizon, most,
    )
    if pairs is None:
        return None
    mine = t_at[np.fromiter(pairs, dtype=int, count=len(pairs))]
    per = [len(got) for got in pairs.values()]
    chosen = np.array([c for got in pairs.values() for c, _ in got], dtype=cells.dtype)
    distance = np.array([d for got in pairs.values() for _, d in got], dtype=float)
    theirs = c_at[np.searchsorted(cells[c_at], chosen)]
    return (np.concatenate([mine, theirs]), np.concatenate([cells[mine], np.repeat(cells[mine], per)]),
            np.concatenate([np.zeros(len(mine)), distance]))


def _joined(cells: np.ndarray, treated: np.ndarray, coords: np.ndarray, cfg: MatchConfig):
    """(rows, cell of the nearest treated row, distance) of the controls with one within the caliper."""
    t_at, c_at = np.flatnonzero(treated), np.flatnonzero(~treated)
    if not len(t_at) or not len(c_at):
        return c_at[:0], cells[:0], np.zeros(0)
    gap, spot = solve.nearest_each(coords[c_at], coords[t_at], cells[t_at])
    within = gap <= cfg.caliper_width if cfg.caliper_width > 0 else np.ones(len(gap), dtype=bool)
    return c_at[within], cells[t_at][spot][within], gap[within]


def matched_rows(cells: np.ndarray, treated: np.ndarray, x: np.ndarray, cfg: MatchConfig) -> dict | None:
    """Columns of the match sets of one stratum, weighted as by :func:`with_match_weights`."""
    out = score_rows(x, treated, cfg)
    if out is None:
        return None
    coords, pscore = out
    if cfg.max_controls_per_treatment:
        at, owner, distance = _paired(cells, treated, coords, cfg)
    else:
        at, owner, distance = _paired(cells, treated, coords, replace(cfg, max_controls_per_treatment=1), most=True)
        # by cell, as a cell may come twice
        gone = {arm: np.isin(cells, cells[at[treated[at] == arm]]) & (treated == arm) for arm in (True, False)}
        rest = np.flatnonzero(gone[True] | (~treated & ~gone[False]))
        more, nearest, gap = _joined(cells[rest], treated[rest], coords[rest], cfg)
        at, owner = np.concatenate([at, rest[more]]), np.concatenate([owner, nearest])
        distance = np.concatenate([distance, gap])
    own = treated[at]
    _, sets = np.unique(owner, return_inverse=True)
    n_t, n_c = np.bincount(sets[own], minlength=len(sets)), np.bincount(sets[~own], minlength=len(sets))
    weight = np.where(own, 1.0, n_t[sets] / np.maximum(n_c[sets], 1))
    return {"cell": cells[at], "treatment": own, "owner": owner, "distance": distance,
            "pscore": pscore[at], "match_weight": weight}


def _sizes(placed: DataFrame, cfg: MatchConfig, horizon: int = 1) -> DataFrame:
    """Controls per stratum, and how many of them one task should take.

    A task takes several times what a pass can keep, so every pass shrinks.
    """
    return placed.groupBy(*STRATUM).agg(
        F.count_if(~F.col("treatment")).alias("n_c"),
        F.greatest(F.lit(cfg.local_rows), 4 * horizon * F.count_if("treatment")).alias("chunk"),
    )


def _salted(placed: DataFrame, sizes: DataFrame) -> DataFrame:
    """Spread a stratum's controls over salts, with its treated in each."""
    many = sizes.select(
        *STRATUM, F.greatest(F.ceil(F.col("n_c") / F.col("chunk")), F.lit(1)).alias("_salts")
    )
    df = placed.join(many, STRATUM)
    controls = df.filter("NOT treatment").withColumn(
        "_salt", F.pmod(F.xxhash64("cell"), F.col("_salts"))
    )
    treated = df.filter("treatment").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_salts") - 1))
    )
    return controls.unionByName(treated).drop("_salts")


def _near_controls(placed: DataFrame, cfg: MatchConfig, horizon: int) -> DataFrame:
    """Controls among the ``horizon`` nearest of some treated row.

    What is nearest overall is nearest in its salt, so each pass keeps a
    superset; passes repeat until every stratum fits one task.
    """
    caliper = cfg.caliper_width

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        treated = pdf["treatment"].to_numpy(dtype=bool)
        columns = _columns(COORDS_SCHEMA)
        if treated.all() or not treated.any():
            return pdf.loc[np.zeros(len(pdf), dtype=bool), columns]
        coords = np.vstack(pdf["coords"].to_numpy())
        cells = pdf["cell"].to_numpy()
        pool = solve.NearestControls(coords[~treated], cells[~treated])
        near = set()
        for point in coords[treated]:
            near.update(pool.cells[pool.nearest(point, horizon, caliper)[1]].tolist())
        return pdf.loc[~treated & pdf["cell"].isin(near), columns]

    treated = placed.filter("treatment")
    while True:
        sizes = _sizes(placed, cfg, horizon)
        if sizes.filter("n_c > chunk").isEmpty():
            return placed
        kept = _salted(placed, sizes).groupBy(*STRATUM, "_salt").applyInPandas(
            keep, COORDS_SCHEMA
        )
        placed = stage(kept.unionByName(treated), "near-controls")


def _pairs_of_large(scored: DataFrame, cfg: MatchConfig, most: bool = False) -> DataFrame:
    """Exact pairing of strata too large for a task.

    Pairing rarely looks past a treated row's first few controls, so it runs
    on those alone. Strata where it would have to look further are reported
    and run again with a longer horizon.
    """
    marker = "__incomplete__"

    def run(horizon: int):
        def pair(pdf: pd.DataFrame) -> pd.DataFrame:
            treated = pdf["treatment"].to_numpy(dtype=bool)
            names = _columns(SETS_SCHEMA)
            if treated.all() or not treated.any():
                return pd.DataFrame([], columns=names)
            coords = np.vstack(pdf["coords"].to_numpy())
            out = pair_stratum(pdf, coords, pdf["pscore"].to_numpy(dtype=float), cfg, horizon, most)
            if out is None:
                head = pdf.iloc[0]
                row = (head["id_numeric"], head["group"], head["cell"], True, marker, None, None, None)
                return pd.DataFrame([row], columns=names)
            return out
        return pair

    rest, done = scored, None
    horizon = FIRST_HORIZON * cfg.max_controls_per_treatment
    while True:
        near = _near_controls(rest, cfg, horizon)
        sets = stage(near.groupBy(*STRATUM).applyInPandas(run(horizon), SETS_SCHEMA), "large-sets")
        good = sets.filter(F.coalesce("match_group", F.lit("")) != marker)
        done = good if done is None else done.unionByName(good)
        bad = sets.filter(F.col("match_group") == marker).select(*STRATUM)
        if bad.isEmpty():
            return done
        rest = rest.join(bad, STRATUM, "left_semi")
        horizon *= 8


def assign_full(placed: DataFrame, cfg: MatchConfig) -> DataFrame:
    """Full matching: sets of one treated and at least one control.

    Every treated row gets a control of its own first, by 1:1 pairing with exchanges:
    no way of pairing within the caliper pairs more. Every control left over
    then joins the nearest paired treated row within the caliper. As a set has one treated row,
    those are left out that no pairing has a control of their own for.
    """
    pairs = stage(_pairs_of_large(placed, replace(cfg, max_controls_per_treatment=1), most=True), "full-pairs")

    def nearest(pdf: pd.DataFrame) -> pd.DataFrame:
        treated = pdf["treatment"].to_numpy(dtype=bool)
        names = _columns(SETS_SCHEMA)
        if treated.all() or not treated.any():
            return pd.DataFrame([], columns=names)
        coords, cells = np.vstack(pdf["coords"].to_numpy()), pdf["cell"].to_numpy()
        at, owner, distance = _joined(cells, treated, coords, cfg)
        group = pdf["group"].iloc[0]
        return pd.DataFrame({
            "id_numeric": pdf["id_numeric"].iloc[0], "group": group, "cell": cells[at], "treatment": False,
            # of type object even where it is empty, as Arrow takes it for a string then
            "match_group": np.array([f"{group}:{cell}" for cell in owner], dtype=object),
            "distance": distance, "pscore": pdf["pscore"].to_numpy(dtype=float)[at],
            "error": np.full(len(at), None, dtype=object),
        }, columns=names)

    used = pairs.select(*STRATUM, "cell", "treatment")
    mine = [*STRATUM, "cell", "treatment"]
    paired = placed.filter("treatment").join(used, mine, "left_semi")
    free = placed.filter("NOT treatment").join(used, mine, "left_anti")
    rest = stage(paired.unionByName(free), "full-rest")
    joined = _salted(rest, _sizes(rest, cfg)).groupBy(*STRATUM, "_salt").applyInPandas(
        nearest, SETS_SCHEMA
    )
    return pairs.unionByName(joined)


def match_rows(placed, cfg: MatchConfig) -> DataFrame:
    """Match sets from the output of :func:`scores.coordinates`.

    A stratum that cannot be scored or paired has one row with its ``error`` and no cell.
    """
    local, scored, names = placed

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        out = score_stratum(pdf, names, cfg)
        if out is None:
            return pd.DataFrame([], columns=_columns(COORDS_SCHEMA))
        coords, pscore = out
        return pdf[[*STRATUM, "cell", "treatment"]].assign(coords=list(coords), pscore=pscore, error=None)

    def pair(pdf: pd.DataFrame) -> pd.DataFrame:
        out = score_stratum(pdf, names, cfg)
        if out is None:
            return pd.DataFrame([], columns=_columns(SETS_SCHEMA))
        return pair_stratum(pdf, *out, cfg)

    sound = None
    if scored is not None:
        odd = F.exists("coords", lambda v: F.isnan(v) | v.isNull())
        lost = stage(scored.where(odd).select(*STRATUM).distinct(), "unscored")
        sound = scored.join(lost, STRATUM, "left_anti").withColumn("error", F.lit(None).cast("string"))
        lost = lost.withColumn("error", F.concat(F.lit("ValueError in group "), F.col("group"), F.lit(": covariates are not finite")))
    if cfg.max_controls_per_treatment == 0:
        rows = stage(local.groupBy(*STRATUM).applyInPandas(_guarded(score, COORDS_SCHEMA), COORDS_SCHEMA), "scores")
        failed = rows.where("error IS NOT NULL").select(*STRATUM, "error")
        rows = rows.where("error IS NULL")
        rows = rows if sound is None else rows.unionByName(sound)
        sets = assign_full(stage(rows, "coordinates"), cfg).unionByName(failed, allowMissingColumns=True)
    else:
        sets = local.groupBy(*STRATUM).applyInPandas(_guarded(pair, SETS_SCHEMA), SETS_SCHEMA)
        sets = sets if sound is None else sets.unionByName(_pairs_of_large(sound, cfg))
    return sets if scored is None else sets.unionByName(lost, allowMissingColumns=True)
