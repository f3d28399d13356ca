"""Strata that fit a task, matched where their controls are.

A site draws on a run of its group's seeded control order, and a control enters for many
sites. Dealt out to all of them the controls are many times the pixels, so the order is cut
into chunks instead and the treated rows of a stratum go to the chunk its run starts in. Only
what a task returns is per site.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from arborlift.config import (
    CATEGORICAL_VARS, PRE_DEFOR_FIRST_START, PRE_INTERVENTION_YEARS, MatchConfig,
)
from arborlift.operators import matching, pairing
from arborlift.session import stage

STRATUM = ["id_numeric", "group"]
CHUNK = ["group", "width", "chunk", "salt"]
#: Least width of a chunk in positions, and the width at which it is no longer four times the longest run.
NARROW, WIDE = 8_192, 262_144
#: Sampled rows of all its strata that a chunk is split at.
ROWS_A_CHUNK = 1_000_000
HASH_DIGITS = 15
BUCKET_BITS = 4 * (HASH_DIGITS - matching.HASH_DIGITS)
#: Covariates up to here are finite in every sum of a fit.
TAME = 1e100
OUT_SCHEMA = (
    "id_numeric int, group string, cell bigint, treatment boolean, owner bigint, distance double, "
    "pscore double, match_weight double, n_treatment_final bigint, n_control_sampled bigint, error string"
)
_ARROW = pa.schema([
    ("id_numeric", pa.int32()), ("group", pa.string()), ("cell", pa.int64()), ("treatment", pa.bool_()),
    ("owner", pa.int64()), ("distance", pa.float64()), ("pscore", pa.float64()), ("match_weight", pa.float64()),
    ("n_treatment_final", pa.int64()), ("n_control_sampled", pa.int64()), ("error", pa.string()),
])


def compared_years(sites: DataFrame, cfg: MatchConfig) -> list[int]:
    """Start years of ``sites`` whose pre-intervention change is known; cover years at most."""
    years = set(cfg.fc_years)
    able = [y for y in years if y >= PRE_DEFOR_FIRST_START and y - PRE_INTERVENTION_YEARS in years]
    return sorted(r[0] for r in sites.where(F.col("start_year").isin(able)).select("start_year").distinct().collect())


def placed_pixels(pixels: DataFrame, key: DataFrame, cfg: MatchConfig, years: list[int]) -> DataFrame:
    """Pixels in their group, with their site if treated, and the values a model may ask for.

    ``times`` says how many rows of the pixel table share the cell. Cover before an
    intervention is 0 where it is missing, as both leave the pixel out.
    """
    values = [F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cfg.covariates)]
    for y in years:
        first = F.col(f"fc_{y - PRE_INTERVENTION_YEARS}").cast("double")
        values += [F.coalesce(first, F.lit(0.0)).alias(f"i{y}"), F.col(f"fc_{y}").cast("double").alias(f"f{y}")]
    same = F.count(F.lit(1)).over(Window.partitionBy("cell"))
    wide = pixels.select("cell", *cfg.exact_match_vars, *values, F.when(F.col("cell").isNotNull(), same).alias("times"))
    grouped = matching.drop_missing_strata(wide, cfg.exact_match_vars).withColumn(
        "group", matching.exact_group(cfg.exact_match_vars)).drop(*cfg.exact_match_vars)
    return stage(matching.flag_treatment(grouped, key), "placed-pixels")


def fits(placed: DataFrame, sites: DataFrame, cfg: MatchConfig) -> bool:
    """Whether cells and sites are unique; indicators need the levels of the whole sample."""
    if set(cfg.covariates) & set(CATEGORICAL_VARS):
        return False
    twice = sites.where("id_numeric IS NOT NULL").groupBy("id_numeric").count().where("count > 1")
    return placed.where("times > 1").isEmpty() and twice.isEmpty()


def chunk_runs(strata_table: DataFrame, sites: DataFrame, cfg: MatchConfig, years: list[int]):
    """Runs of the strata with their chunk, and the chunks with the positions they need."""
    compared = F.when(F.col("start_year").isin(years), F.col("start_year")).otherwise(0).cast("int")
    runs = matching.control_runs(strata_table, cfg.control_multiplier, cfg.random_seed).join(
        sites.select("id_numeric", compared.alias("year")), "id_numeric")
    longest = F.pow(F.lit(2), F.ceil(F.log2("take"))).cast("bigint")
    width = F.greatest(F.least(4 * longest, F.lit(WIDE)), longest, F.lit(NARROW))
    runs = runs.withColumn("width", width).withColumn("chunk", F.floor(F.col("start") / F.col("width")))
    runs = stage(runs, "runs")
    chunks = stage(runs.groupBy("group", "width", "chunk").agg(
        F.min("start").alias("lo"), F.max(F.col("start") + F.col("take")).alias("hi"),
        F.max("n_controls").alias("n"), F.ceil(F.sum("take") / ROWS_A_CHUNK).alias("salts"),
    ), "chunks")
    salt = F.pmod(F.xxhash64("id_numeric"), F.col("salts"))
    runs = runs.join(chunks.select("group", "width", "chunk", "salts"), ["group", "width", "chunk"])
    return stage(runs.withColumn("salt", salt).drop("salts"), "salted-runs"), chunks


def chunked(placed: DataFrame, runs: DataFrame, chunks: DataFrame, cfg: MatchConfig):
    """Treated rows and controls, both with the chunk they go to."""
    digest = matching._digest(cfg.random_seed, F.col("cell"))
    # pixels without a cell are in no bucket, but the order counts them first
    controls = placed.where("NOT treatment").drop("id_numeric", "treatment", "times").withColumn(
        "h", matching._hex_number(digest, HASH_DIGITS)).withColumn("bucket", F.shiftright("h", BUCKET_BITS))
    counts = controls.groupBy("group", "bucket").agg(F.count("*").alias("n_here"))
    along = Window.partitionBy("group").orderBy("bucket")
    offsets = counts.withColumn("offset", F.sum("n_here").over(along) - F.col("n_here"))
    end = F.col("offset") + F.col("n_here")
    need = chunks.join(offsets, "group").where(
        ((F.col("offset") < F.col("hi")) & (end > F.col("lo"))) | (F.col("offset") < F.col("hi") - F.col("n")))
    need = stage(need.select(
        "group", "bucket", "offset", "width", "chunk",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)).alias("salt")), "needed-buckets")
    controls = controls.join(need, ["group", "bucket"]).drop("bucket")

    own = placed.where("treatment").drop("treatment", "times")
    treated = own.join(runs.where(F.col("n_treated") <= cfg.max_treatment_pixels), STRATUM)
    many = runs.where(F.col("n_treated") > cfg.max_treatment_pixels)
    if not many.isEmpty():
        treated = treated.unionByName(matching.sample_treated(
            own.join(many, STRATUM), cfg.max_treatment_pixels, cfg.random_seed))
    return treated.drop("n_treated", "lo", "hi"), controls


def _by_hash(cells: np.ndarray, h: np.ndarray, seed: int) -> np.ndarray:
    """Order of the whole hash, then the cell; ``h`` is its beginning."""
    order = np.lexsort((cells, h))
    tied = np.flatnonzero((h[order][1:] == h[order][:-1]) & (cells[order][1:] != cells[order][:-1]))
    if len(tied):
        full = [hashlib.md5(f"{seed}:{c}".encode()).hexdigest() for c in cells.tolist()]
        order = np.array(sorted(range(len(cells)), key=lambda i: (full[i], cells[i])))
    return order


def _array(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


class _Values:
    """Cells of one side of a chunk with their model values, in a given order."""

    def __init__(self, table: pa.Table, order: np.ndarray, n_covariates: int, years: list[int]):
        self.cells = _array(table, "cell")[order].astype(np.int64)
        self.x = np.column_stack([_array(table, f"x{i}")[order] for i in range(n_covariates)]).astype(float)
        self.cover = {y: (_array(table, f"i{y}")[order], _array(table, f"f{y}")[order]) for y in years}

    def sampled(self, at, year: int):
        """(cells, terms) of the rows ``at`` that enter matching."""
        cells, x = self.cells[at], self.x[at]
        if not year:
            return cells, np.column_stack([x, np.zeros(len(x))])
        before, after = (v[at] for v in self.cover[year])
        change = (after - before) / before * 100
        enters = before != 0
        return cells[enters], np.column_stack([x, change])[enters]


def match_chunks(treated: DataFrame, controls: DataFrame, cfg: MatchConfig, years: list[int], rows: bool = True) -> DataFrame:
    """Matched rows of every stratum, and one row without a cell that tells its counts and error.

    With ``rows`` off there are only the latter.
    """
    p = len(cfg.covariates)

    def one(group, mine, run, own: _Values, pool: _Values, position):
        start, take, n, year = run
        end = start + take
        at = np.arange(*np.searchsorted(position, [start, min(end, n)]))
        if end > n:
            at = np.concatenate([at, np.arange(np.searchsorted(position, end - n))])
        t_cells, t_x = own.sampled(mine, year)
        c_cells, c_x = pool.sampled(at, year)
        if not len(t_cells) or not len(c_cells):
            return None
        head = (len(t_cells), len(c_cells))
        x = np.vstack([t_x, c_x])
        full = ~np.isnan(x).any(axis=1)
        flag = np.repeat([True, False], head)[full]
        x, cells = x[full], np.concatenate([t_cells, c_cells])[full]
        if not rows and (len(x) == 0 or np.abs(x).max() < TAME):
            return *head, None, None
        try:
            return *head, None, pairing.matched_rows(cells, flag, x, cfg)
        except (ArithmeticError, ValueError, np.linalg.LinAlgError) as exc:
            return *head, f"{type(exc).__name__} in group {group}: {exc}", None

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _ARROW.empty_table()
        group = left.column("group")[0].as_py()
        order = _by_hash(_array(right, "cell"), h := _array(right, "h"), cfg.random_seed)
        offset, at = _array(right, "offset")[order], np.arange(len(order))
        first = np.concatenate([[True], offset[1:] != offset[:-1]])
        position = offset + at - np.maximum.accumulate(np.where(first, at, 0))
        pool = _Values(right, order, p, years)
        order = np.lexsort((_array(left, "cell"), _array(left, "id_numeric")))
        own, ids = _Values(left, order, p, years), _array(left, "id_numeric")[order]
        runs = [_array(left, c)[order] for c in ("start", "take", "n_controls", "year")]
        edges = [*np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])).tolist(), len(ids)]
        heads, parts = [], []
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            for a, b in zip(edges, edges[1:]):
                got = one(group, slice(a, b), [int(c[a]) for c in runs], own, pool, position)
                if got is not None:
                    heads.append((ids[a], *got[:3]))
                    if rows and got[3] is not None:
                        parts.append((ids[a], got[3]))
        out = [_heads_table(heads, group)]
        if parts:
            out.append(_rows_table(parts, group))
        return pa.concat_tables(out)

    # both sides come from one table; columns of new names' own keep them apart
    treated, controls = (side.toDF(*side.columns).groupBy(*CHUNK) for side in (treated, controls))
    return treated.cogroup(controls).applyInArrow(work, OUT_SCHEMA)


def _table(n: int, group: str, columns: dict) -> pa.Table:
    columns = {"group": pa.DictionaryArray.from_arrays(pa.array(np.zeros(n, dtype=np.int32)), [group]).cast(pa.string()), **columns}
    return pa.Table.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in _ARROW], schema=_ARROW)


def _heads_table(heads: list, group: str) -> pa.Table:
    ids, n_t, n_c, errors = (list(v) for v in zip(*heads)) if heads else ([], [], [], [])
    return _table(len(ids), group, {
        "id_numeric": pa.array(ids, pa.int32()), "n_treatment_final": pa.array(n_t, pa.int64()),
        "n_control_sampled": pa.array(n_c, pa.int64()), "error": pa.array(errors, pa.string())})


def _rows_table(parts: list, group: str) -> pa.Table:
    sizes = [len(rows["cell"]) for _, rows in parts]
    columns = {c: pa.array(np.concatenate([rows[c] for _, rows in parts]), _ARROW.field(c).type, from_pandas=True)
               for c in ("cell", "treatment", "owner", "distance", "pscore", "match_weight")}
    ids = pa.array(np.repeat([i for i, _ in parts], sizes), pa.int32())
    return _table(sum(sizes), group, {"id_numeric": ids, **columns})
