"""From sites and layers to the treatment key and the wide pixel table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from arborlift.config import (
    FIRST_COVER_YEAR, LAST_COVER_YEAR, OPEN_END_YEAR, PRE_INTERVENTION_YEARS,
    REQUIRED_SITE_COLUMNS, MatchConfig, require_columns,
)
from arborlift.functions import grid
from arborlift.functions.stats import value_bucket, with_rank
from arborlift.operators import polygons
from arborlift.session import tasks_for

CLIP_BUFFER_DEG = 0.1


def with_site_years(sites: DataFrame) -> DataFrame:
    return sites.withColumns({
        "start_year": F.year("start_date"),
        "end_year": F.coalesce(F.year("end_date"), F.lit(OPEN_END_YEAR)),
    })


def with_site_ids(sites: DataFrame, position: str) -> DataFrame:
    """1-based ids in input order, given before any filter."""
    ranked = with_rank(
        sites.withColumn("_all", F.lit(1)), ["_all"], [position],
        value_bucket(F.col(position).cast("double")), "_rank",
    )
    return ranked.withColumn("id_numeric", (F.col("_rank") + 1).cast("int")).drop(
        "_all", "_rank", "_rank_count"
    )


def reject_duplicate_ids(sites: DataFrame) -> DataFrame:
    twice = sites.groupBy("site_id").count().filter("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"site_id is not unique: {sorted(r.site_id for r in twice)}")
    return sites


def prepare_sites(raw: DataFrame, min_area_ha: float) -> DataFrame:
    """Sites with years, ids and area, without those below the minimum."""
    require_columns(raw.columns, REQUIRED_SITE_COLUMNS, "site file")
    sites = with_site_years(with_site_ids(reject_duplicate_ids(raw), "position"))
    area = polygons.equal_area_ha(sites, "id_numeric")
    kept = large_sites(sites.join(area, "id_numeric"), min_area_ha)
    if kept.isEmpty():
        raise ValueError("no sites left after the area filter")
    return kept


def large_sites(sites: DataFrame, min_area_ha: float) -> DataFrame:
    return sites.filter(F.col("area_ha") >= min_area_ha)


def panel_years(sites: DataFrame) -> DataFrame:
    """Cover years a run over these sites needs, both ends included."""
    known_end = F.when(F.col("end_year") < OPEN_END_YEAR, F.col("end_year"))
    span = sites.agg(
        F.greatest(F.lit(FIRST_COVER_YEAR), F.min("start_year") - PRE_INTERVENTION_YEARS)
        .alias("a"),
        F.least(F.lit(LAST_COVER_YEAR), F.coalesce(F.max(known_end), F.lit(LAST_COVER_YEAR)))
        .alias("b"),
    )
    return span.filter("b >= a").select(F.explode(F.sequence("a", "b")).alias("year"))


def pivot_layers(layers: DataFrame, names: list[str]) -> DataFrame:
    """Long (layer, cell, value) to one row per cell; listed names only."""
    listed = layers.filter(F.col("layer").isin(*names))
    return listed.repartition(tasks_for(listed.count()), "cell").groupBy("cell").agg(*[
        F.max(F.when(F.col("layer") == n, F.col("value"))).alias(n) for n in names
    ])


def clip_to_box(pixels: DataFrame, west, south, east, north, buffer=CLIP_BUFFER_DEG):
    """Pixels in the box widened by the buffer, as plain row and column ranges."""
    rows = (F.floor(F.lit((90 - north - buffer) * 120)), F.floor(F.lit((90 - south + buffer) * 120)))
    cols = (F.floor(F.lit((west + 180 - buffer) * 120)), F.floor(F.lit((east + 180 + buffer) * 120)))
    return pixels.filter(F.col("row").between(*rows) & F.col("col").between(*cols))


def treatment_key(sites: DataFrame) -> DataFrame:
    """(cell, id_numeric, area_ha, site_id) of all treated cells."""
    cells = polygons.site_cells(sites)
    size = 1 / grid.CELLS_PER_DEGREE
    names = sites.select("id_numeric", "site_id")
    return cells.join(names, "id_numeric").select(
        "cell", "id_numeric",
        grid.pixel_area_ha(grid.centre_lat(F.col("row")), size, size).alias("area_ha"),
        "site_id",
    )


def extent_cells(extent: DataFrame, key: str) -> DataFrame:
    """Cells of the matching extent polygons, every touched cell included.

    Polygons are filled one by one (``key`` tells them apart), as overlapping
    ones would cancel out under the even-odd rule.
    """
    touched = polygons.touched_cells(extent, key)
    return touched.select(grid.cell_at(F.col("row"), F.col("col")).alias("cell")).distinct()


def candidate_cells(in_extent: DataFrame, key: DataFrame) -> DataFrame:
    return in_extent.select("cell").union(key.select("cell")).distinct()


def within_matching_extent(pixels: DataFrame, key: DataFrame, variables) -> DataFrame:
    """Pixels that share, for every polygon variable, an id found under a site.

    Chained semi-joins on the id sets replace the union and intersection of
    polygons. With no polygon variable there is no limit.
    """
    treated = pixels.join(key.select("cell"), "cell", "left_semi")
    for var in variables:
        ids = treated.filter(F.col(var).isNotNull() & (F.col(var) != 0)).select(var).distinct()
        pixels = pixels.join(ids, var, "left_semi")
    return pixels


def pixel_table(layers: DataFrame, key: DataFrame, cfg: MatchConfig) -> DataFrame:
    """Wide candidates: matching extent plus treated cells, with pixel areas."""
    wide = pivot_layers(layers, cfg.layers)
    inside = within_matching_extent(wide, key, cfg.extent_vars).select("cell")
    wanted = candidate_cells(inside, key)
    size = 1 / grid.CELLS_PER_DEGREE
    lat = grid.centre_lat(grid.row_in(F.col("cell")))
    return wide.join(wanted, "cell", "left_semi").withColumn(
        "area_ha", grid.pixel_area_ha(lat, size, size)
    )


def downcast(df: DataFrame) -> DataFrame:
    """Doubles to floats, as layers are stored."""
    return df.select(*[
        F.col(c).cast("float").alias(c) if t == "double" else F.col(c) for c, t in df.dtypes
    ])


def formula(covariates) -> dict:
    from arborlift.config import CATEGORICAL_VARS

    terms = [f"factor({c})" if c in CATEGORICAL_VARS else c for c in covariates]
    return {"lhs": "treatment", "rhs": list(covariates),
            "formula_str": "treatment ~ " + " + ".join(terms)}
