"""Ordered operators: differences, baselines, owners, newest records, stencils."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborlift.operators import polygons, raster, registry
from arborlift.plans.aggregate_queries import panel, rounded
from arborlift.plans.catalogue import query
from arborlift.plans.oracle_views import (
    GRID, KEY, PANELED, PIX, POLYGONS, REGISTRY, cte,
)
from arborlift.sources import shared_tables as T


@query("win_forest_change", cte(*PANELED) + """
SELECT site_id, cell, year, round(forest_change_ha,6) AS forest_change_ha FROM pan""")
def _(spark, d):
    return rounded(panel(spark, d).select("site_id", "cell", "year", "forest_change_ha"))


@query("win_baseline_fraction", cte(*PANELED) + """
SELECT site_id, cell, year, round(forest_at_year_end,6) AS forest_at_year_end,
 round(frac,6) AS forest_frac_remaining FROM pan""")
def _(spark, d):
    return rounded(panel(spark, d).select(
        "site_id", "cell", "year", "forest_at_year_end", "forest_frac_remaining"))


@query("win_emissions", cte(*PANELED) + """
SELECT site_id, cell, year, round(emissions_mgco2e,6) AS emissions_mgco2e FROM pan""")
def _(spark, d):
    return rounded(panel(spark, d).select("site_id", "cell", "year", "emissions_mgco2e"))


@query("win_cell_owner", """
SELECT l_orderkey AS cell, CAST(max(l_suppkey) AS INT) AS id_numeric FROM lineitem GROUP BY 1""")
def _(spark, d):
    burned = T.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("cell"), F.col("l_suppkey").cast("int").alias("id_numeric")
    )
    return polygons.cell_owner(burned)


@query("win_latest_record", cte(REGISTRY) + """
SELECT covariate_name, id, status, merged_url, size_bytes FROM latest""")
def _(spark, d):
    latest = registry.latest_record(T.registry(spark, d))
    return latest.select("covariate_name", "id", "status", "merged_url", "size_bytes")


@query("win_latest_by_status", cte(REGISTRY) + """
SELECT covariate_name, id, status FROM (SELECT *, row_number() OVER (PARTITION BY covariate_name
 ORDER BY started_at DESC NULLS LAST, id) AS k FROM reg
 WHERE status IN ('exported','merged','failed')) WHERE k=1""")
def _(spark, d):
    latest = registry.latest_record(T.registry(spark, d), registry.REUSABLE)
    return latest.select("covariate_name", "id", "status")


@query("win_array_index", cte(PIX, KEY) + """
SELECT id_numeric, row_number() OVER (ORDER BY c)-1 AS array_index
FROM (SELECT id_numeric, min(cell) AS c FROM tkey GROUP BY 1)""")
def _(spark, d):
    return registry.array_index(T.treatment_key(spark, d))


@query("win_scanline_pairs", cte(POLYGONS) + """
, cr AS (SELECT id_numeric, "row", x0+(cy-y0)/(y1-y0)*(x1-x0) AS x FROM
  (SELECT e.*, r."row", 90e0-(r."row"+0.5e0)/120 AS cy FROM edge e
   JOIN (SELECT DISTINCT id_numeric, "row" FROM cand) r USING (id_numeric))
  WHERE least(y0,y1)<=cy AND cy<greatest(y0,y1)),
nx AS (SELECT *, lead(x) OVER w AS x_end, row_number() OVER w AS i FROM cr
  WINDOW w AS (PARTITION BY id_numeric, "row" ORDER BY x))
SELECT id_numeric, "row", round(x,8) AS x, round(x_end,8) AS x_end FROM nx WHERE i%2=1""")
def _(spark, d):
    edge = polygons.edges(T.site_polygons(spark, d), "id_numeric")
    return rounded(polygons.inside_runs(edge, "id_numeric"), 8)


_SIDES = {"nw": (-1, -1), "n": (-1, 0), "ne": (-1, 1), "w": (0, -1), "e": (0, 1),
          "sw": (1, -1), "s": (1, 0), "se": (1, 1)}
STENCIL_SQL = """, el AS (SELECT "row", col, max(value) AS z FROM grid GROUP BY ALL),
nb AS (SELECT el."row", el.col, """ + ", ".join(
    f"max(o.z) FILTER (o.\"row\"-el.\"row\"={r} AND o.col-el.col={c}) AS {k}"
    for k, (r, c) in _SIDES.items()
) + """ FROM el JOIN el o ON o."row" BETWEEN el."row"-1 AND el."row"+1
  AND o.col BETWEEN el.col-1 AND el.col+1 GROUP BY ALL),
gr AS (SELECT "row", col, ((ne+2*e+se)-(nw+2*w+sw))/240e0 AS dx,
 ((nw+2*n+ne)-(sw+2*s+se))/240e0 AS dy FROM nb)
"""


def elevation(spark, d):
    return T.grid_values(spark, d).groupBy("row", "col").agg(F.max("value").alias("elevation"))


@query("win_neighbourhood_3x3", cte(PIX, GRID) + STENCIL_SQL + """
SELECT "row", col, round(dx,6) AS dx, round(dy,6) AS dy FROM gr""")
def _(spark, d):
    return rounded(raster.gradient(elevation(spark, d), F.lit(30.0)).select("row", "col", "dx", "dy"))


@query("ras_slope", cte(PIX, GRID) + STENCIL_SQL + """
SELECT "row", col, round(degrees(atan(sqrt(dx*dx+dy*dy))),6) AS slope FROM gr""")
def _(spark, d):
    return rounded(raster.slope(elevation(spark, d), F.lit(30.0)).select("row", "col", "slope"))


@query("ras_aspect", cte(PIX, GRID) + STENCIL_SQL + """
SELECT "row", col, round(CASE WHEN dx=0 AND dy=0 THEN 0 ELSE
 (degrees(atan2(-dx,-dy))+360)-360*floor((degrees(atan2(-dx,-dy))+360)/360) END,6) AS aspect FROM gr""")
def _(spark, d):
    return rounded(raster.aspect(elevation(spark, d), F.lit(30.0)).select("row", "col", "aspect"))
