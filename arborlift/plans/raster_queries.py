"""Covariate derivation on pixel tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborlift.operators import extract, polygons, raster
from arborlift.plans.aggregate_queries import rounded
from arborlift.plans.catalogue import query
from arborlift.plans.oracle_views import GRID, PIX, POLYGONS, cte
from arborlift.sources import shared_tables as T

COARSE = """CAST(floor("row"/5) AS BIGINT) AS "row", CAST(floor(col/5) AS BIGINT) AS col"""


@query("ras_resample", cte(PIX, GRID) + f"""
, md AS (SELECT "row", col, value FROM (SELECT *, row_number() OVER (PARTITION BY "row", col
  ORDER BY n DESC, value) AS rn FROM (SELECT {COARSE}, value, count(*) AS n FROM grid GROUP BY ALL))
  WHERE rn=1),
ms AS (SELECT {COARSE}, round(avg(value),6) AS mean, round(sum(value),6) AS sum FROM grid GROUP BY ALL)
SELECT "row", col, mean, sum, round(value,6) AS mode FROM ms JOIN md USING ("row", col)""")
def _(spark, d):
    g = T.grid_values(spark, d)
    out = raster.resample(g, 5, "mode").withColumnRenamed("value", "mode")
    for how in ("mean", "sum"):
        out = out.join(raster.resample(g, 5, how).withColumnRenamed("value", how), ["row", "col"])
    return rounded(out)


TILES = """, til AS (SELECT CAST(l_orderkey AS BIGINT) AS cell, 'layer_'||l_linenumber AS layer,
 l_suppkey*100000+l_partkey AS ord, CASE WHEN l_returnflag<>'A' THEN l_quantity END AS value FROM lineitem)"""


def tiles(spark, d):
    return T.table(spark, d, "lineitem").select(
        F.floor(F.col("l_orderkey") / 100).alias("row"), (F.col("l_orderkey") % 100).alias("col"),
        F.col("l_orderkey").alias("cell"),
        F.concat(F.lit("layer_"), F.col("l_linenumber").cast("string")).alias("layer"),
        F.struct(F.col("l_suppkey") * 100000 + F.col("l_partkey"), "l_quantity").alias("ord"),
        F.when(F.col("l_returnflag") != "A", F.col("l_quantity")).alias("value"),
        F.year("l_shipdate").alias("year"),
    )


@query("ras_mosaic", """
SELECT l_orderkey//100 AS "row", l_orderkey%100 AS col, arg_max(l_quantity,
 (l_suppkey*100000+l_partkey, l_quantity)) AS value
FROM lineitem WHERE l_returnflag<>'A' GROUP BY l_orderkey""")
def _(spark, d):
    return raster.mosaic(tiles(spark, d), "ord")


@query("ras_filter_year", """
SELECT l_orderkey AS cell, count(*) AS n FROM lineitem WHERE year(l_shipdate)=1999 GROUP BY 1""")
def _(spark, d):
    return raster.of_year(tiles(spark, d), 1999).groupBy("cell").agg(F.count("*").alias("n"))


@query("ras_merge_tiles", """
SELECT 'layer_'||l_linenumber AS layer, l_orderkey AS cell, arg_max(l_quantity,
 (l_suppkey*100000+l_partkey, l_quantity)) AS value
FROM lineitem WHERE l_returnflag<>'A' GROUP BY ALL""")
def _(spark, d):
    return raster.merge_tiles(tiles(spark, d), "ord")


@query("ras_pop_growth", """
SELECT p_partkey, round(CASE WHEN p_size<10 THEN 0 ELSE pow(p_retailprice/p_size, 1/20e0)-1 END,9)
 AS pop_growth FROM part""")
def _(spark, d):
    first = F.when(F.col("p_size") < 10, 0).otherwise(F.col("p_size"))
    return T.table(spark, d, "part").select(
        "p_partkey",
        F.round(raster.population_growth(first, F.col("p_retailprice")), 9).alias("pop_growth"),
    )


@query("ras_forest_cover_year", """
SELECT p_partkey, CAST(y AS INT) AS year, CASE WHEN l>0 AND l<=y-2000 THEN 0e0 ELSE t END AS fc FROM
(SELECT p_partkey, p_retailprice/10 AS t, p_size%25 AS l FROM part), range(2000,2025) r(y)""")
def _(spark, d):
    from arborlift.operators.summary import unpivot_cover

    px = T.table(spark, d, "part").select(
        "p_partkey", (F.col("p_retailprice") / 10).alias("treecover2000"),
        (F.col("p_size") % 25).alias("lossyear"),
    )
    wide = raster.cover_columns(px).drop("treecover2000", "lossyear")
    return unpivot_cover(wide)


def _case(legend):
    return "CASE " + " ".join(
        f"WHEN code IN ({','.join(map(str, codes))}) THEN '{name}'" for name, codes in legend.items()
    ) + " END"


CODES = """, fine AS (SELECT "row", col, value, CAST((cell_code*10) AS INT) AS code FROM
 (SELECT "row", col, value, CAST(floor(value/20) AS INT)+CAST(code*3 AS INT) AS cell_code FROM grid))"""


def fine_codes(spark, d):
    code = (F.floor(F.col("value") / 20) + F.col("code") * 3).cast("int") * 10
    return T.grid_values(spark, d).select(
        "row", "col", code.alias("code"), (F.col("value") / 7.1 + 1).alias("area_ha")
    )


@query("ras_landcover_area", cte(PIX, GRID) + CODES + f"""
SELECT {COARSE}, """ + ", ".join(
    f"round(sum(CASE WHEN code IN ({','.join(map(str, codes))}) THEN value/7.1e0+1 ELSE 0 END),6)"
    f" AS lc_2015_{name}" for name, codes in raster.LAND_COVER.items()
) + " FROM fine GROUP BY 1, 2")
def _(spark, d):
    return rounded(raster.land_cover_areas(fine_codes(spark, d), 5))


@query("ras_landcover_remap", cte(PIX, GRID) + CODES + f"""
SELECT {_case(raster.LAND_COVER_ALTERNATIVE)} AS land_class, count(*) AS n FROM fine GROUP BY 1""")
def _(spark, d):
    named = raster.land_cover_class(F.col("code")).alias("land_class")
    return fine_codes(spark, d).groupBy(named).agg(F.count("*").alias("n"))


@query("ras_cropland_fraction", """
SELECT (l_orderkey//100)//5 AS "row", (l_orderkey%100)//5 AS col,
 round(avg(CASE WHEN l_returnflag='R' THEN 1e0 ELSE 0e0 END),9) AS cropland_2003
FROM lineitem WHERE year(l_shipdate)+4=2003 GROUP BY ALL""")
def _(spark, d):
    fine = T.table(spark, d, "lineitem").select(
        F.floor(F.col("l_orderkey") / 100).alias("row"), (F.col("l_orderkey") % 100).alias("col"),
        F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("value"),
        (F.year("l_shipdate") + 4).alias("year"),
    )
    return rounded(raster.cropland_share(fine, 5, 2003), 9)


@query("ras_zone_id", cte(POLYGONS) + """
SELECT "row"*43200+col AS cell, coalesce(arg_min(z, id_numeric), 0) AS zone
FROM (SELECT DISTINCT "row", col FROM covered) LEFT JOIN
  (SELECT "row", col, zone AS z, id_numeric FROM inside) USING ("row", col) GROUP BY "row", col""")
def _(spark, d):
    shapes = T.site_polygons(spark, d)
    pixels = extract.extent_cells(shapes, "id_numeric")
    return polygons.burned_attribute(pixels, shapes, "zone", "id_numeric", last_wins=False)


@query("ras_passthrough", cte(PIX, GRID) + """
SELECT "row", col, CAST(value AS FLOAT) AS elev FROM grid""")
def _(spark, d):
    return raster.passthrough(T.grid_values(spark, d), "value", "elev")


CATALOG_SQL = "WITH cat(covariate_name, category, resample) AS (VALUES " + ", ".join(
    f"('{n}','{c}','{r}')" for n, c, r, _, _ in raster.catalog_rows()
) + ")"


@query("ras_catalog", CATALOG_SQL + """
SELECT c.covariate_name, c.category, c.resample, count(e.event_id) AS n_events FROM cat c
LEFT JOIN events e ON c.covariate_name='fc_'||(2000+e.user_id) GROUP BY ALL""")
def _(spark, d):
    used = T.table(spark, d, "events").groupBy(
        F.concat(F.lit("fc_"), (F.col("user_id") + 2000).cast("string")).alias("covariate_name")
    ).agg(F.count("*").alias("n"))
    return raster.catalog(spark).join(used, "covariate_name", "left").select(
        "covariate_name", "category", "resample", F.coalesce("n", F.lit(0)).alias("n_events")
    )


@query("ras_select_catalog", CATALOG_SQL + """
SELECT covariate_name, resample, count(*) AS n FROM cat JOIN events
 ON covariate_name='fc_'||(2000+user_id) WHERE category='forest_cover' GROUP BY ALL""")
def _(spark, d):
    picked = raster.select_catalog(raster.catalog(spark), category="forest_cover")
    used = T.table(spark, d, "events").select(
        F.concat(F.lit("fc_"), (F.col("user_id") + 2000).cast("string")).alias("covariate_name")
    )
    return used.join(F.broadcast(picked), "covariate_name").groupBy(
        "covariate_name", "resample"
    ).agg(F.count("*").alias("n"))
