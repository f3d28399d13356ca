"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborlift.functions import grid, scalar
from arborlift.operators import extract, matching, polygons, registry, summary
from arborlift.plans.aggregate_queries import PROFILE_SQL, rounded, totals, yearly
from arborlift.plans.catalogue import query
from arborlift.plans.oracle_views import (
    PIX, POLYGONS, RESULTS, SITES, cte,
)
from arborlift.sources import shared_tables as T

POINTS = """, pt AS (SELECT c_custkey AS id, c_acctbal*0.0163e0 AS lon, c_acctbal*0.0079e0 AS lat
FROM customer)"""


def points(spark, d):
    c = T.table(spark, d, "customer")
    return c.select(
        F.col("c_custkey").alias("id"), (F.col("c_acctbal") * 0.0163).alias("lon"),
        (F.col("c_acctbal") * 0.0079).alias("lat"),
    )


@query("fn_pixel_area_ha", "WITH " + POINTS[2:] + """,
k AS (SELECT 6356752.3142e0 AS b, sqrt(1-pow(6356752.3142e0/6378137e0,2)) AS e),
a AS (SELECT id, b, e, sin(radians(lat+1/240e0)) AS s1, sin(radians(lat-1/240e0)) AS s0 FROM pt, k)
SELECT id, round(pi()*b*b*((atanh(e*s1)/e+s1/((1+e*s1)*(1-e*s1)))
 -(atanh(e*s0)/e+s0/((1+e*s0)*(1-e*s0))))/120e0/360e0/10000e0,4) AS area_ha FROM a""")
def _(spark, d):
    size = 1 / grid.CELLS_PER_DEGREE
    return points(spark, d).select(
        "id", F.round(grid.pixel_area_ha(F.col("lat"), size, size), 4).alias("area_ha")
    )


@query("fn_equal_area_ha", cte(POLYGONS) + """
, k AS (SELECT sqrt(1-pow(6356752.3142e0/6378137e0,2)) AS e),
p AS (SELECT id_numeric, ring, radians(x0)*6378137e0 AS x0, radians(x1)*6378137e0 AS x1,
 6378137e0/2*(1-e*e)*(sin(radians(y0))/(1-pow(e*sin(radians(y0)),2))+atanh(e*sin(radians(y0)))/e) AS y0,
 6378137e0/2*(1-e*e)*(sin(radians(y1))/(1-pow(e*sin(radians(y1)),2))+atanh(e*sin(radians(y1)))/e) AS y1
 FROM edge, k)
SELECT id_numeric, round(sum(CASE WHEN ring=0 THEN a ELSE -a END)/10000e0,2) AS area_ha FROM
(SELECT id_numeric, ring, abs(sum(x0*y1-x1*y0))/2 AS a FROM p GROUP BY ALL) GROUP BY 1""")
def _(spark, d):
    return rounded(polygons.equal_area_ha(T.site_polygons(spark, d), "id_numeric"), 2)


@query("fn_cell_of_point", "WITH " + POINTS[2:] + """
SELECT id, r AS "row", c AS col, r*43200+c AS cell, round(90-(r+0.5e0)/120,9) AS lat,
 round((c+0.5e0)/120-180,9) AS lon FROM (SELECT id, CAST(floor((90-lat)*120) AS BIGINT) AS r,
 CAST(floor((lon+180)*120) AS BIGINT) AS c FROM pt)""")
def _(spark, d):
    cells = points(spark, d).select(
        "id", grid.row_of(F.col("lat")).alias("row"), grid.col_of(F.col("lon")).alias("col")
    )
    cell = grid.cell_at(F.col("row"), F.col("col"))
    return cells.select(
        "id", "row", "col", cell.alias("cell"),
        F.round(grid.centre_lat(F.col("row")), 9).alias("lat"),
        F.round(grid.centre_lon(F.col("col")), 9).alias("lon"),
    )


@query("fn_snap_grid", "WITH " + POINTS[2:] + """
SELECT id, round(CASE WHEN abs(round(lon*120)/120-lon)<0.01e0 THEN round(lon*120)/120 END,9) AS snapped,
 abs(1/120e0-lat/1000)<1e-6 AS same FROM pt""")
def _(spark, d):
    return points(spark, d).select(
        "id", F.round(grid.snapped(F.col("lon")), 9).alias("snapped"),
        grid.same_resolution(F.lit(1 / 120), F.col("lat") / 1000).alias("same"),
    )


@query("fn_exact_group", cte(PIX) + """
SELECT cell, concat_ws('.',admin1,ecoregion,pa) AS "group" FROM pix WHERE ecoregion IS NOT NULL""")
def _(spark, d):
    px = matching.drop_missing_strata(T.candidates(spark, d), T.EXACT)
    return px.select("cell", matching.exact_group(T.EXACT).alias("group"))


@query("fn_cover_to_ha", cte(PIX) + """
SELECT cell, round(fc_2005/100e0*area_ha,6) AS forest_ha FROM pix""")
def _(spark, d):
    px = T.pixels(spark, d)
    return px.select(
        "cell", F.round(F.col("fc_2005") / 100 * F.col("area_ha"), 6).alias("forest_ha")
    )


@query("fn_unpivot_years", cte(PIX) + """
SELECT cell, CAST(substr(k,4) AS INT) AS year, round(fc,6) AS fc FROM
 (UNPIVOT (SELECT cell, COLUMNS('^fc_.*') FROM pix) ON COLUMNS('^fc_.*') INTO NAME k VALUE fc)""")
def _(spark, d):
    px = T.pixels(spark, d).select("cell", *[f"fc_{y}" for y in T.YEARS])
    return rounded(summary.unpivot_cover(px))


@query("fn_pre_flag", cte(*RESULTS) + "SELECT site_id, year, is_pre_intervention FROM yearly")
def _(spark, d):
    return yearly(spark, d).select("site_id", "year", "is_pre_intervention")


@query("fn_parse_iso_ts", """
SELECT event_id, strftime(try_cast(t AS TIMESTAMP),'%Y-%m-%d %H:%M:%S') AS parsed FROM (
SELECT event_id, CASE WHEN event_type='error' THEN 'n/a' WHEN event_type='view' THEN ''
 ELSE strftime(ts,'%Y-%m-%dT%H:%M:%S') END AS t FROM events)""")
def _(spark, d):
    text = F.when(F.col("event_type") == "error", "n/a").when(
        F.col("event_type") == "view", "").otherwise(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    feed = T.table(spark, d, "events").select("event_id", text.alias("t"))
    return feed.select(
        "event_id",
        F.date_format(scalar.iso_timestamp(F.col("t")), "yyyy-MM-dd HH:mm:ss").alias("parsed"),
    )


@query("fn_format_dates", cte(*RESULTS) + """
SELECT site_id, coalesce(CASE WHEN end_year<2099 THEN end_year||'-06-30' END,'Ongoing') AS end_shown,
 CASE WHEN first_year IS NULL THEN '-' ELSE first_year||'-'||last_year END AS period
FROM sites LEFT JOIN totals USING (site_id)""")
def _(spark, d):
    s = T.sites(spark, d).select("site_id", F.when(
        F.col("end_year") < 2099, F.make_date(F.col("end_year"), F.lit(6), F.lit(30))
    ).alias("end_date"))
    t = totals(spark, d).select("site_id", "first_year", "last_year")
    return s.join(t, "site_id", "left").select(
        "site_id", scalar.shown_date(F.col("end_date"), "Ongoing").alias("end_shown"),
        scalar.period(F.col("first_year"), F.col("last_year")).alias("period"),
    )


@query("fn_state_map", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'running'
 ELSE 'submitted' END AS status FROM orders""")
def _(spark, d):
    remote = F.when(F.col("o_orderstatus") == "F", "finished").when(
        F.col("o_orderstatus") == "O", "READY").otherwise("PENDING")
    return T.table(spark, d, "orders").select(
        "o_orderkey", scalar.mapped_state(remote, scalar.RUN_STATES, "submitted").alias("status")
    )


@query("fn_strip_prefix", """
SELECT page_id, CASE WHEN url LIKE 'http:%' THEN substr(url,6) ELSE url END AS stripped,
 regexp_extract(url,'^[a-z0-9]+://([^/]+)',1) AS bucket,
 regexp_extract(url,'^[a-z0-9]+://[^/]+/(.*)$',1) AS key,
 regexp_replace(split_part(url||'.tif','/',-1),'[.]tif$','') AS layer FROM pages""")
def _(spark, d):
    url = F.col("url")
    return T.table(spark, d, "pages").select(
        "page_id", scalar.without_prefix(url, "http:").alias("stripped"),
        scalar.bucket_of(url).alias("bucket"), scalar.key_of(url).alias("key"),
        scalar.layer_of_object(F.concat(url, F.lit(".tif"))).alias("layer"),
    )


@query("fn_null_to_zero", cte(PIX) + """
SELECT cell, coalesce(pop_2015,0) AS pop_2015 FROM pix""")
def _(spark, d):
    return scalar.zeroed(T.pixels(spark, d).select("cell", "pop_2015"), ["pop_2015"])


@query("fn_size_mb", """
SELECT o_orderkey, round(o_totalprice*1000/1048576e0,1) AS size_mb FROM orders""")
def _(spark, d):
    return T.table(spark, d, "orders").select(
        "o_orderkey", registry.size_mb(F.col("o_totalprice") * 1000).alias("size_mb")
    )


@query("fn_normalize_list", """
SELECT event_id, CASE WHEN event_type='error' THEN 0 WHEN event_type IN ('view','click') THEN 2
 ELSE 1 END AS n, CASE WHEN event_type<>'error' THEN CAST(json_extract(props,'$.k') AS INT) END AS k
FROM events""")
def _(spark, d):
    p = F.col("props")
    shape = (
        F.when(F.col("event_type") == "view", F.concat(F.lit("["), p, F.lit(","), p, F.lit("]")))
        .when(F.col("event_type") == "click",
              F.concat(F.lit('{"1": '), p, F.lit(', "2": '), p, F.lit("}")))
        .when(F.col("event_type") == "error", F.lit('"text"')).otherwise(p)
    )
    rows = T.table(spark, d, "events").select(
        "event_id", scalar.normalised_list(shape, "struct<k:int>").alias("l")
    )
    return rows.select(
        "event_id", F.size("l").alias("n"), F.try_element_at("l", F.lit(1))["k"].alias("k")
    )


@query("fn_skew_flag", PROFILE_SQL + """
SELECT layer, CASE WHEN mean>median*2 THEN 'right-skewed' WHEN mean<median*0.5e0
 THEN 'left-skewed' ELSE 'balanced' END AS skew, round(q[2],6) AS min_value,
 round(q[10],6) AS max_value FROM prof""")
def _(spark, d):
    p = registry.layer_profile(T.layer_values(spark, d), nodata=-9999.0)
    return rounded(p.select(
        "layer", scalar.skew_flag(F.col("mean"), F.col("median")).alias("skew"),
        F.col("p2").alias("min_value"), F.col("p98").alias("max_value"),
    ))


@query("fn_series_representative", """
SELECT event_id, CASE WHEN regexp_matches(n,'^fc_\\d{4}$') AND n<>'fc_2020' THEN 'fc_2020'
 WHEN regexp_matches(n,'^pop_\\d{4}$') AND n<>'pop_2020' THEN 'pop_2020' END AS copied_from FROM
(SELECT event_id, CASE WHEN event_type='view' THEN 'pop_' ELSE 'fc_' END||(1990+user_id) AS n FROM events)""")
def _(spark, d):
    name = F.concat(
        F.when(F.col("event_type") == "view", "pop_").otherwise("fc_"),
        (F.col("user_id") + 1990).cast("string"),
    )
    return T.table(spark, d, "events").select(
        "event_id", scalar.series_representative(name).alias("copied_from")
    )


@query("fn_formula", """
SELECT s_suppkey, 'treatment ~ factor(ecoregion) + '||s_name AS formula FROM supplier""")
def _(spark, d):
    text = extract.formula(["ecoregion", "NAME"])["formula_str"]
    return T.table(spark, d, "supplier").select(
        "s_suppkey", F.replace(F.lit(text), F.lit("NAME"), F.col("s_name")).alias("formula")
    )


@query("fn_formula_terms", """
SELECT p_partkey, i, trim(string_split(p_brand||' + '||p_type||'+ elev','+')[i]) AS term
FROM part, (SELECT CAST(unnest(range(1,4)) AS INT) AS i)""")
def _(spark, d):
    text = F.concat(F.lit("treatment ~ "), "p_brand", F.lit(" + "), "p_type", F.lit("+ elev"))
    return T.table(spark, d, "part").select(
        "p_partkey", F.posexplode(scalar.formula_terms(text)).alias("i", "term")
    ).withColumn("i", F.col("i") + 1)


@query("fn_diag_key", cte(SITES) + """
SELECT id_numeric, CASE WHEN area_ha>500 THEN site_id ELSE CAST(id_numeric AS VARCHAR) END AS key
FROM sites""")
def _(spark, d):
    s = T.sites(spark, d)
    known = F.when(F.col("area_ha") > 500, F.col("site_id")).otherwise("")
    return s.select("id_numeric", scalar.diagnostic_key(known, F.col("id_numeric")).alias("key"))
