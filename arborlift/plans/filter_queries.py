"""Filters, projections, sorts, limits and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborlift.config import MatchConfig
from arborlift.operators import extract, matching, polygons, registry, summary
from arborlift.plans.aggregate_queries import panel, rounded, yearly
from arborlift.plans.catalogue import query
from arborlift.plans.oracle_views import (
    KEY, MATCHED, PANELED, PIX, POLYGONS, REGISTRY, RESULTS, SITES, cte,
)
from arborlift.sources import shared_tables as T
from arborlift.sources import vectors


@query("flt_site_area", cte(SITES) + "SELECT * FROM sites WHERE area_ha>=100")
def _(spark, d):
    return extract.large_sites(T.sites(spark, d), 100)


@query("prj_site_years", """
SELECT o_orderkey AS site_id, CAST(year(o_orderdate) AS INT) AS start_year,
 CAST(CASE WHEN o_orderstatus='F' THEN year(o_orderdate) ELSE 2099 END AS INT) AS end_year FROM orders""")
def _(spark, d):
    o = T.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("site_id"), F.col("o_orderdate").alias("start_date"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("end_date"),
    )
    return extract.with_site_years(o).select("site_id", "start_year", "end_year")


@query("prj_site_ids", """
SELECT c_name AS site_id, CAST(row_number() OVER (ORDER BY c_custkey) AS INT) AS id_numeric
FROM customer""")
def _(spark, d):
    c = T.table(spark, d, "customer").select(F.col("c_name").alias("site_id"), "c_custkey")
    return extract.with_site_ids(c, "c_custkey").select("site_id", "id_numeric")


@query("chk_geometry_type", """
SELECT page_id AS position, kind AS geometry_type FROM (SELECT page_id,
 CASE WHEN url LIKE 'https%' THEN 'Polygon' WHEN length(html)<6000 THEN 'LineString'
 ELSE 'MultiPolygon' END AS kind FROM pages) WHERE kind NOT IN ('Polygon','MultiPolygon')
ORDER BY page_id LIMIT 10""")
def _(spark, d):
    kind = F.when(F.col("url").startswith("https"), "Polygon").when(
        F.length("html") < 6000, "LineString").otherwise("MultiPolygon")
    features = T.table(spark, d, "pages").select(
        F.col("page_id").alias("position"), kind.alias("geometry_type")
    )
    return vectors.bad_geometry_types(features)


@query("flt_missing_strata", cte(PIX) + "SELECT cell FROM pix WHERE ecoregion IS NOT NULL")
def _(spark, d):
    return matching.drop_missing_strata(T.candidates(spark, d), T.EXACT).select("cell")


@query("flt_complete_cases", cte(PIX) + """
SELECT concat_ws('.',admin1,pa) AS "group", count(pop_2015) AS n_kept,
 count(*)-count(pop_2015) AS n_dropped FROM pix GROUP BY 1""")
def _(spark, d):
    cfg = MatchConfig(covariates=T.COVARIATES, exact_match_vars=("admin1", "pa"), fc_years=T.YEARS)
    px = T.candidates(spark, d).withColumns({
        "group": matching.exact_group(("admin1", "pa")), "uses_pre_defor": F.lit(False),
        "defor_pre_intervention": F.lit(None).cast("double"),
    })
    kept, _ = matching.design_features(px, cfg)
    n = px.groupBy("group").agg(F.count("*").alias("n"))
    return n.join(kept.groupBy("group").agg(F.count("*").alias("n_kept")), "group", "left").select(
        "group", "n_kept", (F.col("n") - F.col("n_kept")).alias("n_dropped")
    )


PRE = """, pre AS (SELECT p.cell, s.id_numeric, start_year,
 CASE start_year-5 WHEN 2000 THEN fc_2000 WHEN 2001 THEN fc_2001 WHEN 2002 THEN fc_2002
  WHEN 2003 THEN fc_2003 WHEN 2004 THEN fc_2004 WHEN 2005 THEN fc_2005 END AS i,
 CASE start_year WHEN 2005 THEN fc_2005 WHEN 2006 THEN fc_2006 WHEN 2007 THEN fc_2007
  WHEN 2008 THEN fc_2008 WHEN 2009 THEN fc_2009 WHEN 2010 THEN fc_2010 END AS f
 FROM pix p JOIN sites s ON s.id_numeric=near_site)"""


@query("flt_pre_cover_nonzero", cte(SITES, PIX) + PRE + """
SELECT cell FROM pre WHERE start_year<2005 OR i<>0""")
def _(spark, d):
    px = T.pixels(spark, d).withColumn("id_numeric", F.col("near_site"))
    return matching.with_pre_intervention(px, T.sites(spark, d)).select("cell")


@query("fn_pre_defor_pct", cte(SITES, PIX) + PRE + """
SELECT cell, round(CASE WHEN start_year>=2005 THEN (f-i)/i*100 END,6) AS defor_pre_intervention
FROM pre WHERE start_year<2005 OR i<>0""")
def _(spark, d):
    px = T.pixels(spark, d).withColumn("id_numeric", F.col("near_site"))
    out = matching.with_pre_intervention(px, T.sites(spark, d))
    return rounded(out.select("cell", "defor_pre_intervention"))


@query("flt_panel_years", cte(*PANELED) + """
SELECT site_id, min(year) AS first_year, max(year) AS last_year, count(*) AS n FROM pan GROUP BY 1""")
def _(spark, d):
    return panel(spark, d).groupBy("site_id").agg(
        F.min("year").alias("first_year"), F.max("year").alias("last_year"),
        F.count("*").alias("n"),
    )


@query("flt_clip_bbox", cte(POLYGONS) + """
SELECT DISTINCT "row", col FROM covered WHERE "row" BETWEEN floor((90-5.2e0-0.1e0)*120)
 AND floor((90-5e0+0.1e0)*120) AND col BETWEEN floor((10.5e0+180-0.1e0)*120)
 AND floor((11.5e0+180+0.1e0)*120)""")
def _(spark, d):
    cells = polygons.touched_cells(T.site_polygons(spark, d), "id_numeric")
    return extract.clip_to_box(cells, 10.5, 5.0, 11.5, 5.2).select("row", "col").distinct()


BOXES = """, box AS (SELECT id_numeric, min(least(x0,x1)) AS xmin, min(least(y0,y1)) AS ymin,
 max(greatest(x0,x1)) AS xmax, max(greatest(y0,y1)) AS ymax FROM edge GROUP BY 1),
hit AS (SELECT site_id AS name, xmin, ymin FROM box JOIN poly USING (id_numeric)
 WHERE xmin<=11.5e0 AND xmax>=10.5e0 AND ymin<=5.3e0 AND ymax>=5.1e0)"""


def boxes(spark, d):
    shapes = T.site_polygons(spark, d)
    names = shapes.select("id_numeric", F.col("site_id").alias("name"))
    return polygons.bounds(shapes, "id_numeric").join(names, "id_numeric")


@query("flt_bbox_overlap", cte(POLYGONS) + BOXES + """
SELECT name, round(xmin,6) AS xmin, round(ymin,6) AS ymin FROM hit""")
def _(spark, d):
    hit = polygons.overlapping_box(boxes(spark, d), 10.5, 5.1, 11.5, 5.3, limit=None)
    return rounded(hit.select("name", "xmin", "ymin"))


@query("limit_features", cte(POLYGONS) + BOXES + "SELECT name FROM hit ORDER BY name LIMIT 2000")
def _(spark, d):
    return polygons.overlapping_box(boxes(spark, d), 10.5, 5.1, 11.5, 5.3).select("name")


CATEGORY = """CASE WHEN p_size<5 THEN 'Ia' WHEN p_size<10 THEN 'Ib' WHEN p_size<15 THEN 'II'
 WHEN p_size<20 THEN 'III' WHEN p_size<25 THEN 'IV' WHEN p_size<40 THEN 'V' ELSE 'Not Reported' END"""


@query("flt_strict_protection", f"""
SELECT p_partkey AS site_id, {CATEGORY} AS iucn_cat FROM part WHERE p_size<25""")
def _(spark, d):
    size = F.col("p_size")
    category = (
        F.when(size < 5, "Ia").when(size < 10, "Ib").when(size < 15, "II").when(size < 20, "III")
        .when(size < 25, "IV").when(size < 40, "V").otherwise("Not Reported")
    )
    areas = T.table(spark, d, "part").select(
        F.col("p_partkey").alias("site_id"), category.alias("iucn_cat")
    )
    return polygons.strictly_protected(areas)


@query("flt_nonempty_geom", """
SELECT CAST(s_suppkey+1 AS INT) AS id_numeric FROM supplier WHERE s_acctbal>=1000""")
def _(spark, d):
    shapes = T.site_polygons(spark, d).join(
        T.table(spark, d, "supplier").select(
            (F.col("s_suppkey") + 1).cast("int").alias("id_numeric"), "s_acctbal"), "id_numeric"
    )
    some = shapes.withColumn(
        "geometry", F.when(F.col("s_acctbal") >= 1000, F.col("geometry"))
        .when(F.col("s_acctbal") >= 0, F.slice("geometry", 1, 0))
    )
    return polygons.nonempty(some).select("id_numeric")


@query("prj_rename_ci", """SELECT s_suppkey AS site_id, s_name AS name FROM supplier""")
def _(spark, d):
    out, _missing = vectors.select_renamed(
        T.table(spark, d, "supplier"), {"S_SUPPKEY": "site_id", "s_Name": "name", "iso3": "iso3"}
    )
    return out


@query("prj_downcast", """
SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS FLOAT) AS price FROM lineitem""")
def _(spark, d):
    return extract.downcast(T.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price")
    ))


@query("flt_task_status", cte(REGISTRY) + """
SELECT id, status FROM reg WHERE status IN ('pending_export','exporting')""")
def _(spark, d):
    active = T.registry(spark, d).filter(F.col("status").isin("pending_export", "exporting"))
    return active.select("id", "status")


NOW = "2024-01-20 00:00:00"
MERGING = """, mrg AS (SELECT event_id AS id, CASE event_type WHEN 'view' THEN 'merging'
 WHEN 'click' THEN 'pending_merge' ELSE 'merged' END AS status, ts AS started_at FROM events)
"""


def merge_feed(spark, d):
    status = F.when(F.col("event_type") == "view", "merging").when(
        F.col("event_type") == "click", "pending_merge").otherwise("merged")
    return T.table(spark, d, "events").select(
        F.col("event_id").alias("id"), status.alias("status"),
        F.col("ts").cast("timestamp").alias("started_at"),
    )


@query("flt_stale_merging", "WITH " + MERGING[2:] + f"""
SELECT id, status FROM mrg WHERE status<>'merged'
AND started_at < TIMESTAMP '{NOW}' - INTERVAL 15 MINUTE""")
def _(spark, d):
    return registry.stale_records(merge_feed(spark, d), F.lit(NOW).cast("timestamp")).select("id", "status")


STALE = f"status<>'merged' AND started_at < TIMESTAMP '{NOW}' - INTERVAL 15 MINUTE"
SHOWN = "yyyy-MM-dd HH:mm:ss"


@query("upd_stale_reset", "WITH " + MERGING[2:] + f"""
SELECT id, CASE WHEN {STALE} THEN 'failed' ELSE status END AS status,
 CASE WHEN {STALE} THEN '{registry.STALE_MESSAGE}' END AS error_message,
 CASE WHEN {STALE} THEN '{NOW}' END AS completed_at FROM mrg""")
def _(spark, d):
    out = registry.reset_stale(merge_feed(spark, d), F.lit(NOW).cast("timestamp"))
    return out.select("id", "status", "error_message", F.date_format("completed_at", SHOWN).alias("completed_at"))


@query("upd_stale_snapshots", "WITH " + MERGING[2:] + f""",
snap AS (SELECT l_orderkey*8+l_linenumber AS id, l_orderkey AS covariate_id, CASE l_returnflag
 WHEN 'N' THEN 'pending_merge' WHEN 'R' THEN 'merging' ELSE 'merged' END AS status FROM lineitem),
upd AS (SELECT *, status<>'merged' AND covariate_id IN (SELECT id FROM mrg WHERE {STALE}) AS hit FROM snap)
SELECT id, covariate_id, CASE WHEN hit THEN 'failed' ELSE status END AS status,
 CASE WHEN hit THEN '{registry.SNAPSHOT_MESSAGE}' END AS error_message,
 CASE WHEN hit THEN '{NOW}' END AS merge_completed_at FROM upd""")
def _(spark, d):
    status = F.when(F.col("l_returnflag") == "N", "pending_merge").when(
        F.col("l_returnflag") == "R", "merging").otherwise("merged")
    snapshots = T.table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"),
        F.col("l_orderkey").alias("covariate_id"), status.alias("status"),
    )
    out = registry.reset_snapshots(snapshots, merge_feed(spark, d), F.lit(NOW).cast("timestamp"))
    return out.withColumn("merge_completed_at", F.date_format("merge_completed_at", SHOWN))


@query("flt_ready_layers", cte(REGISTRY) + """
SELECT covariate_name FROM latest WHERE status='merged' AND coalesce(merged_url,'')<>''
 AND covariate_name NOT LIKE 'fc\\_%' ESCAPE '\\' UNION SELECT 'ecoregion' UNION SELECT 'pa'""")
def _(spark, d):
    return registry.ready_layers(T.registry(spark, d))


@query("flt_site_drilldown", cte(*RESULTS) + """
SELECT site_id, min(year) FILTER (is_pre_intervention) AS pre_from,
 max(year) FILTER (is_pre_intervention) AS pre_to,
 max(CASE WHEN end_year<2099 THEN end_year+1 END) AS post_from, count(*) AS n_years,
 sum(treatment_emissions_mgco2e)>0 OR sum(control_emissions_mgco2e)>0 AS has_emissions
FROM yearly JOIN sites USING (site_id) GROUP BY site_id""")
def _(spark, d):
    return summary.site_drilldown(yearly(spark, d), T.sites(spark, d))


@query("flt_subsampled_sites", cte(*PANELED) + """
SELECT DISTINCT id_numeric, site_id, site_name, sampled_fraction,
 sampled_fraction*100 AS sampled_percent FROM pan WHERE sampled_fraction<1""")
def _(spark, d):
    sampling = summary.sampling_by_site(panel(spark, d))
    return summary.subsampled_sites(sampling, T.sites(spark, d))


@query("top_recent_tasks", """
SELECT o_orderkey AS id, o_orderstatus AS status, c_name AS user_name FROM
 (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50)
 LEFT JOIN customer ON c_custkey=o_custkey""")
def _(spark, d):
    tasks = T.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    newest = registry.by_newest(tasks, "o_orderdate", "o_orderkey").limit(50)
    users = T.table(spark, d, "customer").select("c_custkey", "c_name")
    return newest.join(users, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"),
        F.col("c_name").alias("user_name"),
    )


@query("sort_site_year", cte(*RESULTS) + """
SELECT site_id, year, n_matched_pixels FROM yearly ORDER BY site_id, year""")
def _(spark, d):
    return yearly(spark, d).select("site_id", "year", "n_matched_pixels").orderBy("site_id", "year")


@query("sort_recent_sets", """
SELECT o_orderkey AS id, o_orderdate AS uploaded_at FROM orders ORDER BY o_orderdate DESC""")
def _(spark, d):
    sets = T.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("uploaded_at")
    )
    return registry.by_newest(sets, "uploaded_at", "id")


@query("sort_site_preview", cte(SITES) + "SELECT site_id, site_name FROM sites ORDER BY site_id")
def _(spark, d):
    return T.sites(spark, d).select("site_id", "site_name").orderBy("site_id")


@query("set_union_arms", cte(PIX) + """
, s AS (SELECT id_numeric, cell, row_number() OVER (PARTITION BY id_numeric
  ORDER BY md5('7:'||id_numeric||':'||cell), cell) AS rn FROM pix WHERE id_numeric IS NOT NULL)
SELECT cell, true AS treatment FROM s WHERE rn<=100
UNION ALL SELECT cell, false FROM pix WHERE id_numeric IS NULL""")
def _(spark, d):
    px = T.pixels(spark, d)
    treated = px.filter("id_numeric IS NOT NULL").select(
        "id_numeric", F.lit("all").alias("group"), "cell"
    )
    treated = matching.sample_treated(treated, 100, 7).select("cell", F.lit(True).alias("treatment"))
    controls = px.filter("id_numeric IS NULL").select("cell", F.lit(False).alias("treatment"))
    return treated.unionByName(controls)


@query("set_union_ragged", cte(*MATCHED) + """
SELECT site_id, cell, precip, CAST(NULL AS DOUBLE) AS elev FROM m WHERE treatment
UNION ALL SELECT site_id, cell, NULL, elev FROM m WHERE NOT treatment""")
def _(spark, d):
    m = T.matches(spark, d)
    a = m.filter("treatment").select("site_id", "cell", "precip")
    b = m.filter("NOT treatment").select("site_id", "cell", "elev")
    return a.unionByName(b, allowMissingColumns=True)


@query("set_candidates", cte(PIX) + """
SELECT cell FROM pix WHERE pa=1 UNION SELECT cell FROM pix WHERE id_numeric IS NOT NULL""")
def _(spark, d):
    px = T.candidates(spark, d)
    return extract.candidate_cells(px.filter("pa = 1"), T.treatment_key(spark, d))


@query("set_overlap_vars", cte(REGISTRY) + """
, w AS (SELECT DISTINCT 'layer_'||user_id AS name FROM events)
SELECT name, 'not ready' AS problem FROM (SELECT name FROM w EXCEPT SELECT covariate_name FROM latest
 WHERE status='merged' AND coalesce(merged_url,'')<>'' AND covariate_name NOT LIKE 'fc%')
UNION ALL SELECT name, 'used twice' FROM (SELECT name FROM w INTERSECT
 SELECT 'layer_'||s_nationkey FROM supplier)""")
def _(spark, d):
    wanted = T.table(spark, d, "events").select(
        F.concat(F.lit("layer_"), F.col("user_id").cast("string")).alias("name")
    ).distinct()
    ready = registry.ready_layers(T.registry(spark, d)).select(F.col("covariate_name").alias("name"))
    exact = T.table(spark, d, "supplier").select(
        F.concat(F.lit("layer_"), F.col("s_nationkey").cast("string")).alias("name")
    )
    return wanted.subtract(ready).withColumn("problem", F.lit("not ready")).union(
        wanted.intersect(exact).withColumn("problem", F.lit("used twice"))
    )


@query("set_distinct_ids", cte(PIX, KEY) + "SELECT DISTINCT id_numeric FROM tkey")
def _(spark, d):
    return T.treatment_key(spark, d).select("id_numeric").distinct()
