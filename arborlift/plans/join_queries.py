"""Joins: treatment, extents, polygons, names, registry bookkeeping."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborlift.functions import scalar
from arborlift.operators import extract, matching, pairing, polygons, registry, summary
from arborlift.plans.aggregate_queries import panel, rounded, totals
from arborlift.plans.catalogue import query
from arborlift.plans.oracle_views import (
    KEY, MANIFEST, MATCHED, PIX, POLYGONS, REGISTRY, RESULTS, SITES, cte,
)
from arborlift.sources import shared_tables as T


@query("join_treatment_flag", cte(PIX) + """
SELECT cell, id_numeric, id_numeric IS NOT NULL AS treatment FROM pix""")
def _(spark, d):
    px = T.candidates(spark, d).select("cell")
    return matching.flag_treatment(px, T.treatment_key(spark, d))


@query("join_exclude_treated", cte(PIX) + "SELECT cell, admin1 FROM pix WHERE id_numeric IS NULL")
def _(spark, d):
    px = T.candidates(spark, d).select("cell", "admin1")
    return matching.control_pixels(px, T.treatment_key(spark, d))


@query("join_control_candidates", cte(PIX) + """
, px AS (SELECT id_numeric, concat_ws('.',admin1,ecoregion,pa) AS g FROM pix
  WHERE ecoregion IS NOT NULL)
SELECT id_numeric, g AS "group", nt AS n_treated, nc AS n_controls FROM
 (SELECT id_numeric, g, count(*) AS nt FROM px WHERE id_numeric IS NOT NULL GROUP BY ALL)
 JOIN (SELECT g, count(*) AS nc FROM px WHERE id_numeric IS NULL GROUP BY g) USING (g)""")
def _(spark, d):
    return matching.strata(T.candidates(spark, d), T.treatment_key(spark, d), T.EXACT)


@query("join_shared_groups", cte(PIX) + """
, g AS (SELECT cell, near_site, elev, pa, id_numeric IS NOT NULL AS treatment FROM pix),
k AS (SELECT near_site, elev, pa FROM g GROUP BY ALL
  HAVING count(*) FILTER (treatment)>0 AND count(*) FILTER (NOT treatment)>0)
SELECT cell, g.near_site, treatment FROM g JOIN k
  ON g.near_site=k.near_site AND g.elev=k.elev AND g.pa=k.pa""")
def _(spark, d):
    px = T.pixels(spark, d).select(
        "cell", "near_site", "elev", "pa", F.col("id_numeric").isNotNull().alias("treatment")
    )
    kept = matching.keep_shared_groups(px, ("near_site", "elev", "pa"))
    return kept.select("cell", "near_site", "treatment")


@query("join_site_polygons", cte(POLYGONS) + """
SELECT "row"*43200+col AS cell, "row", col, max(id_numeric) AS id_numeric FROM inside
GROUP BY "row", col""")
def _(spark, d):
    return polygons.site_cells(T.site_polygons(spark, d))


@query("join_extent_polygon", cte(POLYGONS) + """
SELECT DISTINCT "row"*43200+col AS cell FROM covered""")
def _(spark, d):
    shapes = T.site_polygons(spark, d)
    key = polygons.site_cells(shapes)
    return extract.candidate_cells(extract.extent_cells(shapes, "id_numeric"), key)


@query("join_polygon_attribute", cte(POLYGONS) + """
SELECT "row"*43200+col AS cell, coalesce(arg_max(z, id_numeric), 0) AS zone
FROM (SELECT DISTINCT "row", col FROM covered) LEFT JOIN
  (SELECT "row", col, zone AS z, id_numeric FROM inside) USING ("row", col) GROUP BY "row", col""")
def _(spark, d):
    shapes = T.site_polygons(spark, d)
    return polygons.burned_attribute(extract.extent_cells(shapes, "id_numeric"), shapes, "zone", "id_numeric")


@query("join_match_extent", cte(PIX) + """
, t AS (SELECT near_site, ecoregion FROM pix WHERE id_numeric IS NOT NULL AND precip>285.4e0)
SELECT cell FROM pix WHERE near_site IN (SELECT near_site FROM t)
AND ecoregion IN (SELECT ecoregion FROM t WHERE ecoregion<>0)""")
def _(spark, d):
    px = T.pixels(spark, d).withColumn("admin2", F.col("near_site"))
    key = px.filter("id_numeric IS NOT NULL AND precip > 285.4").select("cell")
    return extract.within_matching_extent(px, key, ("admin2", "ecoregion")).select("cell")


@query("join_site_dates", cte(*MATCHED) + """
SELECT site_id, cell, start_year, end_year FROM m LEFT JOIN sites USING (site_id)""")
def _(spark, d):
    out = summary.with_site_dates(T.matches(spark, d), T.sites(spark, d))
    return out.select("site_id", "cell", "start_year", "end_year")


@query("join_sampling", cte(*RESULTS) + """
SELECT site_id, year, n_matched_pixels, sampled_fraction FROM yearly""")
def _(spark, d):
    p = panel(spark, d)
    counts = p.groupBy("site_id", "year").agg(F.count_if("treatment").alias("n_matched_pixels"))
    share = summary.sampling_by_site(p).select("site_id", "sampled_fraction")
    return counts.join(share, "site_id", "left")


@query("join_site_names", cte(*RESULTS) + """
SELECT site_id, n_years, site_name, area_ha FROM totals""")
def _(spark, d):
    return totals(spark, d).select("site_id", "n_years", "site_name", "area_ha")


@query("join_failed_names", cte(SITES) + """
SELECT CAST(c_custkey AS INT) AS id_numeric, CAST(NULL AS VARCHAR) AS site_id,
 coalesce(CASE WHEN c_acctbal>5000 THEN c_name END, site_name) AS site_name,
 coalesce(CASE WHEN c_nationkey<20 THEN c_mktsegment END, 'Unknown error') AS error,
 CAST(NULL AS VARCHAR) AS "timestamp", c_nationkey AS array_index,
 'failed_'||c_custkey||'.json' AS failure_marker_file
FROM customer LEFT JOIN sites ON id_numeric=c_custkey""")
def _(spark, d):
    markers = T.table(spark, d, "customer").select(
        F.col("c_custkey").cast("int").alias("id_numeric"),
        F.lit(None).cast("string").alias("site_id"),
        F.when(F.col("c_acctbal") > 5000, F.col("c_name")).alias("site_name"),
        F.when(F.col("c_nationkey") < 20, F.col("c_mktsegment")).alias("error"),
        F.lit(None).cast("string").alias("timestamp"),
        F.col("c_nationkey").alias("array_index"),
        F.concat(F.lit("failed_"), F.col("c_custkey").cast("string"), F.lit(".json"))
        .alias("failure_marker_file"),
    )
    return summary.failed_site_table(markers, T.sites(spark, d))


@query("join_site_id_map", cte(SITES, PIX, KEY) + """
SELECT cell, k.id_numeric, s.site_id FROM tkey k JOIN sites s ON k.id_numeric=s.id_numeric""")
def _(spark, d):
    names = T.sites(spark, d).select("id_numeric", "site_id")
    return T.treatment_key(spark, d).select("cell", "id_numeric").join(names, "id_numeric")


@query("join_set_counts", cte(*MATCHED) + """
SELECT site_id, cell, nt AS n_treated, nc AS n_controls FROM m WHERE NOT treatment""")
def _(spark, d):
    m = T.matches(spark, d)
    controls = m.filter("NOT treatment").select("site_id", "group", "match_group", "cell")
    return controls.join(pairing.set_counts(m), list(pairing.SET_KEY)).select(
        "site_id", "cell", "n_treated", "n_controls"
    )


SNAPSHOTS = """snap AS (SELECT CASE WHEN user_id<40 THEN 'fc_' ELSE 'layer_' END||user_id AS covariate_name,
 CASE WHEN value>3 THEN substr(md5(props),1,16) END AS tile_etag_hash,
 CASE event_type WHEN 'purchase' THEN 'merged' WHEN 'view' THEN 'skipped_existing' ELSE 'failed' END
 AS status, ts AS created_at FROM events),
last AS (SELECT covariate_name, arg_max(tile_etag_hash, (created_at, tile_etag_hash)) AS last_hash
 FROM snap WHERE status<>'failed' AND tile_etag_hash IS NOT NULL GROUP BY 1)"""


def snapshots(spark, d):
    status = F.when(F.col("event_type") == "purchase", "merged").when(
        F.col("event_type") == "view", "skipped_existing"
    ).otherwise("failed")
    return T.table(spark, d, "events").select(
        T.layer_name(F.col("user_id")).alias("covariate_name"),
        F.when(F.col("value") > 3, F.substring(F.md5("props"), 1, 16)).alias("tile_etag_hash"),
        status.alias("status"), F.col("ts").alias("created_at"),
    )


@query("join_latest_snapshot", cte(SNAPSHOTS) + "SELECT * FROM last")
def _(spark, d):
    return registry.latest_snapshot(snapshots(spark, d))


@query("join_changed_layers", cte(SNAPSHOTS, REGISTRY) + """
, cur AS (SELECT 'layer_'||c_custkey AS covariate_name,
  coalesce(CASE WHEN c_acctbal>0 THEN last_hash END, c_name) AS tile_etag_hash
  FROM customer LEFT JOIN last ON covariate_name='layer_'||c_custkey)
SELECT covariate_name, tile_etag_hash, last_hash FROM cur LEFT JOIN last USING (covariate_name)
WHERE tile_etag_hash IS DISTINCT FROM last_hash AND covariate_name NOT IN
 (SELECT covariate_name FROM latest WHERE status='pending_merge')""")
def _(spark, d):
    last = registry.latest_snapshot(snapshots(spark, d))
    current = T.table(spark, d, "customer").withColumn(
        "covariate_name", F.concat(F.lit("layer_"), F.col("c_custkey").cast("string"))
    ).join(last, "covariate_name", "left").select(
        "covariate_name",
        F.coalesce(F.when(F.col("c_acctbal") > 0, F.col("last_hash")), F.col("c_name"))
        .alias("tile_etag_hash"),
    )
    busy = registry.latest_record(T.registry(spark, d)).filter(
        F.col("status").isin(*registry.IN_PROGRESS)
    )
    return registry.changed_layers(current, last, busy)


@query("join_untracked_layers", cte(REGISTRY) + """
SELECT c_custkey AS key, 'layer_'||c_custkey AS covariate_name FROM customer
WHERE 'layer_'||c_custkey NOT IN (SELECT covariate_name FROM reg
  WHERE status IN ('pending_merge','merged'))""")
def _(spark, d):
    found = T.table(spark, d, "customer").select(
        F.col("c_custkey").alias("key"),
        F.concat(F.lit("layer_"), F.col("c_custkey").cast("string")).alias("covariate_name"),
    )
    known = T.registry(spark, d).filter(F.col("status").isin(*registry.TRACKED))
    return registry.untracked(found, known, "covariate_name").select("key", "covariate_name")


@query("join_untracked_runs", """
SELECT CAST(o_orderkey AS VARCHAR) AS run_id FROM orders WHERE CAST(o_orderkey AS VARCHAR) NOT IN (
 SELECT substr(j,5) FROM (SELECT CASE WHEN value>20 THEN 'api:' ELSE 'job:' END||event_id AS j
  FROM events) WHERE j LIKE 'api:%')""")
def _(spark, d):
    runs = T.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("run_id"))
    tasks = T.table(spark, d, "events").select(
        F.concat(F.when(F.col("value") > 20, "api:").otherwise("job:"),
                 F.col("event_id").cast("string")).alias("extract_job_id")
    )
    return registry.untracked_runs(runs, tasks)


@query("join_longest_prefix", """
WITH f AS (SELECT DISTINCT lower(p_type)||'_'||p_size||CASE WHEN p_retailprice<950 THEN '0000-01' ELSE '' END
  ||'.tif' AS file FROM part),
n AS (SELECT DISTINCT lower(p_type)||'_'||s AS name FROM part,
  (SELECT DISTINCT n_nationkey AS s FROM nation UNION ALL SELECT 4 UNION ALL SELECT 3))
SELECT file, arg_max(name, length(name)) AS name FROM f JOIN n ON starts_with(file, name) AND
 (file=name||'.tif' OR regexp_matches(substr(file,length(name)+1,1),'[0-9]')) GROUP BY file""")
def _(spark, d):
    part = T.table(spark, d, "part")
    kind = F.lower("p_type")
    files = part.select(F.concat(
        kind, F.lit("_"), F.col("p_size").cast("string"),
        F.when(F.col("p_retailprice") < 950, "0000-01").otherwise(""), F.lit(".tif"),
    ).alias("file")).distinct()
    numbers = T.table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("s"))
    kinds = part.select(kind.alias("kind")).distinct()
    names = kinds.withColumn("k", F.lit(1)).join(numbers.withColumn("k", F.lit(1)), "k").select(
        F.concat("kind", F.lit("_"), "s").alias("name")
    )
    return registry.longest_name(files, names)


@query("join_layer_inventory", cte(REGISTRY, MANIFEST) + """
, cat AS (SELECT 'layer_'||c_custkey AS covariate_name,
   CASE WHEN c_nationkey<12 THEN 'climate' ELSE c_mktsegment END AS category, c_custkey FROM customer),
til AS (SELECT 'layer_'||s_suppkey AS covariate_name, CAST(sum(s_nationkey+1) AS BIGINT) AS n FROM supplier GROUP BY 1),
sto AS (SELECT 'layer_'||p_partkey AS covariate_name, 'http://o/'||p_partkey AS url, p_size*1000000 AS size FROM part)
SELECT covariate_name, CASE category WHEN 'climate' THEN 'Climate' ELSE category END AS category,
 coalesce(n,0) AS gcs_tiles, url IS NOT NULL AS on_s3, coalesce(status,'') AS status,
 round(coalesce(CASE WHEN size_bytes<>0 THEN size_bytes END, size)/1048576e0,1) AS size_mb,
 coalesce(merged_url, url, '') AS merged_url,
 coalesce(strftime(started_at,'%Y-%m-%dT%H:%M:%SZ'),'') AS started_at
FROM cat LEFT JOIN til USING (covariate_name) LEFT JOIN sto USING (covariate_name)
LEFT JOIN latest USING (covariate_name)""")
def _(spark, d):
    def name(c):
        return F.concat(F.lit("layer_"), F.col(c).cast("string")).alias("covariate_name")

    catalog = T.table(spark, d, "customer").select(
        name("c_custkey"),
        F.when(F.col("c_nationkey") < 12, "climate").otherwise(F.col("c_mktsegment"))
        .alias("category"),
    )
    tiles = T.table(spark, d, "supplier").groupBy(name("s_suppkey")).agg(
        F.sum(F.col("s_nationkey") + 1).alias("n_tiles")
    )
    store = T.table(spark, d, "part").select(
        name("p_partkey"), F.concat(F.lit("http://o/"), F.col("p_partkey").cast("string"))
        .alias("url"), (F.col("p_size") * 1000000).cast("double").alias("size"),
    )
    latest = registry.latest_record(T.registry(spark, d))
    return registry.inventory(catalog, tiles, store, latest)


@query("join_task_owner", """
SELECT o_orderkey AS id, o_orderstatus AS status, c_name AS user_name
FROM orders LEFT JOIN customer ON c_custkey=o_custkey""")
def _(spark, d):
    users = T.table(spark, d, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("user_name")
    )
    return T.table(spark, d, "orders").join(users, "o_custkey", "left").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), "user_name"
    )


@query("join_totals_to_features", cte(*RESULTS) + """
SELECT s.site_id, round(coalesce(emissions_avoided_mgco2e,0),6) AS emissions_avoided_mgco2e,
 round(coalesce(forest_loss_avoided_ha,0),6) AS forest_loss_avoided_ha,
 coalesce(t.area_ha,0) AS total_area_ha FROM sites s LEFT JOIN totals t USING (site_id)""")
def _(spark, d):
    t = totals(spark, d).select(
        "site_id", "emissions_avoided_mgco2e", "forest_loss_avoided_ha",
        F.col("area_ha").alias("total_area_ha"),
    )
    joined = T.sites(spark, d).select("site_id").join(t, "site_id", "left")
    return rounded(scalar.zeroed(joined, t.columns[1:]))


@query("join_site_labels", cte(SITES) + """
SELECT site_id, coalesce(nullif(CASE WHEN area_ha<500 THEN site_id ELSE site_name END, site_id),
  CASE WHEN start_year<2007 THEN upper(site_name) END, site_id) AS label FROM sites""")
def _(spark, d):
    s = T.sites(spark, d)
    own = F.when(F.col("area_ha") < 500, F.col("site_id")).otherwise(F.col("site_name"))
    names = s.filter("start_year < 2007").select("site_id", F.upper("site_name").alias("total"))
    return s.withColumn("own", own).join(names, "site_id", "left").select(
        "site_id", scalar.site_label(F.col("site_id"), F.col("own"), F.col("total")).alias("label")
    )
