"""Sources and sinks: written by Spark from the tables, read back and checked."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborlift.operators import extract, registry, summary
from arborlift.plans.aggregate_queries import BALANCE_SQL, balance, panel, rounded, totals, yearly
from arborlift.plans.catalogue import query
from arborlift.plans.oracle_views import (
    KEY, MANIFEST, MATCHED, PIX, POLYGONS, RESULTS, SITES, cte,
)
from arborlift.schema import BY_SITE_TOTAL
from arborlift.sources import shared_tables as T, tables, vectors

ROUND_YEAR = """SELECT site_id, year, round(forest_loss_avoided_ha,6) AS forest_loss_avoided_ha,
 round(emissions_avoided_mgco2e,6) AS emissions_avoided_mgco2e, n_matched_pixels,
 is_pre_intervention FROM yearly"""
YEAR_COLUMNS = ("site_id", "year", "forest_loss_avoided_ha", "emissions_avoided_mgco2e",
                "n_matched_pixels", "is_pre_intervention")


def dated_sites(spark, d):
    s = T.sites(spark, d).join(T.site_polygons(spark, d).drop("site_id", "zone"), "id_numeric")
    day = F.make_date(F.col("start_year"), F.lit(3), F.lit(1))
    end = F.when(F.col("end_year") < 2099, F.make_date(F.col("end_year"), F.lit(6), F.lit(30)))
    return s.withColumns({"start_date": day, "end_date": end})


@query("src_sites_geojson", cte(SITES, POLYGONS) + """
SELECT s.id_numeric, s.site_id, s.site_name, start_year, end_year FROM sites s
WHERE s.id_numeric IN (SELECT id_numeric FROM edge)""")
def _(spark, d):
    path = tables.work_path(spark, "sites-geojson")
    tables.feature_lines(dated_sites(spark, d), "id_numeric").write.text(path)
    sites = vectors.read_sites(spark, path, 0, lines=True)
    return sites.select("id_numeric", "site_id", "site_name", "start_year", "end_year")


def long_layers(spark, d):
    px = T.pixels(spark, d)
    names = ("precip", "elev", "pop_2015", "fc_2005")
    return px.select("cell", F.inline(F.array(*[
        F.struct(F.lit(n).alias("layer"), F.col(n).alias("value")) for n in names
    ])))


@query("src_pixel_layers", cte(PIX) + "SELECT cell, precip, pop_2015, fc_2005 FROM pix")
def _(spark, d):
    path = tables.work_path(spark, "layers")
    tables.write_parquet(long_layers(spark, d), path, partition_by="layer")
    return extract.pivot_layers(spark.read.parquet(path), ["precip", "pop_2015", "fc_2005"])


@query("src_parquet_steps", cte(PIX, KEY) + """
SELECT site_id, count(*) AS n, round(sum(area_ha),6) AS area_ha FROM tkey GROUP BY 1""")
def _(spark, d):
    path = tables.work_path(spark, "key")
    tables.write_parquet(T.treatment_key(spark, d), path)
    return spark.read.parquet(path).groupBy("site_id").agg(
        F.count("*").alias("n"), F.round(F.sum("area_ha"), 6).alias("area_ha")
    )


@query("src_match_files", cte(*MATCHED) + """
SELECT id_numeric, site_id, count(*) AS n, count(*) FILTER (treatment) AS n_treated
FROM m GROUP BY ALL""")
def _(spark, d):
    path = tables.work_path(spark, "matches")
    tables.write_matches(T.matches(spark, d), path)
    return tables.read_matches(spark, path).groupBy("id_numeric", "site_id").agg(
        F.count("*").alias("n"), F.count_if("treatment").alias("n_treated")
    )


@query("src_failure_markers", cte(SITES) + """
SELECT id_numeric, site_id, 'No treatment cells found for site' AS error, true AS has_file
FROM sites WHERE area_ha<300""")
def _(spark, d):
    path = tables.work_path(spark, "failed")
    T.sites(spark, d).filter("area_ha < 300").select(
        "id_numeric", "site_id", "site_name", F.col("site_id").alias("marker"),
        F.lit("No treatment cells found for site").alias("error"),
    ).write.partitionBy("marker").json(path)
    markers = tables.read_failures(spark, path)
    return markers.select(
        "id_numeric", "site_id", "error",
        F.col("failure_marker_file").endswith(".json").alias("has_file"),
    )


@query("src_csv_chunked", cte(*MATCHED) + """
SELECT site_id, count(*) FILTER (treatment) AS n_treated, round(sum(pscore),6) AS sum_pscore
FROM m GROUP BY 1""")
def _(spark, d):
    path = tables.work_path(spark, "scores-csv")
    columns = ("cell", "site_id", "treatment", "match_group", "match_weight", "pscore")
    tables.write_csv(T.matches(spark, d).select(*columns), path)
    schema = ("cell bigint, site_id string, treatment boolean, match_group string, "
              "match_weight double, pscore double")
    read = tables.read_csv(spark, path, schema, ("site_id", "treatment", "pscore"))
    return read.groupBy("site_id").agg(
        F.count_if("treatment").alias("n_treated"), F.round(F.sum("pscore"), 6).alias("sum_pscore")
    )


def site_payloads(spark, d):
    """One payload document per site, its own few years inside."""
    y, t = yearly(spark, d), totals(spark, d)
    series = tables.time_series_entries(y).groupBy("site_id").agg(
        F.array_join(F.sort_array(F.collect_list("entry")), ",").alias("s")
    )
    return series.join(tables.record_entries(t), "site_id", "left").select(
        F.col("site_id").alias("task_id"),
        F.concat(F.lit('{"name":"x","records":['), F.coalesce("entry", F.lit("")),
                 F.lit('],"time_series":['), "s", F.lit("]}")).alias("payload"),
    )


@query("src_result_payload", cte(*RESULTS) + ROUND_YEAR)
def _(spark, d):
    path = tables.work_path(spark, "results")
    rows, _totals = tables.parse_payloads(site_payloads(spark, d))
    tables.replace_task(rows, path)
    return rounded(spark.read.parquet(path).select(*YEAR_COLUMNS))


@query("src_object_manifest", cte(MANIFEST) + """
SELECT name, etag, size_bytes, updated FROM mani WHERE name LIKE '%.tif'
UNION ALL SELECT url, md5(html), CAST(length(html) AS BIGINT), CAST(page_id AS VARCHAR)
FROM pages WHERE url LIKE '%.tif'""")
def _(spark, d):
    tiles = T.manifest(spark, d).drop("covariate_name")
    other = T.table(spark, d, "pages").select(
        F.col("url").alias("name"), F.md5("html").alias("etag"),
        F.length("html").cast("bigint").alias("size_bytes"),
        F.col("page_id").cast("string").alias("updated"),
    )
    return registry.tif_objects(tiles.unionByName(other))


@query("src_vector_reference", cte(SITES, POLYGONS) + """
SELECT site_id, xmin, ymin FROM (SELECT id_numeric, round(min(least(x0,x1)),5) AS xmin,
 round(min(least(y0,y1)),5) AS ymin FROM edge GROUP BY 1) JOIN poly USING (id_numeric)""")
def _(spark, d):
    path = tables.work_path(spark, "reference-geojson")
    tables.feature_lines(dated_sites(spark, d), "id_numeric").write.text(path)
    fields = {"site_id": "string", "area_ha": "double"}
    features = vectors.read_features(spark, path, fields, lines=True)
    out = vectors.import_reference(features, {"SITE_ID": "site_id"})
    return rounded(out.select("site_id", "xmin", "ymin"), 5)


@query("sink_parquet", cte(PIX) + "SELECT cell, precip, admin1 FROM pix")
def _(spark, d):
    path = tables.work_path(spark, "pixels")
    tables.write_pixels(T.candidates(spark, d), path)
    return spark.read.parquet(path).select("cell", "precip", "admin1")


@query("sink_csv", BALANCE_SQL + """
SELECT site_id, covariate, round(smd,6) AS smd FROM smd""")
def _(spark, d):
    path = tables.work_path(spark, "balance-csv")
    tables.write_csv(balance(spark, d), path)
    schema = ("site_id string, covariate string, mean_treatment double, mean_control double, "
              "pooled_sd double, smd double")
    return rounded(tables.read_csv(spark, path, schema, ("site_id", "covariate", "smd")))


@query("sink_empty_schema", cte(*RESULTS) + """
SELECT site_id, emissions_avoided_mgco2e, n_years FROM totals WHERE n_years>1000""")
def _(spark, d):
    path = tables.work_path(spark, "empty")
    none = totals(spark, d).filter("n_years > 1000")
    tables.write_parquet(none.unionByName(tables.empty(spark, BY_SITE_TOTAL)), path)
    return spark.read.parquet(path).select("site_id", "emissions_avoided_mgco2e", "n_years")


def written(spark, lines, name):
    path = tables.work_path(spark, name)
    tables.write_document(lines, path)
    return path


def summary_lines(spark, d):
    p = panel(spark, d)
    s, y, t = T.sites(spark, d), yearly(spark, d), totals(spark, d)
    failed = s.join(t, "site_id", "left_anti").withColumn("error", F.lit("No matches found"))
    run = summary.run_totals(t, y, failed)
    sub = summary.subsampled_sites(summary.sampling_by_site(p), s)
    return tables.run_summary_document(run, t, failed, sub, "run", 1)


@query("sink_summary_json", cte(*RESULTS) + """
, done AS (SELECT site_id, site_name, emissions_avoided_mgco2e AS e, forest_loss_avoided_ha AS f, area_ha AS a, n_years FROM totals),
lost AS (SELECT site_id, site_name FROM sites WHERE site_id NOT IN (SELECT site_id FROM totals))
SELECT 'run' AS section, CAST(NULL AS VARCHAR) AS site_id, CAST(NULL AS VARCHAR) AS site_name, round(sum(e),4) AS emissions_avoided_mgco2e,
 round(sum(f),4) AS forest_loss_avoided_ha, round(sum(a),4) AS area_ha, count(*) AS n_sites, (SELECT count(*) FROM lost) AS n_failed,
 CAST(NULL AS BIGINT) AS n_years, CAST(NULL AS DOUBLE) AS sampled_fraction, CAST(NULL AS VARCHAR) AS error FROM done
UNION ALL SELECT 'site', site_id, site_name, round(e,4), round(f,4), round(a,4), NULL, NULL, n_years, NULL, NULL FROM done
UNION ALL SELECT 'failed', site_id, site_name, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'No matches found' FROM lost
UNION ALL SELECT DISTINCT 'subsampled', site_id, site_name, NULL, NULL, NULL, NULL, NULL, NULL, sampled_fraction, NULL
 FROM pan WHERE sampled_fraction<1""")
def _(spark, d):
    path = written(spark, summary_lines(spark, d), "summary-json")
    members = tables.document_members(spark, path, (
        "site_id string, site_name string, emissions_avoided_mgco2e double, forest_loss_avoided_ha double, "
        "area_ha double, n_years bigint, sampled_fraction double, error string"
    ))
    section = F.when(F.col("error").isNotNull(), "failed").when(
        F.col("n_years").isNotNull(), "site").otherwise("subsampled")
    head = tables.document_head(spark, path, (
        "n_sites bigint, n_failed_sites bigint, total_emissions_avoided_mgco2e double, "
        "total_forest_loss_avoided_ha double, total_area_ha double"
    )).select(
        F.lit("run").alias("section"), "n_sites", F.col("n_failed_sites").alias("n_failed"),
        F.col("total_emissions_avoided_mgco2e").alias("emissions_avoided_mgco2e"),
        F.col("total_forest_loss_avoided_ha").alias("forest_loss_avoided_ha"), F.col("total_area_ha").alias("area_ha"),
    )
    rows = members.withColumn("section", section).unionByName(head, allowMissingColumns=True)
    return rounded(rows, 4)


@query("sink_analysis_payload", cte(*RESULTS) + """
SELECT 'record' AS kind, site_id, site_name, CAST(NULL AS INT) AS year, first_year, last_year,
 round(forest_loss_avoided_ha,6) AS forest_loss_avoided_ha, round(emissions_avoided_mgco2e,6) AS emissions_avoided_mgco2e,
 n_matched_pixels, n_years, CAST(NULL AS BOOLEAN) AS is_pre_intervention FROM totals
UNION ALL SELECT 'series', site_id, site_name, year, NULL, NULL, round(forest_loss_avoided_ha,6),
 round(emissions_avoided_mgco2e,6), n_matched_pixels, NULL, is_pre_intervention FROM yearly""")
def _(spark, d):
    path = written(spark, tables.analysis_payload(yearly(spark, d), totals(spark, d), "{}"), "payload-json")
    members = tables.document_members(spark, path, (
        "entity_id string, entity_name string, year int, period_start int, period_end int, values map<string,double>, "
        "metadata struct<n_matched_pixels:bigint,n_years:bigint,is_pre_intervention:boolean>"
    ))
    return rounded(members.select(
        F.when(F.col("year").isNull(), "record").otherwise("series").alias("kind"),
        F.col("entity_id").alias("site_id"), F.col("entity_name").alias("site_name"), "year",
        F.col("period_start").alias("first_year"), F.col("period_end").alias("last_year"),
        *[F.col("values")[v].alias(v) for v in ("forest_loss_avoided_ha", "emissions_avoided_mgco2e")], "metadata.*",
    ))


@query("sink_feature_collection", cte(SITES, POLYGONS) + """
SELECT site_id, site_name, start_year||'-03-01' AS start_date, CASE WHEN end_year<2099 THEN end_year||'-06-30' END AS end_date,
 area_ha, xmin, ymin FROM sites JOIN (SELECT id_numeric, round(min(least(x0,x1)),5) AS xmin,
 round(min(least(y0,y1)),5) AS ymin FROM edge GROUP BY 1) USING (id_numeric)""")
def _(spark, d):
    path = written(spark, tables.feature_collection(dated_sites(spark, d)), "features-json")
    features = tables.document_members(spark, path, (
        "geometry struct<coordinates:array<array<array<array<double>>>>>, "
        "properties struct<site_id:string,site_name:string,start_date:string,end_date:string,area_ha:double>"
    ))
    corners = F.flatten(F.flatten("geometry.coordinates"))
    return rounded(features.select(
        "properties.*", F.array_min(F.transform(corners, lambda p: p[0])).alias("xmin"),
        F.array_min(F.transform(corners, lambda p: p[1])).alias("ymin"),
    ), 5)


@query("sink_value_key", """
SELECT DISTINCT p_size AS eco_id, p_brand AS eco_name, p_type AS realm FROM part""")
def _(spark, d):
    part = T.table(spark, d, "part").select(
        F.col("p_size").alias("eco_id"), F.col("p_brand").alias("eco_name"),
        F.col("p_type").alias("realm"), "p_name",
    )
    return tables.value_key(part, ("eco_id", "eco_name", "realm"))
