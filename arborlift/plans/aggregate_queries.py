"""Aggregations: panel sums, balance, histograms, quantiles, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from arborlift.operators import quality, registry, summary
from arborlift.plans.catalogue import query
from arborlift.plans.oracle_views import (
    KEY, LAYERS, MANIFEST, MATCHED, PANELED, PIX, REGISTRY, RESULTS, SITES, cte,
)
from arborlift.sources import shared_tables as T


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[
        F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes
    ])


def panel(spark, d):
    return summary.pixel_panel(T.matches(spark, d), T.sites(spark, d))


def yearly(spark, d):
    return summary.site_year(panel(spark, d), T.sites(spark, d))


def totals(spark, d):
    return summary.site_total(yearly(spark, d), T.sites(spark, d))


def balance(spark, d):
    return quality.balance(T.matches(spark, d), T.COVARIATES)


YEARLY_COLUMNS = """site_id, year, round(treatment_defor_ha,6) AS treatment_defor_ha,
 round(control_defor_ha,6) AS control_defor_ha,
 round(forest_loss_avoided_ha,6) AS forest_loss_avoided_ha,
 round(treatment_emissions_mgco2e,6) AS treatment_emissions_mgco2e,
 round(control_emissions_mgco2e,6) AS control_emissions_mgco2e,
 round(emissions_avoided_mgco2e,6) AS emissions_avoided_mgco2e"""

BALANCE_SQL = cte(*MATCHED).rstrip() + """,
cv AS (SELECT site_id, treatment, match_weight w, cov, v FROM
  (UNPIVOT (SELECT site_id, treatment, match_weight, precip, elev, pop_2015, dist_cities FROM m)
   ON precip, elev, pop_2015, dist_cities INTO NAME cov VALUE v)),
sc AS (SELECT * FROM cv UNION ALL SELECT '__all__', treatment, w, cov, v FROM cv),
mu AS (SELECT *, sum(w*v) OVER p/sum(w) OVER p AS mean, count(*) OVER p AS n FROM sc
  WINDOW p AS (PARTITION BY site_id, cov, treatment)),
arm AS (SELECT site_id, cov, treatment, max(n) AS n, max(mean) AS mean,
  CASE WHEN min(v)=max(v) THEN 0 ELSE sum(w*(v-mean)*(v-mean))/sum(w) END AS var
  FROM mu GROUP BY ALL),
smd AS (SELECT site_id, cov AS covariate, CASE WHEN ok THEN mt END AS mean_treatment,
  CASE WHEN ok THEN mc END AS mean_control, CASE WHEN ok THEN sd END AS pooled_sd,
  CASE WHEN ok THEN CASE WHEN sd>0 THEN (mt-mc)/sd ELSE 0 END END AS smd
 FROM (SELECT site_id, cov, max(mean) FILTER (treatment) AS mt,
   max(mean) FILTER (NOT treatment) AS mc,
   sqrt((max(var) FILTER (treatment)+max(var) FILTER (NOT treatment))/2) AS sd,
   coalesce(max(n) FILTER (treatment)>=2 AND max(n) FILTER (NOT treatment)>=2, false) AS ok
  FROM arm GROUP BY site_id, cov))
"""


@query("agg_group_counts", cte(PIX) + """
SELECT id_numeric IS NOT NULL AS treatment, concat_ws('.',admin1,ecoregion,pa) AS "group",
  count(*) AS n FROM pix WHERE ecoregion IS NOT NULL GROUP BY ALL""")
def _(spark, d):
    px = T.pixels(spark, d).filter("ecoregion IS NOT NULL")
    return px.groupBy(
        F.col("id_numeric").isNotNull().alias("treatment"),
        F.concat_ws(".", *T.EXACT).alias("group"),
    ).agg(F.count("*").alias("n"))


@query("agg_set_counts", cte(*MATCHED) + """
SELECT site_id, grp AS "group", match_group, count(*) FILTER (treatment) AS n_treated,
  count(*) FILTER (NOT treatment) AS n_controls FROM m GROUP BY ALL""")
def _(spark, d):
    from arborlift.operators.pairing import set_counts
    return set_counts(T.matches(spark, d))


@query("agg_control_pool", cte(SITES, PIX) + """
, px AS (SELECT *, concat_ws('.',admin1,ecoregion,pa) AS g FROM pix WHERE ecoregion IS NOT NULL),
sg AS (SELECT DISTINCT id_numeric, g FROM px WHERE id_numeric IS NOT NULL)
SELECT sg.id_numeric, CAST(sum(n) AS BIGINT) AS n_control_pool
FROM sg JOIN (SELECT g, count(*) AS n FROM px WHERE id_numeric IS NULL GROUP BY g) c USING (g)
GROUP BY sg.id_numeric""")
def _(spark, d):
    from arborlift.operators import matching
    strata = matching.strata(T.candidates(spark, d), T.treatment_key(spark, d), T.EXACT)
    return matching.control_pool(strata)


@query("agg_sampled_fraction", cte(SITES, PIX) + """
SELECT k.id_numeric, f/CAST(n AS DOUBLE) AS sampled_fraction
FROM (SELECT id_numeric, count(*) AS n,
  count(*) FILTER (ecoregion IS NOT NULL AND fc_2000<>0) AS f
  FROM pix WHERE id_numeric IS NOT NULL GROUP BY 1) k""")
def _(spark, d):
    from arborlift.operators import matching
    kept = T.pixels(spark, d).filter("id_numeric IS NOT NULL AND ecoregion IS NOT NULL")
    kept = kept.filter("fc_2000 <> 0").select("id_numeric", F.lit(True).alias("treatment"))
    return matching.sampled_fraction(kept, T.treatment_key(spark, d)).select(
        "id_numeric", "sampled_fraction"
    )


@query("agg_match_set_year", cte(*PANELED) + """
SELECT site_id, grp AS "group", match_group, year,
  round(td,6) AS treatment_defor_ha, round(cd,6) AS control_defor_ha,
  round(te,6) AS treatment_emissions_mgco2e, round(ce,6) AS control_emissions_mgco2e,
  n AS n_matched_pixels, round(cd-td,6) AS forest_loss_avoided_ha,
  round(ce-te,6) AS emissions_avoided_mgco2e FROM (
SELECT site_id, split_part(match_group,':',1) AS grp, match_group, year,
  coalesce(sum(CASE WHEN treatment THEN abs(forest_change_ha)*match_weight END),0) AS td,
  coalesce(sum(CASE WHEN NOT treatment THEN abs(forest_change_ha)*match_weight END),0) AS cd,
  coalesce(sum(CASE WHEN treatment THEN abs(emissions_mgco2e)*match_weight END),0) AS te,
  coalesce(sum(CASE WHEN NOT treatment THEN abs(emissions_mgco2e)*match_weight END),0) AS ce,
  count(*) FILTER (treatment) AS n FROM pan GROUP BY ALL)""")
def _(spark, d):
    return rounded(summary.match_set_year(panel(spark, d)))


@query("agg_site_year", cte(*RESULTS) + f"""
SELECT {YEARLY_COLUMNS}, n_matched_pixels, sampled_fraction, site_name, is_pre_intervention
FROM yearly""")
def _(spark, d):
    return rounded(yearly(spark, d))


@query("agg_site_total", cte(*RESULTS) + """
SELECT site_id, round(forest_loss_avoided_ha,6) AS forest_loss_avoided_ha,
  round(emissions_avoided_mgco2e,6) AS emissions_avoided_mgco2e, n_matched_pixels,
  sampled_fraction, first_year, last_year, n_years, site_name, area_ha FROM totals""")
def _(spark, d):
    return rounded(totals(spark, d))


@query("agg_run_summary", cte(*RESULTS) + """
SELECT count(*) AS n_sites, round(sum(emissions_avoided_mgco2e),4) AS total_emissions_avoided_mgco2e,
  round(sum(forest_loss_avoided_ha),4) AS total_forest_loss_avoided_ha,
  sum(area_ha) AS total_area_ha, (SELECT min(year) FROM yearly) AS year_min,
  (SELECT max(year) FROM yearly) AS year_max,
  (SELECT count(*) FROM sites WHERE site_id NOT IN (SELECT site_id FROM totals)) AS n_failed_sites
FROM totals""")
def _(spark, d):
    tot = totals(spark, d)
    failed = T.sites(spark, d).join(tot, "site_id", "left_anti")
    return rounded(summary.run_totals(tot, yearly(spark, d), failed), 4)


@query("agg_sampling_by_site", cte(*PANELED) + """
SELECT DISTINCT id_numeric, site_id, sampled_fraction, sampled_fraction*100 AS sampled_percent,
  sampled_fraction<1 AS was_subsampled FROM pan""")
def _(spark, d):
    return summary.sampling_by_site(panel(spark, d))


@query("agg_balance_smd", BALANCE_SQL + """
SELECT site_id, covariate, round(mean_treatment,6) AS mean_treatment,
  round(mean_control,6) AS mean_control, round(pooled_sd,6) AS pooled_sd, round(smd,6) AS smd
FROM smd""")
def _(spark, d):
    return rounded(balance(spark, d))


COUNT_COLUMNS = """count(*) FILTER (treatment) AS n_treatment,
  count(*) FILTER (NOT treatment) AS n_control"""
POOL = """, pool AS (SELECT site_id, count(*) AS n_control_pool FROM um WHERE NOT treatment GROUP BY 1),
mp AS (SELECT m.*, n_control_pool, CAST(floor(n_control_pool*0.9e0) AS BIGINT) AS n_control_sampled
FROM m JOIN pool USING (site_id))
"""


def _with_pool(spark, d):
    pool = (
        T.unweighted_matches(spark, d).filter("NOT treatment").groupBy("site_id")
        .agg(F.count("*").alias("n_control_pool"))
        .withColumn("n_control_sampled", F.floor(F.col("n_control_pool") * 0.9))
    )
    return T.matches(spark, d).join(pool, "site_id")


QUALITY_COUNTS_SQL = cte(*MATCHED, KEY).rstrip() + POOL.rstrip() + f""",
bs AS (SELECT site_id, {COUNT_COLUMNS}, max(n_control_sampled) AS n_control_sampled,
  max(n_control_pool) AS n_control_pool, 1 AS n_sites FROM mp GROUP BY site_id),
al AS (SELECT * FROM bs UNION ALL SELECT '__all__', CAST(sum(n_treatment) AS BIGINT),
  CAST(sum(n_control) AS BIGINT), CAST(sum(n_control_sampled) AS BIGINT),
  CAST(sum(n_control_pool) AS BIGINT), CAST(count(*) AS INT) FROM bs),
kt AS (SELECT site_id, count(*) AS n_treatment_total FROM tkey GROUP BY 1
  UNION ALL SELECT '__all__', count(*) FROM tkey),
qc AS (SELECT al.*, n_treatment_total FROM al LEFT JOIN kt USING (site_id))
"""


@query("agg_quality_counts", QUALITY_COUNTS_SQL + "SELECT * FROM qc")
def _(spark, d):
    return quality.quality_counts(_with_pool(spark, d), T.treatment_key(spark, d))


@query("fn_pool_percent", QUALITY_COUNTS_SQL + """
SELECT site_id, n_control, n_control_sampled, n_control_pool,
 round(CASE WHEN n_control_sampled>n_control AND n_control_sampled*100e0/n_control_pool<100
 THEN n_control_sampled*100e0/n_control_pool END,6) AS pool_percent FROM qc""")
def _(spark, d):
    counts = quality.quality_counts(_with_pool(spark, d), T.treatment_key(spark, d))
    return rounded(quality.pool_percent(counts).select(
        "site_id", "n_control", "n_control_sampled", "n_control_pool", "pool_percent"
    ))


@query("agg_quality_counts_est", cte(*MATCHED).rstrip() + f""",
bs AS (SELECT site_id, {COUNT_COLUMNS}, 1 AS n_sites,
  CAST(round_even(count(*) FILTER (treatment)/max(sampled_fraction),0) AS BIGINT)
    AS n_treatment_total FROM m GROUP BY site_id)
SELECT * FROM bs UNION ALL SELECT '__all__', CAST(sum(n_treatment) AS BIGINT),
  CAST(sum(n_control) AS BIGINT), CAST(count(*) AS INT), CAST(sum(n_treatment_total) AS BIGINT)
FROM bs""")
def _(spark, d):
    m = T.matches(spark, d).withColumns({
        "n_control_sampled": F.lit(None).cast("bigint"), "n_control_pool": F.lit(None).cast("bigint"),
    })
    share = m.select("site_id", "sampled_fraction").distinct()
    return quality.quality_counts_estimated(m, share)


HIST = """
cv AS (SELECT site_id, treatment, cov, v FROM
  (UNPIVOT (SELECT site_id, treatment, precip, elev, pop_2015, dist_cities FROM m)
   ON precip, elev, pop_2015, dist_cities INTO NAME cov VALUE v)),
sc AS (SELECT * FROM cv UNION ALL SELECT '__all__', treatment, cov, v FROM cv),
"""
HIST_TAIL = """
cnt AS (SELECT site_id, cov, bin, count(*) FILTER (treatment) AS t,
  count(*) FILTER (NOT treatment) AS c FROM b GROUP BY ALL),
tot AS (SELECT site_id, cov, sum(t) AS tt, sum(c) AS ct FROM cnt GROUP BY ALL)
SELECT site_id, cov AS covariate, CAST(i AS INT) AS bin, round(lo+(hi-lo)/40*i,6) AS bin_start,
  round(lo+(hi-lo)/40*(i+1),6) AS bin_end,
  round(coalesce(t*100/CAST(nullif(tt,0) AS DOUBLE),0),6) AS treatment_pct,
  round(coalesce(c*100/CAST(nullif(ct,0) AS DOUBLE),0),6) AS control_pct
FROM r JOIN tot USING (site_id, cov) CROSS JOIN range(40) z(i)
LEFT JOIN cnt ON cnt.site_id=r.site_id AND cnt.cov=r.cov AND cnt.bin=i
"""
HIST_LOCAL_SQL = cte(*MATCHED).rstrip() + "," + HIST + """
r AS (SELECT site_id, cov, min(v) AS lo, max(v) AS hi FROM sc GROUP BY ALL
  HAVING count(*)>=2 AND max(v)>min(v)),
b AS (SELECT sc.site_id, sc.cov, treatment,
  least(greatest(CAST(ceil((v-lo)/(hi-lo)*40) AS INT)-1,0),39) AS bin
  FROM sc JOIN r USING (site_id, cov)),""" + HIST_TAIL
HIST_GLOBAL_SQL = cte(*MATCHED).rstrip() + "," + HIST + """
g AS (SELECT cov, min(v) AS lo, max(v) AS hi FROM cv GROUP BY cov HAVING max(v)>min(v)),
r AS (SELECT DISTINCT site_id, cov, lo, hi FROM sc JOIN g USING (cov)),
b AS (SELECT sc.site_id, sc.cov, treatment,
  least(CAST(floor((v-lo)/(hi-lo)*40) AS INT),39) AS bin
  FROM sc JOIN g USING (cov)),""" + HIST_TAIL


@query("agg_histogram_local", HIST_LOCAL_SQL)
def _(spark, d):
    return rounded(quality.histogram_local(T.matches(spark, d), T.COVARIATES))


@query("agg_histogram_global", HIST_GLOBAL_SQL)
def _(spark, d):
    return rounded(quality.histogram_global(T.matches(spark, d), T.COVARIATES))


@query("agg_histogram_equal_width", f"""SELECT * EXCLUDE (site_id)
FROM ({HIST_GLOBAL_SQL}) WHERE site_id='__all__'""")
def _(spark, d):
    return rounded(quality.histogram_equal_width(T.matches(spark, d), T.COVARIATES))


QQ = cte(*MATCHED).rstrip() + """,
s AS (SELECT site_id, treatment, pscore FROM m WHERE pscore IS NOT NULL
  UNION ALL SELECT '__all__', treatment, pscore FROM m WHERE pscore IS NOT NULL),
l AS (SELECT site_id, list_sort(list(pscore) FILTER (treatment)) AS t,
  list_sort(list(pscore) FILTER (NOT treatment)) AS c FROM s GROUP BY site_id
  HAVING count(*) FILTER (treatment)>=2 AND count(*) FILTER (NOT treatment)>=2),
k AS (SELECT *, {points} AS k FROM l),
q AS (SELECT site_id, t, c, i, i/CAST(k-1 AS DOUBLE) AS p,
   i/CAST(k-1 AS DOUBLE)*(len(t)-1) AS ht, i/CAST(k-1 AS DOUBLE)*(len(c)-1) AS hc
  FROM (SELECT *, unnest(range(CAST(k AS BIGINT))) AS i FROM k))
SELECT site_id, i AS "index", round(p,6) AS quantile,
  round(t[floor(ht)::INT+1]+(ht-floor(ht))*(t[ceil(ht)::INT+1]-t[floor(ht)::INT+1]),6)
    AS treatment_value,
  round(c[floor(hc)::INT+1]+(hc-floor(hc))*(c[ceil(hc)::INT+1]-c[floor(hc)::INT+1]),6)
    AS control_value
FROM q"""


@query("agg_qq_quantiles", QQ.replace("{points}", "500"))
def _(spark, d):
    return rounded(quality.qq_pairs(T.matches(spark, d, "pscore")))


@query("agg_qq_adaptive", QQ.replace("{points}", "least(500, greatest(len(t), len(c)))"))
def _(spark, d):
    return rounded(quality.qq_pairs(T.matches(spark, d, "pscore"), adaptive=True))


@query("agg_year_trend", cte(*RESULTS) + """
SELECT year, round(sum(treatment_defor_ha),4) AS treatment_defor_ha,
  round(sum(control_defor_ha),4) AS control_defor_ha FROM yearly GROUP BY year""")
def _(spark, d):
    return rounded(
        yearly(spark, d).groupBy("year").agg(
            F.sum("treatment_defor_ha").alias("treatment_defor_ha"),
            F.sum("control_defor_ha").alias("control_defor_ha"),
        ), 4)


@query("agg_intervention_bounds", cte(*RESULTS) + """
SELECT min(year) FILTER (is_pre_intervention) AS pre_from,
  max(year) FILTER (is_pre_intervention) AS pre_to,
  (SELECT min(end_year) FROM sites WHERE end_year<2099) AS post_from,
  count(DISTINCT site_id) AS n_sites,
  sum(treatment_defor_ha)>0 OR sum(control_defor_ha)>0 AS has_loss FROM yearly""")
def _(spark, d):
    head = yearly(spark, d).agg(
        F.min(F.when(F.col("is_pre_intervention"), F.col("year"))).alias("pre_from"),
        F.max(F.when(F.col("is_pre_intervention"), F.col("year"))).alias("pre_to"),
        F.countDistinct("site_id").alias("n_sites"),
        ((F.sum("treatment_defor_ha") > 0) | (F.sum("control_defor_ha") > 0)).alias("has_loss"),
        F.lit(1).alias("k"),
    )
    ends = T.sites(spark, d).filter("end_year < 2099").agg(
        F.min("end_year").alias("post_from"), F.lit(1).alias("k")
    )
    return head.join(ends, "k").drop("k")


@query("agg_panel_years", cte(SITES) + """
SELECT CAST(y AS INT) AS year FROM (SELECT greatest(2000, min(start_year)-5) AS a,
  least(2024, coalesce(max(end_year) FILTER (end_year<2099),2024)) AS b FROM sites),
  range(2000, 2025) t(y) WHERE y BETWEEN a AND b""")
def _(spark, d):
    from arborlift.operators import extract
    return extract.panel_years(T.sites(spark, d))


PROFILE_SQL = cte(LAYERS).rstrip() + """,
v AS (SELECT layer, CASE WHEN value<>-9999 THEN value END AS x, value FROM lay),
prof AS (SELECT layer, count(*) AS total, count(x) AS valid,
  round(1-count(x)/CAST(count(*) AS DOUBLE),4) AS nodata_fraction, min(x) AS "min", max(x) AS "max",
  avg(x) AS mean, stddev_pop(x) AS std, median(x) AS median,
  quantile_cont(x,[0.01,0.02,0.05,0.1,0.25,0.5,0.75,0.9,0.95,0.98,0.99]) AS q,
  round(count(*) FILTER (x=0)/CAST(count(x) AS DOUBLE),4) AS zero_fraction,
  count(DISTINCT x) AS n_distinct, count(DISTINCT x)<=50 AS is_categorical FROM v GROUP BY layer)
"""


@query("agg_layer_profile", PROFILE_SQL + """
SELECT layer, total, valid, nodata_fraction, round("min",6) AS "min", round("max",6) AS "max",
 round(mean,6) AS mean, round(std,6) AS std, round(median,6) AS median, round(q[1],6) AS p1,
 round(q[2],6) AS p2, round(q[3],6) AS p5, round(q[4],6) AS p10, round(q[5],6) AS p25,
 round(q[6],6) AS p50, round(q[7],6) AS p75, round(q[8],6) AS p90, round(q[9],6) AS p95,
 round(q[10],6) AS p98, round(q[11],6) AS p99, zero_fraction, n_distinct, is_categorical
FROM prof""")
def _(spark, d):
    return rounded(registry.layer_profile(T.layer_values(spark, d), nodata=-9999.0))


@query("agg_layer_histogram", PROFILE_SQL.rstrip() + """,
r AS (SELECT layer, q[1] AS lo, q[11] AS hi FROM prof WHERE q[1]<>q[11]),
b AS (SELECT layer, least(CAST(floor((x-lo)/(hi-lo)*20) AS INT),19) AS bin FROM v JOIN r USING (layer)
  WHERE x BETWEEN lo AND hi),
c AS (SELECT layer, bin, count(*) AS n FROM b GROUP BY ALL)
SELECT layer, CAST(i AS INT) AS bin, round(lo+(hi-lo)/20*i,4) AS bin_start, coalesce(n,0) AS n
FROM r CROSS JOIN range(20) z(i) LEFT JOIN c ON c.layer=r.layer AND c.bin=i""".replace(
    "SELECT layer, CAST(i", "SELECT r.layer, CAST(i"))
def _(spark, d):
    return registry.layer_histogram(T.layer_values(spark, d), nodata=-9999.0)


@query("agg_tile_counts", cte(MANIFEST) + """
SELECT covariate_name, count(*) AS n_tiles, CAST(sum(size_bytes) AS BIGINT) AS total_bytes
FROM mani GROUP BY 1""")
def _(spark, d):
    return registry.tile_counts(T.manifest(spark, d))


@query("agg_tile_fingerprint", cte(MANIFEST) + """
SELECT covariate_name, substr(sha256(string_agg(b||h,'|' ORDER BY b)),1,16) AS tile_etag_hash
FROM (SELECT covariate_name, b, sha256(string_agg(DISTINCT e,'|' ORDER BY e)) AS h
 FROM (SELECT covariate_name, substr(md5(name),1,3) AS b, name||':'||etag||':'||size_bytes AS e FROM mani)
 GROUP BY 1,2) GROUP BY 1""")
def _(spark, d):
    return registry.tile_fingerprint(T.manifest(spark, d))


@query("agg_inventory_counts", cte(REGISTRY, MANIFEST) + """
, lt AS (SELECT covariate_name, n FROM (SELECT DISTINCT covariate_name FROM reg) LEFT JOIN
  (SELECT 'layer_'||(40+length(covariate_name)) AS covariate_name, count(*) AS n FROM mani GROUP BY 1)
  USING (covariate_name))
SELECT count(*) AS n_total, count(*) FILTER (n>0) AS n_on_source,
  count(*) FILTER (merged_url IS NOT NULL) AS n_on_store FROM lt JOIN latest USING (covariate_name)""")
def _(spark, d):
    latest = registry.latest_record(T.registry(spark, d))
    tiles = T.manifest(spark, d).groupBy(
        F.concat(F.lit("layer_"), (F.length("covariate_name") + 40).cast("string"))
        .alias("covariate_name")
    ).agg(F.count("*").alias("n"))
    return registry.inventory_counts(
        latest.join(tiles, "covariate_name", "left").select(
            F.coalesce("n", F.lit(0)).alias("gcs_tiles"),
            F.col("merged_url").isNotNull().alias("on_s3"),
        )
    )


@query("agg_bounds", cte(SITES) + """
SELECT round(min(id_numeric-0.5e0),6) AS xmin, round(min(start_year-0.5e0),6) AS ymin,
  round(max(id_numeric+0.5e0),6) AS xmax, round(max(start_year+0.5e0),6) AS ymax FROM sites""")
def _(spark, d):
    from arborlift.operators import polygons
    s = T.sites(spark, d)
    x, y = F.col("id_numeric"), F.col("start_year")
    ring = F.array(*[
        F.struct((x + dx).cast("double").alias("x"), (y + dy).cast("double").alias("y"))
        for dx, dy in ((-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5), (-0.5, -0.5))
    ])
    return polygons.total_bounds(s.select(F.array(F.array(ring)).alias("geometry")))


@query("agg_task_refcount", """
SELECT c_custkey AS site_set_id, count(o_orderkey) AS n_tasks, count(o_orderkey)=0 AS can_delete
FROM customer LEFT JOIN orders ON o_custkey=c_custkey GROUP BY 1""")
def _(spark, d):
    sets = T.table(spark, d, "customer").select(F.col("c_custkey").alias("site_set_id"))
    tasks = T.table(spark, d, "orders").select(F.col("o_custkey").alias("site_set_id"))
    return registry.reference_counts(sets, tasks)


WARN_SQL = BALANCE_SQL.rstrip() + ",\n" + ",\n".join([PANELED[-1], RESULTS[-1]]) + """,
bw AS (SELECT site_id, CASE WHEN site_id='__all__' THEN 'aggregate' ELSE site_id END AS scope,
  max(abs(smd)) AS mx, arg_min(covariate, (-abs(smd), covariate)) AS worst,
  list(covariate ORDER BY abs(smd) DESC, covariate) FILTER (abs(smd)>=0.25) AS crit,
  count(*) FILTER (abs(smd)>=0.25) AS nc, count(*) FILTER (abs(smd)>0.1) AS np, count(*) AS nt
 FROM smd WHERE smd IS NOT NULL GROUP BY site_id),
wr AS (
SELECT CASE WHEN n_matched_pixels<50 THEN 'danger' ELSE 'warning' END AS level, site_id AS scope,
 'Site ‘'||site_name||'’ has only '||n_matched_pixels||CASE WHEN n_matched_pixels<50
 THEN ' matched pixels, which is very low for reliable results.'
 ELSE ' matched pixels, which may limit result reliability.' END AS message, 0 AS rule
FROM totals WHERE n_matched_pixels<200
UNION ALL SELECT 'danger', scope, 'Covariate balance is poor: '||CASE WHEN nc=1
 THEN '‘'||worst||'’ has |SMD| = '||printf('%.2f',mx)||'.'
 ELSE nc||' covariates have |SMD| ≥ 0.25 (worst: ‘'||worst||'’ at '||printf('%.2f',mx)||').'
 END, 1 FROM bw WHERE nc>0
UNION ALL SELECT 'warning', scope, np||' of '||nt||' covariates ('||
 CAST(round_even(np*100e0/nt,0) AS INT)||'%) have |SMD| > 0.1, suggesting imperfect matching.', 2
FROM bw WHERE np/CAST(nt AS DOUBLE)>0.2)
"""


def warnings(spark, d):
    return quality.quality_warnings(totals(spark, d), balance(spark, d))


@query("fn_quality_warnings", WARN_SQL + "SELECT level, scope, message, rule FROM wr")
def _(spark, d):
    return warnings(spark, d)


@query("agg_warning_digest", WARN_SQL + """
SELECT scope, min(level) AS level, string_agg(message,'; ' ORDER BY rule, message) AS issues
FROM wr WHERE scope<>'aggregate' GROUP BY scope""")
def _(spark, d):
    return quality.warning_digest(warnings(spark, d))


@query("set_caution_minus_danger", WARN_SQL + """
SELECT scope FROM wr WHERE scope<>'aggregate' AND level='warning'
EXCEPT SELECT scope FROM wr WHERE level='danger'""")
def _(spark, d):
    return quality.caution_only(warnings(spark, d))


@query("flt_latest_scope", WARN_SQL + """
SELECT level, scope, message FROM wr WHERE scope='aggregate'""")
def _(spark, d):
    return warnings(spark, d).filter("scope = 'aggregate'").select("level", "scope", "message")


@query("top_worst_covariate", WARN_SQL + """
SELECT site_id, round(mx,6) AS max_smd, worst AS worst_covariate,
 coalesce(array_to_string(crit,','),'') AS critical_covariates, nc AS n_critical, np AS n_poor,
 nt AS n_total FROM bw""")
def _(spark, d):
    w = quality.worst_covariates(balance(spark, d))
    return rounded(w.withColumn("critical_covariates", F.array_join("critical_covariates", ",")))


@query("sort_by_abs_smd", BALANCE_SQL + """
SELECT covariate, round(smd,6) AS smd, abs(smd)<=0.1 AS within_threshold FROM smd
WHERE site_id='__all__' AND smd IS NOT NULL ORDER BY abs(smd)""")
def _(spark, d):
    return quality.by_absolute_smd(balance(spark, d)).select(
        "covariate", F.round("smd", 6).alias("smd"), "within_threshold"
    )


@query("set_union_balance", BALANCE_SQL + """
SELECT CASE WHEN site_id='__all__' THEN 'run' ELSE 'site' END AS part, count(*) AS n,
 round(sum(mean_treatment),4) AS sum_mean FROM smd GROUP BY 1""")
def _(spark, d):
    part = F.when(F.col("site_id") == quality.ALL_SCOPE, "run").otherwise("site").alias("part")
    return balance(spark, d).groupBy(part).agg(
        F.count("*").alias("n"), F.round(F.sum("mean_treatment"), 4).alias("sum_mean")
    )
