"""ANSI SQL twins of the derived tables, for the side-by-side check."""

from __future__ import annotations

SITES = """sites AS (
SELECT CAST(s_suppkey+1 AS INT) AS id_numeric,
       'S'||lpad(CAST(s_suppkey AS VARCHAR),12,'0') AS site_id, s_name AS site_name,
       CAST(2003+s_nationkey%8 AS INT) AS start_year,
       CAST(CASE WHEN s_acctbal<2000 THEN 2006+s_nationkey%8 ELSE 2099 END AS INT) AS end_year,
       CAST(100+floor(s_acctbal/10) AS DOUBLE) AS area_ha
FROM supplier)"""

YEARS = range(2000, 2013)
_COVER = ",\n       ".join(
    f"greatest(0e0, fc0-loss*({y}-2000)) AS fc_{y}" for y in YEARS
)
PIX = f"""pix0 AS (
SELECT b.cell, CASE WHEN flag='R' THEN CAST(supp+1 AS INT) END AS id_numeric,
       CAST(supp+1 AS INT) AS near_site, (b.cell%16+600)/7.1e0 AS area_ha,
       n_regionkey AS admin1,
       CASE WHEN p_size=50 THEN NULL WHEN p_size<17 THEN 0 WHEN p_size<34 THEN 1 ELSE 2 END
         AS ecoregion, pa,
       p_retailprice*2/7e0 AS precip, p_size*50/7e0 AS elev,
       CASE WHEN qty<>50 THEN qty/7e0 END AS pop_2015, tax*100/7e0 AS dist_cities,
       (p_size*3+50)/7.1e0 AS total_biomass,
       CAST(CASE WHEN p_size=1 THEN 0 ELSE 40+b.cell%61 END AS DOUBLE) AS fc0,
       (b.cell%7)*0.5e0*(CASE WHEN flag='R' THEN 0.5e0 ELSE 1e0 END) AS loss
FROM (SELECT l_orderkey*8+l_linenumber AS cell, max(l_suppkey) supp, max(l_partkey) part,
             max(l_quantity) qty, max(l_tax) tax, max(l_returnflag) flag,
             max(CASE WHEN l_linestatus='O' THEN 1 ELSE 0 END) pa
      FROM lineitem GROUP BY l_orderkey, l_linenumber) b
JOIN supplier ON s_suppkey=b.supp JOIN nation ON n_nationkey=s_nationkey
JOIN part ON p_partkey=b.part),
pix AS (SELECT * EXCLUDE (fc0, loss),
       {_COVER}
FROM pix0)"""

KEY = """tkey AS (SELECT cell, id_numeric, area_ha,
  'S'||lpad(CAST(id_numeric-1 AS VARCHAR),12,'0') AS site_id
FROM pix WHERE id_numeric IS NOT NULL)"""

MATCHES = """um AS (
SELECT cell, near_site AS id_numeric,
       'S'||lpad(CAST(near_site-1 AS VARCHAR),12,'0') AS site_id,
       p.id_numeric IS NOT NULL AS treatment,
       concat_ws('.',admin1,ecoregion,pa) AS grp,
       concat_ws('.',admin1,ecoregion,pa)||':'||((cell//8)%12) AS match_group,
       p.area_ha, precip, elev, pop_2015, dist_cities, total_biomass,
       CASE WHEN s.area_ha>600 THEN 0.5e0 ELSE 1e0 END AS sampled_fraction,
       CASE WHEN NOT (pa=1 AND ecoregion=2)
            THEN (elev+coalesce(pop_2015,25e0))/401.3e0 END AS pscore,
       COLUMNS('^fc_.*')
FROM pix p JOIN sites s ON s.id_numeric=near_site WHERE ecoregion IS NOT NULL),
m AS (SELECT *, CASE WHEN treatment THEN 1e0 ELSE nt/CAST(nc AS DOUBLE) END AS match_weight
FROM (SELECT *, count(*) FILTER (treatment) OVER (PARTITION BY site_id, grp, match_group) AS nt,
      count(*) FILTER (NOT treatment) OVER (PARTITION BY site_id, grp, match_group) AS nc FROM um)
WHERE nt>0 AND nc>0)"""

PANEL = """panel AS (
SELECT *, fc/100e0*area_ha AS forest_at_year_end,
  fc/100e0*area_ha - lag(fc/100e0*area_ha) OVER w AS forest_change_ha,
  CASE WHEN first_value(fc/100e0*area_ha) OVER w <> 0
       THEN fc/100e0*area_ha / first_value(fc/100e0*area_ha) OVER w END AS frac
FROM (SELECT mm.cell, mm.site_id, mm.id_numeric, mm.area_ha, mm.treatment, sampled_fraction,
        total_biomass, match_group, match_weight, s.start_year, s.end_year, s.site_name,
        CAST(substr(k,4) AS INT) AS year, fc
      FROM (UNPIVOT m ON COLUMNS('^fc_.*') INTO NAME k VALUE fc) mm JOIN sites s USING (site_id))
WHERE year BETWEEN greatest(2000, start_year-6) AND end_year
WINDOW w AS (PARTITION BY site_id, cell, treatment ORDER BY year)),
pan AS (SELECT * FROM (SELECT *,
    (total_biomass*frac - lag(total_biomass*frac) OVER
      (PARTITION BY site_id, cell, treatment ORDER BY year))*0.5e0*-3.67e0 AS emissions_mgco2e
  FROM panel) WHERE year BETWEEN greatest(2001, start_year-5) AND end_year)"""

YEARLY = """raw_year AS (
SELECT site_id, year, max(sampled_fraction) AS sampled_fraction, max(start_year) AS start_year,
  max(site_name) AS site_name,
  coalesce(sum(CASE WHEN treatment THEN abs(forest_change_ha)*match_weight END),0) AS td,
  coalesce(sum(CASE WHEN NOT treatment THEN abs(forest_change_ha)*match_weight END),0) AS cd,
  coalesce(sum(CASE WHEN treatment THEN abs(emissions_mgco2e)*match_weight END),0) AS te,
  coalesce(sum(CASE WHEN NOT treatment THEN abs(emissions_mgco2e)*match_weight END),0) AS ce,
  count(*) FILTER (treatment) AS n FROM pan GROUP BY site_id, year),
yearly AS (SELECT site_id, year, td/sampled_fraction AS treatment_defor_ha,
  cd/sampled_fraction AS control_defor_ha, (cd-td)/sampled_fraction AS forest_loss_avoided_ha,
  te/sampled_fraction AS treatment_emissions_mgco2e,
  ce/sampled_fraction AS control_emissions_mgco2e,
  (ce-te)/sampled_fraction AS emissions_avoided_mgco2e,
  n AS n_matched_pixels, sampled_fraction, site_name, year<start_year AS is_pre_intervention,
  start_year FROM raw_year),
totals AS (SELECT y.site_id, sum(forest_loss_avoided_ha) AS forest_loss_avoided_ha,
  sum(emissions_avoided_mgco2e) AS emissions_avoided_mgco2e,
  max(n_matched_pixels) AS n_matched_pixels, max(sampled_fraction) AS sampled_fraction,
  min(year) AS first_year, max(year) AS last_year, count(*) AS n_years,
  max(y.site_name) AS site_name, max(s.area_ha) AS area_ha
FROM yearly y JOIN sites s USING (site_id) WHERE year>=y.start_year GROUP BY y.site_id)"""

REGISTRY = """reg AS (
SELECT event_id AS id, CASE WHEN user_id<40 THEN 'fc_' ELSE 'layer_' END||user_id AS covariate_name,
  CASE event_type WHEN 'view' THEN 'exporting' WHEN 'click' THEN 'exported'
    WHEN 'purchase' THEN 'merged' WHEN 'signup' THEN 'pending_merge' ELSE 'failed' END AS status,
  CASE WHEN value>5 THEN 'u/'||event_id END AS merged_url,
  CASE WHEN value>2 THEN value*100000 END AS size_bytes,
  CASE WHEN event_type<>'signup' THEN ts END AS started_at
FROM events),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY covariate_name
  ORDER BY started_at DESC NULLS LAST, id) AS rn FROM reg) WHERE rn=1)"""

MANIFEST = """mani AS (
SELECT regexp_replace(url,'[?#].*$','')||'.tif' AS name,
  regexp_extract(url,'://([^/.]+)[.]',1) AS covariate_name,
  md5(html) AS etag, CAST(length(html) AS BIGINT) AS size_bytes,
  CAST(page_id AS VARCHAR) AS updated FROM pages)"""

LAYERS = """lay AS (
SELECT layer, CASE WHEN layer='l_quantity' AND v=13 THEN -9999e0 ELSE v END AS value
FROM (UNPIVOT (SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem)
      ON COLUMNS(*) INTO NAME layer VALUE v))"""

GRID = """grid AS (SELECT CAST(floor(cell/100) AS BIGINT) AS row, cell%100 AS col, elev AS value, pa AS code
FROM pix)"""

POLYGONS = """poly AS (
SELECT CAST(s_suppkey+1 AS INT) AS id_numeric, s_nationkey AS zone,
  'S'||lpad(CAST(s_suppkey AS VARCHAR),12,'0') AS site_id,
  10.00123e0+s_nationkey*0.11e0 AS lon, 5.00217e0+s_acctbal/20000e0 AS lat,
  0.0311e0+(s_suppkey%7)*0.0101e0 AS r FROM supplier),
edge AS (SELECT id_numeric, zone, ring, lon+r*a AS x0, lat+r*b AS y0, lon+r*c AS x1, lat+r*d AS y1
FROM poly CROSS JOIN (VALUES (0,-1.0e0,0.1e0,-0.5e0,-0.9e0), (0,-0.5e0,-0.9e0,0.6e0,-0.8e0), (0,0.6e0,-0.8e0,1.0e0,0.2e0),
  (0,1.0e0,0.2e0,0.4e0,0.9e0), (0,0.4e0,0.9e0,-0.6e0,0.7e0), (0,-0.6e0,0.7e0,-1.0e0,0.1e0),
  (1,-0.3e0,0.05e0,0.02e0,-0.35e0), (1,0.02e0,-0.35e0,0.33e0,0.03e0), (1,0.33e0,0.03e0,0.04e0,0.31e0),
  (1,0.04e0,0.31e0,-0.3e0,0.05e0)) v(ring,a,b,c,d)),
cand AS (SELECT id_numeric, zone, "row", col, 90e0-("row"+0.5e0)/120 AS cy, (col+0.5e0)/120-180e0 AS cx
FROM (SELECT *, unnest(range(CAST(floor((90-lat-r)*120) AS BIGINT), CAST(floor((90-lat+r)*120)+1 AS BIGINT))) AS "row" FROM poly),
  LATERAL (SELECT unnest(range(CAST(floor((lon-r+180)*120) AS BIGINT), CAST(floor((lon+r+180)*120)+1 AS BIGINT))) AS col)),
inside AS (SELECT c.id_numeric, c.zone, "row", col FROM cand c JOIN edge e ON c.id_numeric=e.id_numeric
  AND least(y0,y1)<=cy AND cy<greatest(y0,y1) AND x0+(cy-y0)/(y1-y0)*(x1-x0)<=cx
  GROUP BY ALL HAVING count(*)%2=1),
touch AS (SELECT DISTINCT c.id_numeric, "row", col FROM cand c JOIN edge e ON c.id_numeric=e.id_numeric
  AND greatest(0, least((cx-1/240e0-x0)/(x1-x0),(cx+1/240e0-x0)/(x1-x0)),
                  least((cy-1/240e0-y0)/(y1-y0),(cy+1/240e0-y0)/(y1-y0)))
   <= least(1, greatest((cx-1/240e0-x0)/(x1-x0),(cx+1/240e0-x0)/(x1-x0)),
               greatest((cy-1/240e0-y0)/(y1-y0),(cy+1/240e0-y0)/(y1-y0)))),
covered AS (SELECT id_numeric, "row", col FROM inside UNION SELECT id_numeric, "row", col FROM touch)"""


def cte(*parts: str) -> str:
    """WITH clause over the given views, each stated once."""
    return "WITH " + ",\n".join(dict.fromkeys(parts)) + "\n"


MATCHED = (SITES, PIX, MATCHES)
PANELED = (*MATCHED, PANEL)
RESULTS = (*PANELED, YEARLY)
