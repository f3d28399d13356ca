"""Sampling, scores, pairing and the whole matching step."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborlift.config import MatchConfig
from arborlift.operators import matching, pairing, proximity, scores
from arborlift.plans.aggregate_queries import rounded
from arborlift.plans.catalogue import query
from arborlift.plans.oracle_views import KEY, MATCHED, PIX, SITES, cte
from arborlift.session import stage
from arborlift.sources import shared_tables as T

SEED = 42


def config(**changes) -> MatchConfig:
    settings = dict(
        covariates=T.COVARIATES, exact_match_vars=T.EXACT, fc_years=T.YEARS, random_seed=SEED
    )
    return MatchConfig(**{**settings, **changes})


def large_site_table(spark, d):
    return T.sites(spark, d).filter("area_ha >= 100")


PX = """, px AS (SELECT cell, id_numeric, concat_ws('.',admin1,ecoregion,pa) AS g
FROM pix WHERE ecoregion IS NOT NULL)"""
STRATA = PX + """,
st AS (SELECT t.id_numeric, t.g, nt, nc FROM
  (SELECT id_numeric, g, count(*) AS nt FROM px WHERE id_numeric IS NOT NULL GROUP BY ALL) t
  JOIN (SELECT g, count(*) AS nc FROM px WHERE id_numeric IS NULL GROUP BY g) c USING (g))"""


@query("win_sample_treatment", cte(PIX) + STRATA + """
SELECT id_numeric, g AS "group", cell FROM (SELECT px.*, row_number() OVER (
  PARTITION BY id_numeric, g ORDER BY md5('42:'||id_numeric||':'||cell), cell) AS rn
  FROM px WHERE id_numeric IS NOT NULL) WHERE rn<=20""")
def _(spark, d):
    rows = matching.grouped_pixels(T.candidates(spark, d), T.treatment_key(spark, d), T.EXACT)
    treated = rows.filter("treatment").select("id_numeric", "group", "cell")
    return matching.sample_treated(treated, 20, SEED)


@query("win_sample_control", cte(PIX) + STRATA + """,
pos AS (SELECT g, cell, row_number() OVER (PARTITION BY g ORDER BY md5('42:'||cell), cell)-1 AS p
  FROM px WHERE id_numeric IS NULL),
run AS (SELECT *, ('0x'||substr(md5('42:'||id_numeric||':'||g),1,8))::BIGINT % nc AS s,
  least(nt*5, nc) AS k FROM st)
SELECT run.id_numeric, run.g AS "group", cell FROM run JOIN pos ON run.g=pos.g
WHERE (p-s+nc)%nc < k""")
def _(spark, d):
    pixels, key = T.candidates(spark, d), T.treatment_key(spark, d)
    rows = matching.grouped_pixels(pixels, key, T.EXACT)
    table = matching.strata(pixels, key, T.EXACT)
    return matching.sample_controls(rows.filter(~F.col("treatment")), table, 5, SEED)


SCORES = """, sc AS (SELECT cell, near_site AS id_numeric, concat_ws('.',admin1,ecoregion,pa) AS g,
  id_numeric IS NOT NULL AS treatment, precip/10e0+elev/100e0 AS score
FROM pix WHERE ecoregion IS NOT NULL)"""


def scored_rows(spark, d):
    """Every pixel with a one-dimensional score, in the stratum of its site."""
    px = T.pixels(spark, d).filter("ecoregion IS NOT NULL")
    return px.select(
        "cell", F.col("near_site").alias("id_numeric"),
        F.concat_ws(".", *T.EXACT).alias("group"),
        F.col("id_numeric").isNotNull().alias("treatment"),
        (F.col("precip") / 10 + F.col("elev") / 100).alias("score"),
    )


PAIRS = SCORES + """, pr AS (SELECT t.id_numeric, t.g, t.cell AS treated_cell, c.cell AS control_cell,
  abs(t.score-c.score) AS distance FROM sc t JOIN sc c ON t.id_numeric=c.id_numeric AND t.g=c.g
  AND t.treatment AND NOT c.treatment AND abs(t.score-c.score)<=0.2e0)
"""


@query("join_caliper_pairs", cte(PIX) + PAIRS + """
SELECT id_numeric, g AS "group", treated_cell, control_cell, round(distance,6) AS distance FROM pr""")
def _(spark, d):
    return rounded(proximity.caliper_pairs(scored_rows(spark, d), 0.2))


@query("match_caliper", cte(PIX) + PAIRS + """
SELECT sc.id_numeric, sc.g AS "group", sc.cell AS treated_cell, count(pr.control_cell) AS n_within
FROM sc LEFT JOIN pr ON sc.cell=treated_cell WHERE treatment GROUP BY ALL""")
def _(spark, d):
    rows = scored_rows(spark, d)
    return proximity.controls_within(rows, 0.2)


@query("win_control_rank", cte(PIX) + PAIRS + """
SELECT id_numeric, g AS "group", treated_cell, control_cell, row_number() OVER (
  PARTITION BY id_numeric, g, treated_cell ORDER BY round(distance,9), control_cell) AS "rank" FROM pr""")
def _(spark, d):
    return proximity.control_rank(
        proximity.caliper_pairs(scored_rows(spark, d), 0.2)
        .withColumn("distance", F.round("distance", 9))
    ).drop("distance")


@query("match_nearest_replace", cte(PIX) + SCORES + """
SELECT id_numeric, g AS "group", treated_cell, round(distance,6) AS distance FROM (
SELECT t.id_numeric, t.g, t.cell AS treated_cell, abs(t.score-c.score) AS distance,
  row_number() OVER (PARTITION BY t.id_numeric, t.g, t.cell ORDER BY abs(t.score-c.score)) AS rn
 FROM sc t JOIN sc c ON t.id_numeric=c.id_numeric AND t.g=c.g AND t.treatment AND NOT c.treatment
) WHERE rn=1""")
def _(spark, d):
    near = proximity.nearest_control(scored_rows(spark, d))
    return rounded(near.select("id_numeric", "group", "treated_cell", "distance"))


@query("match_linear_score", cte(PIX) + SCORES + """,
md AS (SELECT id_numeric, g, treatment, count(*) AS n, median(score) AS med FROM sc GROUP BY ALL),
mad AS (SELECT sc.id_numeric, sc.g, sc.treatment, max(n) AS n, stddev_samp(score) AS sd,
  1.4826e0*median(abs(score-med)) AS mad
  FROM sc JOIN md ON sc.id_numeric=md.id_numeric AND sc.g=md.g AND sc.treatment=md.treatment
  GROUP BY ALL)
SELECT id_numeric, g AS "group", round(CASE WHEN a>1e-12 THEN a WHEN b>1e-12 THEN b ELSE 1 END,6) AS scale
FROM (SELECT id_numeric, g, sqrt(sum((n-1)*mad*mad)/(sum(n)-2)) AS a,
 sqrt(sum((n-1)*coalesce(sd,0)*coalesce(sd,0))/(sum(n)-2)) AS b FROM mad GROUP BY id_numeric, g
 HAVING count(*)=2 AND sum(n)>2)""")
def _(spark, d):
    rows = matching.keep_shared_groups(scored_rows(spark, d))
    sized = rows.groupBy("id_numeric", "group").count().filter("count > 2")
    rows = stage(rows.join(sized, ["id_numeric", "group"], "left_semi"), "linear-scores")
    return rounded(scores.pooled_spreads(rows.withColumnRenamed("score", "lp"), "mad"))


@query("match_weights", cte(*MATCHED) + """
SELECT site_id, cell, match_group, round(match_weight,9) AS match_weight FROM m""")
def _(spark, d):
    m = pairing.with_match_weights(T.unweighted_matches(spark, d))
    return m.select("site_id", "cell", "match_group", F.round("match_weight", 9).alias("match_weight"))


def _run(spark, d, **changes):
    cfg = config(**changes)
    return matching.match_sites(
        T.candidates(spark, d), T.treatment_key(spark, d), large_site_table(spark, d), cfg, with_pixels=False
    )


@query("match_all_sites")
def _(spark, d):
    """All sites: strata, samples, scores and 1:1 pairs, in one job."""
    matches, _ = _run(spark, d)
    return matches.select(
        "site_id", "group", "cell", "treatment", "match_group", "match_weight", "pscore",
        "sampled_fraction", "n_control_sampled", "n_control_pool",
    )


@query("match_pairs_k")
def _(spark, d):
    matches, _ = _run(spark, d, max_controls_per_treatment=2)
    return matches.select("site_id", "group", "cell", "treatment", "match_group", "distance")


@query("match_full")
def _(spark, d):
    matches, _ = _run(spark, d, max_controls_per_treatment=0)
    return matches.select("site_id", "group", "cell", "treatment", "match_group", "match_weight")


def _model_rows(spark, d):
    """Rows around every site with standardized covariates, ready for models."""
    px = T.pixels(spark, d).filter("ecoregion IS NOT NULL").dropna(subset=list(T.COVARIATES))
    names = [f"x{i}" for i in range(len(T.COVARIATES))]
    rows = px.select(
        F.col("near_site").alias("id_numeric"),
        F.col("admin1").cast("string").alias("group"), "cell",
        F.col("id_numeric").isNotNull().alias("treatment"),
        *[F.col(c).alias(n) for c, n in zip(T.COVARIATES, names)],
    )
    return rows, names


@query("match_pscore_logit")
def _(spark, d):
    """Logistic model of every stratum by shuffled sums only."""
    rows, names = _model_rows(spark, d)
    out = scores.distributed_coordinates(rows, names, config(min_glm_treatment_pixels=1))
    return out.select("id_numeric", "group", "cell", "treatment", "pscore")


@query("match_mahalanobis")
def _(spark, d):
    """Whitened covariates: Euclidean distance is the Mahalanobis distance."""
    rows, names = _model_rows(spark, d)
    out = scores.distributed_coordinates(rows, names, config(min_glm_treatment_pixels=10_000))
    return out.select("id_numeric", "group", "cell", "treatment", "coords")


FAIL_SQL = cte(SITES, PIX, KEY) + """,
stages AS (SELECT id_numeric, count(*) FILTER (admin1<3) AS n_key,
  count(*) FILTER (ecoregion=2 AND pa=0 AND elev>330) AS ntf,
  count(*) FILTER (ecoregion=2 AND pa=0 AND elev>350) AS nm
 FROM pix WHERE id_numeric IS NOT NULL GROUP BY 1)
SELECT id_numeric, site_id, site_name, error FROM (SELECT s.id_numeric, site_id, site_name,
 CASE WHEN coalesce(n_key,0)=0 THEN 'No treatment cells found for site'
  WHEN ntf=0 THEN 'No treatment pixels remaining after filtering'
  WHEN nm=0 THEN 'No matches found (treatment='||ntf||', control='||n_key||')' END AS error
 FROM sites s LEFT JOIN stages USING (id_numeric)) WHERE error IS NOT NULL"""


@query("match_failures", FAIL_SQL)
def _(spark, d):
    kept = (F.col("ecoregion") == 2) & (F.col("pa") == 0)
    px = T.pixels(spark, d).filter("id_numeric IS NOT NULL")
    stages = px.groupBy("id_numeric").agg(
        F.count_if(F.col("admin1") < 3).alias("n_key"),
        F.count_if(kept & (F.col("elev") > 330)).alias("n_treatment_final"),
        F.count_if(F.col("admin1") < 3).alias("n_control_final"),
        F.count_if(kept & (F.col("elev") > 350)).alias("n_matched"),
    )
    return matching.failures(T.sites(spark, d), stages)


@query("match_resume", cte(*MATCHED) + """
SELECT site_id FROM sites WHERE id_numeric NOT IN
 (SELECT id_numeric FROM m GROUP BY 1 HAVING count(*)>=400)""")
def _(spark, d):
    m = T.matches(spark, d)
    big = m.groupBy("id_numeric").count().filter("count >= 400")
    done = m.join(big, "id_numeric", "left_semi")
    return matching.pending_sites(T.sites(spark, d), done).select("site_id")
