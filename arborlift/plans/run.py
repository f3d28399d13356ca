"""A whole run: extract, match, summarize, write - one Spark job per step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from arborlift.config import MatchConfig
from arborlift.operators import extract, matching, quality, summary
from arborlift.schema import FAILED_SITES
from arborlift.session import stage
from arborlift.sources import tables

PIXEL_COLUMNS = (
    "cell", "site_id", "year", "treatment", "sampled_fraction", "match_group", "match_weight",
    "forest_at_year_end", "forest_change_ha", "emissions_mgco2e",
)


def _earlier_matches(spark: SparkSession, path: str) -> DataFrame | None:
    if not tables.has_rows(spark, path):
        return None
    return spark.read.option("mergeSchema", True).parquet(path)


def extract_step(sites: DataFrame, layers: DataFrame, cfg: MatchConfig, out: str):
    """Write the treatment key and the wide pixel table; return both."""
    spark = sites.sparkSession
    tables.write_parquet(extract.treatment_key(sites), f"{out}/treatment_key")
    key = spark.read.parquet(f"{out}/treatment_key")
    tables.write_pixels(extract.pixel_table(layers, key, cfg), f"{out}/pixels")
    return key, spark.read.parquet(f"{out}/pixels")


def match_step(pixels, key, sites, cfg: MatchConfig, out: str) -> DataFrame:
    """Match the sites without a valid earlier result and write them."""
    spark = pixels.sparkSession
    path = f"{out}/matches"
    todo = stage(matching.pending_sites(sites, _earlier_matches(spark, path)), "todo")
    matches, failed = matching.match_sites(pixels, key, sites, cfg, todo)
    tables.write_matches(matches, path)
    markers = failed.select(
        "*", F.lit(None).cast("string").alias("timestamp"),
        F.lit(None).cast("int").alias("array_index"), F.lit(None).cast("string")
        .alias("failure_marker_file"),
    )
    tables.write_parquet(markers, f"{out}/failed")
    # the schema is given, as a run without any match leaves no file to infer it from
    return spark.read.schema(matches.schema).parquet(path)


def summarize_step(matches, key, sites, cfg: MatchConfig, out: str) -> dict[str, DataFrame]:
    """Write every result table; returns the tables by name."""
    spark = matches.sparkSession
    columns = spark.read.parquet(f"{out}/failed").select(
        *[f.split()[0] for f in FAILED_SITES.split(", ")]
    )
    failed = summary.failed_site_table(columns, sites)
    panel = summary.pixel_panel(matches, sites, cfg.scale_by_area)
    yearly = stage(summary.site_year(panel, sites), "yearly")
    totals = stage(summary.site_total(yearly, sites), "totals")
    sampling = stage(summary.sampling_by_site(matches), "sampling")
    covariates = [*cfg.covariates, "defor_pre_intervention"]
    balance = stage(quality.balance(matches, covariates), "balance")
    ids = ["cell", "site_id", "treatment", "match_group", "match_weight"]
    results = {
        "results_by_site_year": yearly,
        "results_by_site_total": totals,
        "results_sampling_by_site": sampling,
        "results_failed_sites": failed,
        "results_balance": balance,
        "results_match_covariates": matches.select(*ids, *covariates),
        "results_propensity_scores": matches.select(*ids, "pscore"),
        "results_pixel_level": panel.select(*PIXEL_COLUMNS),
        "quality_counts": quality.quality_counts(matches, key),
        "quality_histograms": quality.histogram_local(matches, covariates),
        "quality_quantiles": quality.qq_pairs(matches),
        "quality_warnings": quality.quality_warnings(totals, balance),
    }
    for name, df in results.items():
        tables.write_csv(df, f"{out}/{name}")
    run = summary.run_totals(totals, yearly, failed)
    tables.write_document(tables.run_summary_document(
        run, totals, failed, summary.subsampled_sites(sampling, sites), cfg.task_id,
        cfg.random_seed), f"{out}/results_summary")
    head = run.withColumn("task_id", F.lit(cfg.task_id)).withColumnsRenamed(
        {"year_min": "year_range_min", "year_max": "year_range_max"})
    summary_json = head.select(F.to_json(F.struct("*"))).first()[0]
    tables.write_document(
        tables.analysis_payload(yearly, totals, summary_json), f"{out}/results_payload")
    return results


def run_analysis(sites: DataFrame, layers: DataFrame, cfg: MatchConfig, out: str):
    """All steps for all sites. ``layers`` is long: (layer, cell, value).

    A rerun into the same folder keeps the matches of finished sites.
    """
    sites = extract.large_sites(sites, cfg.min_site_area_ha)
    key, pixels = extract_step(sites, layers, cfg, out)
    matches = match_step(pixels, key, sites, cfg, out)
    return summarize_step(matches, key, sites, cfg, out)
