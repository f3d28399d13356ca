"""From matched pixels to yearly and total impact figures.

A matched row carries its whole cover series as ``fc_<year>`` columns, so
changes and remaining fractions are computed inside the row and only then
exploded. No window and no shuffle is needed before the final aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from arborlift.config import (
    OPEN_END_YEAR, PRE_INTERVENTION_YEARS, REQUIRED_MATCH_COLUMNS, require_columns,
)

# Biomass to carbon, and carbon to CO2 equivalent (as a loss).
CARBON_SHARE = 0.5
CO2E_PER_CARBON = -3.67

MEASURES = (
    "treatment_defor_ha", "control_defor_ha", "forest_loss_avoided_ha",
    "treatment_emissions_mgco2e", "control_emissions_mgco2e", "emissions_avoided_mgco2e",
)


def cover_years(columns) -> list[int]:
    return sorted(int(c[3:]) for c in columns if c.startswith("fc_") and c[3:].isdigit())


def with_site_dates(matches: DataFrame, sites: DataFrame) -> DataFrame:
    dates = sites.select("site_id", "start_year", "end_year")
    return matches.drop("start_year", "end_year").join(dates, "site_id", "left")


def unpivot_cover(matches: DataFrame) -> DataFrame:
    """Wide ``fc_<year>`` columns to (year, fc) rows, keeping NULL cover."""
    years = cover_years(matches.columns)
    keep = [c for c in matches.columns if c not in {f"fc_{y}" for y in years}]
    rows = F.array(*[
        F.struct(F.lit(y).alias("year"), F.col(f"fc_{y}").cast("double").alias("fc"))
        for y in years
    ])
    return matches.select(*keep, F.inline(rows))


def _year_positions(sites: DataFrame, years: list[int]) -> DataFrame:
    """Per site: positions in ``years`` of the first read, first and last kept year."""
    start, end = F.col("start_year"), F.col("end_year")
    read_from = F.greatest(F.lit(years[0]), start - PRE_INTERVENTION_YEARS - 1)
    keep_from = F.greatest(F.lit(years[0] + 1), start - PRE_INTERVENTION_YEARS)
    listed = F.array(*[F.lit(y) for y in years])

    def before(limit: Column) -> Column:
        return F.size(F.filter(listed, lambda y: y < limit))

    return sites.select(
        "site_id", "start_year", "end_year", before(read_from).alias("_first"),
        before(keep_from).alias("_lo"), (before(end + 1) - 1).alias("_hi"),
    )


def pixel_panel(matches: DataFrame, sites: DataFrame, scale_by_area: bool = False) -> DataFrame:
    """Pixel-year rows with cover (ha), change (ha) and emissions.

    Six years before the start are read and five kept; the extra one is the
    base of the first difference. Differences are against the previous listed
    year, which need not be the calendar year before. Emissions come from
    biomass density; ``scale_by_area`` multiplies them by the pixel area.

    Positions of the years are worked out once per site. Only kept years are
    exploded, and each looks up its values in the row's own cover array.
    """
    require_columns(matches.columns, REQUIRED_MATCH_COLUMNS, "match table")
    years = cover_years(matches.columns)
    cover = [f"fc_{y}" for y in years]
    keep = [c for c in matches.columns if c not in {*cover, "start_year", "end_year"}]
    hectares = F.array(*[F.col(c).cast("double") / 100 * F.col("area_ha") for c in cover])
    df = (
        matches.select(*keep, hectares.alias("_ha"))
        .join(_year_positions(sites, years), "site_id")
        .filter("_hi >= _lo")
        .withColumn("_i", F.explode(F.sequence("_lo", "_hi")))
    )
    mass = F.col("total_biomass").cast("double")
    if scale_by_area:
        mass = mass * F.col("area_ha")
    df = df.withColumns({
        "year": F.get(F.array(*[F.lit(y) for y in years]), F.col("_i")),
        "forest_at_year_end": F.get("_ha", F.col("_i")),
        "_before": F.when(F.col("_i") > F.col("_first"), F.get("_ha", F.col("_i") - 1)),
        "_base": F.get("_ha", F.col("_first")),
    })
    fraction = F.try_divide("forest_at_year_end", "_base")
    fraction_before = F.try_divide("_before", "_base")
    carbon = (mass * fraction - mass * fraction_before) * CARBON_SHARE
    return df.select(
        *keep, "start_year", "end_year", "year", "forest_at_year_end",
        (F.col("forest_at_year_end") - F.col("_before")).alias("forest_change_ha"),
        fraction.alias("forest_frac_remaining"),
        (carbon * CO2E_PER_CARBON).alias("emissions_mgco2e"),
    )


def _arm_sum(value: str, treated: bool) -> Column:
    arm = F.col("treatment") if treated else ~F.col("treatment")
    total = F.sum(F.when(arm, F.abs(F.col(value)) * F.col("match_weight")))
    return F.coalesce(total, F.lit(0.0))


def _loss_sums() -> list[Column]:
    return [
        _arm_sum("forest_change_ha", True).alias("treatment_defor_ha"),
        _arm_sum("forest_change_ha", False).alias("control_defor_ha"),
        _arm_sum("emissions_mgco2e", True).alias("treatment_emissions_mgco2e"),
        _arm_sum("emissions_mgco2e", False).alias("control_emissions_mgco2e"),
        F.count_if("treatment").alias("n_matched_pixels"),
    ]


def _with_avoided(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "forest_loss_avoided_ha": F.col("control_defor_ha") - F.col("treatment_defor_ha"),
        "emissions_avoided_mgco2e":
            F.col("control_emissions_mgco2e") - F.col("treatment_emissions_mgco2e"),
    })


def match_set_year(panel: DataFrame) -> DataFrame:
    """Weighted losses of every match set and year; sets never mix strata."""
    return _with_avoided(
        panel.groupBy("site_id", "group", "match_group", "year").agg(*_loss_sums())
    )


def site_year(panel: DataFrame, sites: DataFrame) -> DataFrame:
    """Site-year figures, scaled up by the sampled share.

    Sums over match sets equal sums over their pixels, so one map-side
    combined aggregation replaces the set-level step.
    """
    sums = _with_avoided(
        panel.groupBy("site_id", "year")
        .agg(*_loss_sums(), F.max("sampled_fraction").alias("sampled_fraction"))
    )
    scaled = sums.withColumns({c: F.col(c) / F.col("sampled_fraction") for c in MEASURES})
    names = sites.select("site_id", "site_name", "start_year")
    return scaled.join(names, "site_id", "left").select(
        "site_id", "year", *MEASURES, "n_matched_pixels", "sampled_fraction", "site_name",
        (F.col("year") < F.col("start_year")).alias("is_pre_intervention"),
    )


def site_total(yearly: DataFrame, sites: DataFrame) -> DataFrame:
    """Totals over the intervention period."""
    sums = (
        yearly.filter(~F.col("is_pre_intervention"))
        .groupBy("site_id")
        .agg(
            F.sum("forest_loss_avoided_ha").alias("forest_loss_avoided_ha"),
            F.sum("emissions_avoided_mgco2e").alias("emissions_avoided_mgco2e"),
            F.max("n_matched_pixels").alias("n_matched_pixels"),
            F.max("sampled_fraction").alias("sampled_fraction"),
            F.min("year").alias("first_year"),
            F.max("year").alias("last_year"),
            F.count("*").alias("n_years"),
        )
    )
    return sums.join(sites.select("site_id", "site_name", "area_ha"), "site_id", "left")


def sampling_by_site(panel: DataFrame) -> DataFrame:
    return (
        panel.select("id_numeric", "site_id", "sampled_fraction").distinct()
        .withColumn("sampled_percent", F.col("sampled_fraction") * 100)
        .withColumn("was_subsampled", F.col("sampled_fraction") < 1)
    )


def subsampled_sites(sampling: DataFrame, sites: DataFrame) -> DataFrame:
    names = sites.select("id_numeric", "site_name")
    return sampling.filter("was_subsampled").join(names, "id_numeric", "left").select(
        "id_numeric", "site_id", "site_name", "sampled_fraction", "sampled_percent"
    )


def failed_site_table(markers: DataFrame, sites: DataFrame) -> DataFrame:
    """Failure rows; a marker's own name wins over the site table's."""
    names = sites.select("id_numeric", F.col("site_name").alias("_name"))
    return markers.join(names, "id_numeric", "left").select(
        "id_numeric", "site_id", F.coalesce("site_name", "_name").alias("site_name"),
        F.coalesce("error", F.lit("Unknown error")).alias("error"),
        "timestamp", "array_index", "failure_marker_file",
    )


def run_totals(totals: DataFrame, yearly: DataFrame, failed: DataFrame) -> DataFrame:
    """One row: counts, grand totals and the year range of the run."""
    head = totals.agg(
        F.count("*").alias("n_sites"),
        F.coalesce(F.sum("emissions_avoided_mgco2e"), F.lit(0.0))
        .alias("total_emissions_avoided_mgco2e"),
        F.coalesce(F.sum("forest_loss_avoided_ha"), F.lit(0.0))
        .alias("total_forest_loss_avoided_ha"),
        F.coalesce(F.sum("area_ha"), F.lit(0.0)).alias("total_area_ha"),
    )
    span = yearly.agg(F.min("year").alias("year_min"), F.max("year").alias("year_max"))
    lost = failed.agg(F.count("*").alias("n_failed_sites"))
    one = F.lit(1).alias("_k")
    return (
        head.withColumn("_k", one)
        .join(span.withColumn("_k", one), "_k")
        .join(lost.withColumn("_k", one), "_k")
        .drop("_k")
    )


def site_drilldown(yearly: DataFrame, sites: DataFrame) -> DataFrame:
    """Per site: pre-intervention span, first year after the end, any emissions."""
    ends = sites.select(
        "site_id",
        F.when(F.col("end_year") < OPEN_END_YEAR, F.col("end_year") + 1).alias("_post"),
    )
    pre = F.when(F.col("is_pre_intervention"), F.col("year"))
    emitted = (F.sum("treatment_emissions_mgco2e") > 0) | (F.sum("control_emissions_mgco2e") > 0)
    spans = yearly.groupBy("site_id").agg(
        F.min(pre).alias("pre_from"), F.max(pre).alias("pre_to"),
        F.count("*").alias("n_years"), emitted.alias("has_emissions"),
    )
    return spans.join(ends, "site_id").withColumnRenamed("_post", "post_from")
