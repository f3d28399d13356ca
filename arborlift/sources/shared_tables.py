"""Sites, pixels, matches and feeds derived from the shared benchmark tables.

The shared tables carry no geography, so a supplier stands for a site, one
(order, line) pair for a pixel, and a pixel whose line was returned for a
treated pixel. Everything is plain column arithmetic over whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

YEARS = tuple(range(2000, 2013))
COVARIATES = ("precip", "elev", "pop_2015", "dist_cities")
EXACT = ("admin1", "ecoregion", "pa")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = 2003 + F.col("s_nationkey") % 8
    return table(spark, sf_dir, "supplier").select(
        (F.col("s_suppkey") + 1).cast("int").alias("id_numeric"),
        _site_id(F.col("s_suppkey")).alias("site_id"),
        F.col("s_name").alias("site_name"),
        start.cast("int").alias("start_year"),
        F.when(F.col("s_acctbal") < 2000, start + 3).otherwise(2099).cast("int").alias("end_year"),
        (F.lit(100) + F.floor(F.col("s_acctbal") / 10)).cast("double").alias("area_ha"),
    )


def _site_id(suppkey: Column) -> Column:
    return F.concat(F.lit("S"), F.lpad(suppkey.cast("string"), 12, "0"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per cell with covariates, strata and yearly forest cover."""
    line = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey", "l_linenumber")
        .agg(
            F.max("l_suppkey").alias("supp"),
            F.max("l_partkey").alias("part"),
            F.max("l_quantity").alias("qty"),
            F.max("l_tax").alias("tax"),
            F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("returned"),
            F.max(F.when(F.col("l_linestatus") == "O", 1).otherwise(0)).alias("pa"),
        )
        .withColumn("cell", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    )
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("admin1"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    # one small table after the other: joined with each other first, they would
    # look larger than the pixels and the pixels would be broadcast
    base = (
        line.join(supplier, F.col("supp") == F.col("s_suppkey"))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(part, F.col("part") == F.col("p_partkey"))
    )
    treated = F.col("returned") == 1
    size = F.col("p_size")
    out = base.select(
        "cell",
        F.when(treated, F.col("supp") + 1).cast("int").alias("id_numeric"),
        (F.col("supp") + 1).cast("int").alias("near_site"),
        ((F.col("cell") % 16 + 600) / 7.1).alias("area_ha"),
        "admin1",
        F.when(size == 50, None).when(size < 17, 0).when(size < 34, 1).otherwise(2).cast("int")
        .alias("ecoregion"),
        "pa",
        (F.col("p_retailprice") * 2 / 7.0).alias("precip"),
        (size * 50 / 7.0).alias("elev"),
        F.when(F.col("qty") != 50, F.col("qty") / 7.0).alias("pop_2015"),
        (F.col("tax") * 100 / 7.0).alias("dist_cities"),
        ((size * 3 + 50) / 7.1).alias("total_biomass"),
        F.when(size == 1, 0).otherwise(40 + F.col("cell") % 61).cast("double").alias("_fc0"),
        ((F.col("cell") % 7) * 0.5 * F.when(treated, 0.5).otherwise(1.0)).alias("_loss"),
    )
    cover = [
        F.greatest(F.lit(0.0), F.col("_fc0") - F.col("_loss") * (y - 2000)).alias(f"fc_{y}")
        for y in YEARS
    ]
    return out.select([c for c in out.columns if not c.startswith("_")] + cover)


def treatment_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir).filter("id_numeric IS NOT NULL")
    return px.select(
        "cell", "id_numeric", "area_ha", _site_id(F.col("id_numeric") - 1).alias("site_id")
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixel table as extraction leaves it: no treatment columns yet."""
    return pixels(spark, sf_dir).drop("id_numeric", "near_site")


def unweighted_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels grouped into match sets around every site, before weighting."""
    px = pixels(spark, sf_dir).filter("ecoregion IS NOT NULL")
    area = sites(spark, sf_dir).select(
        F.col("id_numeric").alias("near_site"), F.col("area_ha").alias("site_area"), "start_year"
    )
    px = px.join(area, "near_site")
    group = F.concat_ws(".", "admin1", "ecoregion", "pa")
    return px.select(
        "cell",
        F.col("near_site").alias("id_numeric"),
        _site_id(F.col("near_site") - 1).alias("site_id"),
        F.col("id_numeric").isNotNull().alias("treatment"),
        group.alias("group"),
        F.concat(group, F.lit(":"), F.floor(F.col("cell") / 8) % 12).alias("match_group"),
        "area_ha",
        *COVARIATES,
        "total_biomass",
        F.when(F.col("site_area") > 600, 0.5).otherwise(1.0).alias("sampled_fraction"),
        F.when(
            ~((F.col("pa") == 1) & (F.col("ecoregion") == 2)),
            (F.col("elev") + F.coalesce("pop_2015", F.lit(25.0))) / 401.3,
        ).alias("pscore"),
        *[f"fc_{y}" for y in YEARS],
    )


def matches(spark: SparkSession, sf_dir: str, *only: str) -> DataFrame:
    """Weighted match sets. Of few columns, given in ``only``, the rows are written once rather than worked out twice."""
    from arborlift.operators.pairing import SET_KEY, with_match_weights
    from arborlift.session import stage

    rows = unweighted_matches(spark, sf_dir)
    if only:
        rows = stage(rows.select(*SET_KEY, "treatment", *only), "unweighted-matches")
    return with_match_weights(rows)


def layer_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long (layer, value) samples of numeric columns, with nodata at -9999."""
    line = table(spark, sf_dir, "lineitem")
    cols = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return line.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("layer"), F.col(c).alias("v")) for c in cols]))
    ).select(
        "layer",
        F.when((F.col("layer") == "l_quantity") & (F.col("v") == 13), -9999.0)
        .otherwise(F.col("v")).alias("value"),
    )


def grid_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fine grid (row, col, value, code): one cell per (order, line)."""
    return pixels(spark, sf_dir).select(
        F.floor(F.col("cell") / 100).alias("row"),
        (F.col("cell") % 100).alias("col"),
        F.col("elev").alias("value"),
        F.col("pa").alias("code"),
    )


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layer history: one event is one record of the layer 'user_id'."""
    status = F.create_map(*[F.lit(v) for pair in EVENT_STATUS.items() for v in pair])
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        layer_name(F.col("user_id")).alias("covariate_name"),
        status[F.col("event_type")].alias("status"),
        F.when(F.col("value") > 5, F.concat(F.lit("u/"), F.col("event_id").cast("string")))
        .alias("merged_url"),
        F.when(F.col("value") > 2, F.col("value") * 100000).alias("size_bytes"),
        F.when(F.col("event_type") != "signup", F.col("ts")).cast("timestamp")
        .alias("started_at"),
    )


# How shared event types stand for layer states.
EVENT_STATUS = {
    "view": "exporting",
    "click": "exported",
    "purchase": "merged",
    "signup": "pending_merge",
    "error": "failed",
}


def layer_name(user_id: Column) -> Column:
    return F.concat(F.when(user_id < 40, "fc_").otherwise("layer_"), user_id.cast("string"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Object listing: one page is one tile object of the layer in its path."""
    return manifest_rows(table(spark, sf_dir, "pages"))


def manifest_rows(pages: DataFrame) -> DataFrame:
    return pages.select(
        F.concat(F.regexp_replace("url", "[?#].*$", ""), F.lit(".tif")).alias("name"),
        F.regexp_extract("url", "://([^/.]+)[.]", 1).alias("covariate_name"),
        F.md5("html").alias("etag"),
        F.length("html").cast("bigint").alias("size_bytes"),
        F.col("page_id").cast("string").alias("updated"),
    )


# Corners of the derived polygons, in units of their radius.
OUTER = ((-1.0, 0.1), (-0.5, -0.9), (0.6, -0.8), (1.0, 0.2), (0.4, 0.9), (-0.6, 0.7))
HOLE = ((-0.3, 0.05), (0.02, -0.35), (0.33, 0.03), (0.04, 0.31))


def site_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hexagon with a hole for every supplier; neighbours overlap."""
    lon = F.lit(10.00123) + F.col("s_nationkey") * 0.11
    lat = F.lit(5.00217) + F.col("s_acctbal") / 20000
    radius = F.lit(0.0311) + (F.col("s_suppkey") % 7) * 0.0101

    def ring(corners):
        return F.array(*[
            F.struct((lon + radius * dx).alias("x"), (lat + radius * dy).alias("y"))
            for dx, dy in corners
        ])

    return table(spark, sf_dir, "supplier").select(
        (F.col("s_suppkey") + 1).cast("int").alias("id_numeric"),
        _site_id(F.col("s_suppkey")).alias("site_id"),
        F.col("s_nationkey").alias("zone"),
        F.array(F.array(ring(OUTER), ring(HOLE))).alias("geometry"),
    )
