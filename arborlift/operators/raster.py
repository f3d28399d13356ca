"""Raster algebra on pixel tables: resampling, mosaics, derived layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from arborlift.session import stage, tasks_for

# Land cover codes per class, in the order they are tested.
LAND_COVER = {
    "forest": (111, 112, 113, 114, 115, 116, 121, 122, 123, 124, 125, 126),
    "grassland": (20, 30),
    "agriculture": (40,),
    "wetlands": (90,),
    "artificial": (50,),
    "other": (60, 70, 100),
    "water": (80, 200),
}
# The alternative 300 m land cover legend.
LAND_COVER_ALTERNATIVE = {
    "forest": (50, 60, 61, 62, 70, 71, 72, 80, 81, 82, 90, 100, 160, 170),
    "grassland": (110, 120, 121, 122, 130, 140),
    "agriculture": (10, 11, 12, 20, 30, 40),
    "wetlands": (180,),
    "artificial": (190,),
    "other": (150, 151, 152, 153, 200, 201, 202),
    "water": (210,),
}
CROPLAND_YEARS = (2003, 2007, 2011, 2015, 2019)
COVER_YEARS = range(2000, 2025)
POPULATION_YEARS = (2000, 2005, 2010, 2015, 2020)
RESAMPLERS = ("mean", "sum", "mode")


def resample(fine: DataFrame, factor: int, how: str, value: str = "value") -> DataFrame:
    """Fine (row, col, value) to cells ``factor`` times as wide.

    The mode counts values first, so it is combined map-side like mean and
    sum; the smaller value wins a tie.
    """
    if how not in RESAMPLERS:
        raise ValueError(f"unknown resampling {how}")
    key = [F.floor(F.col(c) / factor).alias(c) for c in ("row", "col")]
    if how == "mode":
        counts = fine.filter(F.col(value).isNotNull()).groupBy(*key, value).agg(
            F.count("*").alias("_n")
        )
        return counts.groupBy("row", "col").agg(
            F.max_by(value, F.struct("_n", (-F.col(value)).alias("v"))).alias(value)
        )
    agg = F.avg(value) if how == "mean" else F.sum(value)
    return fine.groupBy(*key).agg(agg.alias(value))


def mosaic(tiles: DataFrame, order: str, value: str = "value") -> DataFrame:
    """Tiles over one grid; the last in ``order`` wins, nodata never does."""
    valid = tiles.filter(F.col(value).isNotNull())
    return valid.groupBy("row", "col").agg(F.max_by(value, order).alias(value))


def of_year(collection: DataFrame, year: int) -> DataFrame:
    return collection.filter(F.col("year") == year)


def merge_tiles(tiles: DataFrame, order: str) -> DataFrame:
    """Tiles of many layers to one value per (layer, cell)."""
    valid = tiles.filter(F.col("value").isNotNull())
    return valid.groupBy("layer", "cell").agg(F.max_by("value", order).alias("value"))


def population_growth(first: Column, last: Column, years: int = 20) -> Column:
    """Yearly compound growth; 0 where nobody lived at first."""
    return F.when(first == 0, 0.0).otherwise(F.pow(last / first, F.lit(1.0 / years)) - 1)


def forest_cover(cover_2000: Column, loss_year: Column, year: int) -> Column:
    """Cover left in ``year``: none where loss came by then; gain is not added."""
    lost = (loss_year > 0) & (loss_year <= year - 2000)
    return F.when(lost, 0.0).otherwise(cover_2000.cast("double"))


def cover_columns(pixels: DataFrame, years=COVER_YEARS) -> DataFrame:
    """Add ``fc_<year>`` for every year in one projection."""
    return pixels.withColumns({
        f"fc_{y}": forest_cover(F.col("treecover2000"), F.col("lossyear"), y) for y in years
    })


def class_area(code: Column, pixel_ha: Column, land_class: str, legend=LAND_COVER) -> Column:
    """Hectares of a class in a pixel: the whole pixel or nothing."""
    if land_class not in legend:
        raise ValueError(f"unknown land cover class {land_class}")
    return F.when(code.isin(*legend[land_class]), pixel_ha).otherwise(0.0)


def land_cover_areas(fine: DataFrame, factor: int, legend=LAND_COVER) -> DataFrame:
    """Hectares of every class per coarse cell, in one aggregation."""
    areas = [
        F.sum(class_area(F.col("code"), F.col("area_ha"), c, legend)).alias(f"lc_2015_{c}")
        for c in legend
    ]
    key = [F.floor(F.col(c) / factor).alias(c) for c in ("row", "col")]
    return fine.groupBy(*key).agg(*areas)


def land_cover_class(code: Column, legend=LAND_COVER_ALTERNATIVE) -> Column:
    out = F.lit(None).cast("string")
    for name, codes in legend.items():
        out = F.when(code.isin(*codes), name).otherwise(out)
    return out


def cropland_share(fine: DataFrame, factor: int, year: int) -> DataFrame:
    if year not in CROPLAND_YEARS:
        raise ValueError(f"cropland year must be one of {CROPLAND_YEARS}")
    return resample(of_year(fine, year), factor, "mean").withColumnRenamed(
        "value", f"cropland_{year}"
    )


BLOCK = 64


def gradient(elevation: DataFrame, spacing_m: Column, north_m: Column | None = None) -> DataFrame:
    """East and north gradient of a 3 x 3 neighbourhood (third-order weights).

    The grid is staged, counted and dealt out once, in blocks of 64 x 64 cells; only cells on the
    rim of a block go to the next block too, about 1.06 rows a cell. Inside a
    block, frames of one row or column look at the neighbours, so nothing is
    shuffled again and any grid size spreads evenly.

    ``spacing_m`` is the width of a cell, ``north_m`` its height (the width if
    not given); both may be expressions of ``row``, as widths shrink towards
    the poles. A gradient is NULL where one of its neighbours is missing. Of
    cells given twice the higher counts; cells without place or value are
    left out.
    """
    def blocks(place: str) -> Column:
        near = [F.floor((F.col(place) + step) / BLOCK) for step in (-1, 1)]
        return F.explode(F.sequence(*near))

    block = ["_down", "_across"]
    known = stage(
        elevation.filter("row IS NOT NULL AND col IS NOT NULL AND elevation IS NOT NULL")
        .select("row", "col", "elevation"), "elevation"
    )
    cells = (
        known.withColumn("_down", blocks("row")).withColumn("_across", blocks("col"))
        .repartition(tasks_for(known.count()), *block).groupBy(*block, "row", "col").agg(F.max("elevation").alias("self"))
    )
    by_row = Window.partitionBy(*block, "col").orderBy("row")
    by_col = Window.partitionBy(*block, "row").orderBy("col")

    def beside(name: str, window, step: int) -> Column:
        return F.max(name).over(window.rangeBetween(step, step))

    # a corner counts with the side next to it: a gradient needs both
    seen = cells.withColumns({
        "n": beside("self", by_row, -1), "s": beside("self", by_row, 1),
    }).withColumns({
        "w": beside("self", by_col, -1), "e": beside("self", by_col, 1),
        "w_n": beside("n", by_col, -1), "w_s": beside("s", by_col, -1),
        "e_n": beside("n", by_col, 1), "e_s": beside("s", by_col, 1),
    }).withColumns({
        "n_w": beside("w", by_row, -1), "n_e": beside("e", by_row, -1),
        "s_w": beside("w", by_row, 1), "s_e": beside("e", by_row, 1),
    })
    c = F.col
    east = (c("e_n") + c("e") * 2 + c("e_s")) - (c("w_n") + c("w") * 2 + c("w_s"))
    north = (c("n_w") + c("n") * 2 + c("n_e")) - (c("s_w") + c("s") * 2 + c("s_e"))
    own = (F.floor(c("row") / BLOCK) == c("_down")) & (F.floor(c("col") / BLOCK) == c("_across"))
    return seen.filter(own).select(
        "row", "col", (east / 8 / spacing_m).alias("dx"),
        (north / 8 / (spacing_m if north_m is None else north_m)).alias("dy"),
    )


def slope(elevation: DataFrame, spacing_m: Column, north_m: Column | None = None) -> DataFrame:
    g = gradient(elevation, spacing_m, north_m)
    steep = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    return g.select("row", "col", F.degrees(F.atan(steep)).alias("slope"))


def aspect(elevation: DataFrame, spacing_m: Column, north_m: Column | None = None) -> DataFrame:
    """Direction the slope faces, clockwise from north; 0 where flat."""
    g = gradient(elevation, spacing_m, north_m)
    angle = F.degrees(F.atan2(-F.col("dx"), -F.col("dy"))) + 360
    turn = angle - F.floor(angle / 360) * 360
    flat = (F.col("dx") == 0) & (F.col("dy") == 0)
    known = F.col("dx").isNotNull() & F.col("dy").isNotNull()
    return g.select(
        "row", "col", F.when(known, F.when(flat, 0.0).otherwise(turn)).alias("aspect")
    )


def passthrough(source: DataFrame, band: str, name: str) -> DataFrame:
    return source.select("row", "col", F.col(band).cast("float").alias(name))


# Fixed values: (name, category, resampling, derivation) of the single layers.
SINGLE_LAYERS = (
    ("precip", "climate", "mean", None),
    ("temp", "climate", "mean", None),
    ("elev", "terrain", "mean", None),
    ("slope", "terrain", "mean", "slope"),
    ("aspect", "terrain", "mean", "aspect"),
    ("dist_cities", "accessibility", "mean", None),
    ("friction_surface", "accessibility", "mean", "friction_surface"),
    ("pop_growth", "demographics", "mean", "pop_growth"),
    ("total_biomass", "biomass", "mean", "total_biomass"),
    ("aez", "ecological", "mode", "aez"),
)
DEFAULT_COVARIATES = (
    "lc_2015_agriculture", "precip", "temp", "elev", "slope", "dist_cities", "friction_surface",
    "pop_2015", "pop_growth", "total_biomass",
)
CATALOG_SCHEMA = "covariate_name string, category string, resample string, derived string, year int"


def catalog_rows() -> list[tuple]:
    """The 52 layer definitions, the yearly families built by rule."""
    rows = [(*layer, None) for layer in SINGLE_LAYERS]
    rows += [(f"pop_{y}", "demographics", "sum", None, y) for y in POPULATION_YEARS]
    rows += [(f"lc_2015_{c}", "land_cover", "sum", "lc_class", None) for c in LAND_COVER]
    rows += [(f"fc_{y}", "forest_cover", "mean", "hansen_fc", y) for y in COVER_YEARS]
    rows += [(f"cropland_{y}", "cropland", "mean", "glad_cropland", y) for y in CROPLAND_YEARS]
    return rows


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(catalog_rows(), CATALOG_SCHEMA)


def select_catalog(layers: DataFrame, names=None, category: str | None = None) -> DataFrame:
    """Layers by name, by category, or all; unknown names raise."""
    if names is not None:
        known = {r.covariate_name for r in layers.select("covariate_name").filter(
            F.col("covariate_name").isin(*names)).collect()}
        unknown = sorted(set(names) - known)
        if unknown:
            raise ValueError(f"unknown layers: {unknown}")
        return layers.filter(F.col("covariate_name").isin(*names))
    return layers if category is None else layers.filter(F.col("category") == category)
