"""Layer history, tile manifests, inventory and layer profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from arborlift.config import DUAL_PURPOSE_VARS
from arborlift.functions.stats import quantiles

# States of a layer and of a task.
IN_PROGRESS = ("pending_merge", "merging")
TRACKED = ("pending_merge", "merging", "merged")
REUSABLE = ("exported", "merged", "failed")
STALE_MINUTES = 15
STALE_MESSAGE = "Merge was under way for too long and has been given up"
SNAPSHOT_MESSAGE = "Given up with its merge"
PERCENTILES = (1, 2, 5, 10, 25, 50, 75, 90, 95, 98, 99)
CATEGORICAL_LIMIT = 50
PROFILE_BINS = 20
BUCKET_DIGITS = 3
CATEGORY_LABELS = {
    "climate": "Climate", "terrain": "Terrain", "accessibility": "Accessibility",
    "demographics": "Demographics", "biomass": "Biomass", "land_cover": "Land Cover",
    "forest_cover": "Forest Cover", "ecological": "Ecological",
    "administrative": "Administrative",
}


def latest_record(registry: DataFrame, statuses=None) -> DataFrame:
    """Newest record of every layer; a record never started loses.

    The newest row is an aggregate, not a window, so a layer with a long
    history is combined map-side.
    """
    if statuses is not None:
        registry = registry.filter(F.col("status").isin(*statuses))
    rest = [c for c in registry.columns if c != "covariate_name"]
    started = F.coalesce(F.unix_micros(F.col("started_at").cast("timestamp")), F.lit(-(2**62)))
    rank = F.struct(started.alias("s"), (-F.col("id")).alias("i"))
    newest = registry.groupBy("covariate_name").agg(F.max_by(F.struct(*rest), rank).alias("r"))
    return newest.select("covariate_name", "r.*")


def stale_records(registry: DataFrame, now: Column) -> DataFrame:
    """Merges that started over 15 minutes ago and never ended."""
    cutoff = now - F.expr(f"INTERVAL {STALE_MINUTES} MINUTES")
    return registry.filter(F.col("status").isin(*IN_PROGRESS) & (F.col("started_at") < cutoff))


def reset_stale(registry: DataFrame, now: Column) -> DataFrame:
    """Registry in which stale merges have failed, with the time they were given up."""
    cutoff = now - F.expr(f"INTERVAL {STALE_MINUTES} MINUTES")
    stale = F.coalesce(
        F.col("status").isin(*IN_PROGRESS) & (F.col("started_at") < cutoff), F.lit(False)
    )
    return registry.withColumns(_failed(registry, stale, STALE_MESSAGE, "completed_at", now))


def reset_snapshots(snapshots: DataFrame, registry: DataFrame, now: Column) -> DataFrame:
    """Snapshots in which the open ones of stale merges have failed too.

    ``registry`` is the one before :func:`reset_stale`; snapshots name their
    record by ``covariate_id``. Snapshots that have ended stay as they are.
    """
    given_up = stale_records(registry, now).select(
        F.col("id").alias("covariate_id"), F.lit(True).alias("_given_up")
    ).distinct()
    open_one = F.coalesce(F.col("status").isin(*IN_PROGRESS) & F.col("_given_up"), F.lit(False))
    return snapshots.join(given_up, "covariate_id", "left").withColumns(
        _failed(snapshots, open_one, SNAPSHOT_MESSAGE, "merge_completed_at", now)
    ).select(*dict.fromkeys([*snapshots.columns, "error_message", "merge_completed_at"]))


def _failed(df: DataFrame, which: Column, message: str, ended: str, now: Column) -> dict:
    def kept(name: str) -> Column:
        return F.col(name) if name in df.columns else F.lit(None)

    return {
        "error_message": F.when(which, message).otherwise(kept("error_message")),
        ended: F.when(which, now).otherwise(kept(ended)),
        "status": F.when(which, "failed").otherwise(F.col("status")),
    }


def ready_layers(registry: DataFrame) -> DataFrame:
    """Layers a run may use: merged with a location, no cover years, plus the burned ones."""
    merged = latest_record(registry).filter(
        (F.col("status") == "merged")
        & (F.coalesce("merged_url", F.lit("")) != "")
        & ~F.col("covariate_name").startswith("fc_")
    ).select("covariate_name")
    always = F.explode(F.array(*[F.lit(v) for v in DUAL_PURPOSE_VARS])).alias("covariate_name")
    spark = registry.sparkSession
    return merged.union(spark.range(1).select(always)).distinct()


def tif_objects(listing: DataFrame) -> DataFrame:
    return listing.filter(F.col("name").endswith(".tif"))


def tile_counts(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("covariate_name").agg(
        F.count("*").alias("n_tiles"), F.sum("size_bytes").alias("total_bytes")
    )


def tile_fingerprint(manifest: DataFrame) -> DataFrame:
    """16 hex digits that change when any tile of the layer does.

    A tree of two levels: tiles go by the hash of their name into 4096
    buckets, each bucket has a digest of its sorted tiles, and the layer's
    digest is over those of its buckets. So no row holds all tiles of a layer,
    and a hot layer spreads over its buckets. A tile listed twice counts once.
    """
    entry = F.concat_ws(
        ":", "name", F.coalesce("etag", F.lit("")), F.col("size_bytes").cast("string")
    )
    bucket = F.substring(F.md5(F.coalesce("name", F.lit(""))), 1, BUCKET_DIGITS)

    def digest(items: Column) -> Column:
        return F.sha2(F.array_join(F.array_sort(items), "|"), 256)

    leaves = manifest.groupBy("covariate_name", bucket.alias("_bucket")).agg(
        digest(F.collect_set(entry)).alias("_digest")
    )
    return leaves.groupBy("covariate_name").agg(
        F.substring(digest(F.collect_list(F.concat("_bucket", "_digest"))), 1, 16)
        .alias("tile_etag_hash")
    )


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    """Fingerprint of the newest snapshot whose merge ended well."""
    good = snapshots.filter(
        F.col("status").isin("merged", "skipped_existing") & F.col("tile_etag_hash").isNotNull()
    )
    return good.groupBy("covariate_name").agg(
        F.max_by("tile_etag_hash", F.struct("created_at", "tile_etag_hash")).alias("last_hash")
    )


def changed_layers(fingerprints: DataFrame, latest: DataFrame, in_progress: DataFrame) -> DataFrame:
    """Layers whose tiles differ from the last merge and are not being merged."""
    joined = fingerprints.join(latest, "covariate_name", "left")
    differs = ~F.col("tile_etag_hash").eqNullSafe(F.col("last_hash"))
    return joined.filter(differs).join(
        in_progress.select("covariate_name"), "covariate_name", "left_anti"
    )


def longest_name(files: DataFrame, names: DataFrame) -> DataFrame:
    """Match each file to the longest known name it starts with.

    A file belongs to a name if it is the name plus ``.tif`` or goes on with a
    digit. Every file lists its possible names - its prefixes that end there -
    so this is an equality join, whatever the number of names.
    """
    stem = F.length("file")
    ends = F.filter(
        F.sequence(F.lit(1), stem),
        lambda i: F.substr(F.col("file"), i + 1, F.lit(1)).rlike("[0-9]")
        | (F.substr(F.col("file"), i + 1) == ".tif"),
    )
    options = files.withColumn("_n", F.explode(ends)).withColumn(
        "name", F.substr(F.col("file"), F.lit(1), F.col("_n"))
    )
    hits = options.join(names.select("name").distinct(), "name")
    return hits.groupBy("file").agg(F.max_by("name", "_n").alias("name"))


def inventory(catalog: DataFrame, tiles: DataFrame, store: DataFrame, latest: DataFrame):
    """One row per catalogued layer with its tiles, stored object and state.

    ``tiles``: covariate_name, n_tiles; ``store``: covariate_name, url, size.
    """
    labels = F.create_map(*[F.lit(x) for kv in CATEGORY_LABELS.items() for x in kv])
    joined = (
        catalog.join(tiles, "covariate_name", "left")
        .join(store, "covariate_name", "left")
        .join(latest, "covariate_name", "left")
    )
    size = F.when(F.col("size_bytes") != 0, F.col("size_bytes"))
    return joined.select(
        "covariate_name",
        F.coalesce(labels[F.col("category")], F.col("category")).alias("category"),
        F.coalesce("n_tiles", F.lit(0)).alias("gcs_tiles"),
        F.col("url").isNotNull().alias("on_s3"),
        F.coalesce("status", F.lit("")).alias("status"),
        size_mb(F.coalesce(size, F.col("size"))).alias("size_mb"),
        F.coalesce(F.when(F.col("merged_url") != "", F.col("merged_url")), F.col("url"),
                   F.lit("")).alias("merged_url"),
        F.coalesce(F.date_format("started_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(""))
        .alias("started_at"),
    )


def inventory_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("*").alias("n_total"),
        F.count_if(F.col("gcs_tiles") > 0).alias("n_on_source"),
        F.count_if("on_s3").alias("n_on_store"),
    )


def size_mb(size_bytes: Column) -> Column:
    return F.round(size_bytes / (1024 * 1024), 1)


def reference_counts(sets: DataFrame, tasks: DataFrame) -> DataFrame:
    used = tasks.groupBy("site_set_id").agg(F.count("*").alias("n"))
    return sets.join(used, "site_set_id", "left").select(
        "site_set_id", F.coalesce("n", F.lit(0)).alias("n_tasks"),
        F.col("n").isNull().alias("can_delete"),
    )


def untracked(found: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return found.join(known.select(key), key, "left_anti")


def untracked_runs(runs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Runs whose id no task holds; tasks store it behind ``api:``."""
    known = tasks.filter(F.col("extract_job_id").startswith("api:")).select(
        F.substr("extract_job_id", F.lit(5)).alias("run_id")
    )
    return runs.filter(F.coalesce("run_id", F.lit("")) != "").join(known, "run_id", "left_anti")


def _valid(values: DataFrame, nodata: float | None) -> DataFrame:
    value = F.col("value").cast("double")
    missing = F.isnan(value) if nodata is None else (value == nodata)
    return values.select("layer", F.when(~missing, value).alias("x"))


def layer_quantiles(values: DataFrame, nodata: float | None = None) -> DataFrame:
    q = quantiles(_valid(values, nodata), ["layer"], "x", [p / 100 for p in PERCENTILES])
    return q.groupBy("layer").agg(*[
        F.max(F.when(F.col("p") == p / 100, F.col("quantile"))).alias(f"p{p}") for p in PERCENTILES
    ])


def layer_profile(values: DataFrame, nodata: float | None = None) -> DataFrame:
    """Counts, moments, exact percentiles and a categorical flag per layer."""
    valid = _valid(values, nodata)
    stats = valid.groupBy("layer").agg(
        F.count("*").alias("total"), F.count("x").alias("valid"),
        F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"),
        F.stddev_pop("x").alias("std"), F.count_if(F.col("x") == 0).alias("zeros"),
    )
    distinct = valid.filter("x IS NOT NULL").distinct().groupBy("layer").agg(
        F.count("*").alias("n_distinct")
    )
    return (
        stats.join(distinct, "layer").join(layer_quantiles(values, nodata), "layer")
        .select(
            "layer", "total", "valid",
            F.round(1 - F.col("valid") / F.col("total"), 4).alias("nodata_fraction"),
            "min", "max", "mean", "std", F.col("p50").alias("median"),
            *[f"p{p}" for p in PERCENTILES],
            F.round(F.col("zeros") / F.col("valid"), 4).alias("zero_fraction"),
            "n_distinct", (F.col("n_distinct") <= CATEGORICAL_LIMIT).alias("is_categorical"),
        )
    )


def layer_histogram(values: DataFrame, nodata: float | None = None) -> DataFrame:
    """20 bins between the 1st and 99th percentile of every layer."""
    ends = layer_quantiles(values, nodata).select(
        "layer", F.col("p1").alias("lo"), F.col("p99").alias("hi")
    ).filter("lo <> hi")
    place = F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * PROFILE_BINS)
    hits = (
        _valid(values, nodata).join(F.broadcast(ends), "layer")
        .filter((F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi")))
        .withColumn("bin", F.least(place.cast("int"), F.lit(PROFILE_BINS - 1)))
        .groupBy("layer", "bin").agg(F.count("*").alias("n"))
    )
    bins = F.explode(F.sequence(F.lit(0), F.lit(PROFILE_BINS - 1))).alias("bin")
    frame = ends.select("layer", "lo", "hi", bins)
    return frame.join(hits, ["layer", "bin"], "left").select(
        "layer", "bin",
        F.round(F.col("lo") + (F.col("hi") - F.col("lo")) / PROFILE_BINS * F.col("bin"), 4)
        .alias("bin_start"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def array_index(treatment_key: DataFrame) -> DataFrame:
    """0-based position of every site in order of its first treated cell."""
    first = treatment_key.groupBy("id_numeric").agg(F.min("cell").alias("_first"))
    from arborlift.functions.stats import value_bucket, with_rank

    ranked = with_rank(
        first.withColumn("_one", F.lit(1)), ["_one"], ["_first"],
        value_bucket(F.col("_first").cast("double")), "array_index",
    )
    return ranked.select("id_numeric", "array_index")


def by_newest(rows: DataFrame, column: str, *ties: str) -> DataFrame:
    return rows.orderBy(F.desc(column), *ties)


