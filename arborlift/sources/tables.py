"""Reading and writing the tables a run exchanges."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from arborlift.config import REQUIRED_MATCH_COLUMNS, require_columns
from arborlift.schema import FAILED_SITES, PAYLOAD
from arborlift.session import shared_folder, stage


def write_parquet(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def write_pixels(pixels: DataFrame, path: str) -> None:
    """Pixel table laid out by cell, so cell ranges prune row groups."""
    sorted_pixels = pixels.repartitionByRange("cell").sortWithinPartitions("cell")
    write_parquet(sorted_pixels, path)


BUCKETS = 64


def replace_rows(df: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    """Write rows, replacing earlier rows of the same keys only.

    Keys are hashed into a fixed number of folders, so their number does not
    grow with the keys, and a large folder is split over several tasks. The
    earlier rows of the folders touched are written again next to the new
    ones. A key without new rows keeps its earlier ones; a null key is a key
    like others. ``buckets`` must stay the same for a table.
    """
    spark = df.sparkSession
    rows = df.withColumn("key_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    if has_rows(spark, path):
        rows = stage(rows, "new-rows")
        touched = rows.select("key_bucket").distinct()  # at most one row for each folder
        new_keys = rows.select(F.col(key).alias("_new")).distinct()
        earlier = spark.read.option("mergeSchema", True).parquet(path).join(
            F.broadcast(touched), "key_bucket", "left_semi")
        kept = earlier.join(new_keys, F.col(key).eqNullSafe(F.col("_new")), "left_anti")
        rows = stage(rows.unionByName(kept, allowMissingColumns=True), "all-rows")
    rows.hint("rebalance", F.col("key_bucket")).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).option("compression", "zstd").partitionBy("key_bucket").parquet(path)


def has_rows(spark: SparkSession, path: str) -> bool:
    """Whether :func:`replace_rows` has written anything there."""
    folders = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/key_bucket=*")
    found = folders.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(folders)
    return found is not None and len(found) > 0


def write_matches(matches: DataFrame, path: str) -> None:
    """Match table in folders by site; only the sites given are replaced."""
    replace_rows(matches, path, "id_numeric")


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    """All match files; columns absent from older files read as NULL."""
    df = spark.read.option("mergeSchema", True).parquet(path).drop("key_bucket")
    require_columns(df.columns, REQUIRED_MATCH_COLUMNS, "match table")
    return df


def read_failures(spark: SparkSession, path: str) -> DataFrame:
    """Failure markers, one JSON document per file, with the file's name."""
    fields = FAILED_SITES.replace(", failure_marker_file string", "")
    return spark.read.schema(fields).option("multiLine", True).json(path).select(
        "*", F.col("_metadata.file_name").alias("failure_marker_file")
    )


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def read_csv(spark: SparkSession, path: str, schema: str, columns) -> DataFrame:
    """Typed CSV scan that parses only the columns asked for."""
    return spark.read.schema(schema).csv(path, header=True).select(*columns)


def replace_task(df: DataFrame, path: str) -> None:
    """Write result rows, replacing earlier rows of the same tasks only."""
    replace_rows(df, path, "task_id")


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def parse_payloads(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(task_id, payload text) to yearly rows and total rows."""
    doc = payloads.select("task_id", F.from_json("payload", PAYLOAD).alias("d"))

    def value(name: str):
        return F.col("e.values")[name].alias(name)

    yearly = doc.select("task_id", F.explode("d.time_series").alias("e")).select(
        "task_id", F.col("e.entity_id").alias("site_id"), F.col("e.year").alias("year"),
        *[value(v) for v in YEARLY_VALUES],
        F.coalesce("e.metadata.is_pre_intervention", F.lit(False)).alias("is_pre_intervention"),
        F.col("e.metadata.n_matched_pixels").alias("n_matched_pixels"),
        F.col("e.metadata.sampled_fraction").alias("sampled_fraction"),
    )
    totals = doc.select("task_id", F.explode("d.records").alias("e")).select(
        "task_id", F.col("e.entity_id").alias("site_id"),
        F.col("e.entity_name").alias("site_name"), *[value(v) for v in TOTAL_VALUES],
        F.col("e.metadata.n_matched_pixels").alias("n_matched_pixels"),
        F.col("e.metadata.sampled_fraction").alias("sampled_fraction"),
        F.col("e.period_start").alias("first_year"), F.col("e.period_end").alias("last_year"),
        F.col("e.metadata.n_years").alias("n_years"),
    )
    return yearly, totals


YEARLY_VALUES = (
    "forest_loss_avoided_ha", "emissions_avoided_mgco2e", "treatment_defor_ha",
    "control_defor_ha", "treatment_emissions_mgco2e", "control_emissions_mgco2e",
)
TOTAL_VALUES = ("forest_loss_avoided_ha", "emissions_avoided_mgco2e", "area_ha")


def _values(names):
    return F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))]).alias("values")


def time_series_entries(yearly: DataFrame) -> DataFrame:
    """(site_id, year, entry JSON) of the nested yearly part."""
    entry = F.struct(
        F.col("site_id").alias("entity_id"), F.col("year"), _values(YEARLY_VALUES),
        F.col("site_name").alias("entity_name"),
        F.struct("n_matched_pixels", "sampled_fraction", "is_pre_intervention").alias("metadata"),
    )
    return yearly.select("site_id", "year", F.to_json(entry).alias("entry"))


def record_entries(totals: DataFrame) -> DataFrame:
    entry = F.struct(
        F.col("site_id").alias("entity_id"), F.col("site_name").alias("entity_name"),
        _values(TOTAL_VALUES), F.col("first_year").alias("period_start"),
        F.col("last_year").alias("period_end"),
        F.struct("n_matched_pixels", "sampled_fraction", "n_years").alias("metadata"),
    )
    return totals.select("site_id", F.to_json(entry).alias("entry"))


# One document is given as ordered lines (section, key, line): written sorted,
# the part files read one after another are the document, and no task or
# driver ever holds it whole.

def _fixed(spark: SparkSession, section: int, line) -> DataFrame:
    text = line if not isinstance(line, str) else F.lit(line)
    return spark.range(1).select(
        F.lit(section).alias("section"), F.lit("").alias("key"), text.alias("line")
    )


def _items(items: DataFrame, section: int) -> DataFrame:
    """List members, each after the first led by a comma.

    Equal members of equal key share a line, so the first line is told by its
    content alone, also where keys repeat or are null (these come first).
    """
    lines = items.select(F.coalesce(F.col("key").cast("string"), F.lit("")).alias("key"), "entry").groupBy(
        "key", "entry").agg(F.count("*").alias("_n"))
    first = lines.agg(F.min(F.struct("key", "entry")).alias("_first"))
    comma = F.when(F.struct("key", "entry") == F.col("_first"), "").otherwise(",")
    repeated = F.array_join(F.array_repeat("entry", F.col("_n").cast("int")), ",")
    return lines.join(F.broadcast(first)).select(
        F.lit(section).alias("section"), "key", F.concat(comma, repeated).alias("line")
    )


def document(spark: SparkSession, pieces: list) -> DataFrame:
    """Lines of a document from fixed texts and (key, entry) tables in order."""
    out = None
    for section, piece in enumerate(pieces):
        part = _items(piece, section) if isinstance(piece, DataFrame) else _fixed(
            spark, section, piece
        )
        out = part if out is None else out.unionByName(part)
    return out


def write_document(lines: DataFrame, path: str) -> None:
    # of equal keys the one without a comma opens the list
    lines.orderBy("section", "key", F.col("line").startswith(",")).select("line").write.mode("overwrite").text(path)


def _feature(extra=()):
    coordinates = F.transform("geometry", lambda poly: F.transform(poly, lambda ring: F.transform(
        ring, lambda p: F.array(p["x"], p["y"])
    )))
    feature = F.struct(
        F.lit("Feature").alias("type"), *extra,
        F.struct(F.lit("MultiPolygon").alias("type"), coordinates.alias("coordinates"))
        .alias("geometry"),
        F.struct(
            "site_id", "site_name", F.date_format("start_date", "yyyy-MM-dd").alias("start_date"),
            F.date_format("end_date", "yyyy-MM-dd").alias("end_date"), "area_ha",
        ).alias("properties"),
    )
    return F.to_json(feature, {"ignoreNullFields": "false"})


def feature_lines(sites: DataFrame, position: str) -> DataFrame:
    """One GeoJSON feature per line, which many tasks can write and read."""
    return sites.select(_feature((F.col(position).alias("id"),)).alias("line"))


def feature_collection(sites: DataFrame) -> DataFrame:
    """GeoJSON FeatureCollection of sites ordered by id; no sites give ``[]``."""
    items = sites.select(F.col("site_id").alias("key"), _feature().alias("entry"))
    return document(
        sites.sparkSession, ['{"type":"FeatureCollection","features":[', items, "]}"]
    )


def _year_key():
    return F.concat("site_id", F.lit("|"), F.lpad(F.col("year").cast("string"), 6, "0"))


def analysis_payload(yearly: DataFrame, totals: DataFrame, summary_json: str,
                     name: str = "", analysis_type: str = "") -> DataFrame:
    """Nested result document: summary, records and time series."""
    records = record_entries(totals).select(F.col("site_id").alias("key"), "entry")
    series = time_series_entries(yearly).select(_year_key().alias("key"), "entry")
    head = f'{{"name":{json.dumps(name)},"analysis_type":{json.dumps(analysis_type)},"summary":'
    return document(yearly.sparkSession, [
        head + summary_json + ',"records":[', records, '],"time_series":[', series, "]}",
    ])


def run_summary_document(run: DataFrame, totals: DataFrame, failed: DataFrame,
                         subsampled: DataFrame, task_id: str, seed: int) -> DataFrame:
    """Summary of a run: its one-row totals, then sites and their exceptions."""
    spark = run.sparkSession
    head = run.select(F.to_json(F.struct(
        F.lit(task_id).alias("task_id"), F.lit(seed).alias("random_seed"),
        "n_sites", "n_failed_sites", "total_emissions_avoided_mgco2e",
        "total_forest_loss_avoided_ha", "total_area_ha",
        F.struct(F.col("year_min").alias("min"), F.col("year_max").alias("max"))
        .alias("year_range"),
    )).alias("j")).select(
        F.lit(0).alias("section"), F.lit("").alias("key"),
        F.concat(F.expr("substr(j, 1, length(j) - 1)"), F.lit(',"sites":[')).alias("line"),
    )

    def entries(df: DataFrame, columns) -> DataFrame:
        entry = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
        return df.select(F.col("site_id").alias("key"), entry.alias("entry"))

    site_columns = ("site_id", "site_name", "emissions_avoided_mgco2e", "forest_loss_avoided_ha",
                    "area_ha", "n_years")
    rest = document(spark, [
        entries(totals, site_columns), '],"failed_sites":[',
        entries(failed, ("id_numeric", "site_id", "site_name", "error")),
        '],"subsampled_sites":[',
        entries(subsampled, ("id_numeric", "site_id", "site_name", "sampled_fraction",
                             "sampled_percent")), "]}",
    ])
    return head.unionByName(rest.withColumn("section", F.col("section") + 1))


def document_members(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """List members of a written document, parsed by all tasks that read its parts.

    A member stands on a line of its own, equal ones share a line; lines around
    the lists begin or end with a bracket. Members of several lists have the
    fields of all in ``schema`` and are told apart by those they lack.
    """
    line = F.regexp_replace("value", "^,", "")
    members = F.from_json(F.concat(F.lit("["), line, F.lit("]")), f"array<struct<{schema}>>")
    lines = spark.read.text(path).filter(F.col("value").rlike(r"^,?\{.*\}$"))
    return lines.select(F.inline(members))


def document_head(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Fields of a written document that come before its first list."""
    head = spark.read.text(path).filter(F.col("value").rlike(r"^\{.*\[$"))
    return head.select(F.from_json(F.concat("value", F.lit("]}")), schema).alias("h")).select("h.*")


def value_key(df: DataFrame, columns) -> DataFrame:
    """Distinct attribute rows of a burned layer, ordered by the first column."""
    return df.select(*columns).distinct().orderBy(columns[0])


def work_path(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{shared_folder(spark).rstrip('/')}/arborlift/{name}-{uuid.uuid4().hex}"
