"""Status and manifest feeds as Structured Streaming jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from arborlift.operators import registry
from arborlift.session import stage

FINAL = ("merged", "exported", "failed", "cancelled", "succeeded")


def latest_status(feed: DataFrame) -> DataFrame:
    """Newest status per key with its start and end stamps.

    ``feed`` has ``key, status, ts, id``. The same aggregation serves batch
    and stream: in a stream its state is one small row per key.
    """
    done = F.col("status").isin(*FINAL)
    return feed.groupBy("key").agg(
        F.max_by("status", F.struct("ts", "id")).alias("status"),
        F.min("ts").alias("started_at"),
        F.max(F.when(done, F.col("ts"))).alias("completed_at"),
        F.count("*").alias("n_changes"),
    )


#: Batches between two compactions of the status table.
COMPACT_EVERY = 16


def _newest(log: DataFrame) -> DataFrame:
    """The row of every key's last batch."""
    rest = [c for c in log.columns if c not in ("key", "slot")]
    return log.groupBy("key").agg(F.max_by(F.struct(*rest), "number").alias("r")).select("key", "r.*")


def _keep_status(table: str, every: int):
    """Write a batch into its slot; now and then fold what is there into one base.

    Slots are used again after two compactions, when the base holds their rows,
    so the table has a fixed number of folders and at most a row per key in
    each. There are two bases by turns and a batch never reads what it writes:
    a repeated batch does the same again.
    """
    def write(batch: DataFrame, number: int) -> None:
        if number and number % every == 0:
            turn = number // every
            log = batch.sparkSession.read.parquet(table).filter(F.col("slot") != _base(turn, every)).filter(
                F.col("number") < number)
            _newest(log).write.mode("overwrite").parquet(f"{table}/slot={_base(turn, every)}")
        batch.withColumn("number", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(
            f"{table}/slot={number % (2 * every)}")
    return write


def _base(turn: int, every: int) -> int:
    return 2 * every + turn % 2


def run_status_stream(feed: DataFrame, table: str, checkpoint: str, every: int = COMPACT_EVERY) -> None:
    """Keep the newest status per key; each batch adds only changed keys."""
    stream = latest_status(feed).writeStream.outputMode("update").foreachBatch(
        _keep_status(table, every)
    ).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()


def read_status(spark: SparkSession, table: str) -> DataFrame:
    """Current status of every key; what a base has replaced is older than it and loses."""
    return _newest(spark.read.parquet(table)).drop("number")


LISTING = "listing bigint, n_objects bigint, name string, covariate_name string, etag string, size_bytes bigint"
CURRENT = "listing bigint, covariate_name string, tile_etag_hash string"


def run_manifest_stream(listing: DataFrame, table: str, checkpoint: str) -> None:
    """Record how layers change from one complete listing to the next.

    Every row of ``listing`` names its listing and how many objects that has
    (``LISTING``); a listing counts once all of them are in, over however many
    batches they came. Complete listings are compared in the order of their
    numbers, the first with the last one of earlier batches; one older than
    that no longer counts. Rows of ``table/changes`` have the listing, the
    layer, its fingerprint and whether it is ``new``, ``changed`` or
    ``removed``. What is carried along - the last fingerprints and the rows of
    listings still open - does not grow with the number of batches.
    """
    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession

        def carried(name: str, schema: str) -> DataFrame:
            if number == 0:
                return spark.createDataFrame([], schema)
            return spark.read.schema(schema).parquet(f"{table}/{name}/{(number - 1) % 2}")

        def carry(df: DataFrame, name: str) -> DataFrame:
            path = f"{table}/{name}/{number % 2}"
            df.write.mode("overwrite").parquet(path)
            return spark.read.schema(df.schema).parquet(path)

        columns = [c.split()[0] for c in LISTING.split(", ")]
        last = carried("last", "last bigint")
        rows = stage(
            carried("open", LISTING).unionByName(batch.select(columns)).join(
                F.broadcast(last), F.col("listing") <= F.col("last"), "left_anti"), "listing-rows")
        counts = rows.groupBy("listing").agg(
            F.count("*").alias("n"), F.max("n_objects").alias("n_objects")).filter("n >= n_objects")
        ready = stage(counts.select("listing").withColumn(
            # one row for each listing of the batch
            "place", F.row_number().over(Window.orderBy("listing"))), "listings")
        carry(rows.join(ready.agg(F.max("listing").alias("last")), F.col("listing") <= F.col("last"), "left_anti"), "open")

        tiles = registry.tif_objects(rows.join(F.broadcast(ready), "listing")).withColumnsRenamed({"covariate_name": "layer"})
        now = registry.tile_fingerprint(
            tiles.withColumn("covariate_name", F.struct("layer", "listing", "place"))
        ).select("covariate_name.*", "tile_etag_hash")
        before = carried("current", CURRENT).select(
            F.col("covariate_name").alias("layer"), "listing", F.lit(0).alias("place"), "tile_etag_hash")
        prints = stage(now.unionByName(before), "fingerprints")
        earlier = prints.select("layer", (F.col("place") + 1).alias("place"), F.col("tile_etag_hash").alias("was")).join(
            F.broadcast(ready.select("place")), "place", "left_semi")
        both = prints.filter("place > 0").join(earlier, ["layer", "place"], "full")
        change = F.when(F.col("was").isNull(), "new").when(F.col("tile_etag_hash").isNull(), "removed").otherwise("changed")
        both.filter("NOT (was <=> tile_etag_hash)").drop("listing").join(F.broadcast(ready), "place").select(
            "listing", F.col("layer").alias("covariate_name"), "tile_etag_hash", change.alias("change"),
        ).write.mode("overwrite").parquet(f"{table}/changes/batch={number}")

        newest = ready.agg(F.max("place").alias("newest"))
        carry(prints.join(F.broadcast(newest), F.col("place") == F.coalesce("newest", F.lit(0)), "left_semi").select(
            "listing", F.col("layer").alias("covariate_name"), "tile_etag_hash"), "current")
        carry(ready.select(F.col("listing").alias("last")).unionByName(last).agg(F.max("last").alias("last")), "last")

    stream = listing.writeStream.foreachBatch(step).option(
        "checkpointLocation", checkpoint
    ).trigger(availableNow=True).start()
    stream.awaitTermination()


def read_changes(spark: SparkSession, table: str) -> DataFrame:
    return spark.read.parquet(f"{table}/changes").drop("batch")
