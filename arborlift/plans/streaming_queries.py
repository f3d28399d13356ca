"""The two feeds, each drained to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborlift.plans.catalogue import query
from arborlift.plans.oracle_views import MANIFEST, cte
from arborlift.sources import shared_tables as T
from arborlift.sources.tables import work_path
from arborlift.streaming import feeds

STATUS = """WITH f AS (SELECT event_id AS id, user_id AS key, ts, CASE event_type
 WHEN 'view' THEN 'exporting' WHEN 'click' THEN 'exported' WHEN 'purchase' THEN 'merged'
 WHEN 'signup' THEN 'pending_merge' ELSE 'failed' END AS status FROM events)
SELECT key, arg_max(status,(ts,id)) AS status, strftime(min(ts),'%Y-%m-%d %H:%M:%S') AS started_at,
 strftime(max(ts) FILTER (status IN ('merged','exported','failed')),'%Y-%m-%d %H:%M:%S')
 AS completed_at, count(*) AS n_changes FROM f GROUP BY key"""


@query("stream_status_latest", STATUS)
def _(spark, d):
    source = T.table(spark, d, "events")
    raw = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    states = F.create_map(*[F.lit(x) for kv in T.EVENT_STATUS.items() for x in kv])
    feed = raw.select(
        F.col("user_id").alias("key"), states[F.col("event_type")].alias("status"),
        "ts", F.col("event_id").alias("id"),
    )
    table = work_path(spark, "status")
    feeds.run_status_stream(feed, table, work_path(spark, "status-checkpoint"))
    shown = "yyyy-MM-dd HH:mm:ss"
    return feeds.read_status(spark, table).withColumns({
        c: F.date_format(c, shown) for c in ("started_at", "completed_at")
    })


LISTINGS = """lists AS (SELECT l AS listing, name, covariate_name,
  CASE WHEN l>=1 AND size_bytes%40=0 AND substr(covariate_name,1,1)<'n' THEN etag||'-'||l ELSE etag END AS etag, size_bytes
 FROM mani, (VALUES (0),(1),(2),(3)) v(l)
 WHERE NOT (l=2 AND length(covariate_name)%2=0)),
prints AS (SELECT listing, covariate_name, substr(sha256(string_agg(b||h,'|' ORDER BY b)),1,16) AS h
 FROM (SELECT listing, covariate_name, b, sha256(string_agg(DISTINCT e,'|' ORDER BY e)) AS h
  FROM (SELECT listing, covariate_name, substr(md5(name),1,3) AS b, name||':'||etag||':'||size_bytes AS e FROM lists)
  GROUP BY 1,2,3) GROUP BY 1,2)"""


@query("stream_manifest_changes", cte(MANIFEST, LISTINGS) + """
SELECT CAST(coalesce(a.listing,b.listing+1) AS BIGINT) AS listing, coalesce(a.covariate_name,b.covariate_name) AS covariate_name,
 a.h AS tile_etag_hash, CASE WHEN b.h IS NULL THEN 'new' WHEN a.h IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM prints a FULL JOIN (SELECT * FROM prints WHERE listing<3) b
 ON a.covariate_name=b.covariate_name AND a.listing=b.listing+1
WHERE a.h IS DISTINCT FROM b.h""")
def _(spark, d):
    """Four listings of the manifest, each in two parts that come in batches of their own.

    Later ones have new tiles in some layers, and one lacks some layers.
    """
    number = F.col("listing")
    tiles = T.manifest_rows(T.table(spark, d, "pages")).withColumn(
        "listing", F.explode(F.array(*[F.lit(n).cast("bigint") for n in range(4)])))
    retiled = (number >= 1) & (F.col("size_bytes") % 40 == 0) & (F.substring("covariate_name", 1, 1) < "n")
    tiles = tiles.filter(~((number == 2) & (F.length("covariate_name") % 2 == 0))).withColumn(
        "etag", F.when(retiled, F.concat_ws("-", "etag", "listing")).otherwise(F.col("etag")))
    sizes = tiles.groupBy("listing").agg(F.count("*").alias("n_objects"))
    tiles = tiles.join(F.broadcast(sizes), "listing").withColumn(
        "part", number * 2 + F.pmod(F.xxhash64("name"), F.lit(2)))
    feed, table = work_path(spark, "listings"), work_path(spark, "snapshots")
    tiles.select("part", *[c.split()[0] for c in feeds.LISTING.split(", ")]).write.partitionBy("part").parquet(feed)
    raw = spark.readStream.schema(feeds.LISTING + ", part bigint").option("maxFilesPerTrigger", 3).parquet(feed)
    feeds.run_manifest_stream(raw, table, work_path(spark, "snapshots-checkpoint"))
    return feeds.read_changes(spark, table)
