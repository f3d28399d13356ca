"""Neighbours along a one-dimensional score, without pairing whole strata."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from arborlift.functions.stats import value_bucket

STRATUM = ["id_numeric", "group"]


def caliper_pairs(rows: DataFrame, caliper: float) -> DataFrame:
    """All treated-control pairs of a stratum within the caliper.

    A band join: controls sit in the bucket of their score, treated rows look
    into their own and both neighbours, and an exact filter follows. Joined on
    (stratum, bucket), so a large stratum spreads over its buckets and AQE can
    split what is left of a hot one.
    """
    bucket = F.floor(F.col("score") / caliper)
    treated = rows.filter("treatment").select(
        *STRATUM, F.col("cell").alias("treated_cell"), F.col("score").alias("_ts"),
        F.explode(F.sequence(bucket - 1, bucket + 1)).alias("_b"),
    )
    controls = rows.filter(~F.col("treatment")).select(
        *STRATUM, F.col("cell").alias("control_cell"), F.col("score").alias("_cs"),
        bucket.alias("_b"),
    )
    distance = F.abs(F.col("_ts") - F.col("_cs"))
    return (
        treated.join(controls, [*STRATUM, "_b"])
        .withColumn("distance", distance).filter(F.col("distance") <= caliper)
        .select(*STRATUM, "treated_cell", "control_cell", "distance")
    )


def control_rank(pairs: DataFrame) -> DataFrame:
    """Controls of a treated row in order of distance, then cell."""
    order = Window.partitionBy(*STRATUM, "treated_cell").orderBy("distance", "control_cell")
    return pairs.withColumn("rank", F.row_number().over(order))


ZONES = 1_000_000
BUCKET_BITS = 16


def controls_within(rows: DataFrame, caliper: float) -> DataFrame:
    """How many controls each treated row has within the caliper; 0 if none.

    No pairs are built. Scores fall into zones of a millionth of the caliper,
    and controls are counted cumulatively along them, so what lies inside the
    band is the difference of two positions. Only the zones at its two ends
    are joined, score by score, and tested exactly. Controls of one zone are
    counted before they are ranked, in buckets of 65536 zones, so a bucket has
    a bounded number of rows however many controls crowd there.

    Scores that are null, NaN or infinite are near nothing. The caliper must
    be positive.
    """
    if not caliper > 0:
        raise ValueError("the caliper must be positive")
    grain = caliper / ZONES
    score = F.col("score")
    usable = rows.filter(score.isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf")))
    controls = usable.filter(~F.col("treatment")).groupBy(*STRATUM, "score").agg(
        F.count("*").alias("_n")
    ).withColumn("_zone", F.floor(score / grain))
    low, high = F.floor((score - caliper) / grain), F.floor((score + caliper) / grain)
    asked = usable.filter("treatment").select(*STRATUM, "score").distinct()
    ends = asked.select(*STRATUM, "score", F.inline(F.array(
        F.struct((low + 1).alias("_zone"), F.lit(-1).alias("_sign")),
        F.struct((high - 2).alias("_zone"), F.lit(1).alias("_sign")),
    )))

    filled = (
        controls.select(*STRATUM, "_zone", "_n")
        .unionByName(ends.select(*STRATUM, "_zone", F.lit(0).cast("long").alias("_n")))
        .groupBy(*STRATUM, "_zone").agg(F.sum("_n").alias("_n"))
        .withColumn("_bucket", F.shiftright("_zone", BUCKET_BITS))
    )
    along = Window.partitionBy(*STRATUM).orderBy("_bucket")
    offsets = filled.groupBy(*STRATUM, "_bucket").agg(F.sum("_n").alias("_b")).select(
        *STRATUM, "_bucket", (F.sum("_b").over(along) - F.col("_b")).alias("_offset")
    )
    inside = Window.partitionBy(*STRATUM, "_bucket").orderBy("_zone")
    positions = filled.withColumn("_up_to", F.sum("_n").over(inside)).join(
        offsets, [*STRATUM, "_bucket"]
    ).select(*STRATUM, "_zone", (F.col("_up_to") + F.col("_offset")).alias("_up_to"))
    between = ends.join(positions, [*STRATUM, "_zone"]).select(
        *STRATUM, "score", (F.col("_sign") * F.col("_up_to")).alias("_n")
    )

    rims = F.array_union(F.sequence(low - 1, low + 1), F.sequence(high - 1, high + 1))
    rim = asked.withColumn("_zone", F.explode(rims)).join(
        controls.withColumnRenamed("score", "_cs"), [*STRATUM, "_zone"]
    ).filter(F.abs(score - F.col("_cs")) <= caliper).select(*STRATUM, "score", "_n")

    n = between.unionByName(rim).groupBy(*STRATUM, "score").agg(F.sum("_n").alias("_n"))
    return rows.filter("treatment").join(n, [*STRATUM, "score"], "left").select(
        *STRATUM, F.col("cell").alias("treated_cell"), F.coalesce("_n", F.lit(0)).alias("n_within")
    )


def nearest_control(rows: DataFrame) -> DataFrame:
    """Nearest control of every treated row, with replacement.

    The nearest control is the last one at or below the score or the first one
    above it. Controls collapse to one per (stratum, score), which keeps the
    smallest cell. Rows are swept per (stratum, score bucket); what lies across
    a bucket's edges comes from the per-bucket extremes, so no task sees a
    whole stratum.
    """
    controls = rows.filter(~F.col("treatment")).groupBy(*STRATUM, "score").agg(
        F.min("cell").alias("_c")
    )
    treated = rows.filter("treatment").select(*STRATUM, "score", F.col("cell").alias("_t"))
    spot = F.struct("score", F.col("_c").alias("c"))
    c = controls.select(
        *STRATUM, value_bucket(F.col("score")).alias("_b"), "score", F.lit(None).cast("bigint")
        .alias("_t"), F.when(F.col("_c").isNotNull(), spot).alias("_spot"),
    )
    t = treated.select(
        *STRATUM, value_bucket(F.col("score")).alias("_b"), "score", "_t",
        F.lit(None).cast(c.schema["_spot"].dataType).alias("_spot"),
    )
    both = c.unionByName(t)
    edge = both.groupBy(*STRATUM, "_b").agg(
        F.min("_spot").alias("_lo"), F.max("_spot").alias("_hi")
    )
    along = Window.partitionBy(*STRATUM).orderBy("_b")
    back = Window.partitionBy(*STRATUM).orderBy(F.desc("_b"))
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    after = back.rowsBetween(Window.unboundedPreceding, -1)
    outside = edge.select(
        *STRATUM, "_b",
        F.last("_hi", ignorenulls=True).over(before).alias("_below"),
        F.last("_lo", ignorenulls=True).over(after).alias("_above"),
    )
    # controls come first among equal scores, so a tie is found on the lower side
    up = Window.partitionBy(*STRATUM, "_b").orderBy("score", F.col("_t").asc_nulls_first())
    down = Window.partitionBy(*STRATUM, "_b").orderBy(
        F.desc("score"), F.col("_t").asc_nulls_first()
    )
    swept = both.withColumns({
        "_l": F.last("_spot", ignorenulls=True).over(up),
        "_r": F.last("_spot", ignorenulls=True).over(down),
    }).filter("_t IS NOT NULL").join(outside, [*STRATUM, "_b"])
    swept = swept.withColumns({
        "_l": F.coalesce("_l", "_below"), "_r": F.coalesce("_r", "_above"),
    })

    def candidate(name: str):
        gap = F.abs(F.col(f"{name}.score") - F.col("score"))
        return F.when(
            F.col(name).isNotNull(),
            F.struct(gap.alias("distance"), F.col(f"{name}.c").alias("control_cell")),
        )

    best = F.least(candidate("_l"), candidate("_r"))
    return swept.withColumn("_best", best).filter("_best IS NOT NULL").select(
        *STRATUM, F.col("_t").alias("treated_cell"),
        F.col("_best.control_cell").alias("control_cell"),
        F.col("_best.distance").alias("distance"),
    )
