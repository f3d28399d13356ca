"""Exact ranks and quantiles that never put one key into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from arborlift.session import dealt, stage

OCTAVE_STEPS = 1024


def value_bucket(value: Column) -> Column:
    """Order-preserving bucket of a double: octave and a step inside it.

    The buckets narrow towards zero like floating point numbers do, so data
    of any scale spreads over many of them. Infinities have the outermost
    buckets, and NaN one above all, as Spark orders it.
    """
    endless = F.lit((1024 + 1100) * OCTAVE_STEPS).cast("long")
    magnitude = F.abs(value)
    finite = F.when(~F.isnan(value) & (magnitude != float("inf")), magnitude)
    octave = F.floor(F.log2(finite))
    step = F.floor((finite / F.pow(F.lit(2.0), octave) - 1) * OCTAVE_STEPS)
    bucket = (octave + 1100) * OCTAVE_STEPS + step
    return (
        F.when(value == 0, F.lit(0).cast("long"))
        .when(F.isnan(value), endless + 1)
        .when(value == float("inf"), endless)
        .when(value == float("-inf"), -endless)
        .otherwise(F.signum(value).cast("long") * bucket)
    )


def with_rank(df: DataFrame, keys: list[str], order: list[str], bucket: Column,
              name: str = "rank") -> DataFrame:
    """0-based rank of every row within ``keys``, plus the key's row count.

    ``bucket`` must not decrease along ``order``. Rows are ranked inside
    (keys, bucket) and shifted by the counts of earlier buckets, so a hot key
    is spread over as many tasks as it has buckets.
    """
    df = df.withColumn("_bucket", bucket)
    counts = df.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    along = Window.partitionBy(*keys).orderBy("_bucket")
    offsets = counts.select(
        *keys, "_bucket",
        (F.sum("_n").over(along) - F.col("_n")).alias("_offset"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias(f"{name}_count"),
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    ranked = df.withColumn("_inside", F.row_number().over(inside) - 1)
    return (
        ranked.join(offsets, [*keys, "_bucket"])
        .withColumn(name, F.col("_inside") + F.col("_offset"))
        .drop("_bucket", "_inside", "_offset")
    )


def value_ranks(df: DataFrame, keys: list[str], value: str, times: str | None = None,
                whole: Column | None = None) -> DataFrame:
    """Distinct values per key with their rank range ``[lo, hi]``, the size and the ``next`` value.

    Repeated values are counted before the shuffle; ``times`` names a column that
    says how often a row counts. The distinct values are staged, so that the tasks
    that rank them are as many as their rows ask for. Keys for which ``whole`` holds, a
    column of ``keys``, have few rows and are ranked in one piece.
    """
    number = F.count("*") if times is None else F.sum(times)
    bucket = value_bucket(F.col(value))
    if whole is not None:
        bucket = F.when(whole, F.lit(0).cast("long")).otherwise(bucket)
    distinct = (
        df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(number.alias("_n"))
        .withColumn("_bucket", bucket)
    )
    distinct = dealt(stage(distinct, "value-counts"), *keys, "_bucket")
    per_bucket = distinct.groupBy(*keys, "_bucket").agg(F.sum("_n").alias("_b"), F.min(value).alias("_first"))
    along = Window.partitionBy(*keys).orderBy("_bucket")
    offsets = per_bucket.select(
        *keys, "_bucket",
        (F.sum("_b").over(along) - F.col("_b")).alias("_offset"),
        F.sum("_b").over(Window.partitionBy(*keys)).alias("size"),
        F.lead("_first").over(along).alias("_beyond"),
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(value)
    running = F.sum("_n").over(inside)
    return (
        distinct.withColumns({"_run": running, "_next": F.lead(value).over(inside)})
        .join(offsets, [*keys, "_bucket"])
        .select(
            *keys, F.col(value).alias("value"), "size",
            (F.col("_offset") + F.col("_run") - F.col("_n")).alias("lo"),
            (F.col("_offset") + F.col("_run") - 1).alias("hi"),
            F.coalesce("_next", "_beyond").alias("next"),
        )
    )


def _interpolate(hits: DataFrame, keys: list[str]) -> DataFrame:
    low = F.max(F.when(F.floor("h").between(F.col("lo"), F.col("hi")), F.col("value")))
    high = F.max(F.when(F.ceil("h").between(F.col("lo"), F.col("hi")), F.col("value")))
    return (
        hits.groupBy(*keys, "p")
        .agg(low.alias("_l"), high.alias("_u"), F.max("h").alias("_h"))
        .select(*keys, "p",
                (F.col("_l") + (F.col("_h") - F.floor("_h")) * (F.col("_u") - F.col("_l")))
                .alias("quantile"))
    )


def quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float]) -> DataFrame:
    """Linearly interpolated quantiles ``(keys, p, quantile)`` for given probs."""
    ranks = value_ranks(df, keys, value)
    wanted = F.array(*[F.lit(float(p)) for p in probs])
    hit = F.filter(
        wanted,
        lambda p: (F.floor(p * (F.col("size") - 1)) <= F.col("hi"))
        & (F.ceil(p * (F.col("size") - 1)) >= F.col("lo")),
    )
    hits = ranks.withColumn("p", F.explode(hit)).withColumn("h", F.col("p") * (F.col("size") - 1))
    return _interpolate(hits, keys)


def even_quantiles(ranks: DataFrame, keys: list[str], points: Column, tasks: int | None = None) -> DataFrame:
    """Quantiles at ``points`` equally spaced probabilities from 0 to 1.

    ``ranks`` comes from :func:`value_ranks`. A value that is the lower one of some point knows the
    upper one, so what is dealt out are at most ``points`` values a key with the range of indexes they
    answer, and points are made after that. With ``tasks`` values go by the first key into so many tasks.
    """
    ranks = ranks.withColumn("points", points).filter("size > 1 AND points > 1")
    per_index = (F.col("size") - 1) / (F.col("points") - 1)
    first = F.greatest(F.floor((F.col("lo") - 1) / per_index) - 1, F.lit(0))
    last = F.least(F.ceil((F.col("hi") + 1) / per_index) + 1, F.col("points") - 1)

    def rank(index: Column) -> Column:
        return index / (F.col("points") - 1) * (F.col("size") - 1)

    answered = F.filter(
        F.sequence(first.cast("long"), last.cast("long")),
        lambda index: (F.floor(rank(index)) >= F.col("lo")) & (F.floor(rank(index)) <= F.col("hi")))
    rows = ranks.withColumn("_answered", answered).filter(F.size("_answered") > 0).select(
        *keys, "value", "next", "hi", "size", "points",
        F.array_min("_answered").alias("_from"), F.array_max("_answered").alias("_to"))
    if tasks is not None:
        rows = rows.repartition(tasks, keys[0])
    rows = rows.withColumn("index", F.explode(F.sequence("_from", "_to")))
    h = rank(F.col("index"))
    upper = F.when(F.ceil(h) <= F.col("hi"), F.col("value")).otherwise(F.col("next"))
    return rows.select(
        *keys, "index", (F.col("index") / (F.col("points") - 1)).alias("p"),
        (F.col("value") + (h - F.floor(h)) * (upper - F.col("value"))).alias("quantile"))
