"""Match quality: balance, histograms, quantile pairs, counts and warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from arborlift.functions.stats import even_quantiles, value_ranks
from arborlift.session import stage, tasks_for

# Scope label of the whole run, bin and point counts, thresholds.
ALL_SCOPE = "__all__"
N_BINS = 40
N_QQ_POINTS = 500
FEW_SCORES = 20_000
SMD_CRITICAL = 0.25
SMD_WARN = 0.1
SMD_POOR_SHARE = 0.20
MIN_PIXELS_CRITICAL = 50
MIN_PIXELS_WARN = 200

# Wording of the warnings.
TEXT_FEW_PIXELS_CRITICAL = (
    "Site ‘%s’ has only %d matched pixels, which is very low for reliable results."
)
TEXT_FEW_PIXELS = (
    "Site ‘%s’ has only %d matched pixels, which may limit result reliability."
)
TEXT_ONE_CRITICAL = "Covariate balance is poor: ‘%s’ has |SMD|\u2009=\u2009%.2f."
TEXT_MANY_CRITICAL = (
    "Covariate balance is poor: %d covariates have |SMD|\u2009≥\u20090.25 "
    "(worst: ‘%s’ at %.2f)."
)
TEXT_MANY_POOR = (
    "%d of %d covariates (%d%%) have |SMD|\u2009>\u20090.1, suggesting imperfect matching."
)


def _finite(name: str) -> Column:
    """NaN read from files counts as missing."""
    value = F.col(name).cast("double")
    return F.when(~F.isnan(value), value)


def _moment_columns(covariates) -> list[Column]:
    out = []
    for cov in covariates:
        for arm, mask in (("t", F.col("treatment")), ("c", ~F.col("treatment"))):
            x = F.when(mask, _finite(cov))
            off = x - F.col(f"`{cov}|shift`")
            w = F.when(x.isNotNull(), F.col("match_weight"))
            out += [
                F.count(x).alias(f"{cov}|{arm}|n"),
                F.sum(w).alias(f"{cov}|{arm}|w"),
                F.sum(w * off).alias(f"{cov}|{arm}|s1"),
                F.sum(w * off * off).alias(f"{cov}|{arm}|s2"),
                F.min(x).alias(f"{cov}|{arm}|lo"),
                F.max(x).alias(f"{cov}|{arm}|hi"),
            ]
    return out


def _roll_up(by_site: DataFrame) -> DataFrame:
    """Whole-run moments from the site moments, a table of one row per site."""
    how = {"n": F.sum, "w": F.sum, "s1": F.sum, "s2": F.sum, "lo": F.min, "hi": F.max, "shift": F.first}
    cols = [c for c in by_site.columns if c != "site_id"]
    everything = by_site.agg(*[how[c.rsplit("|", 1)[1]](F.col(f"`{c}`")).alias(c) for c in cols])
    return everything.select(F.lit(ALL_SCOPE).alias("site_id"), *[F.col(f"`{c}`") for c in cols])


def covariate_moments(matches: DataFrame, covariates) -> DataFrame:
    """Weighted moments per (scope, covariate).

    Sums are taken of the distance from a covariate's plain mean (``shift``,
    one row over all matches), so that values far from zero do not cancel. All
    covariates and both arms share one aggregation keyed on the site; the
    whole-run scope is rolled up from it, so pixels are neither duplicated per
    scope nor per covariate.
    """
    endless = F.lit(float("inf"))
    shifts = matches.agg(*[
        F.coalesce(F.avg(F.when(F.abs(_finite(c)) < endless, _finite(c))), F.lit(0.0)).alias(f"{c}|shift")
        for c in covariates
    ])
    by_site = matches.join(F.broadcast(shifts)).groupBy("site_id").agg(
        *_moment_columns(covariates), *[F.first(f"`{c}|shift`").alias(f"{c}|shift") for c in covariates])
    scopes = by_site.unionByName(_roll_up(by_site))
    parts = ("n", "w", "s1", "s2", "lo", "hi")
    entry = [
        F.struct(
            F.lit(cov).alias("covariate"), F.col(f"`{cov}|shift`").alias("shift"),
            *[F.col(f"`{cov}|{arm}|{p}`").alias(f"{arm}_{p}") for arm in "tc" for p in parts],
        )
        for cov in covariates
    ]
    return scopes.select("site_id", F.inline(F.array(*entry)))


def balance(matches: DataFrame, covariates) -> DataFrame:
    """Standardized mean differences per site and over the whole run."""
    m = covariate_moments(matches, covariates)

    def off(arm: str) -> Column:
        return F.try_divide(F.col(f"{arm}_s1"), F.col(f"{arm}_w"))

    def mean(arm: str) -> Column:
        return F.col("shift") + off(arm)

    def variance(arm: str) -> Column:
        spread = F.try_divide(F.col(f"{arm}_s2"), F.col(f"{arm}_w")) - off(arm) * off(arm)
        constant = F.col(f"{arm}_lo") == F.col(f"{arm}_hi")
        return F.when(constant, 0.0).otherwise(F.greatest(spread, F.lit(0.0)))

    enough = (F.col("t_n") >= 2) & (F.col("c_n") >= 2)
    m = m.withColumn("_sd", F.when(enough, F.sqrt((variance("t") + variance("c")) / 2)))
    smd = F.when(F.col("_sd") > 0, (off("t") - off("c")) / F.col("_sd")).when(
        F.col("_sd") == 0, 0.0
    )
    return m.select(
        "site_id", "covariate",
        F.when(enough, mean("t")).alias("mean_treatment"),
        F.when(enough, mean("c")).alias("mean_control"),
        F.col("_sd").alias("pooled_sd"),
        smd.alias("smd"),
    )


def _long_values(matches: DataFrame, covariates) -> DataFrame:
    entry = [F.struct(F.lit(c).alias("covariate"), _finite(c).alias("value")) for c in covariates]
    long = matches.select("site_id", "treatment", F.inline(F.array(*entry)))
    return long.filter("value IS NOT NULL")


def _value_range(matches: DataFrame, covariates) -> DataFrame:
    """Range and number of values of every covariate, per site and over the run, in one pass."""
    parts = (("lo", F.min), ("hi", F.max), ("n", F.count))
    by_site = stage(matches.filter("treatment IS NOT NULL").groupBy("site_id").agg(
        *[how(_finite(c)).alias(f"{c}|{p}") for c in covariates for p, how in parts]), "site-ranges")
    entry = [F.struct(F.lit(c).alias("covariate"), *[F.col(f"`{c}|{p}`").alias(p) for p, _ in parts])
             for c in covariates]
    return _roll_up(by_site).unionByName(by_site).select("site_id", F.inline(F.array(*entry)))


def _binned(matches: DataFrame, covariates, ranges: DataFrame, bin_of) -> DataFrame:
    """Zero-filled share of each arm per bin, for sites and the run in one pass.

    A value is binned by its site's range and by the run's (one range per
    covariate, hence broadcast); counts combine map-side before the shuffle.
    """
    run = ranges.filter(F.col("site_id") == ALL_SCOPE).select(
        "covariate", F.col("lo").alias("_rlo"), F.col("hi").alias("_rhi")
    )
    own = ranges.filter(F.col("site_id") != ALL_SCOPE)
    placed = (
        _long_values(matches, covariates)
        .join(own, ["site_id", "covariate"], "left")
        .join(F.broadcast(run), "covariate", "left")
    )
    scopes = F.array(
        F.struct(F.col("site_id").alias("scope"), bin_of("lo", "hi").alias("bin")),
        F.struct(F.lit(ALL_SCOPE).alias("scope"), bin_of("_rlo", "_rhi").alias("bin")),
    )
    counts = (
        placed.select("covariate", "treatment", F.inline(scopes)).filter("bin IS NOT NULL")
        .groupBy(F.col("scope").alias("site_id"), "covariate", "bin")
        .agg(F.count_if("treatment").alias("t"), F.count_if(~F.col("treatment")).alias("c"))
    )
    keys = ["site_id", "covariate"]
    whole = Window.partitionBy(*keys)
    shares = counts.select(
        *keys, "bin",
        F.try_divide(F.col("t") * 100, F.sum("t").over(whole)).alias("tp"),
        F.try_divide(F.col("c") * 100, F.sum("c").over(whole)).alias("cp"),
    )
    bins = F.explode(F.sequence(F.lit(0), F.lit(N_BINS - 1))).alias("bin")
    width = (F.col("hi") - F.col("lo")) / N_BINS
    return ranges.select(*keys, "lo", "hi", bins).join(shares, [*keys, "bin"], "left").select(
        *keys, "bin",
        (F.col("lo") + width * F.col("bin")).alias("bin_start"),
        (F.col("lo") + width * (F.col("bin") + 1)).alias("bin_end"),
        F.coalesce("tp", F.lit(0.0)).alias("treatment_pct"),
        F.coalesce("cp", F.lit(0.0)).alias("control_pct"),
    )


def _place(lo: str, hi: str) -> Column:
    return (F.col("value") - F.col(lo)) / (F.col(hi) - F.col(lo)) * N_BINS


def _right_closed(lo: str, hi: str) -> Column:
    index = F.ceil(_place(lo, hi)).cast("int") - 1
    return F.when(F.col(lo).isNotNull(), F.least(F.greatest(index, F.lit(0)), F.lit(N_BINS - 1)))


def _left_closed(lo: str, hi: str) -> Column:
    index = F.floor(_place(lo, hi)).cast("int")
    return F.when(F.col(lo).isNotNull(), F.least(index, F.lit(N_BINS - 1)))


def _values(matches: DataFrame, covariates) -> DataFrame:
    """The columns of a histogram, written once: ranges and bins each read them."""
    return stage(matches.select("site_id", "treatment", *covariates), "histogram-values")


def histogram_local(matches: DataFrame, covariates) -> DataFrame:
    """40 bins over each scope's own range, closed on the right.

    The ranges are written first: they are tiny, and without them in hand
    every use would scan the matches again.
    """
    matches = _values(matches, covariates)
    ranges = _value_range(matches, covariates).filter("n >= 2 AND hi > lo")
    return _binned(matches, covariates, stage(ranges, "ranges"), _right_closed)


def histogram_global(matches: DataFrame, covariates) -> DataFrame:
    """40 bins over the whole run's range for every scope, closed on the left."""
    matches = _values(matches, covariates)
    ranges = stage(_value_range(matches, covariates).filter("n > 0"), "ranges")
    run = ranges.filter((F.col("site_id") == ALL_SCOPE) & (F.col("hi") > F.col("lo")))
    shared = ranges.select("site_id", "covariate").join(
        F.broadcast(run.select("covariate", "lo", "hi")), "covariate"
    )
    return _binned(matches, covariates, shared, _left_closed)


def histogram_equal_width(matches: DataFrame, covariates) -> DataFrame:
    """Whole-run histogram of the covariates that take two values or more."""
    return histogram_global(matches, covariates).filter(F.col("site_id") == ALL_SCOPE).drop(
        "site_id"
    )


def _whole_run(values: DataFrame) -> DataFrame:
    return values.withColumn("site_id", F.lit(ALL_SCOPE))


def qq_pairs(scores: DataFrame, adaptive: bool = False) -> DataFrame:
    """Paired quantiles of the treated and control scores of every scope.

    Fixed mode gives 500 points; adaptive mode gives the larger arm's size up
    to 500. Scopes with fewer than two scores in an arm give none.
    """
    keys = ["site_id", "treatment"]
    counts = stage(
        scores.filter("pscore IS NOT NULL").groupBy(*keys, "pscore").agg(F.count("*").alias("n")), "score-counts"
    )
    scoped = counts.unionByName(_whole_run(counts.groupBy("treatment", "pscore").agg(F.sum("n").alias("n"))))
    arm = F.col("treatment")
    points = F.lit(N_QQ_POINTS)
    if adaptive:
        points = F.least(points, F.greatest("nt", "nc"))
    sizes = stage(
        scoped.groupBy("site_id").agg(F.sum(F.when(arm, F.col("n"))).alias("nt"), F.sum(F.when(~arm, F.col("n"))).alias("nc"))
        .filter("nt >= 2 AND nc >= 2")
        .select("site_id", points.cast("long").alias("points"), (F.greatest("nt", "nc") <= FEW_SCORES).alias("few")),
        "scope-points",
    )
    asked = sizes.agg(F.coalesce(F.sum("points"), F.lit(0))).first()[0]
    ranks = value_ranks(scoped.join(sizes, "site_id"), [*keys, "points", "few"], "pscore", "n", F.col("few"))
    # two arms; both arms of a scope meet in one task, whose points are bounded
    q = even_quantiles(ranks, keys, F.col("points"), tasks_for(2 * asked))
    return q.groupBy("site_id", "index").agg(
        F.max("p").alias("quantile"),
        F.max(F.when(F.col("treatment"), F.col("quantile"))).alias("treatment_value"),
        F.max(F.when(~F.col("treatment"), F.col("quantile"))).alias("control_value"),
    )


def scope_counts(matches: DataFrame) -> DataFrame:
    by_site = matches.groupBy("site_id").agg(
        F.count_if("treatment").alias("n_treatment"),
        F.count_if(~F.col("treatment")).alias("n_control"),
        F.max("n_control_sampled").alias("n_control_sampled"),
        F.max("n_control_pool").alias("n_control_pool"),
    ).withColumn("n_sites", F.lit(1).cast("bigint"))
    names = ("n_treatment", "n_control", "n_control_sampled", "n_control_pool", "n_sites")
    total = by_site.agg(*[F.sum(n).alias(n) for n in names])
    return by_site.unionByName(total.withColumn("site_id", F.lit(ALL_SCOPE)))


def quality_counts(matches: DataFrame, treatment_key: DataFrame) -> DataFrame:
    """Counts per scope; totals come from the treatment key."""
    key = treatment_key.groupBy("site_id").agg(F.count("*").alias("n_treatment_total"))
    total = key.agg(F.sum("n_treatment_total").alias("n_treatment_total"))
    key = key.unionByName(total.withColumn("site_id", F.lit(ALL_SCOPE)))
    return scope_counts(matches).join(key, "site_id", "left")


def quality_counts_estimated(matches: DataFrame, sampling: DataFrame) -> DataFrame:
    """Counts per scope where totals are estimated from the sampled share."""
    by_site = scope_counts(matches).filter(F.col("site_id") != ALL_SCOPE)
    share = sampling.select("site_id", "sampled_fraction").filter("sampled_fraction > 0")
    by_site = by_site.join(share, "site_id", "left").withColumn(
        "n_treatment_total",
        F.bround(F.col("n_treatment") / F.coalesce("sampled_fraction", F.lit(1.0))).cast("bigint"),
    )
    names = ("n_treatment", "n_control", "n_sites", "n_treatment_total")
    total = by_site.agg(*[F.sum(n).alias(n) for n in names])
    return by_site.select("site_id", *names).unionByName(
        total.withColumn("site_id", F.lit(ALL_SCOPE))
    )


def pool_percent(counts: DataFrame) -> DataFrame:
    """Sampled share of the control pool, given only where it is below 100."""
    share = F.try_divide(F.col("n_control_sampled") * 100.0, F.col("n_control_pool"))
    shown = (F.col("n_control_sampled") > F.col("n_control")) & (share < 100)
    return counts.withColumn("pool_percent", F.when(shown, share))


def pixel_warnings(totals: DataFrame) -> DataFrame:
    n = F.coalesce(F.col("n_matched_pixels"), F.lit(0))
    label = F.coalesce("site_name", "site_id")
    low = n < MIN_PIXELS_CRITICAL
    return totals.filter(n < MIN_PIXELS_WARN).select(
        F.when(low, "danger").otherwise("warning").alias("level"),
        F.col("site_id").alias("scope"),
        F.when(low, F.format_string(TEXT_FEW_PIXELS_CRITICAL, label, n))
        .otherwise(F.format_string(TEXT_FEW_PIXELS, label, n)).alias("message"),
        F.lit(0).alias("rule"),
    )


def worst_covariates(balance_rows: DataFrame) -> DataFrame:
    """Per scope: worst covariate, critical ones by falling |SMD|, and counts."""
    size = F.abs("smd")
    critical = F.collect_list(
        F.when(size >= SMD_CRITICAL, F.struct((-size).alias("k"), F.col("covariate").alias("c")))
    )
    return (
        balance_rows.filter("smd IS NOT NULL")
        .groupBy("site_id")
        .agg(
            F.max(size).alias("max_smd"),
            F.min(F.struct((-size).alias("k"), F.col("covariate").alias("c")))["c"]
            .alias("worst_covariate"),
            F.transform(F.array_sort(critical), lambda s: s["c"]).alias("critical_covariates"),
            F.count_if(size >= SMD_CRITICAL).alias("n_critical"),
            F.count_if(size > SMD_WARN).alias("n_poor"),
            F.count("*").alias("n_total"),
        )
    )


def balance_warnings(balance_rows: DataFrame) -> DataFrame:
    w = worst_covariates(balance_rows).withColumn(
        "scope", F.when(F.col("site_id") == ALL_SCOPE, "aggregate").otherwise(F.col("site_id"))
    )
    one = F.format_string(TEXT_ONE_CRITICAL, "worst_covariate", "max_smd")
    many = F.format_string(TEXT_MANY_CRITICAL, "n_critical", "worst_covariate", "max_smd")
    danger = w.filter("n_critical > 0").select(
        F.lit("danger").alias("level"), "scope",
        F.when(F.col("n_critical") == 1, one).otherwise(many).alias("message"),
        F.lit(1).alias("rule"),
    )
    share = F.col("n_poor") / F.col("n_total")
    percent = F.bround(share * 100).cast("int")
    warning = w.filter(share > SMD_POOR_SHARE).select(
        F.lit("warning").alias("level"), "scope",
        F.format_string(TEXT_MANY_POOR, "n_poor", "n_total", percent).alias("message"),
        F.lit(2).alias("rule"),
    )
    return danger.unionByName(warning)


def quality_warnings(totals: DataFrame, balance_rows: DataFrame) -> DataFrame:
    return pixel_warnings(totals).unionByName(balance_warnings(balance_rows))


def warning_digest(warnings: DataFrame) -> DataFrame:
    """Per site: its level (danger wins) and its messages in rule order."""
    entry = F.struct("rule", "message")
    return (
        warnings.filter(F.col("scope") != "aggregate")
        .groupBy("scope")
        .agg(
            F.min("level").alias("level"),
            F.array_join(
                F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["message"]), "; "
            ).alias("issues"),
        )
    )


def caution_only(warnings: DataFrame) -> DataFrame:
    """Sites with a warning and no danger."""
    sites = warnings.filter(F.col("scope") != "aggregate")
    caution = sites.filter("level = 'warning'").select("scope")
    return caution.subtract(sites.filter("level = 'danger'").select("scope"))


def by_absolute_smd(balance_rows: DataFrame, scope: str = ALL_SCOPE) -> DataFrame:
    return (
        balance_rows.filter((F.col("site_id") == scope) & F.col("smd").isNotNull())
        .withColumn("within_threshold", F.abs("smd") <= SMD_WARN)
        .orderBy(F.abs("smd"), "covariate")
    )


