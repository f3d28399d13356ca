"""Strata, seeded sampling, scores and matching for all sites in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from arborlift.config import (
    CATEGORICAL_VARS, PRE_DEFOR_FIRST_START, PRE_INTERVENTION_YEARS, MatchConfig, require_columns,
)
from arborlift.functions.stats import with_rank
from arborlift.operators.summary import cover_years
from arborlift.session import stage

HASH_DIGITS = 3
BLOCK = 256
MAX_LEVELS = 200
STRATUM = ["id_numeric", "group"]


def exact_group(exact_vars) -> Column:
    return F.concat_ws(".", *[F.col(v).cast("string") for v in exact_vars])


def drop_missing_strata(pixels: DataFrame, exact_vars) -> DataFrame:
    """Pixels with every exact-match variable present; 0 is a value like any other."""
    return pixels.dropna(subset=list(exact_vars))


def flag_treatment(pixels: DataFrame, treatment_key: DataFrame) -> DataFrame:
    """Mark treated pixels with their site; all others are controls of anyone."""
    key = treatment_key.select("cell", "id_numeric")
    flagged = pixels.drop("id_numeric").join(key, "cell", "left")
    return flagged.withColumn("treatment", F.col("id_numeric").isNotNull())


def control_pixels(pixels: DataFrame, treatment_key: DataFrame) -> DataFrame:
    """Pixels that no site treats."""
    return pixels.join(treatment_key.select("cell"), "cell", "left_anti")


def grouped_pixels(pixels: DataFrame, treatment_key: DataFrame, exact_vars) -> DataFrame:
    """Narrow (cell, id_numeric, treatment, group) table strata are built on."""
    narrow = drop_missing_strata(pixels.select("cell", *exact_vars), exact_vars)
    narrow = narrow.select("cell", exact_group(exact_vars).alias("group"))
    return flag_treatment(narrow, treatment_key)


def strata(pixels: DataFrame, treatment_key: DataFrame, exact_vars) -> DataFrame:
    """(site, group) pairs with both arms, and their sizes before sampling."""
    return strata_of(grouped_pixels(pixels, treatment_key, exact_vars))


def strata_of(grouped: DataFrame) -> DataFrame:
    """The same from pixels in their group."""
    counts = grouped.groupBy("group", "id_numeric").agg(F.count("*").alias("n_treated"))
    controls = F.max(F.when(F.col("id_numeric").isNull(), F.col("n_treated"))).over(
        Window.partitionBy("group")
    )
    return counts.withColumn("n_controls", controls).filter(
        "id_numeric IS NOT NULL AND n_controls > 0"
    ).select(*STRATUM, "n_treated", "n_controls")


def control_pool(strata_table: DataFrame) -> DataFrame:
    """Controls a site could draw on, before sampling."""
    return strata_table.groupBy("id_numeric").agg(F.sum("n_controls").alias("n_control_pool"))


def _digest(*parts) -> Column:
    pieces = []
    for i, part in enumerate(parts):
        if i:
            pieces.append(F.lit(":"))
        pieces.append(part if isinstance(part, Column) else F.lit(str(part)))
    return F.md5(F.concat(*[p.cast("string") for p in pieces]))


def _hex_number(digest: Column, digits: int) -> Column:
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("bigint")


def sample_treated(treated: DataFrame, cap: int, seed: int) -> DataFrame:
    """At most ``cap`` treated pixels per (site, group), in seeded hash order."""
    hashed = treated.withColumn("_h", _digest(seed, F.col("id_numeric"), F.col("cell")))
    bucket = _hex_number(F.col("_h"), HASH_DIGITS)
    ranked = with_rank(hashed, STRATUM, ["_h", "cell"], bucket, "_r")
    return ranked.filter(F.col("_r") < cap).drop("_r", "_r_count", "_h")


def control_positions(controls: DataFrame, seed: int) -> DataFrame:
    """Seeded random position of every control within its group."""
    hashed = controls.select("cell", "group", _digest(seed, F.col("cell")).alias("_h"))
    bucket = _hex_number(F.col("_h"), HASH_DIGITS)
    return with_rank(hashed, ["group"], ["_h", "cell"], bucket, "position").drop(
        "_h", "position_count"
    )


def control_runs(strata_table: DataFrame, multiplier: int, seed: int) -> DataFrame:
    """Where in its group's order every stratum starts, and how many controls it takes."""
    n = F.col("n_controls")
    start = _hex_number(_digest(seed, F.col("id_numeric"), F.col("group")), 8) % n
    return strata_table.select(
        *STRATUM, "n_treated", "n_controls", start.alias("start"),
        F.least(F.col("n_treated") * multiplier, n).alias("take"),
    )


def sample_controls(controls: DataFrame, strata_table: DataFrame, multiplier: int,
                    seed: int, values: DataFrame | None = None) -> DataFrame:
    """``multiplier`` x treated controls per (site, group), without the full join.

    The controls of a group are put in one seeded random order and every site
    takes a run of it from a seeded start, wrapping round. A run is a simple
    random sample, and since runs are joined by blocks of positions, only rows
    that are sampled (and the rest of their block) are ever produced. Columns of
    ``values`` (by cell) join the controls before they are dealt to the sites.
    """
    drawn = control_runs(strata_table, multiplier, seed)
    n, end = F.col("n_controls"), F.col("start") + F.col("take")
    runs = drawn.select(*STRATUM, F.col("start").alias("_s"), F.least(end, n).alias("_e")).unionAll(
        drawn.filter((end - n) > 0).select(*STRATUM, F.lit(0).cast("bigint"), end - n)
    )
    blocks = runs.withColumn(
        "_block",
        F.explode(F.sequence(F.floor(F.col("_s") / BLOCK), F.floor((F.col("_e") - 1) / BLOCK))),
    )
    placed = control_positions(controls, seed).withColumn(
        "_block", F.floor(F.col("position") / BLOCK)
    )
    extra = []
    if values is not None:
        extra = [c for c in values.columns if c != "cell"]
        placed = placed.join(values, "cell")
    hit = placed.join(blocks, ["group", "_block"]).filter(
        (F.col("position") >= F.col("_s")) & (F.col("position") < F.col("_e"))
    )
    return hit.select("id_numeric", "group", "cell", *extra)


def sampled_cells(pixels, treatment_key, strata_table, cfg: MatchConfig, columns=()) -> DataFrame:
    """(site, group, cell, treatment) rows that enter matching, with ``columns`` of their pixels.

    A control enters for many sites, so its columns are joined once, before that.
    """
    narrow = grouped_pixels(pixels, treatment_key, cfg.exact_match_vars)
    treated = narrow.filter("treatment").join(
        strata_table.select(*STRATUM), STRATUM, "left_semi"
    ).select(*STRATUM, "cell")
    treated = sample_treated(treated, cfg.max_treatment_pixels, cfg.random_seed)
    values = pixels.select("cell", *columns) if columns else None
    if columns:
        treated = treated.join(values, "cell").select(*STRATUM, "cell", *columns)
    controls = sample_controls(
        narrow.filter(~F.col("treatment")), strata_table, cfg.control_multiplier, cfg.random_seed, values
    )
    return treated.withColumn("treatment", F.lit(True)).unionByName(
        controls.withColumn("treatment", F.lit(False))
    )


def with_pre_intervention(rows: DataFrame, sites: DataFrame) -> DataFrame:
    """Add the five-year change before the start, where it applies.

    It applies to sites starting in 2005 or later with both cover years at
    hand; their rows without initial cover are dropped. Which years a site
    compares is worked out on the site table, so a row only looks them up.
    """
    years = cover_years(rows.columns)
    listed = F.array(*[F.lit(y) for y in years])
    start = F.col("start_year")
    first = F.array_position(listed, start - PRE_INTERVENTION_YEARS)
    last = F.array_position(listed, start)
    applies = (start >= PRE_DEFOR_FIRST_START) & (first > 0) & (last > 0)
    spans = sites.select(
        "id_numeric", "start_year", F.coalesce(applies, F.lit(False)).alias("uses_pre_defor"),
        (first - 1).cast("int").alias("_a"), (last - 1).cast("int").alias("_b"),
    )
    cover = F.array(*[F.col(f"fc_{y}").cast("double") for y in years])
    df = rows.withColumn("_fc", cover).join(spans, "id_numeric").withColumns({
        "_init": F.get("_fc", F.col("_a")), "_final": F.get("_fc", F.col("_b")),
    })
    df = df.filter(~F.col("uses_pre_defor") | (F.col("_init") != 0))
    change = (F.col("_final") - F.col("_init")) / F.nullif(F.col("_init"), F.lit(0.0)) * 100
    return df.withColumn(
        "defor_pre_intervention", F.when(F.col("uses_pre_defor"), change)
    ).drop("_fc", "_a", "_b", "_init", "_final")


def shared_groups(rows: DataFrame, keys=tuple(STRATUM)) -> DataFrame:
    """Groups that have both treated and control rows."""
    both = rows.groupBy(*keys).agg(
        F.count_if("treatment").alias("_t"), F.count_if(~F.col("treatment")).alias("_c")
    )
    return both.filter("_t > 0 AND _c > 0").select(*keys)


def keep_shared_groups(rows: DataFrame, keys=tuple(STRATUM)) -> DataFrame:
    return rows.join(shared_groups(rows, keys), list(keys), "left_semi")


def sampled_fraction(entered: DataFrame, treatment_key: DataFrame) -> DataFrame:
    """Treated rows entering matching over treated cells of the site."""
    return fraction_of(entered_counts(entered), treatment_key)


def entered_counts(entered: DataFrame) -> DataFrame:
    return entered.groupBy("id_numeric").agg(
        F.count_if("treatment").alias("n_treatment_final"),
        F.count_if(~F.col("treatment")).alias("n_control_sampled"),
    )


def fraction_of(final: DataFrame, treatment_key: DataFrame) -> DataFrame:
    total = treatment_key.groupBy("id_numeric").agg(F.count("*").alias("n_treatment_total"))
    return total.join(final, "id_numeric").withColumn(
        "sampled_fraction", F.col("n_treatment_final") / F.col("n_treatment_total")
    )


def design_features(rows: DataFrame, cfg: MatchConfig) -> tuple[DataFrame, list[str]]:
    """Complete cases with one double column per model term.

    Categorical ids become indicators of the levels present. NaN counts as
    missing. The pre-intervention term is 0, hence inert, where unused.
    """
    cols, names = {}, []
    for cov in cfg.covariates:
        if cov in CATEGORICAL_VARS:
            found = rows.filter(F.col(cov).isNotNull()).select(cov).distinct().limit(
                MAX_LEVELS + 1
            ).collect()
            if len(found) > MAX_LEVELS:
                raise ValueError(f"{cov} has more than {MAX_LEVELS} levels; match on it exactly")
            for level in sorted(r[0] for r in found)[1:]:
                cols[f"x{len(names)}"] = F.when(F.col(cov).isNotNull(), F.col(cov) == level).cast(
                    "double"
                )
                names.append(f"x{len(names)}")
        else:
            value = F.col(cov).cast("double")
            cols[f"x{len(names)}"] = F.when(~F.isnan(value), value)
            names.append(f"x{len(names)}")
    pre = f"x{len(names)}"
    cols[pre] = F.when(F.col("uses_pre_defor"), F.col("defor_pre_intervention")).otherwise(0.0)
    names.append(pre)
    return rows.withColumns(cols).dropna(subset=names), names


def failures(sites: DataFrame, stages: DataFrame) -> DataFrame:
    """Why a site gave no matches, in the order the stages run.

    ``stages`` has one row per site with ``n_key``, ``n_treatment_final``,
    ``n_control_final`` and ``n_matched``; absent sites count as 0 everywhere. An
    ``error`` column, if there is one, goes before the counts of what was matched.
    """
    stages = stages.withColumnsRenamed({"error": "raised"})
    df = sites.select("id_numeric", "site_id", "site_name").join(stages, "id_numeric", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in
            ("n_key", "n_treatment_final", "n_control_final", "n_matched")}
    raised = F.col("raised") if "raised" in df.columns else F.lit(None).cast("string")
    reason = (
        F.when(zero["n_key"] == 0, "No treatment cells found for site")
        .when(zero["n_treatment_final"] == 0, "No treatment pixels remaining after filtering")
        .when(raised.isNotNull(), raised)
        .when(zero["n_matched"] == 0, F.format_string(
            "No matches found (treatment=%d, control=%d)",
            zero["n_treatment_final"], zero["n_control_final"]))
    )
    return df.withColumn("error", reason).filter("error IS NOT NULL").select(
        "id_numeric", "site_id", "site_name", "error"
    )


def pending_sites(sites: DataFrame, done: DataFrame | None) -> DataFrame:
    """Sites still to match: those without rows in a valid earlier result."""
    from arborlift.config import REQUIRED_MATCH_COLUMNS

    if done is None or set(REQUIRED_MATCH_COLUMNS) - set(done.columns):
        return sites
    return sites.join(done.select("id_numeric").distinct(), "id_numeric", "left_anti")


def _match_sampled(pixels, key, strata_table, sites, cfg: MatchConfig) -> tuple[DataFrame, DataFrame]:
    """(sets, rows entered by site) of strata whose sampled rows are dealt out and staged."""
    from arborlift.operators import pairing, scores

    columns = list(dict.fromkeys([*cfg.covariates, *cfg.cover_columns]))
    rows = sampled_cells(pixels, key, strata_table, cfg, columns)
    rows = stage(with_pre_intervention(rows, sites).drop("start_year", *cfg.cover_columns), "sampled")
    shared = stage(shared_groups(rows), "shared-groups")
    entered = rows.join(shared, STRATUM, "left_semi")
    features, names = design_features(entered, cfg)
    placed = scores.coordinates(features, strata_table, names, cfg)
    return stage(pairing.match_rows(placed, cfg), "sets"), entered_counts(entered)


def _match_chunked(placed, strata_table, sites, cfg: MatchConfig, years) -> tuple[DataFrame, DataFrame]:
    """(sets with weights, rows entered and error by stratum) of strata that fit a task."""
    from arborlift.operators import chunks

    runs, needed = chunks.chunk_runs(strata_table, sites, cfg, years)
    treated, controls = chunks.chunked(placed, runs, needed, cfg)
    if cfg.max_controls_per_treatment:
        out = stage(chunks.match_chunks(treated, controls, cfg, years), "chunk-sets")
        heads = out.where("cell IS NULL")
    else:
        # full matching keeps most of the sampled rows: they are made when they are asked for, and not written
        heads = stage(chunks.match_chunks(treated, controls, cfg, years, rows=False), "chunk-counts")
        out = chunks.match_chunks(treated, controls, cfg, years)
    label = F.concat("group", F.lit(":"), F.col("owner").cast("string"))
    sets = out.where("cell IS NOT NULL").select(
        *STRATUM, "cell", "treatment", label.alias("match_group"), "distance", "pscore", "match_weight")
    return sets, heads.select("id_numeric", "n_treatment_final", "n_control_sampled", "error")


def match_sites(pixels: DataFrame, treatment_key: DataFrame, sites: DataFrame, cfg: MatchConfig,
                todo: DataFrame | None = None, with_pixels: bool = True) -> tuple[DataFrame, DataFrame]:
    """Match all sites at once; returns (matches, failed sites).

    With ``todo`` only those sites are matched, while the treated cells of all
    ``sites`` stay out of the control pool. Without ``with_pixels`` the matches
    need not have the columns of their pixels.
    """
    from arborlift.operators import chunks, pairing, scores

    require_columns(pixels.columns, ["cell", "area_ha", *cfg.layers], "pixel table")
    key = stage(treatment_key.select("cell", "id_numeric").join(
        sites.select("id_numeric"), "id_numeric", "left_semi"), "treated-cells")
    years = chunks.compared_years(sites, cfg)
    placed = chunks.placed_pixels(pixels, key, cfg, years)
    strata_table = strata_of(placed)
    if todo is not None:
        strata_table = strata_table.join(todo.select("id_numeric"), "id_numeric", "left_semi")
        sites = todo
    strata_table = stage(strata_table, "strata")
    simple = chunks.fits(placed, sites, cfg)
    local = (scores.sampled_size(cfg) <= cfg.local_rows) & F.lit(simple)
    sampled = strata_table.where(~local)
    sets, final = _match_chunked(placed, strata_table.where(local), sites, cfg, years)
    final = stage(final, "entered")
    errors = final.where("error IS NOT NULL").select("id_numeric", "error")
    final = final.drop("error")
    if not sampled.isEmpty():
        more, counts = _match_sampled(pixels, key, sampled, sites, cfg)
        errors = errors.unionByName(more.where("error IS NOT NULL").select("id_numeric", "error"))
        final = final.unionByName(counts)
        site_sets = ["id_numeric", "group", "match_group"]
        more = pairing.with_match_weights(more.where("error IS NULL").drop("error"), site_sets)
        sets = sets.unionByName(more)
    # a site with a stratum that failed has failed; the others go on
    raised = stage(errors.groupBy("id_numeric").agg(F.min("error").alias("error")), "raised")
    if not raised.isEmpty():
        sets = sets.join(raised, "id_numeric", "left_anti")

    share = fraction_of(final.groupBy("id_numeric").agg(*[F.sum(c).alias(c) for c in final.columns[1:]]), key)
    pool = control_pool(strata_table)
    per_site = stage(
        share.join(pool, "id_numeric").join(sites.select("id_numeric", "site_id"), "id_numeric"),
        "site-counts",
    )
    counts = per_site.select(
        "id_numeric", "site_id", "sampled_fraction", "n_control_sampled", "n_control_pool"
    )
    matches = sets.join(counts, "id_numeric")
    if with_pixels or not simple:
        keep = list(dict.fromkeys(["cell", "area_ha", *cfg.layers]))
        # matched rows are few: their pixels are fetched again, and the
        # pre-intervention change is worked out again rather than carried along
        matches = with_pre_intervention(
            matches.join(pixels.select(*keep), "cell"), sites
        ).drop("start_year", "uses_pre_defor")

    matched = sets.groupBy("id_numeric").agg(F.count("*").alias("n_matched"))
    stages = (
        key.groupBy("id_numeric").agg(F.count("*").alias("n_key"))
        .join(per_site.select("id_numeric", "n_treatment_final",
                              F.col("n_control_sampled").alias("n_control_final")),
              "id_numeric", "left")
        .join(matched, "id_numeric", "left")
        .join(raised, "id_numeric", "left")
    )
    return matches, failures(sites, stages)
