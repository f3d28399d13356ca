"""Sampling, scores and pairing against brute force and against each other."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from arborlift.config import MatchConfig
from arborlift.functions import solve
from arborlift.operators import matching, proximity, scores
from arborlift.sources import shared_tables as T


def config(**changes):
    base = dict(covariates=T.COVARIATES, exact_match_vars=T.EXACT, fc_years=T.YEARS, random_seed=7)
    return MatchConfig(**{**base, **changes})


def run(spark, sf, **changes):
    sites = T.sites(spark, sf).filter("area_ha >= 100")
    return matching.match_sites(
        T.candidates(spark, sf), T.treatment_key(spark, sf), sites, config(**changes)
    )


def brute_greedy(t, tc, c, cc, k, caliper):
    """Passes of nearest pair first; units that stay short release their controls."""
    gaps = {(i, j): round(float(np.sqrt(((t[i] - c[j]) ** 2).sum())), 9) for i in range(len(tc)) for j in range(len(cc))}
    used, done, left = set(), {}, list(range(len(tc)))
    while True:
        free = {i: sorted((gaps[i, j], cc[j], j) for j in range(len(cc))
                          if j not in used and (caliper == 0 or gaps[i, j] <= caliper)) for i in left}
        left = [i for i in left if len(free[i]) >= k]
        if not left:
            return {i: sorted(int(cc[j]) for j in v) for i, v in done.items()}
        taken, got = set(), {i: [] for i in left}
        for _, _, _, i, j in sorted((d, tc[i], cell, i, j) for i in left for d, cell, j in free[i]):
            if j not in taken and len(got[i]) < k:
                taken.add(j)
                got[i].append(j)
        complete = {i: v for i, v in got.items() if len(v) == k}
        if not complete:
            first = min(left, key=lambda i: (free[i][0][0], tc[i]))
            complete = {first: [j for _, _, j in free[first][:k]]}
        done |= complete
        used |= {j for v in complete.values() for j in v}
        left = [i for i in left if i not in complete]


def test_incomplete_sets_release_their_controls():
    t, c = np.array([[0.0], [0.9]]), np.array([[0.45], [1.3], [5.0]])
    got = solve.greedy_pairs(t, np.arange(2), c, np.arange(3), 2, 0.5)
    assert {i: [cell for cell, _ in v] for i, v in got.items()} == {1: [1, 0]}


@pytest.mark.parametrize("dims", [1, 3])
@pytest.mark.parametrize("k,caliper", [(1, 0.0), (1, 0.1), (2, 0.3), (3, 0.0)])
@pytest.mark.parametrize("rounding", [8, 1])
def test_greedy_equals_brute_force(dims, k, caliper, rounding):
    rng = np.random.default_rng(dims * 100 + k)
    t = rng.normal(size=(25, dims)).round(rounding)
    c = rng.normal(size=(120, dims)).round(rounding)
    tc, cc = np.arange(25), rng.permutation(np.arange(1000, 1120))
    got = solve.greedy_pairs(t, tc, c, cc, k, caliper)
    plain = {i: sorted(int(cell) for cell, _ in v) for i, v in got.items()}
    assert plain == brute_greedy(t, tc, c, cc, k, caliper)


def test_greedy_reports_a_short_horizon():
    t, c = np.zeros((5, 1)), np.arange(20.0)[:, None]
    assert solve.greedy_pairs(t, np.arange(5), c, np.arange(20), 1, 0.0, horizon=3) is None
    assert len(solve.greedy_pairs(t, np.arange(5), c, np.arange(20), 1, 0.0, horizon=5)) == 5


@pytest.mark.parametrize("dims", [1, 2])
def test_nearest_each_equals_brute_force(dims):
    rng = np.random.default_rng(3)
    p = rng.normal(size=(200, dims)).round(1)
    t = rng.normal(size=(40, dims)).round(1)
    cells = rng.permutation(40)
    d, at = solve.nearest_each(p, t, cells)
    for i in range(200):
        gaps = np.sqrt(((t - p[i]) ** 2).sum(axis=1))
        best = min(range(40), key=lambda j: (gaps[j], cells[j]))
        assert d[i] == pytest.approx(gaps[best])
        assert gaps[at[i]] == pytest.approx(gaps[best])
        if dims == 1:
            assert abs(gaps[at[i]] - gaps[best]) < 1e-12


def test_sample_sizes_and_determinism(spark, sf):
    pixels, key = T.candidates(spark, sf), T.treatment_key(spark, sf)
    table = matching.strata(pixels, key, T.EXACT)
    cfg = config(max_treatment_pixels=5, control_multiplier=2)
    cells = matching.sampled_cells(pixels, key, table, cfg)
    counts = cells.groupBy("id_numeric", "group").agg(
        F.count_if("treatment").alias("t"), F.count_if(~F.col("treatment")).alias("c"),
        F.countDistinct("cell").alias("d"), F.count("*").alias("n"),
    ).join(table, ["id_numeric", "group"]).collect()
    assert counts
    for r in counts:
        assert r.t == min(5, r.n_treated)
        # the control cap follows the treated count before treatment sampling
        assert r.c == min(2 * r.n_treated, r.n_controls)
        assert r.d == r.n
    again = matching.sampled_cells(pixels.repartition(3), key, table, cfg)
    assert cells.exceptAll(again).isEmpty() and again.exceptAll(cells).isEmpty()


def test_sample_is_the_first_of_the_seeded_order(spark, sf):
    rows = matching.grouped_pixels(T.candidates(spark, sf), T.treatment_key(spark, sf), T.EXACT)
    treated = rows.filter("treatment").select("id_numeric", "group", "cell")
    got = {tuple(r) for r in matching.sample_treated(treated, 9, 1).collect()}
    want = set()
    order = {}
    for r in treated.collect():
        digest = hashlib.md5(f"1:{r.id_numeric}:{r.cell}".encode()).hexdigest()
        order.setdefault((r.id_numeric, r.group), []).append((digest, r.cell))
    for key, cells in order.items():
        want |= {(*key, cell) for _, cell in sorted(cells)[:9]}
    assert got == want


def key_rows(df, columns):
    return df.select(*columns).toPandas().sort_values(columns[:3]).reset_index(drop=True)


@pytest.mark.parametrize("k", [1, 2])
def test_distributed_path_gives_the_local_result(spark, sf, k):
    columns = ["id_numeric", "group", "cell", "treatment", "match_group", "match_weight", "pscore"]
    local, _ = run(spark, sf, max_controls_per_treatment=k, caliper_width=0.5)
    spread, _ = run(spark, sf, max_controls_per_treatment=k, caliper_width=0.5, local_rows=40)
    a, b = key_rows(local, columns), key_rows(spread, columns)
    assert len(a) > 100
    pd.testing.assert_frame_equal(a, b, check_exact=False, rtol=1e-6)


def test_pairs_keep_their_promises(spark, sf):
    m, _ = run(spark, sf, max_controls_per_treatment=2)
    sets = m.groupBy("site_id", "group", "match_group").agg(
        F.count_if("treatment").alias("t"), F.count_if(~F.col("treatment")).alias("c"),
        F.sum(F.when(~F.col("treatment"), F.col("match_weight"))).alias("w"),
        F.max("distance").alias("d"),
    ).toPandas()
    assert len(sets) and (sets.t == 1).all() and (sets.c == 2).all()
    assert np.allclose(sets.w, sets.t) and (sets.d <= 0.2).all()
    twice = m.filter("NOT treatment").groupBy("site_id", "cell").count().filter("count > 1")
    assert twice.isEmpty()


def test_full_matching_sets(spark, sf):
    m, _ = run(spark, sf, max_controls_per_treatment=0)
    sets = m.groupBy("site_id", "group", "match_group").agg(
        F.count_if("treatment").alias("t"), F.count_if(~F.col("treatment")).alias("c"),
        F.sum(F.when(~F.col("treatment"), F.col("match_weight"))).alias("w"),
    ).toPandas()
    assert len(sets) and (sets.t == 1).all() and (sets.c >= sets.t).all() and np.allclose(sets.w, sets.t)
    spread, _ = run(spark, sf, max_controls_per_treatment=0, local_rows=40)
    columns = ["id_numeric", "group", "cell", "treatment", "match_group", "match_weight"]
    pd.testing.assert_frame_equal(
        key_rows(m, columns), key_rows(spread, columns), check_exact=False, rtol=1e-6
    )


def test_logit_agrees_with_spark_glm(spark, sf):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    px = T.pixels(spark, sf).dropna().drop("id_numeric", "near_site")
    px = T.pixels(spark, sf).dropna(subset=list(T.COVARIATES)).select(
        "cell", F.col("id_numeric").isNotNull().alias("treatment"), *T.COVARIATES
    )
    names = ["x0", "x1", "x2", "x3"]
    rows = px.select(
        F.lit(1).alias("id_numeric"), F.lit("g").alias("group"), "cell", "treatment",
        *[F.col(c).alias(n) for c, n in zip(T.COVARIATES, names)],
    )
    ours = scores.distributed_coordinates(rows, names, config()).select("cell", "pscore")
    pdf = rows.toPandas()
    local = 1 / (1 + np.exp(-solve.logit_score(pdf[names].to_numpy(), pdf.treatment.to_numpy())))
    local = pd.Series(local, index=pdf.cell)
    vec = VectorAssembler(inputCols=names, outputCol="features").transform(
        rows.withColumn("label", F.col("treatment").cast("double"))
    )
    model = GeneralizedLinearRegression(family="binomial", maxIter=50, tol=1e-10).fit(vec)
    theirs = model.transform(vec).select("cell", "prediction")
    both = ours.join(theirs, "cell").toPandas()
    assert np.abs(both.pscore - both.prediction).max() < 1e-6
    assert np.abs(both.set_index("cell").pscore - local.loc[both.cell]).max() < 1e-8


def test_separable_and_constant_columns():
    x = np.column_stack([np.arange(40.0), np.ones(40), np.arange(40.0) * 2])
    y = np.arange(40) >= 20
    score = solve.logit_score(x, y)
    assert np.isfinite(score).all() and score[-1] > score[0]


def test_mahalanobis_coordinates(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 3)) @ np.array([[2, 0.5, 0], [0, 1, 0.3], [0, 0, 0.1]])
    t = np.arange(60) < 10
    centred = np.vstack([x[t] - x[t].mean(axis=0), x[~t] - x[~t].mean(axis=0)])
    inverse = np.linalg.inv(centred.T @ centred / 58)
    coords = solve.whitened(x, t)
    for i, j in ((0, 20), (3, 59), (9, 33)):
        d = x[i] - x[j]
        assert np.linalg.norm(coords[i] - coords[j]) == pytest.approx(np.sqrt(d @ inverse @ d))
    pdf = pd.DataFrame(x, columns=["x0", "x1", "x2"]).assign(
        id_numeric=np.int32(1), group="g", cell=np.arange(60), treatment=t)
    rows = spark.createDataFrame(pdf)
    out = scores.distributed_coordinates(
        rows.withColumn("id_numeric", F.col("id_numeric").cast("int")), ["x0", "x1", "x2"],
        config(min_glm_treatment_pixels=100),
    ).toPandas().sort_values("cell")
    far = np.vstack(out.coords.to_numpy())
    d = x[0] - x[20]
    assert np.linalg.norm(far[0] - far[20]) == pytest.approx(np.sqrt(d @ inverse @ d))
    assert out.pscore.isna().all()


def strata_case(spark):
    pixels = spark.createDataFrame(
        [(i, a, e) for i, (a, e) in enumerate(
            [(1, 1), (1, 1), (1, 1), (2, 1), (2, 1), (0, 1), (0, 1), (None, 1), (3, 1)])],
        "cell bigint, admin1 int, ecoregion int",
    )
    key = spark.createDataFrame(
        [(0, 1, 1.0, "A"), (3, 1, 1.0, "A"), (4, 2, 1.0, "B"), (5, 2, 1.0, "B"), (7, 2, 1.0, "B")],
        "cell bigint, id_numeric int, area_ha double, site_id string",
    )
    return pixels, key


def test_strata_rules(spark):
    """0 is a group, NULL is none, and other sites' treated cells are no controls."""
    pixels, key = strata_case(spark)
    got = {(r.id_numeric, r.group): (r.n_treated, r.n_controls)
           for r in matching.strata(pixels, key, ("admin1", "ecoregion")).collect()}
    assert got == {(1, "1.1"): (1, 2), (2, "0.1"): (1, 1)}


def test_pre_intervention_rules(spark):
    rows = spark.createDataFrame(
        [(1, 1, 50.0, 40.0, 30.0), (2, 1, 0.0, 0.0, 0.0), (3, 2, 50.0, 40.0, 30.0),
         (4, 3, 50.0, 40.0, 30.0), (5, 1, None, 40.0, 30.0)],
        "cell bigint, id_numeric int, fc_2000 double, fc_2005 double, fc_2006 double",
    )
    sites = spark.createDataFrame([(1, 2005), (2, 2004), (3, 2006)], "id_numeric int, start_year int")
    out = {r.cell: r.defor_pre_intervention
           for r in matching.with_pre_intervention(rows, sites).collect()}
    # 2005 has both years: computed, zero and missing first cover dropped; the rest do not apply
    assert out == {1: pytest.approx(-20.0), 3: None, 4: None}


def test_failures_and_fraction(spark, sf):
    m, failed = run(spark, sf)
    sites = {r.site_id for r in T.sites(spark, sf).filter("area_ha >= 100").collect()}
    done = {r.site_id for r in m.select("site_id").distinct().collect()}
    lost = {r.site_id for r in failed.collect()}
    assert done | lost == sites and not done & lost
    for r in m.select("sampled_fraction").distinct().collect():
        assert 0 < r.sampled_fraction <= 1
    none, all_failed = run(spark, sf, min_site_area_ha=0, caliper_width=1e-12)
    assert all("No matches found" in r.error or "No treatment" in r.error
               for r in all_failed.collect())
    assert none.columns == m.columns


def test_nearest_control_equals_brute_force(spark):
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({
        "id_numeric": rng.integers(1, 3, 400).astype("int32"), "group": "g",
        "cell": np.arange(400), "treatment": rng.random(400) < 0.3,
        "score": rng.normal(size=400).round(2) * 10,
    })
    near = proximity.nearest_control(spark.createDataFrame(pdf)).toPandas().set_index("treated_cell")
    for r in pdf[pdf.treatment].itertuples():
        pool = pdf[(~pdf.treatment) & (pdf.id_numeric == r.id_numeric)]
        gaps = (pool.score - r.score).abs()
        assert near.loc[r.cell].distance == pytest.approx(gaps.min())
        ties = pool.cell[np.isclose(gaps, gaps.min())]
        assert near.loc[r.cell].control_cell in set(ties)
    assert len(near) == pdf.treatment.sum()


def test_resume_skips_finished_sites(spark, sf):
    sites = T.sites(spark, sf)
    m = T.matches(spark, sf).filter("id_numeric <= 4")
    left = {r.id_numeric for r in matching.pending_sites(sites, m).collect()}
    assert left == {r.id_numeric for r in sites.collect()} - {1, 2, 3, 4}
    # a result without the needed columns does not count as finished
    assert matching.pending_sites(sites, m.drop("match_weight")).count() == sites.count()


def test_config_guards():
    with pytest.raises(ValueError):
        MatchConfig(covariates=("pa",), exact_match_vars=("pa",))
    with pytest.raises(ValueError):
        MatchConfig(covariates=("elev",), exact_match_vars=())
    with pytest.raises(ValueError):
        config(caliper_width=-1)
    with pytest.raises(ValueError):
        config(random_seed=0)
    with pytest.raises(ValueError):
        config(ready_covariates=("elev",))
    assert config().layers[:5] == ["precip", "elev", "pop_2015", "dist_cities", "total_biomass"]


def test_categorical_terms_become_indicators(spark):
    rows = spark.createDataFrame(
        [(1, 10, 1.0), (2, 20, 2.0), (3, 30, 3.0), (4, None, 4.0), (5, 20, float("nan"))],
        "cell bigint, ecoregion int, elev double",
    ).withColumns({"uses_pre_defor": F.lit(False), "defor_pre_intervention": F.lit(None).cast("double")})
    cfg = MatchConfig(covariates=("ecoregion", "elev"), exact_match_vars=("pa",))
    out, names = matching.design_features(rows, cfg)
    got = {r.cell: [r[n] for n in names] for r in out.collect()}
    assert got == {1: [0, 0, 1, 0], 2: [1, 0, 2, 0], 3: [0, 1, 3, 0]}


@pytest.mark.parametrize("changes", [{}, {"max_controls_per_treatment": 2}, {"max_controls_per_treatment": 0}, {"local_rows": 40}])
def test_a_poisoned_stratum_fails_its_site_alone(spark, sf, changes):
    """Infinite covariates in one site's stratum: one marker for it, and all other sites as before."""
    sites = T.sites(spark, sf).filter("area_ha >= 100")
    key, pixels = T.treatment_key(spark, sf), T.candidates(spark, sf)
    cfg = config(**changes)
    plain, lost = matching.match_sites(pixels, key, sites, cfg)
    plain = key_rows(plain, ["site_id", "cell", "match_group", "treatment"])
    victim = plain.site_id.iloc[0]
    cell = plain[(plain.site_id == victim) & plain.treatment].cell.iloc[0]
    elev = F.when(F.col("cell") == int(cell), float("inf")).otherwise(F.col("elev"))
    got, failed = matching.match_sites(pixels.withColumn("elev", elev), key, sites, cfg)
    got = key_rows(got, ["site_id", "cell", "match_group", "treatment"])
    pd.testing.assert_frame_equal(got, plain[plain.site_id != victim].reset_index(drop=True))
    before, after = ({r.site_id: r.error for r in f.collect()} for f in (lost, failed))
    assert set(after) == set(before) | {victim} and "not finite" in after[victim]


def test_full_matching_of_strata_out_of_reach(spark, sf):
    """A caliper no left-over control lies within: such a stratum adds no rows, and nothing fails."""
    m, _ = run(spark, sf, max_controls_per_treatment=0, caliper_width=1e-7)
    assert m.filter("NOT treatment AND distance > 1e-7").isEmpty()


def test_controls_within_counts_without_pairs(spark):
    rng = random.Random(9)
    scores = [rng.choice([0.1 * k for k in range(-20, 20)] + [5 + 1e-9 * k for k in range(30)]) for _ in range(600)]
    rows = [(i % 3, "g" if i % 5 else None, i, i % 4 == 0, s) for i, s in enumerate(scores)]
    rows += [(0, "g", 1000 + i, i % 2 == 0, v) for i, v in enumerate(
        [None, None, float("nan"), float("nan"), float("inf"), float("inf"), float("-inf"), float("-inf")])]
    # a third of all rows on one score of one stratum
    rows += [(1, "g", 2000 + i, False, 0.3) for i in range(300)]
    df = spark.createDataFrame(rows, "id_numeric int, group string, cell int, treatment boolean, score double")
    for caliper in (0.1, 0.2, 1e-9, 40.0):
        want = {}
        for i, g, cell, t, s in rows:
            if t:
                want[cell] = 0 if s is None or g is None else sum(
                    1 for i2, g2, _, t2, s2 in rows
                    if not t2 and s2 is not None and (i2, g2) == (i, g) and abs(s - s2) <= caliper)
        got = {r.treated_cell: r.n_within for r in proximity.controls_within(df, caliper).collect()}
        assert got == want
    assert proximity.controls_within(df.limit(0), 0.1).isEmpty()
    with pytest.raises(ValueError):
        proximity.controls_within(df, 0.0)


def most_pairs(near):
    """Size of a largest pairing, by plain augmenting paths over each unit's near controls."""
    owner = {}

    def place(i, seen):
        for j in near[i]:
            if j not in seen:
                seen.add(j)
                if j not in owner or place(owner[j], seen):
                    owner[j] = i
                    return True
        return False

    return sum(place(i, set()) for i in range(len(near)))


@pytest.mark.parametrize("dims", [1, 2])
@pytest.mark.parametrize("horizon", [None, 3, 40])
def test_exchanges_pair_as_many_as_can_be(dims, horizon):
    rng = np.random.default_rng(dims)
    gained = 0
    for _ in range(40):
        t, c = rng.normal(size=(30, dims)).round(2), rng.normal(size=(28, dims)).round(2)
        tc, cc = rng.permutation(30), rng.permutation(28)
        gaps = np.sqrt(((t[:, None] - c[None]) ** 2).sum(axis=2)).round(9)
        want = most_pairs([np.flatnonzero(row <= 0.3).tolist() for row in gaps])
        plain = solve.greedy_pairs(t, tc, c, cc, 1, 0.3)
        got = solve.greedy_pairs(t, tc, c, cc, 1, 0.3, horizon, most=True)
        if got is None:
            assert horizon == 3
            continue
        at = {cell: j for j, cell in enumerate(cc.tolist())}
        assert len(got) == want and set(plain) <= set(got)
        assert len({cell for [(cell, _)] in got.values()}) == want
        assert all(d == gaps[i, at[cell]] <= 0.3 for i, [(cell, d)] in got.items())
        if horizon:
            assert got == solve.greedy_pairs(t, tc, c, cc, 1, 0.3, most=True)
        gained += want - len(plain)
    assert gained or horizon == 3


def test_full_matching_leaves_nobody_out_that_can_be_matched(spark):
    """Treated 2 reaches control 10 alone, which the nearer treated 1 takes first; 1 can move on to control 11."""
    from arborlift.operators import pairing

    rows = [(1, "g", 1, True, [0.0]), (1, "g", 2, True, [0.15]), (1, "g", 10, False, [0.05]),
            (1, "g", 11, False, [-0.15]), (1, "g", 13, False, [9.0])]
    placed = spark.createDataFrame([(*r, None, None) for r in rows], pairing.COORDS_SCHEMA)
    got = {(r.cell, r.match_group) for r in pairing.assign_full(placed, config(caliper_width=0.2)).collect()}
    assert got == {(1, "g:1"), (11, "g:1"), (2, "g:2"), (10, "g:2")}


CHUNKED = ["id_numeric", "group", "cell", "treatment", "match_group", "match_weight", "pscore", "sampled_fraction",
           "n_control_sampled", "n_control_pool"]


@pytest.mark.parametrize("k", [0, 2])
def test_chunks_give_what_dealt_out_rows_give(spark, sf, monkeypatch, k):
    """Small chunks, runs that wrap round, treated rows over their cap; then the same with all rows dealt out to their sites."""
    from arborlift.operators import chunks

    changes = dict(max_controls_per_treatment=k, max_treatment_pixels=15, control_multiplier=3, caliper_width=0.5)
    with monkeypatch.context() as patched:
        patched.setattr(chunks, "NARROW", 16)
        patched.setattr(chunks, "WIDE", 64)
        patched.setattr(chunks, "ROWS_A_CHUNK", 100)
        # sampled rows are not dealt out to the sites on this way
        patched.setattr(matching, "sampled_cells", None)
        small, lost = run(spark, sf, **changes)
        small, lost = key_rows(small, CHUNKED), sorted(map(tuple, lost.collect()))
    with monkeypatch.context() as patched:
        patched.setattr(chunks, "fits", lambda *_: False)
        dealt, failed = run(spark, sf, **changes)
        dealt, failed = key_rows(dealt, CHUNKED), sorted(map(tuple, failed.collect()))
    assert len(small) > 100 and lost == failed
    pd.testing.assert_frame_equal(small, dealt, check_exact=False, rtol=1e-6)


def test_missing_cover_in_chunks(spark, monkeypatch):
    """Rows without initial cover leave, a missing final cover counts as entered, and a cell that comes twice goes the other way."""
    from arborlift.operators import chunks

    rng = random.Random(4)
    first = [None, 0.0, float("nan"), 50.0, 60.0, 70.0]
    rows = [(i, i % 2, rng.random(), rng.choice(first), rng.choice([None, float("nan"), 30.0, 40.0]), 1.0, 2.0)
            for i in range(400)]
    # pixels without a cell are never matched, but count in the order
    rows += [(None, i % 2, 0.5, 50.0, 40.0, 1.0, 2.0) for i in range(9)]
    names = "cell bigint, pa int, elev double, fc_2000 double, fc_2005 double, area_ha double, total_biomass double"
    key = spark.createDataFrame([(i, 1 + i % 3 % 2) for i in range(60)] + [(3, 9)], "cell bigint, id_numeric int")
    sites = spark.createDataFrame([(1, "A", "a", 2005), (2, "B", "b", 2001), (9, "C", "c", None)],
                                  "id_numeric int, site_id string, site_name string, start_year int")
    cfg = MatchConfig(covariates=("elev",), exact_match_vars=("pa",), fc_years=(2000, 2005), random_seed=3,
                      control_multiplier=4, min_glm_treatment_pixels=3, caliper_width=0.3)
    for extra in ([], [rows[70]]):
        pixels = spark.createDataFrame(rows + extra, names)
        got = []
        for way in (None, lambda *_: False):
            with monkeypatch.context() as patched:
                if way:
                    patched.setattr(chunks, "fits", way)
                m, _ = matching.match_sites(pixels, key, sites, cfg)
                got.append(key_rows(m, [*CHUNKED, "distance"]))
        assert len(got[0]) > 10 and set(got[0].id_numeric) >= {1, 2}
        pd.testing.assert_frame_equal(*got, check_exact=False, rtol=1e-6)
    narrow, _ = matching.match_sites(pixels.dropDuplicates(["cell"]), key, sites, cfg, with_pixels=False)
    wide, _ = matching.match_sites(pixels.dropDuplicates(["cell"]), key, sites, cfg)
    assert sorted(map(str, narrow.collect())) == sorted(map(str, wide.select(narrow.columns).collect()))


@pytest.mark.parametrize("caliper", [0.0, 0.25])
@pytest.mark.parametrize("decimals", [1, 12])
def test_walk_goes_in_the_order_of_the_nearest(caliper, decimals):
    rng = np.random.default_rng(decimals)
    c = rng.normal(size=(300, 1)).round(decimals)
    c[:40] = c[0] + np.arange(40)[:, None] * 3e-10  # nearer to each other than distances count
    cells = rng.permutation(np.arange(300) // 2)
    pool = solve.NearestControls(c, cells)
    for point in [*rng.normal(size=20).round(decimals).tolist(), float(c[0, 0]), 50.0]:
        distance, position = pool.nearest(np.array([point]), 300, caliper)
        assert list(pool.walk(point, caliper)) == list(zip(distance.tolist(), position.tolist()))
