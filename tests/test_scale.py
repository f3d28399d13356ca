"""Plans that must not change shape as tables grow."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from arborlift.config import MatchConfig
from arborlift.functions import stats
from arborlift.operators import extract, matching, quality, raster, registry, scores


def plan_of(df, capsys) -> str:
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def counted(spark, rows, schema):
    """The rows as a frame, and how many of them were ever read."""
    seen = spark.sparkContext.accumulator(0)

    def tell(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    return spark.createDataFrame(rows, schema).mapInPandas(tell, schema), seen


def match_rows():
    return [(f"S{i % 3}", i % 2 == 0, float(i), i / 7) for i in range(60)]


MATCHES = "site_id string, treatment boolean, a double, pscore double"


@pytest.mark.parametrize("histogram", [
    quality.histogram_local, quality.histogram_global, quality.histogram_equal_width])
def test_histograms_read_the_matches_once(spark, histogram):
    df, seen = counted(spark, match_rows(), MATCHES)
    out = histogram(df, ["a"]).collect()
    assert seen.value == 60
    run = [r for r in out if getattr(r, "site_id", quality.ALL_SCOPE) == quality.ALL_SCOPE]
    assert len(run) == 40 and sum(r.treatment_pct for r in run) == pytest.approx(100)


@pytest.mark.parametrize("adaptive", [False, True])
def test_score_quantiles_read_the_matches_once(spark, adaptive):
    df, seen = counted(spark, match_rows(), MATCHES)
    out = quality.qq_pairs(df, adaptive).collect()
    assert seen.value == 60
    points = {r.site_id: sum(o.site_id == r.site_id for o in out) for r in out}
    assert points == ({"S0": 10, "S1": 10, "S2": 10, "__all__": 30} if adaptive
                      else dict.fromkeys(["S0", "S1", "S2", "__all__"], 500))
    last = {r.site_id: r for r in out if r.quantile == 1}["__all__"]
    assert (last.treatment_value, last.control_value) == (pytest.approx(58 / 7), pytest.approx(59 / 7))


def test_tasks_follow_the_rows(spark, capsys):
    """Sorters get as many tasks as the rows ask for, however few bytes those are on the wire."""
    values = spark.createDataFrame([(i % 2, float(i)) for i in range(40)], "k int, v double")
    cells = spark.createDataFrame([(i, j, float(i * j)) for i in range(5) for j in range(5)],
                                  "row bigint, col bigint, elevation double")
    layers = spark.createDataFrame([("x", 1, 2.0), ("y", 1, 3.0)], "layer string, cell bigint, value double")
    for df in (stats.value_ranks(values, ["k"], "v"), raster.gradient(cells, F.lit(1.0)),
               extract.pivot_layers(layers, ["x", "y"])):
        assert "REPARTITION_BY_NUM" in plan_of(df, capsys)


def test_layer_values_are_not_dealt_out_by_layer(spark, capsys):
    values = spark.createDataFrame([("a", float(i)) for i in range(200)], "layer string, value double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in plan_of(registry.layer_histogram(values), capsys)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_newton_step_sorts_no_rows(spark, capsys):
    rows = spark.createDataFrame([(1, "g", i, i % 3 == 0, i / 10) for i in range(30)],
                                 "id_numeric int, group string, cell bigint, treatment boolean, x0 double")
    betas = spark.createDataFrame([(1, "g", [0.0, 0.0], float("inf"), False)],
                                  "id_numeric int, group string, beta array<double>, deviance double, done boolean")
    assert "SortAggregate" not in plan_of(scores._logit_step(rows, betas, ["x0"]), capsys)


def test_columns_join_controls_before_they_are_dealt_out(spark):
    pixels = spark.createDataFrame([(i, i % 2, i / 3) for i in range(80)], "cell bigint, pa int, elev double")
    key = spark.createDataFrame([(i, 1 + i % 2) for i in range(12)], "cell bigint, id_numeric int")
    cfg = MatchConfig(covariates=("elev",), exact_match_vars=("pa",), fc_years=(2000,), control_multiplier=3, random_seed=5)
    table = matching.strata(pixels, key, cfg.exact_match_vars)
    rows = matching.sampled_cells(pixels, key, table, cfg, ["elev"])
    plain = matching.sampled_cells(pixels, key, table, cfg).join(pixels.select("cell", "elev"), "cell")
    names = ["id_numeric", "group", "cell", "treatment", "elev"]
    assert sorted(map(tuple, rows.select(names).collect())) == sorted(map(tuple, plain.select(names).collect()))
    assert rows.count() > 12


def test_staging_leaves_no_shuffle_files(spark):
    """What was shuffled for a staged table goes from the disks, and the setting is as before."""
    import time
    from pathlib import Path

    from arborlift import session

    def files():
        return {p for p in Path(spark.conf.get("spark.local.dir")).rglob("shuffle_*.data")}

    before, setting = files(), spark.conf.get(session.SHUFFLE_CLEANUP, None)
    staged = session.stage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "shuffled")
    for _ in range(100):  # files are removed in the background
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert not left and staged.count() == 7
    assert spark.conf.get(session.SHUFFLE_CLEANUP, None) == setting


@pytest.mark.parametrize("few", [0, 20_000])
def test_score_quantiles_are_dealt_out_before_they_are_points(spark, capsys, monkeypatch, few):
    """Values that answer points are shuffled, not the points, and scopes ranked whole or in buckets give the same."""
    import numpy as np

    monkeypatch.setattr(quality, "FEW_SCORES", few)
    rows = [("A", i % 3 == 0, float((i * 37) % 101) / 7) for i in range(200)] + [("B", i % 2 == 0, 0.5) for i in range(40)]
    rows += [("C", True, None), ("C", False, 1.0), ("D", True, 2.0), ("D", True, -3.0), ("D", False, 0.0), ("D", False, 1e9)]
    rows += [("E", i % 2 == 0, i / 1000) for i in range(3000)]
    out = quality.qq_pairs(spark.createDataFrame(rows, "site_id string, treatment boolean, pscore double"))
    plan = plan_of(out, capsys)
    assert plan.index("Generate explode(sequence(") < plan.index("Exchange ")
    got = {}
    for r in out.collect():
        got.setdefault(r.site_id, []).append((r["index"], r.quantile, r.treatment_value, r.control_value))
    assert set(got) == {"A", "B", "D", "E", "__all__"}
    for scope, points in got.items():
        points.sort()
        assert [p[0] for p in points] == list(range(500))
        for at, arm in ((2, True), (3, False)):
            values = [v for s, t, v in rows if t == arm and v is not None and scope in (s, "__all__")]
            want = np.quantile(values, [p[1] for p in points])
            assert [p[at] for p in points] == pytest.approx(want.tolist(), rel=1e-9, abs=1e-9)


def test_few_columns_of_the_matches_are_the_same_rows(spark, sf):
    from arborlift.sources import shared_tables as T

    names = ["site_id", "group", "match_group", "treatment", "pscore", "match_weight"]
    few, all_of_them = T.matches(spark, sf, "pscore"), T.matches(spark, sf)
    assert sorted(few.columns) == sorted(names)
    assert few.select(names).exceptAll(all_of_them.select(names)).isEmpty() and few.count() == all_of_them.count()
