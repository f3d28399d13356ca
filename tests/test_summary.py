"""Hand-computed panels, weights and quality figures."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from arborlift.operators import pairing, quality, summary

MATCH = (
    "cell bigint, site_id string, id_numeric int, group string, treatment boolean, area_ha double, "
    "sampled_fraction double, total_biomass double, match_group string, match_weight double"
)
SITES = "id_numeric int, site_id string, site_name string, start_year int, end_year int, area_ha double"


def matches(spark, cover, **override):
    """cover: {cell: (treatment, weight, {year: fc})}."""
    years = sorted({y for _, _, fc in cover.values() for y in fc})
    rows = [
        (cell, "A", 1, "g", t, 100.0, override.get("fraction", 1.0), 200.0, "g:1", w,
         *[fc.get(y) for y in years])
        for cell, (t, w, fc) in cover.items()
    ]
    return spark.createDataFrame(rows, MATCH + "".join(f", fc_{y} double" for y in years))


def sites(spark, start=2004, end=2099):
    return spark.createDataFrame([(1, "A", "Alpha", start, end, 500.0)], SITES)


def test_panel_gain_zero_cover_and_range(spark):
    m = matches(spark, {
        1: (True, 1.0, {2000: 80.0, 2001: 60.0, 2002: 70.0}),
        2: (False, 1.0, {2000: 0.0, 2001: 0.0, 2002: 0.0}),
    })
    rows = {(r.cell, r.year): r for r in summary.pixel_panel(m, sites(spark)).collect()}
    # the first year is only the base of the difference
    assert set(rows) == {(1, 2001), (1, 2002), (2, 2001), (2, 2002)}
    assert rows[1, 2001].forest_change_ha == pytest.approx(-20)
    assert rows[1, 2002].forest_change_ha == pytest.approx(10)
    # 200 Mg x (0.75 - 1) x 0.5 x -3.67
    assert rows[1, 2001].emissions_mgco2e == pytest.approx(91.75)
    assert rows[1, 2002].emissions_mgco2e == pytest.approx(-45.875)
    # no initial cover: the fraction is undefined, not an error
    assert rows[2, 2001].emissions_mgco2e is None and rows[2, 2001].forest_change_ha == 0
    y = {r.year: r for r in summary.site_year(summary.pixel_panel(m, sites(spark)), sites(spark)).collect()}
    # a gain counts as a loss, as absolute changes are summed
    assert y[2002].treatment_defor_ha == pytest.approx(10)
    assert y[2001].emissions_avoided_mgco2e == pytest.approx(-91.75)
    assert y[2001].n_matched_pixels == 1


def test_differences_are_positional(spark):
    m = matches(spark, {1: (True, 1.0, {2000: 50.0, 2001: 50.0, 2004: 40.0})})
    rows = {r.year: r for r in summary.pixel_panel(m, sites(spark)).collect()}
    assert rows[2004].forest_change_ha == pytest.approx(-10)


def test_year_window(spark):
    fc = {y: 50.0 for y in range(2000, 2021)}
    m = matches(spark, {1: (True, 1.0, fc)})
    years = sorted(r.year for r in summary.pixel_panel(m, sites(spark, 2010, 2014)).collect())
    assert years == list(range(2005, 2015))
    changes = summary.pixel_panel(m, sites(spark, 2010, 2014)).filter("forest_change_ha IS NULL")
    assert changes.isEmpty()


def test_scaling_totals_and_area(spark):
    fc = {y: 60.0 - (y - 2000) for y in range(2000, 2009)}
    m = matches(spark, {1: (True, 1.0, fc), 2: (False, 1.0, {y: 60.0 for y in fc})}, fraction=0.5)
    s = sites(spark, 2004)
    yearly = summary.site_year(summary.pixel_panel(m, s), s)
    total = summary.site_total(yearly, s).first()
    # one hectare a year from 2004 to 2008, doubled for the sampled half
    assert total.forest_loss_avoided_ha == pytest.approx(-10)
    assert (total.first_year, total.last_year, total.n_years) == (2004, 2008, 5)
    assert total.n_matched_pixels == 1 and total.area_ha == 500
    assert [r.year for r in yearly.filter("is_pre_intervention").orderBy("year").collect()] == [
        2001, 2002, 2003]
    scaled = summary.site_year(summary.pixel_panel(m, s, scale_by_area=True), s)
    a, b = (d.agg(F.sum("treatment_emissions_mgco2e")).first()[0] for d in (yearly, scaled))
    assert b == pytest.approx(100 * a)


def test_weights(spark):
    rows = [("A", "g", "1", True), ("A", "g", "1", False), ("A", "g", "2", True),
            ("A", "g", "2", False), ("A", "g", "2", False), ("A", "g", "2", False),
            ("A", "h", "1", True), ("A", "h", "1", True), ("A", "h", "1", False),
            ("A", "h", "1", False), ("A", "h", "1", False), ("A", "k", "1", True)]
    df = spark.createDataFrame(rows, "site_id string, group string, match_group string, treatment boolean")
    got = pairing.with_match_weights(df).filter("NOT treatment").groupBy("group", "match_group").agg(
        F.max("match_weight").alias("w"), F.count("*").alias("n")).collect()
    assert {(r.group, r.match_group): (round(r.w, 6), r.n) for r in got} == {
        ("g", "1"): (1.0, 1), ("g", "2"): (0.333333, 3), ("h", "1"): (0.666667, 3)}


def quality_rows(spark):
    rng = np.random.default_rng(2)
    n = 300
    pdf = pd.DataFrame({
        "site_id": np.where(rng.random(n) < 0.9, "A", "B"), "treatment": rng.random(n) < 0.4,
        "match_weight": rng.choice([1.0, 0.5, 1 / 3], n), "x": rng.normal(1000, 3, n),
        "flat": 5.5, "pscore": rng.random(n),
    })
    pdf.loc[::17, "x"] = np.nan
    return pdf, spark.createDataFrame(pdf)


def test_balance_matches_two_pass(spark):
    pdf, df = quality_rows(spark)
    got = {(r.site_id, r.covariate): r for r in quality.balance(df, ("x", "flat")).collect()}
    for scope, part in (("__all__", pdf), ("A", pdf[pdf.site_id == "A"])):
        stats = []
        for arm in (True, False):
            p = part[(part.treatment == arm) & part.x.notna()]
            mean = np.average(p.x, weights=p.match_weight)
            stats.append((mean, np.average((p.x - mean) ** 2, weights=p.match_weight)))
        pooled = np.sqrt((stats[0][1] + stats[1][1]) / 2)
        row = got[scope, "x"]
        assert row.pooled_sd == pytest.approx(pooled, rel=1e-6)
        assert row.smd == pytest.approx((stats[0][0] - stats[1][0]) / pooled, abs=1e-6)
        assert got[scope, "flat"].smd == 0 and got[scope, "flat"].pooled_sd == 0
    tiny = spark.createDataFrame(pdf.head(2))
    assert quality.balance(tiny, ("x",)).filter("smd IS NOT NULL").isEmpty()


def test_histograms_sum_to_100(spark):
    pdf, df = quality_rows(spark)
    for build in (quality.histogram_local, quality.histogram_global):
        h = build(df, ("x", "flat"))
        sums = h.groupBy("site_id", "covariate").agg(
            F.sum("treatment_pct").alias("t"), F.sum("control_pct").alias("c"),
            F.count("*").alias("n")).collect()
        assert {r.covariate for r in sums} == {"x"}
        for r in sums:
            assert r.n == 40 and r.t == pytest.approx(100) and r.c == pytest.approx(100)
    x = pdf[pdf.treatment & pdf.x.notna()].x
    counts, _ = np.histogram(x, bins=np.linspace(pdf.x.min(), pdf.x.max(), 41))
    rows = quality.histogram_global(df, ("x",)).filter("site_id = '__all__'").orderBy("bin").collect()
    assert np.allclose([r.treatment_pct for r in rows], counts / counts.sum() * 100)


def test_quantile_pairs(spark):
    pdf, df = quality_rows(spark)
    rows = quality.qq_pairs(df).filter("site_id = '__all__'").orderBy("index").collect()
    probs = np.linspace(0, 1, 500)
    assert np.allclose([r.treatment_value for r in rows],
                       np.quantile(pdf[pdf.treatment].pscore, probs))
    assert np.allclose([r.control_value for r in rows],
                       np.quantile(pdf[~pdf.treatment].pscore, probs))
    few = quality.qq_pairs(df, adaptive=True).filter("site_id = 'B'").count()
    b = pdf[pdf.site_id == "B"]
    assert few == max(b.treatment.sum(), (~b.treatment).sum())


def test_warnings(spark):
    totals = spark.createDataFrame([("A", "Alpha", 10), ("B", None, 120), ("C", "Gamma", 500)],
                                   "site_id string, site_name string, n_matched_pixels int")
    bal = spark.createDataFrame(
        [("__all__", "elev", 0.3), ("__all__", "slope", -0.4), ("__all__", "temp", 0.0),
         ("B", "elev", -0.26), ("B", "slope", 0.05), ("C", "elev", 0.05), ("C", "temp", None)],
        "site_id string, covariate string, smd double")
    got = quality.quality_warnings(totals, bal)
    levels = sorted((r.level, r.scope, r.rule) for r in got.collect())
    assert levels == [("danger", "A", 0), ("danger", "B", 1), ("danger", "aggregate", 1),
                      ("warning", "B", 0), ("warning", "B", 2), ("warning", "aggregate", 2)]
    digest = {r.scope: (r.level, r.issues.count("; ")) for r in quality.warning_digest(got).collect()}
    assert digest == {"A": ("danger", 0), "B": ("danger", 2)}
    assert quality.caution_only(got).isEmpty()


def test_balance_far_from_zero(spark):
    rng = np.random.default_rng(2)
    x = 1e8 + rng.normal(size=400)
    rows = [("s", bool(i % 2), 1.0, float(v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "site_id string, treatment boolean, match_weight double, x double")
    t, c = x[1::2] - 1e8, x[::2] - 1e8
    want = (t.mean() - c.mean()) / np.sqrt((t.var() + c.var()) / 2)
    for r in quality.balance(df, ("x",)).collect():
        assert abs(r.smd - want) < 1e-5
