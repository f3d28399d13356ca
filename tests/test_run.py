"""A small landscape through all steps."""

from __future__ import annotations

import json
import glob

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from arborlift.config import MatchConfig
from arborlift.functions import grid
from arborlift.plans.run import run_analysis
from arborlift.schema import GEOMETRY


def landscape(spark):
    """40 x 40 cells; two sites lose less cover than what surrounds them."""
    n, row0, col0 = 40, 10000, 20000
    rng = np.random.default_rng(8)
    base = [(row0 + r) * grid.GRID_COLUMNS + col0 + c for r in range(n) for c in range(n)]
    inside = {i for i, _ in enumerate(base) if 5 <= i // n < 12 and (4 <= i % n < 11 or 24 <= i % n < 31)}
    rows = []
    for i, cell in enumerate(base):
        layers = {"elev": rng.normal(500, 100), "slope": rng.random() * 10, "total_biomass": 150.0,
                  "admin1": 1.0, "pa": float(i % n >= 20)}
        for y in range(2000, 2011):
            layers[f"fc_{y}"] = 80 - (0.5 if i in inside else 1.5) * (y - 2000)
        rows += [(k, cell, float(v)) for k, v in layers.items()]
    def square(c):
        x0, y0, s = (col0 + c) / 120 - 180, 90 - (row0 + 5) / 120, 7 / 120
        ring = [(x0, y0), (x0 + s, y0), (x0 + s, y0 - s), (x0, y0 - s)]
        return [[[{"x": x, "y": y} for x, y in ring]]]
    sites = spark.createDataFrame(
        [(1, "W", "West", 2004, 2099, 3000.0, square(4)), (2, "E", "East", 2004, 2007, 3000.0, square(24)),
         (3, "T", "Tiny", 2006, 2099, 3.0, square(35))],
        f"id_numeric int, site_id string, site_name string, start_year int, end_year int, area_ha double, geometry {GEOMETRY}")
    return sites, spark.createDataFrame(pd.DataFrame(rows, columns=["layer", "cell", "value"]))


def test_run_end_to_end(spark, tmp_path):
    sites, layers = landscape(spark)
    cfg = MatchConfig(covariates=("elev", "slope"), exact_match_vars=("admin1", "pa"),
                      fc_years=tuple(range(2000, 2011)), random_seed=5, caliper_width=0.5)
    out = str(tmp_path / "out")
    results = run_analysis(sites, layers, cfg, out)
    totals = {r.site_id: r for r in results["results_by_site_total"].collect()}
    assert set(totals) == {"W", "E"}
    area = spark.read.parquet(f"{out}/treatment_key").agg(F.avg("area_ha")).first()[0]
    for sid, years in (("W", 7), ("E", 4)):
        t = totals[sid]
        assert t.n_years == years
        # one percent of cover saved per treated pixel and year, scaled to all 49 treated pixels
        kept = t.n_matched_pixels
        assert t.forest_loss_avoided_ha > 0
        assert abs(t.forest_loss_avoided_ha - years * kept * area / 100 / t.sampled_fraction) < 1.5
    assert results["results_failed_sites"].isEmpty()
    doc = json.loads("".join(open(p).read().replace("\n", "") for p in sorted(glob.glob(f"{out}/results_summary/part-*"))))
    assert doc["n_sites"] == 2 and doc["year_range"] == {"min": 2001, "max": 2010}
    # a rerun leaves the finished sites as they are
    before = sorted(glob.glob(f"{out}/matches/id_numeric=*/*.parquet"))
    run_analysis(sites, layers, cfg, out)
    assert sorted(glob.glob(f"{out}/matches/id_numeric=*/*.parquet")) == before
