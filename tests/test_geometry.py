"""Grid arithmetic and polygons against brute force."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from arborlift.functions import grid
from arborlift.operators import extract, polygons, raster
from arborlift.schema import GEOMETRY


def shape(*rings):
    return [[[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings]]


def frame(spark, shapes):
    return spark.createDataFrame(
        [(i + 1, s) for i, s in enumerate(shapes)], f"id_numeric int, geometry {GEOMETRY}"
    )


def cells_of(df, key=None):
    return {(r["row"], r["col"]) for r in df.collect() if key is None or r.id_numeric == key}


def even_odd(rings, x, y):
    inside = False
    for ring in rings:
        for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
            if min(y0, y1) <= y < max(y0, y1) and x0 + (y - y0) / (y1 - y0) * (x1 - x0) <= x:
                inside = not inside
    return inside


def test_random_polygons_equal_even_odd(spark):
    random.seed(4)
    shapes = []
    for _ in range(6):
        cx, cy = random.uniform(-3, 3), random.uniform(-3, 3)
        ring = [(cx + random.uniform(0.02, 0.09) * math.cos(a), cy + random.uniform(0.02, 0.09) * math.sin(a))
                for a in sorted(random.uniform(0, 6.28) for _ in range(9))]
        shapes.append([ring])
    got = polygons.centre_cells(frame(spark, [shape(*s) for s in shapes]), "id_numeric").collect()
    for i, rings in enumerate(shapes):
        want = set()
        xs, ys = [p[0] for p in rings[0]], [p[1] for p in rings[0]]
        for r in range(int((90 - max(ys)) * 120) - 1, int((90 - min(ys)) * 120) + 2):
            for c in range(int((min(xs) + 180) * 120) - 1, int((max(xs) + 180) * 120) + 2):
                if even_odd(rings, (c + 0.5) / 120 - 180, 90 - (r + 0.5) / 120):
                    want.add((r, c))
        assert {(g["row"], g["col"]) for g in got if g.id_numeric == i + 1} == want


def square(x0, y0, n):
    """Square covering n x n whole cells from the north-west corner."""
    e, s = x0 + n / 120, y0 - n / 120
    return [(x0, y0), (e, y0), (e, s), (x0, s)]


def test_squares_holes_and_overlaps(spark):
    a = shape(square(10, 10, 6), square(10 + 2 / 120, 10 - 2 / 120, 2))
    b = shape(square(10 + 3 / 120, 10, 6))
    df = frame(spark, [a, b])
    cells = polygons.centre_cells(df, "id_numeric")
    assert len(cells_of(cells, 1)) == 32 and len(cells_of(cells, 2)) == 36
    owners = polygons.site_cells(df).groupBy("id_numeric").count().collect()
    # the later site takes the shared cells
    assert {r.id_numeric: r["count"] for r in owners} == {1: 32 - 16, 2: 36}


def test_touched_cells_cover_more_than_centres(spark):
    thin = shape([(5.0001, 5.0001), (5.05, 5.0002), (5.05, 5.0004), (5.0001, 5.0003)])
    df = frame(spark, [thin])
    assert not cells_of(polygons.centre_cells(df, "id_numeric"))
    touched = cells_of(polygons.touched_cells(df, "id_numeric"))
    assert touched == {(10199, c) for c in range(22200, 22207)}


def test_overlapping_extents_do_not_cancel(spark):
    df = frame(spark, [shape(square(1, 1, 4)), shape(square(1, 1, 4))])
    assert extract.extent_cells(df, "id_numeric").count() >= 16


def test_pixel_areas_sum_to_the_ellipsoid(spark):
    lat = spark.range(grid.GRID_ROWS).select(grid.centre_lat(F.col("id")).alias("lat"))
    total = lat.agg(F.sum(grid.pixel_area_ha(F.col("lat"), 1 / 120, 1 / 120))).first()[0]
    a, b = 6378137.0, 6356752.3142
    e = math.sqrt(1 - (b / a) ** 2)
    whole = 2 * math.pi * a * a * (1 + (1 - e * e) / e * math.atanh(e))
    assert total * grid.GRID_COLUMNS * 1e4 == pytest.approx(whole, rel=1e-9)


def test_equal_area_agrees_with_pixels(spark):
    df = frame(spark, [shape(square(20, 40, 12), square(20 + 3 / 120, 40 - 3 / 120, 3))])
    area = polygons.equal_area_ha(df, "id_numeric").first().area_ha
    cells = polygons.centre_cells(df, "id_numeric")
    pixels = cells.agg(F.sum(grid.pixel_area_ha(grid.centre_lat(F.col("row")), 1 / 120, 1 / 120))).first()[0]
    assert area == pytest.approx(pixels, rel=1e-6)


def test_burn_first_and_last(spark):
    df = frame(spark, [shape(square(0, 0, 2)), shape(square(0, 0, 2))]).withColumn(
        "code", F.col("id_numeric") * 10)
    cells = polygons.centre_cells(df, "id_numeric").select(
        grid.cell_at(F.col("row"), F.col("col")).alias("cell")).distinct()
    pixels = cells.union(spark.range(1).select(F.col("id").alias("cell")))
    for last, want in ((True, 20), (False, 10)):
        out = polygons.burned_attribute(pixels, df, "code", "id_numeric", last)
        assert {r.cell == 0: r.code for r in out.collect()} == {True: 0, False: want}


def test_cells_round_trip(spark):
    pts = spark.createDataFrame([(-180.0, 90.0), (0.0, 0.0), (12.34, -56.78)], "x double, y double")
    for r in pts.select("*", grid.cell_of(F.col("x"), F.col("y")).alias("c")).select(
        "*", grid.centre_lon(grid.col_in(F.col("c"))).alias("lon"),
        grid.centre_lat(grid.row_in(F.col("c"))).alias("lat")).collect():
        assert abs(r.lon - r.x) <= 0.5 / 120 + 1e-9 and abs(r.lat - r.y) <= 0.5 / 120 + 1e-9


def test_slope_and_aspect_of_a_plane(spark):
    plane = spark.range(25).select(
        F.floor(F.col("id") / 5).alias("row"), (F.col("id") % 5).alias("col"),
        ((F.col("id") % 5) * 30.0).alias("elevation"))
    s = raster.slope(plane, F.lit(30.0)).filter("slope IS NOT NULL").collect()
    assert len(s) == 9 and all(r.slope == pytest.approx(45) for r in s)
    a = raster.aspect(plane, F.lit(30.0)).filter("aspect IS NOT NULL").collect()
    # rising to the east, so it faces west
    assert all(r.aspect == pytest.approx(270) for r in a)
    flat = plane.withColumn("elevation", F.lit(7.0))
    assert {r.aspect for r in raster.aspect(flat, F.lit(30.0)).filter("aspect IS NOT NULL").collect()} == {0.0}


def test_gradient_over_block_edges_and_gaps(spark):
    rng = random.Random(4)
    z = {(r, c): rng.random() for r in range(-3, 4) for c in range(60, 132) if rng.random() > 0.1}
    z |= {(r, c): rng.random() for r in range(62, 67) for c in range(-2, 3)}
    rows = [(r, c, v) for (r, c), v in z.items()] + [(0, 63, -1.0), (None, 3, 1.0), (900, 3, None)]
    z.setdefault((0, 63), -1.0)
    cells = spark.createDataFrame(rows, "row int, col int, elevation double")
    got = {(r.row, r.col): (r.dx, r.dy) for r in raster.gradient(cells, F.lit(2.0), F.col("row") + 100.0).collect()}
    assert set(got) == set(z)

    def side(r, c, places):
        parts = [z.get((r + dr, c + dc)) for dr, dc in places]
        return None if None in parts else parts[0] + 2 * parts[1] + parts[2]

    for (r, c), (dx, dy) in got.items():
        e, w = side(r, c, [(-1, 1), (0, 1), (1, 1)]), side(r, c, [(-1, -1), (0, -1), (1, -1)])
        n, s = side(r, c, [(-1, -1), (-1, 0), (-1, 1)]), side(r, c, [(1, -1), (1, 0), (1, 1)])
        assert dx == (None if None in (e, w) else pytest.approx((e - w) / 16))
        assert dy == (None if None in (n, s) else pytest.approx((n - s) / 8 / (r + 100.0)))
    assert raster.gradient(cells.limit(0), F.lit(1.0)).isEmpty()


def test_mode_ties_and_catalog(spark):
    fine = spark.createDataFrame([(0, 0, 3.0), (0, 1, 1.0), (1, 0, 3.0), (1, 1, 1.0)],
                                 "row bigint, col bigint, value double")
    assert raster.resample(fine, 2, "mode").first().value == 1.0
    layers = raster.catalog(spark)
    assert layers.count() == 52
    with pytest.raises(ValueError):
        raster.select_catalog(layers, names=["precip", "nothing"])
    assert raster.select_catalog(layers, category="climate").count() == 2
