"""Arithmetic of the shared 1/120 degree grid, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Grid geometry and the WGS-84 ellipsoid.
CELLS_PER_DEGREE = 120
GRID_COLUMNS = 43_200
GRID_ROWS = 21_600
SEMI_MAJOR_M = 6_378_137.0
SEMI_MINOR_M = 6_356_752.3142
SNAP_TOLERANCE_DEG = 0.01
RESOLUTION_TOLERANCE = 1e-6

ECCENTRICITY = math.sqrt(1 - (SEMI_MINOR_M / SEMI_MAJOR_M) ** 2)


def row_of(lat: Column) -> Column:
    return F.floor((F.lit(90.0) - lat) * CELLS_PER_DEGREE)


def col_of(lon: Column) -> Column:
    return F.floor((lon + 180.0) * CELLS_PER_DEGREE)


def cell_at(row: Column, col: Column) -> Column:
    return row.cast("bigint") * GRID_COLUMNS + col.cast("bigint")


def cell_of(lon: Column, lat: Column) -> Column:
    return cell_at(row_of(lat), col_of(lon))


def row_in(cell: Column) -> Column:
    return F.floor(cell / GRID_COLUMNS)


def col_in(cell: Column) -> Column:
    return cell % GRID_COLUMNS


def centre_lat(row: Column) -> Column:
    return F.lit(90.0) - (row + 0.5) / CELLS_PER_DEGREE


def centre_lon(col: Column) -> Column:
    return (col + 0.5) / CELLS_PER_DEGREE - 180.0


def _sphere_slice(lat: Column) -> Column:
    """Area in square metres between the equator and ``lat``, all round."""
    s = F.sin(F.radians(lat))
    e = F.lit(ECCENTRICITY)
    inner = F.atanh(e * s) / e + s / ((1 + e * s) * (1 - e * s))
    return F.lit(math.pi * SEMI_MINOR_M**2) * inner


def pixel_area_ha(lat: Column, height: float, width: float) -> Column:
    """Hectares of a ``height`` x ``width`` degree cell centred on ``lat``."""
    top, bottom = _sphere_slice(lat + height / 2), _sphere_slice(lat - height / 2)
    return (top - bottom) * (width / 360) / 10_000


def equal_area_y(lat: Column) -> Column:
    """Northing in metres of the cylindrical equal-area projection."""
    s = F.sin(F.radians(lat))
    e = ECCENTRICITY
    q = (1 - e * e) * (s / (1 - e * e * s * s) + F.atanh(F.lit(e) * s) / e)
    return q * (SEMI_MAJOR_M / 2)


def equal_area_x(lon: Column) -> Column:
    return F.radians(lon) * SEMI_MAJOR_M


def snapped(degrees: Column) -> Column:
    """Nearest grid line, or NULL when none lies within the tolerance."""
    line = F.round(degrees * CELLS_PER_DEGREE) / CELLS_PER_DEGREE
    return F.when(F.abs(line - degrees) < SNAP_TOLERANCE_DEG, line)


def same_resolution(a: Column, b: Column) -> Column:
    return F.abs(a - b) < RESOLUTION_TOLERANCE
