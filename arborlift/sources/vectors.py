"""Polygon sources: GeoJSON sites and reference layers as typed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from arborlift.config import REQUIRED_SITE_COLUMNS, require_columns
from arborlift.operators import extract, polygons
from arborlift.schema import GEOMETRY

POLYGON_TYPES = ("Polygon", "MultiPolygon")
BAD_LIMIT = 10


def select_renamed(df: DataFrame, names: dict[str, str]) -> tuple[DataFrame, list[str]]:
    """Select and rename columns whatever their case; also what was missing."""
    actual = {c.lower(): c for c in df.columns}
    found = {k: v for k, v in names.items() if k.lower() in actual}
    missing = [k for k in names if k.lower() not in actual]
    return df.select(*[F.col(actual[k.lower()]).alias(v) for k, v in found.items()]), missing


def bad_geometry_types(features: DataFrame) -> DataFrame:
    """First offenders whose geometry is not a polygon, for the error report."""
    wrong = features.filter(~F.coalesce(F.col("geometry_type"), F.lit("")).isin(*POLYGON_TYPES))
    return wrong.orderBy("position").limit(BAD_LIMIT)


def as_polygons(kind, coordinates, parts):
    """One multi-polygon array from a GeoJSON geometry's type and JSON text.

    Collections keep their polygonal members, other kinds give NULL.
    """
    point = "array<double>"
    one = F.array(F.from_json(coordinates, f"array<array<{point}>>"))
    many = F.from_json(coordinates, f"array<array<array<{point}>>>")
    members = F.flatten(F.transform(
        parts,
        lambda m: F.when(m["type"] == "Polygon", F.array(
            F.from_json(m["coordinates"], f"array<array<{point}>>")
        )).when(m["type"] == "MultiPolygon", F.from_json(
            m["coordinates"], f"array<array<array<{point}>>>"
        )).otherwise(F.from_json(F.lit("[]"), f"array<array<array<{point}>>>")),
    ))
    nested = F.when(kind == "Polygon", one).when(kind == "MultiPolygon", many).when(
        kind == "GeometryCollection", members
    )
    return F.transform(nested, lambda poly: F.transform(poly, lambda ring: F.transform(
        ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    ))).cast(GEOMETRY)


def _feature_schema(properties: dict[str, str]) -> str:
    fields = ",".join(f"{n}:{t}" for n, t in properties.items())
    geometry = (
        "struct<type:string,coordinates:string,"
        "geometries:array<struct<type:string,coordinates:string>>>"
    )
    return f"struct<type:string,id:bigint,properties:struct<{fields}>,geometry:{geometry}>"


def read_features(spark: SparkSession, path: str, properties: dict[str, str],
                  lines: bool = False) -> DataFrame:
    """Features of GeoJSON files: position, properties, geometry.

    ``properties`` maps names to types; absent ones read as NULL. A feature
    collection is one JSON document, so its file is read by one task; with
    ``lines`` every line is a feature (with its position as ``id``) and files
    are split freely.
    """
    feature = _feature_schema(properties)
    if lines:
        text = spark.read.text(path)
        rows = text.select(F.from_json("value", feature).alias("f"))
        rows = rows.select(F.col("f.id").alias("position"), "f")
    else:
        schema = f"type string, features array<{feature}>"
        doc = spark.read.schema(schema).json(path, multiLine=True)
        rows = doc.select(F.posexplode("features").alias("position", "f"))
    g = F.col("f.geometry")
    return rows.select(
        "position", *[F.col(f"f.properties.{n}").alias(n) for n in properties],
        g["type"].alias("geometry_type"),
        as_polygons(g["type"], g["coordinates"], g["geometries"]).alias("geometry"),
    )


SITE_PROPERTIES = {
    "site_id": "string", "site_name": "string", "start_date": "date", "end_date": "date",
}


def read_sites(spark: SparkSession, path: str, min_area_ha: float,
               lines: bool = False) -> DataFrame:
    """Sites from GeoJSON, validated, with ids, years and areas."""
    raw = read_features(spark, path, SITE_PROPERTIES, lines)
    wrong = bad_geometry_types(raw).select("position", "geometry_type").collect()
    if wrong:
        listed = ", ".join(f"{r.position}: {r.geometry_type}" for r in wrong)
        raise ValueError(f"geometries must be Polygon or MultiPolygon ({listed})")
    absent = raw.agg(*[F.count(c).alias(c) for c in REQUIRED_SITE_COLUMNS]).first()
    require_columns([c for c in REQUIRED_SITE_COLUMNS if absent[c]], REQUIRED_SITE_COLUMNS,
                    "site file")
    return extract.prepare_sites(raw.drop("geometry_type"), min_area_ha)


def import_reference(features: DataFrame, names: dict[str, str]) -> DataFrame:
    """Reference polygons with renamed attributes and a bounding box each."""
    kept = polygons.nonempty(features)
    picked, _ = select_renamed(kept, {**names, "position": "position", "geometry": "geometry"})
    return picked.join(polygons.bounds(picked, "position"), "position")
