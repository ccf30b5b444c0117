"""Readers for cached road / area payloads and GeoJSON geometries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import box
from ..schemas import OVERPASS

# Tags that make an area water or green; the first match counts.
WATER_TAGS = (("natural", "water"), ("waterway", "riverbank"))
GREEN_TAGS = (
    ("leisure", "park"), ("landuse", "forest"), ("landuse", "grass"), ("landuse", "meadow"),
    ("natural", "wood"),
)


def _ways(files: DataFrame, text: str) -> DataFrame:
    kept = [c for c in files.columns if c != text]
    ways = F.filter(F.from_json(text, OVERPASS)["elements"], lambda e: e["type"] == "way")
    points = F.filter(
        F.col("_e.geometry"), lambda p: p["lat"].isNotNull() & p["lon"].isNotNull()
    )
    return files.select(*kept, F.posexplode(ways).alias("pos", "_e")).select(
        *kept, F.col("pos").cast("bigint").alias("pos"), points.alias("points"), F.col("_e.tags").alias("_tags")
    )


def _tag(name: str) -> Column:
    return F.try_element_at(F.col("_tags"), F.lit(name))


def _with_box(df: DataFrame) -> DataFrame:
    lats = F.transform("points", lambda p: p["lat"])
    lons = F.transform("points", lambda p: p["lon"])
    return df.withColumn(
        "fbox", box(F.array_min(lats), F.array_min(lons), F.array_max(lats), F.array_max(lons))
    )


def read_roads(files: DataFrame, text: str = "text") -> DataFrame:
    """Roads with points, class, name and bounding box."""
    roads = _ways(files, text).filter(F.size("points") > 0)
    named = roads.withColumn("highway", F.coalesce(_tag("highway"), F.lit(""))).withColumn("name", _tag("name"))
    return _with_box(named).drop("_tags")


def area_kind() -> Column:
    def any_of(tags) -> Column:
        test = F.lit(False)
        for name, value in tags:
            test = test | F.coalesce(_tag(name) == value, F.lit(False))
        return test

    return F.when(any_of(WATER_TAGS), "water").when(any_of(GREEN_TAGS), "green")


def read_areas(files: DataFrame, text: str = "text") -> DataFrame:
    """Water and green polygons with at least three points."""
    areas = _ways(files, text).withColumn("kind", area_kind())
    return _with_box(areas.filter((F.size("points") >= 3) & F.col("kind").isNotNull())).drop("_tags")


def geojson_lines(files: DataFrame, geojson: str = "geojson") -> DataFrame:
    """Polylines ``line_no`` / ``points`` of lines and outer rings, turned to (lat, lon)."""
    kept = [c for c in files.columns if c != geojson]
    shape = F.from_json(geojson, "type STRING, coordinates STRING")

    def parsed(depth: int) -> Column:
        return F.from_json(shape["coordinates"], "ARRAY<" * depth + "DOUBLE" + ">" * depth)

    kind = shape["type"]
    rings = (
        F.when(kind == "LineString", F.array(parsed(2)))
        .when(kind == "MultiLineString", parsed(3))
        .when(kind == "Polygon", F.slice(parsed(3), 1, 1))
        .when(
            kind == "MultiPolygon",
            F.transform(F.filter(parsed(4), lambda p: F.size(p) > 0), lambda p: p[0]),
        )
    )
    lines = F.transform(
        F.filter(rings, lambda r: F.size(r) > 0),
        lambda r: F.transform(r, lambda p: F.struct(p[1].alias("lat"), p[0].alias("lon"))),
    )
    return files.select(*kept, F.posexplode(lines).alias("line_no", "points")).withColumn(
        "line_no", F.col("line_no").cast("bigint")
    )
