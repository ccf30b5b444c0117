"""Distances, bearings, projections and boxes as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sphere radius, and metres per degree of latitude.
EARTH_RADIUS_M = 6_371_000.0
METRES_PER_DEGREE = EARTH_RADIUS_M * math.pi / 180


def _c(value) -> Column:
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(float(value))


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in metres."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    half_dlat = (F.radians(lat2) - F.radians(lat1)) / 2
    half_dlon = (F.radians(lon2) - F.radians(lon1)) / 2
    a = F.sin(half_dlat) * F.sin(half_dlat) + F.cos(F.radians(lat1)) * F.cos(
        F.radians(lat2)
    ) * F.sin(half_dlon) * F.sin(half_dlon)
    # least() skips NULL, so an unknown point must be kept apart
    return F.when(a.isNotNull(), 2 * F.asin(F.least(F.lit(1.0), F.sqrt(a))) * EARTH_RADIUS_M)


def wrap(value: Column, period: float) -> Column:
    """Floor modulo: result has the sign of ``period``."""
    return F.pmod(value, F.lit(float(period)))


def bearing_deg(lat1, lon1, lat2, lon2) -> Column:
    """Initial compass bearing from the first point to the second."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    p1, p2, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    x = F.sin(dl) * F.cos(p2)
    y = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    return wrap(F.degrees(F.atan2(x, y)) + 360, 360)


def relative_bearing_deg(heading, target) -> Column:
    """Signed angle of a target seen from a heading; right is positive."""
    return wrap(_c(target) - _c(heading) + 180, 360) - 180


def segment_distance_m(lat, lon, a_lat, a_lon, b_lat, b_lon) -> Column:
    """Distance to a segment, in a flat projection around the query point."""
    lat, lon, a_lat, a_lon, b_lat, b_lon = map(_c, (lat, lon, a_lat, a_lon, b_lat, b_lon))
    k = F.cos(F.radians(lat)) * EARTH_RADIUS_M
    px, py = F.radians(lon) * k, F.radians(lat) * EARTH_RADIUS_M
    ax, ay = F.radians(a_lon) * k, F.radians(a_lat) * EARTH_RADIUS_M
    bx, by = F.radians(b_lon) * k, F.radians(b_lat) * EARTH_RADIUS_M
    dx, dy = bx - ax, by - ay
    length2 = dx * dx + dy * dy
    t = F.when(length2 == 0, F.lit(0.0)).otherwise(
        F.greatest(
            F.lit(0.0),
            F.least(F.lit(1.0), F.try_divide((px - ax) * dx + (py - ay) * dy, length2)),
        )
    )
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


def course_between(a, b, t) -> Column:
    """Circular interpolation of two courses; one missing gives the other."""
    a, b, t = _c(a), _c(b), _c(t)
    x = (1 - t) * F.cos(F.radians(a)) + t * F.cos(F.radians(b))
    y = (1 - t) * F.sin(F.radians(a)) + t * F.sin(F.radians(b))
    turned = wrap(F.degrees(F.atan2(y, x)), 360)
    return (
        F.when(a.isNull(), b)
        .when(b.isNull(), a)
        .when((x == 0) & (y == 0), a)
        .when(turned == 360, F.lit(0.0))
        .otherwise(turned)
    )


# Fixed values of the crop heuristic: field of view, slowest speed with a usable
# heading, reference distance and fraction, smallest and largest crop.
FIELD_OF_VIEW_DEG = 136.0
MIN_HEADING_SPEED_KMH = 5.0
CROP_REFERENCE_M = 15.0
CROP_REFERENCE_FRACTION = 0.5
CROP_MIN, CROP_MAX = 0.12, 0.9


def crop_box(
    lat, lon, heading, speed_kmh, target_lat, target_lon, distance_m, fov=FIELD_OF_VIEW_DEG
) -> Column:
    """STRUCT<x, y, width, height> as frame fractions, or NULL when out of sight."""
    heading, speed, dist = _c(heading), _c(speed_kmh), _c(distance_m)
    rel = relative_bearing_deg(heading, bearing_deg(lat, lon, target_lat, target_lon))
    raw = F.when(dist <= 0, F.lit(CROP_MAX)).otherwise(
        F.try_divide(F.lit(CROP_REFERENCE_FRACTION * CROP_REFERENCE_M), dist)
    )
    width = F.greatest(F.lit(CROP_MIN), F.least(F.lit(CROP_MAX), raw))
    x = F.greatest(width / 2, F.least(1 - width / 2, 0.5 + rel / fov))
    seen = heading.isNotNull() & (speed >= MIN_HEADING_SPEED_KMH) & (F.abs(rel) <= fov / 2)
    return F.when(
        seen,
        F.struct(
            x.alias("x"), F.lit(0.5).alias("y"), width.alias("width"), width.alias("height")
        ),
    )


def _lon_scale(lat: Column) -> Column:
    scale = F.cos(F.radians(lat))
    return F.when(scale == 0, F.lit(1e-9)).otherwise(scale)


MIN_BOX_RADIUS_M = 5.0


def box_around(lat, lon, radius_m, aspect: float | None = None) -> Column:
    """STRUCT<min_lat, min_lon, max_lat, max_lon> around a point."""
    lat, lon = _c(lat), _c(lon)
    r = F.greatest(_c(radius_m), F.lit(MIN_BOX_RADIUS_M))
    d_lat = r / METRES_PER_DEGREE
    d_lon = (r * (1.0 if aspect is None else aspect)) / (_lon_scale(lat) * METRES_PER_DEGREE)
    return box(lat - d_lat, lon - d_lon, lat + d_lat, lon + d_lon)


def box(min_lat: Column, min_lon: Column, max_lat: Column, max_lon: Column) -> Column:
    return F.struct(
        min_lat.alias("min_lat"),
        min_lon.alias("min_lon"),
        max_lat.alias("max_lat"),
        max_lon.alias("max_lon"),
    )


def box_union(a: Column, b: Column) -> Column:
    return box(
        F.least(a["min_lat"], b["min_lat"]),
        F.least(a["min_lon"], b["min_lon"]),
        F.greatest(a["max_lat"], b["max_lat"]),
        F.greatest(a["max_lon"], b["max_lon"]),
    )


def box_contains(outer: Column, inner: Column) -> Column:
    return (
        (outer["min_lat"] <= inner["min_lat"])
        & (outer["max_lat"] >= inner["max_lat"])
        & (outer["min_lon"] <= inner["min_lon"])
        & (outer["max_lon"] >= inner["max_lon"])
    )


def box_overlaps(a: Column, b: Column) -> Column:
    return (
        (a["min_lat"] <= b["max_lat"])
        & (a["max_lat"] >= b["min_lat"])
        & (a["min_lon"] <= b["max_lon"])
        & (a["max_lon"] >= b["min_lon"])
    )


def _box_size(b: Column) -> tuple[Column, Column, Column]:
    scale = _lon_scale((b["min_lat"] + b["max_lat"]) / 2)
    flat = b["max_lat"] - b["min_lat"]
    height = F.when(flat == 0, F.lit(1e-9)).otherwise(flat)
    return (b["max_lon"] - b["min_lon"]) * scale, height, scale


def aspect_ratio(b: Column) -> Column:
    """Real-world width divided by height."""
    width, height, _ = _box_size(b)
    return width / height


def grow_to_aspect(b: Column, aspect: float) -> Column:
    """Widen the shorter side around the centre until the ratio is met."""
    width, height, scale = _box_size(b)
    pad_lon = F.greatest((height * aspect - width) / scale / 2, F.lit(0.0))
    pad_lat = F.when(width < height * aspect, F.lit(0.0)).otherwise((width / aspect - height) / 2)
    return box(
        b["min_lat"] - pad_lat, b["min_lon"] - pad_lon, b["max_lat"] + pad_lat, b["max_lon"] + pad_lon
    )


def degrees_for(radius_m: float) -> float:
    """Latitude span of a radius, rounded up a little so that it never under-covers."""
    return math.degrees(radius_m / EARTH_RADIUS_M) * (1 + 1e-9) + 1e-12
