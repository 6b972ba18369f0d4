"""Geometry as Column expressions: metres on the task plane, degrees on the sphere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the FAI sphere and of the tolerance rule.
EARTH_RADIUS_M = 6371000.0
RADIUS_TOLERANCE = 0.0
ABSOLUTE_TOLERANCE_M = 5.0
MEASURE_POLICY = "outer"


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on the FAI sphere."""
    half_dlat = (F.radians(lat2) - F.radians(lat1)) / 2
    half_dlon = F.radians(lon2 - lon1) / 2
    h = (F.pow(F.sin(half_dlat), F.lit(2))
         + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_dlon), F.lit(2)))
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(h))


def plane_xy(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """Azimuthal-equidistant coordinates around (lat0, lon0)."""
    phi, phi0 = F.radians(lat), F.radians(lat0)
    dlon = F.radians(lon) - F.radians(lon0)
    cosine = (F.sin(phi0) * F.sin(phi) + F.cos(phi0) * F.cos(phi) * F.cos(dlon))
    arc = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine)))
    scale = EARTH_RADIUS_M * F.when(arc < 1e-12, F.lit(1.0)).otherwise(arc / F.sin(arc))
    return (scale * F.cos(phi) * F.sin(dlon),
            scale * (F.cos(phi0) * F.sin(phi) - F.sin(phi0) * F.cos(phi) * F.cos(dlon)))


def plane_latlon(x: Column, y: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """Inverse of :func:`plane_xy`."""
    rho = F.sqrt(x * x + y * y)
    arc = rho / EARTH_RADIUS_M
    phi0 = F.radians(lat0)
    lat = F.degrees(F.asin(F.cos(arc) * F.sin(phi0) + y * F.sin(arc) * F.cos(phi0) / rho))
    lon = lon0 + F.degrees(F.atan2(
        x * F.sin(arc), rho * F.cos(phi0) * F.cos(arc) - y * F.sin(phi0) * F.sin(arc)))
    at_centre = arc < 1e-12
    return F.when(at_centre, lat0).otherwise(lat), F.when(at_centre, lon0).otherwise(lon)


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def inner_radius(r: Column, rt: Column | None = None, at: Column | None = None) -> Column:
    rt = F.lit(RADIUS_TOLERANCE) if rt is None else rt
    at = F.lit(ABSOLUTE_TOLERANCE_M) if at is None else at
    return F.least(r * (1 - rt), r - at)


def outer_radius(r: Column, rt: Column | None = None, at: Column | None = None) -> Column:
    rt = F.lit(RADIUS_TOLERANCE) if rt is None else rt
    at = F.lit(ABSOLUTE_TOLERANCE_M) if at is None else at
    return F.greatest(r * (1 + rt), r + at)


def measure_radius(r: Column, policy: Column, rt: Column | None = None,
                   at: Column | None = None) -> Column:
    """The radius distances are measured to; an unknown policy is an error."""
    return (F.when(policy == "outer", outer_radius(r, rt, at))
            .when(policy == "inner", inner_radius(r, rt, at))
            .when(policy == "nominal", r)
            .otherwise(F.raise_error(F.concat(F.lit("unknown measurement radius: "), policy))
                       .cast("double")))


def boundary_transition(d0: Column, d1: Column, inner: Column, outer: Column) -> Column:
    """A segment changed side of the inner or of the outer tolerance boundary."""
    return ((d0 < inner) != (d1 < inner)) | ((d0 <= outer) != (d1 <= outer))


def chord_hits(ax: Column, ay: Column, bx: Column, by: Column,
               cx: Column, cy: Column, radius: Column) -> Column:
    """The inside of segment AB comes within ``radius`` of the centre."""
    dx, dy = bx - ax, by - ay
    length2 = dx * dx + dy * dy
    dot = (cx - ax) * dx + (cy - ay) * dy
    cross = (cx - ax) * dy - (cy - ay) * dx
    return ((length2 > 1e-18) & (dot > 0) & (dot < length2)
            & (cross * cross <= radius * radius * length2))


def zone_contact(d0: Column, d1: Column, ax: Column, ay: Column, bx: Column, by: Column,
                 cx: Column, cy: Column, outer: Column) -> Column:
    """A segment validates a zone: an end inside the outer boundary, or a chord through it."""
    return (d1 <= outer) | (d0 <= outer) | chord_hits(ax, ay, bx, by, cx, cy, outer)


def in_zone(x: Column, y: Column, cx: Column, cy: Column, outer: Column) -> Column:
    return (x - cx) * (x - cx) + (y - cy) * (y - cy) <= outer * outer


def first_contact_fraction(ax: Column, ay: Column, bx: Column, by: Column,
                           cx: Column, cy: Column, radius: Column) -> Column:
    """Fraction along AB of the first point inside the disc, or null (analysis only)."""
    dx, dy, ex, ey = bx - ax, by - ay, ax - cx, ay - cy
    a = dx * dx + dy * dy
    half_b = ex * dx + ey * dy
    c = ex * ex + ey * ey - radius * radius
    disc = half_b * half_b - a * c
    root = F.when((a > 1e-18) & (disc >= 0), (-half_b - F.sqrt(disc)) / a)
    return F.when(c <= 0, F.lit(0.0)).when((root >= 0) & (root <= 1), root)


def edge_distance(x: Column, y: Column, cx: Column, cy: Column, radius: Column) -> Column:
    """Distance from a point to the rim of a disc, zero inside."""
    return F.greatest(F.lit(0.0), distance(x, y, cx, cy) - radius)
