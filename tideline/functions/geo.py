"""Geometry on a sphere of 6371 km and on polygons, as column expressions and array helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

R = 6371.0


def km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    h = a[0] * a[0] + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * a[1] * a[1]
    return 2 * R * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p, q, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    y, x = F.sin(d) * F.cos(q), F.cos(p) * F.sin(q) - F.sin(p) * F.cos(q) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def angle_between(a: Column, b: Column) -> Column:
    return F.abs(F.pmod(a - b + 540, F.lit(360.0)) - 180)


def cross_track(olat: Column, olon: Column, dlat: Column, dlon: Column, lat: Column, lon: Column) -> Column:
    d = km(olat, olon, lat, lon) / R
    off = F.radians(bearing(olat, olon, lat, lon) - bearing(olat, olon, dlat, dlon))
    return F.abs(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sin(d) * F.sin(off)))) * R)


def moved(lat: Column, lon: Column, course: Column, distance: Column) -> tuple[Column, Column]:
    """The point a distance (km) away on a course."""
    p, d, b = F.radians(lat), distance / R, F.radians(course)
    q = F.asin(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(b))
    step = F.atan2(F.sin(b) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(q))
    return F.degrees(q), F.pmod(lon + F.degrees(step) + 540, F.lit(360.0)) - 180


def within_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd test of a point against a ring of structs (x, y); a constant number of rows, any number of corners."""
    def crosses(p: Column, i: Column) -> Column:
        q = F.get(ring, (i + F.size(ring) - 1) % F.size(ring))
        at = (q["x"] - p["x"]) * (y - p["y"]) / F.when(q["y"] != p["y"], q["y"] - p["y"]) + p["x"]
        return F.when(((p["y"] > y) != (q["y"] > y)) & (x < at), 1).otherwise(0)

    return F.aggregate(F.transform(ring, crosses), F.lit(0), lambda s, c: s + c) % 2 == 1


def ring_area(ring: Column) -> Column:
    """Shoelace area in the ring's units."""
    twice = F.transform(ring, lambda p, i: F.get(ring, (i + 1) % F.size(ring))["x"] * -p["y"] + p["x"] * F.get(ring, (i + 1) % F.size(ring))["y"])
    return F.abs(F.aggregate(twice, F.lit(0.0), lambda s, v: s + v)) / 2


def to_line_km(lat: Column, lon: Column, line: Column) -> Column:
    """Least distance of a point to the corners and segments of a line of structs (x, y), on a local plane."""
    kx, ky = F.cos(F.radians(lat)) * 111.32, F.lit(110.57)

    def apart(p: Column, i: Column) -> Column:
        q = F.get(line, F.least(i + 1, F.size(line) - 1))
        ax, ay, bx, by = (p["x"] - lon) * kx, (p["y"] - lat) * ky, (q["x"] - lon) * kx, (q["y"] - lat) * ky
        dx, dy = bx - ax, by - ay
        t = F.when(dx * dx + dy * dy > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / (dx * dx + dy * dy)))).otherwise(0.0)
        return F.sqrt((ax + t * dx) * (ax + t * dx) + (ay + t * dy) * (ay + t * dy))

    return F.array_min(F.transform(line, apart))
