"""Polygons and lines held as arrays of structs (x, y): simplifying and clipping, batch by batch in pandas UDFs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

RING = "array<struct<x:double,y:double>>"


def _off(p: tuple, a: tuple, b: tuple) -> float:
    dx, dy = b[0] - a[0], b[1] - a[1]
    size = (dx * dx + dy * dy) ** 0.5
    return abs(dx * (a[1] - p[1]) - dy * (a[0] - p[0])) / size if size else ((p[0] - a[0]) ** 2 + (p[1] - a[1]) ** 2) ** 0.5


def simplify(points: list[tuple], tolerance: float) -> list[tuple]:
    """Points of a line that lie off its simpler form by more than the tolerance, ends included."""
    keep, todo = {0, len(points) - 1}, [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        far = max(range(a + 1, b), key=lambda i: _off(points[i], points[a], points[b]), default=None)
        if far is not None and _off(points[far], points[a], points[b]) > tolerance:
            keep.add(far)
            todo += [(a, far), (far, b)]
    return [points[i] for i in sorted(keep)] if points else []


def clip(ring: list[tuple], box: tuple[float, float, float, float]) -> list[tuple]:
    """The part of a convex or simple ring inside a box (x0, y0, x1, y1), one side after the other."""
    for axis, bound, sign in ((0, box[0], 1), (1, box[1], 1), (0, box[2], -1), (1, box[3], -1)):
        out: list[tuple] = []
        for i, q in enumerate(ring):
            p = ring[i - 1]
            was, now = (p[axis] - bound) * sign >= 0, (q[axis] - bound) * sign >= 0
            if was != now:
                t = (bound - p[axis]) / (q[axis] - p[axis])
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
            if now:
                out.append(q)
        ring = out
    return ring


def _each(work):
    @F.pandas_udf(RING)
    def run(rings: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else [{"x": x, "y": y} for x, y in work([(p["x"], p["y"]) for p in r])] for r in rings])

    return run


def simplified(tolerance: float):
    return _each(lambda r: simplify(r, tolerance))


def clipped(box: tuple[float, float, float, float]):
    return _each(lambda r: clip(r, box))
