"""Geometry on ``ARRAY<ARRAY<DOUBLE>>`` point lists."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINTS = T.ArrayType(T.ArrayType(T.DoubleType()))


def _sum_edges(points: Column, last: Column, term) -> Column:
    """Sum of ``term(x1, y1, x2, y2)`` over edges 0..last-1; the edge list wraps around."""
    n = F.size(points)
    idx = F.when(last > 0, F.sequence(F.lit(0), last - 1)).otherwise(F.array().cast("array<int>"))

    def step(acc, i):
        p, q = F.get(points, i), F.get(points, (i + 1) % n)
        return acc + term(F.get(p, F.lit(0)), F.get(p, F.lit(1)), F.get(q, F.lit(0)), F.get(q, F.lit(1)))

    return F.aggregate(idx, F.lit(0.0), step)


def polygon_area(points: Column) -> Column:
    s = _sum_edges(points, F.size(points), lambda x1, y1, x2, y2: x1 * y2 - x2 * y1)
    return F.when(F.size(points) >= 3, F.abs(s) / 2.0).otherwise(F.lit(0.0))


def _hyp(x1, y1, x2, y2):
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))


def polyline_length(points: Column, closed: Column | bool = False) -> Column:
    closed = F.lit(closed) if isinstance(closed, bool) else F.coalesce(closed, F.lit(False))
    n = F.size(points)
    last = F.when(closed, n).otherwise(n - 1)
    return F.when(n >= 2, _sum_edges(points, last, _hyp)).otherwise(F.lit(0.0))


def side(points: Column, i: int, j: int) -> Column:
    p, q = F.get(points, F.lit(i)), F.get(points, F.lit(j))
    return _hyp(F.get(p, F.lit(0)), F.get(p, F.lit(1)), F.get(q, F.lit(0)), F.get(q, F.lit(1)))


def rectangle_sides(points: Column, ptm: Column) -> Column:
    """``[a, b]`` in metres when opposite sides agree within 1 cm, else null."""
    a, b, c, d = (side(points, i, (i + 1) % 4) / ptm for i in range(4))
    ok = (F.size(points) == 4) & (F.abs(a - c) <= 0.01) & (F.abs(b - d) <= 0.01)
    return F.when(ok, F.array(a, b))


def extent(points: Column, axis: int) -> Column:
    vals = F.transform(points, lambda p: F.get(p, F.lit(axis)))
    return F.array_max(vals) - F.array_min(vals)


def point_in_polygon(px: Column, py: Column, points: Column) -> Column:
    """Ray casting: odd number of crossings to the right."""
    def crosses(x1, y1, x2, y2):
        hit = ((y1 > py) != (y2 > py)) & (px < (x2 - x1) * (py - y1) / F.nullif(y2 - y1, F.lit(0.0)) + x1)
        return F.when(hit, F.lit(1.0)).otherwise(F.lit(0.0))

    return (_sum_edges(points, F.size(points), crosses) % 2) == 1


def rectangle_from_area(f: Column, u: Column) -> Column:
    """Sides with a+b = U/2 and a·b = F; null when no such rectangle exists."""
    h = u / 2.0
    disc = h * h - 4.0 * f
    root = F.sqrt(F.greatest(disc, F.lit(0.0)))
    return F.when((f > 0) & (u > 0) & (disc >= 0),
                  F.struct(((h + root) / 2.0).alias("a"), ((h - root) / 2.0).alias("b")))


def iso_perimeter(f: Column, ratio: float = 1.35) -> Column:
    """Perimeter of a rectangle of area ``f`` with the given side ratio."""
    return 2.0 * (F.sqrt(f * ratio) + F.sqrt(f / ratio))


def square_perimeter(f: Column) -> Column:
    return 4.0 * F.sqrt(f)


def outer_perimeter_estimate(slab: Column, factor: float = 1.40) -> Column:
    b = F.sqrt(slab / 1.3)
    return F.when(slab > 0, 2.0 * (b * 1.3 + b) * factor).otherwise(F.lit(0.0))


def plausible_perimeter(f: Column, u: Column) -> Column:
    """Perimeter below 98 % of the square's or above 5F+2 is discarded."""
    bad = (u < 0.98 * square_perimeter(f)) | (u > 5.0 * f + 2.0)
    return F.when(~F.coalesce(bad, F.lit(False)), u)


def _simplify(pts: list, eps: float) -> list:
    """Line simplification with an explicit stack; keeps points farther than ``eps``."""
    n = len(pts)
    if n < 3:
        return pts
    keep = [False] * n
    keep[0] = keep[-1] = True
    stack = [(0, n - 1)]
    while stack:
        a, b = stack.pop()
        (ax, ay), (bx, by) = pts[a], pts[b]
        dx, dy = bx - ax, by - ay
        norm = (dx * dx + dy * dy) ** 0.5
        far, at = -1.0, -1
        for i in range(a + 1, b):
            px, py = pts[i][0] - ax, pts[i][1] - ay
            d = abs(dx * py - dy * px) / norm if norm else (px * px + py * py) ** 0.5
            if d > far:
                far, at = d, i
        if far > eps:
            keep[at] = True
            stack += [(a, at), (at, b)]
    return [p for p, k in zip(pts, keep) if k]


@F.pandas_udf(POINTS)
def simplify(points: pd.Series, eps: pd.Series) -> pd.Series:
    """Douglas–Peucker per polygon column value."""
    return pd.Series([
        None if p is None else _simplify([[float(v) for v in q] for q in p], float(e))
        for p, e in zip(points, eps)
    ])
