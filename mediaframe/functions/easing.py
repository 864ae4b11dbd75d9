"""Easing curves and interpolation as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed handle values
BEZIER = {"easeIn": (0.42, 0.0, 1.0, 1.0), "easeOut": (0.0, 0.0, 0.58, 1.0), "easeInOut": (0.42, 0.0, 0.58, 1.0)}
DEFAULT_HANDLES = (0.25, 0.1, 0.25, 1.0)


def unit_clamp(u: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), u))


def _cubic(p1, p2, t: Column) -> Column:
    """One coordinate of a cubic Bezier from 0 to 1 with inner control values p1, p2."""
    s = F.lit(1.0) - t
    return s * s * t * 3.0 * p1 + s * t * t * 3.0 * p2 + t * t * t


def cubic_bezier(x1, y1, x2, y2, x: Column) -> Column:
    """y of the curve at x. The parameter is found by halving steps (x is monotone in it)."""
    c = [F.lit(float(v)) if not isinstance(v, Column) else v for v in (x1, y1, x2, y2)]
    steps = F.transform(F.sequence(F.lit(2), F.lit(40)), lambda i: F.pow(F.lit(2.0), -i))
    t = F.aggregate(steps, F.lit(0.5), lambda acc, s: acc + F.when(_cubic(c[0], c[2], acc) < x, s).otherwise(-s))
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when((c[0] == c[1]) & (c[2] == c[3]), x).otherwise(
        F.element_at(F.transform(F.array(t), lambda p: _cubic(c[1], c[3], p)), 1))


def bounce_out(t: Column) -> Column:
    n, d = 7.5625, 2.75
    arc = lambda shift, lift: (t - shift / d) * (t - shift / d) * n + lift
    return (F.when(t < 1 / d, arc(0.0, 0.0)).when(t < 2 / d, arc(1.5, 0.75)).when(t < 2.5 / d, arc(2.25, 0.9375))
            .otherwise(arc(2.625, 0.984375)))


def elastic_out(t: Column) -> Column:
    wave = F.pow(F.lit(2.0), t * -10) * F.sin((t * 10 - 0.75) * (2 * math.pi / 3)) + 1
    return F.when(t <= 0, 0.0).when(t >= 1, 1.0).otherwise(wave)


def ease_out_back(x: Column) -> Column:
    c = 1.70158
    return F.pow(x - 1, F.lit(3.0)) * (c + 1) + F.pow(x - 1, F.lit(2.0)) * c + 1


def ease_in_out_cubic(x: Column) -> Column:
    return F.when(x < 0.5, x * x * x * 4).otherwise(F.lit(1.0) - F.pow(x * -2 + 2, F.lit(3.0)) / 2)


def ease_out_cubic(x: Column) -> Column:
    return F.lit(1.0) - F.pow(F.lit(1.0) - x, F.lit(3.0))


def ease(u: Column, easing: Column, handles: Column | None = None) -> Column:
    """Progress u through an easing name; unknown names are linear. ``handles`` is ``array<double>``."""
    c = unit_clamp(u)
    h = [F.lit(v) if handles is None else F.coalesce(F.get(handles, i), F.lit(v)) for i, v in enumerate(DEFAULT_HANDLES)]
    out = F.when(easing == "bounce", bounce_out(c)).when(easing == "elastic", elastic_out(c))
    for name, b in BEZIER.items():
        out = out.when(easing == name, cubic_bezier(*b, c))
    return out.when(easing == "bezier", cubic_bezier(*h, c)).otherwise(c)


def lerp(a: Column, b: Column, k: Column) -> Column:
    return a + (b - a) * k


def lerp_array(a: Column, b: Column, k: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + (F.coalesce(y, x) - x) * k)
