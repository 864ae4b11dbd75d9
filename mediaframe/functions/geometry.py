"""Box geometry on columns. A box is four double columns x1, y1, x2, y2."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column


def box(prefix: str = "", suffix: str = "") -> Box:
    return Box(*[F.col(f"{prefix}{c}{suffix}") for c in ("x1", "y1", "x2", "y2")])


def struct_box(col: Column) -> Box:
    return Box(col["x1"], col["y1"], col["x2"], col["y2"])


def as_struct(b: Box) -> Column:
    return F.struct(b.x1.alias("x1"), b.y1.alias("y1"), b.x2.alias("x2"), b.y2.alias("y2"))


def _positive(c: Column) -> Column:
    return F.greatest(c, F.lit(0.0))


def width(b: Box) -> Column:
    return b.x2 - b.x1


def height(b: Box) -> Column:
    return b.y2 - b.y1


def area(b: Box) -> Column:
    return _positive(width(b)) * _positive(height(b))


def raw_area(b: Box) -> Column:
    return width(b) * height(b)


def intersection(a: Box, b: Box) -> Column:
    return _positive(F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)) * _positive(F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1))


def iou(a: Box, b: Box, areas: tuple[Column, Column] | None = None) -> Column:
    """``areas`` of the two boxes, where they are known: a join that works them out for each pair gets too long for the JVM to compile."""
    inter = intersection(a, b)
    size_a, size_b = areas or (area(a), area(b))
    union = size_a + size_b - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def containment(inner: Box, outer: Box) -> Column:
    """Share of ``inner`` that lies inside ``outer``."""
    return intersection(inner, outer) / F.greatest(F.lit(1e-6), raw_area(inner))


def head_in_body(a: Box, b: Box) -> Column:
    """One box at most half the other and at least 80 % inside it."""
    aa, ab = F.greatest(F.lit(1e-6), raw_area(a)), F.greatest(F.lit(1e-6), raw_area(b))
    inside = F.when(aa <= ab, containment(a, b)).otherwise(containment(b, a))
    return (F.least(aa, ab) <= F.greatest(aa, ab) * 0.5) & (inside >= 0.8)


def centre_x(b: Box) -> Column:
    return (b.x1 + b.x2) / 2


def centre_y(b: Box) -> Column:
    return (b.y1 + b.y2) / 2


def centre_distance(b: Box, w: float, h: float) -> Column:
    return F.hypot(centre_x(b) - w / 2.0, centre_y(b) - h / 2.0)


def intersects(a: Box, b: Box, tol: float = 0.0) -> Column:
    return (a.x1 < b.x2 - tol) & (a.x2 > b.x1 + tol) & (a.y1 < b.y2 - tol) & (a.y2 > b.y1 + tol)


def touches_edge(b: Box, w: float, h: float, frac: float = 0.02) -> Column:
    return (b.x1 <= frac * w) | (b.y1 <= frac * h) | (b.x2 >= w - frac * w) | (b.y2 >= h - frac * h)


def expand(b: Box, frac: float, w: float, h: float) -> Box:
    """Grow by ``frac`` of the size on each side, in whole pixels, inside the frame."""
    bw, bh = F.greatest(width(b), F.lit(1.0)), F.greatest(height(b), F.lit(1.0))
    return Box(F.greatest(F.lit(0.0), F.floor(b.x1 - bw * frac).cast("double")), F.greatest(F.lit(0.0), F.floor(b.y1 - bh * frac).cast("double")),
               F.least(F.lit(float(w)), F.ceil(b.x2 + bw * frac).cast("double")), F.least(F.lit(float(h)), F.ceil(b.y2 + bh * frac).cast("double")))


def clamp(b: Box, w: float, h: float) -> Box:
    lim = lambda c, hi: F.greatest(F.lit(0.0), F.least(F.lit(float(hi)), c))
    xa, xb, ya, yb = lim(b.x1, w), lim(b.x2, w), lim(b.y1, h), lim(b.y2, h)
    return Box(F.least(xa, xb), F.least(ya, yb), F.greatest(xa, xb), F.greatest(ya, yb))


def is_group_box(b: Box, w: float, h: float) -> Column:
    """A box around several subjects: over 55 % of the frame, or nearly full height and over 70 % wide."""
    return (raw_area(b) > 0.55 * w * h) | ((height(b) >= 0.9 * h) & (width(b) > 0.7 * w))


def is_tall(b: Box) -> Column:
    return height(b) >= F.greatest(width(b), F.lit(1e-6)) * 1.3


def head_box(b: Box) -> Box:
    """Top 45 % of a tall box, the box itself otherwise."""
    return Box(b.x1, b.y1, b.x2, F.when(is_tall(b), b.y1 + height(b) * 0.45).otherwise(b.y2))


def head_region(b: Box) -> Box:
    """Top 30 %, central 60 % of the width."""
    return Box(b.x1 + width(b) * 0.2, b.y1, b.x2 - width(b) * 0.2, b.y1 + height(b) * 0.3)


def to_centre_form(b: Box) -> tuple[Column, Column, Column, Column]:
    """Centre x, centre y, aspect, height."""
    w, h = F.greatest(width(b), F.lit(1e-6)), F.greatest(height(b), F.lit(1e-6))
    return b.x1 + w / 2, b.y1 + h / 2, w / h, h


def from_centre_form(cx: Column, cy: Column, aspect: Column, h: Column) -> Box:
    hh = F.greatest(h, F.lit(1e-6))
    w = F.greatest(aspect * hh, F.lit(1e-6))
    return Box(cx - w / 2, cy - hh / 2, cx + w / 2, cy + hh / 2)


SIDES = ("left", "right", "above", "below")


def box_side(crop: Box, dup: Box, slack: float = -1.0) -> Column:
    """Which side of ``dup`` the crop lies on; null when it overlaps by more than a pixel. The first of
    left, right, above, below wins a tie."""
    gaps = [dup.x1 - crop.x2, crop.x1 - dup.x2, dup.y1 - crop.y2, crop.y1 - dup.y2]
    best = F.greatest(*gaps)
    pick = F.when(gaps[0] == best, "left").when(gaps[1] == best, "right").when(gaps[2] == best, "above").otherwise("below")
    return F.when(best >= slack, pick)
